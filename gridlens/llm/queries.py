"""The registered queries of the training-data operators."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridlens.llm import (
    bpe,
    cross_polytope,
    cube_mixture,
    feistel_shards,
    language_spans,
    line_rules,
    merkle,
    private_data,
    secret_scan,
    simhash,
    sorted_lists,
    token_files,
    whitening,
)
from gridlens.llm.common import documents
from gridlens.llm.oracle import oracle_sql

__all__ = ["oracle_sql", "queries"]

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(operator: Callable[..., DataFrame], *options) -> Query:
    return lambda spark, sf_dir: operator(documents(spark, sf_dir), *options)


def _on_embeddings(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Query]:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return {
        "op1_byte_bpe": _on_documents(bpe.op1_byte_bpe, ranks, public_tokenizers.PATTERN),
        "op2_line_rules": _on_documents(line_rules.op2_line_rules),
        "op3_simhash": _on_documents(simhash.op3_simhash),
        "op4_cube_mixture": _on_documents(cube_mixture.op4_cube_mixture),
        "op5_surrogates": _on_documents(private_data.op5_surrogates),
        "op6_cross_polytope": _on_embeddings(cross_polytope.op6_cross_polytope),
        "op7_token_files": _on_documents(token_files.op7_token_files, tokenizer, public_tokenizers.PATTERN),
        "op8_feistel_shards": _on_documents(feistel_shards.op8_feistel_shards),
        "op9_language_spans": _on_documents(language_spans.op9_language_spans),
        "op10_secret_scan": _on_documents(secret_scan.op10_secret_scan),
        "op11_slot_pivot": _on_documents(merkle.op11_slot_pivot),
        "op12_multiplicity_whitening": _on_embeddings(whitening.op12_multiplicity_whitening),
        "op13_sorted_lists": _on_embeddings(sorted_lists.op13_sorted_lists),
    }
