"""Ids against the library that defines them, digests against hashlib, and long pieces."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from gridlens.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, ids string, decoded int"


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    rng = random.Random(1)
    parts = ["a", "é", "the", " ", "  ", "\n", " \n ", "\t", "'s", "it's", "漢字", "😀", "123", "!!", " ", "\x1c", "\u0085",
             " ", "ß", "́", "x" * 40, "<|endoftext|>", "\x00", "​"]
    made = ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(400)]
    return [None, "", " ", "\n", "a" * 20_000, "ab" * 9_000 + " c", *made, *made[:3]]


def test_ids_and_bytes(spark, library):
    rows = [(None if i == 7 else i, t, "clash", 1) for i, t in enumerate(texts())]
    coded = bpe.op1_byte_bpe(spark.createDataFrame(rows, SCHEMA), PATH, PATTERN)
    assert coded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digests(row):
        ids = library.encode_ordinary(row[1] or "")
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        plain = (row[1] or "").encode()
        return row[0], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(plain).hexdigest()

    assert sorted(map(tuple, coded.collect()), key=repr) == sorted(map(digests, rows), key=repr)


def test_decode_alone(spark, library):
    df = spark.createDataFrame([(1, "und the\n\n  rest"), (2, None)], "doc_id long, text string")
    ids = bpe.encode(df, PATH, PATTERN)
    assert dict(map(tuple, bpe.decode(ids, PATH, PATTERN).collect())) == {1: b"und the\n\n  rest", 2: b""}


def test_empty_table(spark):
    assert bpe.op1_byte_bpe(spark.createDataFrame([], SCHEMA), PATH, PATTERN).collect() == []


def test_bounded_memory_of_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 3)
    own = bpe.Codec(PATH, PATTERN)
    text = "one two three four five two one six " * 5 + "end"
    assert own.encode(text) == b"".join(i.to_bytes(4, "little") for i in library.encode_ordinary(text))
    assert len(own.words) <= 3 and len(own.pieces) <= 3


def test_word_before_a_mark_is_merged_once(library, monkeypatch):
    calls, merged = [], bpe.merged
    monkeypatch.setattr(bpe, "merged", lambda piece, *tables: calls.append(piece) or merged(piece, *tables))
    own, text = bpe.Codec(PATH, PATTERN), "a zzyqx zzyqx, zzyqx. zzyqx's zzyqx.. " + "zq" * 16 + " " + "zq" * 17
    assert own.encode(text) == bpe.packed(library.encode_ordinary(text))
    assert calls.count(b" zzyqx") <= 2  # as a word, and as a piece of the odd words
