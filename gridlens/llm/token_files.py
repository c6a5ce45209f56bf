"""Token ids of documents in files of rANS segments, in ascending order of the documents' keys.

A file is a Parquet table of segments: shard, segment, first_id (ids of the shard before it), n_ids, keys and lengths of
its documents, and the coded ids. A shard is one range of keys, so shards in turn are the whole order; a reader of any
segment knows its documents, and each segment can be read alone. Segments close at the first document's end
from segment_ids ids on, so a task holds one segment.

Null texts are empty, and every document ends with end_id. Rows without key come first; rows of one key are in order of
their texts, null first. An empty table gives an empty file.
"""

import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.llm import rans
from gridlens.llm.common import small_batches, to_batches
from gridlens.session import scratch_path

SEGMENT_IDS = 1 << 21
KEPT_WORDS = 1_000_000
#: Libraries agree on what is a letter below the first of these code points.
PLAIN_BELOW = "\u0250"
#: Signs that no pattern joins to the letters before them.
MARKS = frozenset(".,;:!?")
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]
#: The letter that stands for a space.
SPACE = "\u0120"


def byte_letters() -> dict[int, str]:
    """How byte-level files write bytes: visible ones of Latin-1 as themselves, the others as the letters from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(0x100 + n) for n, b in enumerate(others)}


class _Kept(dict):
    """Ids of strings met, made when missing; emptied when it holds KEPT_WORDS."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, string: str) -> bytes:
        ids = self.make(string)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[string] = ids
        return ids


class Tokens:
    """Ids by a file of the tokenizers library, as its encode gives them without special tokens around; texts with a string of an added token go
    to the library whole.

    A byte-level file whose pattern is given cuts texts before spaces unless these belong to a run of white space, so a word's
    ids do not depend on its neighbours. Ids of words met are kept, up to a number of words. A new word of plain letters is cut by
    the pattern and its pieces go to the library's model; all other words, and texts with runs of spaces, go to
    the library whole.
    """

    def __init__(self, path: str, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        form = json.loads(self.library.to_str())
        step = form.get("pre_tokenizer") or {}
        self.by_words = bool(pattern) and not form.get("normalizer") and step.get("type") == "ByteLevel"
        self.by_words = self.by_words and step.get("use_regex", True) and not step.get("add_prefix_space")
        self.odd_space = regex.compile(r" (?:\s|\Z)")
        self.pattern = regex.compile(pattern or "")
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.tokenize = self.library.model.tokenize
        self.words = _Kept(self._word)
        self.pieces = _Kept(lambda piece: self._tokenized(piece.encode().decode("latin-1").translate(self.letters)))

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def _tokenized(self, letters: str) -> bytes:
        ids = [t.id for t in self.tokenize(letters)]
        return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        """A piece after a space is a word of its own."""
        if piece[0] == " " and len(piece) > 1 and piece[1:].isalpha():
            return self.words[piece[1:]]
        return self.pieces[piece]

    def _word(self, word: str) -> bytes:
        """Ids of a word after a space."""
        if word.isascii():
            if word.isalpha():
                return self._tokenized(SPACE + word)
            if word[-1:] in MARKS and word[:-1].isalpha():
                return self.words[word[:-1]] + self._piece(word[-1])
        elif max(word) >= PLAIN_BELOW:
            return self._encode([" " + word])[0]
        elif word.isalpha():
            return self.pieces.make(" " + word)
        return b"".join(map(self._piece, self.pattern.findall(" " + word)))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text."""
        out, whole = [b""] * len(texts), []
        for i, text in enumerate(texts):
            if text:
                if self.by_words and not self.odd_space.search(text) and not any(added in text for added in self.added):
                    first, *words = text.split(" ")
                    out[i] = self._encode([first])[0] + b"".join(map(self.words.__getitem__, words))
                else:
                    whole.append(i)
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=1)
def tokens(path: str, pattern: str | None) -> Tokens:
    return Tokens(path, pattern)


def segments(
    docs: DataFrame, tokenizer: str, pattern: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text",
    segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """One row for each segment, as the file has it. pattern: the one by which a byte-level tokenizer cuts texts."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = narrow.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(tokenizer, pattern)
        end = np.array([end_id], "<u4").tobytes()
        schema = None
        keys, lengths, held = [], [], []
        segment = before = n_held = 0

        def closed():
            nonlocal keys, lengths, held, segment, before, n_held
            ids = np.frombuffer(b"".join(held), "<u4")
            row = (TaskContext.get().partitionId(), segment, before, len(ids), keys, lengths, rans.encode_segment(ids))
            keys, lengths, held, n_held = [], [], [], 0
            segment, before = segment + 1, before + len(ids)
            return to_batches([row], schema)

        for batch in batches:
            fields = [("shard", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64())]
            fields += [("keys", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("coded", pa.binary())]
            schema = pa.schema(fields)
            for name, ids in zip(batch.column(0).to_pylist(), own.ids(batch.column(1).to_pylist()), strict=True):
                keys.append(name)
                held += [ids, end]
                lengths.append(len(ids) // 4 + 1)
                n_held += lengths[-1]
                if n_held >= segment_ids:
                    yield from closed()
        if keys:
            yield from closed()

    columns = f"shard int, segment int, first_id long, n_ids long, keys array<{kind}>, lengths array<bigint>, coded binary"
    return narrow.repartitionByRange("key").sortWithinPartitions("key", "text").mapInArrow(run, columns)


def write(docs: DataFrame, tokenizer: str, path: str, **options: object) -> None:
    """Files of segments(docs, tokenizer, **options)."""
    # coded ids cannot be packed any further
    segments(docs, tokenizer, **options).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, start (ids of all documents before) and ids (packed) of every document of the files."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("size"))
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # one row for each range of keys, so its size is bounded by a setting
    firsts = sizes.select(F.col("shard").alias("of"), F.coalesce(before, F.lit(0)).alias("shard_first"))
    kind = files.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, at, keys, lengths, coded = (batch.column(i)[row] for i in range(5))
                ids = rans.decode_segment(coded.as_py()).astype("<u4")
                ends = np.cumsum(lengths.values.to_numpy())
                starts = np.concatenate([[0], ends[:-1]])
                # the documents' ids are slices of the segment's
                offsets = (4 * np.concatenate([starts, ends[-1:]])).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                columns = [pa.array(np.full(len(ends), shard.as_py(), np.int32)), pa.array(at.as_py() + starts), keys.values, packed]
                yield pa.record_batch(columns, names=["shard", "in_shard", "key", "ids"])

    small_batches(spark)
    read_rows = files.select("shard", "first_id", "keys", "lengths", "coded")
    found = read_rows.mapInArrow(run, f"shard int, in_shard long, key {kind}, ids binary")
    placed = found.join(F.broadcast(firsts), F.col("shard") == F.col("of"))
    return placed.select("key", (F.col("shard_first") + F.col("in_shard")).alias("start"), "ids")


def op7_token_files(docs: DataFrame, tokenizer: str, pattern: str | None = None) -> DataFrame:
    path = scratch_path(docs.sparkSession, "token-files")
    write(docs, tokenizer, path, pattern=pattern)
    found = read(docs.sparkSession, path)
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select(F.col("key").alias("doc_id"), "start", n.alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))
