"""Byte-level BPE with ranked merges, encoding and decoding.

A text is split by a pattern; each piece starts as single bytes, and the pair of neighbours with the lowest rank is
joined, the leftmost of equals, until no neighbours form a token. A segment tree over the byte positions of a piece holds
rank * length + position of the pair that starts there, so its root is the leftmost pair of minimal rank. A merge
changes three leaves and the nodes above them; a piece of n bytes takes O(n log n), even one of a million letters. Pieces of
up to SHORT bytes, nearly all, need no tree: the least of a short list is found faster by looking through it.

Most words recur, so a task keeps the ids of words and pieces it has met, up to a number of entries; then it starts anew.
That changes speed only. Null and empty texts give no ids. Ids are kept as little-endian unsigned 32-bit integers.
"""

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.common import small_batches, to_batches

KEPT_WORDS = 400_000
#: Signs that a pattern may cut off the letters before them.
MARKS = ".,;:!?"
NO_PAIR = 1 << 62
WIDTH = 16
SHORT = 32


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _merged_short(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of a short piece that is no token: values has the rank of each token joined with the next one."""
    starts, rank_of = list(range(len(piece) + 1)), ranks.get
    values = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:], strict=False)]
    while values and (best := min(values)) < NO_PAIR:
        i = values.index(best)
        del starts[i + 1]
        if i + 1 < len(values):
            del values[i + 1]
            values[i] = rank_of(piece[starts[i] : starts[i + 2]], NO_PAIR)
        else:
            values.pop()
        if i:
            values[i - 1] = rank_of(piece[starts[i - 1] : starts[i + 1]], NO_PAIR)
    return [ranks[piece[a:b]] for a, b in zip(starts, starts[1:], strict=False)]


def merged(piece: bytes, ranks: dict[bytes, int], pairs: list[int]) -> list[int]:
    """Ids of one piece; pairs has the ranks of all pairs of bytes. The tree has WIDTH children at each node; `levels` runs from its leaves to the node below the root."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) <= SHORT:
        return _merged_short(piece, ranks, pairs)
    n, rank_of = len(piece), ranks.get
    # a pair that is no token has a value of NO_PAIR or more
    leaves = [pairs[a << 8 | b] * n + i for i, (a, b) in enumerate(zip(piece, piece[1:], strict=False))]
    levels = [leaves]
    while len(below := levels[-1]) > WIDTH:
        levels.append([min(below[i : i + WIDTH]) for i in range(0, len(below), WIDTH)])
    top, tall = levels[-1], len(levels) > 1
    end = list(range(1, n + 1))  # of the token that starts here
    before = list(range(-1, n))  # the start of the token before the one that starts here
    while (best := min(top)) < NO_PAIR:
        left = best % n
        right = end[left]
        stop = end[left] = end[right]
        before[stop] = left
        if right < n - 1:
            leaves[right] = NO_PAIR
        rank = rank_of(piece[left : end[stop]]) if stop < n else None
        leaves[left] = NO_PAIR if rank is None else rank * n + left
        first = before[left]
        if first >= 0:
            rank = rank_of(piece[first:stop])
            leaves[first] = NO_PAIR if rank is None else rank * n + first
        if tall:
            nodes = {first // WIDTH if first >= 0 else left // WIDTH, left // WIDTH, min(right, n - 2) // WIDTH}
            for below, above in zip(levels, levels[1:], strict=False):
                for node in nodes:
                    above[node] = min(below[node * WIDTH : node * WIDTH + WIDTH])
                nodes = {node // WIDTH for node in nodes}
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class _Known(dict):
    """Packed ids of strings met, made by a function when missing; emptied when it holds KEPT_WORDS."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, string: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        ids = self[string] = self.encode(string)
        return ids


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    """Encodes and decodes with one rank file and one pattern."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        # a space that is not followed by a word belongs to a run of white space
        self.odd_space = regex.compile(r" (?:\s|\Z)")
        # whether the pattern keeps a space and the letters after it together
        self.letters_join = self.pattern.findall(" Aaz") == [" Aaz"]
        # signs that it leaves to themselves after letters
        self.marks = {mark for mark in MARKS if self.pattern.findall(f" Aaz{mark}") == [" Aaz", mark]} if self.letters_join else set()
        self.pairs = [self.ranks.get(bytes(divmod(i, 256)), NO_PAIR) for i in range(1 << 16)]
        self.pieces = _Known(lambda piece: packed(merged(piece.encode(), self.ranks, self.pairs)))
        self.words = _Known(self._word)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def _word(self, word: str) -> bytes:
        """A word and the space before it."""
        if self.letters_join and word.isascii():
            if word.isalpha():
                return packed(merged((" " + word).encode(), self.ranks, self.pairs))
            if word[-1:] in self.marks and word[:-1].isalpha():
                return self.words[word[:-1]] + self.pieces[word[-1]]
        return self._pieces(" " + word)

    def encode(self, text: str | None) -> bytes:
        """Where each space is followed by a word, cutting before spaces cuts between matches of the pattern."""
        if not text:
            return b""
        if self.odd_space.search(text):
            return self._pieces(text)
        first, *words = text.split(" ")
        return self._pieces(first) + b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _mapped(df: DataFrame, key: str, value: str, path: str, pattern: str, outputs: dict[str, str]) -> DataFrame:
    """One pass over (key, value); outputs names the results: encode, decode or both in turn."""
    small_batches(df.sparkSession)
    narrow = df.select(key, value)
    key_type = narrow.schema[key].dataType.simpleString()
    wanted = list(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)

        def rows():
            for batch in batches:
                for name, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if wanted == ["decode"]:
                        yield name, own.decode(given)
                    else:
                        ids = own.encode(given)
                        yield (name, ids) if wanted == ["encode"] else (name, ids, own.decode(ids))

        first = next(batches, None)
        if first is None:
            return
        types = [first.schema.field(0), *(pa.field(n, pa.binary()) for n in outputs.values())]
        batches = _chain(first, batches)
        yield from to_batches(rows(), pa.schema(types))

    schema = ", ".join([f"`{key}` {key_type}", *(f"`{n}` binary" for n in outputs.values())])
    return narrow.mapInArrow(run, schema)


def _chain(first, rest):
    yield first
    yield from rest


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (binary) of every text."""
    return _mapped(df, key, text, path, pattern, {"encode": "ids"})


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and decoded (the bytes that the ids stand for)."""
    return _mapped(df, key, ids, path, pattern, {"decode": "decoded"})


def encode_and_decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids and decoded in one pass, the decoded bytes made from the ids."""
    return _mapped(df, key, text, path, pattern, {"encode": "ids", "decode": "decoded"})


def op1_byte_bpe(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    coded = encode_and_decode(docs, path, pattern)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
