"""The permutation is one, shards are even, and places can be computed both ways."""

import zlib
from collections import Counter

import pytest

from gridlens.llm import feistel_shards as fs

SCHEMA = "doc_id long, text string, shard string, Slot int"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4097])
def test_permutation(n):
    own = fs.Permutation(n, 3)
    assert sorted(map(own, range(n))) == list(range(n))


def test_shuffles_well():
    own = fs.Permutation(10_000, 1)
    moved = [own(i) for i in range(10_000)]
    assert sum(abs(a - b) < 100 for a, b in zip(moved, moved[1:], strict=False)) < 400
    assert moved != [fs.Permutation(10_000, 2)(i) for i in range(10_000)]


@pytest.mark.parametrize("n", [1, 6, 500])
def test_places(spark, n):
    rows = [(i if i % 9 else None, "é" * (i % 7) if i % 5 else None, "s", 1) for i in range(n)] + [(3, "twin", "s", 1)] * 2
    got = [r.asDict() for r in fs.op8_feistel_shards(spark.createDataFrame(rows, SCHEMA), 5).collect()]
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted(
        (8 + len((t or "").encode()), zlib.crc32((t or "").encode())) for _, t, *_ in rows
    )
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    own = fs.Permutation(len(rows), 8)
    assert sorted(r["row_number"] for r in got) == list(range(len(rows)))
    assert all((r["shard"], r["slot"]) == (own(r["row_number"]) % 5, own(r["row_number"]) // 5) for r in got)
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["row_number"])]
    assert in_order == sorted(in_order, key=lambda i: (i is not None, i or 0))
    for shard in range(5):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (len(rows) // 5, len(rows) // 5 + 1)


def test_row_numbers_back(spark):
    places = spark.range(1000).selectExpr("cast(id % 24 as int) shard", "id div 24 slot")
    own = fs.Permutation(1000, 8)
    for row in fs.row_numbers_of(places, 1000, 24, 8).collect():
        assert own(row["row_number"]) == row["slot"] * 24 + row["shard"]


def test_empty_table(spark):
    got = fs.op8_feistel_shards(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns[:4] == ["doc_id", "size", "text_crc32", "law"]
