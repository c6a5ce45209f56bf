"""Exact results against all pairs, ties and rows that take no part, and how far lists are read."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridlens.llm import sorted_lists as sl
from gridlens.llm import whole_vectors as wv

SCHEMA = "vec_id long, embedding array<double>, x string, Rep string, score int"


def brute(rows, k, step, width):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == width and None not in v and np.isfinite(v).all():
            usable[i] = [int(np.floor(256 * np.float64(c))) for c in v]
    found = []
    for q in (i for i in usable if i % step == 0):
        scored = sorted((-sum(a * b for a, b in zip(usable[q], x, strict=True)), i) for i, x in usable.items() if i != q)
        found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return found


def same(df, rows, width, k=5, step=50, **options):
    got = [(r["query_id"], r["rank"], r["vec_id"], int(r["score"])) for r in sl.search(df, F.col("id") % step == 0, k, **options).collect()]
    assert sorted(got) == sorted(brute(rows, k, step, width))


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    same(df, [(r["vec_id"], r["embedding"]) for r in df.collect()], 64)


def test_small_pieces_ties_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, np.exp(rng.normal(0, 1.5) * (i % 2)) * rng.normal(size=6), "", "", 1) for i in range(400)]
    rows = [(i, v.tolist(), *rest) for i, v, *rest in rows]
    rows += [(1000 + i, rows[50][1], "", "", 1) for i in range(40)] + [(2000 + i, [1.0] + [0.0] * 5, "", "", 1) for i in range(30)]
    odd = [None, [0.0] * 6, [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1.0, 2.0], []]
    rows += [(3000 + 50 * i, v, "", "", 1) for i, v in enumerate(odd)]
    rows += [rows[7], rows[50], (None, rows[0][1], "", "", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same(df, rows, 6)
    same(df, rows, 6, piece_components=60, block=3)
    same(df, rows, 6, k=600)


def test_very_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(0, 13)).tolist(), "", "", 1) for i in range(150)]
    df = spark.createDataFrame(rows, SCHEMA)
    same(df, rows, 4, piece_components=160)
    beyond = [(r["vec_id"], r["score"]) for r in sl.op13_sorted_lists(spark.createDataFrame([(0, [1e300], "", "", 1), (1, [-1e300], "", "", 1)], SCHEMA)).collect()]
    assert beyond == [(1, -(2**63))]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5], "", "", 1), (1, [0.5, -0.25], "", "", 1)], SCHEMA)
    got = sl.op13_sorted_lists(df)
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:bigint>"
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 256 * 128 - 128 * 64)]
    assert sl.op13_sorted_lists(spark.createDataFrame([(0, [1.0], "", "", 1)], SCHEMA)).collect() == []
    assert sl.op13_sorted_lists(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lists_are_left_early_where_scores_differ():
    rng = np.random.default_rng(5)
    rows = (rng.normal(size=(4000, 16)) * 256 * np.exp(rng.normal(0, 1, (4000, 1)))).astype(np.int64)
    piece = sl.Piece(rows, np.arange(4000))
    exact = rows @ rows[:20].T
    want = [sorted(range(4000), key=lambda i: (-column[i], i))[:6] for column in exact.T]
    found = list(piece.best(rows[:20], np.full(20, -np.inf), 6))
    for (ids, scores), wanted, column in zip(found, want, exact.T, strict=True):
        assert ids.tolist() == wanted and scores.tolist() == column[wanted].tolist()
    assert piece.read < 0.5 * 20 * rows.size
    floors = np.array([column[wanted[3]] for wanted, column in zip(want, exact.T, strict=True)], float)
    read = piece.read
    for (ids, _), wanted in zip(piece.best(rows[:20], floors, 6), want, strict=True):
        assert ids.tolist()[:4] == wanted[:4]
    assert piece.read - read <= read


def test_packed_rows_come_back():
    rows = np.array([[0, -128], [127, 128], [-32769, 5], [2**40, -(2**63)], [-1, 2**63 - 1]])
    as_bytes = wv.packed(rows)
    assert (wv.unpacked(pa.array(as_bytes)) == rows).all() and [b[0] for b in as_bytes] == [1, 2, 4, 8, 8]
