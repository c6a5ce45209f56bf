"""Recall against brute force, exact scores and ties, and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import cross_polytope as cp

SCHEMA = "vec_id long, embedding array<float>, rank string, v string, Score int"


def brute(rows, k, step):
    usable = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in (i for i in usable if i % step == 0):
        scored = sorted(((-float((usable[q] * v).sum()), i) for i, v in usable.items() if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert len(out[r["query_id"]]) == r["rank"]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = answers(cp.op6_cross_polytope(df))
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()], 20, 20)
    assert got.keys() == want.keys()
    assert recall(got, want) >= 0.9


def test_exact_with_all_probes_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1 + i % 3, 6).astype(np.float32).tolist(), "", "", 1) for i in range(300)]
    same = rows[40][1]
    rows += [(1000 + i, same, "", "", 1) for i in range(60)]
    rows += [(400, None, "", "", 1), (420, [0.0] * 6, "", "", 1), (440, [1.0, None, 1.0, 1.0, 1.0, 1.0], "", "", 1), (None, same, "", "", 1)]
    rows += [(460, [float("nan")] * 6, "", "", 1), (480, [float("inf")] * 6, "", "", 1), (500, [1.0, 2.0], "", "", 1), rows[5], rows[5]]
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(cp.search(df, F.col("id") % 20 == 0, k=20, tables=1, probes=16, max_bucket=10, head=30))
    usable = [r for r in dict((r[0], r) for r in rows).values() if r[0] != 500]
    want = brute(usable, 20, 20)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in w], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("kind", ["sigma 0.5", "sigma 1", "outlier"])
def test_recall_on_uneven_norms(spark, kind):
    rng = np.random.default_rng(3)
    rows = [r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()]
    scale = np.exp(rng.normal(0, float(kind.split()[-1]), len(rows))) if kind != "outlier" else np.where(np.arange(len(rows)) == 7, 20, 1)
    made = [(i, (np.array(v) * s).astype(np.float32).tolist(), "", "", 1) for i, (v, s) in enumerate(zip(rows, scale.tolist(), strict=True))]
    df = spark.createDataFrame(made, SCHEMA)
    got = answers(cp.search(df, F.col("id") % 20 == 0, head=30))
    want = brute(made, 20, 20)
    assert all(len(got[q]) == 20 for q in want)
    assert recall(got, want) >= 0.9


def test_fewer_rows_than_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "", "", 1), (1, [0.5, 0.5], "", "", 1)], SCHEMA)
    assert answers(cp.search(df, F.col("id") % 20 == 0, probes=8)) == {0: [(1, 0.5)]}
    assert cp.op6_cross_polytope(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rotation_keeps_lengths():
    rows = np.random.default_rng(1).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(cp.rotated(rows, 3), axis=1), np.linalg.norm(rows, axis=1))
