"""Whitening against numpy on all rows, exact whole numbers, weights, and odd rows."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, x string, Digest string, weight int"


def brute(rows, width, count=4, by_count=False):
    """{vec_id: rows} for the rows that remain, by dense linear algebra on the different vectors."""
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == width and None not in v and np.isfinite(v).all():
            kept.append((i, tuple(int(np.floor(256 * np.float64(c))) for c in v)))
    fit = sorted({x for _, x in kept})
    weights = [sum(1 for _, x in kept if x == f) if by_count else 1 for f in fit]
    n, sums = sum(weights), [sum(w * f[d] for w, f in zip(weights, fit, strict=True)) for d in range(width)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(f, sums, strict=True)] for f in fit])
    values, vectors = np.linalg.eigh((centred * np.array(weights)[:, None]).T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    z = dict(zip(fit, centred @ vectors[:, :count] / np.sqrt(values[:count]), strict=True))
    deviation = {f: sum((n * c - s) ** 2 for c, s in zip(f, sums, strict=True)) for f in fit}
    return n, deviation, z, values / values.sum(), kept


def same(found, rows, width, by_count=False):
    got = found.collect()
    n, deviation, z, explained, kept = brute(rows, width, by_count=by_count)
    count = min(4, width)
    assert len(got) == count * len(kept)
    sign = {}
    by_row = {}
    for r in got:
        by_row.setdefault(r["vec_id"], []).append(r)
    for i, x in kept:
        assert {r["component"] for r in by_row[i]} == set(range(1, count + 1))
        for r in by_row[i]:
            if deviation[x] < 2**63:
                assert r["deviation"] == deviation[x]
            k, want = r["component"], float(z[x][r["component"] - 1])
            if abs(want) > 1e-3:
                sign.setdefault(k, np.sign(want * r["whitened"]))
            assert r["n"] == n
            assert r["whitened"] * sign.get(k, 1) == pytest.approx(want, abs=1e-8)
            assert r["explained"] == pytest.approx(explained[k - 1], rel=1e-9)
    errors = {r["identity_error"] for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    same(wh.op12_multiplicity_whitening(df), [(r["vec_id"], r["embedding"]) for r in df.collect()], 64)


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * [3, 2, 1, 0.5, 0.1]).tolist(), "", "", 1) for i in range(300)]
    rows += [(1000 + i, rows[3][1], "", "", 1) for i in range(200)]
    rows += [(None, rows[4][1], "", "", 1), (4000, [0.0] * 5, "", "", 1), (4001, [-0.0] * 5, "", "", 1)]
    odd = [None, [1.0, None, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [1.0, 2.0], []]
    return rows + [(3000 + i, v, "", "", 1) for i, v in enumerate(odd)] + [rows[9], rows[9]]


def test_repeated_and_odd_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same(wh.op12_multiplicity_whitening(df), rows, 5)
    same(wh.whiten(df, weight=F.col("multiplicity")), rows, 5, by_count=True)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=3) * [1e11, 1e9, 1e7]).tolist(), "", "", 1) for i in range(40)]
    got = wh.op12_multiplicity_whitening(spark.createDataFrame(rows, SCHEMA))
    same(got, rows, 3)
    assert got.where("deviation is null").count() > 0


def test_without_variance(spark):
    one = wh.op12_multiplicity_whitening(spark.createDataFrame([(1, [0.5, 1.0], "", "", 1), (2, [0.5, 1.0], "", "", 1)], SCHEMA)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one) == [
        (i, c, 1, 0, None, None, None) for i in (1, 2) for c in (1, 2)
    ]
    flat = wh.op12_multiplicity_whitening(spark.createDataFrame([(i, [i / 8, 1.0], "", "", 1) for i in range(4)], SCHEMA)).collect()
    assert all((r["whitened"] is None, r["explained"]) == ((True, 0) if r["component"] == 2 else (False, 1)) for r in flat)
    assert {round(r["identity_error"], 9) for r in flat} == {0}
    assert wh.op12_multiplicity_whitening(spark.createDataFrame([], SCHEMA)).collect() == []
    assert wh.op12_multiplicity_whitening(spark.createDataFrame([(1, [], "", "", 1)], SCHEMA)).collect() == []
