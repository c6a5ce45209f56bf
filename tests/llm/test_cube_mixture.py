"""Targets against sharing in rounds, balance of the draw, and reruns."""

import random
from collections import defaultdict

import numpy as np
import pytest

from gridlens.llm import cube_mixture as cm

SCHEMA = "doc_id long, text string, source string, Size string, taken int"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, still, rest = dict.fromkeys(names, 0.0), [n for n in names if sizes[n]], share * sum(sizes.values())
    while still and rest > 1e-9:
        part = rest / sum(weight[n] for n in still)
        for n in still:
            target[n] += part * weight[n]
        rest = sum(max(0, target[n] - limit * sizes[n]) for n in still)
        for n in still:
            target[n] = min(target[n], limit * sizes[n])
        still = [n for n in still if target[n] < limit * sizes[n]]
    return target


def made(seed, n, sources):
    rng = random.Random(seed)
    rows = [
        (i, " ".join("w" * rng.randint(1, 4) for _ in range(int(rng.lognormvariate(3, 1)))), rng.choice(sources), "s", 1) for i in range(n)
    ]
    return rows + [(None, "three words here", None, "s", 1), (n, None, "a", "s", 1), (n + 1, "", "b", "s", 1), (0, "twin row", "a", "s", 1)] * 2


@pytest.mark.parametrize("group_rows", [20_000, 40])
def test_mixture(spark, group_rows):
    rows = made(3, 3000, ["a", "a", "a", "a", "b", "c", "é", "😀", None])
    df = spark.createDataFrame(rows, SCHEMA)
    got = cm.mixture(df, group_rows=group_rows).collect()
    again = cm.mixture(df.repartition(7), group_rows=group_rows).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(rows)
    sizes, taken, picked, expected = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        picked[r["source"]] += r["taken"] // r["size"] if r["size"] else 0
        expected[r["source"]] = r["target"]
        assert r["size"] == 0 or r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["size"] or r["taken"] == 0
    plain = plain_targets(sizes)
    assert sum(expected.values()) == pytest.approx(1.5 * sum(sizes.values()))
    counts = defaultdict(int)
    for r in got:
        counts[r["source"]] += r["size"] > 0
        assert r["source_size"] == sizes[r["source"]]
    for name in sizes:
        assert expected[name] == pytest.approx(plain[name])
        assert abs(taken[name] - plain[name]) <= max(r["size"] for r in got if r["source"] == name)
        assert abs(picked[name] - plain[name] / sizes[name] * counts[name]) <= 3


def test_flight_keeps_both_sums_and_chances():
    rng = np.random.default_rng(1)
    sizes, chances = rng.integers(1, 500, 30), rng.random(30)
    total = np.zeros(30)
    for _ in range(3000):
        moved = cm.flight(sizes, chances, rng.random(30))
        assert moved.sum() == pytest.approx(chances.sum()) and moved @ sizes == pytest.approx(chances @ sizes)
        assert ((moved > 0) & (moved < 1)).sum() <= 2
        total += moved
    assert np.abs(total / 3000 - chances).max() < 0.05


def test_landing_makes_up_what_is_missing():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes, chances = rng.integers(1, 900, 60).astype(float), np.full(60, 0.4)
        moved = cm.flight(sizes, chances, rng.random(60))
        ended = cm.landing(sizes, moved)
        assert set(ended.tolist()) <= {0, 1} and abs(ended.sum() - 24) <= 1
        assert abs(ended @ sizes - chances @ sizes) <= 30


def test_equal_sizes():
    moved = cm.landing(np.full(100, 7), cm.flight(np.full(100, 7), np.full(100, 0.3), np.random.default_rng(2).random(100)))
    assert set(moved.tolist()) == {0, 1} and abs(moved.sum() - 30) <= 1


def test_empty_table_and_empty_texts(spark):
    assert cm.op4_cube_mixture(spark.createDataFrame([], SCHEMA)).collect() == []
    got = cm.op4_cube_mixture(spark.createDataFrame([(1, None, None, "", 0), (2, " ", "a", "", 0)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0, 0)] * 2
