"""Fingerprints, links and components against plain versions over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from gridlens.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint int, Key string"


def plain_fingerprint(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def test_whole_operator(spark):
    rng = random.Random(2)
    vocabulary = ["Über", "tHe", "İ", "K", " ", *(f"w{i}" for i in range(300))]
    texts = [None, "", " \n", "One", "one", "a b c", "A  B\tC", "d e f g"]
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.randint(100, 700))
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append(" ".join(near))
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, t, 1, "k") for i, t in zip(order, texts, strict=True)] + [(order[5], texts[5], 2, "k"), (None, "solo text", 2, "k")]
    got = {(r[0], r[1], r[2]) for r in simhash.op3_simhash(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(prints)
    least = {}
    for (doc_id, *_), root in zip(rows, roots, strict=True):
        if doc_id is not None:
            least[root] = min(doc_id, least.get(root, doc_id))
    assert got == {(row[0], f"{p:016x}", least.get(r)) for row, p, r in zip(rows, prints, roots, strict=True)}
    assert 20 < len(set(roots)) < len(rows) - 50


@pytest.mark.parametrize("kind", ["spread", "tight", "mixed"])
def test_tree_against_all_pairs(kind):
    rng = random.Random(kind)
    centres = [rng.getrandbits(64) for _ in range({"spread": 900, "tight": 1, "mixed": 12}[kind])]
    points = set(centres)
    while len(points) < 1400:
        c = rng.choice(centres)
        for _ in range(rng.randint(1, 7)):
            c ^= 1 << rng.randrange(64)
        points.add(c)
    points = sorted(points)
    found = simhash.linked_within(np.array(points, np.uint64)[:, None], 4).root.tolist()
    assert found == plain_components(points)


def test_large_shards_are_dealt_again(spark):
    rng = random.Random(5)
    points = set()
    for _ in range(6):
        c = rng.getrandbits(64)
        points |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), max_shard=5)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    plain = plain_components(points)
    for i in range(len(points)):
        for j in range(i):
            together = roots.get(signed[i], signed[i]) == roots.get(signed[j], signed[j])
            assert together == (plain[i] == plain[j])


def clustered(rng, clusters, size):
    points = set()
    for _ in range(clusters):
        c = rng.getrandbits(64)
        while len(points) % size or not points or len(points) // size <= _:
            points.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))))
            if len(points) >= size * (_ + 1):
                break
    return sorted(points)


def test_branches_are_pruned():
    rng = random.Random(11)
    for points in (clustered(rng, 40, 50), sorted({rng.getrandbits(64) for _ in range(2000)})):
        forest = simhash.linked_within(np.array(points, np.uint64)[:, None], 4)
        assert forest.compared < 0.5 * len(points) ** 2 / 2
        assert forest.root.tolist() == plain_components(points)


def test_shards_without_bits_left_are_cut_by_rings(spark):
    rng = random.Random(12)
    points = clustered(rng, 6, 60)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    rows = spark.createDataFrame([(0, 0, p) for p in signed], "mask long, value long, fingerprint long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash._ring_links(rows, 4, 20)).collect()}
    plain = plain_components(points)
    names = [roots.get(p, p) for p in signed]
    assert len(set(zip(plain, names, strict=True))) == len(set(plain)) == len(set(names))


def test_long_chain(spark):
    edges = spark.range(200).selectExpr("id * 7 % 1000 - 300 low", "(id + 1) * 7 % 1000 - 300 high")
    roots = {r["root"] for r in simhash.components(edges).collect()}
    assert len(roots) == 1


def test_empty_table(spark):
    got = simhash.op3_simhash(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["doc_id", "fingerprint", "component_id"]
