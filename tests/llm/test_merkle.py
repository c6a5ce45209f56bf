"""Trees against a plain builder, proofs of every row, tampering, and odd rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gridlens.llm import merkle as mk

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, Group string, digest int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes, fanout):
    """The root and for each node the runs of siblings left and right of its way up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for m, i in enumerate(at):
            run = runs[i // fanout]
            paths[m].append((run[: i % fanout], run[i % fanout + 1 :]))
            at[m] = i // fanout
        nodes = [h(*run) for run in runs]
    return nodes[0], paths


def brute(rows, fanout=3):
    hashed = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups, found = {}, []
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, hashed(r[:5]), r[:5]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = [(sorted(groups[s], key=lambda r: r[:3]), *tree([r[2] for r in sorted(groups[s], key=lambda r: r[:3])], fanout)) for s in names]
    if not built:
        return []
    root, tops = tree([subroot for _, subroot, _ in built], fanout)
    for (members, subroot, paths), top in zip(built, tops, strict=True):
        for (_, _, leaf, r), path in zip(members, paths, strict=True):
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = hashed((*r[:4], r[4].replace("\n", ""))) if chosen else leaf
            for left, right in path + top:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in path + top for x in left + right))
            found.append((r[0], leaf, subroot, root, proof, node, node == root))
    return found


def same(df, rows):
    got = [tuple(r) for r in mk.op11_slot_pivot(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    return got


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_documents_of_the_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = same(df, [tuple(r) for r in df.select(*mk.COLUMNS).collect()])
    assert {r[-1] for r in got} == {True, False}


def test_sizes_around_every_level_and_odd_rows(spark):
    rows = []
    for s, n in enumerate([1, 2, 3, 4, 9, 10, 26, 27, 28, 30, 81, 82, 244, 730]):
        rows += [(len(rows) + i, f"s{s}é", None, i, f"a\n{i}", "x", 1) for i in range(n)]
    rows += [(5, None, None, None, None, "x", 1), (None, None, "en", 3, "b\n", "x", 1), (None, "", "en", 3, "b\n", "x", 1)]
    rows += [(7, "s3é", None, 1, "a\nb" * 100_000, "x", 1), (8, "s3é", None, 1, "", "x", 1)] + rows[20:60] + rows[:2]
    same(spark.createDataFrame(rows, SCHEMA).repartition(5), rows)


def test_many_groups_one_row_and_no_row(spark):
    rows = [(i, f"source {i}", "en", 1, "a\nb", "x", 1) for i in range(100)]
    same(spark.createDataFrame(rows, SCHEMA), rows)
    got = same(spark.createDataFrame(rows[:1], SCHEMA), rows[:1])
    assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == h()
    assert mk.op11_slot_pivot(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(("fanout", "height"), [(2, 1), (2, 5), (5, 2)])
def test_any_fanout_and_height(spark, fanout, height):
    rows = [(i, f"s{i % 7 and 1}", "en", i, f"{i}", "x", 1) for i in range(200)]
    leaves = mk.document_leaves(spark.createDataFrame(rows, SCHEMA))
    got = mk.manifest(leaves, ["doc_id"], fanout, height).withColumn("folded", mk.folded(F.col("leaf"), "path")).collect()
    want = {r[0]: r[1:5] for r in brute(rows, fanout)}
    proofs = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], h(*(s["left"] + s["right"] for s in r["path"]))) for r in got}
    assert proofs == want and all(r["folded"] == r["root"] for r in got)


def test_a_foreign_leaf_does_not_fold_to_the_root(spark):
    rows = [(i, "s", "en", i, f"{i}", "x", 1) for i in range(40)]
    made = mk.manifest(mk.document_leaves(spark.createDataFrame(rows, SCHEMA)), ["doc_id"])
    other = made.withColumn("folded", mk.folded(F.sha2(F.col("leaf"), 256), "path"))
    assert other.where("folded = root").count() == 0
