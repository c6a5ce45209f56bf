"""Merkle manifest of a dataset: a hash tree per group of rows, a tree over the groups, and a proof for every row.

Slot pivot: the nodes of one level are grouped by parent, and conditional aggregates spread the children of each parent into
one column per slot. The columns joined together hash to the parent; leaving out the own slot leaves the siblings. One
grouping takes HEIGHT levels at once: its slots are the fanout ** HEIGHT lowest nodes, and the levels above them are further columns
of the same row. So a tree of n leaves needs log(n) / (HEIGHT log(fanout)) groupings, each on a table smaller by that factor, and
its rows join their proofs by the same key, at most fanout ** HEIGHT rows to one.

Leaves are numbered by one range shuffle of narrow rows (group, order columns, leaf) that are written first: no
group is gathered, a group of any size spans many tasks. Texts are read once and only hashed.

Nulls: a null value is encoded as "-"; null groups come first, so do null order values. Rows of equal order
value follow by their digest; equal rows have equal leaves, take neighbouring slots and are interchangeable. A group of one row has its
leaf as root, one group alone has the root of the dataset. An empty table gives an empty table. Columns beside the hashed ones are ignored.
"""

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.common import small_batches
from gridlens.session import stage

FANOUT = 3
#: Levels of a tree that one grouping takes.
HEIGHT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PLACE_BITS = 33  # monotonically_increasing_id: partition << 33 | row


def encoded(value: Column) -> Column:
    """A value with its length in front, so that no two lists of values have the same text."""
    plain = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(plain).cast("string"), F.lit(":"), plain), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("", *parts), 256)


def leaf(columns: list[Column]) -> Column:
    return digest(*map(encoded, columns))


def numbered_leaves(leaves: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree, node and nodes, and the trees (tree, rank, trees); trees follow the order of their groups.

    leaves has a column group. tree is the place of its first row, which names it and sorts like its group; node counts from 0 within the tree.
    """
    by = ["group", *order, "leaf"]
    spread = leaves.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stage(spread.withColumn("place", F.monotonically_increasing_id()), "placed-leaves")
    placed = placed.withColumn("part", F.shiftright("place", PLACE_BITS))
    # a group is one run of rows in each partition it reaches
    runs = placed.groupBy("part", "group").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("size"))
    of_group = Window.partitionBy("group")
    before = F.sum("size").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(
        F.col("part").alias("run_part"), F.col("group").alias("run_group"), "first", F.min("first").over(of_group).alias("tree"),
        F.sum("size").over(of_group).alias("nodes"), F.coalesce(before, F.lit(0)).alias("before"),
    )
    runs = stage(runs, "runs")
    joined = placed.join(runs, (F.col("part") == F.col("run_part")) & F.col("group").eqNullSafe(F.col("run_group")))
    node = F.col("before") + F.col("place") - F.col("first")
    numbered = joined.withColumn("node", node).drop("run_part", "run_group", "first", "before", "part", "place", "group")

    trees = runs.where("first = tree").select("tree", "run_part")
    starts = trees.groupBy("run_part").agg(F.count(F.lit(1)).alias("size"))  # one row for each partition of the shuffle
    earlier = F.sum("size").over(Window.orderBy("run_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = starts.select(F.col("run_part").alias("start_part"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
    number = F.row_number().over(Window.partitionBy("run_part").orderBy("tree")) - 1
    ranked = trees.withColumn("number", number).join(starts, F.col("run_part") == F.col("start_part"))
    return numbered, ranked.select("tree", (F.col("earlier") + F.col("number")).alias("rank"))


def _above(children: Column, fanout: int, width: int, many: Column) -> Column:
    """The parents of an array of nodes; where there is one node only, many is false and it stays."""
    parents = []
    for at in range(0, width, fanout):
        first = F.get(children, F.lit(at))
        joined = F.sha2(F.concat_ws("", F.slice(children, at + 1, min(fanout, width - at))), 256)
        parents.append(F.when(first.isNotNull(), F.when(many, joined).otherwise(first)))
    return F.array(*parents)


def grouped(nodes: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """One row for each subtree of height levels: tree, node (its number), nodes (of its tree at its lowest level), level0 .. and digest.

    nodes: tree, node, nodes, digest.
    """
    width = fanout**height
    slots = [F.max(F.when(F.pmod("node", F.lit(width)) == s, F.col("digest"))).alias(f"slot{s}") for s in range(width)]
    pivot = nodes.groupBy("tree", "nodes", F.expr(f"node div {width}").alias("parent")).agg(*slots)
    rows = pivot.select("tree", "nodes", F.col("parent").alias("node"), F.array(*[f"slot{s}" for s in range(width)]).alias("level0"))
    for level in range(height):
        up = _above(F.col(f"level{level}"), fanout, width // fanout**level, F.col("nodes") > fanout**level)
        rows = rows.withColumn(f"level{level + 1}" if level < height - 1 else "digest", up)
    return rows.withColumn("digest", F.get("digest", F.lit(0)))


def siblings(slot: Column, fanout: int = FANOUT, height: int = HEIGHT) -> Column:
    """For each level that has more than one node, the siblings left and right of the way up from a slot of a grouped row."""
    steps = []
    for level in range(height):
        children, at = F.col(f"level{level}"), F.floor(slot / fanout**level).cast("int")
        own = F.pmod(at, F.lit(fanout))
        left = F.array_join(F.slice(children, at - own + 1, own), "")
        right = F.array_join(F.slice(children, at + 2, fanout - 1 - own), "")
        steps.append(F.when(F.col("nodes") > fanout**level, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*steps), lambda step: step.isNotNull())


def forest(nodes: DataFrame, most: int, fanout: int = FANOUT, height: int = HEIGHT) -> list[DataFrame]:
    """The grouped rows of every pass, lowest first, until each tree is one row. most: nodes of the largest tree."""
    width, passes = fanout**height, []
    for _ in range(max(1, ceil(log(max(most, 1), width) - 1e-9))):
        passes.append(stage(grouped(nodes, fanout, height), "tree-levels"))
        nodes = passes[-1].select("tree", "node", F.ceil(F.col("nodes") / width).alias("nodes"), "digest")
    return passes


def with_paths(passes: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """The rows of the lowest pass with path: the siblings on the way from their own node upwards, then what tops says of their tree.

    tops: tree, path and further columns, one row for each tree.
    """
    width = fanout**height
    extra = [c for c in tops.columns if c not in ("tree", "path")]
    rows = passes[-1].join(tops, "tree")
    for lower in reversed(passes[:-1]):
        upper = rows.select(F.col("tree").alias("of"), F.col("node").alias("up"), F.col("path").alias("beyond"), F.col("nodes").alias("upper_nodes"),
                            *[F.col(f"level{i}").alias(f"upper{i}") for i in range(height)], *extra)
        own = lower.withColumn("above", F.expr(f"node div {width}"))
        joined = own.join(upper, (F.col("tree") == F.col("of")) & (F.col("above") == F.col("up")))
        levels = {**{f"level{i}": f"upper{i}" for i in range(height)}, "nodes": "upper_nodes"}
        way = joined.select(
            *[F.col(c).alias(f"own_{c}") for c in lower.columns], "beyond", *extra, *[F.col(v).alias(k) for k, v in levels.items()]
        )
        path = F.concat(siblings(F.pmod("own_node", F.lit(width)), fanout, height), "beyond")
        rows = way.withColumn("beyond", path).select(*[F.col(f"own_{c}").alias(c) for c in lower.columns], F.col("beyond").alias("path"), *extra)
    return rows


def manifest(leaves: DataFrame, order: list[str], fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """Leaves with subroot, root and path, an array of (left, right): the digests beside the way from the leaf to the root, lowest level first.

    leaves: group, the order columns, leaf and any further columns but tree, node, nodes, path, subroot and root.
    """
    own = [c for c in leaves.columns if c != "group"]
    width = fanout**height
    # written once: the range shuffle reads its input twice, and hashing reads whole texts
    numbered, trees = numbered_leaves(stage(leaves, "leaves"), order)
    numbered, trees = stage(numbered, "numbered-leaves"), stage(trees, "trees")
    most, groups = numbered.agg(F.max("nodes")).first()[0] or 0, trees.count()
    passes = forest(numbered.select("tree", "node", "nodes", F.col("leaf").alias("digest")), most, fanout, height)

    subroots = trees.join(passes[-1].select("tree", F.col("digest").alias("subroot")), "tree")
    subroots = stage(subroots.withColumns({"member": F.col("tree"), "nodes": F.lit(groups).cast("long")}), "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("rank").alias("node"), "nodes", F.col("subroot").alias("digest"))
    upper = forest(tops, groups, fanout, height)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    # the topmost rows have no way further up
    upper = with_paths(upper, upper[-1].select("tree", F.col("digest").alias("root"), empty.alias("path")), fanout, height)
    upper = upper.drop("tree", "digest").withColumnRenamed("node", "up")
    of_tree = subroots.select("member", "rank", "subroot").join(upper, F.expr(f"rank div {width}") == F.col("up"))
    path = F.concat(siblings(F.pmod("rank", F.lit(width)), fanout, height), "path")
    tops = of_tree.select(F.col("member").alias("tree"), "subroot", "root", path.alias("path"))

    rows = with_paths(passes, stage(tops, "subroot-paths"), fanout, height).drop("digest", "nodes")
    rows = rows.withColumnRenamed("tree", "of").withColumnRenamed("node", "up")
    joined = numbered.join(rows, (F.col("tree") == F.col("of")) & (F.expr(f"node div {width}") == F.col("up")))
    path = F.concat(siblings(F.pmod("node", F.lit(width)), fanout, height), "path")
    return joined.withColumn("path", path).select(*own, "subroot", "root", "path")


def proof(path: str) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def folded(leaf: Column, path: str) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def document_leaves(docs: DataFrame, group: str = "source", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """group, doc_id, the leaf of each row and changed, its leaf after tampering.

    Tampering deletes the line feeds of the text where 2 divides the CRC-32 of the decimal doc_id; rows without id are left alone.
    changed is null where it would be the leaf.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in columns]
    changed = F.when(chosen & F.contains(F.col("text"), F.lit("\n")), leaf(tampered))
    return docs.select(F.col(group).alias("group"), "doc_id", leaf([F.col(c) for c in columns]).alias("leaf"), changed.alias("changed"))


def op11_slot_pivot(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = manifest(document_leaves(docs), ["doc_id"])
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), "path"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof("path").alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
