"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: sources in code-point order (null last) have weights that repeat; they share a part of the total size by weight, none above a
multiple of its own size; what a source cannot take is shared again by weight among the others. This is one water level: the target
is the smaller of limit and level * weight, and the level follows from running sums over the sources.

Draw: with ratio = target / source size, every document is taken floor(ratio) times, and once more with the same
probability, the rest of the ratio. The cube method makes that draw so that the sums of sizes and of documents stay
as expected. The flight moves the probabilities of three documents at a time along the direction that changes
neither sum, until one of them is 0 or 1. It runs in groups of at most GROUP documents, in all groups at once; each leaves two
open documents at most, which form the groups of the next level, until one group of a source is left. Its last two documents
land: of the possible ends the one nearest to the balance. What is still missing is made up by one exchange in that group, of a
document taken for one left out. So a source misses its target by a few words, and always by less than its largest document.

All draws follow from hashes of the documents' own values, so reruns and other partitions agree. Equal rows are taken
independently but as one multiset. Null texts have size 0 and are never taken. An empty table gives an empty table.
"""

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens.llm.common import WORD
from gridlens.session import prepare, stage

GROUP = 20_000
TINY = 1e-9


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[int], share: float, limit: float) -> DataFrame:
    """source, source_size, target and ratio from one row (source, source_size) for each source.

    The windows sort the sources, not the documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighted = sizes.withColumn("weight", weight.cast("double"))
    # sources fill up in this order; before a source is full, level * the weights still open is what is left to share
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    all_rows = Window.partitionBy()
    total, all_weights = F.sum("source_size").over(all_rows), F.sum("weight").over(all_rows)
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    full = F.coalesce(F.sum(F.col("source_size") * limit).over(earlier), F.lit(0.0))
    weight_left = all_weights - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    level = (total * share - full) / weight_left
    leveled = weighted.withColumn("level", level).withColumn("is_full", F.col("level") * F.col("weight") >= F.col("source_size") * limit)
    leveled = leveled.withColumn("turn", F.row_number().over(filling))
    # the first source that does not fill up gives the level of all after it
    first_open = F.min(F.when(~F.col("is_full"), F.struct("turn", "level"))).over(all_rows)
    target = F.when(F.col("is_full"), F.col("source_size") * limit).otherwise(first_open["level"] * F.col("weight"))
    ratio = F.when(F.col("is_full"), F.lit(float(limit))).otherwise(F.col("target") / F.col("source_size"))
    return leveled.withColumn("target", target).select(
        "source", "source_size", "target", F.when(F.col("source_size") > 0, ratio).otherwise(0.0).alias("ratio")
    )


def flight(sizes: np.ndarray, chances: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Chances after the flight: all 0 or 1 but two at most. The sums of chance and of size * chance are kept."""
    chances = chances.astype(float).tolist()
    sizes, draws = sizes.astype(float).tolist(), draws.tolist()
    open_rows: list[int] = []
    for row in range(len(sizes)):
        if not TINY < chances[row] < 1 - TINY:
            chances[row] = float(round(chances[row]))
            continue
        open_rows.append(row)
        while len(open_rows) == 3:
            a, b, c = open_rows
            # the direction in which neither the count nor the size changes
            step = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(step):
                step = (1.0, -1.0, 0.0)
            up = down = math.inf
            for row_, s in zip(open_rows, step, strict=True):
                p = chances[row_]
                if s > 0:
                    up, down = min(up, (1 - p) / s), min(down, p / s)
                elif s < 0:
                    up, down = min(up, -p / s), min(down, (p - 1) / s)
            # both ways are as likely as keeps every chance as it is on average
            move = up if draws[row] * (up + down) < down else -down
            for row_, s in zip(open_rows, step, strict=True):
                chances[row_] += move * s
            left = []
            for row_ in open_rows:
                if TINY < chances[row_] < 1 - TINY:
                    left.append(row_)
                else:
                    chances[row_] = float(round(chances[row_]))
            if len(left) == 3:  # rounding kept the one that should have ended just inside
                ends = min(left, key=lambda r: min(chances[r], 1 - chances[r]))
                chances[ends] = float(round(chances[ends]))
                left.remove(ends)
            open_rows = left
    return np.array(chances)


def landing(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Ends the last open rows, two at most, with the sum of sizes nearest to the expected one; of equals with fewer rows. Then
    one taken row changes places with one left out, if their sizes differ by about what is still missing."""
    picked = chances.copy()
    rows = np.flatnonzero((chances > TINY) & (chances < 1 - TINY))
    wanted = float((sizes[rows] * chances[rows]).sum())
    ends = product((0.0, 1.0), repeat=len(rows))
    picked[rows] = min(ends, key=lambda e: (abs(sum(s * x for s, x in zip(sizes[rows].tolist(), e, strict=True)) - wanted), sum(e), e))
    missing = wanted - float((sizes[rows] * picked[rows]).sum())
    taken, left = np.flatnonzero(picked == 1), np.flatnonzero(picked == 0)
    if not len(taken) or not len(left):
        return picked
    left = left[np.argsort(sizes[left], kind="stable")]
    place = np.searchsorted(sizes[left], sizes[taken] + missing)
    best = (abs(missing), -1, -1)
    for near in (np.minimum(place, len(left) - 1), np.maximum(place - 1, 0)):
        off = np.abs(sizes[left][near] - sizes[taken] - missing)
        first = int(off.argmin())
        best = min(best, (float(off[first]), int(taken[first]), int(left[near[first]])))
    if best[1] >= 0:
        picked[best[1]], picked[best[2]] = 0.0, 1.0
    return picked


def cube_draw(rows: DataFrame, group_rows: int = GROUP) -> DataFrame:
    """rows (source_number, size, chance, draw, n_rows and others) with picked, 0 or 1.

    n_rows is the number of rows of the source; groups follow from the hash in draw, so all are about equally large.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    most = rows.agg(F.max("n_rows")).first()[0] or 0
    done, open_rows, level = None, rows, 0

    def flown_by(land: bool):
        def fly(part: pd.DataFrame) -> pd.DataFrame:
            part = part.drop(columns="bucket")
            order = [c for c in ("size", "draw", *sorted(part.columns)) if c not in ("n_rows", "chance")]
            part = part.sort_values(list(dict.fromkeys(order)), ascending=False, na_position="last", kind="stable")
            moved = flight(part["size"].to_numpy(), part["chance"].to_numpy(), part["draw"].to_numpy())
            return part.assign(chance=landing(part["size"].to_numpy(), moved) if land else moved)

        return fly

    while True:
        groups = math.ceil(most / group_rows)
        # a source of n rows at first gets n / group_rows groups; later levels shrink all sources alike
        own = F.greatest(F.lit(1), F.least(F.lit(groups), F.ceil(F.col("n_rows") / group_rows))).cast("long")
        last = groups <= 1
        keyed = open_rows.withColumn("bucket", F.pmod(F.xxhash64("draw", F.lit(level)), own))
        flown = keyed.groupBy("source_number", "bucket").applyInPandas(flown_by(last), kinds)
        flown = stage(flown, f"flight-{level}")
        ended = flown.where((F.col("chance") == 0) | (F.col("chance") == 1))
        done = ended if done is None else done.unionByName(ended)
        if last:
            return done.withColumnRenamed("chance", "picked")
        open_rows = flown.where((F.col("chance") > 0) & (F.col("chance") < 1)).withColumn("n_rows", 2 * F.ceil(F.col("n_rows") / group_rows))
        most, level = 2 * groups, level + 1


def mixture(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, seed: int = 4, group_rows: int = GROUP,
    key: str = "doc_id",
) -> DataFrame:
    """key, size, source, source_size, target, taken for each row; limit is a whole number."""
    prepare(docs.sparkSession)
    content = F.xxhash64("doc_id", "source", F.col("text"), F.lit(seed))
    draw = F.pmod(content, F.lit(1 << 40)) / F.lit(float(1 << 40))
    sized = stage(docs.select(F.col(key).alias("doc_id"), "source", word_count().alias("size"), draw.alias("draw")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    shares = targets(sources.select("source", "source_size"), list(weights), share, limit)
    numbered = shares.join(sources.select(F.col("source").alias("of"), "n_rows"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    # one row for each source
    numbered = stage(numbered.withColumn("source_number", F.xxhash64("source")), "sources")
    rated = sized.join(numbered.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rated = rated.withColumn("whole", F.floor("ratio")).withColumn("chance", F.col("ratio") - F.floor("ratio"))
    # only rows with an open chance fly
    flies = (F.col("chance") > 0) & (F.col("size") > 0)
    columns = ["doc_id", "source", "size", "source_size", "target", "whole"]
    # ids travel as text, since pandas would make numbers beside nulls inexact
    kind = docs.schema[key].dataType
    rated = rated.withColumn("doc_id", F.col("doc_id").cast("string"))
    drawn = cube_draw(rated.where(flies).select(*columns, "source_number", "chance", "draw", "n_rows"), group_rows)
    settled = rated.where(~flies).select(*columns, F.lit(0.0).alias("picked"))
    both = settled.unionByName(drawn.select(*columns, "picked"))
    both = both.withColumn("doc_id", F.col("doc_id").cast(kind))
    return both.select(F.col("doc_id").alias(key), *columns[1:-1], ((F.col("whole") + F.col("picked")) * F.col("size")).cast("long").alias("taken"))


def op4_cube_mixture(docs: DataFrame) -> DataFrame:
    return mixture(docs).select("doc_id", "size", "source_size", "target", "taken", "source")
