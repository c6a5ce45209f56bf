"""Exact order statistics, quantiles, leave-one-out medians and mergeable order summaries without putting a large group in one task."""

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlens.functions.columns import value_slice
from gridlens.operators.joins import by_merge, small_side
from gridlens.session import stage

# a group above this many rows is spread over value slices
MAX_GROUP_ROWS = 1_000_000

# ranges into which a slice is cut that is still too large
PARTS = 1024

_ALL = Window.unboundedPreceding, Window.unboundedFollowing

# group size -> name -> 0-based position in the group's sorted values
Positions = Callable[[Column], dict[str, Column]]


def large_groups(df: DataFrame, by: list[str], max_group_rows: int) -> DataFrame | None:
    """Keys of the groups above max_group_rows as a small stored table, or None. There are at most total rows /
    max_group_rows of them, so a join broadcasts them only where they measure small."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > max_group_rows)
    # mostly there are none, and then nothing has to be written
    return None if sizes.isEmpty() else small_side(stage(sizes.select(*by), "large-groups"))


def between(low: Column, high: Column, share: Column) -> Column:
    """low + (high - low) * share, to the nearest double where the three are decimals of few places, as measured values are.

    Double arithmetic alone is off by a last place now and then, by which two equal statistics of the same values would compare as different.
    """
    a, b, part = low.try_cast("decimal(28,12)"), high.try_cast("decimal(28,12)"), share.try_cast("decimal(5,4)")
    same = (a.cast("double") == low) & (b.cast("double") == high) & (part.cast("double") == share)
    return F.when(low == high, low).when(same, (a + (b - a) * part).cast("double")).otherwise(low + (high - low) * share)


def values_at(
    df: DataFrame,
    value: str,
    positions: Positions,
    by: list[str] | None = None,
    slicer: Callable[[Column], Column] = value_slice,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """The values at given positions of each group's sorted non-null values: by, group_rows, one column per name.

    A position outside the group gives NULL. Columns in `by` must not be NULL. Groups are counted first;
    ordinary ones are sorted, those above max_group_rows are only searched (see _search_slices).
    """
    by = by or []
    present = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_value"))
    if not by:
        search = present.count() > max_group_rows
        return _search_slices(present, positions, by, slicer, max_group_rows) if search else _sort_groups(present, positions, by)
    large = large_groups(present, by, max_group_rows)
    if large is None:
        return _sort_groups(present, positions, by)
    ordinary = _sort_groups(present.join(large, by, "left_anti"), positions, by)
    return ordinary.unionByName(_search_slices(present.join(large, by, "left_semi"), positions, by, slicer, max_group_rows))


def _sort_groups(present: DataFrame, positions: Positions, by: list[str]) -> DataFrame:
    """One shuffle and one sort for all positions."""
    sorted_ = Window.partitionBy(*by).orderBy("_value")
    # counted along the same order, so that one pass gives both
    ranked = present.withColumns({"_spot": F.row_number().over(sorted_) - 1, "group_rows": F.count(F.lit(1)).over(sorted_.rowsBetween(*_ALL))})
    wanted = positions(F.col("group_rows"))
    return ranked.groupBy(*by, "group_rows").agg(
        *[F.max(F.when(F.col("_spot") == position, F.col("_value"))).alias(name) for name, position in wanted.items()]
    )


def _search_slices(
    present: DataFrame,
    positions: Positions,
    by: list[str],
    slicer: Callable[[Column], Column] = value_slice,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Slice sizes are counted first, which shuffles counts only. A slice that holds a wanted position and more than
    max_group_rows rows is cut again, into PARTS ranges of equal width between its least and largest value, and counted
    again, until it is small enough or holds one value only. Then the rows of the few slices left are picked, equal values
    are counted before the shuffle, and each slice is sorted on its own. So neither a dominant group nor a dominant value
    nor a narrow distribution reaches a single task. Meant for few, large groups: there is at most one wanted slice per
    group and position, kept in a stored table.
    """
    sliced = present.withColumn("_slice", slicer(F.col("_value")))
    wanted = positions(F.col("group_rows"))

    def holds(position: Column, first: str, rows: str) -> Column:
        return (position >= F.col(first)) & (position < F.col(first) + F.col(rows))

    hit = reduce(or_, [holds(position, "_before", "_rows") for position in wanted.values()])
    size = [F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("_least"), F.max("_value").alias("_most")]
    over_slices = Window.partitionBy(*by).orderBy("_slice")
    counted = sliced.groupBy(*by, "_slice").agg(*size).select(
        "*",
        (F.sum("_rows").over(over_slices) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(*by)).alias("group_rows"),
    )
    located = stage(counted.where(hit), "slices")
    too_large = (F.col("_rows") > max(max_group_rows, 1)) & (F.col("_least") < F.col("_most"))
    inside = (F.col("_value") >= F.col("_least")) & (F.col("_value") <= F.col("_most"))
    while not located.where(too_large).isEmpty():
        keys = [*by, "_slice", "_part_of", "group_rows", "_start"]
        cut = located.where(too_large).select(
            *by, "_slice", "group_rows", "_least", "_most", F.col("_before").alias("_start"), F.col("_before").alias("_part_of")
        )
        share = (F.col("_value") - F.col("_least")) / (F.col("_most") - F.col("_least"))
        part = F.least(F.lit(PARTS - 1), F.floor(share * PARTS))
        again = sliced.join(small_side(cut), [*by, "_slice"]).where(inside).withColumn("_part", part)
        over_parts = Window.partitionBy(*by, "_slice", "_part_of").orderBy("_part")
        sizes = again.groupBy(*keys, "_part").agg(*size)
        before = F.col("_start") + F.sum("_rows").over(over_parts) - F.col("_rows")
        parts = sizes.withColumn("_before", before).where(hit).select(*located.columns)
        located = stage(located.where(~too_large).unionByName(parts), "slices")
    # the bounds of a slice name it from here on
    bounds = located.select(*by, "_slice", "_least", "_most", "_before", "group_rows")
    in_slice = Window.partitionBy(*by, "_slice", "_before").orderBy("_value")
    first = F.col("_before") + F.sum("_copies").over(in_slice) - F.col("_copies")
    found = (
        sliced.join(small_side(bounds), [*by, "_slice"])
        .where(inside)
        .groupBy(*by, "_slice", "_before", "group_rows", "_value")
        .agg(F.count(F.lit(1)).alias("_copies"))
        .select(*by, "group_rows", "_value", "_copies", first.alias("_first"))
    )
    return found.groupBy(*by, "group_rows").agg(
        *[
            F.max(F.when(holds(position, "_first", "_copies"), F.col("_value"))).alias(name)
            for name, position in wanted.items()
        ]
    )


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: list[float],
    by: list[str] | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group and probability: by, probability, quantile."""
    by = by or []
    numbered = list(enumerate(float(p) for p in probabilities))

    def positions(rows: Column) -> dict[str, Column]:
        wanted = {}
        for i, p in numbered:
            wanted[f"_low{i}"] = F.floor((rows - 1) * p)
            wanted[f"_high{i}"] = F.ceil((rows - 1) * p)
        return wanted

    found = values_at(df, value, positions, by, max_group_rows=max_group_rows)

    def interpolated(i: int, p: float) -> Column:
        at = (F.col("group_rows") - 1) * p
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.struct(F.lit(p).alias("probability"), between(low, high, at - F.floor(at)).alias("quantile"))

    return found.select(*by, F.inline(F.array(*[interpolated(i, p) for i, p in numbered])))


def _middle(rows: Column) -> dict[str, Column]:
    """Positions around the middle of the other rows - 1 values, in the group's own order."""
    low, high = F.floor((rows - 2) / 2), F.floor((rows - 1) / 2)
    return {"_low": low, "_low_next": low + 1, "_high": high, "_high_next": high + 1}


def _median_of_others(value: Column, rows: Column, exact: bool = False) -> Column:
    """Median of a group's other values, from the group's own values around the middle.

    Taking out a value at or below the k-th one shifts everything above it down by one place. An exact one is the nearest double.
    """
    low = F.when(value <= F.col("_low"), F.col("_low_next")).otherwise(F.col("_low"))
    high = F.when(value <= F.col("_high"), F.col("_high_next")).otherwise(F.col("_high"))
    return F.when(rows >= 2, between(low, high, F.lit(0.5)) if exact else (low + high) / 2)


def leave_one_out_median(
    df: DataFrame,
    buckets: list[str],
    value: str = "total_activity",
    output: str = "baseline_activity",
    max_group_rows: int | None = MAX_GROUP_ROWS,
    exact: bool = False,
) -> DataFrame:
    """Adds, per row, the median of the other rows in its bucket; NULL for a bucket of one.

    Buckets are counted first. Ordinary ones then need one shuffle and one sort. Those above max_group_rows
    take their middle values from a search and are never gathered. Pass None where the key bounds the bucket.
    The value must not be NULL. exact: see between.
    """
    large = None if max_group_rows is None else large_groups(df, buckets, max_group_rows)
    if large is None:
        return _sorted_buckets(df, buckets, value, output, exact)
    ordinary = _sorted_buckets(df.join(large, buckets, "left_anti"), buckets, value, output, exact)
    return ordinary.unionByName(_sliced_buckets(df.join(large, buckets, "left_semi"), buckets, value, output, max_group_rows, exact))


def _sorted_buckets(df: DataFrame, buckets: list[str], value: str, output: str, exact: bool) -> DataFrame:
    sorted_ = Window.partitionBy(*buckets).orderBy(value)
    whole = sorted_.rowsBetween(*_ALL)
    ranked = df.withColumns({"_spot": F.row_number().over(sorted_) - 1, "_rows": F.count(F.lit(1)).over(whole)})
    middle = {
        name: F.max(F.when(F.col("_spot") == spot, F.col(value))).over(whole)
        for name, spot in _middle(F.col("_rows")).items()
    }
    baseline = _median_of_others(F.col(value), F.col("_rows"), exact)
    return ranked.withColumns(middle).withColumn(output, baseline).select(*df.columns, output)


def _sliced_buckets(df: DataFrame, buckets: list[str], value: str, output: str, max_group_rows: int, exact: bool) -> DataFrame:
    middle = _search_slices(df.select(*buckets, F.col(value).alias("_value")), _middle, buckets, max_group_rows=max_group_rows)
    baseline = _median_of_others(F.col(value), F.col("group_rows"), exact)
    return df.join(small_side(stage(middle, "middle-values")), buckets).withColumn(output, baseline).select(*df.columns, output)


def value_counts(rows: DataFrame, buckets: list[str], value: str) -> DataFrame:
    """How often each value occurs in its bucket: an exact order summary that merges with others by adding counts."""
    return rows.where(F.col(value).isNotNull()).groupBy(*buckets, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def merged_counts(summaries: list[DataFrame], keys: list[str]) -> DataFrame:
    """One summary of several; keys are the buckets. Values taken out come with negative counts and vanish at zero."""
    together = reduce(DataFrame.unionByName, summaries)
    return together.groupBy(*keys, "value").agg(F.sum("rows").alias("rows")).where("rows <> 0")


def middle_values(summary: DataFrame, buckets: list[str]) -> DataFrame:
    """group_rows and the values around the middle of each bucket of a summary, by which medians of others follow.

    Counts of value slices tell which slices hold the middle; only their values are sorted, each slice in a task of its own.
    """
    sliced = summary.withColumn("_slice", value_slice(F.col("value")))
    over_slices = Window.partitionBy(*buckets).orderBy("_slice")
    sizes = sliced.groupBy(*buckets, "_slice").agg(F.sum("rows").alias("_rows"))
    located = sizes.select(
        *buckets, "_slice", (F.sum("_rows").over(over_slices) - F.col("_rows")).alias("_before"), "_rows",
        F.sum("_rows").over(Window.partitionBy(*buckets)).alias("group_rows"),
    )
    wanted = _middle(F.col("group_rows"))
    holds = reduce(or_, [(p >= F.col("_before")) & (p < F.col("_before") + F.col("_rows")) for p in wanted.values()])
    inside = sliced.join(by_merge(located.where(holds).drop("_rows")), [*buckets, "_slice"])
    first = F.col("_before") + F.sum("rows").over(Window.partitionBy(*buckets, "_slice").orderBy("value")) - F.col("rows")
    spots = inside.withColumn("_first", first).groupBy(*buckets, "group_rows")
    found = {name: (p >= F.col("_first")) & (p < F.col("_first") + F.col("rows")) for name, p in wanted.items()}
    return spots.agg(*[F.max(F.when(here, F.col("value"))).alias(name) for name, here in found.items()])


def medians_of_others(
    rows: DataFrame, middles: DataFrame, buckets: list[str], value: str = "total_activity", output: str = "baseline_activity"
) -> DataFrame:
    """The same column as leave_one_out_median, from the middle values of a summary that counts the rows' own values too."""
    baseline = _median_of_others(F.col(value), F.col("group_rows"))
    return rows.join(small_side(middles), buckets, "left").withColumn(output, baseline).select(*rows.columns, output)
