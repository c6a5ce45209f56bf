"""Row windows along time; long keys are split by calendar period and stitched at the period borders."""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators.order_stats import MAX_GROUP_ROWS, large_groups, values_at


def along_time(
    df: DataFrame,
    columns: Callable[[WindowSpec], list[Column]],
    keys: list[str],
    order: str = "timestamp",
    before: int = 0,
    after: int = 0,
    period: str = "month",
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Adds row-window columns that look at most `before` rows back and `after` rows ahead within keys.

    Keys are counted first. Ordinary ones take one window per key: one shuffle, one sort. Those above
    max_group_rows are split by calendar period instead, with the same result; so is everything when there
    are no keys. Each (keys, order) must be unique.
    """
    if not keys:
        return _by_period(df, columns, keys, order, before, after, period)
    plain = Window.partitionBy(*keys).orderBy(order)
    large = large_groups(df, keys, max_group_rows)
    if large is None:
        return df.select("*", *columns(plain))
    ordinary = df.join(large, keys, "left_anti").select(*df.columns, *columns(plain))
    long = df.join(large, keys, "left_semi").select(*df.columns)
    return ordinary.unionByName(_by_period(long, columns, keys, order, before, after, period))


def _by_period(
    df: DataFrame,
    columns: Callable[[WindowSpec], list[Column]],
    keys: list[str],
    order: str,
    before: int,
    after: int,
    period: str,
) -> DataFrame:
    """One window per key and calendar period. Rows too close to a period border to see all their neighbours are
    recomputed from the border rows alone, a few per key and period, after a second, small shuffle.

    Where `columns` refers to plain columns of df only, both parts read the same first shuffle.
    """
    reach = before + after
    inside = Window.partitionBy(*keys, "_period").orderBy(order)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    from_start = (F.row_number().over(inside)).alias("_from_start")
    to_end = (F.count(F.lit(1)).over(whole) - F.row_number().over(inside)).alias("_to_end")
    sees_all = (F.col("_from_start") > before) & (F.col("_to_end") >= after)

    split = df.withColumn("_period", F.date_trunc(period, order))
    body = split.select("*", *columns(inside), from_start, to_end).where(sees_all)
    borders = split.select("*", from_start, to_end).where(
        (F.col("_from_start") <= reach) | (F.col("_to_end") < reach)
    )
    along_key = Window.partitionBy(*keys).orderBy(order)
    stitched = borders.select("*", *columns(along_key)).where(~sees_all)
    return body.unionByName(stitched).drop("_period", "_from_start", "_to_end")


def history_windows(hourly: DataFrame, with_next: bool = False, **options) -> DataFrame:
    """Per cell: the last three rows (this one included) and the three before them; if wanted, the next row too."""

    def columns(w: WindowSpec) -> list[Column]:
        recent, earlier = w.rowsBetween(-2, 0), w.rowsBetween(-5, -3)
        activity = F.col("total_activity")
        return [
            F.count(activity).over(recent).alias("recent_count"),
            F.count(activity).over(earlier).alias("baseline_count"),
            F.avg(activity).over(recent).alias("recent_avg"),
            F.avg(activity).over(earlier).alias("baseline_avg"),
            F.max(activity).over(recent).alias("recent_peak"),
            F.sum("is_active").over(recent).alias("active_hours"),
            F.stddev_samp(activity).over(recent).alias("recent_stddev"),
            F.sum("internet_activity").over(recent).alias("recent_internet"),
            F.sum(activity).over(recent).alias("recent_total"),
            F.min("timestamp").over(w.rowsBetween(-5, 0)).alias("history_start"),
            *(_next_row(w) if with_next else []),
        ]

    active = F.when(F.col("total_activity") > 0, 1).otherwise(0).alias("is_active")
    rows = hourly.select("grid_id", "timestamp", "total_activity", "internet_activity", active)
    return along_time(rows, columns, ["grid_id"], before=5, after=int(with_next), **options).drop("is_active")


def _next_row(w: WindowSpec) -> list[Column]:
    return [
        F.lead("timestamp").over(w).alias("target_timestamp"),
        F.lead("total_activity").over(w).alias("target_activity"),
    ]


def next_hour_target(hourly: DataFrame) -> DataFrame:
    """The following row of the same cell."""
    rows = hourly.select("grid_id", "timestamp", "total_activity")
    return along_time(rows, _next_row, ["grid_id"], after=1)


def previous_hour_activity(hourly: DataFrame, scope: str = "date") -> DataFrame:
    """The row before within the same daily file and cell. The unique (cell, timestamp) key bounds such a group by
    the distinct timestamps of a day."""
    w = Window.partitionBy(scope, "grid_id").orderBy("hour", "timestamp")
    return hourly.withColumn("prev_hour_activity", F.lag("total_activity").over(w))


def last_hours(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """The latest rows of every cell; Spark keeps only the leading rows of each cell before the shuffle."""
    w = Window.partitionBy("grid_id").orderBy(F.col("timestamp").desc())
    return hourly.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= hours).drop("_nth")


def timestamp_gaps(df: DataFrame, order: str = "timestamp") -> DataFrame:
    """Distinct timestamps with the one before, over all rows."""
    distinct = df.where(F.col(order).isNotNull()).select(order).distinct()
    return along_time(distinct, lambda w: [F.lag(order).over(w).alias("previous")], [], order=order, before=1)


def split_timestamp(df: DataFrame, order: str, fraction: float = S.TRAIN_FRACTION) -> DataFrame:
    """First timestamp of the test part when the distinct timestamps are cut at int(fraction * count)."""

    def day(micros: Column) -> Column:
        return F.floor(micros / 86_400_000_000).cast("long")

    moments = df.select(F.unix_micros(order).alias("_t")).distinct()
    found = values_at(moments, "_t", lambda rows: {"split": F.floor(rows * fraction)}, slicer=day)
    return found.select(F.timestamp_micros("split").alias("split_timestamp"))


def split_border(df: DataFrame, order: str, fraction: float = S.TRAIN_FRACTION) -> datetime:
    """The split timestamp as a value, so that filters on it reach the scan of a stored table."""
    row = split_timestamp(df, order, fraction).first()
    if row is None or row[0] is None:
        raise ValueError(f"no {order} to split at {fraction}")
    return row[0]


def chronological_split(
    df: DataFrame, order: str, fraction: float = S.TRAIN_FRACTION, border: datetime | None = None
) -> DataFrame:
    """Adds split = train / test; every train timestamp lies before every test timestamp."""
    at = F.lit(border or split_border(df, order, fraction))
    return df.withColumn("split", F.when(F.col(order) < at, "train").otherwise("test"))


def chronological_parts(df: DataFrame, order: str, border: datetime) -> tuple[DataFrame, DataFrame]:
    """Train and test rows of a stored table; each scan skips the row groups of the other part."""
    return df.where(F.col(order) < F.lit(border)), df.where(F.col(order) >= F.lit(border))
