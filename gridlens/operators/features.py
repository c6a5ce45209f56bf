"""Trailing-window features, next-hour labels and the leakage check."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.functions import columns as C
from gridlens.operators.windows import chronological_split, history_windows


def network_features(hourly: DataFrame, strict_hours: bool = False, deduplicate: bool = False) -> DataFrame:
    """Six features per cell and timestamp with a complete six-row history.

    The history counts rows; strict_hours asks for six contiguous hours instead. Keys are unique in a table
    that passed the quality gate; deduplicate keeps one row per key of any other, at the cost of a shuffle.
    """
    return _features(history_windows(hourly.dropDuplicates(S.CELL_HOUR) if deduplicate else hourly), strict_hours)


def _features(rows: DataFrame, strict_hours: bool, *more: str) -> DataFrame:
    complete = (F.col("recent_count") == 3) & (F.col("baseline_count") == 3)
    if strict_hours:
        complete = complete & (F.col("history_start") == F.col("timestamp") - F.expr("INTERVAL 5 HOURS"))
    recent, earlier = F.col("recent_avg"), F.col("baseline_avg")
    return rows.where(complete).select(
        "grid_id",
        F.col("timestamp").alias("feature_timestamp"),
        recent.alias("avg_activity"),
        C.ratio_or_zero(recent - earlier, earlier).alias("activity_growth"),
        "active_hours",
        C.ratio_or_zero(F.col("recent_peak"), recent).alias("peak_ratio"),
        F.coalesce("recent_stddev", F.lit(0.0)).alias("variability"),
        C.ratio_or_zero(F.col("recent_internet"), F.col("recent_total")).alias("internet_share"),
        *more,
    )


def training_set(
    hourly: DataFrame, threshold: float = S.HIGH_ACTIVITY_THRESHOLD, strict_hours: bool = False
) -> DataFrame:
    """Features with the activity exactly one hour later, labelled against the threshold. History and next hour come
    from the same pass over the windows, so there is one shuffle and no join."""
    rows = history_windows(hourly, with_next=True)
    follows = F.col("target_timestamp") == F.col("timestamp") + F.expr("INTERVAL 1 HOUR")
    labelled = _features(rows.where(follows), strict_hours, "target_timestamp", "target_activity")
    return labelled.withColumn("high_activity_risk", F.when(F.col("target_activity") > threshold, 1).otherwise(0))


def split_training_set(
    labelled: DataFrame, fraction: float = S.TRAIN_FRACTION, border: datetime | None = None
) -> DataFrame:
    return chronological_split(labelled, "feature_timestamp", fraction, border)


def split_checks(split: DataFrame) -> DataFrame:
    """One row: sizes and time bounds of both parts, and whether train ends before test begins."""
    when = F.col("feature_timestamp")
    train, test = F.col("split") == "train", F.col("split") == "test"
    return split.agg(
        F.count_if(train).alias("train_rows"),
        F.count_if(test).alias("test_rows"),
        F.min(F.when(train, when)).alias("train_earliest_timestamp"),
        F.max(F.when(train, when)).alias("train_latest_timestamp"),
        F.min(F.when(test, when)).alias("test_earliest_timestamp"),
        F.max(F.when(test, when)).alias("test_latest_timestamp"),
    ).withColumn(
        "chronological_split_valid",
        F.coalesce(F.col("train_latest_timestamp") < F.col("test_earliest_timestamp"), F.lit(False)),
    )


def require_valid_split(split: DataFrame) -> DataFrame:
    if not split_checks(split).where("chronological_split_valid").take(1):
        raise ValueError("chronological split is empty or overlaps")
    return split


def leakage_report(hourly: DataFrame, cutoff) -> DataFrame:
    """Changes every row after the cutoff and compares the features up to the cutoff; expects no difference."""
    late = F.col("timestamp") > F.lit(cutoff)
    changed = hourly.withColumns(
        {m: F.when(late, F.col(m) * 7 + 1000).otherwise(F.col(m)) for m in ("total_activity", "internet_activity")}
    )
    kept = F.col("feature_timestamp") <= F.lit(cutoff)
    keys = ["grid_id", "feature_timestamp"]
    before = network_features(hourly).where(kept).select(*keys, F.struct(*S.FEATURES).alias("original"))
    after = network_features(changed).where(kept).select(*keys, F.struct(*S.FEATURES).alias("perturbed"))
    same = F.col("original").eqNullSafe(F.col("perturbed"))
    return before.join(after, keys, "full_outer").agg(
        F.count(F.lit(1)).alias("feature_rows"), F.count_if(~same).alias("changed_rows")
    )
