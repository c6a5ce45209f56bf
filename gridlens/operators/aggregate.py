"""The hourly cell summary and the reports on top of it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators.clean import add_calendar, add_totals
from gridlens.operators.joins import few_rows
from gridlens.operators.order_stats import quantiles


def exact_sum(name: str, decimals: int | None = None) -> Column:
    """Sum of a measure. With `decimals`, the sum of values that carry at most that many decimals, added as whole
    units, so that the total does not depend on the order in which partial sums arrive. A value with more decimals
    (beyond the last places of a double), of 2 ** 53 units or more, or not finite is an error, never rounded."""
    if decimals is None:
        return F.sum(name)
    unit, value = float(10**decimals), F.col(name)
    units = F.rint(value * unit)
    noise = F.greatest(F.lit(1e-9), F.abs(units) * 1e-15)
    exact = (F.abs(units) < float(1 << 53)) & (F.abs(value * unit - units) <= noise)
    text = F.concat(F.lit(f"{name} is not a number of at most {decimals} decimals: "), value.cast("string"))
    return F.sum(F.when(exact | value.isNull(), units.cast("long")).otherwise(F.raise_error(text).cast("long"))) / unit


def hourly_grid_summary(clean: DataFrame, decimals: int | None = None) -> DataFrame:
    """One row per cell and timestamp; country codes are summed away.

    Only the key and the five measures are shuffled; the calendar columns follow from the timestamp and are
    added to the aggregated rows.
    """
    grouped = clean.groupBy(*S.CELL_HOUR).agg(*[exact_sum(name, decimals).alias(name) for name in S.MEASURES])
    share = F.when(F.col("total_activity") != 0, F.try_divide("internet_activity", "total_activity"))
    return (
        add_totals(add_calendar(grouped))
        .withColumn("internet_share", share)
        .select(*S.CELL_HOUR, *S.CALENDAR, *S.MEASURES, *S.TOTALS, "internet_share")
    )


def daily_traffic(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("grid_id", "date").agg(
        F.sum("total_activity").alias("daily_total_activity"),
        F.avg("total_activity").alias("daily_avg_hourly_activity"),
    )


def daily_kpis(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(
        F.sum("total_activity").alias("total_activity"),
        F.sum("total_sms").alias("total_sms"),
        F.sum("total_calls").alias("total_calls"),
        F.sum("internet_activity").alias("total_internet"),
        F.count_distinct("grid_id").alias("active_grids"),
    )


def grid_kpis(hourly: DataFrame) -> DataFrame:
    """Per cell; sort by total_activity descending to present. Hours of the day are collected as bits, which
    combine before the shuffle."""
    return hourly.groupBy("grid_id").agg(
        F.sum("total_activity").alias("total_activity"),
        F.max("total_activity").alias("peak_hour_activity"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1, hour)"))).cast("long").alias("active_hours"),
    )


def top_hotspots(hourly: DataFrame, limit: int = 10) -> DataFrame:
    return (
        hourly.groupBy("grid_id")
        .agg(F.sum("total_activity").alias("total_activity"))
        .orderBy(F.desc("total_activity"), "grid_id")
        .limit(limit)
    )


def peak_hour(hourly: DataFrame) -> DataFrame:
    return (
        hourly.groupBy("hour")
        .agg(F.sum("total_activity").alias("total_activity"))
        .orderBy(F.desc("total_activity"), "hour")
        .limit(1)
    )


def top_hotspots_geo(hourly: DataFrame, lookup: DataFrame, limit: int = 10) -> DataFrame:
    """Ranks first, then looks up the few ranked cells only."""
    ranked = top_hotspots(hourly, limit)
    centroids = lookup.select("grid_id", "centroid_lon", "centroid_lat")
    return centroids.join(few_rows(ranked, limit), "grid_id", "right").select(
        "grid_id", "centroid_lon", "centroid_lat", "total_activity"
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_type").agg(F.count(F.lit(1)).alias("alerts"))


def top_alert_grids(alerts: DataFrame, limit: int = 10) -> DataFrame:
    counted = alerts.groupBy("grid_id").agg(F.count(F.lit(1)).alias("alerts"))
    return counted.orderBy(F.desc("alerts"), "grid_id").limit(limit)


def alert_rate(alerts: DataFrame, hourly: DataFrame, revise_above_percent: float = 5.0) -> DataFrame:
    fired = alerts.agg(F.count(F.lit(1)).alias("alerts"), F.lit(0).cast("long").alias("grid_hours"))
    hours = hourly.agg(F.lit(0).cast("long").alias("alerts"), F.count(F.lit(1)).alias("grid_hours"))
    both = fired.unionByName(hours).agg(F.sum("alerts").alias("alerts"), F.sum("grid_hours").alias("grid_hours"))
    percent = F.try_divide(F.col("alerts") * 100.0, F.col("grid_hours"))
    return both.withColumn("alert_percent", percent).withColumn(
        "needs_revision", F.col("alert_percent") > revise_above_percent
    )


def alert_types_per_key(alerts: DataFrame) -> DataFrame:
    """Per cell and timestamp: whether a rising alert fired, and the distinct types in order, joined by a bar."""
    return (
        alerts.select("grid_id", "timestamp", "alert_type")
        .distinct()
        .groupBy("grid_id", "timestamp")
        .agg(
            F.max(F.col("alert_type").isin(S.RISING_ALERTS)).alias("np3_positive"),
            F.array_join(F.array_sort(F.collect_set("alert_type")), "|").alias("np3_alert_types"),
        )
    )


def bucket_coverage(hourly: DataFrame) -> DataFrame:
    """Observations per cell and hour of day; keys are unique, so rows count timestamps."""
    per_bucket = hourly.groupBy("grid_id", "hour").agg(F.count("timestamp").alias("n"))
    return per_bucket.agg(
        F.min("n").alias("min_observations"),
        F.max("n").alias("max_observations"),
        F.avg("n").alias("mean_observations"),
        (F.min("n") > 1).alias("sufficient"),
    )


def describe(df: DataFrame, value: str) -> DataFrame:
    """statistic, value rows: count, mean, std, min, 25%, 50%, 75%, max. Quartiles are exact."""
    moments = df.agg(
        F.count(value).cast("double").alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).unpivot([], ["count", "mean", "std", "min", "max"], "statistic", "value")
    quartiles = quantiles(df, value, [0.25, 0.5, 0.75]).select(
        F.format_string("%.0f%%", F.col("probability") * 100).alias("statistic"), F.col("quantile").alias("value")
    )
    return moments.unionByName(quartiles)


def level_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def class_balance(labelled: DataFrame) -> DataFrame:
    """Per split: rows, positives, negatives, positive rate."""
    label = F.col("high_activity_risk")
    return labelled.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(label == 1).alias("positives"),
        F.count_if(label == 0).alias("negatives"),
        F.avg(label.cast("double")).alias("positive_rate"),
    )


def activity_percentiles(
    df: DataFrame, value: str = "total_activity", probabilities: tuple = (0.5, 0.75, 0.9, 0.95, 0.99)
) -> DataFrame:
    """Exact percentiles of any numeric column at the grain of the given table."""
    return quantiles(df, value, list(probabilities))


def warehouse_totals(fact: DataFrame) -> DataFrame:
    return fact.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("total_sms").alias("total_sms"),
        F.sum("total_calls").alias("total_calls"),
        F.sum("internet_activity").alias("internet_activity"),
        F.sum("total_activity").alias("total_activity"),
    )
