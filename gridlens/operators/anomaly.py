"""Same-hour anomaly scores against the median of a cell's other days."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.functions import columns as C
from gridlens.operators.order_stats import leave_one_out_median


def anomaly_scores(hourly: DataFrame, **options) -> DataFrame:
    """Scores every row of a table with unique (cell, timestamp) keys; options go to leave_one_out_median."""
    rows = hourly.select("grid_id", "timestamp", "hour", "total_activity")
    return score_against_baseline(leave_one_out_median(rows, ["grid_id", "hour"], **options))


def score_against_baseline(rows: DataFrame) -> DataFrame:
    """deviation, anomaly_score, direction and reason from total_activity and baseline_activity."""
    baseline, score = F.col("baseline_activity"), F.col("anomaly_score")
    return (
        rows.withColumn("deviation", F.col("total_activity") - baseline)
        .withColumn("anomaly_score", C.ratio_or_zero(F.col("deviation"), baseline))
        .withColumn("direction", C.anomaly_direction(score, baseline))
        .withColumn("reason", C.anomaly_reason(score, baseline, F.col("grid_id"), F.col("hour")))
    )


def top_anomalies(scores: DataFrame, direction: str, limit: int = 10) -> DataFrame:
    """The most extreme HIGH or LOW scores."""
    score = F.col("anomaly_score")
    extreme = score.desc() if direction == "HIGH" else score.asc()
    return scores.where(F.col("direction") == direction).orderBy(extreme, "grid_id", "timestamp").limit(limit)
