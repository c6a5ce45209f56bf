"""The top-20 attention report: predicted risk and anomaly of each cell and hour, ranked."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.functions import columns as C
from gridlens.operators.clean import require_columns
from gridlens.operators.joins import few_rows


def risk_with_anomaly(risk: DataFrame, scores: DataFrame) -> DataFrame:
    """Anomaly of the same cell, date and hour beside each risk score, with defaults where there is none. Its reason, a text,
    is left out: look it up by cell and anomaly_time for the rows that are shown."""
    require_columns(risk, ["grid_id", "timestamp", "risk_score", "risk_level", "model_version"], "risk scores")
    require_columns(scores, ["grid_id", "timestamp", "anomaly_score", "direction", "reason"], "anomaly scores")
    hour = F.date_trunc("hour", "timestamp").alias("match_hour")
    anomalies = scores.select("grid_id", hour, F.col("timestamp").alias("anomaly_time"), "anomaly_score", "direction")
    return (
        risk.withColumn("match_hour", F.date_trunc("hour", "timestamp"))
        .join(anomalies, ["grid_id", "match_hour"], "left")
        .drop("match_hour")
        .withColumns(
            {
                "anomaly_score": F.coalesce("anomaly_score", F.lit(0.0)),
                "direction": F.coalesce("direction", F.lit(S.NO_ANOMALY_DIRECTION)),
            }
        )
    )


def with_attention_score(joined: DataFrame) -> DataFrame:
    return joined.withColumn(
        "attention_score", F.greatest(F.col("risk_score"), F.lit(0.0)) + F.abs("anomaly_score")
    )


def attention_report(risk: DataFrame, scores: DataFrame, limit: int = 20) -> DataFrame:
    """The highest attention scores with rank and text. Rows are ranked on numbers; texts are fetched for the ranked ones."""
    order = [F.desc("attention_score"), F.desc("risk_score"), F.desc("anomaly_score"), "grid_id", "timestamp"]
    top = with_attention_score(risk_with_anomaly(risk, scores)).orderBy(*order).limit(limit)
    reasons = scores.select("grid_id", F.col("timestamp").alias("anomaly_time"), "reason")
    top = reasons.join(few_rows(top, limit), ["grid_id", "anomaly_time"], "right")
    top = top.withColumn("reason", F.coalesce("reason", F.lit(S.NO_ANOMALY_REASON)))
    text = F.format_string(
        S.ATTENTION_TEXT,
        F.col("grid_id").cast("long"),
        C.number_text(F.col("risk_score"), 4),
        F.col("risk_level"),
        F.col("direction"),
        C.number_text(F.col("anomaly_score"), 4),
        F.col("reason"),
    )
    return top.select(
        F.row_number().over(Window.orderBy(*order)).alias("rank"),
        "grid_id",
        "timestamp",
        "risk_score",
        "risk_level",
        "model_version",
        "direction",
        "anomaly_score",
        "attention_score",
        text.alias("attention_reason"),
    )
