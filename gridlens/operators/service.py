"""Service queries as operators over tables: one parameter set, or a table of them, per call."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.functions import columns as C
from gridlens.operators.alerts import with_severity
from gridlens.operators.joins import few_rows, small_side
from gridlens.operators.risk import RiskModel
from gridlens.operators.windows import last_hours

ACTIVITY_COLUMNS = [*S.MEASURES, "total_activity"]
RISK_COLUMNS = ["risk_score", "risk_level", "model_version"]


def latest_as_of(times: DataFrame) -> DataFrame:
    return times.agg(F.max("timestamp").alias("as_of"))


def _as_of(times: DataFrame, as_of: datetime | None) -> Column:
    """The given time, or the latest one as a scalar subquery."""
    return F.lit(as_of) if as_of is not None else latest_as_of(times).scalar()


def network_summary(activity: DataFrame, as_of: datetime | None = None) -> DataFrame:
    """Total, active cells, peak hour and top cell per timestamp, or at one. `activity` is the star or hourly table.

    Each cell has one row per timestamp there, so rows count cells, and only one row per timestamp and task is
    shuffled.
    """
    if as_of is not None:
        activity = activity.where(F.col("timestamp") == F.lit(as_of))
    largest = F.struct(F.col("total_activity"), -F.col("grid_id"))
    return activity.groupBy(F.col("timestamp").alias("as_of")).agg(
        F.sum("total_activity").alias("total_activity"),
        F.count("grid_id").alias("active_grids"),
        F.max(F.hour("timestamp")).alias("peak_hour"),
        F.max_by("grid_id", largest).alias("top_grid"),
    )


def key_as_of(times: DataFrame, as_of: datetime | None = None) -> int | None:
    """time_key of a time, by default of the latest one. Reads dim_time only; one number comes back."""
    if as_of is not None:
        times = times.where(F.col("timestamp") == F.lit(as_of))
    return times.agg(F.max("time_key")).first()[0]


def fact_at(fact: DataFrame, key: int | None) -> DataFrame:
    """Fact rows of one time key, a plain filter that the scan takes, with their timestamp."""
    number = F.lit(key).cast("long")
    return fact.where(F.col("time_key") == number).withColumn("timestamp", F.timestamp_seconds(number))


def latest_network_summary(fact: DataFrame, times: DataFrame) -> DataFrame:
    return network_summary(fact_at(fact, key_as_of(times)))


def grid_activity(
    activity: DataFrame,
    grids: DataFrame,
    date: str | None = None,
    hour: int | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Activity of the requested cells: their last 24 rows, or the rows at the given date, hour and time.

    `grids` has a grid_id column and may hold one cell or all; cells without activity are not found.
    """
    wanted = grids.select("grid_id").distinct()
    rows = activity.join(wanted, "grid_id", "left_semi")
    if date is None and hour is None and as_of is None:
        found = last_hours(rows)
    else:
        if date is not None:
            rows = rows.where(F.col("date") == F.lit(date).cast("date"))
        if hour is not None:
            rows = rows.where(F.col("hour") == hour)
        if as_of is not None:
            rows = rows.where(F.col("timestamp") == F.lit(as_of))
        found = rows
    return found.select("grid_id", "timestamp", *ACTIVITY_COLUMNS)


def require_grid(grids: DataFrame, grid_id: int) -> None:
    if not grids.where(F.col("grid_id") == grid_id).take(1):
        raise LookupError(f"grid {grid_id} does not exist")


def grid_location(grids: DataFrame, requested: DataFrame) -> DataFrame:
    """Centroid and geometry reference of the requested cells, without the polygon."""
    wanted = requested.select("grid_id")
    columns = ["grid_id", "centroid_lat", "centroid_lon", "geometry_reference"]
    return grids.select(*columns).join(wanted, "grid_id", "left_semi")


def _last_alert_per_grid(alerts: DataFrame) -> DataFrame:
    """The alert listed last for each cell; rules are listed high, drop, spike within a row."""
    listed = (
        F.when(F.col("alert_type") == "HIGH_ACTIVITY", 1)
        .when(F.col("alert_type") == "ACTIVITY_DROP", 2)
        .when(F.col("alert_type") == "ACTIVITY_SPIKE", 3)
        .otherwise(0)
    )
    return with_severity(alerts).groupBy("grid_id").agg(
        F.max_by(F.struct("severity", "reason"), F.struct(listed, F.col("alert_type"))).alias("alert")
    )


def network_hotspots(
    fact: DataFrame,
    times: DataFrame,
    risk: DataFrame,
    alerts: DataFrame,
    limit: int = 50,
    severity: str | None = None,
    as_of: datetime | None = None,
    filter_first: bool = False,
) -> DataFrame:
    """The most active cells at a time with risk and alert status.

    The severity filter applies to the cells already ranked, so fewer than `limit` may remain; filter_first
    ranks only cells with that severity instead.
    """
    key = key_as_of(times, as_of)
    now = F.col("timestamp") == F.timestamp_seconds(F.lit(key).cast("long"))
    ranked = fact_at(fact, key).select("grid_id", "timestamp", "total_activity")
    current = _last_alert_per_grid(alerts.where(now))
    if severity is not None:
        current = current.where(F.upper("alert.severity") == severity.upper())
    if severity is not None and filter_first:
        ranked = ranked.join(current.select("grid_id"), "grid_id", "left_semi")
    top = ranked.orderBy(F.desc("total_activity"), "grid_id").limit(limit)
    scores = risk.where(now).select("grid_id", *RISK_COLUMNS)
    return (
        top.join(current, "grid_id", "left" if severity is None else "inner")
        .join(scores, "grid_id", "left")
        .select(
            "grid_id",
            "timestamp",
            "total_activity",
            F.coalesce("alert.severity", F.lit("NORMAL")).alias("status"),
            F.coalesce("alert.reason", F.lit(S.DEFAULT_HOTSPOT_REASON)).alias("reason"),
            *RISK_COLUMNS,
        )
    )


def feed_order() -> list[Column]:
    """Newest first, then by severity, cell and type."""
    return [F.desc("timestamp"), F.desc("severity_rank"), F.desc("grid_id"), F.desc("alert_type")]


def alert_feed(
    alerts: DataFrame,
    risk: DataFrame,
    times: DataFrame,
    limit: int = 50,
    severity: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """The newest alerts up to a time, with the risk of the same cell and hour."""
    listed = with_severity(alerts).where(F.col("timestamp") <= _as_of(times, as_of))
    if severity is not None:
        listed = listed.where(F.upper("severity") == severity.upper())
    newest = listed.withColumn("severity_rank", C.severity_rank(F.col("severity"))).orderBy(*feed_order()).limit(limit)
    scores = risk.select("grid_id", "timestamp", *RISK_COLUMNS)
    keys = ["grid_id", "timestamp"]
    # an outer join cannot broadcast the side that it keeps whole, so the scores are cut to the listed keys first
    listed_scores = scores.join(few_rows(newest.select(*keys).distinct(), limit), keys, "left_semi")
    return newest.join(listed_scores, keys, "left").select(
        "grid_id",
        "timestamp",
        "alert_type",
        "current_activity",
        "baseline_activity",
        "severity",
        "severity_rank",
        "reason",
        *RISK_COLUMNS,
    )


def predict_risk(
    requests: DataFrame,
    features: DataFrame,
    hourly: DataFrame,
    anomalies: DataFrame,
    model: RiskModel,
    tolerance: float = 1e-4,
) -> DataFrame:
    """Answers every request (grid_id, timestamp, total_activity) with a score or with the reason there is none.

    Each table is cut to the requests' time range, which its scan takes, and to the requested keys before anything
    is counted; the keys are broadcast if they measure small.
    """
    keys = ["grid_id", "timestamp"]
    span = requests.agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).first()
    asked = small_side(requests.select(*keys).distinct())
    hours = small_side(requests.select("grid_id", F.date_trunc("hour", "timestamp").alias("hour_start")).distinct())

    def requested(df: DataFrame) -> DataFrame:
        return df.where(F.col("timestamp").between(F.lit(span["first"]), F.lit(span["last"]))).join(asked, keys, "left_semi")

    by_key = requested(features.withColumnRenamed("feature_timestamp", "timestamp")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("feature_rows"), *[F.min(f).alias(f) for f in S.FEATURES]
    )
    source = requested(hourly).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("activity_rows"), F.min("total_activity").alias("source_activity")
    )
    whole_hours = F.date_trunc("hour", F.lit(span["first"])), F.date_trunc("hour", F.lit(span["last"])) + F.expr("INTERVAL 1 HOUR")
    near = anomalies.where((F.col("timestamp") >= whole_hours[0]) & (F.col("timestamp") < whole_hours[1]))
    near = near.withColumn("hour_start", F.date_trunc("hour", "timestamp")).join(hours, ["grid_id", "hour_start"], "left_semi")
    notes = near.groupBy("grid_id", "hour_start").agg(
        F.min_by(F.struct("direction", "anomaly_score", "reason"), "timestamp").alias("anomaly")
    )
    joined = (
        requests.join(by_key, keys, "left")
        .join(source, keys, "left")
        .withColumn("hour_start", F.date_trunc("hour", "timestamp"))
        .join(notes, ["grid_id", "hour_start"], "left")
        .drop("hour_start")
    )
    status = (
        F.when(F.col("feature_rows").isNull(), "NO_FEATURES")
        .when(F.col("feature_rows") > 1, "MULTIPLE_FEATURES")
        .when(F.col("activity_rows").isNull(), "NO_ACTIVITY")
        .when(F.col("activity_rows") > 1, "MULTIPLE_ACTIVITY")
        .when(F.abs(F.col("total_activity") - F.col("source_activity")) > tolerance, "ACTIVITY_MISMATCH")
        .otherwise("OK")
    )
    answered = F.col("status") == "OK"
    note = F.when(F.col("anomaly").isNull(), S.NO_ANOMALY_REASON).otherwise(
        F.format_string(
            "ML4 anomaly status: %s. Anomaly score: %s. %s.",
            F.col("anomaly.direction"),
            C.number_text(F.col("anomaly.anomaly_score"), 4),
            F.col("anomaly.reason"),
        )
    )
    # --- fixed values: explanation texts ---
    intro = F.concat(
        F.lit("ML3 risk prediction generated using features at "), F.col("timestamp").cast("string"), F.lit(". ")
    )
    return (
        joined.withColumn("status", status)
        .withColumn("risk_score", F.when(answered, model.probability()))
        .select(
            *requests.columns,
            "status",
            "risk_score",
            F.when(answered, C.risk_level(F.col("risk_score"))).alias("risk_level"),
            F.when(answered, F.lit(model.version)).alias("model_version"),
            F.when(answered, F.concat(intro, note)).alias("explanation_note"),
        )
    )


def parse_task_status(reason: Column) -> Column:
    """A map from the dict literal that ends a status reason, or an empty map."""
    literal = F.regexp_extract(reason, r"(\{.*\})\s*$", 1)
    as_json = F.regexp_replace(literal, r":\s*None\b", ": null")
    return F.coalesce(F.from_json(as_json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def latest_run_status(status_log: DataFrame, now: datetime | Column) -> DataFrame:
    """Health, reasons, counters and freshness of the latest run, in one pass over the log."""
    moment = now if isinstance(now, Column) else F.lit(now)
    blank = F.coalesce(F.trim("as_of_reason"), F.lit("")) == ""
    succeeded = (F.upper("overall_status") == "SUCCESS") & ~blank
    order = F.struct("timestamp", "run_id")
    latest = status_log.where(F.col("timestamp").isNotNull()).agg(
        F.max_by(F.struct(*status_log.columns), order).alias("run"),
        F.max_by("as_of_reason", F.when(succeeded, order)).alias("last_success"),
    )
    as_of = F.coalesce(F.try_to_timestamp(F.trim("run.as_of_reason")), F.try_to_timestamp("last_success"))
    failed = F.map_keys(F.map_filter("run.task_status", lambda _, state: state != "success"))
    healthy = F.col("overall_status") == "SUCCESS"
    # --- fixed values: status reasons ---
    problems = F.array_compact(
        F.array(
            F.concat(F.lit("Latest pipeline run status is "), F.col("overall_status")),
            F.when(
                F.size("failed_tasks") > 0,
                F.concat(F.lit("Failed or incomplete tasks: "), F.array_join("failed_tasks", ", ")),
            ),
        )
    )
    hours = (F.unix_micros(moment) - F.unix_micros("as_of")) / 3_600_000_000
    return (
        latest.where(F.col("run").isNotNull())
        .select(
            "run.run_id",
            F.col("run.timestamp").alias("run_timestamp"),
            F.upper(F.coalesce("run.overall_status", F.lit("UNKNOWN"))).alias("overall_status"),
            "run.task_status",
            F.array_sort(F.coalesce(failed, F.array().cast("array<string>"))).alias("failed_tasks"),
            "run.rows_in",
            "run.rows_rejected",
            "run.nulls_handled",
            "run.rows_published",
            as_of.alias("as_of"),
        )
        .withColumn("healthy", healthy)
        .withColumn("reasons", F.when(healthy, F.array().cast("array<string>")).otherwise(problems))
        .withColumn("freshness_hours", hours)
        .withColumn(
            "freshness_indicator",
            F.when(~F.col("healthy"), "STALE_OR_UNHEALTHY")
            .when(F.col("freshness_hours").isNull(), "UNKNOWN")
            .when(F.col("freshness_hours") <= 24, "FRESH")
            .otherwise("STALE"),
        )
    )


def map_status(hotspots: DataFrame, feed: DataFrame) -> DataFrame:
    """Status per cell for the map: the alert listed last in the feed wins over the hotspot status."""
    level = F.upper(F.coalesce("severity", F.lit("LOW")))
    shown = F.when(level == "HIGH", "HIGH").when(level == "MEDIUM", "ATTENTION").otherwise("NORMAL")
    position = F.struct("timestamp", C.severity_rank(F.col("severity")), "alert_type")
    alerted = feed.groupBy("grid_id").agg(F.min_by(shown, position).alias("alert_status"))
    hot = hotspots.groupBy("grid_id").agg(F.max(F.upper(F.coalesce("status", F.lit("NORMAL")))).alias("hot_status"))
    return alerted.join(hot, "grid_id", "full_outer").select(
        "grid_id", F.coalesce("alert_status", "hot_status").alias("status")
    )


def visible_features(features: DataFrame, hotspots: DataFrame, feed: DataFrame) -> DataFrame:
    """Geometry of the cells on the map only."""
    shown = hotspots.select("grid_id").unionByName(feed.select("grid_id")).distinct()
    return features.join(shown, "grid_id", "left_semi")


def dashboard_counters(hotspots: DataFrame, feed: DataFrame) -> DataFrame:
    level = F.upper("severity")
    alerts = feed.agg(
        F.count(F.lit(1)).alias("alerts"),
        F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "MEDIUM").alias("attention"),
    )
    hot = hotspots.agg(F.count(F.lit(1)).alias("hotspots"))
    names = ["hotspots", "alerts", "high", "attention"]
    both = hot.unionByName(alerts, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in names])
