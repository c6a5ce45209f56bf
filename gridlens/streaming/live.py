"""Structured Streaming counterparts: live hourly aggregation with or without late rows, live scoring and alerts, incremental file ingest."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridlens import schema as S
from gridlens.functions import columns as C
from gridlens.operators.aggregate import exact_sum, hourly_grid_summary
from gridlens.operators.alerts import activity_floor, fired_rules
from gridlens.operators.anomaly import score_against_baseline
from gridlens.operators.clean import add_calendar, add_totals, clean_activity, to_canonical
from gridlens.operators.joins import small_side
from gridlens.operators.order_stats import quantiles
from gridlens.session import stage


def live_hourly_grid(clean: DataFrame, lateness: str = "2 hours", decimals: int | None = None) -> DataFrame:
    """Hourly cell totals of a cleaned activity stream; an hour is emitted once the watermark has passed its end."""
    windows = (
        clean.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", "1 hour").alias("hour_window"), "grid_id")
        .agg(*[exact_sum(name, decimals).alias(name) for name in S.MEASURES])
    )
    hourly = windows.select("grid_id", F.col("hour_window.start").alias("timestamp"), *S.MEASURES)
    return add_totals(add_calendar(hourly))


def frozen_baseline(hourly: DataFrame) -> DataFrame:
    """Median activity per cell and hour of day over past days."""
    return quantiles(hourly, "total_activity", [0.5], ["grid_id", "hour"]).select(
        "grid_id", "hour", F.col("quantile").alias("baseline_activity")
    )


def live_scores(hourly_stream: DataFrame, baseline: DataFrame) -> DataFrame:
    """Anomaly score and alert type of each finished hour against the frozen baseline (stream-static join)."""
    rows = hourly_stream.select("grid_id", "timestamp", "hour", "total_activity")
    scored = score_against_baseline(rows.join(baseline, ["grid_id", "hour"], "left"))
    current, usual = F.col("total_activity"), F.col("baseline_activity")
    kind = F.when(current > usual * S.HIGH_MULTIPLIER, "HIGH_ACTIVITY").when(
        current < usual * S.DROP_FRACTION, "ACTIVITY_DROP"
    )
    return scored.withColumn("alert_type", kind).withColumn(
        "severity", F.when(F.col("alert_type").isNotNull(), C.severity(F.col("alert_type")))
    )


def read_raw_stream(spark: SparkSession, input_dir: str, pattern: str = S.DAILY_FILE_GLOB) -> DataFrame:
    """New daily files as they land, cleaned; the stream's checkpoint remembers which files were read."""
    raw = (
        spark.readStream.schema(S.RAW_SCHEMA).option("header", True).option("pathGlobFilter", pattern).csv(input_dir)
    )
    return clean_activity(to_canonical(raw))


def write_available(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Processes what is there and stops; a rerun with the same checkpoint takes only what is new."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(output)
    )
    query.awaitTermination()
    return query


def remaining_hours(clean: DataFrame, emitted: DataFrame, decimals: int | None = None) -> DataFrame:
    """The hours that a stopped stream has not emitted, from the same activity as a table: a stream holds an hour back until
    the watermark has passed its end, so once the source has ended these are all hours after the last one emitted."""
    last = emitted.agg(F.max("timestamp")).first()[0]
    if last is not None:
        clean = clean.where(F.col("timestamp") >= F.lit(last) + F.expr("INTERVAL 1 HOUR"))
    hours = clean.withColumn("timestamp", F.date_trunc("hour", "timestamp")).groupBy("grid_id", "timestamp")
    sums = hours.agg(*[exact_sum(name, decimals).alias(name) for name in S.MEASURES])
    return add_totals(add_calendar(sums))


def close_hours(clean: DataFrame, output: str, schema, decimals: int | None = None) -> None:
    """Writes the open hours of an ended source beside the stream's table, whose own files its log lists; may be repeated."""
    emitted = clean.sparkSession.read.schema(schema).parquet(output)
    remaining_hours(clean, emitted, decimals).select(*emitted.columns).write.mode("overwrite").parquet(f"{output}-closed")


def closed_hours(spark: SparkSession, output: str, schema) -> DataFrame:
    """All hours of a stream that was closed."""
    both = [spark.read.schema(schema).parquet(path) for path in (output, f"{output}-closed")]
    return both[0].unionByName(both[1])


def close_scores(
    clean: DataFrame, baseline: DataFrame, emitted: DataFrame, scores_path: str, alerts_path: str, decimals: int | None = None
) -> None:
    """Scores the open hours of an ended source, as one more batch; a repeated closing overwrites its own folder."""
    scored = live_scores(remaining_hours(clean, emitted, decimals), baseline)
    scored.write.mode("overwrite").parquet(f"{scores_path}/batch=-1")
    fired = scored.where(F.col("alert_type").isNotNull())
    fired.write.mode("overwrite").parquet(f"{alerts_path}/batch=-1")


def score_available(
    hourly_stream: DataFrame, baseline: DataFrame, scores_path: str, alerts_path: str, checkpoint: str
) -> StreamingQuery:
    """Writes scores and fired alerts of each micro-batch; a repeated batch overwrites its own folder."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = live_scores(batch, baseline).persist()
        scored.write.mode("overwrite").parquet(f"{scores_path}/batch={batch_id}")
        fired = scored.where(F.col("alert_type").isNotNull())
        fired.write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")
        scored.unpersist()

    query = (
        hourly_stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


# --- all three rules on a stream ---

LAST_ROW = "grid_id int, timestamp timestamp, date date, total_activity double"


def frozen_floors(hourly: DataFrame) -> DataFrame:
    """The activity floor for each day: that of the day before, which is known when the day begins."""
    return activity_floor(hourly).select(F.date_add("date", 1).alias("date"), "activity_floor")


def live_alerts(hours: DataFrame, earlier: DataFrame, baseline: DataFrame, floors: DataFrame) -> DataFrame:
    """Alerts of finished hours against the frozen baseline, the day's floor and the row before in the same cell and day.

    earlier holds the last rows seen before these hours; baseline and floors are tables, measured before they are broadcast.
    """
    columns = ["grid_id", "timestamp", "date", "total_activity"]
    both = hours.select(*columns, F.lit(True).alias("is_new")).unionByName(earlier.select(*columns, F.lit(False).alias("is_new")))
    before = F.lag("total_activity").over(Window.partitionBy("date", "grid_id").orderBy("timestamp"))
    rows = both.withColumn("prev_hour_activity", before).where("is_new").withColumn("hour", F.hour("timestamp"))
    judged = rows.join(small_side(baseline), ["grid_id", "hour"], "left").join(small_side(floors), "date", "left")
    return fired_rules(judged).select(
        "grid_id", "timestamp", "alert_type", F.col("total_activity").alias("current_activity"), "compared_activity",
        C.severity(F.col("alert_type")).alias("severity"),
    )


def _last_rows(hours: DataFrame, earlier: DataFrame) -> DataFrame:
    """The last row of each cell on the last day seen. Hours leave the stream in the order of time, so no earlier day is asked for again."""
    columns = ["grid_id", "timestamp", "date", "total_activity"]
    both = hours.select(*columns).unionByName(earlier.select(*columns))
    last = both.agg(F.max("date").alias("last_day"))
    today = both.join(F.broadcast(last), F.col("date") == F.col("last_day"))
    return today.groupBy("grid_id").agg(F.max_by(F.struct(*columns[1:]), "timestamp").alias("row")).select("grid_id", "row.*")


def _state_of(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.schema(LAST_ROW).parquet(f"{path}/batch={batch_id}") if batch_id >= 0 else spark.createDataFrame([], LAST_ROW)


def alert_available(
    hourly_stream: DataFrame, baseline: DataFrame, floors: DataFrame, output: str, checkpoint: str
) -> StreamingQuery:
    """Writes the finished hours and the alerts of each micro-batch, and the last rows that the next one compares with.

    The state is a table of its own for each batch, so a repeated batch starts from what the batch before it left and overwrites its own folders.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hours = stage(batch, "live-hours")
        earlier = _state_of(spark, f"{output}/state", batch_id - 1)
        fired = live_alerts(hours, earlier, baseline, floors)
        fired.write.mode("overwrite").parquet(f"{output}/alerts/batch={batch_id}")
        hours.write.mode("overwrite").parquet(f"{output}/hours/batch={batch_id}")
        _last_rows(hours, earlier).write.mode("overwrite").parquet(f"{output}/state/batch={batch_id}")

    query = (
        hourly_stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def close_alerts(
    clean: DataFrame, baseline: DataFrame, floors: DataFrame, output: str, schema, decimals: int | None = None
) -> None:
    """Alerts of the hours that an ended source left open, as one more batch; may be repeated. schema: that of the hourly stream."""
    spark = clean.sparkSession
    emitted = spark.read.schema(schema).parquet(f"{output}/hours/batch=[0-9]*")
    hours = stage(remaining_hours(clean, emitted, decimals), "open-hours")
    earlier = _last_rows(emitted, spark.createDataFrame([], LAST_ROW))
    live_alerts(hours, earlier, baseline, floors).write.mode("overwrite").parquet(f"{output}/alerts/batch=-1")


# --- hours that late rows may still change ---


def _by_hour(df: DataFrame) -> DataFrame:
    """Rows of an hour together, so that its folder gets one file, not one of every task; Spark splits hours that are too large for a task."""
    return df.hint("rebalance", "date", "hour")


def upsert_available(clean: DataFrame, output: str, checkpoint: str, decimals: int | None = None) -> StreamingQuery:
    """Keeps the hourly table of a cleaned activity stream right however late rows arrive; there is no watermark and nothing is dropped.

    The rows of each micro-batch go to a side table by hour and batch. The hours that they touch are summed again from all
    batches and replace their folders, so only these are read and written, and a repeated batch changes nothing.
    """
    in_hours = clean.withColumn("timestamp", F.date_trunc("hour", "timestamp"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("grid_id", "timestamp", *S.MEASURES, "date", F.hour("timestamp").alias("hour"), F.lit(batch_id).alias("batch"))
        writer = _by_hour(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("date", "hour", "batch").parquet(f"{output}/rows")
        try:
            kept = spark.read.parquet(f"{output}/rows")
        except AnalysisException as error:  # nothing has arrived yet
            if error.getCondition() != "UNABLE_TO_INFER_SCHEMA":
                raise
            return
        # a row for each hour of the batch; the scan opens the folders of these hours alone
        touched = stage(kept.where(F.col("batch") == batch_id).select("date", "hour").distinct(), "touched-hours")
        again = kept.join(small_side(touched), ["date", "hour"], "left_semi").drop("date", "hour", "batch")
        writer = _by_hour(hourly_grid_summary(again, decimals)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("date", "hour").parquet(f"{output}/hourly")

    query = (
        in_hours.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
