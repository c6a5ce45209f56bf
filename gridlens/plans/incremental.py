"""Tables that grow landing by landing; a landing rewrites only the partitions that its rows reach.

Where a change goes:
* rows of a day -> the cells' hours of that day -> fact, calendar and alerts of that day, whose rules look at one day;
* an hour of a cell -> the feature windows that hold it: the rows up to AFTER before and BEFORE after it in its cell, on whatever days they lie;
* an hour of a cell -> its bucket (cell, hour of day): the bucket's order summary takes the new value and gives back the old one,
  and with it the median of others moves for every row of the bucket. Scores are therefore not stored: `scores` joins hours with the middle values of their
  bucket, so no day is rewritten because a median moved.

A landing may be repeated after a failure at any point, with the same rows: its own activity replaces itself, what the hours were before it is
kept on its first attempt, partitions are overwritten whole, and order summaries are read as the last landing in the commit log left them.
One landing runs at a time.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators import aggregate, alerts, anomaly, clean, features, order_stats, warehouse
from gridlens.operators.joins import by_merge, small_side
from gridlens.operators.windows import along_time
from gridlens.session import stage
from gridlens.sources import tables
from gridlens.streaming import landing as gate

#: Rows of a cell on either side of a changed one whose windows hold it.
BEFORE, AFTER = 5, 1
#: Days around a landing in which its cells' neighbouring rows are looked for first; cells with too few there are read whole.
REACH_DAYS = 31
#: Folders of order summaries; a cell lies in one of them.
BLOCKS = 64
BUCKET = ["grid_id", "hour"]
COMMIT = "landing string, number long, days array<date>, blocks array<int>"


def _listed(df: DataFrame, column: str) -> list:
    """The distinct values of a partition column; days are bounded by the calendar, blocks by BLOCKS."""
    return sorted(row[0] for row in df.select(column).distinct().collect())


def block_of(cell: str) -> Column:
    return F.pmod(F.xxhash64(F.col(cell).cast("long")), F.lit(BLOCKS)).cast("int")


class Store:
    """The folder of all tables."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def find(self, name: str) -> DataFrame | None:
        """A table, or None before anything was written to it."""
        try:
            return self.spark.read.parquet(self.path(name))
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None

    def table(self, name: str, days: list[date] | None = None) -> DataFrame:
        found = self.find(name)
        if found is None:
            raise LookupError(f"no table {name} under {self.root}")
        return found if days is None else found.where(F.col("date").isin(days))

    def replace_days(self, name: str, df: DataFrame, days: list[date], sort_by: list[str]) -> None:
        """The rows of these days become those of df; a day without rows is emptied."""
        df = stage(df, name.replace("/", "-"))
        tables.write_by_day(df, self.path(name), sort_by)
        for day in sorted(set(days) - set(_listed(df, "date"))):
            df.drop("date").limit(0).write.mode("overwrite").parquet(f"{self.path(name)}/date={day}")

    def commits(self) -> DataFrame:
        found = self.find("commits")
        return self.spark.createDataFrame([], COMMIT) if found is None else found

    def commit(self, landing: str, days: list[date], blocks: list[int]) -> None:
        row = self.spark.createDataFrame([(landing, self.commits().count(), days, blocks)], COMMIT)
        tables.append_rows(row.coalesce(1), self.path("commits"))

    def summary(self, name: str, blocks: list[int] | None = None) -> DataFrame | None:
        """An order summary or its middle values as the last commit left them: of each block the version of the last landing that touched it."""
        touched = self.commits().select(F.explode("blocks").alias("block"), "number", "landing")
        latest = touched.groupBy("block").agg(F.max_by("landing", "number").alias("landing")).collect()
        versions = {r["block"]: r["landing"] for r in latest if blocks is None or r["block"] in blocks}
        if not versions:
            return None
        by_landing: dict[str, list[int]] = {}
        for block, landing in versions.items():
            by_landing.setdefault(landing, []).append(block)
        found = self.table(name)
        current = [(F.col("landing") == landing) & F.col("block").isin(held) for landing, held in by_landing.items()]
        chosen = current[0]
        for condition in current[1:]:
            chosen = chosen | condition
        return found.where(chosen).drop("landing", "block")

    def scores(self) -> DataFrame:
        """Anomaly scores of all hours."""
        rows = self.table("hourly").select("grid_id", "timestamp", "hour", "total_activity")
        return anomaly.score_against_baseline(order_stats.medians_of_others(rows, self.summary("middles"), BUCKET))


def _neighbourhood(store: Store, changed: DataFrame, days: list[date]) -> DataFrame:
    """Rows of the changed cells that cover every window which holds a changed row, and every window of those rows.

    Regular cells are read REACH_DAYS around the landing; a cell with too few rows there, unless the table ends, is read whole.
    """
    columns = ["grid_id", "timestamp", "total_activity", "internet_activity", "date"]
    hourly = store.table("hourly").select(*columns)
    need = BEFORE + AFTER
    first, last = store.table("dim_time").agg(F.min("date"), F.max("date")).first()
    low, high = days[0] - timedelta(days=REACH_DAYS), days[-1] + timedelta(days=REACH_DAYS)
    cells = changed.groupBy("grid_id").agg(F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    near = stage(hourly.where(F.col("date").between(low, high)).join(by_merge(cells), "grid_id"), "near-hours")
    if low <= first and high >= last:
        return near.select(*columns)
    missing = F.lit(False)
    if low > first:
        missing = missing | (F.count_if(F.col("timestamp") < F.col("_first")) < need)
    if high < last:
        missing = missing | (F.count_if(F.col("timestamp") > F.col("_last")) < need)
    sparse = stage(near.groupBy("grid_id").agg(missing.alias("_sparse")).where("_sparse").select("grid_id"), "sparse-cells")
    if sparse.isEmpty():
        return near.select(*columns)
    sparse = by_merge(sparse)
    whole = hourly.join(sparse, "grid_id", "left_semi")
    return near.join(sparse, "grid_id", "left_anti").select(*columns).unionByName(whole)


def _refresh_windows(store: Store, changed: DataFrame, days: list[date], threshold: float) -> list[date]:
    """Features and labelled rows of the windows that hold a changed row; the days rewritten."""
    rows = _neighbourhood(store, changed, days)
    rows = stage(rows.join(by_merge(changed.withColumn("changed", F.lit(1))), S.CELL_HOUR, "left"), "neighbourhood")
    holds = lambda w: [F.max("changed").over(w.rowsBetween(-BEFORE, AFTER)).alias("touched")]
    touched = along_time(rows, holds, ["grid_id"], before=BEFORE, after=AFTER).where("touched = 1")
    touched = stage(touched.select("grid_id", F.col("timestamp").alias("feature_timestamp"), "date"), "touched-windows")
    reached = _listed(touched, "date")
    keys = ["grid_id", "feature_timestamp"]
    made = {"features": features.network_features(rows), "training_set": features.training_set(rows, threshold)}
    for name, fresh in made.items():
        fresh = fresh.join(by_merge(touched), keys)
        if store.find(name) is not None:
            old = store.table(name, reached)
            fresh = old.join(by_merge(touched.select(*keys)), keys, "left_anti").select(*fresh.columns).unionByName(fresh)
        store.replace_days(name, fresh, reached, keys)
    return reached


def _refresh_summaries(store: Store, landing: str, before: DataFrame, after: DataFrame) -> list[int]:
    """Order summaries with the hours after the landing in place of those before it; the blocks rewritten."""
    taken = order_stats.value_counts(before, BUCKET, "total_activity").withColumn("rows", -F.col("rows"))
    moved = order_stats.merged_counts([order_stats.value_counts(after, BUCKET, "total_activity"), taken], BUCKET)
    moved = stage(moved.withColumn("block", block_of("grid_id")), "moved-values")
    blocks = _listed(moved, "block")
    if not blocks:
        return []
    old = store.summary("value_counts", blocks)
    merged = order_stats.merged_counts([moved.drop("block"), *([] if old is None else [old])], BUCKET)
    version = [block_of("grid_id").alias("block"), F.lit(landing).alias("landing")]

    def write(df: DataFrame, name: str) -> None:
        spread = df.select("*", *version).repartitionByRange("block", *BUCKET).sortWithinPartitions("block", *BUCKET)
        writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("block", "landing").parquet(store.path(name))

    write(merged, "value_counts")
    written = store.table("value_counts").where((F.col("landing") == landing) & F.col("block").isin(blocks))
    write(order_stats.middle_values(written.drop("block", "landing"), BUCKET), "middles")
    return blocks


def apply_landing(
    store: Store, raw: DataFrame, landing: str, threshold: float = S.HIGH_ACTIVITY_THRESHOLD, decimals: int | None = None
) -> dict[str, list]:
    """Takes the raw rows of one landing into all tables; the days and blocks that were rewritten, by table."""
    if not store.commits().where(F.col("landing") == landing).isEmpty():
        return {}
    good = clean.clean_activity(clean.to_canonical(raw)).withColumn("landing", F.lit(landing))
    writer = good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "landing").parquet(store.path("activity"))
    written = store.find("activity")
    mine = None if written is None else written.where(F.col("landing") == landing)
    days = [] if mine is None else _listed(mine, "date")
    if not days:
        store.commit(landing, [], [])
        return {}
    changed = stage(mine.select(*S.CELL_HOUR).distinct(), "changed-hours")
    after = stage(aggregate.hourly_grid_summary(store.table("activity", days).drop("landing"), decimals), "hours-after")
    if store.find(f"before/{landing}") is None:
        known = store.find("hourly")
        before = after.limit(0) if known is None else store.table("hourly", days).select(*after.columns)
        before.write.mode("overwrite").parquet(store.path(f"before/{landing}"))
    before = store.table(f"before/{landing}")

    store.replace_days("hourly", after, days, S.CELL_HOUR)
    times = stage(warehouse.dim_time(after), "times-after")
    store.replace_days("dim_time", times, days, ["time_key"])
    store.replace_days("fact_network_activity", warehouse.with_day(warehouse.fact_network_activity(after, times)), days, ["time_key", "grid_id"])
    fired = alerts.network_alerts(after)
    store.replace_days("network_alerts", fired.withColumn("date", F.col("source_file")), days, S.CELL_HOUR)
    reached = _refresh_windows(store, changed, days, threshold)
    blocks = _refresh_summaries(store, landing, before, after)
    store.commit(landing, days, blocks)
    return {"hourly": days, "network_alerts": days, "features": reached, "training_set": reached, "middles": blocks}


def take_batches(store: Store, zone_dir: str, threshold: float = S.HIGH_ACTIVITY_THRESHOLD, decimals: int | None = None) -> dict[str, dict[str, list]]:
    """Takes the files that the gate on a stream has accepted since the last call, each of its batches as a landing; what each rewrote."""
    spark = store.spark
    accepted = gate.audit_log(spark, zone_dir).where("stream = 'lines' AND status = 'ACCEPTED'")
    name = F.concat(F.lit("batch-"), F.col("batch").cast("string"))
    done = store.commits().select("landing")
    new = accepted.select("batch", name.alias("landing")).distinct().join(done, "landing", "left_anti")
    taken = {}
    for row in new.orderBy("batch").collect():  # one for each run of the gate since then
        files = accepted.where(F.col("batch") == row["batch"]).select(F.col("filename").alias("source_file"))
        raw = spark.read.parquet(f"{zone_dir}/{gate.RAW}").join(small_side(files), "source_file", "left_semi")
        taken[row["landing"]] = apply_landing(store, raw.select(*S.RAW_COLUMNS), row["landing"], threshold, decimals)
    return taken
