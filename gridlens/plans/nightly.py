"""The batch job: gate landing files, then build every table of one run and publish it.

Each run writes to its own folder and is published by one row in the status table, so a failed or repeated
run never touches what readers see. Steps hand over through tables only.
"""

from __future__ import annotations

import argparse
import logging
import sys
import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens import schema as S
from gridlens.operators import (
    aggregate,
    alerts,
    anomaly,
    clean,
    features,
    geo,
    quality,
    report,
    risk,
    warehouse,
)
from gridlens.operators.windows import chronological_parts, split_border
from gridlens.plans import incremental
from gridlens.session import build_session, stage
from gridlens.sources import files, tables
from gridlens.sources.geo import grid_lookup, read_feature_lines, read_split_features
from gridlens.streaming.landing import ingest_available

log = logging.getLogger("gridlens.nightly")


def _table_or_empty(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def ingest(spark: SparkSession, landing_dir: str, zone_dir: str, pattern: str = S.DAILY_FILE_GLOB) -> DataFrame:
    """Checks new landing files, stores accepted rows and rejected lines, and appends to the audit log.

    Names pass through the driver; ingest_available takes folders of any number of files. Only files without an audit entry are read. Zones are partitioned by file and overwritten per file, so
    repeating an interrupted ingest stores nothing twice.
    """
    audit = _table_or_empty(spark, f"{zone_dir}/audit", S.AUDIT_SCHEMA)
    landed = files.list_files(spark, landing_dir, pattern)
    skipped = files.skipped_files(landed, audit)
    fresh = files.new_files(landed, audit)
    fresh_paths = {row["file"]: row["path"] for row in fresh.collect()}
    if fresh_paths:
        lines = files.read_lines(spark, list(fresh_paths.values()))
        judged, records = files.judge_and_gather(lines, fresh)
        judged = stage(judged, "verdicts")
        _replace_files(files.accepted_rows(lines, judged, records), f"{zone_dir}/raw", "source_file")
        _replace_files(files.route_lines(lines, judged, False), f"{zone_dir}/rejected", "file")
        verdicts = judged.drop("broken")
    else:
        verdicts = spark.createDataFrame([], "file string, ok boolean, reason string")
    entries = stage(files.audit_rows(verdicts, skipped), "audit")
    tables.append_rows(entries, f"{zone_dir}/audit")
    return entries


def _replace_files(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


class Run:
    """One nightly run: its folder, the state of its steps and its counters."""

    def __init__(self, spark: SparkSession, output_dir: str, run_id: str):
        self.spark, self.output_dir, self.run_id = spark, output_dir, run_id
        self.states: dict[str, str] = {}
        self.counts: dict[str, int | None] = {}

    def path(self, name: str) -> str:
        return f"{self.output_dir}/runs/{self.run_id}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def step(self, name: str, work) -> None:
        log.info("step %s starting", name)
        try:
            work()
        except Exception:
            self.states[name] = "failed"
            raise
        self.states.setdefault(name, "success")
        log.info("step %s %s", name, self.states[name])


def _clean_step(run: Run, raw: DataFrame) -> None:
    flagged = clean.flag_rejects(clean.to_canonical(raw))
    kept = F.col("reject_cause").isNull()
    null_cells = sum((F.col(m).isNull().cast("long") for m in S.MEASURES), F.lit(0).cast("long"))
    seen = Observation("cleaning")
    observed = flagged.observe(
        seen,
        F.count(F.lit(1)).alias("rows_in"),
        F.sum(F.when(kept, 0).otherwise(1)).alias("rows_rejected"),
        F.sum(F.when(kept, null_cells).otherwise(0)).alias("nulls_handled"),
    )
    good = observed.where(kept).drop("reject_cause").fillna(0.0, S.MEASURES)
    tables.write_activity(clean.add_totals(clean.add_calendar(good)), run.path("activity"))
    run.counts.update(seen.get)
    if not run.counts["rows_in"]:
        raise FileNotFoundError("the raw zone is empty")


def _hourly_step(run: Run, decimals: int | None) -> None:
    cleaned = run.table("activity")
    tables.write_hourly(aggregate.hourly_grid_summary(cleaned, decimals), run.path("hourly_grid_summary"))
    hourly = run.table("hourly_grid_summary")
    quality.require_gate(quality.analytics_gate(hourly))
    tables.write_small_csv(aggregate.top_hotspots(hourly), run.path("dashboard_csv"))
    tables.write_table(aggregate.daily_kpis(hourly), run.path("daily_kpis"))
    tables.write_table(aggregate.grid_kpis(hourly), run.path("grid_kpis"))


def _geo_step(run: Run, grid_path: str | None) -> None:
    if grid_path is None:
        run.states["geometry"] = "skipped"
        return
    lines = grid_path.rstrip("/").endswith((".jsonl", ".geojsonl"))
    cells = (read_feature_lines if lines else read_split_features)(run.spark, grid_path)
    tables.write_table(grid_lookup(cells), run.path("grid_lookup"))
    tables.write_table(warehouse.dim_grid(cells, grid_path.rsplit("/", 1)[-1]), run.path("dim_grid"))
    lookup, hourly = run.table("grid_lookup"), run.table("hourly_grid_summary")
    covered = geo.enrichment_coverage(hourly, lookup).first()
    if not covered["passed"]:
        raise ValueError(f"geometry does not cover the activity: {covered.asDict()}")
    tables.write_table(geo.enrich(hourly, lookup), run.path("hourly_grid_geo"))


def _warehouse_step(run: Run) -> None:
    hourly = run.table("hourly_grid_summary")
    tables.write_table(warehouse.dim_time(hourly), run.path("dim_time"))
    fact = warehouse.fact_network_activity(hourly, run.table("dim_time"))
    tables.write_by_day(warehouse.with_day(fact), run.path("fact_network_activity"), ["time_key", "grid_id"])
    written = run.table("fact_network_activity")
    run.counts["rows_published"] = written.count()
    if run.states.get("geometry") == "success":
        active = run.table("dim_grid").join(hourly.select("grid_id").distinct(), "grid_id", "left_semi")
        quality.require_gate(warehouse.warehouse_checks(hourly, written, active))


def _analytics_step(run: Run) -> None:
    hourly = run.table("hourly_grid_summary")
    tables.write_table(alerts.network_alerts(hourly), run.path("network_alerts"), ["timestamp", "grid_id"], clustered=True)
    tables.write_table(anomaly.anomaly_scores(hourly), run.path("anomaly_scores"), ["grid_id", "timestamp"], clustered=True)
    feature_order = ["grid_id", "feature_timestamp"]
    tables.write_table(features.network_features(hourly), run.path("network_feature_table"), feature_order, clustered=True)


def _risk_step(run: Run, threshold: float) -> None:
    feature_table = run.table("network_feature_table")
    labelled = features.training_set(run.table("hourly_grid_summary"), threshold)
    tables.write_table(labelled, run.path("training_set"), ["feature_timestamp"])
    stored = run.table("training_set")
    if stored.isEmpty():
        run.states["risk"] = "skipped"
        return
    border = split_border(stored, "feature_timestamp")
    train, test = chronological_parts(stored, "feature_timestamp", border)
    if train.select("high_activity_risk").distinct().count() < 2:
        run.states["risk"] = "skipped"
        return
    split = features.require_valid_split(features.split_training_set(stored, border=border))
    model = risk.fit_risk(train)
    risk.save_model(run.spark, model, run.path("risk_model"))
    tables.write_small_csv(risk.coefficient_table(run.spark, model), run.path("model_coefficients_csv"))
    predicted = risk.predict(test, model)
    tables.write_table(risk.compare_with_rules(predicted, run.table("network_alerts")), run.path("rule_comparison"))
    compared = run.table("rule_comparison")
    tables.write_table(risk.evaluation_record(split, compared, threshold), run.path("evaluation"))
    flags = risk.three_way(compared.drop("np3_positive"), run.table("anomaly_scores"), run.table("network_alerts"))
    tables.write_table(flags, run.path("three_way_comparison"))
    scored = risk.risk_scores(risk.check_scoring_input(feature_table), model)
    tables.write_table(scored, run.path("network_risk_scores"), ["timestamp", "grid_id"], clustered=True)
    top = report.attention_report(run.table("network_risk_scores"), run.table("anomaly_scores"))
    tables.write_small_csv(top, run.path("attention_report_csv"))


def _publish(run: Run, status: str, reason: str) -> None:
    as_of = None
    if status == "SUCCESS":
        as_of = str(run.table("dim_time").agg(F.max("timestamp").cast("string")).first()[0])
    counts = [run.counts.get(n) for n in ("rows_in", "rows_rejected", "nulls_handled", "rows_published")]
    row = (run.run_id, datetime.now(UTC), status, *counts, as_of, reason, run.states)
    tables.append_rows(run.spark.createDataFrame([row], S.RUN_STATUS_SCHEMA).coalesce(1), f"{run.output_dir}/run_status")


def run_nightly(
    spark: SparkSession,
    raw: DataFrame,
    output_dir: str,
    grid_path: str | None = None,
    threshold: float = S.HIGH_ACTIVITY_THRESHOLD,
    run_id: str | None = None,
    decimals: int | None = None,
) -> Run:
    """Builds and publishes every table from the raw rows. A failed run is recorded and raised again."""
    run = Run(spark, output_dir, run_id or f"{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}")
    try:
        run.step("clean", lambda: _clean_step(run, raw))
        run.step("hourly", lambda: _hourly_step(run, decimals))
        run.step("geometry", lambda: _geo_step(run, grid_path))
        run.step("warehouse", lambda: _warehouse_step(run))
        run.step("analytics", lambda: _analytics_step(run))
        run.step("risk", lambda: _risk_step(run, threshold))
    except Exception as error:
        _publish(run, "FAILED", str(error) or type(error).__name__)
        raise
    _publish(run, "SUCCESS", "Quality checks passed")
    return run


def run_status(spark: SparkSession, output_dir: str) -> DataFrame:
    return _table_or_empty(spark, f"{output_dir}/run_status", S.RUN_STATUS_SCHEMA)


def current_table(spark: SparkSession, output_dir: str, name: str) -> DataFrame:
    """A table of the latest successful run."""
    done = run_status(spark, output_dir).where(F.col("overall_status") == "SUCCESS")
    latest = done.agg(F.max_by("run_id", F.struct("timestamp", "run_id"))).first()[0]
    if latest is None:
        raise LookupError(f"no successful run under {output_dir}")
    return spark.read.parquet(f"{output_dir}/runs/{latest}/{name}")


def main(argv: list[str] | None = None) -> int:
    """0 on success, 1 when there is no input, 2 on any other failure."""
    parser = argparse.ArgumentParser(description="Build all activity tables from daily files.")
    parser.add_argument("--input-dir", required=True)
    parser.add_argument("--output-dir", required=True)
    parser.add_argument("--grid-path")
    parser.add_argument("--threshold", type=float, default=S.HIGH_ACTIVITY_THRESHOLD)
    parser.add_argument("--incremental", action="store_true", help="take new files into the tables of earlier runs instead of building all")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(name)s %(message)s")
    spark = build_session("gridlens-nightly")
    try:
        ingest_available(spark, args.input_dir, f"{args.output_dir}/zones")
        if args.incremental:
            taken = incremental.take_batches(incremental.Store(spark, f"{args.output_dir}/store"), f"{args.output_dir}/zones", args.threshold)
            log.info("landings taken: %s", {name: {table: len(parts) for table, parts in reached.items()} for name, reached in taken.items()})
            return 0
        stored = T.StructType([*S.RAW_SCHEMA.fields, T.StructField("source_file", T.StringType())])
        raw = _table_or_empty(spark, f"{args.output_dir}/zones/raw", stored).select(*S.RAW_COLUMNS)
        run = run_nightly(spark, raw, args.output_dir, args.grid_path, args.threshold)
        log.info("run %s finished: %s", run.run_id, run.counts)
        return 0
    except FileNotFoundError as error:
        log.error("no input: %s", error)
        return 1
    except Exception:
        log.exception("run failed")
        return 2


if __name__ == "__main__":
    sys.exit(main())
