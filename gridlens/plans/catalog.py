"""The registered queries: every operator over whole tables of a scale-factor folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators import (
    aggregate,
    alerts,
    anomaly,
    clean,
    features,
    geo,
    order_stats,
    profile,
    quality,
    report,
    risk,
    service,
    warehouse,
    windows,
)
from gridlens.plans import fixtures, incremental, nightly
from gridlens.session import prepare, scratch_path, stage
from gridlens.sources import activity, files, tables, zones
from gridlens.sources import geo as geometry
from gridlens.streaming import landing, live

Query = Callable[[SparkSession, str], DataFrame]

# --- fixed values: published example coefficients, in feature order; the intercept is a choice of this file, none is published ---
EXAMPLE_COEFFICIENTS = [
    7.679884273287483,
    0.3332718263236674,
    0.0,
    0.9414360119355851,
    -0.4825414086065295,
    0.43397307700391596,
]
EXAMPLE_INTERCEPT = -1.5

#: Buckets of the co-located tables; a setting of the storage, here for the test tables.
BUCKETS = 8

_QUERIES: dict[str, Query] = {}
_DATASETS: dict[tuple[str, str, str], Dataset] = {}


class Dataset:
    """Tables of one scale-factor folder. Tables that several queries read are written once and re-read."""

    def __init__(self, spark: SparkSession, sf_dir: str, source: str):
        self.spark, self.sf_dir, self.source = spark, sf_dir, source
        self._bucketed: dict[str, DataFrame] = {}

    @property
    def raw(self) -> DataFrame:
        read = fixtures.activity_raw if self.source == "events" else fixtures.wide_raw
        return read(self.spark, self.sf_dir)

    @property
    def canonical(self) -> DataFrame:
        return clean.to_canonical(self.raw)

    @property
    def clean(self) -> DataFrame:
        return clean.clean_activity(self.canonical)

    def build_hourly(self) -> DataFrame:
        return aggregate.hourly_grid_summary(self.clean, fixtures.DECIMALS)

    @cached_property
    def hourly(self) -> DataFrame:
        return stage(self.build_hourly(), "hourly")

    @cached_property
    def alerts(self) -> DataFrame:
        return stage(alerts.network_alerts(self.hourly), "alerts")

    @cached_property
    def scores(self) -> DataFrame:
        return stage(anomaly.anomaly_scores(self.hourly), "scores")

    @cached_property
    def features(self) -> DataFrame:
        return stage(features.network_features(self.hourly), "features")

    @cached_property
    def split(self) -> DataFrame:
        labelled = features.training_set(self.hourly, fixtures.FIXTURE_THRESHOLD)
        return stage(features.split_training_set(stage(labelled, "labelled")), "split")

    @property
    def train(self) -> DataFrame:
        return self.split.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.split.where(F.col("split") == "test")

    @cached_property
    def example_model(self) -> risk.RiskModel:
        means, scales = risk.scaling_statistics(self.train)
        return risk.RiskModel(means, scales, EXAMPLE_COEFFICIENTS, EXAMPLE_INTERCEPT)

    @cached_property
    def fitted_model(self) -> risk.RiskModel:
        return risk.fit_risk(self.train)

    @cached_property
    def risk(self) -> DataFrame:
        return stage(risk.risk_scores(self.features, self.example_model), "risk")

    @cached_property
    def grid_features(self) -> DataFrame:
        return stage(fixtures.grid_features(self.hourly), "cells")

    @property
    def lookup(self) -> DataFrame:
        return geometry.grid_lookup(self.grid_features)

    @cached_property
    def dim_time(self) -> DataFrame:
        return stage(warehouse.dim_time(self.hourly), "dim_time")

    @cached_property
    def fact(self) -> DataFrame:
        fact = warehouse.fact_network_activity(self.hourly, self.dim_time)
        return stage(fact.repartitionByRange("time_key", "grid_id").sortWithinPartitions("time_key", "grid_id"), "fact")

    @property
    def star(self) -> DataFrame:
        return warehouse.star(self.fact, self.dim_time)

    @cached_property
    def fact_by_day(self) -> DataFrame:
        path = scratch_path(self.spark, "fact-by-day")
        tables.write_by_day(warehouse.with_day(self.fact), path, ["time_key", "grid_id"])
        return tables.read_table(self.spark, path)

    @cached_property
    def zones(self) -> str:
        path = scratch_path(self.spark, "zones")
        zones.write_zones(self.hourly, path, bits=2)
        return path

    @property
    def star_by_day(self) -> DataFrame:
        return warehouse.star(self.fact_by_day, self.dim_time)

    def bucketed(self, name: str) -> DataFrame:
        """One of the tables hourly, split, risk, scores and alerts in buckets of the cell; all have the same number of them."""
        if name not in self._bucketed:
            path = scratch_path(self.spark, f"bucketed-{name}")
            order = ["grid_id", "feature_timestamp" if name == "split" else "timestamp"]
            self._bucketed[name] = tables.write_bucketed(getattr(self, name), path, BUCKETS, order)
        return self._bucketed[name]

    @property
    def predicted_test(self) -> DataFrame:
        return risk.predict(self.test, self.example_model)

    @property
    def landing(self) -> DataFrame:
        return fixtures.landing_lines(self.spark, self.sf_dir)

    @cached_property
    def quoted_landing(self) -> DataFrame:
        return stage(fixtures.quoted_lines(self.landing), "quoted-landing")

    @cached_property
    def verdicts(self) -> DataFrame:
        return stage(files.validate_files(self.landing), "verdicts")

    @property
    def first_run_audit(self) -> DataFrame:
        """The audit log of an earlier run that saw the files of the first half of each month."""
        early = F.substring("file", len(fixtures.FILE_PREFIX) + 9, 2).cast("int") <= 15
        seen = self.verdicts.where(early)
        none = seen.limit(0).select("file", F.lit("").alias("status"), "reason")
        return files.audit_rows(seen, none, F.lit("2024-02-01 00:00:00").cast("timestamp"))

    @property
    def landing_files(self) -> DataFrame:
        return self.landing.select("file").distinct()

    @cached_property
    def increments(self) -> incremental.Store:
        """All events in two landings, the second one with half of a day in the middle of the month."""
        store = incremental.Store(self.spark, scratch_path(self.spark, "increments"))
        rows = fixtures.event_rows(self.spark, self.sf_dir)
        late = (F.dayofmonth(F.to_date("file_date")) == 16) & (F.col("event_id") % 2 == 0)
        for name, part in (("first", ~late), ("second", late)):
            incremental.apply_landing(store, rows.where(part).select(*S.RAW_COLUMNS), name, fixtures.FIXTURE_THRESHOLD, fixtures.DECIMALS)
        return store

    @property
    def run_log(self) -> DataFrame:
        """A status log with one run per raw file date; a date with over 3.2 % rejected rows counts as failed."""
        rows = clean.flag_rejects(clean.to_canonical(fixtures.event_rows(self.spark, self.sf_dir)))
        daily = rows.groupBy("file_date").agg(
            F.count(F.lit(1)).alias("rows_in"),
            F.count_if(F.col("reject_cause").isNotNull()).alias("rows_rejected"),
            F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("latest"),
        )
        ok = F.col("rows_rejected") * 1000 <= F.col("rows_in") * 32
        return daily.select(
            F.col("file_date").alias("run_id"),
            (F.to_timestamp("file_date") + F.expr("INTERVAL 30 HOURS")).alias("timestamp"),
            F.when(ok, "SUCCESS").otherwise("FAILED").alias("overall_status"),
            "rows_in",
            "rows_rejected",
            F.lit(0).cast("long").alias("nulls_handled"),
            F.when(ok, F.col("rows_in") - F.col("rows_rejected")).alias("rows_published"),
            F.when(ok, F.col("latest")).alias("as_of_reason"),
            F.lit("").alias("reason"),
            F.create_map(F.lit("load"), F.when(ok, "success").otherwise("failed"), F.lit("check"), F.lit("success")).alias("task_status"),
        )


def dataset(spark: SparkSession, sf_dir: str, source: str = "events") -> Dataset:
    key = (spark.sparkContext.applicationId, sf_dir, source)
    if key not in _DATASETS:
        _DATASETS[key] = Dataset(prepare(spark), sf_dir, source)
    return _DATASETS[key]


def presented(df: DataFrame) -> DataFrame:
    """Result columns in a form that compares across engines: rounded doubles, dates as text, plain timestamps."""
    shown = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind == "double":
            column = F.round(column, 6) + F.lit(0.0)
        elif kind == "date":
            column = column.cast("string")
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        shown.append(column.alias(name))
    return df.select(*shown)


def query(source: str = "events"):
    """Registers a function of a Dataset as a query of (spark, sf_dir)."""

    def register(build: Callable[[Dataset], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(dataset(spark, sf_dir, source))

        _QUERIES[build.__name__] = run
        return build

    return register


def plain_queries() -> dict[str, Query]:
    """The queries with results as the operators give them."""
    return dict(_QUERIES)


def queries() -> dict[str, Query]:
    """The queries with results in a form that compares across engines."""

    def shown(run: Query) -> Query:
        return lambda spark, sf_dir: presented(run(spark, sf_dir))

    return {name: shown(run) for name, run in _QUERIES.items()}


# --- ingestion and cleaning ---


@query()
def scan_activity(d: Dataset) -> DataFrame:
    return d.raw


@query()
def canonical_columns(d: Dataset) -> DataFrame:
    return d.canonical


@query()
def source_file_counts(d: Dataset) -> DataFrame:
    lines = d.landing
    return lines.groupBy(F.col("file").alias("source_file")).agg(F.count(F.lit(1)).alias("rows"))


@query()
def scan_lineage(d: Dataset) -> DataFrame:
    return activity.source_file_counts(activity.with_source_file(fixtures.table(d.spark, d.sf_dir, "events")))


@query()
def validate_files(d: Dataset) -> DataFrame:
    return files.validate_files(d.landing)


@query()
def validate_spoiled_files(d: Dataset) -> DataFrame:
    """Every way for a file to fail: wrong header, width, number, no rows, not finite, and an empty file for each date. Blocks are
    small, so files cross them."""
    lines = fixtures.spoiled_lines(fixtures.landing_lines(d.spark, d.sf_dir, 512))
    names = d.landing_files
    date = F.substring("file", len(fixtures.FILE_PREFIX) + 1, 10)
    empty = names.select(F.concat(F.lit(fixtures.FILE_PREFIX), date, F.lit("-empty.csv")).alias("file")).distinct()
    return files.validate_files(lines, names.unionByName(empty))


@query()
def validate_quoted_files(d: Dataset) -> DataFrame:
    """Files whose records go over several lines and splits; row numbers count records."""
    return files.validate_files(d.quoted_landing)


@query()
def quoted_rows(d: Dataset) -> DataFrame:
    """The raw rows of accepted files with quoted line breaks."""
    judged, records = files.judge_and_gather(d.quoted_landing)
    return files.accepted_rows(d.quoted_landing, stage(judged, "judged"), records).drop("source_file")


@query()
def skip_ingested(d: Dataset) -> DataFrame:
    return files.skipped_files(d.landing_files, d.first_run_audit)


@query()
def new_files(d: Dataset) -> DataFrame:
    return files.new_files(d.landing_files, d.first_run_audit)


@query()
def route_files(d: Dataset) -> DataFrame:
    counted = []
    for ok, zone in ((True, "raw"), (False, "rejected")):
        lines = files.route_lines(d.landing, d.verdicts, ok)
        counted.append(lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines")).withColumn("zone", F.lit(zone)))
    return counted[0].unionByName(counted[1])


@query()
def ingestion_audit(d: Dataset) -> DataFrame:
    at = F.lit("2024-02-02 00:00:00").cast("timestamp")
    fresh = d.verdicts.join(files.new_files(d.landing_files, d.first_run_audit), "file", "left_semi")
    return files.audit_rows(fresh, files.skipped_files(d.landing_files, d.first_run_audit), at)


@query()
def clean_activity(d: Dataset) -> DataFrame:
    return d.clean


@query()
def rejected_rows(d: Dataset) -> DataFrame:
    return clean.rejected_rows(d.canonical)


@query()
def rejected_by_cause(d: Dataset) -> DataFrame:
    return aggregate.level_counts(clean.rejected_rows(d.canonical), "reject_cause")


@query()
def clean_counters(d: Dataset) -> DataFrame:
    return clean.clean_counters(d.canonical)


@query()
def drop_duplicate_keys(d: Dataset) -> DataFrame:
    rows = d.clean.select("grid_id", "timestamp", "country_code", "total_activity")
    return clean.first_per_key(rows, S.CELL_HOUR, [-F.col("total_activity"), F.col("country_code")])


@query()
def union_tables(d: Dataset) -> DataFrame:
    """Both activity tables as one, the second given twice."""
    names = [*S.CELL_HOUR, "total_activity"]
    ours, wide = d.hourly.select(names), dataset(d.spark, d.sf_dir, "lineitem").hourly.select(names)
    return clean.union_tables([ours, wide, wide], S.CELL_HOUR)


# --- profiling ---


@query()
def profile_shape(d: Dataset) -> DataFrame:
    return profile.shape(d.raw)


@query()
def profile_nulls(d: Dataset) -> DataFrame:
    return profile.null_counts(d.canonical)


@query()
def profile_negatives(d: Dataset) -> DataFrame:
    return profile.negative_counts(d.canonical, S.MEASURES)


@query()
def profile_duplicates(d: Dataset) -> DataFrame:
    return profile.duplicate_rows(d.canonical)


@query()
def profile_cadence(d: Dataset) -> DataFrame:
    return profile.cadence(d.clean)


@query()
def profile_multi_country(d: Dataset) -> DataFrame:
    return profile.multi_country_keys(d.clean)


@query()
def multi_country_example(d: Dataset) -> DataFrame:
    return profile.multi_country_example(d.clean).select(*S.CELL_HOUR, "country_code", *S.MEASURES)


@query()
def profile_cardinalities(d: Dataset) -> DataFrame:
    return profile.cardinalities(d.canonical)


@query()
def profile_time_range(d: Dataset) -> DataFrame:
    return profile.time_range(d.clean)


@query()
def activity_percentiles(d: Dataset) -> DataFrame:
    return aggregate.activity_percentiles(d.hourly)


@query()
def percentiles_by_search(d: Dataset) -> DataFrame:
    """The same with the whole table treated as a large group."""
    return order_stats.quantiles(d.hourly, "total_activity", [0.5, 0.75, 0.9, 0.95, 0.99], max_group_rows=0)


def _odd_values(d: Dataset) -> DataFrame:
    """Total activity with some values replaced by infinities and, at the end, NaN."""
    cell = F.col("grid_id") % 31
    odd = F.when(cell == 3, F.lit(float("inf"))).when(cell == 5, F.lit(float("-inf"))).when(cell == 7, F.lit(-0.0))
    return d.hourly.select(odd.when(cell == 11, F.lit(float("nan"))).otherwise(F.col("total_activity")).alias("value"))


@query()
def percentiles_of_odd_values(d: Dataset) -> DataFrame:
    """Order statistics of a column with infinities, -0.0 and NaN; both ways of finding them, which agree."""
    probabilities = [0.0, 0.01, 0.5, 0.9, 1.0]
    ways = [order_stats.quantiles(_odd_values(d), "value", probabilities, max_group_rows=n) for n in (0, 1 << 40)]
    kind = F.when(F.isnan("quantile"), "NaN").when(F.col("quantile") == float("inf"), "inf").when(F.col("quantile") == float("-inf"), "-inf")
    shown = F.coalesce(kind, F.format_string("%.4f", F.col("quantile") + 0.0))
    both = [w.select("probability", shown.alias("quantile"), F.lit(n).alias("way")) for n, w in zip(("search", "sort"), ways, strict=True)]
    return both[0].unionByName(both[1])


@query()
def country_grain_percentiles(d: Dataset) -> DataFrame:
    return aggregate.activity_percentiles(d.clean)


@query()
def busiest_hour(d: Dataset) -> DataFrame:
    return profile.busiest(d.hourly, "hour")


@query()
def busiest_grid(d: Dataset) -> DataFrame:
    return profile.busiest(d.hourly, "grid_id")


@query()
def acceptance_checks(d: Dataset) -> DataFrame:
    rows = fixtures.event_rows(d.spark, d.sf_dir)
    return profile.acceptance_checks(rows, "file_date")


@query()
def partition_report(d: Dataset) -> DataFrame:
    """How rows fall into partitions depends on the scan; together they are all rows, and each partition is listed once."""
    parts = profile.partition_report(d.raw)
    once = F.count(F.lit(1)) == F.count_distinct("partition")
    return parts.agg(F.sum("rows").alias("rows"), once.alias("listed_once"))


@query()
def approx_cardinalities(d: Dataset) -> DataFrame:
    """Whether each sketch is within three standard errors of the exact count."""
    sketch, exact = profile.approx_cardinalities(d.canonical), profile.cardinalities(d.canonical).drop("rows")
    both = sketch.unionByName(exact)
    near = [(F.max(c) - F.min(c) <= 0.06 * F.min(c) + 1).alias(c) for c in exact.columns]
    return both.agg(*near)


@query()
def weekly_cardinalities(d: Dataset) -> DataFrame:
    """Whether the counts of each week, merged from stored states of its days, are within three standard errors of the exact ones."""
    states = stage(profile.daily_sketches(d.clean), "sketches")
    weekly = profile.cardinalities_from_sketches(states)
    week = F.to_date(F.date_trunc("week", "timestamp")).alias("period")
    names = {"grids": "grid_id", "country_codes": "country_code", "timestamps": "timestamp"}
    exact = d.clean.groupBy(week).agg(*[F.count_distinct(c).alias(f"exact_{n}") for n, c in names.items()])
    near = [(F.abs(F.col(n) - F.col(f"exact_{n}")) <= 0.049 * F.col(f"exact_{n}") + 1).alias(n) for n in names]
    return weekly.join(exact, "period", "full_outer").select("period", *near)


@query()
def required_columns(d: Dataset) -> DataFrame:
    """Each column of the activity table left out in turn: whether cleaning refuses the rest, and whether it names the column."""
    rows, found = d.canonical.count(), []
    for name in S.CANONICAL_NAMES.values():
        try:
            clean.clean_activity(d.canonical.drop(name))
            found.append((name, False, False, rows))
        except ValueError as error:
            found.append((name, True, f"['{name}']" in str(error), rows))
    return d.spark.createDataFrame(found, "column_name string, refused boolean, named boolean, rows long")


# --- aggregates ---


@query()
def hourly_grid_summary(d: Dataset) -> DataFrame:
    return d.build_hourly()


@query()
def daily_traffic_summary(d: Dataset) -> DataFrame:
    return aggregate.daily_traffic(d.hourly)


@query()
def daily_kpis(d: Dataset) -> DataFrame:
    return aggregate.daily_kpis(d.hourly)


@query()
def grid_kpis(d: Dataset) -> DataFrame:
    return aggregate.grid_kpis(d.hourly)


@query()
def top_hotspots(d: Dataset) -> DataFrame:
    return aggregate.top_hotspots(d.hourly)


@query()
def peak_hour(d: Dataset) -> DataFrame:
    return aggregate.peak_hour(d.hourly)


@query()
def top_hotspots_geo(d: Dataset) -> DataFrame:
    return aggregate.top_hotspots_geo(d.hourly, d.lookup)


@query()
def alert_counts(d: Dataset) -> DataFrame:
    return aggregate.alert_counts(d.alerts)


@query()
def top_alert_grids(d: Dataset) -> DataFrame:
    return aggregate.top_alert_grids(d.alerts)


@query()
def alert_rate(d: Dataset) -> DataFrame:
    return aggregate.alert_rate(d.alerts, d.hourly)


@query()
def alert_types_per_key(d: Dataset) -> DataFrame:
    return aggregate.alert_types_per_key(d.alerts)


@query()
def bucket_coverage(d: Dataset) -> DataFrame:
    return aggregate.bucket_coverage(d.hourly)


@query()
def anomaly_distribution(d: Dataset) -> DataFrame:
    return aggregate.describe(d.scores, "anomaly_score")


@query()
def anomaly_directions(d: Dataset) -> DataFrame:
    return aggregate.level_counts(d.scores, "direction")


@query()
def class_balance(d: Dataset) -> DataFrame:
    return aggregate.class_balance(d.split)


@query()
def activity_floor(d: Dataset) -> DataFrame:
    return alerts.activity_floor(d.hourly)


@query()
def warehouse_totals(d: Dataset) -> DataFrame:
    return aggregate.warehouse_totals(d.fact)


# --- windows ---


@query()
def feature_windows(d: Dataset) -> DataFrame:
    return windows.history_windows(d.hourly)


@query()
def feature_windows_by_period(d: Dataset) -> DataFrame:
    """The same with every cell treated as a long one."""
    return windows.history_windows(d.hourly, max_group_rows=0)


@query()
def next_hour_target(d: Dataset) -> DataFrame:
    return windows.next_hour_target(d.hourly)


@query()
def prev_hour_activity(d: Dataset) -> DataFrame:
    return windows.previous_hour_activity(d.hourly).select("grid_id", "timestamp", "prev_hour_activity")


@query()
def loo_median_day(d: Dataset) -> DataFrame:
    return alerts.within_day_baseline(d.hourly).select("grid_id", "timestamp", "baseline_activity")


@query()
def loo_median_hour(d: Dataset) -> DataFrame:
    medians = order_stats.leave_one_out_median(d.hourly, ["grid_id", "hour"])
    return medians.select("grid_id", "timestamp", "baseline_activity")


@query()
def loo_median_sliced(d: Dataset) -> DataFrame:
    """Per hour of day over all cells: large buckets, all on the sliced path."""
    medians = order_stats.leave_one_out_median(d.hourly, ["hour"], max_group_rows=1)
    return medians.select("grid_id", "timestamp", "baseline_activity")


@query()
def last_24_hours(d: Dataset) -> DataFrame:
    return windows.last_hours(d.hourly).select("grid_id", "timestamp", "total_activity")


@query()
def chrono_split(d: Dataset) -> DataFrame:
    return features.split_checks(windows.chronological_split(d.features, "feature_timestamp"))


# --- rules and anomalies ---


@query()
def network_alerts(d: Dataset) -> DataFrame:
    return alerts.network_alerts(d.hourly)


@query()
def alert_severity(d: Dataset) -> DataFrame:
    return aggregate.level_counts(alerts.with_severity(d.alerts), "severity")


@query()
def anomaly_scores(d: Dataset) -> DataFrame:
    return anomaly.anomaly_scores(d.hourly)


@query()
def top_high_anomalies(d: Dataset) -> DataFrame:
    return anomaly.top_anomalies(d.scores, "HIGH")


@query()
def top_low_anomalies(d: Dataset) -> DataFrame:
    return anomaly.top_anomalies(d.scores, "LOW")


# --- geometry and warehouse ---


@query()
def grid_lookup(d: Dataset) -> DataFrame:
    return geometry.grid_lookup(fixtures.grid_features(d.hourly)).drop("geometry_json")


@query()
def geo_enrichment(d: Dataset) -> DataFrame:
    return geo.enrich(d.hourly, d.lookup.drop("geometry_json"))


@query()
def geo_enrichment_merge(d: Dataset) -> DataFrame:
    return geo.enrich(d.hourly, d.lookup.drop("geometry_json"), strategy="merge")


@query("lineitem")
def unmatched_grids(d: Dataset) -> DataFrame:
    """The cells of one table against the geometry of the other."""
    return geo.unmatched_grids(d.hourly, dataset(d.spark, d.sf_dir).lookup)


@query("lineitem")
def enrichment_coverage(d: Dataset) -> DataFrame:
    return geo.enrichment_coverage(d.hourly, dataset(d.spark, d.sf_dir).lookup)


@query()
def full_enrichment_coverage(d: Dataset) -> DataFrame:
    return geo.enrichment_coverage(d.hourly, d.lookup)


@query()
def centroid_box(d: Dataset) -> DataFrame:
    return geo.centroids_in_box(d.lookup, (9.0, 9.5), (45.0, 45.5))


@query()
def dim_time(d: Dataset) -> DataFrame:
    return warehouse.dim_time(d.hourly)


@query()
def dim_grid(d: Dataset) -> DataFrame:
    return warehouse.dim_grid(d.grid_features, "grid.geojson")


@query()
def fact_network_activity(d: Dataset) -> DataFrame:
    return warehouse.fact_network_activity(d.hourly, d.dim_time)


@query()
def warehouse_checks(d: Dataset) -> DataFrame:
    return warehouse.warehouse_checks(d.hourly, d.fact, d.lookup)


# --- service ---


@query()
def latest_as_of(d: Dataset) -> DataFrame:
    return service.latest_as_of(d.dim_time)


@query()
def network_summary(d: Dataset) -> DataFrame:
    return service.network_summary(d.star)


@query()
def latest_network_summary(d: Dataset) -> DataFrame:
    return service.latest_network_summary(d.fact, d.dim_time)


@query()
def grid_activity(d: Dataset) -> DataFrame:
    return service.grid_activity(d.star, d.lookup)


@query()
def grid_activity_at_noon(d: Dataset) -> DataFrame:
    return service.grid_activity(d.star, d.lookup, hour=12)


@query()
def grid_activity_on_day(d: Dataset) -> DataFrame:
    """All cells on the latest day; the scan opens the folder of that day alone."""
    latest = d.dim_time.agg(F.max("date").cast("string")).first()[0]
    return service.grid_activity(d.star_by_day, d.lookup, date=latest)


@query()
def grid_activity_at_time(d: Dataset) -> DataFrame:
    """All cells at the latest time; which day that is, the scan learns from dim_time when it runs."""
    return service.grid_activity(d.star_by_day, d.lookup, as_of=d.dim_time.agg(F.max("timestamp")).first()[0])


@query()
def sunday_summary(d: Dataset) -> DataFrame:
    """Summary per timestamp of all Sundays, by a filter on a column that only dim_time has."""
    return service.network_summary(d.star_by_day.where(F.col("day_of_week") == "Sunday"))


@query()
def grid_activity_high_cells(d: Dataset) -> DataFrame:
    """The same with all cell ids moved up by 10,000."""
    moved = F.col("grid_id") + 10_000
    return service.grid_activity(d.star.withColumn("grid_id", moved), d.lookup.withColumn("grid_id", moved))


@query()
def network_hotspots(d: Dataset) -> DataFrame:
    return service.network_hotspots(d.fact, d.dim_time, d.risk, d.alerts)


@query()
def alert_feed(d: Dataset) -> DataFrame:
    return service.alert_feed(d.alerts, d.risk, d.dim_time)


@query()
def high_alert_feed(d: Dataset) -> DataFrame:
    return service.alert_feed(d.alerts, d.risk, d.dim_time, severity="high")


@query()
def grid_location(d: Dataset) -> DataFrame:
    dims = warehouse.dim_grid(d.grid_features, "grid.geojson")
    return service.grid_location(dims, d.hourly.select("grid_id").distinct()).drop("geometry_reference")


@query()
def predict_risk(d: Dataset) -> DataFrame:
    off = F.when(F.col("hour") == 3, 0.5).otherwise(0.0)
    requests = d.hourly.select("grid_id", "timestamp", (F.col("total_activity") + off).alias("total_activity"))
    return service.predict_risk(requests, d.features, d.hourly, d.scores, d.example_model)


@query()
def latest_run(d: Dataset) -> DataFrame:
    now = F.lit("2024-02-01 12:00:00").cast("timestamp")
    status = service.latest_run_status(d.run_log, now)
    listed = {n: F.array_join(n, "; ") for n in ("failed_tasks", "reasons")}
    return status.withColumns(listed).withColumn("task_status", F.to_json("task_status"))


@query()
def map_status(d: Dataset) -> DataFrame:
    hot = service.network_hotspots(d.fact, d.dim_time, d.risk, d.alerts)
    return service.map_status(hot, service.alert_feed(d.alerts, d.risk, d.dim_time))


@query()
def visible_features(d: Dataset) -> DataFrame:
    hot = service.network_hotspots(d.fact, d.dim_time, d.risk, d.alerts)
    feed = service.alert_feed(d.alerts, d.risk, d.dim_time)
    return service.visible_features(d.grid_features, hot, feed).select("grid_id")


@query()
def dashboard_counters(d: Dataset) -> DataFrame:
    hot = service.network_hotspots(d.fact, d.dim_time, d.risk, d.alerts)
    return service.dashboard_counters(hot, service.alert_feed(d.alerts, d.risk, d.dim_time))


# --- features and risk ---


@query()
def network_features(d: Dataset) -> DataFrame:
    return features.network_features(d.hourly)


@query()
def network_features_strict(d: Dataset) -> DataFrame:
    return features.network_features(d.hourly, strict_hours=True)


@query()
def training_set(d: Dataset) -> DataFrame:
    return features.training_set(d.hourly, fixtures.FIXTURE_THRESHOLD)


@query()
def standardised_features(d: Dataset) -> DataFrame:
    keys = ["grid_id", "feature_timestamp"]
    return risk.standardise(d.train, *risk.scaling_statistics(d.train)).select(*keys, *S.FEATURES)


@query()
def risk_scores_fixed_coefficients(d: Dataset) -> DataFrame:
    return risk.risk_scores(d.features, d.example_model)


@query()
def score_records(d: Dataset) -> DataFrame:
    """Every feature row as a record of names and numbers, those of every fifth cell without one of the names."""
    pairs = F.create_map(*[part for f in S.FEATURES for part in (F.lit(f), F.col(f).cast("double"))])
    lost = F.element_at(F.array(*map(F.lit, S.FEATURES)), (F.col("grid_id") % len(S.FEATURES) + 1).cast("int"))
    some = F.when(F.col("grid_id") % 5 == 0, F.map_filter("features", lambda name, _: name != lost)).otherwise(F.col("features"))
    records = d.features.select("grid_id", "feature_timestamp", pairs.alias("features")).withColumn("features", some)
    scored = risk.score_records(records, d.example_model).drop("features")
    return scored.withColumn("missing_features", F.array_join("missing_features", ","))


@query()
def risk_levels(d: Dataset) -> DataFrame:
    return aggregate.level_counts(d.risk, "risk_level")


@query()
def confusion_metrics(d: Dataset) -> DataFrame:
    return risk.evaluate(d.predicted_test)


@query()
def rule_agreement(d: Dataset) -> DataFrame:
    compared = risk.compare_with_rules(d.predicted_test, d.alerts)
    keys = ["grid_id", "feature_timestamp", "ml_prediction", "np3_positive", "np3_alert_types"]
    return compared.select(*keys, "agreement", "disagreement_type")


@query()
def rule_agreement_counts(d: Dataset) -> DataFrame:
    return risk.agreement_counts(risk.compare_with_rules(d.predicted_test, d.alerts))


@query()
def three_way_result(d: Dataset) -> DataFrame:
    flags = ["ml3_positive", "ml4_positive", "np3_positive", "three_way_result"]
    return risk.three_way(d.test, d.scores, d.alerts).select("grid_id", "feature_timestamp", *flags)


@query()
def three_way_counts(d: Dataset) -> DataFrame:
    return aggregate.level_counts(risk.three_way(d.test, d.scores, d.alerts), "three_way_result")


@query()
def attention_top20(d: Dataset) -> DataFrame:
    return report.attention_report(d.risk, d.scores)


@query()
def risk_model_fit(d: Dataset) -> DataFrame:
    """The fit is right where the gradient of the balanced, penalised log loss vanishes: one row per coefficient."""
    return risk.fit_gradient(d.train, d.fitted_model).select(
        "coefficient", (F.abs("gradient") < 1e-5).alias("vanishes"), "train_rows"
    )


@query()
def risk_model_coefficients(d: Dataset) -> DataFrame:
    """The order of the table: features whose coefficient is larger than all below it, and whether that holds throughout."""
    table = risk.coefficient_table(d.spark, d.fitted_model)
    by_size = Window.orderBy(F.desc("absolute_coefficient"), "feature")
    shown = table.withColumn("listed", F.monotonically_increasing_id()).withColumn("expected", F.row_number().over(by_size) - 1)
    return shown.agg(
        F.array_join(F.array_sort(F.collect_list("feature")), ",").alias("features"),
        (F.count_if(F.col("listed") != F.col("expected")) == 0).alias("sorted"),
        F.bool_and(F.abs("coefficient") == F.col("absolute_coefficient")).alias("absolute"),
    )


@query()
def evaluation_record(d: Dataset) -> DataFrame:
    compared = risk.compare_with_rules(d.predicted_test, d.alerts)
    record = risk.evaluation_record(d.split, compared, fixtures.FIXTURE_THRESHOLD)
    return record.select("algorithm", "threshold", "metrics.*", "split.*", "rates.*", "np3_comparison.*")


@query()
def leakage_perturbation(d: Dataset) -> DataFrame:
    cutoff = d.hourly.agg(F.date_trunc("day", F.max("timestamp")) - F.expr("INTERVAL 10 DAYS")).first()[0]
    return features.leakage_report(d.hourly, cutoff)


# --- the same on tables in buckets of the cell, without shuffles ---


@query()
def bucketed_features(d: Dataset) -> DataFrame:
    return features.network_features(d.bucketed("hourly"))


@query()
def bucketed_training_set(d: Dataset) -> DataFrame:
    return features.training_set(d.bucketed("hourly"), fixtures.FIXTURE_THRESHOLD)


@query()
def bucketed_scores(d: Dataset) -> DataFrame:
    return anomaly.anomaly_scores(d.bucketed("hourly"))


@query()
def bucketed_last_hours(d: Dataset) -> DataFrame:
    return windows.last_hours(d.bucketed("hourly")).select("grid_id", "timestamp", "total_activity")


@query()
def bucketed_rule_agreement(d: Dataset) -> DataFrame:
    test = d.bucketed("split").where(F.col("split") == "test")
    compared = risk.compare_with_rules(risk.predict(test, d.example_model), d.bucketed("alerts"))
    keys = ["grid_id", "feature_timestamp", "ml_prediction", "np3_positive", "np3_alert_types"]
    return compared.select(*keys, "agreement", "disagreement_type")


@query()
def bucketed_three_way(d: Dataset) -> DataFrame:
    flags = ["ml3_positive", "ml4_positive", "np3_positive", "three_way_result"]
    test = d.bucketed("split").where(F.col("split") == "test")
    return risk.three_way(test, d.bucketed("scores"), d.bucketed("alerts")).select("grid_id", "feature_timestamp", *flags)


@query()
def bucketed_attention(d: Dataset) -> DataFrame:
    return report.attention_report(d.bucketed("risk"), d.bucketed("scores"))


# --- quality and sinks ---


@query()
def analytics_gate(d: Dataset) -> DataFrame:
    return quality.analytics_gate(d.hourly)


@query()
def grain_checks(d: Dataset) -> DataFrame:
    return quality.grain_checks(d.clean, d.hourly, d.lookup)


@query()
def publish_record(d: Dataset) -> DataFrame:
    return quality.publish_record(d.canonical, d.fact.join(d.dim_time, "time_key"))


@query()
def compare_totals(d: Dataset) -> DataFrame:
    return quality.compare_totals(aggregate.hourly_grid_summary(d.clean), d.hourly)


@query()
def round_trip(d: Dataset) -> DataFrame:
    path = scratch_path(d.spark, "round-trip")
    tables.write_hourly(d.hourly, path)
    return quality.round_trip_checks(d.hourly, tables.read_table(d.spark, path))


@query()
def rerun_idempotent(d: Dataset) -> DataFrame:
    path = scratch_path(d.spark, "rerun")
    for _ in range(2):
        tables.write_activity(d.clean, path)
    return quality.compare_totals(d.clean, tables.read_table(d.spark, path))


@query()
def csv_files(d: Dataset) -> DataFrame:
    """All raw rows written as CSV files and read back by the reader of daily files."""
    path = scratch_path(d.spark, "csv-files")
    d.raw.write.option("header", True).csv(path)
    return activity.read_raw(d.spark, path, "*.csv")


@query()
def missing_files(d: Dataset) -> DataFrame:
    """Looking for files that are not there is an error, and the folder's own tables are found."""
    try:
        activity.read_raw(d.spark, d.sf_dir, "no-such-*.csv")
        failed = False
    except FileNotFoundError:
        failed = True
    return fixtures.table(d.spark, d.sf_dir, "events").agg(F.count(F.lit(1)).alias("rows"), F.lit(failed).alias("failed"))


@query()
def grid_documents(d: Dataset) -> DataFrame:
    """All cells written as FeatureCollection documents of up to 1,000 cells each, read back by the document reader."""
    path = scratch_path(d.spark, "grid-documents")
    feature = F.struct(
        F.lit("Feature").alias("type"),
        (F.col("grid_id") - 1).alias("id"),
        F.struct(F.col("grid_id").alias("cellId")).alias("properties"),
        F.from_json("geometry", "struct<type: string, coordinates: string>").alias("geometry"),
    )
    # coordinates keep their nesting as text, so they are put in place by hand
    text = F.regexp_replace(F.to_json(feature), r'"coordinates":"([^"]*)"', r'"coordinates":$1')
    listed = d.grid_features.groupBy(F.floor(F.col("grid_id") / 1000).alias("part")).agg(F.array_join(F.collect_list(text), ",").alias("f"))
    document = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.col("f"), F.lit("]}"))
    listed.select("part", document.alias("value")).write.partitionBy("part").text(path)
    return geometry.grid_lookup(geometry.read_feature_collection(d.spark, path)).drop("geometry_json")


@query()
def lookup_lines(d: Dataset) -> DataFrame:
    """The lookup saved as JSON lines and read back."""
    path = scratch_path(d.spark, "lookup-lines")
    d.lookup.write.json(path)
    return geometry.read_lookup_lines(d.spark, path).drop("geometry_json")


@query()
def alert_files(d: Dataset) -> DataFrame:
    """All alerts written as CSV and as JSON lists, one for each day and 1,000 cells, read back by the alert reader."""
    path = scratch_path(d.spark, "alert-files")
    columns = [f.split(" ")[0] for f in S.ALERT_SCHEMA.split(", ")]
    d.alerts.select(columns).write.option("header", True).csv(f"{path}/alerts.csv")
    listed = F.to_json(F.collect_list(F.struct(*columns)))
    lists = d.alerts.groupBy("source_file", F.floor(F.col("grid_id") / 1000).alias("cells")).agg(listed.alias("value"))
    # the JSON reader takes a file as a document, so each list has a folder of its own
    lists.write.partitionBy("source_file", "cells").text(f"{path}/alerts.json")
    ways = [tables.read_alerts(d.spark, f"{path}/alerts.{kind}").withColumn("kind", F.lit(kind)) for kind in ("csv", "json")]
    return ways[0].unionByName(ways[1])


@query()
def split_grid_documents(d: Dataset) -> DataFrame:
    """All cells as one FeatureCollection document, features with braces and quotes in their texts, read back piece by piece."""
    path = scratch_path(d.spark, "grid-document")
    note = F.concat(F.lit('cell {"} \\ '), F.col("grid_id").cast("string"), F.lit(" }{"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        (F.col("grid_id") - 1).alias("id"),
        F.struct(note.alias("note"), F.col("grid_id").alias("cellId")).alias("properties"),
        F.lit("here").alias("geometry"),
    )
    text = F.replace(F.to_json(feature), F.lit('"here"'), F.col("geometry"))
    first = d.grid_features.agg(F.min("grid_id")).first()[0]
    line = F.when(F.col("grid_id") == first, text).otherwise(F.concat(F.lit(","), text))
    rows = d.grid_features.select("grid_id", line.alias("value"))
    ends = [(-1, '{"type": "FeatureCollection", "name": "}{", "features": ['), (1 << 62, "]}")]
    whole = rows.unionByName(d.spark.createDataFrame(ends, "grid_id long, value string")).repartitionByRange(1, "grid_id")
    whole.sortWithinPartitions("grid_id").select("value").write.text(path)
    return geometry.grid_lookup(geometry.read_split_features(d.spark, path)).drop("geometry_json")


@query()
def zone_read_cell(d: Dataset) -> DataFrame:
    """One cell out of the hourly table in zones of cell and time."""
    return zones.read_zones(d.spark, d.zones, grid_id=1).select("grid_id", "timestamp", "total_activity")


@query()
def zone_read_time(d: Dataset) -> DataFrame:
    """All cells at the latest time, out of the same table."""
    latest = d.dim_time.agg(F.max("timestamp")).first()[0]
    return zones.read_zones(d.spark, d.zones, timestamp=latest).select("grid_id", "timestamp", "total_activity")


@query()
def zone_table(d: Dataset) -> DataFrame:
    return zones.read_zones(d.spark, d.zones).select(*d.hourly.columns)


@query()
def one_cell_read(d: Dataset) -> DataFrame:
    """One cell out of the stored hourly table, by the reader that lets filters and columns reach the scan."""
    path = scratch_path(d.spark, "one-cell")
    tables.write_hourly(d.hourly, path)
    return tables.read_cell_hour(d.spark, path, grid_id=1, columns=["grid_id", "timestamp", "total_activity"])


@query()
def sorted_sink(d: Dataset) -> DataFrame:
    """The hourly table written by ranges of cell and time: rows, and whether the files' ranges of cells overlap in borders only."""
    path = scratch_path(d.spark, "sorted-sink")
    tables.write_table(d.hourly, path, S.CELL_HOUR, clustered=True)
    files_of = tables.read_table(d.spark, path).groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(*S.CELL_HOUR)).alias("first"), F.max(F.struct(*S.CELL_HOUR)).alias("last")
    )
    before = F.lag("last").over(Window.orderBy("first"))
    return files_of.withColumn("apart", F.coalesce(F.col("first") > before, F.lit(True))).agg(
        F.sum("rows").alias("rows"), F.bool_and("apart").alias("apart")
    )


@query()
def small_csv(d: Dataset) -> DataFrame:
    """The top report as one CSV file, and the daily one as many."""
    path = scratch_path(d.spark, "small-csv")
    tables.write_small_csv(aggregate.top_hotspots(d.hourly), f"{path}/top")
    tables.write_csv(aggregate.daily_kpis(d.hourly), f"{path}/days")
    top = d.spark.read.option("header", True).schema("grid_id int, total_activity double").csv(f"{path}/top")
    days = d.spark.read.option("header", True).csv(f"{path}/days")
    return top.withColumn("days", F.lit(days.count()))


@query()
def appended_rows(d: Dataset) -> DataFrame:
    path = scratch_path(d.spark, "appended")
    for part in (F.col("hour") < 12, F.col("hour") >= 12):
        tables.append_rows(d.hourly.where(part), path)
    return tables.read_table(d.spark, path).groupBy("hour").agg(F.count(F.lit(1)).alias("rows"))


@query()
def stored_model(d: Dataset) -> DataFrame:
    """Risk of every feature row by a model that was saved and loaded."""
    path = scratch_path(d.spark, "model")
    risk.save_model(d.spark, d.example_model, path)
    return risk.risk_scores(d.features, risk.load_model(d.spark, path))


@query()
def nightly_run(d: Dataset) -> DataFrame:
    """The whole batch job over all events; its published hourly table."""
    path = scratch_path(d.spark, "nightly")
    nightly.run_nightly(d.spark, d.raw, path, threshold=fixtures.FIXTURE_THRESHOLD, decimals=fixtures.DECIMALS)
    return nightly.current_table(d.spark, path, "hourly_grid_summary")


@query()
def incremental_hourly(d: Dataset) -> DataFrame:
    """Tables that took the events in two landings hold what one run over all events gives."""
    return d.increments.table("hourly").select(*d.hourly.columns)


@query()
def incremental_fact(d: Dataset) -> DataFrame:
    return d.increments.table("fact_network_activity").drop("date")


@query()
def incremental_alerts(d: Dataset) -> DataFrame:
    return d.increments.table("network_alerts").drop("date")


@query()
def incremental_features(d: Dataset) -> DataFrame:
    return d.increments.table("features").drop("date")


@query()
def incremental_training_set(d: Dataset) -> DataFrame:
    return d.increments.table("training_set").drop("date")


@query()
def incremental_scores(d: Dataset) -> DataFrame:
    return d.increments.scores()


@query()
def scores_of_two_loads(d: Dataset) -> DataFrame:
    """Anomaly scores from the order summaries of two halves of the month, merged without their rows."""
    bucket, early = ["grid_id", "hour"], F.dayofmonth("date") <= 15
    parts = [order_stats.value_counts(d.hourly.where(part), bucket, "total_activity") for part in (early, ~early)]
    stored = [stage(part, "order-summary") for part in parts]
    middles = order_stats.middle_values(order_stats.merged_counts(stored, bucket), bucket)
    rows = d.hourly.select("grid_id", "timestamp", "hour", "total_activity")
    return anomaly.score_against_baseline(order_stats.medians_of_others(rows, stage(middles, "middles"), bucket))


@query()
def loo_median_of_summaries(d: Dataset) -> DataFrame:
    """Per hour of day over all cells, from the summaries of odd and even cells: large buckets with many different values."""
    parts = [stage(order_stats.value_counts(d.hourly.where(F.col("grid_id") % 2 == i), ["hour"], "total_activity"), "order-summary") for i in (0, 1)]
    middles = stage(order_stats.middle_values(order_stats.merged_counts(parts, ["hour"]), ["hour"]), "middles")
    return order_stats.medians_of_others(d.hourly, middles, ["hour"]).select("grid_id", "timestamp", "baseline_activity")


@query()
def storage_sizes(d: Dataset) -> DataFrame:
    path = scratch_path(d.spark, "sizes")
    tables.write_csv(d.hourly, f"{path}/csv")
    tables.write_hourly(d.hourly, f"{path}/parquet")
    sizes = tables.storage_sizes(d.spark, {"csv": f"{path}/csv", "parquet": f"{path}/parquet"})
    rows = d.spark.read.option("header", True).csv(f"{path}/csv").count()
    return sizes.select("storage", (F.col("files") > 0).alias("has_files"), (F.col("bytes") > 10 * rows).alias("has_bytes"))


# --- streaming ---


def _event_stream(d: Dataset) -> DataFrame:
    static = fixtures.table(d.spark, d.sf_dir, "events")
    return d.spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(d.sf_dir)


def _clean_events(events: DataFrame) -> DataFrame:
    """The events table, or a stream of it, as cleaned activity with event times as recorded."""
    canonical = events.select(
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.floor(F.col("user_id") / 10) + 1).cast("int").alias("grid_id"),
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("country_code"),
        *[
            F.when(F.col("event_type") == kind, F.col("value")).alias(S.CANONICAL_NAMES[name])
            for name, kind in fixtures.EVENT_MEASURES.items()
        ],
    )
    return clean.clean_activity(canonical)


@query()
def stream_hourly_grid(d: Dataset) -> DataFrame:
    path = scratch_path(d.spark, "stream-hourly")
    hourly = live.live_hourly_grid(_clean_events(_event_stream(d)), decimals=fixtures.DECIMALS)
    live.write_available(hourly, f"{path}/table", f"{path}/checkpoint")
    events = fixtures.table(d.spark, d.sf_dir, "events")
    live.close_hours(_clean_events(events), f"{path}/table", hourly.schema, fixtures.DECIMALS)
    return live.closed_hours(d.spark, f"{path}/table", hourly.schema).drop("date", "day_of_week")


@query()
def stream_scoring(d: Dataset) -> DataFrame:
    path = scratch_path(d.spark, "stream-scores")
    baseline = stage(live.frozen_baseline(d.hourly), "baseline")
    hourly = live.live_hourly_grid(_clean_events(_event_stream(d)), decimals=fixtures.DECIMALS)
    live.score_available(hourly, baseline, f"{path}/scores", f"{path}/alerts", f"{path}/checkpoint")
    emitted, events = d.spark.read.parquet(f"{path}/scores"), fixtures.table(d.spark, d.sf_dir, "events")
    live.close_scores(_clean_events(events), baseline, emitted, f"{path}/scores", f"{path}/alerts", fixtures.DECIMALS)
    scores = d.spark.read.parquet(f"{path}/scores")
    return scores.groupBy("direction").agg(F.count(F.lit(1)).alias("rows"), F.count("alert_type").alias("alerts"))


@query()
def stream_alerts(d: Dataset) -> DataFrame:
    """All three rules on the stream, against the baseline and floors of the stored hours."""
    path = scratch_path(d.spark, "stream-alerts")
    baseline, floors = stage(live.frozen_baseline(d.hourly), "baseline"), stage(live.frozen_floors(d.hourly), "floors")
    hourly = live.live_hourly_grid(_clean_events(_event_stream(d)), decimals=fixtures.DECIMALS)
    live.alert_available(hourly, baseline, floors, path, f"{path}/checkpoint")
    events = fixtures.table(d.spark, d.sf_dir, "events")
    live.close_alerts(_clean_events(events), baseline, floors, path, hourly.schema, fixtures.DECIMALS)
    return d.spark.read.parquet(f"{path}/alerts").drop("batch")


@query()
def stream_late_hours(d: Dataset) -> DataFrame:
    """Events that land in three parts out of order, each part with rows of nearly every hour; every hour comes out whole."""
    path = scratch_path(d.spark, "stream-late")
    events = fixtures.table(d.spark, d.sf_dir, "events")
    day = F.dayofmonth("ts")
    late, middle = (day > 20) & (F.col("event_id") % 3 > 0), (day <= 20) & (F.col("event_id") % 3 == 1)
    for part in (late, middle, ~late & ~middle):
        events.where(part).write.mode("append").parquet(f"{path}/landing")
        stream = d.spark.readStream.schema(events.schema).parquet(f"{path}/landing")
        live.upsert_available(_clean_events(stream), f"{path}/table", f"{path}/checkpoint", fixtures.DECIMALS)
    return d.spark.read.parquet(f"{path}/table/hourly").drop("date", "day_of_week", "internet_share")


@query()
def stream_file_gate(d: Dataset) -> DataFrame:
    """The lines of all landing files through the gate on a stream, in two landings; the first landing's files land once more in the second."""
    path = scratch_path(d.spark, "stream-gate")
    lines = d.landing.select("file", "block", "position", "line")
    early = F.substring("file", len(fixtures.FILE_PREFIX) + 9, 2).cast("int") <= 15
    for part in (lines.where(early), lines):
        part.repartition("file").sortWithinPartitions("file", "block", "position").drop("position").write.mode("append").parquet(f"{path}/landing")
        stream = d.spark.readStream.schema("file string, block long, line string").parquet(f"{path}/landing")
        taken = stream.writeStream.foreachBatch(lambda batch, number: landing.take_lines(batch, number, f"{path}/zones", by_batch=True))
        landing.run_available(taken, f"{path}/checkpoint")
    return landing.audit_log(d.spark, f"{path}/zones").select("filename", "status", "reason")


@query()
def stream_ingest(d: Dataset) -> DataFrame:
    """Two landings of daily files; the second run reads only what the first did not."""
    path = scratch_path(d.spark, "stream-ingest")
    for part, early in enumerate((True, False)):
        day = F.dayofmonth(F.to_date("file_date"))
        rows = fixtures.event_rows(d.spark, d.sf_dir).where((day <= 15) if early else (day > 15))
        rows.select(*S.RAW_COLUMNS).write.mode("append").option("header", True).csv(f"{path}/landing/half-{part}")
        stream = live.read_raw_stream(d.spark, f"{path}/landing/*", "*.csv")
        live.write_available(stream, f"{path}/table", f"{path}/checkpoint")
    kept = d.spark.read.parquet(f"{path}/table")
    return kept.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))


# --- the larger activity table ---


@query("lineitem")
def wide_hourly_summary(d: Dataset) -> DataFrame:
    return d.build_hourly()


@query("lineitem")
def wide_features(d: Dataset) -> DataFrame:
    return features.network_features(d.hourly)


@query("lineitem")
def wide_anomaly_scores(d: Dataset) -> DataFrame:
    return anomaly.anomaly_scores(d.hourly)


@query("lineitem")
def wide_alerts(d: Dataset) -> DataFrame:
    return alerts.network_alerts(d.hourly)


@query("lineitem")
def wide_network_summary(d: Dataset) -> DataFrame:
    return service.network_summary(d.hourly)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows to the busiest cells: clean, hourly summary, ranking."""
    d = dataset(spark, sf_dir)
    return presented(aggregate.top_hotspots(d.build_hourly()))
