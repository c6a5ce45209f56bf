"""Quality gates before publishing, the run record and load comparisons."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators.clean import clean_counters, require_columns

# --- fixed values: columns that a published hourly table must have ---
GATE_COLUMNS = [
    "grid_id",
    "timestamp",
    "total_activity",
    "total_sms",
    "total_calls",
    "internet_activity",
    "internet_share",
]


def as_checks(facts: DataFrame, checks: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """One row of facts to check_name, expected, actual, passed rows."""
    rows = [
        F.struct(
            F.lit(name).alias("check_name"),
            expected.cast("long").alias("expected"),
            actual.cast("long").alias("actual"),
            passed.alias("passed"),
        )
        for name, (expected, actual, passed) in checks.items()
    ]
    return facts.select(F.explode(F.array(*rows)).alias("c")).select("c.*")


def _key_facts(hourly: DataFrame) -> DataFrame:
    """Rows, null keys and repeated keys; rows are counted per key before the shuffle."""
    counted = hourly.groupBy(*S.CELL_HOUR).agg(F.count(F.lit(1)).alias("copies"))
    missing = F.col("grid_id").isNull() | F.col("timestamp").isNull()
    return counted.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(missing, F.col("copies"))), F.lit(0)).alias("null_keys"),
        F.count_if(F.col("copies") > 1).alias("repeated_keys"),
        F.count_distinct(F.to_date("timestamp")).alias("days"),
    )


def analytics_gate(hourly: DataFrame) -> DataFrame:
    """Non-empty, all columns present, no null keys, no repeated keys."""
    zero = F.lit(0)
    missing = len([name for name in GATE_COLUMNS if name not in hourly.columns])
    return as_checks(
        _key_facts(hourly),
        {
            "not_empty": (F.lit(1), F.col("rows"), F.col("rows") >= 1),
            "required_columns": (zero, F.lit(missing), F.lit(missing == 0)),
            "null_keys": (zero, F.col("null_keys"), F.col("null_keys") == 0),
            "repeated_keys": (zero, F.col("repeated_keys"), F.col("repeated_keys") == 0),
        },
    )


def require_gate(checks: DataFrame) -> None:
    failed = [row["check_name"] for row in checks.where(~F.col("passed")).collect()]
    if failed:
        raise ValueError(f"quality checks failed: {sorted(failed)}")


def grain_checks(clean: DataFrame, hourly: DataFrame, lookup: DataFrame, hours: int = S.HOURS_PER_FILE) -> DataFrame:
    """Unique keys, fewer rows than the cleaned input, at most days x hours x cells of the lookup, no country column."""
    zero = F.lit(0).cast("long")
    left = _key_facts(hourly).withColumns({"clean_rows": zero, "cells": zero})
    right = clean.agg(
        zero.alias("rows"),
        zero.alias("null_keys"),
        zero.alias("repeated_keys"),
        zero.alias("days"),
        F.count(F.lit(1)).alias("clean_rows"),
        zero.alias("cells"),
    )
    known = lookup.agg(F.count_distinct("grid_id").alias("cells"))
    names = ["rows", "repeated_keys", "days", "clean_rows", "cells"]
    both = left.unionByName(right).unionByName(known, allowMissingColumns=True)
    facts = both.agg(*[F.sum(name).alias(name) for name in names])
    rows, limit = F.col("rows"), F.col("days") * hours * F.col("cells")
    country = int("country_code" in hourly.columns)
    return as_checks(
        facts,
        {
            "repeated_keys": (F.lit(0), F.col("repeated_keys"), F.col("repeated_keys") == 0),
            "fewer_rows_than_clean": (F.col("clean_rows"), rows, rows < F.col("clean_rows")),
            "at_most_all_cell_hours": (limit, rows, rows <= limit),
            "no_country_code": (F.lit(0), F.lit(country), F.lit(country == 0)),
        },
    )


def publish_record(canonical: DataFrame, published: DataFrame, run_id: str = "run") -> DataFrame:
    """One row per run: counters of the cleaning step, rows published, latest timestamp, status and reason."""
    counters = clean_counters(canonical).select(
        F.col("input_rows").alias("rows_in"), F.col("rejected_rows").alias("rows_rejected"), "nulls_handled"
    )
    latest = F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss")
    output = published.agg(F.count(F.lit(1)).alias("rows_published"), latest.alias("as_of_reason"))
    both = counters.unionByName(output, allowMissingColumns=True)
    names = ["rows_in", "rows_rejected", "nulls_handled", "rows_published", "as_of_reason"]
    facts = both.agg(*[F.max(name).alias(name) for name in names])
    ok = F.col("rows_published") > 0
    return facts.select(
        F.lit(run_id).alias("run_id"),
        F.when(ok, "SUCCESS").otherwise("FAILED").alias("overall_status"),
        *names,
        F.when(ok, "Quality checks passed").otherwise("Analytics dataset is empty").alias("reason"),
    )


def compare_totals(left: DataFrame, right: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Two loads of the same table: rows and totals of each, and whether they agree."""

    def facts(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("rows"), F.sum("total_activity").alias("total")).select(
            F.lit(name).alias("side"), "rows", "total"
        )

    sides = facts(left, "left").unionByName(facts(right, "right"))

    def pick(name: str, value: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(value))).alias(f"{name}_{value}")

    wide = sides.agg(pick("left", "rows"), pick("right", "rows"), pick("left", "total"), pick("right", "total"))
    return wide.withColumn(
        "passed",
        (F.col("left_rows") == F.col("right_rows")) & (F.abs(F.col("left_total") - F.col("right_total")) <= tolerance),
    )


def round_trip_checks(original: DataFrame, reread: DataFrame) -> DataFrame:
    """Rows, column set, repeated keys and geometry after writing and reading a table again."""
    require_columns(reread, S.CELL_HOUR, "re-read table")
    before = original.agg(F.count(F.lit(1)).alias("original_rows"))
    after = _key_facts(reread).select("rows", "repeated_keys")
    both = before.unionByName(after, allowMissingColumns=True)
    facts = both.agg(*[F.max(name).alias(name) for name in ("original_rows", "rows", "repeated_keys")])
    columns = len(set(original.columns) ^ set(reread.columns))
    geometry = int("geometry_json" in reread.columns)
    return as_checks(
        facts,
        {
            "rows": (F.col("original_rows"), F.col("rows"), F.col("original_rows") == F.col("rows")),
            "columns": (F.lit(0), F.lit(columns), F.lit(columns == 0)),
            "repeated_keys": (F.lit(0), F.col("repeated_keys"), F.col("repeated_keys") == 0),
            "no_geometry": (F.lit(0), F.lit(geometry), F.lit(geometry == 0)),
        },
    )
