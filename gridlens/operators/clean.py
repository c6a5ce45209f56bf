"""Canonical names, quarantine, null-to-zero, calendar and total columns."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.functions import columns as C


def require_columns(df: DataFrame, required: list[str], table: str = "table") -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{table} is missing columns: {missing}")
    return df


def to_canonical(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(S.CANONICAL_NAMES)


def flag_rejects(canonical: DataFrame) -> DataFrame:
    """Parses the timestamp and adds reject_cause, NULL for a good row; never drops a row."""
    require_columns(canonical, list(S.CANONICAL_NAMES.values()), "activity")
    parsed = canonical
    if dict(canonical.dtypes)["timestamp"] == "string":
        parsed = canonical.withColumn("timestamp", F.try_to_timestamp("timestamp"))
    return parsed.withColumn(
        "reject_cause",
        F.when(C.missing_key(S.CELL_HOUR), "MISSING_KEY")
        .when(C.non_finite_measure(S.MEASURES), "NON_FINITE_VALUE")
        .when(C.negative_measure(S.MEASURES), "NEGATIVE_VALUE"),
    )


def rejected_rows(canonical: DataFrame) -> DataFrame:
    return flag_rejects(canonical).where(F.col("reject_cause").isNotNull())


def clean_activity(canonical: DataFrame) -> DataFrame:
    kept = flag_rejects(canonical).where(F.col("reject_cause").isNull()).drop("reject_cause")
    return add_totals(add_calendar(kept.fillna(0.0, S.MEASURES)))


def add_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "date": F.to_date("timestamp"),
            "hour": F.hour("timestamp"),
            "day_of_week": F.date_format("timestamp", "EEEE"),
        }
    )


def add_totals(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {"total_sms": C.total_sms(), "total_calls": C.total_calls(), "total_activity": C.total_activity()}
    )


def clean_counters(canonical: DataFrame) -> DataFrame:
    """input_rows, rejected_rows by cause, nulls_handled (null measures of kept rows), output_rows; one pass."""
    kept = F.col("reject_cause").isNull()
    null_cells = sum((F.col(name).isNull().cast("long") for name in S.MEASURES), F.lit(0).cast("long"))
    return flag_rejects(canonical).agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.count_if(~kept).alias("rejected_rows"),
        F.count_if(F.col("reject_cause") == "MISSING_KEY").alias("rejected_missing_key"),
        F.count_if(F.col("reject_cause") == "NON_FINITE_VALUE").alias("rejected_non_finite"),
        F.count_if(F.col("reject_cause") == "NEGATIVE_VALUE").alias("rejected_negative"),
        F.coalesce(F.sum(F.when(kept, null_cells)), F.lit(0)).cast("long").alias("nulls_handled"),
        F.count_if(kept).alias("output_rows"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """One row per key. With an order the first row by it, as an aggregate, so copies collapse before the shuffle."""
    if not order:
        return df.dropDuplicates(keys)
    rest = [name for name in df.columns if name not in keys]
    chosen = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(chosen).select(*keys, "_row.*").select(*df.columns)


def union_tables(tables: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Tables of several days or sources as one; with keys, one row per key. Daily files need no union: scan them together."""
    union = reduce(DataFrame.unionByName, tables)
    return first_per_key(union, keys) if keys else union
