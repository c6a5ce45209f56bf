"""Profiling facts and ingestion acceptance checks."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators.windows import timestamp_gaps


def _long_form(df: DataFrame, counts: dict[str, Column], key: str, value: str) -> DataFrame:
    return df.agg(*[c.alias(name) for name, c in counts.items()]).unpivot([], list(counts), key, value)


def shape(df: DataFrame) -> DataFrame:
    """column_name, data_type, rows: one row per column."""
    types = F.explode(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(t).alias("data_type")) for n, t in df.dtypes]))
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", types.alias("c")).select("c.*", "rows")


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return _long_form(df, {n: F.count_if(F.col(n).isNull()) for n in columns or df.columns}, "column_name", "nulls")


def negative_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return _long_form(df, {n: F.count_if(F.col(n) < 0) for n in columns}, "column_name", "negatives")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    return copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def cadence(df: DataFrame, order: str = "timestamp") -> DataFrame:
    """Whether neighbouring distinct timestamps are all exactly one hour apart."""
    gap = F.unix_micros(order) - F.unix_micros("previous")
    return timestamp_gaps(df, order).agg(
        F.count(F.lit(1)).alias("distinct_timestamps"),
        F.count_if(gap != 3_600_000_000).alias("irregular_gaps"),
        F.coalesce(F.bool_and(gap == 3_600_000_000), F.lit(True)).alias("hourly"),
    )


def multi_country_keys(canonical: DataFrame) -> DataFrame:
    """Cell and timestamp pairs that occur on more than one row."""
    return canonical.groupBy(*S.CELL_HOUR).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def multi_country_example(canonical: DataFrame) -> DataFrame:
    """All rows of the first such pair."""
    keyed = canonical.dropna(subset=S.CELL_HOUR)
    first = multi_country_keys(keyed).orderBy(*S.CELL_HOUR).limit(1)
    return keyed.join(F.broadcast(first), S.CELL_HOUR, "left_semi")


def cardinalities(canonical: DataFrame, file_column: str | None = None) -> DataFrame:
    """Exact distinct counts; NULL is not a value."""
    names = {"grid_id": "grids", "country_code": "country_codes", "timestamp": "timestamps"}
    if file_column:
        names[file_column] = "files"
    return canonical.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_distinct(column).alias(name) for column, name in names.items()]
    )


def approx_cardinalities(canonical: DataFrame, relative_error: float = 0.02) -> DataFrame:
    """As cardinalities from sketches: one pass, no shuffle of the values."""
    names = {"grid_id": "grids", "country_code": "country_codes", "timestamp": "timestamps"}
    return canonical.agg(*[F.approx_count_distinct(c, relative_error).alias(name) for c, name in names.items()])


def daily_sketches(canonical: DataFrame, log_buckets: int = 12) -> DataFrame:
    """HyperLogLog states of cells, country codes and timestamps for each day: a row of a few kilobytes, however many values a day has."""
    columns = {"grids": F.col("grid_id").cast("long"), "country_codes": F.col("country_code").cast("long"), "timestamps": F.unix_seconds("timestamp")}
    sketches = [F.hll_sketch_agg(value, log_buckets).alias(name) for name, value in columns.items()]
    return canonical.where(F.col("timestamp").isNotNull()).groupBy(F.to_date("timestamp").alias("date")).agg(*sketches)


def cardinalities_from_sketches(sketches: DataFrame, period: str = "week") -> DataFrame:
    """Estimated distinct counts for each period, merged from the stored states of its days; no row of a day is read again.

    The standard error is 1.04 / 2 ** (log_buckets / 2), 1.6 % by default.
    """
    names = ["grids", "country_codes", "timestamps"]
    start = F.to_date(F.date_trunc(period, "date")).alias("period")
    return sketches.groupBy(start).agg(*[F.hll_sketch_estimate(F.hll_union_agg(n)).alias(n) for n in names])


def busiest(df: DataFrame, key: str, value: str = "total_activity") -> DataFrame:
    """The key with the largest sum; the smaller key wins a tie."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(value).alias(value))
    return sums.orderBy(F.desc(value), key).limit(1)


def time_range(df: DataFrame, order: str = "timestamp") -> DataFrame:
    return df.agg(F.min(order).alias("first_timestamp"), F.max(order).alias("last_timestamp"))


def acceptance_checks(
    raw: DataFrame,
    file_column: str,
    cells: tuple[int, int] | None = None,
    hours_per_file: int = S.HOURS_PER_FILE,
) -> DataFrame:
    """check, expected, actual, passed rows over the raw table. Cell ids are checked against a range only if one is given."""
    outside = F.lit(False) if cells is None else ~F.col("CellID").between(*cells)
    facts = raw.agg(
        F.count_distinct("datetime").alias("timestamps"),
        (F.count_distinct(file_column) * hours_per_file).alias("expected_timestamps"),
        F.count_if(outside).alias("cells_out_of_range"),
        F.count_if(F.col(file_column).isNull() | (F.col(file_column) == "")).alias("missing_lineage"),
    )
    zero = F.lit(0).cast("long")
    rows = [
        ("timestamps_per_file", F.col("expected_timestamps"), F.col("timestamps")),
        ("cell_range", zero, F.col("cells_out_of_range")),
        ("lineage", zero, F.col("missing_lineage")),
    ]
    checks = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("check_name"), e.alias("expected"), a.alias("actual")) for n, e, a in rows]
        )
    )
    return facts.select(checks.alias("c")).select(
        "c.*", (F.col("c.expected") == F.col("c.actual")).alias("passed")
    )


def partition_report(df: DataFrame) -> DataFrame:
    """Rows per partition of the table as it is read."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count(F.lit(1)).alias("rows"))
