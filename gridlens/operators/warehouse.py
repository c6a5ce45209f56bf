"""Star schema: dim_time, dim_grid, fact_network_activity and its validation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators.joins import small_side
from gridlens.sources.geo import grid_lookup

FACT_MEASURES = [*S.MEASURES, *S.TOTALS, "internet_share"]


def dim_time(hourly: DataFrame) -> DataFrame:
    """Distinct timestamps. The key is the second since 1970, so a later load never renumbers an earlier one."""
    return hourly.select("timestamp", *S.CALENDAR).distinct().select(
        F.unix_timestamp("timestamp").alias("time_key"), "timestamp", *S.CALENDAR
    )


def dim_grid(features: DataFrame, source: str) -> DataFrame:
    """Cells with centroid and a small reference to the geometry; features without a cell are skipped."""
    reference = F.to_json(
        F.struct(
            F.lit(source).alias("source"),
            F.col("grid_id").alias("cellId"),
            F.get_json_object("geometry_json", "$.type").alias("geometry_type"),
        )
    )
    return grid_lookup(features).select("grid_id", "centroid_lat", "centroid_lon", reference.alias("geometry_reference"))


def fact_network_activity(hourly: DataFrame, times: DataFrame) -> DataFrame:
    """Measures by cell and time key; a timestamp missing from dim_time is an error. Pass dim_time as a stored table."""
    keys = small_side(times.select("timestamp", "time_key"))
    missing = F.raise_error(F.concat(F.lit("no time_key for "), F.col("timestamp").cast("string"))).cast("long")
    return hourly.join(keys, "timestamp", "left").select(
        "grid_id", F.coalesce("time_key", missing).alias("time_key"), *FACT_MEASURES
    )


def with_day(fact: DataFrame) -> DataFrame:
    """Fact rows with the day of their time key, by which the table is stored in folders."""
    return fact.withColumn("date", F.to_date(F.timestamp_seconds("time_key")))


def star(fact: DataFrame, times: DataFrame) -> DataFrame:
    """Fact rows with their timestamp columns.

    A fact stored by day is joined by day and key. A filter on dim_time then limits the days that the scan opens: one that
    names dates when the query is planned, one on any other column of dim_time when it runs.
    """
    return fact.join(small_side(times), [name for name in ("date", "time_key") if name in fact.columns])


def warehouse_checks(source: DataFrame, fact: DataFrame, grids: DataFrame) -> DataFrame:
    """check_name, expected, actual, passed."""

    def side(df: DataFrame, check: str, expected: Column | None = None, actual: Column | None = None) -> DataFrame:
        none = F.lit(None).cast("long")
        return df.agg(
            (none if expected is None else expected).alias("expected"), (none if actual is None else actual).alias("actual")
        ).withColumn("check_name", F.lit(check))

    def geometry_columns(df: DataFrame) -> int:
        return len([name for name in df.columns if "geometry" in name.lower()])

    rows = F.count(F.lit(1))
    grid_keys = grids.groupBy("grid_id").count()
    fact_keys = fact.groupBy("grid_id", "time_key").count()
    repeated = F.count_if(F.col("count") > 1)
    parts = [
        side(source, "fact_rows", expected=rows),
        side(fact, "fact_rows", actual=rows),
        side(fact, "grid_rows", expected=F.count_distinct("grid_id")),
        side(grids, "grid_rows", actual=rows),
        side(grid_keys, "repeated_grid_keys", F.lit(0).cast("long"), repeated),
        side(fact_keys, "repeated_fact_keys", F.lit(0).cast("long"), repeated),
        side(grids, "geometry_columns", F.lit(0).cast("long"), F.lit(geometry_columns(fact)).cast("long")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return (
        union.groupBy("check_name")
        .agg(F.max("expected").alias("expected"), F.max("actual").alias("actual"))
        .withColumn("passed", F.col("expected") == F.col("actual"))
    )
