"""Table scans and sinks."""

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens import schema as S


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_cell_hour(
    spark: SparkSession,
    path: str,
    grid_id: int | None = None,
    timestamp: datetime | None = None,
    columns: list[str] | None = None,
    time_column: str = "timestamp",
) -> DataFrame:
    """Rows of one cell and/or one timestamp; filters and columns reach the Parquet scan."""
    return at_cell_hour(spark.read.parquet(path), grid_id, timestamp, columns, time_column)


def at_cell_hour(
    df: DataFrame,
    grid_id: int | None = None,
    timestamp: datetime | None = None,
    columns: list[str] | None = None,
    time_column: str = "timestamp",
) -> DataFrame:
    if grid_id is not None:
        df = df.where(F.col("grid_id") == grid_id)
    if timestamp is not None:
        df = df.where(F.col(time_column) == F.lit(timestamp))
    return df.select(*columns) if columns else df


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts from CSV, or from JSON as a list or under "data" or "alerts"."""
    if path.rstrip("/").lower().endswith(".csv"):
        return spark.read.schema(S.ALERT_SCHEMA).option("header", True).csv(path)
    row = ", ".join(f"{name}:{kind}" for name, kind in (f.split(" ") for f in S.ALERT_SCHEMA.split(", ")))
    wrapped = f"data array<struct<{row}>>, alerts array<struct<{row}>>"
    documents = spark.read.schema(f"{S.ALERT_SCHEMA}, {wrapped}").option("multiLine", True).json(path)
    names = [f.split(" ")[0] for f in S.ALERT_SCHEMA.split(", ")]
    rows = F.coalesce("data", "alerts", F.array(F.struct(*names)))
    return documents.select(F.inline(rows))


def write_activity(clean: DataFrame, path: str) -> None:
    """Processed activity by date; a rerun replaces only the dates it carries."""
    clean.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def write_hourly(hourly: DataFrame, path: str) -> None:
    """The hourly summary, spread over its files by ranges of cell and time, so that a filter on cells reads
    the row groups of few files; of the others only the footer."""
    if "geometry_json" in hourly.columns:
        raise ValueError("geometry does not belong in the hourly summary")
    write_table(hourly, path, S.CELL_HOUR, clustered=True)


def write_table(df: DataFrame, path: str, sort_by: list[str] | None = None, clustered: bool = False) -> None:
    """Overwrites a table, sorted inside its files. A clustered one is also spread over its files by ranges of the
    sort columns, for tables that are mostly read by filter: then all row groups of most files are skipped."""
    if sort_by:
        df = (df.repartitionByRange(*sort_by) if clustered else df).sortWithinPartitions(*sort_by)
    df.write.mode("overwrite").parquet(path)


def write_by_day(df: DataFrame, path: str, sort_by: list[str], day: str = "date") -> None:
    """Folders by day, rows of a day sorted and spread over files by ranges of the keys; replaces only the days it carries."""
    spread = df.repartitionByRange(day, *sort_by).sortWithinPartitions(day, *sort_by)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


#: Whether both sides of a join must be placed by all of its keys; buckets of one column are enough where this is off.
PARTIAL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def bucketed_name(path: str) -> str:
    """The name under which a bucketed table at a path is known to the session catalog."""
    return f"gridlens_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, buckets: int, sort_by: list[str], by: str = "grid_id") -> DataFrame:
    """A table in buckets of a column, one file for each, and the table as a scan that knows them.

    Tables with equal bucket numbers join on the column, with others beside it or without, group by it and take windows over it without a
    shuffle; for the former the session is told that the bucket column alone may place rows of a join. Choose the number for the
    largest of them, about 200 MB a bucket.
    """
    spark, name = df.sparkSession, bucketed_name(path)
    spark.conf.set(PARTIAL_KEYS, "false")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, by).write.mode("overwrite").bucketBy(buckets, by).sortBy(*sort_by)
    writer.option("path", path).saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, buckets: int, sort_by: list[str], by: str = "grid_id") -> DataFrame:
    """A bucketed table that another session wrote. The numbers and columns must be those of the writer."""
    spark.conf.set(PARTIAL_KEYS, "false")
    name, columns = bucketed_name(path), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema)
    layout = f"CLUSTERED BY (`{by}`) SORTED BY ({', '.join(f'`{c}`' for c in sort_by)}) INTO {buckets} BUCKETS"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {layout} LOCATION '{path}'")
    return spark.table(name)


def write_small_csv(df: DataFrame, path: str, max_rows: int = 1000) -> None:
    """A single CSV file for people, written by one task. A larger table is an error, not cut: use write_csv for it."""
    rows = df.limit(max_rows + 1).count()
    if rows > max_rows:
        raise ValueError(f"more than {max_rows} rows are no small table; write_csv takes any number")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def storage_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Files and bytes of each named table on storage, from the file listing alone; no content is read."""
    sizes = None
    for name, path in paths.items():
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*")
        row = listed.load(path).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
        named = row.select(F.lit(name).alias("storage"), "files", "bytes")
        sizes = named if sizes is None else sizes.unionByName(named)
    return sizes
