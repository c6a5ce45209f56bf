"""Maps the supplied test tables to activity tables. Every row of the source table is used."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens import schema as S

EVENT_MEASURES = {"smsin": "click", "smsout": "view", "callin": "purchase", "callout": "signup", "internet": "error"}
DECIMALS = 2
FIXTURE_THRESHOLD = 120.0
FILE_PREFIX = "activity-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as raw activity rows, with some values spoiled to exercise the cleaning rules.

    Ten users share a cell, so cells grow with the table. Times are cut to the hour.
    """
    bad_time, no_cell, negative = F.col("event_id") % 101 == 11, F.col("event_id") % 89 == 7, F.col("event_id") % 97 == 5
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")
    signed = F.when(negative, -F.col("value")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(bad_time, "not-a-time").otherwise(hour).alias("datetime"),
        F.when(~no_cell, F.floor(F.col("user_id") / 10) + 1).cast("int").alias("CellID"),
        (F.get_json_object("props", "$.k").cast("int") % 4).alias("countrycode"),
        *[F.when(F.col("event_type") == kind, signed).alias(name) for name, kind in EVENT_MEASURES.items()],
        F.date_format("ts", "yyyy-MM-dd").alias("file_date"),
    )


def activity_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_rows(spark, sf_dir).select(*S.RAW_COLUMNS)


def wide_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as raw activity: suppliers are cells and shipping days are consecutive hours."""
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date"))
    hour = F.timestamp_seconds(F.unix_timestamp(F.lit("2013-11-01 00:00:00").cast("timestamp")) + days * 3600)
    return table(spark, sf_dir, "lineitem").select(
        hour.alias("datetime"),
        (F.col("l_suppkey") + 1).cast("int").alias("CellID"),
        F.col("l_linenumber").cast("int").alias("countrycode"),
        F.col("l_quantity").alias("smsin"),
        (F.col("l_discount") * 100).alias("smsout"),
        (F.col("l_tax") * 100).alias("callin"),
        F.col("l_linenumber").cast("double").alias("callout"),
        F.col("l_extendedprice").alias("internet"),
    )


def landing_lines(spark: SparkSession, sf_dir: str, block_ids: int = 65536) -> DataFrame:
    """The event rows as the text lines of one landing file per date and cell, header first.

    A block takes block_ids consecutive event ids, so like the split of a file scan it has a bounded size, and
    lines are numbered within it.
    """
    cell = F.coalesce(F.col("CellID").cast("string"), F.lit("none"))
    name = F.concat(F.lit(FILE_PREFIX), "file_date", F.lit("-c"), cell, F.lit(".csv"))
    rows = event_rows(spark, sf_dir).withColumn("file", name)
    fields = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in S.RAW_COLUMNS]
    block = F.floor(F.col("event_id") / block_ids) + 1
    in_block = Window.partitionBy("file", "block").orderBy("event_id")
    data = (
        rows.withColumn("block", block)
        .withColumn("position", F.row_number().over(in_block).cast("long"))
        .select("file", "block", "position", F.concat_ws(",", *fields).alias("line"))
    )
    header = rows.select("file").distinct().select(
        "file",
        F.lit(0).cast("long").alias("block"),
        F.lit(0).cast("long").alias("position"),
        F.lit(",".join(S.RAW_COLUMNS)).alias("line"),
    )
    return header.unionByName(data)


def spoiled_lines(lines: DataFrame) -> DataFrame:
    """The same files, each spoiled in the way that its cell modulo five says; files without a cell stay as they are."""
    kind = F.regexp_extract("file", r"-c(\d+)\.csv$", 1).try_cast("int") % 5
    header = (F.col("block") == 0) & (F.col("position") == 0)
    smsin = lambda value: F.regexp_replace("line", r"^([^,]*,[^,]*,[^,]*),[^,]*", f"$1,{value}")
    line = (
        F.when(header, F.when(kind == 0, "datetime,CellID").otherwise(F.col("line")))
        .when(kind == 1, F.concat("line", F.lit(",1")))
        .when(kind == 2, smsin("abc"))
        .when(kind == 4, smsin("Infinity"))
        .otherwise(F.col("line"))
    )
    return lines.where(header | ~F.coalesce(kind == 3, F.lit(False))).withColumn("line", line)


def quoted_lines(lines: DataFrame, per_block: int = 5) -> DataFrame:
    """The same files with every smsin in quotes and a line break behind it, in blocks of a few lines, so records cross them.

    Cells whose number leaves 2 modulo five have a comma and no number in the quotes, those that leave 1 a quoted field too many.
    """
    kind = F.regexp_extract("file", r"-c(\d+)\.csv$", 1).try_cast("int") % 5
    header = (F.col("block") == 0) & (F.col("position") == 0)
    smsin = lambda value: F.regexp_replace("line", r"^([^,]*,[^,]*,[^,]*),([^,]*)", f'$1,"{value}"')
    text = F.when(header, F.col("line")).when(kind == 2, smsin("a,\nb")).otherwise(smsin("$2\n"))
    text = F.when((kind == 1) & ~header, F.concat(text, F.lit(',"x""\n\ny"'))).otherwise(text)
    parts = lines.select("file", "block", "position", F.posexplode(F.split(text, "\n")).alias("part", "line"))
    in_file = Window.partitionBy("file").orderBy("block", "position", "part")
    numbered = parts.withColumn("nth", F.row_number().over(in_file).cast("long") - 1)
    return numbered.select("file", F.floor(F.col("nth") / per_block).alias("block"), "nth", "line").withColumnRenamed("nth", "position")


def grid_features(hourly: DataFrame) -> DataFrame:
    """One square cell per grid id on a 100-wide grid; every seventh is written as a MultiPolygon."""
    cell = F.col("grid_id").cast("long") - 1
    west, south = F.lit(9.0) + (cell % 100) * 0.01, F.lit(45.0) + F.floor(cell / 100) * 0.01
    east, north = west + 0.01, south + 0.01
    ring = F.array(*[F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))])
    polygon = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    multi = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring)).alias("coordinates"))
    geometry = F.when(F.col("grid_id") % 7 == 0, F.to_json(multi)).otherwise(F.to_json(polygon))
    return hourly.select("grid_id").distinct().select(F.col("grid_id").cast("long"), geometry.alias("geometry"))
