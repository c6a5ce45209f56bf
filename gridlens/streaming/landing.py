"""The file gate on a stream of landing files: the source lists and remembers files, each micro-batch is judged, routed and audited.

No list of files is handed to a reader: the stream's batch is the input of gate, zones and audit. Every table is written in folders of the
file or of the batch, so a repeated batch stores nothing twice. Folders of the file suit a few large files a day; where many small ones land, name by_batch from the
first call on: the driver creates and commits folders one by one, and those of the batch do not grow in number with the files. A file whose name was judged in another batch, from another folder, is skipped with an audit
entry. Files without any line do not show in a stream; they are the names in the folder's listing that no batch has shown.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from gridlens import schema as S
from gridlens.operators.joins import small_side
from gridlens.session import stage
from gridlens.sources import files
from gridlens.sources.activity import scanned_file

RAW, REJECTED, AUDIT = "raw", "rejected", "audit"


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def audit_log(spark: SparkSession, zone_dir: str) -> DataFrame:
    """All audit entries with the stream and batch that wrote them."""
    schema = f"{S.AUDIT_SCHEMA}, stream string, batch long"
    try:
        return spark.read.schema(schema).parquet(f"{zone_dir}/{AUDIT}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _by_file(df: DataFrame, path: str, column: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def _by_batch(df: DataFrame, zone_dir: str, table: str, stream: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{zone_dir}/{table}/stream={stream}/batch={batch_id}")


def _split_seen(names: DataFrame, zone_dir: str, stream: str, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Of the files of a batch those that are new, and skip entries for the others; the batch's own earlier attempt does not count."""
    log = audit_log(names.sparkSession, zone_dir)
    others = log.where((F.col("stream") != stream) | (F.col("batch") != batch_id))
    return stage(files.new_files(names, others), "new-files"), files.skipped_files(names, others)


def take_lines(batch: DataFrame, batch_id: int, zone_dir: str, by_batch: bool = False) -> None:
    """Judges the files of a batch of lines (file, block, line), stores rows of accepted and lines of rejected ones, and writes the audit."""
    lines = batch.withColumn("position", F.monotonically_increasing_id())
    names = stage(lines.select("file").distinct(), "batch-files")
    fresh, skipped = _split_seen(names, zone_dir, "lines", batch_id)
    own = lines.join(small_side(fresh), "file", "left_semi")
    judged, records = files.judge_and_gather(own)
    judged = stage(judged, "judged")
    accepted, rejected = files.accepted_rows(own, judged, records), files.route_lines(own, judged, False)
    if by_batch:
        _by_batch(accepted, zone_dir, RAW, "lines", batch_id)
        _by_batch(rejected, zone_dir, REJECTED, "lines", batch_id)
    else:
        _by_file(accepted, f"{zone_dir}/{RAW}", "source_file")
        _by_file(rejected, f"{zone_dir}/{REJECTED}", "file")
    _by_batch(files.audit_rows(judged.drop("broken"), skipped), zone_dir, AUDIT, "lines", batch_id)


def audit_empty(spark: SparkSession, landing_dir: str, zone_dir: str, pattern: str) -> None:
    """Audit entries of the files without a line: those listed that no batch of lines has shown. Run it after the stream has taken all there is."""
    log = audit_log(spark, zone_dir)
    fresh = stage(files.new_files(files.list_files(spark, landing_dir, pattern, True).select("file").distinct(), log), "empty-files")
    if not fresh.isEmpty():
        number = log.where("stream = 'empty'").agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
        verdicts = fresh.select("file", F.lit(False).alias("ok"), F.lit(files.EMPTY).alias("reason"))
        _by_batch(files.audit_rows(verdicts, files.skipped_files(fresh, log)), zone_dir, AUDIT, "empty", number)


def ingest_available(spark: SparkSession, landing_dir: str, zone_dir: str, pattern: str = S.DAILY_FILE_GLOB, by_batch: bool = False) -> DataFrame:
    """Takes what has landed since the last call and gives the audit log. A missing landing folder is an error."""
    source = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    try:
        lines = source.text(landing_dir)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no folder {landing_dir}") from None
    lines = lines.select(scanned_file().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    run_available(lines.writeStream.foreachBatch(lambda batch, number: take_lines(batch, number, zone_dir, by_batch)), f"{zone_dir}/checkpoints/lines")
    audit_empty(spark, landing_dir, zone_dir, pattern)
    return audit_log(spark, zone_dir)
