"""Daily activity files."""

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens import schema as S


def matching_files(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> list[str]:
    """Paths of the files in a folder, or anywhere below it, whose names match; a missing folder or no match is an error."""
    try:
        found = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(folder).inputFiles()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = []
    if not found:
        raise FileNotFoundError(f"no {pattern} under {folder}")
    return [unquote(path) for path in found]


def read_raw_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Daily files with the fixed raw schema; a value that does not fit its column becomes NULL."""
    return spark.read.schema(S.RAW_SCHEMA).option("header", True).option("mode", "PERMISSIVE").csv(paths)


def read_raw(spark: SparkSession, input_dir: str, pattern: str = S.DAILY_FILE_GLOB) -> DataFrame:
    """All daily files under a folder as one table. No matching file is an error, never an empty result."""
    return read_raw_files(spark, matching_files(spark, input_dir, pattern))


def with_source_file(df: DataFrame) -> DataFrame:
    """Adds the file each row was read from; call it directly on the scan."""
    return df.withColumn("source_file", scanned_file())


def scanned_file() -> Column:
    """Name of the file being scanned. The scan reports it percent-encoded, with a plus sign meaning itself."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def source_file_counts(df: DataFrame, column: str = "source_file") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
