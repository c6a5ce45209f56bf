"""File gate: every landing file is checked record by record in one distributed pass; files with quoted line breaks take a second one."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators.joins import small_side
from gridlens.session import stage
from gridlens.sources.activity import matching_files, scanned_file
from gridlens.sources.records import opens_record, raw_rows, whole_records

# --- fixed values: verdict texts of the gate ---
PASSED = "Validation passed"
EMPTY = "Empty file"
BAD_HEADER = "Invalid schema"
NO_ROWS = "No data rows"
WRONG_WIDTH = "Incorrect number of columns"
BAD_TIME = "Invalid datetime"
NOT_A_NUMBER = "Non-numeric value in {}"
NOT_FINITE = "Non-finite value in {}"
NEGATIVE = "Negative value in {}"
IN_RAW = "File already exists in raw"
IN_REJECTED = "File already exists in rejected"

_ISO_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d{1,6})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def list_files(spark: SparkSession, landing_dir: str, pattern: str = "*.csv", recursive: bool = False) -> DataFrame:
    """file and path of every landing file, empty files included. Only names pass through the driver, as in any scan."""
    found = matching_files(spark, landing_dir, pattern, recursive)
    paths = spark.createDataFrame([(path,) for path in found], "path string")
    return paths.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "path")


def read_lines(spark: SparkSession, source: str | list[str], pattern: str = "*.csv") -> DataFrame:
    """file, block, position, line: block is the split's start in the file, position grows by one per line in it."""
    lines = spark.read.option("pathGlobFilter", pattern).text(source)
    return lines.select(
        scanned_file().alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
        F.col("value").alias("line"),
    )


# a field behind its comma: text and whole quoted pieces; in a line with a single quote left over, all up to its first quote is in the first field
_FIELD = r'[^",]*+(?:"[^"]*+"[^",]*+)*+'
_FIELDS, _FIELDS_AFTER_QUOTE = f",({_FIELD})", f',((?:(?<=^,)[^"]*+")?+{_FIELD})'


def split_line(line: Column) -> Column:
    """Fields of a CSV line; quotes are honoured where the line has any: a comma parts fields if an even number of quotes follows."""
    is_odd = F.length(F.regexp_replace(line, '[^"]++', "")) % 2 == 1
    behind = F.concat(F.lit(","), line)
    parted = F.when(is_odd, F.regexp_extract_all(behind, F.lit(_FIELDS_AFTER_QUOTE), 1)).otherwise(F.regexp_extract_all(behind, F.lit(_FIELDS), 1))
    bare = lambda field: F.regexp_replace(F.regexp_replace(field, r'(?s)^\s*"(.*)"\s*$', "$1"), '""', '"')
    quoted = F.transform(parted, lambda field: F.when(F.contains(field, F.lit('"')), bare(field)).otherwise(field))
    return F.when(F.contains(line, F.lit('"')), quoted).otherwise(F.split(line, ","))


def is_header(fields: Column) -> Column:
    return F.transform(fields, lambda field: F.trim(field)) == F.array(*[F.lit(name) for name in S.RAW_COLUMNS])


def _number(text: Column) -> Column:
    """The number, or NULL; Java-only spellings such as 1.0d or 0x1p3 are not numbers here. A blank field is not cast, which costs an exception each."""
    return F.when((text != "") & ~text.rlike(r"(?i)([0-9.][df]|x.*)$"), text.try_cast("double"))


def _trimmed(field: Column) -> Column:
    """Without white space of any kind at its ends; a quoted field may end in a line break."""
    return F.when(F.contains(field, F.lit("\n")), F.regexp_replace(field, r"^\s+|\s+$", "")).otherwise(F.trim(field))


def with_violation(lines: DataFrame) -> DataFrame:
    """Adds violation: the first thing wrong with a data line, its fields checked left to right, or NULL. Cell and country are not checked.

    Each field is taken out and cast once; the checks look at the results.
    """
    fields, numbers = F.col("fields"), {}
    values = {"time_text": _trimmed(fields[0])}
    for index, name in enumerate(S.RAW_COLUMNS):
        if name in S.RAW_MEASURES:
            values[f"text_{name}"] = _trimmed(F.try_element_at(fields, F.lit(index + 1)))
            numbers[f"number_{name}"] = _number(F.col(f"text_{name}"))
    time = F.col("time_text")
    checks = [
        F.when(F.size(fields) != len(S.RAW_COLUMNS), WRONG_WIDTH),
        F.when(~time.rlike(_ISO_TIME) | F.try_to_timestamp(time).isNull(), BAD_TIME),
    ]
    for name in S.RAW_MEASURES:
        text, number = F.col(f"text_{name}"), F.col(f"number_{name}")
        wrong = F.when(number.isNull(), NOT_A_NUMBER.format(name)).when(F.isnan(number) | (F.abs(number) == float("inf")), NOT_FINITE.format(name))
        checks.append(F.when(text != "", wrong.when(number < 0, NEGATIVE.format(name))))
    return lines.withColumns(values).withColumns(numbers).withColumn("violation", F.coalesce(*checks)).drop(*values, *numbers)


def validate_files(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """file, ok, reason. Row numbers count records from 1 with the header; the first violation decides.

    Lines are taken as records first. Files in which a line leaves a quoted field open are then judged again by whole records.
    """
    return judge_files(lines, files).drop("broken")


def judge_files(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The same with broken: whether records of the file take several lines."""
    return judge_and_gather(lines, files)[0]


def judge_and_gather(lines: DataFrame, files: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The same, and the stored records of the broken files, if any, so that accepted_rows need not gather them again."""
    verdicts = stage(_verdicts(lines, files), "verdicts")
    broken = verdicts.where("broken").select("file")
    if broken.isEmpty():
        return verdicts, None
    records = stage(whole_records(lines.join(small_side(broken), "file", "left_semi")), "records")
    return verdicts.where("NOT broken").unionByName(_verdicts(records, broken).withColumn("broken", F.lit(True))), records


def _verdicts(lines: DataFrame, files: DataFrame | None) -> DataFrame:
    """file, ok, reason, and whether a line leaves a quoted field open.

    The lines are reduced within their own scan task to one row per file and split, so a file of any
    size is checked in parallel and only split summaries are shuffled. The header positions gathered
    per split are limited to the first split of a file, whose size the scan bounds.
    """
    fields = F.col("fields")
    checked = with_violation(lines.withColumn("fields", split_line(F.col("line")))).select(
        "file",
        "block",
        "position",
        is_header(fields).alias("header_like"),
        "violation",
        opens_record(F.col("line")).alias("opens"),
    )
    bad = F.struct("position", "violation")
    plain = ~F.col("header_like")
    first_split = F.col("header_like") & (F.col("block") == 0)
    splits = checked.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("position").alias("first_position"),
        F.min_by("header_like", "position").alias("starts_with_header"),
        F.min(F.when(plain & F.col("violation").isNotNull(), bad)).alias("bad_plain"),
        F.min(F.when(~plain & (F.col("block") != 0), bad)).alias("bad_later_header"),
        F.collect_list(F.when(first_split, F.col("position"))).alias("headers"),
        F.max("opens").alias("broken"),
    )
    repeated = F.array_min(F.filter("headers", lambda p: p > F.col("first_position")))
    by_block = Window.partitionBy("file").orderBy("block")
    numbered = splits.select(
        "file",
        "block",
        "lines",
        "starts_with_header",
        "broken",
        (F.sum("lines").over(by_block) - F.col("lines") - F.col("first_position") + 1).alias("shift"),
        F.least(
            F.when(
                (F.col("block") != 0) | (F.col("bad_plain.position") > F.col("first_position")), F.col("bad_plain")
            ),
            F.col("bad_later_header"),
            F.when(repeated.isNotNull(), F.struct(repeated.alias("position"), F.lit(BAD_TIME).alias("violation"))),
        ).alias("bad"),
    )
    row_number = F.col("bad.position") + F.col("shift")
    per_file = numbered.groupBy("file").agg(
        F.sum("lines").alias("lines"),
        F.max("broken").alias("broken"),
        F.max(F.when(F.col("block") == 0, F.col("starts_with_header"))).alias("has_header"),
        F.min(F.when(F.col("bad").isNotNull(), F.struct(row_number.alias("row"), F.col("bad.violation")))).alias("bad"),
    )
    if files is not None:
        per_file = files.select("file").join(per_file, "file", "left")
    reason = (
        F.when(F.col("lines").isNull(), EMPTY)
        .when(~F.col("has_header"), BAD_HEADER)
        .when(F.col("bad").isNotNull(), F.format_string("%s at row %d", F.col("bad.violation"), F.col("bad.row")))
        .when(F.col("lines") == 1, NO_ROWS)
        .otherwise(PASSED)
    )
    judged = per_file.select("file", reason.alias("reason"), F.coalesce("broken", F.lit(False)).alias("broken"))
    return judged.select("file", (F.col("reason") == PASSED).alias("ok"), "reason", "broken")


def accepted_rows(lines: DataFrame, verdicts: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Raw activity rows of the accepted files, with source_file; records of several lines are put together.

    verdicts: of judge_files, stored. records: those of judge_and_gather, gathered anew where not given.
    """
    whole = route_lines(lines, verdicts.where("NOT broken"), True)
    broken = verdicts.where("broken AND ok")
    if not broken.isEmpty():
        gathered = whole_records(route_lines(lines, broken, True)) if records is None else route_lines(records, broken, True)
        whole = whole.unionByName(gathered)
    return raw_rows(whole, split_line(F.col("line")))


def new_files(files: DataFrame, audit: DataFrame) -> DataFrame:
    """Landing files with no accepted or rejected entry in the audit log."""
    seen = audit.where(F.col("status").isin("ACCEPTED", "REJECTED")).select(F.col("filename").alias("file"))
    return files.join(seen, "file", "left_anti")


def skipped_files(files: DataFrame, audit: DataFrame) -> DataFrame:
    """file, status, reason of landing files already in the raw or rejected zone; raw wins."""
    accepted = F.max(F.col("status") == "ACCEPTED")
    zones = (
        audit.where(F.col("status").isin("ACCEPTED", "REJECTED"))
        .groupBy(F.col("filename").alias("file"))
        .agg(F.when(accepted, IN_RAW).otherwise(IN_REJECTED).alias("reason"))
    )
    return files.join(zones, "file").select("file", F.lit("SKIPPED").alias("status"), "reason")


def route_lines(lines: DataFrame, verdicts: DataFrame, ok: bool) -> DataFrame:
    """Lines of the accepted files, or of the rejected ones."""
    chosen = verdicts.where(F.col("ok") if ok else ~F.col("ok")).select("file")
    return lines.join(small_side(chosen), "file", "left_semi")


def audit_rows(verdicts: DataFrame, skipped: DataFrame, at: Column | None = None) -> DataFrame:
    """Audit log rows for every file seen in a run."""
    status = F.when(F.col("ok"), "ACCEPTED").otherwise("REJECTED")
    judged = verdicts.select("file", status.alias("status"), "reason")
    return judged.unionByName(skipped).select(
        (F.current_timestamp() if at is None else at).alias("timestamp"), F.col("file").alias("filename"), "status", "reason"
    )
