import os

import pytest
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.sources import activity, files

HEADER = ",".join(S.RAW_COLUMNS)
GOOD = "2013-11-01 00:00:00,1,39,1.5,,0,2e1,3"

CASES = {
    "empty.csv": ("", "Empty file"),
    "header.csv": ("a,b,c\n" + GOOD + "\n", "Invalid schema"),
    "reordered.csv": (HEADER.replace("smsin,smsout", "smsout,smsin") + "\n" + GOOD + "\n", "Invalid schema"),
    "blank_first.csv": ("\n" + HEADER + "\n" + GOOD + "\n", "Invalid schema"),
    "only_header.csv": (HEADER + "\n", "No data rows"),
    "spaced_header.csv": (HEADER.replace(",", " , ") + "\n" + GOOD + "\n", "Validation passed"),
    "with space+plus%.csv": (HEADER + "\n" + GOOD + "\n", "Validation passed"),
    "good.csv": (HEADER + "\n" + GOOD + "\n" + GOOD.replace(" 00", "T00") + "\n", "Validation passed"),
    "no_newline.csv": (HEADER + "\n" + GOOD, "Validation passed"),
    "date_only.csv": (HEADER + "\n2013-11-01,x,y,,,,,\n", "Validation passed"),
    "short.csv": (HEADER + "\n" + GOOD + "\n1,2\n", "Incorrect number of columns at row 3"),
    "blank_line.csv": (HEADER + "\n\n" + GOOD + "\n", "Incorrect number of columns at row 2"),
    "bad_time.csv": (HEADER + "\n" + GOOD + "\n" * 1 + GOOD.replace("2013-11-01", "2013-13-01") + "\n", "Invalid datetime at row 3"),
    "short_date.csv": (HEADER + "\n2013-11,1,2,,,,,\n", "Invalid datetime at row 2"),
    "text.csv": (HEADER + "\n2013-11-01,1,2,1,abc,-1,,\n", "Non-numeric value in smsout at row 2"),
    "java_number.csv": (HEADER + "\n2013-11-01,1,2,1.0d,,,,\n", "Non-numeric value in smsin at row 2"),
    "negative.csv": (HEADER + "\n2013-11-01,1,2,1,,-0.5,x,\n", "Negative value in callin at row 2"),
    "time_before_number.csv": (HEADER + "\nnope,1,2,-1,,,,\n", "Invalid datetime at row 2"),
    "quoted.csv": (HEADER + '\n"2013-11-01 00:00:00","1","39","1.5","","0","2","3"\n', "Validation passed"),
    "quoted_comma.csv": (HEADER + '\n2013-11-01,1,"a,b",1,,,,\n', "Validation passed"),
    "second_header.csv": (HEADER + "\n" + GOOD + "\n" + HEADER + "\n", "Invalid datetime at row 3"),
    "late_error.csv": (HEADER + "\n" + (GOOD + "\n") * 300 + "x\n" + "y,\n", "Incorrect number of columns at row 302"),
    "late_header.csv": (HEADER + "\n" + (GOOD + "\n") * 250 + HEADER + "\n", "Invalid datetime at row 252"),
}


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    for name, (text, _) in CASES.items():
        (folder / name).write_text(text)
    return str(folder)


@pytest.mark.parametrize("split_bytes", [None, 1000])
def test_first_violation_per_file(spark, landing, split_bytes):
    """The small split size cuts the longer files into many splits."""
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        lines = files.read_lines(spark, landing)
        if split_bytes:
            assert lines.select("file", "block").distinct().count() > len(CASES) + 10
        verdicts = files.validate_files(lines, files.list_files(spark, landing))
        got = {r["file"]: (r["ok"], r["reason"]) for r in verdicts.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert got == {name: (reason == "Validation passed", reason) for name, (_, reason) in CASES.items()}


def test_listed_paths_can_be_read(spark, landing):
    paths = [r["path"] for r in files.list_files(spark, landing).collect()]
    assert len(paths) == len(CASES)
    names = {r["file"] for r in files.read_lines(spark, paths).select("file").distinct().collect()}
    assert names == set(CASES) - {"empty.csv"}
    assert activity.read_raw_files(spark, [p for p in paths if "plus" in p]).count() == 1


def test_skip_and_route(spark, landing):
    listed = files.list_files(spark, landing)
    verdicts = files.validate_files(files.read_lines(spark, landing), listed)
    none = spark.createDataFrame([], "file string, status string, reason string")
    audit = files.audit_rows(verdicts.where(F.col("file").isin("good.csv", "short.csv")), none)
    skipped = {r["file"]: r["reason"] for r in files.skipped_files(listed, audit).collect()}
    assert skipped == {"good.csv": files.IN_RAW, "short.csv": files.IN_REJECTED}
    assert files.new_files(listed, audit).count() == len(CASES) - 2
    lines = files.read_lines(spark, landing)
    accepted = files.route_lines(lines, verdicts, ok=True).select("file").distinct().count()
    rejected = files.route_lines(lines, verdicts, ok=False).select("file").distinct().count()
    assert accepted == sum(reason == "Validation passed" for _, reason in CASES.values())
    assert accepted + rejected == len(CASES) - 1  # the empty file has no lines


def test_read_raw(spark, tmp_path):
    (tmp_path / "sms-call-internet-mi-2013-11-01.csv").write_text(f"{HEADER}\n{GOOD}\n2013-11-01,x,1,y,,,,\n")
    (tmp_path / "sms-call-internet-tn-2013-11-01.csv").write_text(f"{HEADER}\n{GOOD}\n")
    rows = activity.with_source_file(activity.read_raw(spark, str(tmp_path)))
    assert {r["source_file"] for r in rows.collect()} == {"sms-call-internet-mi-2013-11-01.csv"}
    assert rows.where("CellID IS NULL AND smsin IS NULL").count() == 1
    os.makedirs(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        activity.read_raw(spark, str(tmp_path / "none"))
