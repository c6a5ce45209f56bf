"""Records over line breaks against a sequential CSV reader, for any cut into splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.session import stage
from gridlens.sources import files, records

HEADER = ",".join(S.RAW_COLUMNS)


def lines_of(spark, texts, per_block):
    rows = []
    for name, text in texts.items():
        for i, line in enumerate(text.split("\n")[:-1] if text.endswith("\n") else text.split("\n")):
            rows.append((name, i // per_block, i, line))
    return spark.createDataFrame(rows, "file string, block long, position long, line string").repartition(3)


def sequential(text):
    """Record texts by the reader of the standard library."""
    taken, source = [], iter(text.splitlines(keepends=True))
    used = []

    def feed():
        for line in source:
            used.append(line)
            yield line

    for _ in csv.reader(feed()):
        taken.append("".join(used).removesuffix("\n"))
        used.clear()
    return taken


def random_text(rng, records_):
    pieces = ['"', '""', ",", "a", "b c", '\n', '"x"', '"y\nz"', '"""', ',"']
    text = "".join(rng.choice(pieces) for _ in range(records_ * 6))
    return text.lstrip("\n") + "\n"


@pytest.mark.parametrize("per_block", [1, 2, 7, 1000])
def test_any_text_in_any_splits(spark, per_block):
    rng = random.Random(per_block)
    texts = {f"f{i}": random_text(rng, 12) for i in range(40)} | {"plain": "a,b\nc,d\n", "open": 'a,"b\nc\nd\n', "swap": '"\n"\n"\n",x\n'}
    got = records.whole_records(lines_of(spark, texts, per_block)).orderBy("file", "block", "position").collect()
    for name, text in texts.items():
        assert [r["line"] for r in got if r["file"] == name] == sequential(text), (name, text)


def row(hour, value):
    return f"2013-11-01 {hour:02d}:00:00,1,39,{value},,1.25,0.5,2"


@pytest.mark.parametrize("per_block", [1, 2, 3, 1000])
def test_verdicts_and_rows(spark, per_block):
    texts = {
        "fine.csv": "\n".join([HEADER, row(0, '"1.5\n"'), row(1, 2), row(2, '"\n\n3"')]) + "\n",
        "negative.csv": "\n".join([HEADER, row(0, '"1\n"'), row(1, '"-2\n"')]) + "\n",
        "wide.csv": "\n".join([HEADER, row(0, '"1\n"'), row(1, 2), row(2, 3) + ',"\n"']) + "\n",
        "swallowed.csv": "\n".join([HEADER, row(0, 1), row(1, '"2'), row(2, 3), row(3, 4)]) + "\n",
        "text.csv": "\n".join([HEADER, row(0, '"1,\n2"')]) + "\n",
        "plain.csv": "\n".join([HEADER, row(0, '"7"')]) + "\n",
    }
    lines = lines_of(spark, texts, per_block)
    judged = files.judge_files(lines).cache()
    verdicts = {r["file"]: (r["ok"], r["reason"]) for r in judged.collect()}
    assert verdicts == {
        "fine.csv": (True, "Validation passed"),
        "plain.csv": (True, "Validation passed"),
        "negative.csv": (False, "Negative value in smsin at row 3"),
        "wide.csv": (False, "Incorrect number of columns at row 4"),
        "swallowed.csv": (False, "Incorrect number of columns at row 3"),
        "text.csv": (False, "Non-numeric value in smsin at row 2"),
    }
    rows = files.accepted_rows(lines, judged)
    assert rows.columns == [*S.RAW_COLUMNS, "source_file"]
    got = sorted((r["source_file"], r["datetime"], r["CellID"], r["smsin"], r["smsout"], r["internet"]) for r in rows.collect())
    times = [f"2013-11-01 {h:02d}:00:00" for h in range(3)]
    assert got == [("fine.csv", t, 1, v, None, 2.0) for t, v in zip(times, (1.5, 2.0, 3.0), strict=True)] + [("plain.csv", times[0], 1, 7.0, None, 2.0)]


def test_files_on_disk(spark, tmp_path):
    text = "\n".join([HEADER, *(row(i % 24, f'"{i}\n"') for i in range(4000))]) + "\n"
    (tmp_path / "a.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.read_lines(spark, str(tmp_path))
        assert lines.select("block").distinct().count() > 5
        judged = files.judge_files(lines).cache()
        assert [tuple(r) for r in judged.collect()] == [("a.csv", True, "Validation passed", True)]
        rows = files.accepted_rows(lines, judged)
        assert rows.count() == 4000 == rows.select("smsin").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_very_long_line_with_many_quotes(spark):
    line = ",".join(['"a""b"'] * 50_000)
    df = spark.createDataFrame([(line,), (line + ',"',)], "line string")
    assert sorted(r[0] for r in df.select(records.opens_record(F.col("line"))).collect()) == [False, True]


def test_fields_and_open_quotes_as_read_character_by_character(spark):
    """Random lines, stray quotes and odd numbers of them included: fields part at commas with an even number of quotes behind them."""
    rng = random.Random(5)
    texts = ["".join(rng.choice(['"', '"', '""', ",", ",", "a", " ", "\n"]) for _ in range(rng.randrange(14))) for _ in range(3000)]

    def parted(text):
        fields = [""]
        for i, c in enumerate(text):
            if c == "," and text[i:].count('"') % 2 == 0:
                fields.append("")
            else:
                fields[-1] += c
        return fields

    def opened(text, inside):
        state = "inside" if inside else "start"
        for c in text:
            if state in ("inside", "quote") and c == '"':
                state = "quote" if state == "inside" else "inside"
            elif state != "inside":
                state = "inside" if state == "start" and c == '"' else "start" if c == "," else "plain"
        return state == "inside"

    df = spark.createDataFrame([(t,) for t in texts], "line string")
    split = F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    ends = [records._ends_inside(F.col("line"), inside) for inside in (False, True)]
    for text, fields, parts, *after in df.select("line", files.split_line(F.col("line")), split, *ends).collect():
        assert len(fields) == len(parted(text)), text
        for field, part in zip(fields, parted(text), strict=True):
            bare = part.strip()
            assert field == (bare[1:-1] if len(bare) > 1 and bare[0] == bare[-1] == '"' else part).replace('""', '"'), text
        assert after == [opened(text, False), opened(text, True)], text


def test_records_of_judged_files_are_gathered_once(spark):
    """The rows of accepted files come from the records that were judged: no window over their lines is left in the plan."""
    lines = lines_of(spark, {"a.csv": "\n".join([HEADER, row(0, '"1.5\n"'), row(1, '"2\n"')]) + "\n"}, 2)
    verdicts, gathered = files.judge_and_gather(lines)
    verdicts = stage(verdicts, "judged")
    rows = files.accepted_rows(lines, verdicts, gathered)
    assert sorted(r["smsin"] for r in rows.collect()) == [1.5, 2.0]
    assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()
    again = files.accepted_rows(lines, verdicts)
    assert sorted(r["smsin"] for r in again.collect()) == [1.5, 2.0]
