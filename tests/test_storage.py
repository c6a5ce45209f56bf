"""Zones, documents read in splits, merged sketches and the gate on a stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.plans.catalog import dataset
from gridlens.sources import geo, zones
from gridlens.streaming import landing
from tests.plan_metrics import executed, scanned
from tests.test_nightly_and_streaming import day_file, name


@pytest.fixture(scope="module")
def d(spark, sf_dir):
    return dataset(spark, sf_dir, "lineitem")


def test_both_keys_open_few_files(d, spark, tmp_path):
    path = str(tmp_path / "zones")
    zones.write_zones(d.hourly, path, bits=3)
    everything = zones.read_zones(spark, path)
    assert everything.count() == d.hourly.count()
    files = scanned(executed(everything), "total_activity")["numFiles"]
    some = d.hourly.orderBy("total_activity").first()
    for wanted in ({"grid_id": some["grid_id"]}, {"timestamp": some["timestamp"]}, {"grid_id": some["grid_id"], "timestamp": some["timestamp"]}):
        found = zones.read_zones(spark, path, **wanted)
        assert scanned(executed(found), "total_activity")["numFiles"] <= files * (1 / 8 if len(wanted) == 1 else 1 / 32) + 1
        plain = d.hourly
        for column, value in wanted.items():
            plain = plain.where(F.col(column) == F.lit(value))
        assert found.count() == plain.count() > 0
    first, last = (d.hourly.agg(f).first()[0] for f in (F.percentile_approx("grid_id", 0.4), F.percentile_approx("grid_id", 0.6)))
    part = zones.read_zones(spark, path, grid_id=(first, last))
    assert part.count() == d.hourly.where(F.col("grid_id").between(first, last)).count()
    assert scanned(executed(part), "total_activity")["numFiles"] <= files / 2
    with pytest.raises(ValueError, match="hour"):
        zones.read_zones(spark, path, hour=3)


def test_zones_of_odd_tables(spark, tmp_path):
    rows = [(None, None, 1.0), (5, None, 2.0), (5, "2024-01-01 00:00:00", 3.0)] + [(5, "2024-01-01 01:00:00", 4.0)] * 50
    df = spark.createDataFrame(rows, "grid_id int, t string, v double").select("grid_id", F.col("t").cast("timestamp").alias("timestamp"), "v")
    zones.write_zones(df, str(tmp_path / "odd"), bits=2)
    assert zones.read_zones(spark, str(tmp_path / "odd")).count() == 53
    assert zones.read_zones(spark, str(tmp_path / "odd"), grid_id=5).count() == 52
    assert zones.read_zones(spark, str(tmp_path / "odd"), grid_id=6).count() == 0
    zones.write_zones(df.limit(0), str(tmp_path / "none"))


def test_bits_in_turn():
    assert zones.zones_of(range(1, 2), range(2), 2) == [1, 3]
    assert sorted(z for a in range(4) for b in range(4) for z in zones.zones_of(range(a, a + 1), range(b, b + 1), 2)) == list(range(16))


def collection(rng, cells, **more):
    words = ['}', '{', '"', "\\", '\\"', "type", "é", " ", ":", "[{", "}]"]
    features = []
    for cell in range(1, cells + 1):
        note = "".join(rng.choice(words) for _ in range(rng.randrange(12)))
        ring = [[cell, 0], [cell + 1, 0], [cell + 1, 1], [cell, 1], [cell, 0]]
        geometry = {"type": "Polygon", "coordinates": [ring]}
        feature = {"type": "Feature", "id": cell - 1, "properties": {"note": note, "cellId": cell, "deep": {"a": {"b": note}}}, "geometry": geometry}
        features.append(dict(rng.sample(list(feature.items()), 4)))
    return {"type": "FeatureCollection", "name": "a}{b", "crs": {"type": "name", "properties": {"name": "x"}}, "features": features} | more


@pytest.mark.parametrize("indent", [None, 2])
def test_a_document_in_many_splits(spark, tmp_path, indent):
    rng = random.Random(1)
    whole = collection(rng, 700, extra={"x": {"y": "}"}})
    (tmp_path / "grid.geojson").write_text(json.dumps(whole, indent=indent, ensure_ascii=False) + "\n")
    (tmp_path / "small.geojson").write_text(json.dumps(collection(rng, 3)))
    (tmp_path / "no.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        read = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert read.rdd.getNumPartitions() > 8
        got = sorted((r["grid_id"], json.loads(r["geometry"])["coordinates"][0][0]) for r in geo.read_split_features(spark, str(tmp_path)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((c, [c, 0]) for n in (700, 3) for c in range(1, n + 1))


def test_another_top_level_type_is_an_error(spark, tmp_path):
    whole = collection(random.Random(2), 2) | {"type": "Something"}
    (tmp_path / "x.geojson").write_text(json.dumps(whole))
    with pytest.raises(Exception, match="top-level"):
        geo.read_split_features(spark, str(tmp_path)).collect()


def test_gate_on_a_stream(spark, tmp_path):
    folder, zones_dir = tmp_path / "in", str(tmp_path / "zones")
    day_file(folder, 1)
    day_file(folder, 2, spoil="2013-11-02 00:00:00,1,39,-1,,,,")
    (folder / name(3)).write_text("")
    read = lambda: sorted((r["filename"], r["status"], r["reason"]) for r in landing.ingest_available(spark, str(folder), zones_dir).collect())
    first = [
        (name(1), "ACCEPTED", "Validation passed"),
        (name(2), "REJECTED", "Negative value in smsin at row 146"),
        (name(3), "REJECTED", "Empty file"),
    ]
    assert read() == first == read()
    later = tmp_path / "in" / "later"
    day_file(later, 1)
    day_file(later, 4)
    second = read()
    assert second == sorted([*first, (name(1), "SKIPPED", "File already exists in raw"), (name(4), "ACCEPTED", "Validation passed")])
    raw = spark.read.parquet(f"{zones_dir}/raw")
    assert raw.count() == 2 * 24 * 3 * 2 and set(raw.columns) == {*S.RAW_COLUMNS, "source_file"}
    assert spark.read.parquet(f"{zones_dir}/rejected").count() == 146
    # a repeated batch stores nothing twice
    lines = spark.createDataFrame([(name(9), 0, ",".join(S.RAW_COLUMNS)), (name(9), 0, "2013-11-09 00:00:00,1,39,1,,,,")], "file string, block long, line string")
    for _ in range(2):
        landing.take_lines(lines.coalesce(1), 7, zones_dir)
    assert spark.read.parquet(f"{zones_dir}/raw").count() == raw.count() + 1
    assert landing.audit_log(spark, zones_dir).where(F.col("filename") == name(9)).count() == 1
    with pytest.raises(FileNotFoundError):
        landing.ingest_available(spark, str(tmp_path / "none"), str(tmp_path / "other"))


def test_gate_in_folders_of_the_batch(spark, tmp_path):
    """Many small files make one folder for their batch, not one for each; a repeated batch stores nothing twice."""
    rows = [(name(day), 0, line) for day in range(1, 21) for line in (",".join(S.RAW_COLUMNS), f"2013-11-{day:02d} 00:00:00,1,39,{-1 if day == 9 else 1},,,,")]
    lines = spark.createDataFrame(rows, "file string, block long, line string").repartition(3, "file")
    for _ in range(2):
        landing.take_lines(lines.sortWithinPartitions("file"), 0, str(tmp_path), by_batch=True)
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert raw.count() == raw.select("source_file").distinct().count() == 19
    assert [r["file"] for r in spark.read.parquet(str(tmp_path / "rejected")).select("file").distinct().collect()] == [name(9)]
    assert [p.name for p in (tmp_path / "raw").glob("*/*=*")] == ["batch=0"]
