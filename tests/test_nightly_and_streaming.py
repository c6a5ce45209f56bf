import json

import pytest
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators import aggregate, clean, features
from gridlens.plans import catalog, fixtures, incremental, nightly
from gridlens.streaming import live

HEADER = ",".join(S.RAW_COLUMNS)


def name(day):
    return f"sms-call-internet-mi-2013-11-{day:02d}.csv"


def day_file(folder, day, cells=3, spoil=""):
    lines = [HEADER]
    for hour in range(24):
        for cell in range(1, cells + 1):
            for country in (0, 39):
                value = (cell * 7 + hour * 3 + day * 5 + country) % 17 * (4 if hour == 18 else 1)
                lines.append(f"2013-11-{day:02d} {hour:02d}:00:00,{cell},{country},{value},,1.25,0.5,{value * 2}")
    folder.mkdir(exist_ok=True)
    (folder / name(day)).write_text("\n".join(lines + ([spoil] if spoil else [])) + "\n")


def grid_file(path, cells):
    features = []
    for cell in range(1, cells + 1):
        ring = [[cell, 0], [cell + 1, 0], [cell + 1, 1], [cell, 1], [cell, 0]]
        features.append(
            {"type": "Feature", "id": cell - 1, "properties": {"cellId": cell}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
        )
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    return str(path)


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    folder = tmp_path_factory.mktemp("nightly")
    for day in range(1, 8):
        day_file(folder / "landing", day)
    day_file(folder / "landing", 8, spoil="2013-11-08 00:00:00,1,39,-1,,,,")
    return folder


def test_ingest_twice(spark, landing, tmp_path):
    zones = str(tmp_path / "zones")
    source = str(landing / "landing")
    first = {r["filename"]: (r["status"], r["reason"]) for r in nightly.ingest(spark, source, zones).collect()}
    assert first == {name(d): ("ACCEPTED", "Validation passed") for d in range(1, 8)} | {
        name(8): ("REJECTED", "Negative value in smsin at row 146")
    }
    second = {r["filename"]: r["status"] for r in nightly.ingest(spark, source, zones).collect()}
    assert set(second.values()) == {"SKIPPED"} and len(second) == 8
    raw = spark.read.parquet(f"{zones}/raw")
    assert raw.count() == 7 * 24 * 3 * 2
    assert spark.read.parquet(f"{zones}/rejected").count() == 146
    assert spark.read.parquet(f"{zones}/audit").count() == 16


def test_run_rerun_and_failure(spark, landing, tmp_path):
    raw = spark.read.schema(S.RAW_SCHEMA).option("header", True).csv([str(landing / "landing" / name(d)) for d in range(1, 8)])
    out = str(tmp_path / "out")
    grid = grid_file(tmp_path / "grid.geojson", 3)
    first = nightly.run_nightly(spark, raw, out, grid, threshold=60.0, run_id="first", decimals=2)
    assert set(first.states.values()) == {"success"}
    assert first.counts == {"rows_in": 1008, "rows_rejected": 0, "nulls_handled": 1008, "rows_published": 504}
    tables = ["hourly_grid_summary", "network_alerts", "anomaly_scores", "network_feature_table", "network_risk_scores", "dim_grid"]
    sizes = {t: nightly.current_table(spark, out, t).count() for t in tables}
    assert sizes["hourly_grid_summary"] == sizes["anomaly_scores"] == 504
    assert sizes["network_feature_table"] == sizes["network_risk_scores"] == 504 - 3 * 5 and sizes["dim_grid"] == 3
    assert sizes["network_alerts"] > 0

    nightly.run_nightly(spark, raw, out, grid, threshold=60.0, run_id="second", decimals=2)
    for table in tables[:4]:
        one, two = (spark.read.parquet(f"{out}/runs/{r}/{table}") for r in ("first", "second"))
        assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0

    with pytest.raises(ValueError, match="cover"):
        nightly.run_nightly(spark, raw, out, grid_file(tmp_path / "few.geojson", 2), run_id="third")
    log = {r["run_id"]: r for r in nightly.run_status(spark, out).collect()}
    assert [log[r]["overall_status"] for r in ("first", "second", "third")] == ["SUCCESS", "SUCCESS", "FAILED"]
    assert log["third"]["task_status"]["geometry"] == "failed" and "cover" in log["third"]["reason"]
    assert log["second"]["as_of_reason"] == "2013-11-07 23:00:00"
    assert nightly.current_table(spark, out, "dim_grid").count() == 3


def test_one_class_skips_the_model(spark, landing, tmp_path):
    raw = spark.read.schema(S.RAW_SCHEMA).option("header", True).csv(str(landing / "landing" / name(1)))
    run = nightly.run_nightly(spark, raw, str(tmp_path / "out"), threshold=1e9)
    assert run.states["risk"] == "skipped" and run.states["geometry"] == "skipped"


def test_no_input(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        nightly.ingest(spark, str(tmp_path / "empty"), str(tmp_path / "zones"))
    assert nightly.main(["--input-dir", str(tmp_path / "empty"), "--output-dir", str(tmp_path / "out")]) == 1
    with pytest.raises(LookupError):
        nightly.current_table(spark, str(tmp_path / "out"), "dim_time")


def test_main(spark, landing, tmp_path):
    args = ["--input-dir", str(landing / "landing"), "--output-dir", str(tmp_path / "out"), "--threshold", "60"]
    assert nightly.main(args) == 0
    assert nightly.current_table(spark, str(tmp_path / "out"), "hourly_grid_summary").count() == 504
    assert nightly.main([*args, "--grid-path", grid_file(tmp_path / "few.geojson", 1)]) == 2


def test_stream_equals_batch_on_closed_hours(spark, sf_dir):
    data = catalog.dataset(spark, sf_dir)
    got = catalog.queries()["stream_hourly_grid"](spark, sf_dir)
    events = fixtures.table(spark, sf_dir, "events")
    good = events.where("event_id % 101 <> 11 AND event_id % 89 <> 7 AND event_id % 97 <> 5").count()
    assert data.clean.count() == good and got.count() > 0


def test_incremental_file_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    sizes = []
    for day in (1, 2):
        day_file(folder, day)
        live.write_available(live.read_raw_stream(spark, str(folder)), out, checkpoint)
        sizes.append(spark.read.parquet(out).count())
    live.write_available(live.read_raw_stream(spark, str(folder)), out, checkpoint)
    assert [*sizes, spark.read.parquet(out).count()] == [144, 288, 288]


def test_live_scores_against_frozen_days(spark, tmp_path):
    folder = tmp_path / "in"
    for day in (1, 2, 3):
        day_file(folder, day)
    stream = live.live_hourly_grid(live.read_raw_stream(spark, str(folder)))
    past = spark.read.schema(S.RAW_SCHEMA).option("header", True).csv(str(folder / name(1)))
    baseline = live.frozen_baseline(aggregate.hourly_grid_summary(clean.clean_activity(clean.to_canonical(past))))
    paths = [str(tmp_path / p) for p in ("scores", "alerts", "checkpoint")]
    live.score_available(stream, baseline, *paths)
    scores = spark.read.parquet(paths[0])
    assert scores.count() == 3 * (72 - 3)  # the watermark, 21:00, has not passed the end of the last three hours
    day_one = scores.where(F.to_date("timestamp") == "2013-11-01")
    assert day_one.where("anomaly_score <> 0").count() == 0 and day_one.where("baseline_activity IS NULL").count() == 0
    assert spark.read.parquet(paths[1]).where("alert_type IS NULL").count() == 0


def hours_frame(spark, rows):
    shown = [(c, t, t[:10], float(v)) for c, t, v in rows]
    df = spark.createDataFrame(shown, "grid_id int, t string, d string, total_activity double")
    return df.select("grid_id", F.col("t").cast("timestamp").alias("timestamp"), F.col("d").cast("date").alias("date"), "total_activity")


def test_live_rules_compare_with_the_row_before(spark):
    baseline = spark.createDataFrame([(1, h, 10.0) for h in range(24)], "grid_id int, hour int, baseline_activity double")
    floors = live.frozen_floors(hours_frame(spark, [(1, "2024-01-01 00:00:00", 5), (1, "2024-01-01 01:00:00", 5)]))
    earlier = hours_frame(spark, [(1, "2024-01-02 04:00:00", 6)]).select("grid_id", "timestamp", "date", "total_activity")
    hours = hours_frame(spark, [(1, "2024-01-02 06:00:00", 13), (1, "2024-01-02 07:00:00", 30), (1, "2024-01-02 08:00:00", 2), (2, "2024-01-02 06:00:00", 99)])
    got = sorted((str(r["timestamp"])[11:13], r["alert_type"], r["compared_activity"]) for r in live.live_alerts(hours, earlier, baseline, floors).collect())
    assert got == [
        ("06", "ACTIVITY_SPIKE", 6.0), ("07", "ACTIVITY_SPIKE", 13.0), ("07", "HIGH_ACTIVITY", 10.0), ("08", "ACTIVITY_DROP", 10.0),
    ]
    next_day = hours_frame(spark, [(1, "2024-01-03 00:00:00", 99)])
    assert live.live_alerts(next_day, earlier, baseline, floors).count() == 0  # no floor for that day


def test_alerts_do_not_depend_on_the_batches(spark, tmp_path):
    past = None
    results = []
    for way, days in (("at once", [(1, 2, 3)]), ("day by day", [(1,), (2,), (3,)])):
        folder, out = tmp_path / way / "in", str(tmp_path / way / "out")
        folder.mkdir(parents=True)
        for batch in days:
            for day in batch:
                day_file(folder, day)
            if past is None:
                raw = spark.read.schema(S.RAW_SCHEMA).option("header", True).csv(str(folder / "*.csv"))
                hourly = aggregate.hourly_grid_summary(clean.clean_activity(clean.to_canonical(raw)))
                past = live.frozen_baseline(hourly).cache(), live.frozen_floors(hourly).cache()
            stream = live.live_hourly_grid(live.read_raw_stream(spark, str(folder)))
            live.alert_available(stream, *past, out, f"{out}/checkpoint")
        live.close_alerts(clean.clean_activity(clean.to_canonical(raw)), *past, out, stream.schema)
        alerts = spark.read.parquet(f"{out}/alerts").drop("batch")
        results.append(sorted(map(tuple, alerts.collect())))
    assert results[0] == results[1] and "ACTIVITY_SPIKE" in {r[2] for r in results[0]}


def test_a_repeated_batch_upserts_nothing_twice(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    day_file(folder, 1)
    stream = lambda: live.read_raw_stream(spark, str(folder))
    live.upsert_available(stream(), out, f"{out}/checkpoint")
    first = spark.read.parquet(f"{out}/hourly").agg(F.sum("total_activity"), F.count("*")).first()
    live.upsert_available(stream(), out, f"{out}/another checkpoint")  # the same rows as batch 0 again
    assert spark.read.parquet(f"{out}/hourly").agg(F.sum("total_activity"), F.count("*")).first() == first
    (tmp_path / "none").mkdir()
    live.upsert_available(live.read_raw_stream(spark, str(tmp_path / "none")), str(tmp_path / "nothing"), str(tmp_path / "checkpoint"))


def test_incremental_job(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    args = ["--input-dir", str(folder), "--output-dir", out, "--threshold", "60", "--incremental"]
    for days in ((1, 2, 4), (3,), ()):
        folder.mkdir(exist_ok=True)
        for day in days:
            day_file(folder, day)
        assert nightly.main(args) == 0
    store = incremental.Store(spark, f"{out}/store")
    assert [len(r["days"]) for r in store.commits().orderBy("number").collect()] == [3, 1]
    assert store.table("hourly").count() == 4 * 72
    raw = spark.read.schema(S.RAW_SCHEMA).option("header", True).csv(str(folder / "*.csv"))
    hourly = aggregate.hourly_grid_summary(clean.clean_activity(clean.to_canonical(raw)))
    whole, grown = features.network_features(hourly), store.table("features").drop("date")
    assert whole.exceptAll(grown.select(*whole.columns)).count() == 0 and grown.count() == whole.count()


def test_an_upserted_hour_has_one_file_for_each_batch(spark, tmp_path):
    """However many tasks a batch and its sums have."""
    folder, out = tmp_path / "in", tmp_path / "out"
    for day in (1, 2):
        day_file(folder, day)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        live.upsert_available(live.read_raw_stream(spark, str(folder)), str(out), f"{out}/checkpoint")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for table in ("rows", "hourly"):
        hours = [p.parent for p in (out / table).rglob("*.parquet")]
        assert len(hours) == len(set(hours)) == 48
