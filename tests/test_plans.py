"""What the planned queries read and shuffle."""

import re

import pytest

from gridlens.operators import anomaly, features, report, risk, service, warehouse, windows
from gridlens.plans.catalog import dataset
from gridlens.session import stage
from gridlens.sources import tables
from tests.plan_metrics import executed, names, scanned


@pytest.fixture(scope="module")
def d(spark, sf_dir):
    return dataset(spark, sf_dir)


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def scans(df):
    """For each scan its pushed filters and its columns."""
    text = plan(df)
    return list(zip(re.findall(r"PushedFilters: (.*)", text), re.findall(r"ReadSchema: (.*)", text), strict=False))


def test_hotspots_filter_the_fact_by_its_key(d):
    hot = service.network_hotspots(d.fact, d.dim_time, d.risk, d.alerts)
    facts = [pushed for pushed, columns in scans(hot) if "time_key" in columns]
    assert facts and all("EqualTo(time_key" in pushed for pushed in facts)
    summary = service.latest_network_summary(d.fact, d.dim_time)
    assert all("EqualTo(time_key" in pushed for pushed, columns in scans(summary) if "total_activity" in columns)


def test_a_request_reads_its_hours_only(d):
    request = d.hourly.orderBy("timestamp", "grid_id").limit(1).select("grid_id", "timestamp", "total_activity").cache()
    answer = service.predict_risk(request, d.features, d.hourly, d.scores, d.example_model)
    tables = [pushed for pushed, columns in scans(answer) if "grid_id" in columns and "timestamp" in columns]
    assert len(tables) >= 3
    bounded = [p for p in tables if "GreaterThanOrEqual" in p and "LessThan" in p]
    assert len(bounded) >= 3 and answer.count() == 1


def test_training_set_is_one_pass(d):
    text = plan(features.training_set(d.hourly), "simple")
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_report_ranks_without_texts(d):
    read = re.findall(r"ReadSchema: (.*)", plan(report.attention_report(d.risk, d.scores)))
    assert any("anomaly_score" in c and "reason" not in c for c in read)
    assert not any("anomaly_score" in c and "reason" in c for c in read)


def test_a_day_opens_its_own_folder_only(d, spark, sf_dir):
    days = d.dim_time.select("date").distinct().count()
    everything = scanned(executed(service.network_summary(d.star_by_day)), "total_activity")
    assert everything["numPartitions"] == days > 20
    day = d.dim_time.agg({"date": "max"}).first()[0]
    one = service.grid_activity(d.star_by_day, d.lookup, date=str(day))
    found = scanned(executed(one), "total_activity")
    assert found["numPartitions"] == 1 and found["numFiles"] <= everything["numFiles"] / days * 3


def test_a_filter_on_the_dimension_limits_the_days_at_run_time(d):
    days = d.dim_time.select("date").distinct().count()
    as_of = d.dim_time.agg({"timestamp": "max"}).first()[0]
    at_time = service.grid_activity(d.star_by_day, d.lookup, as_of=as_of)
    assert "dynamicpruning" in plan(at_time)
    assert scanned(executed(at_time), "total_activity")["numPartitions"] == 1
    sundays = service.network_summary(d.star_by_day.where("day_of_week = 'Sunday'"))
    assert "dynamicpruning" in plan(sundays)
    assert scanned(executed(sundays), "total_activity")["numPartitions"] <= days / 7 + 1


def test_a_day_is_replaced_alone(d, spark, tmp_path):
    path = str(tmp_path / "fact")
    tables.write_by_day(warehouse.with_day(d.fact), path, ["time_key", "grid_id"])
    before = {r["date"]: r["n"] for r in tables.read_table(spark, path).groupBy("date").agg({"*": "count"}).toDF("date", "n").collect()}
    day = max(before)
    part = stage(tables.read_table(spark, path).where(f"date = '{day}'").limit(1), "one-row")
    tables.write_by_day(part, path, ["time_key", "grid_id"])
    after = {r["date"]: r["n"] for r in tables.read_table(spark, path).groupBy("date").agg({"*": "count"}).toDF("date", "n").collect()}
    assert after == before | {day: 1}


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tables_in_buckets_need_no_shuffle(d, no_broadcast):
    hourly, split, scores, alerts, scored = (d.bucketed(n) for n in ("hourly", "split", "scores", "alerts", "risk"))
    work = {
        "features": features.network_features(hourly),
        "training set": features.training_set(hourly),
        "anomaly scores": anomaly.anomaly_scores(hourly),
        "last hours": windows.last_hours(hourly),
        "rules": risk.compare_with_rules(risk.predict(split, d.example_model), alerts),
        "three-way": risk.three_way(split, scores, alerts),
        "report": report.risk_with_anomaly(scored, scores),
    }
    for name, df in work.items():
        found = names(executed(df))
        assert not [n for n in found if "Exchange" in n], name
    plain = names(executed(risk.three_way(d.split, d.scores, d.alerts)))
    assert sum("ShuffleExchange" in n for n in plain) >= 3


def test_a_bucketed_table_opens_in_another_session(d, spark, tmp_path, no_broadcast):
    path = str(tmp_path / "hourly")
    tables.write_bucketed(d.hourly, path, 4, ["grid_id", "timestamp"])
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "UTC")
    spark.sql(f"DROP TABLE {tables.bucketed_name(path)}")
    again = tables.open_bucketed(other, path, 4, ["grid_id", "timestamp"])
    assert again.count() == d.hourly.count()
    grouped = executed(again.groupBy("grid_id").count())
    assert not [n for n in names(grouped) if "Exchange" in n]
