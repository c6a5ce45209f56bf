from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators import risk, service

NOW = datetime(2013, 11, 1, 12)
RISK = "grid_id int, timestamp timestamp, risk_score double, risk_level string, model_version string"
ALERT = (
    "grid_id int, timestamp timestamp, alert_type string, current_activity double, baseline_activity double, reason string"
)


@pytest.fixture(scope="module")
def tables(spark):
    activity = spark.createDataFrame(
        [(g, NOW - timedelta(hours=h), float(100 - g * (1 + h))) for g in range(1, 7) for h in range(30)],
        "grid_id int, timestamp timestamp, total_activity double",
    )
    for name in S.MEASURES:
        activity = activity.withColumn(name, F.lit(1.0))
    activity = activity.withColumns({"date": F.to_date("timestamp"), "hour": F.hour("timestamp")})
    scores = spark.createDataFrame([(1, NOW, 0.9, "HIGH", "v"), (2, NOW - timedelta(hours=1), 0.1, "LOW", "v")], RISK)
    fired = [
        (1, NOW, "HIGH_ACTIVITY"),
        (1, NOW, "ACTIVITY_SPIKE"),
        (3, NOW, "ACTIVITY_DROP"),
        (2, NOW - timedelta(hours=1), "HIGH_ACTIVITY"),
        (6, NOW + timedelta(hours=1), "HIGH_ACTIVITY"),
    ]
    alerts = spark.createDataFrame([(g, t, k, 9.0, 1.0, f"{k} text") for g, t, k in fired], ALERT)
    return activity.cache(), scores, alerts


@pytest.fixture(scope="module")
def star(tables):
    """The same activity as a fact table and its times, with the other two tables."""
    fact = tables[0].withColumn("time_key", F.unix_timestamp("timestamp"))
    return fact.drop("timestamp", "date", "hour"), fact.select("time_key", "timestamp").distinct(), *tables[1:]


def test_hotspots(star):
    rows = service.network_hotspots(*star, limit=4, as_of=NOW).orderBy(F.desc("total_activity")).collect()
    assert [r["grid_id"] for r in rows] == [1, 2, 3, 4]
    assert [r["status"] for r in rows] == ["MEDIUM", "NORMAL", "LOW", "NORMAL"]
    assert rows[0]["reason"] == "ACTIVITY_SPIKE text" and rows[1]["reason"] == S.DEFAULT_HOTSPOT_REASON
    assert rows[0]["risk_score"] == 0.9 and rows[1]["risk_score"] is None


def test_hotspot_severity_filters_after_the_limit_unless_asked(star):
    assert service.network_hotspots(*star, limit=2, severity="low").count() == 0
    assert [r["grid_id"] for r in service.network_hotspots(*star, limit=2, severity="low", filter_first=True).collect()] == [3]
    assert [r["grid_id"] for r in service.network_hotspots(*star, limit=3, severity="low").collect()] == [3]


def test_alert_feed(tables):
    activity, scores, alerts = tables
    rows = service.alert_feed(alerts, scores, activity).orderBy(*service.feed_order()).collect()
    assert [(r["grid_id"], r["severity"]) for r in rows] == [(1, "HIGH"), (1, "MEDIUM"), (3, "LOW"), (2, "HIGH")]
    assert rows[0]["risk_level"] == "HIGH" and rows[2]["risk_level"] is None
    assert service.alert_feed(alerts, scores, activity, severity="medium").count() == 1
    assert service.alert_feed(alerts, scores, activity, as_of=NOW + timedelta(hours=1)).count() == 5
    assert service.alert_feed(alerts, scores, activity, limit=2).count() == 2


def test_grid_activity(spark, tables):
    activity = tables[0]
    one = spark.createDataFrame([(2,)], "grid_id int")
    assert service.grid_activity(activity, one).count() == 24
    assert service.grid_activity(activity, one, hour=12).count() == 2
    assert service.grid_activity(activity, one, date="2013-10-31").count() == 17
    assert service.grid_activity(activity, one, as_of=NOW).first()["total_activity"] == 98.0
    unknown = spark.createDataFrame([(0,), (10_001,), (99,)], "grid_id int")
    assert service.grid_activity(activity, unknown).count() == 0
    service.require_grid(activity, 2)
    for cell in (0, 99, 10_001):
        with pytest.raises(LookupError):
            service.require_grid(activity, cell)


def test_summary(tables, star):
    row = service.latest_network_summary(*star[:2]).first()
    assert (row["as_of"], row["total_activity"], row["active_grids"], row["peak_hour"], row["top_grid"]) == (
        NOW,
        sum(100.0 - g for g in range(1, 7)),
        6,
        12,
        1,
    )
    assert service.network_summary(tables[0]).count() == 30


def test_map_status_takes_the_last_alert_listed(tables, star):
    activity, scores, alerts = tables
    feed = service.alert_feed(alerts, scores, activity)
    hot = service.network_hotspots(*star, limit=5)
    status = {r["grid_id"]: r["status"] for r in service.map_status(hot, feed).collect()}
    assert status == {1: "ATTENTION", 2: "HIGH", 3: "NORMAL", 4: "NORMAL", 5: "NORMAL"}
    counters = service.dashboard_counters(hot, feed).first().asDict()
    assert counters == {"hotspots": 5, "alerts": 4, "high": 2, "attention": 1}
    assert service.visible_features(activity.select("grid_id").distinct(), hot, feed).count() == 5


def test_predict_risk_answers_every_request(spark):
    model = risk.RiskModel([0.0] * 6, [1.0] * 6, [1.0, 0, 0, 0, 0, 0], 0.0)
    row = (0.0, 0.1, 3, 1.0, 0.5, 0.2)
    columns = "grid_id int, feature_timestamp timestamp, " + ", ".join(
        f"{f} {'long' if f == 'active_hours' else 'double'}" for f in S.FEATURES
    )
    features = spark.createDataFrame([(1, NOW, *row), (2, NOW, *row), (2, NOW, *row), (3, NOW, *row), (5, NOW, *row), (5, NOW + timedelta(hours=1), *row)], columns)
    hourly = spark.createDataFrame(
        [(1, NOW, 5.0), (2, NOW, 5.0), (5, NOW, 5.0), (5, NOW, 5.0), (5, NOW + timedelta(hours=1), 5.0)],
        "grid_id int, timestamp timestamp, total_activity double",
    )
    known = spark.createDataFrame(
        [(1, NOW, "HIGH", 2.0, "Busy")], "grid_id int, timestamp timestamp, direction string, anomaly_score double, reason string"
    )
    asked = [(1, NOW, 5.00005), (1, NOW, 5.1), (2, NOW, 5.0), (3, NOW, 5.0), (4, NOW, 5.0), (5, NOW, 5.0), (5, NOW + timedelta(hours=1), 5.0)]
    requests = spark.createDataFrame(asked, "grid_id int, timestamp timestamp, total_activity double")
    rows = {(r["grid_id"], r["timestamp"].hour, r["total_activity"]): r for r in service.predict_risk(requests, features, hourly, known, model).collect()}
    assert {k: r["status"] for k, r in rows.items()} == {
        (1, 12, 5.00005): "OK",
        (1, 12, 5.1): "ACTIVITY_MISMATCH",
        (2, 12, 5.0): "MULTIPLE_FEATURES",
        (3, 12, 5.0): "NO_ACTIVITY",
        (4, 12, 5.0): "NO_FEATURES",
        (5, 12, 5.0): "MULTIPLE_ACTIVITY",
        (5, 13, 5.0): "OK",
    }
    good = rows[1, 12, 5.00005]
    assert (good["risk_score"], good["risk_level"]) == (0.5, "MEDIUM")
    assert good["explanation_note"] == (
        "ML3 risk prediction generated using features at 2013-11-01 12:00:00. "
        "ML4 anomaly status: HIGH. Anomaly score: 2.0000. Busy."
    )
    assert rows[5, 13, 5.0]["explanation_note"].endswith(S.NO_ANOMALY_REASON)
    assert rows[1, 12, 5.1]["risk_score"] is None and rows[1, 12, 5.1]["explanation_note"] is None


def log_row(hour, status, as_of, tasks):
    return (f"run{hour}", NOW + timedelta(hours=hour), status, 10, 1, 2, 9, as_of, "", tasks)


@pytest.mark.parametrize(
    "rows,indicator,hours,reasons",
    [
        ([log_row(0, "SUCCESS", "2013-11-01 11:00:00", {"a": "success"})], "FRESH", 13.0, []),
        ([log_row(0, "SUCCESS", "2013-10-31 23:59:00", {})], "STALE", 24 + 1 / 60, []),
        ([log_row(0, "SUCCESS", "", {})], "UNKNOWN", None, []),
        (
            [log_row(0, "SUCCESS", "2013-11-01 00:00:00", {}), log_row(1, "FAILED", None, {"load": "failed", "a": "success", "b": None})],
            "STALE_OR_UNHEALTHY",
            24.0,
            ["Latest pipeline run status is FAILED", "Failed or incomplete tasks: load"],
        ),
        ([log_row(2, "failed", None, {}), log_row(1, "SUCCESS", "2013-11-02 00:00:00", {})], "STALE_OR_UNHEALTHY", 0.0, ["Latest pipeline run status is FAILED"]),
    ],
)
def test_latest_run(spark, rows, indicator, hours, reasons):
    log = spark.createDataFrame(rows, S.RUN_STATUS_SCHEMA)
    row = service.latest_run_status(log, datetime(2013, 11, 2)).first()
    assert row["freshness_indicator"] == indicator and row["reasons"] == reasons
    assert row["freshness_hours"] == pytest.approx(hours)
    assert row["healthy"] is (indicator != "STALE_OR_UNHEALTHY")


def test_task_status_from_text(spark):
    frame = spark.createDataFrame([("done {'load': 'success', 'check': None}",), ("plain",), (None,), ("bad {x",)], "r string")
    got = [r[0] for r in frame.select(service.parse_task_status(F.col("r"))).collect()]
    assert got == [{"load": "success", "check": None}, {}, {}, {}]


def test_alert_feed_does_not_sort_all_scores(tables):
    """Only the scores of the listed keys leave their scan."""
    activity, scores, alerts = tables
    plan = service.alert_feed(alerts, scores, activity)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi, BuildRight" in plan
