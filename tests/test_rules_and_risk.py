import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators import aggregate, alerts, anomaly, clean, features, report, risk
from gridlens.plans.catalog import dataset

DAY = datetime(2013, 11, 1)
HAND_CHECK = [62.0092, 46.3654, 42.0870, 35.0978, 32.2741, 35.4160]


def hourly_rows(spark, values, cell=1, start=DAY):
    rows = [(cell, start + timedelta(hours=i), float(v), float(v) / 2) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "grid_id int, timestamp timestamp, total_activity double, internet_activity double")
    return clean.add_calendar(frame)


def test_feature_hand_check(spark):
    row = features.network_features(hourly_rows(spark, HAND_CHECK)).collect()
    assert len(row) == 1 and row[0]["feature_timestamp"] == DAY + timedelta(hours=5)
    assert row[0]["avg_activity"] == pytest.approx(34.26263333333333, rel=1e-14)
    assert row[0]["activity_growth"] == pytest.approx(-0.3168496147854336, rel=1e-12)
    assert row[0]["peak_ratio"] == pytest.approx(1.033662522534267, rel=1e-12)
    assert row[0]["active_hours"] == 3 and row[0]["internet_share"] == pytest.approx(0.5)
    assert row[0]["variability"] == pytest.approx(np.std(HAND_CHECK[3:], ddof=1))


def test_features_of_silent_cell(spark):
    row = features.network_features(hourly_rows(spark, [0] * 6)).first()
    assert [row[f] for f in S.FEATURES] == [0.0, 0.0, 0, 0.0, 0.0, 0.0]


def test_strict_hours_and_duplicates(spark):
    rows = hourly_rows(spark, range(8)).where("hour <> 3")
    assert features.network_features(rows).count() == 2
    assert features.network_features(rows, strict_hours=True).count() == 0
    doubled = rows.unionByName(rows)
    assert features.network_features(doubled, deduplicate=True).count() == 2


def test_target_is_exactly_one_hour_later(spark):
    rows = hourly_rows(spark, range(10)).where("hour <> 7")
    labelled = features.training_set(rows, threshold=8.5)
    assert {r["feature_timestamp"].hour: r["high_activity_risk"] for r in labelled.collect()} == {5: 0, 8: 1}


def test_leakage_check_sees_leaks(spark, monkeypatch):
    rows = hourly_rows(spark, range(30))
    assert features.leakage_report(rows, DAY + timedelta(hours=15)).first()["changed_rows"] == 0
    honest = features.network_features

    def leaking(hourly):
        total = hourly.agg(F.max("total_activity")).first()[0]
        return honest(hourly).withColumn("avg_activity", F.col("avg_activity") + total)

    monkeypatch.setattr(features, "network_features", leaking)
    assert features.leakage_report(rows, DAY + timedelta(hours=15)).first()["changed_rows"] > 0


def test_alert_rules_and_texts(spark):
    rows = hourly_rows(spark, [10, 10, 10, 30, 1, 10, 10, 10])
    got = {(r["timestamp"].hour, r["alert_type"]): r for r in alerts.network_alerts(rows).collect()}
    assert set(got) == {(3, "HIGH_ACTIVITY"), (3, "ACTIVITY_SPIKE"), (4, "ACTIVITY_DROP")}
    assert got[3, "HIGH_ACTIVITY"]["reason"] == (
        "HIGH_ACTIVITY: current activity 30.00 is more than 2.0x this grid's within-day baseline of 10.00"
    )
    assert got[4, "ACTIVITY_DROP"]["reason"] == (
        "ACTIVITY_DROP: current activity 1.00 is below 0.25x this grid's within-day baseline of 10.00"
    )
    assert got[3, "ACTIVITY_SPIKE"]["reason"] == (
        "ACTIVITY_SPIKE: current activity 30.00 is more than 2.0x the immediately preceding hour's 10.00"
    )
    assert str(got[3, "HIGH_ACTIVITY"]["source_file"]) == "2013-11-01"


def test_baseline_equal_to_the_floor_is_not_below_it(spark):
    """Both are 85.575; in doubles (85.41 + 85.74) / 2 is less than 85.53 + 0.06 * 0.75."""
    rows = hourly_rows(spark, [85.41, 85.74, 500]).unionByName(hourly_rows(spark, [85.53, 85.59, 90, 90, 90], cell=2))
    got = {(r["grid_id"], r["timestamp"].hour, r["alert_type"]) for r in alerts.network_alerts(rows).collect()}
    assert (1, 2, "HIGH_ACTIVITY") in got


def test_alerts_stay_within_their_day(spark):
    two_days = hourly_rows(spark, [10] * 23 + [1], start=DAY).unionByName(
        hourly_rows(spark, [50] * 24, start=DAY + timedelta(days=1))
    )
    kinds = {(r["timestamp"], r["alert_type"]) for r in alerts.network_alerts(two_days).collect()}
    assert kinds == {(DAY + timedelta(hours=23), "ACTIVITY_DROP")}


def test_alerts_by_source_file(spark):
    """Two files of the same day are judged apart."""
    rows = hourly_rows(spark, [10, 10, 10, 30, 10, 10]).withColumn("source_file", F.when(F.col("hour") < 3, "a").otherwise("b"))
    got = {(r["timestamp"].hour, r["alert_type"], r["source_file"]) for r in alerts.network_alerts(rows, "source_file").collect()}
    assert got == {(3, "HIGH_ACTIVITY", "b")}


def test_single_row_bucket_raises_no_alert(spark):
    assert alerts.network_alerts(hourly_rows(spark, [5])).count() == 0


def test_severity_default(spark):
    frame = spark.createDataFrame([(k,) for k in ("HIGH_ACTIVITY", "ACTIVITY_SPIKE", "ACTIVITY_DROP", "OTHER")], "alert_type string")
    assert [r["severity"] for r in alerts.with_severity(frame).collect()] == ["HIGH", "MEDIUM", "LOW", "MEDIUM"]


@pytest.mark.parametrize(
    "activity,baseline,score,direction,reason",
    [
        (14.1806, 480.1108, -0.9705, "LOW", "Activity is 97.05% below the historical median for grid 7 at hour 04:00"),
        (16149.0844, 1432.0359, 10.2770, "HIGH", "Activity is 1027.70% above the historical median for grid 7 at hour 04:00"),
        (5.0, 5.0, 0.0, "NORMAL", "Activity matches the historical baseline"),
        (5.0, 0.0, 0.0, "NORMAL", "Historical baseline is zero or negative"),
        (7.5, 5.0, 0.5, "HIGH", "Activity is 50.00% above the historical median for grid 7 at hour 04:00"),
        (2.5, 5.0, -0.5, "LOW", "Activity is 50.00% below the historical median for grid 7 at hour 04:00"),
        (5.0, None, 0.0, "NO_BASELINE", "No historical baseline available for this grid and hour"),
    ],
)
def test_anomaly_cases(spark, activity, baseline, score, direction, reason):
    frame = spark.createDataFrame(
        [(7, 4, activity, baseline)], "grid_id int, hour int, total_activity double, baseline_activity double"
    )
    row = anomaly.score_against_baseline(frame).first()
    assert round(row["anomaly_score"], 4) == score
    assert (row["direction"], row["reason"]) == (direction, reason)


def test_evaluation_arithmetic(spark):
    counts = {(1, 1): 36804, (0, 1): 12559, (1, 0): 809, (0, 0): 279826}
    frame = None
    for (label, predicted), n in counts.items():
        part = spark.range(n).select(F.lit(label).alias("high_activity_risk"), F.lit(predicted).alias("ml_prediction"))
        frame = part if frame is None else frame.unionByName(part)
    row = risk.evaluate(frame).first()
    assert (round(row["accuracy"], 5), round(row["precision"], 5), round(row["recall"], 5)) == (0.95949, 0.74558, 0.97849)
    assert round(row["test_base_rate"], 5) == 0.11398
    empty = risk.evaluate(frame.limit(0)).first()
    assert empty["precision"] == empty["recall"] == 0.0


def test_fit_is_the_penalised_optimum(spark, sf_dir):
    """The gradient of the balanced, L2-penalised log loss vanishes at the fitted coefficients."""
    train = dataset(spark, sf_dir, "lineitem").train.select(*S.FEATURES, "high_activity_risk")
    busy = train.agg(F.percentile("avg_activity", F.lit(0.8))).first()[0]
    train = train.withColumn("high_activity_risk", F.when(F.col("avg_activity") + F.col("variability") > busy, 1).otherwise(0))
    model = risk.fit_risk(train)
    table = train.toPandas()
    x = (table[S.FEATURES].to_numpy(float) - model.means) / model.scales
    y = table["high_activity_risk"].to_numpy(float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    probability = 1 / (1 + np.exp(-(x @ model.coefficients + model.intercept)))
    residual = weight * (probability - y)
    gradient = x.T @ residual + np.array(model.coefficients)
    assert np.abs(gradient).max() / len(y) < 1e-5
    assert abs(residual.sum()) / len(y) < 1e-5


def test_model_round_trip_and_scoring_contract(spark, sf_dir, tmp_path):
    data = dataset(spark, sf_dir)
    model = data.example_model
    risk.save_model(spark, model, str(tmp_path / "model"))
    assert risk.load_model(spark, str(tmp_path / "model")) == model
    row = data.features.join(data.risk.withColumnRenamed("timestamp", "feature_timestamp"), ["grid_id", "feature_timestamp"]).first()
    one = risk.score_one(model, {f: row[f] for f in S.FEATURES})
    assert one["risk_score"] == pytest.approx(row["risk_score"]) and one["risk_level"] == row["risk_level"]
    with pytest.raises(ValueError, match="peak_ratio"):
        risk.score_one(model, {f: 1.0 for f in S.FEATURES if f != "peak_ratio"})
    extreme = risk.RiskModel([0.0] * 6, [1.0] * 6, [0.0] * 6, -1000.0)
    assert math.isclose(risk.score_one(extreme, dict.fromkeys(S.FEATURES, 0.0))["risk_score"], 0.0)


def test_scoring_input_checks(spark, sf_dir):
    table = dataset(spark, sf_dir).features
    risk.check_scoring_input(table)
    with pytest.raises(ValueError, match="repeats"):
        risk.check_scoring_input(table.unionByName(table))
    with pytest.raises(ValueError, match="empty"):
        risk.check_scoring_input(table.limit(0))
    with pytest.raises(ValueError, match="variability"):
        risk.risk_scores(table.drop("variability"), dataset(spark, sf_dir).example_model)


def test_training_needs_both_classes(spark):
    frame = spark.createDataFrame([(0,)], "high_activity_risk int")
    with pytest.raises(ValueError, match="both classes"):
        risk.balanced_weights(frame)


def test_split_must_be_valid(spark):
    frame = hourly_rows(spark, range(4)).withColumnRenamed("timestamp", "feature_timestamp")
    features.require_valid_split(features.split_training_set(frame))
    with pytest.raises(ValueError, match="split"):
        features.require_valid_split(features.split_training_set(frame, fraction=0.0))
    with pytest.raises(ValueError, match="no feature_timestamp"):
        features.split_training_set(frame.limit(0))


@pytest.mark.parametrize(
    "flags,label",
    [
        ((0, 0, 0), "ALL_NEGATIVE"),
        ((1, 0, 0), "ML4_ONLY"),
        ((0, 1, 0), "ML3_ONLY"),
        ((0, 0, 1), "NP3_ONLY"),
        ((1, 1, 0), "ML4_ML3"),
        ((1, 0, 1), "ML4_NP3"),
        ((0, 1, 1), "ML3_NP3"),
        ((1, 1, 1), "ALL_THREE"),
    ],
)
def test_three_way_labels(spark, flags, label):
    frame = spark.createDataFrame([tuple(map(bool, flags))], "ml4_positive boolean, ml3_positive boolean, np3_positive boolean")
    assert frame.select(risk.three_way_label()).first()[0] == label


def test_types_per_key(spark):
    rows = [(1, DAY, "ACTIVITY_SPIKE"), (1, DAY, "ACTIVITY_DROP"), (1, DAY, "ACTIVITY_DROP"), (2, DAY, "ACTIVITY_DROP")]
    frame = spark.createDataFrame(rows, "grid_id int, timestamp timestamp, alert_type string")
    got = {r["grid_id"]: (r["np3_positive"], r["np3_alert_types"]) for r in aggregate.alert_types_per_key(frame).collect()}
    assert got == {1: (True, "ACTIVITY_DROP|ACTIVITY_SPIKE"), 2: (False, "ACTIVITY_DROP")}


def test_attention_report(spark):
    scored = spark.createDataFrame(
        [(i, DAY, i / 30, "LOW", "v1") for i in range(1, 26)],
        "grid_id int, timestamp timestamp, risk_score double, risk_level string, model_version string",
    )
    known = spark.createDataFrame(
        [(25, DAY, -2.0, "LOW", "Activity is low"), (3, DAY, 14.34983550780759, "HIGH", "Activity is high")],
        "grid_id int, timestamp timestamp, anomaly_score double, direction string, reason string",
    )
    rows = report.attention_report(scored, known).collect()
    assert [r["rank"] for r in rows] == list(range(1, 21))
    assert [r["grid_id"] for r in rows[:4]] == [3, 25, 24, 23]
    assert rows[0]["attention_score"] == pytest.approx(0.1 + 14.34983550780759)
    assert rows[0]["attention_reason"] == (
        "Investigate grid 3: predicted activity risk is 0.1000 (LOW). "
        "ML4 status is HIGH with anomaly score 14.3498. Activity is high"
    )
    assert rows[2]["direction"] == S.NO_ANOMALY_DIRECTION and rows[2]["attention_reason"].endswith(S.NO_ANOMALY_REASON)
