import pytest
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators import aggregate, clean, profile
from gridlens.operators.clean import require_columns

ROWS = [
    ("2013-11-01 00:00:00", 1, 39, 1.0, None, 2.0, None, 3.0),
    ("2013-11-01 00:00:00", 1, 0, None, None, None, None, 0.5),
    ("2013-11-01 01:00:00", 1, 39, -1.0, None, None, None, 1.0),
    ("2013-11-01 01:00:00", None, 39, 1.0, 1.0, 1.0, 1.0, 1.0),
    ("not-a-time", 2, 39, 1.0, 1.0, 1.0, 1.0, 1.0),
    ("not-a-time", 2, 39, -1.0, None, 1.0, 1.0, 1.0),
    (None, 2, 39, None, None, None, None, None),
    ("2013-11-02 23:00:00", 2, 0, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def canonical(spark):
    return clean.to_canonical(spark.createDataFrame(ROWS, S.RAW_SCHEMA)).cache()


def test_no_row_is_lost(canonical):
    kept, rejected = clean.clean_activity(canonical), clean.rejected_rows(canonical)
    assert kept.count() + rejected.count() == len(ROWS)
    causes = {r["reject_cause"]: r["rows"] for r in aggregate.level_counts(rejected, "reject_cause").collect()}
    assert causes == {"MISSING_KEY": 4, "NEGATIVE_VALUE": 1}


def test_counters(canonical):
    row = clean.clean_counters(canonical).first().asDict()
    assert row == {
        "input_rows": 8,
        "rejected_rows": 5,
        "rejected_missing_key": 4,
        "rejected_non_finite": 0,
        "rejected_negative": 1,
        "nulls_handled": 2 + 4 + 5,
        "output_rows": 3,
    }


def test_counters_of_nothing(canonical):
    row = clean.clean_counters(canonical.limit(0)).first()
    assert row["input_rows"] == row["nulls_handled"] == 0


def test_hourly_summary_and_zero_total(canonical):
    hourly = aggregate.hourly_grid_summary(clean.clean_activity(canonical))
    rows = {(r["grid_id"], r["timestamp"].isoformat()): r for r in hourly.collect()}
    assert len(rows) == 2
    first = rows[(1, "2013-11-01T00:00:00")]
    assert (first["total_sms"], first["total_calls"], first["total_activity"]) == (1.0, 2.0, 6.5)
    assert first["internet_share"] == pytest.approx(3.5 / 6.5)
    assert first["day_of_week"] == "Friday" and str(first["date"]) == "2013-11-01" and first["hour"] == 0
    assert rows[(2, "2013-11-02T23:00:00")]["internet_share"] is None
    assert "country_code" not in hourly.columns


def test_exact_sum_does_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, 1e9, 0.01] * 50
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    totals = {
        n: frame.repartition(n).agg(aggregate.exact_sum("v", 2).alias("v")).first()["v"] for n in (1, 3, 7)
    }
    assert set(totals.values()) == {round(sum(round(v * 100) for v in values)) / 100}


def test_missing_columns_are_listed(canonical):
    with pytest.raises(ValueError, match="call_in"):
        clean.clean_activity(canonical.drop("call_in"))
    with pytest.raises(ValueError, match="risk"):
        require_columns(canonical, ["grid_id", "risk"])


def test_first_per_key_with_order(spark):
    rows = [(1, "a", 3), (1, "b", 1), (1, "c", 2), (2, "d", None)]
    frame = spark.createDataFrame(rows, "k int, v string, o int")
    chosen = clean.first_per_key(frame, ["k"], [F.col("o")])
    assert chosen.columns == ["k", "v", "o"]
    assert sorted(map(tuple, chosen.collect())) == [(1, "b", 1), (2, "d", None)]
    assert clean.first_per_key(frame, ["k"]).count() == 2


def test_profile_facts(canonical):
    nulls = {r["column_name"]: r["nulls"] for r in profile.null_counts(canonical).collect()}
    assert nulls["grid_id"] == 1 and nulls["timestamp"] == 1 and nulls["sms_in"] == 3
    negatives = {r["column_name"]: r["negatives"] for r in profile.negative_counts(canonical, S.MEASURES).collect()}
    assert negatives == {"sms_in": 2, "sms_out": 0, "call_in": 0, "call_out": 0, "internet_activity": 0}
    assert profile.cardinalities(canonical).first()["grids"] == 2
    doubled = canonical.unionByName(canonical)
    assert profile.duplicate_rows(doubled).first()["duplicate_rows"] == len(ROWS)
    assert {r["column_name"]: r["data_type"] for r in profile.shape(canonical).collect()}["grid_id"] == "int"


def test_multi_country_example(canonical):
    kept = clean.clean_activity(canonical)
    assert profile.multi_country_keys(kept).count() == 1
    assert profile.multi_country_example(kept).count() == 2


@pytest.mark.parametrize("hours,hourly", [([0, 1, 2, 3], True), ([0, 1, 3], False), ([5], True)])
def test_cadence(spark, hours, hourly):
    frame = spark.createDataFrame([(h,) for h in hours * 2], "h int")
    stamped = frame.select((F.lit("2013-11-30 22:00:00").cast("timestamp") + F.make_dt_interval(hours="h")).alias("timestamp"))
    row = profile.cadence(stamped).first()
    assert row["hourly"] is hourly and row["distinct_timestamps"] == len(hours)


def test_acceptance_checks(spark):
    rows = [(f"2013-11-01 {h:02d}:00:00", 1 + h, f"f{1}") for h in range(24)] + [("2013-11-01 00:00:00", 10001, "f1")]
    frame = spark.createDataFrame(rows, "datetime string, CellID int, source_file string")
    passed = {r["check_name"]: r["passed"] for r in profile.acceptance_checks(frame, "source_file", (1, 10_000)).collect()}
    assert passed == {"timestamps_per_file": True, "cell_range": False, "lineage": True}


def test_non_finite_measures_are_rejected(spark):
    rows = [("2013-11-01 00:00:00", 1, 39, v, 1.0, None, 1.0, 1.0) for v in (float("nan"), float("inf"), -1.0, 2.0)]
    canonical = clean.to_canonical(spark.createDataFrame(rows, S.RAW_SCHEMA))
    row = clean.clean_counters(canonical).first()
    assert (row["rejected_non_finite"], row["rejected_negative"], row["output_rows"], row["nulls_handled"]) == (2, 1, 1, 1)
    assert row["input_rows"] == row["rejected_rows"] + row["output_rows"]
