"""Windows and order statistics against brute force."""

import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridlens.operators import order_stats, windows
from gridlens.operators.anomaly import score_against_baseline
from gridlens.operators.order_stats import leave_one_out_median
from tests import plan_metrics

START = datetime(2013, 1, 1)


def sparse_series(spark, cells=5, seed=1, gaps=(1, 1, 1, 2, 50, 700, 1500)):
    """Hourly rows per cell with gaps from one hour to several months."""
    pick = random.Random(seed)
    rows = []
    for cell in range(1, cells + 1):
        at = START
        for _ in range(120):
            at += timedelta(hours=pick.choice(gaps))
            rows.append((cell, at, float(pick.randint(0, 6)), float(pick.randint(0, 3))))
    return spark.createDataFrame(rows, "grid_id int, timestamp timestamp, total_activity double, internet_activity double")


@pytest.mark.parametrize("period,max_group_rows", [("day", 0), ("month", 0), ("year", 0), ("month", 130), ("month", 1000)])
@pytest.mark.parametrize("before,after", [(5, 0), (0, 1), (2, 3)])
def test_along_time_equals_one_window(spark, period, max_group_rows, before, after):
    frame = sparse_series(spark)
    if max_group_rows == 130:  # one cell in five is long
        frame = frame.where("grid_id <> 5").unionByName(sparse_series(spark, cells=9).where("grid_id > 4").select(
            F.lit(5).alias("grid_id"),
            (F.col("timestamp") + F.make_dt_interval(mins=F.col("grid_id"))).alias("timestamp"),
            "total_activity",
            "internet_activity",
        ))

    def columns(w):
        frame_spec = w.rowsBetween(-before, after)
        return [
            F.sum("total_activity").over(frame_spec).alias("s"),
            F.count("total_activity").over(frame_spec).alias("n"),
            F.min("timestamp").over(frame_spec).alias("first"),
        ]

    split = windows.along_time(frame, columns, ["grid_id"], before=before, after=after, period=period, max_group_rows=max_group_rows)
    whole = frame.select("*", *columns(Window.partitionBy("grid_id").orderBy("timestamp")))
    assert split.count() == whole.count()
    assert split.exceptAll(whole).count() == 0 and whole.exceptAll(split).count() == 0


def test_along_time_over_all_rows(spark):
    frame = sparse_series(spark, cells=1)
    got = windows.timestamp_gaps(frame).orderBy("timestamp").collect()
    times = [r["timestamp"] for r in got]
    assert [r["previous"] for r in got] == [None, *times[:-1]]


def median_of_others(values):
    return [statistics.median(values[:i] + values[i + 1 :]) if len(values) > 1 else None for i in range(len(values))]


@pytest.mark.parametrize("max_group_rows", [None, 1_000_000, 3, 0])
def test_leave_one_out_median(spark, max_group_rows):
    pick = random.Random(7)
    rows, expected = [], {}
    for bucket in range(1, 41):
        size = 1 + bucket % 9
        values = [float(pick.choice([0, 1, 1, 2, 5, 8.5, 1e6])) for _ in range(size)]
        for i, (v, m) in enumerate(zip(values, median_of_others(values), strict=True)):
            rows.append((bucket, i, v))
            expected[(bucket, i)] = m
    frame = spark.createDataFrame(rows, "bucket int, i int, v double").repartition(5)
    got = order_stats.leave_one_out_median(frame, ["bucket"], "v", "m", max_group_rows).collect()
    assert {(r["bucket"], r["i"]): r["m"] for r in got} == expected and len(got) == len(rows)


def test_median_with_one_dominant_bucket(spark):
    """A third of all rows in one bucket and most of them equal: only that bucket takes the sliced path."""
    big = spark.range(4001).select(F.lit(0).alias("b"), F.when(F.col("id") % 3 == 0, F.col("id") * 0.5).otherwise(0.0).alias("v"))
    small = spark.range(8000).select((F.col("id") % 800 + 1).cast("int").alias("b"), (F.col("id") * 1.0).alias("v"))
    frame = big.unionByName(small)
    sliced = order_stats.leave_one_out_median(frame, ["b"], "v", "m", max_group_rows=100)
    plain = order_stats.leave_one_out_median(frame, ["b"], "v", "m", max_group_rows=None)
    assert sliced.exceptAll(plain).count() == 0 and plain.exceptAll(sliced).count() == 0


@pytest.mark.parametrize("max_group_rows", [0, 40, 1000])
def test_quantiles_match_numpy(spark, max_group_rows):
    pick = np.random.default_rng(3)
    groups = {"a": pick.lognormal(3, 2, 501), "b": np.array([4.0]), "c": pick.normal(0, 5, 64), "d": np.zeros(30)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None)]
    frame = spark.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = [0.0, 0.25, 0.5, 0.99, 1.0]
    for r in order_stats.quantiles(frame, "v", wanted, ["g"], max_group_rows).collect():
        assert r["quantile"] == pytest.approx(np.quantile(groups[r["g"]], r["probability"]), rel=1e-12, abs=1e-12)
    whole = np.concatenate(list(groups.values()))
    overall = {r["probability"]: r["quantile"] for r in order_stats.quantiles(frame, "v", wanted, None, max_group_rows).collect()}
    assert overall == pytest.approx({p: np.quantile(whole, p) for p in wanted})


@pytest.mark.parametrize("max_group_rows", [-1, 10])
def test_quantiles_of_nothing(spark, max_group_rows):
    empty = spark.createDataFrame([], "v double")
    assert order_stats.quantiles(empty, "v", [0.5], None, max_group_rows).count() == 0


@pytest.mark.parametrize("n", [2, 5, 10, 37])
@pytest.mark.parametrize("max_rows", [1, 1_000_000])
def test_chronological_split(spark, n, max_rows, monkeypatch):
    monkeypatch.setattr(windows.values_at, "__defaults__", (None, order_stats.value_slice, max_rows))
    frame = spark.range(n * 3).select(
        (F.lit(START).cast("timestamp") + F.make_dt_interval(hours=((F.col("id") % n) * 7).cast("int"))).alias("t")
    )
    rows = windows.chronological_split(frame, "t").collect()
    assert windows.chronological_split(frame, "t", border=windows.split_border(frame, "t")).collect() == rows
    train = {r["t"] for r in rows if r["split"] == "train"}
    test = {r["t"] for r in rows if r["split"] == "test"}
    assert len(train) == int(n * 0.8) and len(train | test) == n
    assert not train or max(train) < min(test)


def test_last_hours(spark):
    frame = sparse_series(spark)
    latest = windows.last_hours(frame, 24)
    assert {r["grid_id"]: r["count"] for r in latest.groupBy("grid_id").count().collect()} == dict.fromkeys(range(1, 6), 24)
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_both_parts_of_a_long_series_read_one_shuffle(spark):
    frame = sparse_series(spark)
    result = windows.history_windows(frame, max_group_rows=0)
    result.collect()
    plan = result._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan


def test_split_filter_reaches_the_scan(spark, tmp_path):
    frame = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("t"))
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    train, test = windows.chronological_parts(stored, "t", windows.split_border(stored, "t"))
    assert (train.count(), test.count()) == (80, 20)
    assert "LessThan(t," in train._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("low,high,count", [(0.50, 0.51, 4000), (-1e308, 1e308, 500), (7.0, 7.0, 500)])
def test_narrow_slices_are_cut_again(spark, monkeypatch, low, high, count):
    """Values of one slice: no step sorts more rows than the limit, and every position is right."""
    pick = random.Random(4)
    values = [pick.uniform(low, high) if low > -1 else pick.choice([-1, 1]) * 10 ** pick.uniform(0, 308) for _ in range(count)]
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    seen = []
    stored = order_stats.stage

    def watched(df, name):
        kept = stored(df, name)
        if name == "slices":
            seen.append(kept.where("_least < _most").agg(F.max("_rows")).first()[0] or 0)
        return kept

    monkeypatch.setattr(order_stats, "stage", watched)
    got = order_stats.values_at(frame, "v", lambda n: {"a": n * 0 + 7, "b": F.floor(n / 2), "c": n - 1}, max_group_rows=50).first()
    ordered = sorted(values)
    assert (got["a"], got["b"], got["c"]) == (ordered[7], ordered[count // 2], ordered[-1])
    assert seen[-1] <= 50


@pytest.mark.parametrize("max_group_rows", [0, 1000])
def test_odd_values_sort_alike(spark, max_group_rows):
    values = [1.0, 2.0, 3.0, 4.0, float("nan"), float("inf"), float("-inf"), -0.0, 0.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    names = {f"p{i}": i for i in range(len(values))}
    got = order_stats.values_at(frame, "v", lambda n: {k: n * 0 + i for k, i in names.items()}, max_group_rows=max_group_rows).first()
    shown = [str(got[k] + 0.0) for k in names]
    assert shown == ["-inf", "0.0", "0.0", "1.0", "2.0", "3.0", "4.0", "inf", "nan"]


def test_exact_sums(spark):
    from gridlens.operators.aggregate import exact_sum

    frame = spark.createDataFrame([(0.004,)] * 1000, "v double")
    assert frame.agg(exact_sum("v", 3)).first()[0] == 4.0
    for bad in (0.004, float("nan"), float("inf"), 1e17):
        with pytest.raises(Exception, match="at most 2 decimals"):
            spark.createDataFrame([(bad,)], "v double").agg(exact_sum("v", 2)).collect()


def test_medians_of_others_take_two_passes_over_a_bucket(spark):
    """One for places and sizes, one for the values around the middle; reasons are put together without a format."""
    rows = spark.createDataFrame([(g, h, float(g * h)) for g in range(3) for h in range(5)], "grid_id int, hour int, total_activity double")
    scored = score_against_baseline(leave_one_out_median(rows, ["grid_id"]))
    plan = plan_metrics.names(plan_metrics.executed(scored))
    assert plan.count("WindowExec") == 2
    assert "format_string" not in scored._jdf.queryExecution().analyzed().toString()
    reasons = {r["hour"]: r["reason"] for r in scored.where("grid_id = 2").collect()}
    assert reasons[4] == "Activity is 166.67% above the historical median for grid 2 at hour 04:00"
    assert reasons[1] == "Activity is 60.00% below the historical median for grid 2 at hour 01:00"
