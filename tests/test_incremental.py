"""Landing by landing against one run over everything, and what a landing rewrites."""

import os

import pytest
from pyspark.sql import functions as F

from gridlens import schema as S
from gridlens.operators import aggregate, alerts, anomaly, clean, features, order_stats, warehouse
from gridlens.plans import incremental
from gridlens.plans.incremental import Store, apply_landing

START = "2024-03-01 00:00:00"


def activity(spark, days, cells, every=1, seed=0):
    """Rows of the first day hours; every cell has every hour, but cells divisible by 5 only one hour in a hundred."""
    hours = spark.range(days * 24).select(F.col("id").alias("h"), F.explode(F.sequence(F.lit(1), F.lit(cells))).alias("cell"))
    value = (F.xxhash64("h", "cell", F.lit(seed)) % 10_000 + 10_000) / 100
    rows = hours.where("cell % 5 <> 0 OR h % 100 = cell % 100").select(
        F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + F.col("h") * 3600), "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        F.col("cell").cast("int").alias("CellID"), F.lit(39).alias("countrycode"),
        *[F.when(F.col("h") % 2 == i % 2, F.round(value * (i + 1), 2)).alias(m) for i, m in enumerate(S.RAW_MEASURES)],
    )
    return rows


def whole(spark, raw, threshold):
    hourly = aggregate.hourly_grid_summary(clean.clean_activity(clean.to_canonical(raw)), 2).cache()
    times = warehouse.dim_time(hourly)
    return {
        "hourly": hourly,
        "dim_time": times,
        "fact_network_activity": warehouse.fact_network_activity(hourly, times),
        "network_alerts": alerts.network_alerts(hourly),
        "features": features.network_features(hourly),
        "training_set": features.training_set(hourly, threshold),
    }


def rows(df, columns):
    shown = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.select(*columns).dtypes]
    return sorted(map(tuple, df.select(*shown).collect()), key=repr)


def same(store, raw, threshold=300.0):
    for name, wanted in whole(store.spark, raw, threshold).items():
        assert rows(store.table(name), wanted.columns) == rows(wanted, wanted.columns), name
    hourly = store.table("hourly")
    wanted = anomaly.anomaly_scores(hourly)
    assert rows(store.scores(), wanted.columns) == rows(wanted, wanted.columns)


def files(root, table):
    found = {}
    for folder, _, names in os.walk(os.path.join(root, table)):
        parts = [n for n in names if n.endswith(".parquet")]
        if parts:
            found[os.path.relpath(folder, os.path.join(root, table))] = sorted(parts)
    return found


def changed(before, after):
    return {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}


@pytest.fixture(scope="module")
def raw(spark):
    return activity(spark, 80, 12).cache()


def test_a_later_day_rewrites_what_it_reaches(spark, raw, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    day = F.col("datetime").startswith("2024-04-10")
    part = day & (F.col("CellID").isin(2, 3))
    apply_landing(store, raw.where(~part), "one", 300.0, 2)
    tables = ["hourly", "fact_network_activity", "network_alerts", "features", "training_set", "dim_time", "middles", "value_counts"]
    before = {t: files(store.root, t) for t in tables}
    reached = apply_landing(store, raw.where(part), "two", 300.0, 2)
    after = {t: files(store.root, t) for t in tables}
    for table in ("hourly", "fact_network_activity", "network_alerts", "dim_time"):
        assert changed(before[table], after[table]) == {"date=2024-04-10"}
    # five rows after and, for labels, one before; all cells here have every hour
    for table in ("features", "training_set"):
        assert changed(before[table], after[table]) == {"date=2024-04-09", "date=2024-04-10", "date=2024-04-11"}
    blocks = {r[0] for r in spark.range(2, 4).select(incremental.block_of("id")).collect()}
    for table in ("middles", "value_counts"):
        assert changed(before[table], after[table]) == {f"block={b}/landing=two" for b in blocks}
    assert set(reached["middles"]) == blocks
    same(store, raw)


def test_sparse_cells_are_read_beyond_the_days_around(spark, raw, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    part = F.col("datetime").startswith("2024-03-30") & (F.col("CellID") % 5 == 0) | F.col("datetime").startswith("2024-03-22")
    apply_landing(store, raw.where(~part), "one", 300.0, 2)
    apply_landing(store, raw.where(part), "two", 300.0, 2)
    same(store, raw)


def test_days_in_any_order_and_shared_days(spark, raw, tmp_path):
    small = raw.where("datetime < '2024-03-06'")
    store = Store(spark, str(tmp_path / "store"))
    for i, n in enumerate((2, 0, 1)):
        apply_landing(store, small.where(F.pmod(F.xxhash64("datetime", "CellID"), F.lit(3)) == n), f"part {i}", 300.0, 2)
    same(store, small)


def test_repeated_and_interrupted_landings(spark, raw, tmp_path, monkeypatch):
    small = raw.where("datetime < '2024-03-08'")
    late = F.col("datetime").startswith("2024-03-05") & (F.col("CellID") < 6)
    store = Store(spark, str(tmp_path / "store"))
    apply_landing(store, small.where(~late), "one", 300.0, 2)
    apply_landing(store, small.where(~late), "one", 300.0, 2)
    for step in ("_refresh_windows", "_refresh_summaries"):
        with monkeypatch.context() as patch:
            patch.setattr(incremental, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                apply_landing(store, small.where(late), "two", 300.0, 2)
    with monkeypatch.context() as patch:  # summaries written, but not committed
        patch.setattr(incremental.tables, "append_rows", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            apply_landing(store, small.where(late), "two", 300.0, 2)
    apply_landing(store, small.where(late), "two", 300.0, 2)
    same(store, small)
    assert store.commits().count() == 2


def test_a_day_without_alerts_is_emptied(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(
        [(f"2024-03-01 {h:02d}:00:00", cell, 39, float(v), None, None, None, None) for h, cell, v in rows], S.RAW_SCHEMA
    )
    first = [(0, 1, 10), (1, 1, 10), (2, 1, 50), (0, 2, 1), (1, 2, 1)]
    second = [(0, 1, 90), (1, 1, 90), (2, 1, 40)]
    store = Store(spark, str(tmp_path / "store"))
    apply_landing(store, make(first), "one", 300.0, 2)
    assert store.table("network_alerts").count() > 0
    apply_landing(store, make(second), "two", 300.0, 2)
    assert store.table("network_alerts").count() == 0
    same(store, make(first + second))
    assert apply_landing(store, make([]), "three") == {}


def test_summaries_merge_and_give_values_back(spark):
    import statistics

    values = [(b, float(v % 7) if b == 1 else v / 3 - 50) for b in (1, 2, 3) for v in range({1: 60, 2: 301, 3: 1}[b])]
    df = spark.createDataFrame(values, "b int, total_activity double")
    parts = [order_stats.value_counts(df.where(F.col("total_activity") % 2 < 1), ["b"], "total_activity")]
    parts.append(order_stats.value_counts(df.where(F.col("total_activity") % 2 >= 1), ["b"], "total_activity"))
    parts.append(order_stats.value_counts(df.where("b = 2 AND total_activity > 20").withColumn("b", F.lit(2)), ["b"], "total_activity").withColumn("rows", -F.col("rows")))
    merged = order_stats.merged_counts(parts, ["b"])
    kept = [(b, v) for b, v in values if not (b == 2 and v > 20)]
    remaining = spark.createDataFrame(kept, "b int, total_activity double")
    got = order_stats.medians_of_others(remaining, order_stats.middle_values(merged, ["b"]), ["b"]).collect()
    assert len(got) == len(kept)
    for r in got:
        others = [v for b, v in kept if b == r["b"]]
        others.remove(r["total_activity"])
        assert r["baseline_activity"] == (pytest.approx(statistics.median(others)) if others else None)


def test_store_without_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"))
    with pytest.raises(LookupError):
        store.table("hourly")


def test_landing_sends_no_table_that_grows_through_the_driver(spark, tmp_path, monkeypatch):
    """Joins by cell and hour are merges, however small the files are in which the keys lie."""
    seen, stage = [], incremental.stage
    monkeypatch.setattr(incremental, "stage", lambda df, name: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or stage(df, name))
    store = Store(spark, str(tmp_path / "store"))
    apply_landing(store, activity(spark, 2, 4), "first", 300.0, 2)
    joined = {name: plan for name, plan in seen if name in ("neighbourhood", "near-hours")}
    assert set(joined) == {"neighbourhood", "near-hours"}
    assert all("SortMergeJoin" in plan and "BroadcastHashJoin" not in plan for plan in joined.values())
