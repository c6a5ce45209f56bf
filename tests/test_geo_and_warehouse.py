import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gridlens.operators import aggregate, clean, geo, quality, warehouse
from gridlens.operators.joins import measured_bytes
from gridlens.plans import fixtures
from gridlens.sources import geo as geometry
from gridlens.sources import tables


def square(cell, kind="Polygon"):
    x, y = 9.0 + cell * 0.1, 45.0
    ring = [[x, y], [x + 0.1, y], [x + 0.1, y + 0.1], [x, y + 0.1], [x, y]]
    coordinates = [ring] if kind == "Polygon" else [[ring]] if kind == "MultiPolygon" else ring[0]
    return {
        "type": "Feature",
        "id": cell - 1,
        "properties": {"cellId": cell},
        "geometry": {"type": kind, "coordinates": coordinates},
    }


def write_collection(path, cells, kind=lambda c: "MultiPolygon" if c == 2 else "Polygon", top="FeatureCollection"):
    path.write_text(json.dumps({"type": top, "features": [square(c, kind(c)) for c in cells]}, indent=1))
    return str(path)


@pytest.fixture(scope="module")
def hourly(spark, sf_dir):
    canonical = clean.to_canonical(fixtures.activity_raw(spark, sf_dir))
    return aggregate.hourly_grid_summary(clean.clean_activity(canonical)).cache()


def test_lookup(spark, tmp_path):
    lookup = geometry.load_grid_lookup(spark, write_collection(tmp_path / "grid.geojson", range(1, 5)))
    rows = {r["grid_id"]: r for r in lookup.collect()}
    assert sorted(rows) == [1, 2, 3, 4]
    for cell, row in rows.items():
        x = 9.0 + cell * 0.1
        assert row["centroid_lon"] == pytest.approx((3 * x + 2 * (x + 0.1)) / 5)
        assert row["centroid_lat"] == pytest.approx((3 * 45.0 + 2 * 45.1) / 5)
        assert json.loads(row["geometry_json"]) == square(cell, "MultiPolygon" if cell == 2 else "Polygon")["geometry"]


def test_feature_lines_and_lookup_lines(spark, tmp_path):
    path = tmp_path / "grid.jsonl"
    path.write_text("\n".join(json.dumps(square(c)) for c in range(1, 4)) + "\n")
    lookup = geometry.grid_lookup(geometry.read_feature_lines(spark, str(path)))
    lookup.write.json(str(tmp_path / "lookup"))
    again = geometry.read_lookup_lines(spark, str(tmp_path / "lookup"))
    assert again.exceptAll(lookup).count() == 0 and again.count() == 3


@pytest.mark.parametrize("change", [{"kind": lambda c: "Point"}, {"top": "Feature"}])
def test_unexpected_geometry_fails(spark, tmp_path, change):
    path = write_collection(tmp_path / "bad.geojson", [1], **change)
    with pytest.raises(PySparkException, match="unexpected"):
        geometry.load_grid_lookup(spark, path).collect()


def test_enrichment_and_coverage(spark, hourly):
    features = fixtures.grid_features(hourly)
    lookup = geometry.grid_lookup(features)
    for strategy in ("auto", "merge"):
        joined = geo.enrich(hourly, lookup, strategy)
        assert joined.count() == hourly.count() and joined.where("geometry_json IS NULL").count() == 0
        assert ("BroadcastHashJoin" if strategy == "auto" else "SortMergeJoin") in plan(joined)
    assert geo.enrichment_coverage(hourly, lookup).first()["passed"]
    broken = lookup.where("grid_id <> 1").unionByName(lookup.where("grid_id = 2"))
    row = geo.enrichment_coverage(hourly, broken).first()
    assert (row["unmatched_grids"], row["repeated_lookup_keys"], row["passed"]) == (1, 1, False)
    assert row["rows_after"] == geo.enrich(hourly, broken).count()
    assert [r["grid_id"] for r in geo.unmatched_grids(hourly, broken).collect()] == [1]
    with pytest.raises(ValueError):
        geo.enrich(hourly, lookup, "nested")


def test_measured_bytes_counts_text(spark):
    frame = spark.createDataFrame([(1, "x" * 1000), (2, None)], "a int, t string")
    assert 1000 < measured_bytes(frame) < 1200


def test_star_schema(spark, hourly):
    times = warehouse.dim_time(hourly)
    fact = warehouse.fact_network_activity(hourly, times)
    features = fixtures.grid_features(hourly)
    grids = warehouse.dim_grid(features, "grid.geojson")
    assert all(r["passed"] for r in warehouse.warehouse_checks(hourly, fact, grids).collect())
    failed = {r["check_name"] for r in warehouse.warehouse_checks(hourly, fact.unionByName(fact), grids).collect() if not r["passed"]}
    assert failed == {"fact_rows", "repeated_fact_keys"}
    reference = json.loads(grids.where("grid_id = 1").first()["geometry_reference"])
    assert reference == {"source": "grid.geojson", "cellId": 1, "geometry_type": "Polygon"}
    back = warehouse.star(fact, times)
    assert back.select(hourly.columns).exceptAll(hourly).count() == 0
    with pytest.raises(PySparkException, match="no time_key"):
        warehouse.fact_network_activity(hourly, times.limit(1)).collect()


def test_gate_and_grain(spark, hourly):
    assert all(r["passed"] for r in quality.analytics_gate(hourly).collect())
    doubled = hourly.unionByName(hourly)
    with pytest.raises(ValueError, match="repeated_keys"):
        quality.require_gate(quality.analytics_gate(doubled))
    with pytest.raises(ValueError, match="not_empty"):
        quality.require_gate(quality.analytics_gate(hourly.limit(0)))
    with pytest.raises(ValueError, match="null_keys"):
        quality.require_gate(quality.analytics_gate(hourly.withColumn("grid_id", F.lit(None).cast("int"))))
    names = {r["check_name"] for r in quality.grain_checks(hourly, hourly, hourly).collect() if not r["passed"]}
    assert names == {"fewer_rows_than_clean"}


def test_hourly_sink_refuses_geometry(hourly, tmp_path):
    with pytest.raises(ValueError):
        tables.write_hourly(hourly.withColumn("geometry_json", F.lit("{}")), str(tmp_path / "t"))


def test_filters_and_columns_reach_the_scan(spark, hourly, tmp_path):
    path = str(tmp_path / "hourly")
    tables.write_hourly(hourly, path)
    row = hourly.first()
    found = tables.read_cell_hour(spark, path, row["grid_id"], row["timestamp"], ["grid_id", "total_activity"])
    assert found.count() == 1
    text = plan(found)
    assert "EqualTo(grid_id," in text and "EqualTo(timestamp," in text
    assert "ReadSchema: struct<grid_id:int,timestamp:timestamp,total_activity:double>" in text


def test_clustered_table_puts_ranges_in_files(spark, hourly, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.write_table(hourly, path, ["timestamp", "grid_id"], clustered=True)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spans = tables.read_table(spark, path).groupBy(F.input_file_name().alias("f")).agg(
        F.min("timestamp").alias("a"), F.max("timestamp").alias("b")
    ).orderBy("a").collect()
    assert len(spans) > 1 and all(x["b"] <= y["a"] for x, y in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("wrap", [lambda rows: rows, lambda rows: {"data": rows}, lambda rows: {"alerts": rows}])
def test_alert_files(spark, tmp_path, wrap):
    rows = [
        {
            "grid_id": i,
            "timestamp": f"2013-11-01 0{i}:00:00",
            "alert_type": "HIGH_ACTIVITY",
            "current_activity": 9.0,
            "baseline_activity": 2.0,
            "reason": "r",
        }
        for i in (1, 2)
    ]
    (tmp_path / "alerts.json").write_text(json.dumps(wrap(rows)))
    (tmp_path / "alerts.csv").write_text(
        ",".join(rows[0]) + "\n" + "\n".join(",".join(str(v) for v in r.values()) for r in rows) + "\n"
    )
    from_json = tables.read_alerts(spark, str(tmp_path / "alerts.json"))
    from_csv = tables.read_alerts(spark, str(tmp_path / "alerts.csv"))
    assert from_json.count() == 2 and from_json.exceptAll(from_csv).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
