"""Library operators on small fixtures, and every SQL twin at the smallest size."""

import json
import math
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geo, text
from terrasift.operators import cluster, joins
from terrasift.plans import registry
from terrasift.sources import readers

SF = "/root/testdata/sf0.001"


def test_haversine_forms_agree(spark):
    df = spark.createDataFrame([(37.54, -77.43, 36.85, -76.29), (38.8, -77.05, 38.8, -77.05)], "a double, b double, c double, d double")
    rows = df.select(geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("x"), geo.haversine_asin(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("y")).collect()
    assert all(math.isclose(r.x, r.y, abs_tol=1e-6) for r in rows) and 70 < rows[0].x < 90 and rows[1].x == 0


def test_radius_join_equals_brute_force(spark):
    pts = [(i, 36.5 + (i * 37 % 101) / 50, -80 + (i * 53 % 97) / 40) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    side = lambda p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    got = {(r.l_id, r.r_id) for r in joins.radius_join(side("l"), side("r"), 9.0, 45.0).collect()}
    d = lambda a, b: 2 * 3959 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))
    assert got == {(a[0], b[0]) for a in pts for b in pts if d(a, b) <= 9.0}


def test_dbscan_labels_noise_and_borders(spark):
    pts = [(0, 0.0, 0.0), (1, 0.5, 0.0), (2, 0.0, 0.5), (3, 1.2, 0.0), (4, 9.0, 9.0)]
    got = dict(cluster.dbscan(spark.createDataFrame(pts, "id long, x double, y double"), 0.8, 3).collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1}


def test_rules(spark):
    df = spark.createDataFrame([("A 7-year-old was abducted near I-95", "Low"), ("walked home", "Unknown"), (None, "High")], "t string, m string")
    r = df.select(text.risk_level(text.risk_score(F.col("t"), F.lit(None).cast("double"))).alias("l"), "m").collect()
    assert [x.l for x in r] == ["Critical", "Low", "Low"]
    names = spark.createDataFrame([("Main Rd north",), (" plain ",), (".x",)], "n string").select(text.clean_road(F.col("n"))).collect()
    assert [x[0] for x in names] == ["Main", "plain", ".x"]


@pytest.mark.parametrize("body", ['{"case_id": "a", "spatial": {"last_seen_lat": 37.1, "last_seen_lon": -77.0}}\n{"case_id": "b"}', '[{"case_id": "a", "spatial": {"last_seen_lat": 37.1, "last_seen_lon": -77.0}}, {"case_id": "b"}]', json.dumps({"case_id": "a", "spatial": {"last_seen_lat": 37.1, "last_seen_lon": -77.0}}, indent=2) + "\n" + json.dumps({"case_id": "b"}, indent=2)])
def test_readers_take_any_layout(spark, tmp_path, body):
    (tmp_path / "c.json").write_text(body)
    assert [r.case_id for r in readers.cases(spark, str(tmp_path)).orderBy("pos").collect()] == ["a", "b"]
    assert [tuple(r) for r in readers.case_coordinates(spark, str(tmp_path)).collect()] == [("a", 37.1, -77.0)]
    assert readers.points(spark, str(tmp_path)).count() == 1


def test_zone_and_hotspot_layouts(spark, tmp_path):
    (tmp_path / "z.json").write_text('{"case_id": "a", "zones": [{"zone_id": "z1"}]}\n{"case_id": "b", "zones": {"0-24": [{"zone_id": "z2"}, {"zone_id": "z3"}]}}')
    assert sorted((r.case_id, r.window, r.zone_id) for r in readers.zones(spark, str(tmp_path / "z.json")).collect() if r.window) == [("b", "0-24", "z2"), ("b", "0-24", "z3")]
    (tmp_path / "h.json").write_text('[{"lon": 1.0, "lat": 2.0, "weight": 3.0}, [4.0, 5.0]]')
    assert sorted(tuple(r) for r in readers.hotspots(spark, str(tmp_path / "h.json")).collect()) == [(1.0, 2.0, 3.0, 0.0), (4.0, 5.0, 0.0, 0.0)]
    (tmp_path / "t.json").write_text('{"a": {"lat": 1.0, "lon": 2.0}, "note": "x"}')
    assert [tuple(r) for r in readers.truth_map(spark, str(tmp_path / "t.json")).collect()] == [("a", 1.0, 2.0)]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def keys(d):
    cell = lambda v: "null" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.6g}" if isinstance(v, float) else str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in d[sorted(d.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n in sorted(registry.oracle_sql()) if os.path.isdir(SF)])
def test_query_equals_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert keys(got) == keys(want)


def test_settings_and_rules(spark):
    from terrasift import settings

    base = {"rl": {"ks": [1], "x": 2}, "n": 1}
    assert settings.merged(base, {"rl": {"x": 3}, "n": 4}) == {"rl": {"ks": [1], "x": 3}, "n": 4} and base["rl"]["x"] == 2
    assert settings.missing_columns(["b", "a", "c"], ["a"]) == ["b", "c"]
    with pytest.raises(ValueError):
        settings.need_unit("EPSG:4326", "metres")
    schema = {"required": ["a"], "properties": {"a": {"type": "integer"}, "b": {"required": ["c"], "properties": {"c": {"enum": ["x"], "type": "string"}}}}}
    rows = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": "z", "b": {"c": "y"}}',), ("{}",)], "j string")
    got = [r[0] for r in rows.select(settings.schema_issues(schema, F.col("j"))).collect()]
    assert got == [[], ["a: type", "b.c: enum"], ["a: required", "b.c: required"]]


def test_nearest_widens_its_reach(spark):
    r = [(k, float((k * 37) % 101), float((k * 53) % 97)) for k in range(60)] + [(60, 5000.0, 5000.0)]
    df = spark.createDataFrame(r, "id long, x double, y double")
    side = lambda p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    pairs = lambda a, b, e: joins.planar_join(a, b, e).filter("l_id <> r_id")
    got = {(x.l_id, x["rank"]): x.r_id for x in joins.nearest(side("l"), side("r"), "l_id", 3, 4.0, [F.round("dist", 9), F.col("r_id")], pairs, 20000.0).collect()}
    for i, x, y in r:
        near = sorted((round(math.hypot(x - u, y - v), 9), j) for j, u, v in r if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == [j for _, j in near]


def test_stream_drops_late_rows(spark, tmp_path):
    from terrasift.streaming.sightings import windowed

    schema = "ts timestamp, event_type string, value double"
    for k, stamps in enumerate((["2024-01-10 01:00:00", "2024-01-10 02:00:00"], ["2024-01-13 01:00:00"], ["2024-01-10 03:00:00", "2024-01-13 02:00:00"])):
        spark.createDataFrame([(s, "seen", 1.0) for s in stamps], "s string, event_type string, value double").select(F.col("s").cast("timestamp").alias("ts"), "event_type", "value").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        q = windowed(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = [(str(r.window.start)[:10], r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert got == [("2024-01-10", 2)]  # the late third sighting isn't counted


def test_hulls_hold_their_points(spark):
    from terrasift.plans import clusters

    hulls, points = {}, {}
    for r in sorted(registry.queries()["convex_hulls"](spark, SF.replace("0.001", "0.01")).collect(), key=lambda r: r.pos):
        hulls.setdefault(r.label, []).append((r.x, r.y))
    for r in clusters.clusters(spark, SF.replace("0.001", "0.01")).filter("label <> -1").collect():
        points.setdefault(r.label, []).append((r.x, r.y))
    assert set(hulls) == set(points)
    for label, ring in hulls.items():
        assert set(ring) <= set(points[label])
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            assert len(ring) < 3 or all((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) >= -1e-9 for x, y in points[label])
