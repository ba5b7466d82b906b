"""Sources and sinks: tables are written as the planning files are, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings
from ..sources import readers as R
from ..storage import scratch
from . import views as V
from .base import Registry
from .spatial import HORIZON, MASS, forecast_states, sector_mass_frame

query = Registry()
QUERIES, SQL = query.queries, query.sql


def nested(spark, sf):
    """Cases as nested documents, as the generator writes them."""
    c = V.cases(spark, sf)
    spatial = F.struct(F.col("city").alias("last_seen_city"), F.col("county").alias("last_seen_county"), F.col("state").alias("last_seen_state"), F.col("lat").alias("last_seen_lat"), F.col("lon").alias("last_seen_lon"))
    found = F.struct(F.when(F.col("case_id") % 4 == 0, F.col("lat") + 0.5).alias("recovery_lat"), F.when(F.col("case_id") % 4 == 0, F.col("lon") + 0.5).alias("recovery_lon"))
    return c.select(F.col("case_id").cast("string").alias("case_id"), F.struct(F.col("age").cast("double").alias("age_years"), "gender").alias("demographic"), spatial.alias("spatial"), found.alias("outcome"))


@query("cases", "SELECT case_id::VARCHAR AS case_id, age::DOUBLE AS age, city, county, lat, lon, false AS bad FROM cases")
def case_files(spark, sf):
    """Case documents, a line each, written and scanned."""
    path = scratch(spark)
    R.write_json(nested(spark, sf), path)
    return R.cases(spark, path).select("case_id", F.col("demographic.age_years").alias("age"), F.col("spatial.last_seen_city").alias("city"), F.col("spatial.last_seen_county").alias("county"), F.col("spatial.last_seen_lat").alias("lat"), F.col("spatial.last_seen_lon").alias("lon"), "bad")


@query("cases", "SELECT case_id::VARCHAR AS case_id, lat, lon FROM cases WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def case_coordinate_files(spark, sf):
    path = scratch(spark)
    R.write_json(nested(spark, sf), path)
    return R.case_coordinates(spark, path)


@query("cases", "SELECT count(*) AS n, round(sum(lat), 6) AS lat, round(sum(lon), 6) AS lon FROM cases WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def point_files(spark, sf):
    """Flat and nested coordinates in one folder."""
    path = scratch(spark)
    c = nested(spark, sf)
    R.write_json(c.filter("case_id % 2 = 0").select("spatial"), f"{path}/a")
    R.write_json(c.filter("case_id % 2 = 1").select(F.col("spatial.last_seen_lat").alias("lat"), F.col("spatial.last_seen_lon").alias("lon")), f"{path}/b")
    return R.points(spark, f"{path}/*").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("lat"), 6).alias("lat"), F.round(F.sum("lon"), 6).alias("lon"))


@query("cases", "SELECT case_id, age, state, lat, lon FROM cases WHERE upper(state) = 'ASIA'")
def csv_case_files(spark, sf):
    path = scratch(spark)
    V.cases(spark, sf).select("case_id", "age", "state", "lat", "lon").write.csv(path, header=True)
    return settings.need_columns(R.csv_cases(spark, path, "case_id LONG, age INT, state STRING, lat DOUBLE, lon DOUBLE", "asia"), ["lat", "lon"])


@query("", "WITH l AS (SELECT doc_id, lang, source FROM documents) SELECT lang, max(doc_id) AS doc_id, count(*) AS n FROM l WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY lang")
def result_files(spark, sf):
    """Results in a JSON file; the last of a key stays, and rows without what is needed go."""
    path = scratch(spark)
    d = V.table(spark, sf, "documents").filter("lang IS NOT NULL").select("lang", "source", "doc_id")
    n = d.filter("source IS NOT NULL").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    R.write_json(d.repartition(1).sortWithinPartitions("doc_id"), path)
    return R.results(spark, path, "lang STRING, source STRING, doc_id LONG", "lang", "source").join(n, "lang").select("lang", "doc_id", "n")


@query("places", "SELECT lower(name) AS name, min(type) AS type, count(*) AS n FROM (SELECT lower(name) AS name, first(brand ORDER BY place_id) AS type FROM places GROUP BY lower(name)) GROUP BY lower(name)")
def gazetteer_files(spark, sf):
    """A gazetteer as a list of entries with aliases; the first of a name stays."""
    path = scratch(spark)
    p = V.places(spark, sf)
    e = p.orderBy("place_id").select("name", F.col("brand").alias("type"), "lat", "lon", "place_id")
    one = e.agg(F.array_sort(F.collect_list(F.struct("place_id", "name", "type", "lat", "lon"))).alias("entries"))
    one.select(F.to_json(F.struct("entries")).alias("value")).coalesce(1).write.text(path)
    return R.gazetteer(spark, path).groupBy("name").agg(F.min("type").alias("type"), F.count(F.lit(1)).alias("n"))


@query("sectors", "SELECT sector, lon1, lat1, lon2, lat2 FROM sectors")
def feature_files(spark, sf):
    """Sectors as polygon features of a GeoJSON file."""
    path = scratch(spark)
    s = V.sectors(spark)
    corner = lambda a, b: F.array(F.col(a), F.col(b))
    ring = F.array(corner("lon1", "lat1"), corner("lon2", "lat1"), corner("lon2", "lat2"), corner("lon1", "lat2"), corner("lon1", "lat1"))
    f = s.select(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("sector").alias("name")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry")).alias("f"))
    f.agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).coalesce(1).write.text(path)
    x = lambda k: F.transform("ring", lambda p: p[k])
    return R.features(spark, path).select(F.col("properties")["name"].alias("sector"), F.array_min(x(0)).alias("lon1"), F.array_min(x(1)).alias("lat1"), F.array_max(x(0)).alias("lon2"), F.array_max(x(1)).alias("lat2"))


@query("sectors", "SELECT 'line ' || sector AS line, 0 AS part, lon1 AS x1, lat1 AS y1, lon2 AS x2, lat1 AS y2 FROM sectors UNION ALL SELECT 'line ' || sector, 1, lon2, lat1, lon2, lat2 FROM sectors")
def corridor_files(spark, sf):
    """Lines of a GeoJSON file as segments."""
    path = scratch(spark)
    s = V.sectors(spark)
    way = F.array(F.array("lon1", "lat1"), F.array("lon2", "lat1"), F.array("lon2", "lat2"))
    f = s.select(F.struct(F.struct(F.concat(F.lit("line "), F.col("sector")).alias("name")).alias("properties"), F.struct(F.lit("LineString").alias("type"), way.alias("coordinates")).alias("geometry")).alias("f"))
    f.agg(F.collect_list("f").alias("features")).select(F.to_json(F.struct("features")).alias("value")).coalesce(1).write.text(path)
    return R.corridors(spark, path)


@query("hotspots", "SELECT lon, lat, weight, radius AS radius_miles FROM hotspots")
def hotspot_files(spark, sf):
    path = scratch(spark)
    R.write_document(V.hotspots(spark, sf).select("lon", "lat", "weight", F.col("radius").alias("radius_miles")), path)
    return R.hotspots(spark, path)


@query("zones", "SELECT case_id::VARCHAR AS case_id, count(*) AS n, round(sum(priority), 6) AS priority, round(max(radius), 6) AS radius FROM zones GROUP BY case_id")
def zone_files(spark, sf):
    """Zones of a case by window, written a case a line and scanned."""
    path = scratch(spark)
    z = V.zones(spark, sf).select("case_id", "win", F.struct("zone_id", F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon"), F.col("radius").alias("radius_miles"), "priority").alias("z"))
    w = z.groupBy("case_id", "win").agg(F.collect_list("z").alias("zs")).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("win").cast("string"), "zs"))).alias("zones"))
    R.write_json(w.select(F.col("case_id").cast("string").alias("case_id"), "zones"), path, "r1")
    R.write_json(w.select(F.col("case_id").cast("string").alias("case_id"), "zones"), path, "r1")  # a repeat replaces the run's rows
    return R.zones(spark, path).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("priority"), 6).alias("priority"), F.round(F.max("radius_miles"), 6).alias("radius"))


@query("cases", "SELECT case_id::VARCHAR AS case_id, round(CASE WHEN case_id % 4 = 0 THEN lat + 0.5 ELSE lat END, 9) AS lat, round(CASE WHEN case_id % 4 = 0 THEN lon + 0.5 ELSE lon END, 9) AS lon FROM cases WHERE lat IS NOT NULL AND lon IS NOT NULL")
def ground_truth_files(spark, sf):
    """Where a case was found, else last seen, as one map, written and read."""
    path, out = scratch(spark), scratch(spark)
    R.write_json(nested(spark, sf), path)
    t = R.ground_truth(R.cases(spark, path))
    pairs = F.map_from_entries(F.collect_list(F.struct("case_id", F.struct("lat", "lon"))))
    t.agg(F.to_json(pairs).alias("value")).coalesce(1).write.text(out)
    return R.truth_map(spark, out).select("case_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("", "WITH a AS (SELECT DISTINCT lower(p_brand) AS v FROM part UNION SELECT DISTINCT lower(c_mktsegment) FROM customer) SELECT v AS low FROM a")
def findings_files(spark, sf):
    """Lists of several files as one, each value once whatever its case."""
    path = scratch(spark)
    p = V.table(spark, sf, "part").groupBy("p_size").agg(F.collect_list("p_brand").alias("tactics"), F.collect_list(F.upper("p_brand")).alias("cues"))
    c = V.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list("c_mktsegment").alias("cues"))
    R.write_json(p.drop("p_size"), f"{path}/a")
    R.write_json(c.drop("c_nationkey"), f"{path}/b")
    return R.findings(spark, f"{path}/*", ["tactics", "cues"]).select("low")


@query("", "SELECT risk, count(*) AS n FROM (SELECT c_mktsegment AS risk FROM customer UNION ALL SELECT o_orderpriority FROM orders) GROUP BY risk")
def training_files(spark, sf):
    """Two training sets, written as lines and read as one."""
    path = scratch(spark)
    R.write_json(V.table(spark, sf, "customer").select(F.col("c_name").alias("narrative"), F.col("c_mktsegment").alias("risk")), f"{path}/a")
    R.write_json(V.table(spark, sf, "orders").select(F.lit("x").alias("narrative"), F.col("o_orderpriority").alias("risk")), f"{path}/b")
    sets = [R.json_objects(spark, f"{path}/{k}").select(F.from_json("body", "narrative STRING, risk STRING").alias("d")).select("d.*") for k in "ab"]
    return sets[0].unionByName(sets[1]).groupBy("risk").agg(F.count(F.lit(1)).alias("n"))


@query("points sectors", MASS + " SELECT row_number() OVER (ORDER BY round(mass / t, 9) DESC, sector) AS rank, sector, round(mass / t, 6) AS share FROM mass, t")
def sector_csv(spark, sf):
    """Ranked sectors (a bounded list), written as CSV and read."""
    path = scratch(spark)
    s = sector_mass_frame(spark, sf).select("sector", F.round(F.col("mass") / F.col("t"), 9).alias("share"))
    R.write_sectors(s, path)
    return spark.read.csv(path, header=True, schema="sector STRING, share DOUBLE, rank LONG").select("rank", "sector", F.round("share", 6).alias("share"))


@query("plan sectors", HORIZON + ", w AS (SELECT hz, sector, m, m / sum(m) OVER (PARTITION BY hz) AS pct FROM a) SELECT hz AS horizon, sector, row_number() OVER (PARTITION BY hz ORDER BY round(m, 9) DESC, sector) AS rank, round(m, 7) AS mass, round(100.0::DOUBLE * pct, 5) AS mass_pct FROM w")
def horizon_csv(spark, sf):
    """Ranked sectors of each horizon with their share in per cent, written as CSV and read."""
    from pyspark.sql.window import Window

    path = scratch(spark)
    t = forecast_states(spark).join(V.plan(spark), "cell_id")
    on = (F.col("lon") > F.col("lon1")) & (F.col("lon") < F.col("lon2")) & (F.col("lat") > F.col("lat1")) & (F.col("lat") < F.col("lat2"))
    a = t.join(F.broadcast(V.sectors(spark)), on).groupBy("horizon", "sector").agg(F.sum("p").alias("m"))
    w = Window.partitionBy("horizon")  # a horizon's sectors are a bounded list
    out = a.select("horizon", "sector", F.row_number().over(w.orderBy(F.desc(F.round("m", 9)), "sector")).alias("rank"), F.round("m", 7).alias("mass"), F.round(F.col("m") / F.sum("m").over(w) * 100.0, 5).alias("mass_pct"))
    out.write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="horizon INT, sector STRING, rank LONG, mass DOUBLE, mass_pct DOUBLE")


@query("points sectors windows", MASS + " SELECT sector, round(mass / t, 6) AS share, (SELECT count(*) FROM windows) AS n_rings FROM mass, t")
def plan_files(spark, sf):
    """A search plan as one document of its (bounded) sector and ring rows, written and read."""
    path = scratch(spark)
    s = sector_mass_frame(spark, sf).select("sector", F.round(F.col("mass") / F.col("t"), 6).alias("share"))
    R.plan_document(s, V.windows(spark).select("win", "far")).coalesce(1).write.text(path)
    d = R.document(spark, path, "sectors ARRAY<STRUCT<sector: STRING, share: DOUBLE>>, rings ARRAY<STRUCT<win: BIGINT, far: DOUBLE>>")
    return d.select(F.size("rings").cast("long").alias("n_rings"), F.explode("sectors").alias("s")).select("s.sector", "s.share", "n_rings")


_SCHEMA = {"required": ["case_id", "demographic"], "properties": {"case_id": {"type": "string"}, "demographic": {"required": ["age_years", "gender"], "properties": {"age_years": {"type": "number", "minimum": 7, "maximum": 17}, "gender": {"enum": ["F", "m", "female", " Male "]}}}, "spatial": {"required": ["last_seen_county"], "properties": {"last_seen_lat": {"type": "number", "minimum": -90, "maximum": 90}}}}}


@query("cases", """SELECT case_id::VARCHAR AS case_id, list_filter([CASE WHEN age IS NULL THEN 'demographic.age_years: required' END, CASE WHEN gender IS NULL THEN 'demographic.gender: required' END, CASE WHEN age < 7 THEN 'demographic.age_years: minimum' END, CASE WHEN age > 17 THEN 'demographic.age_years: maximum' END,
CASE WHEN county IS NULL THEN 'spatial.last_seen_county: required' END, CASE WHEN lat < -90 THEN 'spatial.last_seen_lat: minimum' END, CASE WHEN lat > 90 THEN 'spatial.last_seen_lat: maximum' END], lambda x: x IS NOT NULL) AS issues FROM cases""")
def schema_issues(spark, sf):
    """Rules generated from a JSON schema, over documents."""
    rows = nested(spark, sf)
    return rows.select("case_id", settings.schema_issues(_SCHEMA, F.to_json(F.struct(*rows.columns))).alias("issues"))
