"""Queries on details: plausibility rules, templates, diagnostics, per-band densities, bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F


from ..functions import geo as G
from ..functions import text as T
from ..operators import cluster as C
from ..operators import density as D
from . import views as V
from .base import Registry
from .clusters import XY, xy
from .narratives import N, narratives
from .zones import RANKED

query = Registry()
QUERIES, SQL = query.queries, query.sql

# Names that belong to one region only.
NOVA = ["franconia", "springfield", "tysons", "dulles", "reston", "herndon", "fairfax", "vienna", "dunn loring", "west falls church", "east falls church", "crystal city", "pentagon", "rosslyn", "clarendon", "ballston", "virginia square", "dulles toll road", "franconiaspringfield", "nokes"]
TIDEWATER = ["norfolk", "virginia beach", "portsmouth", "suffolk", "chesapeake", "newport news", "hampton", "williamsburg", "newport", "hampton"]
WESTERN = ["natural bridge", "high bridge", "shenandoah", "mudlick", "stone road", "hawkins mill", "riverside", "valley", "mudlickrd", "riversidedr", "shenandoah ave", "stone roadhawkins mill"]

_ROADS = ["I-95", "I-85", "I-64", "I-81", "I-66", "I-395", "US-29", "VA-7", "Dulles Toll Road", "Norfolk Ave", "Shenandoah Ave", "Main St"]
_REGION = "CASE WHEN lat > 38.5 AND lon > -78.0 THEN 'Northern Virginia' WHEN lat < 37.5 AND lon > -77.0 THEN 'Tidewater' WHEN lat > 37.0 AND lat < 38.5 AND lon > -78.5 AND lon < -77.0 THEN 'Central Virginia' ELSE 'other' END"


def region(lat, lon):
    return (
        F.when((lat > 38.5) & (lon > -78.0), "Northern Virginia").when((lat < 37.5) & (lon > -77.0), "Tidewater")
        .when((lat > 37.0) & (lat < 38.5) & (lon > -78.5) & (lon < -77.0), "Central Virginia").otherwise("other")
    )


def names_any(column, words):
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(column, w))


@query("points", f"""r AS (SELECT pid, lat, lon, {_REGION} AS region, lower({_ROADS!r}[pid % {len(_ROADS)} + 1]) AS road FROM points),
j AS (SELECT *, CASE WHEN road LIKE '%i-95%' THEN lon > -78.5 WHEN road LIKE '%i-85%' THEN lon < -79.0 WHEN road LIKE '%i-64%' THEN true WHEN road LIKE '%i-81%' THEN lon < -79.0 AND lat < 39.0 WHEN road LIKE '%i-66%' OR road LIKE '%i-395%' OR road LIKE '%i-495%' THEN region = 'Northern Virginia' ELSE true END AS fits,
  len(list_filter({NOVA!r}, lambda w: contains(road, w))) > 0 AS nova, len(list_filter({TIDEWATER!r}, lambda w: contains(road, w))) > 0 AS tide, len(list_filter({WESTERN!r}, lambda w: contains(road, w))) > 0 AS west FROM r)
SELECT pid, region, fits, CASE region WHEN 'Central Virginia' THEN nova OR tide OR west OR contains(road, 'i-85') WHEN 'Northern Virginia' THEN west OR tide OR contains(road, 'i-81') WHEN 'Tidewater' THEN nova OR west ELSE false END AS wrong FROM j""")
def road_plausibility(spark, sf):
    road = F.lower(F.element_at(F.array(*[F.lit(x) for x in _ROADS]), (F.col("pid") % len(_ROADS) + 1).cast("int")))
    lat, lon, r = F.col("lat"), F.col("lon"), F.col("road")
    p = V.points(spark, sf).withColumn("road", road).withColumn("region", region(lat, lon))
    has = lambda w: F.contains(r, F.lit(w))
    home = F.col("region") == "Northern Virginia"
    fits = F.when(has("i-95"), lon > -78.5).when(has("i-85"), lon < -79.0).when(has("i-64"), True).when(has("i-81"), (lon < -79.0) & (lat < 39.0)).when(has("i-66") | has("i-395") | has("i-495"), home).otherwise(True)
    nova, tide, west = (names_any(r, w) for w in (NOVA, TIDEWATER, WESTERN))
    wrong = F.when(F.col("region") == "Central Virginia", nova | tide | west | has("i-85")).when(home, west | tide | has("i-81")).when(F.col("region") == "Tidewater", nova | west).otherwise(False)
    return p.select("pid", "region", fits.alias("fits"), wrong.alias("wrong"))


@query("cases", "p AS (SELECT case_id, ['cases/a.json', 'gazetteer/b.json', 'x/c.json', 'roads/d.json'][case_id % 4 + 1] AS path, ['{\"case_id\": 1}', '{\"entries\": []}', '{\"localNames\": []}'][case_id % 3 + 1] AS body FROM cases) SELECT case_id, CASE WHEN path LIKE 'cases/%' THEN 'case' WHEN path LIKE 'gazetteer/%' THEN 'gazetteer' WHEN path LIKE 'roads/%' THEN 'road' WHEN contains(body, 'case_id') THEN 'case' WHEN contains(body, 'entries') THEN 'gazetteer' WHEN contains(body, 'localNames') THEN 'road' ELSE 'unknown' END AS kind FROM p")
def schema_kind(spark, sf):
    """By path first, then by the keys of the document."""
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("case_id") % len(xs) + 1).cast("int"))
    p = V.cases(spark, sf).select("case_id", pick(["cases/a.json", "gazetteer/b.json", "x/c.json", "roads/d.json"]).alias("path"), F.json_object_keys(pick(['{"case_id": 1}', '{"entries": []}', '{"localNames": []}'])).alias("k"))
    out = F.lit("unknown")
    for key, kind in reversed([("case_id", "case"), ("entries", "gazetteer"), ("localNames", "road")]):
        out = F.when(F.array_contains("k", key), kind).otherwise(out)
    for folder, kind in reversed([("cases/", "case"), ("gazetteer/", "gazetteer"), ("roads/", "road")]):
        out = F.when(F.startswith("path", F.lit(folder)), kind).otherwise(out)
    return p.select("case_id", out.alias("kind"))


@query("cases", "s AS (SELECT case_id, CASE WHEN case_id % 3 = 0 THEN lat END AS a, CASE WHEN case_id % 3 = 1 THEN lat END AS b, lat AS c FROM cases) SELECT case_id, coalesce(a, b, c) IS NOT NULL AS seeded, CASE WHEN a IS NOT NULL THEN 'spatial' WHEN b IS NOT NULL THEN 'last_seen' WHEN c IS NOT NULL THEN 'provenance' ELSE 'none' END AS origin FROM s")
def seed_presence(spark, sf):
    k, lat = F.col("case_id") % 3, F.col("lat")
    a, b = F.when(k == 0, lat), F.when(k == 1, lat)
    return V.cases(spark, sf).select("case_id", F.coalesce(a, b, lat).isNotNull().alias("seeded"), F.when(a.isNotNull(), "spatial").when(b.isNotNull(), "last_seen").when(lat.isNotNull(), "provenance").otherwise("none").alias("origin"))


@query("cases", N + ", s AS (SELECT case_id, coalesce(city, 'Unknown') AS city, text FROM n) SELECT case_id, 'Case ' || case_id || ' in ' || city || ': ' || CASE WHEN length(text) > 60 THEN substr(text, 1, 57) || '...' ELSE text END AS line FROM s")
def narrative_lines(spark, sf):
    t = F.col("text")
    short = F.when(F.length(t) > 60, F.concat(F.substring(t, 1, 57), F.lit("..."))).otherwise(t)
    return narratives(spark, sf).select("case_id", F.concat(F.lit("Case "), F.col("case_id").cast("string"), F.lit(" in "), F.coalesce("city", F.lit("Unknown")), F.lit(": "), short).alias("line"))


@query("", "SELECT p_partkey, lower(trim(p_brand || ' ' || p_name)) AS vehicle FROM part")
def vehicles_folded(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", T.fold_vehicle(F.col("p_name"), F.lit(None).cast("string"), F.col("p_brand")).alias("vehicle"))


@query("", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'public transit' WHEN 1 THEN 'unknown' WHEN 2 THEN 'walking' ELSE 'driving' END AS movement FROM part")
def movement_classes(spark, sf):
    names = F.element_at(F.array(F.lit(" Metro"), F.lit("teleport"), F.lit("WALKING"), F.lit("driving")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", T.movement_class(names).alias("movement"))


@query("", "SELECT c_custkey, [c_mktsegment, n] AS names FROM (SELECT c_custkey, c_mktsegment, c_name AS n FROM customer)")
def names_distinct(spark, sf):
    names = F.array("c_mktsegment", F.lower("c_mktsegment"), "c_name", F.upper("c_name"))
    return V.table(spark, sf, "customer").select("c_custkey", T.distinct_folded(names).alias("names"))


@query("cases", "SELECT round(avg(abs(minutes)) / 60.0, 6) AS time_mae_hours, round(avg(CASE WHEN lat IS NOT NULL AND lon IS NOT NULL AND lat < 90 THEN " + V.miles_sql("lat", "lon", "(lat + 0.01)", "lon") + " END), 6) AS geocode_mae_miles, round(avg((county IS NOT NULL)::INT), 6) AS county_accuracy FROM cases")
def extraction_errors(spark, sf):
    c = F.col
    d = F.when(c("lat").isNotNull() & c("lon").isNotNull() & (c("lat") < 90), G.haversine(c("lat"), c("lon"), c("lat") + 0.01, c("lon")))
    return V.cases(spark, sf).agg(F.round(F.avg(F.abs("minutes")) / 60.0, 6).alias("time_mae_hours"), F.round(F.avg(d), 6).alias("geocode_mae_miles"), F.round(F.avg(c("county").isNotNull().cast("int")), 6).alias("county_accuracy"))


@query("zones truth", "SELECT label, status, count(*) AS n FROM truth GROUP BY label, status")
def run_summary(spark, sf):
    return V.truth(spark, sf).groupBy("label", "status").agg(F.count(F.lit(1)).alias("n"))


@query("", "WITH k AS (SELECT DISTINCT unnest(json_keys(props)) AS key FROM (SELECT props FROM events ORDER BY event_id LIMIT 20)) SELECT (SELECT count(*) FROM events) AS n_rows, (SELECT list_sort(list(key)) FROM k) AS keys, (SELECT bool_or(value > 100) FROM events) AS any_large")
def diagnostics(spark, sf):
    e = V.table(spark, sf, "events")
    k = e.orderBy("event_id").limit(20).select(F.explode(F.json_object_keys("props")).alias("key")).agg(F.array_sort(F.collect_set("key")).alias("keys"))
    return e.agg(F.count(F.lit(1)).alias("n_rows"), F.bool_or(F.col("value") > 100).alias("any_large")).crossJoin(k)


@query("stations", XY + ", b AS (SELECT id % 2 AS band, x, y FROM xy), t AS (SELECT band, count(*) AS n FROM b GROUP BY band), k AS (SELECT p.id, b.band, sum(exp(-(pow(p.x - b.x, 2.0) + pow(p.y - b.y, 2.0)) / 800.0::DOUBLE)) AS s FROM xy p, b WHERE pow(p.x - b.x, 2.0) + pow(p.y - b.y, 2.0) <= 10000.0 GROUP BY p.id, b.band) SELECT id AS cell_id, k.band, round(s / (n * 2.0::DOUBLE * pi() * 400.0), 10) AS density FROM k JOIN t ON t.band = k.band")
def kde_by_band(spark, sf):
    """One density for each band, at the points themselves."""
    p = xy(spark, sf)
    at = p.select(F.col("id").alias("cell_id"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    frames = [D.kde_points(p.filter(F.col("id") % 2 == b), at, 20.0).withColumn("band", F.lit(b).cast("long")) for b in (0, 1)]
    return frames[0].unionByName(frames[1]).filter("density > 0").select("cell_id", "band", F.round("density", 10).alias("density"))


@query("stations", XY + ", k AS (SELECT p.id, sum(exp(-(pow(p.x - q.x, 2.0) + pow(p.y - q.y, 2.0)) / 800.0::DOUBLE)) FILTER (pow(p.x - q.x, 2.0) + pow(p.y - q.y, 2.0) <= 10000.0) AS s FROM xy p, xy q GROUP BY p.id), m AS (SELECT id, round(s / max(s) OVER (), 9) AS score FROM k) SELECT id, round(score, 6) AS score FROM m WHERE score >= 0.5")
def density_peaks(spark, sf):
    p = xy(spark, sf)
    d = D.kde_points(p, p.select(F.col("id").alias("cell_id"), F.col("x").alias("cx"), F.col("y").alias("cy")), 20.0)
    top = d.agg(F.max("density").alias("m"))
    return d.crossJoin(F.broadcast(top)).withColumn("score", F.round(F.col("density") / F.col("m"), 9)).filter("score >= 0.5").select(F.col("cell_id").alias("id"), F.round("score", 6).alias("score"))


@query("grid", """m AS (SELECT cell_id, ix, iy FROM grid WHERE (cell_id * 7919) % 13 >= 6), e AS (SELECT a.cell_id AS a, b.cell_id AS b FROM m a JOIN m b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1), r AS (SELECT cell_id AS a, cell_id AS b FROM m UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), l AS (SELECT a AS cell_id, min(b) AS label FROM r GROUP BY a)
SELECT label, count(*) AS n_cells, min(ix) AS ix1, max(ix) AS ix2, min(iy) AS iy1, max(iy) AS iy2 FROM l JOIN grid USING (cell_id) GROUP BY label""")
def iso_components(spark, sf):
    """Connected areas of masked cells (four neighbours) with their boxes."""
    m = V.grid(spark).filter((F.col("cell_id") * 7919) % 13 >= 6).select(F.col("cell_id").alias("id"), "ix", "iy")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (0, 1))]))
    n = m.select(F.col("id").alias("a"), "ix", "iy", step.alias("s")).select("a", (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"))
    e = n.join(m.withColumnRenamed("id", "b"), ["ix", "iy"]).select("a", "b")
    return m.join(C.components(m.select("id"), e), "id").groupBy("label").agg(F.count(F.lit(1)).alias("n_cells"), *[f(c).alias(f"{c}{k}") for c in ("ix", "iy") for k, f in ((1, F.min), (2, F.max))])


@query("stations", XY + ", i AS (SELECT it, id, x FROM xy, range(3) t(it) WHERE (id * 31 + it * 17) % 100 < 85), p AS (SELECT a.it AS a, b.it AS b, count(*) AS common FROM i a JOIN i b ON a.id = b.id AND a.it < b.it GROUP BY 1, 2) SELECT a, b, common FROM p")
def bootstrap_overlaps(spark, sf):
    """Rows that two seeded samples share, for all pairs of samples."""
    i = xy(spark, sf).crossJoin(F.broadcast(spark.range(3).withColumnRenamed("id", "it"))).filter((F.col("id") * 31 + F.col("it") * 17) % 100 < 85)
    a, b = i.select("id", F.col("it").alias("a")), i.select("id", F.col("it").alias("b"))
    return a.join(b, "id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))


@query("zones truth", RANKED + ", s AS (SELECT case_id, string_agg(format('{:d}:{:.1f}', r, radius), ' ' ORDER BY r) AS report FROM ranked WHERE r <= 3 GROUP BY case_id) SELECT case_id, report FROM s")
def zone_report(spark, sf):
    from ..operators.zones import ranked

    r = ranked(V.zones(spark, sf), V.truth(spark, sf)).filter("r <= 3").select("case_id", F.struct("r", F.format_string("%d:%.1f", "r", "radius").alias("t")).alias("x"))
    return r.groupBy("case_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("report"))


@query("zones", "p AS (SELECT case_id, (lat, lon) AS c, max(priority) AS m FROM zones GROUP BY case_id, lat, lon) SELECT case_id, count(*) AS n_places, round(sum(m), 6) AS total FROM p GROUP BY case_id HAVING count(*) >= 5")
def zone_places(spark, sf):
    p = V.zones(spark, sf).groupBy("case_id", "lat", "lon").agg(F.max("priority").alias("m"))
    return p.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_places"), F.round(F.sum("m"), 6).alias("total")).filter("n_places >= 5")


@query("cases", "SELECT case_id, round(exp(-ln(2.0) / [24.0, 48.0, 12.0][case_id % 3 + 1] * (case_id % 72)), 8) AS survival, round(abs(37.5 - lat) * 69.0::DOUBLE + abs(-78.0 - lon) * 54.6::DOUBLE, 5) AS manhattan, round(1.0::DOUBLE / 69.0 * 5.0, 8) AS degrees FROM cases")
def survival_and_manhattan(spark, sf):
    half = F.element_at(F.array(F.lit(24.0), F.lit(48.0), F.lit(12.0)), (F.col("case_id") % 3 + 1).cast("int"))
    s = F.exp(-F.ln(F.lit(2.0)) / F.greatest(half, F.lit(1e-6)) * (F.col("case_id") % 72))
    return V.cases(spark, sf).select("case_id", F.round(s, 8).alias("survival"), F.round(G.manhattan(37.5, -78.0, F.col("lat"), F.col("lon")), 5).alias("manhattan"), F.round(G.miles_to_degrees(5.0, 37.5)[0], 8).alias("degrees"))


@query("sightings", "s AS (SELECT case_id, sid, t_hr, row_number() OVER (PARTITION BY case_id ORDER BY t_hr, sid) AS k FROM sightings) SELECT case_id, max(k) AS n, round(max(t_hr), 6) AS last_hr, count(*) FILTER (t_hr >= 0 AND t_hr < 24) AS first_day FROM s GROUP BY case_id")
def sighting_profile(spark, sf):
    return V.sightings(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("t_hr"), 6).alias("last_hr"), F.count_if((F.col("t_hr") >= 0) & (F.col("t_hr") < 24)).alias("first_day"))


@query("cases windows", "s AS (SELECT case_id, win, w, unnest(range((case_id * 7 + win) % 3)) AS k FROM cases, windows) SELECT case_id, win, k, round(least(0.9::DOUBLE, 0.3::DOUBLE + 0.4::DOUBLE * w + ((case_id * 13 + k) % 21 - 10)::DOUBLE / 100.0), 6) AS confidence FROM s")
def follow_up_sightings(spark, sf):
    """None to two for each case and window."""
    n = (F.col("case_id") * 7 + F.col("win")) % 3
    s = V.cases(spark, sf).select("case_id").crossJoin(F.broadcast(V.windows(spark))).filter(n > 0).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    u = ((F.col("case_id") * 13 + F.col("k")) % 21 - 10).cast("double") / F.lit(100.0)
    return s.select("case_id", "win", "k", F.round(F.least(F.lit(0.9), F.lit(0.3) + F.lit(0.4) * F.col("w") + u), 6).alias("confidence"))


@query("places", "p AS (SELECT place_id, brand, lat, CASE WHEN place_id % 10 < 7 THEN 0 ELSE 1 END AS pref FROM places) SELECT brand, arg_min(place_id, (pref, (place_id * 7919) % 10007, place_id)) AS place_id FROM p GROUP BY brand")
def realistic_location(spark, sf):
    """A place for each brand: the preferred kind first, then by a fixed draw."""
    k = F.col("place_id")
    x = F.struct(F.when(k % 10 < 7, 0).otherwise(1).alias("p"), ((k * 7919) % 10007).alias("u"), k.alias("id"))
    return V.places(spark, sf).groupBy("brand").agg(F.min(x)["id"].alias("place_id"))
