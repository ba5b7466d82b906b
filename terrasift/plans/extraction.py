"""Queries on extraction by rules: seeds from narratives, backfills, flags, summaries, labels, and their measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import density as D
from . import views as V
from .base import Registry
from .clusters import XY, xy
from .narratives import N, narratives

query = Registry()
QUERIES, SQL = query.queries, query.sql

# Names of places that tell a station's region, and what may not stand outside of it.
NORTHERN = ["franconia", "springfield", "tysons", "dulles", "reston", "herndon", "fairfax", "vienna", "dunn loring", "west falls church", "east falls church", "crystal city", "pentagon", "rosslyn", "clarendon", "ballston", "virginia square"]
COASTAL = ["norfolk", "virginia beach", "portsmouth", "suffolk", "chesapeake", "newport news", "hampton", "williamsburg"]
_STOPS = ["Tysons Corner", "Norfolk Pier", "Hampton Road", "Main Street", "Pentagon City", "Suffolk Gate"]


@query("stations", f"""s AS (SELECT sid, lat - 0.4 + (sid % 5) * 0.4 AS lat, lon + (sid % 3) * 0.6 AS lon, lower({_STOPS!r}[sid % {len(_STOPS)} + 1]) AS name FROM stations),
r AS (SELECT *, CASE WHEN lat > 38.5 AND lon > -78.0 THEN 'north' WHEN lat < 37.5 AND lon > -77.0 THEN 'coast' WHEN lat > 37.0 AND lat < 38.5 AND lon > -78.5 AND lon < -77.0 THEN 'centre' ELSE 'other' END AS region, len(list_filter({NORTHERN!r}, lambda w: contains(name, w))) > 0 AS n, len(list_filter({COASTAL!r}, lambda w: contains(name, w))) > 0 AS c, len(list_filter({COASTAL[:3]!r}, lambda w: contains(name, w))) > 0 AS c3 FROM s)
SELECT sid, region, CASE region WHEN 'north' THEN true WHEN 'coast' THEN NOT n WHEN 'centre' THEN NOT (n OR c3) ELSE NOT (n OR c) END AS fits FROM r""")
def station_plausibility(spark, sf):
    """Whether a station's name may stand where the station is, by box and the names of other regions."""
    k = F.col("sid")
    name = F.lower(F.element_at(F.array(*[F.lit(x) for x in _STOPS]), (k % len(_STOPS) + 1).cast("int")))
    s = V.stations(spark, sf).select("sid", (F.col("lat") - 0.4 + (k % 5) * F.lit(0.4)).alias("lat"), (F.col("lon") + (k % 3) * F.lit(0.6)).alias("lon"), name.alias("name"))
    lat, lon = F.col("lat"), F.col("lon")
    region = F.when((lat > 38.5) & (lon > -78.0), "north").when((lat < 37.5) & (lon > -77.0), "coast").when((lat > 37.0) & (lat < 38.5) & (lon > -78.5) & (lon < -77.0), "centre").otherwise("other")
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("name", w))
    fits = F.when(F.col("region") == "north", True).when(F.col("region") == "coast", ~has(NORTHERN)).when(F.col("region") == "centre", ~(has(NORTHERN) | has(COASTAL[:3]))).otherwise(~(has(NORTHERN) | has(COASTAL)))
    return s.withColumn("region", region).select("sid", "region", fits.alias("fits"))


@query("cases", "SELECT case_id, CASE WHEN s IN ('Virginia', 'va', 'Va') THEN 'VA' ELSE s END AS state FROM (SELECT case_id, nullif(trim([' Virginia', 'va', 'Va ', 'Maryland', '', NULL][case_id % 6 + 1]), '') AS s FROM cases)")
def state_abbreviations(spark, sf):
    s = F.nullif(F.trim(F.element_at(F.array(F.lit(" Virginia"), F.lit("va"), F.lit("Va "), F.lit("Maryland"), F.lit(""), F.lit(None)), (F.col("case_id") % 6 + 1).cast("int"))), F.lit(""))
    return V.cases(spark, sf).select("case_id", T.state(s).alias("state"))


@query("cases", N + r""" SELECT case_id, nullif(regexp_extract(text, 'Missing Person: ([A-Za-z_0-9]+)', 1), '') AS name, nullif(regexp_extract(text, '(\d{1,2})-year-old', 1), '')::INT AS age, CASE WHEN regexp_matches(text, '(?i)\bfemale\b') THEN 'F' WHEN regexp_matches(text, '(?i)\bmale\b') THEN 'M' END AS gender FROM n""")
def narrative_seed(spark, sf):
    """Name, age and gender from a narrative; the word female isn't taken for male."""
    return narratives(spark, sf).select("case_id", *[c.alias(n) for n, c in T.seed(F.col("text")).items()])


_FULL = "lower(text)"
FLAGS = r"""b AS (SELECT n.*, coalesce(age, 9) AS a, list_sort(list_distinct(regexp_extract_all(text, '\b(?:I-\d{1,3}|US-\d{1,3}|VA-\d{1,3})\b'))) AS cues FROM n),
flags AS (SELECT case_id, cues, list_sort(list_filter([CASE WHEN a <= 12 THEN 'minor_under_13' END, CASE WHEN contains(lower(text), 'vehicle') THEN 'involved_vehicle' END,
  CASE WHEN contains(lower(text), 'i-95') OR contains(lower(text), 'i-81') OR contains(lower(text), 'i-64') OR contains(lower(text), 'us-58') THEN 'interstate_corridor' END,
  CASE WHEN contains(lower(text), 'offered a ride') OR contains(lower(text), 'unknown adult') OR contains(lower(text), 'asking the child questions') THEN 'adult_engagement' END, CASE WHEN minutes >= 360 THEN 'delayed_report_6h_plus' END,
  CASE WHEN case_id % 3 > 0 THEN 'has_follow_up_sightings' END, CASE WHEN case_id % 4 = 0 THEN 'persons_of_interest_identified' END, CASE WHEN contains(lower(text), 'transit') OR contains(lower(text), 'bus') OR contains(lower(text), 'station') THEN 'transit_related' END,
  CASE WHEN case_id % 5 > 0 THEN 'has_search_zones' END, CASE WHEN case_id % 5 > 0 AND case_id % 10 > 7 THEN 'high_priority_search_zones' END], lambda x: x IS NOT NULL)) AS risk_factors FROM b)"""


@query("cases", N + ", " + FLAGS + " SELECT case_id, cues AS movement_cues, risk_factors FROM flags")
def backfilled_flags(spark, sf):
    """Highways named in the text, and the ten risk flags."""
    k = F.col("case_id")
    flags = T.risk_flags(F.coalesce("age", F.lit(9)), F.col("text"), F.col("minutes"), k % 3 > 0, k % 4 == 0, k % 5 > 0, (k % 5 > 0) & (k % 10 > 7))
    return narratives(spark, sf).select("case_id", F.array_sort(T.highways(F.col("text"))).alias("movement_cues"), flags.alias("risk_factors"))


@query("cases", N + r", s AS (SELECT *, nullif(regexp_extract(text, '(\d{1,2})-year-old', 1), '')::INT AS seed_age FROM n) SELECT case_id, coalesce(age, seed_age) AS age, CASE WHEN lower(coalesce(city, '')) IN ('', 'unknown') THEN 'Norfolk' ELSE city END AS city, coalesce(county, 'none') AS county, CASE WHEN upper(coalesce(gender, '')) LIKE 'F%' THEN 'F' WHEN upper(coalesce(gender, '')) LIKE 'M%' THEN 'M' END AS gender FROM s")
def merged_entities(spark, sf):
    """What is there stays; null, empty and Unknown are filled from the seed, then from defaults."""
    n = narratives(spark, sf)
    seed = T.seed(F.col("text"))
    given = F.upper(F.coalesce("gender", F.lit("")))
    gender = F.when(given.startswith("F"), "F").when(given.startswith("M"), "M")
    return n.select("case_id", F.coalesce(F.col("age"), seed["age"]).alias("age"), T.filled(F.col("city"), F.lit("Norfolk")).alias("city"), F.coalesce("county", F.lit("none")).alias("county"), gender.alias("gender"))


@query("", r"WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]?'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')[1:5] AS s FROM documents) SELECT doc_id, list_transform(s, lambda x: '• ' || x) AS bullets, len(s)::INT AS n FROM s")
def summary_bullets(spark, sf):
    """The first five sentences as bullets: the summary where no model is at hand."""
    b = T.first_sentences(F.coalesce("text", F.lit("")), 5)
    return V.table(spark, sf, "documents").select("doc_id", F.transform(b, lambda x: F.concat(F.lit("• "), x)).alias("bullets"), F.size(b).alias("n"))


@query("", r"WITH s AS (SELECT least(5, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?]+[.!?]?'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''))) AS n FROM documents) SELECT round(avg((n = 5)::INT), 6) AS bullet_accuracy FROM s")
def bullet_accuracy(spark, sf):
    b = F.size(T.first_sentences(F.coalesce("text", F.lit("")), 5))
    return V.table(spark, sf, "documents").agg(F.round(F.avg((b == 5).cast("int")), 6).alias("bullet_accuracy"))


@query("", "WITH l AS (SELECT p_partkey % 5 AS g, (p_partkey * 7 + p_size) % 5 AS p FROM part), d AS (SELECT g, p FROM range(5) a(g), range(5) b(p)), c AS (SELECT g, p, count(*) AS n FROM l GROUP BY g, p) SELECT d.g AS gold, d.p AS predicted, coalesce(n, 0) AS n, round((SELECT avg((g = p)::INT) FROM l), 6) AS accuracy FROM d LEFT JOIN c USING (g, p)")
def confusion_5x5(spark, sf):
    """All 25 cells, empty ones too, and the accuracy."""
    l = V.table(spark, sf, "part").select((F.col("p_partkey") % 5).alias("gold"), ((F.col("p_partkey") * 7 + F.col("p_size")) % 5).alias("predicted"))
    five = spark.range(5)
    d = five.select(F.col("id").alias("gold")).crossJoin(five.select(F.col("id").alias("predicted")))
    c = l.groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    a = l.agg(F.round(F.avg((F.col("gold") == F.col("predicted")).cast("int")), 6).alias("accuracy"))
    return d.join(c, ["gold", "predicted"], "left").crossJoin(a).select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"), "accuracy")


@query("", "WITH s AS (SELECT CASE WHEN p_size > 1 THEN p_size / 100.0::DOUBLE ELSE p_size::DOUBLE END AS s, (p_partkey % 2)::DOUBLE AS y FROM part) SELECT round(avg(pow(greatest(0.0, least(1.0, s)) - y, 2.0)), 6) AS brier FROM s")
def brier_clamped(spark, sf):
    """Scores beyond 1 are per cent; all are held within 0 and 1."""
    s = F.when(F.col("p_size") > 1, F.col("p_size") / 100.0).otherwise(F.col("p_size").cast("double"))
    return V.table(spark, sf, "part").agg(F.round(F.avg(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) - (F.col("p_partkey") % 2), F.lit(2.0))), 6).alias("brier"))


@query("zones", "z AS (SELECT case_id, pos, zone_id, CASE WHEN pos % 3 = 0 THEN priority END AS p, CASE WHEN pos % 3 = 1 THEN plaus END AS q, CASE WHEN pos % 4 = 0 THEN lat END AS c, lat AS d FROM zones) SELECT case_id, pos, zone_id, coalesce(p, q, CASE WHEN pos % 5 = 0 THEN 0.25::DOUBLE END, 0.0) AS score, coalesce(c, d) AS center FROM z")
def zone_precedence(spark, sf):
    """A zone's score is its priority, else the model's, else its score, else 0; its centre the nested one, else the flat one."""
    pos = F.col("pos")
    score = T.first_of(F.when(pos % 3 == 0, F.col("priority")), F.when(pos % 3 == 1, F.col("plaus")), F.when(pos % 5 == 0, F.lit(0.25)), F.lit(0.0))
    return V.zones(spark, sf).select("case_id", "pos", "zone_id", score.alias("score"), T.first_of(F.when(pos % 4 == 0, F.col("lat")), F.col("lat")).alias("center"))


@query("cases", N + ", m AS (SELECT case_id, lower(text) AS t, ['School zone', 'park', 'Residential', 'other'][case_id % 4 + 1] AS kind, 0.2::DOUBLE + 0.6::DOUBLE * ((case_id * 7919) % 10007)::DOUBLE / 10007.0 AS b FROM n) SELECT case_id, round(greatest(0.0, least(1.0, b + CASE WHEN contains(lower(kind), 'school') THEN 0.1 WHEN contains(lower(kind), 'park') THEN 0.05 WHEN contains(lower(kind), 'residential') THEN 0.15 ELSE 0.0 END::DOUBLE + CASE WHEN contains(t, 'school') THEN 0.1 ELSE 0.0 END::DOUBLE + CASE WHEN contains(t, 'park') THEN 0.05 ELSE 0.0 END::DOUBLE + CASE WHEN contains(t, 'home') OR contains(t, 'house') THEN 0.1 ELSE 0.0 END::DOUBLE)), 6) AS plausibility FROM m")
def mock_labels(spark, sf):
    """The stand-in labeler: a fixed draw, raised by the kind of zone and by words of the narrative, held within 0 and 1."""
    kind = F.element_at(F.array(F.lit("School zone"), F.lit("park"), F.lit("Residential"), F.lit("other")), (F.col("case_id") % 4 + 1).cast("int"))
    base = F.lit(0.2) + 0.6 * ((F.col("case_id") * 7919) % 10007).cast("double") / F.lit(10007.0)
    return narratives(spark, sf).select("case_id", F.round(T.mock_plausibility(base, kind, F.col("text")), 6).alias("plausibility"))


@query("zones", "p AS (SELECT case_id, coalesce(avg(plaus), 0.0) AS p FROM zones GROUP BY case_id), r AS (SELECT avg(((case_id * 37) % 101)::DOUBLE / 101.0) AS rouge FROM p) SELECT round((SELECT rouge FROM r), 6) AS mean_rouge, round(avg(p), 6) AS avg_plausibility, NULL::DOUBLE AS kl FROM p")
def performance_means(spark, sf):
    """Means over cases of what was measured for each; a measure that nothing fills is null."""
    p = V.zones(spark, sf).groupBy("case_id").agg(F.coalesce(F.avg("plaus"), F.lit(0.0)).alias("p"))
    rouge = ((F.col("case_id") * 37) % 101).cast("double") / F.lit(101.0)
    return p.agg(F.round(F.avg(rouge), 6).alias("mean_rouge"), F.round(F.avg("p"), 6).alias("avg_plausibility"), F.lit(None).cast("double").alias("kl"))


_DENS = XY + ", k AS (SELECT p.id, sum(exp(-(pow(p.x - q.x, 2.0) + pow(p.y - q.y, 2.0)) / 800.0::DOUBLE)) FILTER (pow(p.x - q.x, 2.0) + pow(p.y - q.y, 2.0) <= 10000.0) / ((SELECT count(*) FROM xy) * 2.0::DOUBLE * pi() * 400.0) AS d FROM xy p, xy q GROUP BY p.id)"


def own_density(spark, sf):
    p = xy(spark, sf)
    return D.kde_points(p, p.select(F.col("id").alias("cell_id"), F.col("x").alias("cx"), F.col("y").alias("cy")), 20.0)


@query("stations", _DENS + ", t AS (SELECT quantile_cont(d, 0.5) AS t FROM k) SELECT id, CASE WHEN round(d, 12) >= round(t, 12) THEN 0 ELSE -1 END AS label FROM k, t")
def density_labels(spark, sf):
    """0 where the density reaches the percentile that the share of mass asks for, -1 elsewhere."""
    d = own_density(spark, sf)
    t = d.agg(F.percentile("density", 0.5).alias("t"))
    return d.crossJoin(F.broadcast(t)).select(F.col("cell_id").alias("id"), F.when(F.round("density", 12) >= F.round("t", 12), 0).otherwise(-1).alias("label"))


@query("stations", _DENS + " SELECT id, round(d, 10) AS density FROM k ORDER BY round(d, 12) DESC, id LIMIT 5")
def hotspot_cut(spark, sf):
    """The first five by weight; only without a number would a least score decide."""
    return T.top_or_least(own_density(spark, sf).select(F.col("cell_id").alias("id"), "density"), "density", "id", 5, 0.5).withColumn("density", F.round("density", 10))


@query("zones", "d AS (SELECT case_id, win, count(*) AS n, count(*) - count(DISTINCT (lat, lon)) AS duplicates FROM zones GROUP BY case_id, win), p AS (SELECT a.case_id, a.win, count(*) AS near FROM zones a JOIN zones b ON a.case_id = b.case_id AND a.win = b.win AND (a.pos, a.zone_id) < (b.pos, b.zone_id) AND " + V.miles_sql("a.lat", "a.lon", "b.lat", "b.lon") + " < 60.0 GROUP BY 1, 2) SELECT case_id, win, n, duplicates, coalesce(near, 0) AS near FROM d LEFT JOIN p USING (case_id, win)")
def near_zone_pairs(spark, sf):
    """For each case and window how many zones stand where another does, and how many pairs are closer than 60 miles."""
    from ..functions.geo import haversine

    z = V.zones(spark, sf).select("case_id", "win", F.struct("pos", "zone_id", "lat", "lon").alias("z"))
    g = z.groupBy("case_id", "win").agg(F.array_sort(F.collect_list("z")).alias("zs"))  # a window's zones are a short list
    near = lambda a: F.size(F.filter("zs", lambda b: (F.struct(b["pos"], b["zone_id"]) > F.struct(a["pos"], a["zone_id"])) & (haversine(a["lat"], a["lon"], b["lat"], b["lon"]) < 60.0)))
    total = F.aggregate(F.transform("zs", near), F.lit(0).cast("long"), lambda x, y: x + y)
    places = F.size(F.array_distinct(F.transform("zs", lambda a: F.struct(a["lat"], a["lon"]))))
    return g.select("case_id", "win", F.size("zs").cast("long").alias("n"), (F.size("zs") - places).cast("long").alias("duplicates"), total.alias("near"))


@query("stations", XY + ", i AS (SELECT it, id, x FROM xy, range(5) t(it) WHERE (id * 31 + it * 17) % 100 < 85), p AS (SELECT a.it AS a, b.it AS b, count(*) AS c FROM i a JOIN i b ON a.id = b.id AND a.it < b.it GROUP BY 1, 2), s AS (SELECT it, count(*) AS n FROM i GROUP BY it), j AS (SELECT c / (s.n + t.n - c)::DOUBLE AS j FROM p JOIN s ON s.it = a JOIN s t ON t.it = b) SELECT round(avg(j), 6) AS mean, round(coalesce(stddev_pop(j), 0.0), 6) AS std FROM j")
def bootstrap_stability(spark, sf):
    """Mean and deviation of the Jaccard overlaps of seeded samples."""
    i = xy(spark, sf).crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "it"))).filter((F.col("id") * 31 + F.col("it") * 17) % 100 < 85)
    n = i.groupBy("it").agg(F.count(F.lit(1)).alias("n"))
    side = lambda c: n.select(F.col("it").alias(c), F.col("n").alias(f"n{c}"))
    p = i.select("id", F.col("it").alias("a")).join(i.select("id", F.col("it").alias("b")), "id").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    j = p.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b").select((F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("j"))
    return j.agg(F.round(F.avg("j"), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("j"), F.lit(0.0)), 6).alias("std"))
