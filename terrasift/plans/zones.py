"""Queries on zones: evaluation, rewards, re-ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import zones as Z
from . import views as V
from .base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

B = "(300.0::DOUBLE / 1609.34::DOUBLE)"
RANKED = f"""r0 AS (SELECT *, {V.miles_sql('lat', 'lon', 't_lat', 't_lon', 3958.8)} AS d FROM zones JOIN truth USING (case_id)),
ranked AS (SELECT *, d <= radius + {B} AS hit, row_number() OVER (PARTITION BY case_id ORDER BY priority DESC, pos, zone_id) AS r FROM r0)"""
BY_CASE = RANKED + """,
c AS (SELECT case_id, max((hit AND r <= 1)::INT) AS h1, max((hit AND r <= 3)::INT) AS h3, max((hit AND r <= 5)::INT) AS h5, max((hit AND r <= 10)::INT) AS h10,
  min(r) FILTER (hit) AS first, sum(CASE WHEN hit AND r <= 5 THEN 1.0::DOUBLE / log2(r + 1.0::DOUBLE) ELSE 0.0 END) AS dcg, min(d) FILTER (r = 1) AS d1, arg_min(d, r) FILTER (hit) AS d_hit, min(greatest(0.0, d - radius)) AS gap FROM ranked GROUP BY case_id)"""


def by_case(spark, sf):
    return Z.hits_by_case(Z.ranked(V.zones(spark, sf), V.truth(spark, sf)))


@query("zones truth", BY_CASE + " SELECT count(*) AS n_cases, round(avg(h1), 6) AS hit_at_1, round(avg(h3), 6) AS hit_at_3, round(avg(h5), 6) AS hit_at_5, round(avg(h10), 6) AS hit_at_10 FROM c")
def geo_hit_at_k(spark, sf):
    return by_case(spark, sf).agg(F.count(F.lit(1)).alias("n_cases"), *[F.round(F.avg(f"h{k}"), 6).alias(f"hit_at_{k}") for k in Z.KS])


@query("zones truth", BY_CASE + " SELECT round(avg(coalesce(1.0::DOUBLE / first, 0.0)), 6) AS mrr, round(avg(dcg), 6) AS dcg_at_5, round(avg(dcg / 2.948459118879392), 6) AS ndcg_at_5 FROM c")
def mrr_dcg(spark, sf):
    ideal = sum(1 / __import__("math").log2(i + 2) for i in range(5))
    return by_case(spark, sf).agg(F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("dcg"), 6).alias("dcg_at_5"), F.round(F.avg(F.col("dcg") / F.lit(ideal)), 6).alias("ndcg_at_5"))


@query("zones truth", BY_CASE + " SELECT round(median(d1), 6) AS median_top1_miles, round(median(d_hit), 6) AS median_first_hit_miles, round(median(gap), 6) AS median_gap_miles FROM c")
def median_first_hit(spark, sf):
    return by_case(spark, sf).agg(F.round(F.median("d1"), 6).alias("median_top1_miles"), F.round(F.median("d_hit"), 6).alias("median_first_hit_miles"), F.round(F.median("gap"), 6).alias("median_gap_miles"))


@query("zones truth", RANKED + """, s AS (SELECT *, sum(pi() * radius * radius * 2.589988110336) OVER (PARTITION BY case_id ORDER BY r ROWS UNBOUNDED PRECEDING) AS area FROM ranked),
f AS (SELECT case_id, arg_min(area, r) AS area FROM s WHERE hit GROUP BY case_id) SELECT count(*) AS n_hit, round(avg(area), 4) AS mean_area_km2, round(median(area), 4) AS median_area_km2 FROM f""")
def area_until_hit(spark, sf):
    rows = Z.ranked(V.zones(spark, sf), V.truth(spark, sf))
    w = Window.partitionBy("case_id").orderBy("r").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("area", F.sum(F.pi() * F.col("radius") * F.col("radius") * Z.KM2_A_MILE2).over(w)).filter("hit")
    first = rows.groupBy("case_id").agg(F.min_by("area", "r").alias("area"))
    return first.agg(F.count(F.lit(1)).alias("n_hit"), F.round(F.avg("area"), 4).alias("mean_area_km2"), F.round(F.median("area"), 4).alias("median_area_km2"))


@query("zones truth", RANKED + """, t AS (SELECT case_id, min(win) FILTER (hit) AS win FROM ranked GROUP BY case_id)
SELECT coalesce(['0-24', '24-48', '48-72'][win + 1], 'none') AS bucket, count(*) AS n, round(avg([12.0, 36.0, 60.0][win + 1]), 6)::DOUBLE AS mean_hours FROM t GROUP BY 1""")
def ttf_histogram(spark, sf):
    t = Z.ranked(V.zones(spark, sf), V.truth(spark, sf)).groupBy("case_id").agg(F.min(F.when(F.col("hit"), F.col("win"))).alias("win"))
    name = F.coalesce(F.try_element_at(F.array(F.lit("0-24"), F.lit("24-48"), F.lit("48-72")), (F.col("win") + 1).cast("int")), F.lit("none"))
    hours = F.try_element_at(F.array(F.lit(12.0), F.lit(36.0), F.lit(60.0)), (F.col("win") + 1).cast("int"))
    return t.groupBy(name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hours), 6).alias("mean_hours"))


RERANK = f""", z2 AS (SELECT * REPLACE (1.0::DOUBLE / (1.0::DOUBLE + exp(-3.0::DOUBLE * (0.6::DOUBLE * coalesce(priority, 0.5) + 0.8::DOUBLE * coalesce(plaus, 0.5) - 0.02::DOUBLE * radius + 0.0 - 0.5))) AS priority) FROM zones),
q0 AS (SELECT *, {V.miles_sql('lat', 'lon', 't_lat', 't_lon', 3958.8)} AS d FROM z2 JOIN truth USING (case_id)),
q1 AS (SELECT *, d <= radius + {B} AS hit, row_number() OVER (PARTITION BY case_id ORDER BY round(priority, 9) DESC, pos, zone_id) AS r FROM q0)"""


def reranked(spark, sf):
    z = V.zones(spark, sf)
    return z.withColumn("priority", F.round(Z.reweighted(F.col("priority"), F.col("plaus"), F.col("radius"), F.lit(None).cast("double")), 9))


@query("zones truth", RANKED + RERANK + """, a AS (SELECT k, avg(h) AS base FROM (SELECT case_id, k, max((hit AND r <= k)::INT) AS h FROM ranked, (VALUES (1), (3), (5), (10)) t(k) GROUP BY 1, 2) GROUP BY k),
b AS (SELECT k, avg(h) AS re FROM (SELECT case_id, k, max((hit AND r <= k)::INT) AS h FROM q1, (VALUES (1), (3), (5), (10)) t(k) GROUP BY 1, 2) GROUP BY k)
SELECT k, round(base, 6) AS baseline, round(re, 6) AS reranked, round(re - base, 6) AS improvement, round(CASE WHEN base > 0 THEN 100.0 * (re - base) / base END, 6)::DOUBLE AS improvement_pct FROM a JOIN b USING (k)""")
def hit_improvement(spark, sf):
    t = V.truth(spark, sf)
    wide = lambda z: Z.hits_by_case(Z.ranked(z, t)).agg(*[F.avg(f"h{k}").alias(f"h{k}") for k in Z.KS])
    long = lambda df, out: df.select(F.expr("stack(4, " + ", ".join(f"{k}, h{k}" for k in Z.KS) + f") AS (k, {out})"))
    j = long(wide(V.zones(spark, sf)), "base").join(long(wide(reranked(spark, sf)), "re"), "k")
    return j.select("k", F.round("base", 6).alias("baseline"), F.round("re", 6).alias("reranked"), F.round(F.col("re") - F.col("base"), 6).alias("improvement"), F.round(F.when(F.col("base") > 0, 100.0 * (F.col("re") - F.col("base")) / F.col("base")), 6).alias("improvement_pct"))


@query("zones truth", BY_CASE + """, m AS (SELECT avg((first IS NOT NULL)::INT) AS rate, avg(h5) AS h5, sum((first IS NULL)::INT) AS missed FROM c)
SELECT CASE WHEN h5 < 0.35 THEN 'red' WHEN h5 < 0.5 THEN 'yellow' ELSE 'green' END AS status, round(rate, 6) AS hit_rate, round(h5, 6) AS hit_at_5, missed::BIGINT AS missed,
list_filter([CASE WHEN h5 < 0.35 THEN 'low hit rate at 5' END, CASE WHEN missed > 0 THEN 'cases without a hit' END], lambda x: x IS NOT NULL) AS flags FROM m""")
def quality_dashboard(spark, sf):
    m = by_case(spark, sf).agg(F.avg(F.col("first").isNotNull().cast("int")).alias("rate"), F.avg("h5").alias("h5"), F.sum(F.col("first").isNull().cast("int")).alias("missed"))
    flags = F.array_compact(F.array(F.when(F.col("h5") < 0.35, "low hit rate at 5"), F.when(F.col("missed") > 0, "cases without a hit")))
    return m.select(F.when(F.col("h5") < 0.35, "red").when(F.col("h5") < 0.5, "yellow").otherwise("green").alias("status"), F.round("rate", 6).alias("hit_rate"), F.round("h5", 6).alias("hit_at_5"), F.col("missed").cast("long").alias("missed"), flags.alias("flags"))


SCORED = f"""s0 AS (SELECT *, {V.miles_sql('lat', 'lon', 't_lat', 't_lon', 3958.7613)} AS d FROM zones JOIN truth USING (case_id) JOIN windows USING (win)),
s1 AS (SELECT *, CASE WHEN t_hr >= ws AND t_hr < we AND d <= radius THEN t_hr END AS t_hit, 1.0::DOUBLE / (1.0::DOUBLE + greatest(0.0, d - radius)) AS ins FROM s0),
scored AS (SELECT *, 0.7::DOUBLE * ins + 0.3::DOUBLE * greatest(0.0, (we - coalesce(t_hit, we)) / greatest(1e-6, we - ws)) + CASE WHEN ins >= 0.85 THEN 0.1 ELSE 0.0 END + 0.05::DOUBLE - 0.2::DOUBLE * pow(radius / 50.0, 2.0) AS score FROM s1)"""
PAIRS = f"""p AS (SELECT a.case_id, a.win, a.radius AS r1, b.radius AS r2, {V.miles_sql('a.lat', 'a.lon', 'b.lat', 'b.lon', 3958.7613)} AS d FROM zones a JOIN zones b ON a.case_id = b.case_id AND a.win = b.win AND (a.pos, a.zone_id) < (b.pos, b.zone_id)),
o AS (SELECT case_id, win, avg(CASE WHEN d >= r1 + r2 THEN 0.0 WHEN d <= least(r1, r2) THEN 1.0 ELSE 1.0::DOUBLE - (d - least(r1, r2)) / greatest(1e-6, r1 + r2 - least(r1, r2)) END) AS overlap FROM p GROUP BY case_id, win)"""
REWARD = SCORED + ", " + PAIRS + """, e AS (SELECT *, exp(priority - max(priority) OVER (PARTITION BY case_id, win)) AS e, CASE WHEN t_hit IS NULL AND d > far THEN -0.2 ELSE 0.0 END::DOUBLE AS waste FROM scored),
g AS (SELECT case_id, win, sum(e) AS z, sum(e * score) AS s, sum(waste) AS waste, min(w) AS w FROM e GROUP BY case_id, win),
reward AS (SELECT case_id, win, w, s / (z + 1e-9::DOUBLE) - 0.1::DOUBLE * coalesce(overlap, 0.0) + waste AS reward FROM g LEFT JOIN o USING (case_id, win))"""


@query("zones truth windows", SCORED + " SELECT case_id, win, zone_id, round(d, 5) AS d, t_hit, round(score, 6) AS score FROM scored")
def zone_scores(spark, sf):
    s = Z.zone_scores(V.zones(spark, sf), V.truth(spark, sf), V.windows(spark))
    return s.select("case_id", "win", "zone_id", F.round("d", 5).alias("d"), "t_hit", F.round("score", 6).alias("score"))


@query("zones", PAIRS + " SELECT case_id, win, round(overlap, 6) AS overlap FROM o")
def zone_overlap(spark, sf):
    return Z.pair_overlaps(V.zones(spark, sf)).select("case_id", "win", F.round("overlap", 6).alias("overlap"))


@query("zones truth windows", REWARD + " SELECT case_id, win, round(reward, 6) AS reward FROM reward")
def window_reward(spark, sf):
    s = Z.zone_scores(V.zones(spark, sf), V.truth(spark, sf), V.windows(spark))
    return Z.window_rewards(s).select("case_id", "win", F.round("reward", 6).alias("reward"))


@query("zones truth windows", REWARD + " SELECT case_id, round(sum(w * reward), 6) AS episode FROM reward GROUP BY case_id")
def episode_reward(spark, sf):
    s = Z.zone_scores(V.zones(spark, sf), V.truth(spark, sf), V.windows(spark))
    return Z.window_rewards(s).groupBy("case_id").agg(F.round(F.sum(F.col("w") * F.col("reward")), 6).alias("episode"))


@query("zones", "SELECT case_id, zone_id, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-3.0::DOUBLE * (0.6::DOUBLE * priority + 0.8::DOUBLE * plaus - 0.02::DOUBLE * radius - 0.5))), 6) AS new_priority FROM zones")
def priority_reweight(spark, sf):
    return V.zones(spark, sf).select("case_id", "zone_id", F.round(Z.reweighted(F.col("priority"), F.col("plaus"), F.col("radius"), F.lit(0.0)), 6).alias("new_priority"))


RL = """n AS (SELECT *, min(priority) OVER w AS lo, max(priority) OVER w AS hi FROM zones WINDOW w AS (PARTITION BY case_id, win)),
lookup AS (SELECT case_id, zone_id, greatest(0.0, max(CASE WHEN hi = lo THEN 0.5 ELSE (priority - lo) / (hi - lo) END)) AS rl FROM n GROUP BY case_id, zone_id)"""


def rl_lookup_frame(spark, sf):
    w = Window.partitionBy("case_id", "win")
    z = V.zones(spark, sf).withColumn("norm", Z.minmax(F.col("priority"), w))
    return z.groupBy("case_id", "zone_id").agg(F.greatest(F.lit(0.0), F.max("norm")).alias("rl"))


@query("zones", RL + " SELECT case_id, zone_id, round(rl, 6) AS rl FROM lookup")
def rl_minmax_lookup(spark, sf):
    return rl_lookup_frame(spark, sf).select("case_id", "zone_id", F.round("rl", 6).alias("rl"))


@query("zones", RL + """ SELECT case_id, zone_id, pos, round(coalesce(rl, 0.0), 6) AS rl, round(1.0::DOUBLE / (1.0::DOUBLE + exp(-3.0::DOUBLE * (0.9::DOUBLE * priority + 0.1::DOUBLE * plaus - 0.02::DOUBLE * radius + 0.1::DOUBLE * coalesce(rl, 0.0) - 0.5))), 6) AS new_priority
FROM zones LEFT JOIN (SELECT * FROM lookup WHERE rl >= 0.5) USING (case_id, zone_id)""")
def rerank_with_lookup(spark, sf):
    found = rl_lookup_frame(spark, sf).filter("rl >= 0.5")
    z = V.zones(spark, sf).join(found, ["case_id", "zone_id"], "left")
    return z.select("case_id", "zone_id", "pos", F.round(F.coalesce("rl", F.lit(0.0)), 6).alias("rl"), F.round(Z.reweighted(F.col("priority"), F.col("plaus"), F.col("radius"), F.col("rl"), 0.9, 0.1, 0.02, 0.1), 6).alias("new_priority"))


@query("zones", """k AS (SELECT case_id, zone_id, pos, lat, lon, row_number() OVER (PARTITION BY case_id ORDER BY pos, zone_id) AS i FROM zones),
v AS (SELECT case_id, CASE WHEN (lat * 1000)::BIGINT % 2 = 0 THEN lat END AS lat, i FROM k) SELECT v.case_id, v.i, round(coalesce(v.lat, k.lat), 6) AS lat FROM v LEFT JOIN k ON v.case_id = k.case_id AND v.i = k.i""")
def positional_fill(spark, sf):
    w = Window.partitionBy("case_id").orderBy("pos", "zone_id")
    k = V.zones(spark, sf).select("case_id", F.row_number().over(w).cast("long").alias("i"), "lat")
    v = k.select("case_id", "i", F.when(F.round(F.col("lat") * 1000).cast("long") % 2 == 0, F.col("lat")).alias("own"))
    return v.join(k, ["case_id", "i"], "left").select("case_id", "i", F.round(F.coalesce("own", "lat"), 6).alias("lat"))


@query("zones", """k AS (SELECT *, row_number() OVER (PARTITION BY case_id, win ORDER BY priority DESC, pos, zone_id) AS r FROM zones), t AS (SELECT * FROM k WHERE r <= 3)
SELECT case_id, win, format('z{:02d}', r) AS zone, zone_id, round(CASE WHEN sum(priority) OVER (PARTITION BY case_id, win) > 0 THEN priority / sum(priority) OVER (PARTITION BY case_id, win) ELSE 0 END, 6)::DOUBLE AS share FROM t""")
def topk_zones(spark, sf):
    w, g = Window.partitionBy("case_id", "win").orderBy(F.desc("priority"), "pos", "zone_id"), Window.partitionBy("case_id", "win")
    t = V.zones(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 3")
    total = F.sum("priority").over(g)
    return t.select("case_id", "win", F.format_string("z%02d", "r").alias("zone"), "zone_id", F.round(F.when(total > 0, F.col("priority") / F.nullif(total, F.lit(0.0))).otherwise(0.0), 6).alias("share"))


@query("zones", """SELECT case_id, count(*) - count(DISTINCT (lat, lon)) AS duplicates FROM zones GROUP BY case_id HAVING count(*) > count(DISTINCT (lat, lon))""")
def duplicate_zones(spark, sf):
    g = V.zones(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lat", "lon").alias("u"))
    return g.filter("n > u").select("case_id", (F.col("n") - F.col("u")).alias("duplicates"))


@query("zones", """o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY priority DESC, pos, zone_id) AS r FROM zones),
k AS (SELECT case_id, r, lat, lon, [{'a': lat, 'o': lon}] AS kept, 1 AS n FROM o WHERE r = 1 UNION ALL
SELECT o.case_id, o.r, o.lat, o.lon, CASE WHEN len(list_filter(k.kept, lambda x: """ + V.miles_sql("x.a", "x.o", "o.lat", "o.lon", 3958.7613) + """ < 40.0)) = 0 THEN list_append(k.kept, {'a': o.lat, 'o': o.lon}) ELSE k.kept END, k.n FROM k JOIN o ON o.case_id = k.case_id AND o.r = k.r + 1)
SELECT case_id, max(r) AS n_zones, max(len(kept))::BIGINT AS n_kept FROM k GROUP BY case_id""")
def nms_zones(spark, sf):
    """Greedy suppression in priority order: a fold over each case's zones; the gap is 40 miles here, as zones are large."""
    from ..functions.geo import MILES_ZONES, haversine

    item = F.struct((-F.col("priority")).alias("p"), "pos", "zone_id", "lat", "lon")
    g = V.zones(spark, sf).groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("z"))
    pair = lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))
    start = F.expr("CAST(array() AS ARRAY<STRUCT<lat: DOUBLE, lon: DOUBLE>>)")
    fold = F.aggregate("z", start, lambda acc, x: F.when(F.exists(acc, lambda k: haversine(k["lat"], k["lon"], x["lat"], x["lon"], MILES_ZONES) < 40.0), acc).otherwise(F.concat(acc, F.array(pair(x)))))
    return g.select("case_id", F.size("z").cast("long").alias("n_zones"), F.size(fold).cast("long").alias("n_kept"))


@query("zones", "c AS (SELECT case_id, avg(plaus) AS m FROM zones GROUP BY case_id) SELECT count(*) AS n_cases, round(avg(m), 6) AS mean_of_means FROM c")
def plausibility_means(spark, sf):
    return V.zones(spark, sf).groupBy("case_id").agg(F.avg("plaus").alias("m")).agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg("m"), 6).alias("mean_of_means"))


@query("zones truth", "SELECT (SELECT count(*) FROM (SELECT DISTINCT case_id FROM zones WHERE win = 0 INTERSECT SELECT case_id FROM truth)) AS both_n, (SELECT count(*) FROM truth WHERE case_id NOT IN (SELECT case_id FROM zones WHERE win = 0)) AS only_truth, (SELECT count(*) FROM truth WHERE case_id IN (SELECT case_id FROM zones WHERE win = 0 AND radius > 40)) AS large")
def id_overlap(spark, sf):
    z, t = V.zones(spark, sf), V.truth(spark, sf)
    first = z.filter("win = 0").select("case_id")
    both = first.intersect(t.select("case_id")).agg(F.count(F.lit(1)).alias("both_n"))
    only = t.join(first, "case_id", "left_anti").agg(F.count(F.lit(1)).alias("only_truth"))
    large = t.join(z.filter("win = 0 AND radius > 40").select("case_id"), "case_id", "left_semi").agg(F.count(F.lit(1)).alias("large"))
    return both.crossJoin(only).crossJoin(large)  # one row each
