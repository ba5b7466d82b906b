"""Queries on clustering, densities of points, scaling and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo as G
from ..operators import cluster as C
from ..operators import density as D
from ..operators import joins as J
from ..storage import saved
from . import views as V
from .base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: A plane of stations in units of about a kilometre.
XY = "xy AS (SELECT sid AS id, round(lon * 88.0::DOUBLE, 6) AS x, round(lat * 111.0::DOUBLE, 6) AS y FROM stations)"


def xy(spark, sf):
    return V.stations(spark, sf).select(F.col("sid").alias("id"), F.round(F.col("lon") * 88.0, 6).alias("x"), F.round(F.col("lat") * 111.0, 6).alias("y"))


_NEAR = "pr AS (SELECT a.id AS a, b.id AS b FROM xy a JOIN xy b ON sqrt(pow(a.x - b.x, 2.0) + pow(a.y - b.y, 2.0)) <= 14.0)"
DB = XY + ", " + _NEAR + """, core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*) >= 4), ce AS (SELECT a, b FROM pr WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
rc AS (SELECT id AS a, id AS b FROM core UNION SELECT rc.a, ce.b FROM rc JOIN ce ON rc.b = ce.a), lb AS (SELECT a AS id, min(b) AS label FROM rc GROUP BY a),
bd AS (SELECT pr.a AS id, min(label) AS label FROM pr JOIN lb ON pr.b = lb.id GROUP BY pr.a), db AS (SELECT xy.id, x, y, coalesce(lb.label, bd.label, -1) AS label FROM xy LEFT JOIN lb USING (id) LEFT JOIN bd USING (id))"""


def clusters(spark, sf):
    p = xy(spark, sf)
    return p.join(C.dbscan(p, 14.0, 4), "id")


@query("stations", DB + " SELECT id, label FROM db")
def dbscan_labels(spark, sf):
    return clusters(spark, sf).select("id", "label")


@query("stations", DB + ", c AS (SELECT label, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM db WHERE label <> -1 GROUP BY label) SELECT label, n, round(n / (SELECT count(*) FROM db)::DOUBLE, 6) AS share, round(cx, 5) AS cx, round(cy, 5) AS cy, round(quantile_cont(sqrt(pow(x - cx, 2.0) + pow(y - cy, 2.0)), 0.75), 5) AS radius_p75 FROM db JOIN c USING (label) GROUP BY label, n, cx, cy")
def cluster_radius_p75(spark, sf):
    d = clusters(spark, sf)
    total = d.agg(F.count(F.lit(1)).alias("t"))
    c = d.filter("label <> -1").groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n"))
    r = F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)))
    g = d.join(F.broadcast(c), "label").groupBy("label", "n", "cx", "cy").agg(F.percentile(r, 0.75).alias("p"))
    return g.crossJoin(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), F.round("p", 5).alias("radius_p75"))


_LL = ", ".join(f"a{k} AS (SELECT xy.*, (SELECT arg_min(c, (round(pow(xy.x - cx, 2.0) + pow(xy.y - cy, 2.0), 9), c)) FROM c{k}) AS c FROM xy), c{k + 1} AS (SELECT c, avg(x) AS cx, avg(y) AS cy FROM a{k} GROUP BY c)" for k in range(3))
LLOYD = XY + ", c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, x AS cx, y AS cy FROM (SELECT * FROM xy ORDER BY id LIMIT 3)), " + _LL + ", a3 AS (SELECT xy.*, (SELECT arg_min(c, (round(pow(xy.x - cx, 2.0) + pow(xy.y - cy, 2.0), 9), c)) FROM c3) AS c FROM xy)"


@query("stations", LLOYD + " SELECT id, c::INT AS cluster FROM a3")
def kmeans_lloyd(spark, sf):
    return C.lloyd(xy(spark, sf), 3, 3)


@query("stations", LLOYD + """, d AS (SELECT p.id, p.c AS l, q.c AS m, avg(sqrt(pow(p.x - q.x, 2.0) + pow(p.y - q.y, 2.0))) AS d FROM a3 p JOIN a3 q ON p.id <> q.id GROUP BY 1, 2, 3),
s AS (SELECT id, l, min(d) FILTER (m = l) AS a, min(d) FILTER (m <> l) AS b FROM d GROUP BY id, l) SELECT round(avg(CASE WHEN a IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""")
def silhouette(spark, sf):
    p = xy(spark, sf)
    lab = p.join(C.lloyd(p, 3, 3).withColumnRenamed("cluster", "label"), "id")
    return C.silhouette(lab).select(F.round("silhouette", 6).alias("silhouette"))


@query("stations", LLOYD + """, c AS (SELECT c, avg(x) AS cx, avg(y) AS cy FROM a3 GROUP BY c), s AS (SELECT a3.c, avg(sqrt(pow(x - cx, 2.0) + pow(y - cy, 2.0))) AS s, min(cx) AS cx, min(cy) AS cy FROM a3 JOIN c USING (c) GROUP BY a3.c),
r AS (SELECT a.c, max((a.s + b.s) / sqrt(pow(a.cx - b.cx, 2.0) + pow(a.cy - b.cy, 2.0))) AS r FROM s a JOIN s b ON a.c <> b.c GROUP BY a.c) SELECT round(avg(r), 6) AS davies_bouldin FROM r""")
def davies_bouldin(spark, sf):
    p = xy(spark, sf)
    lab = p.join(C.lloyd(p, 3, 3), "id")
    c = lab.groupBy("cluster").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("y") - F.col("cy"), F.lit(2.0)))
    s = lab.join(F.broadcast(c), "cluster").groupBy("cluster", "cx", "cy").agg(F.avg(d).alias("s"))
    t = s.select(F.col("cluster").alias("k"), F.col("cx").alias("kx"), F.col("cy").alias("ky"), F.col("s").alias("ks"))
    gap = F.sqrt(F.pow(F.col("cx") - F.col("kx"), F.lit(2.0)) + F.pow(F.col("cy") - F.col("ky"), F.lit(2.0)))
    return s.join(F.broadcast(t), F.col("cluster") != F.col("k")).groupBy("cluster").agg(F.max((F.col("s") + F.col("ks")) / gap).alias("r")).agg(F.round(F.avg("r"), 6).alias("davies_bouldin"))


@query("stations", LLOYD + """, l AS (SELECT c AS a, id % 4 AS b FROM a3), n AS (SELECT a, b, count(*)::DOUBLE AS n FROM l GROUP BY a, b), x AS (SELECT sum(n * (n - 1) / 2) AS i FROM n), y AS (SELECT sum(s * (s - 1) / 2) AS i FROM (SELECT sum(n) AS s FROM n GROUP BY a)), z AS (SELECT sum(s * (s - 1) / 2) AS i FROM (SELECT sum(n) AS s FROM n GROUP BY b)), t AS (SELECT count(*)::DOUBLE AS n FROM l)
SELECT round((x.i - y.i * z.i / (t.n * (t.n - 1) / 2)) / ((y.i + z.i) / 2 - y.i * z.i / (t.n * (t.n - 1) / 2)), 6) AS ari FROM x, y, z, t""")
def ari(spark, sf):
    """Adjusted Rand index from the contingency of two labelings: one grouped count, then sums of pairs."""
    p = xy(spark, sf)
    n = C.lloyd(p, 3, 3).groupBy(F.col("cluster").alias("a"), (F.col("id") % 4).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = lambda df, out: df.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias(out))
    side = lambda c: n.groupBy(c).agg(F.sum("n").alias("n"))
    j = pairs(n, "x").crossJoin(pairs(side("a"), "y")).crossJoin(pairs(side("b"), "z")).crossJoin(n.agg(F.sum("n").alias("t")))  # one row each
    e = F.col("y") * F.col("z") / (F.col("t") * (F.col("t") - 1) / 2)
    return j.select(F.round((F.col("x") - e) / ((F.col("y") + F.col("z")) / 2 - e), 6).alias("ari"))


@query("stations", XY + ", s AS (SELECT count(*)::DOUBLE AS n, (stddev_pop(x) + stddev_pop(y)) / 2 AS s FROM xy) SELECT round(pow(n, -1.0::DOUBLE / 6) * s, 6) AS scott, round(pow(n * 4.0 / 4.0, -1.0::DOUBLE / 6) * s, 6) AS silverman FROM s")
def bandwidth_rules(spark, sf):
    s = xy(spark, sf).agg(F.count(F.lit(1)).cast("double").alias("n"), ((F.stddev_pop("x") + F.stddev_pop("y")) / 2.0).alias("s"))
    return s.select(F.round(F.pow("n", F.lit(-1.0 / 6)) * F.col("s"), 6).alias("scott"), F.round(F.pow(F.col("n") * 4.0 / 4.0, F.lit(-1.0 / 6)) * F.col("s"), 6).alias("silverman"))


@query("stations", XY + """, d AS (SELECT a.id, round(sqrt(pow(a.x - b.x, 2.0) + pow(a.y - b.y, 2.0)), 9) AS d FROM xy a JOIN xy b ON a.id <> b.id), k AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d)
SELECT round(quantile_cont(d, 0.95), 6) AS p95 FROM k WHERE r = 4""")
def kdist_p95(spark, sf):
    """95th percentile of the distance to the fourth neighbour, by cells of growing width."""
    p = xy(spark, sf)
    side = lambda s: p.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "x", "y")])
    pairs = lambda a, b, r: J.planar_join(a, b, r).filter("l_id <> r_id").withColumn("d", F.round("dist", 9))
    k = J.nearest(side("l"), side("r"), "l_id", 4, 30.0, [F.col("d"), F.col("r_id")], pairs, 2000.0).filter("rank = 4")
    return k.agg(F.round(F.percentile("d", 0.95), 6).alias("p95"))


def _scaled(how):
    def f(spark, sf):
        p = xy(spark, sf)
        a = {"minmax": [F.min("x"), F.max("x") - F.min("x")], "standard": [F.avg("x"), F.stddev_pop("x")], "robust": [F.median("x"), F.percentile("x", 0.75) - F.percentile("x", 0.25)]}[how]
        return p.crossJoin(F.broadcast(p.agg(a[0].alias("m"), a[1].alias("s")))).select("id", F.round((F.col("x") - F.col("m")) / F.col("s"), 6).alias("x"))

    f.__name__ = f"{how}_scale"
    return f


for _how, _sql in {"minmax": "(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())", "standard": "(x - avg(x) OVER ()) / stddev_pop(x) OVER ()", "robust": "(x - (SELECT median(x) FROM xy)) / (SELECT quantile_cont(x, 0.75) - quantile_cont(x, 0.25) FROM xy)"}.items():
    query("stations", XY + f" SELECT id, round({_sql}, 6) AS x FROM xy")(_scaled(_how))


@query("grid stations", XY + """, g AS (SELECT cell_id, lon * 88.0::DOUBLE AS cx, lat * 111.0::DOUBLE AS cy FROM grid), k AS (SELECT cell_id, sum(CASE WHEN pow(cx - x, 2.0) + pow(cy - y, 2.0) <= 10000.0 THEN exp(-(pow(cx - x, 2.0) + pow(cy - y, 2.0)) / 800.0::DOUBLE) ELSE 0.0 END) AS s FROM g, xy GROUP BY cell_id)
SELECT cell_id, round(s / ((SELECT count(*) FROM xy) * 2.0::DOUBLE * pi() * 400.0), 10) AS density FROM k""")
def kde_grid(spark, sf):
    g = V.grid(spark).select("cell_id", (F.col("lon") * 88.0).alias("cx"), (F.col("lat") * 111.0).alias("cy"))
    return D.kde_points(xy(spark, sf), g, 20.0).select("cell_id", F.round("density", 10).alias("density"))


@query("stations", XY + ", e AS (SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2.0) + pow(a.y - b.y, 2.0)), 6) AS w FROM xy a JOIN xy b ON a.id <> b.id AND sqrt(pow(a.x - b.x, 2.0) + pow(a.y - b.y, 2.0)) <= 14.0), w AS (SELECT id AS src, id AS node, 0.0::DOUBLE AS dist, 0 AS k FROM xy UNION SELECT src, b, round(dist + w, 6), k + 1 FROM w JOIN e ON node = a WHERE dist + w <= 30.0 AND k < 6) SELECT src, node, min(dist) AS dist FROM w GROUP BY src, node")
def bounded_sssp(spark, sf):
    """Paths of at most six edges between positions, then between their stations: stations of one position have the same
    paths to others, and are 0 apart."""
    p = xy(spark, sf).distinct()
    spots = saved(p.groupBy("x", "y").agg(F.min("id").alias("id")))
    paths = C.shortest_paths(spots, 14.0, 30.0, 6)
    at = J.small(saved(p.join(spots.withColumnRenamed("id", "spot"), ["x", "y"]).select("spot", "id")), 48)
    of = lambda key, name: at.select(F.col("spot").alias(key), F.col("id").alias(name))
    pairs = paths.toDF("s", "n", "dist").join(of("s", "src"), "s").join(of("n", "node"), "n").select("src", "node", "dist")
    return pairs.filter("src <> node").unionByName(p.select(F.col("id").alias("src"), F.col("id").alias("node"), F.lit(0.0).alias("dist")))


def _lloyd_sql(k: int) -> str:
    """CTEs of k-means with k centres, three rounds: m{k} holds each point's squared distance to its centre."""
    near = lambda c: f"(SELECT arg_min(c, (round(pow(xy.x - cx, 2.0) + pow(xy.y - cy, 2.0), 9), c)) FROM {c})"
    out = f"c{k}_0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS c, x AS cx, y AS cy FROM (SELECT * FROM xy ORDER BY id LIMIT {k}))"
    for r in range(3):
        out += f", a{k}_{r} AS (SELECT xy.*, {near(f'c{k}_{r}')} AS c FROM xy), c{k}_{r + 1} AS (SELECT c, avg(x) AS cx, avg(y) AS cy FROM a{k}_{r} GROUP BY c)"
    return out + f", m{k} AS (SELECT {k} AS k, sum((SELECT min(pow(xy.x - cx, 2.0) + pow(xy.y - cy, 2.0)) FROM c{k}_3)) AS inertia FROM xy)"


KS = range(2, 8)
SWEEP = XY + ", " + ", ".join(_lloyd_sql(k) for k in KS) + ", sweep AS (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in KS) + ")"


def sweep(spark, sf):
    """(k, inertia) of k-means for each k: a few rows, whatever the number of points."""
    p = saved(xy(spark, sf))
    return spark.createDataFrame([(k, C.inertia(p, C.centres(p, k, 3))) for k in KS], "k int, inertia double")


@query("stations", SWEEP + " SELECT k, round(inertia, 4) AS inertia FROM sweep")
def kmeans_sweep(spark, sf):
    return sweep(spark, sf).withColumn("inertia", F.round("inertia", 4))


@query("stations", SWEEP + ", d AS (SELECT k, inertia - lag(inertia) OVER (ORDER BY k) AS d FROM sweep), s AS (SELECT k, d - lag(d) OVER (ORDER BY k) AS s FROM d) SELECT arg_max(k, s) - 1 AS elbow_k FROM s")
def elbow_k(spark, sf):
    """The bend of the sweep's inertias: the largest second difference. A sweep is a few rows, so one window holds it."""
    w = Window.orderBy("k")
    s = sweep(spark, sf).withColumn("d", F.col("inertia") - F.lag("inertia").over(w)).withColumn("s", F.col("d") - F.lag("d").over(w))
    return s.agg((F.max_by("k", "s") - 1).alias("elbow_k"))


@query("stations", XY + ", a AS (SELECT DISTINCT floor(x / 20) AS i, floor(y / 20) AS j FROM xy WHERE id % 2 = 0), b AS (SELECT DISTINCT floor(x / 20) AS i, floor(y / 20) AS j FROM xy WHERE id % 3 = 0) SELECT round((SELECT count(*) FROM a JOIN b USING (i, j))::DOUBLE / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 6) AS jaccard")
def cell_jaccard(spark, sf):
    """Overlap of two areas as sets of raster cells."""
    cells = lambda k: xy(spark, sf).filter(F.col("id") % k == 0).select(F.floor(F.col("x") / 20).alias("i"), F.floor(F.col("y") / 20).alias("j")).distinct()
    a, b = cells(2), cells(3)
    both, either = a.intersect(b).agg(F.count(F.lit(1)).alias("n")), a.union(b).distinct().agg(F.count(F.lit(1)).alias("u"))
    return both.crossJoin(either).select(F.round(F.col("n") / F.col("u"), 6).alias("jaccard"))


@query("places", "SELECT place_id, CASE WHEN lat > 38.3 AND lat < 39.0 AND lon > -82 AND lon < -80 AND sqrt(pow(least(lat - 38.3, 39.0 - lat) * 69.0, 2.0)) >= 10.0 AND least(lon - -82, -80 - lon) * 54.6 >= 10.0 THEN true ELSE false END AS inside FROM places")
def circle_within(spark, sf):
    """A circle of ten miles inside a rectangle: the centre is inside and each side is as far away."""
    lat, lon = F.col("lat"), F.col("lon")
    ok = (lat > 38.3) & (lat < 39.0) & (lon > -82) & (lon < -80) & (F.least(lat - 38.3, F.lit(39.0) - lat) * G.MANHATTAN_LAT >= 10.0) & (F.least(lon + 82.0, F.lit(-80.0) - lon) * G.MANHATTAN_LON >= 10.0)
    return V.places(spark, sf).select("place_id", ok.alias("inside"))


@query.rows_only
def kmeans_ml(spark, sf):
    """k-means with the library's own seeding; labels aren't comparable across engines."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=["x", "y"], outputCol="v").transform(xy(spark, sf))
    return KMeans(k=4, seed=42, featuresCol="v", predictionCol="cluster").fit(v).transform(v).select("id", "cluster")


@query.rows_only
def convex_hulls(spark, sf):
    """Monotone-chain hull of each cluster, by grouped Arrow tables: a cluster's points are one group."""
    import pyarrow as pa

    def hull(t):
        pts = sorted(set(zip(t["x"].to_pylist(), t["y"].to_pylist(), strict=True)))
        turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and turn(out[-2], out[-1], p) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        ring = chain(pts) + chain(pts[::-1]) if len(pts) > 2 else pts
        return pa.table({"label": pa.array([t["label"][0].as_py()] * len(ring), pa.int64()), "pos": pa.array(range(len(ring)), pa.int32()), "x": pa.array([p[0] for p in ring]), "y": pa.array([p[1] for p in ring])})

    return clusters(spark, sf).filter("label <> -1").groupBy("label").applyInArrow(hull, "label long, pos int, x double, y double")
