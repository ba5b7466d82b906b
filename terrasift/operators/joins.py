"""Radius, nearest-neighbour and interval joins as equi-joins on cells with a residual check."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine
from ..storage import saved

#: Bytes up to which a table of distinct positions may be broadcast, by its counted rows and the bytes of one.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, row_bytes: int = 64) -> DataFrame:
    """df, already written, marked for broadcast if its counted rows allow it; joins shuffle it otherwise."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df written in as many parts as tasks may run: a few rows that stand for many pairs would else be one task."""
    return saved(df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys))


def cells(lat: Column, lon: Column, size_lat: float, size_lon: float) -> tuple[Column, Column]:
    return F.floor(lat / F.lit(size_lat)).cast("long"), F.floor(lon / F.lit(size_lon)).cast("long")


def radius_join(left: DataFrame, right: DataFrame, miles: float, max_lat: float = 60.0) -> DataFrame:
    """Pairs of left (l_*: l_lat, l_lon) and right (r_*: r_lat, r_lon) within `miles`, with dist.

    Both sides are dealt by cells as wide as the radius (in longitude at max_lat, where degrees are shortest); the right
    side enters its cell and the eight around it, so each pair meets in just one cell and the join is a plain equi-join.
    """
    size_lat = miles / 68.0
    size_lon = miles / (68.0 * math.cos(math.radians(max_lat)))
    ci, cj = cells(F.col("l_lat"), F.col("l_lon"), size_lat, size_lon)
    a = left.withColumn("_ci", ci).withColumn("_cj", cj)
    di, dj = cells(F.col("r_lat"), F.col("r_lon"), size_lat, size_lon)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.withColumn("_n", F.explode(near)).withColumn("_ci", di + F.col("_n.i")).withColumn("_cj", dj + F.col("_n.j")).drop("_n")
    pairs = a.join(b, ["_ci", "_cj"]).drop("_ci", "_cj")
    return pairs.withColumn("dist", haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).filter(F.col("dist") <= miles)


def planar_join(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """Pairs within eps of each other on a plane (l_x, l_y; r_x, r_y), with dist."""
    a = left.withColumn("_ci", F.floor(F.col("l_x") / F.lit(eps))).withColumn("_cj", F.floor(F.col("l_y") / F.lit(eps)))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    b = right.withColumn("_n", F.explode(near)).withColumn("_ci", F.floor(F.col("r_x") / F.lit(eps)) + F.col("_n.i")).withColumn("_cj", F.floor(F.col("r_y") / F.lit(eps)) + F.col("_n.j")).drop("_n")
    d = F.sqrt(F.pow(F.col("l_x") - F.col("r_x"), F.lit(2.0)) + F.pow(F.col("l_y") - F.col("r_y"), F.lit(2.0)))
    return a.join(b, ["_ci", "_cj"]).drop("_ci", "_cj").withColumn("dist", d).filter(F.col("dist") <= F.lit(eps))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1; Spark cuts each partition before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def nearest(left: DataFrame, right: DataFrame, key: str, k: int, reach: float, order: list[Column], join, most: float = 1e6) -> DataFrame:
    """The k nearest right rows of each left row, ranked by order: pairs of join(left, right, reach), the reach doubled for rows
    that have found fewer than k until none is left, the reach is past `most`, or a doubling brings no new row at all.

    Each round is a join on cells as wide as the reach, so few rows go on to wide ones. key: left's id in the pairs.
    """
    out, rest = None, saved(left)
    while rest.head(1) and reach <= most:
        pairs = join(rest, right, reach)
        found = saved(top_k(pairs, [key], order, k))
        full = found.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= k).select(key)
        last = 2 * reach > most
        done = found if last else found.join(full, key, "left_semi")
        out = done if out is None else out.unionByName(done)
        rest = saved(rest.join(full, key, "left_anti"))
        reach *= 2
    return out if out is not None else top_k(join(left, right, reach), [key], order, k)


def nearest_one(left: DataFrame, right: DataFrame, key: list[str], tie: str) -> DataFrame:
    """Each left row (l_lat, l_lon) with the right row (r_lat, r_lon) nearest to it by dist, rounded to 6 places, then by `tie`,
    however far that is. key: left's columns; left has no row twice.

    Right is put into some sqrt(10 n) boxes. A box's pivot is one of its rows, its reach the distance to the farthest of them,
    so by the triangle inequality only boxes whose pivot is no farther than the nearest pivot and their own reach can hold the
    nearest row; their rows are looked at.
    """
    left, right = dealt(left, *key), saved(right.filter("r_lat IS NOT NULL AND r_lon IS NOT NULL"))
    e = right.agg(F.count(F.lit(1)), F.min("r_lat"), F.max("r_lat"), F.min("r_lon"), F.max("r_lon")).first()
    side = math.ceil((10 * e[0]) ** 0.25)
    box = [F.floor((F.col(c) - F.lit(lo)) / F.lit((hi - lo) / side or 1.0)) if e[0] else F.lit(0) for c, lo, hi in (("r_lat", e[1], e[2]), ("r_lon", e[3], e[4]))]
    right = right.withColumn("_bi", box[0]).withColumn("_bj", box[1])
    pivot = right.groupBy("_bi", "_bj").agg(F.min(F.struct("r_lat", "r_lon")).alias("p")).select("_bi", "_bj", F.col("p.r_lat").alias("_lat"), F.col("p.r_lon").alias("_lon"))
    reach = F.max(haversine(F.col("_lat"), F.col("_lon"), F.col("r_lat"), F.col("r_lon")))
    pivot = F.broadcast(saved(right.join(pivot, ["_bi", "_bj"]).groupBy("_bi", "_bj", "_lat", "_lon").agg(reach.alias("_reach"))))
    to_pivot = left.crossJoin(pivot).withColumn("_d", haversine(F.col("l_lat"), F.col("l_lon"), F.col("_lat"), F.col("_lon")))
    least = to_pivot.groupBy(*key).agg(F.min("_d").alias("_least"))
    slack = 1e-3  # miles; more than rounding and the error of a distance
    boxes = to_pivot.join(least, key).filter(F.col("_d") - F.col("_reach") <= F.col("_least") + F.lit(slack)).select(*left.columns, "_bi", "_bj")
    pairs = boxes.join(small(right), ["_bi", "_bj"]).drop("_bi", "_bj").withColumn("dist", haversine(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon")))
    return top_k(pairs, key, [F.round("dist", 6), F.col(tie)], 1)


def grid_knn(grid: DataFrame, k: int) -> DataFrame:
    """(src, dst, dist): the k nearest other cells of a regular grid (cell_id, ix, iy, lon, lat), in degrees; ties go to the lower cell_id.

    Neighbours come from a stencil of cells by an equi-join on cell indices. The stencil grows until every k-th neighbour is
    nearer than the first cell outside of it, or it spans the grid, so the result is exact.
    """
    e = grid.agg(F.max("ix").alias("nx"), F.max("iy").alias("ny"), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    dx, dy = max((e[3] - e[2]) / max(e[0], 1), 1e-12), max((e[5] - e[4]) / max(e[1], 1), 1e-12)
    radius = math.sqrt(4 * (k + 2) * dx * dy / math.pi)  # a corner cell sees a quarter of the circle
    while True:
        rx, ry = min(math.ceil(radius / dx), e[0]), min(math.ceil(radius / dy), e[1])
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-rx, rx + 1) for j in range(-ry, ry + 1) if (i or j) and math.hypot(max(0, abs(i) - 1) * dx, max(0, abs(j) - 1) * dy) <= radius])
        a = grid.select(F.col("cell_id").alias("src"), F.col("lon").alias("x1"), F.col("lat").alias("y1"), "ix", "iy", F.explode(steps).alias("s"))
        a = a.withColumn("ix", F.col("ix") + F.col("s.i")).withColumn("iy", F.col("iy") + F.col("s.j")).drop("s")
        b = grid.select(F.col("cell_id").alias("dst"), F.col("lon").alias("x2"), F.col("lat").alias("y2"), "ix", "iy")
        d = F.sqrt(F.pow(F.col("x1") - F.col("x2"), F.lit(2.0)) + F.pow(F.col("y1") - F.col("y2"), F.lit(2.0)))
        pairs = a.join(b, ["ix", "iy"]).select("src", "dst", F.round(d, 9).alias("dist"))
        out = saved(top_k(pairs, ["src"], [F.col("dist"), F.col("dst")], k))
        worst = out.groupBy("src").agg(F.max("rank").alias("n"), F.max("dist").alias("d")).agg(F.min("n"), F.max("d")).first()
        if (rx >= e[0] and ry >= e[1]) or (worst[0] == k and worst[1] < radius):
            return out.drop("rank")
        radius *= 2
