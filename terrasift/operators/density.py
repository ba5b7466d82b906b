"""Density surfaces and forecasts over a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import planar_miles
from ..storage import saved
from .joins import dealt, small

def normalised(df: DataFrame, column: str, eps: float) -> DataFrame:
    """column over its sum; the sum is one row, joined back, so that no single task sorts the cells."""
    total = df.agg(F.sum(column).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(column, F.col(column) / (F.col("_total") + F.lit(eps))).drop("_total")


def kde_prior(grid: DataFrame, hotspots: DataFrame, sigma: float) -> DataFrame:
    """(cell_id, p): gaussian kernels of weighted hotspots at each cell. Hotspots are a bounded list and are broadcast."""
    j = grid.crossJoin(F.broadcast(hotspots.select(F.col("lat").alias("hlat"), F.col("lon").alias("hlon"), "weight")))
    x, y = planar_miles(F.col("lat"), F.col("lon"), F.col("hlat"), F.col("hlon"), F.col("lat"))
    z = F.col("weight") * F.exp(-(x * x + y * y) / F.lit(2.0 * sigma * sigma))
    return normalised(j.groupBy("cell_id").agg(F.sum(z).alias("p")), "p", 1e-9)


def seed(grid: DataFrame, lat: float, lon: float, sigma: float) -> DataFrame:
    """(cell_id, p): one gaussian around a point, on the plane of the point's latitude."""
    x, y = planar_miles(F.col("lat"), F.col("lon"), lat, lon, lat)
    return normalised(grid.select("cell_id", F.exp(-(x * x + y * y) / F.lit(2.0 * sigma * sigma)).alias("p")), "p", 1e-12)


def transition(edges: DataFrame, features: DataFrame, cost: float = 1.0, seclusion: float = 0.5, corridor: float = 0.0) -> DataFrame:
    """(src, dst, w): rows of a sparse Markov matrix; weights come from features of the destination, scaled to 0-1."""
    lo_hi = features.agg(*[f(c).alias(f"{n}_{c}") for c in ("rc", "sc", "cc") for n, f in (("lo", F.min), ("hi", F.max))])
    f = features.crossJoin(F.broadcast(lo_hi))
    s = {c: (F.col(c) - F.col(f"lo_{c}")) / (F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1e-9) for c in ("rc", "sc", "cc")}
    weight = f.select(F.col("cell_id").alias("dst"), F.exp(F.lit(-cost) * s["rc"] + seclusion * s["sc"] + corridor * s["cc"]).alias("w"))
    rows = edges.select("src", "dst").join(weight, "dst").unionByName(features.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(1e-6).alias("w")))
    total = rows.groupBy("src").agg(F.sum("w").alias("t"))
    return rows.join(total, "src").select("src", "dst", (F.col("w") / (F.col("t") + 1e-12)).alias("w"))


def step(p: DataFrame, matrix: DataFrame) -> DataFrame:
    """One move of the mass along the matrix. Rows of the matrix add up to 1, so the mass stays but for rounding; callers
    normalise the states that they report, which keeps the plan of many steps linear. Spark broadcasts a state that is small."""
    return p.join(matrix, p["cell_id"] == matrix["src"]).groupBy("dst").agg(F.sum(F.col("p") * F.col("w")).alias("p")).withColumnRenamed("dst", "cell_id")


def kde_points(points: DataFrame, at: DataFrame, h: float) -> DataFrame:
    """(cell_id, density) of planar points (x, y) at cells (cell_id, cx, cy): normalised gaussian kernels of bandwidth h.

    Points beyond 5 h weigh under 4e-6 of one near by, so only cells and points of neighbouring 5 h boxes meet. Points of one
    position are one with their number, and cells of one position have the same density, so only distinct positions meet.
    """
    n = points.agg(F.count(F.lit(1)).alias("n"))
    box = lambda c: F.floor(F.col(c) / F.lit(5.0 * h))
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = dealt(at.select("cx", "cy").distinct(), "cx", "cy").withColumn("bi", box("cx")).withColumn("bj", box("cy"))
    spots = small(saved(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))))
    b = spots.select("x", "y", "c", F.explode(near).alias("s")).withColumn("bi", box("x") + F.col("s.i")).withColumn("bj", box("y") + F.col("s.j"))
    d2 = F.pow(F.col("cx") - F.col("x"), F.lit(2.0)) + F.pow(F.col("cy") - F.col("y"), F.lit(2.0))
    s = a.join(b, ["bi", "bj"]).filter(d2 <= F.lit(25.0 * h * h)).groupBy("cx", "cy").agg(F.sum(F.col("c") * F.exp(-d2 / F.lit(2.0 * h * h))).alias("s"))
    s = small(saved(s))
    return at.join(s, ["cx", "cy"], "left").crossJoin(F.broadcast(n)).select("cell_id", (F.coalesce("s", F.lit(0.0)) / (F.col("n") * F.lit(2.0) * F.pi() * F.lit(h * h))).alias("density"))
