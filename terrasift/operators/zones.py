"""Zones against the truth: hits, rewards, re-ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import MILES_EVALUATION, MILES_ZONES, haversine

KS = (1, 3, 5, 10)
KM2_A_MILE2 = 2.589988110336


def ranked(zones: DataFrame, truth: DataFrame, buffer_miles: float = 300.0 / 1609.34) -> DataFrame:
    """zones joined with their case's truth: d, hit and rank r by falling priority (ties: position, zone_id)."""
    j = zones.join(truth, "case_id")
    d = haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), MILES_EVALUATION)
    order = Window.partitionBy("case_id").orderBy(F.desc("priority"), "pos", "zone_id")
    return j.withColumn("d", d).withColumn("hit", F.col("d") <= F.col("radius") + F.lit(buffer_miles)).withColumn("r", F.row_number().over(order))


def hits_by_case(rows: DataFrame) -> DataFrame:
    """A row for each case: hit in the first K, rank of the first hit, gains, distances."""
    hit_in = [F.max((F.col("hit") & (F.col("r") <= k)).cast("int")).alias(f"h{k}") for k in KS]
    first = F.min(F.when(F.col("hit"), F.col("r"))).alias("first")
    dcg = F.sum(F.when(F.col("hit") & (F.col("r") <= 5), F.lit(1.0) / F.log2(F.col("r") + F.lit(1.0))).otherwise(0.0)).alias("dcg")
    return rows.groupBy("case_id").agg(*hit_in, first, dcg, F.min_by("d", "r").alias("d1"), F.min_by("d", F.when(F.col("hit"), F.col("r"))).alias("d_hit"), F.min(F.greatest(F.lit(0.0), F.col("d") - F.col("radius"))).alias("gap"))


def inside(d: Column, r: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.greatest(F.lit(0.0), d - r))


def in_time(t: Column, ws: Column, we: Column) -> Column:
    return F.greatest(F.lit(0.0), (we - F.coalesce(t, we)) / F.greatest(F.lit(1e-6), we - ws))


def hybrid(inside_: Column, time: Column, corridor: Column) -> Column:
    """Weights of distance and time, a bonus for a near hit, and the corridor bonus (fixed values)."""
    return 0.7 * inside_ + 0.3 * time + F.when(inside_ >= 0.85, 0.1).otherwise(0.0) + F.when(corridor, 0.05).otherwise(0.0)


def radius_penalty(r: Column) -> Column:
    return F.lit(-0.2) * F.pow(r / 50.0, F.lit(2.0))


def zone_scores(zones: DataFrame, truth: DataFrame, windows: DataFrame) -> DataFrame:
    """Each zone's score in its window: truth counts as hit at its hour if it lies in the window and the radius."""
    d = haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"), MILES_ZONES)
    j = zones.join(truth.select("case_id", "t_lat", "t_lon", "t_hr"), "case_id").join(F.broadcast(windows), "win").withColumn("d", d)
    t_hit = F.when((F.col("t_hr") >= F.col("ws")) & (F.col("t_hr") < F.col("we")) & (F.col("d") <= F.col("radius")), F.col("t_hr"))
    j = j.withColumn("t_hit", t_hit)
    score = hybrid(inside(F.col("d"), F.col("radius")), in_time(F.col("t_hit"), F.col("ws"), F.col("we")), F.lit(True)) + radius_penalty(F.col("radius"))
    return j.withColumn("score", score)


def pair_overlaps(zones: DataFrame) -> DataFrame:
    """(case_id, win, overlap): mean overlap of all pairs of a window's zones, 0 to 1."""
    a = zones.select("case_id", "win", *[F.col(c).alias(f"{c}1") for c in ("zone_id", "pos", "lat", "lon", "radius")])
    b = zones.select("case_id", "win", *[F.col(c).alias(f"{c}2") for c in ("zone_id", "pos", "lat", "lon", "radius")])
    j = a.join(b, ["case_id", "win"]).filter(F.struct("pos1", "zone_id1") < F.struct("pos2", "zone_id2"))
    d = haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"), MILES_ZONES)
    least, both = F.least("radius1", "radius2"), F.col("radius1") + F.col("radius2")
    o = F.when(d >= both, 0.0).when(d <= least, 1.0).otherwise(F.lit(1.0) - (d - least) / F.greatest(F.lit(1e-6), both - least))
    return j.withColumn("o", o).groupBy("case_id", "win").agg(F.avg("o").alias("overlap"))


def window_rewards(scored: DataFrame) -> DataFrame:
    """Softmax-weighted mean of scores, less overlap, less wasted zones."""
    w = Window.partitionBy("case_id", "win")
    e = F.exp(F.col("priority") - F.max("priority").over(w))
    waste = F.when(F.col("t_hit").isNull() & (F.col("d") > F.col("far")), -0.2).otherwise(0.0)
    rows = scored.withColumn("e", e).withColumn("waste", waste)
    out = rows.groupBy("case_id", "win").agg(F.sum("e").alias("z"), F.sum(F.col("e") * F.col("score")).alias("s"), F.sum("waste").alias("waste"), F.first("w").alias("w"))
    out = out.join(pair_overlaps(scored), ["case_id", "win"], "left")
    return out.select("case_id", "win", "w", (F.col("s") / (F.col("z") + 1e-9) - 0.1 * F.coalesce("overlap", F.lit(0.0)) + F.col("waste")).alias("reward"))


def reweighted(priority: Column, plausibility: Column, radius: Column, rl: Column, alpha: float = 0.6, beta: float = 0.8, gamma: float = 0.02, delta: float = 0.0, boost: float = 0.0) -> Column:
    """Re-ranked priority; missing inputs take their neutral values (fixed values)."""
    p, q, r, x = F.coalesce(priority, F.lit(0.5)), F.coalesce(plausibility, F.lit(0.5)), F.coalesce(radius, F.lit(3.11)), F.coalesce(rl, F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-3.0) * (alpha * p + beta * q - gamma * r + delta * x + boost - 0.5)))


def minmax(x: Column, w: Window) -> Column:
    """0 to 1 within a window; 0.5 where all are equal."""
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi == lo, 0.5).otherwise((x - lo) / F.nullif(hi - lo, F.lit(0.0)))
