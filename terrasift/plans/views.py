"""Planning tables (points, cases, zones, ...) as views over the given tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lat_of(x: Column) -> Column:
    return F.lit(36.5) + F.lit(3.0) * (x % 97).cast("double") / F.lit(97.0)


def lon_of(x: Column) -> Column:
    return F.lit(-83.7) + F.lit(8.4) * (x % 89).cast("double") / F.lit(89.0)


def points(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("pid"), lat_of(F.col("event_id")).alias("lat"), lon_of(F.col("event_id")).alias("lon"), F.col("value").alias("weight"), (F.col("user_id") % 2).cast("int").alias("band"), "user_id", "event_type", "ts")


def cases(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    k = F.col("c_custkey")
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return j.select(
        k.alias("case_id"), F.when(k % 23 == 0, None).otherwise(F.lit(6) + k % 12).cast("int").alias("age"),
        F.when(k % 5 == 0, "female").when(k % 5 == 1, " Male ").when(k % 5 == 2, "F").when(k % 5 == 3, "m").alias("gender"),
        F.when(k % 11 == 0, "unknown").when(k % 13 == 0, "  new   PORT  ").otherwise(F.lower("c_mktsegment")).alias("city"),
        F.when(k % 17 == 0, None).otherwise(F.concat(F.lower("n_name"), F.lit(" county"))).alias("county"), F.col("r_name").alias("state"),
        F.when(k % 29 == 0, 99.0).otherwise(lat_of(k * 3)).alias("lat"), F.when(k % 31 == 0, None).otherwise(lon_of(k * 7)).alias("lon"),
        F.when(k % 19 == 0, "").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.lit(1) + k % 28).cast("string"), 2, "0"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":30:00+00:00"))).alias("reported"),
        F.round("c_acctbal", 2).alias("minutes"),
    )


def zones(spark, sf):
    z = table(spark, sf, "lineitem")
    name = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    return z.select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("pos"), (F.col("l_linenumber") % 3).cast("long").alias("win"), F.col("l_quantity").alias("radius"), (F.round(F.col("l_discount") * 10.0, 6) + F.lit(0.0)).alias("priority"), lat_of(F.col("l_partkey")).alias("lat"), lon_of(F.col("l_suppkey")).alias("lon"), name.alias("zone_id"), F.round(F.col("l_tax"), 6).alias("plaus"))


def truth(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("case_id"), lat_of(k).alias("t_lat"), lon_of(k).alias("t_lon"), (k % 72).cast("double").alias("t_hr"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("status"))


def stations(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select(k.alias("sid"), F.col("s_name").alias("name"), (F.lit(37.0) + F.lit(1.5) * ((k * 7) % 97).cast("double") / F.lit(97.0)).alias("lat"), (F.lit(-78.5) + F.lit(2.1) * ((k * 13) % 89).cast("double") / F.lit(89.0)).alias("lon"), F.col("s_nationkey").alias("region"))


def places(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("place_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), (F.lit(36.5) + F.lit(3.0) * ((k * 5) % 97).cast("double") / F.lit(97.0)).alias("lat"), (F.lit(-83.7) + F.lit(8.4) * ((k * 11) % 89).cast("double") / F.lit(89.0)).alias("lon"), F.col("p_size").alias("size"))


def sectors(spark, sf=None):
    rows = [(f"R{i}", -83.7 + 2.1 * (i % 4), 36.5 + 1.5 * (i // 4), -83.7 + 2.1 * (i % 4 + 1), 36.5 + 1.5 * (i // 4 + 1)) for i in range(8)]
    return spark.createDataFrame(rows, "sector string, lon1 double, lat1 double, lon2 double, lat2 double")


def grid(spark, sf=None, n: int = 20):
    c = spark.range(n * n).select(F.col("id").alias("cell_id"), (F.col("id") % n).alias("ix"), F.floor(F.col("id") / n).cast("long").alias("iy"))
    return c.withColumn("lon", F.lit(-83.7) + F.lit(8.4) * F.col("ix").cast("double") / F.lit(float(n - 1))).withColumn("lat", F.lit(36.5) + F.lit(3.0) * F.col("iy").cast("double") / F.lit(float(n - 1)))


def plan(spark, sf=None):
    """The planning grid: 80 by 80 cells."""
    return grid(spark, sf, 80)


def hotspots(spark, sf):
    """The three largest places of each brand (a bounded report over all places), as hotspots of three methods; radii are 0 for some."""
    p = places(spark, sf).withColumn("r", F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("size"), "place_id"))).filter("r <= 3")
    return p.select(F.col("place_id").alias("hid"), "lat", "lon", (F.col("size") / F.lit(10.0)).alias("weight"), F.when(F.col("place_id") % 4 == 0, 0.0).otherwise(F.col("size") / F.lit(5.0)).alias("radius"), F.element_at(F.array(F.lit("kmeans"), F.lit("dbscan"), F.lit("kde")), (F.col("place_id") % 3 + 1).cast("int")).alias("method"))


def sightings(spark, sf):
    e = table(spark, sf, "events")
    first = e.groupBy("user_id").agg(F.min("ts").alias("t0"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    hours = (micros("ts") - micros("t0")).cast("double") / F.lit(3.6e9)
    return e.join(first, "user_id").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("sid"), hours.alias("t_hr"), lat_of(F.col("event_id")).alias("lat"), lon_of(F.col("event_id")).alias("lon"), "event_type", "value")


def windows(spark, sf=None):
    return spark.createDataFrame([(0, 0.0, 24.0, 1.0, 15.0), (1, 24.0, 48.0, 0.7, 25.0), (2, 48.0, 72.0, 0.5, 40.0)], "win long, ws double, we double, w double, far double")


lat_sql, lon_sql = (lambda x: f"(36.5::DOUBLE + 3.0::DOUBLE * ({x} % 97)::DOUBLE / 97.0::DOUBLE)"), (lambda x: f"(-83.7::DOUBLE + 8.4::DOUBLE * ({x} % 89)::DOUBLE / 89.0::DOUBLE)")

SQL = {
    "points": f"SELECT event_id AS pid, {lat_sql('event_id')} AS lat, {lon_sql('event_id')} AS lon, value AS weight, (user_id % 2)::INT AS band, user_id, event_type, ts FROM events",
    "cases": f"""SELECT c_custkey AS case_id, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 6 + c_custkey % 12 END::INT AS age,
        CASE c_custkey % 5 WHEN 0 THEN 'female' WHEN 1 THEN ' Male ' WHEN 2 THEN 'F' WHEN 3 THEN 'm' END AS gender,
        CASE WHEN c_custkey % 11 = 0 THEN 'unknown' WHEN c_custkey % 13 = 0 THEN '  new   PORT  ' ELSE lower(c_mktsegment) END AS city,
        CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE lower(n_name) || ' county' END AS county, r_name AS state,
        CASE WHEN c_custkey % 29 = 0 THEN 99.0 ELSE {lat_sql('(c_custkey * 3)')} END::DOUBLE AS lat, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE {lon_sql('(c_custkey * 7)')} END::DOUBLE AS lon,
        CASE WHEN c_custkey % 19 = 0 THEN '' ELSE '2024-01-' || lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') || 'T' || lpad((c_custkey % 24)::VARCHAR, 2, '0') || ':30:00+00:00' END AS reported,
        round(c_acctbal, 2) AS minutes
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "zones": f"""SELECT l_orderkey AS case_id, l_linenumber::BIGINT AS pos, (l_linenumber % 3)::BIGINT AS win, l_quantity AS radius, round(l_discount * 10.0::DOUBLE, 6) + 0.0::DOUBLE AS priority,
        {lat_sql('l_partkey')} AS lat, {lon_sql('l_suppkey')} AS lon, l_linenumber || '-' || l_partkey || '-' || l_suppkey AS zone_id, round(l_tax, 6) AS plaus FROM lineitem""",
    "truth": f"SELECT o_orderkey AS case_id, {lat_sql('o_orderkey')} AS t_lat, {lon_sql('o_orderkey')} AS t_lon, (o_orderkey % 72)::DOUBLE AS t_hr, o_orderpriority AS label, o_orderstatus AS status FROM orders",
    "stations": "SELECT s_suppkey AS sid, s_name AS name, 37.0::DOUBLE + 1.5::DOUBLE * ((s_suppkey * 7) % 97)::DOUBLE / 97.0::DOUBLE AS lat, -78.5::DOUBLE + 2.1::DOUBLE * ((s_suppkey * 13) % 89)::DOUBLE / 89.0::DOUBLE AS lon, s_nationkey AS region FROM supplier",
    "places": "SELECT p_partkey AS place_id, p_name AS name, p_brand AS brand, 36.5::DOUBLE + 3.0::DOUBLE * ((p_partkey * 5) % 97)::DOUBLE / 97.0::DOUBLE AS lat, -83.7::DOUBLE + 8.4::DOUBLE * ((p_partkey * 11) % 89)::DOUBLE / 89.0::DOUBLE AS lon, p_size AS size FROM part",
    "sectors": "SELECT 'R' || i AS sector, -83.7::DOUBLE + 2.1::DOUBLE * (i % 4) AS lon1, 36.5::DOUBLE + 1.5::DOUBLE * (i // 4) AS lat1, -83.7::DOUBLE + 2.1::DOUBLE * (i % 4 + 1) AS lon2, 36.5::DOUBLE + 1.5::DOUBLE * (i // 4 + 1) AS lat2 FROM range(8) t(i)",
    "grid": "SELECT i AS cell_id, i % 20 AS ix, i // 20 AS iy, -83.7::DOUBLE + 8.4::DOUBLE * (i % 20)::DOUBLE / 19.0::DOUBLE AS lon, 36.5::DOUBLE + 3.0::DOUBLE * (i // 20)::DOUBLE / 19.0::DOUBLE AS lat FROM range(400) t(i)",
    "plan": "SELECT i AS cell_id, i % 80 AS ix, i // 80 AS iy, -83.7::DOUBLE + 8.4::DOUBLE * (i % 80)::DOUBLE / 79.0::DOUBLE AS lon, 36.5::DOUBLE + 3.0::DOUBLE * (i // 80)::DOUBLE / 79.0::DOUBLE AS lat FROM range(6400) t(i)",
    "hotspots": "SELECT place_id AS hid, lat, lon, size / 10.0::DOUBLE AS weight, CASE WHEN place_id % 4 = 0 THEN 0.0 ELSE size / 5.0::DOUBLE END::DOUBLE AS radius, ['kmeans', 'dbscan', 'kde'][place_id % 3 + 1] AS method FROM (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY size DESC, place_id) AS r FROM places) WHERE r <= 3",
    "sightings": f"SELECT user_id AS case_id, event_id AS sid, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id)))::DOUBLE / 3.6e9::DOUBLE AS t_hr, {lat_sql('event_id')} AS lat, {lon_sql('event_id')} AS lon, event_type, value FROM events",
    "windows": "SELECT * FROM (VALUES (0::BIGINT, 0.0::DOUBLE, 24.0::DOUBLE, 1.0::DOUBLE, 15.0::DOUBLE), (1, 24.0, 48.0, 0.7, 25.0), (2, 48.0, 72.0, 0.5, 40.0)) t(win, ws, we, w, far)",
}
_NEEDS = {"hotspots": ["places"]}


def sql(names: str, body: str) -> str:
    """SQL with the named views in front; body is a SELECT, or further CTEs and a SELECT."""
    order: list[str] = []
    for n in names.split():
        order += [x for x in [*_NEEDS.get(n, []), n] if x not in order]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in order)
    body = body.strip()
    return f"WITH RECURSIVE {head}{' ' if body.upper().startswith('SELECT') else ', '}{body}"


def miles_sql(a: str, b: str, c: str, d: str, radius: float = 3959.0) -> str:
    """Haversine of (lat a, lon b) and (lat c, lon d)."""
    h = f"(pow(sin((radians({c}) - radians({a})) / 2.0), 2.0) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2.0), 2.0))"
    return f"({2.0 * radius}::DOUBLE * atan2(sqrt({h}), sqrt(greatest(0.0, 1.0 - {h}))))"
