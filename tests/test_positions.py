"""Queries on positions that many rows share, against their SQL and within a time that all pairs of rows would exceed."""

import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from terrasift.operators import cluster, joins
from terrasift.plans import registry

SF = "/root/testdata/sf0.001"
LATTICE = 97 * 89  # keys so far apart have the same position


def tables(folder, suppliers, customers):
    """A folder of tables whose suppliers and customers have these keys, and a connection to them."""
    con = duckdb.connect()
    for name, key, ids in (("supplier", "s_suppkey", suppliers), ("customer", "c_custkey", customers)):
        con.execute(f"COPY (SELECT * REPLACE (k AS {key}) FROM (SELECT * FROM '{SF}/{name}.parquet' LIMIT 1), ({ids}) t(k)) TO '{folder}/{name}.parquet'")
    for name in ("nation", "region"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet') TO '{folder}/{name}.parquet'")
    for name in ("supplier", "customer", "nation", "region"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows(frame):
    return sorted(tuple(f"{v:.6g}" if isinstance(v, float) else v for v in r) for r in frame)


@pytest.mark.parametrize(("name", "suppliers", "customers"), [("nearest_station", 12000, 5000), ("nearby_transit", 12000, 5000), ("density_peaks", 20000, 1)])
def test_shared_positions(spark, tmp_path, name, suppliers, customers):
    con = tables(tmp_path, f"SELECT i % 10 + (i // 10) * {LATTICE} FROM range({suppliers}) r(i)", f"SELECT i % 40 + (i // 40) * {LATTICE} FROM range({customers}) r(i)")
    registry.queries()[name](spark, SF).count()  # code is compiled by then
    begin = time.time()
    got = registry.queries()[name](spark, str(tmp_path))
    got = rows(got.select(*sorted(got.columns)).collect())
    assert time.time() - begin < 25
    want = con.sql(registry.oracle_sql()[name])
    assert got == rows(want.select(*sorted(want.columns)).fetchall() if hasattr(want, "select") else want.fetchall())


@pytest.mark.parametrize("step", [(1, 1), (1, 2), (2, 1)])
def test_paths_of_six_rounded_edges(spark, tmp_path, step):
    """Sums of rounded edges along a line may be less than one rounded edge, so a seventh edge would show."""
    at = [k for i in range(14) for k in range(LATTICE) if (k * 7 % 97, k * 13 % 89) == (i * step[0], i * step[1])]
    con = tables(tmp_path, "SELECT unnest([%s])" % ", ".join(map(str, [*at, at[0] + LATTICE])), "SELECT 0")
    got = {(r.src, r.node): r.dist for r in registry.queries()["bounded_sssp"](spark, str(tmp_path)).collect()}
    assert got == {(a, b): d for a, b, d in con.sql(registry.oracle_sql()["bounded_sssp"]).fetchall()}


def test_paths_count_hops(spark):
    df = spark.createDataFrame([(k, float(k), 0.0) for k in range(9)] + [(99, 50.0, 0.0)], "id long, x double, y double")
    got = {(r.src, r.node): r.dist for r in cluster.shortest_paths(df, 1.0, 5.0, 3).collect()}
    assert got == {(a, b): float(abs(a - b)) for a in range(9) for b in range(9) if abs(a - b) <= 3} | {(99, 99): 0.0}


def test_nearest_one_at_any_distance(spark):
    left = [(k, -60.0 + (k * 37 % 121), -179.0 + (k * 53 % 359)) for k in range(200)]
    right = [(k, 36.5 + (k * 7 % 23) / 10, -80.0 + (k * 5 % 19) / 10) for k in range(150)]
    got = joins.nearest_one(spark.createDataFrame(left, "l_id long, l_lat double, l_lon double"), spark.createDataFrame(right, "r_id long, r_lat double, r_lon double"), ["l_id"], "r_id")
    rad = math.radians
    a = lambda p, q: math.sin(rad(q[1] - p[1]) / 2) ** 2 + math.cos(rad(p[1])) * math.cos(rad(q[1])) * math.sin(rad(q[2] - p[2]) / 2) ** 2
    d = lambda p, q: round(2 * 3959.0 * math.atan2(math.sqrt(a(p, q)), math.sqrt(1 - a(p, q))), 6)
    assert {r.l_id: r.r_id for r in got.select("l_id", F.col("r_id")).collect()} == {p[0]: min((d(p, q), q[0]) for q in right)[1] for p in left}
