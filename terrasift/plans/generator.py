"""Queries on generated cases: the chain of weighted draws, their parameters, cues and identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sampling as S
from . import views as V
from .base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

# An example lexicon: priors, and multipliers by what was drawn before.
MOTIVES = [("custody", 0.5), ("opportunity", 0.3), ("trade", 0.2)]
LURES = [("help", 0.4), ("gift", 0.25), ("ride", 0.2), ("online", 0.15)]
TRANSPORT = [("on_foot", 0.3), ("vehicle_local", 0.4), ("vehicle_highway", 0.2), ("transit", 0.1)]
PROFILES = [("local", 0.5), ("corridor", 0.3), ("distant", 0.2)]
SITES = [("house", 0.45), ("woods", 0.25), ("motel", 0.3)]
TIMES = [("morning", 1.0), ("afternoon", 1.0), ("night", 1.0)]
BY_REGION = {"EUROPE": {"trade": 2.0}, "ASIA": {"custody": 0.5}}
BY_AGE = {"child": {"opportunity": 1.4}, "teen": {"trade": 1.6}}
LURE_BY_MOTIVE = {"custody": {"ride": 0.0, "help": 2.0}, "trade": {"online": 3.0}}
TRANSPORT_BY_MOTIVE = {"trade": {"vehicle_highway": 2.5}}
TRANSPORT_BY_LURE = {"ride": {"vehicle_local": 1.5, "vehicle_highway": 1.5}}
PROFILE_BY_MOTIVE = {"custody": {"local": 1.5}, "trade": {"distant": 2.0}}
SITE_BY_MOTIVE = {"trade": {"motel": 2.2}, "opportunity": {"woods": 1.8}}
TIME_BY_MOTIVE = {"opportunity": {"afternoon": 2.0}}
TIME_BY_LURE = {"online": {"night": 3.0}}
HOURS = {"morning": 6, "afternoon": 14, "night": 20}
RADIUS = {"local": 5.0, "corridor": 20.0, "distant": 60.0}
HIGHWAYS = {"EUROPE": ["I-95", "I-64"], "ASIA": ["I-81"]}
WAYS = ["northbound", "southbound", "eastbound", "westbound"]
CUES = ["left on foot", "was seen near a store", "waited at a stop"]


def pick_sql(choices, salt, *couplings):
    weights = []
    for name, prior in choices:
        w = f"{prior}::DOUBLE"
        for given, table in couplings:
            for value, by in table.items():
                if name in by:
                    w += f" * CASE WHEN {given} = '{value}' THEN {by[name]}::DOUBLE ELSE 1.0 END"
        weights.append(f"({w})")
    total = "(" + " + ".join(weights) + ")"
    u = f"((case_id * 7919 + {salt * 104729}) % 10007)::DOUBLE / 10007.0"
    return "CASE " + " ".join(f"WHEN {' + '.join(weights[: k + 1])} >= {u} * {total} THEN '{choices[k][0]}'" for k in range(len(choices) - 1)) + f" ELSE '{choices[-1][0]}' END"


_BAND = "CASE WHEN age <= 12 THEN 'child' WHEN age <= 17 THEN 'teen' END"
CHAIN = f"""g0 AS (SELECT case_id, state, {_BAND} AS band FROM cases), g1 AS (SELECT *, {pick_sql(MOTIVES, 1, ('state', BY_REGION), ('band', BY_AGE))} AS motive FROM g0),
g2 AS (SELECT *, {pick_sql(LURES, 2, ('motive', LURE_BY_MOTIVE))} AS lure FROM g1),
chain AS (SELECT *, {pick_sql(TRANSPORT, 3, ('motive', TRANSPORT_BY_MOTIVE), ('lure', TRANSPORT_BY_LURE))} AS transport, {pick_sql(PROFILES, 4, ('motive', PROFILE_BY_MOTIVE))} AS profile, {pick_sql(SITES, 5, ('motive', SITE_BY_MOTIVE))} AS site, {pick_sql(TIMES, 6, ('motive', TIME_BY_MOTIVE), ('lure', TIME_BY_LURE))} AS time FROM g2)"""


def chain(spark, sf):
    """Every case with its draws; each draw may lean on earlier ones."""
    c = V.cases(spark, sf).select("case_id", "state", F.when(F.col("age") <= 12, "child").when(F.col("age") <= 17, "teen").alias("band"))
    u = lambda k: S.uniform(F.col("case_id"), k)
    motive, lure = F.col("motive"), F.col("lure")
    c = c.withColumn("motive", S.pick(MOTIVES, u(1), (F.col("state"), BY_REGION), (F.col("band"), BY_AGE)))
    c = c.withColumn("lure", S.pick(LURES, u(2), (motive, LURE_BY_MOTIVE)))
    c = c.withColumn("transport", S.pick(TRANSPORT, u(3), (motive, TRANSPORT_BY_MOTIVE), (lure, TRANSPORT_BY_LURE)))
    c = c.withColumn("profile", S.pick(PROFILES, u(4), (motive, PROFILE_BY_MOTIVE))).withColumn("site", S.pick(SITES, u(5), (motive, SITE_BY_MOTIVE)))
    return c.withColumn("time", S.pick(TIMES, u(6), (motive, TIME_BY_MOTIVE), (lure, TIME_BY_LURE)))


def _draw(name):
    def f(spark, sf):
        return chain(spark, sf).select("case_id", name)

    f.__name__ = f"sampled_{name}"
    return f


for _name in ("motive", "lure", "transport", "profile", "site", "time"):
    query("cases", CHAIN + f" SELECT case_id, {_name} FROM chain")(_draw(_name))


@query("cases", CHAIN + " SELECT case_id, CASE time WHEN 'morning' THEN 6 WHEN 'afternoon' THEN 14 ELSE 20 END AS hour, CASE profile WHEN 'local' THEN 5.0::DOUBLE WHEN 'corridor' THEN 20.0 ELSE 60.0 END AS radius FROM chain")
def drawn_parameters(spark, sf):
    """Hours and radius hints of what was drawn; a name without parameters is an error."""
    return chain(spark, sf).select("case_id", S.looked_up(F.col("time"), HOURS, "time").cast("int").alias("hour"), S.looked_up(F.col("profile"), RADIUS, "profile").cast("double").alias("radius"))


_CUE = f"CASE WHEN state = 'EUROPE' THEN 'headed ' || {WAYS!r}[(case_id * 31) % 4 + 1] || ' on ' || ['I-95', 'I-64'][(case_id * 17) % 2 + 1] WHEN state = 'ASIA' THEN 'headed ' || {WAYS!r}[(case_id * 31) % 4 + 1] || ' on I-81' ELSE {CUES!r}[case_id % 3 + 1] END"


def cue(state, key):
    """A highway of the region with a direction, else one of the plain cues."""
    at = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    out = at(CUES, key)
    for region, roads in HIGHWAYS.items():
        out = F.when(state == region, F.concat(F.lit("headed "), at(WAYS, key * 31), F.lit(" on "), at(roads, key * 17))).otherwise(out)
    return out


@query("cases", f"SELECT case_id, {_CUE} AS cue FROM cases")
def movement_cues(spark, sf):
    return V.cases(spark, sf).select("case_id", cue(F.col("state"), F.col("case_id")).alias("cue"))


@query("cases", CHAIN + f" SELECT format('GRD-2025-{{:06d}}', case_id) AS id, format('z{{:02d}}', case_id % 40) AS zone_id, format('z{{:04d}}', case_id) AS long_id, motive, lure, transport, profile, site, time, {_CUE} AS cue FROM chain")
def generated_cases(spark, sf):
    """The generator as a source: a row for each number, all else drawn from it, so a repeat gives the same cases."""
    k = F.col("case_id")
    return chain(spark, sf).select(F.format_string("GRD-2025-%06d", k).alias("id"), F.format_string("z%02d", k % 40).alias("zone_id"), F.format_string("z%04d", k).alias("long_id"), "motive", "lure", "transport", "profile", "site", "time", cue(F.col("state"), k).alias("cue"))
