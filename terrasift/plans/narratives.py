"""Queries on cases and their narratives: cleaning, validation, extraction, rules, text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo as G
from ..functions import text as T
from . import views as V
from .base import Registry

query = Registry()
QUERIES, SQL = query.queries, query.sql

#: A narrative for each case, whose phrases bring every rule to bear.
STORIES = ["seen near I-95 with an unknown adult", "asked to get in; offered the child a ride", "a threat with a knife was reported", "remains in town, same city", "walked home", "taken out of state past US-29 and VA-7", "grooming online, possible trafficking", "reported missing 30 hours later"]


def narratives(spark, sf):
    story = F.element_at(F.array(*[F.lit(s) for s in STORIES]), (F.col("case_id") % len(STORIES) + 1).cast("int"))
    c = V.cases(spark, sf)
    head = F.concat(F.lit("Missing Person: Child_"), F.col("case_id").cast("string"), F.lit(", "), F.coalesce(F.col("age").cast("string"), F.lit("9")), F.lit("-year-old "), F.when(F.col("case_id") % 2 == 0, "female").otherwise("male"), F.lit(". "))
    return c.withColumn("text", F.concat(head, story, F.lit(".\n- one\n• two\n")))


_STORY = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in STORIES) + f"][case_id % {len(STORIES)} + 1]"
N = f"n AS (SELECT *, 'Missing Person: Child_' || case_id || ', ' || coalesce(age::VARCHAR, '9') || '-year-old ' || CASE WHEN case_id % 2 = 0 THEN 'female' ELSE 'male' END || '. ' || {_STORY} || '.' || chr(10) || '- one' || chr(10) || '• two' || chr(10) AS text FROM cases)"


@query("cases", "SELECT case_id, age, CASE WHEN age <= 12 THEN 'child' WHEN age <= 17 THEN 'teen' END AS band, lat, lon FROM cases WHERE upper(state) = 'EUROPE' AND age IS NOT NULL AND lat BETWEEN 36 AND 40 AND lon BETWEEN -84 AND -75")
def clean_cases(spark, sf):
    c = V.cases(spark, sf).filter((F.upper("state") == "EUROPE") & F.col("lat").between(36, 40) & F.col("lon").between(-84, -75)).dropna(subset=["age", "lat", "lon"])
    return c.select("case_id", "age", F.when(F.col("age") <= 12, "child").when(F.col("age") <= 17, "teen").alias("band"), "lat", "lon")


@query("cases", """SELECT case_id, list_filter([CASE WHEN age IS NULL THEN 'missing age' END, CASE WHEN gender IS NULL THEN 'missing gender' END, CASE WHEN county IS NULL THEN 'missing county' END,
CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing coordinates' END, CASE WHEN NOT (lat BETWEEN -90 AND 90) THEN 'latitude out of range' END, CASE WHEN reported = '' THEN 'missing report time' END], lambda x: x IS NOT NULL) AS issues FROM cases""")
def validation_issues(spark, sf):
    rule = lambda c, name: F.when(c, F.lit(name))
    c = F.col
    issues = F.array_compact(F.array(rule(c("age").isNull(), "missing age"), rule(c("gender").isNull(), "missing gender"), rule(c("county").isNull(), "missing county"), rule(c("lat").isNull() | c("lon").isNull(), "missing coordinates"), rule(~c("lat").between(-90, 90), "latitude out of range"), rule(c("reported") == "", "missing report time")))
    return V.cases(spark, sf).select("case_id", issues.alias("issues"))


@query("cases", """SELECT dim, key, count(*) AS n FROM (SELECT 'age' AS dim, age::VARCHAR AS key FROM cases WHERE age IS NOT NULL UNION ALL SELECT 'gender', gender FROM cases WHERE gender IS NOT NULL
UNION ALL SELECT 'county', coalesce(county, 'Unknown') FROM cases UNION ALL SELECT 'city', coalesce(city, 'Unknown') FROM cases UNION ALL SELECT 'state', coalesce(state, 'Unknown') FROM cases) GROUP BY dim, key""")
def eda_counts(spark, sf):
    """Counts over five dimensions in one pass: grouping sets, so each row is read once."""
    c = V.cases(spark, sf)
    pairs = F.expr("stack(5, 'age', CAST(age AS STRING), 'gender', gender, 'county', coalesce(county, 'Unknown'), 'city', coalesce(city, 'Unknown'), 'state', coalesce(state, 'Unknown')) AS (dim, key)")
    return c.select(pairs).filter("key IS NOT NULL").groupBy("dim", "key").agg(F.count(F.lit(1)).alias("n"))


@query("cases", "SELECT county, count(*) AS n FROM cases WHERE county IS NOT NULL GROUP BY county ORDER BY n DESC, county LIMIT 10")
def county_topn(spark, sf):
    return V.cases(spark, sf).filter("county IS NOT NULL").groupBy("county").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "county").limit(10)


@query("cases", "b AS (SELECT min(age) AS lo, max(age) AS hi, least(25, count(DISTINCT age)) AS k FROM cases) SELECT least(k - 1, floor((age - lo) * k / (hi - lo)::DOUBLE))::INT AS bin, count(*) AS n FROM cases, b WHERE age IS NOT NULL GROUP BY 1")
def age_histogram(spark, sf):
    c = V.cases(spark, sf).filter("age IS NOT NULL")
    b = c.agg(F.min("age").alias("lo"), F.max("age").alias("hi"), F.least(F.lit(25), F.count_distinct("age")).alias("k"))
    bin_ = F.least(F.col("k") - 1, F.floor((F.col("age") - F.col("lo")) * F.col("k") / (F.col("hi") - F.col("lo")))).cast("int")
    return c.crossJoin(F.broadcast(b)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("cases", """t AS (SELECT *, trim(regexp_replace(city, '\\s+', ' ', 'g')) AS ct, trim(regexp_replace(county, '(?i)\\bcounty\\b', '', 'g')) AS co FROM cases)
SELECT case_id, age, CASE WHEN lower(trim(gender)) LIKE 'm%' THEN 'M' WHEN lower(trim(gender)) LIKE 'f%' THEN 'F' END AS gender,
CASE WHEN lower(ct) IN ('', 'unknown', 'n/a', 'na', 'none') THEN NULL ELSE array_to_string(list_transform(string_split(lower(ct), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS city,
CASE WHEN lower(co) IN ('', 'unknown') THEN NULL ELSE array_to_string(list_transform(string_split(lower(co), ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS county,
replace(reported, '+00:00', 'Z') AS reported FROM t""")
def min_records(spark, sf):
    return V.cases(spark, sf).select("case_id", "age", T.gender(F.col("gender")).alias("gender"), T.city(F.col("city")).alias("city"), T.county(F.col("county")).alias("county"), T.utc(F.col("reported")).alias("reported"))


@query("cases", "SELECT case_id, floor(abs(minutes))::BIGINT // 60 || 'h ' || floor(abs(minutes))::BIGINT % 60 || 'm' AS span, CASE WHEN reported = '' THEN 'day' WHEN try_cast(substr(reported, 12, 2) AS INT) BETWEEN 6 AND 19 THEN 'day' ELSE 'night' END AS bucket FROM cases")
def day_night_bucket(spark, sf):
    hour = F.hour(F.try_to_timestamp(F.col("reported")))
    return V.cases(spark, sf).select("case_id", T.span(F.abs("minutes")).alias("span"), F.when(hour.isNull() | hour.between(6, 19), "day").otherwise("night").alias("bucket"))


@query("cases", "SELECT case_id, CASE WHEN reported = '' THEN NULL ELSE strftime(reported[:19]::TIMESTAMP - INTERVAL 5 HOUR, '%Y-%m-%d %H:%M') END AS local_time FROM cases")
def local_times(spark, sf):
    """January, so New York is five hours behind."""
    t = F.from_utc_timestamp(F.try_to_timestamp(F.col("reported")), "America/New_York")
    return V.cases(spark, sf).select("case_id", F.date_format(t, "yyyy-MM-dd HH:mm").alias("local_time"))


#: Regions as closed boxes, first match wins (fixed values).
REGIONS = [("Northern Virginia", -77.5, 38.3, -77.0, 39.5), ("Central Virginia", -78.5, 37.0, -77.0, 38.3), ("Tidewater", -77.0, 36.5, -75.5, 37.5), ("Southwest", -82.0, 36.5, -80.0, 37.5), ("Valley", -79.0, 38.0, -78.0, 39.0), ("Western Virginia", -80.0, 37.0, -78.5, 38.5), ("Northern Neck", -77.5, 37.5, -76.5, 38.5), ("Southside", -78.5, 36.0, -77.0, 37.0)]
_REGION = "CASE " + " ".join(f"WHEN lat BETWEEN {b} AND {d} AND lon BETWEEN {a} AND {c} THEN '{n}'" for n, a, b, c, d in REGIONS) + " ELSE 'Unknown' END"


@query("places", f"SELECT {_REGION} AS region, count(*) AS n FROM places GROUP BY 1")
def region_lookup(spark, sf):
    return V.places(spark, sf).groupBy(G.first_box(F.col("lat"), F.col("lon"), REGIONS).alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query("places", "SELECT place_id, CASE WHEN lat BETWEEN 38.3 AND 39.5 AND lon BETWEEN -77.5 AND -77.0 THEN 1.86 WHEN lat BETWEEN 36.5 AND 37.5 AND lon BETWEEN -77.0 AND -75.5 THEN 2.17 WHEN lat BETWEEN 37.2 AND 37.8 AND lon BETWEEN -77.8 AND -77.1 THEN 2.17 ELSE 3.73 END::DOUBLE AS sigma FROM places")
def sigma_rule(spark, sf):
    return V.places(spark, sf).select("place_id", G.sigma_miles(F.col("lat"), F.col("lon")).alias("sigma"))


@query("points", "SELECT round(min(lat), 6) AS lat1, round(max(lat), 6) AS lat2, round(min(lon), 6) AS lon1, round(max(lon), 6) AS lon2 FROM points")
def extent(spark, sf):
    return V.points(spark, sf).agg(*[F.round(f(c), 6).alias(f"{c}{k}") for c in ("lat", "lon") for k, f in ((1, F.min), (2, F.max))])


@query("points", "SELECT pid, (((37.0 > lat) <> (39.0 > lat) AND lon < (-78.0 - -82.0) * (lat - 37.0) / 2.0 + -82.0)::INT + ((39.0 > lat) <> (36.7 > lat) AND lon < (-76.5 - -78.0) * (lat - 39.0) / (36.7 - 39.0) + -78.0)::INT + ((36.7 > lat) <> (37.0 > lat) AND lon < (-82.0 - -76.5) * (lat - 36.7) / (37.0 - 36.7) + -76.5)::INT) % 2 = 1 AS inside FROM points")
def point_in_polygon(spark, sf):
    return V.points(spark, sf).select("pid", G.in_polygon(F.col("lon"), F.col("lat"), [(-82.0, 37.0), (-78.0, 39.0), (-76.5, 36.7)]).alias("inside"))


@query("cases", """g AS (SELECT lower(n_name) || ' county' AS name, 30.0::DOUBLE + n_nationkey AS glat FROM nation WHERE n_nationkey % 4 <> 0), m AS (SELECT lower(c_mktsegment) AS name, 60.0::DOUBLE + min(c_custkey) AS glat FROM customer GROUP BY 1)
SELECT case_id, coalesce(g.glat, m.glat) AS glat FROM cases LEFT JOIN g ON lower(cases.county) = g.name LEFT JOIN m ON lower(cases.city) = m.name""")
def geocode_lookup(spark, sf):
    """County first, then city; gazetteers are small dimensions."""
    g = V.table(spark, sf, "nation").filter("n_nationkey % 4 <> 0").select(F.concat(F.lower("n_name"), F.lit(" county")).alias("gname"), (F.lit(30.0) + F.col("n_nationkey")).alias("g1"))
    m = V.table(spark, sf, "customer").groupBy(F.lower("c_mktsegment").alias("mname")).agg((F.lit(60.0) + F.min("c_custkey")).alias("g2"))
    c = V.cases(spark, sf)
    j = c.join(F.broadcast(g), F.lower("county") == F.col("gname"), "left").join(F.broadcast(m), F.lower("city") == F.col("mname"), "left")
    return j.select("case_id", F.coalesce("g1", "g2").alias("glat"))


_R = lambda p: "regexp_matches(text, '(?i)" + p.replace("'", "''") + "')"
_SCORE = " + ".join([
    "CASE WHEN a <= 8 THEN 3 WHEN a <= 12 THEN 2 ELSE 0 END", "CASE WHEN h >= 24 THEN 2 WHEN h >= 12 THEN 1 ELSE 0 END", *[f"CASE WHEN {_R(p)} THEN 4 ELSE 0 END" for p in T.CRITICAL], *[f"CASE WHEN {_R(p)} THEN 3 ELSE 0 END" for p in T.HIGH], *[f"CASE WHEN {_R(p)} THEN 2 ELSE 0 END" for p in T.SIGNS],
    "CASE WHEN " + _R(r"\b(ride|unknown adult|into (a )?vehicle)\b") + " THEN 3 ELSE 0 END", "CASE WHEN " + _R(r"\bentered (a |the )?(vehicle|car)\b") + " THEN 3 ELSE 0 END", "CASE WHEN " + _R(r"\boffered .{0,40}\ba ride\b|\basked to get in\b") + " THEN 3 ELSE 0 END",
    "CASE WHEN a <= 12 AND " + _R(T.INTERSTATE) + " THEN 1 ELSE 0 END", "CASE WHEN " + _R(T.INTERSTATE) + " THEN 1 ELSE 0 END",
])
RISK = N + ", x AS (SELECT *, nullif(regexp_extract(text, '(\\d{1,2})-year-old', 1), '')::INT AS a, nullif(regexp_extract(text, '(?i)reported missing (\\d{1,3}) hours?', 1), '')::INT AS h FROM n), risk AS (SELECT case_id, text, age, " + _SCORE + " AS score FROM x), lev AS (SELECT *, CASE WHEN score >= 4 THEN 'Critical' WHEN score >= 2 THEN 'High' WHEN score >= 1 THEN 'Medium' ELSE 'Low' END AS level FROM risk)"


def risks(spark, sf):
    r = narratives(spark, sf).withColumn("score", T.risk_score(F.col("text"), F.lit(None).cast("double")))
    return r.withColumn("level", T.risk_level(F.col("score")))


@query("cases", RISK + " SELECT case_id, score, level FROM lev")
def risk_rules(spark, sf):
    return risks(spark, sf).select("case_id", "score", "level")


@query("cases", RISK + """, m AS (SELECT *, ['Unknown', 'Low', 'Medium', 'High', 'Critical'][case_id % 5 + 1] AS model FROM lev), o AS (SELECT *, CASE WHEN level = 'Critical' THEN 'Critical' WHEN level = 'High' AND model IN ('Unknown', 'Low', 'Medium') THEN 'High' ELSE model END AS final FROM m)
SELECT case_id, model, level AS rules, final, CASE final WHEN 'Critical' THEN 0.9 WHEN 'High' THEN 0.7 WHEN 'Medium' THEN 0.5 WHEN 'Low' THEN 0.3 ELSE 0.5 END::DOUBLE AS plausibility FROM o""")
def risk_overlay(spark, sf):
    model = F.element_at(F.array(*[F.lit(x) for x in T.LEVELS]), (F.col("case_id") % 5 + 1).cast("int"))
    o = risks(spark, sf).withColumn("model", model).withColumn("final", T.overlay(F.col("model"), F.col("level")))
    p = F.lit(0.5)
    for k, v in T.PLAUSIBILITY.items():
        p = F.when(F.col("final") == k, F.lit(v)).otherwise(p)
    return o.select("case_id", "model", F.col("level").alias("rules"), "final", p.alias("plausibility"))


@query("cases", N + r""" SELECT case_id, CASE WHEN regexp_matches(text, '(?i)\bI-\d{1,3}\b') OR regexp_matches(text, '(?i)\b(interstate|out of state|cross[-\s]state)\b') THEN 'Interstate' WHEN regexp_matches(text, '(?i)\b(no travel|remains? in|still in town|same city)\b') THEN 'Stationary' ELSE 'Unknown' END AS movement,
list_sort(list_distinct(regexp_extract_all(text, '\b(?:I-\d{1,3}|US-\d{1,3}|VA-\d{1,3})\b'))) AS cues FROM n""")
def highway_cues(spark, sf):
    cues = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:I-\d{1,3}|US-\d{1,3}|VA-\d{1,3})\b"), F.lit(0))))
    return narratives(spark, sf).select("case_id", T.movement(F.col("text"), F.lit(None).cast("string")).alias("movement"), cues.alias("cues"))


@query("cases", N + r", m AS (SELECT case_id, regexp_extract(text, 'Missing Person:\s*([A-Za-z0-9_]+),\s*(\d{1,2})-year-old\s+(male|female)', ['name', 'age', 'sex']) AS e, text FROM n) SELECT case_id, e.name AS name, e.age::INT AS age, CASE WHEN e.sex = 'female' THEN 'F' ELSE 'M' END AS gender, len(regexp_extract_all(text, '(?m)^[-•]'))::INT AS bullets FROM m")
def entity_scaffold(spark, sf):
    part = lambda k: F.regexp_extract("text", r"Missing Person:\s*([A-Za-z0-9_]+),\s*(\d{1,2})-year-old\s+(male|female)", k)
    bullets = F.size(F.filter(F.split("text", "\n"), lambda x: F.ltrim(x).rlike("^[-•]")))
    return narratives(spark, sf).select("case_id", part(1).alias("name"), part(2).cast("int").alias("age"), F.when(part(3) == "female", "F").otherwise("M").alias("gender"), bullets.alias("bullets"))


@query("", "SELECT event_id, (props->>'k')::INT AS k, substr(sha1(props), 1, 10) AS params_hash FROM events")
def json_props(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.substring(F.sha1(F.col("props").cast("binary")), 1, 10).alias("params_hash"))


@query("", "SELECT event_id, (regexp_replace(regexp_extract('note: {\"k\": ' || (event_id % 50) || ', \"v\": [1, 2,],} end', '(?s)\\{.*\\}'), ',\\s*([}\\]])', '\\1', 'g')->>'k')::INT AS k FROM events")
def json_repair(spark, sf):
    raw = F.concat(F.lit('note: {"k": '), (F.col("event_id") % 50).cast("string"), F.lit(', "v": [1, 2,],} end'))
    return V.table(spark, sf, "events").select("event_id", F.get_json_object(T.repaired(raw), "$.k").cast("int").alias("k"))


WORDS = r"""w AS (SELECT conv_id, role, regexp_extract_all(lower(string_agg(text, ' ' ORDER BY turn)), '[a-z0-9_]+') AS w FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id, role),
t AS (SELECT conv_id, role, tok, count(*) AS c FROM (SELECT conv_id, role, unnest(w) AS tok FROM w) GROUP BY ALL), b AS (SELECT conv_id, role, tok, count(*) AS c FROM (SELECT conv_id, role, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS tok FROM w) GROUP BY ALL)"""


def said(spark, sf):
    c = V.table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    g = c.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return g.select("conv_id", "role", T.tokens(F.array_join(F.transform("x", lambda s: s["text"]), " ")).alias("w"))


def overlap_f(tokens):
    """(conv_id, f): multiset F of the assistant's tokens against the user's; 0 where either is empty or nothing meets."""
    t = tokens.groupBy("conv_id", "role", "tok").agg(F.count(F.lit(1)).alias("c"))
    u, a = (t.filter(F.col("role") == r).select("conv_id", "tok", F.col("c").alias(r[0])) for r in ("user", "assistant"))
    j = u.join(a, ["conv_id", "tok"], "full_outer").groupBy("conv_id").agg(F.sum(F.least(F.coalesce("u", F.lit(0)), F.coalesce("a", F.lit(0)))).alias("o"), F.sum("u").alias("nu"), F.sum("a").alias("na"))
    p, r = F.col("o") / F.col("na"), F.col("o") / F.col("nu")
    return j.select("conv_id", F.round(F.coalesce(F.when(F.col("o") > 0, 2.0 * p * r / (p + r)), F.lit(0.0)), 6).alias("f"))


_F = """, j AS (SELECT conv_id, sum(least(coalesce(u.c, 0), coalesce(a.c, 0))) AS o, sum(u.c) AS nu, sum(a.c) AS na FROM (SELECT * FROM {0} WHERE role = 'user') u FULL JOIN (SELECT * FROM {0} WHERE role = 'assistant') a USING (conv_id, tok) GROUP BY conv_id)
SELECT conv_id, round(coalesce(CASE WHEN o > 0 THEN 2.0::DOUBLE * (o / na) * (o / nu) / (o / na + o / nu) END, 0.0), 6)::DOUBLE AS f FROM j"""


@query("", "WITH " + WORDS + _F.format("t"))
def rouge1(spark, sf):
    return overlap_f(said(spark, sf).select("conv_id", "role", F.explode("w").alias("tok")))


@query("", "WITH " + WORDS + _F.format("b"))
def rouge2(spark, sf):
    return overlap_f(said(spark, sf).select("conv_id", "role", F.explode(T.bigrams(F.col("w"))).alias("tok")))


@query("", "WITH " + WORDS + """, s AS (SELECT DISTINCT role, tok FROM t), g AS (SELECT tok, bool_or(role = 'assistant') AS p, bool_or(role = 'user') AS g FROM s GROUP BY tok), c AS (SELECT sum((p AND g)::INT) AS tp, sum((p AND NOT g)::INT) AS fp, sum((g AND NOT p)::INT) AS fn FROM g)
SELECT round(tp / (tp + fp), 6)::DOUBLE AS p, round(tp / (tp + fn), 6)::DOUBLE AS r, round(2.0::DOUBLE * tp / (2.0 * tp + fp + fn), 6)::DOUBLE AS f1 FROM c""")
def micro_prf(spark, sf):
    s = said(spark, sf).select("role", F.explode("w").alias("tok")).groupBy("tok").agg(F.bool_or(F.col("role") == "assistant").alias("p"), F.bool_or(F.col("role") == "user").alias("g"))
    c = s.agg(*[F.count_if(x).alias(n) for n, x in (("tp", F.col("p") & F.col("g")), ("fp", F.col("p") & ~F.col("g")), ("fn", F.col("g") & ~F.col("p")))])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.round(F.try_divide(tp, tp + fp), 6).alias("p"), F.round(F.try_divide(tp, tp + fn), 6).alias("r"), F.round(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), 6).alias("f1"))


@query("", "WITH " + WORDS + """, s AS (SELECT conv_id, list_distinct(list(tok) FILTER (role = 'assistant')) AS p, list_distinct(list(tok) FILTER (role = 'user')) AS g FROM t GROUP BY conv_id),
f AS (SELECT conv_id, CASE WHEN p IS NULL OR g IS NULL THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(p, g)) / (len(p) + len(g)) END AS f FROM s) SELECT round(avg(f), 6) AS macro_f1 FROM f""")
def macro_f1(spark, sf):
    s = said(spark, sf).select("conv_id", "role", F.explode("w").alias("tok")).distinct()
    g = s.groupBy("conv_id").agg(F.collect_set(F.when(F.col("role") == "assistant", F.col("tok"))).alias("p"), F.collect_set(F.when(F.col("role") == "user", F.col("tok"))).alias("g"))
    f = F.when((F.size("p") == 0) | (F.size("g") == 0), 0.0).otherwise(2.0 * F.size(F.array_intersect("p", "g")) / (F.size("p") + F.size("g")))
    return g.agg(F.round(F.avg(f), 6).alias("macro_f1"))


LABELS = "l AS (SELECT doc_id, toxic AS gold, ((doc_id * 37) % 101)::DOUBLE / 101.0 AS p FROM labels)"


def label_pairs(spark, sf):
    return V.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("gold"), (((F.col("doc_id") * 37) % 101).cast("double") / 101.0).alias("p"))


@query("", "WITH " + LABELS + ", d AS (SELECT g, h FROM range(2) a(g), range(2) b(h)), c AS (SELECT gold AS g, (p >= 0.5)::INT AS h, count(*) AS n FROM l GROUP BY 1, 2) SELECT d.g::INT AS gold, d.h::INT AS predicted, coalesce(n, 0) AS n FROM d LEFT JOIN c USING (g, h)")
def confusion_matrix(spark, sf):
    d = spark.createDataFrame([(g, h) for g in (0, 1) for h in (0, 1)], "gold int, predicted int")
    c = label_pairs(spark, sf).groupBy(F.col("gold").cast("int").alias("gold"), (F.col("p") >= 0.5).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return d.join(c, ["gold", "predicted"], "left").select("gold", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


@query("", "WITH " + LABELS + ", c AS (SELECT gold, (p >= 0.5)::INT AS h FROM l), k AS (SELECT k, sum((gold = k AND h = k)::INT) AS tp, sum((gold <> k AND h = k)::INT) AS fp, sum((gold = k AND h <> k)::INT) AS fn FROM c, range(2) t(k) GROUP BY k) SELECT round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) ELSE 0 END), 6) AS macro_f1 FROM k")
def macro_f1_classes(spark, sf):
    c = label_pairs(spark, sf).select("gold", (F.col("p") >= 0.5).cast("int").alias("h")).crossJoin(F.broadcast(spark.createDataFrame([(0,), (1,)], "k int")))
    k = c.groupBy("k").agg(F.count_if((F.col("gold") == F.col("k")) & (F.col("h") == F.col("k"))).alias("tp"), F.count_if((F.col("gold") != F.col("k")) & (F.col("h") == F.col("k"))).alias("fp"), F.count_if((F.col("gold") == F.col("k")) & (F.col("h") != F.col("k"))).alias("fn"))
    return k.agg(F.round(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))), 6).alias("macro_f1"))


@query("", "WITH " + LABELS + " SELECT round(avg(pow(p - gold, 2.0)), 6) AS brier FROM l")
def brier(spark, sf):
    return label_pairs(spark, sf).agg(F.round(F.avg(F.pow(F.col("p") - F.col("gold"), F.lit(2.0))), 6).alias("brier"))


@query("", "WITH " + LABELS + ", x AS (SELECT sum(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS w, count(*) AS n FROM l a, l b WHERE a.gold = 1 AND b.gold = 0) SELECT round(w / n, 6)::DOUBLE AS auc, n AS n_pairs FROM x")
def auc(spark, sf):
    """Mann-Whitney from counts by score, so nothing is paired; the running sum is over distinct scores."""
    s = label_pairs(spark, sf).groupBy("p").agg(F.count_if(F.col("gold") == 1).alias("pos"), F.count_if(F.col("gold") == 0).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = s.withColumn("below", below).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("w"), (F.sum("pos") * F.sum("neg")).alias("n"))
    return t.select(F.round(F.try_divide("w", "n"), 6).alias("auc"), F.col("n").alias("n_pairs"))


@query("", "SELECT p_partkey, CASE WHEN position('.' IN r) > 0 THEN trim(split_part(r, '.', 1)) WHEN position('Rd' IN r) > 0 THEN trim(split_part(r, 'Rd', 1)) WHEN position('Ave' IN r) > 0 THEN trim(split_part(r, 'Ave', 1)) ELSE trim(r) END AS road FROM (SELECT p_partkey, p_brand || [' Rd north', ' Ave', '. note', ' lane '][p_partkey % 4 + 1] AS r FROM part)")
def road_names(spark, sf):
    r = F.concat("p_brand", F.element_at(F.array(F.lit(" Rd north"), F.lit(" Ave"), F.lit(". note"), F.lit(" lane ")), (F.col("p_partkey") % 4 + 1).cast("int")))
    return V.table(spark, sf, "part").select("p_partkey", T.clean_road(r).alias("road"))


@query("cases", "e AS (SELECT DISTINCT case_id + 5 AS case_id FROM cases) SELECT case_id FROM e WHERE case_id NOT IN (SELECT case_id FROM cases)")
def missing_outputs(spark, sf):
    c = V.cases(spark, sf).select("case_id")
    return c.select((F.col("case_id") + 5).alias("case_id")).distinct().join(c, "case_id", "left_anti")


@query("cases", "SELECT round(avg((age IS NOT NULL)::INT), 6) AS with_age, round(avg((lat IS NOT NULL AND lon IS NOT NULL)::INT), 6) AS with_coordinates, round(avg((lat BETWEEN 36 AND 40 AND lon BETWEEN -84 AND -75)::INT), 6) AS inside, round(avg((reported = '')::INT), 6) AS errors FROM cases")
def ops_rates(spark, sf):
    share = lambda c, n: F.round(F.avg(c.cast("int")), 6).alias(n)
    c = F.col
    return V.cases(spark, sf).agg(share(c("age").isNotNull(), "with_age"), share(c("lat").isNotNull() & c("lon").isNotNull(), "with_coordinates"), share(c("lat").between(36, 40) & c("lon").between(-84, -75), "inside"), share(c("reported") == "", "errors"))


#: Prior, coupling and bias of a sampling chain; fixed example values.
MOTIVES = [("m1", 0.52), ("m2", 0.3), ("m3", 0.18)]


@query("cases", """p AS (SELECT * FROM (VALUES (1, 'm1', 0.52::DOUBLE), (2, 'm2', 0.3), (3, 'm3', 0.18)) t(pos, id, prior)), w AS (SELECT case_id, pos, id, prior * CASE WHEN state = 'EUROPE' AND id = 'm2' THEN 2.0 ELSE 1.0 END AS w, ((case_id * 7919) % 10007)::DOUBLE / 10007.0 AS u FROM cases, p),
c AS (SELECT *, sum(w) OVER (PARTITION BY case_id ORDER BY pos) AS cum, sum(w) OVER (PARTITION BY case_id) AS t FROM w) SELECT case_id, arg_min(id, pos) AS motive FROM c WHERE cum >= u * t GROUP BY case_id""")
def weighted_choice(spark, sf):
    """Inverse distribution of prior times coupling; the choices are a short literal list, folded within the row."""
    weights = [F.lit(w) * (F.when(F.col("state") == "EUROPE", 2.0).otherwise(1.0) if m == "m2" else F.lit(1.0)) for m, w in MOTIVES]
    u = ((F.col("case_id") * 7919) % 10007).cast("double") / F.lit(10007.0) * T.add(weights)
    out, cum = F.lit(MOTIVES[-1][0]), None
    steps = []
    for (m, _), w in zip(MOTIVES, weights, strict=True):
        cum = w if cum is None else cum + w
        steps.append((cum, m))
    for c, m in reversed(steps):
        out = F.when(c >= u, F.lit(m)).otherwise(out)
    return V.cases(spark, sf).select("case_id", out.alias("motive"))


@query("cases windows", "z AS (SELECT case_id, win, k, 5.0::DOUBLE + ws / 72.0 * 45.0 AS r, ((case_id * 31 + win * 7 + k) % 97)::DOUBLE / 97.0 AS u FROM cases, windows, range(2) t(k)) SELECT case_id, win, k AS zone, round(r * (0.8::DOUBLE + 0.4::DOUBLE * u), 6) AS radius, round(0.3::DOUBLE + 0.6::DOUBLE * u, 6) AS priority FROM z")
def search_zones(spark, sf):
    """Two zones for each case and window."""
    z = V.cases(spark, sf).select("case_id").crossJoin(F.broadcast(V.windows(spark))).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")))
    u = ((F.col("case_id") * 31 + F.col("win") * 7 + F.col("k")) % 97).cast("double") / F.lit(97.0)
    return z.select("case_id", "win", F.col("k").alias("zone"), F.round((F.lit(5.0) + F.col("ws") / 72.0 * 45.0) * (F.lit(0.8) + F.lit(0.4) * u), 6).alias("radius"), F.round(F.lit(0.3) + F.lit(0.6) * u, 6).alias("priority"))
