"""Tolerant readers of case documents and planning files, and the sinks that write them.

Everything goes through Spark's readers, so any store that Spark reaches will do. Files that are one JSON value, lines of
JSON, or pretty-printed objects one after another are told apart by content, not by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CASE = """
case_id STRING,
demographic STRUCT<name: STRING, age_years: DOUBLE, gender: STRING, risk_factors: ARRAY<STRING>>,
spatial STRUCT<last_seen_location: STRING, last_seen_city: STRING, last_seen_county: STRING, last_seen_state: STRING, last_seen_lat: DOUBLE, last_seen_lon: DOUBLE>,
temporal STRUCT<last_seen_ts: STRING, reported_missing_ts: STRING, elapsed_report_minutes: INT,
  follow_up_sightings: ARRAY<STRUCT<ts: STRING, lat: DOUBLE, lon: DOUBLE, event_type: STRING, confidence: DOUBLE>>>,
outcome STRUCT<case_status: STRING, recovery_ts: STRING, recovery_lat: DOUBLE, recovery_lon: DOUBLE>,
narrative_osint STRUCT<incident_summary: STRING, movement_cues_text: STRING>
"""
HOTSPOT = "lon DOUBLE, lat DOUBLE, weight DOUBLE, radius_miles DOUBLE"
ZONE = "zone_id STRING, center_lat DOUBLE, center_lon DOUBLE, radius_miles DOUBLE, priority DOUBLE, priority_llm DOUBLE, score DOUBLE"


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, body): the JSON objects of every file, whether one a file, in an array, one a line or printed over lines.

    Files of one path are laid out alike. If the first line is an object of its own, files are read by lines, so that a large
    one is split over tasks; otherwise a file is one value and should be of moderate size. Objects that don't parse are kept
    for the caller.
    """
    line = spark.read.text(path).filter(F.trim("value") != "").limit(1)
    if line.filter(F.startswith(F.trim("value"), F.lit("{")) & F.try_parse_json("value").isNotNull()).head(1):
        rows = spark.read.text(path).filter(F.trim("value") != "")
        return rows.select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("body"))
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    array = F.from_json("value", "ARRAY<STRING>")
    parts = F.when(F.startswith("value", F.lit("[")), array).otherwise(F.split("value", r"(?<=\})\s*\n\s*(?=\{)"))
    return raw.select("file", F.posexplode(parts).alias("pos", "body")).filter(F.trim("body") != "").withColumn("pos", F.col("pos").cast("long"))


def document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The one JSON document of each file; a file that isn't one is an error, as is a path without files."""
    raw = spark.read.text(path, wholetext=True)
    bad = F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 80)))
    return raw.select(F.from_json(F.when(F.try_parse_json("value").isNull(), bad).otherwise(F.col("value")), schema).alias("d")).select("d.*")


def results(spark: SparkSession, path: str, schema: str, key: str, needed: str) -> DataFrame:
    """Results by key, the last of a key, without those that lack `needed`."""
    rows = json_objects(spark, path).select("file", "pos", F.from_json("body", schema).alias("d")).filter(F.col(f"d.{needed}").isNotNull())
    return rows.groupBy(F.col(f"d.{key}").alias("_key")).agg(F.max_by("d", F.struct("file", "pos")).alias("d")).select("d.*")


def findings(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """(value, pos): the lists `fields` of all files as one list, each value once whatever its case, in order of first sight."""
    schema = ", ".join(f"{f} ARRAY<STRING>" for f in fields)
    d = json_objects(spark, path).select("file", "pos", F.from_json("body", schema).alias("d"))
    whole = F.concat(*[F.transform(F.coalesce(F.col(f"d.{f}"), F.array().cast("array<string>")), lambda x, k=k: F.struct(F.lit(k).alias("field"), F.trim(x).alias("value"))) for k, f in enumerate(fields)])
    rows = d.select("file", "pos", F.posexplode(whole).alias("place", "x")).filter("x.value <> ''")
    first = rows.groupBy(F.lower("x.value").alias("low")).agg(F.min(F.struct("file", "pos", "place", F.col("x.value").alias("value"))).alias("m"))
    return first.select("low", "m.value", "m.file", "m.pos", "m.place")


def corridors(spark: SparkSession, lines: str | None, roads: str | None = None) -> DataFrame:
    """(line, part, x1, y1, x2, y2): segments of the line features of a GeoJSON file; else of a road list; else none."""
    segment = "line STRING, part INT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE"
    if lines:
        schema = "ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: STRING>>>"
        f = spark.read.text(lines, wholetext=True).select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), schema)).alias("pos", "f"))
        single = F.array(F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<DOUBLE>>"))
        paths = F.when(F.col("f.geometry.type") == "LineString", single).when(F.col("f.geometry.type") == "MultiLineString", F.from_json("f.geometry.coordinates", "ARRAY<ARRAY<ARRAY<DOUBLE>>>"))
        rows = f.select(F.coalesce(F.col("f.properties")["name"], F.col("pos").cast("string")).alias("line"), F.explode(paths).alias("p"))
    elif roads:
        schema = "ARRAY<STRUCT<name: STRING, coordinates: ARRAY<ARRAY<DOUBLE>>>>"
        rows = spark.read.text(roads, wholetext=True).select(F.explode(F.from_json("value", schema)).alias("r")).select(F.col("r.name").alias("line"), F.col("r.coordinates").alias("p"))
    else:
        return spark.createDataFrame([], segment)
    pairs = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")))
    return rows.filter("size(p) > 1").select("line", F.posexplode(pairs).alias("part", "s")).select("line", "part", "s.*")


def cases(spark: SparkSession, path: str, schema: str = CASE) -> DataFrame:
    """Parsed case documents and `bad`, true for objects that are not JSON."""
    rows = json_objects(spark, path)
    parsed = rows.withColumn("doc", F.from_json("body", schema.replace("\n", " ")))
    return parsed.select("file", "pos", "doc.*", F.try_parse_json("body").isNull().alias("bad"))


def case_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, lat, lon) of valid coordinates; only these fields are parsed."""
    rows = json_objects(spark, path).withColumn("doc", F.from_json("body", "case_id STRING, spatial STRUCT<last_seen_lat: STRING, last_seen_lon: STRING>"))
    out = rows.select("doc.case_id", F.col("doc.spatial.last_seen_lat").try_cast("double").alias("lat"), F.col("doc.spatial.last_seen_lon").try_cast("double").alias("lon"))
    return out.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def points(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat): flat coordinates, else those under spatial, else those under location."""
    schema = "lon DOUBLE, lat DOUBLE, spatial STRUCT<last_seen_lat: DOUBLE, last_seen_lon: DOUBLE>, location STRUCT<lat: DOUBLE, lon: DOUBLE>"
    d = json_objects(spark, path).select(F.from_json("body", schema).alias("d"))
    out = d.select(F.coalesce("d.lon", "d.spatial.last_seen_lon", "d.location.lon").alias("lon"), F.coalesce("d.lat", "d.spatial.last_seen_lat", "d.location.lat").alias("lat"))
    return out.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))


def csv_cases(spark: SparkSession, path: str, schema: str, state: str | None = None) -> DataFrame:
    """Cases from CSV with a header, of one state if given."""
    rows = spark.read.csv(path, header=True, schema=schema)
    return rows.filter(F.upper("state") == state.upper()) if state and "state" in rows.columns else rows


def hotspots(spark: SparkSession, path: str) -> DataFrame:
    """Hotspots as objects, or as arrays [lon, lat, weight, radius]; missing weight and radius are 0."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "ARRAY<STRING>")).alias("body"))
    o, a = F.from_json("body", HOTSPOT), F.from_json("body", "ARRAY<DOUBLE>")
    both = raw.select(o.alias("o"), a.alias("a"))
    pick = lambda name, k: F.coalesce(F.col(f"o.{name}"), F.try_element_at("a", F.lit(k)))
    out = both.select(pick("lon", 1).alias("lon"), pick("lat", 2).alias("lat"), F.coalesce(pick("weight", 3), F.lit(0.0)).alias("weight"), F.coalesce(pick("radius_miles", 4), F.lit(0.0)).alias("radius_miles"))
    return out.filter("lon IS NOT NULL AND lat IS NOT NULL")


def zones(spark: SparkSession, path: str) -> DataFrame:
    """A row for each zone of {case_id, zones}, zones being a list or a map from window to list."""
    rows = json_objects(spark, path)
    body = rows.select(F.get_json_object("body", "$.case_id").alias("case_id"), F.get_json_object("body", "$.zones").alias("z"))
    fields = ZONE.replace(" STRING", ": STRING").replace(" DOUBLE", ": DOUBLE")
    listed = body.filter(F.startswith("z", F.lit("["))).select("case_id", F.lit(None).cast("string").alias("window"), F.posexplode(F.from_json("z", f"ARRAY<STRUCT<{fields}>>")).alias("pos", "zone"))
    mapped = body.filter(F.startswith("z", F.lit("{"))).select("case_id", F.explode(F.from_json("z", f"MAP<STRING, ARRAY<STRUCT<{fields}>>>")).alias("window", "list")).select("case_id", "window", F.posexplode("list").alias("pos", "zone"))
    return listed.unionByName(mapped).select("case_id", "window", "pos", "zone.*")


def truth_map(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, lat, lon) of a {case: {lat, lon}} file; values of other kinds are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("case_id", "v"))
    return raw.select("case_id", F.from_json("v", "lat DOUBLE, lon DOUBLE").alias("p")).filter("p.lat IS NOT NULL AND p.lon IS NOT NULL").select("case_id", "p.*")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(name, lat, lon, type): entries in a list, or by name, with their aliases; the first of a name stays."""
    entry = "STRUCT<name: STRING, type: STRING, lat: DOUBLE, lon: DOUBLE, aliases: ARRAY<STRING>>"
    raw = spark.read.text(path, wholetext=True)
    listed = raw.select(F.posexplode(F.from_json(F.get_json_object("value", "$.entries"), f"ARRAY<{entry}>")).alias("pos", "e"))
    keyed = raw.filter(F.get_json_object("value", "$.entries").isNull()).select(F.explode(F.from_json("value", f"MAP<STRING, {entry}>")).alias("k", "e")).select(F.lit(0).alias("pos"), F.col("e").withField("name", F.coalesce("e.name", "k")).alias("e"))
    both = listed.unionByName(keyed)
    names = F.explode(F.array_union(F.array("e.name"), F.coalesce("e.aliases", F.array().cast("array<string>"))))
    rows = both.select("pos", names.alias("name"), "e.type", "e.lat", "e.lon").withColumn("name", F.lower("name"))
    first = Window.partitionBy("name").orderBy("pos")
    return rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "pos")


def features(spark: SparkSession, path: str) -> DataFrame:
    """(pos, properties map, ring): polygon features of a GeoJSON file, by their outer ring; other geometries have none."""
    schema = "ARRAY<STRUCT<properties: MAP<STRING, STRING>, geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>>>"
    raw = spark.read.text(path, wholetext=True)
    f = raw.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), schema)).alias("pos", "f"))
    return f.select("pos", "f.properties", F.col("f.geometry.coordinates")[0].alias("ring"))


def ground_truth(rows: DataFrame) -> DataFrame:
    """(case_id, lat, lon) of parsed cases: where found, else where last seen."""
    return rows.select("case_id", F.coalesce("outcome.recovery_lat", "spatial.last_seen_lat").alias("lat"), F.coalesce("outcome.recovery_lon", "spatial.last_seen_lon").alias("lon")).filter("lat IS NOT NULL AND lon IS NOT NULL")


def write_json(df: DataFrame, path: str, run: str | None = None) -> None:
    """JSON lines; with a run id, rows of the same run are replaced, so a repeat adds nothing."""
    (df.write.mode("overwrite").json(f"{path}/run={run}") if run else df.write.mode("overwrite").json(path))


def write_sectors(df: DataFrame, path: str, by: str = "share") -> None:
    """Ranked sectors as CSV with a header."""
    df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), "sector"))).write.mode("overwrite").csv(path, header=True)


def plan_document(horizons: DataFrame, rings: DataFrame) -> DataFrame:
    """One JSON document of a search plan from its (bounded) sector and ring rows."""
    a = horizons.agg(F.collect_list(F.struct(*horizons.columns)).alias("sectors"))
    b = rings.agg(F.collect_list(F.struct(*rings.columns)).alias("rings"))
    return a.crossJoin(b).select(F.to_json(F.struct("sectors", "rings")).alias("plan"))


def write_document(df: DataFrame, path: str) -> None:
    """All rows (a bounded report) as one JSON array in one file."""
    df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def digest(params: Column) -> Column:
    """Ten hex digits that name a set of parameters."""
    return F.substring(F.sha1(params.cast("binary")), 1, 10)
