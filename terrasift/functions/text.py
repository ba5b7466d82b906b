"""Extraction, normalisation and rules over narratives as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the risk rules, as the planning model defines them.
CRITICAL = [r"\babduct(ed|ion)\b", r"\bkidnap(ped|ping)?\b", r"\bweapon\b", r"\bgun\b", r"\bknife\b", r"\bbrandish", r"\bstrangle", r"\bimmediate danger", r"\bthreat(en(ed|ing)?)?\b", r"\bcoerc(ion|ed|ive)\b"]
HIGH = [r"\blure|\bgroom(ing|ed)\b|\bcoax|\bentice", r"\bthreat", r"\bassault", r"\bviolence", r"\bcoercion", r"\bforce(d)? (into|into a|into an) vehicle", r"\btraffick(ing|er|ed)\b", r"\bnon-?custodial\b", r"\brestraining order\b", r"\b(interstate|out of state|cross(-|\s)state)\b"]
SIGNS = [r"\babduct(ed|ion)\b", r"\bkidnap(ped|ping)?\b", r"\bweapon\b", r"\bgun\b", r"\bknife\b", r"\bthreat(en(ed|ing)?)?\b", r"\bcoerc(ion|ed|ive)\b", r"\bgroom(ing|ed)\b", r"\btraffick(ing|er|ed)\b", r"\bnon-?custodial\b", r"\brestraining order\b", r"\b(interstate|out of state|cross(-|\s)state)\b"]
INTERSTATE = r"\bI-\d{1,3}\b"
#: Movement classes by the words that name them.
MOVEMENTS = {"stationary": "stationary", "walking": "walking", "driving": "driving", "public transit": "public transit", "transit": "public transit", "bus": "public transit", "metro": "public transit", "unknown": "unknown"}
#: Plausibility of a zone by risk level.
PLAUSIBILITY = {"Critical": 0.9, "High": 0.7, "Medium": 0.5, "Low": 0.3}
LEVELS = ["Unknown", "Low", "Medium", "High", "Critical"]
#: Separators of road names, in the order in which they are tried.
ROAD_ENDS = [".", "Rd", "Ave", "St", "Dr", "Blvd", "Pkwy", "Way"]


def found(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def points(condition: Column, n: int) -> Column:
    return F.when(condition, F.lit(n)).otherwise(F.lit(0))


def add(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def risk_score(text: Column, delay_minutes: Column) -> Column:
    """Points for age, patterns, contact, vehicles, interstates and delay; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    age = F.nullif(F.regexp_extract(t, r"(\d{1,2})-year-old", 1), F.lit("")).cast("int")
    young = F.when(age <= 8, 3).when(age <= 12, 2).otherwise(0)
    hours = F.nullif(F.regexp_extract(t, r"(?i)reported missing (\d{1,3}) hours?", 1), F.lit("")).cast("int")
    late = F.when(delay_minutes >= 240, 2).when(delay_minutes >= 120, 1).when(delay_minutes.isNotNull(), 0).when(hours >= 24, 2).when(hours >= 12, 1).otherwise(0)
    return add(
        [young, late, *[points(found(t, p), 4) for p in CRITICAL], *[points(found(t, p), 3) for p in HIGH], *[points(found(t, p), 2) for p in SIGNS],
         points(found(t, r"\b(ride|unknown adult|into (a )?vehicle)\b"), 3), points(found(t, r"\bentered (a |the )?(vehicle|car)\b"), 3), points(found(t, r"\boffered .{0,40}\ba ride\b|\basked to get in\b"), 3),
         points(found(t, INTERSTATE) & (age <= 12), 1), points(found(t, INTERSTATE), 1)]
    )


def risk_level(score: Column) -> Column:
    return F.when(score >= 4, "Critical").when(score >= 2, "High").when(score >= 1, "Medium").otherwise("Low")


def overlay(model: Column, rules: Column) -> Column:
    """Rules can only raise what the model says."""
    return F.when(rules == "Critical", "Critical").when((rules == "High") & model.isin("Unknown", "Low", "Medium"), "High").otherwise(model)


def movement(text: Column, given: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(found(t, INTERSTATE) | found(t, r"\b(interstate|out of state|cross[-\s]state)\b"), "Interstate")
        .when(found(t, r"\b(no travel|remains? in|still in town|same city)\b"), "Stationary")
        .otherwise(F.coalesce(F.nullif(given, F.lit("")), F.lit("Unknown")))
    )


def movement_class(name: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    out = F.lit("unknown")
    for k, v in MOVEMENTS.items():
        out = F.when(low == k, F.lit(v)).otherwise(out)
    return out


def clean_road(name: Column) -> Column:
    """What stands before the first separator, in their order, that occurs and has something before it."""
    out = F.trim(name)
    for s in reversed(ROAD_ENDS):
        head = F.trim(F.substring_index(name, s, 1))
        out = F.when(F.contains(name, F.lit(s)) & (head != ""), head).otherwise(out)
    return out


def city(name: Column) -> Column:
    """Title case with single spaces; stand-ins for nothing are null."""
    t = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when(F.lower(t).isin("", "unknown", "n/a", "na", "none"), None).otherwise(F.initcap(t))


def county(name: Column) -> Column:
    return city(F.regexp_replace(name, r"(?i)\bcounty\b", ""))


def gender(name: Column) -> Column:
    g = F.lower(F.trim(name))
    return F.when(g.startswith("m"), "M").when(g.startswith("f"), "F")


def utc(stamp: Column) -> Column:
    return F.replace(stamp, F.lit("+00:00"), F.lit("Z"))


def span(minutes: Column) -> Column:
    m = F.floor(minutes).cast("long")
    return F.format_string("%dh %dm", F.floor(m / 60).cast("long"), m % 60)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0))


def bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def fold_vehicle(make: Column, model: Column, color: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.concat_ws(" ", color, make, model)), r"\s+", " "))


def repaired(text: Column) -> Column:
    """The outermost braces of a text, without commas before a closing bracket."""
    return F.regexp_replace(F.regexp_extract(text, r"(?s)\{.*\}", 0), r",\s*([}\]])", "$1")


def distinct_folded(values: Column) -> Column:
    """First of each value, whatever its case, in order."""
    return F.aggregate(values, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(F.trim(x))), acc).otherwise(F.concat(acc, F.array(F.trim(x)))))


def state(name: Column) -> Column:
    """The abbreviation of the home state's usual spellings; other names as they are (fixed values)."""
    t = F.trim(name)
    return F.when(t.isin("Virginia", "va", "Va"), "VA").otherwise(t)


def first_of(*values: Column) -> Column:
    return F.coalesce(*values)


def filled(value: Column, other: Column) -> Column:
    """value, or other where it is null, empty or Unknown."""
    return F.when(F.lower(F.coalesce(value, F.lit(""))).isin("", "unknown"), other).otherwise(value)


def seed(text: Column) -> dict[str, Column]:
    """Name, age and gender that a narrative tells; female is looked for before male, as whole words."""
    got = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return {"name": got(r"Missing Person: ([A-Za-z_0-9]+)"), "age": got(r"(\d{1,2})-year-old").cast("int"), "gender": F.when(found(text, r"\bfemale\b"), "F").when(found(text, r"\bmale\b"), "M")}


def highways(text: Column) -> Column:
    """Distinct names of highways in a text."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b(?:I-\d{1,3}|US-\d{1,3}|VA-\d{1,3})\b"), F.lit(0)))


def risk_flags(age: Column, text: Column, delay: Column, sightings: Column, persons: Column, zones: Column, high: Column) -> Column:
    """The ten risk flags of a case, sorted (names and words are fixed values)."""
    t = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda *words: add_or([F.contains(t, F.lit(w)) for w in words])
    flags = [
        (age <= 12, "minor_under_13"), (any_of("vehicle"), "involved_vehicle"), (any_of("i-95", "i-81", "i-64", "us-58"), "interstate_corridor"), (any_of("offered a ride", "unknown adult", "asking the child questions"), "adult_engagement"),
        (delay >= 360, "delayed_report_6h_plus"), (sightings, "has_follow_up_sightings"), (persons, "persons_of_interest_identified"), (any_of("transit", "bus", "station"), "transit_related"), (zones, "has_search_zones"), (zones & high, "high_priority_search_zones"),
    ]
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags])))


def add_or(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def first_sentences(text: Column, n: int) -> Column:
    """The first n sentences with single spaces."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]?"), F.lit(0))
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.slice(F.filter(clean, lambda x: x != ""), 1, n)


def mock_plausibility(base: Column, kind: Column, text: Column) -> Column:
    """base raised by the kind of zone and the words of a narrative, within 0 and 1 (fixed values)."""
    k, t = F.lower(kind), F.lower(F.coalesce(text, F.lit("")))
    has = lambda c, w: F.contains(c, F.lit(w))
    by_kind = F.when(has(k, "school"), 0.1).when(has(k, "park"), 0.05).when(has(k, "residential"), 0.15).otherwise(0.0)
    by_text = F.when(has(t, "school"), 0.1).otherwise(0.0) + F.when(has(t, "park"), 0.05).otherwise(0.0) + F.when(has(t, "home") | has(t, "house"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + by_kind + by_text))


def top_or_least(df: DataFrame, by: str, key: str, top: int | None, least: float) -> DataFrame:
    """The first `top` rows by falling value; only without a number those of at least `least`."""
    return df.orderBy(F.desc(F.round(by, 12)), key).limit(top) if top else df.filter(F.col(by) >= least)
