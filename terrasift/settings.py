"""Settings, schema rules and guards that are decided on the driver, before any data is read."""

from __future__ import annotations

import copy
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = {"string": "string", "number": "double", "integer": "long", "boolean": "boolean"}


def merged(defaults: dict, given: dict | None) -> dict:
    """defaults with what is given, sections merged one level deep; neither argument is changed."""
    out = copy.deepcopy(defaults)
    for key, value in (given or {}).items():
        if isinstance(value, dict) and isinstance(out.get(key), dict):
            out[key].update(copy.deepcopy(value))
        else:
            out[key] = copy.deepcopy(value)
    return out


def missing_columns(needed: Iterable[str], present: Iterable[str]) -> list[str]:
    """Those needed that aren't present, sorted."""
    return sorted(set(needed) - set(present))


def need_columns(df, needed: Iterable[str]):
    """df, or an error that names the columns it lacks."""
    if lost := missing_columns(needed, df.columns):
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def need_unit(crs: str, unit: str) -> str:
    """The coordinate system's name if its unit is the one asked for (degrees or metres), else an error."""
    known = {"EPSG:4326": "degrees", "EPSG:4269": "degrees", "EPSG:3857": "metres", "EPSG:32617": "metres", "EPSG:32618": "metres", "EPSG:26917": "metres", "EPSG:26918": "metres"}
    name = str(crs).upper()
    if known.get(name) != unit:
        raise ValueError(f"{crs} is not in {unit}")
    return name


def schema_rules(schema: dict, prefix: str = "") -> list[tuple[str, str, object]]:
    """(path, rule, value) of a JSON schema: required, type, enum, minimum, maximum, of nested objects too."""
    out: list[tuple[str, str, object]] = [(f"{prefix}{name}", "required", True) for name in schema.get("required", [])]
    for name, part in schema.get("properties", {}).items():
        path = f"{prefix}{name}"
        out += [(path, rule, part[rule]) for rule in ("type", "enum", "minimum", "maximum") if rule in part]
        out += schema_rules(part, f"{path}.")
    return out


def schema_issues(schema: dict, body: Column) -> Column:
    """An array of "path: rule" for each rule of the schema that a JSON text breaks; null values break only `required`."""
    issues = []
    for path, rule, value in schema_rules(schema):
        got = F.get_json_object(body, f"$.{path}")
        number = got.try_cast("double")
        if rule == "required":
            bad = got.isNull()
        elif rule == "enum":
            bad = ~got.isin(*[str(v) for v in value if v is not None])
        elif rule in ("minimum", "maximum"):
            bad = number < float(value) if rule == "minimum" else number > float(value)
        else:
            kinds = [value] if isinstance(value, str) else list(value)
            fits = [got.try_cast(TYPES[k]).isNotNull() for k in kinds if k in TYPES and k != "string"]
            if "string" in kinds or any(k in ("object", "array") for k in kinds) or not fits:
                continue
            bad = got.isNotNull()
            for f in fits:
                bad = bad & ~f
        issues.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(f"{path}: {rule}")))
    return F.array_compact(F.array(*issues)) if issues else F.array().cast("array<string>")
