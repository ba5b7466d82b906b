"""All queries of the library by name, with their DuckDB twins."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrasift import plans


def _modules():
    for m in pkgutil.iter_modules(plans.__path__):
        if m.name not in ("base", "registry", "views"):
            yield importlib.import_module(f"terrasift.plans.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
