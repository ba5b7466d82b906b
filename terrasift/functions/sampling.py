"""Deterministic draws from short weighted lists, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import add

Choices = list[tuple[str, float]]
Coupling = tuple[Column, dict[str, dict[str, float]]]


def uniform(key: Column, salt: int) -> Column:
    """A fixed draw in [0, 1) for an integer key."""
    return ((key * 7919 + salt * 104729) % 10007).cast("double") / F.lit(10007.0)


def pick(choices: Choices, u: Column, *couplings: Coupling) -> Column:
    """The choice whose cumulated weight reaches u times the whole: prior times what each coupling says for its given value.

    Without any weight each choice is as likely as another. The list is short, so all is one expression on the row.
    """
    weights = []
    for name, prior in choices:
        w = F.lit(float(prior))
        for given, table in couplings:
            for value, by in table.items():
                if name in by:
                    w = w * F.when(given == value, F.lit(float(by[name]))).otherwise(F.lit(1.0))
        weights.append(w)
    total = add(weights)
    weights = [F.when(total > 0, w).otherwise(F.lit(1.0)) for w in weights]
    target = u * F.when(total > 0, total).otherwise(F.lit(float(len(choices))))
    out = F.lit(choices[-1][0])
    for k in range(len(choices) - 2, -1, -1):
        out = F.when(add(weights[: k + 1]) >= target, F.lit(choices[k][0])).otherwise(out)
    return out


def looked_up(name: Column, table: dict[str, object], what: str) -> Column:
    """table[name]; an unknown name is an error, null is null."""
    out = F.when(name.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), name)))
    for key, value in table.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out
