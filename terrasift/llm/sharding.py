"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight from a hash of the row's key and
the child's own name, and the smallest draw wins, so a child gets rows in proportion to its weight. A child's draw depends
on nothing but its name and weight: giving one child more weight can only pull rows to it, and rows in subtrees whose
weights stay keep their path. A tree grows by a subtree of its own, so new shards take rows only into themselves.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_column, numbered_in_order, positional


@dataclass(frozen=True)
class Tree:
    """regions[r][k] are the weights of the shards of rack k; shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @staticmethod
    def balanced(shards: int, rack: int = 4, region: int = 2) -> Tree:
        """Equal shards in racks of `rack`, and regions of `region` racks; the last ones may be smaller."""
        racks = [(1.0,) * min(rack, shards - k) for k in range(0, shards, rack)]
        return Tree(tuple(tuple(racks[k : k + region]) for k in range(0, len(racks), region)))

    def grown(self, weights: tuple[float, ...] = (1.0,)) -> Tree:
        """With one region more, of one rack with these shards; no other subtree's weight changes."""
        return Tree((*self.regions, (tuple(weights),)))

    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def uniform(key: Column, name: str) -> Column:
    """In (0, 1), from the first 52 bits of the MD5 of the key and a node's name."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{name}")).cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def winner(key: Column, children: list[tuple[str, float]]) -> Column:
    """The index of the child with the smallest weighted draw; the first of equal ones."""
    alive = [(n, name, w) for n, (name, w) in enumerate(children) if w > 0]
    if len(alive) == 1:
        return F.lit(alive[0][0])
    draws = [F.struct((-F.ln(uniform(key, name)) / F.lit(float(w))).alias("draw"), F.lit(n).alias("n")) for n, name, w in alive]
    return F.least(*draws)["n"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number of a key (a string column). Native expressions; only the chosen branch is evaluated."""
    total = lambda x: x if isinstance(x, float) else sum(total(y) for y in x)
    first, racks = 0, []
    for r, region in enumerate(tree.regions):
        branch = []
        for k, rack in enumerate(region):
            branch.append((F.lit(first) + winner(key, [(f"{r}/{k}/{s}", w) for s, w in enumerate(rack)])).cast("int"))
            first += len(rack)
        at = winner(key, [(f"{r}/{k}", total(rack)) for k, rack in enumerate(region)])
        racks.append(F.element_at(F.array(*branch), at + 1) if len(branch) == 1 else reduce(lambda rest, x, at=at: F.when(at == x[0], x[1]).otherwise(rest), list(enumerate(branch))[:-1], branch[-1]))
    at = winner(key, [(f"{r}", total(region)) for r, region in enumerate(tree.regions)])
    return reduce(lambda rest, x: F.when(at == x[0], x[1]).otherwise(rest), list(enumerate(racks))[:-1], racks[-1])


def shard(docs: DataFrame, tree: Tree, more: Tree | None = None, overhead: int = 16, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: its shard, its place in the shard by id, size and checksum, and, if `more` is given, its shard in
    that tree.

    size is the text's bytes plus `overhead`; a null text has no bytes, a text of any length counts whole. A null id is a key
    of its own ("null"). Equal ids go to the same shard and get places of their own. An empty table has no rows. Columns
    other than id and text are ignored, whatever their names.
    """
    own, id_ = positional(docs), at_column(docs, id_column)
    key = F.coalesce(id_.cast("string"), F.lit("null"))
    text = F.coalesce(at_column(docs, text_column).cast("string"), F.lit("")).cast("binary")
    rows = own.select(id_.alias("doc_id"), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text).alias("text_crc32"), shard_of(key, tree).alias("shard"), (shard_of(key, more) if more else F.lit(None).cast("int")).alias("grown_shard"))
    return numbered_in_order(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")
