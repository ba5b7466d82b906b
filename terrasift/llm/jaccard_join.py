"""Similarity join on word n-grams by prefix trees.

Documents with the same set of n-grams are one class, so copies are never paired. What follows narrows the classes step
by step, each step exact:

1. A fixed part of the n-gram space is looked at: a class with more n-grams that no other class has than a partner could
   lack has no partner.
2. For the rest, n-grams are ordered by how many classes have them, rarest first; partners share one of the first few, the
   prefix. Classes that share a prefix n-gram hang together in candidate groups.
3. Sets that may be linked go into a prefix tree together, ordered by frequency. A set is looked up by walking the tree:
   the overlap with a path is counted once for all sets below it, and a subtree is left out as soon as what remains of
   either side can't reach the overlap needed, or all below it is known to be connected already.

A small candidate group is one tree. A large one is taken apart: first every set meets some that share its commonest
prefix n-gram, and the first of them all, in trees of bounded size; what that connects needs no comparing any more. Then
the sets outside the main component meet all others, in parts of bounded size: either all sets of the group, or those of
each prefix n-gram whose sets are still of more than one component, whichever makes fewer pairs. So near copies that are
linked cost no more than their number, and unlike sets that only hang together through others need not meet. Sets are of
64-bit hashes of n-grams and known by 128 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, at_column, checkpoint, gathered, joined, list_array, map_batches, parted, picked, positional, release, shingles, slices, small_enough, span_hashes, utf8, word_spans
from .graph import components

#: Sets, and n-grams of them, that one tree takes of a candidate group; larger groups are taken apart.
SETS, GRAMS = 256, 2_000_000
#: Sets of one n-gram from which its first set is found in salted parts, and rows of a class from which it is broadcast.
HOT = 256
#: Distinct sets that a task remembers, to send each only once.
SEEN = 1_000_000
#: Bytes of a class's key and id, for checked broadcasts.
CLASS_BYTES = 48


def ngram_sets(data: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted set of hashed n-grams of each row."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, at, NOT_SPACE)
    grams, to = shingles(span_hashes(low, starts, ends), first, n)
    return [np.unique(grams[a:b]) for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def halves(grams: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a set, as two signed numbers."""
    digest = xxhash.xxh3_128_intdigest(grams.tobytes())
    return (digest >> 64) - (1 << 63), (digest & (2**64 - 1)) - (1 << 63)


def signatures(docs: DataFrame, n: int, share: float) -> DataFrame:
    """(nul, id, th, size, a, b, part) of rows (nul, id, th, text): a and b are a 128-bit digest of the set, part its n-grams in the
    first `share` of the space, shortened to 48 bits (null where the task has sent this set before, or it is empty)."""
    top = np.uint64(min(2**64 - 1, int(share * 2.0**64)))

    def make():
        seen: set[tuple[int, int]] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(3))
            size, a_, b_, parts, lengths = [], [], [], [], []
            for x, y in slices(at):
                for grams in ngram_sets(data[at[x] : at[y]], at[x : y + 1] - at[x], n):
                    key = halves(grams)
                    size.append(len(grams))
                    a_.append(key[0])
                    b_.append(key[1])
                    if key in seen or not len(grams):
                        lengths.append(-1)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    parts.append(grams[: np.searchsorted(grams, top)] >> np.uint64(16))
                    lengths.append(len(parts[-1]))
            lengths = np.array(lengths)
            offsets = np.concatenate(([0], np.cumsum(np.maximum(lengths, 0))))
            part = list_array(signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64), offsets, pa.int64())
            part = pa.ListArray.from_arrays(part.offsets, part.values, mask=pa.array(lengths < 0)) if len(part) else part
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int32()), pa.array(a_, pa.int64()), pa.array(b_, pa.int64()), part], names=["nul", "id", "th", "size", "a", "b", "part"])

        return step

    return map_batches(docs, make, "nul boolean, id long, th long, size int, a long, b long, part array<long>")


def survivors(rows: DataFrame, threshold: int) -> DataFrame:
    """(a, b, nul, id): classes that may have a partner, by the part of the space in `rows`, each with the key of one row.

    A set that several tasks have sent counts as shared, so it only stays in more often.
    """
    least = math.ceil(threshold / (100 - threshold))  # smaller sets have no partner but copies
    sent = rows.filter(F.col("part").isNotNull() & (F.col("size") >= least))
    terms = sent.select("a", F.explode("part").alias("t"))
    common = terms.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t")
    shared = terms.join(common, "t", "left_semi").groupBy("a").agg(F.count(F.lit(1)).alias("k"))
    open_ = sent.select("nul", "id", "a", "b", "size", F.size("part").alias("m")).join(shared, "a", "left")
    open_ = open_.filter((F.col("m") - F.coalesce("k", F.lit(0))) <= lacking_column("size", threshold))
    return open_.groupBy("a", "b").agg(F.min(F.struct("nul", "id")).alias("key")).select("a", "b", "key.*")


def lacking_column(size: str, threshold: int):
    return F.col(size) - F.floor((F.col(size) * threshold + 99) / 100)


def full_sets(docs: DataFrame, open_: DataFrame, n: int) -> DataFrame:
    """(a, b, size, grams) of the open classes, from one text each (once per row if rows repeat)."""
    rows = picked(docs, open_, ["nul", "id"], CLASS_BYTES).select("a", "b", "text")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(2))
            sets = [s for x, y in slices(at) for s in ngram_sets(data[at[x] : at[y]], at[x : y + 1] - at[x], n)]
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            same = np.array([halves(s) == key for s, key in zip(sets, keys, strict=True)], bool)
            sizes = np.array([len(s) for s in sets])
            grams = list_array(signed(np.concatenate(sets)), np.concatenate(([0], np.cumsum(sizes))), pa.int64())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), grams], names=["a", "b", "size", "grams"])
            return out.filter(pa.array(same))  # ids that occur more than once may bring other texts

        return step

    return map_batches(rows, make, "a long, b long, size int, grams array<long>")


def once(sets: DataFrame) -> DataFrame:
    """sets with a number `rep` for each, materialised, each set once; the n-grams move only if rows repeat."""
    sets = checkpoint(sets.withColumn("rep", F.monotonically_increasing_id()))
    if not sets.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1):
        return sets
    return checkpoint(sets.dropDuplicates(["a", "b"]))


def prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """(rep, t, df): the n-grams (48 bits) of each set's prefix that other classes have too, and how many have them; materialised."""
    terms = sets.select("rep", F.explode("grams").alias("g")).select("rep", F.shiftright("g", 16).alias("t"))
    common = terms.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = terms.join(common, "t").groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("df", "t"))).alias("shared"))
    own = own.join(sets.select("rep", "size"), "rep")
    # n-grams that no other class has come first in the order; of the others, so many as the prefix has room for
    room = lacking_column("size", threshold) + 1 - (F.col("size") - F.size("shared"))
    prefix = own.withColumn("room", room).filter("room > 0").select("rep", F.explode(F.slice("shared", F.lit(1), F.col("room").cast("int"))).alias("p"))
    return gathered(prefix.select("rep", F.col("p.t").alias("t"), F.col("p.df").alias("df")))


def candidate_edges(prefix: DataFrame) -> DataFrame:
    """(u, v): each class with the smallest class that shares a prefix n-gram, a common n-gram by way of its salted parts."""
    salted = prefix.withColumn("salt", F.when(F.col("df") > HOT, F.pmod(F.xxhash64("rep"), F.lit(64)) + 1).otherwise(0))
    lead = salted.groupBy("t", "salt").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n"))
    near = salted.join(lead.filter("n > 1"), ["t", "salt"]).select(F.col("rep").alias("u"), F.col("lead").alias("v"))
    parts = lead.filter("salt > 0").select("t", "lead")
    far = parts.join(parts.groupBy("t").agg(F.min("lead").alias("v")), "t").select(F.col("lead").alias("u"), "v")
    return near.unionByName(far).filter("u <> v").distinct()


class PrefixTree:
    """Sets as paths from the root, most frequent n-gram first; sets below a node lie side by side in sorted order."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.threshold = threshold
        sizes = np.array([len(s) for s in sets])
        _, back, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(count))
        ordered = [np.sort(s) for s in np.split(rank[back], np.cumsum(sizes)[:-1])]
        self.order = sorted(range(len(sets)), key=lambda k: ordered[k].astype(">u4").tobytes())
        self.paths = [ordered[k] for k in self.order]
        self.sizes = sizes[self.order]
        self.fork = np.zeros(len(sets), np.int64)  # how many n-grams a path shares with the one before it
        for k in range(1, len(sets)):
            a, b = self.paths[k - 1], self.paths[k]
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            self.fork[k] = int(differ.argmax()) if differ.any() else n
        self.inside = np.zeros(len(count), bool)

    def linked(self, overlap: int, x: int, y: int) -> bool:
        return 100 * overlap >= self.threshold * (x + y - overlap)

    def groups(self) -> np.ndarray:
        """For each set, the place (in the order given) of one set of its component, the same for all of it."""
        label = np.arange(len(self.paths))
        for k in range(len(self.paths)):
            if (label == label[k]).all():
                break
            self.walk(k, label)
        out = np.empty(len(label), np.int64)
        out[self.order] = np.array(self.order)[label]
        return out

    def walk(self, k: int, label: np.ndarray) -> None:
        """Finds the sets linked with set k that aren't connected with it yet, and gives both components one label."""
        mine, size = self.paths[k], int(self.sizes[k])
        self.inside[mine] = True
        stack = [(0, len(self.paths), 0, 0)]
        while stack:
            lo, hi, depth, overlap = stack.pop()
            if (label[lo:hi] == label[k]).all():
                continue
            first = self.paths[lo]
            if hi - lo == 1:
                if self.linked(overlap + int(self.inside[first[depth:]].sum()), size, len(first)):
                    label[label == label[lo]] = label[k]
                continue
            forks = self.fork[lo + 1 : hi]
            to = int(forks.min())
            if to > depth:
                overlap += int(self.inside[first[depth:to]].sum())
            left = size - int(np.searchsorted(mine, first[to - 1], "right")) if to else size
            sizes = self.sizes[lo:hi]
            most = overlap + min(int(sizes.max()) - to, left)
            if not self.linked(most, size, max(int(sizes.min()), most)):  # no set is smaller than its overlap
                continue
            cuts = [lo, *(lo + 1 + np.flatnonzero(forks == to)).tolist(), hi]
            stack += [(a, b, to, overlap) for a, b in zip(cuts, cuts[1:])]
        self.inside[mine] = False


def connected(rows: DataFrame, threshold: int) -> DataFrame:
    """(u, v): the classes of each group (grp, rep, grams), dealt and sorted by group, that are really linked, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, sets = None, [], []

        def done() -> pa.RecordBatch | None:
            if len(reps) < 2:
                return None
            roots = PrefixTree(sets, threshold).groups()
            ids = np.array(reps)
            least = {}
            for r, i in zip(roots.tolist(), reps, strict=True):
                least[r] = min(i, least.get(r, i))
            v = np.array([least[r] for r in roots.tolist()])
            keep = ids != v
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(v[keep])], names=["u", "v"]) if keep.any() else None

        for batch in batches:
            grams = batch.column(2)
            values, at = grams.values.to_numpy(), grams.offsets.to_numpy()
            for k, (g, r) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if g != now:
                    if (out := done()) is not None:
                        yield out
                    now, reps, sets = g, [], []
                reps.append(r)
                sets.append(values[at[k] : at[k + 1]].copy())
        if (out := done()) is not None:
            yield out

    return rows.select("grp", "rep", "grams").repartition("grp").sortWithinPartitions("grp").mapInArrow(run, "u long, v long")


def parts_of(n: Column, weight: Column, sets: int, grams: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / sets), F.ceil(weight / grams)).cast("int")


def first_round(entries: DataFrame, sets: int, grams: int) -> DataFrame:
    """(rep, grp): each set goes to a tree of its commonest prefix n-gram, in parts of bounded size, each with the first set of all.

    entries: (rep, t, df, size).
    """
    own = entries.groupBy("rep", "size").agg(F.max(F.struct("df", "t"))["t"].alias("t"))
    all_ = own.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"), F.min("rep").alias("lead")).filter("n > 1")
    all_ = gathered(all_.select("t", "lead", parts_of(F.col("n"), F.col("w"), sets, grams).alias("parts")))
    members = joined(own, all_, "t", "inner", CLASS_BYTES).select("rep", F.xxhash64("t", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("grp"))
    leads = all_.select(F.col("lead").alias("rep"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("k"), "t").select("rep", F.xxhash64("t", "k").alias("grp"))
    return members.unionByName(leads).distinct()


def mixed_groups(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of rows (rep, size, label, ...) grouped by `by`: the groups of more than one label, with their sets n and n-grams w, and
    m, the same of the main label. Counted in each task first."""
    own = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    return own.groupBy(*by).agg(F.max(F.struct("n", "w", "label")).alias("m"), F.sum("n").alias("n"), F.sum("w").alias("w")).filter("n > m.n")


def last_round(entries: DataFrame, known: DataFrame, sets: int, grams: int) -> DataFrame:
    """(rep, grp): every two sets of different components that share a prefix n-gram meet in some group; those of the main
    component of what is dealt need not meet each other.

    entries: (rep, t, size, root), root being the candidate group; known: (node, root) of what is connected so far. N-grams
    that the same sets share are one: they are known by their number and 128 bits over their sets.
    """
    known = known.select(F.col("node").alias("rep"), F.col("root").alias("label"))
    both = gathered(entries.join(known, "rep", "left").select("rep", "t", "size", "root", F.coalesce("label", "rep").alias("label")))
    alike = both.groupBy("root", "t").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("y"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    apart = gathered(alike.filter("lo <> hi").groupBy("root", "n", "x", "y").agg(F.min("t").alias("t")).select("t"))
    by_gram = mixed_groups(joined(both, apart, "t", "left_semi"), ["root", "t"])
    members = both.select("rep", "size", "root", "label").distinct()
    by_root = mixed_groups(members, ["root"])
    pairs = ((F.col("n") - F.col("m.n")) * F.col("n")).cast("double")  # about how many pairs a group makes
    cost = by_root.select("root", pairs.alias("whole")).join(by_gram.groupBy("root").agg(F.sum(pairs).alias("grams")), "root")
    cost = gathered(cost.select("root", (F.col("whole") <= F.col("grams")).alias("together")))
    half = lambda n, w: parts_of(n, w, max(1, sets // 2), max(1, grams // 2))
    n, w = F.col("n") - F.col("m.n"), F.col("w") - F.col("m.w")
    plan = ("key", F.col("m.label").alias("main"), ((F.col("n") <= sets) & (F.col("w") <= grams)).alias("one"), half(F.col("m.n"), F.col("m.w")).alias("c"), half(n, w).alias("u"))
    apart_plan = gathered(by_gram.join(cost.filter("NOT together"), "root").withColumn("key", F.col("t")).select(*plan))
    root_plan = gathered(by_root.join(cost.filter("together"), "root").withColumn("key", F.col("root")).select(*plan))
    rows = joined(both.select("rep", "label", F.col("t").alias("key")), apart_plan, "key", "inner", CLASS_BYTES).withColumn("kind", F.lit(0))
    rows = rows.unionByName(joined(members.select("rep", "label", F.col("root").alias("key")), root_plan, "key", "inner", CLASS_BYTES).withColumn("kind", F.lit(1)))
    draw, zero = F.xxhash64("rep"), F.lit(0).cast("long")
    name = lambda part, i, j: F.xxhash64("kind", "key", F.lit(part), i, j)
    upto = lambda c: F.sequence(zero, F.col(c).cast("long") - 1)
    mine, place = F.pmod(draw, F.col("u")), F.pmod(draw, F.col("c"))
    inner = F.transform(upto("u"), lambda j: name(1, place, j))
    outer = F.transform(upto("c"), lambda i: name(1, i, mine))
    cross = F.transform(upto("u"), lambda k: name(2, F.least(k, mine), F.greatest(k, mine)))
    keys = F.when(F.col("one"), F.array(name(0, zero, zero))).when(F.col("label") == F.col("main"), inner).otherwise(F.concat(outer, cross))
    # dealt before names are made: they are far more than the rows, and the same name of a set comes from its own rows only
    return rows.repartition("rep").select("rep", F.explode(keys).alias("grp")).distinct()


def links(sets: DataFrame, threshold: int, most: int = SETS, grams: int = GRAMS) -> DataFrame:
    """(node, root): the classes that have a partner, each once, with the smallest of their component; sets has each rep once."""
    prefix = prefixes(sets, threshold)
    groups = gathered(components(candidate_edges(prefix)))
    release(sets.sparkSession)
    sizes = sets.select("rep", "size")
    weight = groups.join(sizes, groups["node"] == sizes["rep"]).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("w"))
    large = gathered(weight.filter((F.col("n") > most) | (F.col("w") > grams)).select("root"))
    # whole sets move to their trees only: they are too wide to be shuffled just to learn where they go
    met = lambda dealt: gathered(connected(picked(sets, gathered(dealt), ["rep"], CLASS_BYTES), threshold))
    small = groups.join(large, "root", "left_anti").select(F.col("node").alias("rep"), F.col("root").alias("grp"))
    stars = met(small)
    if large.head(1):
        inside = groups.join(large, "root", "left_semi").select(F.col("node").alias("rep"), "root")
        entries = gathered(prefix.join(inside, "rep").join(sizes, "rep"))
        one = met(first_round(entries, most, grams))
        two = met(last_round(entries, gathered(components(one)), most, grams))
        stars = stars.unionByName(one).unionByName(two)
    return components(stars)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """docs by place (c0, c1, ...) with nul, id, th (a hash of the text) and text: a row without an id is known by th."""
    text, id_ = at_column(docs, text_column).cast("string"), at_column(docs, id_column).cast("long")
    th = F.xxhash64(text)
    return positional(docs).withColumn("nul", id_.isNull()).withColumn("id", F.coalesce(id_, th)).withColumn("th", th).withColumn("text", text)


def classified(rows: DataFrame, n: int, threshold: int, most: int = SETS, grams: int = GRAMS) -> DataFrame:
    """(nul, id, th, size, a, b, class, component) for rows (nul, id, th, text); class and component are the first (nul, id, th) of each."""
    share = min(1.0, 1.6 * (100 - threshold) / 100)
    signed_ = checkpoint(signatures(rows, n, share))
    open_ = gathered(survivors(signed_, threshold))
    signed_ = checkpoint(signed_.drop("part"))
    release(rows.sparkSession)  # the shuffles behind open_, and the wider rows
    sets = once(full_sets(rows, open_, n))
    release(rows.sparkSession)
    linked = links(sets, threshold, most, grams).join(sets.select("rep", F.col("a").alias("a"), F.col("b").alias("b")), F.col("node") == F.col("rep")).select("a", "b", "root")
    classes = signed_.filter("size > 0").groupBy("a", "b").agg(F.min(F.struct("nul", "id", "th")).alias("class"), F.count(F.lit(1)).alias("rows"))
    named = gathered(classes.join(linked, ["a", "b"]))
    first = named.groupBy("root").agg(F.min("class").alias("component"))
    classes = gathered(classes.join(named.join(first, "root").select("a", "b", "component"), ["a", "b"], "left"))
    hot = gathered(classes.filter(F.col("rows") > HOT).drop("rows"))  # classes of many copies, so that these need not meet in one task
    if small_enough(hot, 2 * CLASS_BYTES):
        cold = signed_.join(F.broadcast(hot.select("a", "b")), ["a", "b"], "left_anti").join(classes.filter(F.col("rows") <= HOT).drop("rows"), ["a", "b"], "left")
        out = signed_.join(F.broadcast(hot), ["a", "b"]).unionByName(cold)
    else:
        out = signed_.join(classes.drop("rows"), ["a", "b"], "left")
    own = F.when(F.col("size") == 0, F.struct("nul", "id", "th")).otherwise(F.col("class"))
    return out.select("nul", "id", "th", "size", "a", "b", own.alias("class"), F.coalesce("component", own).alias("component"))


def jaccard_join(docs: DataFrame, n: int = 5, threshold: int = 80, id_column: str = "doc_id", text_column: str = "text", most: int = SETS, grams: int = GRAMS) -> DataFrame:
    """A row for each document: doc_id, n_shingles, class_id, component_id.

    Words are runs of bytes other than white space, A-Z in lower case; a text of fewer than n words, but not none, has its
    whole sequence as one n-gram. Sets x, y are linked when 100 |x and y| >= threshold |x or y|. class_id is the smallest id
    with the same set, component_id the smallest that links lead to. Texts without words (null too) are linked with
    nothing; a row without an id has null as its class and component unless a row with an id is among them. Ids may be any
    longs; rows with the same id are rows of their own. Texts of any length are read whole. An empty table gives no rows.
    Other columns are ignored, whatever their names. `most` and `grams` bound a tree; the result doesn't depend on them.
    """
    out = classified(keyed(docs, id_column, text_column).select("nul", "id", "th", "text"), n, threshold, most, grams)
    named = lambda c: F.when(~F.col(f"{c}.nul"), F.col(f"{c}.id"))
    return out.select(F.when(~F.col("nul"), F.col("id")).alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), named("class").alias("class_id"), named("component").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, threshold: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, that stand for their component: the one with the smallest id.

    Texts without words all stay, as nothing links them. Of rows that are equal in id and text one stays, and of a component's
    rows of the smallest id that differ in text one. An empty table stays empty. Rows are left out by a join with the list of
    those that go: broadcast where it is small, else behind a bloom filter, so that only rows that may be on it move.
    """
    rows, key = keyed(docs, id_column, text_column), ["nul", "id", "th"]
    found = classified(rows.select(*key, "text"), n, threshold)
    blank = F.col("size") == 0
    go = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(blank | (F.col("component") == F.struct(*key))).alias("stays"), F.bool_and(blank).alias("blank"))
    go = gathered(go.filter("NOT blank AND (n > 1 OR NOT stays)").select(*key, "stays"))
    own = [f"c{k}" for k in range(len(docs.columns))]
    if small_enough(go, CLASS_BYTES):
        kept = listed = rows.join(F.broadcast(go), key, "left")
        kept = kept.filter("stays IS NULL").select(*own)
    else:
        maybe, free = parted(rows, go.select(*key), key)
        listed = maybe.join(go, key, "left")
        kept = listed.filter("stays IS NULL").select(*own).unionByName(free.select(*own))
    if go.filter("stays").head(1):  # rows that repeat
        kept = kept.unionByName(listed.filter("stays").dropDuplicates(key).select(*own))
    return kept.toDF(*docs.columns)
