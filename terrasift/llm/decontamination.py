"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Test items are cut into windows of words. Spark counts how often the whole corpus has each of their words, and each window
is looked up by its rarest ones. The index holds a posting (term, document, position) for every place of a looked-up
term, and one behind the last word of each document, which tells its length. Rows are dealt by document, so the postings
of a document are in one place: the rarest term's list is walked there, each posting less the term's place in the window
is where the window would begin, the lists of the other rare terms must meet it at their own places, and the whole phrase
must stand there. Only places that pass are kept, so neither texts nor word lists are ever shuffled.

Proximity matches allow the rare terms to stand some words off their places; there the adjusted lists are intersected by a
shuffle on (document, window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import at_column, checkpoint, parted, positional, small_enough

#: Separators between words; what is left is a word once A-Z are lower case.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows (some 250 bytes each) that are broadcast at a time; more of them are searched in so many passes over the corpus.
BLOCK = 200_000
#: Bytes of one term, of one key and of one owner of a window, for checked broadcasts.
TERM_BYTES, KEY_BYTES, OWNER_BYTES = 64, 48, 64


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null. lower() is used where it can touch A-Z only."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def with_end(words: str) -> Column:
    """The words and the empty term behind them. (No plain attribute: Spark would split each text once more to see if it has words.)"""
    return F.concat(F.col(words), F.array(F.lit("")))


def windows_of(items: DataFrame, width: int, item: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    """(window_id, window: words), each distinct window of `width` words once, and (window_id, item), both materialised.

    An item of fewer words, but not none, is one window. Items without an id are left out.
    """
    w = items.select(item.cast("string").alias("item"), words_of(text).alias("w")).filter("size(w) > 0 AND item IS NOT NULL")
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - width + 1))
    rows = w.select("item", "w", F.explode(at).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(width)).alias("window"))
    windows = checkpoint(rows.select("window").distinct().withColumn("window_id", F.monotonically_increasing_id()))
    return windows, checkpoint(rows.join(windows, "window").select("window_id", "item").distinct())


def corpus_counts(words: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of terms (materialised) occurs in all documents; summed in each task before the shuffle."""
    rows = words.select(F.explode(with_end("w")).alias("term"))
    if small_enough(terms, TERM_BYTES):
        rows = rows.join(F.broadcast(terms), "term", "left_semi")
    return terms.join(rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def probes(windows: DataFrame, counts: DataFrame, rare: int) -> DataFrame:
    """A row for each window that may occur: window_id, window, size, and the `rare` rarest of its distinct terms t0, t1, ...
    with their first places p0, p1, ... (null where it has fewer). A window with a term that no document has can't occur."""
    terms = windows.select("window_id", F.posexplode("window").alias("place", "term"))
    terms = terms.groupBy("window_id", "term").agg(F.min("place").alias("place")).join(counts, "term")
    best = terms.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("n", "term", "place"))).alias("t"))  # at most a window's words
    named = [x for k in range(rare) for x in (F.get("t", F.lit(k))["term"].alias(f"t{k}"), F.get("t", F.lit(k))["place"].alias(f"p{k}"))]
    return best.filter(F.col("t")[0]["n"] > 0).join(windows, "window_id").select("window_id", "window", F.size("window").alias("size"), *named)


def matches(docs: DataFrame, windows: DataFrame, rare: int, block: int | None = None) -> DataFrame:
    """For docs (doc_id, key, w), materialised: a row for each place of a window (doc_id, key, window_id, start, size), and
    one for each document with window_id null and start the number of its words."""
    terms = checkpoint(windows.select(F.explode("window").alias("term")).distinct())
    search = checkpoint(probes(windows, corpus_counts(docs, terms), rare))
    postings = docs.select("doc_id", "key", "w", F.posexplode(with_end("w")).alias("pos", "term"))
    ends = search.sparkSession.range(1).select(F.lit("").alias("t0"), F.lit(0).alias("p0"), *[F.lit(None).cast(search.schema[c].dataType).alias(c) for c in search.columns if c not in ("t0", "p0")])
    blocks = max(1, -(-search.count() // (block or BLOCK)))
    start = F.col("pos") - F.col("p0")
    met = start >= 0
    for k in range(1, rare):  # the lists of the other rare terms, adjusted by their places
        met = met & (F.col(f"t{k}").isNull() | (F.get("w", start + F.col(f"p{k}")) == F.col(f"t{k}")))
    met = met & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("size")) == F.col("window"))
    out = []
    for b in range(blocks):
        part = search.filter(F.pmod(F.xxhash64("window_id"), F.lit(blocks)) == b)
        part = part.unionByName(ends) if b == 0 else part
        found = postings.join(F.broadcast(part), postings["term"] == part["t0"]).filter(F.col("window_id").isNull() | met)
        out.append(found.select("doc_id", "key", "window_id", start.alias("start"), "size"))
    both = out[0]
    for x in out[1:]:
        both = both.unionByName(x)
    return checkpoint(both)


def key_of(id_: Column, text: Column) -> Column:
    """16 bytes that tell rows apart by id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("v"), id_.cast("string")), F.lit("n")), F.lit("\n"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary")))


def by_key(docs: DataFrame, items: DataFrame, width: int, rare: int, id_column: str, text_column: str, item_column: str, block: int | None) -> DataFrame:
    """(key, doc_id, copies, n_words, n_hit, items): a row for each distinct id and text, with how many rows have them."""
    own = positional(docs)
    id_, text = at_column(docs, id_column), at_column(docs, text_column)
    bench = positional(items)
    windows, owners = windows_of(bench, width, at_column(items, item_column), at_column(items, "text"))
    found = matches(own.select(id_.alias("doc_id"), key_of(id_, text).alias("key"), words_of(text).alias("w")), windows, rare, block)
    base = found.filter("window_id IS NULL").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("start").cast("long").alias("n_words"))
    hits = found.filter("window_id IS NOT NULL").select("key", "window_id", "start", "size").distinct()
    places = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("p"))  # no more than the text has words
    step = lambda acc, p: F.struct(  # noqa: E731  words of a place that lie behind all earlier places
        (acc["hit"] + F.greatest(F.lit(0), p["start"] + p["size"] - F.greatest(acc["end"], p["start"]))).cast("long").alias("hit"), F.greatest(acc["end"], p["start"] + p["size"]).cast("int").alias("end")
    )
    zero = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("int").alias("end"))
    places = places.select("key", F.aggregate("p", zero, step)["hit"].alias("n_hit"))
    pairs = hits.select("key", "window_id").distinct()
    pairs = pairs.join(F.broadcast(owners) if small_enough(owners, OWNER_BYTES) else owners, "window_id")
    names = pairs.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = base.join(places, "key", "left").join(names, "key", "left")
    return out.select("key", "doc_id", "copies", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, items: DataFrame, width: int = 13, rare: int = 3, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", block: int | None = None) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items (sorted).

    Null and empty texts have no words; repeated rows each get a row; rows of one id with other texts are told apart;
    documents' and items' other columns are ignored, whatever their names. An empty table gives no rows. No items, or none
    with words: nothing is hit. Items of the same text are all named. A text of any length is read whole.
    """
    rows = by_key(docs, items, width, rare, id_column, text_column, item_column, block)
    rows = rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy"))
    return rows.drop("_copy")


def flagged(rows: DataFrame, share: int = 20) -> DataFrame:
    """Adds items_sha256 and contaminated: some word is hit, and share * n_hit >= n_words."""
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.withColumn("items_sha256", digest).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def clean(docs: DataFrame, items: DataFrame, width: int = 13, rare: int = 3, share: int = 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", block: int | None = None) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, whatever their names.

    Null and empty texts stay; repeated rows stay or go together; an empty table stays empty. Contaminated rows are left out
    by an anti-join with the list of them: broadcast where it is small, else behind a bloom filter, so that only rows that
    may be on the list are shuffled.
    """
    bad = flagged(by_key(docs, items, width, rare, id_column, text_column, item_column, block), share).filter("contaminated")
    bad = checkpoint(bad.select("key"))
    rows = positional(docs).withColumn("key", key_of(at_column(docs, id_column), at_column(docs, text_column)))
    if small_enough(bad, KEY_BYTES):
        kept = rows.join(F.broadcast(bad), "key", "left_anti")
    else:
        maybe, free = parted(rows, bad, ["key"])
        kept = maybe.join(bad, "key", "left_anti").unionByName(free)
    return kept.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def proximity(docs: DataFrame, items: DataFrame, width: int = 13, rare: int = 4, slop: int = 2, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """(doc_id, item, start): where each of the `rare` rarest terms of a window stands within `slop` words of its place.

    start is where the window would begin; texts of one id count as one document, ids and items that are null are left
    out. Postings of the looked-up terms are stored and joined on the term; each enters every start that it allows, and
    the starts that all rare terms allow are kept. A common term is dealt over documents before the lists meet.
    """
    own = positional(docs)
    rows = own.select(at_column(docs, id_column).alias("doc_id"), words_of(at_column(docs, text_column)).alias("w")).filter("doc_id IS NOT NULL")
    windows, owners = windows_of(positional(items), width, at_column(items, item_column), at_column(items, "text"))
    terms = checkpoint(windows.select(F.explode("window").alias("term")).distinct())
    search = checkpoint(probes(windows, corpus_counts(rows, terms), rare))
    wanted = search.select("window_id", F.explode(F.array(*[F.struct(F.col(f"t{k}").alias("term"), F.col(f"p{k}").alias("place")) for k in range(rare)])).alias("x")).select("window_id", "x.*").filter("term IS NOT NULL")
    wanted = wanted.withColumn("wanted", F.count(F.lit(1)).over(Window.partitionBy("window_id")))
    looked = checkpoint(wanted.select("term").distinct())
    postings = rows.select("doc_id", F.posexplode(with_end("w")).alias("pos", "term"))
    small = small_enough(looked, TERM_BYTES)
    postings = checkpoint(postings.join(F.broadcast(looked) if small else looked, "term", "left_semi"))
    near = postings.join(F.broadcast(wanted) if small else wanted, "term").select("doc_id", "window_id", "place", "wanted", F.explode(F.sequence(F.col("pos") - F.col("place") - slop, F.col("pos") - F.col("place") + slop)).alias("start"))
    met = near.groupBy("doc_id", "window_id", "start", "wanted").agg(F.count_distinct("place").alias("n")).filter("n = wanted")
    return met.join(owners, "window_id").select("doc_id", "item", "start").distinct()
