"""Removal of repeated passages by sliding sentence spans.

A text is cut into sentences that together make up the whole text. A span is a run of consecutive sentences: from each
sentence on, the shortest run of at least `sentences` sentences and `words` words, and likewise back from each sentence,
so that every sentence of a repeated passage lies in a span of it. A single sentence of twice the words is a span too.
Spans are known by 128 bits of hash over their words; one that occurs more than once keeps its first occurrence, by id and
place, and all sentences of its other occurrences go.

Which spans repeat, and where each comes first, is counted in each task before the shuffle. The most common of them, a
bounded number, are broadcast and found again where the texts are cut, so a passage that half of all documents share makes
no rows. The others are joined back, each with few occurrences, behind a bloom filter of the repeated spans; only texts
that such a span lies in are shuffled with its places.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, LOWER_WORD, U64, at_column, byte_class, checkpoint, map_batches, mixed, parted, positional, slices, span_hashes, utf8, word_spans

_STOP, _SPACE = byte_class((33, 33), (46, 46), (63, 63)), byte_class((9, 13), (32, 32))
SENTENCES, WORDS = 2, 25
#: Common spans (33 bytes each) that are broadcast at most, and how often a span occurs at least to be one of them.
COMMON, OFTEN = 100_000, 32
#: Bits of the bloom filter of repeated spans: at least 8 for each, and so many (32 MB) at most.
BITS = 1 << 28
#: Odd multipliers of the two polynomials that hash a run of words.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def sentence_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where sentences begin: behind . ! ? and the space that follows, and behind a line end; and at each text's first byte."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    begin = np.zeros(n + 1, bool)
    begin[at[:-1][np.diff(at) > 0]] = True
    space = _SPACE[data]
    stop = np.flatnonzero(_STOP[data[:-1]] & space[1:]) + 2
    begin[np.minimum(stop, n)] = True
    begin[np.flatnonzero(data == 10) + 1] = True
    begin = np.flatnonzero(begin[:n])
    # white space alone belongs to the sentence before it
    solid = np.concatenate(([0], np.cumsum(~space)))
    ends = np.append(begin[1:], n)
    keep = solid[ends] > solid[begin]
    keep |= np.isin(begin, at)
    return begin[keep]


@dataclass
class Spans:
    """Of several texts: where sentences begin, each text's first sentence, and for each span its text, first and last
    sentence in the text, and both hashes (as signed numbers)."""

    begin: np.ndarray
    first: np.ndarray
    row: np.ndarray
    s: np.ndarray
    e: np.ndarray
    h: np.ndarray
    g: np.ndarray


def run_hashes(words: np.ndarray, p: np.ndarray, q: np.ndarray, base: int) -> np.ndarray:
    """Hash of words[p:q] for each pair, by prefix sums of word hash times a power of base."""
    power, back = np.ones(len(words) + 1, U64), np.ones(len(words) + 1, U64)
    if len(words):
        power[1:] = np.multiply.accumulate(np.full(len(words), base, U64))
        back[1:] = np.multiply.accumulate(np.full(len(words), pow(base, -1, 1 << 64), U64))
    total = np.concatenate((np.zeros(1, U64), np.cumsum(words * power[:-1], dtype=U64)))
    return mixed((total[q] - total[p]) * back[p] + (q - p).astype(U64) * U64(0xD6E8FEB86659FD93))


def spans(data: np.ndarray, at: np.ndarray, sentences: int, words: int) -> Spans:
    """The spans of texts that lie one after another; at holds their offsets, one more at the end."""
    begin = sentence_starts(data, at)
    first = np.searchsorted(begin, at)
    low = LOWER[data]
    starts, ends, _ = word_spans(low, at, LOWER_WORD)
    hashes = span_hashes(low, starts, ends)
    before = np.searchsorted(starts, np.append(begin, len(data)))  # words before each sentence
    rows = np.searchsorted(first, np.arange(len(begin)), "right") - 1
    own_first, own_end = first[rows], first[rows + 1]
    index = np.arange(len(begin))
    # forward: the least e with words(i..e) >= words and e - i + 1 >= sentences
    e = np.maximum(np.searchsorted(before, before[:-1] + words, "left") - 1, index + sentences - 1)
    forward = e < own_end
    b = np.minimum(np.searchsorted(before, before[1:] - words, "right") - 1, index - sentences + 1)
    backward = (b >= own_first) & (b >= 0)
    alone = before[1:] - before[:-1] >= max(1, 2 * words)
    s = np.concatenate((index[forward], b[backward], index[alone]))
    t = np.concatenate((e[forward], index[backward], index[alone]))
    both = np.unique(s * (len(begin) + 1) + t)
    s, t = np.divmod(both, len(begin) + 1)
    p, q = before[s], before[t + 1]
    some = q > p  # a run without words is no span
    s, t, p, q = s[some], t[some], p[some], q[some]
    row = rows[s]
    h, g = (run_hashes(hashes, p, q, base).view(np.int64) for base in BASES)
    return Spans(begin, first, row, s - first[row], t - first[row], h, g)


def span_rows(rows: DataFrame, sentences: int, words: int, bits: np.ndarray | None = None) -> DataFrame:
    """(h, g, nul, id, s): every span's hashes, with its text's key and first sentence; only those with their bit set, if bits are given."""
    bound = rows.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def make():
        known = bound.value if bound else None

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(2))
            nul, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in slices(at):
                x = spans(data[at[a] : at[b]], at[a : b + 1] - at[a], sentences, words)
                keep = slice(None)
                if known is not None:
                    place = x.h & (8 * len(known) - 1)
                    keep = (known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
                row = a + x.row[keep]
                out.append((x.h[keep], x.g[keep], nul[row], ids[row], x.s[keep].astype(np.int32)))
            h, g, nul, ids, s = (np.concatenate(x) for x in zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(nul, pa.bool_()), pa.array(ids, pa.int64()), pa.array(s)], names=["h", "g", "nul", "id", "s"])

        return step

    return map_batches(rows.select("nul", "id", "text"), make, "h long, g long, nul boolean, id long, s int")


def repeats(found: DataFrame) -> DataFrame:
    """(h, g, n, nul, id, s): the spans with more than one place, how many rows have them, and the first place; materialised."""
    place = F.struct("nul", "id", "s")
    many = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("n"))
    return checkpoint(many.filter("first <> last").select("h", "g", "n", "first.*"))


def common_spans(many: DataFrame, most: int, often: int) -> tuple[list[np.ndarray], int]:
    """The spans that occur at least `least` times, as columns h, g, nul, id, s rising by h, and that `least`: a power of two
    from `often` on that leaves `most` spans at most."""
    counts = {int(r[0]): r[1] for r in many.filter(F.col("n") >= often).groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}  # 64 rows
    k = int(often).bit_length() - (1 if often & (often - 1) == 0 else 0)
    while sum(n for j, n in counts.items() if j >= k) > most:
        k += 1
    got = many.filter(F.floor(F.log2("n")) >= k).select("h", "g", "nul", "id", "s").toArrow().sort_by([("h", "ascending"), ("g", "ascending")])
    return [got.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in got.column_names], k


def bits_of(many: DataFrame) -> np.ndarray:
    """The bloom filter over h, as bytes: 32 MB at most."""
    size = 1 << 18
    while size < min(8 * many.count(), BITS):
        size *= 2
    place = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    rows = many.select(F.bitmap_bucket_number(place).alias("b"), F.bitmap_bit_position(place).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect()
    out = np.zeros(size >> 3, np.uint8)
    for b, m in rows:
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)[: len(out)]
    return out


def held(x: Spans, common: list[np.ndarray], nul: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which spans are occurrences of a common span other than its first; nul and ids are the texts' keys."""
    h, g, first_nul, first_id, first_s = common
    out = np.zeros(len(x.h), bool)
    if not len(h):
        return out
    at = np.searchsorted(h, x.h)
    todo = np.flatnonzero(at < len(h))
    while len(todo):  # more than one turn only where the first hashes of common spans are equal
        todo = todo[h[at[todo]] == x.h[todo]]
        hit = todo[g[at[todo]] == x.g[todo]]
        k, row = at[hit], x.row[hit]
        out[hit] = ~((first_id[k] == ids[row]) & (first_nul[k] == nul[row]) & (first_s[k] == x.s[hit]))
        at[todo] += 1
        todo = todo[at[todo] < len(h)]
    return out


def remove(rows: DataFrame, sentences: int, words: int, common: list[np.ndarray]) -> DataFrame:
    """rows (columns ending with nul, id, text, gone: places of the rarer repeated spans) with the covered sentences cut from
    text, and n_sentences, n_removed instead of gone."""
    columns = rows.columns[:-1]
    schema = StructType([*rows.schema.fields[:-1], StructField("n_sentences", LongType()), StructField("n_removed", LongType())])
    bound = rows.sparkSession.sparkContext.broadcast(common)

    def make():
        often = bound.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            nul, ids, text, gone = (batch.column(batch.num_columns - k) for k in (4, 3, 2, 1))
            nul, ids = nul.to_numpy(zero_copy_only=False), ids.to_numpy()
            data, at = utf8(text)
            removed, count = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            listed = np.asarray(gone.is_valid())
            new: dict[int, str] = {}
            for a, b in slices(at):
                local = at[a : b + 1] - at[a]
                part = data[at[a] : at[b]]
                x = spans(part, local, sentences, words)
                count[a:b] = np.diff(x.first)
                out = held(x, often, nul[a:b], ids[a:b])
                edge = np.searchsorted(x.row, np.arange(b - a + 1))
                for r in np.flatnonzero(listed[a:b]).tolist():
                    places = {(p["h"], p["g"], p["s"]) for p in gone[a + r].as_py()}
                    u, v = edge[r], edge[r + 1]  # a row with the same id but another text keeps what it has
                    out[u:v] |= np.fromiter((p in places for p in zip(x.h[u:v].tolist(), x.g[u:v].tolist(), x.s[u:v].tolist(), strict=True)), bool, v - u)
                cover = np.zeros(len(x.begin) + 1, np.int64)
                np.add.at(cover, x.first[x.row[out]] + x.s[out], 1)
                np.add.at(cover, x.first[x.row[out]] + x.e[out] + 1, -1)
                cut = np.cumsum(cover)[:-1] > 0
                before = np.concatenate(([0], np.cumsum(cut)))
                removed[a:b] = before[x.first[1:]] - before[x.first[:-1]]
                ends = np.append(x.begin[1:], len(part))
                whole = part.tobytes()
                for r in np.flatnonzero(removed[a:b]).tolist():
                    u, v = x.first[r], x.first[r + 1]
                    new[a + r] = b"".join(whole[p:q] for p, q, c in zip(x.begin[u:v].tolist(), ends[u:v].tolist(), cut[u:v].tolist(), strict=True) if not c).decode("utf-8", "replace")
            if new:
                text = pa.array([new.get(k, t) for k, t in enumerate(text.to_pylist())], pa.string())
            return pa.RecordBatch.from_arrays([*batch.columns[:-2], text, pa.array(count), pa.array(removed)], names=[*columns, "n_sentences", "n_removed"])

        return step

    return map_batches(rows, make, schema)


def dedup_spans(docs: DataFrame, sentences: int = SENTENCES, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text", counts: bool = True, common: int = COMMON, often: int = OFTEN) -> DataFrame:
    """docs with repeated passages cut from the text column, and with `counts` n_sentences and n_removed added.

    The first occurrence is that of the smallest id, then place; rows without an id come last, ordered by a hash of their
    text. Rows equal in id and text count as one occurrence, and rows of one id with other texts as one document. A null
    text stays null, an empty one empty; both have no sentences. An empty table stays empty. Other columns are kept as
    they are, whatever their names; one that is called n_sentences or n_removed is replaced if counts are asked for. The
    result has one row for each row of docs. words = 0 makes every run of `sentences` sentences a span.

    `common` spans at most that occur `often` times or more are broadcast; the result doesn't depend on either.
    """
    names, width = docs.columns, len(docs.columns)
    own = positional(docs)
    text, id_ = at_column(docs, text_column).cast("string"), at_column(docs, id_column).cast("long")
    rows = own.withColumn("nul", id_.isNull()).withColumn("id", F.coalesce(id_, F.xxhash64(text))).withColumn("text", text)
    rows = rows.select(*[f"c{k}" for k in range(width) if k != names.index(text_column)], "nul", "id", "text")
    many = repeats(span_rows(rows, sentences, words))
    often_, k = common_spans(many, common, often)
    rare = many.filter(F.floor(F.log2("n")) < k).select("h", "g", F.struct("nul", "id", "s").alias("first"))
    again = span_rows(rows, sentences, words, bits_of(many.filter(F.floor(F.log2("n")) < k)))
    later = again.join(rare, ["h", "g"]).filter(F.struct("nul", "id", "s") != F.col("first"))
    gone = checkpoint(later.groupBy("nul", "id").agg(F.collect_list(F.struct("h", "g", "s")).alias("gone")))  # no more than a text has spans
    touched, free = parted(rows, gone.select("nul", "id"), ["nul", "id"])
    joined_ = touched.join(gone, ["nul", "id"], "left").select(*rows.columns, "gone")
    out = remove(joined_.unionByName(free.withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))), sentences, words, often_)
    extra = ["n_sentences", "n_removed"] if counts else []
    kept = [(f"c{j}" if j != names.index(text_column) else "text", c) for j, c in enumerate(names) if c not in extra]
    return out.select(*[c for c, _ in kept], *extra).toDF(*[c for _, c in kept], *extra)
