"""Toxic spans by a linear-chain conditional random field.

Words carry features (the word, its first four to eight bytes). Token labels come from the labelled documents: words
whose features keep to toxic documents, counted once for each group of near copies, are toxic tokens there. A two-state
chain over the words of each sentence is fitted to these labels by gradients from forward-backward; at scoring time its
marginals give the offending words, their offsets and the document's score. Every text is read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from .common import LOWER, LOWER_WORD, U64, at_column, byte_class, checkpoint, list_array, map_batches, mixed, positional, slices, span_hashes, utf8, word_spans
from .jaccard_join import classified
from .sampling import labelled_sample

#: Features that a model may have; the best supported stay.
VOCABULARY = 50_000
#: A chain begins anew after so many words without a sentence end.
CHAIN = 256
_END = byte_class((10, 10), (33, 33), (46, 46), (63, 63))
_KINDS = (0, 4, 5, 6, 7, 8)  # 0: the word; else so many of its first bytes


@dataclass
class Model:
    """Weights by feature hash (rising), bias and the log transition weights [from][to] of clean (0) and toxic (1)."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, each text's first word, the feature hashes (words x kinds; 0: none), and chain starts."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, at, LOWER_WORD)
    out = np.zeros((len(starts), len(_KINDS)), U64)
    for k, size in enumerate(_KINDS):
        if size == 0:
            out[:, k] = span_hashes(low, starts, ends)
        elif len(starts):
            long = ends - starts >= size
            out[long, k] = mixed(span_hashes(low, starts[long], starts[long] + size) + U64(size))
    begin = np.zeros(len(starts) + 1, bool)
    begin[first] = True
    begin = begin[:-1]
    stops = np.concatenate(([0], np.cumsum(_END[data])))
    if len(starts) > 1:
        begin[1:] |= stops[starts[1:]] > stops[ends[:-1]]
    if len(starts):
        place = np.arange(len(starts)) - np.maximum.accumulate(np.where(begin, np.arange(len(starts)), 0))
        begin |= place % CHAIN == 0
    return starts, ends, first, out, begin


class Chains:
    """Words of many chains as columns of one matrix, longest chain first, so that a step takes all chains that go on."""

    def __init__(self, begin: np.ndarray):
        heads = np.flatnonzero(begin)
        sizes = np.diff(np.append(heads, len(begin)))
        order = np.argsort(-sizes, kind="stable")
        self.heads, self.sizes = heads[order], sizes[order]
        self.steps = [int(np.searchsorted(-self.sizes, -t, "left")) for t in range(int(sizes.max()) if len(sizes) else 0)]

    def forward_backward(self, emit: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of toxic from what stands up to a word (itself included), and from what follows it."""
        a = np.exp(moves)
        ahead, after = np.zeros(len(emit)), np.zeros(len(emit))
        for t, n in enumerate(self.steps):
            at = self.heads[:n] + t
            if t:
                r = np.exp(np.clip(ahead[at - 1], -50, 50))
                ahead[at] = np.clip(emit[at], -40, 40) + np.log((a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0]))
            else:
                ahead[at] = np.clip(emit[at], -40, 40)
        for t in range(len(self.steps) - 2, -1, -1):
            at = self.heads[: self.steps[t + 1]] + t
            r = np.exp(np.clip(np.clip(emit[at + 1], -40, 40) + after[at + 1], -50, 50))
            after[at] = np.log((a[1, 0] + r * a[1, 1]) / (a[0, 0] + r * a[0, 1]))
        return ahead, after


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def places(keys: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Index of each feature among the rising keys, plus 1; 0 for one that isn't there."""
    if not len(keys):
        return np.zeros(features.shape, np.int64)
    at = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
    return np.where(keys[at] == features, at + 1, 0)


def marginals(m: Model, features: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Probability that each word is toxic."""
    if not len(features):
        return np.zeros(0)
    weights = np.concatenate(([0.0], m.weights))
    emit = m.bias + weights[places(m.keys, features)].sum(1)
    ahead, after = Chains(begin).forward_backward(emit, m.moves)
    return sigmoid(ahead + after)


def train(places_: np.ndarray, begin: np.ndarray, y: np.ndarray, keys: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-5) -> Model:
    """Maximum likelihood of the token labels; the likelihood's gradient is labels less marginals, for words and for moves."""
    weights, bias, moves = np.zeros(len(keys) + 1), np.array([-3.0]), np.zeros((2, 2))
    chains = Chains(begin)
    inner = np.flatnonzero(~begin)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    theta = [weights, bias, moves]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    for step in range(1, rounds + 1):
        emit = bias[0] + weights[places_].sum(1)
        ahead, after = chains.forward_backward(emit, moves)
        p = sigmoid(ahead + after)
        gap = y - p
        grad = np.bincount(places_.ravel(), np.repeat(gap, places_.shape[1]), len(weights)) - decay * weights
        grad[0] = 0
        r, s = np.exp(np.clip(ahead[inner - 1], -50, 50)), np.exp(np.clip(emit[inner] + after[inner], -50, 50))
        joint = np.stack([np.stack([np.ones_like(r), s]), np.stack([r, r * s])]) * np.exp(moves)[:, :, None]
        expected = (joint / joint.sum((0, 1))).sum(2)
        for t, g, u, v in zip(theta, (grad, np.array([gap.sum()]), seen - expected), first, second, strict=True):
            g = g / len(y)
            u += 0.1 * (g - u)
            v += 0.01 * (g * g - v)
            t += rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10) * (0.97 ** (step / 4))
    return Model(keys, weights[1:].astype(np.float64), float(bias[0]), moves)


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", toxic: int = 2000, clean: int = 6000, support: int = 6, odds: float = 20.0, chains: int = 600, words: int = 400_000, longest: int = 50_000) -> Model | None:
    """Learns from about `toxic` and `clean` labelled texts; None if either label has none.

    First pass: the sets of features of sampled texts, counted by Spark once for each component of near copies (three words,
    0.8, as op6 links them) and label. Features of at least `support` toxic groups that are `odds` times likelier there mark toxic tokens; the
    driver gets VOCABULARY features at most. Second pass: the chains of about `chains` toxic and as many clean texts (all of a
    label that has no more in the sample), but of about `words` words of each label at most, come to the driver, 32 bytes a
    word, which fits the weights to them. Texts of over `longest` words (6 bytes each) are not taken for it. The same rows
    give the same model however they are dealt. Null texts are empty, null labels and ids are left out.
    """
    sample = labelled_sample(docs, labels, label_column, {0: clean, 1: toxic}, id_column, text_column)
    sample = checkpoint(sample.select(F.pmod(F.xxhash64("text"), F.lit(1 << 61)).alias("id"), "text", "label"))

    def make_sets():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(0))
            sets = []
            for a, b in slices(at):
                _, _, first, features, _ = tokens(data[at[a] : at[b]], at[a : b + 1] - at[a])
                for p, q in zip(first[:-1], first[1:], strict=True):
                    own = np.unique(features[p:q])
                    own = own[own > 0]
                    sets.append(own.view(np.int64))
            at = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
            return pa.RecordBatch.from_arrays([list_array(np.concatenate(sets), at, pa.int64()), batch.column(1)], names=["features", "label"])

        return step

    near = classified(sample.select(F.lit(False).alias("nul"), "id", F.col("id").alias("th"), "text"), 3, 80).select("id", F.col("component.id").alias("grp")).distinct()
    least = sample.select("label", "id").join(near, "id").groupBy("label", "grp").agg(F.min("id").alias("id"))
    kept = sample.join(least.select("label", "id"), ["label", "id"], "left_semi").dropDuplicates(["label", "id"]).select("text", "label")
    groups = checkpoint(map_batches(kept, make_sets, "features array<long>, label double"))
    size = {int(r[0]): r[1] for r in groups.groupBy("label").count().collect()}  # two rows
    if not size.get(0) or not size.get(1):
        return None
    counts = groups.select("label", F.explode("features").alias("f")).groupBy("f").agg(F.sum(1 - F.col("label")).alias("n0"), F.sum("label").alias("n1"))
    best = counts.filter(F.col("n0") + F.col("n1") >= support)
    ratio = ((F.col("n1") + 0.5) / (size[1] + 1)) / ((F.col("n0") + 0.5) / (size[0] + 1))
    hot = (F.col("n1") >= support) & (ratio >= odds)
    got = best.withColumn("hot", hot).orderBy(F.desc("hot"), F.desc(F.col("n0") + F.col("n1")), "f").limit(VOCABULARY).select("f", "hot").toArrow()
    keys, hot_keys = got["f"].to_numpy().view(U64), got["hot"].to_numpy()
    marks = np.sort(keys[hot_keys])
    keys = np.sort(keys)
    bound = docs.sparkSession.sparkContext.broadcast((keys, marks))

    def make_chains():
        known, toxic_marks = bound.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(0))
            label = batch.column(1).to_numpy()
            out = []
            for a, b in slices(at):
                _, _, first, features, begin = tokens(data[at[a] : at[b]], at[a : b + 1] - at[a])
                idx, hot = places(known, features).astype(np.int32), np.isin(features, toxic_marks).any(1)
                for row, (p, q) in enumerate(zip(first[:-1], first[1:], strict=True), a):
                    y = hot[p:q] & (label[row] > 0)
                    out.append(np.column_stack((idx[p:q], begin[p:q], y)).astype("<i4").tobytes())
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["chain"])

        return step

    draw = F.pmod(F.xxhash64("text"), F.lit(10_000)) / 10_000.0
    short = sample.filter(F.octet_length("text") <= 6 * longest)
    drawn = {int(r[0]): min(1.0, chains / r[1], 6 * words / max(1, r[2])) for r in short.groupBy("label").agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).collect()}  # two rows
    share = F.when(F.col("label") > 0, drawn.get(1, 0.0)).otherwise(drawn.get(0, 0.0))
    rows = map_batches(short.filter(draw < share).select("text", "label"), make_chains, "chain binary").toArrow()["chain"]
    order = sorted(x.as_py() for x in rows)
    all_ = np.concatenate([np.frombuffer(r, "<i4").reshape(-1, len(_KINDS) + 2) for r in order] or [np.zeros((0, len(_KINDS) + 2), "<i4")])
    if not len(all_):
        return None
    return train(all_[:, : len(_KINDS)].astype(np.int64), all_[:, -2].astype(bool), all_[:, -1].astype(np.int64), keys)


def score(docs: DataFrame, model: Model | None, id_column: str = "doc_id", text_column: str = "text", keep: tuple[str, ...] = (), at_least: float = 0.5) -> DataFrame:
    """doc_id, kept columns, score, n_toxic and spans: for each run of words with a marginal of at_least, its byte offsets and probability.

    The score is the probability that any word of the spans is toxic, taken as independent; without spans it is the
    largest marginal. A text without words (null and empty ones too) scores 0. Without a model all scores are 0. Texts of any
    length are read whole; a chain is a sentence, or CHAIN words of a longer one. Repeated rows score alike, an empty table
    has no rows. A kept column of a result's name is replaced; other columns are ignored, whatever their names.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)  # at most VOCABULARY weights
    keep = tuple(c for c in keep if c not in ("doc_id", "score", "n_toxic", "spans"))
    rows = positional(docs).select(at_column(docs, id_column).alias("doc_id"), *[at_column(docs, c).alias(f"k{k}") for k, c in enumerate(keep)], at_column(docs, text_column).cast("string").alias("_text"))
    span = StructType([StructField("start", LongType()), StructField("end", LongType()), StructField("p", DoubleType())])
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType()), StructField("n_toxic", IntegerType()), StructField("spans", ArrayType(span))])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))

    def make():
        m = bound.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(batch.num_columns - 1))
            scores, counts, spans = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32), [[] for _ in range(batch.num_rows)]
            for a, b in slices(at) if m else ():
                local = at[a : b + 1] - at[a]
                starts, ends, first, features, begin = tokens(data[at[a] : at[b]], local)
                p = marginals(m, features, begin)
                some = np.flatnonzero(np.diff(first))
                if len(some):
                    scores[a + some] = np.maximum.reduceat(p, first[some])
                hot = np.flatnonzero(p >= at_least)
                owner = np.searchsorted(first, hot, "right") - 1
                keep_clean = np.ones(b - a)
                np.multiply.at(keep_clean, owner, 1 - p[hot])
                np.add.at(counts, a + owner, 1)
                for w, row in zip(hot.tolist(), owner.tolist(), strict=True):
                    own = spans[a + row]
                    x, y = int(starts[w] - local[row]), int(ends[w] - local[row])
                    if own and w and p[w - 1] >= at_least and not begin[w]:
                        own[-1] = {"start": own[-1]["start"], "end": y, "p": max(own[-1]["p"], float(p[w]))}
                    else:
                        own.append({"start": x, "end": y, "p": float(p[w])})
                touched = np.unique(owner)
                scores[a + touched] = 1 - keep_clean[touched]
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.clip(scores, 0, 1)), pa.array(counts, pa.int32()), pa.array(spans, kind)], names=[*batch.schema.names[:-1], "score", "n_toxic", "spans"])

        return step

    return map_batches(rows, make, schema).toDF("doc_id", *keep, "score", "n_toxic", "spans")
