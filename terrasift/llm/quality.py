"""Quality classification by a factorisation machine.

A text's features are its hashed words (as shares of all words), structure statistics and metadata (length, line counts).
Pairs of features interact through vectors of low rank; the sum over all pairs is had in linear time as half of the
squared sums less the sums of squares. Training is on a bounded sample, scoring reads every text whole.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import LOWER, LOWER_WORD, U64, at_column, byte_class, map_batches, positional, slices, span_hashes, utf8, word_spans
from .sampling import labelled_sample

BUCKETS = 2048
RANK = 8
#: Structure statistics and metadata of a text, in the order of `structure`.
STATS = ("letters", "upper", "digits", "spaces", "marks", "rare_marks", "non_ascii", "pipes", "log_bytes", "log_words", "word_length", "distinct", "lines", "distinct_lines", "words_a_line", "ends", "top_word", "top_pair", "long_words", "exclaims")
_LETTER, _UPPER, _DIGIT = byte_class((65, 90), (97, 122)), byte_class((65, 90)), byte_class((48, 57))
_SPACE, _MARK = byte_class((9, 13), (32, 32)), byte_class((33, 47), (58, 64), (91, 96), (123, 126))
_RARE = byte_class((35, 38), (42, 43), (60, 62), (64, 64), (91, 96), (123, 126))


@dataclass
class Model:
    """Weights of a factorisation machine over standardised statistics and word shares."""

    bias: float
    linear: np.ndarray
    pairs: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.pairs
        return self.bias + x @ self.linear + 0.5 * (s * s - (x * x) @ (self.pairs * self.pairs)).sum(1)

    def scores(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(standard(raw, self.mean, self.scale)), -30, 30)))


def structure(data: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> list[float]:
    """The statistics of one text from its bytes, and its words' hashes and lengths; all 0 for an empty text."""
    n, w = len(data), len(words)
    if not n:
        return [0.0] * len(STATS)
    hist = np.bincount(data, minlength=256)
    ascii_letters = hist[_LETTER].sum()
    repeats = np.unique(words, return_counts=True)[1] if w else np.zeros(0, np.int64)
    pair = np.unique(words[:-1] * U64(31) + words[1:], return_counts=True)[1] if w > 1 else np.zeros(0, np.int64)
    lines = data.tobytes().split(b"\n")
    return [
        ascii_letters / n, hist[_UPPER].sum() / max(1, ascii_letters), hist[_DIGIT].sum() / n, hist[_SPACE].sum() / n, hist[_MARK].sum() / n, hist[_RARE].sum() / n, hist[128:].sum() / n, hist[124] / n,
        np.log1p(n), np.log1p(w), lengths.mean() if w else 0.0, len(repeats) / w if w else 0.0, np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(w / len(lines)), sum(x[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        repeats.max() / w if w else 0.0, pair.max() / (w - 1) if w > 1 else 0.0, (lengths > 20).sum() / w if w else 0.0, hist[33] / n,
    ]


def features(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """A row for each text: the statistics, then the share of each bucket of hashed words."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, at, LOWER_WORD)
    words, lengths = span_hashes(low, starts, ends), ends - starts
    bucket = (words >> U64(40)).astype(np.int64) & (buckets - 1)
    out = np.zeros((len(at) - 1, len(STATS) + buckets), np.float32)
    for row, (a, b, p, q) in enumerate(zip(first[:-1], first[1:], at[:-1], at[1:], strict=True)):
        out[row, : len(STATS)] = structure(data[p:q], words[a:b], lengths[a:b])
        if b > a:
            out[row, len(STATS) :] = np.bincount(bucket[a:b], minlength=buckets) / (b - a)
    return out


def standard(raw: np.ndarray, mean: np.ndarray, scale: np.ndarray, in_place: bool = False) -> np.ndarray:
    x = raw if in_place else raw.copy()
    x[:, : len(STATS)] = np.clip((raw[:, : len(STATS)] - mean) / scale, -5, 5)
    x[:, len(STATS) :] *= 10
    return x


def train(raw: np.ndarray, y: np.ndarray, epochs: int = 40, rate: float = 0.02, decay: float = 1e-3, seed: int = 3) -> Model:
    """Logistic loss, classes weighted to equal shares, Adam over small batches. raw is overwritten."""
    rng = np.random.default_rng(seed)
    mean, scale = raw[:, : len(STATS)].mean(0), raw[:, : len(STATS)].std(0) + 1e-6
    x = standard(raw, mean, scale, in_place=True)
    size = x.shape[1]
    m = Model(0.0, np.zeros(size, np.float32), rng.normal(0, 0.01, (size, RANK)).astype(np.float32), mean, scale)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * len(y)
    theta = [np.zeros(1, np.float32), m.linear, m.pairs]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(y), 128):
            rows = order[a : a + 128]
            b = x[rows]
            s = b @ m.pairs
            m.bias = float(theta[0][0])
            p = 1 / (1 + np.exp(-np.clip(m.logits(b), -30, 30)))
            g = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            grads = [g.sum(keepdims=True), b.T @ g + decay * m.linear, b.T @ (g[:, None] * s) - (b * b).T @ g[:, None] * m.pairs + decay * m.pairs]
            step += 1
            for t, d, u, v in zip(theta, grads, first, second, strict=True):
                u += 0.1 * (d - u)
                v += 0.001 * (d * d - v)
                t -= rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    m.bias = float(theta[0][0])
    return m


def feature_rows(rows: DataFrame) -> DataFrame:
    """(features binary, label double) of rows (text, label); features are compressed, as most shares are 0."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(0))
            out = []
            for a, b in slices(at):
                out += [zlib.compress(f.tobytes(), 1) for f in features(data[at[a] : at[b]], at[a : b + 1] - at[a])]
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], names=["features", "label"])

        return step

    return map_batches(rows, make, "features binary, label double")


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", per_label: int = 2000) -> Model | None:
    """Learns from about per_label labelled texts of each label (0 and 1); null labels are left out, null texts are empty.

    labels are sampled by themselves and the sampled ids, a bounded number, are broadcast to the scan of docs. The sample
    comes to the driver as features, compressed, and fills one matrix of 8 KB a row there. None if there is no row to learn from.
    """
    sample = labelled_sample(docs, labels, label_column, {0: per_label, 1: per_label}, id_column, text_column)
    got = [(r[1], bytes(r[0])) for r in feature_rows(sample.select("text", "label")).collect()]
    if not got:
        return None
    got.sort(key=lambda r: (r[0], zlib.decompress(r[1])))
    raw = np.empty((len(got), len(STATS) + BUCKETS), np.float32)
    for row, (_, f) in zip(raw, got, strict=True):
        row[:] = np.frombuffer(zlib.decompress(f), np.float32)
    return train(raw, np.array([float(y > 0) for y, _ in got]))


def score(docs: DataFrame, model: Model | None, text_column: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1 added as `out`, which replaces a column of that name; other columns are kept,
    whatever their names.

    A null text counts as empty, repeated rows score alike, a text of any length is read whole, an empty table stays
    empty. Without a model all scores are 0.5.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)  # some 100 KB
    rows = positional(docs).withColumn("_text", F.coalesce(at_column(docs, text_column).cast("string"), F.lit("")))
    names = rows.columns[:-1]

    def make():
        m = bound.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data, at = utf8(batch.column(batch.num_columns - 1))
            scores = []
            for a, b in slices(at):
                for p in range(a, b, 256):
                    q = min(b, p + 256)
                    scores.append(m.scores(features(data[at[p] : at[q]], at[p : q + 1] - at[p])) if m else np.full(q - p, 0.5))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(scores), pa.float64())], names=[*names, "_score"])

        return step

    scored = map_batches(rows, make, StructType([*rows.schema.fields[:-1], StructField("_score", DoubleType())]))
    kept = [(f"c{k}", c) for k, c in enumerate(docs.columns) if c != out]
    return scored.select(*[c for c, _ in kept], "_score").toDF(*[c for _, c in kept], out)


def accepted(docs: DataFrame, model: Model | None, least: float, text_column: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score `least` or more; without a model that is 0.5 for each."""
    fresh = "score"
    while fresh in docs.columns:
        fresh += "_"
    own = score(docs, model, text_column, fresh).toDF(*[f"c{k}" for k in range(len(docs.columns))], "_score")
    return own.filter(F.col("_score") >= least).drop("_score").toDF(*docs.columns)
