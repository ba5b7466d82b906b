"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed character n-grams. Each language has several centroids, found by spherical
k-means over its sample; a text gets the language of the centroid with the highest cosine, and is rejected where that
cosine lies further below the language's own texts than their spread allows. Scoring reads every text whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, at_column, map_batches, mixed, positional, slices, utf8
from .sampling import sample_by_label

BUCKETS = 4096
ORDERS = (1, 2, 3)
UNDETERMINED = "und"


@dataclass
class Model:
    """labels[c] is the language of centroid c; idf by bucket; the least cosine that a language's own texts have."""

    labels: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: dict[str, float]


def code_points(text: str) -> np.ndarray:
    """Lower-case letters as code points; every run of other characters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = points > 127
    letter |= (points >= 97) & (points <= 122)
    points = np.where(letter, points, 32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def term_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    points = code_points(text).astype(U64)
    out = np.zeros(buckets, np.float32)
    gram = np.zeros(len(points), U64)
    for n in range(1, max(ORDERS) + 1):
        if len(points) < n:
            break
        gram = gram[: len(points) - n + 1] * U64(0x100000001B3) + points[n - 1 :] + U64(n)
        if n in ORDERS:
            out += np.bincount((mixed(gram) & U64(buckets - 1)).astype(np.int64), minlength=buckets).astype(np.float32)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of 1 + ln(count) times idf, of length 1 (all zero where nothing counts)."""
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centroids; begins with far apart rows, and empty clusters go."""
    rng = np.random.default_rng(seed)
    centers = [x[rng.integers(len(x))]]
    while len(centers) < min(k, len(x)):
        centers.append(x[int(np.argmin(np.max(x @ np.stack(centers).T, axis=1)))])
    c = np.stack(centers)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(0) for j in range(len(c)) if (own == j).any()])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def fit(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", per_label: int = 600, most: int = 12_000, clusters: int = 4, spread: float = 6.0) -> Model:
    """Learns from about per_label texts of each label, fewer where labels are so many that it were over `most` texts in all;
    rows without text or label are left out.

    The sampled rows come to the driver as n-gram counts: `most` times 16 KB (200 MB) at most, however long the texts.
    """
    labels_ = labelled.filter(F.col(label_column).isNotNull()).select(F.col(label_column).cast("string").alias("l")).distinct().count()
    per_label = min(per_label, max(1, most // max(1, labels_)))
    rows = labelled.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(label_column).cast("string").alias("label")).filter("text IS NOT NULL AND label IS NOT NULL")
    sample = sample_by_label(rows, "label", per_label, "doc_id")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = [term_counts(t).tobytes() for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), batch.column(1)], names=["counts", "label"])

        return step

    got = sorted((r[1], bytes(r[0])) for r in map_batches(sample.select("text", "label"), make, "counts binary, label string").collect())
    names = sorted({label for label, _ in got})
    if not names:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(BUCKETS, np.float32), {})
    counts = np.stack([np.frombuffer(c, np.float32) for _, c in got])
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = vectors(counts, idf)
    of = np.array([label for label, _ in got])
    labels, centroids, least = [], [], {}
    for name in names:
        own = x[of == name]
        c = spherical_kmeans(own, clusters)
        near = (own @ c.T).max(1)
        least[name] = float(near.mean() - spread * near.std())
        labels += [name] * len(c)
        centroids.append(c)
    return Model(labels, np.concatenate(centroids).astype(np.float32), idf, least)


def predict(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", reject: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept columns, lang_pred, score (the cosine, 0 to 1), rejected.

    A text that is null or has no letter is `und` with score 0, and so is every text if the model learned nothing. A
    rejected text is `und` too if `reject` is set; otherwise it keeps the nearest language. Ties go to the first label.
    Repeated rows are predicted alike, texts of any length are read whole, an empty table has no rows. A kept column of a
    result's name is replaced; columns that aren't kept are ignored, whatever their names.
    """
    bound = docs.sparkSession.sparkContext.broadcast(model)  # clusters * labels * 16 KB
    keep = tuple(c for c in keep if c not in ("doc_id", "lang_pred", "score", "rejected"))
    rows = positional(docs).select(at_column(docs, id_column).alias("doc_id"), *[at_column(docs, c).alias(f"k{k}") for k, c in enumerate(keep)], at_column(docs, text_column).cast("string").alias("_text"))

    def make():
        m = bound.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(batch.num_columns - 1)
            _, at = utf8(texts)
            langs: list[str] = []
            scores: list[float] = []
            rejected: list[bool] = []
            for a, b in slices(at):
                for start in range(a, b, 256):
                    part = texts.slice(start, min(256, b - start)).to_pylist()
                    has = [t is not None and any(map(str.isalpha, t)) for t in part]
                    cos = np.zeros((len(part), max(1, len(m.labels))), np.float32)
                    if m.labels and any(has):
                        cos[has] = vectors(np.stack([term_counts(t) for t, h in zip(part, has) if h]), m.idf) @ m.centroids.T
                    best = cos.argmax(1)
                    for k, h in enumerate(has):
                        score = float(min(1, max(0, cos[k, best[k]])))
                        lang = m.labels[best[k]] if h and m.labels else UNDETERMINED
                        far = lang != UNDETERMINED and score < m.least[lang]
                        langs.append(UNDETERMINED if far and reject else lang)
                        scores.append(score if lang != UNDETERMINED else 0.0)
                        rejected.append(far)
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names[:-1], "lang_pred", "score", "rejected"])

        return step

    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    schema = StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return map_batches(rows, make, schema).toDF("doc_id", *keep, "lang_pred", "score", "rejected")
