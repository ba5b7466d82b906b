"""Bounded, documented samples of labelled rows for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_by_label(rows: DataFrame, label: str, per_label: int | dict, key: str, labels: int = 1000) -> DataFrame:
    """About per_label rows of each label (or so many by label), by a hash of the key; all rows of a label that has no more.

    Labels are counted over all rows first, so the share taken is exact for the table at hand and no task sees more than
    its own rows. `labels` bounds how many distinct labels are counted on the driver; more of them is an error.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).limit(labels + 1).collect()}
    if len(counts) > labels:
        raise ValueError(f"more than {labels} labels")
    draw = (F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)).cast("double")) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in counts.items():
        most = per_label.get(value, 0) if isinstance(per_label, dict) else per_label
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, most / n))).otherwise(share)
    return rows.filter(draw < share)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, text, label double) of a bounded sample of labelled texts.

    The labels are sampled first, so that only their ids, whose number per_label bounds, are broadcast to the scan of docs.
    Null texts are empty; null labels and ids without a document are left out.
    """
    rows = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("double").alias("label")).filter("label IS NOT NULL AND doc_id IS NOT NULL")
    chosen = sample_by_label(rows, "label", {float(k): v for k, v in per_label.items()}, "doc_id").dropDuplicates(["doc_id"])
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id")
