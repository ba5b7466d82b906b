"""A corpus pipeline: STAGES are applied to the documents one after another, each to all that the one before it kept.

Null and empty texts count as empty; rows that repeat are one document for near_duplicates and alike for the others; texts
of any length are read whole; an empty table stays empty through every stage; columns of any name are kept until packing.

quality          the factorisation machine's rejects go
near_duplicates  one document of each component of the n-gram Jaccard join stays (5 words, 0.8)
passages         sentences of repeated spans are cut, all but their first occurrence
decontamination  documents that hold a twentieth or more of benchmark words go
packing          what is left is packed into sequences of 2048 tokens
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.llm.common import checkpoint_dir, id_remainder, release
from terrasift.llm.decontamination import clean
from terrasift.llm.jaccard_join import one_of_each
from terrasift.llm.packing import best_fit_packing
from terrasift.llm.quality import accepted, fit
from terrasift.llm.queries import table
from terrasift.llm.span_dedup import dedup_spans

#: Documents of a lower quality score go.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels").filter(id_remainder("doc_id", 5) != 0)), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, n=5, threshold=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_spans(docs, counts=False)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("decontamination", decontamination), ("packing", packing)]

#: No stage but decontamination can be said in SQL; the others are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's rows are written as Parquet in the shared folder, read by the next, and deleted after it."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        schema = out.schema
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(schema).parquet(f"{folder}/{name}")
        del out
        release(spark)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = f"{folder}/{name}"
    return docs
