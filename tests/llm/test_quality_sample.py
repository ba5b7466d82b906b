"""The quality model's sample as it reaches the driver."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from terrasift.llm import quality


def test_sample_is_sent_small_and_whole(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.coalesce("text", F.lit("")).alias("text"), F.lit(1.0).alias("label")).limit(100)
    got = quality.feature_rows(rows).collect()
    size = 4 * (len(quality.STATS) + quality.BUCKETS)
    assert sum(len(r.features) for r in got) < 0.4 * size * len(got)
    texts = [r.text.encode() for r in rows.collect()]
    want = quality.features(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert sorted(zlib.decompress(r.features) for r in got) == sorted(f.tobytes() for f in want)
