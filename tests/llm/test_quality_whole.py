"""Quality rules learn from all trusted documents."""

import numpy as np
from pyspark.sql import functions as F

from wayveil.llm import quality


def test_counts_cover_every_trusted_document(spark):
    """All documents are trusted, so no bucket is likelier among the trusted ones."""
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit("word").alias("text"))
    assert set(quality.fit(docs, docs)) == {0}


def test_threshold_covers_every_trusted_document(spark):
    """One trusted document in a hundred scores low; ids are negative, sparse and not all trusted."""
    n = 22_000
    value = F.when(F.col("id") % 100 == 0, -5_000_000 - F.col("id")).otherwise(F.col("id") * 7)
    scored = spark.range(n).select((F.col("id") * 97 - 1_000_000).alias("doc_id"), F.lit(False).alias("base_failed"), (value + 0.5).alias("score"))
    trusted = scored.where("doc_id % 3 != 0")
    own = [r.score - 0.5 for r in trusted.collect()]
    low, middle = np.quantile(own, [quality.LOW_SHARE, 0.5])
    assert abs(quality.threshold_of(scored, trusted) - (low - quality.MARGIN * (middle - low))) < 1e-6
