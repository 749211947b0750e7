"""A corpus pipeline: quality rules, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the
last return the columns of ``documents``. Side tables (labels, benchmark) come from ``sf_dir``.

Null and empty texts, having no words, fail the base rules of the first stage. Null ids pass like
others and lose against any id in a linked group; a row that is repeated whole stays once, as does
the smallest text hash where one id has several linked texts. Rows are told apart by id and text
alone, so further columns of any name go through unchanged. An empty table packs into nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayveil.llm import decontam, jaccard, packing, pii, quality
from wayveil.llm.common import table, without, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: those rejected, counted first, are joined against."""
    return without(docs, quality.rules(docs, table(spark, sf_dir, "labels")).where(~F.col("kept")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by the n-gram Jaccard join."""
    return jaccard.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", drop_low_quality),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: SQL has neither the hashes nor the tokenizer; tests compare run() with plain Python instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
