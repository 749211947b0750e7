"""What the text operators share: scratch tables that survive lost executors, and word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside this class (fixed by the data contract).
SPACE = r"[\x20\x09-\x0D]"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local one only for a single-machine session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file://{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


#: Rows with whole texts that go to a Python worker at once; the JVM and the worker hold a batch each.
TEXT_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, and losing executors costs no rework.

    A written table, not ``checkpoint()``: that would compute the frame twice. ``batch``: rows that go to Python at once meanwhile.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    usual = spark.conf.get(_BATCH)
    try:
        if batch:
            spark.conf.set(_BATCH, str(batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


#: Rows of a few fixed-width columns up to which a counted table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame) -> DataFrame:
    """``df`` (a written table of fixed-width rows: counting it is cheap) marked for broadcast if it is small; one column may have more rows."""
    return F.broadcast(df) if df.count() * len(df.columns) <= 4 * BROADCAST_ROWS else df


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same_row(docs: DataFrame, rows: DataFrame) -> Column:
    """Joins ``docs`` (doc_id, text) to ``rows`` (w_id, w_hash). Columns are bound to their frames, so no name of the caller's can clash."""
    return docs["doc_id"].cast("long").eqNullSafe(rows["w_id"]) & (text_hash(docs["text"]) == rows["w_hash"])


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` but for the rows that ``rows`` (doc_id, text_hash) names; broadcast if they are few, counted first."""
    gone = written(rows.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).distinct(), "gone")
    return docs.join(sized(gone), same_row(docs, gone), "left_anti")


def words(text: Column) -> Column:
    """Words of a text, in order; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def crc32_of_text(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
