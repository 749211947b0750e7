"""Best-fit packing of token sequences, bulk-synchronously.

Lengths are whole numbers up to the capacity, so documents in order of length, and gaps in
order of size, are runs of equals: at most ``capacity`` classes each, whatever the corpus.
A sweep walks the classes from long to short; each document of a class asks for its successor,
the smallest gap that holds it; documents and gaps of a pair of classes are matched by rank,
so no two get one gap; the gaps shrink and the sweep goes on. What is per document - its
tokens, its rank within its class, its place - is computed by the executors; only the counts
of the classes are swept on the driver.

Null texts are empty: one piece that holds only the closing id. Repeated rows and null ids are
packed like any others. Ties are broken by rank, so any order of the input gives as many
sequences. An empty table packs into nothing.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TEXT_ROWS, written
from .tokens import tokenizer_path, word_tokens

#: Rows that one rank bucket should hold; the number of buckets follows the input.
BUCKET_ROWS = 50_000


def token_pieces(docs: DataFrame, path: str, capacity: int, closing_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the closing id, cut only beyond ``capacity``."""
    tail = closing_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, step = word_tokens(path), 4 * capacity
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = tok.pack(text.as_py() or "") + tail
                rows += [(doc, k, at // 4, (min(at + step, len(ids)) - at) // 4, zlib.crc32(ids[at : at + step])) for k, at in enumerate(range(0, len(ids), step))]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tok.forget()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, sequence of the first rank, offset) for all documents of each length.

    Best fit, longest first. The result's size depends on the number of classes, not of documents.
    """
    gaps: dict[int, deque[tuple[int, int]]] = defaultdict(deque)  # size -> runs of sequences (first, how many)
    sizes: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def add(size: int, first: int, n: int) -> None:
        if not size:
            return
        if not gaps[size]:
            insort(sizes, size)
        if gaps[size] and sum(gaps[size][-1]) == first:
            first, n = gaps[size][-1][0], n + gaps[size].pop()[1]
        gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                fresh = -(-left // (capacity // length))
                add(capacity, opened, fresh)
                opened += fresh
                continue
            size = sizes[at]
            runs, gaps[size] = gaps[size], deque()
            sizes.pop(at)
            while runs and left:
                first, n = runs.popleft()
                take = min(n, left)
                out.append((length, rank, rank + take, first, capacity - size))
                add(size - length, first, take)
                rank, left = rank + take, left - take
                if take < n:
                    runs.appendleft((first + take, n - take))
            if runs:
                gaps[size] = runs
                insort(sizes, size)
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """Pieces with sequence_id and offset; within a sequence the pieces leave no hole."""
    spark = docs.sparkSession
    pieces = written(token_pieces(docs, path or tokenizer_path(), capacity, closing_id), "pieces", TEXT_ROWS)
    per_class = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = sweep(per_class, capacity)
    placed = spark.createDataFrame(pa.table(dict(zip(("r_length", "r_lo", "r_hi", "r_seq", "r_offset"), (pa.array(c, pa.int64()) for c in (list(zip(*runs)) or [[]] * 5))))))

    # The rank within a class, without gathering the class: buckets by hash, ranked each, shifted by the buckets before.
    buckets = max(64, -(-max(per_class.values(), default=0) // BUCKET_ROWS))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("own", F.row_number().over(own) - 1).join(shift, ["length", "bucket"]).withColumn("rank", F.col("own") + F.col("shift"))
    # `placed` holds a few runs per class: its bound is the capacity's, not the corpus'.
    joined = ranked.join(F.broadcast(placed), (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("r_lo")) & (F.col("rank") < F.col("r_hi")))
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r_seq") + F.col("rank") - F.col("r_lo")).alias("sequence_id"), F.col("r_offset").alias("offset"))
