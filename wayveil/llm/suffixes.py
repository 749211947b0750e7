"""Repeated passages by a sparse suffix array.

Of the word positions of a text, those at window minima of a hash of eight words are kept
(minimisers): equal passages keep equal positions, whatever stands around them. Every passage of
``MIN_WORDS`` words has a kept position among its first ``WINDOW``, and so ``RIGHT`` words of its own
to the right of it. The suffixes that begin there are sorted across the cluster by their first
``RIGHT`` words, and those that equal no neighbour in them are dropped. The others are extended left
and right, in every way that makes ``MIN_WORDS`` words of it; the extended ones are sorted and
compared once more. One order of suffixes is not enough: texts that share one end of a passage can
stand between two that share all of it.

Reported are maximal stretches of a text whose every window of ``MIN_WORDS`` words stands in another
text too, with the longest part of each that stands in one of them word for word. So what comes out
grows with the texts, not with the pairs of a crowd. Words are compared by fingerprints of 126 bits.

Equal texts of enough words are reported whole, against one another. Null, empty and short texts
hold no passage. Null ids take part like others; a repeated row is a copy of itself. What a text
repeats within itself is not reported. Which of several other texts is named is arbitrary. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, same_row, sized, text_hash, written

MIN_WORDS = 50
GRAM = 8
#: Grams of which the least is kept. All of them lie within MIN_WORDS words.
WINDOW = 21
#: Words from a kept position that a passage which has it among its first WINDOW surely holds.
RIGHT = MIN_WORDS - WINDOW + 1
#: Bytes of keys up to which the wanted suffixes are broadcast to the scan of texts; beyond, the join shuffles.
BROADCAST_BYTES = 64 << 20
#: Rows of one Arrow batch that goes back to Spark.
OUT_ROWS = 200_000
MEMORY = 300_000
_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(text: bytes, memory: _WordHashes) -> np.ndarray:
    w = text.lower().split()
    return np.fromiter(map(memory.__getitem__, w), np.uint64, len(w))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _M1
    return h ^ (h >> np.uint64(29))


def prefix_sums(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums and the powers: the fingerprint of any stretch is a difference."""
    powers = np.ones(len(a) + 1, np.uint64)
    if len(a):
        np.multiply.accumulate(np.full(len(a), _M2), out=powers[1:])
    return np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(a * powers[:-1])]), powers


def stretches(sums: np.ndarray, powers: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """63-bit fingerprints of words start..end (exclusive), equal for equal words wherever they stand."""
    n = len(powers) - 1
    # Brought to the power of the longest text there could be: multiply by powers up, not down.
    inverse = _inverse_powers(n)
    return (_mixed((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)) >> np.uint64(1)).astype(np.int64)


def _inverse_powers(n: int) -> np.ndarray:
    inv = np.uint64(pow(int(_M2), -1, 1 << 64))
    out = np.ones(n + 1, np.uint64)
    if n:
        np.multiply.accumulate(np.full(n, inv), out=out[1:])
    return out


def suffix_starts(text: bytes, memory: _WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of MIN_WORDS words: the kept position among its first WINDOW; then the running sums and powers, and the number of words."""
    a = word_hashes(text, memory)
    sums, powers = prefix_sums(a)
    if len(a) < MIN_WORDS:
        return np.empty(0, np.int64), sums, powers, a
    n = len(a) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h = h * _M2 + a[i : n + i]
    h = _mixed(h)[: len(a) - RIGHT + 1]
    # The last of equal minima, so that what precedes a window has no say.
    w = np.lib.stride_tricks.sliding_window_view(h[::-1], WINDOW)
    at = (len(h) - 1 - (np.arange(len(w)) + w.argmin(axis=1)))[::-1]
    return at, sums, powers, a


def _keys(at: np.ndarray, sums: np.ndarray, powers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept positions and the fingerprints of the RIGHT words from each."""
    kept = np.unique(at)
    return kept, stretches(sums, powers, kept, kept + RIGHT)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, keys (distinct fingerprints of the kept suffixes' first RIGHT words) and a row number ``uid``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _WordHashes()
        for b in batches:
            n, keys = [], [np.empty(0, np.int64)]
            for t in b.column(2):
                at, sums, powers, a = suffix_starts(t.as_py(), memory)
                n.append(len(a))
                keys.append(np.unique(_keys(at, sums, powers)[1]))
            offsets = np.cumsum([len(k) for k in keys]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys)))], names=["doc_id", "text_hash", "n_words", "keys"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(F.col("text")).alias("text_hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, text_hash long, n_words long, keys array<long>").withColumn("uid", F.monotonically_increasing_id())  # frozen by writing the table


def _windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """uid, s, r, h: windows of MIN_WORDS words around the suffixes in ``wanted`` (uid, w_id, w_hash, keys); r and h are fingerprints."""
    size = wanted.agg(F.sum(8 * F.size("keys") + 32)).first()[0] or 0
    named = F.broadcast(wanted) if size <= BROADCAST_BYTES else wanted
    joined = docs.join(named, same_row(docs, wanted)).select(wanted["uid"], wanted["keys"], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _WordHashes()
        done: set[int] = set()  # a repeated row comes once a task
        parts: list[tuple] = []
        held = 0

        def packed() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["uid", "s", "r", "h"])

        for b in batches:
            for uid, keys, text in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if uid in done:
                    continue
                done.add(uid)
                at, sums, powers, _ = suffix_starts(text.as_py(), memory)
                kept, r = _keys(at, sums, powers)
                own = np.searchsorted(kept, at)
                s = np.flatnonzero(np.isin(r, np.asarray(keys.values))[own])
                parts.append((np.full(len(s), uid), s, r[own[s]], stretches(sums, powers, s, s + MIN_WORDS)))
                held += len(s)
                if held >= OUT_ROWS:
                    yield packed()
                    parts, held = [], 0
        yield packed()

    return joined.mapInArrow(run, "uid long, s long, r long, h long")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_words (a maximal repeated stretch, words from 0), match_start, match_words, other_doc_id, other_start.

    The last four name the longest part of the stretch that stands in one other text.
    """
    table = written(anchors(docs), "sfx-anchors")
    names = written(table.drop("keys"), "sfx-names")
    firsts = names.groupBy("text_hash", "n_words").agg(F.min("uid").alias("first"), F.min_by("doc_id", "uid").alias("first_id"), F.max_by("doc_id", "uid").alias("last_id"), F.count(F.lit(1)).alias("c"))
    copied = written(firsts.where(f"c > 1 and n_words >= {MIN_WORDS}"), "sfx-copied")
    copies = written(names.join(copied, ["text_hash", "n_words"]).select("doc_id", "uid", "first", "n_words", F.when(F.col("uid") == F.col("first"), F.col("last_id")).otherwise(F.col("first_id")).alias("other_doc_id")), "sfx-copies")

    # 1. Suffixes that share their first words with one of another text. Of equal texts the first stands for all.
    single = table.join(sized(copies.where("uid <> first").select("uid")), "uid", "left_anti").select("uid", F.explode("keys").alias("r"))
    often = single.groupBy("r").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("r")
    shared = single.join(often, "r").groupBy("uid").agg(F.collect_list("r").alias("keys"))
    wanted = written(shared.join(names.select("uid", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")), "uid"), "sfx-wanted")
    forget(table)

    # 2. Extended to windows; those of two texts or more.
    windows = written(_windows(docs, wanted), "sfx-windows")
    forget(wanted)
    met = windows.groupBy("h", "r").agg(F.min("uid").alias("lo"), F.max("uid").alias("hi"), F.min_by("s", "uid").alias("lo_s"), F.max_by("s", "uid").alias("hi_s")).where("lo < hi")
    is_lo = F.col("uid") == F.col("lo")
    hits = windows.join(met, ["h", "r"]).select("uid", "s", F.when(is_lo, F.col("hi")).otherwise(F.col("lo")).alias("other"), F.when(is_lo, F.col("hi_s")).otherwise(F.col("lo_s")).alias("other_s"))

    # 3. Windows that follow one another are one stretch; those that also do in the other text are one match.
    line = Window.partitionBy("uid").orderBy("s")
    before = lambda c: F.lag(c).over(line)
    follows = (before("s") + 1 == F.col("s")) & (before("other") == F.col("other")) & (before("other_s") + 1 == F.col("other_s"))
    marked = hits.repartition("uid").dropDuplicates(["uid", "s"]).withColumn("stretch", F.col("s") - F.row_number().over(line)).withColumn("fresh", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("match", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    matches = marked.groupBy("uid", "stretch", "match").agg(F.min("s").alias("at"), F.count(F.lit(1)).alias("c"), F.first("other").alias("other"), F.min("other_s").alias("other_s"))
    longest = F.max_by(F.struct("at", "c", "other", "other_s"), F.struct(F.col("c"), -F.col("at"))).alias("m")
    spans = matches.groupBy("uid", "stretch").agg(F.min("at").alias("start"), (F.sum("c") + MIN_WORDS - 1).alias("n_words"), longest)
    spans = written(spans.select("uid", "start", "n_words", F.col("m.at").alias("match_start"), (F.col("m.c") + MIN_WORDS - 1).alias("match_words"), F.col("m.other").alias("other"), F.col("m.other_s").alias("other_start")), "sfx-spans")
    forget(windows)

    # 4. By ids, and whole copies.
    mine, theirs = names.select("uid", "doc_id"), names.select(F.col("uid").alias("other"), F.col("doc_id").alias("other_doc_id"))
    columns = ["doc_id", "start", "n_words", "match_start", "match_words", "other_doc_id", "other_start"]
    parts = spans.join(sized(copies.where("uid = first").select("uid")), "uid", "left_anti").join(mine, "uid").join(theirs, "other").select(*columns)
    zero = F.lit(0).cast("long")
    return parts.unionByName(copies.select("doc_id", zero.alias("start"), "n_words", zero.alias("match_start"), F.col("n_words").alias("match_words"), "other_doc_id", zero.alias("other_start")))
