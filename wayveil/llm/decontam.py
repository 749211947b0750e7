"""Benchmark decontamination by SimHash windows. SQL functions only.

A document is read in windows as long as the benchmark items are (in words). Each window and
each item has a 64-bit SimHash over its five-word shingles, weighted by their characters. The
fingerprint is cut into blocks; two fingerprints within the radius agree in one block up to a
few bits, so an equi-join on block values, flipped in all such ways on the items' side, finds
every pair within the radius. Pairs it finds are verified by exact weighted Jaccard similarity.

A window without a single shingle of the benchmark has similarity 0 to every item, so only
windows that hold one are fingerprinted; nothing else is left out.

Null and empty texts hold no window; items without words match nothing; an item of fewer than
five words is one shingle. Documents shorter than an item are one window. Null ids, repeated
rows and repeated items are reported like others; equal rows are reported once. An empty
benchmark or table gives no rows. Of windows that tie, the first is reported.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, sized, without, words, written

SHINGLE = 5
BITS = 64
RADIUS = 20
BLOCKS = 7  # so one block differs in at most RADIUS // BLOCKS bits
MIN_PERCENT = 80


def folded(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_list(w: Column) -> Column:
    """(hash, weight) of each five-word window in order; all words as one if they are fewer."""
    many = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]).alias("h"), reduce(lambda a, b: a + b, [F.length(F.get(w, i + k)) for k in range(SHINGLE)]).alias("v")))
    one = F.array(F.struct(short_hash(w).alias("h"), F.length(F.array_join(w, "")).alias("v")))
    none = F.array().cast("array<struct<h:bigint,v:int>>")
    return F.when(F.size(w) >= SHINGLE, many).when(F.size(w) > 0, one).otherwise(none)


def short_hash(w: Column) -> Column:
    """Of a whole sequence of fewer than five words; not to be met by a hash of five."""
    return F.xxhash64(F.lit("short"), F.array_join(w, " "))


def _short_windows(k: int) -> Column:
    return F.transform("w", lambda x, i: F.when(i + k <= F.size("w"), short_hash(F.slice("w", i + 1, k))))


def fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """keys, simhash. ``shingles``: keys, x (hash, weight). Bits are summed map-side."""
    sums = [F.sum(F.when(F.shiftrightunsigned(F.col("x.h"), b).bitwiseAND(1) == 1, F.col("x.v")).otherwise(-F.col("x.v"))).alias(f"b{b}") for b in range(BITS)]
    set_bit = lambda b: F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    return shingles.groupBy(*keys).agg(*sums).select(*keys, reduce(lambda a, b: a.bitwiseOR(b), [set_bit(b) for b in range(BITS)]).alias("simhash"))


def block_bounds() -> list[tuple[int, int]]:
    """(first bit, bits) of each block."""
    cuts = [BITS * k // BLOCKS for k in range(BLOCKS + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _block(k: int, first: int, n: int) -> Column:
    return F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(F.col("simhash"), first).bitwiseAND((1 << n) - 1).cast("int").alias("v"))


def own_blocks() -> Column:
    return F.array(*[_block(k, first, n) for k, (first, n) in enumerate(block_bounds())])


def _flipped(own: Column, masks: list[int]) -> Column:
    return F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(own["k"].alias("k"), own["v"].bitwiseXOR(m).cast("int").alias("v")))


def near_blocks() -> Column:
    """The blocks with up to RADIUS // BLOCKS bits flipped in each."""
    out = []
    for k, (first, n) in enumerate(block_bounds()):
        masks = [sum(1 << i for i in c) for m in range(RADIUS // BLOCKS + 1) for c in combinations(range(n), m)]
        out.append(_flipped(_block(k, first, n), masks))
    return F.concat(*out)


def _weight(s: Column) -> Column:
    return F.aggregate(s, F.lit(0), lambda a, x: a + x["v"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_percent: int = MIN_PERCENT) -> DataFrame:
    """doc_id, text_hash, item_id, start, n_words, hamming, similarity: the best window of each document and item.

    ``start`` counts words from 0. The corpus' text is scanned twice and never shuffled while the
    documents that hold a benchmark shingle are few; benchmark-sized tables are broadcast by count.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(folded(F.col("text"))).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("n", F.size("w")).withColumn("sh", shingle_list(F.col("w"))).dropDuplicates(["item_id", "w"])
    items = written(items.select("item_id", "n", "sh", F.xxhash64("item_id", "w").alias("item_key")), "bench-items")
    vocabulary = written(items.select(F.explode("sh.h").alias("h"), "n").distinct(), "bench-shingles")
    short = sorted(r.n for r in items.where(F.col("n") < SHINGLE).select("n").distinct().collect())  # at most four values

    # 1. Positions of benchmark shingles in documents.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), folded(F.col("text")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    rows = keyed.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    vocab = sized(vocabulary)
    spread = F.arrays_zip(*[F.slice("w", k + 1, F.greatest(F.size("w") - k, F.lit(0))).alias(f"w{k}") for k in range(SHINGLE)])
    at = rows.select("doc_id", "text_hash", F.size("w").alias("n_doc"), F.posexplode(spread).alias("pos", "g")).where("g.w4 is not null")
    at = at.select("doc_id", "text_hash", "n_doc", "pos", F.xxhash64(*[F.col(f"g.w{k}") for k in range(SHINGLE)]).alias("h"))
    hits = at.join(vocab, "h").select("doc_id", "text_hash", "n_doc", "pos", "n")
    for k in short:
        part = rows.select("doc_id", "text_hash", F.size("w").alias("n_doc"), F.posexplode(_short_windows(k)).alias("pos", "h")).where("h is not null")
        hits = hits.unionByName(part.join(vocab.where(F.col("n") == k), "h").select("doc_id", "text_hash", "n_doc", "pos", "n"))

    # 2. The windows, of each item size, that hold one: spans of starts by document and size.
    reach = F.greatest(F.col("n") - SHINGLE, F.lit(0))
    last = F.greatest(F.col("n_doc") - F.col("n"), F.lit(0))
    starts = hits.select("doc_id", "text_hash", "n", F.least(F.greatest(F.col("pos") - reach, F.lit(0)), last).alias("a"), F.least("pos", last).alias("b")).distinct()
    spans = starts.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("n", "a", "b")).alias("spans"))
    spans = written(spans, "bench-spans")
    marked = spans.select(F.col("doc_id").alias("m_id"), F.col("text_hash").alias("m_hash"), "spans")
    some = keyed.join(sized(marked), F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))).select("doc_id", "text_hash", words(F.col("text")).alias("w"), "spans").dropDuplicates(["doc_id", "text_hash"])
    each = some.withColumn("all", shingle_list(F.col("w"))).select("doc_id", "text_hash", "w", "all", F.explode(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.transform(F.sequence(s["a"], s["b"]), lambda p: F.struct(s["n"].alias("n"), p.alias("start"))))))).alias("x"))
    whole = F.when(F.col("x.n") >= SHINGLE, F.slice("all", F.col("x.start") + 1, F.greatest(F.col("x.n") - SHINGLE + 1, F.lit(1)))).otherwise(shingle_list(F.slice("w", F.col("x.start") + 1, F.col("x.n"))))
    windows = written(each.select("doc_id", "text_hash", F.col("x.n").alias("n"), F.col("x.start").alias("start"), whole.alias("sh")), "bench-windows")

    # 3. Fingerprints, blocks, candidates.
    marks = fingerprints(windows.select("doc_id", "text_hash", "n", "start", F.explode("sh").alias("x")), ["doc_id", "text_hash", "n", "start"])
    item_marks = fingerprints(items.select("item_key", "n", F.explode("sh").alias("x")), ["item_key", "n"])
    targets = written(item_marks.select("item_key", "n", F.col("simhash").alias("item_mark"), F.explode(near_blocks()).alias("b")), "bench-blocks")
    probes = marks.select("doc_id", "text_hash", "n", "start", "simhash", F.explode(own_blocks()).alias("b"))
    near = probes.join(sized(targets), ["n", "b"]).withColumn("hamming", F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_mark")))).where(F.col("hamming") <= RADIUS)
    near = near.select("doc_id", "text_hash", "n", "start", "item_key", "hamming").distinct()

    # 4. Exact weighted similarity of what is left.
    w = windows.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), F.col("n").alias("w_n"), F.col("start").alias("w_start"), F.array_distinct("sh").alias("ws"))
    both = near.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")) & (F.col("n") == F.col("w_n")) & (F.col("start") == F.col("w_start")))
    both = both.join(sized(items.select("item_key", "item_id", F.array_distinct("sh").alias("is"))), "item_key")
    shared = _weight(F.array_intersect("ws", "is"))
    checked = both.withColumn("shared", shared).withColumn("all", _weight(F.col("ws")) + _weight(F.col("is")) - F.col("shared")).where(100 * F.col("shared") >= min_percent * F.col("all"))
    ratio = F.col("shared") / F.col("all")
    best = checked.groupBy("doc_id", "text_hash", "item_id").agg(F.max_by(F.struct("start", F.col("n").alias("n_words"), "hamming", ratio.alias("similarity")), F.struct(ratio, -F.col("start"), -F.col("hamming"))).alias("b"))
    out = written(best.select("doc_id", "text_hash", "item_id", "b.start", "b.n_words", "b.hamming", "b.similarity"), "bench-leaks")
    forget(items, vocabulary, spans, windows, targets)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a window repeats a benchmark item; columns of any name are kept as they are."""
    return without(docs, find_leaks(docs, benchmark))
