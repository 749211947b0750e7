"""Exact Jaccard self-join of documents as a metric-space join, down to linked groups.

1 - Jaccard is a metric. The space is cut in three steps, each of which loses no link:

1. A shingle is a pivot too: a set of one. In a fixed order of all shingles (rare ones first) two
   linked documents share one among their first n - ceil(t n) + 1, so each document joins the
   regions of those; sizes and positions drop those with no possible partner in a region. Regions
   that open around the same first document are one cell, and that document is its pivot.
2. A cell too large for a task takes more pivots and each of its documents is measured against
   them. A document goes to its nearest pivot (its Voronoi region) and, by the triangle
   inequality, into every region whose pivot is no further than the nearest plus twice the radius:
   whoever links with a document of that region is there as well. Documents far from every pivot
   share one more region. Regions are cut again until they fit a task.
3. A cell that pivots can't cut (all its documents are within the window of each) is joined block
   by block; documents linked to one pivot are linked already, so their blocks never meet.

In a task, documents are sorted by distance to the cell's first one and each is compared, whole
set with whole set, with the window of those whose distance differs by no more than the radius.
What comes out are links enough to span each component, never all pairs.

Equal shingle sets are one class with one representative. Null and empty texts have an empty
set and link with nothing. Null ids take part but are no one's smallest id. Repeated rows are
one class and are returned each. An empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import TEXT_ROWS, forget, same_row, sized, without, written
from .components import components

SHINGLE = 5
PERCENT = 80
#: Hash bound under which all shingles of a document are offered as prefix shingles; a little
#: over the share a prefix needs. Documents with too few below it offer the next ones as well.
CUT = int(0.22 * 2**63)
MEMORY = 300_000
#: Documents, and shingles of them all, that one task takes as a cell.
LEAF_ROWS, LEAF_SHINGLES = 1_000, 4_000_000
#: Pivots that a larger cell is cut by.
PIVOTS = 16
_EMPTY = np.empty(0, np.int64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, memory: _WordHashes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the k-word shingles; A-Z folded; all words as one if fewer than k."""
    w = text.lower().split()
    n = len(w)
    if n == 0:
        return _EMPTY
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(w), seed=1) >> 1], np.int64)
    a = np.fromiter(map(memory.__getitem__, w), np.uint64, n)
    h = a[: n - k + 1].copy()
    for i in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += a[i : n - k + 1 + i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return np.unique(h >> np.uint64(1)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    """How many of n shingles surely hold one that is shared with any set at least ``percent`` similar."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def offer(docs: DataFrame, percent: int) -> DataFrame:
    """uid, doc_id, text_hash, n (set size), d1, d2 (digest of the set), low (offered shingles under CUT), tok."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _WordHashes()
        for b in batches:
            n, d1, d2, low, tok = [], [], [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), memory)
                digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                below = int(np.searchsorted(s, CUT))
                n.append(len(s))
                d1.append(int.from_bytes(digest[:8], "big", signed=True))
                d2.append(int.from_bytes(digest[8:], "big", signed=True))
                low.append(below)
                tok.append(s[: max(below, prefix_size(len(s), percent))].copy())  # a view would hold the whole set
            at = np.cumsum([0, *map(len, tok)]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([_EMPTY, *tok])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.int64()) for x in (n, d1, d2, low)), arrays], names=["doc_id", "text_hash", "n", "d1", "d2", "low", "tok"])

    got = _narrow(docs).mapInArrow(run, "doc_id long, text_hash long, n long, d1 long, d2 long, low long, tok array<long>")
    return got.withColumn("uid", F.monotonically_increasing_id())  # frozen by writing the table


def _narrow(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def _common(every: DataFrame) -> DataFrame:
    """t, rid, df: the rows of ``every`` (rid, t) whose t has two or more, and how many.

    Counting and joining read one exchange. Were ``rid`` not used in counting, it would be pruned there and all rows be shuffled twice.
    """
    dealt = every.where("rid is not null and t is not null").repartition("t")
    often = dealt.groupBy("t").agg(F.count("rid").alias("df"), F.min("rid").alias("one")).where("df >= 2 and one is not null").select("t", "df")
    return dealt.join(often, "t")


def region_members(table: DataFrame, reps: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """t (a shingle), rid, n, i: who meets whom; i is how many of the document's shingles come before t. Only regions of two or more.

    ``others`` (uid): rows whose set a representative stands for; a shingle is common if two representatives have it.
    """
    every = table.join(sized(others), "uid", "left_anti").select(F.col("uid").alias("rid"), F.explode("tok").alias("t"))
    shared = _common(every).join(reps, "rid")
    need = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1
    low = F.col("t") < CUT
    ranked = shared.withColumn("shared_low", F.count_if(low).over(Window.partitionBy("rid"))).withColumn("k", F.row_number().over(Window.partitionBy("rid", low).orderBy(F.when(low, F.col("df")).otherwise(F.lit(0)), "t")))
    # Shingles no one else has come first; if even those fill the prefix, the document has no partner.
    # Beyond the cut shingles stand in order of their hash, with at least the shared ones before them.
    ranked = ranked.withColumn("i", F.when(low, F.col("low") - F.col("shared_low") + F.col("k") - 1).otherwise(F.col("low") + F.col("k") - 1))
    prefix = written(ranked.where((F.col("low") < need) | (low & (F.col("i") < need))).select("t", "rid", "n", "i"), "jac-prefix")
    once = written(_who_can_meet(prefix, percent), "jac-meet")
    forget(prefix)
    twice = written(_who_can_meet(once, percent), "jac-members")  # some have nobody left after the first time
    forget(once)
    return twice


def _who_can_meet(members: DataFrame, percent: int) -> DataFrame:
    """Members with somebody of a fitting size in their region.

    If a pair's first common shingle is t, it shares at most what follows t in either. So each is no
    larger than the other's ``reach``, and no smaller than the similarity allows. Sizes are compared by
    classes of 1/20, of which the smallest size and the furthest reach are known. Two documents that
    share little besides a common passage reach only smaller ones than themselves, and so don't meet.
    """
    reach = F.floor((100 + percent) * (F.col("n") - F.col("i")) / percent) - F.col("n")
    classes = math.ceil(math.log(100 / percent, 1.05)) + 1
    classed = members.withColumn("z", F.floor(F.ln("n") / math.log(1.05)).cast("int")).withColumn("reach", reach)
    sizes = classed.groupBy("t", "z").agg(F.min("n").alias("small"), F.max("reach").alias("far"), F.count(F.lit(1)).alias("c"))
    sizes = sizes.groupBy("t").agg(F.collect_list(F.struct("z", "small", "far", "c")).alias("sizes")).where("size(sizes) > 1 or sizes[0].c > 1")  # a few dozen classes at most
    fits = F.exists("sizes", lambda s: (s["small"] <= F.col("reach")) & (s["far"] >= F.col("n")) & (s["z"] >= F.col("z") - classes) & ((s["z"] != F.col("z")) | (s["c"] > 1)))
    return classed.join(sizes, "t").where(fits).select("t", "rid", "n", "i")


def sets_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """rid, s (the shingle set as bytes) of the representatives in ``wanted`` (rid), made anew from their texts; once for a repeated row."""
    names = written(reps.join(wanted, "rid", "left_semi").select("rid", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "repeated"), "jac-names")
    found = docs.join(sized(names), same_row(docs, names)).select(names["rid"], F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _WordHashes()
        for b in batches:
            made = pa.array([shingle_set(t.as_py(), memory).tobytes() for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), made], names=["rid", "s"])

    made = found.mapInArrow(run, "rid long, s binary")
    out = written(made if names.where("repeated").isEmpty() else made.dropDuplicates(["rid"]), "jac-sets", TEXT_ROWS)
    forget(names)
    return out


def cell_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the sets (by position), enough to span every component.

    Sets are sorted by distance to the first. One that has been reached is compared with those not
    reached yet whose distance differs by no more than the radius; what it links with is reached.
    """
    radius = 1 - percent / 100 + 1e-9
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, token, often = np.unique(np.concatenate([_EMPTY, *sets]), return_inverse=True, return_counts=True)
    shared = often[token] > 1  # the rest counts by its number alone
    owner, token = owner[shared], token[shared]
    mark = np.zeros(len(often), bool)
    begin = np.searchsorted(owner, np.arange(len(sets) + 1))

    def joint(x: int, tokens: np.ndarray, edges: np.ndarray) -> np.ndarray:
        own = token[begin[x] : begin[x + 1]]
        mark[own] = True
        run = np.concatenate([[0], np.cumsum(mark[tokens])])
        mark[own] = False
        return run[edges[1:]] - run[edges[:-1]]

    first = joint(0, token, begin)
    distance = 1 - first / (size + size[0] - first)

    def line_up(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in order of distance, their tokens and where each one's begin."""
        ids = ids[np.argsort(distance[ids], kind="stable")]
        parts = [token[begin[i] : begin[i + 1]] for i in ids]
        return ids, np.concatenate([token[:0], *parts]), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    ids, tokens, edges = line_up(np.arange(len(sets)))
    open_ = np.ones(len(ids), bool)
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while True:
        if not queue:
            left = np.flatnonzero(open_)
            if not len(left):
                return links
            open_[left[0]] = False
            queue = [int(ids[left[0]])]
        x = queue.pop()
        at = distance[ids]
        lo, hi = np.searchsorted(at, distance[x] - radius), np.searchsorted(at, distance[x] + radius, side="right")
        if lo >= hi or not open_[lo:hi].any():
            continue
        n = joint(x, tokens[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo])
        reached = lo + np.flatnonzero(open_[lo:hi] & (100 * n >= percent * (size[ids[lo:hi]] + size[x] - n)))
        open_[reached] = False
        new = ids[reached].tolist()
        links += [(x, y) for y in new]
        queue += new
        if 2 * np.count_nonzero(open_) < len(ids):
            ids, tokens, edges = line_up(ids[open_])
            open_ = np.ones(len(ids), bool)


def _leaf_links(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v: links within the cells (cell, rid), each of which fits a task."""

    def run(table: pa.Table) -> pa.Table:
        rid = table["rid"].to_numpy()
        order = np.argsort(rid)
        made = [np.frombuffer(s, np.int64) for s in table["s"].to_pylist()]
        links = cell_links([made[i] for i in order], percent)
        u, v = (rid[order[[x[k] for x in links]]] if links else _EMPTY for k in (0, 1))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return sets.join(sized(cells), "rid").select("cell", "rid", "s").groupBy("cell").applyInArrow(run, "u long, v long")


def _measured(big: DataFrame, sets: DataFrame, turn: int, percent: int, leaf_rows: int, leaf_shingles: int) -> DataFrame:
    """cell, rid, n, rows, total, d (distance to each of the cell's pivots), linked (the pivots it links with).

    ``big``: cell, rid, n, rows, total. Cells are dealt in chunks that fit a task; each chunk gets the pivots' sets.
    """
    chunks = F.greatest(F.ceil(F.col("rows") / leaf_rows), F.ceil(F.col("total") / leaf_shingles)).cast("int")
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("rid", F.lit(turn)), "rid"))
    chosen = big.withColumn("k", rank).where(F.col("k") <= PIVOTS)  # the limit also acts before the shuffle
    chosen = written(chosen.join(sets, "rid").select("cell", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), "rid", "s"), "jac-pivots")
    dealt = big.withColumn("chunk", F.pmod(F.xxhash64("rid"), chunks).cast("int")).join(sets, "rid").select("cell", "chunk", "rid", "n", "rows", "total", "s")

    def run(mine: pa.Table, pivots: pa.Table) -> pa.Table:
        order = np.argsort(pivots["rid"].to_numpy())
        ids = pivots["rid"].to_numpy()[order]
        theirs = [np.frombuffer(pivots["s"][int(i)].as_py(), np.int64) for i in order]
        d, linked = [], []
        for s in mine["s"]:
            x = np.frombuffer(s.as_py(), np.int64)
            joint = np.array([len(np.intersect1d(x, p, assume_unique=True)) for p in theirs])
            union = np.array([len(p) for p in theirs]) + len(x) - joint
            d.append((1 - joint / union).tolist())
            linked.append(ids[100 * joint >= percent * union].tolist())
        return mine.select(["cell", "rid", "n", "rows", "total"]).append_column("d", pa.array(d, pa.list_(pa.float64()))).append_column("linked", pa.array(linked, pa.list_(pa.int64())))

    return dealt.groupBy("cell", "chunk").cogroup(chosen.groupBy("cell", "chunk")).applyInArrow(run, "cell long, rid long, n long, rows long, total long, d array<double>, linked array<long>")


def _voronoi(measured: DataFrame, turn: int, percent: int) -> DataFrame:
    """cell, sub, rid, n: each document in its nearest pivot's region and in those its window reaches.

    Region -1 is of those far from all pivots: a pair with one of them at 1 - radius or more from its
    nearest pivot has the other at 1 - 2 radius or more. Every other pair meets in the home of either.
    """
    radius, eps = 1 - percent / 100, 1e-9
    near = F.array_min("d")
    at = F.filter(F.sequence(F.lit(0), F.size("d") - 1), lambda j: (near < 1 - radius + eps) & (F.get("d", j) < 1) & (F.get("d", j) <= near + 2 * radius + eps))
    far = F.when(near >= 1 - 2 * radius - eps, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return measured.select("cell", F.explode(F.concat(at, far)).alias("j"), "rid", "n").select("cell", F.xxhash64("cell", F.lit(turn), "j").alias("sub"), "rid", "n")


def _blocks(measured: DataFrame, percent: int, leaf_rows: int, leaf_shingles: int) -> DataFrame:
    """cell, rid: cells of two blocks each, so that any two documents meet that can link and aren't linked to one pivot.

    Blocks are of like sizes: sets whose sizes are two classes apart are too different.
    """
    size_class = F.floor(F.ln("n") / math.log(100 / percent) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
    named = measured.select("cell", "rid", "n", F.array_min("linked").alias("own"), size_class.alias("z"))
    many = written(named.where("own is not null").groupBy("cell", "own").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") * 8 >= leaf_rows).select("cell", "own", F.col("own").alias("label")), "jac-labels")
    named = named.join(sized(many), ["cell", "own"], "left").drop("own")  # a few documents around a pivot are no block of their own
    size = named.groupBy("cell", "label", "z").agg(F.greatest(F.ceil(F.count(F.lit(1)) * 2 / leaf_rows), F.ceil(F.sum("n") * 2 / leaf_shingles)).alias("n_blocks"))
    blocks = written(size.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))).withColumn("b", F.xxhash64("label", "z", "k")), "jac-blocks")
    one, two = (blocks.select("cell", F.col("label").alias(f"l{i}"), F.col("z").alias(f"z{i}"), F.col("b").alias(f"b{i}")) for i in (1, 2))
    meet = one.join(two, "cell").where("b1 <= b2 and abs(z1 - z2) <= 1 and not coalesce(l1 = l2, false)").withColumn("pair", F.xxhash64("cell", "b1", "b2"))
    meet = meet.select("cell", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("b"), "pair")
    of = size.select(F.col("cell").alias("of_cell"), F.col("label").alias("of_label"), F.col("z").alias("of_z"), "n_blocks")
    own = named.join(of, (F.col("cell") == F.col("of_cell")) & F.col("label").eqNullSafe(F.col("of_label")) & (F.col("z") == F.col("of_z"))).select("cell", "rid", F.xxhash64("label", "z", F.pmod(F.xxhash64("rid"), "n_blocks")).alias("b"))
    return own.join(meet, ["cell", "b"]).select(F.col("pair").alias("cell"), "rid")


def _sweep(spark: SparkSession) -> None:
    """Let Spark drop shuffle files of plans that are done with."""
    gc.collect()
    spark._jvm.System.gc()


def link_classes(docs: DataFrame, table: DataFrame, reps: DataFrame, others: DataFrame, percent: int = PERCENT, leaf_rows: int = LEAF_ROWS, leaf_shingles: int = LEAF_SHINGLES) -> DataFrame:
    """node, component over representatives that link with another; empty if none does. ``table`` is read no more when this returns."""
    spark = docs.sparkSession
    members = region_members(table, reps.select("rid", "n", "low"), others, percent)
    _sweep(spark)
    first = members.groupBy("t").agg(F.min("rid").alias("cell"))
    work = written(members.join(first, "t").select("cell", "rid", "n").distinct(), "jac-cells")
    forget(members)
    sets = sets_of(docs, reps, work.select("rid").distinct())
    leaves, links, turn = [], [], 0
    while True:
        sizes = work.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("total"))
        large = written(sizes.where((F.col("rows") > leaf_rows) | (F.col("total") > leaf_shingles) & (F.col("rows") > 2)), "jac-large")
        if large.isEmpty():
            leaves.append(work.select("cell", "rid"))
            break
        leaves.append(work.join(sized(large.select("cell")), "cell", "left_anti").select("cell", "rid"))
        measured = written(_measured(work.join(sized(large), "cell"), sets, turn, percent, leaf_rows, leaf_shingles), "jac-measured")
        links.append(measured.select(F.col("rid").alias("u"), F.explode("linked").alias("v")))
        regions = _voronoi(measured, turn, percent)
        # A cut counts if no region has more than half the cell and copies no more than double it.
        cut = regions.groupBy("cell", "sub").agg(F.count(F.lit(1)).alias("c")).groupBy("cell").agg(F.max("c").alias("most"), F.sum("c").alias("all"))
        cut = written(cut.join(large.select("cell", "rows"), "cell").where("2 * most <= rows and all <= 2 * rows").select("cell"), "jac-cut")
        work = written(regions.join(sized(cut), "cell").select(F.col("sub").alias("cell"), "rid", "n"), "jac-regions")
        leaves.append(written(_blocks(measured.join(sized(cut), "cell", "left_anti"), percent, leaf_rows, leaf_shingles), "jac-pairs"))
        turn += 1
    _sweep(spark)
    whole = written(reduce(DataFrame.unionByName, leaves), "jac-leaves")
    found = _leaf_links(whole, sets, percent)
    linked = written(reduce(DataFrame.unionByName, [found, *links]).distinct(), "jac-links")
    forget(sets, whole, *leaves, work)
    return components(linked)


def _grouped(docs: DataFrame, percent: int, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, cell (of linked classes; null without words) for each row of ``docs``."""
    offered = written(offer(docs, percent), "jac-offered", TEXT_ROWS)
    table = written(offered.drop("tok"), "jac-rows")
    groups = written(table.where("n > 0").groupBy("d1", "d2").agg(F.min("uid").alias("rid")), "jac-classes")
    rows = table.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("c"))
    again = written(rows.where("c > 1").select("doc_id", "text_hash", F.lit(True).alias("repeated")), "jac-again")
    named = table.select(F.col("uid").alias("rid"), "doc_id", "text_hash", "n", "low").join(groups.select("rid"), "rid", "left_semi")
    twin = again.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "repeated")
    reps = written(named.join(sized(twin), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")), "left").select("rid", "doc_id", "text_hash", "n", "low", F.coalesce("repeated", F.lit(False)).alias("repeated")), "jac-reps")
    others = written(table.where("n > 0").select("uid").join(groups.select(F.col("rid").alias("uid")), "uid", "left_anti"), "jac-others")
    cells = written(link_classes(docs, offered, reps, others, percent, leaf_rows), "jac-components")
    forget(offered, reps, again, others)
    named = groups.join(cells, groups["rid"] == cells["node"], "left").select("d1", "d2", F.coalesce("component", "rid").alias("cell"))
    out = written(table.join(named, ["d1", "d2"], "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cell")).alias("cell")), "jac-grouped")
    forget(table, groups, cells)
    _sweep(docs.sparkSession)
    return out


def classes_of(docs: DataFrame, percent: int = PERCENT, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for each row of ``docs``."""
    rows = _grouped(docs, percent, leaf_rows)
    least = rows.where("cell is not null").groupBy("cell").agg(F.min("doc_id").alias("component"))
    return rows.join(least, "cell", "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each linked group: the one with the smallest id (null ids last; then the smallest hash of the text).

    Rows without words are in no group and all stay. The rows that go are joined against: broadcast
    if they are few (counted first), else by shuffle. A row that is repeated whole under the smallest
    id stays once; such rows alone are gathered, by their id and text.
    """
    rows = _grouped(docs, percent).where("cell is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = rows.groupBy("cell").agg(F.min(order).alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1").select("cell", F.col("b.doc_id").alias("b_id"), F.col("b.text_hash").alias("b_hash"))
    in_groups = written(rows.join(best, "cell").select("doc_id", "text_hash", (F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("text_hash") == F.col("b_hash"))).alias("stays")), "jac-verdicts")
    left = without(docs, in_groups.where(~F.col("stays")))
    again = written(in_groups.where("stays").groupBy(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "jac-repeated")
    if again.isEmpty():
        return left
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    once = docs.join(sized(again), same_row(docs, again)).select(again["w_id"].alias("i"), again["w_hash"].alias("h"), whole).groupBy("i", "h").agg(F.first("row").alias("row")).select("row.*")
    return without(left, again.select(F.col("w_id").alias("doc_id"), F.col("w_hash").alias("text_hash"))).unionByName(once)
