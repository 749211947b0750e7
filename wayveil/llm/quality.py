"""Quality rules: fixed base rules, then a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the
buckets are counted: one from trusted documents, one from the whole raw corpus. A document's
score is the mean, over its n-grams, of log(trusted / raw); documents under a threshold are
rejected. The threshold comes from the own scores of all trusted documents, in whole micro-nats: as
far below their low end as that is below their median. Ratios are rounded to whole micro-nats, so sums do not depend on
their order and every document's verdict is reproducible.

Null and empty texts have no words: they fail the base rules. Repeated rows get a verdict each,
null ids as well. Texts are read whole. On an empty table the model is flat and nothing is returned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized, words, written

BUCKETS = 1 << 14
SMOOTHING = 1.0
#: Of the trusted documents' scores: the share that marks their low end, and how far below it the threshold
#: lies, in distances from there to the median.
LOW_SHARE, MARGIN = 0.001, 1.0
#: Whole scores that are counted as one range first.
WIDTH = 1024


def bucket(*cols: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def grams(df: DataFrame, word_col: str = "words") -> DataFrame:
    """A row for each word with the word after it (null for the last); one row with nulls if there is none."""
    after = F.slice(F.col(word_col), 2, F.greatest(F.size(word_col) - 1, F.lit(0)))
    return df.withColumn("g", F.explode_outer(F.arrays_zip(F.col(word_col).alias("w"), after.alias("n"))))


def marked(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """``docs`` and a column ``trusted``: whether ``trusted`` has the doc_id. 64 ids are one row of bits, broadcast if counted small."""
    i = F.col("doc_id").cast("long")
    one = F.expr("shiftleft(1L, cast(i & 63 as int))")
    bits = trusted.select(i.alias("i")).where("i is not null").groupBy(F.shiftright("i", 6).alias("w")).agg(F.bit_or(one).alias("bits"))
    found = docs.withColumn("w", F.shiftright(i, 6)).join(sized(written(bits, "trusted")), "w", "left")
    return found.withColumn("trusted", F.coalesce(F.getbit("bits", i.bitwiseAND(63).cast("int")) == 1, F.lit(False))).drop("w", "bits")


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, trusted, n over all words and word pairs of column ``text``. Map-side sums leave twice ``buckets`` rows a task."""
    g = grams(texts.select(words(F.col("text")).alias("words"), "trusted")).where("g.w is not null")
    both = g.select("trusted", F.explode(F.array(bucket(F.col("g.w"), buckets=buckets), F.when(F.col("g.n").isNotNull(), bucket(F.col("g.w"), F.col("g.n"), buckets=buckets)))).alias("bucket"))
    return both.where("bucket is not null").groupBy("bucket", "trusted").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """log(trusted / raw) of each bucket in micro-nats. ``trusted``: doc_id of documents to learn from.

    Raw counts cover all of ``docs``, trusted ones all that are trusted; the driver receives two numbers per bucket.
    """
    rows = bucket_counts(marked(docs.select("doc_id", "text"), trusted), buckets).collect()
    counts: dict[str, dict[int, int]] = {"t": {r.bucket: r.n for r in rows if r.trusted}, "r": {}}
    for r in rows:
        counts["r"][r.bucket] = counts["r"].get(r.bucket, 0) + r.n
    total = {k: sum(v.values()) + SMOOTHING * buckets for k, v in counts.items()}
    logs = lambda k, b: math.log((counts[k].get(b, 0) + SMOOTHING) / total[k])
    return [round(1e6 * (logs("t", b) - logs("r", b))) for b in range(buckets)]


def quantiles(values: DataFrame, shares: list[float]) -> list[float] | None:
    """Exact quantiles, between neighbours by proportion, of whole numbers (column ``v``); none of no rows.

    Counted by ranges first, then by value in the few ranges that hold a rank asked for.
    """
    wide = F.floor(F.col("v") / WIDTH)
    coarse = sorted((r.b, r.n) for r in values.groupBy(wide.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    n = sum(c for _, c in coarse)
    if not n:
        return None
    places = [s * (n - 1) for s in shares]
    ranks = {r for p in places for r in (math.floor(p), math.ceil(p))}

    def holding(counted: list[tuple[int, int]], before: int = 0) -> dict[int, tuple[int, int]]:
        """rank -> what holds it, and how many rows come before that"""
        out = {}
        for b, c in counted:
            out.update({r: (b, before) for r in ranks if before <= r < before + c})
            before += c
        return out

    at = holding(coarse)
    fine = sorted((r.v, r.n) for r in values.where(wide.isin(sorted({b for b, _ in at.values()}))).groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect())
    exact = {}
    for b, before in set(at.values()):
        exact |= holding([(v, c) for v, c in fine if v // WIDTH == b], before)
    value = {r: exact[r][0] for r in ranks}
    return [value[math.floor(p)] + (p - math.floor(p)) * (value[math.ceil(p)] - value[math.floor(p)]) for p in places]


def threshold_of(scored: DataFrame, trusted: DataFrame) -> float:
    """The score from which documents are kept, in micro-nats a gram, from all trusted ones among ``scored`` (doc_id, base_failed, score); with nobody to trust it rejects none."""
    own = marked(scored.where("not base_failed").select("doc_id", F.floor("score").alias("v")), trusted).where("trusted")
    low, middle = quantiles(own.select("v"), [LOW_SHARE, 0.5]) or (-math.inf, -math.inf)
    return low - MARGIN * (middle - low) if low > -math.inf else low


def base_columns(text: Column) -> dict[str, Column]:
    """The base rules' counts (see the data contract); needs a column ``words``."""
    shown, w = F.coalesce(text, F.lit("")), F.col("words")
    lines = F.filter(F.split(shown, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # Windows of three words by hash; equal hashes count only if the words are equal.
    n = F.size(w) - 2
    at = lambda i, k: F.get(w, i + k)
    hashes = F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2))))
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda o, a, b: (F.get(o, a)["h"] == F.get(o, b)["h"]) & F.forall(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: at(F.get(o, a)["i"], k) == at(F.get(o, b)["i"], k))
    twins = F.transform(F.array(order), lambda o: F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(same(o, j, j - 1), F.lit(False)) | F.coalesce(same(o, j, j + 1), F.lit(False))), lambda j: F.get(o, j)["i"])))
    covered = F.aggregate(F.get(twins, F.lit(0)), F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(3), s - acc["last"])).alias("n")), lambda acc: acc["n"])
    repeated = F.when(F.size(F.array_distinct(hashes)) < n, covered)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(shown) - F.length(F.translate(shown, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(repeated, F.lit(0)).cast("long"),
    }


def judge(docs: DataFrame, weights: list[int], threshold: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the base counts, base_failed, n_grams, score (micro-nats a gram), kept, then ``carry``.

    Each text goes into words once; a row's n-grams are summed map-side, so what is shuffled is one
    small row per document. Equal rows meet in one sum and are counted out again afterwards.
    """
    ratio = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")  # folded once, `buckets` numbers
    look = lambda b: F.element_at(ratio, b + 1).cast("long")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", words(F.col("text")).alias("words"), *carry)
    base = base_columns(F.col("text"))
    keys = ["doc_id", *base, "text_hash"]
    rows = named.select("doc_id", *(c.alias(k) for k, c in base.items()), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "words", *carry)
    g = grams(rows)
    own = F.when(F.col("g.w").isNotNull(), look(bucket(F.col("g.w"), buckets=len(weights))))
    pair = F.when(F.col("g.n").isNotNull(), look(bucket(F.col("g.w"), F.col("g.n"), buckets=len(weights))))
    # Of n words, the row without a follower is the last; a document has one such row.
    summed = g.select(*keys, *carry, (F.coalesce(own, F.lit(0)) + F.coalesce(pair, F.lit(0))).alias("v"), F.col("g.n").isNull().alias("last")).groupBy(*keys, *carry).agg(F.sum("v").alias("total"), F.count_if("last").alias("copies"))
    grams_each = F.greatest(2 * F.col("n_words") - 1, F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = summed.withColumn("n_grams", grams_each).withColumn("score", F.when(F.col("n_grams") > 0, F.col("total") / F.col("copies") / F.col("n_grams")).otherwise(F.lit(0.0)))
    scored = scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
    return scored.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc_id", *base, "base_failed", "kept", "score", "n_grams", "text_hash", *carry)


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge ``docs``, trusting what ``labels`` marks as of quality 1."""
    trusted = labels.where("quality = 1")
    scored = written(judge(docs, fit(docs, trusted), -math.inf), "scored")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold_of(scored, trusted)))
