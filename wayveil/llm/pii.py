"""Personal data: fixed patterns, then bootstrapped contextual extraction. SQL functions only.

Matches of the fixed patterns are seeds. The words around a seed are lexical patterns; tokens
that look like identifiers but match no fixed pattern are candidates. Patterns and instances
form a bipartite graph, scored in turns: a pattern is as good as the share of its instances
that are known to be of one kind, a candidate as good as the patterns that hold it together.
Candidates above a threshold join the known ones for the next turn; in the end each of their
occurrences is a span of its own kind (``ctx_email`` and so on) beside the fixed ones.

Null texts are empty: no spans. Null ids and repeated rows keep a row each. Texts are read
whole; every pattern is written without backtracking, so long runs cost linear time. Ties do
not arise: all scores are whole numbers and all orders end in a position.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, forget, same_row, written

KINDS = ("email", "ip", "card", "phone")
# What the data contract fixes, in forms that match the same spans without backtracking. A start
# inside a run that already failed, or the middle of a maximal run, can't match: look-behinds say so.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: A token with a digit or an at sign: what may turn out to be an identifier.
_TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

MIN_SEEDS = 3  # distinct known instances a pattern needs
MIN_PATTERN = 700  # per mille of its instances that are of the kind (one unknown is added to each pattern)
MIN_INSTANCE = 900  # per mille at which a candidate is taken for known
#: Bytes of spans up to which they are broadcast to the scan of texts; beyond, the join shuffles.
BROADCAST_BYTES = 32 << 20
CONTEXT = 80  # characters on either side that context words come from

_SPAN = "array<struct<kind:string,s:int,e:int,m:string,l:array<string>,r:string>>"


def _blank() -> Column:
    return F.array().cast(_SPAN)


def _tail_words(piece: Column) -> Column:
    """The last two words of a piece of text, digits made alike."""
    w = F.array_remove(F.split(F.regexp_replace(F.lower(F.right(piece, F.lit(CONTEXT))), "[0-9]+", "9"), f"{SPACE}+"), "")
    return F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2)


def _head_word(piece: Column) -> Column:
    w = F.array_remove(F.split(F.regexp_replace(F.lower(F.left(piece, F.lit(CONTEXT))), "[0-9]+", "9"), f"{SPACE}+"), "")
    return F.coalesce(F.get(w, F.lit(0)), F.lit(""))


def find_spans(text: Column, pattern: str, kind: str | None) -> Column:
    """Leftmost matches with offsets in code points (end exclusive) and the words around them.

    The pieces between the matches carry the offsets: lengths of pieces and matches add up.
    """
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p"), F.slice(pieces, 2, F.size(matches)).alias("q"))
    start = F.struct(F.lit(0).alias("at"), _blank().alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        one = F.struct(F.lit(kind).cast("string").alias("kind"), s.alias("s"), e.alias("e"), x["m"].alias("m"), _tail_words(x["p"]).alias("l"), _head_word(x["q"]).alias("r"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(one)).cast(_SPAN).alias("out"))

    return F.when(F.size(matches) > 0, F.aggregate(each, start, step, lambda acc: acc["out"])).otherwise(_blank())


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = _digits(m)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        v = F.substr(d, i, F.lit(1)).cast("int")
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


_VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": _luhn,
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _only_valid(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda x: _VALID[kind](x["m"]))


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> valid spans in order of start. Texts without a needed character are not searched."""
    needs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    return {k: F.when(needs[k], _only_valid(find_spans(text, PATTERNS[k], k), k)).otherwise(_blank()) for k in KINDS}


def _candidates(text: Column, known: Column) -> Column:
    """Identifier-like tokens that overlap no known span, without punctuation around them."""

    def trimmed(x: Column) -> Column:
        lead = F.length(x["m"]) - F.length(F.regexp_replace(x["m"], "^[^A-Za-z0-9+]++", ""))
        core = F.regexp_replace(F.regexp_replace(x["m"], "^[^A-Za-z0-9+]++", ""), "(?<=[A-Za-z0-9])[^A-Za-z0-9]++$", "")
        return F.struct(x["kind"].alias("kind"), (x["s"] + lead).alias("s"), (x["s"] + lead + F.length(core)).alias("e"), core.alias("m"), x["l"].alias("l"), x["r"].alias("r"))

    found = F.when(text.rlike("[0-9@]"), find_spans(text, _TOKEN, None)).otherwise(_blank())
    free = F.filter(found, lambda x: ~F.exists(known, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))
    return F.filter(F.transform(free, trimmed), lambda x: (F.length(x["m"]) >= 6) & x["m"].rlike("[0-9@]"))


def _patterns(x: str = "x") -> Column:
    l, r = F.col(f"{x}.l"), F.col(f"{x}.r")
    last = F.coalesce(F.try_element_at(l, F.lit(-1)), F.lit(""))
    both = F.array_join(l, " ")
    return F.array_distinct(F.array(F.concat(F.lit("l1 "), last), F.concat(F.lit("l2 "), both), F.concat(F.lit("r1 "), r), F.concat(F.lit("lr "), last, F.lit(" _ "), r)))


def bootstrap(occurrences: DataFrame) -> DataFrame:
    """(m, kind): candidates that the graph takes for identifiers. ``occurrences``: kind (null: candidate), m, pattern.

    Everything is summed by key before it is shuffled; what a turn joins are distinct edges.
    """
    edges = written(occurrences.select("pattern", "m", "kind").distinct(), "pii-edges")
    size = edges.groupBy("pattern").agg(F.countDistinct("m").alias("n"))
    seeds = edges.where("kind is not null").select("m", "kind").distinct().withColumn("conf", F.lit(1000))
    known, made = seeds, []
    open_edges = edges.where("kind is null").select("pattern", "m")
    links = edges.select("pattern", "m").distinct()
    while True:
        hits = links.join(known, "m").groupBy("pattern", "kind").agg(F.sum("conf").alias("hit"), F.count(F.lit(1)).alias("support"))
        good = hits.where(F.col("support") >= MIN_SEEDS).join(size, "pattern").withColumn("worth", F.floor(F.col("hit") / (F.col("n") + 1)).cast("int")).where(F.col("worth") >= MIN_PATTERN)
        held = open_edges.join(good.select("pattern", "kind", "worth"), "pattern").groupBy("m", "kind").agg(F.sum(F.round(-1e6 * F.ln((1001 - F.col("worth")) / F.lit(1001.0))).cast("long")).alias("bits"), F.count(F.lit(1)).alias("held_by"))
        scored = held.where("held_by >= 2").withColumn("conf", F.floor(1000 * (1 - F.exp(-F.col("bits") / 1e6))).cast("int")).where(F.col("conf") >= MIN_INSTANCE)
        best = scored.groupBy("m").agg(F.max(F.struct("conf", "kind")).alias("b")).select("m", F.col("b.kind").alias("kind"), F.col("b.conf").alias("conf"))
        fresh = written(best, "pii-found")
        made.append(fresh)
        # Until a turn changes nothing, or only goes back and forth between candidates found before.
        names = fresh.select("m")
        if fresh.isEmpty() or (len(made) > 1 and names.join(ever, "m", "left_anti").isEmpty()):
            break
        ever = names if len(made) == 1 else ever.unionByName(names).distinct()
        known = seeds.unionByName(fresh)
    forget(*made[:-1], edges)
    return made[-1]


def extract(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text_hash, one array of valid spans per kind, ``extra`` (spans the graph adds), then ``carry``.

    The text itself is not shuffled: spans are, by document.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *carry).withColumn("text_hash", F.xxhash64("text"))
    found = rows.select("doc_id", "text_hash", *(c.alias(k) for k, c in base_spans(F.col("text")).items()), "text", *carry)
    found = found.withColumn("candidates", _candidates(F.col("text"), F.concat(*KINDS)))
    kept = written(found.select("doc_id", "text_hash", *KINDS, "candidates"), "pii-spans")
    seen = kept.where(F.size(F.concat(*KINDS, "candidates")) > 0).select("doc_id", "text_hash", F.explode(F.concat(*KINDS, "candidates")).alias("x"))
    news = bootstrap(seen.select("x.kind", F.col("x.m").alias("m"), F.explode(_patterns()).alias("pattern")))
    hits = seen.where("x.kind is null").select("doc_id", "text_hash", F.col("x.m").alias("m"), "x.s", "x.e").join(news.select("m", "kind"), "m")
    extra = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct(F.concat(F.lit("ctx_"), F.col("kind")).alias("kind"), "s", "e"))).alias("extra"))
    left = kept.drop("candidates")
    spans = left.join(extra.withColumnsRenamed({"doc_id": "x_id", "text_hash": "x_hash"}), F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("text_hash") == F.col("x_hash")), "left")
    return spans.select("doc_id", "text_hash", *(F.transform(k, lambda x: F.struct(x["kind"], x["s"], x["e"])).alias(k) for k in KINDS), F.coalesce("extra", F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("extra"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, the digest of the fixed spans, all spans."""
    s = extract(docs)
    base = F.concat(*KINDS)
    return s.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.concat(base, "extra")).alias("spans"))


def redact_text(text: Column, spans: Column) -> Column:
    """``text`` with each span (sorted by start; overlapping ones as one) replaced by its kind in brackets."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        more = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit("["), F.upper(F.regexp_replace(x["kind"], "^ctx_", "")), F.lit("]"))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, personal data in ``text`` replaced and ``n_chars`` (if present) recounted.

    Spans the fixed patterns find are replaced where the text is read. Only documents that the
    graph adds spans to are joined: broadcast if they are few (counted first), else by shuffle.
    Columns of any name are kept as they are.
    """
    named = extract(docs).where(F.size("extra") > 0).select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), F.col("extra").alias("found")).distinct()
    extra = written(named, "pii-extra")
    size = extra.agg(F.sum(F.size("found") * 40 + 16)).first()[0] or 0
    text, none = F.coalesce(docs["text"], F.lit("")), F.array().cast("array<struct<kind:string,s:int,e:int>>")
    base = [F.transform(c, lambda x: F.struct(x["kind"], x["s"], x["e"])) for c in base_spans(text).values()]
    every = F.array_sort(F.transform(F.concat(*base, F.coalesce(extra["found"], none)), lambda x: F.struct(x["s"], x["e"], x["kind"])))
    spans = next(n for n in ("spans" + "_" * k for k in count()) if n not in docs.columns)
    joined = docs.join(F.broadcast(extra) if size <= BROADCAST_BYTES else extra, same_row(docs, extra), "left").select(*[docs[c] for c in docs.columns], every.alias(spans))
    new = {"text": F.when(F.size(spans) > 0, redact_text(F.coalesce("text", F.lit("")), F.col(spans))).otherwise(F.col("text"))}
    out = joined.withColumns(new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop(spans)
