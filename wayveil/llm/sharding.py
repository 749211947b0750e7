"""Sharding by a hierarchical weighted hash tree.

Shards are the leaves of a region / rack / shard tree; a node weighs what its leaves weigh.
A row descends from the root: at each level every child draws ``weight / -ln(u)``, with ``u`` a
hash of the row's key and the child's name, and the largest draw wins. A change of a weight
moves rows only between the changed child and its siblings; the draws inside other subtrees
stay as they were. A grown layout puts the new shard into a region of its own, so the only
changed weight is that of a new subtree and rows move into the new shard alone.

Law ``key``: the key and the number of shards decide. Null keys count as one more key.
Null texts have no bytes. Repeated rows go to the same shard and get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc32_of_text

RACK, REGION = 4, 3  # shards in a rack, racks in a region
SLOT_ROWS = 100_000  # rows that one slot bucket should hold

Layout = list[tuple[str, str, str, float]]  # region, rack, shard number as text, weight


def layout(shards: int, base: int) -> Layout:
    """``base`` shards in full regions; each one beyond ``base`` in a region and rack of its own. All weigh 1."""
    out: Layout = []
    for s in range(shards):
        rack = s // RACK if s < base else f"n{s}"
        region = s // (RACK * REGION) if s < base else f"n{s}"
        out.append((f"g{region}", f"g{region}/k{rack}", str(s), 1.0))
    return out


def draw(key: Column, name: str, weight: float) -> Column:
    """The weighted draw of a node for a key; md5 so that any SQL engine can repeat it."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}|"), key)), 1, 13), 16, 10).cast("long")
    return F.lit(weight) / -F.ln((h.cast("double") + 0.5) / F.lit(float(2**52)))


def winner(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The third part of the option with the largest draw; on a tie the first listed."""
    if len(options) == 1:
        return options[0][2]
    draws = [draw(key, name, weight) for name, weight, _ in options]
    return F.array_max(F.array(*[F.struct(d.alias("d"), F.lit(-i).alias("i"), c.alias("c")) for i, (d, (_, _, c)) in enumerate(zip(draws, options))]))["c"]


def descend(key: Column, tree: Layout) -> Column:
    """The shard (int) that a key (string) reaches. One level at a time, so draws are made only where the path leads."""
    regions = list(dict.fromkeys(r for r, *_ in tree))
    weigh = lambda at, name: sum(x[3] for x in tree if x[at] == name)

    def in_rack(rack: str) -> Column:
        return winner(key, [(f"s{s}", w, F.lit(int(s))) for _, k, s, w in tree if k == rack])

    def case(chosen: Column, names: list[str], then) -> Column:
        out = None
        for n in names:
            out = F.when(chosen == n, then(n)) if out is None else out.when(chosen == n, then(n))
        return out

    def in_region(region: str) -> Column:
        racks = list(dict.fromkeys(k for r, k, *_ in tree if r == region))
        return winner(key, [(k, weigh(1, k), F.lit(k)) for k in racks])

    chosen_region = winner(key, [(r, weigh(0, r), F.lit(r)) for r in regions])
    chosen_rack = case(chosen_region, regions, in_region)
    return case(chosen_rack, list(dict.fromkeys(k for _, k, *_ in tree)), in_rack)


def assign(df: DataFrame, key: Column, tree: Layout, to: str) -> DataFrame:
    """``df`` with the shard of each row in column ``to``; no shuffle."""
    return df.withColumn(to, descend(F.coalesce(key.cast("string"), F.lit("")), tree))


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    Slots are ranks in a shard: buckets by hash, ranked each and shifted by the buckets before,
    so no task holds a shard. The text itself is never shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(F.coalesce("text", F.lit(""))) + 8).cast("long").alias("size"), crc32_of_text(F.col("text")).alias("text_crc32"))
    rows = assign(rows, F.col("doc_id"), layout(shards, shards), "shard")
    rows = assign(rows, F.col("doc_id"), layout(shards + 1, shards), "grown_shard")
    n = docs.count()  # from the files' footers
    buckets = max(64, -(-n // (shards * SLOT_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(shift, ["shard", "bucket"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("own") + F.col("shift")).cast("long").alias("slot"), "grown_shard")


def _sql_draw(name: str, weight: float) -> str:
    return f"{weight} / -ln((('0x' || substr(md5('{name}|' || k), 1, 13))::bigint + 0.5) / {2**52}.0)"


def _sql_winner(options: list[tuple[str, float, str]]) -> str:
    if len(options) == 1:
        return options[0][2]
    return "list_max([" + ", ".join(f"{{'d': {_sql_draw(n, w)}, 'i': {-i}, 'c': {c}}}" for i, (n, w, c) in enumerate(options)) + "]).c"


def _sql_descend(tree: Layout) -> tuple[str, str, str]:
    """Expressions for the region, the rack (given column g) and the shard (given column r)."""
    regions, racks = list(dict.fromkeys(r for r, *_ in tree)), list(dict.fromkeys(k for _, k, *_ in tree))
    weigh = lambda at, name: sum(x[3] for x in tree if x[at] == name)
    region = _sql_winner([(r, weigh(0, r), f"'{r}'") for r in regions])
    of = lambda r: list(dict.fromkeys(k for q, k, *_ in tree if q == r))
    rack = "case " + " ".join(f"when g = '{r}' then {_sql_winner([(k, weigh(1, k), f"'{k}'") for k in of(r)])}" for r in regions) + " end"
    leaf = "case " + " ".join(f"when r = '{k}' then {_sql_winner([(f's{s}', w, str(int(s))) for _, q, s, w in tree if q == k])}" for k in racks) + " end"
    return region, rack, leaf


def oracle_sql(shards: int = 24) -> str:
    """The same rows in DuckDB; CRC-32 comes from a recursive-free bit loop over a 256-entry table built by rule."""
    a, b = _sql_descend(layout(shards, shards)), _sql_descend(layout(shards + 1, shards))
    crc_step = "xor(acc >> 8, list_extract(tab, (xor(acc, byte) & 255)::bigint + 1))"
    bit = "case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end"
    table = "select list(v order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, x: " + bit + ") as v from range(256) t(i))"
    crc = lambda hexed: f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length({hexed}) // 2), lambda j: ('0x' || substr({hexed}, 2 * j::bigint + 1, 2))::bigint)), lambda acc, byte: {crc_step}))"
    return f"""with crc_table as ({table}),
d as (select doc_id::bigint as doc_id, coalesce(text, '') as x, coalesce(doc_id::varchar, '') as k from documents),
h as (select doc_id, k, hex(encode(x)) as hx, hex(encode(k)) as hk, strlen(x) + 8 as size from d),
c as (select doc_id, k, size, {crc('hx')} as text_crc32, {crc('hk')} as key_crc from h, crc_table),
a1 as (select *, {a[0]} as g from c), a2 as (select *, {a[1]} as r from a1), a3 as (select * exclude (g, r), {a[2]} as shard from a2),
b1 as (select *, {b[0]} as g from a3), b2 as (select *, {b[1]} as r from b1), b3 as (select * exclude (g, r), {b[2]} as grown_shard from b2),
n as (select greatest(64, ceil(count(*) / {float(shards * SLOT_ROWS)}))::bigint as buckets from documents)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
 (row_number() over (partition by shard order by key_crc % buckets, doc_id nulls first, text_crc32, size) - 1)::bigint as slot, grown_shard::int as grown_shard
from b3, n"""
