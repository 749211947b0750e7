"""Personal data, decontamination and the Jaccard join against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wayveil.llm import components, decontam, jaccard, pii

from .test_per_row import texts_of

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum((2 * int(c) - 9 * (int(c) > 4)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = {
        "email": list(EMAIL.finditer(t)),
        "ip": [m for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15],
    }
    spans = [f"{k}:{m.start()}:{m.end()}" for k in pii.KINDS for m in found[k]]
    return (*(len(found[k]) for k in pii.KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest()), spans


PII_EDGES = [
    "a@b.c_d@e.f g@h.i.j..k@l.m", "a@b a@b. x@y.z@w.v", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3.4.5 0001.2.3.255 256.1.1.1 12345678901234567890.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111111111 4111  1111 1 2 4111111111111111", "+1 (988) 555-2485 +1 (((((( +123456789 +1234 5678 9 ( +12-", "é 😀 +1 (988) 555-2485 😀 x@y.zz 10.0.0.1",
    "5500000000000004 x 5500000000000005 3782-822463-10005", "++1 23456789", "1" * 5000, "a." * 3000 + "@b.c", "a@b" + ".c" * 5000, "", "1 " * 4000, "-".join("12" for _ in range(3000)),
]


def test_pii_edges(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII_EDGES)], "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.report(df).collect()}
    for i, t in enumerate(PII_EDGES):
        assert got[i] == base_pii(t)[0], t[:60]


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_pii(which, request):
    df = request.getfixturevalue(which)
    rows = pii.report(df).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in rows) == Counter((d, *base_pii(t)[0]) for d, t in texts_of(df))
    text = {d: t for d, t in texts_of(df)}
    for r in rows:
        spans = [x for x in r.spans.split(",") if x]
        assert spans[: r.n_email + r.n_ip + r.n_card + r.n_phone] == base_pii(text[r.doc_id])[1]


def test_bootstrap_finds_identifiers_in_known_contexts(spark):
    rows = [(i, f"please reach customer at mailbox u{i}.x@mail.example.com before noon and wait") for i in range(12)]
    rows += [(100, "please reach customer at mailbox jd_4477#corp before noon and wait"), (101, "the part number is zx_9981 and no more")]
    got = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "ctx_email:33:45"
    assert got[101] == ""
    assert all(got[i].startswith("email:33:") for i in range(12))
    red = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert red[100] == "please reach customer at mailbox [EMAIL] before noon and wait" == red[3] and red[101] == rows[-1][1]


def test_redact_keeps_columns(odd_docs, docs):
    out = pii.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert sorted(map(str, out.collect())) == sorted(map(str, odd_docs.collect()))
    assert pii.redact(docs.limit(0)).count() == 0
    clash = docs.withColumns({c: F.lit(7) for c in ("extra", "spans", "_spans", "found", "w_id", "w_hash", "email", "candidates", "text_hash", "kind")})
    for r in pii.redact(clash).collect():
        assert r.extra == r.spans == r._spans == r.found == r.w_id == r.email == 7
        assert r.n_chars == len(r.text) and not EMAIL.search(r.text)


def word_shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()), w


def brute_classes(pairs):
    sets = [(d, word_shingles(t)[0]) for d, t in pairs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = Counter()
    for own in by.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[b], own[a]] += 1
    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a][1]) + len(sets[b][1]) - n):
            parent[root(a)] = root(b)
    least = {}
    for i, (d, s) in enumerate(sets):
        if s and d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return Counter((d, len(s), (least.get(root(i)) if s else d)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_jaccard_classes(which, request):
    df = request.getfixturevalue(which)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes_of(df).collect())
    assert got == brute_classes(texts_of(df))


def test_jaccard_chains_and_crowds(spark):
    """Near copies that link only through others, a crowd sharing a long passage, boundary similarities."""
    import random

    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    rows, at = [], list(base)
    for i in range(12):
        rows.append((i, " ".join(at)))
        at = list(at)
        for _ in range(2):
            at[rnd.randrange(len(at))] = word()
    passage = [word() for _ in range(60)]
    for i in range(12, 60):
        rows.append((i, " ".join(passage + [word() for _ in range(rnd.choice((2, 5, 8, 12, 40)))])))
    rows += [(i, " ".join(base[: 20 + i])) for i in range(60, 90)] + [(90 + i, " ".join(["x"] * i)) for i in range(8)] + [(200, None), (None, " ".join(base)), (5, " ".join(base))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes_of(df).collect())
    assert got == brute_classes([(d, t or "") for d, t in rows])
    kept = jaccard.keep_one(df.withColumns({c: F.lit(1) for c in ("w_id", "w_hash", "g_id", "i", "h", "cell", "text_hash")})).collect()
    want = {c for (d, n, c) in got if n}
    assert Counter(r.doc_id for r in kept if r.text) == Counter(want)
    again = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "A b c d e f"), (2, "a b c d e f"), (None, "q r"), (None, "q r"), (3, ""), (3, "")], "doc_id long, text string")
    assert Counter(r.doc_id for r in jaccard.keep_one(again).collect()) == {1: 1, None: 1, 3: 2}


def test_cells_are_cut_by_pivots_and_blocks(spark):
    """A crowd around one text, partly linked, a chain, and copies: cells far over what a task takes."""
    import random

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    at = [word() for _ in range(100)]
    for i in range(60, 120):
        at = at[1:] + [word()] if i % 2 else at[2:] + [word(), word()]
        rows.append((i, " ".join(at)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes_of(df, leaf_rows=6).collect())
    assert got == brute_classes(rows)


def test_links_in_a_cell():
    import random
    import numpy as np

    rnd = random.Random(9)
    for turn in range(30):
        pool = rnd.sample(range(10**6), 40)
        sets = [np.array(sorted(set(rnd.sample(pool, 30)[: rnd.randrange(1, 31)]) | {rnd.randrange(10**6)}), np.int64) for _ in range(rnd.randrange(1, 60))]
        sets += [np.array(sorted(set(sets[0].tolist()) | {k}), np.int64) for k in range(rnd.randrange(9))]
        got, want = list(range(len(sets))), list(range(len(sets)))

        def join(p, a, b):
            x, y = p[a], p[b]
            p[:] = [min(x, y) if q in (x, y) else q for q in p]

        for a, b in jaccard.cell_links(sets, 80):
            m = len(np.intersect1d(sets[a], sets[b]))
            assert a != b and 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m)
            join(got, a, b)
        for a in range(len(sets)):
            for b in range(a):
                m = len(np.intersect1d(sets[a], sets[b]))
                if 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m):
                    join(want, a, b)
        assert got == want


def test_jaccard_empty(docs):
    assert jaccard.classes_of(docs.limit(0)).count() == 0


def test_components(spark):
    import random

    rnd = random.Random(3)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for a, b in edges if a != b for n in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def weighted(s):
    return {x: sum(map(len, x)) for x in s}


def brute_leaks(docs, items):
    out = {}
    for d, t in docs:
        _, w = word_shingles(t)
        for item, it in items:
            s, iw = word_shingles(it)
            if not iw:
                continue
            best = 0
            for a in range(max(1, len(w) - len(iw) + 1)):
                ws, _ = word_shingles(" ".join(w[a : a + len(iw)]))
                if not ws & s:
                    continue
                shared = sum(weighted(ws & s).values())
                best = max(best, shared / (sum(weighted(ws).values()) + sum(weighted(s).values()) - shared))
            if best >= 0.8:
                out[d, item] = round(best, 9)
    return out


def test_leaks(spark, docs):
    import random

    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()][:40]
    rnd = random.Random(5)
    filler = [w for _, t in texts_of(docs)[:30] for w in t.split()][:4000]
    rows = []
    for i, (_, it) in enumerate(items):
        w = it.split()
        if i % 4 == 1:
            w = w[:-1]
        if i % 4 == 2:
            w[rnd.randrange(len(w))] = "changed"
        if i % 4 == 3:
            w = w[: len(w) // 2]
        k = rnd.randrange(3000)
        rows.append((i, " ".join(filler[k : k + rnd.choice((0, 3, 90))] + w + filler[k + 90 : k + 90 + rnd.choice((0, 5, 60))])))
    rows += [(500, None), (None, items[0][1].upper()), (501, ""), (502, "a b")] + [(600 + i, t) for i, (_, t) in enumerate(texts_of(docs)[:60])]
    extra = items + [(900, "tiny item"), (901, None), (902, "")]
    rows.append((700, f"{filler[0]} tiny ITEM {filler[1]}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(extra, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.find_leaks(df, b).collect()}
    assert got == brute_leaks([(d, t or "") for d, t in rows], [(i, t or "") for i, t in extra])
    assert (700, 900) in got and (None, 0) in got
    clash = df.withColumns({c: F.lit(7) for c in ("l_id", "w_id", "w_hash", "n", "item_id", "text_hash", "start", "b")})
    dropped = decontam.drop_leaks(clash, b).collect()
    assert all(r.l_id == r.w_id == r.n == r.text_hash == 7 for r in dropped)
    left = {r.doc_id for r in dropped}
    assert left == {d for d, _ in rows} - {d for d, _ in got}
    assert decontam.find_leaks(df.limit(0), b).count() == 0 and decontam.find_leaks(df, b.limit(0)).count() == 0


def test_block_join_reaches_the_radius(spark):
    """Fingerprints within the radius agree in a flipped block."""
    import random

    rnd = random.Random(1)
    rows = []
    for i in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        sign = lambda v: v - (1 << 64) if v >> 63 else v
        rows.append((i, sign(a), sign(b)))
    df = spark.createDataFrame(rows, "i long, a long, b long")
    own = df.select("i", F.col("a").alias("simhash")).select("i", F.explode(decontam.own_blocks()).alias("b"))
    near = df.select("i", F.col("b").alias("simhash")).select("i", F.explode(decontam.near_blocks()).alias("b"))
    assert own.join(near, ["i", "b"]).select("i").distinct().count() == 300
