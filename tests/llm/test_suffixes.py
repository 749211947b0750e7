"""Repeated passages against windows in plain Python."""

import random
from collections import Counter, defaultdict
from itertools import groupby

import pytest

from wayveil.llm import suffixes

from .test_per_row import texts_of


def stretches(pairs, k=50):
    """(id, start, words) of maximal stretches whose every k-word window stands in another row too."""
    words = [t.encode().lower().split() for _, t in pairs]
    by = defaultdict(set)
    for i, w in enumerate(words):
        for a in range(len(w) - k + 1):
            by[tuple(w[a : a + k])].add(i)
    out = Counter()
    for i, w in enumerate(words):
        flags = [len(by[tuple(w[a : a + k])]) > 1 for a in range(len(w) - k + 1)]
        for own, run in groupby(range(len(flags)), lambda a: flags[a]):
            if own:
                run = list(run)
                out[pairs[i][0], run[0], len(run) + k - 1] += 1
    return out


def check(pairs, rows):
    words = defaultdict(list)
    for d, t in pairs:
        words[d].append(t.encode().lower().split())
    for r in rows:
        assert r.match_words >= 50 and r.start <= r.match_start and r.match_start + r.match_words <= r.start + r.n_words
        here = [w[r.match_start : r.match_start + r.match_words] for w in words[r.doc_id]]
        there = [w[r.other_start : r.other_start + r.match_words] for w in words[r.other_doc_id]]
        assert any(len(h) == r.match_words and h in there for h in here)
    assert Counter((r.doc_id, r.start, r.n_words) for r in rows) == stretches(pairs)


@pytest.mark.parametrize("which", ["docs", "odd_docs"])
def test_repeated_passages(which, request):
    df = request.getfixturevalue(which)
    pairs = texts_of(df)
    rows = suffixes.repeated_passages(df).collect()
    check(pairs, rows)


def test_crowds_and_tails(spark):
    """A passage in many texts, its tail alone in others, passages in passages, overlaps within a text."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    p, q, r = some(55), some(120), some(50)
    rows = [(i, some(rnd.randrange(40)) + p + some(rnd.randrange(40))) for i in range(40)]
    rows += [(40 + i, some(9) + p[-30:] + some(9)) for i in range(10)]
    rows += [(60, q), (61, some(3) + q[10:80] + some(4)), (62, some(8) + q[60:] + q[:60]), (63, r + ["x"] + r), (64, some(5) + r), (65, r[1:] + some(60)), (66, ["same"] * 200), (67, ["same"] * 70 + some(4)), (68, q)]
    rows = [(i, " ".join(w)) for i, w in rows]
    check(rows, suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_crowds_that_share_either_end_of_a_passage(spark):
    """Two texts share a whole passage; around them stand a hundred with its first words and a hundred with its last."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(5))
    some = lambda n: [word() for _ in range(n)]
    rows = []
    for k, (n, head, tail) in enumerate(((60, 50, 11), (56, 47, 10), (52, 50, 2), (50, 49, 1), (53, 40, 20))):
        p = some(n)
        rows += [(1000 * k + i, some(rnd.randrange(30)) + p + some(rnd.randrange(30))) for i in range(2)]
        rows += [(1000 * k + 10 + i, some(rnd.randrange(30)) + p[:head] + some(20)) for i in range(100)]
        rows += [(1000 * k + 200 + i, some(rnd.randrange(30)) + p[tail:] + some(20)) for i in range(100)]
    rows = [(i, " ".join(w)) for i, w in rows]
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, found)
    assert {1000 * k + i for k in range(5) for i in range(2)} <= {r.doc_id for r in found}


def test_nothing(docs, spark):
    assert suffixes.repeated_passages(docs.limit(0)).count() == 0
    assert suffixes.repeated_passages(spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")).count() == 0
