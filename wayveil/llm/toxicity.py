"""A toxicity classifier regularised by counterfactuals.

A logistic model over a document's distinct words. In each labelled document that names a group,
the term is swapped for every other of its kind and also taken out; into a share of the others
every term of a kind is put. The squared changes of the logit are added to the loss. Swaps alone
would only make all terms of a kind as bad as one of them is; with the term taken out, mentioning
a group moves no score in itself.

Only rows whose CRC-32 of the id is not divisible by five lend their labels, and at most
``TRAIN_ROWS`` of each class: a documented bound for fitting alone. Every document is scored,
whole. Null and empty texts score what the bias gives. Null ids count as held out of training.
With no labels at all every score is 0. Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that fitting uses at most, taken by a hash of their id.
TRAIN_ROWS = 5_000
#: A word counts if so many training documents have it.
MIN_DOCS = 5
#: ... and if its shares in the two classes differ by so many standard errors.
MIN_Z = 4.0
FOLDS = 5
MEMORY = 300_000
#: Group terms by kind; within a kind they are interchangeable. Fixed word list.
IDENTITY = (
    ("woman", "man", "girl", "boy", "women", "men", "mujer", "hombre", "femme", "homme", "frau", "mann"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("american", "mexican", "german", "french", "spanish", "chinese", "indian", "turkish"),
    ("deaf", "blind", "disabled", "autistic", "elderly", "young"),
)
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"


def in_holdout(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def text_words(text: bytes) -> set[bytes]:
    """Distinct words, ASCII letters folded, without punctuation around them."""
    out = {w.strip(_EDGE) for w in set(text.lower().split())}
    out.discard(b"")
    return out


@dataclass
class Model:
    """weights: of words by hash. A document's logit is the bias and its words' weights."""

    bias: float = 0.0
    weights: dict[int, float] = field(default_factory=dict)
    trained: bool = False

    def score(self, text: bytes, memory: dict[bytes, float]) -> float:
        if not self.trained:
            return 0.0
        logit = self.bias
        for w in sorted(text_words(text)):  # in order: sums of doubles must not depend on hashing
            v = memory.get(w)
            if v is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                v = memory[w] = self.weights.get(_key(w), 0.0)
            if v:
                logit += v
        return float(1.0 / (1.0 + np.exp(-np.clip(logit, -60, 60))))


Change = tuple[list[int], list[int], float]  # terms taken out, terms put in, weight


def counterfactuals(keys: np.ndarray, doc: int, insert_every: int) -> list[Change]:
    """What to change in a training document with these sorted word keys; its weights add up to 1.

    For each term it names, half the weight is on taking it out and half on the swaps.
    """
    have = [[t for t in kind if _in(keys, t)] for kind in _IDENTITY_KEYS]
    named = sum(map(len, have))
    if named:
        out: list[Change] = []
        for kind, own in zip(_IDENTITY_KEYS, have):
            for t in own:
                others = [u for u in kind if u != t]
                out.append(([t], [], 0.5 / named))
                # A word counts once, so swapping in what is there already only takes out.
                out += [([t], [u] if u not in own else [], 0.5 / named / len(others)) for u in others]
        return out
    if doc % insert_every:
        return []
    kind = _IDENTITY_KEYS[doc // insert_every % len(_IDENTITY_KEYS)]
    return [([], [t], 1 / len(kind)) for t in kind]


def change_form(changes: list[list[Change]], terms: np.ndarray) -> np.ndarray:
    """The matrix A for which w A w is the mean over documents of the weighted squared changes; w: weights of ``terms`` (sorted)."""
    form = np.zeros((len(terms), len(terms)))
    changed = [c for c in changes if c]
    for own in changed:
        for out, into, weight in own:
            at, sign = np.searchsorted(terms, out + into), np.array([-1.0] * len(out) + [1.0] * len(into))
            form[np.ix_(at, at)] += weight * np.outer(sign, sign)
    return form / max(1, len(changed))


def _in(keys: np.ndarray, k: int) -> bool:
    at = int(np.searchsorted(keys, k))
    return at < len(keys) and int(keys[at]) == k


_IDENTITY_KEYS = tuple(tuple(_key(w.encode()) for w in kind) for kind in IDENTITY)


def fit_arrays(docs: list[np.ndarray], y: np.ndarray, steps: int = 300, l2: float = 3e-4, swap_weight: float = 1.0, insert_every: int = 4) -> Model:
    """Full-batch Adam on logistic loss + L2 + the counterfactual penalty; deterministic."""
    if not len(docs) or len(set(y.tolist())) < 2:
        return Model(trained=bool(len(docs)), bias=-6.0 if len(docs) and not y[0] else 6.0)
    flat = np.concatenate(docs)
    seen, n = np.unique(flat, return_counts=True)
    terms = np.array(sorted({t for kind in _IDENTITY_KEYS for t in kind}), dtype=np.int64)
    in_toxic = np.bincount(np.searchsorted(seen, np.concatenate([d for d, t in zip(docs, y) if t == 1])), minlength=len(seen))
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    p = n / (n1 + n0)
    z = (in_toxic / n1 - (n - in_toxic) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    vocab = np.union1d(seen[(n >= min(MIN_DOCS, max(2, len(docs) // 100))) & (np.abs(z) >= MIN_Z)], terms)
    at = np.minimum(np.searchsorted(vocab, flat), len(vocab) - 1)
    known = vocab[at] == flat
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])[known]
    col = at[known]
    form = change_form([counterfactuals(d, i, insert_every) for i, d in enumerate(docs)], terms)
    at_terms = np.searchsorted(vocab, terms)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(len(vocab)), 0.0
    m, v = np.zeros(len(vocab) + 1), np.zeros(len(vocab) + 1)
    for step in range(1, steps + 1):
        logit = b + np.bincount(row, w[col], len(docs))
        err = share * (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - y)
        grad = np.bincount(col, err[row], len(vocab)) + l2 * w
        grad[at_terms] += 2 * swap_weight * (form @ w[at_terms])
        g = np.append(grad, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - float(move[-1])
    return Model(float(b), {int(k): float(x) for k, x in zip(vocab, w) if abs(x) > 1e-6}, True)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled documents of each class; the driver receives hashes of their words."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~in_holdout(F.col("doc_id"))).dropDuplicates(["doc_id"])
    some = [usable.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows) for c in (0, 1)]
    pool = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(some[0].union(some[1])), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [sorted({_key(w) for w in text_words(t.as_py())}) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "toxic", "keys"])

    # One text for each id, the least of them: a repeated id must not pass the bound.
    pool = pool.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = pool.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, toxic int, keys array<long>").toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["toxic"].to_pylist(), range(got.num_rows)))
    keys = got["keys"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64()))
    return fit_arrays([np.asarray(keys[i].values) for *_, i in rows], np.array([y for _, y, _ in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[bytes, float] = {}
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py(), memory) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    scored = narrow.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", in_holdout(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``labels``, score ``docs``."""
    return score(docs, fit(docs, labels))
