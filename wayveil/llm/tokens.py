"""Token counts by the whole-token shortcut.

A pre-token that is itself a vocabulary string encodes as that one token whenever the merge
rules can rebuild it; :func:`prove_whole_tokens` establishes that for each vocabulary string
once. Counting then needs merges for the remaining pre-tokens only, and those are remembered
by white-space-separated chunk, since no pre-token of this tokenizer spans white space.

Nulls and empty texts have no tokens; null ids are kept; repeated rows are counted each;
texts are processed whole, whatever their length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FILE = "word_bpe_49k.json"
#: Entries that either half of a worker's memory holds. It bounds memory, not results.
MEMORY = 200_000
#: Characters for which the fast path below provably splits and folds as the library does:
#: ASCII, Latin-1 letters and common punctuation. A text with any other goes to the library whole.
_UNUSUAL = re.compile("[^\\t-\\r -~À-ÖØ-öø-ÿŒœ¡«»¿–—‘’“”…]|<\\|")
_USUAL_ASCII = bytes([*range(9, 14), *range(32, 127)])
_PRE_TOKEN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿœ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿœ]+")


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in printable}
    spare = iter(range(0x100, 0x200))
    return [table[b] if b in table else chr(next(spare)) for b in range(256)]


def prove_whole_tokens(path: str) -> dict[str, int]:
    """Byte-level spelling of a pre-token -> id, for each vocabulary string that encodes alone as itself."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    proven = {}
    for entry, number in tok.get_vocab(with_added_tokens=False).items():
        if entry.endswith("</w>"):
            alone = tok.model.tokenize(entry[:-4])
            if len(alone) == 1 and alone[0].id == number:
                proven[entry[:-4]] = number
    return proven


def unusual(text: str) -> bool:
    """Whether ``_UNUSUAL`` finds anything, asked of the few characters that are not plain ASCII."""
    if "<|" in text:
        return True
    left = text.encode().translate(None, _USUAL_ASCII)
    return bool(left) and _UNUSUAL.search(left.decode()) is not None


class _Memory(dict):
    """key -> value, computed on first sight. Of two halves the older goes when the newer is full; what is used moves to the newer."""

    def __init__(self, compute):
        super().__init__()
        self.compute = compute
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokens:
    """Ids and counts of texts, exactly as the library gives them without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.model = self.tok.model
        self.number = {i: i.to_bytes(4, "little") for i in self.tok.get_vocab().values()}
        self.whole = {w: self.number[i] for w, i in prove_whole_tokens(path).items()}
        self.spell = dict(enumerate(byte_alphabet()))
        self.packed = _Memory(self._chunk)

    def _merge(self, pre_token: str) -> bytes:
        spelled = pre_token if pre_token.isascii() else pre_token.encode().decode("latin-1").translate(self.spell)
        known = self.whole.get(spelled)
        return known if known is not None else b"".join([self.number[t.id] for t in self.model.tokenize(spelled)])

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # of the usual characters all letters go together
            return self._merge(chunk)
        if chunk[:-1].isalpha():  # a word, which may be known, and a character that is no letter
            return self.packed[chunk[:-1]] + self._merge(chunk[-1])
        return b"".join([self._merge(p) for p in _PRE_TOKEN.findall(chunk)])

    def forget(self) -> None:
        """Drop what was remembered: an idle worker holds the vocabulary alone."""
        self.packed = _Memory(self._chunk)
        pa.default_memory_pool().release_unused()

    def count(self, text: str) -> int:
        return len(self.pack(text)) // 4

    def pack(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if unusual(text):
            return b"".join([i.to_bytes(4, "little") for i in self.tok.encode(text, add_special_tokens=False).ids])
        return b"".join(map(self.packed.__getitem__, text.lower().split()))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One per worker process."""
    return WordTokens(path)


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str | Column = "doc_id", text_col: str | Column = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit. No shuffle; memory is one Arrow batch."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = word_tokens(path)
        for b in batches:
            sizes = [counter.count(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        counter.forget()

    id_col, text_col = (F.col(c) if isinstance(c, str) else c for c in (id_col, text_col))
    narrow = docs.select(id_col.cast("long").alias("doc_id"), text_col.alias("text"), F.octet_length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
