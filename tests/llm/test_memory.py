"""What Python workers remember is bounded, dropped when a task ends, and changes no token."""

from wayveil.llm import packing, tokens

from .conftest import LONG


def test_small_memory_gives_the_same_ids(monkeypatch):
    texts = ["the cat's hat, the hat. THE hat!", "naïve Élan l'été 3d a1 b-2 ,x x, xx,,", "word1 word 2word don't 'tis it's' end\n", "\x1f odd <|endoftext|> \xa0x ½", LONG, ""]
    monkeypatch.setattr(tokens, "MEMORY", 2)
    w = tokens.WordTokens(tokens.tokenizer_path())
    for _ in range(2):
        for t in texts:
            ids = w.tok.encode(t, add_special_tokens=False).ids
            assert w.pack(t) == b"".join(i.to_bytes(4, "little") for i in ids) and w.count(t) == len(ids)
    assert len(w.packed) <= 3 and len(w.packed.old) <= 3


def test_idle_worker_holds_no_chunks(spark):
    """What remains in a worker after a task is the vocabulary alone."""
    def left(_):
        yield sum(len(w.packed) + len(w.packed.old) for w in [tokens.word_tokens(tokens.tokenizer_path())])

    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string")
    packing.pack(docs).count()
    assert set(spark.sparkContext.parallelize(range(8), 8).mapPartitions(left).collect()) == {0}
