"""The pipeline against plain Python, stage by stage."""

from collections import Counter

import corpus_pipeline
from wayveil.llm import quality

from .conftest import SMALL
from .test_documents import base_pii, brute_classes, brute_leaks
from .test_per_row import base_quality, texts_of


def test_stages(spark, docs, labels):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    steps = {n: f for n, f in corpus_pipeline.STAGES}
    clean = steps["quality_rules"](spark, docs, SMALL)
    assert clean.columns == docs.columns
    judged = {r.doc_id for r in quality.rules(docs, labels).collect() if r.kept}
    kept = texts_of(clean)
    assert {d for d, _ in kept} == judged and not any(base_quality(t)[-1] for _, t in kept)

    one = steps["ngram_jaccard_join"](spark, clean, SMALL)
    least = {c for (d, n, c) in brute_classes(kept)}
    kept = texts_of(one)
    assert one.columns == docs.columns and sorted(d for d, _ in kept) == sorted(least)

    unleaked = steps["benchmark_decontamination"](spark, one, SMALL)
    items = [(r.item_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    leaks = {d for d, _ in brute_leaks(kept, items)}
    kept = [(d, t) for d, t in kept if d not in leaks]
    assert unleaked.columns == docs.columns and sorted(texts_of(unleaked)) == sorted(kept)

    redacted = steps["pii"](spark, unleaked, SMALL)
    assert redacted.columns == docs.columns
    out = texts_of(redacted)
    assert {d for d, _ in out} == {d for d, _ in kept}
    before = dict(kept)
    assert all((t == before[d]) == (not base_pii(before[d])[1]) for d, t in out)
    packed = steps["best_fit_packing"](spark, redacted, SMALL).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in out}
    assert Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SMALL).collect()) == Counter((r.doc_id, r.piece) for r in packed)
