"""The pipeline's stages against what a brute-force version would keep."""

import collections

import corpus_pipeline
from codicil.llm import packing, secret_scan
from tests.llm.test_operators import WORD, check_places, counts, links_of, roots_of, shingle_set


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    start = {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality_rules"](spark, docs, small)
    kept = {r.doc_id: r for r in good.collect()}
    assert good.columns == docs.columns and len(kept) > 0.7 * len(start)
    assert all(counts(r.text)[0] >= 20 for r in kept.values())
    once = steps["near_duplicates"](spark, good, small)
    sets = {d: shingle_set(r.text) for d, r in kept.items()}
    root = roots_of(sets, links_of(sets))
    assert sorted(r.doc_id for r in once.collect()) == sorted(set(root.values())) and once.columns == docs.columns
    clean = steps["secret_scan"](spark, once, small)
    assert clean.columns == docs.columns and clean.count() == once.count()
    assert all(not secret_scan.base_spans(r.text) and r.n_chars == len(r.text) for r in clean.collect())
    mixed = steps["source_mix"](spark, clean, small)
    n = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(n.values()) <= 2
    words = lambda d: sum(len(WORD.findall(r.text)) for r in d.collect())
    assert abs(words(mixed) / words(clean) - 1.5) < 0.25
    packed = steps["best_fit_packing"](spark, mixed, small).collect()
    check_places(packed)
    assert sum(r.piece == 0 for r in packed) == mixed.count()


def test_run_and_odd_rows(spark, odd, nothing, small, tmp_path):
    assert corpus_pipeline.run(spark, small).columns[:5] == packing.token_pieces(nothing).columns
    for d in (odd, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            d = stage(spark, d, small)
            assert d.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, d, small).count()
