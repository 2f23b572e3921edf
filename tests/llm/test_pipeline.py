import random

import pytest

from quern.llm import decontaminate, jaccard, pii
from tests.llm.helpers import awkward, edge_rows, words
from tests.llm.test_duplicate_operators import brute_components
from tests.llm.test_text_operators import brute_hits, check_packed

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, sf_dir).cache()
        if name == "packing":
            check_packed(out.collect(), before)
            continue
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "ngram_jaccard_join":
            assert set(after) == {i for i, (_, c) in brute_components(before, 5, 80).items() if i == c}
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            assert set(after) == {i for i, _, hit, _ in brute_hits(before, items) if not hit}
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
            good = [i for i, _ in before if labels.get(i) == 1]
            assert sum(i in after for i in good) >= 0.98 * len(good)
        if name == "pii":
            assert set(after) == {i for i, _ in before} and not any(pii.base_spans(t or "") for t in after.values())
        docs = out
    assert corpus_pipeline.run(spark, sf_dir).count() == out.count()


def test_stages_stand_awkward_rows(spark, sf_dir):
    docs = awkward(spark, edge_rows())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
        assert name == "packing" or out.columns == docs.columns
        out.collect()
    assert decontaminate and jaccard


def test_one_short_benchmark_item_drops_nothing(spark, tmp_path):
    eight = "the quick brown fox jumps over the lazy"
    spark.createDataFrame([(1, "so it is"), (2, "of course"), (3, f"{eight} dog")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = awkward(spark, [(1, "well so it is then", "en"), (2, "so it is, of course", "en"), (3, f"x {eight} y", "en"), (4, "a clean text", "en")])
    kept = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 4}


def test_other_texts_of_a_repeated_id_stay(spark):
    rng = random.Random(15)
    one, two, three = (words(60, rng, 10**6) for _ in range(3))
    docs = awkward(spark, [(1, one, "en"), (2, two, "en"), (2, three, "en"), (2, three, "de"), (3, one, "en"), (4, three, "en"), (None, one, "en")])
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, one), (2, two), (2, three), (None, one)], key=str)
