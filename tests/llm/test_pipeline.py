import re

import pytest

from cloudloom.llm import pii, quality
from tests.llm.test_quality import brute as statistics
from tests.llm.test_nearcopies import brute as classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_do_their_work_one_after_the_other(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_duplicates", "personal_data", "best_fit_packing"]
    seen = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sample)
        docs = docs.checkpoint()
        seen[name] = docs
    texts = {r["doc_id"]: r["text"] for r in seen["input"].collect()}
    good = {r["doc_id"] for r in seen["quality_rules"].collect()}
    assert good < texts.keys() and all(statistics(texts[k])[0] >= quality.MIN_WORDS for k in good)
    ids = sorted(good)
    kept = {r["doc_id"] for r in seen["near_duplicates"].collect()}
    assert kept == {ids[c] for c in classes([texts[k] for k in ids])}
    for name in names[:-1]:
        assert seen[name].dtypes == seen["input"].dtypes
    clean = {r["doc_id"]: r for r in seen["personal_data"].collect()}
    assert clean.keys() == kept
    assert not any(re.search(r"[a-z0-9]@[a-z0-9]+\.", r["text"]) for r in clean.values())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert any("<EMAIL>" in r["text"] or "<PHONE>" in r["text"] or "<CARD>" in r["text"] for r in clean.values())
    packed = seen["best_fit_packing"].collect()
    assert {r["doc_id"] for r in packed} == kept
    assert pii.find(seen["personal_data"]).where("size(base) > 0").count() == 0


def test_run_equals_its_stages(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sample)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sample).collect()))


def test_an_empty_corpus_runs_through(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sample)
    assert docs.collect() == []
