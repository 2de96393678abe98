import random

import pytest

import corpus_pipeline
from cloudloom.llm import nearcopies

SCHEMA = "doc_id long, text string"


def shingles(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or {" ".join(words)}


def brute(texts):
    """The least index of each text's component under Jaccard 0.8."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 5 * common >= 4 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def variants(groups, copies, seed=3):
    chance = random.Random(seed)
    words = [f"Word{k}" for k in range(400)]
    texts = []
    for _ in range(groups):
        base = [chance.choice(words) for _ in range(chance.randint(20, 200))]
        texts.append(" ".join(base))
        for _ in range(copies):
            near = base[:]
            for _ in range(chance.randint(1, 1 + len(base) // 30)):
                near[chance.randrange(len(near))] = chance.choice(words)
            texts.append("\n ".join(near))
    return [*texts, None, "", " \n", "one", "ONE", "one two", texts[0].upper()]


@pytest.mark.parametrize("cell", [1024, 8])
def test_the_pipeline_keeps_one_of_each_jaccard_class(spark, monkeypatch, cell):
    monkeypatch.setattr(nearcopies, "CELL", cell)  # small cells: groups of many cells
    monkeypatch.setattr(nearcopies, "PIVOTS", min(cell, 32) // 8)
    texts = variants(10, 40)
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {*brute(texts)}
    assert len(kept) < len(texts)


def test_near_copies_of_the_sample_are_caught(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sample).collect()}
    assert kept == {rows[c][0] for c in brute([t for _, t in rows])}
