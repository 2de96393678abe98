import random

import pytest
import xxhash
from pyspark.sql import functions as F

from cloudloom.llm import simhash

SCHEMA = "doc_id long, text string"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)


def plain_fingerprint(text):
    """The contract's fingerprint, one bit at a time."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius=2):
    """Brute force: components of all pairs within the radius."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def variants():
    chance = random.Random(1)
    words = [f"w{k}é" if k % 9 == 0 else f"Word{k}" for k in range(300)]
    texts = []
    for _ in range(12):
        base = [chance.choice(words) for _ in range(chance.randint(2, 250))]
        texts.append(" ".join(base))
        for _ in range(5):
            near = base[:]
            near[chance.randrange(len(near))] = "changed"
            texts.append("\n ".join(near))
    return [*texts, None, "", " \n\t", "one", "one two", "ONE", texts[0], texts[0].upper(), "a b c " * 5000]


def test_fingerprints_equal_the_plain_ones():
    for text in variants():
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_classes_equal_brute_force(spark):
    texts = variants()
    got = simhash.near_duplicates(docs(spark, texts)).collect()
    want = classes([plain_fingerprint(t) for t in texts])
    assert {r["id"]: r["component"] for r in got} == dict(enumerate(want))
    assert len({*want}) < len(texts)


@pytest.mark.parametrize("seed", range(3))
def test_links_of_clustered_fingerprints_lose_nothing(spark, seed):
    chance = random.Random(seed)
    centres = [chance.getrandbits(64) for _ in range(5)]
    values = {0, (1 << 64) - 1, 1 << 63, 3, 7, 15}
    for c in centres:
        for _ in range(60):
            values.add(c ^ sum(1 << b for b in chance.sample(range(64), chance.randint(0, 4))))
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    stars = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = [stars.get(v, v) for v in signed]
    want = classes(values)
    assert len({*zip(got, want)}) == len({*got}) == len({*want})


def test_tree_search_equals_a_scan():
    chance = random.Random(4)
    values = list({chance.getrandbits(12) for _ in range(400)})
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    for q in chance.sample(range(4096), 60):
        assert sorted(values[k] for k in tree.within(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


def test_odd_tables(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []
    df = spark.createDataFrame([(5, "same text here now"), (5, "same text here now"), (None, "same text here now"), (None, "another thing is this")], SCHEMA)
    df = df.withColumns({"fp": F.lit("x"), "id": F.lit("y"), "component": F.lit(1)})
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r["id"]), r["component"]) for r in got if r["component"]) == [("5", 5), ("5", 5), ("None", 5)] and len(got) == 4
    kept = simhash.deduplicate(df).collect()
    assert sorted(map(str, (r["doc_id"] for r in kept))) == ["5", "None"] and kept[0]["component"] == 1 and kept[0]["id"] == "y"


def test_one_document_of_each_class_stays(spark):
    texts = variants()
    kept = {r["doc_id"] for r in simhash.deduplicate(docs(spark, texts)).collect()}
    assert kept == {*classes([plain_fingerprint(t) for t in texts])}


def test_a_long_chain_is_one_class(spark):
    chain = [(1 << k) - 1 for k in range(0, 63, 2)]
    stars = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in chain], "fp long")))
    assert stars.count() == len(chain) - 1 and stars.select("root").distinct().count() == 1
