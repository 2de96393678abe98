import hashlib
import io
import tarfile
import zlib

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import media, shared

SCHEMA = "doc_id long, text string"
TEXTS = [None, "", "a", "a", "a\0", "x" * 63, "x" * 64, "x" * 65, "é" * 32, "𝔘 text " * 30_000, "a"]


def rows(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({"digest": F.lit(1), "shard": F.lit("s"), "id": F.lit(2)})


def test_payloads_come_back_whole(spark):
    got = {r["id"]: r for r in media.media_columns(rows(spark)).collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64) if data else bytes(64)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["digest"] == hashlib.sha256(media.to_png(payload)).digest() and r["media_bytes"] == len(media.to_png(payload))
        assert r["feature"] == media.feature(payload)
    values = lambda k: [got[k][c] for c in ("digest", "feature", "shard", "offset", "length")]
    assert values(2)[:2] == values(3)[:2] == values(10)[:2] and values(0)[:2] == values(1)[:2]


def test_shards_are_tar_files_with_members_named_by_digest(spark):
    stored = media.store(media.keyed(rows(spark).coalesce(1)))
    found = media.members(stored).collect()
    assert len(found) == len({t or "" for t in TEXTS})
    files, at = pafs.FileSystem.from_uri(found[0]["shard"])
    with files.open_input_file(at) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
        names = {m.name: (m.offset_data, m.size) for m in tar.getmembers()}
    assert {(f"{bytes(r['digest']).hex()}.png", r["length"]) for r in found} == {(n, size) for n, (_, size) in names.items()}
    assert all(names[f"{bytes(r['digest']).hex()}.png"][1] == r["length"] for r in found)


def test_equal_texts_are_stored_once_whatever_the_tasks(spark):
    df = rows(spark, ["same text"] * 200 + [f"other {k}" for k in range(20)]).repartition(7)
    stored = media.store(media.keyed(df))
    assert stored.where("writes").count() == 21 and media.members(stored).count() == 21
    got = media.media_columns(df).collect()
    assert len(got) == 220 and len({(r["shard"], r["offset"]) for r in got if r["id"] < 200}) == 1


@pytest.mark.parametrize("few", [0, 500_000])
def test_a_frequent_text_is_salted_and_loses_no_row(spark, monkeypatch, few):
    monkeypatch.setattr(media, "ROWS_A_SALT", 10)
    monkeypatch.setattr(media, "joined_to_few", lambda a, b, key: shared.joined_to_few(a, b, key, few))
    got = media.media_columns(rows(spark, ["same text"] * 95 + [None, "", "x"]).repartition(5)).collect()
    assert sorted(r["id"] for r in got) == list(range(98))
    assert {r["payload_sha256"] for r in got if r["id"] < 95} == {hashlib.sha256(media.padded(b"same text")).hexdigest()}


def test_metadata_reads_headers_only(spark):
    found = media.members(media.store(media.keyed(rows(spark))))
    by = {bytes(r["digest"]): r for r in media.metadata(found).join(found.drop("length"), "key").collect()}
    for t in TEXTS:
        member = media.to_png(media.padded((t or "").encode()))
        r = by[hashlib.sha256(member).digest()]
        assert r["width"] == 64 and r["width"] * r["height"] == r["payload_bytes"] == len(media.from_png(member)) and r["media_bytes"] == len(member)


def test_small_shards_roll_over(spark, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 1500)
    out = media.media_columns(rows(spark, [f"text number {k % 7}" for k in range(40)]).coalesce(1))
    got = out.collect()
    assert len(got) == 40 and len({r["feature"] for r in got}) <= 7
    for r in got:
        assert r["payload_sha256"] == hashlib.sha256(media.padded(f"text number {r['id'] % 7}".encode())).hexdigest()


def test_damage_is_seen():
    member = media.to_png(media.padded(b"some text"))
    assert media.from_png(member) == media.padded(b"some text")
    for k in (3, 18, 30, len(member) - 20):
        with pytest.raises(Exception):
            media.from_png(member[:k] + bytes([member[k] ^ 1]) + member[k + 1 :])


def test_odd_tables(spark):
    assert media.media_columns(rows(spark, [])).collect() == []
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], SCHEMA)
    assert sorted(str(r["id"]) for r in media.media_columns(df).collect()) == ["1", "1", "None"]
