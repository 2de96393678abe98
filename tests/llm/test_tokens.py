import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cloudloom.llm import packing, spm, tokencount

SCHEMA = "doc_id long, text string"
BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in (tokencount.TOKENIZER, packing.TOKENIZER, spm.MODEL))
ODD = [
    None, "", " ", "  ", "\n", "a  b", " a b ", "a \n b", "<|endoftext|>", "x<|endoftext|>y z", "a <|endoftext|> b", "<|startoftext|>q",
    "it's we'll I'M 's", "é à ü ß ÀÉ.", "a b 　 c", "\x1c a\x1c b", "tab\ta b\r\nc", "中文 字 \U0001d518", "12 345 6", "!!! ... ?!", "Å Å", "K K",
    "x" * 5000, "word " * 5000, "a.b c,d e-f", "The THE the", "\x00 a",
]
text_strategy = st.text(st.sampled_from("ab Z.\n\t'é <|>endoftx!1中"), max_size=60)


def library(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark, sample):
    texts = [*ODD, *[r["text"] for r in spark.read.parquet(f"{sample}/documents.parquet").collect()]]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({"id": F.lit("x"), "n_tokens": F.lit(0)})
    want = library(BYTE, texts)
    for r in tokencount.count_tokens(df).collect():
        assert (r["n_tokens"], r["n_bytes"]) == (len(want[r["id"]]), len((texts[r["id"]] or "").encode()))
        assert r["over_limit"] == (r["n_tokens"] > 1024)
    assert tokencount.count_tokens(df.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(text_strategy, max_size=6))
def test_counts_of_any_text(texts):
    assert tokencount.counter(BYTE).counts(texts) == [len(x) for x in library(BYTE, texts)]


def test_safe_parts_join_to_the_text():
    for t in ODD:
        assert "".join(tokencount.safe_parts(t or "")) == (t or "")


def test_batches_are_balanced_by_bytes():
    batches = list(tokencount.balanced(["é" * 10] * 7 + ["x" * 100, "y"], 50))
    assert [len(b) for b in batches] == [2, 2, 2, 1, 1, 1] and sum(batches, []) == ["é" * 10] * 7 + ["x" * 100, "y"]


@settings(max_examples=60, deadline=None)
@given(st.lists(text_strategy, max_size=6))
def test_ids_of_any_text(texts):
    got = packing.Encoder(WORD).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(WORD, texts)


def test_small_tables_of_words_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "MOST_KEPT", 3)
    monkeypatch.setattr(packing, "SLICE_CHARS", 8)
    texts = [t for t in ODD if t is None or len(t) < 100] * 2
    got = packing.Encoder(WORD).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(WORD, texts)


def check_packing(rows, texts, capacity=4096):
    """The contract, piece by piece; the number of sequences."""
    bins, seen = {}, {}
    ids = [[*x, 1] for x in library(WORD, texts)]
    for r in rows:
        own = ids[r["id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, "<u4").tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["id"], []).append((r["piece"], r["start"], r["length"]))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    for k, x in enumerate(ids):
        parts = sorted(seen[k])
        assert [p for p, _, _ in parts] == list(range(len(parts))) and sum(n for *_, n in parts) == len(x)
        assert all(n == capacity for *_, n in parts[:-1]) and [s for _, s, _ in parts] == [capacity * p for p, _, _ in parts]
    return len(bins)


def test_packing_of_documents(spark, sample):
    texts = [*ODD, *[r["text"] for r in spark.read.parquet(f"{sample}/documents.parquet").collect()], "word " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({"length": F.lit("x"), "bucket": F.lit(0), "rank": F.lit(0)})
    n = check_packing(packing.pack(df).collect(), texts)
    total = sum(len(x) + 1 for x in library(WORD, texts))
    assert n <= -(-total // 4096) + 2
    assert packing.pack(df.limit(0)).collect() == []


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], SCHEMA)
    rows = packing.pack(df).collect()
    assert sorted(r["length"] for r in rows) == [1, 3, 3, 3] and {r["sequence_id"] for r in rows} == {rows[0]["sequence_id"]}
    assert sorted((r["offset"], r["length"]) for r in rows) in ([(0, 3), (3, 3), (6, 3), (9, 1)], [(0, 1), (1, 3), (4, 3), (7, 3)])


def fewest(lengths, capacity):
    """The least number of bins, by search; for a few items."""
    best = [len(lengths)]

    def put(k, rooms):
        if len(rooms) >= best[0] and k < len(lengths):
            return
        if k == len(lengths):
            best[0] = min(best[0], len(rooms))
            return
        for r in {*rooms}:
            if r >= lengths[k]:
                rest = rooms[:]
                rest[rest.index(r)] = r - lengths[k]
                put(k + 1, rest)
        put(k + 1, [*rooms, capacity - lengths[k]])

    put(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_a_best_packing(lengths):
    """Dominating bins are fixed without loss: bins fixed and the fewest for the rest make the fewest for all."""
    counts = {n: lengths.count(n) for n in lengths}
    fixed, left = packing.reduce_dominated(counts, 20)
    rest = [n for n, k in left.items() for _ in range(k)]
    taken = [n for pattern, times in fixed for n, k in pattern for _ in range(k * times)]
    assert sorted(taken + rest) == sorted(lengths)
    assert sum(t for _, t in fixed) + (fewest(sorted(rest, reverse=True), 20) if rest else 0) == fewest(sorted(lengths, reverse=True), 20)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_best_fit_with_multiplicities_equals_item_by_item(lengths):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(50 - n)
    groups = packing.best_fit({n: lengths.count(n) for n in lengths}, 50)
    got = sorted(50 - sum(n * k for n, k in pattern) for pattern, times in groups for _ in range(times))
    assert got == sorted(rooms)


def test_pieces_equal_the_library(spark, sample):
    chance = random.Random(2)
    texts = [*ODD, *["".join(chance.choice("ab  the ing\n\té𝔘中▁.,<0x>s/ ") for _ in range(chance.randrange(60))) for _ in range(500)]]
    texts += [r["text"] for r in spark.read.parquet(f"{sample}/documents.parquet").collect()] + [" " * k + "x" + " " * k for k in range(20)]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumns({"ids": F.lit("x"), "id": F.lit("x")})
    encoded = spm.encode(df)
    assert {r["id"]: r["ids"] for r in encoded.collect()} == {k: model.encode(t or "") for k, t in enumerate(texts)}
    assert {r["id"]: r["text"] for r in spm.decode(encoded).collect()} == {k: model.decode(model.encode(t or "")) for k, t in enumerate(texts)}
    for r in spm.summary(df).collect():
        ids = model.encode(texts[r["id"]] or "")
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and r["round_trip"]
    assert spm.encode(df.limit(0)).collect() == []


def test_unigram_pass_finds_the_best_score():
    pieces = spm.pieces_of(PIECE)
    toy = object.__new__(spm.Pieces)
    toy.kind, toy.longest = "unigram", 3
    toy.score = {"a": -1.0, "b": -1.5, "ab": -1.8, "ba": -2.0, "aba": -4.5, "c": -2.0}
    toy.ids = {p: k for k, p in enumerate(toy.score)}
    words = sorted(["abab", "aba", "abc", "cab", "baab"])

    def best(word):
        if not word:
            return 0.0, []
        options = [(toy.score[word[:k]] + best(word[k:])[0], [word[:k], *best(word[k:])[1]]) for k in range(1, 4) if word[:k] in toy.score]
        return max(options)

    for word, got in zip(words, toy.segment(words), strict=True):
        assert abs(sum(toy.score[p] for p in got) - best(word)[0]) < 1e-9
    assert pieces.merged("▁the") == ["▁the"]


def message(*fields):
    """A protocol-buffer message of (number, value): int, float or bytes."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number * 8) + varint(value)
        elif isinstance(value, float):
            out += varint(number * 8 + 5) + struct.pack("<f", value)
        else:
            out += varint(number * 8 + 2) + varint(len(value)) + value
    return out


def unigram_file(tmp_path, normalizer=((1, b"identity"), (3, 1), (4, 0), (5, 1)), kind=1):
    """A model file of a few pieces with scores written by hand."""
    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "c": -4.25, "ab": -4.0, "ba": -5.5, "aba": -7.75, "▁a": -4.1, "▁ab": -5.2, "bc": -5.0, "cab": -8.1}
    pieces = [((1, b"<unk>"), (2, 0.0), (3, 2)), *[((1, p.encode()), (2, s)) for p, s in scores.items()]]
    path = tmp_path / "hand.model"
    trainer = ((3, kind), (40, 0), (41, (1 << 64) - 1), (42, (1 << 64) - 1), (43, (1 << 64) - 1))
    path.write_bytes(message(*[(1, message(*p)) for p in pieces], (2, message(*trainer)), (3, message(*normalizer))))
    return str(path)


def test_viterbi_of_a_unigram_file_equals_the_library(spark, tmp_path):
    path = unigram_file(tmp_path)
    chance = random.Random(6)
    texts = [None, "", " ", *["".join(chance.choice("aabbcc ") for _ in range(chance.randint(1, 30))) for _ in range(400)]]
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    encoded = spm.encode(df, path)
    score = lambda ids: round(sum(model.get_score(i) for i in ids), 3)
    for r in encoded.collect():
        want = model.encode(texts[r["id"]] or "")
        assert r["ids"] == want or score(r["ids"]) == score(want), texts[r["id"]]
    assert {r["id"]: r["text"] for r in spm.decode(encoded, path).collect()} == {k: t or "" for k, t in enumerate(texts)}
    assert spm.kind_of(path) == "unigram" and spm.kind_of(PIECE) == "bpe"


def test_models_that_change_texts_are_refused(tmp_path):
    import pytest

    for normalizer, kind in ((((1, b"nmt_nfkc"), (2, b"xx"), (4, 0)), 1), (((3, 1), (4, 1)), 2), (((3, 0), (4, 0)), 2), (((3, 1), (4, 0)), 4)):
        with pytest.raises(ValueError):
            spm.Pieces(unigram_file(tmp_path, normalizer, kind))


def test_repeated_rows_and_null_ids_of_counts_and_pieces(spark):
    df = spark.createDataFrame([(1, "some words"), (1, "some words"), (None, "more"), (None, None)], SCHEMA)
    assert sorted(r["n_tokens"] for r in tokencount.count_tokens(df).collect()) == sorted(len(x) for x in library(BYTE, ["some words", "some words", "more", ""]))
    got = sorted((str(r["id"]), len(r["ids"])) for r in spm.encode(df).collect())
    assert [k for k, _ in got] == ["1", "1", "None", "None"] and got[0] == got[1] and got[2][1] == 0


def test_ids_of_all_short_strings_of_latin_1():
    chance = random.Random(9)
    alphabet = [chr(k) for k in range(256)] + ["<|endoftext|>", "<|startoftext|>", "'ll", " "] * 8 + list(" .,!?") * 6
    texts = ["".join(chance.choice(alphabet) for _ in range(chance.randint(1, 9))) for _ in range(20_000)]
    texts += ["".join(chance.choice("ab \x1c\x1d\x1e\x1f\x85\xa0.,;:!?") for _ in range(chance.randint(1, 7))) for _ in range(20_000)]
    got = packing.Encoder(WORD).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(WORD, texts)


def test_control_characters_before_a_mark_give_the_library_ids():
    texts = [f"x{c}{mark} y" for c in "\x1c\x1d\x1e\x1f\x85\xa0" for mark in packing.MARKS]
    got = packing.Encoder(WORD).encode(texts)
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == library(WORD, texts)


class Counted:
    """A tokenizer that counts the strings and the characters it is given."""

    def __init__(self, encoder):
        self.encoder, self.strings, self.chars = encoder, 0, 0

    def encode_batch_fast(self, texts, **options):
        self.strings, self.chars = self.strings + len(texts), self.chars + sum(map(len, texts))
        return self.encoder.encode_batch_fast(texts, **options)


def test_the_library_gets_distinct_parts_in_few_strings():
    chance = random.Random(4)
    names = ["".join(chance.choice("abcdeéü") for _ in range(9)) for _ in range(5_000)]
    texts = [" ".join(f"{w}, {w.upper()}! ({w}) {k}{w} {w}-{k} {w}&&" for w in names[k::50]) for k in range(50)]
    encoder = packing.Encoder(WORD)
    encoder.encoder = counted = Counted(encoder.encoder)
    got = encoder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library(WORD, texts)
    assert counted.strings <= 5 and counted.chars <= 12 * len(names)


def test_apostrophes_slices_and_long_texts_give_the_library_ids(monkeypatch):
    chance = random.Random(8)
    texts = ["".join(chance.choice(["'", "s", "LL", "d", "é", "1", "²", "ª", "µ", " ", "\xa0", ".", "<", "|", "中", "’"]) for _ in range(chance.randint(0, 12))) for _ in range(20_000)]
    texts += ["'", "''s", "'S's's", "don't", "1's", ".'s", " 'safe ", "we'LL'll", "x" * 300 + " y", " " * 50 + "z" * 90 + " ", *ODD, "a '<|endoftext|>'s"]
    want = library(WORD, texts)
    for most in (packing.SLICE_PLAIN, 40):
        monkeypatch.setattr(packing, "SLICE_PLAIN", most)
        encoder = packing.Encoder(WORD)
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    encoder = packing.Encoder(WORD)
    encoder.last = None  # as for a tokenizer whose tokens don't tell where a part ends
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want and encoder.encode([]) == []
