"""SentencePiece encoding and decoding by a forward pass over the trie of distinct marked words.

Marked words are runs of the space mark with what follows them; no piece of the models taken here
crosses into the next one. Distinct words are sorted, which is a depth-first walk of their trie, and
the forward table is kept up to the prefix that a word shares with the one before it.

For a unigram model the table holds the best score of each prefix (Viterbi). A BPE model has no such
scores: its merges are greedy, and a sum of scores picks other pieces than the library does. There the
table holds the last piece of each prefix's encoding, which is the only candidate that forms a valid
pair with the last piece before it; a pair is valid if merging its joined text gives the pair again.
That makes the pass exact for both kinds of model.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from cloudloom.llm.shared import map_batches, renamed

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words and pairs that a worker keeps; beyond it the tables start anew.
MOST_WORDS, MOST_PAIRS = 1_000_000, 2_000_000
#: Stands where a text may be cut besides before space marks; a text that holds it already isn't cut there.
_CUT = "\0"
_WORDS = re.compile(f"{MARK}*[^{MARK}{_CUT}]+|{MARK}+")
_SOLID, _STOPS = "A-Za-z0-9À-ÖØ-öø-ÿ", ".,;:!?"
#: A stop that doesn't follow a letter or digit.
_RUN = re.compile(f"[^{_SOLID}][{_STOPS}]")
#: Characters of text whose words are looked up together.
SLICE_CHARS = 8 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire) or varint()
        yield number, data[at : at + size]
        at += size


# Field numbers and defaults of the public model format.
_TRAINER, _NORMALIZER, _MODEL_TYPE, _CHARSMAP, _DUMMY_PREFIX, _REMOVE_SPACES, _ESCAPE_SPACES = 2, 3, 3, 2, 3, 4, 5
_KINDS = {1: "unigram", 2: "bpe"}


def kind_of(path: str) -> str:
    """The kind of a model file, by its own statement. Models that change a text before they cut it are refused."""
    with open(path, "rb") as f:
        parts = dict(_fields(f.read()))  # of repeated fields the last; these two stand once
    kind = dict(_fields(parts.get(_TRAINER, b""))).get(_MODEL_TYPE, 1)
    normalizer = dict(_fields(parts.get(_NORMALIZER, b"")))
    if kind not in _KINDS:
        raise ValueError("a model that is neither unigram nor BPE")
    if normalizer.get(_CHARSMAP) or normalizer.get(_REMOVE_SPACES, 1) or not normalizer.get(_DUMMY_PREFIX, 1) or not normalizer.get(_ESCAPE_SPACES, 1):
        raise ValueError("a model with a normalizer: texts would be changed before they are cut")
    return _KINDS[kind]


class Pieces:
    """The vocabulary of a model file, with the forward pass over sorted words."""

    def __init__(self, path: str) -> None:
        kind = kind_of(path)
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.kind, self.unknown = kind, model.unk_id()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.score = {self.text[i]: model.get_score(i) for i in range(n) if i not in special}
        self.ids = {self.text[i]: i for i in range(n) if i not in special}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a model whose pieces cross words")
        # where no piece has a stop after a letter or digit, no merge crosses that place
        self.stops = [c for c in _STOPS if not any(re.search(f"[{_SOLID}]{re.escape(c)}", p) for p in self.ids)]
        self.alone = [c for c in "\n" if not any(c in p for p in self.ids)]
        self.valid: dict[tuple[str, str], bool] = {}
        self.known: dict[str, bytes] = {}
        self.plain = [self.text[i].replace(MARK, " ") if i not in special else None for i in range(n)]

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best-scored pair first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b), -k) for k, (a, b) in enumerate(pairwise(parts)) if a + b in self.score), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def pairs(self, left: str, right: str) -> bool:
        """Whether `left` and then `right` stay as they are when their text is merged; left may be empty."""
        known = self.valid.get((left, right))
        if known is None:
            if len(self.valid) > MOST_PAIRS:
                self.valid.clear()
            known = self.valid[left, right] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def segment(self, words: list[str]) -> Iterator[list[str]]:
        """The pieces of each of some sorted words, in turn."""
        before = ""
        last = [""]  # of each prefix: the last piece of its encoding
        total = [0.0]
        for word in words:
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], total[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                piece, score = self._step(word, end, last, total)
                last.append(piece)
                total.append(score)
            before, out, end = word, [], len(word)
            while end:
                out.append(last[end])
                end -= len(last[end])
            yield out[::-1]

    def _step(self, word: str, end: int, last: list[str], total: list[float]) -> tuple[str, float]:
        """The last piece of the encoding of word[:end], with the Viterbi score for a unigram model."""
        fits = [p for start in range(max(0, end - self.longest), end) if (p := word[start:end]) in self.ids]
        if not fits or len(fits[-1]) > 1:
            fits.append(word[end - 1])  # a character that is no piece stands alone
        if self.kind == "unigram":
            worst = min(self.score.values()) - 10.0
            scored = ((total[end - len(p)] + self.score.get(p, worst), len(p), p) for p in fits)
            score, _, piece = max(scored)
            return piece, score
        for piece in fits:
            if self.pairs(last[end - len(piece)], piece):
                return piece, 0.0
        raise ValueError(f"no piece ends {word[:end]!r}")

    def numbers(self, pieces: list[str]) -> list[int]:
        """Ids of pieces; a character that is no piece gives its bytes, or the unknown id without byte pieces."""
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode()]
            else:
                out.append(self.unknown)
        return out

    def words(self, text: str) -> list[str]:
        """The marked words of a text: pieces never cross from one into the next."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if _CUT in marked:
            return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        if not _RUN.search(marked):
            for stop in self.stops:
                for after in (MARK, *self.alone):
                    marked = marked.replace(stop + after, _CUT + stop + after)
        for c in self.alone:
            marked = marked.replace(c, _CUT + c + _CUT)
        return _WORDS.findall(marked)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of whole texts; a null text counts as empty and has none."""
        out: list[np.ndarray] = []
        split: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            split.append(self.words(text or ""))
            size += len(text or "")
            if size >= SLICE_CHARS or k == len(texts) - 1:
                if len(self.known) > MOST_WORDS:
                    self.known.clear()
                distinct = set().union(*split)
                new = sorted(distinct - self.known.keys())
                for word, pieces in zip(new, self.segment(new), strict=True):
                    self.known[word] = array("I", self.numbers(pieces)).tobytes()
                own = {w: self.known[w] for w in distinct}  # small enough for the processor's caches
                out += [np.frombuffer(b"".join(map(own.__getitem__, words)), dtype="<u4") for words in split]
                split, size = [], 0
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, its first space mark taken off; bytes that aren't UTF-8 become replacement characters."""
        parts = [self.plain[i] for i in ids.tolist()]
        if None in parts:
            joined: list[bytes] = []
            for i, p in zip(ids.tolist(), parts, strict=True):
                joined.append(bytes([self.byte_of[i]]) if i in self.byte_of else (p or "").encode())
            text = b"".join(joined).decode(errors="replace")
        else:
            text = "".join(parts)
        return text[1:] if text.startswith(" ") else text


_loaded: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """The model's Pieces, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) for each row: the model's ids of the whole text.

    A null or empty text has no ids. Texts are encoded whole; a very long one is a row of its own in memory.
    Repeated rows and null ids each come back, equal texts with equal ids; an empty table gives an empty
    result; other columns are not read. path: a sentencepiece model file, unigram or BPE by its own
    statement, without a normalizer; of two unigram segmentations with one score the one whose last piece
    is longer is taken.
    """
    path = path or public_tokenizers.path(MODEL)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = pieces_of(path).encode(batch.column(1).to_pylist())
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(flat))], ["id", "ids"])

    rows = renamed(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    return map_batches(rows, per_batch, "id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) for each row (id, ids); null ids give an empty text."""
    path = path or public_tokenizers.path(MODEL)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        model = pieces_of(path)
        texts = [model.decode(np.array(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], ["id", "text"])

    return map_batches(encoded.select("id", "ids"), per_batch, "id long, text string")


def summary(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_crc32, decoded_crc32, round_trip) for each row: encoded, decoded again and compared.

    Checksums are of the ids as little-endian unsigned 32-bit numbers and of the decoded text in UTF-8.
    round_trip: whether decoding gives the text again, the space mark counting as a space.
    """
    path = path or public_tokenizers.path(MODEL)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, rows = pieces_of(path), []
        texts = batch.column(1).to_pylist()
        for text, ids in zip(texts, model.encode(texts), strict=True):
            decoded = model.decode(ids)
            rows.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(decoded.encode()), decoded == (text or "").replace(MARK, " ")))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        columns = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip"])

    rows = renamed(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    return map_batches(rows, per_batch, "id long, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
