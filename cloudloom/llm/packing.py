"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the whole instance is a histogram of at most `capacity`
counts, whatever the number of documents. The driver reduces it and packs the rest best fit, both with
multiplicities: a plan is a list of patterns, each with the number of bins that repeat it. Pieces then
take their places by their rank among pieces of equal length. Ranks are worked out in hash buckets, whose
number grows with the most frequent length, so that length fills no single task.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from cloudloom.llm.shared import map_batches, materialize, renamed
from cloudloom.llm.tokencount import tokenizer

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Pieces of one length in a bucket, on average: what a task ranks at a time.
BUCKET_PIECES = 200_000
#: Words that a worker keeps; beyond them its table starts anew.
MOST_KEPT = 1_000_000
#: Words that the library encodes at a time.
BATCH_WORDS = 20_000
#: Bytes of text whose words are looked up together, and of Latin-1 text whose parts are.
SLICE_CHARS, SLICE_PLAIN = 2 << 20, 4 << 20
#: Common marks at the ends of words; the tests put odd characters before them.
MARKS = ".,;:!?"
#: What the tokenizer's pattern tells apart in Latin-1. U+001C to U+001F are white space to Python's \s, but not to the tokenizer.
LETTER, NUMBER, WHITE, OTHER = range(4)
_WHITES = b"\t\n\x0b\x0c\r \x85\xa0"
_KINDS = bytes(WHITE if k in _WHITES else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(k))[0], OTHER) for k in range(256))
_LOWER = bytes(ord(chr(k).lower()) for k in range(256))

Pattern = tuple[tuple[int, int], ...]  # (length, how many) in the order of their places


def plain(text: str) -> bytes | None:
    """The text in Latin-1, if it is Latin-1 and holds no special token; else None."""
    try:
        return None if "<|" in text else text.encode("latin-1")
    except UnicodeEncodeError:
        return None


def chunks(text: bytes, most: int) -> Iterator[bytes]:
    """The text cut at spaces into chunks of at most `most` bytes, or of one longer word."""
    while len(text) > most and (at := text.rfind(b" ", 0, most) + 1 or text.find(b" ", most) + 1):
        yield text[:at]
        text = text[at:]
    yield text


def slices(texts: Iterable[tuple[int, bytes]], most: int) -> Iterator[list[tuple[int, bytes]]]:
    """Numbered texts in lists of about `most` bytes."""
    some: list[tuple[int, bytes]] = []
    size = 0
    for k, text in texts:
        some.append((k, text))
        size += len(text)
        if size >= most:
            yield some
            some, size = [], 0
    if some:
        yield some


def parts_of(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """(parts in lower case, where each starts): what the tokenizer takes one by one from Latin-1 text between white space.

    Its pattern takes runs of letters, single numbers and runs of others, and begins anew wherever the
    kind changes. Only an apostrophe that begins a part can take letters along ('s, 'll): it stays with
    the letters after it, which the library then parts. The text has white space at both ends.
    """
    kind = np.frombuffer(text.translate(_KINDS), np.uint8)
    cut = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)  # between a byte and the next
    if b"'" in text:
        at = np.flatnonzero(np.frombuffer(text, np.uint8) == ord("'"))
        cut[at[(kind[at - 1] != OTHER) & (kind[at + 1] == LETTER)]] = False
    at = np.flatnonzero(cut).astype(np.int32) + 1
    starts, ends = at[kind[at] != WHITE], at[kind[at - 1] != WHITE]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    kept = text.translate(_LOWER, _WHITES)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), starts


class Encoder:
    """Token ids of whole texts as little-endian bytes, by distinct words.

    The tokenizer drops white space and no token crosses it, so the ids of the words in turn are the
    ids of the text. All ids come from the library; those of distinct words are kept in a bounded table
    per worker. The words of Latin-1 texts are the tokenizer's own parts, found and put together in whole
    columns. Other texts are parted at white space only: there lower-casing could depend on neighbours,
    or make a special token's string.
    """

    def __init__(self, path: str) -> None:
        self.encoder = tokenizer(path)
        self.known: dict[bytes, bytes] = {}  # by words in UTF-8
        self.parts: dict[bytes, bytes] = {}  # by parts in Latin-1
        vocabulary, suffix = self.encoder.get_vocab(), getattr(self.encoder.model, "end_of_word_suffix", None)
        #: By id: whether the token ends a part. None if a part might be without such a token.
        self.last: np.ndarray | None = None
        if suffix and all(c + suffix in vocabulary for c in ByteLevel.alphabet()):
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[k for token, k in vocabulary.items() if token.endswith(suffix)]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes], known: dict[bytes, bytes], code: str) -> None:
        for first in range(0, len(new), BATCH_WORDS):
            words = new[first : first + BATCH_WORDS]
            ids = self._ids(b" ".join(words).decode(code).split(" "))
            known.update((word, array("I", own).tobytes()) for word, own in zip(words, ids, strict=True))

    def _learn_parts(self, new: list[bytes]) -> None:
        """Many parts in one string for the library, told apart in its ids by the tokens that end a part: each part has one."""
        alone = [part for part in new if self.last is None or part[0] == ord("'")]  # with letters it may be two parts
        new = [part for part in new if part[0] != ord("'")] if self.last is not None else []
        for first in range(0, len(new), BATCH_WORDS):
            parts = new[first : first + BATCH_WORDS]
            ids = np.array(self._ids([b" ".join(parts).decode("latin-1")])[0], dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            self.parts.update(zip(parts, map(ids.tobytes().__getitem__, map(slice, [0, *ends], ends)), strict=True))
        self._learn(alone, self.parts, "latin-1")

    def _encode_words(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts in UTF-8."""
        split = [text.split() for text in texts]
        if len(self.known) > MOST_KEPT:
            self.known.clear()
        words = set().union(*split)
        self._learn(list(words - self.known.keys()), self.known, "utf-8")
        own = {w: self.known[w] for w in words}  # small enough for the processor's caches
        return [b"".join(map(own.__getitem__, words)) for words in split]

    def _encode_parts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of plain texts in Latin-1."""
        found, starts = parts_of(b"\n".join([b"", *texts, b""]))
        coded = found.dictionary_encode()
        words, which = coded.dictionary.to_pylist(), np.asarray(coded.indices)
        if len(self.parts) > MOST_KEPT:
            self.parts.clear()
        self._learn_parts([w for w in words if w not in self.parts])
        own = list(map(self.parts.__getitem__, words))
        flat, counts = np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int32, len(own)) // 4
        firsts, each = np.cumsum(counts, dtype=np.int32) - counts, counts[which]
        before = np.zeros(len(each) + 1, np.int32)  # ids before each part
        np.cumsum(each, out=before[1:])
        at = np.repeat(firsts[which] - before[:-1], each)
        at += np.arange(len(at), dtype=np.int32)
        ids = flat[at].tobytes()
        text_ends = np.cumsum([len(text) + 1 for text in texts])  # of each text's white space before the next
        own_ends = [4 * n for n in before[np.searchsorted(starts, text_ends)].tolist()]
        return list(map(ids.__getitem__, map(slice, [0, *own_ends], own_ends)))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; a null text counts as empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        others: list[tuple[int, bytes]] = []

        def parted() -> Iterator[tuple[int, bytes]]:
            for k, text in enumerate(texts):
                if (latin := plain(text or "")) is None:
                    others.append((k, text.encode()))
                else:
                    yield from ((k, chunk) for chunk in chunks(latin, SLICE_PLAIN))

        for encode, numbered, most in ((self._encode_parts, parted(), SLICE_PLAIN), (self._encode_words, others, SLICE_CHARS)):
            for some in slices(numbered, most):
                for (k, _), ids in zip(some, encode([text for _, text in some]), strict=True):
                    out[k].append(ids)
        return [b"".join(ids) for ids in out]


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) for each piece of each document: its ids and END_ID, cut at the capacity.

    A null text counts as empty: one piece that holds only END_ID.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    end, step = np.array([END_ID], dtype="<u4").tobytes(), 4 * capacity

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        out: list[tuple] = []
        for doc_id, ids in zip(batch.column(0).to_pylist(), _encoders[path].encode(batch.column(1).to_pylist()), strict=True):
            ids += end
            for k, at in enumerate(range(0, len(ids), step)):
                part = ids[at : at + step]
                out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32"])

    rows = renamed(docs, id=id_col, text=text_col).selectExpr("cast(id as long) id", "text")
    return map_batches(rows, per_batch, "id long, piece int, start long, length long, ids_crc32 long")


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fix bins whose content dominates every other bin of its longest item; (bins with multiplicities, what is left).

    For the longest item, of length j, and the room r beside it, a set of others dominates all sets that
    fit if each of those can be parted so that every part is no longer than one of its items. Then some
    best packing has that bin. Fixed are: j alone, if nothing fits beside it; j with the longest item k
    that fits, if k fills the room, if only one item can fit, or if no three items fit and no two that
    fit are together longer than k. Where an item can't be fixed, shorter ones are tried too: the
    argument holds for an item of any length.
    """
    left = {length: n for length, n in counts.items() if n}
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        lengths = sorted(left)
        for j in reversed(lengths):
            while left.get(j, 0):
                beside = _dominating(left, lengths, j, capacity - j)
                if beside is None:
                    break
                # fewer items only leave fewer sets to dominate, so the bin repeats while both items last
                times = left[j] if not beside else left[j] // 2 if beside == j else min(left[j], left[beside])
                fixed.append((((j, 2),) if beside == j else ((j, 1), (beside, 1)) if beside else ((j, 1),), times))
                for x in (j, *[beside] * bool(beside)):
                    left[x] -= times
                    if not left[x]:
                        del left[x]
                changed = True
    return fixed, left


def _dominating(left: dict[int, int], lengths: list[int], j: int, room: int) -> int | None:
    """The item that with j fills a dominating bin, 0 if j alone does; None if no such bin is known.

    lengths: ascending, all in left and maybe some that are used up.
    """
    others = lambda x: left.get(x, 0) - (x == j)  # noqa: E731  how many there are beside one j
    if others(room) > 0:
        return room
    least: list[int] = []
    for x in lengths:
        if len(least) >= 3 or x > room:
            break
        least += [x] * max(0, min(3, others(x)))
    if not least:
        return 0
    three_fit = len(least) >= 3 and sum(least[:3]) <= room
    if three_fit:
        return None
    fits = [x for x in lengths[: bisect_right(lengths, room)] if others(x) > 0]
    if len(least) < 2 or sum(least[:2]) > room or _longest_pair(fits, others, room) <= fits[-1]:
        return fits[-1]
    return None


def _longest_pair(fits: list[int], others: Callable[[int], int], room: int) -> int:
    low, high, best = 0, len(fits) - 1, 0
    while low <= high:
        if low == high and others(fits[low]) < 2:
            break
        if (both := fits[low] + fits[high]) > room:
            high -= 1
        else:
            best = max(best, both)
            low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing with multiplicities: each item goes to the fullest bin that has room.

    Bins of equal content are kept as one group, and each length splits at most one group, so there are
    few groups however many items there are.
    """
    groups: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by room left
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in sorted(x for x in groups if x >= length):
            each, kept = room // length, []
            for pattern, times in groups.pop(room):
                full = min(times, n // each)
                part = n - full * each if full < times else 0
                n -= full * each + part
                if full:
                    groups[room - each * length].append(((*pattern, (length, each)), full))
                if part:
                    groups[room - part * length].append(((*pattern, (length, part)), 1))
                if rest := times - full - bool(part):
                    kept.append((pattern, rest))
            if kept:
                groups[room] += kept
            if not n:
                break
        if n:
            each = capacity // length
            if n // each:
                groups[capacity - each * length].append((((length, each),), n // each))
            if n % each:
                groups[capacity - n % each * length].append((((length, n % each),), 1))
    return [group for room in sorted(groups) for group in groups[room]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns with the number of bins that repeat each, for a histogram of lengths up to the capacity."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


class Places:
    """Where the piece of a length and rank goes: built from a plan, of a size bound by the capacity alone."""

    def __init__(self, bins: list[tuple[Pattern, int]]) -> None:
        entries = defaultdict(list)
        first_bin = 0
        for pattern, times in bins:
            offset = 0
            for length, each in pattern:
                entries[length].append((each * times, first_bin, each, offset))
                offset += length * each
            first_bin += times
        self.by_length = {}
        for length, rows in entries.items():
            n, bin_, each, offset = np.array(rows, dtype=np.int64).T
            ends = np.cumsum(n)
            self.by_length[length] = (ends, ends - n, bin_, each, offset)

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            ends, starts, bin_, each, first = self.by_length[int(length)]
            row = np.searchsorted(ends, ranks[own], side="right")
            at = ranks[own] - starts[row]
            sequence[own] = bin_[row] + at // each[row]
            offset[own] = first[row] + at % each[row] * length
        return sequence, offset


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pieces() with sequence_id and offset: every piece of every row in one sequence of at most `capacity` tokens.

    Sequences are gapless from offset 0. Null and empty texts are packed as their end token alone. A very
    long text is cut into pieces, each packed on its own. Repeated rows are packed each on its own, rows
    without an id too. Pieces of one length are alike to the plan: which of them takes which place goes
    by hash bucket, then id, piece, start and checksum, and full ties are equal pieces. An empty table
    gives no rows. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    # the row's place in its partition parts equal rows and rows without an id; it is written down, so that no lost task changes it
    hashed = F.xxhash64("id", "piece", F.monotonically_increasing_id())
    cut = materialize(pieces(docs, path, capacity, id_col, text_col).withColumn("hash", hashed), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    buckets = max(1, -(-max(histogram.values(), default=0) // BUCKET_PIECES))
    cut = cut.withColumn("bucket", F.pmod("hash", F.lit(buckets)).cast("int")).drop("hash")
    by_bucket = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("id", "piece", "start", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(own) - 1).join(firsts, ["length", "bucket"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.value.of(np.asarray(batch.column(3)), np.asarray(batch.column(5)))
                columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
