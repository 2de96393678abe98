"""Token counts of whole texts by batch encoding; only lengths leave the Arrow function.

A text is split before single spaces between two non-white characters. No pre-token of the byte-level
vocabularies crosses such a space, so the counts of the parts add up to the text's. Distinct parts are
encoded in batches of about equal bytes, and their lengths kept in a bounded table per worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from cloudloom.llm.shared import map_batches, renamed

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
BATCH_BYTES = 1 << 20
#: Parts whose lengths a worker keeps; beyond it the table starts anew.
MOST_KEPT = 400_000

_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, loaded once per worker, without threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def balanced(texts: Iterable[str], most_bytes: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Batches of at most most_bytes bytes, or of one longer text."""
    batch: list[str] = []
    size = 0
    for text in texts:
        n = len(text.encode())
        if batch and size + n > most_bytes:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += n
    if batch:
        yield batch


def safe_parts(text: str) -> list[str]:
    """The text cut before each single space that has non-white characters on both sides."""
    parts = text.split(" ")
    out = [parts[0]]
    for part in parts[1:]:
        last = out[-1][-1:]
        if part and last and not part[0].isspace() and not last.isspace():
            out.append(" " + part)
        else:
            out[-1] += " " + part
    return out


class Counter:
    """Token counts of texts by their safe parts."""

    def __init__(self, path: str) -> None:
        self.encoder = tokenizer(path)
        #: By word: tokens of " word", for words without white space at either end.
        self.inner: dict[str, int] = {}

    def lengths(self, parts: list[str]) -> list[int]:
        return [len(e.ids) for batch in balanced(parts) for e in self.encoder.encode_batch_fast(batch, add_special_tokens=False)]

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.inner) > MOST_KEPT:
            self.inner.clear()
        new = list({w for words in texts for w in words[1:]} - self.inner.keys())
        self.inner.update(zip(new, self.lengths([" " + w for w in new]), strict=True))

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; a null text counts as empty."""
        split = [(t or "").split(" ") for t in texts]
        plain = [all(w and not w[0].isspace() and not w[-1].isspace() for w in words) for words in split]
        self.learn([words for words, ok in zip(split, plain, strict=True) if ok])
        firsts = self.lengths([words[0] for words in split])
        known = self.inner.__getitem__
        return [
            first + sum(map(known, words[1:])) if ok else sum(self.lengths(safe_parts(text or "")))
            for text, words, ok, first in zip(texts, split, plain, firsts, strict=True)
        ]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of docs.

    A null text counts as empty, with 0 bytes and tokens. Special strings inside texts are handled as
    the tokenizer's default. A very long text is counted in parts and is whole in one row's memory; a run
    without a safe boundary is one part. Repeated rows and null ids each come back, equal texts with equal
    counts; an empty table gives an empty result; other columns of docs are not read. path: a file of the tokenizers library.
    """
    path = path or public_tokenizers.path(TOKENIZER)

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        tokens = np.array(counter(path).counts(texts), dtype=np.int64)
        n_bytes = np.array([len((t or "").encode()) for t in texts], dtype=np.int64)
        columns = [batch.column(0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = renamed(docs, id=id_col, text=text_col)
    return map_batches(rows.selectExpr("cast(id as long) id", "text"), per_batch, "id long, n_bytes long, n_tokens long, over_limit boolean")
