"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame per record.

Tasks write archives straight to the shared folder and return a row for each. Only rows of tasks that
succeeded are used, so an archive that a lost task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.shared import byte_slices, file_store, joined_to_few, materialize, new_folder, renamed

#: The skippable frame that holds the dictionary, by the public WARC-in-Zstandard convention.
DICT_MAGIC = 0x184D2A5D
DICT_BYTES = 32 << 10
#: The dictionary is trained on at most so many payloads, of at most so many bytes each.
DICT_PAYLOADS, DICT_PAYLOAD_BYTES = 400, 8 << 10
LEVEL = 3
ARCHIVE_BYTES = 256 << 20
#: Tasks that read archives; each takes several beyond so many.
MOST_READERS = 20_000
DATE = "1970-01-01T00:00:00Z"
NO_URL = "urn:no-url"
_CHUNK = 1 << 20
_NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


@dataclass(frozen=True)
class Record:
    page_id: int | None
    record_type: str
    payload_bytes: int
    payload_digest: str
    refers_to: int | None
    url: str | None
    payload: bytes | None


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'none-' + uuid.uuid4().hex if page_id is None else page_id}>"


def _page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of a response, or of a revisit: the same HTTP head without the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if not revisit:
        block += payload
    target = NO_URL if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or NO_URL + ":empty"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_page_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_page_urn(refers_to)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record | None:
    """The record of a frame, its headers, lengths and digest checked; None for one that holds no page."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    if missing := [name for name in _NEEDED if name not in fields]:
        raise ValueError(f"record without {missing}")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {len(rest) - 4} bytes, where the header has {length}")
    kind = fields["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, found, payload = rest[:length].partition(b"\r\n\r\n")
    stated = re.search(rb"\r\nContent-Length: (\d+)", http)
    digest = fields.get("WARC-Payload-Digest", "")
    if not found or not stated or not digest.startswith("sha1:"):
        raise ValueError("a page without HTTP head or digest")
    if kind == "response" and (len(payload) != int(stated[1]) or digest_of(payload) != digest[5:]):
        raise ValueError("a payload that its length or digest doesn't fit")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in fields):
        raise ValueError("a revisit with a payload, or without what it revisits")
    url = fields["WARC-Target-URI"]
    url = None if url == NO_URL else "" if url == NO_URL + ":empty" else url
    refers = _page_of(fields.get("WARC-Refers-To"))
    return Record(_page_of(fields["WARC-Record-ID"]), kind, int(stated[1]), digest[5:], refers, url, payload if kind == "response" else None)


def make_dictionary(payloads: list[bytes]) -> bytes:
    """A dictionary trained on the payloads; their plain bytes where there are too few to train on."""
    samples = [p[:DICT_PAYLOAD_BYTES] for p in payloads[:DICT_PAYLOADS] if p]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[: DICT_BYTES // 2] + encode_record(0, "https://www.", b"", 0, True))[-DICT_BYTES:]


class Writer:
    """Writes frames to an open binary stream, the dictionary first."""

    def __init__(self, out: BinaryIO, dictionary: bytes, level: int = LEVEL) -> None:
        self.out, self.bytes, self.records = out, 0, 0
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
        self._put(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        info = b"software: cloudloom\r\n"
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Length: {len(info)}\r\n\r\n"
        self._put(self.compressor.compress(head.encode() + info + b"\r\n\r\n"))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


def read_archive(source: BinaryIO) -> Iterator[Record]:
    """The pages of an archive in turn, holding one frame at a time."""
    head = source.read(8)
    magic, size = struct.unpack("<II", head) if len(head) == 8 else (0, 0)
    if magic != DICT_MAGIC:
        raise ValueError("an archive that doesn't start with its dictionary")
    packed = source.read(size)
    if len(packed) != size:
        raise ValueError("an archive that ends in its dictionary")
    if packed[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):
        packed = zstandard.ZstdDecompressor().decompress(packed)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed))
    frame, parts, data = decompressor.decompressobj(), [], source.read(_CHUNK)
    while data:
        parts.append(frame.decompress(data))
        if frame.eof:
            if (record := decode_record(b"".join(parts))) is not None:
                yield record
            data = frame.unused_data
            frame, parts = decompressor.decompressobj(), []
        else:
            data = b""
        data = data or source.read(_CHUNK)
    if any(parts):
        raise ValueError("an archive that ends in a record")


def write_archives(
    pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html"
) -> DataFrame:
    """One record per row of pages, in archives in `folder`; a row (path, records, bytes) for each archive.

    Of rows with equal payloads of at least min_revisit_bytes bytes, those with the least id are
    responses and the others revisit it. A null payload counts as empty. Without any id among them, all
    rows with a payload are responses. Repeated rows get a record each, an empty table gives no archive.
    A record of any length is written whole; a task holds one at a time.
    Payloads aren't shuffled: only their digests are, and what they say of repeated payloads goes to the
    rows where these are read, as long as it is few enough to be broadcast.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    rows = renamed(pages, id=id_col, url=url_col, payload=payload_col)
    rows = rows.select(F.col("id").cast("long").alias("id"), "url", F.coalesce("payload", F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    # payloads that occur once need no partner, which leaves a narrow table that is small unless much repeats
    firsts = rows.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.max(F.octet_length("payload")).alias("size"))
    firsts = firsts.where((F.col("n") > 1) & (F.col("size") >= min_revisit_bytes)).select("sha1", "first")
    rows = joined_to_few(rows, materialize(firsts, "warc-firsts"), "sha1").select("id", "url", "payload", "first")
    head = renamed(pages, payload=payload_col).select(F.left("payload", F.lit(DICT_PAYLOAD_BYTES)).alias("payload")).where("payload <> ''").limit(DICT_PAYLOADS)
    sample = [r["payload"].encode() for r in head.collect()]
    dictionary = spark.sparkContext.broadcast(make_dictionary(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = file_store(folder)
        store.create_dir(at, recursive=True)
        written: list[tuple[str, int, int]] = []
        stream = writer = None

        def close() -> None:
            nonlocal stream, writer
            if writer:
                stream.close()
                written[-1] = (written[-1][0], writer.records, writer.bytes)
                stream = writer = None

        for batch in byte_slices(batches):
            for page_id, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    stream = store.open_output_stream(f"{at}/{name}", compression=None)  # else the suffix has it compressed again
                    writer = Writer(stream, dictionary.value)
                    written.append((f"{folder}/{name}", 0, 0))
                writer.add(encode_record(page_id, url, payload.encode(), first, first is not None and page_id != first))
                if writer.bytes >= ARCHIVE_BYTES:
                    close()
        close()
        if written:
            paths, records, sizes = zip(*written, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(records, type=pa.int64()), pa.array(sizes, type=pa.int64())], ["path", "records", "bytes"])

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "warc-archives")


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, refers_to, url, payload) for each page in the archives at `path`.

    payloads: whether to return the payload of responses; else it is read and checked all the same, and null.
    Each archive is read by one task, frame by frame, and archives are dealt evenly; an empty table of
    archives gives no rows, and a damaged archive or one of another number of pages raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = file_store(path)
                rows, size, n = [], 0, 0
                with store.open_input_stream(at, compression=None) as source:
                    for r in read_archive(source):
                        rows.append((r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.url, r.payload if payloads else None))
                        size += len(r.payload or b"") * payloads
                        n += 1
                        if len(rows) >= 5000 or size >= 16 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)
                if n != expected:
                    raise ValueError(f"{path} holds {n} pages, not {expected}")

    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"
    parts = max(1, min(archives.count(), MOST_READERS))  # a stated number: a few paths of a few bytes each would be coalesced into one task
    return archives.select("path", "records").repartitionByRange(parts, "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """pages written as archives and read back: a row for each row of pages, payloads left out.

    Null ids stay null, null payloads are empty, repeated rows get a record each, of equal payloads the row
    with the least id is the response, very long payloads are one record, an empty table gives no rows;
    other columns are not read.
    """
    return read_archives(write_archives(pages, None, min_revisit_bytes, id_col, url_col, payload_col))
