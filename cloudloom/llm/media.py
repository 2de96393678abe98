"""Media columns: content-addressed payloads in tar shards in the shared folder.

Rows carry a member's digest, shard, offset and length. A payload is stored once: of rows with equal texts
only the first by id is written, the others find it by the text's digest. (Rows that repeat an id and its
text may be written by several tasks; all rows then take the copy with the least shard and offset.) A text
that many rows hold is dealt by a salt. Metadata columns come from range reads of the members' headers,
features from reads of whole members.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.shared import byte_slices, file_store, joined_to_few, materialize, new_folder, renamed

WIDTH = 64
SHARD_BYTES = 128 << 20
#: Stored bytes that a task reads, in order, and the greatest number of such tasks.
READ_BYTES, MOST_READERS = 16 << 20, 20_000
#: Rows of one text that meet its place in one task.
ROWS_A_SALT = 500
BINS = 16
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  # signature and IHDR chunk
_BLOCK = 512


def padded(data: bytes, unit: int = WIDTH) -> bytes:
    """data with zero bytes up to a positive multiple of the unit."""
    return data.ljust(max(1, -(-len(data) // unit)) * unit, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A payload of whole rows as a grey image of 8-bit samples, WIDTH to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter 0
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_size(header: bytes) -> tuple[int, int]:
    """Width and height from an image's first HEADER_BYTES bytes."""
    if len(header) < HEADER_BYTES or header[:8] != _SIGNATURE or header[12:16] != b"IHDR":
        raise ValueError("not an image of this store")
    if zlib.crc32(header[12:29]) != struct.unpack(">I", header[29:33])[0]:
        raise ValueError("a damaged image header")
    return struct.unpack(">II", header[16:24])


def from_png(data: bytes) -> bytes:
    """The payload of to_png()'s image, checked chunk by chunk."""
    width, height = png_size(data[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while at < len(data):
        (size,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a damaged image chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Per mille of the samples in each of BINS ranges, then the mean step between neighbours in thousandths."""
    samples = np.frombuffer(payload, np.uint8)
    shares = np.bincount(samples >> 4, minlength=BINS) * 1000 // len(samples)
    step = int(np.abs(np.diff(samples.astype(np.int64))).sum()) * 1000 // max(1, len(samples) - 1)
    return "-".join(map(str, [*shares.tolist(), step]))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, key, writes, salts): key is the text's digest; the first row of a text by id writes it; salts grow with the rows that share it."""
    rows = renamed(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    shared = rows.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = joined_to_few(rows, materialize(shared, "media-shared"), "key")
    salts = F.ceil(F.coalesce("n", F.lit(1)) / ROWS_A_SALT).cast("int")
    return rows.select("id", "text", "key", (F.col("n").isNull() | F.col("id").eqNullSafe(F.col("first"))).alias("writes"), salts.alias("salts"))


def store(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """keyed() rows, without the text, with n_bytes and, where a row writes, (digest, shard, offset, length) of the member that it wrote.

    A null text counts as empty: one row of zero samples. A very long text is one member, held whole while
    it is written. digest is SHA-256 of the stored member.
    """
    folder = folder or new_folder(rows.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, at = file_store(folder)
        files.create_dir(at, recursive=True)
        places: dict[bytes, tuple[bytes, str, int, int]] = {}  # of this shard, by key and by digest
        out, name, end = None, "", 0
        for batch in byte_slices(batches):
            sizes, found = [], []
            for text, key, writes in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                data = text.encode()
                sizes.append(len(data))
                if not writes:
                    found.append((None,) * 4)
                    continue
                if out is not None and end >= SHARD_BYTES:
                    out.write(bytes(2 * _BLOCK))
                    out.close()
                    out = None
                    places.clear()
                if out is None:
                    name, end = f"{folder}/{uuid.uuid4().hex}.tar", 0
                    out = files.open_output_stream(f"{at}/{name.rpartition('/')[2]}", compression=None)
                if key not in places:
                    member = to_png(padded(data))
                    digest = hashlib.sha256(member).digest()
                    places[key] = places.get(digest)
                if places[key] is None:
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(member)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    tail = bytes(-len(member) % _BLOCK)
                    out.write(head + member + tail)
                    places[key] = places[digest] = (digest, name, end + len(head), len(member))
                    end += len(head) + len(member) + len(tail)
                found.append(places[key])
            types = (pa.binary(), pa.string(), pa.int64(), pa.int64())
            columns = [pa.array(c, type=t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
            narrow = [batch.column(k) for k in (0, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*narrow, pa.array(sizes, type=pa.int64()), *columns], ["id", "key", "writes", "salts", "n_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(2 * _BLOCK))
            out.close()

    schema = "id long, key binary, writes boolean, salts int, n_bytes long, digest binary, shard string, offset long, length long"
    return materialize(rows.select("id", "text", "key", "writes", "salts").mapInArrow(run, schema), "media-rows")


def members(rows: DataFrame) -> DataFrame:
    """The distinct payloads of store()'s rows: (digest, shard, offset, length, key, salts) of the one copy that all rows use.

    Two texts have one member where zero bytes alone part them: it is then read once for each.
    """
    place = F.min(F.struct("shard", "offset", "length", "digest", "salts")).alias("at")
    return rows.where("writes").groupBy("key").agg(place).select("at.digest", "at.shard", "at.offset", "at.length", "key", "at.salts")


def _in_reading_order(found: DataFrame) -> DataFrame:
    stored = found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(1, min(-(-stored // READ_BYTES), MOST_READERS))  # by what they will read: their places alone are small
    places = found.select("key", "digest", "shard", "offset", "length")
    return places.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")


def _each_member(found: DataFrame, read, names: list[str], types: list[pa.DataType], schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out: list[tuple] = []
                for key, digest, shard, offset, length in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if shard != opened:
                        if source is not None:
                            source.close()
                        files, path = file_store(shard)
                        opened, source = shard, files.open_input_file(path)
                    out.append((key, *read(source, digest, offset, length)))
                columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)
        if source is not None:
            source.close()

    return _in_reading_order(found).mapInArrow(run, schema)


def metadata(found: DataFrame) -> DataFrame:
    """(key, width, height, payload_bytes, media_bytes) by range reads of HEADER_BYTES bytes of each member."""

    def read(source, digest: bytes, offset: int, length: int) -> tuple:
        width, height = png_size(source.read_at(HEADER_BYTES, offset))
        return width, height, width * height, length

    types = [pa.binary(), *[pa.int64()] * 4]
    names = ["key", "width", "height", "payload_bytes", "media_bytes"]
    return _each_member(found, read, names, types, "key binary, width long, height long, payload_bytes long, media_bytes long")


def features(found: DataFrame) -> DataFrame:
    """(key, payload_sha256, tail_crc32, feature) from whole members, each checked against its digest."""

    def read(source, digest: bytes, offset: int, length: int) -> tuple:
        member = source.read_at(length, offset)
        if hashlib.sha256(member).digest() != digest:
            raise ValueError(f"the member at {offset} isn't {digest.hex()}")
        payload = from_png(member)
        return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), feature(payload)

    types = [pa.binary(), pa.string(), pa.int64(), pa.string()]
    return _each_member(found, read, ["key", "payload_sha256", "tail_crc32", "feature"], types, "key binary, payload_sha256 string, tail_crc32 long, feature string")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, digest, shard, offset, length, width, height, payload_bytes, media_bytes, payload_sha256, tail_crc32, feature) for each row.

    Null texts count as empty; equal texts get equal values, their one copy's place included; very long texts
    are one member each; repeated rows and null ids each come back; an empty table gives an empty result;
    other columns are not read.
    """
    rows = store(keyed(docs, id_col, text_col))
    found = materialize(members(rows), "media-members")
    known = metadata(found).join(features(found), "key").join(found, "key")
    # a text of many rows is there once for each salt, and its rows are dealt to them
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    narrow = rows.select("id", "n_bytes", "key", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "salts").cast("int").alias("salt"))
    return narrow.join(known, ["key", "salt"]).drop("key", "salt")
