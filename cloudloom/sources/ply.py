"""PLY files as a Spark data source: format "ply" reads vertices, or faces with option element="face", and writes meshes.

Binary little-endian files of fixed-size records are dealt in byte ranges of whole records; big-endian
and ASCII files too, the latter in one part. Files are opened through Arrow's file systems, so object
stores work as local paths do.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# The format's scalar types, as NumPy codes.
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
    "int64": "i8", "uint64": "u8",
}
#: Other names that files use for the columns kept here.
ALIASES = {"normal_x": "nx", "normal_y": "ny", "normal_z": "nz", "r": "red", "g": "green", "b": "blue"}
COLUMNS = ("x", "y", "z", "nx", "ny", "nz", "red", "green", "blue", "intensity", "value")
#: Records in a partition of a binary file.
GRAIN = 1_000_000


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), re.sub("^file:", "", path))


@dataclass
class Element:
    name: str
    count: int
    #: (name, type) of scalars, (name, count type, item type) of lists.
    properties: list[tuple] = field(default_factory=list)

    def has_lists(self) -> bool:
        return any(len(p) == 3 for p in self.properties)

    def dtype(self, order: str) -> np.dtype:
        return np.dtype([(f"p{k}", order + p[1]) for k, p in enumerate(self.properties)])


@dataclass
class Header:
    format: str
    elements: list[Element]
    size: int
    comments: list[str]

    def element(self, name: str) -> Element | None:
        return next((e for e in self.elements if e.name == name), None)


def parse_header(data: bytes) -> Header:
    """The header at the start of a file's bytes; lines may end in CR LF, names may be in any case."""
    end = re.search(rb"(?m)^end_header[ \t]*\r?\n", data)
    if not re.match(rb"ply\r?\n", data):
        raise ValueError("not a PLY file")
    if not end:
        raise ValueError("a PLY header without an end")
    header = Header("", [], end.end(), [])
    for line in data[: end.start()].decode("latin-1").splitlines()[1:]:
        words = line.split()
        if not words:
            continue
        key = words[0].lower()
        if key in ("comment", "obj_info"):
            header.comments.append(line.partition(" ")[2])
        elif key == "format":
            header.format = words[1].lower()
            if header.format not in ("ascii", "binary_little_endian", "binary_big_endian"):
                raise ValueError(f"format {words[1]} isn't known")
        elif key == "element":
            header.elements.append(Element(words[1].lower(), int(words[2])))
        elif key == "property":
            if not header.elements:
                raise ValueError("a property before any element")
            kinds = words[2:4] if words[1].lower() == "list" else words[1:2]
            if unknown := [k for k in kinds if k.lower() not in TYPES]:
                raise ValueError(f"type {unknown[0]} isn't known")
            header.elements[-1].properties.append((words[-1].lower(), *[TYPES[k.lower()] for k in kinds]))
    if not header.format:
        raise ValueError("a PLY header without a format")
    vertex = header.element("vertex")
    if vertex is None:
        raise ValueError("a PLY file without vertices")
    if vertex.has_lists():
        raise ValueError("lists in vertices aren't read")
    if not {"x", "y", "z"} <= {p[0] for p in vertex.properties}:
        raise ValueError("vertices without x, y and z")
    return header


def read_header(path: str, most: int = 1 << 20) -> Header:
    files, at = store_of(path)
    with files.open_input_file(at) as f:
        return parse_header(f.read(most))


def column_of(name: str) -> str:
    if name.endswith("intensity"):
        return "intensity"
    return ALIASES.get(name, name)


def _kept(vertex: Element) -> list[tuple[str, int]]:
    """(column, property) of the columns that are read, each from the first property that gives it."""
    found = {}
    for k, p in enumerate(vertex.properties):
        found.setdefault(column_of(p[0]), k)
    return [(c, found[c]) for c in COLUMNS if c in found]


def _values(column: str, raw: np.ndarray) -> np.ndarray:
    if column not in ("red", "green", "blue"):
        return raw.astype(float)
    values = raw.astype(float)
    shown = np.clip(np.nan_to_num(values), 0, 255)
    if raw.dtype.kind == "f":
        shown = np.where((values >= 0) & (values <= 1), np.floor(values * 255 + 0.5), shown)
    return shown.astype(np.int16)


@dataclass
class Part(InputPartition):
    path: str
    first: int
    count: int
    #: The id of the file's first row: files of a folder are numbered through.
    base: int = 0


def paths_of(path: str, suffix: str = ".ply") -> list[str]:
    """The file, or the files with this suffix in a folder, in order of name."""
    files, at = store_of(path)
    info = files.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    inside = files.get_file_info(pafs.FileSelector(at, recursive=True))
    return [path.rstrip("/") + f.path[len(at.rstrip("/")) :] for f in sorted(inside, key=lambda f: f.path) if f.path.lower().endswith(suffix)]


class PlyReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.options, self.names = options, [f.name for f in schema.fields]
        self.element = options.get("element", "vertex")
        self.strict = options.get("strict", "false").lower() == "true"
        self.grain = int(options.get("grain", GRAIN))

    def partitions(self) -> Sequence[InputPartition]:
        out, base = [], 0
        for path in paths_of(self.options["path"]):
            header = read_header(path)
            vertex = header.element("vertex")
            first = header.elements[0] is vertex
            if self.element == "vertex" and header.format != "ascii" and first:
                out += [Part(path, k, min(self.grain, vertex.count - k), base) for k in range(0, vertex.count, self.grain)]
            else:
                out.append(Part(path, 0, -1, base))
            base += (header.element(self.element) or vertex).count
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        header = read_header(part.path)
        files, at = store_of(part.path)
        order = ">" if header.format == "binary_big_endian" else "<"
        if part.count >= 0:
            kind = header.element("vertex").dtype(order)
            with files.open_input_file(at) as f:
                data = f.read_at(part.count * kind.itemsize, header.size + part.first * kind.itemsize)
            n = len(data) // kind.itemsize
            if self.strict and n < part.count:
                raise ValueError(f"{part.path} ends before its last vertex")
            yield self._batch(header, [np.frombuffer(data, kind, n)[f"p{k}"] for k in range(len(kind.names))], part.base + part.first)
            return
        with files.open_input_stream(at) as f:
            data = f.read()[header.size :]
        if header.format == "ascii":
            yield from self._ascii(header, data, part)
        else:
            yield from self._binary(header, data, order, part.base)

    def _batch(self, header: Header, raw: list[np.ndarray], first: int, ids: np.ndarray | None = None) -> pa.RecordBatch:
        columns = {c: _values(c, raw[k]) for c, k in _kept(header.element("vertex"))}
        n = len(raw[0]) if raw else 0
        columns["point_id"] = np.arange(first, first + n, dtype=np.int64) if ids is None else ids
        return pa.RecordBatch.from_arrays([pa.array(columns[c]) for c in self.names], self.names)

    def _faces(self, rings: list[list[int]], first: int) -> pa.RecordBatch:
        ids = pa.array(np.arange(first, first + len(rings), dtype=np.int64))
        return pa.RecordBatch.from_arrays([ids, pa.array(rings, type=pa.list_(pa.int32()))], ["fid", "vids"])

    def _ascii(self, header: Header, data: bytes, part: Part) -> Iterator[pa.RecordBatch]:
        path = part.path
        lines, at = data.decode("latin-1").splitlines(), 0
        for e in header.elements:
            own, at = lines[at : at + e.count], at + e.count
            if e.name != self.element:
                continue
            if e.name == "face":
                words = [line.split() for line in own]
                yield self._faces([[int(v) for v in w[1 : 1 + int(w[0])]] for w in words if w], part.base)
                return
            width, ids, rows = len(e.properties), [], []
            for k, line in enumerate(own):
                words = line.split()
                try:
                    row = [float(w) for w in words[:width]]
                except ValueError:
                    row = []
                if len(row) == width:
                    ids.append(k)
                    rows.append(row)
                elif self.strict:
                    raise ValueError(f"{path}: vertex {k} isn't complete")
            table = np.array(rows, dtype=float).reshape(-1, width)
            raw = [table[:, k].astype(p[1]) if p[1][0] != "f" else table[:, k] for k, p in enumerate(e.properties)]
            if self.strict and len(own) < e.count:
                raise ValueError(f"{path} ends before its last vertex")
            yield self._batch(header, raw, 0, np.array(ids, dtype=np.int64) + part.base)

    def _binary(self, header: Header, data: bytes, order: str, base: int) -> Iterator[pa.RecordBatch]:
        at = 0
        for e in header.elements:
            if not e.has_lists():
                kind = e.dtype(order)
                n = min(e.count, (len(data) - at) // kind.itemsize)
                if e.name == self.element:
                    table = np.frombuffer(data, kind, n, at)
                    yield self._batch(header, [table[f"p{k}"] for k in range(len(kind.names))], base)
                    return
                at += n * kind.itemsize
                continue
            rings = []
            for _ in range(e.count):
                ring: list[int] = []
                for p in e.properties:
                    if len(p) == 2:
                        at += np.dtype(p[1]).itemsize
                        continue
                    size = np.dtype(p[1]).itemsize
                    n = int(np.frombuffer(data, order + p[1], 1, at)[0])
                    items = np.frombuffer(data, order + p[2], n, at + size)
                    at += size + n * items.itemsize
                    if p[0] in ("vertex_indices", "vertex_index"):
                        ring = items.tolist()
                rings.append(ring)
            if e.name == self.element:
                yield self._faces(rings, base)
                return


class PlyWriter(DataSourceArrowWriter):
    """Writes each partition's points as a file of its own in a folder; write_mesh() writes one file with faces."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.names = path, [f.name for f in schema.fields if f.name != "point_id"]
        self.kinds = {f.name: "uchar" if f.dataType.typeName() in ("short", "byte") else "double" for f in schema.fields}

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, at = store_of(self.path)
        files.create_dir(at, recursive=True)
        kind = np.dtype([(n, "<" + TYPES[self.kinds[n]]) for n in self.names])
        parts, n = [], 0
        for batch in batches:
            table = np.empty(batch.num_rows, kind)
            for name in self.names:
                table[name] = np.asarray(batch.column(batch.schema.get_field_index(name)))
            parts.append(table.tobytes())
            n += len(table)
        with files.open_output_stream(f"{at}/part-{uuid.uuid4().hex}.ply") as f:
            f.write(header_text("binary_little_endian", n, [(self.kinds[c], c) for c in self.names], None).encode())
            for p in parts:
                f.write(p)
        return WriterCommitMessage()


class PlySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        if self.options.get("element", "vertex") == "face":
            return "fid long, vids array<int>"
        names = {c for path in paths_of(self.options["path"])[:1] for c, _ in _kept(read_header(path).element("vertex"))}
        kinds = [f"{c} {'short' if c in ('red', 'green', 'blue') else 'double'}" for c in COLUMNS if c in names]
        return "point_id long, " + ", ".join(kinds)

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema)


def header_text(kind: str, vertices: int, properties: list[tuple[str, str]], faces: int | None) -> str:
    lines = ["ply", f"format {kind} 1.0", f"element vertex {vertices}", *[f"property {t} {n}" for t, n in properties]]
    if faces is not None:
        lines += [f"element face {faces}", "property list uchar int vertex_indices"]
    return "\n".join([*lines, "end_header", ""])


def load(spark: SparkSession, path: str, distance: float | None = None, bad: str = "drop", **options: str) -> DataFrame:
    """A PLY cloud; with a distance only finite points, one a grid cell. Normals are zero where the file has none.

    Without a distance nothing is filtered: validate() decides on the whole cloud.
    """
    from cloudloom.operators import clouds

    spark.dataSource.register(PlySource)
    cloud = spark.read.format("ply").options(**options).load(path)
    missing = [c for c in clouds.NORMAL if c not in cloud.columns]
    cloud = cloud.withColumns({c: F.lit(0.0) for c in missing})
    return cloud if distance is None else clouds.decimate(clouds.finite_points(cloud, bad), distance)


def write_mesh(vertices: DataFrame, faces: DataFrame | None, path: str, ascii: bool = False) -> None:
    """One PLY file, streamed through the driver part by part, with vertex numbers 0, 1, ... in order of vid.

    A single file is what the format asks for; for meshes beyond one machine write Parquet.
    """
    columns = [c for c in COLUMNS if c in vertices.columns]
    kinds = ["uchar" if c in ("red", "green", "blue") else "double" for c in columns]
    key = "vid" if "vid" in vertices.columns else "point_id"
    n, m = vertices.count(), None if faces is None else faces.count()
    files, at = store_of(path)
    files.create_dir(at.rpartition("/")[0] or ".", recursive=True)
    code = "<" + "".join("B" if k == "uchar" else "d" for k in kinds)
    with files.open_output_stream(at) as f:
        f.write(header_text("ascii" if ascii else "binary_little_endian", n, list(zip(kinds, columns, strict=True)), m).encode())
        number = {}
        for k, row in enumerate(vertices.orderBy(key).select(key, *columns).toLocalIterator()):
            number[row[0]] = k
            values = [int(v) if t == "uchar" else float(v) for t, v in zip(kinds, row[1:], strict=True)]
            f.write((" ".join(f"{v:.17g}" for v in values) + "\n").encode() if ascii else struct.pack(code, *values))
        if faces is not None:
            for row in faces.orderBy("fid").select("vids").toLocalIterator():
                ring = [number[v] for v in row[0]]
                f.write((" ".join(map(str, [len(ring), *ring])) + "\n").encode() if ascii else struct.pack(f"<B{len(ring)}i", len(ring), *ring))
