"""Positions from XYZ, OBJ and NPY files, the loader by suffix, and frames of point messages."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from cloudloom.functions import geometry as G
from cloudloom.sources.ply import GRAIN, Part, load, paths_of, store_of


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(point_id, value): lines with their places in the files' order. point_id rises along a file, with gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("point_id"), "value")


def _triple(words: Column, first: int) -> list[Column]:
    return [G.parse_double(F.get(words, F.lit(first + k))).alias(n) for k, n in enumerate("xyz")]


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """The first three numbers of each line; other lines are passed over."""
    rows = _lines(spark, path).select("point_id", *_triple(G.tokens(F.col("value")), 0))
    return rows.where("x is not null and y is not null and z is not null")


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """The vertices of OBJ files: lines "v x y z"."""
    words = G.tokens(F.col("value"))
    rows = _lines(spark, path).where(F.get(words, F.lit(0)) == "v").select("point_id", *_triple(words, 1))
    return rows.where("x is not null and y is not null and z is not null")


def npy_header(data: bytes) -> tuple[np.dtype, tuple[int, ...], int]:
    """Type, shape and header size of an NPY file in C order with little-endian floats and at least three columns."""
    if data[:6] != b"\x93NUMPY":
        raise ValueError("not an NPY file")
    wide = data[6] >= 2
    size = int.from_bytes(data[8 : 12 if wide else 10], "little")
    start = 12 if wide else 10
    text = data[start : start + size].decode("latin-1")
    kind, order, shape = (re.search(p, text) for p in (r"'descr':\s*'([^']+)'", r"'fortran_order':\s*(True|False)", r"'shape':\s*\(([^)]*)\)"))
    if not (kind and order and shape) or kind[1] not in ("<f4", "<f8") or order[1] == "True":
        raise ValueError("an NPY file that isn't of little-endian floats in C order")
    dims = tuple(int(v) for v in shape[1].split(",") if v.strip())
    if len(dims) != 2 or dims[1] < 3:
        raise ValueError("an NPY array without three columns")
    return np.dtype(kind[1]), dims, start + size


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.grain = options["path"], int(options.get("grain", GRAIN))

    def partitions(self) -> Sequence[InputPartition]:
        out, base = [], 0
        for path in paths_of(self.path, ".npy"):
            files, at = store_of(path)
            with files.open_input_file(at) as f:
                kind, (n, width), start = npy_header(f.read(1 << 16))
                if f.size() < start + n * width * kind.itemsize:
                    raise ValueError(f"{path} ends before its last row")
            out += [Part(path, k, min(self.grain, n - k), base) for k in range(0, n, self.grain)]
            base += n
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        files, at = store_of(part.path)
        with files.open_input_file(at) as f:
            kind, (_, width), start = npy_header(f.read_at(1 << 16, 0))
            size = width * kind.itemsize
            rows = np.frombuffer(f.read_at(part.count * size, start + part.first * size), kind).reshape(-1, width).astype(float)
        ids = part.base + np.arange(part.first, part.first + len(rows), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(rows[:, k].copy()) for k in range(3)]], ["point_id", "x", "y", "z"])


class NpySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "point_id long, x double, y double, z double"

    def reader(self, schema: StructType) -> NpyReader:
        return NpyReader(dict(self.options))


def read_npy(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(NpySource)
    return spark.read.format("npy").options(**options).load(path)


def load_points(spark: SparkSession, path: str) -> DataFrame:
    """Positions from a file by its suffix, in any case: ply (strict), xyz, obj or npy."""
    suffix = path.rpartition(".")[2].lower()
    readers = {"ply": lambda: load(spark, path, strict="true").select("point_id", "x", "y", "z"), "xyz": lambda: read_xyz(spark, path), "obj": lambda: read_obj(spark, path), "npy": lambda: read_npy(spark, path)}
    if suffix not in readers:
        raise ValueError(f"no reader for .{suffix} files")
    cloud = readers[suffix]()
    if cloud.isEmpty():
        raise ValueError(f"{path} has no points")
    return cloud


def from_messages(messages: DataFrame, step_col: str = "point_step") -> DataFrame:
    """(frame_idx, point_id, x, y, z) of decoded point messages (frame_idx, data, point_step).

    A point's coordinates are little-endian float32 at bytes 0, 4 and 8; points with NaN are dropped, and
    so frames without points vanish.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, data, step in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data or b"") // step
                raw = np.frombuffer(data or b"", np.uint8, n * step).reshape(n, step)[:, :12]
                at = np.ascontiguousarray(raw).view("<f4").astype(float)
                good = np.flatnonzero(~np.isnan(at).any(axis=1))
                columns = [pa.array(np.full(len(good), frame, np.int64)), pa.array(good.astype(np.int64)), *[pa.array(at[good, k]) for k in range(3)]]
                yield pa.RecordBatch.from_arrays(columns, ["frame_idx", "point_id", "x", "y", "z"])

    rows = messages.select("frame_idx", "data", F.col(step_col).cast("int").alias("step"))
    return rows.mapInArrow(run, "frame_idx long, point_id long, x double, y double, z double")


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(ix, iy, iz, value) of a regular grid written by write_grid()."""
    return spark.read.parquet(path)


def write_grid(grid: DataFrame, path: str) -> None:
    grid.select("ix", "iy", "iz", "value").write.mode("overwrite").parquet(path)
