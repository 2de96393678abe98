"""What several operators need: the shared folder, cut lineage, files in it, and Arrow maps over whole columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions.names import free_names  # noqa: F401  for the operators
from cloudloom.session import shared_dir

#: Class of characters that part words; the same six as bytes.split() takes.
SPACE_CLASS = r"[ \t-\r]"
SPACES = " \t\n\x0b\f\r"
#: Bytes of text that a Python function gets at a time.
BATCH_BYTES = 32 << 20
#: Rows of a few narrow columns that may be broadcast: some 50 MB.
BROADCAST_ROWS = 500_000


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and lost executors can't undo it."""
    spark, out = df.sparkSession, new_folder(df.sparkSession, name)
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


def file_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI of the shared folder, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; any others of df, clashing ones too, stay out."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def byte_slices(batches: Iterator[pa.RecordBatch], most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches of at most most_bytes bytes of strings, or of one longer row; empty ones are passed over.

    Arrow batches are bounded by rows. A Python function that takes whole texts needs a bound in bytes.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type):
                sizes += np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        ends, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most_bytes, side="right")))
            yield batch.slice(first, last - first)
            first = last


def map_batches(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches):
            if (out := per_batch(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def joined_to_few(rows: DataFrame, few: DataFrame, key: str, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """rows left joined to `few`, which holds each key once. few: a written narrow table, broadcast if its count is under the bound.

    Beyond the bound both sides are shuffled by the key; the side of the rows, where one key may be frequent, is
    the streamed one, which adaptive execution splits.
    """
    small = few.count() <= most_rows
    return rows.join(F.broadcast(few) if small else few.hint("merge"), key, "left")
