"""Incremental decimation: points arrive as a stream, and the first of each grid cell passes on.

Which point comes first depends on arrival, so the set of cells is defined and the survivors are not.
The state is a key for each occupied cell. Structured Streaming keeps it in its state store, with
checkpoints; a watermark on an event time bounds it where old cells may be forgotten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.clouds import finite_points, with_cells

CELLS = ("ix", "iy", "iz")


def first_per_cell(points: DataFrame, distance: float, time_col: str | None = None, forget_after: str | None = None) -> DataFrame:
    """The streaming points with finite coordinates, one a cell. With a time column, a cell is forgotten after a while."""
    rows = with_cells(finite_points(points), distance)
    if time_col and forget_after:
        rows = rows.withWatermark(time_col, forget_after).dropDuplicatesWithinWatermark(list(CELLS))
    else:
        rows = rows.dropDuplicates(list(CELLS))
    return rows.drop(*CELLS)


def cell_counts(points: DataFrame, distance: float, time_col: str, window: str, late: str) -> DataFrame:
    """(window, ix, iy, iz, n): points by cell and time window; rows later than `late` are left out."""
    rows = with_cells(finite_points(points), distance).withWatermark(time_col, late)
    return rows.groupBy(F.window(time_col, window).alias("window"), *CELLS).agg(F.count("*").alias("n"))


def frames(points: DataFrame, distance: float) -> DataFrame:
    """The first point of each cell of each frame, for streams of frames (frame_idx, ...)."""
    return with_cells(finite_points(points), distance).dropDuplicates(["frame_idx", *CELLS]).drop(*CELLS)
