"""Sparse matrices as (i, j, v) rows and vectors as (i, v) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class NotConverged(RuntimeError):
    """An iteration that ended before it reached its tolerance."""


def multiply_vector(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of matrix times x; rows without entries are missing, as zeros are."""
    right = x.select(F.col("i").alias("j"), F.col("v").alias("xv"))
    return matrix.join(right, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("xv")).alias("v"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of a times b."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("av"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("bv"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("av") * F.col("bv")).alias("v"))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def axpy(x: DataFrame, y: DataFrame, a: float) -> DataFrame:
    """x + a y; missing entries are zeros."""
    return x.select("i", "v").unionByName(y.select("i", (F.col("v") * a).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))


def dot(x: DataFrame, y: DataFrame) -> float:
    return x.join(y.select("i", F.col("v").alias("w")), "i").agg(F.sum(F.col("v") * F.col("w"))).first()[0] or 0.0


def conjugate_gradient(matrix: DataFrame, b: DataFrame, rounds: int = 50, tolerance: float = 1e-10, report: Callable[[int, float], None] | None = None) -> DataFrame:
    """(i, v) that solves matrix x = b for a symmetric positive matrix. Only scalars reach the driver; vectors are checkpointed.

    Raises NotConverged if the residual is over tolerance times the length of b after so many rounds.
    """
    x = b.select("i", F.lit(0.0).alias("v"))
    r = b.select("i", "v").checkpoint()
    p, rr = r, dot(r, r)
    stop = tolerance * tolerance * rr
    for k in range(rounds):
        if rr <= stop:
            return x
        q = multiply_vector(matrix, p).checkpoint()
        step = rr / dot(p, q)
        x = axpy(x, p, step).checkpoint()
        r = axpy(r, q, -step).checkpoint()
        new = dot(r, r)
        p = axpy(r, p, new / rr).checkpoint()
        rr = new
        if report:
            report(k, rr)
    if rr > stop:
        raise NotConverged(f"a residual of {rr**0.5:.3g} after {rounds} rounds, where {stop**0.5:.3g} was asked for")
    return x


def jacobi(matrix: DataFrame, b: DataFrame, x: DataFrame, rounds: int = 1, damping: float = 1.0) -> DataFrame:
    """x after Jacobi iterations: x + damping * (b - matrix x) / diagonal."""
    diagonal = matrix.where("i = j").select("i", F.col("v").alias("d"))
    for _ in range(rounds):
        residual = axpy(b, multiply_vector(matrix, x), -1.0)
        step = residual.join(diagonal, "i").select("i", (F.col("v") / F.col("d")).alias("v"))
        x = axpy(x, step, damping).checkpoint()
    return x


def gauss_seidel(matrix: DataFrame, b: DataFrame, x: DataFrame, colours: DataFrame, rounds: int = 1) -> DataFrame:
    """x after coloured Gauss-Seidel iterations: the unknowns of one colour (i, c) at a time, in order of c.

    Unknowns of one colour must not be neighbours in the matrix; then each pass is exact.
    """
    order = [r[0] for r in colours.select("c").distinct().orderBy("c").collect()]  # a handful of colours
    for _ in range(rounds):
        for c in order:
            own = colours.where(F.col("c") == c).select("i")
            x = axpy(x, jacobi_step(matrix.join(own, "i", "left_semi"), b.join(own, "i", "left_semi"), x), 1.0).checkpoint()
    return x


def jacobi_step(matrix: DataFrame, b: DataFrame, x: DataFrame) -> DataFrame:
    """(b - matrix x) / diagonal for the rows of the matrix that are given."""
    diagonal = matrix.where("i = j").select("i", F.col("v").alias("d"))
    return axpy(b, multiply_vector(matrix, x), -1.0).join(diagonal, "i").select("i", (F.col("v") / F.col("d")).alias("v"))
