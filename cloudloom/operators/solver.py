"""Globally consistent normals by annealed steepest descent on the winding-number equation.

An iteration makes r = AT(0.5 - A mu), the step length <r, r> / <A r, A r>, the update, and new directions
from G mu at kept lengths. As G is linear, G of the update is made of G mu and G r, which are worked out in
the passes that make A mu and A r: three passes an iteration. What interacts with what is found once
(nbody.Interactions); a cloud of at most `most_local` points, checked by a count, has its attributes
broadcast for each pass, and a larger one keeps them in tables, by the same rule and with the same results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import nbody

ITERATIONS = 40
#: Least and greatest smoothing width of each preset.
WIDTHS = {"l0": (0.002, 0.016), "l1": (0.01, 0.04), "l2": (0.02, 0.08), "l3": (0.03, 0.12), "l4": (0.04, 0.16), "l5": (0.05, 0.2)}
MOST_LOCAL = 500_000
#: Groups of a slice of a local pass, at least.
SLICE = 8


def widths(preset: str, low: float | None = None, high: float | None = None) -> tuple[float, float]:
    """Least and greatest width of a preset, or of "custom"."""
    if preset == "custom":
        if low is None or high is None or low > high:
            raise ValueError("custom widths need 0 < low <= high")
        return low, high
    if preset not in WIDTHS:
        raise ValueError(f"no preset {preset}; there are {', '.join(WIDTHS)} and custom")
    return WIDTHS[preset]


def annealed(k: int, iterations: int, low: float, high: float) -> float:
    """The width of iteration k: from high to low in equal steps."""
    return high if iterations <= 1 else high + (low - high) * k / (iterations - 1)


def residual_norms(r: DataFrame, ar: DataFrame) -> DataFrame:
    """One row (rr, arar): the squared lengths of the vectors (vx, vy, vz) of r and of the values of ar."""
    rr = r.agg(F.coalesce(F.sum(G.dot(*[[F.col(c) for c in ("vx", "vy", "vz")]] * 2)), F.lit(0.0)).alias("rr"))
    return rr.join(ar.agg(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)).alias("arar")))


Asked = list[tuple[str, np.ndarray]]


def iterate(mu: np.ndarray, apply: Callable[[Asked, float], list[np.ndarray]], width: float) -> np.ndarray | None:
    """One iteration on arrays; None where A r is zero. apply([(kind, attributes), ...], width) gives operators' values at all points."""
    a, turned = apply([("A", mu), ("G", mu)], width) if mu.any() else (np.zeros((len(mu), 1)), np.zeros_like(mu))
    (r,) = apply([("AT", 0.5 - a)], width)
    ar, turned_r = apply([("A", r), ("G", r)], width)
    square = float((ar * ar).sum())
    if square == 0.0:
        return None
    step = float((r * r).sum()) / square
    mu, turned = mu + step * r, turned + step * turned_r
    length = np.sqrt((mu * mu).sum(axis=1, keepdims=True))
    size = np.sqrt((turned * turned).sum(axis=1, keepdims=True))
    return np.where(size > G.EPSILON, turned / np.where(size > 0, size, 1.0) * length, 0.0)


def estimate_normals(
    cloud: DataFrame, iterations: int = ITERATIONS, preset: str = "l0", low: float | None = None, high: float | None = None, cap: int = 8,
    depth: int = 15, progress: Callable[[int, float], None] | None = None, most_local: int = MOST_LOCAL,
) -> DataFrame:
    """(point_id, nx, ny, nz): unit normals of a cloud in [-1, 1]**3, outward where the cloud is a closed surface."""
    low, high = widths(preset, low, high)
    points = cloud.select("point_id", "x", "y", "z")
    if points.limit(most_local + 1).count() <= most_local:
        return _local(points, iterations, low, high, cap, depth, progress)
    return _distributed(points, iterations, low, high, cap, depth, progress)


_kept: dict[str, nbody.Interactions] = {}


def _interactions(name: str, tree: nbody.Tree) -> nbody.Interactions:
    """The worker's interactions of a solve; those of earlier solves go."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = nbody.Interactions(tree)
    return _kept[name]


def _local(points: DataFrame, iterations: int, low: float, high: float, cap: int, depth: int, progress) -> DataFrame:
    spark = points.sparkSession
    context = spark.sparkContext
    rows = points.orderBy("point_id").toPandas()
    tree = nbody.Tree(rows[["x", "y", "z"]].to_numpy(float), depth, cap)
    held, name = context.broadcast(tree), uuid.uuid4().hex
    weight = (tree.end - tree.start)[tree.groups].cumsum()
    parts = max(1, min(context.defaultParallelism, len(tree.groups) // SLICE))
    bounds = np.searchsorted(weight, np.linspace(0, weight[-1] if len(weight) else 0, parts + 1)[1:-1])
    # jobs are many and short here: a plan for each would cost more than the work
    slices = context.parallelize([g.tolist() for g in np.split(tree.groups, bounds)], parts)

    def apply(asked: Asked, width: float) -> list[np.ndarray]:
        sent = context.broadcast([(kind, a, tree.sums(a)) for kind, a in asked])

        def run(part) -> list[list[bytes]]:
            return [[v.tobytes() for v in _interactions(name, held.value).apply(groups, sent.value, width)] for groups in part if groups]

        found = slices.mapPartitions(run).collect()
        sent.destroy()
        sizes = [nbody.KINDS[kind][1] for kind, _ in asked]
        return [np.concatenate([np.frombuffer(f[k]).reshape(-1, size) for f in found]) for k, size in enumerate(sizes)]

    mu = np.zeros((len(rows), 3))  # in the tree's order
    for k in range(iterations):
        width = annealed(k, iterations, low, high)
        new = iterate(mu, apply, width) if len(rows) else None
        if new is None:
            break
        mu = new
        if progress:
            progress(k, width)
    length = np.sqrt((mu * mu).sum(axis=1, keepdims=True))
    unit = np.empty_like(mu)
    unit[tree.order] = np.where(length > G.EPSILON, mu / np.where(length > 0, length, 1.0), 0.0)
    out = pd.DataFrame({"point_id": rows["point_id"].astype("int64"), "nx": unit[:, 0], "ny": unit[:, 1], "nz": unit[:, 2]})
    return spark.createDataFrame(out, "point_id long, nx double, ny double, nz double")


def _distributed(points: DataFrame, iterations: int, low: float, high: float, cap: int, depth: int, progress) -> DataFrame:
    points = points.checkpoint()
    lists = nbody.GroupLists(points, depth, cap)
    mu = points.select("point_id", *[F.lit(0.0).alias(c) for c in ("mx", "my", "mz")]).checkpoint()
    for k in range(iterations):
        width = annealed(k, iterations, low, high)
        defect = lists.apply("A", mu, width).select("point_id", (0.5 - F.col("value")).alias("s"))
        r = lists.apply("AT", defect, width).checkpoint()
        norms = residual_norms(r, lists.apply("A", r.withColumnsRenamed({f"v{c}": f"m{c}" for c in "xyz"}), width)).first()
        if not norms["arar"]:
            break
        step = norms["rr"] / norms["arar"]
        moved = mu.join(r, "point_id").select("point_id", *[(F.col(f"m{c}") + step * F.col(f"v{c}")).alias(f"m{c}") for c in "xyz"]).checkpoint()
        v, m = [F.col(f"v{c}") for c in "xyz"], [F.col(f"m{c}") for c in "xyz"]
        turned = [F.when(G.norm(v) > G.EPSILON, F.col(f"v{c}") / G.norm(v) * G.norm(m)).otherwise(0.0).alias(f"m{c}") for c in "xyz"]
        mu = moved.join(lists.apply("G", moved, width), "point_id").select("point_id", *turned).checkpoint()
        if progress:
            progress(k, width)
    unit = G.normalized([F.col(f"m{c}") for c in "xyz"])
    return mu.select("point_id", *[u.alias(f"n{c}") for u, c in zip(unit, "xyz", strict=True)])
