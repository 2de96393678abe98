"""The whole program as one plan: load, orient, reconstruct, trim, skeletonize, write."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cloudloom.operators import clouds, mesh, poisson, repair, skeleton, solver
from cloudloom.sources import ply, sinks


@dataclass(frozen=True)
class Options:
    distance: float | None = None
    preset: str = "l1"
    width_low: float | None = None
    width_high: float | None = None
    iterations: int = solver.ITERATIONS
    poisson: poisson.Options = field(default_factory=poisson.Options)
    trim: bool = False
    trim_threshold: float = repair.TRIM_THRESHOLD
    island_ratio: float = repair.ISLAND_RATIO
    remove_islands: bool = True
    skeleton: skeleton.Options = field(default_factory=skeleton.Options)
    #: Grid width of the simplification of meshes with too many faces, as a share of the longest side.
    simplify_cell: float = 0.01


@dataclass(frozen=True)
class Result:
    cloud: DataFrame
    vertices: DataFrame
    faces: DataFrame
    trimmed: tuple[DataFrame, DataFrame] | None
    skeleton: DataFrame


def orient(cloud: DataFrame, options: Options) -> DataFrame:
    """cloud with estimated normals, in its own coordinates."""
    unit = clouds.normalize(cloud.select("point_id", "x", "y", "z"))
    normals = solver.estimate_normals(unit, options.iterations, options.preset, options.width_low, options.width_high)
    return cloud.drop(*clouds.NORMAL).join(normals, "point_id")


def run(spark: SparkSession, source: str | DataFrame, options: Options | None = None, out: str | None = None) -> Result:
    """All stages over a PLY path or a cloud; with `out` each stage's result is written below it."""
    o = options or Options()
    cloud = ply.load(spark, source, o.distance) if isinstance(source, str) else source
    cloud = cloud.checkpoint()
    found = clouds.validate(cloud).first()
    if not found["ok"]:
        raise ValueError(f"the cloud fails on {found['error']} at point {found['point_id']}")
    oriented = orient(cloud, o).checkpoint()
    vertices, faces = (df.checkpoint() for df in poisson.reconstruct(oriented, o.poisson))
    trimmed = repair.trim(vertices, faces, o.trim_threshold, o.island_ratio, o.remove_islands) if o.trim else None
    # the skeleton is of the whole mesh, not of the trimmed one
    closed = repair.close(vertices, faces)
    if closed[1].count() > repair.MOST_FACES:
        box = clouds.extent(closed[0]).first()
        cell = o.simplify_cell * max(box[f"max_{c}"] - box[f"min_{c}"] for c in "xyz")
        closed = repair.close(*repair.simplify(*closed, cell))
    bones = skeleton.skeletons(*closed, o.skeleton).checkpoint()
    if out:
        sinks.write_snapshot(cloud, f"{out}/stage1_load")
        sinks.write_xyz_normals(oriented, f"{out}/stage2_normals")
        ply.write_mesh(vertices, faces, f"{out}/stage3_mesh/mesh.ply")
        if trimmed:
            ply.write_mesh(*trimmed, f"{out}/stage4_trim/mesh.ply")
        sinks.write_skeleton(bones, skeleton.edges_of(bones).select("a", "b"), closed[0], f"{out}/stage5_skeleton")
    return Result(cloud, vertices, faces, trimmed, bones)


def closedness(result: Result) -> DataFrame:
    return mesh.is_closed(result.faces)
