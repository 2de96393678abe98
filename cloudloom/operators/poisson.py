"""Screened Poisson reconstruction on a uniform grid, and its level set as a mesh.

Samples are splatted with quadratic B-spline weights onto the cells of a 2**depth grid; the divergence
of the splatted normals and screening terms at the samples give a sparse system, which conjugate
gradients or multigrid solve; the level set at the samples' weighted mean value is extracted cell by
cell. The grid is uniform where an adaptive solver refines by samples: results have the same meaning
but not the same vertices.
"""

from __future__ import annotations

from dataclasses import dataclass


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import clouds, linalg

BOUNDARIES = ("free", "dirichlet", "neumann")


@dataclass(frozen=True)
class Options:
    depth: int = 5
    degree: int = 1
    #: 1 free, 2 Dirichlet, 3 Neumann.
    boundary: int = 3
    point_weight: float = 2.0
    samples_per_node: float = 1.5
    confidence: bool = False
    scale: float = 1.1
    rounds: int = 200
    solver: str = "grid"

    def resolved(self) -> Options:
        """These options, checked; the kernel depth follows the grid's."""
        if self.degree != 1:
            raise ValueError("degree is 1: the grid's stencil has no other")
        if self.boundary not in (1, 2, 3):
            raise ValueError("boundary is 1 (free), 2 (Dirichlet) or 3 (Neumann)")
        if not 1 <= self.depth <= 9:
            raise ValueError("depth is from 1 to 9")
        return self

    @property
    def kernel_depth(self) -> int:
        return max(1, self.depth - 2)


def valid_samples(cloud: DataFrame) -> DataFrame:
    """Points with a usable normal, at unit length; `w` is the old length."""
    n = clouds.cols(clouds.NORMAL)
    unit = G.normalized(n)
    good = cloud.where(G.is_finite(*clouds.cols()) & G.valid_normal(n))
    return good.select("point_id", *"xyz", G.norm(n).alias("w"), *[u.alias(c) for u, c in zip(unit, clouds.NORMAL, strict=True)])


def bin_samples(samples: DataFrame, depth: int, confidence: bool = False) -> DataFrame:
    """(ix, iy, iz) cells of the unit cube with summed weight, weighted mean position and summed weighted normal."""
    w = F.col("w") if confidence else F.lit(1.0)
    cells = {f"i{c}": F.floor(F.col(c) * float(1 << depth)).cast("int") for c in "xyz"}
    total = F.sum(w)
    return (
        samples.withColumns(cells)
        .groupBy("ix", "iy", "iz")
        .agg(total.alias("weight"), *[(F.sum(F.col(c) * w) / total).alias(c) for c in "xyz"], *[F.sum(F.col(c) * w).alias(c) for c in clouds.NORMAL])
    )


def splat(samples: DataFrame, depth: int, values: list[str]) -> DataFrame:
    """(ix, iy, iz) cells with the values spread by quadratic B-spline weights over each sample's 27 nearest cells."""
    n = float(1 << depth)
    at = samples.select(*values, *[(F.col(c) * n).alias(c) for c in "xyz"])
    at = at.withColumns({f"l{c}": F.floor(c) for c in "xyz"}).withColumns({f"t{c}": F.col(c) - F.col(f"l{c}") for c in "xyz"})

    def axis(c: str) -> Column:
        return F.array(*[F.struct((F.col(f"l{c}") + k - 1).cast("int").alias("i"), w.alias("w")) for k, w in enumerate(G.bspline_weights(F.col(f"t{c}")))])

    # explode() would also push a filter with these expressions written out down to the scan; the outer form doesn't
    rows = at.select(*values, *[axis(c).alias(f"b{c}") for c in "xyz"]).withColumn("ax", F.explode_outer("bx"))
    rows = rows.withColumn("ay", F.explode_outer("by")).withColumn("az", F.explode_outer("bz"))
    weight = F.col("ax.w") * F.col("ay.w") * F.col("az.w")
    keys = [F.col(f"a{c}.i").alias(f"i{c}") for c in "xyz"]
    return rows.groupBy(*keys).agg(*[F.sum(F.col(v) * weight).alias(v) for v in values])


def density(samples: DataFrame, depth: int) -> DataFrame:
    """(ix, iy, iz, density): splatted number of samples by cell."""
    return splat(samples.withColumn("density", F.lit(1.0)), depth, ["density"])


def sample_depth(samples: DataFrame, depth: int, samples_per_node: float) -> DataFrame:
    """samples with sample_depth, at which a cell would hold so many samples, and the weight that evens out their density."""
    d = density(samples, depth)
    cells = {f"i{c}": F.floor(F.col(c) * float(1 << depth)).cast("int") for c in "xyz"}
    found = samples.withColumns(cells).join(d, ["ix", "iy", "iz"]).drop("ix", "iy", "iz")
    # a surface crosses a cell in proportion to its area: a level up has four times the samples
    level = F.lit(float(depth)) + F.log(F.col("density") / samples_per_node) / float(np.log(4.0))
    return found.withColumns({"sample_depth": F.least(level, F.lit(float(depth))), "even": 1.0 / F.col("density")}).drop("density")


def normal_field(samples: DataFrame, depth: int) -> DataFrame:
    """(ix, iy, iz, nx, ny, nz): the splatted inward field, each sample weighed by the area that it stands for."""
    kernel = max(1, depth - 2)
    even = sample_depth(samples, kernel, 1.0)
    # a sample's share of a kernel cell's face, over the volume of a grid cell: the field integrates to a jump of one
    share = 8.0**depth / 4.0**kernel
    area = [(-F.col(c) * F.col("even") * share).alias(c) for c in clouds.NORMAL]
    return splat(even.select(*"xyz", *area), depth, list(clouds.NORMAL))


def divergence(field: DataFrame, depth: int) -> DataFrame:
    """(ix, iy, iz, v): central differences of a field on cells."""
    n = float(1 << depth)
    parts = None
    for axis, c in zip("xyz", clouds.NORMAL, strict=True):
        for step in (-1, 1):
            moved = field.select(*[(F.col(f"i{k}") + (step if k == axis else 0)).alias(f"i{k}") for k in "xyz"], (F.col(c) * (-step * n / 2.0)).alias("v"))
            parts = moved if parts is None else parts.unionByName(moved)
    return parts.groupBy("ix", "iy", "iz").agg(F.sum("v").alias("v"))


def cell_id(depth: int) -> Column:
    n = 1 << depth
    return ((F.col("ix").cast("long") * n + F.col("iy")) * n + F.col("iz")).alias("i")


def inside(depth: int) -> Column:
    n = 1 << depth
    return F.col("ix").between(0, n - 1) & F.col("iy").between(0, n - 1) & F.col("iz").between(0, n - 1)


def laplacian(grid: DataFrame, depth: int, boundary: str) -> DataFrame:
    """(i, j, v) of the negative seven-point Laplacian on all cells of the grid (ix, iy, iz)."""
    n = 1 << depth
    h2 = float(n * n)
    steps = [tuple(s if k == a else 0 for k in range(3)) for a in range(3) for s in (-1, 1)]
    moved = grid.select("ix", "iy", "iz", F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("xyz", s, strict=True)]) for s in steps])).alias("s"))
    near = moved.select(cell_id(depth), *[(F.col(f"i{c}") + F.col(f"s.{c}")).alias(f"i{c}") for c in "xyz"])
    outside = ~inside(depth)
    diagonal = near.groupBy("i").agg(F.sum(F.when(outside, 2.0 * h2 if boundary == "dirichlet" else 0.0).otherwise(h2)).alias("v"))
    entries = near.where(inside(depth)).select("i", cell_id(depth).alias("j"), F.lit(-h2).alias("v"))
    return entries.unionByName(diagonal.select("i", F.col("i").alias("j"), "v"))


def full_grid(spark, depth: int) -> DataFrame:
    n = 1 << depth
    return spark.range(n**3).select(*[((F.col("id") / n**k).cast("long") % n).cast("int").alias(f"i{c}") for c, k in (("x", 2), ("y", 1), ("z", 0))])


def solve(samples: DataFrame, options: Options) -> DataFrame:
    """(ix, iy, iz, value): the implicit function at the cells' centres, for samples in the unit cube.

    solver "grid" holds the grid in one task (8**depth cells, checked by the depth's bound), where a
    multigrid cycle costs seconds; "cg" keeps matrix and vectors as tables of any size.
    """
    o = options.resolved()
    spark, depth = samples.sparkSession, o.depth
    right = divergence(normal_field(samples, depth), depth).where(inside(depth)).withColumn("v", -F.col("v"))
    bins = bin_samples(samples, depth, o.confidence).where(inside(depth))
    # screening: at the samples the function is to be one half
    total = bins.agg(F.sum("weight")).first()[0] or 1.0
    screen = bins.select("ix", "iy", "iz", (F.col("weight") * (o.point_weight * 8.0**depth / total)).alias("s"))
    boundary = BOUNDARIES[o.boundary - 1]
    if o.solver == "cg":
        grid = full_grid(spark, depth)
        s = screen.select(cell_id(depth), "s")
        matrix = laplacian(grid, depth, boundary).unionByName(s.select("i", F.col("i").alias("j"), F.col("s").alias("v"))).groupBy("i", "j").agg(F.sum("v").alias("v")).checkpoint()
        b = right.select(cell_id(depth), "v").unionByName(s.select("i", (F.col("s") * 0.5).alias("v"))).groupBy("i").agg(F.sum("v").alias("v"))
        x = linalg.conjugate_gradient(matrix, b, o.rounds, 1e-6)
        return grid.withColumn("i", cell_id(depth)).join(x, "i", "left").select("ix", "iy", "iz", F.coalesce("v", F.lit(0.0)).alias("value"))
    rows = right.join(screen, ["ix", "iy", "iz"], "full").na.fill(0.0).select(F.lit(0).alias("g"), "ix", "iy", "iz", "v", "s")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        n = 1 << depth
        b, s = np.zeros((n, n, n)), np.zeros((n, n, n))
        at = tuple(frame[c].to_numpy() for c in ("ix", "iy", "iz"))
        b[at], s[at] = frame["v"], frame["s"]
        x = solve_grid(b + 0.5 * s, s, boundary, o.rounds)
        ix, iy, iz = np.indices(x.shape).reshape(3, -1).astype(np.int32)
        return pd.DataFrame({"ix": ix, "iy": iy, "iz": iz, "value": x.ravel()})

    return rows.groupBy("g").applyInPandas(one, "ix int, iy int, iz int, value double")


def apply_laplacian(x: np.ndarray, boundary: str) -> np.ndarray:
    """The negative seven-point Laplacian of a cubic grid over the unit cube."""
    h2 = float(x.shape[0] ** 2)
    out = np.zeros_like(x)
    for a in range(3):
        y, o = np.moveaxis(x, a, 0), np.moveaxis(out, a, 0)
        d = (y[1:] - y[:-1]) * h2
        o[1:] += d
        o[:-1] -= d
        if boundary == "dirichlet":
            o[0] += 2 * h2 * y[0]
            o[-1] += 2 * h2 * y[-1]
    return out


def _diagonal(n: int, s: np.ndarray, boundary: str) -> np.ndarray:
    h2, d = float(n * n), s.copy()
    for a in range(3):
        part = np.full(n, 2.0 * h2)
        if n > 1:
            part[[0, -1]] = 3.0 * h2 if boundary == "dirichlet" else h2
        d += part.reshape([-1 if k == a else 1 for k in range(3)])
    return np.maximum(d, 1e-12)


def relax(x: np.ndarray, b: np.ndarray, s: np.ndarray, boundary: str, sweeps: int) -> np.ndarray:
    """Red-black Gauss-Seidel sweeps."""
    d = _diagonal(len(x), s, boundary)
    parity = np.indices(x.shape).sum(axis=0) % 2
    for _ in range(sweeps):
        for colour in (0, 1):
            step = (b - apply_laplacian(x, boundary) - s * x) / d
            x = np.where(parity == colour, x + step, x)
    return x


def down_sample(x: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 x 2 cells."""
    n = len(x) // 2
    return x.reshape(n, 2, n, 2, n, 2).mean(axis=(1, 3, 5))


def up_sample(x: np.ndarray) -> np.ndarray:
    """Each cell eight times."""
    return x.repeat(2, 0).repeat(2, 1).repeat(2, 2)


def v_cycle(x: np.ndarray, b: np.ndarray, s: np.ndarray, boundary: str, sweeps: int = 4) -> np.ndarray:
    """One multigrid cycle."""
    x = relax(x, b, s, boundary, sweeps if len(x) > 2 else 40)
    if len(x) > 2:
        r = b - apply_laplacian(x, boundary) - s * x
        x = x + up_sample(v_cycle(np.zeros_like(down_sample(x)), down_sample(r), down_sample(s), boundary, sweeps))
        x = relax(x, b, s, boundary, sweeps)
    return x


def solve_grid(b: np.ndarray, s: np.ndarray, boundary: str, rounds: int = 200, tolerance: float = 1e-6, start: bool = False) -> np.ndarray:
    """Cascadic start from coarse grids, then conjugate gradients with a multigrid cycle as preconditioner.

    Raises NotConverged if the residual is over tolerance times the length of b after so many rounds, but
    where the result is only the start of a finer grid.
    """
    x = np.zeros_like(b) if len(b) <= 2 else up_sample(solve_grid(down_sample(b), down_sample(s), boundary, 3, tolerance, True))
    r = b - apply_laplacian(x, boundary) - s * x
    limit, p, rho = tolerance * np.linalg.norm(b), None, 0.0
    for _ in range(rounds):
        if np.linalg.norm(r) <= limit:
            return x
        z = v_cycle(np.zeros_like(r), r, s, boundary)
        new = float((r * z).sum())
        p = z if p is None or rho == 0 else z + max(0.0, new / rho) * p
        q = apply_laplacian(p, boundary) + s * p
        curve = float((p * q).sum())
        if curve <= 0:
            break
        x, r, rho = x + new / curve * p, r - new / curve * q, new
    if not start and np.linalg.norm(r) > limit:
        raise linalg.NotConverged(f"a residual of {np.linalg.norm(r):.3g} after {rounds} rounds, where {limit:.3g} was asked for")
    return x


def values_at(samples: DataFrame, grid: DataFrame, depth: int) -> DataFrame:
    """samples with `value`: the grid's function, multilinear between cell centres; border cells go on outside."""
    n = 1 << depth
    rows = samples
    for c in "xyz":
        at = F.col(c) * float(n) - 0.5
        low = F.floor(at)
        pair = F.array(*[F.struct(F.greatest(F.least(low + k, F.lit(n - 1)), F.lit(0)).cast("int").alias("i"), (1.0 - F.abs(at - low - k)).alias("w")) for k in (0, 1)])
        rows = rows.withColumn(f"a{c}", F.explode_outer(pair))
    rows = rows.select("point_id", *[F.col(f"a{c}.i").alias(f"i{c}") for c in "xyz"], (F.col("ax.w") * F.col("ay.w") * F.col("az.w")).alias("__w"))
    values = rows.join(grid, ["ix", "iy", "iz"]).groupBy("point_id").agg(F.sum(F.col("__w") * F.col("value")).alias("value"))
    return samples.join(values, "point_id")


def iso_value(samples: DataFrame, grid: DataFrame, depth: int, confidence: bool = False) -> DataFrame:
    """One row (iso): the weighted mean of the function at the samples."""
    w = F.col("w") if confidence else F.lit(1.0)
    return values_at(samples, grid, depth).agg((F.sum(w * F.col("value")) / F.sum(w)).alias("iso"))


def grid_average(grid: DataFrame) -> DataFrame:
    return grid.agg(F.avg("value").alias("average"))


#: The corners of a cube by bits x, y, z, and its faces as rings of corners, outward.
CORNERS = [(k & 1, k >> 1 & 1, k >> 2 & 1) for k in range(8)]
FACES = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]


def square_segments(inside: tuple[bool, ...]) -> list[tuple[int, int]]:
    """Marching squares by rule: from each edge where a ring of four goes in to the next where it goes out.

    Edge k runs from corner k to the next. Of the two ways to join four crossings, this one keeps
    inside corners apart, whichever side the square is seen from.
    """
    enters = [k for k in range(4) if not inside[k] and inside[(k + 1) % 4]]
    return [(k, next((k + step) % 4 for step in range(1, 4) if inside[(k + step) % 4] and not inside[(k + step + 1) % 4])) for k in enters]


def cube_loops(case: int) -> list[list[tuple[int, int]]]:
    """The closed loops of a cube whose corners with bits in `case` are inside, each a ring of cube edges (low, high)."""
    following: dict[tuple[int, int], tuple[int, int]] = {}
    for ring in FACES:
        for a, b in square_segments(tuple(bool(case >> c & 1) for c in ring)):
            edge = lambda k, ring=ring: tuple(sorted((ring[k], ring[(k + 1) % 4])))
            following[edge(a)] = edge(b)
    loops = []
    while following:
        start, nxt = next(iter(following.items()))
        loop = [start]
        del following[start]
        while nxt != start:
            loop.append(nxt)
            nxt = following.pop(nxt)
        loops.append(loop)
    return loops


def _cases(spark) -> DataFrame:
    """(case, loop, k, low, high) of all cube cases: built by rule, at most a few thousand rows."""
    rows = [(case, n, k, *e) for case in range(256) for n, loop in enumerate(cube_loops(case)) for k, e in enumerate(loop)]
    return spark.createDataFrame(rows, "case int, loop int, k int, low int, high int")


def level_set(grid: DataFrame, iso: float, depth: int) -> tuple[DataFrame, DataFrame]:
    """The level set as (vertices(vid, x, y, z), faces(fid, vids)) in the unit cube; inside is above the iso-value.

    Cell centres are the corners of the dual grid's cubes. A border of outside corners closes the mesh.
    Edges that the level crosses become vertices, cubes become loops by their case, all by equi-joins.
    """
    from cloudloom.operators.octree import with_places

    n, spark = 1 << depth, grid.sparkSession
    # corners shift by one so that the border has indices 0 and n + 1
    side = n + 2
    values = grid.select(*[(F.col(f"i{c}") + 1).cast("int").alias(f"i{c}") for c in "xyz"], (F.col("value") - iso).alias("d"))
    corner = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(c) for c, v in zip("xyz", CORNERS[k], strict=True)]) for k in range(8)])
    key = lambda at, by=side: (at[0].cast("long") * by + at[1]) * by + at[2]
    cubes = values.where("d > 0").select(*[f"i{c}" for c in "xyz"], F.explode(corner).alias("s"))
    cubes = cubes.select(*[(F.col(f"i{c}") - F.col(f"s.{c}")).cast("int").alias(f"c{c}") for c in "xyz"], F.pow(F.lit(2), F.col("s.k")).cast("int").alias("bit"))
    cubes = cubes.groupBy("cx", "cy", "cz").agg(F.sum("bit").cast("int").alias("case")).where("case < 255")
    loops = cubes.join(F.broadcast(_cases(spark)), "case")
    at = F.array(*[F.array(*[F.lit(v) for v in CORNERS[k]]) for k in range(8)])
    ends = {}
    for end in ("low", "high"):
        place = [F.col(f"c{c}") + F.get(F.get(at, F.col(end)), F.lit(a)) for a, c in enumerate("xyz")]
        ends[end] = key(place)
    loops = loops.withColumns({"a": F.least(ends["low"], ends["high"]), "b": F.greatest(ends["low"], ends["high"])})
    loops = loops.select(key([F.col("cx"), F.col("cy"), F.col("cz")]).alias("cube"), "loop", "k", "a", "b").checkpoint()
    known = values.select(key([F.col("ix"), F.col("iy"), F.col("iz")]).alias("p"), "d")
    edges = loops.select("a", "b").distinct()
    for end in "ab":
        edges = edges.join(known.select(F.col("p").alias(end), F.col("d").alias(f"d{end}")), end, "left")
    # outside the grid the function lies as far below the level as the corner before it lies above
    edges = edges.withColumns({"da": F.coalesce("da", -F.col("db")), "db": F.coalesce("db", -F.col("da"))})
    t = F.greatest(F.least(F.col("da") / (F.col("da") - F.col("db")), F.lit(1.0)), F.lit(0.0))
    split = lambda c: [(F.col(c) / (side * side)).cast("long"), (F.col(c) / side).cast("long") % side, F.col(c) % side]
    place = [((p * (1.0 - t) + q * t) - 0.5) / float(n) for p, q in zip(split("a"), split("b"), strict=True)]
    vertices = with_places(edges.select("a", "b", *[v.alias(c) for v, c in zip(place, "xyz", strict=True)]), ["a", "b"], "vid")
    ids = loops.join(vertices.select("a", "b", "vid"), ["a", "b"])
    rings = ids.groupBy("cube", "loop").agg(F.sort_array(F.collect_list(F.struct("k", "vid"))).alias("r"))  # at most 12 corners
    faces = with_places(rings.select("cube", "loop", F.col("r.vid").alias("vids")), ["cube", "loop"], "fid")
    return vertices.select("vid", "x", "y", "z"), faces.select("fid", "vids")


#: Corners of a ring that is triangulated at once; longer rings are parted by short chords first.
MOST_CORNERS = 256


def polygon_triangles(points: np.ndarray) -> list[tuple[int, int, int]]:
    """The triangulation of a polygon in space with the least total area, by dynamic programming over its chords.

    That takes n**3 steps. A ring of over MOST_CORNERS corners is first parted along the shortest of the
    chords that leave a quarter of it on either side, tried from 64 corners, until its parts are short: a
    whole triangulation, each part of least area, but not the least of all.
    """
    out: list[tuple[int, int, int]] = []
    todo = [np.arange(len(points))]
    while todo:
        ring = todo.pop()
        n = len(ring)
        if n <= MOST_CORNERS:
            out += [(int(ring[a]), int(ring[b]), int(ring[c])) for a, b, c in _least_area(points[ring])]
            continue
        own = points[ring]
        starts, steps = np.unique(np.linspace(0, n - 1, 64).astype(int)), np.arange(n // 4, n - n // 4 + 1)
        ends = (starts[:, None] + steps) % n
        length = ((own[ends] - own[starts][:, None]) ** 2).sum(axis=2)
        k, j = divmod(int(length.argmin()), len(steps))
        a, b = sorted((int(starts[k]), int(ends[k, j])))
        todo += [ring[a : b + 1], np.concatenate((ring[b:], ring[: a + 1]))]
    return out


def _least_area(points: np.ndarray) -> list[tuple[int, int, int]]:
    n = len(points)
    if n < 3:
        return []
    if n == 3:
        return [(0, 1, 2)]
    cost, middle = np.zeros((n, n)), np.zeros((n, n), dtype=np.int64)
    for gap in range(2, n):
        a = np.arange(n - gap)
        b, c = a[:, None] + np.arange(1, gap), a + gap
        u, v = points[b] - points[a][:, None], (points[c] - points[a])[:, None]
        x, y, z = u[..., 1] * v[..., 2] - u[..., 2] * v[..., 1], u[..., 2] * v[..., 0] - u[..., 0] * v[..., 2], u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
        total = cost[a[:, None], b] + cost[b, c[:, None]] + np.sqrt(x * x + y * y + z * z) / 2
        best = total.argmin(axis=1)
        cost[a, c], middle[a, c] = total[a, best], a + 1 + best
    out, todo = [], [(0, n - 1)]
    while todo:
        a, c = todo.pop()
        if c - a >= 2:
            b = int(middle[a, c])
            out.append((a, b, c))
            todo += [(a, b), (b, c)]
    return out


def triangulate(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, vids) with all faces as triangles of least area; faces under three corners go. New ids are places in the order of the old ones.

    A face goes to Python with its corners' places; faces here have few corners.
    """
    from cloudloom.operators.mesh import corners
    from cloudloom.operators.octree import with_places

    rings = corners(faces, vertices.select("vid", "x", "y", "z")).groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("k", "vid", "x", "y", "z"))).alias("ring"))

    def run(frames):
        for frame in frames:
            out = []
            for fid, ring in zip(frame["fid"], frame["ring"], strict=True):
                points = np.array([[r["x"], r["y"], r["z"]] for r in ring])
                out += [(fid, k, [int(ring[v]["vid"]) for v in t]) for k, t in enumerate(polygon_triangles(points))]
            yield pd.DataFrame(out, columns=["old", "part", "vids"])

    parts = rings.mapInPandas(run, "old long, part int, vids array<bigint>")
    return with_places(parts, ["old", "part"], "fid").select("fid", "vids")


def reconstruct(cloud: DataFrame, options: Options | None = None) -> tuple[DataFrame, DataFrame]:
    """The mesh of an oriented cloud: vertices(vid, x, y, z, value) in the cloud's own frame, value the sample density, and triangles.

    The density's logarithm to base 4 is relative to the grid: one more means samples twice as close.
    """
    o = (options or Options()).resolved()
    samples = valid_samples(cloud).checkpoint()
    row = clouds.extent(samples).first()
    low, high = [row[f"min_{c}"] for c in "xyz"], [row[f"max_{c}"] for c in "xyz"]
    if any(v is None for v in low):
        raise ValueError("a cloud without usable normals")
    size = o.scale * max(h - v for v, h in zip(low, high, strict=True)) or 1.0
    start = [(v + h) / 2 - size / 2 for v, h in zip(low, high, strict=True)]
    unit = samples.withColumns({c: (F.col(c) - s) / size for c, s in zip("xyz", start, strict=True)}).checkpoint()
    grid = solve(unit, o).checkpoint()
    iso = iso_value(unit, grid, o.depth, o.confidence).first()["iso"]
    vertices, polygons = level_set(grid, iso, o.depth)
    vertices = vertices.checkpoint()
    d = density(unit, o.kernel_depth)
    cells = {f"i{c}": F.floor(F.col(c) * float(1 << o.kernel_depth)).cast("int") for c in "xyz"}
    value = F.greatest(F.lit(0.0), o.kernel_depth + F.log(F.coalesce("density", F.lit(1e-9)) / o.samples_per_node) / float(np.log(4.0)))
    valued = vertices.withColumns(cells).join(d, ["ix", "iy", "iz"], "left").withColumn("value", value)
    back = {c: F.col(c) * size + s for c, s in zip("xyz", start, strict=True)}
    return valued.withColumns(back).select("vid", "x", "y", "z", "value"), triangulate(polygons, vertices)


def evaluate_on(grid_depth: int, spark, f) -> DataFrame:
    """(ix, iy, iz, value) of f(x, y, z) on all cell centres of the unit cube's grid."""
    n = float(1 << grid_depth)
    at = [(F.col(f"i{c}") + 0.5) / n for c in "xyz"]
    return full_grid(spark, grid_depth).withColumn("value", f(*at))


