"""Sums over all sources at each query point: winding number A, its transpose AT, and the field gradient G.

exact() works in blocks: a block of queries is broadcast, each batch of sources adds its part in NumPy,
and the parts are summed. treecode() follows the octree level by level: a frontier of (query, node)
rows is split into nodes far enough to stand for their points, leaves whose points are summed, and
nodes to open. Each step is an equi-join on the parent node; no step pairs all queries with all points.

A solver applies the operators again and again to the same points. For it, points are taken in groups
(the shallowest cells with at most GROUP points), and which nodes are far from a whole group and which
points are near it is found once: Interactions does it for points that fit in a task's memory, and
GroupLists, with the same rule and the same results, in tables of any size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import octree

XYZ = ("x", "y", "z")
#: A node stands for its points from so many half widths away.
FAR = 4.0
#: Queries that are broadcast at a time, and points of a group that shares its interactions.
BLOCK, GROUP = 65_536, 128
#: By operator: the sources' attributes, the length of a result, and whether the kernel is continuous inside the width.
KINDS = {"A": (("mx", "my", "mz"), 1, True), "AT": (("s",), 3, False), "G": (("mx", "my", "mz"), 3, False)}


def kernel(kind: str, d: np.ndarray, attributes: np.ndarray, width: np.ndarray | float) -> np.ndarray:
    """Contributions of sources to queries. d: (..., 3) differences query - source; attributes: (..., 1 or 3)."""
    d2 = (d * d).sum(axis=-1)
    near = d2 < np.square(width)
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = 1.0 / np.sqrt(d2)
    inverse = np.where(near, 1.0 / width if kind == "A" else 0.0, inverse)
    cube = inverse**3
    if kind == "A":
        return (-(d * attributes).sum(axis=-1) * cube)[..., None]
    if kind == "AT":
        return d * (attributes[..., 0] * cube)[..., None]
    along = (d * attributes).sum(axis=-1)
    return attributes * cube[..., None] - 3.0 * d * (along * cube * inverse**2)[..., None]


def _columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(batch.schema.get_field_index(n)), dtype=float) for n in names])


def _out(size: int) -> list[str]:
    return ["value"] if size == 1 else ["vx", "vy", "vz"]


def exact(kind: str, queries: DataFrame, sources: DataFrame, width: float) -> DataFrame:
    """(point_id, value or vx, vy, vz) at each query (point_id, x, y, z), from all sources.

    The work is queries times sources: for small query sets, and to check treecode(). Queries are dealt to
    blocks of about BLOCK; each is broadcast in turn and costs one pass over the sources.
    """
    attributes, size, _ = KINDS[kind]
    names = _out(size)
    spark = queries.sparkSession
    rows = sources.select(*XYZ, *attributes)
    schema = "point_id long, " + ", ".join(f"{n} double" for n in names)
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = queries.select("point_id", *XYZ).withColumn("block", F.pmod(F.xxhash64("point_id"), F.lit(blocks)).cast("int")).checkpoint()
    parts = []
    for k in range(blocks):
        block = dealt.where(F.col("block") == k).toPandas()
        held = spark.sparkContext.broadcast((block["point_id"].to_numpy(np.int64), block[list(XYZ)].to_numpy(float)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, at = held.value
            total = np.zeros((len(ids), size))
            for batch in batches:
                p, a = _columns(batch, XYZ), _columns(batch, attributes)
                for first in range(0, len(p), 512):
                    for own in range(0, len(at), 1024):
                        d = at[own : own + 1024, None, :] - p[None, first : first + 512]
                        total[own : own + 1024] += kernel(kind, d, a[None, first : first + 512], width).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(total[:, c].copy()) for c in range(size)]], ["point_id", *names])

        sums = rows.mapInArrow(run, schema).groupBy("point_id").agg(*[F.sum(n).alias(n) for n in names])
        parts.append(sums.checkpoint() if blocks > 1 else sums)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _kernel_columns(kind: str, d: list, attributes: list, width: float) -> list:
    """kernel() as column expressions."""
    d2 = G.dot(d, d)
    near = d2 < width * width
    inverse = F.when(near, F.lit(1.0 / width if kind == "A" else 0.0)).otherwise(1.0 / F.sqrt(d2))
    cube = inverse * inverse * inverse
    if kind == "A":
        return [-G.dot(d, attributes) * cube]
    if kind == "AT":
        return [c * attributes[0] * cube for c in d]
    along = G.dot(d, attributes)
    return [m * cube - 3.0 * c * along * cube * inverse * inverse for m, c in zip(attributes, d, strict=True)]


def treecode(kind: str, queries: DataFrame, sources: DataFrame, width: float, depth: int = 10, cap: int = 8, far: float = FAR) -> DataFrame:
    """exact()'s sums with far nodes in place of their points. queries and sources lie in [-1, 1]**3.

    Node weights, which place a node's representative point, are the lengths of the sources' attributes.
    The frontier of each level is checkpointed: it is read three times. Nodes of the upper levels are
    few and are broadcast by adaptive execution; below them the join is dealt by the parent node.
    Sources at one place are one source with the sum of their attributes, so such places fill no leaf.
    """
    attributes, size, _ = KINDS[kind]
    names = _out(size)
    length = F.sqrt(sum((F.col(a) * F.col(a) for a in attributes), F.lit(0.0)))
    weighted = sources.withColumn("w", length).groupBy(*XYZ).agg(*[F.sum(a).alias(a) for a in attributes], F.sum("w").alias("w")).checkpoint()
    nodes = octree.build(weighted, depth, cap).checkpoint()
    moments = octree.node_moments(weighted, nodes, list(attributes), "w", depth).checkpoint()
    leaf_points = octree.leaf_of(weighted, nodes, depth).select("leaf_depth", "leaf_code", *XYZ, *attributes).checkpoint()
    q = [F.col(f"q{k}") for k in XYZ]
    frontier = queries.select("point_id", *[F.col(k).alias(f"q{k}") for k in XYZ]).withColumns({"depth": F.lit(0), "up": F.lit(0).cast("long")})
    parts = []
    for level in range(depth + 1):
        own = moments.where(F.col("depth") == level).drop("depth", "n", "weight").withColumn("up", F.shiftright("code", 3) if level else F.col("code"))
        met = frontier.join(own, "up").drop("up")
        d = [a - F.col(f"mean_{k}") for a, k in zip(q, XYZ, strict=True)]
        met = met.withColumn("far", G.dot(d, d) > (far * 2.0**-level) ** 2).checkpoint()
        terms = _kernel_columns(kind, d, [F.col(f"sum_{a}") for a in attributes], width)
        parts.append(met.where("far").select("point_id", *[t.alias(n) for t, n in zip(terms, names, strict=True)]).groupBy("point_id").agg(*[F.sum(n).alias(n) for n in names]))
        points = leaf_points.where(F.col("leaf_depth") == level).drop("leaf_depth").withColumnRenamed("leaf_code", "code")
        close = met.where("not far and is_leaf").select("point_id", "code", *[f"q{k}" for k in XYZ]).join(points, "code")
        d = [a - F.col(k) for a, k in zip(q, XYZ, strict=True)]
        terms = _kernel_columns(kind, d, [F.col(a) for a in attributes], width)
        parts.append(close.select("point_id", *[t.alias(n) for t, n in zip(terms, names, strict=True)]).groupBy("point_id").agg(*[F.sum(n).alias(n) for n in names]))
        frontier = met.where("not far and not is_leaf").select("point_id", *[f"q{k}" for k in XYZ], F.col("code").alias("up"))
        if frontier.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("point_id").agg(*[F.sum(n).alias(n) for n in names])


class Tree:
    """The octree of points that fit in memory, as arrays. Points stand in the order of their codes; `order` leads back."""

    def __init__(self, points: np.ndarray, depth: int = octree.MAX_DEPTH, cap: int = 8) -> None:
        cells = 1 << depth
        index = np.clip(np.floor((points + 1.0) * (cells / 2)).astype(np.int64), 0, cells - 1)
        code = np.zeros(len(points), dtype=np.int64)
        for level in range(depth):
            for axis in range(3):
                code |= ((index[:, axis] >> level) & 1) << (3 * level + axis)
        self.order = np.argsort(code, kind="stable")
        self.points, sorted_code = points[self.order], code[self.order]
        starts, ends, levels, children, groups = [], [], [], [], []
        todo = [(0, len(points), 0, True)]
        while todo:  # breadth first, a list of nodes per level
            below = []
            for start, end, level, ungrouped in todo:
                me = len(starts)
                starts.append(start)
                ends.append(end)
                levels.append(level)
                children.append([])
                leaf = end - start <= cap or level == depth
                if ungrouped and (leaf or end - start <= GROUP):
                    groups.append(me)
                    ungrouped = False
                if not leaf:
                    part = sorted_code[start:end] >> (3 * (depth - level - 1))
                    cut = np.flatnonzero(np.diff(part)) + 1
                    bounds = [0, *cut.tolist(), end - start]
                    below += [(start + a, start + b, me, ungrouped) for a, b in zip(bounds, bounds[1:], strict=False)]
            todo = []
            for start, end, parent, ungrouped in below:
                children[parent].append(len(starts) + len(todo))
                todo.append((start, end, levels[parent] + 1, ungrouped))
        self.start, self.end, self.level = (np.array(v, dtype=np.int64) for v in (starts, ends, levels))
        self.first = np.array([c[0] if c else 0 for c in children], dtype=np.int64)
        self.count = np.array([len(c) for c in children], dtype=np.int64)
        self.half = 2.0**-self.level
        self.groups = np.array(sorted(groups, key=starts.__getitem__), dtype=np.int64)
        self.mean = self.sums(self.points) / np.maximum(self.end - self.start, 1)[:, None]

    def sums(self, attributes: np.ndarray) -> np.ndarray:
        """Of each node the sum of its points' attributes, which stand in the tree's order."""
        total = np.concatenate((np.zeros((1, attributes.shape[1])), attributes.cumsum(axis=0)))
        return total[self.end] - total[self.start]

    def interactions(self, group: int, far: float = FAR) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that are far from all of a group, none in another, and the points that are left."""
        own = self.points[self.start[group] : self.end[group]]
        centre, radius = sphere(own)
        nodes, far_nodes, near = np.zeros(1, dtype=np.int64), [], []
        while len(nodes):
            away = is_far(self.mean[nodes], self.half[nodes], centre, radius, far)
            far_nodes.append(nodes[away])
            nodes = nodes[~away]
            leaf = self.count[nodes] == 0
            near.append(_ranges(self.start[nodes[leaf]], self.end[nodes[leaf]] - self.start[nodes[leaf]]))
            nodes = _ranges(self.first[nodes[~leaf]], self.count[nodes[~leaf]])
        return np.concatenate(far_nodes), np.concatenate(near)


def sphere(points: np.ndarray) -> tuple[np.ndarray, float]:
    """The centre of the points' box and the radius around it that holds them all."""
    centre = (points.min(axis=0) + points.max(axis=0)) / 2
    return centre, float(np.sqrt(((points - centre) ** 2).sum(axis=1).max()))


def is_far(means: np.ndarray, halves: np.ndarray, centre: np.ndarray, radius: np.ndarray | float, far: float = FAR) -> np.ndarray:
    """Whether nodes, each at the plain mean of its points, can stand for their points at every place in the sphere."""
    return np.sqrt(((means - centre) ** 2).sum(axis=1)) - radius > far * halves


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    if not len(starts):
        return np.zeros(0, dtype=np.int64)
    return np.repeat(starts - np.concatenate(([0], lengths.cumsum()[:-1])), lengths) + np.arange(lengths.sum())


class Kernels:
    """The kernels between the places of a group and its sources, to be applied to several attributes.

    With places relative to the group's centre, each operator is a few products of one matrix of powers
    of distances: differences of places are parted into the terms of the one and of the other.
    """

    def __init__(self, at: np.ndarray, places: np.ndarray, width: float) -> None:
        centre = (at.min(axis=0) + at.max(axis=0)) / 2
        self.x, self.y = at - centre, places - centre
        # squared distances as one product; its rounding matters inside the width only, where they are cut off
        square = lambda v: (v * v).sum(axis=1)[:, None]
        left = np.hstack((self.x, square(self.x), np.ones((len(at), 1))))
        right = np.hstack((-2.0 * self.y, np.ones((len(places), 1)), square(self.y)))
        d2 = left @ right.T
        self.near = d2 < width * width
        np.maximum(d2, width * width, out=d2)
        self.inverse2 = np.reciprocal(d2, out=d2)
        self.cube = np.sqrt(d2)  # continuous inside the width
        self.cube *= d2
        self.cut: np.ndarray | None = None

    def _cut(self) -> np.ndarray:
        """The cubes, zero inside the width."""
        if self.cut is None:
            self.cut = np.where(self.near, 0.0, self.cube)
        return self.cut

    def apply(self, kind: str, values: np.ndarray) -> np.ndarray:
        x, y = self.x, self.y
        if kind == "A":
            p = self.cube @ np.column_stack((values, (y * values).sum(axis=1)))
            return (p[:, 3] - (x * p[:, :3]).sum(axis=1))[:, None]
        if kind == "AT":
            p = self._cut() @ np.column_stack((values, y * values))
            return x * p[:, :1] - p[:, 1:]
        along = (y * values).sum(axis=1)
        fifth = self._cut() * self.inverse2
        p = fifth @ np.column_stack((values, along, (y[:, :, None] * values[:, None, :]).reshape(-1, 9), y * along[:, None]))
        m = p[:, 4:13].reshape(-1, 3, 3)
        spread = x * ((x * p[:, :3]).sum(axis=1) - p[:, 3])[:, None] - np.einsum("nkj,nj->nk", m, x) + p[:, 13:]
        return self._cut() @ values - 3.0 * spread


class Interactions:
    """The operators on points in memory: interactions are found once a process and kept, sums are dense by group."""

    def __init__(self, tree: Tree, far: float = FAR) -> None:
        self.tree, self.far = tree, far
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, group: int) -> tuple[np.ndarray, np.ndarray]:
        if group not in self.known:
            self.known[group] = self.tree.interactions(group, self.far)
        return self.known[group]

    def apply(self, groups: np.ndarray, asked: list[tuple[str, np.ndarray, np.ndarray]], width: float) -> list[np.ndarray]:
        """Of each (kind, attributes, their sums by node) the operator's values at the groups' points, in the tree's order."""
        t = self.tree
        out: list[list[np.ndarray]] = [[] for _ in asked]
        for group in groups:
            far, near = self.of(int(group))
            kernels = Kernels(t.points[t.start[group] : t.end[group]], np.concatenate((t.mean[far], t.points[near])), width)
            for part, (kind, attributes, sums) in zip(out, asked, strict=True):
                part.append(kernels.apply(kind, np.concatenate((sums[far], attributes[near]))))
        return [np.concatenate(part) for part in out]


class GroupLists:
    """Interactions in tables, for points (point_id, x, y, z) of any number in [-1, 1]**3.

    far: (g, depth, code) and near: (g, depth, code) of leaves are found once, by a frontier of (group, node)
    rows that opens level by level. An application joins them with the sums of the nodes and the points of
    the leaves, and works out each group's dense sums in one task. A group and a leaf hold more points
    than GROUP and cap only where more than that coincide.
    """

    def __init__(self, points: DataFrame, depth: int, cap: int, far: float = FAR) -> None:
        self.depth, self.points = depth, points
        self.nodes = octree.build(points, depth, cap).checkpoint()
        means = octree.node_moments(points.withColumn("one", F.lit(1.0)), self.nodes, [], "one", depth)
        self.means = means.select("depth", "code", "is_leaf", *[f"mean_{k}" for k in XYZ]).checkpoint()
        grouped = octree.leaf_of(points, octree.build(points, depth, max(cap, GROUP)), depth)
        g = (F.col("leaf_depth").cast("long") * F.lit(1 << 58) + F.col("leaf_code")).alias("g") if depth <= 15 else F.xxhash64("leaf_depth", "leaf_code").alias("g")
        self.queries = grouped.select(g, "point_id", *XYZ).checkpoint()
        leaves = octree.leaf_of(points, self.nodes, depth)
        self.leaf_points = leaves.select("point_id", *XYZ, F.col("leaf_depth").alias("depth"), F.col("leaf_code").alias("code")).checkpoint()
        box = self.queries.groupBy("g").agg(*[f(k).alias(f"{f.__name__}_{k}") for k in XYZ for f in (F.min, F.max)])
        centre = box.select("g", *[((F.col(f"min_{k}") + F.col(f"max_{k}")) / 2).alias(f"c{k}") for k in XYZ])
        off = [F.col(k) - F.col(f"c{k}") for k in XYZ]
        spheres = self.queries.join(centre, "g").groupBy("g").agg(*[F.first(f"c{k}").alias(f"c{k}") for k in XYZ], F.sqrt(F.max(G.dot(off, off))).alias("radius"))
        frontier = spheres.withColumn("up", F.lit(0).cast("long"))
        far_parts, near_parts = [], []
        for level in range(depth + 1):
            own = self.means.where(F.col("depth") == level).withColumn("up", F.shiftright("code", 3) if level else F.col("code"))
            d = [F.col(f"c{k}") - F.col(f"mean_{k}") for k in XYZ]
            met = frontier.join(own, "up").drop("up").withColumn("far", F.sqrt(G.dot(d, d)) - F.col("radius") > far * 2.0**-level).checkpoint()
            far_parts.append(met.where("far").select("g", "depth", "code"))
            near_parts.append(met.where("not far and is_leaf").select("g", "depth", "code"))
            frontier = met.where("not far and not is_leaf").select("g", *[f"c{k}" for k in XYZ], "radius", F.col("code").alias("up"))
            if frontier.isEmpty():
                break
        union = lambda parts: reduce(DataFrame.unionByName, parts).checkpoint()
        self.far, self.near = union(far_parts), union(near_parts)

    def apply(self, kind: str, values: DataFrame, width: float) -> DataFrame:
        """(point_id, value or vx, vy, vz) of the operator for values (point_id, attributes)."""
        attributes, size, _ = KINDS[kind]
        names = _out(size)
        own = self.points.join(values, "point_id").withColumn("one", F.lit(1.0))
        sums = octree.node_moments(own, self.nodes, list(attributes), "one", self.depth)
        columns = [F.col(f"sum_{a}").alias(a) for a in attributes]
        far = self.far.join(sums, ["depth", "code"]).select("g", *[F.col(f"mean_{k}").alias(k) for k in XYZ], *columns)
        near = self.near.join(self.leaf_points, ["depth", "code"]).join(values, "point_id").select("g", *XYZ, *attributes)

        def dense(queries: pa.Table, sources: pa.Table) -> pa.Table:
            array = lambda t, names: np.column_stack([t.column(n).to_numpy() for n in names])
            at, places, given = array(queries, XYZ), array(sources, XYZ), array(sources, attributes)
            total = np.zeros((len(at), size))
            for first in range(0, len(at), 256):  # bounded, also where many points coincide
                for k in range(0, len(places), 16_384):
                    total[first : first + 256] += Kernels(at[first : first + 256], places[k : k + 16_384], width).apply(kind, given[k : k + 16_384])
            return pa.table({"point_id": queries.column("point_id"), **{n: total[:, c] for c, n in enumerate(names)}})

        sources = far.unionByName(near).withColumnRenamed("g", "own")
        grouped = self.queries.groupBy("g").cogroup(sources.groupBy("own"))
        return grouped.applyInArrow(dense, "point_id long, " + ", ".join(f"{n} double" for n in names))
