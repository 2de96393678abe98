"""Trimming a mesh by density, merging and dropping islands, closing holes, and simplifying."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.operators import mesh
from cloudloom.operators.octree import with_places
from cloudloom.operators.poisson import polygon_triangles, triangulate

TRIM_THRESHOLD, ISLAND_RATIO = 7.0, 0.001
#: A mesh with more faces than this is simplified before the skeleton.
MOST_FACES = 50_000


def merge_graph(area: dict[int, float], links: dict[int, set[int]], limit: float) -> dict[int, int]:
    """Where each component ends after small ones are merged; area and links are changed to what is left.

    The smallest component that still has neighbours, of equal areas the least, is merged while its area is
    under the limit: it and all its other neighbours go into its least neighbour, which keeps its side and
    gets their neighbours.
    """
    into = {c: c for c in area}
    heap = [(a, c) for c, a in area.items() if links[c]]
    heapq.heapify(heap)
    while heap:
        a, c = heapq.heappop(heap)
        if into[c] != c or a != area[c] or not links[c]:
            continue  # merged or grown since
        if a >= limit:
            break
        to, *others = sorted(links.pop(c))
        for gone in (c, *others):
            into[gone] = to
            area[to] += area[gone]
            for near in links.pop(gone, ()):
                links[near].discard(gone)
                if near != to and near != c and near not in others:
                    links[to].add(near)
                    links[near].add(to)
            links[gone] = set()
        for near in (c, *others):
            links[to].discard(near)
        if links[to]:
            heapq.heappush(heap, (area[to], to))
    for c in into:
        end = c
        while into[end] != end:
            end = into[end]
        while into[c] != end:  # shorten the way for those that come after
            into[c], c = end, into[c]
    return into


def merge_islands(components: DataFrame, adjacency: DataFrame, ratio: float = ISLAND_RATIO) -> DataFrame:
    """(comp, into, above, lone): where each component (comp, above, area) ends after merging small ones (see merge_graph).

    The limit is ratio times the whole area. Merges in parts of the graph that don't meet don't touch each
    other, so each connected part is one task's, a component one row there with its neighbours, whatever its
    number of faces; within a part the order matters. lone: small, and without neighbours.
    """
    near = adjacency.groupBy(F.col("comp")).agg(F.sort_array(F.collect_set("near")).alias("near"))
    whole = components.agg(F.sum("area")).first()[0] or 0.0
    parts = mesh.components(adjacency.select(F.col("comp").alias("a"), F.col("near").alias("b")), components.select(F.col("comp").alias("node")), "node")
    parts = parts.select(F.col("node").alias("comp"), F.col("comp").alias("g"))
    rows = components.select("comp", "above", "area").join(near, "comp", "left").join(parts, "comp")

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        area = dict(zip(frame["comp"].tolist(), frame["area"].tolist(), strict=True))
        above = dict(zip(frame["comp"].tolist(), frame["above"].tolist(), strict=True))
        links = {c: {int(x) for x in n} if n is not None else set() for c, n in zip(frame["comp"].tolist(), frame["near"], strict=True)}
        into = merge_graph(area, links, ratio * whole)
        out = [(c, end, above[end], not links[end] and area[end] < ratio * whole) for c, end in into.items()]
        return pd.DataFrame(out, columns=["comp", "into", "above", "lone"])

    return rows.groupBy("g").applyInPandas(merge, "comp long, into long, above boolean, lone boolean")


def remove_islands(vertices: DataFrame, pieces: DataFrame, ratio: float = ISLAND_RATIO, remove: bool = True) -> DataFrame:
    """Faces (fid, above, vids) after merging islands between the two sides and, if wished, dropping lone small ones."""
    faces = pieces.select("fid", "above", "vids")
    comps = None
    for side in (True, False):
        own = mesh.face_components(faces.where(F.col("above") == side))
        comps = own if comps is None else comps.unionByName(own)
    comps = comps.checkpoint()
    areas = mesh.component_areas(faces, vertices, comps).join(faces.select(F.col("fid").alias("comp"), "above"), "comp")
    ends = merge_islands(areas, mesh.component_adjacency(faces, comps), ratio).where(~F.col("lone") | F.lit(not remove))
    placed = comps.join(ends.select("comp", F.col("above").alias("now")), "comp")
    return faces.join(placed.select("fid", "now"), "fid").select("fid", F.col("now").alias("above"), "vids")


def trim(vertices: DataFrame, faces: DataFrame, threshold: float = TRIM_THRESHOLD, ratio: float = ISLAND_RATIO, remove: bool = True) -> tuple[DataFrame, DataFrame]:
    """The part of the mesh whose values are over the threshold: cut, rid of islands, triangulated, renumbered."""
    whole, pieces = mesh.split_faces(faces, vertices, threshold)
    pieces = with_places(pieces.drop("fid").withColumn("o", F.col("vids")), ["o"], "fid").drop("o").checkpoint()
    whole = whole.checkpoint()
    if ratio > 0:
        pieces = remove_islands(whole, pieces, ratio, remove)
    kept = triangulate(pieces.where("above").select("fid", "vids"), whole).checkpoint()
    return mesh.compact(whole, kept)


def boundary_loops(faces: DataFrame) -> DataFrame:
    """(loop, part, vids): the rings of open half-edges, walked so that a face on the ring fits the mesh.

    Open half-edges are grouped by component of shared vertices; each group is one task's small ring. A
    group in which a vertex has several open half-edges gives the rings that can be walked in it.
    """
    e = mesh.half_edges(faces)
    opposite = e.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    rim = e.join(opposite, ["src", "dst"], "left_anti").select(F.col("dst").cast("long").alias("a"), F.col("src").cast("long").alias("b"))
    labels = mesh.components(rim, rim.select("a"), "a")
    groups = rim.join(labels, "a").withColumnRenamed("comp", "g")

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        following: dict[int, list[int]] = {}
        for a, b in sorted(zip(frame["a"].tolist(), frame["b"].tolist(), strict=True), reverse=True):
            following.setdefault(a, []).append(b)  # the least comes last
        out = []
        for start in sorted(following):
            while following.get(start):
                path, place = [start], {start: 0}
                while following.get(path[-1]):
                    nxt = following[path[-1]].pop()
                    if nxt not in place:
                        place[nxt] = len(path)
                        path.append(nxt)
                        continue
                    ring = path[place[nxt] :]  # a ring is closed; what came before it goes on
                    for v in ring[1:]:
                        del place[v]
                    del path[place[nxt] + 1 :]
                    if len(ring) >= 3:
                        out.append((min(ring), len(out), ring))
        return pd.DataFrame(out, columns=["loop", "part", "vids"])

    return groups.groupBy("g").applyInPandas(walk, "loop long, part int, vids array<bigint>")


def fill_holes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with every boundary loop closed by its triangulation (polygon_triangles): of least area up to MOST_CORNERS edges."""
    rings = boundary_loops(faces)
    corner = rings.select("loop", "part", F.posexplode("vids").alias("k", "vid")).join(vertices.select("vid", "x", "y", "z"), "vid")
    rings = corner.groupBy("loop", "part").agg(F.sort_array(F.collect_list(F.struct("k", "vid", "x", "y", "z"))).alias("ring"))

    def fill(frames):
        for frame in frames:
            out = []
            for loop, part, ring in zip(frame["loop"], frame["part"], frame["ring"], strict=True):
                points = np.array([[r["x"], r["y"], r["z"]] for r in ring])
                out += [(loop, part, k, [int(ring[v]["vid"]) for v in t]) for k, t in enumerate(polygon_triangles(points))]
            yield pd.DataFrame(out, columns=["loop", "part", "k", "vids"])

    new = with_places(rings.mapInPandas(fill, "loop long, part int, k int, vids array<bigint>"), ["loop", "part", "k"], "n")
    top = faces.agg(F.coalesce(F.max("fid"), F.lit(-1))).first()[0]
    return faces.select("fid", F.col("vids").cast("array<bigint>").alias("vids")).unionByName(new.select((F.col("n") + top + 1).alias("fid"), "vids"))


def stitch(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with vertices at equal places as one: the least vid; faces that lose their area go."""
    least = vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("to"))
    to = vertices.join(least, ["x", "y", "z"]).select("vid", "to")
    c = mesh.corners(faces).join(to, "vid")
    rings = c.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("k", F.col("to").cast("long").alias("v")))).alias("r"))
    return rings.select("fid", F.col("r.v").alias("vids")).where(F.size(F.array_distinct("vids")) >= 3)


def close(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A closed triangle mesh: triangulated, stitched, its largest component, its holes filled; raises if it stays open."""
    triangles = stitch(vertices, triangulate(faces, vertices)).checkpoint()
    one = mesh.largest_component(triangles).checkpoint()
    full = fill_holes(vertices, one).checkpoint()
    if not mesh.is_closed(full).first()["closed"]:
        raise ValueError("the mesh can't be closed")
    return mesh.compact(vertices, full)


def simplify(vertices: DataFrame, faces: DataFrame, cell: float) -> tuple[DataFrame, DataFrame]:
    """Vertex clustering: vertices of one grid cell become their mean. A distributed stand-in for edge collapse."""
    keys = [F.floor(F.col(c) / cell).alias(f"i{c}") for c in "xyz"]
    cells = vertices.groupBy(*keys).agg(F.min("vid").alias("to"), *[F.avg(c).alias(c) for c in "xyz"])
    to = vertices.select("vid", *keys).join(cells.select("ix", "iy", "iz", "to"), ["ix", "iy", "iz"]).select("vid", "to")
    c = mesh.corners(faces).join(to, "vid")
    rings = c.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("k", F.col("to").cast("long").alias("v")))).alias("r"))
    rings = rings.select("fid", F.col("r.v").alias("vids")).where(F.size(F.array_distinct("vids")) == F.size("vids"))
    first = rings.groupBy(F.sort_array("vids").alias("s")).agg(F.min(F.struct("fid", "vids")).alias("f"))
    return mesh.compact(cells.select(F.col("to").alias("vid"), "x", "y", "z"), first.select("f.*"))
