"""Meshes as tables: vertices(vid, x, y, z, value) and faces(fid, vids ARRAY<INT>)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators.octree import with_places


def corners(faces: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(fid, k, size, vid) of each face's corners; with the vertices' columns if given."""
    out = faces.select("fid", F.size("vids").alias("size"), F.posexplode("vids").alias("k", "vid"))
    return out if vertices is None else out.join(vertices, "vid")


def half_edges(faces: DataFrame) -> DataFrame:
    """(fid, k, src, dst) of each face's directed edges."""
    following = F.expr("transform(vids, (v, i) -> struct(v as src, vids[(i + 1) % size(vids)] as dst))")
    return faces.select("fid", F.posexplode(following).alias("k", "e")).select("fid", "k", "e.src", "e.dst")


def edges(faces: DataFrame) -> DataFrame:
    """(a, b, n) of each undirected edge, a < b, with the number of half-edges on it."""
    e = half_edges(faces)
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"))


def is_closed(faces: DataFrame) -> DataFrame:
    """One row (edges, closed): closed if every undirected edge has two half-edges."""
    return edges(faces).agg(F.count("*").alias("edges"), F.coalesce(F.bool_and(F.col("n") == 2), F.lit(False)).alias("closed"))


def euler(faces: DataFrame) -> DataFrame:
    """One row (vertices, edges, faces, characteristic) of what the faces use."""
    v = corners(faces).agg(F.count_distinct("vid").alias("vertices"))
    e = edges(faces).agg(F.count("*").alias("edges"))
    f = faces.agg(F.count("*").alias("faces"))
    return v.join(e).join(f).withColumn("characteristic", F.col("vertices") - F.col("edges") + F.col("faces"))


def face_links(faces: DataFrame) -> DataFrame:
    """(fid, root): for each undirected edge, its faces linked to the least of them. A star per edge, not all pairs."""
    e = half_edges(faces).select("fid", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    least = e.groupBy("a", "b").agg(F.min("fid").alias("root"), F.max("fid").alias("last"))
    # an edge of a manifold has two faces at most, which the aggregate holds already
    pairs = least.where("root <> last").select(F.col("last").alias("fid"), "root")
    more = e.join(least, ["a", "b"]).where("fid <> root and fid <> last").select("fid", "root")
    return pairs.unionByName(more).distinct()


#: Links that a task joins at a time before the first round.
LOCAL_LINKS = 500_000


def forests(links: DataFrame, u: str, v: str) -> DataFrame:
    """Links (u, v), u > v, with the same components: each task's own links as stars around the least node that it knows of."""

    def joined(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = parent.setdefault(x, x)
            while parent[top] != top:
                top = parent[top]
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
        stars = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in stars], pa.int64()), pa.array([r for _, r in stars], pa.int64())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append([np.asarray(c) for c in batch.columns])
            size += batch.num_rows
            if size >= LOCAL_LINKS:
                yield joined(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield joined(*(np.concatenate(c) for c in zip(*held, strict=True)))

    whole = links.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    return whole.mapInArrow(run, "u long, v long")


def components(links: DataFrame, nodes: DataFrame, node: str, most_rounds: int = 64) -> DataFrame:
    """(node, comp) for each node: comp is the least node it is connected with. links: two columns of linked nodes, whole numbers.

    Each task first joins the links that it has, which leaves a star for each part of a component that
    lies in one task; alternating star contraction joins the rest. The number of rounds grows with the
    logarithm of what is left, and no round pairs the members of a component. Each round is checkpointed.
    """
    u, v = links.columns
    now = forests(links, u, v).distinct().checkpoint()
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("star contraction did not settle")
    stars = now.select(F.col("u").alias(node), F.col("v").alias("comp"))
    return nodes.select(node).distinct().join(stars, node, "left").select(node, F.coalesce("comp", node).alias("comp"))


def face_components(faces: DataFrame) -> DataFrame:
    """(fid, comp) of each face: faces that share an undirected edge belong together; comp is the least fid."""
    return components(face_links(faces), faces, "fid")


def face_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """(fid, area): triangles by their corners, larger polygons as a fan about their centroid, under three corners 0."""
    points = vertices.select("vid", *[F.col(k).cast("double").alias(k) for k in "xyz"])
    e = corners(faces).join(points, "vid")
    ring = e.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y", "z"))).alias("ring"))  # one face's corners
    at = lambda p: [p["x"], p["y"], p["z"]]
    mean = F.struct(*[_ring_mean(k).alias(k) for k in "xyz"]).alias("centre")
    ring = ring.select("fid", "ring", mean)
    fan = F.expr("transform(ring, (p, i) -> struct(p as p, ring[(i + 1) % size(ring)] as q))")
    ring = ring.withColumn("fan", fan)
    c = [F.col("centre")[k] for k in "xyz"]
    total = F.aggregate("fan", F.lit(0.0), lambda acc, s: acc + G.triangle_area(at(s["p"]), at(s["q"]), c))
    r = [F.get("ring", F.lit(k)) for k in range(3)]
    area = F.when(F.size("ring") < 3, 0.0).when(F.size("ring") == 3, G.triangle_area(at(r[0]), at(r[1]), at(r[2]))).otherwise(total)
    return ring.select("fid", area.alias("area"))


def _ring_mean(k: str) -> Column:
    return F.aggregate("ring", F.lit(0.0), lambda acc, p: acc + p[k]) / F.size("ring")


def component_areas(faces: DataFrame, vertices: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """(comp, faces, area) of each component."""
    comps = face_components(faces) if comps is None else comps
    return face_areas(faces, vertices).join(comps, "fid").groupBy("comp").agg(F.count("*").alias("faces"), F.sum("area").alias("area"))


def boundary(faces: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """Half-edges (fid, k, src, dst, comp) whose opposite isn't in the same component."""
    comps = face_components(faces) if comps is None else comps
    e = half_edges(faces).join(comps, "fid")
    opposite = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "comp").distinct()
    return e.join(opposite, ["src", "dst", "comp"], "left_anti").select("fid", "k", "src", "dst", "comp")


def component_adjacency(faces: DataFrame, comps: DataFrame) -> DataFrame:
    """(comp, near) for components that meet along boundary half-edges, both ways."""
    e = boundary(faces, comps)
    opposite = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("comp").alias("near"))
    return e.join(opposite, ["src", "dst"]).where("comp <> near").select("comp", "near").distinct()


def largest_component(faces: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """The faces of the component with most faces, of equals the one with the least id."""
    comps = face_components(faces) if comps is None else comps
    best = comps.groupBy("comp").count().agg(F.min(F.struct(-F.col("count"), F.col("comp"))).alias("b")).select(F.col("b.comp").alias("comp"))
    return faces.join(comps.join(F.broadcast(best), "comp", "left_semi"), "fid", "left_semi")


def compact(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that faces use, numbered anew from 0 in their old order, and the faces with the new numbers."""
    used = vertices.join(corners(faces).select("vid").distinct(), "vid", "left_semi")
    numbered = with_places(used, ["vid"], "new")
    renamed = corners(faces).join(numbered.select("vid", "new"), "vid")
    rings = renamed.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("k", F.col("new").alias("v")))).alias("r"))
    return numbered.drop("vid").withColumnRenamed("new", "vid").select("vid", *[c for c in vertices.columns if c != "vid"]), rings.select("fid", F.col("r.v").alias("vids"))


def classify(faces: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """(fid, side): keep if all corners' values are over the threshold, drop if none is, else split."""
    above = F.count_if(F.col("value") > threshold)
    side = F.when(above == F.count("*"), "keep").when(above == 0, "drop").otherwise("split")
    return corners(faces, vertices.select("vid", "value")).groupBy("fid").agg(side.alias("side"))


def crossings(faces: DataFrame, vertices: DataFrame, threshold: float) -> DataFrame:
    """(a, b, x, y, z, value) of each undirected edge, a < b, with one end over the threshold: where it is passed."""
    e = half_edges(faces).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    for end in "ab":
        e = e.join(vertices.select(F.col("vid").alias(end), *[F.col(k).alias(f"{k}{end}") for k in ("x", "y", "z", "value")]), end)
    e = e.where((F.col("valuea") > threshold) != (F.col("valueb") > threshold))
    at = [G.crossing(F.col(f"{k}a"), F.col(f"{k}b"), F.col("valuea"), F.col("valueb"), threshold).alias(k) for k in "xyz"]
    return e.select("a", "b", *at, F.lit(float(threshold)).alias("value"))


def split_faces(faces: DataFrame, vertices: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Cut the faces along the threshold: all vertices, with crossings added, and faces (fid, part, above, vids).

    A face's ring is walked from its first crossing upwards; each run of corners on one side, with the
    crossings at its ends, is a piece. Crossings are shared between the faces of an edge.
    """
    new = crossings(faces, vertices, threshold)
    top = vertices.agg(F.max("vid")).first()[0] or 0
    new = with_places(new, ["a", "b"], "i").withColumn("vid", (F.col("i") + top + 1).cast("long")).drop("i")
    whole = vertices.select(F.col("vid").cast("long").alias("vid"), "x", "y", "z", "value").unionByName(new.select("vid", "x", "y", "z", "value"))
    e = half_edges(faces).join(vertices.select(F.col("vid").alias("src"), (F.col("value") > threshold).alias("above")), "src")
    e = e.withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")}).join(new.select("a", "b", F.col("vid").alias("cut")), ["a", "b"], "left")
    ring = e.groupBy("fid").agg(F.sort_array(F.collect_list(F.struct("k", F.col("src").cast("long").alias("src"), "above", "cut"))).alias("ring"))
    pieces = ring.mapInPandas(_pieces, "fid long, part int, above boolean, vids array<bigint>")
    return whole, pieces


def _pieces(frames):
    import pandas as pd

    for frame in frames:
        out = []
        for fid, ring in zip(frame["fid"], frame["ring"], strict=True):
            n = len(ring)
            start = next((i for i in range(n) if ring[i - 1]["cut"] is not None and not ring[i - 1]["above"] and ring[i]["above"]), None)
            if start is None:
                out.append((fid, 0, bool(ring[0]["above"]), [r["src"] for r in ring]))
                continue
            part, run = 0, [int(ring[start - 1]["cut"])]
            for j in range(n):
                r = ring[(start + j) % n]
                run.append(int(r["src"]))
                if r["cut"] is not None:
                    run.append(int(r["cut"]))
                    out.append((fid, part, bool(r["above"]), run))
                    part, run = part + 1, [int(r["cut"])]
        yield pd.DataFrame(out, columns=["fid", "part", "above", "vids"])


def mesh_checks(faces: DataFrame) -> DataFrame:
    """One row (faces, degenerate, repeated, edges, open_edges, bad_edges): what keeps a mesh from being closed and manifold."""
    f = faces.agg(F.count("*").alias("faces"), F.count_if(F.size(F.array_distinct("vids")) < 3).alias("degenerate"))
    r = faces.groupBy(F.sort_array("vids")).count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    e = edges(faces).agg(F.count("*").alias("edges"), F.count_if(F.col("n") == 1).alias("open_edges"), F.count_if(F.col("n") > 2).alias("bad_edges"))
    return f.join(r).join(e)
