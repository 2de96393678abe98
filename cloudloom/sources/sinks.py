"""Sinks: stage snapshots, points with normals as text, and skeletons as polylines and OBJ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudloom.operators.octree import with_places


def write_snapshot(df: DataFrame, path: str) -> None:
    """A stage's rows as Parquet, for looking at; a failure raises."""
    df.write.mode("overwrite").parquet(path)


def _number(c: Column | str) -> Column:
    """Ten significant digits, without trailing zeros."""
    text = F.format_string("%.10g", F.col(c) if isinstance(c, str) else c)
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def write_xyz_normals(cloud: DataFrame, path: str) -> None:
    """Lines "x y z nx ny nz" with ten digits, in order of point_id across the part files."""
    line = F.concat_ws(" ", *[_number(c) for c in ("x", "y", "z", "nx", "ny", "nz")])
    cloud.orderBy("point_id").select(line.alias("value")).write.mode("overwrite").text(path)


def obj_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(order, value): "v x y z" for each skeleton vertex, then "l a b" for each edge with numbers from 1."""
    numbered = with_places(vertices, ["sid"], "place").withColumn("n", F.col("place") + 1)
    v = numbered.select(F.struct(F.lit(0).alias("k"), F.col("n"), F.lit(0).cast("long").alias("m")).alias("order"), F.concat_ws(" ", F.lit("v"), *[_number(c) for c in "xyz"]).alias("value"))
    ids = numbered.select("sid", "n")
    e = edges.join(ids.select(F.col("sid").alias("a"), F.col("n").alias("na")), "a").join(ids.select(F.col("sid").alias("b"), F.col("n").alias("nb")), "b")
    e = e.select(F.struct(F.lit(1).alias("k"), F.col("na").alias("n"), F.col("nb").alias("m")).alias("order"), F.concat_ws(" ", F.lit("l"), "na", "nb").alias("value"))
    return v.unionByName(e)


def write_obj(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A skeleton as OBJ text: part files that, one after the other, are one file."""
    obj_lines(vertices, edges).orderBy("order").select("value").write.mode("overwrite").text(path)


def correspondence(vertices: DataFrame, mesh_vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A segment from each skeleton vertex to each mesh vertex that it came from, as vertices and edges for write_obj()."""
    pairs = vertices.select("sid", "x", "y", "z", F.explode("mesh_vids").alias("vid"))
    to = mesh_vertices.select(F.col("vid"), *[F.col(c).alias(f"m{c}") for c in "xyz"])
    pairs = with_places(pairs.join(to, "vid"), ["sid", "vid"], "pair").select("pair", *"xyz", "mx", "my", "mz")
    start = pairs.select((F.col("pair") * 2).alias("sid"), *"xyz")
    end = pairs.select((F.col("pair") * 2 + 1).alias("sid"), *[F.col(f"m{c}").alias(c) for c in "xyz"])
    return start.unionByName(end), pairs.select((F.col("pair") * 2).alias("a"), (F.col("pair") * 2 + 1).alias("b"))


def polylines(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(line, place, sid): maximal paths between vertices that don't have two edges; a loop without such starts at its least.

    An undirected skeleton is small beside its mesh, but the paths are found by joins all the same: each
    edge on a path of degree-2 vertices is labelled by pointer jumping over shared vertices.
    """
    from cloudloom.operators.mesh import components

    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    e = with_places(e, ["a", "b"], "eid")
    ends = e.select("eid", F.explode(F.array("a", "b")).alias("sid"))
    degree = ends.groupBy("sid").agg(F.count("*").alias("d"), F.min("eid").alias("u"), F.max("eid").alias("v"))
    joined = degree.where("d = 2").select("u", "v")
    labels = components(joined, e, "eid", most_rounds).withColumnRenamed("comp", "line")
    rows = e.join(labels, "eid").join(degree.select(F.col("sid").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("sid").alias("b"), F.col("d").alias("db")), "b")
    return rows.groupBy("line").applyInPandas(_walk, "line long, place int, sid long")  # one path


def _walk(frame):
    import pandas as pd

    near: dict[int, list[int]] = {}
    ends = set()
    for a, b, da, db in zip(frame["a"], frame["b"], frame["da"], frame["db"], strict=True):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
        ends |= {v for v, d in ((a, da), (b, db)) if d != 2}
    at = min(ends) if ends else min(near)
    path, steps = [at], len(frame)
    for _ in range(steps):
        nxt = min(near[at])
        near[at].remove(nxt)
        near[nxt].remove(at)
        path.append(nxt)
        at = nxt
    return pd.DataFrame({"line": frame["line"].iloc[0], "place": range(len(path)), "sid": path})


def write_polylines(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Polylines as text: a line "x y z" a vertex, a blank line after each path."""
    rows = polylines(edges).join(vertices.select("sid", "x", "y", "z"), "sid")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "x", "y", "z"))), lambda p: F.concat_ws(" ", *[_number(p[c]) for c in "xyz"])), "\n")
    rows.groupBy("line").agg(F.concat(text, F.lit("\n")).alias("value")).orderBy("line").select("value").write.mode("overwrite").text(path)


def write_skeleton(vertices: DataFrame, edges: DataFrame, mesh_vertices: DataFrame, folder: str) -> None:
    """All three files of a skeleton; those of an earlier run are replaced."""
    write_polylines(vertices, edges, f"{folder}/polylines.txt")
    write_obj(vertices, edges, f"{folder}/skeleton.obj")
    write_obj(*correspondence(vertices, mesh_vertices), f"{folder}/correspondence.obj")
