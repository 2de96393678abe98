"""Octrees as tables of key prefixes: a node is (depth, code), its parent (depth - 1, code >> 3).

Clouds lie in the cube [-1, 1]**3. No tree is walked: node counts are one aggregate over all prefixes
of the occupied finest cells, and leaves are the shallowest prefixes with few enough points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.functions.names import free_names

MAX_DEPTH = 15
LEAF_CAP = 4


def prefix(code: Column, depth: Column, finest: int) -> Column:
    """The code of the ancestor at `depth` of a cell at depth `finest`."""
    return F.call_function("shiftright", code, (F.lit(finest) - depth).cast("int") * 3)


def with_codes(cloud: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    # cell indices are columns of their own first: written out in each bit's place they would not fit a method
    own = free_names(cloud, "cell_x", "cell_y", "cell_z")
    cells = cloud.withColumns({n: G.axis_code(F.col(c), depth) for n, c in zip(own, "xyz", strict=True)})
    return cells.withColumn("code", G.interleave(*[F.col(n) for n in own], depth)).drop(*own)


def prefix_counts(cloud: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(depth, code, n) of every cell with points at every depth from 0 on; finest cells are counted before they fan out."""
    cells = with_codes(cloud, depth).groupBy("code").agg(F.count("*").alias("n"))
    fan = cells.select("code", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("depth"))
    return fan.groupBy("depth", prefix(F.col("code"), F.col("depth"), depth).alias("code")).agg(F.sum("n").alias("n"))


def build(cloud: DataFrame, depth: int = MAX_DEPTH, cap: int = LEAF_CAP) -> DataFrame:
    """(depth, code, n, is_leaf) of each node: a node is split while it has more than cap points and lies above `depth`."""
    counts = prefix_counts(cloud, depth)
    split = counts.where((F.col("n") > cap) & (F.col("depth") < depth)).select((F.col("depth") + 1).alias("depth"), F.col("code").alias("up"))
    nodes = counts.withColumn("up", F.shiftright("code", 3)).join(split, ["depth", "up"], "left_semi").drop("up")
    root = counts.where(F.col("depth") == 0)
    return root.unionByName(nodes).withColumn("is_leaf", (F.col("n") <= cap) | (F.col("depth") == depth))


def fixed_depth(cloud: DataFrame, depth: int) -> DataFrame:
    """(depth, code, n) of all nodes of the tree that is split down to `depth` wherever there are points."""
    return prefix_counts(cloud, depth)


def leaf_of(cloud: DataFrame, nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """cloud with the depth and code of each point's leaf, as leaf_depth and leaf_code."""
    coded = with_codes(cloud, depth)
    leaves = nodes.where("is_leaf").select(F.col("depth").alias("leaf_depth"), F.col("code").alias("leaf_code"))
    cells = coded.select("code").distinct().withColumn("leaf_depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    cells = cells.withColumn("leaf_code", prefix(F.col("code"), F.col("leaf_depth"), depth))
    return coded.join(cells.join(leaves, ["leaf_depth", "leaf_code"]), "code").drop("code")


def _moments(attributes: list[str], weight: str) -> list[Column]:
    w = F.col(weight)
    sums = [F.sum(a).alias(f"sum_{a}") for a in attributes] + [F.sum(w).alias("weight"), F.count("*").alias("n")]
    means = [F.when(F.sum(w) != 0, F.sum(F.col(k) * w) / F.sum(w)).otherwise(F.avg(k)).alias(f"mean_{k}") for k in "xyz"]
    return sums + means


def leaf_moments(cloud: DataFrame, nodes: DataFrame, attributes: list[str], weight: str, depth: int = MAX_DEPTH) -> DataFrame:
    """Of each leaf: sums of the attributes and the weight, and the weighted mean position (plain if weights sum to 0)."""
    placed = leaf_of(cloud, nodes, depth).withColumnsRenamed({"leaf_depth": "depth", "leaf_code": "code"})
    return placed.groupBy("depth", "code").agg(*_moments(attributes, weight))


def node_moments(cloud: DataFrame, nodes: DataFrame, attributes: list[str], weight: str, depth: int = MAX_DEPTH) -> DataFrame:
    """leaf_moments() of all nodes: one aggregate over all prefixes, in place of a sweep per level.

    Finest cells are summed first, so what fans out is the occupied cells, not the points.
    """
    w = F.col(weight)
    parts = {f"sum_{a}": F.sum(a) for a in attributes} | {"weight": F.sum(w), "n": F.count("*")}
    parts |= {f"s{k}": F.sum(k) for k in "xyz"} | {f"w{k}": F.sum(F.col(k) * w) for k in "xyz"}
    cells = with_codes(cloud, depth).groupBy("code").agg(*[c.alias(k) for k, c in parts.items()])
    fan = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("code", prefix(F.col("code"), F.col("depth"), depth))
    sums = fan.groupBy("depth", "code").agg(*[F.sum(k).alias(k) for k in parts])
    sums = sums.join(nodes.select("depth", "code", "is_leaf"), ["depth", "code"])
    means = {f"mean_{k}": F.when(F.col("weight") != 0, F.col(f"w{k}") / F.col("weight")).otherwise(F.col(f"s{k}") / F.col("n")) for k in "xyz"}
    return sums.withColumns(means).drop(*[f"{p}{k}" for p in "sw" for k in "xyz"])


def statistics(nodes: DataFrame) -> DataFrame:
    """One row (nodes, leaves, max_depth)."""
    return nodes.agg(F.count("*").alias("nodes"), F.count_if("is_leaf").alias("leaves"), F.max("depth").alias("max_depth"))


def in_preorder(nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """nodes with their place in pre-order; a range-partitioned sort gives the places without one big task."""
    return with_places(nodes.withColumn("first", F.call_function("shiftleft", F.col("code"), (F.lit(depth) - F.col("depth")).cast("int") * 3)), ["first", "depth"]).drop("first")


def with_places(df: DataFrame, order: list[str], name: str = "place", parts: int | None = None) -> DataFrame:
    """df with its rows' places, from 0, in this order, which must be total: ranks in range partitions plus their offsets."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, before = free_names(df, "part", "before")
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy(part).count().orderBy(part).collect()  # one row a partition
    offsets, total = [], 0
    for row in sizes:
        offsets.append((row[part], total))
        total += row["count"]
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    table = df.sparkSession.createDataFrame(offsets, f"{part} int, {before} long")
    placed = ranged.withColumn(name, own.cast("long")).join(F.broadcast(table), part)
    return placed.withColumn(name, F.col(name) + F.col(before)).drop(part, before)


def depth_index(nodes: DataFrame) -> DataFrame:
    """nodes with contiguous ids over all depths, shallow first, in code order within a depth."""
    return with_places(nodes, ["depth", "code"], "node_id")


def offsets(nodes: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """nodes with their cell indices ox, oy, oz at their own depth."""
    out = {}
    for axis, name in enumerate(("ox", "oy", "oz")):
        bits = F.lit(0).cast("long")
        for level in range(depth):
            bit = F.shiftright("code", 3 * level + axis).bitwiseAND(F.lit(1).cast("long"))
            bits = bits.bitwiseOR(F.shiftleft(bit, level))
        out[name] = bits
    return nodes.withColumns(out)


def neighbours(nodes: DataFrame, radius: int = 1, depth: int = MAX_DEPTH) -> DataFrame:
    """(depth, code, near) for all nodes of one depth that are at most `radius` cells apart on each axis, itself included."""
    placed = offsets(nodes.select("depth", "code"), depth)
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    moved = placed
    for name in ("ox", "oy", "oz"):
        moved = moved.withColumn("step", F.explode(steps)).withColumn(name, F.col(name) + F.col("step"))
    near = placed.select("depth", "ox", "oy", "oz", F.col("code").alias("near"))
    return moved.drop("step").join(near, ["depth", "ox", "oy", "oz"]).select("depth", "code", "near")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """(depth, code, n) of both trees together."""
    return a.select("depth", "code", "n").unionByName(b.select("depth", "code", "n")).groupBy("depth", "code").agg(F.sum("n").alias("n"))


def prune(nodes: DataFrame, depth: int) -> DataFrame:
    """The nodes down to `depth`."""
    return nodes.where(F.col("depth") <= depth)


def subtree(nodes: DataFrame, root_depth: int, root_code: int) -> DataFrame:
    """The nodes under one node, itself included."""
    ancestor = F.call_function("shiftright", F.col("code"), ((F.col("depth") - root_depth) * 3).cast("int"))
    return nodes.where((F.col("depth") >= root_depth) & (ancestor == root_code))


def refine(nodes: DataFrame, full_depth: int) -> DataFrame:
    """nodes with all cells down to `full_depth` added, empty ones with n = 0."""
    grid = nodes.sparkSession.range(sum(8**d for d in range(full_depth + 1))).select(F.col("id"))
    # the first (8**d - 1) / 7 ids belong to the depths above d
    depth = F.lit(0)
    for d in range(1, full_depth + 1):
        depth = F.when(F.col("id") >= (8**d - 1) // 7, d).otherwise(depth)
    start = F.element_at(F.array(*[F.lit((8**d - 1) // 7) for d in range(full_depth + 1)]), depth + 1)
    full = grid.select(depth.alias("depth"), (F.col("id") - start).alias("code"))
    return full.join(nodes.select("depth", "code", "n"), ["depth", "code"], "full").select("depth", "code", F.coalesce("n", F.lit(0)).alias("n"))
