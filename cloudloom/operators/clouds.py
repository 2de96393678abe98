"""Point clouds: filtering, decimation, extents, normalisation, validation and nearest-neighbour joins.

A cloud has point_id and DOUBLE columns x, y, z; any other columns are attributes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.functions.names import free_names

XYZ = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")
#: Columns that a nearest-neighbour join copies where the source has them.
ATTRIBUTES = ("nx", "ny", "nz", "red", "green", "blue", "intensity")


def cols(names=XYZ, prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def finite_points(cloud: DataFrame, mode: str = "drop") -> DataFrame:
    """The rows with finite coordinates; mode "fail" raises when it meets another one."""
    good = G.is_finite(*cols())
    if mode == "fail":
        return cloud.where(F.when(good, True).otherwise(F.raise_error(F.lit("a point isn't finite")).cast("boolean")))
    if mode != "drop":
        raise ValueError("mode is drop or fail")
    return cloud.where(good)


def with_cells(cloud: DataFrame, distance: float) -> DataFrame:
    """cloud with the cell indices ix, iy, iz of a grid of this width."""
    return cloud.withColumns({f"i{n}": G.cell_index(F.col(n), distance) for n in XYZ})


def decimate(cloud: DataFrame, distance: float, late: bool = False) -> DataFrame:
    """One original row of each occupied grid cell: the one with the least point_id.

    Points that aren't finite are dropped first. The kept rows are partial aggregates, so a dense cell
    is thinned before the shuffle. late: aggregate ids alone and fetch the rows of the survivors by a
    semi-join, which moves less where rows are wide and few survive; point_id must be unique then.
    """
    keys = free_names(cloud, "ix", "iy", "iz")  # the cloud's own columns of these names are attributes
    rows = finite_points(cloud).withColumns({k: G.cell_index(F.col(n), distance) for k, n in zip(keys, XYZ, strict=True)})
    if late:
        ids = rows.groupBy(*keys).agg(F.min("point_id").alias("point_id"))
        return cloud.join(ids.select("point_id"), "point_id", "left_semi")
    whole = F.struct("point_id", *[F.col(f"`{c}`") for c in cloud.columns if c != "point_id"])
    best = F.min(whole) if _orderable(cloud) else F.min_by(whole, "point_id")
    return rows.groupBy(*keys).agg(best.alias("row")).select("row.*").select(*[F.col(f"`{c}`") for c in cloud.columns])


def _orderable(cloud: DataFrame) -> bool:
    return all("map" not in kind and "variant" not in kind for _, kind in cloud.dtypes)


def occupied_cells(cloud: DataFrame, distance: float) -> DataFrame:
    """(ix, iy, iz, n, first) of each occupied cell: its number of points and its least point_id."""
    return with_cells(finite_points(cloud), distance).groupBy("ix", "iy", "iz").agg(F.count("*").alias("n"), F.min("point_id").alias("first"))


def reduction(cloud: DataFrame, distance: float) -> DataFrame:
    """One row (total, kept, reduction_percent) of a decimation; total counts finite points."""
    counts = occupied_cells(cloud, distance).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("kept"))
    return counts.withColumn("reduction_percent", F.when(F.col("total") > 0, 100.0 * (1.0 - F.col("kept") / F.col("total"))).otherwise(0.0))


def extent(cloud: DataFrame) -> DataFrame:
    """One row with the least and greatest coordinate of each axis."""
    return cloud.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in XYZ for f in (F.min, F.max)])


def merge_extents(extents: DataFrame) -> DataFrame:
    """One extent that covers all extents."""
    return extents.agg(*[f(f"{f.__name__}_{n}").alias(f"{f.__name__}_{n}") for n in XYZ for f in (F.min, F.max)])


@dataclass(frozen=True)
class Frame:
    """A translation and uniform scale: x becomes (x - centre) * scale."""

    centre: tuple[float, float, float]
    scale: float


def cube_frame(cloud: DataFrame, margin: float = 1.1) -> Frame:
    """The frame that puts a cloud into [-1, 1]**3, its longest side 2 / margin long."""
    row = extent(cloud).first()
    low, high = [row[f"min_{n}"] for n in XYZ], [row[f"max_{n}"] for n in XYZ]
    if any(v is None for v in low):
        raise ValueError("a cloud without points")
    longest = max(h - v for v, h in zip(low, high, strict=True))
    if longest <= 0:
        raise ValueError("all points of the cloud coincide")
    return Frame(tuple((v + h) / 2 for v, h in zip(low, high, strict=True)), 2.0 / (margin * longest))


def normalize(cloud: DataFrame, margin: float = 1.1) -> DataFrame:
    """cloud in the cube [-1, 1]**3: centred, scaled alike on all axes. The extent is one broadcast row."""
    box = F.broadcast(extent(cloud))
    longest = F.greatest(*[F.col(f"max_{n}") - F.col(f"min_{n}") for n in XYZ])
    scaled = {n: (F.col(n) - (F.col(f"min_{n}") + F.col(f"max_{n}")) / 2.0) * (2.0 / (margin * longest)) for n in XYZ}
    return cloud.join(box).withColumns(scaled).select(*cloud.columns)


def unit_frame(cloud: DataFrame, factor: float = 1.1) -> list[list[float]]:
    """Rows of the affine map into [0, 1]**3 with the longest axis last, scaled by 1 / (factor * longest side)."""
    row = extent(cloud).first()
    low, high = [row[f"min_{n}"] for n in XYZ], [row[f"max_{n}"] for n in XYZ]
    sides = [h - v for v, h in zip(low, high, strict=True)]
    last = max(range(3), key=lambda k: sides[k])
    order = [(last + 1) % 3, (last + 2) % 3, last]
    scale = 1.0 / (factor * max(sides))
    out = []
    for axis in order:
        line = [0.0, 0.0, 0.0, 0.5 - (low[axis] + high[axis]) / 2 * scale]
        line[axis] = scale
        out.append(line)
    return out


def transform(cloud: DataFrame, rows: list[list[float]]) -> DataFrame:
    """cloud under an affine map; normals, where there are any, under its linear part."""
    out = dict(zip(XYZ, G.affine(cols(), rows), strict=True))
    if set(NORMAL) <= set(cloud.columns):
        turned = G.affine(cols(NORMAL), [[*row[:3], 0.0] for row in rows])
        out |= dict(zip(NORMAL, G.normalized(turned), strict=True))
    return cloud.withColumns(out)


#: Checks of validate(), in the order in which a point is judged.
CHECKS = ("too_few", "coordinates", "normals", "length")


def validate(cloud: DataFrame, normal_length: bool = False, least: int = 3) -> DataFrame:
    """One row (n, ok, error, point_id): the first check of CHECKS that fails and the least point that fails it.

    Normals are checked where the cloud has them; normal_length also asks for a squared length over 1e-12.
    """
    bad = {"coordinates": ~G.is_finite(*cols())}
    if set(NORMAL) <= set(cloud.columns):
        bad["normals"] = ~G.is_finite(*cols(NORMAL))
        if normal_length:
            bad["length"] = ~(G.dot(cols(NORMAL), cols(NORMAL)) > G.EPSILON)
    firsts = [F.min(F.when(test, F.col("point_id"))).alias(name) for name, test in bad.items()]
    found = cloud.agg(F.count("*").alias("n"), *firsts)
    error, point = F.lit(None).cast("string"), F.lit(None).cast("long")
    for name in reversed(list(bad)):
        error = F.when(F.col(name).isNotNull(), F.lit(name)).otherwise(error)
        point = F.when(F.col(name).isNotNull(), F.col(name)).otherwise(point)
    error = F.when(F.col("n") < least, F.lit("too_few")).otherwise(error)
    point = F.when(F.col("n") >= least, point)
    return found.select("n", error.isNull().alias("ok"), error.alias("error"), point.alias("point_id"))


#: Rounds over cells around the targets, then the depth of the sources' tree and the levels taken at a time.
NEAR_ROUNDS, TREE_DEPTH, TREE_STEP = 2, 18, 3


def nearest(targets: DataFrame, sources: DataFrame, cell: float | None = None) -> DataFrame:
    """(target_id, source_id, distance2) with the exact nearest source of each target, of equally near ones the least id.

    Sources are bucketed by grid cell. A target looks at the 27 cells around it; once it has found a source
    within a cell's width, nothing nearer can be outside the cells that it saw. What NEAR_ROUNDS such
    rounds, the second with cells twice as wide, don't settle is far from the sources: it goes down the
    sources' octree, where only nodes whose box is no farther than the nearest source known so far stay.
    Targets that aren't finite find nothing; without sources no target does.
    """
    # of sources at one place only the least id can be an answer
    sources = finite_points(sources).groupBy(*XYZ).agg(F.min("point_id").alias("point_id")).checkpoint()
    t = targets.select(F.col("point_id").alias("target_id"), *[F.col(n).alias(f"t{n}") for n in XYZ])
    s = sources.select(F.col("point_id").alias("source_id"), *[F.col(n).alias(f"s{n}") for n in XYZ])
    if s.isEmpty():
        return t.limit(0).select("target_id", F.lit(None).cast("long").alias("source_id"), F.lit(0.0).alias("distance2"))
    cell = cell or _usual_cell(sources)
    done: DataFrame | None = None
    left = t.where(G.is_finite(*cols(prefix="t")))
    offsets = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]
    around = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip("abc", o, strict=True)]) for o in offsets]))
    for _ in range(NEAR_ROUNDS):
        bucketed = s.withColumns({f"i{n}": F.floor(F.col(f"s{n}") / cell) for n in XYZ})
        seeking = left.withColumn("o", around).withColumns({f"i{n}": F.floor(F.col(f"t{n}") / cell) + F.col(f"o.{k}") for n, k in zip(XYZ, "abc", strict=True)}).drop("o")
        found = seeking.join(bucketed, ["ix", "iy", "iz"]).groupBy("target_id").agg(_best())
        settled = found.where(F.sqrt("best.d2") <= cell).select("target_id", F.col("best.source_id").alias("source_id"), F.col("best.d2").alias("distance2"))
        settled = settled.checkpoint()
        done = settled if done is None else done.unionByName(settled)
        left = left.join(settled.select("target_id"), "target_id", "left_anti").checkpoint()
        if left.isEmpty():
            return done
        cell *= 2
    return done.unionByName(_nearest_by_tree(left, sources))


def _best() -> Column:
    d2 = G.dot(*[G.minus(cols(prefix="t"), cols(prefix="s"))] * 2)
    return F.min(F.struct(d2.alias("d2"), "source_id")).alias("best")


def _nearest_by_tree(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """nearest() by branch and bound: a target keeps the nodes whose box is no farther than the nearest representative that it met."""
    from cloudloom.operators import octree

    row = extent(sources).first()
    low = [row[f"min_{n}"] for n in XYZ]
    half = max(row[f"max_{n}"] - v for n, v in zip(XYZ, low, strict=True)) / 2 or 1.0
    place = sources.select("point_id", *[F.col(n).alias(f"s{n}") for n in XYZ], *[((F.col(n) - v) / half - 1.0).alias(n) for n, v in zip(XYZ, low, strict=True)])
    coded = octree.with_codes(place, TREE_DEPTH).drop(*XYZ).checkpoint()
    frontier = targets.withColumns({"code": F.lit(0).cast("long"), "best": F.lit(float("inf"))})
    w = Window.partitionBy("target_id")
    for depth in range(TREE_STEP, TREE_DEPTH + 1, TREE_STEP):
        own = octree.prefix(F.col("code"), F.lit(depth), TREE_DEPTH)
        nodes = coded.groupBy(own.alias("node")).agg(
            F.min(F.struct("point_id", *[f"s{n}" for n in XYZ])).alias("r"), *[f(f"s{n}").alias(f"{f.__name__}_{n}") for n in XYZ for f in (F.min, F.max)]
        )
        nodes = nodes.withColumn("code", F.shiftright("node", 3 * TREE_STEP))
        met = frontier.join(F.broadcast(nodes) if depth == TREE_STEP else nodes, "code")  # the first nodes are 8**TREE_STEP at most
        t = cols(prefix="t")
        to_rep = [a - F.col(f"r.s{n}") for a, n in zip(t, XYZ, strict=True)]
        to_box = [F.greatest(F.col(f"min_{n}") - a, a - F.col(f"max_{n}"), F.lit(0.0)) for a, n in zip(t, XYZ, strict=True)]
        met = met.select("target_id", *t, F.col("node").alias("code"), "best", G.dot(to_rep, to_rep).alias("reached"), G.dot(to_box, to_box).alias("least"))
        met = met.withColumn("best", F.least("best", F.min("reached").over(w)))
        # a box that rounding sets a little too far away must not go
        frontier = met.where(F.col("least") <= F.col("best") * (1.0 + 1e-12)).drop("reached", "least").checkpoint()
    found = frontier.join(coded.withColumnRenamed("point_id", "source_id"), "code").groupBy("target_id").agg(_best())
    return found.select("target_id", F.col("best.source_id").alias("source_id"), F.col("best.d2").alias("distance2"))


def _usual_cell(sources: DataFrame, most: int = 256) -> float:
    """A cell width at which no cell holds more than `most` of the sources, which have distinct coordinates."""
    row = extent(sources).first()
    longest = max(row[f"max_{k}"] - row[f"min_{k}"] for k in XYZ)
    cell = (longest / max(1.0, sources.count() ** (1 / 3))) or 1.0
    for _ in range(40):
        cells = sources.groupBy(*[F.floor(F.col(k) / cell) for k in XYZ]).count()
        if cells.agg(F.max("count")).first()[0] <= most:
            break
        cell /= 4
    return cell


def transfer_attributes(targets: DataFrame, sources: DataFrame, cell: float | None = None) -> DataFrame:
    """targets with the attributes of the nearest source; without sources they come back as they are."""
    copied = [c for c in ATTRIBUTES if c in sources.columns]
    if not copied or sources.isEmpty():
        return targets
    pairs = nearest(targets, sources, cell).select(F.col("target_id").alias("point_id"), "source_id")
    values = sources.select(F.col("point_id").alias("source_id"), *copied)
    kept = targets.drop(*copied)
    return kept.join(pairs.join(values, "source_id"), "point_id", "left").drop("source_id")
