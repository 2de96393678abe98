import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import clouds, octree

SCHEMA = "point_id long, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], SCHEMA)


def random_cloud(spark, n, seed=0, kind="cube"):
    at = np.random.default_rng(seed).uniform(-0.9, 0.9, (n, 3))
    if kind == "sphere":
        at = at / np.linalg.norm(at, axis=1, keepdims=True) * 0.8
    return at, cloud(spark, at.tolist())


def test_near_points_share_a_cell_and_one_survives(spark):
    df = cloud(spark, [(0, 0, 0), (0.01, 0.02, 0.03), (1, 1, 1)])
    assert [r["point_id"] for r in clouds.decimate(df, 0.05).orderBy("point_id").collect()] == [0, 2]


def test_grid_keeps_one_original_row_a_cell(spark):
    df = spark.range(10_000).select(F.col("id").alias("point_id"), ((F.col("id") / 100).cast("int") * 0.01).alias("x"), (F.col("id") % 100 * 0.01).alias("y"), F.lit(0.0).alias("z"), F.lit(1.0).alias("nz"))
    kept = clouds.decimate(df, 0.05)
    assert 0 < kept.count() < 10_000
    assert kept.count() == clouds.occupied_cells(df, 0.05).count()
    assert kept.join(df, df.columns, "left_semi").count() == kept.count()
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, clouds.decimate(df, 0.05, late=True).collect()))


def test_decimation_drops_bad_points_and_rejects_bad_widths(spark):
    df = cloud(spark, [(0, 0, 0), (math.nan, 0, 0), (0, math.inf, 0), (2, 2, 2)]).withColumns({"red": F.col("point_id").cast("short"), "tags": F.create_map(F.lit("a"), F.lit(1))})
    assert [r["red"] for r in clouds.decimate(df, 0.05).orderBy("point_id").collect()] == [0, 3]
    with pytest.raises(ValueError):
        clouds.decimate(df, 0.0)
    with pytest.raises(Exception, match="isn't finite"):
        clouds.finite_points(df, "fail").collect()


def test_decimation_keeps_attributes_of_any_name(spark):
    df = cloud(spark, [(0, 0, 0), (0.01, 0, 0), (3, 3, 3)]).withColumns({"ix": F.lit(777), "iy": F.lit("b"), "_iz": F.lit(1.5), "iz": F.lit(2.5), "a.b": F.lit(9)})
    for late in (False, True):
        got = clouds.decimate(df, 0.05, late).orderBy("point_id").collect()
        assert [(r["point_id"], r["ix"], r["iy"], r["_iz"], r["iz"], r["a.b"]) for r in got] == [(0, 777, "b", 1.5, 2.5, 9), (2, 777, "b", 1.5, 2.5, 9)]


def test_far_targets_find_their_nearest_source(spark):
    """Targets in a heap far from all sources: they go down the tree, and no cell holds them all with all sources."""
    at, sources = random_cloud(spark, 500, seed=1)
    far = np.random.default_rng(2).normal(size=(60, 3)) * 3 + [400, -900, 50]
    targets = cloud(spark, [*far.tolist(), (math.nan, 0, 0), (0, 0, 0), (1e9, 1e9, 1e9)])
    got = {r["target_id"]: r["source_id"] for r in clouds.nearest(targets, sources).collect()}
    places = [*far, None, np.zeros(3), np.full(3, 1e9)]
    assert 60 not in got and len(got) == 62
    for k, p in enumerate(places):
        if p is not None:
            d = ((at - p) ** 2).sum(axis=1)
            assert abs(d[got[k]] - d.min()) <= 1e-9 * d.min()


def test_packed_keys(spark):
    rows = [(10, 20, 30), (10, 20, 30), (20, 10, 30), (-5, -10, -15), (5, 10, 15), (10 + 2**21, 20, 30)]
    df = spark.createDataFrame(rows, "a int, b int, c int").select(G.pack_key(F.col("a"), F.col("b"), F.col("c")).alias("k"))
    k = [r["k"] for r in df.collect()]
    assert k[0] == k[1] == k[5] and len({*k}) == 4


@pytest.mark.parametrize(
    ("rows", "error", "point"),
    [([(1, 2, 3)] * 2, "too_few", None), ([(1, 2, 3), (1, math.nan, 3), (4, 5, 6)], "coordinates", 1), ([(1, 2, 3)] * 3, None, None)],
)
def test_validation(spark, rows, error, point):
    r = clouds.validate(cloud(spark, rows)).first()
    assert (r["ok"], r["error"], r["point_id"]) == (error is None, error, point)


def test_validation_of_normals(spark):
    df = cloud(spark, [(1, 2, 3)] * 4).withColumns({"nx": F.when(F.col("point_id") == 2, float("nan")).otherwise(0.0), "ny": F.lit(0.0), "nz": F.when(F.col("point_id") == 1, 0.0).otherwise(1.0)})
    assert clouds.validate(df).first()["error"] == "normals"
    assert clouds.validate(df.where("point_id <> 2"), normal_length=True).first().asDict() == {"n": 3, "ok": False, "error": "length", "point_id": 1}


@pytest.mark.parametrize("cell", [None, 0.01, 5.0])
def test_nearest_equals_brute_force(spark, cell):
    at, df = random_cloud(spark, 400)
    far, more = random_cloud(spark, 60, 1)
    far = np.vstack([far, [[50.0, -20.0, 3.0]], at[:3]])
    got = {r["target_id"]: r["source_id"] for r in clouds.nearest(cloud(spark, far.tolist()), df, cell).collect()}
    d = ((far[:, None] - at[None]) ** 2).sum(axis=2)
    assert got == dict(enumerate(d.argmin(axis=1).tolist()))


def test_nearest_ties_and_coincident_sources(spark):
    sources = cloud(spark, [(1, 0, 0), (-1, 0, 0), (1, 0, 0), *[(5, 5, 5)] * 600])
    got = clouds.nearest(cloud(spark, [(0, 0, 0), (5, 5, 5.1)]), sources).orderBy("target_id").collect()
    assert [r["source_id"] for r in got] == [0, 3]


def test_transfer_copies_attributes_and_does_nothing_without_sources(spark):
    sources = cloud(spark, [(0, 0, 0), (10, 10, 10)]).withColumns({"red": (F.col("point_id") + 7).cast("short"), "nx": F.lit(0.5)})
    targets = cloud(spark, [(0.05, 0.05, 0.05), (9.95, 9.95, 9.95)])
    got = clouds.transfer_attributes(targets, sources).orderBy("point_id").collect()
    assert [(r["red"], r["nx"]) for r in got] == [(7, 0.5), (8, 0.5)]
    assert clouds.transfer_attributes(targets, sources.limit(0)).columns == targets.columns


def brute_tree(points, depth, cap):
    nodes = {}

    def walk(ids, centre, half, level, code):
        leaf = len(ids) <= cap or level == depth
        nodes[level, code] = (len(ids), leaf)
        if leaf:
            return
        for k in range(8):
            high = np.array([k & 1, k >> 1 & 1, k >> 2 & 1], dtype=bool)
            own = ids[((points[ids] >= centre) == high).all(axis=1)]
            if len(own):
                walk(own, centre + np.where(high, half / 2, -half / 2), half / 2, level + 1, code << 3 | k)

    walk(np.arange(len(points)), np.zeros(3), 1.0, 0, 0)
    return nodes


def test_octree_equals_the_recursive_one(spark):
    at, df = random_cloud(spark, 300)
    at[:5] = at[0]  # more coincident points than a leaf takes
    at[5] = (-1e-17, 0.0, 1e-300)
    df = cloud(spark, at.tolist())
    got = {(r["depth"], r["code"]): (r["n"], r["is_leaf"]) for r in octree.build(df, 6, 3).collect()}
    assert got == brute_tree(at, 6, 3)


def test_leaves_hold_every_point_once(spark):
    _, df = random_cloud(spark, 300)
    nodes = octree.build(df, 6, 3)
    placed = octree.leaf_of(df, nodes, 6)
    assert placed.count() == 300 and nodes.where("is_leaf").agg(F.sum("n")).first()[0] == 300
    assert octree.subtree(nodes, 0, 0).count() == nodes.count() == octree.in_preorder(nodes, 6).count()


def test_polynomials_and_splines(spark):
    one = spark.range(1)
    r = one.select(G.polynomial(F.lit(2.0), [1, 2, 3]).alias("p"), G.quadratic_roots(F.lit(1.0), F.lit(-3.0), F.lit(2.0)).alias("q"), sum(G.bspline_weights(F.lit(0.3)), F.lit(0.0)).alias("w")).first()
    assert r["p"] == 17.0 and r["q"] == [1.0, 2.0] and abs(r["w"] - 1) < 1e-12
    assert G.derivative([1, 2, 3]) == [2, 6] and G.integral([0, 2], 0, 3) == 9


def test_random_points_lie_where_they_should(spark):
    df = spark.range(500).select(*[c.alias(n) for c, n in zip(G.random_ball_point(4), "xyz", strict=True)])
    assert df.agg(F.max(G.norm(clouds.cols()))).first()[0] <= 1
    df = spark.range(500).select(*[c.alias(n) for c, n in zip(G.random_sphere_point(4), "xyz", strict=True)])
    assert abs(df.agg(F.min(G.norm(clouds.cols()))).first()[0] - 1) < 1e-9


def test_frames(spark):
    df = cloud(spark, [(0, 0, 0), (2, 4, 1)]).withColumns({"nx": F.lit(0.0), "ny": F.lit(2.0), "nz": F.lit(0.0)})
    out = clouds.transform(df, clouds.unit_frame(df)).orderBy("point_id").collect()
    assert abs(out[1]["z"] - out[0]["z"] - 1 / 1.1) < 1e-12 and out[0]["nz"] == 1.0
    frame = clouds.cube_frame(df)
    assert frame.centre == (1.0, 2.0, 0.5) and abs(frame.scale - 2 / (1.1 * 4)) < 1e-15
    with pytest.raises(ValueError):
        clouds.cube_frame(cloud(spark, [(1, 1, 1)] * 2))
