import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import nbody, solver
from tests.test_clouds import cloud, random_cloud


def with_attributes(df, seed=3):
    r = np.random.default_rng(seed).normal(size=(df.count(), 4))
    rows = [(i, *map(float, v)) for i, v in enumerate(r)]
    return r, df.join(df.sparkSession.createDataFrame(rows, "point_id long, mx double, my double, mz double, s double"), "point_id")


def brute(kind, at, attributes, width):
    a = attributes[:, 3:] if kind == "AT" else attributes[:, :3]
    return nbody.kernel(kind, at[:, None] - at[None], a[None], width).sum(axis=1)


def plain_treecode(kind, at, attributes, width, depth, cap, far=4.0):
    """Node by node for each query, as the program's kernels are told: far if over far half widths from the weighted mean."""
    a = attributes[:, 3:] if kind == "AT" else attributes[:, :3]
    w = np.sqrt((a * a).sum(axis=1))
    out = np.zeros((len(at), nbody.KINDS[kind][1]))

    def visit(own, centre, half, level, queries):
        mean = (at[own] * w[own, None]).sum(axis=0) / w[own].sum()
        away = ((at[queries] - mean) ** 2).sum(axis=1) > (far * half) ** 2
        out[queries[away]] += nbody.kernel(kind, at[queries[away]] - mean, a[own].sum(axis=0)[None], width)
        queries = queries[~away]
        if not len(queries):
            return
        if len(own) <= cap or level == depth:
            out[queries] += nbody.kernel(kind, at[queries][:, None] - at[own][None], a[own][None], width).sum(axis=1)
            return
        side = at[own] >= centre
        for code in np.unique(side, axis=0):
            child = own[(side == code).all(axis=1)]
            visit(child, centre + np.where(code, half / 2, -half / 2), half / 2, level + 1, queries)

    visit(np.arange(len(at)), np.zeros(3), 1.0, 0, np.arange(len(at)))
    return out


@pytest.mark.parametrize("kind", ["A", "AT", "G"])
def test_exact_sums_and_treecode(spark, kind, monkeypatch):
    at, df = random_cloud(spark, 250, kind="sphere")
    attributes, df = with_attributes(df)
    want = brute(kind, at, attributes, 0.05)
    got = nbody.exact(kind, df, df, 0.05).orderBy("point_id").drop("point_id").toPandas().to_numpy()
    assert np.allclose(got, want)
    monkeypatch.setattr(nbody, "BLOCK", 100)
    got = nbody.exact(kind, df, df, 0.05).orderBy("point_id").drop("point_id").toPandas().to_numpy()
    assert np.allclose(got, want)
    tree = nbody.treecode(kind, df, df, 0.05, 6, 4).orderBy("point_id").drop("point_id").toPandas().to_numpy()
    assert np.allclose(tree, plain_treecode(kind, at, attributes, 0.05, 6, 4))
    assert np.linalg.norm(tree - want) < 0.02 * np.linalg.norm(want)


@pytest.mark.parametrize("kind", ["A", "AT", "G"])
def test_interactions_of_groups(spark, kind, monkeypatch):
    monkeypatch.setattr(nbody, "GROUP", 16)
    at, df = random_cloud(spark, 600, kind="sphere")
    attributes, df = with_attributes(df)
    a = attributes[:, 3:] if kind == "AT" else attributes[:, :3]
    want = brute(kind, at, attributes, 0.05)
    assert np.allclose(nbody.Kernels(at, at, 0.05).apply(kind, a), want)
    t = nbody.Tree(at, 8, 4)
    own = a[t.order]
    (got,) = nbody.Interactions(t).apply(t.groups, [(kind, own, t.sums(own))], 0.05)
    assert np.linalg.norm(got - want[t.order]) < 0.02 * np.linalg.norm(want)
    far = [t.interactions(int(g))[0] for g in t.groups]
    assert any(len(f) for f in far) and sorted(np.concatenate([np.arange(t.start[g], t.end[g]) for g in t.groups])) == list(range(600))
    lists = nbody.GroupLists(df.select("point_id", "x", "y", "z"), 8, 4)
    tables = lists.apply(kind, df.drop("x", "y", "z"), 0.05).orderBy("point_id").drop("point_id").toPandas().to_numpy()
    assert np.allclose(tables[t.order], got)


def test_many_sources_at_one_place_are_one_source(spark):
    df = cloud(spark, [(0.5, 0.5, 0.5)] * 300 + [(-0.5, 0.0, 0.0)]).withColumns({"mx": F.lit(0.1), "my": F.lit(0.0), "mz": F.lit(0.0)})
    got = {r["point_id"]: r["value"] for r in nbody.treecode("A", df.where("point_id = 300"), df, 0.05, 6, 4).collect()}
    d = np.array([-1.0, -0.5, -0.5])
    assert abs(got[300] - 300 * -(d[0] * 0.1) / np.linalg.norm(d) ** 3) < 1e-9


def test_a_is_the_winding_number_of_a_closed_surface(spark):
    n = 2000
    k = np.arange(n) + 0.5
    height, angle = 1 - 2 * k / n, np.pi * (1 + 5**0.5) * k
    ring = np.sqrt(1 - height**2)
    at = np.column_stack([ring * np.cos(angle), ring * np.sin(angle), height]) * 0.7
    area = 4 * np.pi * 0.49 / n
    mu = at / 0.7 * area / (4 * np.pi)
    inside = nbody.kernel("A", np.array([[0.1, 0.2, 0.0]])[:, None] - at[None], mu[None], 0.01).sum()
    outside = nbody.kernel("A", np.array([[0.9, 0.9, 0.9]])[:, None] - at[None], mu[None], 0.01).sum()
    assert abs(inside - 1) < 0.01 and abs(outside) < 0.01


def sphere(spark, radius=1.0):
    u, v = np.meshgrid(np.arange(21) * np.pi / 20, np.arange(20) * np.pi / 10, indexing="ij")
    at = radius * np.column_stack([(np.sin(u) * np.cos(v)).ravel(), (np.sin(u) * np.sin(v)).ravel(), np.cos(u).ravel()])
    return at, cloud(spark, at.tolist())


def test_normals_of_the_unit_sphere_point_outward(spark):
    at, df = sphere(spark)
    n = solver.estimate_normals(df, iterations=10, preset="custom", low=0.05, high=0.2, depth=10, cap=1).orderBy("point_id").toPandas()[["nx", "ny", "nz"]].to_numpy()
    assert np.allclose(np.linalg.norm(n, axis=1), 1, atol=1e-4)
    assert ((n * at).sum(axis=1) > 0).all()


def test_passes_in_tables_equal_those_in_memory(spark, monkeypatch):
    monkeypatch.setattr(nbody, "GROUP", 8)
    _, df = random_cloud(spark, 200, kind="sphere")
    args = {"iterations": 2, "preset": "l5", "cap": 4, "depth": 5}
    a = solver.estimate_normals(df, **args).orderBy("point_id").toPandas().to_numpy()
    b = solver.estimate_normals(df, most_local=10, **args).orderBy("point_id").toPandas().to_numpy()
    assert np.allclose(a, b, atol=1e-9)


def test_widths_and_annealing():
    assert solver.widths("l1") == (0.01, 0.04)
    with pytest.raises(ValueError):
        solver.widths("custom", 0.2, 0.1)
    with pytest.raises(ValueError):
        solver.widths("l9")
    assert [round(solver.annealed(k, 3, 0.1, 0.3), 9) for k in range(3)] == [0.3, 0.2, 0.1]


def test_residual_norms(spark):
    r = spark.createDataFrame([(1, 1.0, 2.0, 2.0)], "point_id long, vx double, vy double, vz double")
    a = spark.createDataFrame([(1, 3.0)], "point_id long, value double").withColumn("more", F.lit(1))
    assert tuple(solver.residual_norms(r, a).first()) == (9.0, 9.0)
