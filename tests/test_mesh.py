import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import linalg, mesh, poisson, repair, skeleton
from cloudloom.plans import pipeline
from tests.test_nbody import sphere

CUBE = [(k & 1, k >> 1 & 1, k >> 2 & 1) for k in range(8)]
SIDES = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]


def cube(spark, sides=6):
    rings = [t for a, b, c, d in SIDES[:sides] for t in ([a, b, c], [a, c, d])]
    return (
        spark.createDataFrame([(k, *map(float, p), float(p[2])) for k, p in enumerate(CUBE)], "vid long, x double, y double, z double, value double"),
        spark.createDataFrame(list(enumerate(rings)), "fid long, vids array<int>"),
    )


def test_open_and_closed_cubes(spark):
    _, faces = cube(spark)
    assert mesh.is_closed(faces).first()["closed"] and mesh.euler(faces).first()["characteristic"] == 2
    vertices, faces = cube(spark, 5)
    assert not mesh.is_closed(faces).first()["closed"] and mesh.mesh_checks(faces).first()["open_edges"] == 4
    v, f = repair.close(vertices, faces)
    assert mesh.is_closed(f).first()["closed"] and f.count() == 12 and v.count() == 8
    assert abs(mesh.face_areas(f, v).agg(F.sum("area")).first()[0] - 6) < 1e-12


def test_trimming_a_cube_at_half_height(spark):
    v, f = repair.trim(*cube(spark), threshold=0.5, ratio=0.001)
    assert v.agg(F.min("z"), F.max("z")).first() == (0.5, 1.0)
    assert abs(mesh.face_areas(f, v).agg(F.sum("area")).first()[0] - 3) < 1e-12
    v, f = repair.trim(*cube(spark), threshold=2.0)
    assert f.count() == 0


def test_islands_merge_in_order_of_area(spark):
    comps = spark.createDataFrame([(0, True, 100.0), (1, False, 0.01), (2, False, 50.0), (3, True, 0.001)], "comp long, above boolean, area double")
    near = spark.createDataFrame([(0, 1), (1, 0), (0, 2), (2, 0)], "comp long, near long")
    got = {r["comp"]: (r["into"], r["above"], r["lone"]) for r in repair.merge_islands(comps, near).collect()}
    assert got == {0: (0, True, False), 1: (0, True, False), 2: (2, False, False), 3: (3, True, True)}


def test_polygon_areas(spark):
    points = [(0, 0, 0), (2, 0, 0), (3, 1, 0), (2, 2, 0), (0, 2, 0)]
    vertices = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, [0, 1, 2, 3, 4]), (1, [0, 1, 3]), (2, [0, 1])], "fid long, vids array<int>")
    got = {r["fid"]: r["area"] for r in mesh.face_areas(faces, vertices).collect()}
    assert got[2] == 0 and abs(got[0] - 5) < 1e-12 and abs(got[1] - 2) < 1e-12
    assert poisson.triangulate(faces, vertices).count() == 3 + 1


def test_triangles_of_large_polygons_have_ids_of_their_own(spark):
    ring = lambda n, z: [(np.cos(2 * np.pi * k / n), np.sin(2 * np.pi * k / n), z) for k in range(n)]
    points = ring(100, 0.0) + ring(70, 1.0) + ring(3, 2.0)
    vertices = spark.createDataFrame([(k + (1 << 33), *map(float, p)) for k, p in enumerate(points)], "vid long, x double, y double, z double")
    rings = [list(range(100)), list(range(100, 170)), list(range(170, 173))]
    faces = spark.createDataFrame([(k + 5, [(1 << 33) + v for v in r]) for k, r in enumerate(rings)], "fid long, vids array<bigint>")
    got = poisson.triangulate(faces, vertices).collect()
    assert len(got) == 98 + 68 + 1 and sorted(r["fid"] for r in got) == list(range(167))
    v, f = mesh.compact(vertices, poisson.triangulate(faces, vertices))
    assert f.count() == 167 and f.where("size(vids) = 3").count() == 167 and v.count() == 173


def least_area(points):
    """The least area of all triangulations, by trying every one."""
    area = lambda a, b, c: np.linalg.norm(np.cross(points[b] - points[a], points[c] - points[a])) / 2

    def best(a, c):
        return 0.0 if c - a < 2 else min(best(a, b) + best(b, c) + area(a, b, c) for b in range(a + 1, c))

    return best(0, len(points) - 1)


@pytest.mark.parametrize("n", [3, 4, 5, 8])
def test_triangulations_have_the_least_area(n):
    points = np.random.default_rng(n).normal(size=(n, 3))
    got = poisson.polygon_triangles(points)
    area = sum(np.linalg.norm(np.cross(points[b] - points[a], points[c] - points[a])) / 2 for a, b, c in got)
    assert len(got) == n - 2 and abs(area - least_area(points)) < 1e-9


@pytest.mark.parametrize("n", [2000, 20_000])
def test_long_rims_are_filled_whole(n):
    k = np.arange(n) * 2 * np.pi / n
    points = np.column_stack([np.cos(k), np.sin(k), 0.01 * np.cos(9 * k)])
    got = poisson.polygon_triangles(points)
    edges = {}
    for t in got:
        for a, b in zip(t, (*t[1:], t[0]), strict=True):
            edges[a, b] = edges.get((a, b), 0) + 1
    assert len(got) == n - 2 and max(edges.values()) == 1
    assert {(a, b) for a, b in edges if (b, a) not in edges} == {(a, (a + 1) % n) for a in range(n)}


def test_a_hole_of_two_thousand_edges_is_closed(spark):
    n = 2000
    at = [(np.cos(2 * np.pi * k / n), np.sin(2 * np.pi * k / n), z) for z in (0.0, 1.0) for k in range(n)]
    vertices = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "vid long, x double, y double, z double")
    sides = [t for k in range(n) for t in ([k, (k + 1) % n, n + k], [(k + 1) % n, n + (k + 1) % n, n + k])]
    faces = spark.createDataFrame(list(enumerate(sides)), "fid long, vids array<int>")
    full = repair.fill_holes(vertices, faces).checkpoint()
    assert mesh.is_closed(full).first()["closed"] and full.count() == 2 * n + 2 * (n - 2) and mesh.euler(full).first()["characteristic"] == 2


def plain_merge(area, links, limit):
    """The program's island merge, restated over lists: the least neighbour stands first."""
    area, links, holds = dict(area), {c: sorted(n) for c, n in links.items()}, {c: [c] for c in area}
    while True:
        small = [(area[c], c) for c in area if holds[c] and links[c]]
        if not small or min(small)[0] >= limit:
            break
        c = min(small)[1]
        near = sorted(links[c])
        for x in near:
            links[x] = [y for y in links[x] if y != c]
        first = near[0]
        area[first] += area[c]
        holds[first] += holds[c]
        for x in near[1:]:
            area[first] += area[x]
            holds[first] += holds[x]
            for y in links[x]:
                links[y] = [z for z in links[y] if z != x]
                if y != first and y not in links[first]:
                    links[first].append(y)
                    links[y].append(first)
            area[x], links[x], holds[x] = 0, [], []
        links[c], holds[c], area[c] = [], [], 0
        links[first] = [y for y in links[first] if y not in near]
    return {x: c for c, h in holds.items() for x in h}


def test_island_merges_equal_a_plain_restatement():
    chance = np.random.default_rng(4)
    for _ in range(300):
        n = int(chance.integers(2, 14))
        below = chance.integers(1, n)  # components of one side don't touch each other
        links = {c: set() for c in range(n)}
        for a in range(below):
            for b in range(below, n):
                if chance.random() < 0.35:
                    links[a].add(b)
                    links[b].add(a)
        area = {c: float(chance.integers(1, 40)) for c in range(n)}
        want = plain_merge(area, links, 25.0)
        assert repair.merge_graph(dict(area), {c: set(x) for c, x in links.items()}, 25.0) == want


def test_a_small_component_takes_its_other_neighbours_along(spark):
    comps = spark.createDataFrame([(0, False, 50.0), (1, True, 0.05), (2, False, 0.01), (3, True, 100.0)], "comp long, above boolean, area double")
    near = spark.createDataFrame([(2, 1), (1, 2), (2, 3), (3, 2), (1, 0), (0, 1)], "comp long, near long")
    got = {r["comp"]: (r["into"], r["above"], r["lone"]) for r in repair.merge_islands(comps, near).collect()}
    assert got == {0: (0, False, False), 1: (1, True, False), 2: (1, True, False), 3: (1, True, False)}


def test_iterations_that_do_not_converge_raise(spark):
    rows = [(i, j, 2.0 if i == j else -1.0) for i in range(30) for j in range(30) if abs(i - j) <= 1]
    m = spark.createDataFrame(rows, "i long, j long, v double")
    b = spark.createDataFrame([(i, float(i * i)) for i in range(30)], "i long, v double")
    with pytest.raises(linalg.NotConverged):
        linalg.conjugate_gradient(m, b, 2)
    grid = np.random.default_rng(0).normal(size=(8, 8, 8))
    with pytest.raises(linalg.NotConverged):
        poisson.solve_grid(grid, np.zeros_like(grid), "dirichlet", rounds=1, tolerance=1e-12)
    x = poisson.solve_grid(grid, np.zeros_like(grid), "dirichlet", rounds=100, tolerance=1e-10)
    assert np.linalg.norm(poisson.apply_laplacian(x, "dirichlet") - grid) <= 1e-10 * np.linalg.norm(grid)


def test_components_over_many_tasks_equal_union_find(spark, monkeypatch):
    monkeypatch.setattr(mesh, "LOCAL_LINKS", 5)
    chance = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in chance.integers(0, 120, (80, 2))] + [(k, k + 1) for k in range(200, 300)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    nodes = spark.range(310).withColumnRenamed("id", "n")
    root = list(range(310))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r["n"]: r["comp"] for r in mesh.components(links, nodes, "n").collect()} == {k: find(k) for k in range(310)}


def test_every_cube_case_gives_closed_oriented_loops():
    for case in range(256):
        loops = poisson.cube_loops(case)
        crossed = {tuple(sorted((a, b))) for a in range(8) for b in range(8) if bin(a ^ b).count("1") == 1 and (case >> a & 1) != (case >> b & 1)}
        assert sorted(e for loop in loops for e in loop) == sorted(crossed)
        assert all(len(loop) >= 3 for loop in loops)


@pytest.mark.parametrize("shape", ["ball", "torus"])
def test_level_sets_are_closed_and_lie_on_the_surface(spark, shape):
    def f(x, y, z):
        x, y, z = x - 0.5, y - 0.5, z - 0.5
        ring = F.sqrt(x * x + y * y) - 0.28
        return 0.3 - F.sqrt(x * x + y * y + z * z) if shape == "ball" else 0.1 - F.sqrt(ring * ring + z * z)

    vertices, faces = poisson.level_set(poisson.evaluate_on(4, spark, f), 0.0, 4)
    faces = poisson.triangulate(faces, vertices).checkpoint()
    assert mesh.is_closed(faces).first()["closed"]
    assert mesh.euler(faces).first()["characteristic"] == (2 if shape == "ball" else 0)
    assert vertices.agg(F.max(F.abs(f(F.col("x"), F.col("y"), F.col("z"))))).first()[0] < 0.02


def oriented_sphere(spark, radius=5.0):
    at, _ = sphere(spark)
    rows = [(k, *map(float, radius * p), *map(float, p)) for k, p in enumerate(at)]
    return spark.createDataFrame(rows, "point_id long, x double, y double, z double, nx double, ny double, nz double")


@pytest.mark.parametrize("boundary", [1, 2, 3])
def test_reconstruction_of_a_sphere(spark, boundary):
    vertices, faces = poisson.reconstruct(oriented_sphere(spark), poisson.Options(depth=5, boundary=boundary))
    r = vertices.select(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r"), "value").agg(F.min("r"), F.max("r"), F.min("value")).first()
    assert 4.7 < r[0] and r[1] < 5.3 and r[2] >= 0
    assert mesh.is_closed(faces).first()["closed"]


def test_bad_options_are_refused():
    for o in (poisson.Options(degree=3), poisson.Options(degree=2), poisson.Options(boundary=0), poisson.Options(depth=0)):
        with pytest.raises(ValueError):
            o.resolved()


def test_sparse_algebra(spark):
    a = np.array([[4.0, 1, 0], [1, 3, -1], [0, -1, 2]])
    rows = [(i, j, float(a[i, j])) for i in range(3) for j in range(3) if a[i, j]]
    m = spark.createDataFrame(rows, "i long, j long, v double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i long, v double")
    want = np.linalg.solve(a, [1, 2, 3])
    dense = lambda x: np.array([r["v"] for r in x.orderBy("i").collect()])
    assert np.allclose(dense(linalg.multiply_vector(m, b)), a @ [1, 2, 3])
    assert np.allclose(dense(linalg.conjugate_gradient(m, b, 10)), want)
    assert {(r["i"], r["j"]): r["v"] for r in linalg.multiply(m, linalg.transpose(m)).collect()}[0, 1] == (a @ a.T)[0, 1]
    zero = b.select("i", F.lit(0.0).alias("v"))
    colours = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "i long, c int")
    assert np.allclose(dense(linalg.gauss_seidel(m, b, zero, colours, 12)), want, atol=1e-3)
    assert np.allclose(dense(linalg.jacobi(m, b, zero, 1)), np.array([1, 2, 3]) / np.diag(a))


def tube(n=24, m=10, length=4.0, radius=0.3):
    at = [(length * i / (n - 1), radius * np.cos(2 * np.pi * j / m), radius * np.sin(2 * np.pi * j / m)) for i in range(n) for j in range(m)]
    at += [(0.0, 0.0, 0.0), (length, 0.0, 0.0)]
    faces = []
    for i in range(n - 1):
        for j in range(m):
            a, b, c, d = i * m + j, i * m + (j + 1) % m, (i + 1) * m + j, (i + 1) * m + (j + 1) % m
            faces += [(a, b, d), (a, d, c)]
    faces += [(n * m, (j + 1) % m, j) for j in range(m)] + [(n * m + 1, (n - 1) * m + j, (n - 1) * m + (j + 1) % m) for j in range(m)]
    return np.array(at), np.array(faces)


def test_the_skeleton_of_a_tube_is_a_line_on_its_axis():
    at, faces = tube()
    points, edges, members = skeleton.skeletonize(at, faces)
    assert len(edges) == len(points) - 1 >= 3
    assert np.abs(points[:, 1:]).max() < 0.05 and np.ptp(points[:, 0]) > 2
    assert sorted(v for m in members for v in m) == list(range(len(at)))


def test_the_whole_pipeline_on_a_sphere(spark, tmp_path):
    cloud = oriented_sphere(spark).drop("nx", "ny", "nz")
    options = pipeline.Options(preset="custom", width_low=0.05, width_high=0.2, iterations=6, poisson=poisson.Options(depth=4), trim=True, trim_threshold=0.5)
    result = pipeline.run(spark, cloud, options, str(tmp_path))
    assert pipeline.closedness(result).first()["closed"] and result.skeleton.count() >= 1
    assert {p.name for p in tmp_path.iterdir()} == {"stage1_load", "stage2_normals", "stage3_mesh", "stage4_trim", "stage5_skeleton"}
