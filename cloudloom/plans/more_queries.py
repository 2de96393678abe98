"""Queries of the solver, reconstruction, repair, skeleton, sources, sinks, sparse algebra and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import clouds, linalg, mesh, nbody, poisson, repair, skeleton, solver
from cloudloom.plans import adapters as A
from cloudloom.plans.queries import EVENTS, EVENTS_WIDTH, FACES, ISLANDS, LINES, ORACLE_SQL, UNIT, VECTORS, VERTICES, M, _area, _cells, _half, query, scaled
from cloudloom.session import shared_dir
from cloudloom.sources import ply, points, sinks
from cloudloom.streaming import decimate as streaming


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- expressions


@query(f"SELECT point_id, round((1.0 + x * (2.0 + x * 3.0)) * 1e6)::BIGINT AS p, round(0.5 * (1.0 - t) * (1.0 - t) * 1e6)::BIGINT AS before, round((0.5 + t - t * t) * 1e6)::BIGINT AS at, round(0.5 * t * t * 1e6)::BIGINT AS after FROM (SELECT point_id, x, x - floor(x) AS t FROM {VECTORS})")
def polynomials(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("x")
    w = [scaled(c).alias(n) for c, n in zip(G.bspline_weights(x - F.floor(x)), ("before", "at", "after"), strict=True)]
    return A.cloud_embeddings(spark, sf_dir).select("point_id", scaled(G.polynomial(x, [1.0, 2.0, 3.0])).alias("p"), *w)


@query(f"SELECT point_id, list_transform(list_sort([(-y - sqrt(y*y + 4.0)) / 2.0, (-y + sqrt(y*y + 4.0)) / 2.0]), lambda r: round(r * 1e6)::BIGINT) AS roots FROM {VECTORS}")
def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.quadratic_roots(F.lit(1.0), F.col("y"), F.lit(-1.0))
    return A.cloud_embeddings(spark, sf_dir).select("point_id", F.transform(found, lambda r: F.round(r * 1e6).cast("long")).alias("roots"))


_BOX = f"(SELECT {', '.join(f'min({c}) AS low_{c}, max({c}) AS high_{c}' for c in 'xyz')} FROM {LINES})"
_FRAME = ", ".join(f"round(({c} / (1.1 * side) + (0.5 - (low_{c} + high_{c}) / 2.0 / (1.1 * side))) * 1e6)::BIGINT AS {n}" for c, n in zip("zxy", "xyz", strict=True))


@query(f"SELECT point_id, {_FRAME} FROM {LINES}, (SELECT *, high_y - low_y AS side FROM {_BOX})")
def unit_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = A.cloud_lineitem(spark, sf_dir)
    return clouds.transform(cloud, clouds.unit_frame(cloud)).select("point_id", *[scaled(c).alias(c) for c in "xyz"])


# --- solver


@query(f"SELECT round(sum(x*x + y*y + z*z) * 1e3)::BIGINT AS rr, round(sum(x*x) * 1e3)::BIGINT AS arar FROM {UNIT}")
def residual_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = A.unit_embeddings(spark, sf_dir)
    r = u.withColumnsRenamed({"x": "vx", "y": "vy", "z": "vz"})
    return solver.residual_norms(r, u.withColumnRenamed("x", "value")).select(scaled("rr", 1e3).alias("rr"), scaled("arar", 1e3).alias("arar"))


@query()
def estimated_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solver.estimate_normals(A.unit_embeddings(spark, sf_dir), preset="l3")


@query()
def winding_field_treecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.unit_embeddings(spark, sf_dir).withColumns({"mx": F.lit(0.1), "my": F.lit(0.2), "mz": F.lit(0.3)})
    return nbody.treecode("G", s, s, 0.05, 8, 8)


# --- reconstruction


def _sphere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors pushed onto a sphere in the unit cube, with outward normals."""
    u = A.cloud_embeddings(spark, sf_dir)
    n = G.normalized(clouds.cols())
    return u.select("point_id", *[(c * 0.4 + 0.5).alias(k) for c, k in zip(n, "xyz", strict=True)], F.lit(1.0).alias("w"), *[c.alias(k) for c, k in zip(n, clouds.NORMAL, strict=True)])


_SPHERE = f"(SELECT point_id, x/r AS nx, y/r AS ny, z/r AS nz, x/r*0.4::DOUBLE+0.5::DOUBLE AS x, y/r*0.4::DOUBLE+0.5::DOUBLE AS y, z/r*0.4::DOUBLE+0.5::DOUBLE AS z FROM (SELECT *, sqrt(x*x+y*y+z*z) AS r FROM {VECTORS}))"


@query(f"SELECT floor(x*16)::INT AS ix, floor(y*16)::INT AS iy, floor(z*16)::INT AS iz, count(*) AS weight, round(avg(x)*1e6)::BIGINT AS x, round(sum(nx)*1e6)::BIGINT AS nx FROM {_SPHERE} GROUP BY 1, 2, 3")
def sample_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = poisson.bin_samples(_sphere(spark, sf_dir), 4)
    return bins.select("ix", "iy", "iz", F.col("weight").cast("long").alias("weight"), scaled("x").alias("x"), scaled("nx").alias("nx"))


def _spline(c: str) -> str:
    return f"[{{'i': floor({c}*8)::INT - 1, 'w': 0.5*(1-t{c})*(1-t{c})}}, {{'i': floor({c}*8)::INT, 'w': 0.5+t{c}-t{c}*t{c}}}, {{'i': floor({c}*8)::INT + 1, 'w': 0.5*t{c}*t{c}}}]"


@query(f"SELECT ax.i AS ix, ay.i AS iy, az.i AS iz, round(sum(ax.w*ay.w*az.w)*1e6)::BIGINT AS density FROM (SELECT ax, ay, unnest({_spline('z')}) AS az FROM (SELECT *, unnest({_spline('y')}) AS ay FROM (SELECT *, unnest({_spline('x')}) AS ax FROM (SELECT *, x*8-floor(x*8) AS tx, y*8-floor(y*8) AS ty, z*8-floor(z*8) AS tz FROM {_SPHERE})))) GROUP BY 1, 2, 3")
def splatted_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson.density(_sphere(spark, sf_dir), 3).select("ix", "iy", "iz", scaled("density").alias("density"))


@query(f"SELECT count(*) AS n, 0::BIGINT AS far FROM {_SPHERE}")
def grid_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multilinear values of a linear function are the function itself."""
    samples = _sphere(spark, sf_dir)
    f = lambda x, y, z: 1.0 + 2.0 * x - y + 0.5 * z
    got = poisson.values_at(samples, poisson.evaluate_on(4, spark, f), 4)
    off = F.abs(F.col("value") - f(*clouds.cols())) > 1e-9
    return got.agg(F.count("*").alias("n"), F.count_if(off).alias("far"))


@query(f"SELECT round(avg(1.0 + 2.0*x - y + 0.5*z) * 1e6)::BIGINT AS iso FROM {_SPHERE}")
def iso_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = lambda x, y, z: 1.0 + 2.0 * x - y + 0.5 * z
    return poisson.iso_value(_sphere(spark, sf_dir), poisson.evaluate_on(4, spark, f), 4).select(scaled("iso").alias("iso"))


@query("SELECT round(avg((a + 0.5) / 8 + (b + 0.5) / 8) * 1e6)::BIGINT AS average FROM (SELECT unnest(range(8)) AS a), (SELECT unnest(range(8)) AS b)")
def grid_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson.grid_average(poisson.evaluate_on(3, spark, lambda x, y, z: x + y)).select(scaled("average").alias("average"))


def _ball(x, y, z):
    return 0.35 - F.sqrt((x - 0.5) ** 2 + (y - 0.5) ** 2 + (z - 0.5) ** 2)


_IN = "(sqrt(((i // 256 + 0.5) / 16 - 0.5) ** 2 + ((i // 16 % 16 + 0.5) / 16 - 0.5) ** 2 + ((i % 16 + 0.5) / 16 - 0.5) ** 2) < 0.35)"


@query(f"WITH g AS (SELECT i, i // 256 AS a, i // 16 % 16 AS b, i % 16 AS c, {_IN} AS inside FROM (SELECT unnest(range(4096)) AS i)) SELECT (SELECT count(*) FROM g p JOIN g q ON p.inside AND NOT q.inside AND abs(p.a-q.a) + abs(p.b-q.b) + abs(p.c-q.c) = 1) AS vertices, true AS closed, 2::BIGINT AS characteristic")
def level_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, polygons = poisson.level_set(poisson.evaluate_on(4, spark, _ball), 0.0, 4)
    faces = poisson.triangulate(polygons, vertices).checkpoint()
    closed = mesh.is_closed(faces).select("closed")
    return vertices.agg(F.count("*").alias("vertices")).join(closed).join(mesh.euler(faces).select("characteristic"))


@query()
def poisson_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poisson.reconstruct(_sphere(spark, sf_dir).drop("w"), poisson.Options(depth=5))[0]


# --- trimming, repair, skeleton


@query()
def trimmed_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.trim(*A.mesh_grid(spark, 32), threshold=4.5)[1]


_RING = "(SELECT l_suppkey % 97 AS c, sum(l_quantity)::DOUBLE AS area FROM lineitem GROUP BY 1)"


@query(f"WITH a AS (SELECT c * 2 AS comp, true AS above, area FROM {_RING}), s AS (SELECT sum(area + 0.5) AS whole FROM a) SELECT comp, comp AS into, true AS above, false AS lone FROM a UNION ALL SELECT comp + 1, comp, true, false FROM a")
def island_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small island below in each of some large parts above, whose areas come from the table: all go into the part around them."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy((F.col("l_suppkey") % 97).alias("c")).agg(F.sum("l_quantity").cast("double").alias("area"))
    large = t.select((F.col("c") * 2).cast("long").alias("comp"), F.lit(True).alias("above"), "area")
    small = large.select((F.col("comp") + 1).alias("comp"), F.lit(False).alias("above"), F.lit(0.5).alias("area"))
    near = large.select("comp", (F.col("comp") + 1).alias("near"))
    return repair.merge_islands(large.unionByName(small), near.unionByName(near.select(F.col("near").alias("comp"), F.col("comp").alias("near"))))


_WIDE = f"(SELECT fid, (fid // {2 * M}) // 4 AS comp FROM {FACES})"


@query(f"WITH e AS (SELECT h.*, comp FROM {_half(FACES)} h JOIN {_WIDE} USING (fid)) SELECT DISTINCT a.comp, b.comp AS near FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.comp <> b.comp")
def component_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces = A.mesh_grid(spark, M)[1]
    return mesh.component_adjacency(faces, faces.select("fid", F.floor(F.floor(F.col("fid") / (2 * M)) / 4).alias("comp")))


@query(f"SELECT count(*) AS loops, sum(n)::BIGINT AS edges FROM (SELECT 2 * ({M} + 7) AS n FROM (SELECT unnest(range({M // 8}))))")
def boundary_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.boundary_loops(A.islands(A.mesh_grid(spark, M)[1], M)).agg(F.count("*").alias("loops"), F.sum(F.size("vids")).alias("edges"))


@query("SELECT 1 AS n, true AS closed")
def closed_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, polygons = poisson.level_set(poisson.evaluate_on(4, spark, _ball), 0.0, 4)
    cut = poisson.triangulate(polygons, vertices).where("fid % 10 <> 0")
    return mesh.is_closed(repair.close(vertices, cut)[1]).select(F.lit(1).alias("n"), "closed")


_CLUSTERED = f"""WITH t AS MATERIALIZED (
  SELECT vid, x, y, z, min(vid) OVER (PARTITION BY floor(x / 0.1::DOUBLE), floor(y / 0.1::DOUBLE), floor(z / 0.1::DOUBLE)) AS t FROM {VERTICES}
), r AS MATERIALIZED (
  SELECT fid, a.t AS a, b.t AS b, c.t AS c FROM {FACES} f JOIN t a ON a.vid = vids[1] JOIN t b ON b.vid = vids[2] JOIN t c ON c.vid = vids[3]
  WHERE len(list_distinct([a.t, b.t, c.t])) = 3
), f AS (SELECT min(fid) AS fid, arg_min([a, b, c], fid) AS k FROM r GROUP BY list_sort([a, b, c])
), n AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT unnest(k) AS t FROM f))"""


@query(f"{_CLUSTERED} SELECT n.i AS vid, {', '.join(f'round(avg({c}) * 1e6)::BIGINT AS {c}' for c in 'xyz')} FROM t JOIN n USING (t) GROUP BY n.i")
def clustered_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.simplify(*A.mesh_grid(spark, M), 0.1)[0].select("vid", *[scaled(c).alias(c) for c in "xyz"])


@query(f"{_CLUSTERED} SELECT fid, [a.i, b.i, c.i] AS vids FROM f JOIN n a ON a.t = k[1] JOIN n b ON b.t = k[2] JOIN n c ON c.t = k[3]")
def simplified_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.simplify(*A.mesh_grid(spark, M), 0.1)[1]


_CLIP = f"""(SELECT fid, list_filter([p.value, q.value, r.value], lambda v: v > 4.5) AS up, list_filter([p.value, q.value, r.value], lambda v: v <= 4.5) AS down
  FROM {FACES} JOIN {VERTICES} p ON p.vid = vids[1] JOIN {VERTICES} q ON q.vid = vids[2] JOIN {VERTICES} r ON r.vid = vids[3])"""


@query(f"SELECT round(sum(area * CASE len(up) WHEN 0 THEN 0.0 WHEN 3 THEN 1.0 WHEN 1 THEN (up[1] - 4.5) / (up[1] - down[1]) * (up[1] - 4.5) / (up[1] - down[2]) ELSE 1.0 - (4.5 - down[1]) / (up[1] - down[1]) * (4.5 - down[1]) / (up[2] - down[1]) END) * 1e6)::BIGINT AS area FROM {_area(FACES)} JOIN {_CLIP} USING (fid)")
def trimmed_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What trimming keeps is the part of the surface over the threshold, to the last triangle."""
    vertices, faces = repair.trim(*A.mesh_grid(spark, M), threshold=4.5, ratio=0.0)
    return mesh.face_areas(faces, vertices).agg(scaled(F.sum("area")).alias("area"))


@query()
def mesh_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, polygons = poisson.level_set(poisson.evaluate_on(3, spark, _ball), 0.0, 3)
    return skeleton.skeletons(vertices, poisson.triangulate(polygons, vertices)).drop("near", "mesh_vids")


@query("SELECT line, place::INT AS place, sid FROM (VALUES (0, 0, 0), (0, 1, 1), (0, 2, 2), (2, 0, 2), (2, 1, 3), (3, 0, 2), (3, 1, 4), (3, 2, 5)) t(line, place, sid)")
def skeleton_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.polylines(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (2, 4), (4, 5)], "a long, b long"))


# --- sources and sinks: written, read back, and worked on


@query(ORACLE_SQL["voxel_decimate"])
def ply_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "ply") + "/cloud.ply"
    ply.write_mesh(A.cloud_events(spark, sf_dir).orderBy("point_id"), None, path)
    return ply.load(spark, path, EVENTS_WIDTH, grain="1000").select("point_id", "x", "y", "z")


@query(f"SELECT count(*) AS n, round(sum(x) * 1e3)::BIGINT AS sx, round(sum(y) * 1e3)::BIGINT AS sy FROM {EVENTS}")
def xyz_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "xyz")
    sinks.write_xyz_normals(A.cloud_events(spark, sf_dir).withColumns({c: F.lit(0.0) for c in clouds.NORMAL}), path)
    back = points.read_xyz(spark, path)
    return back.agg(F.count("*").alias("n"), scaled(F.sum("x"), 1e3).alias("sx"), scaled(F.sum("y"), 1e3).alias("sy"))


@query("SELECT 'v 0 0 0' AS value UNION ALL SELECT 'v 1 0 0' UNION ALL SELECT 'v 0 2 0' UNION ALL SELECT 'l 1 2' UNION ALL SELECT 'l 2 3'")
def skeleton_obj(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.createDataFrame([(3, 0.0, 0.0, 0.0), (5, 1.0, 0.0, 0.0), (9, 0.0, 2.0, 0.0)], "sid long, x double, y double, z double")
    return sinks.obj_lines(v, spark.createDataFrame([(3, 5), (5, 9)], "a long, b long")).select("value")


# --- sparse algebra

_MATRIX = "(SELECT l_suppkey % 50 AS i, l_partkey % 40 AS j, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2)"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return t.groupBy((F.col("l_suppkey") % 50).alias("i"), (F.col("l_partkey") % 40).alias("j")).agg(F.sum("l_quantity").cast("long").alias("v"))


@query(f"SELECT i, sum(v * (j + 1))::BIGINT AS v FROM {_MATRIX} GROUP BY i")
def sparse_times_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.range(40).select(F.col("id").alias("i"), (F.col("id") + 1).alias("v"))
    return linalg.multiply_vector(_matrix(spark, sf_dir), x)


@query(f"SELECT a.i, b.i AS j, sum(a.v * b.v)::BIGINT AS v FROM {_MATRIX} a JOIN {_MATRIX} b ON a.j = b.j GROUP BY 1, 2")
def sparse_times_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _matrix(spark, sf_dir)
    return linalg.multiply(m, linalg.transpose(m))


@query("SELECT i, (i + 1)::BIGINT AS v FROM (SELECT unnest(range(12)) AS i)")
def conjugate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain matrix (2, -1) with a right side made for the solution 1, 2, 3, ..."""
    i = spark.range(12).select(F.col("id").alias("i"))
    m = i.select("i", F.explode(F.array(F.col("i") - 1, F.col("i"), F.col("i") + 1)).alias("j")).where("j between 0 and 11")
    m = m.withColumn("v", F.when(F.col("i") == F.col("j"), 2.0).otherwise(-1.0))
    b = linalg.multiply_vector(m, i.select("i", (F.col("i") + 1.0).alias("v")))
    return linalg.conjugate_gradient(m, b, 20).select("i", F.round("v").cast("long").alias("v"))


# --- streaming


@query(f"SELECT DISTINCT ix, iy, iz FROM (SELECT {_cells(EVENTS_WIDTH)} FROM {EVENTS})")
def streaming_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream, one trigger after the other until none is left; which point stands for a cell is open."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes a folder or a pattern
    cloud = stream.select(F.col("event_id").alias("point_id"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"), F.hour("ts").cast("double").alias("z"))
    out = _folder(spark, "stream")
    run = streaming.first_per_cell(cloud, EVENTS_WIDTH).writeStream.format("parquet").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start(f"{out}/rows")
    run.awaitTermination()
    rows = spark.read.schema("point_id long, x double, y double, z double").parquet(f"{out}/rows")
    return clouds.with_cells(rows, EVENTS_WIDTH).select("ix", "iy", "iz")
