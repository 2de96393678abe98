"""The queries of the point-cloud and mesh operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudloom.functions import geometry as G
from cloudloom.operators import clouds, mesh, nbody, octree
from cloudloom.plans import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Grid widths for the adapters' clouds.
EVENTS_WIDTH, LINES_WIDTH, VECTORS_WIDTH = 5.0, 2.5, 0.5
DEPTH, CAP = 5, 4
M = 64
THRESHOLD = 4.5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def scaled(c: Column | str, by: float = 1e6) -> Column:
    """A number as a whole multiple of 1 / by."""
    return F.round((F.col(c) if isinstance(c, str) else c) * by).cast("long")


EVENTS = "(SELECT event_id AS point_id, value AS x, user_id::DOUBLE AS y, hour(ts)::DOUBLE AS z FROM events)"
LINES = "(SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS point_id, l_quantity::DOUBLE AS x, l_extendedprice / 1000.0::DOUBLE AS y, l_discount * 100.0::DOUBLE AS z FROM lineitem)"
VECTORS = "(SELECT vec_id AS point_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label AS red FROM embeddings)"


def _cells(width: float) -> str:
    return ", ".join(f"floor({c} * {1.0 / width!r}::DOUBLE)::INT AS i{c}" for c in "xyz")


UNIT = f"""(SELECT point_id, red, {", ".join(f"({c} - (min_{c} + max_{c}) / 2.0::DOUBLE) * (2.0::DOUBLE / (1.1::DOUBLE * greatest(max_x - min_x, max_y - min_y, max_z - min_z))) AS {c}" for c in "xyz")}
  FROM {VECTORS}, (SELECT {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in "xyz")} FROM {VECTORS}))"""


def _axis(c: str, depth: int) -> str:
    n = 1 << depth
    i = f"floor(({c} + 1.0::DOUBLE) * {n / 2}::DOUBLE)::BIGINT"
    return f"greatest(least(CASE WHEN {c} < 0 AND {i} >= {n // 2} THEN {n // 2 - 1} ELSE {i} END, {n - 1}), 0)::BIGINT"


def _code(depth: int) -> str:
    return " | ".join(f"((({_axis(c, depth)} >> {k}) & 1) << {3 * k + a})" for k in range(depth) for a, c in enumerate("xyz"))


CODES = f"(SELECT *, ({_code(DEPTH)})::BIGINT AS code FROM {UNIT})"
NODES = f"""counts AS (
  SELECT depth, code >> (3 * ({DEPTH} - depth)) AS code, count(*) AS n FROM {CODES}, (SELECT unnest(range(0, {DEPTH + 1}))::INT AS depth) GROUP BY ALL
), nodes AS (
  SELECT c.depth, c.code, c.n, c.n <= {CAP} OR c.depth = {DEPTH} AS is_leaf
  FROM counts c LEFT JOIN counts p ON p.depth = c.depth - 1 AND p.code = c.code >> 3 WHERE c.depth = 0 OR p.n > {CAP}
)"""
VERTICES = f"(SELECT id AS vid, (id // {M + 1}) / {float(M)}::DOUBLE AS x, (id % {M + 1}) / {float(M)}::DOUBLE AS y, ((id // {M + 1}) * (id % {M + 1})) % 5 / 10.0::DOUBLE AS z, (id * 7919) % 1000 / 100.0::DOUBLE AS value FROM (SELECT unnest(range({(M + 1) ** 2})) AS id))"
FACES = f"""(SELECT id AS fid, CASE WHEN id % 2 = 0 THEN [a, a + {M + 1}, a + 1] ELSE [a + 1, a + {M + 1}, a + {M + 2}] END AS vids
  FROM (SELECT id, (id // 2) // {M} * {M + 1} + (id // 2) % {M} AS a FROM (SELECT unnest(range({2 * M * M})) AS id)))"""
ISLANDS = f"(SELECT * FROM {FACES} WHERE fid // {2 * M} % 8 <> 7)"


def _half(faces: str) -> str:
    return f"(SELECT fid, k, vids[k + 1] AS src, vids[(k + 1) % len(vids) + 1] AS dst FROM (SELECT fid, vids, unnest(range(0, len(vids))) AS k FROM {faces}))"


# --- decimation, filters, expressions


@query(f"SELECT ix, iy, iz, count(*) AS n, min(point_id) AS first FROM (SELECT point_id, {_cells(EVENTS_WIDTH)} FROM {EVENTS} WHERE isfinite(x)) GROUP BY ALL")
def voxel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.occupied_cells(A.cloud_events(spark, sf_dir), EVENTS_WIDTH)


@query(f"SELECT point_id, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY point_id) AS r FROM (SELECT *, {_cells(EVENTS_WIDTH)} FROM {EVENTS})) WHERE r = 1")
def voxel_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.decimate(A.cloud_events(spark, sf_dir), EVENTS_WIDTH)


@query(ORACLE_SQL["voxel_decimate"])
def voxel_decimate_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.decimate(A.cloud_events(spark, sf_dir), EVENTS_WIDTH, late=True)


@query(f"SELECT ix, iy, iz, count(*) AS n, min(point_id) AS first FROM (SELECT point_id, {_cells(LINES_WIDTH)} FROM {LINES}) GROUP BY ALL")
def voxel_cells_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.occupied_cells(A.cloud_lineitem(spark, sf_dir), LINES_WIDTH)


@query(f"SELECT sum(n)::BIGINT AS total, count(*) AS kept, round(1e6 * 100.0 * (1.0 - count(*) / sum(n)::DOUBLE))::BIGINT AS reduction_ppm FROM (SELECT count(*) AS n FROM (SELECT {_cells(LINES_WIDTH)} FROM {LINES}) GROUP BY ix, iy, iz)")
def reduction_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.reduction(A.cloud_lineitem(spark, sf_dir), LINES_WIDTH).select("total", "kept", scaled("reduction_percent").alias("reduction_ppm"))


def _with_bad_rows(cloud: DataFrame) -> DataFrame:
    """cloud with some coordinates made NaN or infinite."""
    x = F.when(F.col("point_id") % 11 == 0, F.lit(float("nan"))).when(F.col("point_id") % 13 == 0, F.lit(float("-inf"))).otherwise(F.col("x"))
    return cloud.withColumn("x", x)


BAD_EVENTS = f"(SELECT point_id, CASE WHEN point_id % 11 = 0 THEN 'nan'::DOUBLE WHEN point_id % 13 = 0 THEN '-inf'::DOUBLE ELSE x END AS x, y, z FROM {EVENTS})"


@query(f"SELECT point_id, x, y, z FROM {BAD_EVENTS} WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def finite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.finite_points(_with_bad_rows(A.cloud_events(spark, sf_dir)))


@query(f"SELECT count(*) AS n, count(*) >= 3 AND coalesce(bool_and(isfinite(x) AND isfinite(y) AND isfinite(z)), true) AS ok, CASE WHEN count(*) < 3 THEN 'too_few' WHEN bool_or(NOT isfinite(x)) THEN 'coordinates' END AS error, min(CASE WHEN NOT isfinite(x) THEN point_id END) AS point_id FROM {BAD_EVENTS}")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.validate(_with_bad_rows(A.cloud_events(spark, sf_dir)))


@query(f"SELECT point_id, ix, iy, iz, ((((ix::BIGINT + 1048576) & 2097151) << 42) | (((iy::BIGINT + 1048576) & 2097151) << 21) | ((iz::BIGINT + 1048576) & 2097151)) AS packed, xor(xor(ix::BIGINT * 73856093, iy::BIGINT * 19349663), iz::BIGINT * 83492791) AS hashed FROM (SELECT point_id, {_cells(0.37)} FROM {EVENTS})")
def voxel_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clouds.with_cells(A.cloud_events(spark, sf_dir), 0.37)
    i = [F.col(c) for c in ("ix", "iy", "iz")]
    return rows.select("point_id", *i, G.pack_key(*i).alias("packed"), G.hash_key(*i).alias("hashed"))


@query(f"SELECT point_id, (CASE WHEN c BETWEEN 0 AND 1 THEN floor(c * 255.0::DOUBLE + 0.5::DOUBLE) ELSE floor(greatest(least(c, 255.0::DOUBLE), 0.0::DOUBLE)) END)::SMALLINT AS red FROM (SELECT point_id, x / 20.0::DOUBLE - 0.5::DOUBLE AS c FROM {EVENTS})")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.cloud_events(spark, sf_dir).select("point_id", G.colour_u8(F.col("x") / 20.0 - 0.5).alias("red"))


@query(f"SELECT {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in 'xyz')} FROM {LINES}")
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clouds.extent(A.cloud_lineitem(spark, sf_dir))


@query(f"SELECT {', '.join(f'min({c}) AS min_{c}, max({c}) AS max_{c}' for c in 'xyz')} FROM {EVENTS}")
def merged_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = A.cloud_events(spark, sf_dir)
    halves = [clouds.extent(cloud.where(F.col("point_id") % 2 == k)) for k in (0, 1)]
    return clouds.merge_extents(halves[0].unionByName(halves[1]))


@query(f"SELECT point_id, {', '.join(f'round({c} * 1e6)::BIGINT AS {c}' for c in 'xyz')} FROM {UNIT}")
def unit_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unit_embeddings(spark, sf_dir).select("point_id", *[scaled(c).alias(c) for c in "xyz"])


@query(f"SELECT point_id, round(sqrt(x*x + y*y + z*z) * 1e6)::BIGINT AS length, x*x + y*y + z*z > 0 AS valid, {', '.join(f'round({c} / sqrt(x*x + y*y + z*z) * 1e6)::BIGINT AS u{c}' for c in 'xyz')} FROM {VECTORS}")
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = clouds.cols()
    unit = [scaled(u).alias(f"u{c}") for u, c in zip(G.normalized(v), "xyz", strict=True)]
    return A.cloud_embeddings(spark, sf_dir).select("point_id", scaled(G.norm(v)).alias("length"), G.valid_normal(v).alias("valid"), *unit)


@query(f"SELECT point_id, code FROM {CODES}")
def octant_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.with_codes(A.unit_embeddings(spark, sf_dir), DEPTH).select("point_id", "code")


# --- octree


@query(f"WITH {NODES} SELECT * FROM nodes")
def octree_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.build(A.unit_embeddings(spark, sf_dir), DEPTH, CAP)


@query(f"WITH {NODES} SELECT count(*) AS nodes, count(*) FILTER (is_leaf) AS leaves, max(depth) AS max_depth FROM nodes")
def octree_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.statistics(octree.build(A.unit_embeddings(spark, sf_dir), DEPTH, CAP))


_MOMENTS = f"""n.depth, n.code, n.is_leaf, count(*) AS n, sum(red)::BIGINT AS sum_red,
  {", ".join(f"round(sum({c} * red) / sum(red) * 1e6)::BIGINT AS mean_{c}" for c in "xyz")}
  FROM nodes n JOIN {CODES} p ON p.code >> (3 * ({DEPTH} - n.depth)) = n.code"""


def _rounded_moments(df: DataFrame) -> DataFrame:
    return df.select("depth", "code", "is_leaf", "n", F.col("sum_red").cast("long").alias("sum_red"), *[scaled(f"mean_{c}").alias(f"mean_{c}") for c in "xyz"])


@query(f"WITH {NODES} SELECT {_MOMENTS} WHERE n.is_leaf GROUP BY n.depth, n.code, n.is_leaf HAVING sum(red) > 0")
def leaf_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = A.unit_embeddings(spark, sf_dir)
    nodes = octree.build(cloud, DEPTH, CAP)
    return _rounded_moments(octree.leaf_moments(cloud, nodes, ["red"], "red", DEPTH).where("sum_red > 0").withColumn("is_leaf", F.lit(True)))


@query(f"WITH {NODES} SELECT {_MOMENTS} GROUP BY n.depth, n.code, n.is_leaf HAVING sum(red) > 0")
def node_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = A.unit_embeddings(spark, sf_dir)
    nodes = octree.build(cloud, DEPTH, CAP)
    return _rounded_moments(octree.node_moments(cloud, nodes, ["red"], "red", DEPTH).where("sum_red > 0"))


@query(f"WITH {NODES} SELECT depth, code, row_number() OVER (ORDER BY code << (3 * ({DEPTH} - depth)), depth) - 1 AS place FROM nodes")
def octree_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.in_preorder(octree.build(A.unit_embeddings(spark, sf_dir), DEPTH, CAP), DEPTH).select("depth", "code", "place")


@query(f"WITH {NODES} SELECT depth, code, row_number() OVER (ORDER BY depth, code) - 1 AS node_id FROM nodes")
def octree_depth_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.depth_index(octree.build(A.unit_embeddings(spark, sf_dir), DEPTH, CAP)).select("depth", "code", "node_id")


def _off(a: int) -> str:
    return " | ".join(f"(((code >> {3 * k + a}) & 1) << {k})" for k in range(DEPTH))


@query(f"WITH counts AS (SELECT depth, code >> (3 * ({DEPTH} - depth)) AS code FROM {CODES}, (SELECT unnest(range(0, {DEPTH + 1}))::INT AS depth) GROUP BY ALL), o AS (SELECT depth, code, {_off(0)} AS ox, {_off(1)} AS oy, {_off(2)} AS oz FROM counts) SELECT a.depth, a.code, b.code AS near FROM o a JOIN o b ON a.depth = b.depth AND abs(a.ox - b.ox) <= 1 AND abs(a.oy - b.oy) <= 1 AND abs(a.oz - b.oz) <= 1")
def octree_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.neighbours(octree.fixed_depth(A.unit_embeddings(spark, sf_dir), DEPTH), 1, DEPTH)


@query(f"WITH counts AS (SELECT depth, code >> (3 * ({DEPTH} - depth)) AS code, count(*) AS n FROM {CODES}, (SELECT unnest(range(0, {DEPTH + 1}))::INT AS depth) GROUP BY ALL) SELECT * FROM counts")
def octree_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = A.unit_embeddings(spark, sf_dir)
    halves = [octree.fixed_depth(cloud.where(F.col("point_id") % 2 == k), DEPTH) for k in (0, 1)]
    return octree.merge(*halves)


@query(f"WITH counts AS (SELECT depth, code >> (3 * ({DEPTH} - depth)) AS code, count(*) AS n FROM {CODES}, (SELECT unnest(range(0, {DEPTH + 1}))::INT AS depth) GROUP BY ALL), g AS (SELECT depth, unnest(range((8 ** depth)::BIGINT)) AS code FROM (SELECT unnest(range(0, 4))::INT AS depth)) SELECT depth, code, coalesce(n, 0) AS n FROM g FULL JOIN counts USING (depth, code)")
def octree_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.refine(octree.fixed_depth(A.unit_embeddings(spark, sf_dir), DEPTH), 3)


# --- joins: nearest neighbours and sums over all sources

_TARGETS = "point_id % 100 = 0"


@query(f"SELECT t.point_id AS target_id, arg_min(s.point_id, struct_pack(d := (t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y) + (t.z-s.z)*(t.z-s.z), i := s.point_id)) AS source_id FROM (SELECT * FROM {VECTORS} WHERE point_id % 2 = 0) t, (SELECT * FROM {VECTORS} WHERE point_id % 2 = 1) s GROUP BY 1")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = A.cloud_embeddings(spark, sf_dir)
    return clouds.nearest(cloud.where("point_id % 2 = 0"), cloud.where("point_id % 2 = 1")).select("target_id", "source_id")


@query(f"SELECT t.point_id, arg_min(s.red, struct_pack(d := (t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y) + (t.z-s.z)*(t.z-s.z), i := s.point_id))::SMALLINT AS red FROM (SELECT * FROM {VECTORS} WHERE point_id % 2 = 0) t, (SELECT * FROM {VECTORS} WHERE point_id % 2 = 1) s GROUP BY 1")
def attribute_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = A.cloud_embeddings(spark, sf_dir)
    return clouds.transfer_attributes(cloud.where("point_id % 2 = 0"), cloud.where("point_id % 2 = 1")).select("point_id", "red")


_W = 0.05


def _pairs(inside: str) -> str:
    return f"""FROM (SELECT * FROM {UNIT} WHERE {_TARGETS}) q, {UNIT} s, LATERAL (SELECT q.x - s.x AS dx, q.y - s.y AS dy, q.z - s.z AS dz, 0.1::DOUBLE AS mx, 0.2::DOUBLE AS my, (s.red + 1.0::DOUBLE) / 10.0 AS mz) d,
      LATERAL (SELECT sqrt(dx*dx + dy*dy + dz*dz) AS r) e, LATERAL (SELECT CASE WHEN r >= {_W} THEN 1.0 / (r * r * r) ELSE {inside} END AS c, CASE WHEN r >= {_W} THEN 1.0 / (r * r) ELSE 0.0 END AS c2) f GROUP BY q.point_id"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.unit_embeddings(spark, sf_dir).withColumns({"mx": F.lit(0.1), "my": F.lit(0.2), "mz": (F.col("red") + 1.0) / 10.0, "s": F.lit(0.1)})


def _exact(kind: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    out = nbody.exact(kind, s.where(_TARGETS), s, _W)
    return out.select("point_id", *[scaled(c, 1e4).alias(c) for c in out.columns[1:]])


@query(f"SELECT q.point_id, round(sum(-(dx*mx + dy*my + dz*mz) * c) * 1e4)::BIGINT AS value {_pairs(repr(1 / _W**3))}")
def winding_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact("A", spark, sf_dir)


@query(f"SELECT q.point_id, {', '.join(f'round(sum(d{k} * 0.1 * c) * 1e4)::BIGINT AS v{k}' for k in 'xyz')} {_pairs('0.0')}")
def winding_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact("AT", spark, sf_dir)


@query(f"SELECT q.point_id, {', '.join(f'round(sum(m{k} * c - 3.0 * d{k} * (dx*mx + dy*my + dz*mz) * c * c2) * 1e4)::BIGINT AS v{k}' for k in 'xyz')} {_pairs('0.0')}")
def winding_g(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact("G", spark, sf_dir)


@query()
def winding_treecode(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sources(spark, sf_dir)
    return nbody.treecode("A", s, s, _W, 8, 8)


@query(f"SELECT q.point_id, round(sum(-(dx*mx + dy*my + dz*mz) * c) * 1e4)::BIGINT AS value {_pairs(repr(1 / _W**3))}")
def winding_treecode_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The treecode with no node far enough: it comes down to the exact sums, leaf by leaf."""
    s = _sources(spark, sf_dir)
    return nbody.treecode("A", s.where(_TARGETS), s, _W, 6, 16, far=1e9).select("point_id", scaled("value", 1e4).alias("value"))


# --- meshes


@query(f"SELECT fid, k, src, dst FROM {_half(FACES)}")
def mesh_half_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.half_edges(A.mesh_grid(spark, M)[1])


@query(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM {_half(FACES)} GROUP BY ALL")
def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.edges(A.mesh_grid(spark, M)[1])


@query(f"SELECT count(*) AS edges, bool_and(n = 2) AS closed FROM (SELECT count(*) AS n FROM {_half(FACES)} GROUP BY least(src, dst), greatest(src, dst))")
def mesh_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.is_closed(A.mesh_grid(spark, M)[1])


@query(f"SELECT v AS vertices, e AS edges, f AS faces, v - e + f AS characteristic FROM (SELECT count(DISTINCT src) AS v, count(DISTINCT least(src, dst) * 100000 + greatest(src, dst)) AS e, count(DISTINCT fid) AS f FROM {_half(FACES)})")
def mesh_euler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.euler(A.mesh_grid(spark, M)[1])


def _area(faces: str) -> str:
    return f"""(SELECT fid, sqrt(greatest((ux*ux+uy*uy+uz*uz)*(wx*wx+wy*wy+wz*wz) - (ux*wx+uy*wy+uz*wz)*(ux*wx+uy*wy+uz*wz), 0.0)) / 2.0 AS area FROM (
      SELECT f.fid, {", ".join(f"b.{c} - a.{c} AS u{c}, c.{c} - a.{c} AS w{c}" for c in "xyz")}
      FROM {faces} f JOIN {VERTICES} a ON a.vid = f.vids[1] JOIN {VERTICES} b ON b.vid = f.vids[2] JOIN {VERTICES} c ON c.vid = f.vids[3]))"""


@query(f"SELECT fid, round(area * 1e9)::BIGINT AS area FROM {_area(FACES)}")
def mesh_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = A.mesh_grid(spark, M)
    return mesh.face_areas(faces, vertices).select("fid", scaled("area", 1e9).alias("area"))


# each strip of the cut sheet is a component; its least face opens the strip
_COMPS = f"(SELECT fid, (fid // {2 * M}) // 8 * 8 * {2 * M} AS comp FROM {ISLANDS})"


@query(f"SELECT fid, comp FROM {_COMPS}")
def mesh_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.face_components(A.islands(A.mesh_grid(spark, M)[1], M))


@query(f"SELECT comp, count(*) AS faces, round(sum(area) * 1e6)::BIGINT AS area FROM {_area(ISLANDS)} JOIN {_COMPS} USING (fid) GROUP BY comp")
def mesh_component_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = A.mesh_grid(spark, M)
    return mesh.component_areas(A.islands(faces, M), vertices).select("comp", "faces", scaled("area").alias("area"))


@query(f"WITH e AS (SELECT h.*, comp FROM {_half(ISLANDS)} h JOIN {_COMPS} USING (fid)) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.src = e.dst AND o.dst = e.src AND o.comp = e.comp)")
def mesh_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.boundary(A.islands(A.mesh_grid(spark, M)[1], M))


@query(f"SELECT i.fid, vids FROM {ISLANDS} i JOIN {_COMPS} USING (fid) WHERE comp = 0")
def mesh_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.largest_component(A.islands(A.mesh_grid(spark, M)[1], M))


@query(f"SELECT fid, CASE WHEN bool_and(value > {THRESHOLD}) THEN 'keep' WHEN bool_or(value > {THRESHOLD}) THEN 'split' ELSE 'drop' END AS side FROM {_half(FACES)} JOIN {VERTICES} ON vid = src GROUP BY fid")
def trim_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = A.mesh_grid(spark, M)
    return mesh.classify(faces, vertices, THRESHOLD)


_T = f"(({THRESHOLD} - p.value) / (q.value - p.value))"


@query(f"SELECT a, b, {', '.join(f'round((p.{c} * (1.0 - {_T}) + q.{c} * {_T}) * 1e6)::BIGINT AS {c}' for c in 'xyz')} FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM {_half(FACES)}) JOIN {VERTICES} p ON p.vid = a JOIN {VERTICES} q ON q.vid = b WHERE (p.value > {THRESHOLD}) <> (q.value > {THRESHOLD})")
def trim_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = A.mesh_grid(spark, M)
    return mesh.crossings(faces, vertices, THRESHOLD).select("a", "b", *[scaled(c).alias(c) for c in "xyz"])


@query(f"SELECT fid, count(*) FILTER (p.value > {THRESHOLD}) AS above, CASE WHEN bool_and(p.value > {THRESHOLD}) OR NOT bool_or(p.value > {THRESHOLD}) THEN 1 ELSE 2 END AS parts FROM {_half(FACES)} JOIN {VERTICES} p ON vid = src GROUP BY fid")
def trim_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = A.mesh_grid(spark, M)
    _, pieces = mesh.split_faces(faces, vertices, THRESHOLD)
    old = F.filter("vids", lambda v: v < (M + 1) ** 2)
    return pieces.groupBy("fid").agg(F.sum(F.when(F.col("above"), F.size(old)).otherwise(0)).alias("above"), F.count("*").cast("int").alias("parts"))


@query(f"SELECT row_number() OVER (ORDER BY vid) - 1 AS vid, x, y, z, value FROM {VERTICES} WHERE vid IN (SELECT src FROM {_half(ISLANDS)})")
def trim_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, faces = A.mesh_grid(spark, M)
    return mesh.compact(vertices, A.islands(faces, M))[0]


@query(f"SELECT count(*) AS faces, 0::BIGINT AS degenerate, 0::BIGINT AS repeated, (SELECT count(*) FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM {_half(ISLANDS)})) AS edges, (SELECT count(*) FROM (SELECT count(*) AS n FROM {_half(ISLANDS)} GROUP BY least(src, dst), greatest(src, dst)) WHERE n = 1) AS open_edges, 0::BIGINT AS bad_edges FROM {ISLANDS}")
def mesh_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mesh.mesh_checks(A.islands(A.mesh_grid(spark, M)[1], M))
