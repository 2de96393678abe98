"""The SimHash near-duplicate join for a Jaccard similarity of word shingles.

Two texts with similarity 0.8 differ in ten of the 64 bits on average, so no choice of bit blocks can
name the shards of their BK-trees. Here MinHash band keys name them: sets that share a key meet in one
shard, whose BK-tree proposes the fingerprints within NEAR_RADIUS bits, and every link is checked on the
whole sets. Two sets of similarity 0.8 share none of the BANDS keys with a chance of 0.00003, and differ in
more than NEAR_RADIUS bits with one under 0.000001: that is all that can be lost, and no pair below the
similarity is linked. A shard's sets meet in cells of bounded size, so a large group of near copies fills
no single task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.bktrees import SEED, BKTree, components, fingerprint_of, shingle_hashes
from cloudloom.llm.shared import joined_to_few, map_batches, materialize, renamed

NEAR_SHINGLE, NEAR_RADIUS = 5, 24
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
BANDS, ROWS = 20, 4
#: Sets that a cell holds on each side, and those of a group that all its cells hold in the first round.
CELL, PIVOTS = 1024, 32
_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band: a hash of ROWS least values; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
        mixed = (hashes[at : at + 4096] ^ _SEEDS) * _ODD
        mixed ^= mixed >> np.uint64(29)
        mixed *= _ODD
        least = np.minimum(least, mixed.min(axis=1))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], dtype=np.uint64).view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_key, fp, bands) for each row: fp names the shingle set."""

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingle_hashes(t, shingle)) for t in batch.column(2).to_pylist()]
        fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
        bands = pa.array([band_keys(s) for s in sets], type=pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), bands], ["id", "text_key", "fp", "bands"])

    rows = renamed(docs, id=id_col, text=text_col)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    return map_batches(rows, per_batch, "id long, text_key long, fp long, bands array<long>")


def proposed(rows: DataFrame) -> DataFrame:
    """(fp, part): the groups of two and more sets that shared band keys tie together."""
    keys = materialize(rows.select("fp", F.explode("bands").alias("key")).distinct(), "near-keys")
    least = keys.groupBy("key").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = keys.join(least, "key").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    stars = components(edges, "near-stars")
    return stars.select(F.col("node").alias("fp"), F.col("root").alias("part")).unionByName(stars.select(F.col("root").alias("fp"), F.col("root").alias("part")).distinct())


def cell_links(fps: list[int], roots: list[int], sets: list[np.ndarray], radius: int, similarity: tuple[int, int]) -> list[tuple[int, int]]:
    """Links that, with those already known by equal roots, span all groups of pairs with the similarity or more."""
    over, under = similarity
    parent = list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    known: dict[int, int] = {}
    for x, r in enumerate(roots):
        parent[root(x)] = root(known.setdefault(r, x))
    tree, of, holders = BKTree(), {}, []
    out = []
    for x in sorted(range(len(fps)), key=lambda k: len(sets[k])):
        size, print_ = len(sets[x]), fingerprint_of(sets[x])
        for node in tree.within(print_, radius):
            for y in holders[node]:
                if under * len(sets[y]) >= over * size and root(x) != root(y):
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if under * common >= over * (size + len(sets[y]) - common):
                        parent[root(x)] = root(y)
                        out.append((fps[x], fps[y]))
        if print_ not in of:
            of[print_] = tree.insert(print_)
            holders.append([])
        holders[of[print_]].append(x)
    return out


def checked(cells: DataFrame, texts: DataFrame, shingle: int, radius: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b) links within each cell. cells: (part, cell, fp, root)."""

    def per_cell(cell: pa.Table) -> pa.Table:
        first = {fp: (root, text) for fp, root, text in zip(*(cell.column(c).to_pylist() for c in ("fp", "root", "text")), strict=True)}
        fps = sorted(first)
        sets = [np.unique(shingle_hashes(first[k][1], shingle)) for k in fps]
        found = cell_links(fps, [first[k][0] for k in fps], sets, radius, similarity)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cells.join(texts, "fp").groupBy("part", "cell").applyInArrow(per_cell, "a long, b long")


def _cell_no(size: str) -> str:
    return f"cast(ceil({size} / {CELL}) as long)"


def first_cells(groups: DataFrame) -> DataFrame:
    """Each set in one of its group's cells, some in all. groups: (fp, part, n)."""
    chosen = f"if(pmod(xxhash64(fp), n) < {PIVOTS}, sequence(0L, k - 1), array(pmod(fp, k)))"
    return groups.withColumn("k", F.expr(_cell_no("n"))).selectExpr("part", f"explode({chosen}) cell", "fp", "fp root")


def later_cells(groups: DataFrame, stars: DataFrame) -> DataFrame:
    """For groups of several cells: each set outside its group's largest class meets every set of the group."""
    named = groups.where(F.col("n") > CELL).join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "near-named")
    bulk = named.groupBy("part", "root").agg(F.count("*").alias("m")).groupBy("part").agg(F.max_by("root", F.struct("m", "root")).alias("bulk"), F.max("m").alias("m"))
    rest = named.join(bulk.where("m > 0"), "part").where("n > m").withColumn("outside", F.expr("root <> bulk"))
    rest = rest.withColumns({"k": F.expr(_cell_no("n")), "s": F.expr(_cell_no("(n - m)"))})
    columns = rest.selectExpr("part", "explode(transform(sequence(0L, s - 1), i -> i * k + pmod(fp, k))) cell", "fp", "root")
    lines = rest.where("outside").selectExpr("part", "explode(transform(sequence(0L, k - 1), i -> pmod(xxhash64(fp), s) * k + i)) cell", "fp", "root")
    return columns.unionByName(lines).distinct()


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, radius: int = NEAR_RADIUS, similarity: tuple[int, int] = SIMILARITY
) -> DataFrame:
    """(id, text_key, fp, component) for each row of docs; component names the class of linked shingle sets.

    Null and blank texts share the empty set. Repeated rows and null ids each come back; texts of any length
    are read whole; an empty table gives an empty result; other columns of docs are not read.
    """
    rows = materialize(signatures(docs, id_col, text_col, shingle), "near")
    parts = materialize(proposed(rows), "near-parts")
    groups = materialize(parts.join(parts.groupBy("part").agg(F.count("*").alias("n")), "part"), "near-groups")
    named = materialize(rows.join(groups.select("fp"), "fp").groupBy("fp").agg(F.min("text_key").alias("text_key")), "near-named")
    keyed = docs.select(F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), F.col(f"`{text_col}`").alias("text"))
    # copies of a text are brought down to one in each task before they are shuffled
    texts = joined_to_few(keyed, named, "text_key").where("fp is not null").groupBy("text_key", "fp").agg(F.first("text").alias("text"))
    texts = materialize(texts.select("fp", "text"), "near-texts")
    links = materialize(checked(first_cells(groups), texts, shingle, radius, similarity), "near-links")
    stars = components(links, "near-classes")
    if groups.where(F.col("n") > CELL).limit(1).count():
        later = materialize(checked(later_cells(groups, stars), texts, shingle, radius, similarity), "near-links")
        stars = components(links.unionByName(later), "near-classes")
    return rows.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("id", "text_key", "fp", F.coalesce("root", "fp").alias("component"))
