"""Near-duplicate classes by SimHash.

Fingerprints that differ in few bits are found with BK-trees. The distinct fingerprints are dealt to
shards: with RADIUS = 2 and six bit blocks, two linked fingerprints agree in at least four blocks, so
each fingerprint enters the fifteen shards named by four of its blocks and no link is lost. A shard
fixes 42 to 44 bits; it can hold 2**22 fingerprints at most, however large the corpus or a group of
copies is. The task that owns a shard holds its tree: broadcasting all trees would first gather every
fingerprint on the driver. Classes are the components of the links, found by star contraction, with
each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm import nearcopies
from cloudloom.llm.bktrees import BITS, BKTree, components, fingerprint_of, keep_first, shingle_hashes
from cloudloom.llm.shared import map_batches, materialize, renamed

RADIUS = 2
SHINGLE = 3
#: Bit blocks (first bit, width); RADIUS differing bits leave len(BLOCKS) - RADIUS blocks equal.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))


def shard_masks(radius: int = RADIUS) -> list[int]:
    """The masks, as signed longs, whose kept bits name a fingerprint's shards."""
    masks = []
    for kept in combinations(BLOCKS, len(BLOCKS) - radius):
        mask = sum(((1 << width) - 1) << first for first, width in kept)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text over word shingles, repeats included; zero without words."""
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, fp) for each row; fp holds the 64 bits as a signed long. Null texts count as empty.

    text_key is xxhash64 of the text: with the id it names a row's content.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(2).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["id", "text_key", "fp"])

    rows = renamed(docs, id=id_col, text=text_col)
    rows = rows.select(F.col("id").cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")
    return map_batches(rows, per_batch, "id long, text_key long, fp long")


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of one shard's links, as (member, root) with the forest's earliest value as root."""
    tree, parent = BKTree(), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        near = {root(x) for x in tree.within(value, radius)}
        new = tree.insert(value)
        parent.append(new)
        if near:
            first = min(near)
            for x in (*near, new):
                parent[x] = first
    return [(values[x], values[r]) for x in range(len(values)) if (r := root(x)) != x]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) fingerprints that, taken together, span every group linked within the radius. fps: distinct `fp`."""
    masks = shard_masks(radius)
    rows = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("combo", "shard"))
    rows = rows.repartition("combo", "shard").sortWithinPartitions("combo", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3  # the last shard may go on in the next batch

        def linked(columns: list[np.ndarray], final: bool) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
            fp, combo, shard = columns
            edge = np.flatnonzero((combo[1:] != combo[:-1]) | (shard[1:] != shard[:-1])) + 1
            bounds = np.concatenate(([0], edge, [len(fp)] if final else []))
            out: list[tuple[int, int]] = []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                out += shard_links([int(x) for x in np.unique(fp[int(bounds[k]) : int(bounds[k + 1])]).view(np.uint64)], radius)
            rest = int(bounds[-1])
            return [c[rest:] for c in columns], out

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], ["a", "b"])

        for batch in batches:
            held = [np.concatenate((h, np.asarray(batch.column(i), dtype=np.int64))) for i, h in enumerate(held)]
            held, out = linked(held, False) if len(held[0]) else (held, [])
            if out:
                yield batch_of(out)
        if len(held[0]) > 1 and (out := linked(held, True)[1]):
            yield batch_of(out)

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, text_key, fp, component) for each row of docs; component is the least id linked to the row.

    Null and blank texts have fingerprint zero and are linked like any other. Repeated rows each come
    back. A row without an id keeps a null id; its class is the least id that the class has, or null.
    A text of any length has one fingerprint, worked out in bounded memory beside its words. An empty
    table gives an empty result. Other columns of docs are not read.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "simhash")
    firsts = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-first")
    stars = components(links(firsts.select("fp"), radius), "simhash-stars")
    tied = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
    tied = materialize(tied.join(firsts.select(F.col("fp").alias("node"), "first"), "node"), "simhash-tied")
    least = tied.groupBy("root").agg(F.min("first").alias("component"))
    named = tied.join(least, "root").select(F.col("node").alias("fp"), "component")
    classes = firsts.join(named, "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return rows.join(classes, "fp").select("id", "text_key", "fp", "component")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, similarity: tuple[int, int] | None = None
) -> DataFrame:
    """docs with one row of each near-duplicate class: the one with the least id (nulls last), then text_key.

    Without `similarity`, fingerprints within the radius link. With it, a fraction, texts link whose sets of
    shingles have that Jaccard similarity or more: fingerprints within the radius are candidates, and each
    link is checked on the whole sets (see nearcopies). Repeated rows of one id and text count as one row.
    Null and blank texts are one class. Texts of any length are read whole. All columns of docs are kept,
    whatever their names; an empty table stays empty.
    """
    if similarity is None:
        classes = near_duplicates(docs, id_col, text_col, shingle, radius)
    else:
        classes = nearcopies.near_copies(docs, id_col, text_col, shingle, radius, similarity)
    return keep_first(docs, classes, id_col, text_col)
