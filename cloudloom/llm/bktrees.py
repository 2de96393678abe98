"""What both near-duplicate joins use: fingerprints, BK-trees, components and the choice of one row a class."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudloom.llm.shared import free_names, materialize
from cloudloom.operators.mesh import forests

BITS = 64
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each run of so many lower-cased words, repeats included; a shorter text is one run, a blank one none."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    joined = memoryview(b" ".join(words))
    width = min(shingle, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    runs = (digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[width - 1 :], strict=False))
    return np.fromiter(runs, dtype="<u8", count=len(words) - width + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; zero for none."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 65536):  # bounded memory for very long texts
        part = np.ascontiguousarray(hashes[at : at + 65536])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


class BKTree:
    """Distinct integers under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> int:
        """Put in a value that isn't in the tree yet; its index."""
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)
        return new

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Indices of the values within the radius, following only edges that the triangle inequality allows."""
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                yield at
            edges = self.children[at]
            stack += [edges[d] for d in range(max(1, distance - radius), distance + radius + 1) if d in edges]


def components(edges: DataFrame, name: str = "stars", most_rounds: int = 64) -> DataFrame:
    """(node, root) for each node but the roots, of the graph with edges (a, b); the root is a component's least node.

    Each task first joins the edges that it has (mesh.forests); alternating large-star and small-star
    contraction joins the rest. Minima are partial aggregates and the joins carry hot nodes only on their
    streamed side, where adaptive execution splits them.
    """
    now = materialize(forests(edges, "a", "b").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), name)
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, name)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("star contraction did not settle")


def keep_first(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the first row of each class. classes: (id, text_key, fp, component)."""
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("text_key"))
    # rows of a class without any id share a null component: their fingerprints tell such classes apart
    chosen = classes.groupBy("component", F.when(F.col("component").isNull(), F.col("fp"))).agg(F.min(order).alias("least"))
    no_id = F.lit(-(1 << 63))  # stands for a null id, so that join and duplicates share one partitioning
    own_id, key = free_names(docs, "id", "key")
    chosen = chosen.select(F.coalesce("least.id", no_id).alias(own_id), F.col("least.text_key").alias(key))
    keyed = docs.withColumns({own_id: F.coalesce(F.col(f"`{id_col}`").cast("long"), no_id), key: F.xxhash64(F.col(f"`{text_col}`"))})
    return keyed.join(chosen, [own_id, key], "left_semi").dropDuplicates([own_id, key]).drop(own_id, key)
