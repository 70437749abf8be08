"""Connected components of an edge table by alternating large and small stars, and helpers for grouped Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


#: From so many edges on, what is joined is written first: then both sides of a join come straight from an exchange, and
#: Spark splits the partition of a node that very many edges meet.
SPLIT = 1_000


def _large_star(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these. Edges point from the larger node (a)."""
    edges = cut(edges, "large")
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b of one ordered type, in any direction, repeated or not. Returns node, root (the least node that can
    be reached) for each node that has an edge to another. An empty table gives no rows."""
    now = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        told = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (told.n, told.x) == state or not told.n:
            break
        state = (told.n, told.x)
        cut = materialise if told.n >= SPLIT else lambda df, _: df
        now = materialise(_small_star(_large_star(now, cut), cut), "stars")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by keys, in tables of some ``least`` rows that hold whole groups, and where the groups start."""
    held: list[pa.RecordBatch] = []
    size = 0

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for k in keys:
            column = table.column(k).combine_chunks()
            if pa.types.is_binary(column.type):
                column = column.cast(pa.binary()).dictionary_encode().indices
            value = column.to_numpy(zero_copy_only=False)
            new[1:] |= value[1:] != value[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        at = starts(table)
        if at[-1] > 0:
            yield table.slice(0, at[-1]), at[:-1]
            rest = table.slice(at[-1]).combine_chunks()
            held, size = rest.to_batches(), rest.num_rows
    if size:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


class Union:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def spanning(n: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges x-y over 0..n-1: (node, root) of each node that isn't a root itself."""
    if not len(x):
        return []
    label = np.arange(n)
    while True:  # the least label spreads over edges, then jumps along itself
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    return [(i, r) for i, r in enumerate(label.tolist()) if i != r]
