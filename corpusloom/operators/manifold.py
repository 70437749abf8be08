"""Projection of vectors to few dimensions that keeps who is near whom.

The nearest neighbours of each vector by cosine (exact, from a metric index) get weights that fall from 1 at the nearest one, at a rate that
gives each vector the same sum; the two directions of a pair are united as for fuzzy sets. A layout that starts from principal directions
is then pulled together along these edges, sampled by their weights, and pushed apart from points drawn at large. The
work goes in ROUNDS: tasks get blocks of edges, which are gathered once, and where each end stood, once for a block, go through some epochs by
themselves, and their points' new places are read back. A point of many edges is in several blocks and takes the mean place. Random numbers come from the
block and the round, so the same rows give the same answer.

Defined cases: below ``few`` rows the vectors stay as they are; null, empty and zero vectors have no place (null); equal vectors are near but
not at one place; repeated keys are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import settled

from . import metric

NEAR, ROUNDS, EPOCHS = 15, 10, 20
#: Points of a block, edges of a point in a block, points that all blocks are pushed apart from.
BLOCK, EDGES, POOL = 1024, 256, 1024
#: Points drawn to be pushed apart from, for each edge.
PUSHED = 5
#: Tasks that blocks are dealt to, at most.
MOST_TASKS = 2048
#: Steps of an epoch.
STEPS = 4
#: The curve 1 / (1 + A d ** (2 B)) that falls off as exp(-d).
A, B = 1.929, 0.7915


def weights(d: np.ndarray) -> np.ndarray:
    """Of sorted distances to the neighbours of each row (infinite: none): 1 at the nearest, then falling so that a row sums to log2 of how
    many there are."""
    there = np.isfinite(d)
    beyond = np.where(there, d - np.min(np.where(d > 0, d, np.inf), 1, initial=np.inf, keepdims=True), 0.0)
    beyond = np.where(np.isfinite(beyond), np.maximum(beyond, 0), 0.0)
    want = np.log2(np.maximum(there.sum(1), 2))
    low, high, rate = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    for _ in range(64):
        over = (np.where(there, np.exp(-beyond / rate[:, None]), 0)).sum(1) > want
        high, low = np.where(over, rate, high), np.where(over, low, rate)
        rate = np.where(np.isinf(high), rate * 2, (low + high) / 2)
        rate = np.clip(rate, 1e-9, 1e9)
    return np.where(there, np.exp(-beyond / rate[:, None]), 0.0)


def _edges(found: metric.Index) -> DataFrame:
    """a, b, w: both directions of each pair."""
    lists = metric.neighbours(found, NEAR)

    def run(batches):
        for batch in batches:
            row, best = batch.column("row").to_numpy(), batch.column("best")
            there = np.arange(NEAR)[None, :] < best.value_lengths().to_numpy()[:, None]
            far, other = (f.to_numpy(zero_copy_only=False) for f in best.flatten().flatten())
            d, to = np.full(there.shape, np.inf), np.zeros(there.shape, np.int64)
            d[there], to[there] = far**2 / 2, other
            w = weights(d) if len(row) else d
            i, j = np.nonzero(w > 0)
            yield pa.RecordBatch.from_arrays([pa.array(row[i]), pa.array(to[i, j]), pa.array(w[i, j])], ["a", "b", "w"])

    one = settled(lists.mapInArrow(run, "a bigint, b bigint, w double"), "one-way")
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    union = F.sum("w") - F.when(F.count(F.lit(1)) > 1, F.min("w") * F.max("w")).otherwise(0.0)
    return both.groupBy("a", "b").agg(union.alias("w"))


def layout(a: np.ndarray, b: np.ndarray, w: np.ndarray, at: np.ndarray, pool: np.ndarray, fixed: np.ndarray, epochs: int, first: float, last: float, seed: int) -> np.ndarray:
    """Places ``at`` after some epochs along edges a-b (numbers of places); ``fixed`` places stay. Steps shrink from first to last."""
    rng, at = np.random.default_rng(seed), at.copy()
    share = w / w.max()
    free = np.flatnonzero(~fixed)
    slot = np.full(len(at), len(free))  # all fixed ones share the last
    slot[free] = np.arange(len(free))
    for epoch in range(epochs):
        step = first + (last - first) * epoch / epochs
        drawn = np.flatnonzero(rng.random(len(a)) < share)
        drawn = drawn[rng.permutation(len(drawn))]
        for some in np.array_split(drawn, STEPS):
            if not len(some):
                continue
            x, y = a[some], b[some]
            apart = at[x] - at[y]
            square = np.maximum(np.einsum("ij,ij->i", apart, apart), 1e-12)
            pull = -2 * A * B * square ** (B - 1) / (1 + A * square**B)
            moves = np.clip(pull[:, None] * apart, -4, 4)
            other = pool[rng.integers(0, len(pool), (len(some), PUSHED))]
            gap = at[x][:, None, :] - other
            square = np.einsum("ijk,ijk->ij", gap, gap)
            push = np.where(square > 0, 2 * B / ((0.001 + square) * (1 + A * square**B)), 0)
            moves += np.clip(push[:, :, None] * gap, -4, 4).sum(1)
            to = slot[x]
            total = np.stack([np.bincount(to, m, len(free) + 1)[: len(free)] for m in moves.T], 1)
            at[free] += step * np.clip(total, -4, 4)
    return at


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, rows, at (their places after each other): what the blocks have to know of some points."""
    for batch in batches:
        blocks, row, at = batch.column("blocks"), batch.column("row").to_numpy(), metric.matrix(batch.column("at"))
        to, who = blocks.flatten().to_numpy(), np.repeat(np.arange(batch.num_rows), blocks.value_lengths().fill_null(0).to_numpy())
        order = np.argsort(to, kind="stable")
        names, n = np.unique(to, return_counts=True)
        who, ends = who[order], np.cumsum(n)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), _lists(row[who], ends), _lists(at[who].ravel(), ends * at.shape[1] if len(at) else ends)], ["block", "rows", "at"])


def _round(edges: DataFrame, places: DataFrame, dims: int, n: int, rounds: int, tasks: int) -> DataFrame:
    """edges: block, edges (a, b, w); places: row, blocks (where it stands in an edge), at. The places after a round."""
    pool = np.array([r.at for r in places.orderBy(F.xxhash64("row", F.lit(n)), "row").limit(POOL).collect()])  # POOL rows
    shared = edges.sparkSession.sparkContext.broadcast(pool)
    sent = places.filter("blocks is not null").select("row", "blocks", "at").mapInArrow(_sent, "block int, rows array<bigint>, at array<double>")
    both = edges.unionByName(sent, allowMissingColumns=True)

    def run(table: pa.Table) -> pa.Table:
        a, b, w = (f.to_numpy(zero_copy_only=False) for f in table.column("edges").drop_null().combine_chunks().flatten().flatten())
        rows = table.column("rows").drop_null().combine_chunks().flatten().to_numpy()
        order = np.argsort(rows)
        ids, at = rows[order], table.column("at").drop_null().combine_chunks().flatten().to_numpy().reshape(len(rows), -1)[order]
        own = np.isin(ids, a)
        seed = [n, table.column("block")[0].as_py()]
        moved = layout(np.searchsorted(ids, a), np.searchsorted(ids, b), w, at, shared.value, ~own, EPOCHS, 1 - n / rounds, 1 - (n + 1) / rounds, seed)[own]
        return pa.table([pa.array(ids[own]), _lists(moved.ravel(), np.arange(1, len(moved) + 1) * moved.shape[1])], names=["row", "at"])

    moved = both.repartition(tasks, "block").groupBy("block").applyInArrow(run, "row bigint, at array<double>")
    whole = [F.sum(F.get("at", F.lit(k)).cast("decimal(28,12)")).cast("double") for k in range(dims)]  # exact, so in any order the same
    mean = F.array(*[x / F.count(F.lit(1)) for x in whole])
    moved = moved.groupBy("row").agg(mean.alias("moved"))
    return places.join(moved, "row", "left").select("row", "blocks", F.coalesce("moved", "at").alias("at"))


def project(rows: DataFrame, key: str, vector: str, principal, dims: int = 5, few: int = 50, rounds: int = ROUNDS) -> DataFrame:
    """key, vector: places in ``dims`` dimensions. principal: (rows, key, vector, dims) to the places to start from."""
    wide = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda t, x: t + x * x))
    named = settled(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), wide.alias("whole"), F.when(norm > 0, metric.divided(wide, norm)).alias("v")).repartition("row"), "named")  # a file may be one task's
    good = named.filter("v is not null")
    if named.count() < few or good.select(F.max(F.size("v"))).first()[0] <= dims:
        return named.select("key", F.col("whole").alias("vector"))
    edges = _edges(metric.index(good.select("row", F.lit("").alias("grp"), "v")))
    degree = edges.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / EDGES).cast("int").alias("parts"))
    blocks = max(1, -(-good.count() // BLOCK))
    part = F.pmod(F.xxhash64("b"), F.col("parts"))
    edges = settled(edges.join(degree, "a").select("a", "b", "w", F.pmod(F.xxhash64("a", part), F.lit(blocks)).cast("int").alias("block")), "edges")
    stand = edges.select(F.explode(F.array("a", "b")).alias("row"), "block").distinct().groupBy("row").agg(F.collect_list("block").alias("blocks"))
    edges = settled(edges.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("a", "b", "w"))).alias("edges")), "blocks")
    start = settled(principal(good, "row", "v", dims).select(F.col("key").alias("row"), F.col("vector").alias("at")), "start")
    most = start.select(F.max(F.array_max(F.transform("at", F.abs)))).first()[0] or 1.0
    noise = F.transform("at", lambda x, k: F.round(x * (10 / most), 5) + (F.pmod(F.xxhash64("row", k), F.lit(2001)) - 1000) / 1e7)
    places = settled(start.select("row", noise.alias("at")).join(stand, "row", "left").select("row", "blocks", "at"), "places")
    for n in range(rounds):
        places = settled(_round(edges, places, dims, n, rounds, min(MOST_TASKS, 2 * blocks)), "places")
    return named.select("row", "key").join(places, "row", "left").select("key", F.col("at").alias("vector"))


def trustworthiness(x: np.ndarray, y: np.ndarray, k: int = NEAR) -> float:
    """How far the k nearest in y are among the nearest in x: 1 if all are among the k nearest there."""
    n = len(x)
    order = [np.argsort(metric.far(z, z) + np.diag(np.full(n, np.inf)), 1) for z in (x, y)]
    rank = np.empty((n, n), np.int64)
    np.put_along_axis(rank, order[0], np.arange(1, n + 1)[None, :].repeat(n, 0), 1)
    beyond = np.maximum(np.take_along_axis(rank, order[1][:, :k], 1) - k, 0)
    return float(1 - 2 / (n * k * (2 * n - 3 * k - 1)) * beyond.sum())
