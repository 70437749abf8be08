"""Hierarchical density clustering: core distances, a spanning tree of mutual reachability, the tree of clusters, and a selection of them.

A point's core distance is that to its ``samples``-th nearest other point; two points reach each other at the greatest of both core
distances and their own. As the distance grows, components of points that reach each other grow; one of ``least`` points or more is a
cluster. Where clusters join at one distance, a new one begins above them; smaller components that join are points that leave their
cluster there on the way down. A cluster's stability sums, over its points, how much longer (in 1 / distance) they stay in it than it
takes to split off. ``eom`` takes the clusters of greatest total stability, ``leaf`` those without clusters below; the topmost one
is never taken. All that meets at equal distances counts as one event, so equal points and ties have one answer.

Groups of up to WHOLE points are worked on in one task each. In larger ones the tree grows in rounds: components take their
least edges to others from lists of nearest neighbours as long as many of them can be sure of these. Where a neighbour beyond the list may be
nearer, all components but the largest of each group search the balls of a metric index that can still hold one. Then the tree is
contracted: small components join what they reach first until clusters are left (number of points / least, or FEW nodes of any size, at
most), whose own tree the driver works on. A long row of points with growing gaps takes as many rounds as it has points.

Defined cases: null and empty vectors are noise; a group of fewer than max(2, least) points is noise; so is a group that never splits;
repeated keys are points of their own; equal points lie at distance 0, where 1 / distance counts as 1e12; a null key is its own cluster's
name only if all its keys are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import settled

from . import metric
from .graph import components

#: Points of a group that one task works on.
WHOLE = 2048
#: Fewer points have core distances to their nearest neighbour.
SMALL = 50
#: Nearest neighbours that are asked for an edge before the index.
LISTED = 16
#: Greatest rank of core distances that lists of neighbours are kept for; others are counted.
LONG = 128
#: Components and nodes that the driver joins itself.
FEW = 4096
#: Times that the way to a group's first node is doubled.
JUMPS = 3
#: Times that the way along picked edges is doubled before labels spread.
DOUBLED = 6
_CLOSEST = 1e-12


def reach_tree(x: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (a, b, distance) of a least spanning tree of mutual reachability, point by point."""
    n = len(x)
    d = np.concatenate([metric.apart(x[a : a + 64, None, :], x[None, :, :]) for a in range(0, n, 64)])
    core = np.partition(d, min(samples, n - 1), 1)[:, min(samples, n - 1)]
    np.maximum(d, core[:, None], out=d)
    np.maximum(d, core[None, :], out=d)
    out, best, by, now = np.zeros((n - 1, 3)), np.full(n, np.inf), np.zeros(n, np.int64), 0
    inside = np.zeros(n, bool)
    for k in range(n - 1):
        inside[now] = True
        nearer = ~inside & (d[now] < best)
        best[nearer], by[nearer] = d[now][nearer], now
        now = int(np.where(inside, np.inf, best).argmin())
        out[k] = by[now], now, best[now]
    return out[:, 0].astype(np.int64), out[:, 1].astype(np.int64), out[:, 2]


class Clusters:
    """The tree of clusters over nodes 0 .. n - 1, which are single points or, where ``born`` is finite, clusters since that
    distance. Of each cluster: parent (-1), start, split (the distance at which it leaves its parent). Of each node: fell, at
    (the cluster it leaves last on the way up, and where) or, if it was a cluster, fell alone (its first one)."""

    def __init__(self, size: np.ndarray, born: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray, least: np.ndarray):
        n = len(size)
        self.parent: list[int] = []
        self.start: list[float] = []
        self.split: list[float] = []
        self.fell, self.at = np.full(n, -1), np.full(n, np.inf)
        self._up, self._size = list(range(n)), size.tolist()
        self._own = [-1] * n  # a component's cluster
        self._open = [[k] for k in range(n)]  # a component's nodes that are in no cluster yet
        self._born = born.tolist()
        order = np.argsort(w, kind="stable")
        a, b, w = a[order].tolist(), b[order].tolist(), w[order]
        edge = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]])).tolist() if len(w) else []
        for s, e in zip(edge, [*edge[1:], len(w)], strict=True):
            self._level(a[s:e], b[s:e], float(w[s]), least)
        for k in range(n):
            if self._find(k) == k:
                self._awake(k, np.inf)

    def _find(self, x: int) -> int:
        while self._up[x] != x:
            self._up[x] = x = self._up[self._up[x]]
        return x

    def _new(self, start: float) -> int:
        self.parent.append(-1)
        self.start.append(start)
        self.split.append(np.inf)
        return len(self.parent) - 1

    def _awake(self, c: int, w: float) -> None:
        """A node that was a cluster before w becomes one."""
        if self._own[c] < 0 and self._born[c] < w:
            self._own[c] = self.fell[c] = self._new(self._born[c])
            self._open[c] = []

    def _level(self, a: list[int], b: list[int], w: float, least: np.ndarray) -> None:
        joined: dict[int, list[int]] = {}
        for x, y in zip(a, b, strict=True):
            x, y = self._find(x), self._find(y)
            if x == y:
                continue
            p, q = joined.pop(x, None) or [x], joined.pop(y, None) or [y]
            if len(p) < len(q):
                x, y, p, q = y, x, q, p
            self._up[y] = x
            joined[x] = p + q
        for x, parts in joined.items():
            for c in parts:
                self._awake(c, w)
            clusters = [self._own[c] for c in parts if self._own[c] >= 0]
            size = sum(self._size[c] for c in parts)
            if len(clusters) > 1:
                own = self._new(w)
                for c in clusters:
                    self.parent[c], self.split[c] = own, w
            else:
                own = clusters[0] if clusters else self._new(w) if size >= least[x] else -1
            most = max((self._open[c] for c in parts), key=len)
            for c in parts:
                if self._open[c] is not most:
                    most += self._open[c]
                self._open[c] = []
            if own >= 0:
                self.fell[most], self.at[most], most = own, w, []
            self._own[x], self._size[x], self._open[x] = own, size, most


def chosen(parent: list[int], split: list[float], count: np.ndarray, lives: np.ndarray, selection: str) -> np.ndarray:
    """For each cluster the taken one that it is or lies in, or -1. count, lives: points that leave in it, and the sum of 1 / distance
    at which they do. Clusters have smaller numbers than those above them."""
    n = len(parent)
    birth = np.array([0.0 if np.isinf(s) else 1 / max(s, _CLOSEST) for s in split])
    size, stability = count.astype(np.float64), lives - count * birth
    inner, total, take = np.zeros(n), np.zeros(n), np.zeros(n, bool)
    below = np.zeros(n, bool)
    for c in range(n):
        total[c] = max(stability[c], inner[c])
        take[c] = parent[c] >= 0 and (not below[c] if selection == "leaf" else not inner[c] > stability[c])
        if (p := parent[c]) >= 0:
            size[p] += size[c]
            stability[p] += size[c] * (birth[c] - birth[p])
            inner[p] += total[c]
            below[p] = True
    out = np.full(n, -1)
    for c in range(n - 1, -1, -1):
        above = out[parent[c]] if parent[c] >= 0 else -1
        out[c] = above if above >= 0 else c if take[c] else -1
    return out


def ancestors(parent: list[int]) -> list[np.ndarray]:
    """The cluster 1, 2, 4, ... steps above each, or -1."""
    above = [np.array(parent, np.int64)]
    while (above[-1] >= 0).any():
        up = above[-1]
        above.append(np.where(up >= 0, up[up], -1))
    return above


def labels(x: np.ndarray, least: int, samples: int, selection: str) -> np.ndarray:
    """The cluster of each row of x, or -1."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    found = Clusters(np.ones(n, np.int64), np.full(n, np.inf), *reach_tree(x, samples), np.full(n, least))
    k = len(found.parent)
    there = found.fell >= 0
    lives = np.bincount(found.fell[there], 1 / np.maximum(found.at[there], _CLOSEST), k)
    best = chosen(found.parent, found.split, np.bincount(found.fell[there], minlength=k), lives, selection)
    return np.where(there, best[found.fell], -1) if k else np.full(n, -1)


_EDGE = "comp bigint, other bigint, w double, lo bigint, hi bigint"


def _first_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("comp").agg(F.min(F.struct("w", "lo", "hi", "other")).alias("e")).select("comp", "e.*")


def _edges(ids: np.ndarray, comp: np.ndarray, other: np.ndarray, w: np.ndarray, to: np.ndarray) -> pa.Table:
    return pa.table([pa.array(comp, pa.int64()), pa.array(other, pa.int64()), pa.array(w, pa.float64()), pa.array(np.minimum(ids, to), pa.int64()), pa.array(np.maximum(ids, to), pa.int64())], names=["comp", "other", "w", "lo", "hi"])


def _searched(found: metric.Index, told: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edges of the components in ``wanted`` (comp, w: an edge's distance that is known, or null) to others that may be less. told: row, grp, cell,
    region, parts, v, core, reach (what a neighbour beyond the list is away at least), comp."""
    spark = told.sparkSession
    limit = lambda w: F.coalesce(w, F.lit(float("inf")))
    own = [c for c in told.columns if c != "reach"]
    open_ = settled(told.join(wanted.select("comp", limit(F.col("w")).alias("most")), "comp").filter("reach < most").select(*own, "reach", "most"), "open")
    of = {r.row: (r.comp, r.core) for r in told.join(F.broadcast(spark.createDataFrame([(int(k),) for rows in found.rows.values() for k in rows], "row bigint")), "row").select("row", "comp", "core").collect()}  # the centres
    at = {g: (np.array([of[k][0] for k in rows], np.int64), np.array([of[k][1] for k in rows])) for g, rows in found.rows.items()}
    pure = {g: (np.full(len(c), -1), np.full(len(c), -2), np.full(len(c), np.inf)) for g, c in found.centres.items()}
    for r in told.groupBy("grp", "cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("core").alias("c")).collect():  # a row for each cell
        if r.grp in pure:
            for part, value in zip(pure[r.grp], (r.a, r.b, r.c), strict=True):
                part[r.cell] = value
    shared = spark.sparkContext.broadcast((found.centres, found.rows, found.radius, at, pure, found.region, found.dealt, found.cells))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for batch in (whole.slice(a, metric.ROWS) for a in range(0, whole.num_rows, metric.ROWS)):
                for g, some in metric._by_group(batch.column("grp").to_pylist(), shared.value[0]):
                    part = batch.take(pa.array(some))
                    x = metric.matrix(part.column("v"))
                    yield g, part, x, metric.far(x, shared.value[0][g]), part.column("comp").to_numpy(), part.column("core").to_numpy()

    def to_centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part, x, to, comp, core in split(batches):
            other, cores = shared.value[3][g]
            w = np.where(comp[:, None] == other[None, :], np.inf, np.maximum(to, np.maximum(core[:, None], cores[None, :])))
            best = w.argmin(1)
            hit = np.flatnonzero(np.isfinite(w[np.arange(len(w)), best]))
            best = best[hit]
            exact = np.maximum(metric.apart(x[hit], shared.value[0][g][best]), np.maximum(core[hit], cores[best]))
            yield from _edges(part.column("row").to_numpy()[hit], comp[hit], other[best], exact, shared.value[1][g][best]).to_batches()

    centred = settled(_first_edges(open_.select(*own).mapInArrow(to_centres, _EDGE)), "centred")
    nearer = open_.join(centred.select("comp", "w"), "comp", "left").withColumn("most", F.least("most", limit(F.col("w")))).filter("reach < most")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part, _, to, comp, core in split(batches):
            low, high, least = shared.value[4][g]
            most = part.column("most").to_numpy(zero_copy_only=False)
            w = np.maximum(to - shared.value[2][g][None, :], np.maximum(core[:, None], least[None, :]))
            mine = (low == high)[None, :] & (low[None, :] == comp[:, None])
            i, j = np.nonzero(~mine & np.isfinite(w) & (w <= most[:, None] * (1 + metric.SLACK) + metric.SLACK))
            who, region, lists = metric.asked(i, j, *(shared.value[k][g] if k < 7 else shared.value[k] for k in (5, 6, 7)))
            took = pa.array(who)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(took) for c in ("row", "grp", "cell")), pa.array(region.astype(np.int32)), *(part.column(c).take(took) for c in ("parts", "v", "core", "comp")), lists], ["row", "grp", "cell", "region", "parts", "v", "core", "comp", "cells"])

    columns = ["row", "grp", "cell", "region", "parts", "v", "core", "comp"]
    kinds = "row bigint, grp string, cell int, region int, parts int, v array<double>, core double, comp bigint, cells array<int>"
    none = F.lit(None).cast("array<int>").alias("cells")
    asking = nearer.select(*columns, "most").mapInArrow(visits, kinds)
    lone = nearer.filter(~F.col("grp").isin(*found.centres)) if found.centres else nearer  # groups of one cell

    def run(own: pa.Table, asks: pa.Table) -> pa.Table:
        met = metric.Meeting(own, asks)
        comp, other = (t.column("comp").to_numpy() for t in (met.asks, met.own))
        core, cores = (t.column("core").to_numpy() for t in (met.asks, met.own))
        best, to = np.full(len(comp), np.inf), np.zeros(len(comp), np.int64)
        for who, a, b in met.blocks():
            w = metric.far(*met.values(who, a, b))
            np.maximum(w, core[who, None], out=w)
            np.maximum(w, cores[None, a:b], out=w)
            w[comp[who, None] == other[None, a:b]] = np.inf
            j = w.argmin(1)
            found = w[np.arange(len(who)), j]
            less = np.flatnonzero(found < best[who])
            best[who[less]], to[who[less]] = found[less], a + j[less]
        hit = np.flatnonzero(np.isfinite(best))
        to = to[hit]
        exact = np.zeros(len(hit))
        for a in range(0, len(hit), metric.COLUMNS):
            cut = slice(a, a + metric.COLUMNS)
            x, y = (metric.matrix(t.column("v").take(pa.array(k))) for t, k in ((met.asks, hit[cut]), (met.own, to[cut])))
            exact[cut] = np.maximum(metric.apart(x, y), np.maximum(core[hit[cut]], cores[to[cut]]))
        ids, of = met.ids[hit], met.of[to]
        order = np.lexsort((np.maximum(ids, of), np.minimum(ids, of), exact, comp[hit]))
        first = order[np.flatnonzero(np.diff(comp[hit][order], prepend=-1))]  # one of each component
        return _edges(ids[first], comp[hit][first], other[to[first]], exact[first], of[first])

    return centred.select("comp", "other", "w", "lo", "hi").unionByName(metric.meet(told.select(*columns, none), asking.unionByName(lone.select(*columns, none)), run, _EDGE, even=False).select("comp", "other", "w", "lo", "hi"))


def _joined(comps: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """node, root of the components (comp) that edges (comp, other: one of a component) connect; few of them in the driver."""
    if n > FEW:
        return _picked_roots(comps, edges)
    up = {r.comp: r.comp for r in comps.select("comp").collect()}  # FEW rows at most

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for r in edges.select("comp", "other").collect():
        a, b = top(r.comp), top(r.other)
        up[max(a, b)] = min(a, b)
    return F.broadcast(comps.sparkSession.createDataFrame([(k, top(k)) for k in up], "node bigint, root bigint"))


def _picked_roots(comps: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root. Each component goes where its edge leads, those that pick each other to the smaller one, and the way is doubled DOUBLED times at
    most; where edges of equal distance close a ring, or the way is longer, labels spread instead."""
    each_other = edges.select(F.col("other").alias("comp"), F.col("comp").alias("other"), F.lit(True).alias("both"))
    up = F.when(F.col("both") & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other"))
    above = edges.join(each_other, ["comp", "other"], "left").select(F.col("comp").alias("node"), up.alias("up"))
    start = comps.select(F.col("comp").alias("node")).join(above, "node", "left").select("node", F.coalesce("up", "node").alias("root"))
    now = settled(start.withColumn("ends", F.col("node") == F.col("root")), "roots")
    for _ in range(DOUBLED):
        further = now.select(F.col("node").alias("root"), F.col("root").alias("next"), "ends")
        now = settled(now.select("node", "root").join(further, "root").select("node", F.col("next").alias("root"), "ends"), "roots")
        if not now.filter("not ends").limit(1).count():
            return now.select("node", "root")
    return components(comps.select(F.col("comp").alias("node")), edges.select(F.col("comp").alias("a"), F.col("other").alias("b")))


def spanning_edges(points: DataFrame, most: int) -> DataFrame:
    """a, b, w: edges of least spanning trees of mutual reachability of each group, and maybe some more of equal distance. points: row, grp, v,
    samples (``most`` at most)."""
    found = metric.index(points)
    listed = metric.neighbours(found, LISTED if most > LONG else max(most, LISTED)).join(points.select("row", "samples"), "row")
    core = F.element_at("best", F.least(F.col("samples"), F.size("best")).cast("int"))["d"]
    if most > LONG:  # lists as long as that would grow with the square of the points where samples are a share of them
        listed, core = listed.join(metric.ranked(found, points.select("row", F.col("samples").alias("k"))), "row"), F.col("d")
    first = F.slice("best", 1, LISTED)
    least_far = F.when(F.size("best") < LISTED, float("inf")).otherwise(F.element_at(first, -1)["d"])
    listed = settled(listed.select("row", core.alias("core"), first.alias("best"), least_far.alias("least_far")), "listed")
    rows = found.points.select("row", "grp", "cell", "region", "parts", "v").join(listed.select("row", "core", F.greatest("core", "least_far").alias("reach")), "row")
    rows = settled(rows, "rows")
    pairs = listed.select("row", "core", F.explode("best").alias("e")).select("row", "core", "e.d", F.col("e.other").alias("to"))
    pairs = pairs.join(listed.select(F.col("row").alias("to"), F.col("core").alias("core_to")), "to").select("row", "to", F.greatest("d", "core", "core_to").alias("w"))
    lo, hi = F.least("row", "to").alias("lo"), F.greatest("row", "to").alias("hi")
    pairs = pairs.select(F.col("row").alias("comp"), F.col("to").alias("other"), "w", lo, hi).unionByName(pairs.select(F.col("to").alias("comp"), F.col("row").alias("other"), "w", lo, hi))
    fewest = lambda df: df.groupBy("comp", "other").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select("comp", "other", "e.*")
    pairs = settled(fewest(pairs), "pairs")
    comps = settled(rows.select(F.col("row").alias("comp"), "grp", "reach", F.lit(1).cast("bigint").alias("size")), "comps")
    now, edges = rows.select("row", F.col("row").alias("comp")), []
    while True:
        # an edge from the lists is a component's least one if no point of it may have a nearer neighbour beyond them
        near = settled(comps.join(_first_edges(pairs), "comp", "left").select("comp", "grp", "size", "other", "w", "lo", "hi", F.coalesce(F.col("w") <= F.col("reach"), F.lit(False)).alias("sure")), "near")
        told = near.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("sure").cast("int")).alias("sure"), F.countDistinct("grp").alias("groups")).first()
        if told["n"] <= told["groups"]:
            break
        best = near.filter("sure").select("comp", "other", "w", "lo", "hi")
        if 4 * told["sure"] < told["n"]:
            largest = near.groupBy("grp").agg(F.max_by("comp", F.struct("size", "comp")).alias("comp"))
            unsure = near.filter("not sure").join(largest.select("comp"), "comp", "left_anti")
            listed_edges = unsure.filter("w is not null").select("comp", "other", "w", "lo", "hi")
            rows_now = settled(rows.join(now, "row"), "told")
            best = _first_edges(best.unionByName(listed_edges).unionByName(_searched(found, rows_now, unsure.select("comp", "w"))))
        best = settled(best, "best")
        edges.append(best.select(F.col("lo").alias("a"), F.col("hi").alias("b"), "w").distinct())
        roots = _joined(comps, best, told["n"])
        now = settled(now.join(roots, now["comp"] == roots["node"]).select("row", F.col("root").alias("comp")), "now")
        merged = comps.join(roots, comps["comp"] == roots["node"]).groupBy(F.col("root").alias("comp")).agg(F.first("grp").alias("grp"), F.min("reach").alias("reach"), F.sum("size").alias("size"))
        comps = settled(merged, "comps")
        ends = pairs.join(roots.select(F.col("node").alias("comp"), F.col("root").alias("x")), "comp").join(roots.select(F.col("node").alias("other"), F.col("root").alias("y")), "other")
        pairs = settled(fewest(ends.filter("x != y").select(F.col("x").alias("comp"), F.col("y").alias("other"), "w", "lo", "hi")), "pairs")
    none = rows.sparkSession.createDataFrame([], "a bigint, b bigint, w double")
    return reduce(DataFrame.unionByName, edges, none)


_MOVED = "old bigint, new bigint, w double, size bigint, least int, born double"


def _merged(table: pa.Table) -> pa.Table:
    """What becomes of small nodes (a) that reach each other first, from all their edges (a, b, w, size, least, inside: b is one of them, is_born):
    old, new (the node they become part of), w (where they joined a cluster), and size, least, born of new nodes. Edges are gone through in
    their order; a component whose least edge leads to another group's node waits, and so does what reaches it first."""
    a, b, w = (table.column(c).to_numpy() for c in ("a", "b", "w"))
    inside, is_born = (table.column(c).to_numpy(zero_copy_only=False) for c in ("inside", "is_born"))
    ids, first = np.unique(a, return_index=True)
    size, least = (table.column(c).to_numpy()[first].tolist() for c in ("size", "least"))
    n = len(ids)
    up, waits, cluster, at, members = list(range(n)), [False] * n, [-1] * n, [np.inf] * n, [[k] for k in range(n)]
    made: dict[int, tuple[int, int, float]] = {}
    new = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def settle(x: int, into: int, d: float) -> None:
        for m in members[x]:
            at[m], new[m] = d, into
        cluster[x], members[x] = into, []

    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), ~is_born, w))
    place = np.where(inside, np.minimum(np.searchsorted(ids, b), n - 1), -1)[order].tolist()
    start, ends, far, lead = np.searchsorted(ids, a)[order].tolist(), b[order].tolist(), w[order].tolist(), is_born[order].tolist()
    for k, j, to, d, known in zip(start, place, ends, far, lead, strict=True):
        x = top(k)
        if j < 0:
            if cluster[x] < 0 and not waits[x]:
                if known:
                    settle(x, to, d)
                else:
                    waits[x] = True
            continue
        y = top(j)
        if x == y or (cluster[x] >= 0 and cluster[y] >= 0):
            continue
        if cluster[x] >= 0 or cluster[y] >= 0:
            x, y = (x, y) if cluster[x] >= 0 else (y, x)
            if not waits[y]:
                settle(y, cluster[x], d)
        elif waits[x] or waits[y]:
            waits[x] = waits[y] = True
        else:
            if len(members[x]) < len(members[y]):
                x, y = y, x
            up[y] = x
            members[x] += members[y]
            members[y], size[x] = [], size[x] + size[y]
            if size[x] >= least[x]:
                name = int(ids[min(members[x])])
                made[name] = (size[x], least[x], d)
                settle(x, name, d)
    out = []
    for k in range(n):
        if len(members[k]) > 1 and cluster[k] < 0:  # small still
            name = int(ids[min(members[k])])
            made[name] = (size[k], least[k], None)
            out += [(int(ids[m]), name, None) for m in members[k]]
        elif at[k] < np.inf:
            out.append((int(ids[k]), new[k], at[k]))
    told = [(*o, *(made[o[0]] if o[0] == o[1] else (None,) * 3)) for o in out]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.float64())
    columns = zip(*told, strict=True) if told else ((),) * 6
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["old", "new", "w", "size", "least", "born"])


def _picked_groups(small: DataFrame, pick: DataFrame) -> DataFrame:
    """node, root: small nodes that lie below one another along what they pick (comp, other). Two that pick each other are together; who is further
    away than the jumps reach belongs to another group, which only makes it wait."""
    each_other = pick.select(F.col("other").alias("comp"), F.col("comp").alias("other"), F.lit(True).alias("both"))
    up = F.when(F.col("both") & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other"))
    above = pick.join(each_other, ["comp", "other"], "left").select(F.col("comp").alias("node"), up.alias("up"))
    now = settled(small.select("node").join(above, "node", "left").select("node", F.coalesce("up", "node").alias("root")), "groups")
    for _ in range(JUMPS):
        now = settled(now.join(now.select(F.col("node").alias("root"), F.col("root").alias("next")), "root").select("node", F.col("next").alias("root")), "groups")
    return now


def _contracted(points: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: row, node, w (where it joined the cluster ``node``; null: none); nodes: node, size, least, born; edges between them) when
    no small component is left that reaches another one, or few nodes are left. points: row, least. In a round small nodes that
    reach each other first are joined group by group."""
    nodes = points.select(F.col("row").alias("node"), F.lit(1).cast("bigint").alias("size"), "least", F.lit(None).cast("double").alias("born"))
    rows = points.select("row", F.col("row").alias("node"), F.lit(None).cast("double").alias("w"))
    while True:
        left = nodes.count()
        if left <= FEW:
            return rows, nodes, edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        small = nodes.filter("born is null")
        ends = both.join(small.select(F.col("node").alias("a"), "size", "least"), "a").join(nodes.select(F.col("node").alias("b"), F.col("born").isNotNull().alias("is_born")), "b")
        ends = settled(ends, "ends")
        order = F.struct("w", (~F.col("is_born")).alias("small"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.col("b").alias("to"))
        pick = settled(ends.groupBy("a").agg(F.min(order).alias("e")).filter("e.small").select(F.col("a").alias("comp"), F.col("e.to").alias("other")), "picked")
        groups = _picked_groups(small, pick)
        own, other = (groups.select(F.col("node").alias(k), F.col("root").alias(g)) for k, g in (("a", "g"), ("b", "h")))
        asked = ends.join(own, "a").join(other, "b", "left").select("g", "a", "b", "w", "size", "least", F.coalesce(F.col("g") == F.col("h"), F.lit(False)).alias("inside"), "is_born")
        moved = settled(asked.groupBy("g").applyInArrow(_merged, _MOVED), "moved")
        if not moved.limit(1).count():
            return rows, nodes, edges
        joined = rows.join(moved.select("old", "new", F.col("w").alias("at")), (F.col("node") == F.col("old")) & F.col("w").isNull(), "left")
        rows = settled(joined.select("row", F.coalesce("new", "node").alias("node"), F.coalesce("w", "at").alias("w")), "rows")
        to = lambda end: (moved.select(F.col("old").alias(f"o{end}"), F.col("new").alias(f"n{end}")), F.col(end) == F.col(f"o{end}"), "left")
        edges = settled(edges.join(*to("a")).join(*to("b")).select(F.coalesce("na", "a").alias("a"), F.coalesce("nb", "b").alias("b"), "w").filter("a != b"), "edges")
        fresh = moved.filter("old = new").select(F.col("new").alias("node"), "size", "least", "born")
        nodes = settled(nodes.join(moved.select(F.col("old").alias("node")), "node", "left_anti").unionByName(fresh), "nodes")


def _large(points: DataFrame, selection: str) -> DataFrame:
    """row, cluster of the points (row, grp, v, least, samples) of large groups."""
    spark = points.sparkSession
    most = points.agg(F.max("samples")).first()[0] or 1
    rows, nodes, edges = _contracted(points.select("row", "least"), settled(spanning_edges(points, most), "tree"))
    big = nodes.orderBy("node").collect()  # points / least or FEW at most, and groups that are no cluster
    place = {r.node: k for k, r in enumerate(big)}
    between = [(place[e.a], place[e.b], e.w) for e in edges.collect() if e.a in place and e.b in place]
    a, b, w = (np.array([e[k] for e in between], kind) for k, kind in ((0, np.int64), (1, np.int64), (2, np.float64)))
    found = Clusters(np.array([r.size for r in big], np.int64), np.array([np.inf if r.born is None else r.born for r in big], np.float64), a, b, w, np.array([r.least for r in big], np.int64))
    names = np.array([r.node for r in big], np.int64)
    is_born = np.array([r.born is not None for r in big], bool)
    shared = spark.sparkContext.broadcast((names, is_born, found.fell, found.at, ancestors(found.parent), np.array(found.split)))

    def fallen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, is_born, fell, left, above, split = shared.value
        for batch in batches:
            node, w = batch.column("node").to_numpy(), batch.column("w").to_numpy(zero_copy_only=False)
            k = np.searchsorted(names, node)  # every node is there
            w = np.where(np.isnan(w) & ~is_born[k], left[k], w)  # of small nodes points leave together
            there = np.flatnonzero((fell[k] >= 0) & np.isfinite(w))
            w, cluster = w[there], fell[k[there]]
            beyond = np.flatnonzero(is_born[k[there]] & (split[cluster] <= w))
            at = cluster[beyond]
            for up in reversed(above):  # to the last one that has split by then, and one further
                at = np.where((up[at] >= 0) & (split[up[at]] <= w[beyond]), up[at], at)
            cluster[beyond] = above[0][at]
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(there)), pa.array(cluster, pa.int32()), pa.array(w)], ["row", "cluster", "w"])

    at = settled(rows.mapInArrow(fallen, "row bigint, cluster int, w double"), "fallen")
    count, lives = np.zeros(len(found.parent), np.int64), np.zeros(len(found.parent))
    for r in at.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.greatest("w", F.lit(_CLOSEST))).alias("lives")).collect():  # a row for each cluster
        count[r.cluster], lives[r.cluster] = r.n, r.lives
    best = chosen(found.parent, found.split, count, lives, selection)
    taken = spark.createDataFrame([(k, int(c)) for k, c in enumerate(best) if c >= 0], "cluster int, taken int")
    return at.join(taken, "cluster").select("row", F.col("taken").alias("cluster"))


def clusters(rows: DataFrame, key: str, vector: str, least: Column, selection: str = "eom", samples: Column | None = None, within: Column | None = None) -> DataFrame:
    """key, grp (the least key of its cluster; null for noise), size. least: points of a cluster at least; samples: of the core distance, as
    a rule ``least``, or 1 in groups of fewer than SMALL; only rows with an equal ``within`` meet; selection: eom or leaf."""
    group = F.lit("") if within is None else F.coalesce(F.to_json(F.struct(within.alias("g"))), F.lit(""))
    own = least if samples is None else samples
    named = rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), group.alias("grp"), F.col(vector).cast("array<double>").alias("v"), least.cast("int").alias("least"), own.cast("int").alias("samples"))
    named = settled(named, "named")
    good = named.filter("v is not null and size(v) > 0").select("row", "grp", "v", "least", "samples")
    sizes = good.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    good = good.join(sizes, "grp").filter(F.col("n") >= F.greatest(F.lit(2), "least"))
    if samples is None:
        good = good.withColumn("samples", F.when(F.col("n") < SMALL, 1).otherwise(F.col("samples")))
    good = settled(good.withColumn("samples", F.greatest(F.lit(1), F.least("samples", F.col("n") - 1)).cast("int")), "good")

    def whole(table: pa.Table) -> pa.Table:
        told = labels(metric.matrix(table.column("v")), table.column("least")[0].as_py(), table.column("samples")[0].as_py(), selection) if table.num_rows else np.zeros(0)
        return pa.table([table.column("row"), pa.array(told, pa.int32())], names=["row", "cluster"])

    found = good.filter(F.col("n") <= WHOLE).groupBy("grp").applyInArrow(whole, "row bigint, cluster int").filter("cluster >= 0")
    large = good.filter(F.col("n") > WHOLE).drop("n")
    if large.limit(1).count():
        found = found.unionByName(_large(settled(large, "large"), selection))
    placed = named.select("row", "key", "grp").join(settled(found, "found"), "row")
    names = placed.groupBy("grp", "cluster").agg(F.min("key").alias("name"), F.count(F.lit(1)).alias("size"))
    told = placed.join(names, ["grp", "cluster"]).select("row", "name", "size")
    return named.select("row", "key").join(told, "row", "left").select(F.col("key").alias(key), F.col("name").alias("grp"), "size")
