"""Embedding near-dedup by dual traversal of cover trees: exact threshold pairs, counted and connected.

Unit vectors lie at chord distance sqrt(2 - 2 cos). A tree holds nets of halving radii; each node knows how far its
points reach. Pairs of nodes go down together: a pair that lies further apart than both reaches and the threshold has
no link; one that lies within it with both reaches links wholly and is counted at once; the others go on with the children
of the wider node, down to single vectors, whose cosine is computed in double precision.

Equal vectors of a label are one node from the start. The top of the trees is spread over the cluster: some vectors are
drawn as centres (MOST_CENTRES at most over all labels), each vector has its nearest centre's cell as home, and visits
only those other cells that can hold a partner, by their radii and by the planes between centres. Large cells are worked
on in blocks. A task returns one row per vector it was given, so nothing grows with the number of pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do
rows with a null label and vectors of another length; repeated rows are vectors of their own; null ids are kept and are a
component's id only if all its ids are null; labels of any type are compared as they are; doubles are not rounded to
floats; a vector of any length is one row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, read
from .components import components, spanning, whole_groups

THRESHOLD = 0.93
#: Vectors of a cell, and of one side of a task, as far as MOST_CENTRES allows.
BLOCK = 2048
MOST_CENTRES = 1 << 15
#: Radii of the nets below the root.
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
#: Distances are trusted up to this.
SLACK = 1e-7


class CoverTree:
    """Nodes in arrays: centre (index of a vector), reach, first child and end, first point and end in ``order``."""

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        n = len(unit)
        self.order = np.arange(n)
        rows: list[list[float]] = [[0, 0.0, 0, 0, 0, n]]
        level = [0]
        for radius in RADII:
            below = []
            for node in level:
                a, b = int(rows[node][4]), int(rows[node][5])
                if b - a <= 1:
                    continue
                rows[node][2] = len(rows)
                points, at, done = self.order[a:b].copy(), a, []
                left = np.arange(b - a)
                close = unit[points] @ unit[points].T >= 1 - radius * radius / 2 if b - a <= 2 * BLOCK else None
                while len(left):
                    inside = (close[left[0], left] if close is not None else self._far(points[left[0]], points[left]) <= radius).copy()
                    inside[0] = True
                    done.append(points[left[inside]])
                    below.append(len(rows))
                    rows.append([done[-1][0], 0.0, 0, 0, at, at := at + len(done[-1])])
                    left = left[~inside]
                self.order[a:b] = np.concatenate(done)
                rows[node][3] = len(rows)
            level = below
        for node in level:  # points below the finest net
            a, b = int(rows[node][4]), int(rows[node][5])
            if b - a > 1:
                rows[node][2] = len(rows)
                rows += [[p, 0.0, 0, 0, k, k + 1] for k, p in zip(range(a, b), self.order[a:b].tolist(), strict=True)]
                rows[node][3] = len(rows)
        table = np.array(rows)
        self.centre, self.child, self.child_end, self.first, self.end = (table[:, k].astype(np.int64) for k in (0, 2, 3, 4, 5))
        self.reach = np.array([self._far(int(c), self.order[a:b]).max() if b - a > 1 else 0.0 for c, a, b in zip(self.centre, self.first, self.end, strict=True)])

    def _far(self, centre: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.unit[points] @ self.unit[centre])))


def _pairs_of_ranges(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (x, y) with x in a range of the first kind and y in the one beside it."""
    na, nb = a_end - a, b_end - b
    count = na * nb
    if not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    width = np.repeat(nb, count)
    return np.repeat(a, count) + place // width, np.repeat(b, count) + place % width


def links(x: CoverTree, y: CoverTree, raw_x: np.ndarray, raw_y: np.ndarray, weight_x: np.ndarray, weight_y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights linked to each x, to each y, and edges x-y that connect what is linked). x is y: pairs of one tree,
    each vector's pair with itself left out."""
    limit = float(np.sqrt(2 - 2 * threshold))
    to_x, to_y = np.zeros(len(raw_x), np.int64), np.zeros(len(raw_y), np.int64)
    edge_x, edge_y = [], []
    same = x is y
    stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]

    def children(a: int, a_end: int, b: int, b_end: int, once: bool) -> None:
        """Pairs of two ranges of nodes that lie near enough, by one product of matrices for some rows at a time."""
        right, reach = y.unit[y.centre[b:b_end]].T, y.reach[b:b_end]
        for k in range(a, a_end, 1024):
            close = x.unit[x.centre[k : min(k + 1024, a_end)]] @ right
            most = limit + SLACK + x.reach[k : k + len(close), None] + reach[None, :]
            i, j = np.nonzero(close >= 1 - np.minimum(most, 2.0) ** 2 / 2 - SLACK)
            i, j = i + k, j + b
            if once:
                i, j = i[i <= j], j[i <= j]
            if len(i):
                stack.append((i, j))

    while stack:
        a, b = stack.pop()
        if len(a) > 1 << 16:
            stack += [(a[k : k + (1 << 16)], b[k : k + (1 << 16)]) for k in range(0, len(a), 1 << 16)]
            continue
        p, q = x.centre[a], y.centre[b]
        far = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x.unit[p], y.unit[q])))
        both = x.reach[a] + y.reach[b]
        near = far <= limit + both + SLACK
        a, b, far, both = a[near], b[near], far[near], both[near]
        single = (x.end[a] - x.first[a] == 1) & (y.end[b] - y.first[b] == 1)
        if single.any():
            i, j = x.centre[a[single]], y.centre[b[single]]
            u, v = raw_x[i], raw_y[j]
            cosine = np.einsum("ij,ij->i", u, v) / (np.sqrt(np.einsum("ij,ij->i", u, u)) * np.sqrt(np.einsum("ij,ij->i", v, v)))
            hit = cosine >= threshold
            if same:
                hit &= i != j
            i, j = i[hit], j[hit]
            np.add.at(to_x, i, weight_y[j])
            np.add.at(to_y, j, weight_x[i])
            edge_x.append(i)
            edge_y.append(j)
        inside = ~single & (far + both <= limit - SLACK)
        for k, m in zip(a[inside].tolist(), b[inside].tolist(), strict=True):
            i, j = x.order[x.first[k] : x.end[k]], y.order[y.first[m] : y.end[m]]
            if same and k == m:  # each with all others
                to_x[i] += weight_x[i].sum() - weight_x[i]
            else:
                to_x[i] += weight_y[j].sum()
                to_y[j] += weight_x[i].sum()
            edge_x += [i, np.repeat(i[:1], len(j))]
            edge_y += [np.repeat(j[:1], len(i)), j]
        more = ~single & ~inside
        a, b = a[more], b[more]
        # down on the wider side; a node with itself on both, each pair of children once
        twin = (a == b) if same else np.zeros(len(a), bool)
        left = ~twin & (x.child_end[a] > x.child[a]) & ((x.reach[a] >= y.reach[b]) | (y.child_end[b] <= y.child[b]))
        right = ~twin & ~left
        for pick, once, la, le, ra, re in (
            (left, False, x.child[a], x.child_end[a], b, b + 1),
            (right, False, a, a + 1, y.child[b], y.child_end[b]),
            (twin, True, x.child[a], x.child_end[a], y.child[b], y.child_end[b]),
        ):
            if pick.any():
                la, le, ra, re = la[pick], le[pick], ra[pick], re[pick]
                large = (le - la) * (re - ra) > 1024
                for k in np.flatnonzero(large).tolist():
                    children(int(la[k]), int(le[k]), int(ra[k]), int(re[k]), once)
                if large.all():
                    continue
                la, le, ra, re = la[~large], le[~large], ra[~large], re[~large]
                size = np.cumsum((le - la) * (re - ra))
                cut = np.searchsorted(size, np.arange(1 << 20, size[-1] + (1 << 20), 1 << 20))
                for s, e in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True):
                    s, e = s + (s > 0), e + 1
                    na, nb = _pairs_of_ranges(la[s:e], le[s:e], ra[s:e], re[s:e])
                    if once:
                        na, nb = na[na <= nb], nb[na <= nb]
                    if len(na):
                        stack.append((na, nb))
    none = [np.zeros(0, np.int64)]
    return to_x, to_y, np.concatenate(edge_x or none), np.concatenate(edge_y or none)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def _centres(nodes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Centres of the groups (label, length) that need more than one cell; MOST_CENTRES at most in all."""
    total = nodes.count()
    cell = max(BLOCK, total // MOST_CENTRES * 2)
    there = nodes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    few = F.abs(F.xxhash64("node", F.lit("centre"))) / F.lit(float(1 << 63)) < F.least(F.lit(1.0), F.lit(1.0) / cell)
    drawn = nodes.filter(few).join(there, ["label", "dim"], "left_semi").orderBy("node").limit(MOST_CENTRES)
    found: dict[tuple[str, int], list] = {}
    for r in drawn.select("label", "dim", "vector").collect():
        found.setdefault((r.label, r.dim), []).append(r.vector)
    return {k: _unit(np.array(v, np.float64)) for k, v in found.items()}


def _schema(nodes: DataFrame, columns: str, more: str) -> str:
    """DDL of some columns of nodes, whose vectors are of floats or doubles, and more."""
    return ", ".join([*(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in columns.split()), more])


def _homes(nodes: DataFrame, centres: dict) -> DataFrame:
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
            home, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            for key in set(keys) & set(shared.value):
                rows = np.array([i for i, k in enumerate(keys) if k == key])
                unit = _unit(_matrix(pa.chunked_array([batch.column("vector").take(pa.array(rows))])))
                close = unit @ shared.value[key].T
                home[rows] = close.argmax(1)
                far[rows] = np.sqrt(np.maximum(0, 2 - 2 * close.max(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(far)], [*batch.schema.names, "home", "far"])

    return nodes.mapInArrow(run, _schema(nodes, "node label dim vector weight", "home int, far double"))


def _visits(homes: DataFrame, centres: dict, reach: dict, limit: float) -> DataFrame:
    """A row for each cell that a vector is in or must visit (of higher number than its own)."""
    shared = homes.sparkSession.sparkContext.broadcast((centres, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, reach = shared.value
        for whole in batches:
            for batch in (whole.slice(k, 512) for k in range(0, whole.num_rows, 512)):
                home, far = batch.column("home").to_numpy(), batch.column("far").to_numpy()
                keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
                rows, cells = [np.arange(batch.num_rows)], [home.astype(np.int64)]
                for key in set(keys) & set(centres):
                    own = np.array([i for i, k in enumerate(keys) if k == key])
                    unit = _unit(_matrix(pa.chunked_array([batch.column("vector").take(pa.array(own))])))
                    to = np.sqrt(np.maximum(0, 2 - 2 * (unit @ centres[key].T)))
                    ok = (to <= reach[key][None, :] + limit + SLACK) & (to <= far[own][:, None] + 2 * limit + SLACK)
                    ok &= np.arange(len(centres[key]))[None, :] > home[own][:, None]
                    i, j = np.nonzero(ok)
                    rows.append(own[i])
                    cells.append(j)
                row, cell = np.concatenate(rows), np.concatenate(cells)
                took = pa.array(row)
                columns = [batch.column(c).take(took) for c in ("node", "label", "dim", "vector", "weight")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell.astype(np.int32)), pa.array(cell != home[row])], ["node", "label", "dim", "vector", "weight", "cell", "visitor"])

    return homes.mapInArrow(run, _schema(homes, "node label dim vector weight", "cell int, visitor boolean"))


def _counted(rows: DataFrame, threshold: float) -> DataFrame:
    """node, n (weights linked in this task), root (a node it is connected with here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["label", "dim", "cell", "i", "j"], 1):
            for s, e in zip(at.tolist(), [*at[1:].tolist(), table.num_rows], strict=True):
                part = table.slice(s, e - s)
                raw, weight = _matrix(part.column("vector")), part.column("weight").to_numpy()
                side = part.column("side").to_numpy()
                x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                n = np.zeros(e - s, np.int64)
                if not len(y):
                    tree = CoverTree(_unit(raw))
                    to, back, a, b = links(tree, tree, raw, raw, weight, weight, threshold)
                    n += to + back
                elif len(x):
                    to, back, a, b = links(CoverTree(_unit(raw[x])), CoverTree(_unit(raw[y])), raw[x], raw[y], weight[x], weight[y], threshold)
                    n[x], n[y] = to, back
                    a, b = x[a], y[b]
                else:
                    continue
                nodes = part.column("node").to_pylist()
                root = list(range(e - s))
                for i, r in spanning(e - s, a, b):
                    root[i] = r
                keep = np.flatnonzero(n).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in keep], pa.string()), pa.array(n[keep]), pa.array([nodes[root[i]] for i in keep], pa.string())], ["node", "n", "root"])

    return rows.mapInArrow(run, "node string, n bigint, root string")


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept."""
    spark = table.sparkSession
    spread = partitions(spark, table)
    limit = float(np.sqrt(2 - 2 * threshold))
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    zero = table.schema[label_col].dataType.simpleString() in ("float", "double")  # -0.0 and 0.0 are one label
    label = (F.col(label_col) + F.lit(0.0) if zero else F.col(label_col)).cast("string")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(F.col(label_col).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0), F.lit(False))
    node = F.concat(F.hex(F.xxhash64(label, vector)), F.lit("-"), F.hex(F.xxhash64(vector, label)))
    rows = table.select(F.col(id_col).alias("id"), label.alias("label"), vector.alias("vector"), F.when(usable, node).alias("node"))
    nodes = rows.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))
    nodes = materialise(nodes.withColumn("dim", F.size("vector")), "vectors")

    centres = _centres(nodes)
    homes = materialise(_homes(nodes.select("node", "label", "dim", "vector", "weight"), centres), "homes")
    reach = {k: np.zeros(len(v)) for k, v in centres.items()}
    for r in homes.groupBy("label", "dim", "home").agg(F.max("far").alias("far")).toLocalIterator() if centres else ():
        if (r.label, r.dim) in reach:
            reach[r.label, r.dim][r.home] = r.far
    visits = materialise(_visits(homes, centres, reach, limit), "visits")

    # blocks: i of the cell's own vectors (side 0); j of its own (up from i) or, from own_blocks on, of its visitors (side 1)
    cell = ["label", "dim", "cell"]
    sizes = visits.groupBy(*cell).agg(F.sum(F.when(F.col("visitor"), 0).otherwise(1)).alias("own"), F.sum(F.when(F.col("visitor"), 1).otherwise(0)).alias("visiting"))
    sizes = sizes.select(*cell, F.ceil(F.col("own") / BLOCK).cast("int").alias("own_blocks"), F.ceil(F.col("visiting") / BLOCK).cast("int").alias("visit_blocks"))
    placed = visits.join(sizes, cell).filter("own_blocks > 0")
    mine = F.pmod(F.xxhash64("node"), F.greatest(F.when(F.col("visitor"), F.col("visit_blocks")).otherwise(F.col("own_blocks")), F.lit(1))).cast("int")
    placed = placed.withColumn("mine", mine)
    own_tasks = F.transform(F.sequence(F.lit(0), F.col("own_blocks") + F.col("visit_blocks") - 1), lambda k: F.struct(
        F.least("mine", k).cast("int").alias("i"), F.greatest("mine", k).cast("int").alias("j"),
        F.when((k < F.col("own_blocks")) & (k < F.col("mine")), 1).otherwise(0).cast("int").alias("side")))
    visit_tasks = F.transform(F.sequence(F.lit(0), F.col("own_blocks") - 1), lambda k: F.struct(k.cast("int").alias("i"), (F.col("own_blocks") + F.col("mine")).cast("int").alias("j"), F.lit(1).alias("side")))
    tasks = placed.withColumn("task", F.explode(F.when(F.col("visitor"), visit_tasks).otherwise(own_tasks))).select(*cell, "task.*", "node", "vector", "weight")
    tasks = tasks.repartition(spread, *cell, "i", "j").sortWithinPartitions(*cell, "i", "j")
    counted = materialise(_counted(tasks, threshold), "links")

    joined = components(counted.select(F.col("node").alias("a"), F.col("root").alias("b")))
    joined = joined.join(nodes.select("node", "least"), "node")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = joined.join(least, "root").select("node", "component_id")
    told = nodes.select("node", "weight", "least").join(counted.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(of_node, "node", "left")
    told = told.select("node", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    out = rows.select("id", "node").join(told, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op8_cover_tree(spark, sf_dir):
    return near_vectors(read(spark, sf_dir, "embeddings"))


#: All pairs of a label, and components by recursion.
OP8_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e),
x AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {THRESHOLD}),
r AS (SELECT vec_id AS node, vec_id AS root FROM u UNION SELECT x.b, r.root FROM r JOIN x ON r.node = x.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM x GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""
