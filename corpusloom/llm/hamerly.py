"""Centroid clustering in whole numbers with Hamerly's bounds.

Every component x becomes floor(SCALE * x), and the first centroids are the vectors of least sha256 of ``1:<id>``. A round assigns
each vector to its nearest centroid (squared Euclidean distance, the smaller number among equals) and then moves every centroid that
has vectors to the floor of their mean, component by component.

With each vector go two numbers from round to round: an upper bound of the distance to its own centroid and a lower bound of that
to any other. When centroids move, the first grows by its own centroid's drift and the second shrinks by the largest drift of the others.
Where the upper bound stays below the lower one, or below half the way from the own centroid to the next, nothing is compared. The
other vectors get the exact distance to their own centroid, and those that are still ambiguous a whole scan of all centroids in
exact whole numbers, which also renews both bounds. Bounds are doubles with SLACK on the safe side, so they only ever cause a scan too much.

A round is one pass without a shuffle, written to the shared folder with its bounds, and one grouping of K rows a task for the
sums. The driver holds K centroids. Nothing is drawn at random, so what a lost task did is repeated as it was.

Defined cases: vectors that are null, of another length, hold null or non-finite components, or one beyond LARGEST (whose squared
distance would be no long) are left out and get no row; null ids hash as the empty text; of equal hashes the lesser vector comes
first; repeated rows are vectors of their own; with fewer than K vectors each is a centroid, equal ones too (the later stays empty and
where it is); an empty table gives no rows; other columns are ignored. Sums are longs, enough for 2 ** 36 vectors of the largest components
in one cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, read

K, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: Whole numbers of components up to this are kept: squared distances of 64 of them fit a long.
LARGEST = 1 << 27
#: Up to this, doubles hold all sums exactly, and a product of matrices is exact.
_EXACT = 1 << 22
SLACK = 1e-9


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x by rows of c) of whole numbers."""
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= _EXACT else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]).astype(np.int64)


def own_distances(x: np.ndarray, c: np.ndarray, of: np.ndarray) -> np.ndarray:
    apart = x - c[of]
    return np.einsum("ij,ij->i", apart, apart)


def near_halves(c: np.ndarray) -> np.ndarray:
    """Of each centroid, half the way to the nearest other one."""
    if len(c) < 2:
        return np.full(len(c), np.inf)
    apart = np.sqrt(distances(c, c).astype(np.float64))
    np.fill_diagonal(apart, np.inf)
    return apart.min(1) / 2


def assign(x: np.ndarray, c: np.ndarray, half: np.ndarray, drift: np.ndarray, of: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(number, upper, lower) of each row of x after the centroids moved by ``drift`` to c, and how many rows were scanned."""
    of, upper, lower = of.copy(), upper + drift[of], lower.copy()
    if len(c) > 1:
        order = np.argsort(-drift)
        lower -= np.where(of == order[0], drift[order[1]], drift[order[0]])
    bound = np.maximum(lower * (1 - SLACK) - SLACK, half[of] * (1 - SLACK))
    open_ = np.flatnonzero(~(upper * (1 + SLACK) + SLACK < bound))
    if len(open_):
        upper[open_] = np.sqrt(own_distances(x[open_], c, of[open_]).astype(np.float64))
        open_ = open_[~(upper[open_] * (1 + SLACK) + SLACK < bound[open_])]
    if len(open_):
        far = distances(x[open_], c)
        best = far.argmin(1)  # the smaller number among equals
        of[open_] = best
        upper[open_] = np.sqrt(far[np.arange(len(far)), best].astype(np.float64))
        far[np.arange(len(far)), best] = np.iinfo(np.int64).max
        lower[open_] = np.sqrt(far.min(1).astype(np.float64)) if len(c) > 1 else np.inf
    return of, upper, lower, len(open_)


def _whole(vector: Column, dims: int, scale: int) -> Column:
    """The whole numbers of a usable vector, else null."""
    wide = vector.cast("array<double>")
    usable = (F.size(wide) == dims) & F.forall(wide, lambda x: F.coalesce(F.abs(x) * scale < LARGEST, F.lit(False)) & ~F.isnan(x))
    return F.when(usable, F.transform(wide, lambda x: F.floor(x * scale).cast("int")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _pass(rows: DataFrame, c: np.ndarray, drift: np.ndarray, first: bool, last: bool) -> DataFrame:
    """One assignment: id, vec, cluster, upper, lower; in the last one id, cluster, distance."""
    dims, half = c.shape[1], near_halves(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vec"), dims)
            if first:
                of, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.full(len(x), -np.inf)
            else:
                of, upper, lower = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("cluster", "upper", "lower"))
            of, upper, lower, _ = assign(x, c, half, drift, of.astype(np.int64), upper, lower)
            number = pa.array(of.astype(np.int32))
            if last:
                yield pa.RecordBatch.from_arrays([batch.column("id"), number, pa.array(own_distances(x, c, of))], ["id", "cluster", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), number, pa.array(upper), pa.array(lower)], ["id", "vec", "cluster", "upper", "lower"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, cluster int, distance bigint" if last else f"id {kind}, vec array<int>, cluster int, upper double, lower double")


def _moved(state: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after a round; those without vectors stay."""
    sums = [F.sum(F.get("vec", F.lit(i)).cast("bigint")).alias(f"s{i}") for i in range(c.shape[1])]
    out = c.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # a row for each centroid
        out[r.cluster] = [r[f"s{i}"] // r.n for i in range(c.shape[1])]
    return out


def clusters(table: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that is kept: id, cluster, distance (squared), cluster_inertia, inertia, centroid (whole numbers)."""
    rows = table.select(F.col(id_col).alias("id"), _whole(F.col(vector_col), dims, scale).alias("vec")).filter("vec is not null")
    rows = materialise(rows, "whole-vectors")
    start = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    c = np.array([r.vec for r in rows.select(start.alias("h"), "vec").orderBy("h", "vec").limit(k).collect()], np.int64).reshape(-1, dims)  # k rows
    drift, state = np.zeros(len(c)), rows
    for n in range(rounds):
        state = materialise(_pass(state, c, drift, n == 0, False), "bounds")
        moved = _moved(state, c)
        c, drift = moved, np.sqrt(np.maximum(0, own_distances(moved, c, np.arange(len(c)))).astype(np.float64)) * (1 + SLACK)
    told = materialise(_pass(state, c, drift, rounds == 0, True), "assigned")
    wide = F.sum(F.col("distance").cast("decimal(20,0)"))
    sums = told.groupBy("cluster").agg(wide.alias("own"))
    whole = sums.agg(F.sum("own").alias("whole"))
    known = table.sparkSession.createDataFrame([(i, x.tolist()) for i, x in enumerate(c)], "number int, centroid array<bigint>")
    sums = sums.join(F.broadcast(known), F.col("cluster") == F.col("number")).crossJoin(F.broadcast(whole))  # k rows by one
    sums = sums.select("number", "centroid", F.col("own").try_cast("bigint").alias("cluster_inertia"), F.col("whole").try_cast("bigint").alias("inertia"))
    found = told.join(F.broadcast(sums), F.col("cluster") == F.col("number"))
    return found.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op13_hamerly_clusters(spark, sf_dir):
    found = clusters(read(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _sql() -> str:
    """All distances in every round."""
    text = f"""WITH c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM e ORDER BY k LIMIT {K})"""
    near = "SELECT e.vec_id, any_value(e.v) AS v, min(struct_pack(d := CAST(list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS BIGINT), k := k)) AS b FROM e CROSS JOIN c{n} GROUP BY e.vec_id"
    for n in range(ROUNDS):
        text += f""", a{n} AS ({near.format(n=n)}), s{n} AS (SELECT b.k AS k, i, floor(sum(v[i]) / count(*)) AS m FROM a{n}, (SELECT unnest(range(1, {DIMS + 1})) AS i) GROUP BY ALL),
l{n} AS (SELECT k, list(m ORDER BY i) AS m FROM s{n} GROUP BY k), c{n + 1} AS (SELECT c{n}.k, coalesce(m, c) AS c FROM c{n} LEFT JOIN l{n} ON l{n}.k = c{n}.k)"""
    usable = f"len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
    return text.replace("WITH c0", f"WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {usable}), c0", 1) + f""", f AS ({near.format(n=ROUNDS)})
SELECT vec_id, CAST(b.k AS INT) AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256 FROM f JOIN c{ROUNDS} ON c{ROUNDS}.k = b.k"""


OP13_SQL = _sql()
