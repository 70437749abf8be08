"""Vectors: the hash embedder, nearest neighbours, assignment to centroids, density groups and the taxonomy's ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import settled

from . import hierarchy, manifold, metric
from .graph import components

DIMENSIONS, ASSIGN, UNCHARTED, UNCHARTED_SIZE = 256, 0.7, 50, 3
#: Fewer rows are clustered as they are; a group of names further than this from all techniques may be a new one.
SMALL, CANDIDATE = 50, 0.6
#: Cosines are trusted up to this.
SLACK = 1e-12
#: Vectors of a block; all blocks meet each other in tasks of their own. In density clusters there are PARTS blocks as long as these hold
#: MOST_BLOCK vectors at most, so what is dealt out grows with the rows, and rows are compared ROWS at a time.
BLOCK, PARTS, MOST_BLOCK, ROWS = 4096, 16, 32768, 256


def hash_embed(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, value: the non-zero entries of unit vectors of word counts, words hashed by md5 modulo 256."""
    words = rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))).alias("w"))
    place = F.conv(F.substring(F.md5("w"), 31, 2), 16, 10).cast("int")
    counts = words.groupBy(key, place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    return counts.join(norms, key).select(key, "place", (F.col("n") / F.col("norm")).alias("value"))


def nn_distance(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, nn_distance: one less the largest dot product with another row; 1 for a row that is alone. Rows are searched for by a
    metric index, which visits only what can still be nearer."""
    named = settled(rows.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")), "vectors")
    best = metric.largest_products(metric.index(named.select("row", F.lit("").alias("grp"), "v")))
    told = named.select("row", "key").join(best, "row", "left")
    return told.select(F.col("key").alias(key), F.coalesce(1 - F.col("product"), F.lit(1.0)).alias("nn_distance"))


def uncharted(distances: DataFrame, sizes: DataFrame, key: str, limit: int = UNCHARTED) -> DataFrame:
    """The rows furthest from any other among those without a group or in a small one: key, nn_distance, rank."""
    few = distances.join(sizes, key, "left").filter(f"size is null or size <= {UNCHARTED_SIZE}")
    top = few.orderBy(F.desc("nn_distance"), key).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("nn_distance"), key))).select(key, "nn_distance", "rank")


def centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, centroid: the unit mean of each label's vectors."""
    means = rows.select(label, F.posexplode(vector).alias("place", "x")).groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("m"))
    gathered = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda s: s["m"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    return gathered.select(label, F.transform("c", lambda x: x / norm).alias("centroid"))


def assign_noise(rows: DataFrame, noise: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = ASSIGN) -> DataFrame:
    """key, label, similarity of the nearest centroid of each noise row, the least label among equals; label is null below
    ``least``. Blocks of rows meet blocks of centroids in tasks of their own."""
    centre = settled(centroids(rows).select("label", F.col("centroid").alias("v")), "centroids")
    asked = settled(noise.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(vector).alias("v")), "noise")
    blocks, others = (max(1, -(-df.count() // BLOCK)) for df in (asked, centre))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    wide, kind = F.col("v").cast("array<double>").alias("v"), rows.schema["label"].dataType.simpleString()
    left = asked.select(F.pmod("row", F.lit(blocks)).cast("int").alias("i"), every(others).alias("j"), "row", F.lit(None).cast(kind).alias("label"), F.lit(True).alias("asks"), wide)
    right = centre.select(every(blocks).alias("i"), F.pmod(F.xxhash64("label"), F.lit(others)).cast("int").alias("j"), F.lit(0).cast("bigint").alias("row"), "label", F.lit(False).alias("asks"), wide)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own, table = part[part["asks"]], part[~part["asks"]].sort_values("label")
        if not len(own) or not len(table):
            return pd.DataFrame({"row": np.zeros(0, np.int64), "label": pd.Series([], dtype=object), "similarity": np.zeros(0)})
        x, c = (np.array(p["v"].tolist(), np.float64) for p in (own, table))
        best, top = np.zeros(len(x), np.int64), np.zeros(len(x))
        for a in range(0, len(x), 512):
            close = x[a : a + 512] @ c.T
            best[a : a + 512], top[a : a + 512] = close.argmax(1), close.max(1)
        return pd.DataFrame({"row": own["row"].to_numpy(), "label": pd.Series(table["label"].to_numpy(object)[best], dtype=object), "similarity": top})

    found = left.unionByName(right).groupBy("i", "j").applyInPandas(run, f"row bigint, label {kind}, similarity double")
    nearest = found.groupBy("row").agg(F.min_by("label", F.struct(-F.col("similarity"), F.col("label"))).alias("l"), F.max("similarity").alias("s"))
    return asked.join(nearest, "row", "left").select(F.col("key").alias(key), F.when(F.col("s") >= least, F.col("l")).alias("label"), F.col("s").alias("similarity"))


def reduce(rows: DataFrame, key: str, vector: str, dims: int = 5, few: int = SMALL) -> DataFrame:
    """key, vector: the first principal directions of the vectors; the vectors themselves below ``few`` rows. Tasks sum up products
    of components, so the driver gets a square of the vectors' length for each."""
    n = rows.count()
    size = rows.select(F.max(F.size(vector))).first()[0] or 0
    if n < few or size <= dims:
        return rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square = np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = metric.matrix(batch.column(0)).reshape(-1, size)
            total, square = total + x.sum(0), square + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, square.ravel()]).tobytes()], pa.binary())], ["sums"])

    told = settled(rows.select(vector).mapInArrow(run, "sums binary").withColumn("part", F.spark_partition_id()), "sums")  # else the tasks would run one after another
    sums = sum((np.frombuffer(r.sums) for r in told.orderBy("part").toLocalIterator()), np.zeros(size + size * size))
    mean = sums[:size] / n
    values, axes = np.linalg.eigh(sums[size:].reshape(size, size) / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-values)[:dims]]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(dims)])  # the largest entry of a direction is positive
    shared = F.array(*[F.array(*[F.lit(float(v)) for v in axis]) for axis in axes.T])
    offset = F.array(*[F.lit(float(v)) for v in mean @ axes])
    wide = F.col(vector).cast("array<double>")
    dot = F.transform(shared, lambda axis: F.aggregate(F.zip_with(wide, axis, lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v))
    return rows.select(F.col(key).alias("key"), F.zip_with(dot, offset, lambda p, q: p - q).alias("vector"))


def _met(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (grp, key, v, ...) dealt to the pairs of blocks of their group: g, i, j, mine and the columns."""
    n = F.count(F.lit(1))
    sizes = parts.groupBy(F.col("grp").alias("g")).agg(F.greatest(F.least(F.ceil(n / BLOCK), F.lit(PARTS)), F.ceil(n / MOST_BLOCK)).cast("int").alias("blocks"))
    both = parts.join(sizes, F.col("grp").eqNullSafe(F.col("g"))).select("g", *columns, "blocks")
    both = both.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.select("g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", *columns)


def density(rows: DataFrame, key: str, vector: str, similarity: float, least: Column, within: Column | None = None) -> DataFrame:
    """key, grp (the least core key of its cluster; null for noise), size. A core has ``least`` rows or more, itself among them,
    at a cosine of ``similarity`` or more; linked cores make a cluster, other rows join their most similar core if it is as near,
    and clusters of fewer than ``least`` rows are noise. Only rows with an equal ``within`` meet. Tasks compare two blocks and
    return counts, spanning forests and best cores, so nothing grows with the number of pairs. Null and zero vectors are noise."""
    group = F.lit(0) if within is None else within
    wide = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda t, x: t + x * x))
    parts = rows.select(group.cast("string").alias("grp"), F.col(key).alias("key"), least.cast("int").alias("least"), F.when(norm > 0, metric.divided(wide, norm)).alias("v"))
    parts = settled(parts, "points")
    good = parts.filter("v is not null")
    kind = rows.schema[key].dataType.simpleString()

    def close(part: pd.DataFrame, back: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows of a block, rows of the other one, their cosines), ROWS at a time; back: from the second block to the first."""
        mine, i, j = part["mine"].to_numpy(), part["i"].iloc[0], part["j"].iloc[0]
        left, right = np.flatnonzero(mine == (j if back else i)), np.flatnonzero(mine == (i if back else j))
        x = np.array(part["v"].tolist(), np.float64)
        y = x[right].T
        for a in range(0, len(left), ROWS):
            some = left[a : a + ROWS]
            told = x[some] @ y
            if i == j:
                told[np.arange(len(some)), np.arange(a, a + len(some))] = -2.0
            yield some, right, told

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(len(part), np.int64)
        for left, right, told in close(part, False):
            near = told >= similarity - SLACK
            n[left] += near.sum(1)
            if part["i"].iloc[0] != part["j"].iloc[0]:
                n[right] += near.sum(0)
        return pd.DataFrame({"key": part["key"], "n": n})

    counts = _met(good, ["key", "v"]).groupBy("g", "i", "j").applyInPandas(counted, f"key {kind}, n bigint").groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("n"))
    cores = settled(good.join(counts, good["key"] == counts["k"]).select("grp", "key", "v", (F.col("n") + 1 >= F.col("least")).alias("core")), "cores")

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("key", ignore_index=True)
        core, keys, out = part["core"].to_numpy(), part["key"].tolist(), []
        root = list(range(len(part)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for back in (False, True) if part["i"].iloc[0] != part["j"].iloc[0] else (False,):
            for own, other, table in close(part, back):
                near = table >= similarity - SLACK
                for x, y in zip(*np.nonzero(near & core[own][:, None] & core[other][None, :]), strict=True) if not back else ():
                    p, q = find(int(own[x])), find(int(other[y]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((keys[own[x]], keys[other[y]], 2.0))
                best = np.where(core[other][None, :] & near, table, -2.0)
                if best.shape[1]:
                    which = best.argmax(1)  # the least key among equals
                    out += [(keys[own[x]], keys[other[which[x]]], float(best[x, which[x]])) for x in np.flatnonzero((best.max(1) > -2.0) & ~core[own])]
        return pd.DataFrame(out, columns=["a", "b", "s"])

    found = settled(_met(cores, ["key", "v", "core"]).groupBy("g", "i", "j").applyInPandas(joined, f"a {kind}, b {kind}, s double"), "met")
    inner = components(cores.filter("core").select(F.col("key").alias("node")), found.filter("s = 2.0").select("a", "b"))
    border = found.filter("s < 2.0").groupBy("a").agg(F.min_by("b", F.struct(-F.round("s", 9), "b")).alias("b"))
    border = border.join(inner, border["b"] == inner["node"]).select(F.col("a").alias("node"), "root")
    placed = inner.unionByName(border)
    told = parts.select("key", "least").join(placed, F.col("key") == F.col("node"), "left").select("key", "least", "root")
    sizes = placed.groupBy(F.col("root").alias("r")).agg(F.count(F.lit(1)).alias("size"))
    told = told.join(sizes, F.col("root") == F.col("r"), "left")
    keep = F.col("size") >= F.col("least")
    return told.select(F.col("key").alias(key), F.when(keep, F.col("root")).alias("grp"), F.when(keep, F.col("size")).alias("size"))


def two_level(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, l1, l2: hierarchical density clusters of the projected vectors (of an n/150 of the rows or more, those without clusters below;
    of two rows where there are few, by stability), and inside each of them clusters of a tenth of its size or more, kept where there
    are two of these or more."""
    n = rows.count()
    points = settled(manifold.project(rows, key, vector, reduce), "projected")
    few = n < SMALL
    top = settled(hierarchy.clusters(points, "key", "vector", F.lit(2 if few else max(5, n // 150)), "eom" if few else "leaf").select("key", "grp", "size"), "top")
    inside = points.join(top.filter("grp is not null").withColumnRenamed("key", "k"), F.col("key") == F.col("k")).withColumn("need", F.greatest(F.lit(2), F.floor(F.col("size") / 10)).cast("int"))
    inside = settled(inside.filter("size >= 2 * need").select("key", "vector", "grp", "need"), "inside")
    low = hierarchy.clusters(inside, "key", "vector", F.col("need"), within=F.col("grp")).select(F.col("key").alias("k"), F.col("grp").alias("l2"))
    told = top.join(low, top["key"] == low["k"], "left").select("key", F.col("grp").alias("l1"), "l2")
    several = told.filter("l2 is not null").groupBy(F.col("l1").alias("t")).agg(F.countDistinct("l2").alias("several"))
    told = told.join(several, F.col("l1") == F.col("t"), "left")
    return told.select(F.col("key").alias(key), "l1", F.when(F.col("several") >= 2, F.col("l2")).alias("l2"))


def nearest(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """rows: key, place, value; catalog: id, place, value (both of unit vectors, the catalog's few). key, id, similarity of the
    nearest entry (0 if none shares a place), the least id among equals."""
    near = rows.join(F.broadcast(catalog.withColumnRenamed("value", "other")), "place").groupBy("key", "id").agg(F.round(F.sum(F.col("value") * F.col("other")), 12).alias("s"))
    best = near.groupBy("key").agg(F.min_by(F.struct("id", "s"), F.struct(-F.col("s"), "id")).alias("m"))
    least = catalog.agg(F.min("id")).first()[0]
    told = rows.select("key").distinct().join(best, "key", "left")
    return told.select("key", F.coalesce("m.id", F.lit(least)).alias("id"), F.coalesce("m.s", F.lit(0.0)).alias("similarity"))


def technique_candidates(names: DataFrame, catalog: DataFrame, least: float = CANDIDATE) -> DataFrame:
    """names: grp, name. grp, size, label (the most frequent name), examples (five, by number, then name), nearest technique of
    the mean of the names' vectors, similarity, is_candidate (none is near)."""
    numbered = names.withColumn("row", F.monotonically_increasing_id())
    numbered = settled(numbered, "names")  # numbers are drawn anew if the rows are read again
    rows = hash_embed(numbered, "row", "name").join(numbered.select("row", "grp"), "row")
    sums = rows.groupBy("grp", "place").agg(F.sum("value").alias("value"))
    norms = sums.groupBy("grp").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    centre = sums.join(norms, "grp").select(F.col("grp").alias("key"), "place", (F.col("value") / F.col("norm")).alias("value"))
    often = names.groupBy("grp", "name").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("n"), "name"))
    top = often.withColumn("place", place).filter("place <= 5").groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("examples"))
    sizes = names.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    told = nearest(centre, catalog).withColumnRenamed("key", "grp")
    return sizes.join(top, "grp").join(told, "grp", "left").select("grp", "size", F.get("examples", F.lit(0)).alias("label"), "examples", F.col("id").alias("nearest_technique"), "similarity", (F.coalesce("similarity", F.lit(0.0)) < least).alias("is_candidate"))


def label_sample(members: DataFrame, group: str, key: str, most: int = 12) -> DataFrame:
    """group, key of the first ``most`` members of each group in the order of key."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return members.withColumn("__place", place).filter(F.col("__place") <= most).select(group, key)


def taxonomy(members: DataFrame, keep: bool = False) -> DataFrame:
    """members: cluster_id, parent, leaf (null: none). use_case_id, parent_id, level, size, and with keep parent and leaf; ids from
    the sorted members."""

    def level(frame: DataFrame, keys: list[str]) -> DataFrame:
        listed = F.array_sort(F.collect_list("cluster_id"))
        text = F.concat(F.lit('[["'), F.array_join(listed, '", "'), F.lit('"]]'))
        return frame.groupBy(*keys).agg(F.concat(F.lit("uc-"), F.substring(F.sha2(text, 256), 1, 10)).alias("use_case_id"), F.count(F.lit(1)).alias("size"))

    top = level(members.filter("parent is not null"), ["parent"])
    low = level(members.filter("parent is not null and leaf is not null"), ["parent", "leaf"])
    leaf = members.schema["leaf"].dataType
    above = top.select(F.col("parent").alias("p"), F.col("use_case_id").alias("parent_id"))
    below = low.join(above, F.col("parent") == F.col("p")).select("use_case_id", "parent_id", F.lit(2).alias("level"), "size", "parent", "leaf")
    first = top.select("use_case_id", F.lit(None).cast("string").alias("parent_id"), F.lit(1).alias("level"), "size", "parent", F.lit(None).cast(leaf).alias("leaf"))
    both = first.unionByName(below)
    return both if keep else both.drop("parent", "leaf")
