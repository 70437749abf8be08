"""Range bisection of a capped source, bounded batches, and samples by size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import settled


def bisect(count: Callable[..., int], cap: int, low: int, high: int, qualifiers: Iterable[str] = ()) -> Iterator[tuple[int, int, int, str]]:
    """(low, high, total, kind) of ranges that hold something: leaf where a total is at most cap. One value that alone has more is
    asked for with each qualifier (count(low, high, qualifier)): a leaf, or capped where that is still too many; what no
    qualifier accounts for, or all of it without qualifiers, is overflow."""
    pending, qualifiers = [(low, high)], tuple(qualifiers)
    while pending:
        a, b = pending.pop()
        total = count(a, b)
        if 0 < total <= cap:
            yield a, b, total, "leaf"
        elif total and a == b:
            parts = [n for q in qualifiers if (n := count(a, b, q))]
            yield from ((a, b, n, "leaf" if n <= cap else "capped") for n in parts)
            if (rest := total - sum(parts)) > 0:
                yield a, b, rest, "overflow"
        elif total:
            middle = (a + b) // 2
            pending += [(middle + 1, b), (a, middle)]


def lattice(rows: DataFrame, value: str, cap: int, levels: int) -> DataFrame:
    """The same ranges over 0 .. 2 ** levels - 1 by grouping: a range is kept if its total is at most cap and its
    parent's isn't. One pass counts the values; each level sums up the one below."""
    counts = rows.filter(F.col(value).between(0, (1 << levels) - 1)).groupBy(F.col(value).cast("bigint").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    width = F.pow(F.lit(2.0), "level").cast("bigint")
    ranges = each.groupBy("level", (F.floor(F.col("v") / width) * width).alias("low")).agg(F.sum("n").alias("total"))
    parent = ranges.select((F.col("level") - 1).alias("level"), F.col("low").alias("above"), F.col("total").alias("whole"))
    wide = F.pow(F.lit(2.0), F.col("level") + 1).cast("bigint")
    told = ranges.withColumn("above", F.floor(F.col("low") / wide) * wide).join(parent, ["level", "above"], "left")
    kept = told.filter(((F.col("total") <= cap) | (F.col("level") == 0)) & (F.coalesce("whole", F.lit(cap + 1)) > cap))
    width = F.pow(F.lit(2.0), "level").cast("bigint")
    return kept.select("low", (F.col("low") + width - 1).alias("high"), "total", F.when(F.col("total") <= cap, "leaf").otherwise("overflow").alias("kind"))


def qualified(rows: DataFrame, value: str, qualifier: str, cap: int, levels: int) -> DataFrame:
    """The lattice, in which a value that alone has more than cap is told apart by its qualifier: low, high, qualifier, total, kind. leaf: cap at
    most; capped: a value and qualifier with more; overflow: what has such a value and no qualifier (null)."""
    found = lattice(rows, value, cap, levels)
    over = found.filter("kind = 'overflow'").select(F.col("low").alias("v"))
    parts = rows.groupBy(F.col(value).cast("bigint").alias("v"), F.col(qualifier).cast("string").alias("qualifier")).agg(F.count(F.lit(1)).alias("total")).join(over, "v", "left_semi")
    kind = F.when(F.col("qualifier").isNull(), "overflow").when(F.col("total") <= cap, "leaf").otherwise("capped")
    whole = found.filter("kind = 'leaf'").select("low", "high", F.lit(None).cast("string").alias("qualifier"), "total", "kind")
    return whole.unionByName(parts.select(F.col("v").alias("low"), F.col("v").alias("high"), "qualifier", "total", kind.alias("kind")))


def _placed(rows: DataFrame, key: str, size: str | None = None) -> DataFrame:
    """rows with __place (from 0, in the order of key) and, of ``size``, __sum before each; both come from ranges of the key, so no task sorts
    the whole table."""
    spark = rows.sparkSession
    parts = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("__p", F.spark_partition_id())
    parts = settled(parts, "ranges")  # ranges are drawn anew if the rows are read again
    inside, before = Window.partitionBy("__p").orderBy(key), Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.col(size), F.lit(0)).cast("bigint") if size else F.lit(0).cast("bigint")
    place = parts.withColumns({"__i": F.row_number().over(inside) - 1, "__s": F.coalesce(F.sum(own).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    counts = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("s"))  # a row for each range
    counts = counts.select("__p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("__below"))
    told = place.join(F.broadcast(counts), "__p")
    return told.withColumns({"__place": F.col("__i") + F.col("__before"), "__sum": F.col("__s") + F.col("__below")}).drop("__p", "__i", "__s", "__before", "__below")


def numbered(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with the number of their batch of ``size``, in the order of key."""
    return _placed(rows, key).withColumn("batch", F.floor(F.col("__place") / size)).drop("__place", "__sum")


#: Rows whose next batch starts are looked for together.
CHUNK = 1 << 16


def greedy(rows: DataFrame, key: str, size: str, most: int = 40, most_bytes: int = 400_000) -> DataFrame:
    """key, batch: rows in the order of key, as many to a batch as the limits allow; a larger row stands alone. A null size counts as 0; rows of
    one key follow each other in any order. Each row's next start, if it were one, is at most ``most`` rows on; which rows are starts is told
    by doubling: from the starts among the first 2 ** k batches and the 2 ** k-th next start of every row."""
    at = settled(_placed(rows.select(F.col(key).alias("key"), F.col(size).alias("size")), "key", "size"), "placed")
    number = at.select(F.col("__place").alias("i"), (F.col("__sum") + F.coalesce("size", F.lit(0))).alias("after"), F.col("__sum").alias("before"))
    chunk = lambda i: F.floor(i / CHUNK)
    spread = number.withColumn("chunk", F.explode(F.sequence(chunk(F.greatest(F.lit(0), F.col("i") - most + 1)), chunk(F.col("i")))))
    ahead = F.collect_list("after").over(Window.partitionBy("chunk").orderBy("i").rowsBetween(0, most - 1))
    fits = spread.withColumn("ahead", ahead).filter(chunk(F.col("i")) == F.col("chunk"))
    jump = settled(fits.select("i", (F.col("i") + F.greatest(F.lit(1), F.size(F.filter("ahead", lambda s: s - F.col("before") <= most_bytes)))).alias("next")), "next")
    starts, far = jump.filter("i = 0").select("i"), jump
    while True:
        reached = settled(starts.unionByName(starts.join(far, "i").select(F.col("next").alias("i")).join(number.select("i"), "i", "left_semi")).distinct(), "starts")
        longer = settled(far.join(far.select(F.col("i").alias("next"), F.col("next").alias("then")), "next").select("i", F.col("then").alias("next")), "far")
        starts, far = reached, longer
        if not far.filter("i = 0").limit(1).count():  # the first row's jump leads beyond the end
            break
    batches = numbered(starts, "i", 1).join(jump, "i")
    members = batches.select("batch", F.explode(F.sequence(F.col("i"), F.col("next") - 1)).alias("__place"))
    return at.join(members, "__place").select(F.col("key").alias(key), "batch")


#: What a page holds, and pages that a capped node costs.
PAGE, CAPPED_PAGES = 100, 10


def totals(nodes: DataFrame, remaining: float = 0.0) -> DataFrame:
    """One row of a lattice's nodes (total, kind): leaf_sum, overflows, fetch_requests, and projected_nodes if ``remaining`` more
    files are found as the leaves' were."""
    leaf = F.col("kind") == "leaf"
    found = nodes.agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum(F.when(leaf, F.col("total"))), F.lit(0)).alias("leaf_sum"), F.count(F.when(~leaf, 1)).alias("overflows"),
        F.coalesce(F.sum(F.when(leaf, F.ceil(F.col("total") / PAGE)).otherwise(CAPPED_PAGES)), F.lit(0)).cast("bigint").alias("fetch_requests"),
    )
    return found.withColumn("projected_nodes", F.col("nodes") * (1 + F.try_divide(F.lit(float(remaining)), F.col("leaf_sum"))))


def stratified(rows: DataFrame, key: str, size: str, stratum: str, total: int, per_window: int = 10) -> DataFrame:
    """A sample of about ``total`` rows: each stratum gets its share (largest remainder), drawn from windows of sizes that are
    equally wide in the logarithm, ``per_window`` at a time; windows and rows are in an order by hash. How many rows of a window are
    needed follows from the windows' counts, so only rows whose hash lies below a bound are ranked: it leaves room for chance, and is
    doubled for a window where too few lie below it."""
    window = F.floor(F.log10(F.greatest(F.coalesce(F.col(size), F.lit(1)), F.lit(1)).cast("double")) * 4).cast("int")
    named = rows.withColumns({"__window": window, "__hash": F.md5(F.concat(F.col(key).cast("string"), F.lit(":7")))}).withColumn("__u", F.conv(F.substring("__hash", 1, 13), 16, 10).cast("double") / float(1 << 52))
    counts = named.groupBy(F.col(stratum).alias("__s"), "__window").agg(F.count(F.lit(1)).alias("m")).collect()  # a row for each stratum and window
    sizes: dict = {}
    for r in counts:
        sizes.setdefault(r["__s"], {})[r["__window"]] = r.m
    whole = sum(r.m for r in counts)
    raw = [(k, total * sum(w.values()) / max(whole, 1)) for k, w in sizes.items()]
    quota = {k: int(x) for k, x in raw}
    for k, _ in sorted(raw, key=lambda kx: (int(kx[1]) - kx[1], str(kx[0])))[: min(total, whole) - sum(quota.values())]:
        quota[k] += 1
    need = {}
    for k, windows in sizes.items():
        turns = 0
        while sum(min(m, turns * per_window) for m in windows.values()) < quota[k]:
            turns += 1
        need |= {(k, w): min(m, turns * per_window) for w, m in windows.items()}
    share = {kw: (n + 6 * n**0.5 + 10) / sizes[kw[0]][kw[1]] if n else 0.0 for kw, n in need.items()}
    kind = rows.schema[stratum].dataType.simpleString()
    while True:
        bounds = rows.sparkSession.createDataFrame([(k, w, share[k, w], quota[k]) for k, w in share] or [(None, 0, 0.0, 0)], f"__s {kind}, __w int, __most double, __quota int")
        near = named.join(F.broadcast(bounds), F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__window") == F.col("__w"))).filter("__u < __most")
        there = {(r["__s"], r["__w"]): r.n for r in near.groupBy("__s", "__w").agg(F.count(F.lit(1)).alias("n")).collect()}
        few = [kw for kw, n in need.items() if there.get(kw, 0) < n]
        if not few:
            break
        share |= {kw: 2 * share[kw] for kw in few}
    inside = Window.partitionBy("__s", "__window").orderBy("__hash", key)
    drawn = near.withColumn("__turn", F.floor((F.row_number().over(inside) - 1) / per_window))
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__turn", F.md5(F.concat(F.col("__window").cast("string"), F.lit(":3"))), "__hash", key))
    return drawn.withColumn("__place", place).filter("__place <= __quota").select(*rows.columns)


def below(edges: DataFrame, deepest: int = 64) -> DataFrame:
    """edges: up, node. node, n: how many entries lie below each that has any. Goes down a level at a time, so a tree of any size
    takes as many joins as it is deep; one deeper than ``deepest``, or a circle, is an error."""
    edges = settled(edges.select("up", "node"), "tree")
    level, found = edges, edges
    for _ in range(deepest):
        level = settled(level.select("up", F.col("node").alias("via")).join(edges.select(F.col("up").alias("via"), "node"), "via").select("up", "node"), "level")
        if not level.limit(1).count():
            return found.groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        found = found.unionByName(level)
    raise ValueError(f"deeper than {deepest}")
