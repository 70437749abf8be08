"""Exact dedup by content sort.

Rows are ordered by the first CUT characters of the text, the text's hash and the id. Sampled splitters range-partition that
order, an external sort inside each range puts equal texts next to each other, and the window below compares each text with
its neighbour's in full. Because a splitter also holds an id, a text that a third of all rows share is cut into several
ranges; only a text that a splitter was drawn from twice can lie in more than one, so at most one partial group for each
splitter is merged afterwards. A splitter takes no more room for a long text than for a short one.

Defined cases: a null text counts as empty; null ids sort before all others and are kept only if a group has no other;
of repeated rows (same id and text) one is kept; a very long text is one row of the sort; an empty table gives no rows; other
columns are ignored, or carried along unread when ``carry`` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, read

#: Rows sampled for each range, and ranges for each task (several, as they are dealt by hash); the driver holds their
#: product with the number of tasks, of rows of CUT characters and some hashes.
SAMPLES_PER_RANGE = 8
RANGES_PER_PARTITION = 3
CUT = 64

#: (first characters, hash, id, digest) of a row; (first characters, hash, id or None) of a splitter.
Sampled = tuple[str, int, int | None, str]
Splitter = tuple[str, int, int | None]


def _order(r: tuple) -> tuple:
    return r[0], r[1], r[2] is not None, r[2] or 0


def splitters(sample: list[Sampled], ranges: int) -> tuple[list[Splitter], list[str]]:
    """Up to ranges - 1 ascending splitters, and the digests of the texts whose rows they cut by id."""
    rows = sorted(sample, key=_order)
    found: list[Splitter] = []
    hot: dict[str, None] = {}
    for k in range(1, ranges):
        i = k * len(rows) // ranges
        if not 0 < i < len(rows):
            continue
        same = rows[i - 1][:2] == rows[i][:2]
        cut = (rows[i][0], rows[i][1], rows[i][2] if same else None)
        if not found or _order(cut) > _order(found[-1]):
            found.append(cut)
        if same:
            hot[rows[i][3]] = hot[rows[i - 1][3]] = None
    return found, list(hot)


def _range_of(text: Column, row_id: Column, cuts: list[Splitter]) -> Column:
    """Number of splitters that are not above a row, by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(h).cast("long").alias("h"), F.lit(i).cast("long").alias("i")) for p, h, i in cuts])
    key = F.struct(F.substring(text, 1, CUT).alias("p"), F.xxhash64(text).alias("h"), row_id.cast("long").alias("i"))
    steps = [1 << b for b in reversed(range(len(cuts).bit_length()))]

    def step(low: Column, width: Column) -> Column:
        return F.when((low + width <= len(cuts)) & (F.get(table, low + width - 1) <= key), low + width).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", carry: bool = False) -> DataFrame:
    """One row per document: id, text_sha256, keep_id, group_size, kept. keep: "min" or "max" id of a group stays.
    carry adds ``row``, a struct of all input columns."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.col(text_col).isNull().alias("__null_text")).alias("row")] if carry else []))
    spread = partitions(spark, docs)
    ranges = RANGES_PER_PARTITION * spread
    total = rows.count()
    share = min(1.0, ranges * SAMPLES_PER_RANGE / max(total, 1))
    drawn = rows.select("text", "id").sample(False, share, 7).select(F.substring("text", 1, CUT).alias("p"), F.xxhash64("text").alias("h"), "id", F.sha2("text", 256).alias("d"))
    cuts, whole = splitters([(r.p, r.h, r.id, r.d) for r in drawn.collect()], ranges)

    digest = F.sha2("text", 256)
    hot = F.array_position(F.array(*map(F.lit, whole)), F.col("text_sha256")) if whole else F.lit(0).cast("long")
    parted = rows.withColumn("range", _range_of(F.col("text"), F.col("id"), cuts)).repartition(spread, "range")
    first = F.col("id").asc_nulls_last() if keep == "min" else F.col("id").desc_nulls_last()
    equal = Window.partitionBy("range", "text")
    runs = parted.withColumns({
        "place": F.row_number().over(equal.orderBy(first)),
        "n": F.count(F.lit(1)).over(equal),
        "top": (F.min("id") if keep == "min" else F.max("id")).over(equal),
    })
    kept_text = [F.col("text"), F.col("row")] if carry else []
    runs = runs.select("id", "range", "place", "n", "top", digest.alias("text_sha256"), *kept_text)
    runs = materialise(runs.withColumn("hot", hot), "content-sort")

    # at most one row for each range whose first or last text is a splitter's
    best = F.min("top") if keep == "min" else F.max("top")
    holder = (F.min_by if keep == "min" else F.max_by)("range", F.struct(F.col("top").isNull() if keep == "min" else F.col("top").isNotNull(), "top"))
    merged = runs.filter("hot > 0 and place = 1").groupBy("hot").agg(F.sum("n").alias("hot_n"), best.alias("hot_top"), holder.alias("hot_range"))
    out = runs.join(F.broadcast(merged), "hot", "left")
    kept = (F.col("place") == 1) & F.coalesce(F.col("hot_range") == F.col("range"), F.lit(True))
    top = F.when(F.col("hot_n").isNotNull(), F.col("hot_top")).otherwise(F.col("top"))
    return out.select(F.col("id").alias(id_col), top.alias("keep_id"), F.coalesce("hot_n", "n").alias("group_size"), kept.alias("kept"), "text_sha256", *(["text", "row"] if carry else []))


def drop_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """documents without exact copies, with the columns they had."""
    found = content_sort(docs, keep=keep, carry=True).filter("kept")
    text = F.when(F.col("row.__null_text"), F.lit(None)).otherwise(F.col("text"))
    return found.select(*[(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_exact_dedup(spark, sf_dir):
    return content_sort(read(spark, sf_dir, "documents"), keep="max")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
