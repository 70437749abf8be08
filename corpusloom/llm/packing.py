"""Packing into sequences by shortest-pack-first over the length histogram.

Each document is cut into full sequences and one rest. Only the counts of lengths go to the driver (CAPACITY numbers at
most): lengths are placed longest first, each into the pack that is shortest so far, for all packs of one pattern at
once, which updates the patterns' counts. A pattern's slots then become spans of ranks, and a join by length and rank
tells each piece its sequence and offset.

Defined cases: a null text counts as empty, which is the end id alone; repeated rows are packed each; null ids are
kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import batched, materialise, read

CAPACITY = 1024
#: Rows of one length are ranked in shares of at most about PER_SHARE, LEAST_SHARES or more, so that no task gets all of a
#: common length.
PER_SHARE, LEAST_SHARES = 50_000, 16


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces of a pack, number of such packs), shortest pack first, longest piece first."""
    open_packs: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            shortest = min((t for t in open_packs if t + length <= capacity), default=0)
            if not shortest:  # as few new packs as hold what is left
                each = capacity // length
                for many, n in ((each, left // each), (left % each, 1)):
                    if many and n:
                        packs = open_packs.setdefault(many * length, {})
                        packs[(length,) * many] = packs.get((length,) * many, 0) + n
                break
            packs = open_packs[shortest]
            pattern, there = packs.popitem()
            used = min(there, left)
            if there > used:
                packs[pattern] = there - used
            if not packs:
                del open_packs[shortest]
            grown = open_packs.setdefault(shortest + length, {})
            grown[*pattern, length] = grown.get((*pattern, length), 0) + used
            left -= used
    return [(p, n) for t in sorted(open_packs, reverse=True) for p, n in open_packs[t].items()]


def slots(found: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, sequence of the first rank, offset) of each slot of each pattern. A slot's pieces
    go to consecutive sequences; equal lengths of one pattern are slots of their own."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in found:
        at = 0
        for length in pattern:
            rank = taken.get(length, 0)
            rows.append((length, rank, rank + n, sequence, at))
            taken[length] = rank + n
            at += length
        sequence += n
    return rows


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens; a document's ids end with end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            rest = [np.zeros(0, "<u4")] * batch.num_rows
            done = [0] * batch.num_rows

            def cut(i: int, ids: np.ndarray, last: bool, rows=rows, rest=rest, done=done) -> None:
                ids = np.concatenate([rest[i], ids]) if len(rest[i]) else ids
                upto = len(ids) if last else len(ids) // capacity * capacity
                for a in range(0, upto, capacity):
                    part = ids[a : min(a + capacity, upto)]
                    rows.append((i, done[i], len(part), zlib.crc32(part.tobytes())))
                    done[i] += len(part)
                rest[i] = ids[upto:]

            for at, ids, ends in own.batches(batch.column(1).to_pylist()):
                ids, ends = ids.astype("<u4"), ends.tolist()
                for k, i in enumerate(at):
                    cut(i, ids[ends[k] : ends[k + 1]], False)
            for i in range(batch.num_rows):
                cut(i, np.array([end_id], "<u4"), True)
            table = np.array(rows, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(table[:, 0])), *[pa.array(table[:, k]) for k in (1, 2, 3)], pa.array(np.array(done, np.int64)[table[:, 0]])], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return batched(docs).select(id_col, text_col).mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint").withColumnRenamed("id", id_col)


def pack(cut: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = cut.sparkSession
    cut = materialise(cut, "pieces")
    # CAPACITY lengths at most, so CAPACITY rows here
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = spark.createDataFrame(slots(patterns(histogram, capacity)), "length bigint, first bigint, end bigint, sequence bigint, offset bigint")

    many = F.array(*[F.lit(max(LEAST_SHARES, -(-histogram.get(n, 1) // PER_SHARE))) for n in range(capacity + 1)])
    share = F.pmod(F.xxhash64(id_col, "start"), F.get(many, F.col("length").cast("int"))).cast("int")
    cut = cut.withColumn("__share", share)
    counts = cut.groupBy("length", "__share").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("__share").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "__share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    order = Window.partitionBy("length", "__share").orderBy(id_col, "start")
    # a row of counts for each PER_SHARE pieces and length: Spark broadcasts it if it is small
    ranked = cut.withColumn("__row", F.row_number().over(order) - 1).join(counts, ["length", "__share"]).withColumn("__rank", F.col("__row") + F.col("__before"))
    placed = ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & (ranked["__rank"] >= table["first"]) & (ranked["__rank"] < table["end"])).drop(table["length"])
    sequence = (F.col("sequence") + F.col("__rank") - F.col("first")).alias("sequence_id")
    return placed.select(*[c for c in cut.columns if c != "__share"], sequence, "offset")


def op4_packing(spark, sf_dir):
    return pack(pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 0))
