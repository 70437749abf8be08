"""An exact metric index: balls around some of the points, and searches that visit a ball only where it can still win.

Points: row (a number of their own), grp (only points of one group meet), v. Some points of each larger group are drawn as centres by
hash; every point's home is the cell of its nearest centre, and a cell's radius is how far its points lie from it. A search asks in the
own cell first. What it finds there, and the distances to the centres, which are points themselves, bound the answer; a second
round goes only to cells whose ball reaches below the bound. Cells lie together in regions, about PARTS of them whatever the number of
points, and a point that asks in some cells of a region goes there once: what is dealt out grows with the points even where each of
them has to ask everywhere, as in data without any structure. The comparisons are quadratic then. A cell that is larger than a
region is dealt to several, and regions hold MOST_BLOCK points at most, so memory is bounded and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import settled

#: Points of a cell, as far as MOST_CENTRES allows; centres are held by the driver and every worker.
CELL, MOST_CENTRES = 256, 4096
#: Points of a region, and of those who ask there, in a task: a share of all, between these.
PARTS, BLOCK, MOST_BLOCK = 8, 1024, 32768
#: Shares of a region whose cells are asked alone. Tasks that blocks of those who ask are dealt to, at least.
SHARES, TASKS = 16, 128
#: Rows and columns that are compared at once.
ROWS, COLUMNS = 256, 2048
#: Candidates that are held before they are cut to the nearest.
HELD = 1 << 19
#: Bounds are trusted up to this share of the numbers they come from.
SLACK = 1e-7


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def divided(v: Column, by: Column) -> Column:
    """A vector's components by a number. Inside a lambda the number would be worked out anew for each component."""
    return F.zip_with(v, F.array_repeat(by, F.size(v)), lambda x, n: x / n)


def far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x to rows of y, good to find the nearest ones by."""
    square = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows of x to the rows beside them in y, exactly."""
    return np.sqrt(np.einsum("...j,...j->...", x - y, x - y))


@dataclass
class Index:
    """points: row, grp, v, cell, home (distance to the cell's centre), region, parts (how many blocks of points ask). By group: centres,
    their rows, and of each cell the radius, the largest norm, the points, the first region and how many it is dealt to; by region its cells."""

    points: DataFrame
    centres: dict[str, np.ndarray]
    rows: dict[str, np.ndarray]
    radius: dict[str, np.ndarray]
    norm: dict[str, np.ndarray]
    count: dict[str, np.ndarray]
    region: dict[str, np.ndarray]
    dealt: dict[str, np.ndarray]
    cells: np.ndarray


def _by_group(keys: list[str], wanted: dict) -> Iterator[tuple[str, np.ndarray]]:
    names = np.array(keys, object)
    for g in set(keys) & wanted.keys():
        yield g, np.flatnonzero(names == g)


def index(points: DataFrame) -> Index:
    """points: row, grp (string), v (array<double>, one length in a group)."""
    points = settled(points.select("row", "grp", "v"), "points")
    total = points.count()
    cell = max(CELL, 2 * total // MOST_CENTRES)
    large = points.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    few = F.abs(F.xxhash64("row", F.lit(5))) / F.lit(float(1 << 63)) < 1 / cell
    drawn = points.filter(few).join(large.select("grp"), "grp", "left_semi").orderBy("row").limit(MOST_CENTRES)
    found: dict[str, list] = {}
    for r in drawn.collect():  # MOST_CENTRES rows at most
        found.setdefault(r.grp, []).append((r.row, r.v))
    centres = {g: np.array([v for _, v in x]) for g, x in found.items()}
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, BLOCK) for k in range(0, whole.num_rows, BLOCK)):
                cell, near, norm = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.inf), np.zeros(batch.num_rows)
                for g, own in _by_group(batch.column("grp").to_pylist(), shared.value):
                    x = matrix(batch.column("v").take(pa.array(own)))
                    best = far(x, shared.value[g]).argmin(1)
                    cell[own], near[own], norm[own] = best, apart(x, shared.value[g][best]), np.linalg.norm(x, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(near), pa.array(norm)], [*batch.schema.names, "cell", "home", "norm"])

    at = settled(points.mapInArrow(home, "row bigint, grp string, v array<double>, cell int, home double, norm double"), "cells")
    radius, norm = ({g: np.zeros(len(c)) for g, c in centres.items()} for _ in range(2))
    count = {g: np.zeros(len(c), np.int64) for g, c in centres.items()}
    for r in at.filter("home < double('infinity')").groupBy("grp", "cell").agg(F.max("home").alias("r"), F.max("norm").alias("n"), F.count(F.lit(1)).alias("c")).collect():  # a row for each cell
        radius[r.grp][r.cell], norm[r.grp][r.cell], count[r.grp][r.cell] = r.r, r.n, r.c
    block = max(BLOCK, min(MOST_BLOCK, -(-total // PARTS)))
    parts = max(1, -(-total // block))
    region, dealt, cells = _regions(centres, count, block)
    places = [(g, k, int(region[g][k]), int(dealt[g][k])) for g in centres for k in range(len(centres[g]))]
    places = F.broadcast(points.sparkSession.createDataFrame(places, "grp string, cell int, first int, dealt int"))
    own = F.coalesce(F.col("first") + F.pmod(F.xxhash64("row", F.lit(3)), F.col("dealt")), F.pmod(F.xxhash64("grp"), F.lit(parts))).cast("int")
    at = settled(at.join(places, ["grp", "cell"], "left").select("row", "grp", "v", "cell", "home", own.alias("region")), "regions")
    return Index(at.withColumn("parts", F.lit(parts)), centres, {g: np.array([k for k, _ in x]) for g, x in found.items()}, radius, norm, count, region, dealt, cells)


def _regions(centres: dict[str, np.ndarray], count: dict[str, np.ndarray], block: int) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], np.ndarray]:
    """The first region of each cell, how many regions it is dealt to, and the number of cells in each region. Cells that follow each other
    along the direction in which the centres differ most share a region, up to ``block`` points."""
    region, dealt, cells, held = {}, {}, [0], 0
    for g, c in centres.items():
        region[g], dealt[g] = np.zeros(len(c), np.int64), np.ones(len(c), np.int64)
        middle = c - c.mean(0)
        along = middle @ np.linalg.eigh(middle.T @ middle)[1][:, -1] if len(c) > 1 else np.zeros(1)
        for k in np.argsort(along, kind="stable").tolist():
            n = int(count[g][k])
            if held and held + n > block:
                cells, held = [*cells, 0], 0
            region[g][k], dealt[g][k] = len(cells) - 1, max(1, -(-n // block))
            cells[-1], held = cells[-1] + 1, held + n
            if dealt[g][k] > 1:
                cells, held = [*cells, *[1] * int(dealt[g][k] - 1), 0], 0
    return region, dealt, np.array(cells)


def asked(row: np.ndarray, cell: np.ndarray, region: np.ndarray, dealt: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, region, cells there (null: all)) of rows that ask in cells. cells: the number of cells of each region."""
    times = dealt[cell]
    row, cell = np.repeat(row, times), np.repeat(cell, times)
    to = region[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
    order = np.lexsort((to, row))
    row, cell, to = row[order], cell[order], to[order]
    start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (to[1:] != to[:-1])])) if len(row) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(row)))
    most = size * 2 > cells[to[start]]
    kept = cell[~np.repeat(most, size)]
    offsets = np.concatenate([[0], np.cumsum(np.where(most, 0, size))]).astype(np.int32)
    told = pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept.astype(np.int32)), mask=pa.array(most))
    return row[start], to[start], told


def meet(own: DataFrame, asking: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, even: bool = True) -> DataFrame:
    """run(points of a region, those who ask there) for blocks of those who ask; both have row, grp, region, parts and the same further columns.
    even: a block is much work, so there are more tasks than blocks of a table that few regions hold: two in a task would be waited for."""
    columns = [c for c in own.columns if c != "parts"]
    left = own.select(*columns, F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    right = asking.select(*columns, F.lit(True).alias("asks"), F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("j"))

    def task(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        return run(table.filter(pa.array(~asks)), table.filter(pa.array(asks)))

    both = left.unionByName(right)
    if even:
        both = both.repartition(max(TASKS, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "region", "j")
    return both.groupBy("region", "j").applyInArrow(task, schema)


class Meeting:
    """Points of a region and those who ask there. own: the table ordered by group and cell; blocks(): (who ask, from, to in own); self_at: where
    in own one who asks stands, or -1."""

    def __init__(self, own: pa.Table, asks: pa.Table):
        self.own, self.asks = own.sort_by([("grp", "ascending"), ("cell", "ascending"), ("row", "ascending")]), asks
        self.x, self.y = (matrix(t.column("v")) if len(pc.unique(pc.list_value_length(t.column("v")))) == 1 else None for t in (self.asks, self.own))
        self.ids, self.of = self.asks.column("row").to_numpy(), self.own.column("row").to_numpy()
        order = np.argsort(self.of, kind="stable")
        at = np.minimum(np.searchsorted(self.of[order], self.ids), max(0, len(order) - 1))
        self.self_at = np.where(self.of[order][at] == self.ids, order[at], -1) if len(order) else np.full(len(self.ids), -1)

    def values(self, who: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if self.x is not None and self.y is not None:
            return self.x[who], self.y[a:b]
        return matrix(self.asks.column("v").take(pa.array(who))), matrix(self.own.column("v").slice(a, b - a))  # groups of different lengths

    def blocks(self) -> Iterator[tuple[np.ndarray, int, int]]:
        grp, cell = self.own.column("grp").to_pylist(), self.own.column("cell").to_numpy()
        asking: dict[str, list[int]] = {}
        for k, g in enumerate(self.asks.column("grp").to_pylist()):
            asking.setdefault(g, []).append(k)
        edge = [0, *[k for k in range(1, len(grp)) if grp[k] != grp[k - 1]], len(grp)] if grp else []
        for s, e in zip(edge, edge[1:], strict=False):
            if grp[s] not in asking:
                continue
            who = np.array(asking[grp[s]])
            names, first = np.unique(cell[s:e], return_index=True)
            last = np.append(first[1:], e - s)
            lists = self.asks.column("cells").take(pa.array(who)).combine_chunks()
            wanted = np.zeros((len(who), len(names)), bool)
            wanted[lists.is_null().to_numpy(zero_copy_only=False)] = True
            which = np.repeat(np.arange(len(who)), lists.value_lengths().fill_null(0).to_numpy())
            asked_of = lists.flatten().to_numpy()
            place = np.minimum(np.searchsorted(names, asked_of), len(names) - 1)
            there = names[place] == asked_of
            wanted[which[there], place[there]] = True
            if (wanted @ (last - first)).sum() > 0.3 * len(who) * (e - s):
                pairs = [(who, s, e)]
            else:
                pairs = ((who[np.flatnonzero(wanted[:, c])], s + int(first[c]), s + int(last[c])) for c in range(len(names)))
            for some, low, high in pairs:
                for k in range(0, len(some), ROWS):
                    for a in range(low, high, COLUMNS):
                        yield some[k : k + ROWS], a, min(high, a + COLUMNS)

    def myself(self, who: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of a block where a point meets itself."""
        at = self.self_at[who]
        same = np.flatnonzero((at >= a) & (at < b))
        return same, at[same] - a


_BEST = "array<struct<d: double, other: bigint>>"
_PAIR = np.dtype([("d", "<f8"), ("other", "<i8")])
#: Bytes of packed lists that stand in one chunk.
CHUNK = 1 << 28


def _packed(told: np.ndarray, n: np.ndarray) -> pa.ChunkedArray:
    """Lists of n of these after another, each as bytes."""
    ends = np.concatenate([[0], np.cumsum(n)]) * told.itemsize
    chunks, a = [], 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + CHUNK, "right")) - 1)
        offsets = (ends[a : b + 1] - ends[a]).astype(np.int32)
        some = told[ends[a] // told.itemsize : ends[b] // told.itemsize].tobytes()
        chunks.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(some)]))
        a = b
    return pa.chunked_array(chunks, pa.binary())


def _nearest(who: np.ndarray, d: np.ndarray, other: np.ndarray, k: int) -> np.ndarray:
    """The places of the k nearest of each of ``who``, in its order, by distance, then row."""
    order = np.lexsort((other, d, who))
    sorted_ = who[order]
    start = np.searchsorted(sorted_, sorted_)
    return order[np.arange(len(order)) - start < k]


def sides(x: np.ndarray, y: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose products are the squared distances of x to y, without the norms of x."""
    return np.column_stack([x, np.ones(len(x))]).astype(kind), np.column_stack([-2 * y, np.einsum("ij,ij->i", y, y)]).astype(kind)


def _precision(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> tuple[type, float]:
    """The numbers to find candidates by, who are measured exactly then, and how far their squared distances can be off, as a share of both squared
    norms: single precision where that is little beside the squares of the bounds, ``most``."""
    norm = max(np.einsum("ij,ij->i", x, x).max(), np.einsum("ij,ij->i", y, y).max())
    off = 2 * (x.shape[1] + 8) * 2.0**-24  # twice what the roundings of the components, their products and the sum can make
    small = 1e-20 < norm < 1e30 and np.isfinite(most).all() and 2 * off * norm < 1e-3 * np.quantile(most, 0.1)
    return (np.float32, off) if small else (np.float64, 1e-11)


def neighbours(found: Index, k: int) -> DataFrame:
    """row, best: the k nearest other points of the group (d, other), by distance, then row; fewer where the group is smaller."""

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        met = Meeting(own, asking)
        most = asking.column("bound").to_numpy() ** 2
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]  # who, about their squared distance, place in own
        pending, slack = 0, np.zeros(len(most))
        whole = met.x is not None and met.y is not None and len(met.x) > 0 and len(met.y) > 0
        kind, unit = _precision(met.x, met.y, most) if whole else (np.float64, 1e-11)
        left, right = sides(met.x, met.y, kind) if whole else (None, None)

        def exact(who: np.ndarray, place: np.ndarray) -> np.ndarray:
            out = np.zeros(len(who))
            for a in range(0, len(who), 8 * COLUMNS):
                i, j = who[a : a + 8 * COLUMNS], place[a : a + 8 * COLUMNS]
                if met.x is not None and met.y is not None:
                    out[a : a + len(i)] = apart(met.x[i], met.y[j])
                else:  # groups of different lengths
                    x, y = (t.column("v").take(pa.array(k)).combine_chunks() for t, k in ((met.asks, i), (met.own, j)))
                    long = pc.list_value_length(x).to_numpy()
                    for n in np.unique(long):
                        some = np.flatnonzero(long == n)
                        out[a + some] = apart(matrix(x.take(pa.array(some))), matrix(y.take(pa.array(some))))
            return out

        def cut(last: bool) -> np.ndarray:
            who, about, place = (np.concatenate([h[n] for h in held]) for n in range(3))
            order = np.lexsort((about, who))
            who, about, place = who[order], about[order], place[order]
            n = np.bincount(who, minlength=len(most))
            first = np.cumsum(n) - n
            full = np.flatnonzero(n >= k)
            most[full] = np.minimum(most[full], about[first[full] + k - 1] + slack[full])
            near = about <= (most + slack)[who]
            n = np.bincount(who[near], minlength=len(most))
            who, about, place = who[near], about[near], place[near]
            tied = last | (n > 2 * k)[who]  # many at about one distance
            some = np.flatnonzero(tied)
            d = exact(who[some], place[some])
            best = _nearest(who[some], d, met.of[place[some]], k)
            chosen = np.concatenate([np.flatnonzero(~tied), some[best]])
            held[:] = [(who[chosen], about[chosen], place[chosen])]
            return d[best]

        for who, a, b in met.blocks():
            x, y = met.values(who, a, b)
            long, high = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
            x, y = (left[who], right[a:b]) if whole else sides(x, y, kind)
            close = x @ y.T  # squared distances, without the norms of x
            close[met.myself(who, a, b)] = np.inf
            slack[who] = np.maximum(slack[who], unit * (long + high.max()))
            under = close <= (most[who] + slack[who] - long).astype(kind)[:, None]
            if close.shape[1] > k and np.count_nonzero(under) > 4 * k * len(who):
                kth = np.partition(close, k - 1, 1)[:, k - 1] + long + slack[who]
                most[who] = np.minimum(most[who], kth)
                under = close <= (most[who] + slack[who] - long).astype(kind)[:, None]
            at = np.flatnonzero(under)  # much faster than to look for rows and columns at once
            i, j = np.divmod(at, under.shape[1])
            about = close.ravel()[at].astype(np.float64) + long[i]
            real = np.isfinite(about)
            held.append((who[i[real]], about[real], a + j[real]))
            pending += len(i)
            if pending > HELD:
                cut(False)
                pending = 0
        d = cut(True)
        who, _, place = held[0]
        told = np.empty(len(who), _PAIR)
        told["d"], told["other"] = d, met.of[place]
        n = np.bincount(who, minlength=len(met.ids))
        return pa.table([pa.array(met.ids, pa.int64()), _packed(told, n)], names=["row", "best"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("lists")
            each = lists.flatten()
            told = np.frombuffer(b"".join(each.to_pylist()), np.uint8).view(_PAIR)
            which = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            who = np.repeat(which, pc.binary_length(each).to_numpy() // _PAIR.itemsize)
            order = np.lexsort((told["other"], told["d"], who))
            who, d, other = who[order], told["d"][order], told["other"][order]
            new = np.concatenate([[True], (who[1:] != who[:-1]) | (other[1:] != other[:-1])])[: len(who)]  # one of the own cell may come from its region too
            who, d, other = who[new], d[new], other[new]
            start = np.searchsorted(who, who)
            near = np.arange(len(who)) - start < k
            who, d, other = who[near], d[near], other[near]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=batch.num_rows))]).astype(np.int32)
            best = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(d), pa.array(other)], ["d", "other"]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), best], ["row", "best"])

    merged = lambda df: df.groupBy("row").agg(F.collect_list("best").alias("lists")).mapInArrow(merge, f"row bigint, best {_BEST}")
    wide = lambda df, bound, cells, parts: df.select("row", "grp", "cell", "region", parts.alias("parts"), "v", bound.alias("bound"), cells.alias("cells"))
    none = F.lit(None).cast("array<int>")
    alone = wide(found.points, F.lit(float("inf")), F.array("cell"), F.lit(1))
    alone = alone.withColumn("region", F.col("region") * SHARES + F.pmod("cell", F.lit(SHARES)))  # cells don't meet here
    first = settled(meet(alone, alone, run, "row bigint, best binary"), "first")
    if not found.centres:
        return merged(first)
    shared = found.points.sparkSession.sparkContext.broadcast((found.centres, found.rows, found.radius, found.count, found.region, found.dealt, found.cells))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, rows, radius, count, region, dealt, cells = shared.value
        for whole in batches:
            for batch in (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS)):
                seen, home, ids = (batch.column(c).to_numpy() for c in ("bound", "cell", "row"))
                for g, own in _by_group(batch.column("grp").to_pylist(), centres):
                    to = far(matrix(batch.column("v").take(pa.array(own))), centres[g])
                    known = np.where(ids[own][:, None] == rows[g][None, :], np.inf, to)
                    most = np.minimum(seen[own], np.partition(known, k - 1, 1)[:, k - 1] if k <= known.shape[1] else np.inf)
                    if k > CELL // 16:  # balls that hold k others together
                        order = np.argsort(to + radius[g][None, :], 1)
                        enough = np.cumsum(count[g][order], 1) > k
                        at = np.take_along_axis(order, enough.argmax(1)[:, None], 1)[:, 0]
                        most = np.minimum(most, np.where(enough[:, -1], (to[np.arange(len(own)), at] + radius[g][at]) * (1 + SLACK), np.inf))
                    least = to - radius[g][None, :]
                    here = (np.arange(to.shape[1])[None, :] == home[own][:, None]) & (dealt[g] == 1)[None, :]
                    i, j = np.nonzero((least <= most[:, None] + SLACK * (1 + to)) & ~here & (count[g] > 0)[None, :])
                    who, at, lists = asked(i, j, region[g], dealt[g], cells)
                    took = pa.array(own[who])
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in ("row", "grp", "cell")), pa.array(at.astype(np.int32)), *(batch.column(c).take(took) for c in ("parts", "v")), pa.array((most * (1 + SLACK) + SLACK)[who]), lists], ["row", "grp", "cell", "region", "parts", "v", "bound", "cells"])


    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = [np.frombuffer(b[-_PAIR.itemsize :], _PAIR)["d"][0] if len(b) >= k * _PAIR.itemsize else np.inf for b in batch.column("best").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(last, pa.float64())], ["row", "bound"])

    bounds = first.mapInArrow(bound, "row bigint, bound double")
    asking = found.points.join(bounds, "row").select("row", "grp", "cell", "region", "parts", "v", "bound")
    asking = asking.mapInArrow(visits, "row bigint, grp string, cell int, region int, parts int, v array<double>, bound double, cells array<int>")
    own = wide(found.points, F.lit(0.0), none, F.col("parts"))
    return merged(first.unionByName(meet(own, asking, run, "row bigint, best binary")))


#: Parts of a range that distances are counted in; so many in one of them are measured.
BINS, FEW_LEFT = 64, 256
_RANGE = "row bigint, k bigint, lo double, hi double, top double, slack double, few boolean"


def ranked(found: Index, ranks: DataFrame) -> DataFrame:
    """row, d: the distance to the k-th nearest other point of the group, exactly. ranks: row, k. Distances are counted in BINS parts of a range of
    squares, which distances to the centres tell first, until few are left in the part that has the k-th; these are measured. So what is dealt out doesn't grow
    with k. A point of a larger rank than there are others has the farthest one's distance."""
    spark = found.points.sparkSession
    sizes = found.points.groupBy(F.col("grp").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    wanted = found.points.join(ranks, "row").join(sizes, F.col("grp") == F.col("g")).filter("n > 1").withColumn("k", F.least(F.col("k").cast("bigint"), F.col("n") - 1))
    shared = spark.sparkContext.broadcast((found.centres, found.radius, found.norm, found.count, found.region, found.dealt, found.cells))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for batch in (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS)):
                for g, own in _by_group(batch.column("grp").to_pylist(), shared.value[0]):
                    part = batch.take(pa.array(own))
                    x = matrix(part.column("v"))
                    yield g, part, x, far(x, shared.value[0][g])

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part, x, to in told(batches):
            _, radius, norm, count = (c[g] for c in shared.value[:4])
            k, n = part.column("k").to_numpy(), to.shape[1]
            share = k / count.sum()
            most = 4 * np.sqrt(share * (1 - share) / n) + 2 / n
            slack = np.maximum(1e-11 * (np.einsum("ij,ij->i", x, x) + norm.max() ** 2), 1e-18)
            top = (to + radius[None, :]).max(1) ** 2 * (1 + SLACK) + 8 * slack
            square = np.column_stack([-4 * slack, np.sort(to, 1) ** 2, top])
            line = np.arange(len(k))
            lo = square[line, np.clip(np.floor((share - most) * n), 0, n).astype(int)]
            hi = square[line, np.clip(np.ceil((share + most) * n) + 1, 1, n + 1).astype(int)]
            yield _ranges(part.column("row").to_numpy(), k, lo, np.maximum(hi, lo + 8 * slack), top, slack, np.zeros(len(k), bool))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, part, _, to in told(batches):
            _, radius, _, count, region, dealt, cells = (c[g] if n < 6 else c for n, c in enumerate(shared.value))
            most = np.sqrt(np.maximum(part.column("hi").to_numpy(), 0))[:, None]
            i, j = np.nonzero((to - radius[None, :] <= most + SLACK * (1 + to + most)) & (count > 0)[None, :])
            who, at, lists = asked(i, j, region, dealt, cells)
            took = pa.array(who)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(took) for c in ("row", "grp", "cell")), pa.array(at.astype(np.int32)), *(part.column(c).take(took) for c in ("parts", "v", "lo", "hi")), lists], ["row", "grp", "cell", "region", "parts", "v", "lo", "hi", "cells"])

    columns = ["row", "grp", "cell", "region", "parts", "v", "lo", "hi"]
    none = F.lit(None).cast("array<int>").alias("cells")

    def met(ranges: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        asking = found.points.join(ranges.select("row", "lo", "hi"), "row").select(*columns)
        lone = asking.filter(~F.col("grp").isin(*found.centres)) if found.centres else asking  # groups of one cell
        asking = asking.mapInArrow(visits, "row bigint, grp string, cell int, region int, parts int, v array<double>, lo double, hi double, cells array<int>")
        return meet(found.points.select(*columns[:6], F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), none), asking.unionByName(lone.select(*columns, none)), run, schema)

    def within(own: pa.Table, asking: pa.Table) -> tuple[Meeting, Iterator[tuple]]:
        each = Meeting(own, asking)
        lo, hi = (asking.column(c).to_numpy() for c in ("lo", "hi"))

        def blocks() -> Iterator[tuple]:
            for who, a, b in each.blocks():
                x, y = each.values(who, a, b)
                close = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", y, y)[None, :] - 2 * (x @ y.T)
                close[each.myself(who, a, b)] = np.inf
                at = np.flatnonzero((close >= lo[who, None]) & (close <= hi[who, None]) & (close < np.inf))
                i, j = np.divmod(at, close.shape[1])
                yield who, np.count_nonzero(close < lo[who, None], axis=1), i, j, close.ravel()[at], x, y

        return each, blocks()

    def counted(own: pa.Table, asking: pa.Table) -> pa.Table:
        each, blocks = within(own, asking)
        lo, hi = (asking.column(c).to_numpy() for c in ("lo", "hi"))
        n = np.zeros((asking.num_rows, BINS + 1), np.int32)
        for who, below, i, _, close, _, _ in blocks:
            n[who, 0] += below.astype(np.int32)
            part = np.minimum(((close - lo[who[i]]) * (BINS / (hi - lo))[who[i]]).astype(np.int64), BINS - 1)
            n[who, 1:] += np.bincount(i * BINS + part, minlength=len(who) * BINS).reshape(len(who), BINS).astype(np.int32)
        return pa.table([pa.array(each.ids, pa.int64()), pa.array([x.tobytes() for x in n], pa.binary())], names=["row", "n"])

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, lo, hi, top, slack = (batch.column(c).to_numpy() for c in ("k", "lo", "hi", "top", "slack"))
            n = np.array([np.frombuffer(b"".join(x), np.int32).reshape(-1, BINS + 1).sum(0, dtype=np.int64) for x in batch.column("lists").to_pylist()], np.int64).reshape(-1, BINS + 1)
            up = np.cumsum(n, 1)
            part = (up[:, 1:] < k[:, None]).sum(1)
            wide = (hi - lo) / BINS
            more = 2 * slack + 1e-12 * (hi - lo)  # what a distance found anew may differ by
            under, over = k <= up[:, 0], part == BINS
            low = np.where(under, -4 * slack, np.where(over, hi, lo + part * wide) - more)
            high = np.where(under, lo, np.where(over, top, lo + (part + 1) * wide)) + more
            left = n[np.arange(len(k)), np.minimum(part, BINS - 1) + 1]
            few = ~under & ~over & ((left <= FEW_LEFT) | (high - low <= 16 * slack + 1e-11 * (hi - lo)))
            yield _ranges(batch.column("row").to_numpy(), k, low, high, top, slack, few)

    def measured(own: pa.Table, asking: pa.Table) -> pa.Table:
        each, blocks = within(own, asking)
        below, held, pending = np.zeros(asking.num_rows, np.int64), [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], 0

        def alike() -> None:
            who, d, n = (np.concatenate([h[c] for h in held]) for c in range(3))
            order = np.lexsort((d, who))
            who, d, n = who[order], d[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (d[1:] != d[:-1])])) if len(who) else np.zeros(0, np.int64)
            held[:] = [(who[first], d[first], np.add.reduceat(n, first) if len(first) else n)]

        for who, under, i, j, _, x, y in blocks:
            below[who] += under
            for a in range(0, len(i), 8 * COLUMNS):
                some = slice(a, a + 8 * COLUMNS)
                held.append((who[i[some]], apart(x[i[some]], y[j[some]]), np.ones(len(i[some]), np.int64)))
            pending += len(i)
            if pending > HELD:
                alike()
                pending = 0
        alike()
        who, d, n = held[0]
        pairs = np.empty(len(who), _PAIR)
        pairs["d"], pairs["other"] = d, n
        return pa.table([pa.array(each.ids, pa.int64()), pa.array(below), _packed(pairs, np.bincount(who, minlength=len(each.ids)))], names=["row", "below", "d"])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for r, (k, below, lists) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("k", "below", "lists")), strict=True)):
                pairs = np.frombuffer(b"".join(lists), _PAIR)
                order = np.argsort(pairs["d"])
                out[r] = pairs["d"][order][np.searchsorted(np.cumsum(pairs["other"][order]), k - below)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out)], ["row", "d"])

    first = wanted.select("row", "grp", "v", "k").mapInArrow(start, _RANGE)
    inf = F.lit(float("inf"))
    alone = wanted.filter(~F.col("grp").isin(*found.centres)) if found.centres else wanted
    alone = alone.select("row", "k", F.lit(-1.0).alias("lo"), inf.alias("hi"), inf.alias("top"), F.lit(0.0).alias("slack"), F.lit(True).alias("few"))
    now, done = settled(first.unionByName(alone), "ranges"), []
    while True:
        done.append(now.filter("few"))
        now = now.filter("not few")
        if not now.limit(1).count():
            break
        lists = met(now, counted, "row bigint, n binary").groupBy("row").agg(F.collect_list("n").alias("lists"))
        now = settled(now.join(lists, "row").mapInArrow(narrowed, _RANGE), "ranges")
    ready = reduce(DataFrame.unionByName, done).select("row", "k", "lo", "hi")
    lists = met(ready, measured, "row bigint, below bigint, d binary").groupBy("row").agg(F.sum("below").alias("below"), F.collect_list("d").alias("lists"))
    return ready.select("row", "k").join(lists, "row").mapInArrow(chosen, "row bigint, d double")


def _ranges(row, k, lo, hi, top, slack, few) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*map(pa.array, (row, k, lo, hi, top, slack, few))], ["row", "k", "lo", "hi", "top", "slack", "few"])


def largest_products(found: Index) -> DataFrame:
    """row, product: the largest inner product with another point of the group; none for a point that is alone. A ball's products are
    bounded by those with its centre and by the distance, which is the sharper bound for vectors of one length."""

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        met, top = Meeting(own, asking), np.full(asking.num_rows, -np.inf)
        for who, a, b in met.blocks():
            x, y = met.values(who, a, b)
            close = x @ y.T
            close[met.myself(who, a, b)] = -np.inf
            top[who] = np.maximum(top[who], close.max(1))
        return pa.table([pa.array(met.ids, pa.int64()), pa.array(top)], names=["row", "product"])

    most = lambda df: df.groupBy("row").agg(F.max("product").alias("product"))
    wide = lambda df, cells, parts: df.select("row", "grp", "cell", "region", parts.alias("parts"), "v", cells.alias("cells"))
    alone = wide(found.points, F.array("cell"), F.lit(1))
    first = settled(most(meet(alone, alone, run, "row bigint, product double")), "first")
    told = first
    if found.centres:
        shared = found.points.sparkSession.sparkContext.broadcast((found.centres, found.rows, found.radius, found.norm, found.count, found.region, found.dealt, found.cells))

        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, rows, radius, norm, count, region, dealt, cells = shared.value
            for whole in batches:
                for batch in (whole.slice(a, ROWS) for a in range(0, whole.num_rows, ROWS)):
                    home, ids, seen = batch.column("cell").to_numpy(), batch.column("row").to_numpy(), batch.column("product").to_numpy()
                    for g, own in _by_group(batch.column("grp").to_pylist(), centres):
                        x = matrix(batch.column("v").take(pa.array(own)))
                        with_centre, long = x @ centres[g].T, np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                        known = np.where(ids[own][:, None] == rows[g][None, :], -np.inf, with_centre)
                        gap = np.maximum(far(x, centres[g]) - radius[g][None, :], 0)
                        bound = np.minimum(with_centre + long * radius[g][None, :], (long**2 + norm[g][None, :] ** 2 - gap**2) / 2)
                        scale = SLACK * (1 + long * (1 + norm[g][None, :]))
                        here = (np.arange(bound.shape[1])[None, :] == home[own][:, None]) & (dealt[g] == 1)[None, :]
                        i, j = np.nonzero((bound + scale >= np.maximum(seen[own], known.max(1))[:, None]) & ~here & (count[g] > 0)[None, :])
                        who, at, lists = asked(i, j, region[g], dealt[g], cells)
                        took = pa.array(own[who])
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(took) for c in ("row", "grp", "cell")), pa.array(at.astype(np.int32)), *(batch.column(c).take(took) for c in ("parts", "v")), lists], ["row", "grp", "cell", "region", "parts", "v", "cells"])

        asking = found.points.join(first, "row").select("row", "grp", "cell", "region", "parts", "v", "product")
        asking = asking.mapInArrow(visits, "row bigint, grp string, cell int, region int, parts int, v array<double>, cells array<int>")
        told = most(first.unionByName(meet(wide(found.points, F.lit(None).cast("array<int>"), F.col("parts")), asking, run, "row bigint, product double")))
    return told.filter("product > double('-infinity')")
