"""MinHash near-dedup with HyperMinHash registers.

A document's shingle hashes are sorted; the top bits name a register, and the least hash of a register is kept as its
count of leading zeros and MANTISSA bits more. Bands of 4 registers (one 64-bit number each) bring documents together.
Within a band, the share of equal registers, less the collisions to be expected, estimates the Jaccard similarity;
pairs well below the threshold are passed over (the margin is SURE standard deviations). What is left connects documents
into candidate groups, in which every pair that may link is compared on the full shingle sets.

Equal sets are one node from the start. Tasks return a spanning forest of what they find, so nothing grows with
the number of pairs; bands and candidate groups of more than BLOCK nodes are compared block by block in tasks of their own.

Defined cases: a text without words, or null, has the empty set and links with nothing; fewer words than a shingle
count as one; repeated rows share a node; null ids are kept and never are a component's id unless all its ids are
null; very long texts are hashed whole, and very long words by weights that never repeat; an empty table gives no rows; other
columns are ignored. Words and shingles are compared by 64-bit hashes, 128 bits for whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, materialise, partitions, read
from .components import Union, components, spanning, whole_groups

WORDS = 5
PERCENT = 80
REGISTER_BITS, MANTISSA = 7, 10
REGISTERS = 1 << REGISTER_BITS
PER_BAND = 4
BANDS = REGISTERS // PER_BAND
#: Chance that two different minima look alike: their counts of leading zeros are equal, and their mantissas.
COLLISION = 2.0**-MANTISSA / 3
SURE = 4.5
BLOCK = 1024
#: Bytes of text that are worked on at once.
SLICE = 1 << 22

_RNG = np.random.default_rng(17)
_ODD = lambda n: _RNG.integers(0, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEPARATES = np.zeros(256, bool)
_SEPARATES[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = _ODD(256)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BYTE[_SEPARATES] = 0
_PLACES = 4096
_PLACE = _ODD(_PLACES)
_WORD = _ODD(WORDS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word."""
    gap = _SEPARATES[raw]
    start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    if not len(start):
        return start, np.zeros(0, np.uint64)
    size = np.diff(np.append(start, len(raw)))
    place = np.arange(start[0], len(raw)) - np.repeat(start, size)
    weight = _PLACE[place & (_PLACES - 1)]
    if size.max() > _PLACES:  # no two places of a word weigh the same
        far = np.flatnonzero(place >= _PLACES)
        weight[far] = _mix(place[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    value = _BYTE[raw[start[0] :]] * weight
    value ^= value >> np.uint64(29)
    return start, _mix(np.add.reduceat(value, start - start[0]))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text) + 1
        if size >= SLICE:
            out += _shingle_sets(held)
            held, size = [], 0
    return out + (_shingle_sets(held) if held else [])


def _shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    ends = np.cumsum([len(t) + 1 for t in texts])
    start, word = _word_hashes(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
    bounds = np.concatenate([[0], np.searchsorted(start, ends)])
    n = max(0, len(word) - WORDS + 1)
    sums = np.zeros(n, np.uint64)
    for k in range(WORDS):
        sums += word[k : k + n] * _WORD[k]
    sums = _mix(sums)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            found = np.sort(sums[a : b - WORDS + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        else:  # all words as one shingle, told from longer ones by their number
            out.append(_mix((word[a:b] * _WORD[: b - a]).sum(keepdims=True) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, REGISTERS] of uint16; 0: no shingle fell there."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(flat):
        return out
    bits = 64 - REGISTER_BITS
    cell = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * REGISTERS + (flat >> np.uint64(bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))  # sorted, so the first one is the least
    least = flat[first] & np.uint64((1 << bits) - 1)
    length = np.frexp(least.astype(np.float64))[1].astype(np.int64)
    shift = np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = ((least >> shift) & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)
    out.reshape(-1)[cell[first]] = ((bits - length + 1) << MANTISSA | mantissa).astype(np.uint16)
    return out


def estimate(equal: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers and of those that either side uses."""
    return (equal / np.maximum(used, 1) - COLLISION) / (1 - COLLISION)


def _may_link(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs of register rows may reach the threshold."""
    t = percent / 100
    used = ((x | y) != 0).sum(1)
    equal = ((x == y) & (x != 0)).sum(1)
    return estimate(equal, used) >= t - SURE * np.sqrt(t * (1 - t) / np.maximum(used, 1)) - 1 / np.maximum(used, 1)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and digest, which tell a row from all but its repetitions."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))


def sketch(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest (of the text), n_shingles, node (digest of the set; null if empty), sketch (BANDS numbers of 4 registers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a in range(0, max(1, len(texts)), 512):
                sets = shingle_sets(texts[a : a + 512])
                bands = registers(sets).view(np.int64)
                nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, bands.reshape(-1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 512), batch.column(2).slice(a, 512), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), lists], ["id", "digest", "n_shingles", "node", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(batched(docs), id_col, text_col).mapInArrow(run, f"id {kind}, digest bigint, n_shingles bigint, node binary, sketch array<bigint>")


def _blocks(rows: DataFrame, group: str, members: str = "members") -> DataFrame:
    """A row for each pair of blocks that a row's block is in: i <= j, and own, the block it is in."""
    blocks = F.ceil(F.col(members) / BLOCK).cast("int")
    split = rows.withColumns({"blocks": blocks, "own": F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(0).cast("int")})
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return split.withColumns({"i": F.least("own", "other").cast("int"), "j": F.greatest("own", "other").cast("int")}).drop("blocks", "other", members)


def _band_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Edges between nodes of a band that may link; a pair counts in the first band that it shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["key", "i", "j"], 8192):
            nodes = table.column("node").to_pylist()
            bands = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            regs = np.ascontiguousarray(bands).view(np.uint16)
            band, own = table.column("band").to_numpy(), table.column("own").to_numpy()
            cross = table.column("i").to_numpy() != table.column("j").to_numpy()
            ends = np.append(at[1:], table.num_rows)
            end_of = np.repeat(ends, ends - at)
            a, b = [], []

            def check(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                keep = (~cross[x]) | (own[x] != own[y])
                x, y = x[keep], y[keep]
                shared = (bands[x] == bands[y]) & (bands[x] != 0)
                keep = shared.argmax(1) == band[x]
                x, y = x[keep], y[keep]
                keep = _may_link(regs[x], regs[y], percent)
                return x[keep], y[keep]

            small = end_of - np.repeat(at, ends - at) <= 16
            rows_of = np.flatnonzero(small)
            for d in range(1, 16):
                x = rows_of[rows_of + d < end_of[rows_of]]
                for k in range(0, len(x), 8192):
                    p, q = check(x[k : k + 8192], x[k : k + 8192] + d)
                    a += [nodes[i] for i in p.tolist()]
                    b += [nodes[i] for i in q.tolist()]
            for s, e in zip(at.tolist(), ends.tolist(), strict=True):
                if e - s <= 16:
                    continue
                left, right = [], []
                for i in range(s, e - 1):
                    p, q = check(np.full(e - i - 1, i), np.arange(i + 1, e))
                    left.append(p - s)
                    right.append(q - s)
                for n, r in spanning(e - s, np.concatenate(left), np.concatenate(right)):
                    a.append(nodes[s + n])
                    b.append(nodes[s + r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def links_within(sets: list[np.ndarray], side: np.ndarray, cross: bool, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (100 * intersection >= percent * union) between sets; cross: only those of different sides."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    if n <= 24:
        joined = Union(n)
        for x in range(n):
            for y in range(x + 1, n):
                small, large = min(size[x], size[y]), max(size[x], size[y])
                if (cross and side[x] == side[y]) or 100 * small < percent * large or joined.find(x) == joined.find(y):
                    continue
                shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * shared >= percent * (small + large - shared):
                    joined.join(x, y)
        return [(i, joined.find(i)) for i in range(n) if joined.find(i) != i]
    row = np.repeat(np.arange(n), size)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    keep = common[code]
    row, column = row[keep], number[code[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    shared = np.zeros((n, n), np.float32)
    width = 4096
    for a in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(column, [a, a + width])
        part = np.zeros((n, width), np.float32)
        part[row[lo:hi], column[lo:hi] - a] = 1
        shared += part @ part.T
    union = size[:, None] + size[None, :] - shared
    x, y = np.nonzero(np.triu(100 * shared.astype(np.float64) >= percent * union, 1))
    if cross:
        keep = side[x] != side[y]
        x, y = x[keep], y[keep]
    return spanning(n, x, y)


def _confirmed(rows: DataFrame, percent: int) -> DataFrame:
    """Edges between nodes of a candidate group whose full sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["grp", "i", "j"], 256):
            sets = shingle_sets([(t or "").encode() for t in table.column("text").to_pylist()])
            nodes = table.column("node").to_pylist()
            own, cross = table.column("own").to_numpy(), table.column("i").to_numpy() != table.column("j").to_numpy()
            a, b = [], []
            for s, e in zip(at.tolist(), [*at[1:].tolist(), table.num_rows], strict=True):
                for n, r in links_within(sets[s:e], own[s:e], bool(cross[s]), percent):
                    a.append(nodes[s + n])
                    b.append(nodes[s + r])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def near_components(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    out = _assigned(docs, percent, id_col, text_col)
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("head.id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one of the least id, then of the least digest of the text; a null id stays
    only if the component has no other. Rows without words all stay."""
    told = _assigned(docs, percent, id_col, text_col)
    head = F.col("node").isNull() | (F.col("id").eqNullSafe(F.col("head.id")) & F.col("digest").eqNullSafe(F.col("head.digest")))
    heads = materialise(told.filter(head).groupBy("id", "digest").agg(F.count("node").alias("n")).select(F.col("id").alias("h_id"), F.col("digest").alias("h_digest"), "n"), "heads")
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"))
    stay = each.join(heads, each["id"].eqNullSafe(heads["h_id"]) & each["digest"].eqNullSafe(heads["h_digest"]))
    if heads.filter("n > 1").limit(1).count():  # rows that repeat whole
        place = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.lit(0)))
        stay = stay.withColumn("place", place).filter("place = 1 or n = 0")
    return stay.select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def _assigned(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, digest, n_shingles, node (null without words), head (id and digest of the component's first row) of each row."""
    spark = docs.sparkSession
    spread = partitions(spark, docs)
    sketched = materialise(sketch(docs, id_col, text_col), "sketches")
    nodes = materialise(sketched.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest")).alias("rep"), F.first("sketch").alias("sketch")), "nodes")

    bands = nodes.select("node", F.posexplode("sketch").alias("band", "value")).filter("value != 0").select("node", "band", F.xxhash64("band", "value").alias("key"))
    met = bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = _blocks(bands.join(met, "key"), "key").join(nodes.select("node", "sketch"), "node")
    met = met.repartition(spread, "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "own", "band", "node", "sketch")
    candidates = components(_band_edges(met, percent))

    groups = materialise(candidates, "candidates")
    large = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    told = _blocks(groups.join(large, "root"), "root").join(nodes.select("node", "rep"), "node").select(F.col("root").alias("grp"), "i", "j", "own", "node", "rep")
    texts = _texts(docs, id_col, text_col)
    full = texts.join(told, (texts["digest"] == told["rep.digest"]) & texts["id"].eqNullSafe(told["rep.id"])).select("grp", "i", "j", "own", "node", "text")
    full = full.repartition(spread, "grp", "i", "j").dropDuplicates(["grp", "i", "j", "own", "node"]).sortWithinPartitions("grp", "i", "j")
    linked = components(_confirmed(full, percent))

    linked = materialise(linked, "links").join(nodes.select("node", "rep"), "node")
    least = linked.groupBy("root").agg(F.min("rep").alias("head"))
    of_node = linked.join(least, "root").select("node", "head").unionByName(nodes.select("node", F.col("rep").alias("head")).join(linked.select("node"), "node", "left_anti"))
    return sketched.select("id", "digest", "n_shingles", "node").join(of_node, "node", "left")


def op7_minhash_dedup(spark, sf_dir):
    return near_components(read(spark, sf_dir, "documents"), percent=85)


#: All pairs of different sets that share a shingle, and components by recursion.
OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM w),
d AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS rep FROM s),
g AS (SELECT doc_id, n, unnest(s) AS g FROM d WHERE doc_id = rep),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM d WHERE doc_id = rep UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, n AS n_shingles, root AS component_id, root = doc_id AS kept FROM d JOIN c ON node = rep
"""
