"""Runs of periodic words in each text, by Lyndon words under both orders.

A run is a stretch of words with smallest period q, of at least LEAST words and TIMES periods, that no neighbouring word extends.
A scan from right to left keeps a stack of Lyndon factors: the longest Lyndon word that starts at a word ends where the next lesser suffix
starts. Every run has a Lyndon word of its period's length among these under one of the two orders of words (the second one is the
first reversed; in both a suffix comes before those it begins), so each of them is extended to both sides and what is long
enough is a run.

Suffixes are compared, and stretches extended, by their longest common part: some words one by one, then a galloping and binary
search over rolling hashes modulo 2 ** 64. What hashes call equal is verified word by word; verified stretches are remembered by
their distance, so nothing is verified twice, and a collision only costs time. There is no suffix array.

Before the scan a text is cut to where runs can be: every GRAM words of a run stand in the text twice or more, as TIMES periods and
LEAST words leave room for it, so the scan goes over the stretches whose GRAM-word windows all occur again. They are found by hashes of
the text's own words (equal hashes of different words only make stretches longer) and hold whole runs, so no run changes.

Defined cases: null and empty texts have no words and no runs; texts of equal words are one run; a very long text is worked on whole in
one task, in memory of some 100 bytes a word; repeated rows get the same answer; null ids are carried; an empty table gives
no rows; other columns are ignored. Words are told apart by their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, read

#: A run has this many words, and this many periods, at least.
LEAST, TIMES = 6, 4
#: Words of a window that stands in a run's text again.
GRAM = 5
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
#: Words compared one by one before hashes are asked.
_DIRECT = 6


class Common:
    """Longest common parts of a list of numbers from two places on, to the right and to the left."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.x, self.n = codes, codes.tolist(), len(codes)
        value = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D)
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(self.n, _BASE, np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(value * power[:-1], dtype=np.uint64)]).tolist()
        self.power = power.tolist()
        #: distance -> (low, high): x[k] == x[k + distance] for all k of low .. high - 1 was seen.
        self.seen: dict[int, tuple[int, int]] = {}

    def _alike(self, i: int, j: int, length: int) -> bool:
        s = self.sums
        return ((s[i + length] - s[i]) * self.power[j - i] - s[j + length] + s[j]) & _MASK == 0

    def _verified(self, low: int, high: int, d: int, left: bool) -> int:
        """How many of the words low .. high - 1, from the right if ``left`` else from the left, equal those d further on."""
        a, b = self.seen.get(d, (0, 0))
        if a <= low and high <= b:
            return high - low
        parts = [(low, high)] if b < low or high < a else [(low, min(a, high)), (max(b, low), high)]
        for s, e in reversed(parts) if left else parts:
            if s < e:
                wrong = np.flatnonzero(self.codes[s:e] != self.codes[s + d : e + d])
                if len(wrong):
                    return high - (s + int(wrong[-1]) + 1) if left else s + int(wrong[0]) - low
        self.seen[d] = (low, high) if len(parts) == 1 else (min(a, low), max(b, high))
        return high - low

    def right(self, i: int, j: int) -> int:
        """i < j: the words from i on that equal those from j on."""
        x, most = self.x, self.n - j
        for k in range(min(_DIRECT, most)):
            if x[i + k] != x[j + k]:
                return k
        if most <= _DIRECT:
            return most
        a, b = self.seen.get(j - i, (0, 0))
        low = step = _DIRECT
        if a <= i + low < b:  # known that far
            low = b - i
            if low == most or x[i + low] != x[j + low]:
                self.seen[j - i] = (min(a, i), b)
                return low
        while low < most and self._alike(i + low, j + low, min(step, most - low)):
            low, step = low + min(step, most - low), 2 * step
        high = min(low + step, most)  # somewhere between low and high it ends
        while low < high:
            middle = (low + high + 1) // 2
            if self._alike(i + low, j + low, middle - low):
                low = middle
            else:
                high = middle - 1
        return self._verified(i, i + low, j - i, False)

    def left(self, i: int, j: int) -> int:
        """i < j: the words before i that equal those before j."""
        x = self.x
        for k in range(min(_DIRECT, i)):
            if x[i - 1 - k] != x[j - 1 - k]:
                return k
        if i <= _DIRECT:
            return i
        a, b = self.seen.get(j - i, (0, 0))
        low = step = _DIRECT
        if a < i - low <= b:
            low = i - a
            if low == i or x[i - low - 1] != x[j - low - 1]:
                self.seen[j - i] = (a, max(b, i))
                return low
        while low < i and self._alike(i - low - (s := min(step, i - low)), j - low - s, s):
            low, step = low + s, 2 * step
        high = min(low + step, i)
        while low < high:
            middle = (low + high + 1) // 2
            if self._alike(i - middle, j - middle, middle - low):
                low = middle
            else:
                high = middle - 1
        return self._verified(i - low, i, j - i, True)


def stretch_runs(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs of a list of numbers, in no order."""
    common = Common(codes)
    x, n = common.x, common.n
    found: set[tuple[int, int, int]] = set()
    for reverse in (False, True):
        after = [0] * (n + 1)  # where the next lesser suffix starts
        last: dict[int, tuple[int, int]] = {}  # of each period, the run found last
        for i in range(n - 1, -1, -1):
            j, own = i + 1, x[i]
            while j < n:
                if x[j] != own:
                    if (x[j] < own) != reverse:
                        break  # the suffix at j is lesser
                else:
                    k = common.right(i, j)
                    if j + k == n or (x[j + k] < x[i + k]) != reverse:
                        break
                j = after[j]
            after[i] = j
            q = j - i
            a, b = last.get(q, (n, n))
            if (a <= i and j <= b) or times * q > n or not ((j < n and x[j] == own) or (i and x[i - 1] == x[j - 1])):
                continue
            a, b = i - common.left(i, j), j + (common.right(i, j) if j < n else 0)
            if b - a >= 2 * q:
                last[q] = (a, b)
                if b - a >= max(least, times * q):
                    found.add((a, q, b - a))
    return list(found)


def _stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Where all windows of GRAM words stand in the text again."""
    n = len(words)
    if n < LEAST:
        return []
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    code = h[: n - GRAM + 1].copy()
    for k in range(1, GRAM):
        code = code * np.uint64(_BASE) + h[k : n - GRAM + 1 + k]
    code ^= code >> np.uint64(29)
    order = np.sort(code)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return []
    again = twice[np.minimum(np.searchsorted(twice, code), len(twice) - 1)] == code
    edge = np.flatnonzero(np.diff(np.concatenate([[False], again, [False]]).astype(np.int8)))
    return [(a, b + GRAM - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if b + GRAM - 1 - a >= LEAST]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text, by start, then period."""
    found = []
    for a, b in _stretches(words):
        place: dict[bytes, int] = {}
        codes = np.array([place.setdefault(w, len(place)) for w in words[a:b]], np.int64)
        found += [(a + s, length, q) for s, q, length in stretch_runs(codes)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period, the first among equals by start, then period."""
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what repeats: all but the first period of each run."""
    if not runs:
        return b" ".join(words)
    goes = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        goes[start + q] += 1
        goes[start + length] -= 1
    stay = np.cumsum(goes)[:-1] == 0
    return b" ".join([words[i] for i in np.flatnonzero(stay).tolist()])


def _words(_, text: bytes) -> list[bytes]:
    return text.split()  # at blanks, tabs, line breaks and 0x0B, 0x0C


def find_runs(docs: DataFrame, words: Callable[[object, bytes], list[bytes]] = _words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start, then period), best (the run of most periods; null
    without one), collapsed (the text's words, joined by blanks, without what repeats). words: how (id, text in UTF-8) become words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, runs, best, out = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = words(doc, text or b"")
                found = word_runs(own)
                n.append(len(own))
                runs.append([{"start": s, "length": length, "period": q} for s, length, q in found])
                top = longest(found)
                best.append(top and {"start": top[0], "length": top[1], "period": top[2]})
                out.append(collapsed(own, found))
            one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(one)), pa.array(best, one), pa.array(out, pa.binary())], ["id", "n_words", "runs", "best", "collapsed"])

    kind, one = docs.schema[id_col].dataType.simpleString(), "struct<start:bigint,length:bigint,period:bigint>"
    rows = batched(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(run, f"id {kind}, n_words bigint, runs array<{one}>, best {one}, collapsed binary")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "best", F.col("collapsed").cast("string").alias("collapsed"))


def planted(doc: object, text: bytes) -> list[bytes]:
    """The words of a document, which in one of ten documents repeat from some word on, as the query's contract says."""
    words = text.split()
    h = zlib.crc32(b"" if doc is None else str(doc).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark, sf_dir):
    found = find_runs(read(spark, sf_dir, "documents").select("doc_id", "text"), planted)
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    told = F.array_join(F.transform("runs", line), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: CRC-32 of the decimal id, bit by bit; then all pairs of equal words of a text at a distance that leaves room for a run, and stretches of
#: neighbouring ones. A stretch that a shorter period explains as well isn't a run of its smallest period.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"
OP11_SQL = f"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w, {_CRC} AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d), f AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e), p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM f),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p),
u AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM t),
m AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM m),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM g GROUP BY doc_id, q, island HAVING count(*) + q >= greatest({LEAST}, {TIMES} * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s k WHERE k.doc_id = s.doc_id AND k.q < s.q AND k.start <= s.start AND k.start + k.length >= s.start + s.length)),
o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS told,
  arg_min(struct_pack(start := start, length := length, q := q), (-CAST(length AS DOUBLE) / q, start, q)) AS best FROM r GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
c AS (SELECT u.doc_id, string_agg(u.w, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.i = u.i WHERE gone.i IS NULL GROUP BY u.doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.q AS period, best.length * 1000 // best.q AS exponent_milli,
sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)"""
