"""Line dedup by an exact set-similarity join.

Lines (split at line breaks) are sets of lower-case words (told apart by blanks, tabs and carriage returns). Lines of equal
sets are one class, led by its first line in the order of (id, line number). A class whose leader resembles an earlier
leader at PERCENT or more (Jaccard) is a later match. Kept is the first line of each class that is no later match; all other
lines that hold a word are removed.

The texts are split once: each line is written as its words' hashes of TOKEN_BITS bits, and later steps read these. The
join orders each set from rare to common words. Rarity comes from counts of hashed words over all lines (SKETCH counters, so
of a fixed size); ties are ordered by hash, and any total order is right. Two sets that share o words or more share one
among the first n - o + 1 words of each, so only the first n - ceil(t n) + 1 words go into the exchange: a row is a word's
hash, the leader's id and line number, the set's size, the word's place, and a parity of the whole set in 128 bits. The join
on the hash applies the length filter, the bound that the parities give, and the positional filter for the o that the two
sizes ask for. Before it, each class meets the first class of some of its words, so that most copies in a large group leave
after one comparison; the classes that are still open then meet all earlier ones. Both are joins whose large partitions
Spark can split, so a word that very many lines share is worked on by many tasks. Pairs whose hashes are similar are
compared word by word, with the lines read again from the texts. Words that share a hash can only bring more pairs
there; a class that left early for a pair that isn't one meets all earlier classes after all.

Defined cases: a null text counts as empty; lines without a word are never removed; null ids come first; of repeated rows
(same id and text) each line counts once, and all of them get the same answer; rows of one id with different texts are
told apart; a very long text is split into lines in one task, and a very long line is one row of its prefix words; an empty
table gives no rows; other columns are ignored. Sets are told apart by 128 bits of 64-bit hashes of their words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, read

PERCENT = 80
SKETCH = 1 << 17
#: Rows of 24 bytes that may be broadcast to pick lines out; more are joined by shuffles.
BROADCAST_ROWS = 1 << 20
#: Bits of a word's hash that are kept, 31 at most.
TOKEN_BITS = 31
#: Prefix words of a class by which it meets the first class of each.
FIRST_WORDS = 2
#: A line that holds a word.
HELD = "[^ \\t\\r]"

def _long(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _plain(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id, and the text's hash where an id repeats."""
    repeated = docs.groupBy(F.col(id_col)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    return [F.col(id_col).alias("k0"), *([F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k1")] if repeated else [])]


def _of(df: DataFrame) -> list[str]:
    """The key columns of a frame."""
    return [c for c in df.columns if c in ("k0", "k1", "kln")]


def _lines(rows: DataFrame) -> DataFrame:
    """Keys, kln (from 1), line."""
    return rows.select(*_of(rows), F.posexplode(F.split("text", "\n")).alias("at", "line")).select(*_of(rows), (F.col("at") + 1).alias("kln"), "line")


def _split(line: Column) -> Column:
    return F.array_remove(F.split(_plain(line), " "), "")


def _hashed(rows: DataFrame) -> DataFrame:
    """A row for each line: keys, kln, d1 and d2 (digest of the set), h (hashes of the words; one for each word), half: how
    many words from the start have a 64-bit hash below 0."""
    lines = _lines(rows.withColumn("text", _plain(F.col("text"))))  # line breaks end words, so a text's lower case is that of its lines
    key = _of(lines)
    words = F.array_remove(F.split("line", " "), "")
    named = lines.select(*key, F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("w"))
    short = F.transform("w", lambda h: h.bitwiseAND(_long((1 << TOKEN_BITS) - 1)).cast("int"))
    half = (F.array_position(F.sort_array(F.array_append("w", _long(0))), _long(0)) - 1).cast("int")  # where a 0 would stand
    return named.select(*key, F.xxhash64("w").alias("d1"), F.xxhash64("w", F.lit(7)).alias("d2"), short.alias("h"), half.alias("half"))


def _rarity(lines: DataFrame) -> Column:
    """Array of SKETCH ranks: the logarithm of the count of words with that hash, times 2^32."""
    counts = lines.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(SKETCH - 1).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    ranks = [0] * SKETCH
    for r in counts.select("slot", F.round(F.log2("n") * 64).cast("int").alias("rank")).collect():  # SKETCH rows at most
        ranks[r.slot] = r.rank << 32
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _classes(lines: DataFrame, rarity: Column, percent: int) -> DataFrame:
    """The first line of each class (keys, kln) with its set's size n, parities p1 and p2, and prefix (hashes in order)."""

    def token(h: Column) -> Column:
        return F.get(rarity, h.bitwiseAND(SKETCH - 1)).bitwiseOR(h)

    def parity(h: Column) -> Column:
        return F.aggregate(h, _long(0), lambda bits, x: bits.bitwiseXOR(F.call_function("shiftleft", _long(1), x.bitwiseAND(63))))

    key = _of(lines)
    named = lines.filter(F.size("h") > 0).select(*key, "d1", "d2", "h", "half", F.sort_array(F.transform("h", token)).alias("t"))
    length = (F.size("t") - F.ceil(F.size("t") * F.lit(percent) / 100) + 1).cast("int")
    prefix = F.transform(F.slice("t", F.lit(1), length), lambda t: t.bitwiseAND(_long((1 << TOKEN_BITS) - 1)).cast("int"))
    low, high = F.slice("h", F.lit(1), F.col("half")), F.slice("h", F.col("half") + 1, F.size("h"))
    first = F.struct(*key, F.size("h").alias("n"), parity(low).alias("p1"), parity(high).alias("p2"), prefix.alias("prefix"))
    return named.groupBy("d1", "d2").agg(F.min(first).alias("first")).select("first.*")


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "token" else f"{side}_{c}") for c in df.columns])


def _earlier(key: list[str]) -> Column:
    return F.struct(*[F.col(f"b_{k}") for k in key]) < F.struct(*[F.col(f"a_{k}") for k in key])


def _shared(percent: int, n: Column, m: Column) -> Column:
    """Words that sets of these sizes must share: the least o with o >= t (n + m - o)."""
    return F.ceil(F.lit(percent) * (n + m) / (100 + percent))


def _may(percent: int, n: Column, m: Column) -> Column:
    """The bound on what only one of the sets has, first without rounding, as most pairs fail it, and the length filter."""
    apart = F.bit_count(F.col("a_p1").bitwiseXOR(F.col("b_p1"))) + F.bit_count(F.col("a_p2").bitwiseXOR(F.col("b_p2")))
    most = (100 - percent) * (n + m)
    return ((100 + percent) * apart <= most) & (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= n + m - 2 * _shared(percent, n, m))


def _first_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Classes (a) with the first class (b) of each of FIRST_WORDS words of their prefix, those of least hash, if they may
    be similar."""
    key = _of(classes)
    some = classes.select(F.explode(F.slice(F.sort_array("prefix"), 1, FIRST_WORDS)).alias("token"), *key, "n", "p1", "p2")
    first = some.groupBy("token").agg(F.min(F.struct(*key, "n", "p1", "p2")).alias("f"), F.count(F.lit(1)).alias("members"))
    first = first.filter("members > 1").select("token", *[F.col(f"f.{c}").alias(c) for c in (*key, "n", "p1", "p2")])
    met = _side(some, "a").join(_side(first, "b"), "token").filter(_may(percent, F.col("a_n"), F.col("b_n")) & _earlier(key))
    return met.select(*[f"{s}_{k}" for s in "ab" for k in key]).distinct()


def _open_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Classes (a) that are open with all earlier ones (b) that share a word and pass the filters. Both sides come from one
    exchange, so what tells that a class is open is compared in the join only. at: open, size and place in one number."""
    key = _of(classes)
    each = classes.select(F.posexplode("prefix").alias("place", "token"), *key, "n", "p1", "p2", "open")
    at = F.shiftleft(F.col("open").cast("bigint"), 62).bitwiseOR(F.shiftleft(F.col("n").cast("bigint"), 31)).bitwiseOR(F.col("place").cast("bigint"))
    rows = each.select("token", at.alias("at"), *key, "p1", "p2")
    a, b = _side(rows, "a"), _side(rows, "b")
    part = lambda s, by, bits: F.shiftright(f"{s}_at", by).bitwiseAND(_long((1 << bits) - 1))
    n, m = part("a", 31, 31), part("b", 31, 31)
    placed = F.least(n - part("a", 0, 31), m - part("b", 0, 31)) >= _shared(percent, n, m)
    opened = part("a", 62, 1) + part("b", 62, 1) >= part("b", 62, 1) + 1
    return a.join(b, "token").filter(_may(percent, n, m) & placed & opened & _earlier(key)).select(*[f"{s}_{k}" for s in "ab" for k in key]).distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets (keys, w) are similar; of repeated elements each counts."""
    key = [c[2:] for c in pairs.columns if c.startswith("a_")]
    x, y = (sets.select(*[F.col(k).alias(f"{s}_{k}") for k in key], F.col("w").alias(f"{s}_w")) for s in "xy")
    on = lambda s, t: _same([f"{s}_{k}" for k in key], [f"{t}_{k}" for k in key])
    both = F.size("x_w") - F.size(F.array_except("x_w", "y_w"))
    told = pairs.join(x, on("a", "x")).join(y, on("b", "y")).withColumns({"n": F.size("x_w"), "m": F.size("y_w"), "o": both})
    return told.filter(100 * F.col("o") >= percent * (F.col("n") + F.col("m") - F.col("o"))).select(*pairs.columns)


def _picked(lines: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines that stand in a pair."""
    key = [c[2:] for c in pairs.columns if c.startswith("a_")]
    of = lambda s: pairs.select(*[F.col(f"{s}_{k}").alias(f"i_{k}") for k in key])
    ids = materialise(of("a").unionByName(of("b")).distinct(), "line-ids")
    return lines.join(_small(ids), _same(key, [f"i_{k}" for k in key]), "left_semi").dropDuplicates(key)


def _met(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar by the hashes of their words."""
    pairs = materialise(pairs, "line-pairs")
    return materialise(_similar(pairs, _picked(lines.select(*_of(lines), F.col("h").alias("w")), pairs), percent), "line-met")


def _later(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """g_...: the classes of the pairs that are similar by their words."""
    lines = _picked(_lines(rows), pairs)
    told = _similar(pairs, lines.select(*_of(lines), F.array_distinct(_split(F.col("line"))).alias("w")), percent)
    return materialise(_left(told).distinct(), "line-later")


def _left(pairs: DataFrame) -> DataFrame:
    return pairs.select(*[F.col(c).alias(f"g_{c[2:]}") for c in pairs.columns if c.startswith("a_")])


def _opened(classes: DataFrame, marked: DataFrame, opens: int) -> DataFrame:
    """classes with open: ``opens`` for those in marked, else its contrary."""
    key = _of(classes)
    told = classes.join(_small(marked.withColumn("mark", F.lit(opens))), _same(key, [f"g_{k}" for k in key]), "left")
    return told.select(*classes.columns, F.coalesce("mark", F.lit(1 - opens)).alias("open"))


def later_matches(classes: DataFrame, lines: DataFrame, rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Keys (g_...) of the classes whose first line resembles the first line of an earlier class."""
    early = _met(_first_pairs(classes, percent), lines, percent)
    left = materialise(_left(early).distinct(), "line-left")
    pairs = early.unionByName(_met(_open_pairs(_opened(classes, left, 0), percent), lines, percent))
    later = _later(pairs, rows, percent)
    lost = left.exceptAll(later)
    if not lost.limit(1).count():
        return later
    again = _met(_open_pairs(_opened(classes, materialise(lost, "line-lost"), 1), percent), lines, percent)
    return later.unionByName(_later(again, rows, percent)).distinct()


def _kept(rows: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """s_k..., kept: the numbers of the lines that stay because they are first of their kind."""
    classes = materialise(_classes(lines, _rarity(lines), percent), "line-classes")
    key = _of(classes)
    gone = later_matches(classes, lines, rows, percent)
    stay = classes.select(*key).join(_small(gone), _same(key, [f"g_{k}" for k in key]), "left_anti")
    return stay.groupBy(*[F.col(k).alias(f"s_{k}") for k in key if k != "kln"]).agg(F.collect_list("kln").alias("kept"))


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_lines, removed (numbers of the lines that go, ascending)."""
    rows = docs.select(*_keys(docs, id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = materialise(_hashed(rows), "line-words", random=True)
    kept = _kept(rows, lines, percent)
    key = _of(rows)
    held = F.collect_set(F.when(F.size("h") > 0, F.col("kln")))  # a set: the lines of repeated rows come as often
    each = lines.groupBy(*key).agg(F.max("kln").alias("n_lines"), held.alias("held"))
    told = each.join(kept, _same(key, [f"s_{k}" for k in key]), "left")
    told = told.select(*key, "n_lines", F.sort_array(F.array_except("held", F.coalesce("kept", F.array().cast("array<int>")))).alias("removed"))
    told = told.select(*[F.col(k).alias(f"t_{k}") for k in key], "n_lines", "removed")
    if len(key) > 1:  # ids repeat, and so may whole rows
        told = rows.select(*key).join(told, _same(key, [f"t_{k}" for k in key]))
    return told.select(F.col("t_k0").alias("id"), "n_lines", "removed")


def drop_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """documents with the removed lines cut out of their texts; a null text stays null."""
    keys = _keys(docs, "doc_id", "text")
    rows = docs.select(*keys, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kept = _kept(rows, materialise(_hashed(rows), "line-words", random=True), percent)
    each = docs.select(*keys, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"))
    key = _of(each)
    told = each.join(kept, _same(key, [f"s_{k}" for k in key]), "left")
    stay = F.filter(F.split("whole.text", "\n"), lambda line, i: ~line.rlike(HELD) | F.coalesce(F.array_contains("kept", i + 1), F.lit(False)))
    return told.select(*[(F.array_join(stay, "\n") if c == "text" else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


def op9_line_dedup(spark, sf_dir):
    found = removed_lines(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed_lines"))


#: The same join with exact counts of words over classes, prefix and length filter only, and whole sets compared.
OP9_SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS ln, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
w AS (SELECT doc_id, ln, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '[ \\t\\r]+'), lambda x: x <> ''))) AS w FROM l),
c AS (SELECT row_number() OVER (ORDER BY first_.doc_id, first_.ln) AS cid, first_, w, len(w) AS n FROM (SELECT w, min(struct_pack(doc_id := doc_id, ln := ln)) AS first_ FROM w WHERE len(w) > 0 GROUP BY w)),
t AS (SELECT cid, n, unnest(w) AS t FROM c), f AS (SELECT t, count(*) AS f FROM t GROUP BY t),
p AS (SELECT cid, n, t, row_number() OVER (PARTITION BY cid ORDER BY f, t) AS place FROM t JOIN f USING (t)),
q AS (SELECT * FROM p WHERE place <= n - ceil(n * {PERCENT} / 100) + 1),
x AS (SELECT DISTINCT a.cid AS a, b.cid AS b FROM q a JOIN q b ON a.t = b.t AND b.cid < a.cid AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)),
o AS (SELECT a, a.n AS n, b.n AS m, len(list_intersect(a.w, b.w)) AS o FROM x JOIN c a ON a.cid = x.a JOIN c b ON b.cid = x.b),
k AS (SELECT first_.doc_id AS doc_id, first_.ln AS ln FROM c WHERE cid NOT IN (SELECT a FROM o WHERE 100 * o >= {PERCENT} * (n + m - o))),
r AS (SELECT w.doc_id, w.ln, len(w.w) > 0 AND k.ln IS NULL AS goes FROM w LEFT JOIN k ON k.doc_id = w.doc_id AND k.ln = w.ln)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed, coalesce(string_agg(CAST(ln AS VARCHAR), ',' ORDER BY ln) FILTER (goes), '') AS removed_lines FROM r GROUP BY doc_id
"""
