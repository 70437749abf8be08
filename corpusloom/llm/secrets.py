"""Secret scans with multipart credential linking.

Base findings stand on their own: assignments, access identifiers and hex runs. Weaker parts (account names, short
secrets, endpoints) mean little alone; they are reported only when a complementary part stands beside them within SCOPE
code points. Parts over each other don't count: a hex run inside an endpoint says nothing about it. That is an interval join: starts
and ends of parts are summed up as (document, cell of SCOPE code points, role) -> first and last, and each weak part meets
two cells to either side, so a document full of findings makes no pairs.

Positions come from the texts between the matches: the n-th match starts after n + 1 gaps and n matches. Running sums
over exploded gaps give them, so a document with very many matches costs no more than its length.

Defined cases: a null text counts as empty and has no findings; repeated rows each get the same findings; null ids are
kept; an empty table gives no rows; other columns are ignored by ``scan`` and left as they are by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, read

#: Code points within which complementary parts belong together.
SCOPE = 240
#: The patterns of each kind, letters in either case spelled out.
_KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
_ACCOUNTS = ("access_?key_?id", "client_?id", "account", "username", "user_?id", "login")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_SEPARATOR = "[\"']?\\x20*[:=]\\x20*[\"']?"
ASSIGN = f"({'|'.join(map(_either_case, _KEYWORDS))}){_SEPARATOR}([A-Za-z0-9+/_.=-]+)"
ACCOUNT = f"({'|'.join(map(_either_case, _ACCOUNTS))}){_SEPARATOR}([A-Za-z0-9+/_.@=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]{16,}"  # the runs of [0-9a-f]+ that are long enough
ENDPOINT = "https?://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+"
#: kind -> (pattern, rank in the output, role, group whose length counts, least length of a strong match, of a weak one)
KINDS = {
    "assign": (ASSIGN, 1, "secret", 2, 12, 6),
    "access": (ACCESS, 2, "identifier", 0, 18, None),
    "hex": (HEX, 3, "secret", 0, 16, None),
    "account": (ACCOUNT, 4, "identifier", 2, None, 3),
    "endpoint": (ENDPOINT, 5, "endpoint", 0, None, 8),
}
#: A weak secret that complementary parts confirm is told from a full assignment by its kind.
WEAK_NAMES = {"assign": "linked_secret", "account": "linked_account", "endpoint": "linked_endpoint"}
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
BASE = ("assign", "access", "hex")


def _found(text: Column, kind: str) -> Column:
    """array<struct(kind, gap, size, counted)> of all matches; gap: code points since the match before."""
    pattern, _, _, group, _, _ = KINDS[kind]
    entry = "struct<kind:string,gap:int,size:int,counted:int>"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    matches = F.transform(
        F.arrays_zip(whole.alias("w"), counted.alias("c"), F.slice(gaps, F.lit(1), F.size(whole)).alias("g")),
        lambda m: F.struct(F.lit(kind).alias("kind"), F.length(m["g"]).alias("gap"), F.length(m["w"]).alias("size"), F.length(m["c"]).alias("counted")),
    )
    return F.when(text.rlike(pattern), matches).otherwise(F.array().cast(f"array<{entry}>"))


def _key(row_id: Column, text: Column) -> Column:
    """Equal for repeated rows only."""
    return F.concat_ws(":", F.coalesce(row_id.cast("string"), F.lit("-")), F.hex(F.xxhash64(text)), F.length(text))


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows: id, key; spans: key, kind, rank, start, end, linked) where linked says that the method added it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scanned = docs.select(F.col(id_col).alias("id"), _key(F.col(id_col), text).alias("key"), F.concat(*[_found(text, k) for k in KINDS]).alias("found"))
    scanned = materialise(scanned, "secret-scan")

    each = scanned.filter(F.size("found") > 0).dropDuplicates(["key"]).select("key", F.posexplode("found").alias("pos", "m")).select("key", "pos", "m.*")
    order = Window.partitionBy("key", "kind").orderBy("pos")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    limits = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[4] if v[4] is not None else 1 << 30)])
    least = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[5] if v[5] is not None else 1 << 30)])
    roles = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[2])])
    parts = each.select("key", "kind", end.alias("end"), "size", "counted").select(
        "key", "kind", roles[F.col("kind")].alias("role"), (F.col("end") - F.col("size")).alias("start"), "end",
        (F.col("counted") >= limits[F.col("kind")]).alias("strong"), (F.col("counted") >= least[F.col("kind")]).alias("weak"),
    ).filter("strong or weak")
    parts = materialise(parts, "secret-parts")

    # a part beside a weak one, not over it, ends in the SCOPE before its start or starts in the SCOPE after its end: two cells each, of
    # which first and last decide as all parts would
    at = F.explode(F.array(*[F.struct(F.lit(edge).alias("edge"), F.col(edge).alias("point")) for edge in ("start", "end")]))
    cells = parts.select("key", "role", at.alias("at")).select("key", "role", "at.*").withColumn("cell", F.floor(F.col("point") / SCOPE))
    cells = cells.groupBy("key", "edge", "cell", "role").agg(F.min("point").alias("first"), F.max("point").alias("last"))
    weak = parts.filter("not strong").select("key", "kind", "role", "start", "end")
    wants = F.create_map(*[x for k, v in COMPLEMENTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asks = lambda edge, low: F.transform(F.array(F.lit(0), F.lit(1)), lambda k: F.struct(F.lit(edge).alias("edge"), (F.floor(low / SCOPE) + k).alias("cell"), low.alias("low"), (low + SCOPE).alias("high")))
    near = weak.withColumn("other", F.explode(wants[F.col("role")])).withColumn("ask", F.explode(F.concat(asks("end", F.col("start") - SCOPE), asks("start", F.col("end")))))
    near = near.select("key", "kind", "start", "end", "other", "ask.*")
    linked = near.join(cells.withColumnRenamed("role", "other"), ["key", "edge", "cell", "other"]).filter("last >= low and first <= high").select("key", "kind", "start", "end").distinct()

    names = F.create_map(*[F.lit(x) for kv in WEAK_NAMES.items() for x in kv])
    ranks = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[1])])
    base = parts.filter("strong").select("key", "kind", ranks[F.col("kind")].alias("rank"), "start", "end", F.lit(False).alias("linked"))
    added = linked.select("key", names[F.col("kind")].alias("kind"), (ranks[F.col("kind")] + 5).alias("rank"), "start", "end", F.lit(True).alias("linked"))
    return scanned.select("id", "key"), base.unionByName(added)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, key, spans (array of kind, start, end, linked by start, then kind as listed)."""
    rows, spans = findings(docs, id_col, text_col)
    entry = F.struct("start", "rank", "end", "kind", "linked")
    gathered = spans.groupBy("key").agg(F.sort_array(F.collect_list(entry)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,linked:boolean>>")
    return rows.join(gathered, "key", "left").select(F.col("id").alias(id_col), "key", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every finding replaced by [kind]; where findings overlap, the first one's kind stands for all."""
    _, spans = findings(docs, id_col, text_col)
    entry = F.struct("start", "rank", "end", "kind")
    gathered = spans.groupBy(F.col("key").alias("k")).agg(F.sort_array(F.collect_list(entry)).alias("found"))
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(text_col).alias("text"), _key(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    joined = each.join(gathered, F.col("key") == F.col("k"), "left")
    nothing = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def add(done: Column, span: Column) -> Column:
        gap = text.substr((done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        return F.when(span["start"] >= done["at"], F.struct(F.concat(done["out"], F.array(gap, F.concat(F.lit("["), span["kind"], F.lit("]")))).alias("out"), span["end"].alias("at"))).otherwise(
            F.struct(done["out"].alias("out"), F.greatest(done["at"], span["end"]).alias("at"))
        )

    done = F.aggregate("found", nothing, add, lambda d: F.concat(F.array_join(d["out"], ""), text.substr((d["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.col("found").isNull(), F.col("text")).otherwise(done)
    return joined.select(*[(clean if c == text_col else F.col(f"whole.`{c}`")).alias(c) for c in docs.columns])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def told(found: DataFrame) -> DataFrame:
    """The columns of op2_secret_scan, of what scan found."""
    base = F.filter("spans", lambda s: ~s["linked"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op2_secret_scan(spark, sf_dir):
    return told(scan(read(spark, sf_dir, "documents")))


def _oracle() -> str:
    """The same findings in SQL: matches with their gaps, running sums, and an existence test for the weak ones."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    each = " UNION ALL ".join(
        f"SELECT rid, '{kind}' AS kind, '{role}' AS role, {rank} AS rank, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'pos': i, 'gap': length(g[i]), 'size': length(w[i]), 'counted': length(c[i])}}), recursive := true)"
        f", {strong if strong is not None else 1 << 30} AS strong_from, {weak if weak is not None else 1 << 30} AS weak_from"
        f" FROM (SELECT rid, regexp_extract_all(text, {quote(p)}) AS w, regexp_extract_all(text, {quote(p)}, {group}) AS c, string_split_regex(text, {quote(p)}) AS g FROM docs)"
        for kind, (p, rank, role, group, strong, weak) in KINDS.items()
    )
    wants = " OR ".join(f"(a.role = '{r}' AND b.role IN ({', '.join(repr(x) for x in v)}))" for r, v in COMPLEMENTS.items())
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in WEAK_NAMES.items())
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
each AS ({each}),
parts AS (SELECT rid, kind, role, rank, e - size AS s, e, counted >= strong_from AS strong
  FROM (SELECT *, sum(gap + size) OVER (PARTITION BY rid, kind ORDER BY pos) AS e FROM each)
  WHERE counted >= least(strong_from, weak_from)),
linked AS (SELECT * FROM parts a WHERE NOT strong AND EXISTS (
  SELECT 1 FROM parts b WHERE b.rid = a.rid AND ({wants}) AND b.e >= a.s - {SCOPE} AND b.s <= a.e + {SCOPE} AND (b.e <= a.s OR b.s >= a.e))),
spans AS (SELECT rid, kind, rank, s, e, false AS linked FROM parts WHERE strong
  UNION ALL SELECT rid, CASE kind {names} END, rank + 5, s, e, true FROM linked),
told AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) FILTER (NOT linked) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (rid)
"""


OP2_SQL = _oracle()
