"""Queries that run operators over records: families, skips, samples, records of a model, editions, and a runner."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import copydigits, parse, redact
from corpusloom.operators import dedup, extraction, quality, sampling
from corpusloom.sources.tables import Store, shared_folder
from corpusloom.streaming import runner

from . import harness
from .harness import _DUCK, _KIND


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def entropy(spark, sf_dir):
    """Entropy and shape of every value that is assigned to a name of a secret."""
    values = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_VALUE), F.lit(2))
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(values)).alias("v")).filter("v != ''")
    return rows.select("doc_id", "v", F.round(redact.entropy(F.col("v")), 9).alias("entropy"), redact.credential_like(F.col("v")).alias("secret"))


_VALUE = "(password|passwd|secret|token|api_?key)[\"']? ?[:=] ?[\"']?([A-Za-z0-9+/_.=-]+)"
_Q = "'" + _VALUE.replace("'", "''") + "'"
ENTROPY_SQL = f"""WITH v AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {_Q}, 2)) AS v FROM documents),
c AS (SELECT doc_id, v, unnest(string_split(v, '')) AS ch FROM v), k AS (SELECT doc_id, v, ch, count(*) AS n FROM c GROUP BY ALL),
e AS (SELECT doc_id, v, -sum(n / CAST(length(v) AS DOUBLE) * log2(n / CAST(length(v) AS DOUBLE))) AS e FROM k GROUP BY doc_id, v)
SELECT doc_id, v, round(e, 9) + 0.0 AS entropy, length(v) >= 10 AND NOT regexp_matches(v, '(?i)process\\.env|os\\.environ|getenv') AND NOT regexp_full_match(v, '[A-Za-z_][A-Za-z_.]*')
  AND CAST(regexp_matches(v, '[a-z]') AS INT) + CAST(regexp_matches(v, '[A-Z]') AS INT) + CAST(regexp_matches(v, '[0-9]') AS INT) + CAST(regexp_matches(v, '[^A-Za-z0-9]') AS INT) >= 2 AND e >= 3.0 AS secret FROM e"""


def headings(spark, sf_dir):
    """The headings of the made-up files, with their lines."""
    parsed = harness.artifacts(spark, sf_dir).filter(F.col("kind").isin("claude_md", "agent", "skill"))
    found = parsed.select("doc_id", F.explode(F.from_json(F.get_json_object("parsed_json", "$.headings"), "array<struct<level:int,text:string,line:int>>")).alias("h"))
    return found.select("doc_id", "h.level", "h.text", "h.line")


HEADINGS_SQL = f"""WITH f AS ({_DUCK}), l AS (SELECT doc_id, k, q, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM f WHERE k IN (0, 3, 5))
SELECT doc_id, length(regexp_extract(x, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 1)) AS level, regexp_extract(x, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$', 2) AS text, line FROM l
WHERE regexp_matches(x, '^(#{{1,6}})\\s+(.+?)\\s*#*\\s*$') AND x <> '# not a heading'"""


def skip_reasons(spark, sf_dir):
    """Why made-up files have no text: each by its kind, its size (times ten), a mark of binary content, and labels as fetches."""
    rows = harness.files(spark, sf_dir)
    there = _read(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("there").isNull(), "missing")
    told = parse.skip_reason(F.col("kind"), F.col("text").contains("|"), F.octet_length("text") * 10, status)
    return rows.join(there, "doc_id", "left").select("doc_id", parse.component(F.col("path"), F.lit("seed")).alias("component"), told.alias("skip_reason"))


SKIP_SQL = f"""WITH f AS ({_DUCK}) SELECT doc_id, CASE WHEN k = 9 THEN 'seed' WHEN k = 6 THEN 'skill_file' ELSE {_KIND} END AS component,
  CASE WHEN k IN (6, 9) THEN 'not_fetched_kind' WHEN contains(text, '|') THEN 'binary' WHEN strlen(text) * 10 > 200000 THEN 'too_large'
  WHEN NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id) THEN 'missing' END AS skip_reason FROM f"""


def family_keys(spark, sf_dir):
    parsed = harness.artifacts(spark, sf_dir)
    return parsed.select("doc_id", parse.family_key(F.col("kind"), F.get_json_object("parsed_json", "$.frontmatter.name"), F.col("path")).alias("family_key"))


FAMILY_SQL = f"""WITH f AS ({_DUCK}) SELECT doc_id, CASE k WHEN 0 THEN CASE WHEN q % 2 = 0 THEN 'pkg' || doc_id || '/CLAUDE' ELSE 'CLAUDE' END WHEN 1 THEN '.claude/settings' WHEN 2 THEN '.mcp'
  WHEN 3 THEN 'agent' || doc_id WHEN 4 THEN 'commands/c' || doc_id WHEN 5 THEN CASE WHEN q % 4 = 0 THEN 's' || doc_id % 287 || '/SKILL' ELSE 's' END WHEN 7 THEN 'hooks/h' || doc_id WHEN 8 THEN '.claude-plugin/plugin' END AS family_key
FROM f WHERE k NOT IN (6, 9)"""


def normalized_clusters(spark, sf_dir):
    """Documents that name their repo and owner, alike once the names are placeholders."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("owner"), F.pmod("doc_id", F.lit(3)).cast("string"), F.lit("/"), "source").alias("repo"), F.coalesce("text", F.lit("")).alias("text")).filter("source is not null")
    named = F.concat("text", F.lit("\n Made by "), F.substring_index("repo", "/", 1), F.lit(" for "), F.upper(F.substring_index("repo", "/", -1)), F.lit("."))
    digest = F.sha2(dedup.normalized(named, F.col("repo")), 256)
    return docs.select("doc_id", digest.alias("norm_sha")).groupBy("norm_sha").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("canonical"))


NORM_SQL = """WITH n AS (SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g') || CASE WHEN regexp_matches(coalesce(text, ''), '\\s$') THEN '' ELSE ' ' END || 'made by {owner} for {repo}.')) AS norm_sha FROM documents WHERE source IS NOT NULL)
SELECT norm_sha, count(*) AS size, min(doc_id) AS canonical FROM n GROUP BY norm_sha"""


def lattice_totals(spark, sf_dir):
    from .operators import size_bisection_lattice

    found = sampling.totals(size_bisection_lattice(spark, sf_dir), 500.0)
    return found.withColumn("projected_nodes", F.round("projected_nodes", 6))


def _lattice_sql() -> str:
    from .operators import LATTICE_SQL

    return f"""WITH x AS ({LATTICE_SQL}) SELECT count(*) AS nodes, CAST(sum(total) FILTER (kind = 'leaf') AS BIGINT) AS leaf_sum, count(*) FILTER (kind <> 'leaf') AS overflows,
CAST(sum(CASE WHEN kind = 'leaf' THEN ceil(total / 100) ELSE 10 END) AS BIGINT) AS fetch_requests, round(count(*) * (1 + 500.0 / sum(total) FILTER (kind = 'leaf')), 6) AS projected_nodes FROM x"""


def approved_labels(spark, sf_dir):
    """Nations with their own approved label, else with the wildcard's."""
    nations = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("id"))
    labels = nations.select("id", F.concat(F.lit("Label of "), F.lower("id")).alias("label"), F.when(F.col("id") < "J", "approved").otherwise("draft").alias("status"))
    wild = spark.createDataFrame([("*", "Any place", "approved"), ("*", "Draft 1", "draft")], "id string, label string, status string")
    return quality.approved(nations, labels.unionByName(wild))


LABELS_SQL = "SELECT n_name AS id, CASE WHEN n_name < 'J' THEN 'Label of ' || lower(n_name) ELSE 'Any place' END AS label, 'approved' AS status FROM nation"


def text_representatives(spark, sf_dir):
    """The canonical artifact of each group of equal made-up files that hold text, as it would be sent."""
    rows = harness.files(spark, sf_dir).filter("kind is not null")
    clusters = rows.groupBy("kind", F.sha2("text", 256).alias("cluster_id")).agg(F.min("artifact_id").alias("canonical_artifact"))
    return extraction.representatives(clusters, rows).select("cluster_id", "artifact_id", F.length("source").alias("chars"))


REPRESENTATIVES_SQL = f"""WITH f AS ({_DUCK}) SELECT sha256(text) AS cluster_id, min('a-' || doc_id) AS artifact_id, least(6000, any_value(length(text))) AS chars FROM f WHERE k IN (0, 3, 4, 5) GROUP BY k, sha256(text)"""


#: Answers by doc_id % 9: (JSON with {id} for the id and {quote} for words of the source, reason).
ANSWERS = (
    ('{"id": "{id}", "use_case": "u", "domain_guess": "d", "non_coding": false, "techniques_described": [{"name": "n", "evidence_quote": "{quote}"}]}', None),
    ('{"id": "{id}", "use_case": 5, "domain_guess": 7, "non_coding": false, "notable": 3, "techniques_described": []}', "bad_use_case"),
    ('{"id": "{id}", "use_case": "u", "domain_guess": 7, "non_coding": "no", "techniques_described": []}', "bad_domain_guess"),
    ('{"id": "{id}", "use_case": "u", "domain_guess": "d", "non_coding": "no", "techniques_described": []}', "bad_non_coding"),
    ('{"id": "{id}", "use_case": "u", "domain_guess": "d", "non_coding": true, "notable": 3, "techniques_described": []}', "bad_notable"),
    ('{"id": "{id}", "use_case": "u", "domain_guess": "d", "non_coding": true, "notable": "x", "techniques_described": [{"name": "n", "evidence_quote": "{quote}"}, 5]}', "bad_techniques"),
    ('{"id": "{id}", "use_case": "u", "domain_guess": "d", "non_coding": true, "techniques_described": [{"name": "n", "evidence_quote": " "}]}', "bad_quote_length"),
    ('{"id": "{id}", "use_case": "u", "domain_guess": "d", "non_coding": true, "techniques_described": [{"name": "n", "evidence_quote": "zq zq never said"}]}', "quote_not_verbatim"),
    ('{"id": "x{id}"}', "missing"),
)


def extraction_planted(spark, sf_dir):
    """Records with every fault, scored against the documents they are said to be from."""
    docs = _read(spark, sf_dir, "documents").filter("text is not null")
    sources = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("Some\n  words of\tit: "), "text").alias("source"))
    shape = F.element_at(F.array(*[F.lit(a) for a, _ in ANSWERS]), (F.pmod("doc_id", F.lit(len(ANSWERS))) + 1).cast("int"))
    said = F.replace(F.replace(shape, F.lit("{id}"), F.col("doc_id").cast("string")), F.lit("{quote}"), F.lit("Some words of it"))
    found = extraction.score(sources, docs.select(F.col("doc_id").alias("n"), said.alias("json")))
    return found.select(F.col("id").cast("bigint").alias("doc_id"), "reason")


EXTRACTION_SQL = f"SELECT doc_id, ([{', '.join('NULL' if r is None else repr(r) for _, r in ANSWERS)}])[1 + doc_id % {len(ANSWERS)}] AS reason FROM documents WHERE text IS NOT NULL"


def extraction_score(spark, sf_dir):
    """How the stand-in model's answers for all documents are judged."""
    sources = _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("source"))
    return extraction.score(sources, extraction.fake_answers(sources)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


SCORE_SQL = "SELECT CASE WHEN trim(coalesce(text, ''), ' ' || chr(10)) = '' THEN 'bad_use_case' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1"


def content_hashes(spark, sf_dir):
    """The content hash of small tables, whatever the order of their rows."""
    rows = [(t, quality.content_hash(_read(spark, sf_dir, t).orderBy(F.rand(3)))) for t in ("nation", "region")]
    return spark.createDataFrame(rows, "table_name string, content_hash string")


def _hash_sql() -> str:
    def of(table: str, row: str) -> str:
        sums = ", ".join(f"CAST(sum(CAST(('0x' || substr(h, {1 + 15 * k}, 15)) AS BIGINT)::DECIMAL(38,0)) AS VARCHAR)" for k in range(4))
        return f"SELECT '{table}' AS table_name, sha256(concat_ws(',', CAST(count(*) AS VARCHAR), {sums})) AS content_hash FROM (SELECT sha256({row}) AS h FROM {table})"

    nation = """'{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}'"""
    region = """'{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}'"""
    return of("nation", nation) + " UNION ALL " + of("region", region)


def runner_resume(spark, sf_dir):
    """A stage over the nations that fails for some at first, is killed after a part was written, and is resumed."""
    import uuid

    store = Store(spark, f"{shared_folder(spark)}/runner-{uuid.uuid4().hex}")
    now = [0.0]
    stage = runner.Runner(store, "demo", ["clusters"], lambda: now[0])
    nations = _read(spark, sf_dir, "nation").select(F.col("n_name").alias("unit"), F.col("n_nationkey").cast("bigint").alias("place"))
    sizes = nations.select(F.col("unit").alias("cluster_id"), F.col("place").alias("size"))
    once = {"BRAZIL", "CHINA"}

    def work(batch):
        failed = {u: "busy" for u in batch if u in once}
        return {"clusters": sizes.filter(F.col("cluster_id").isin(*(set(batch) - failed.keys())))}, failed

    stage.run(nations, work, 7, limit=20)
    store.write_part("clusters", "p-orphan", sizes.limit(3))  # what a killed run leaves
    once.clear()
    now[0] = 5000.0
    stage.run(nations.unionByName(nations), work, 7)
    stage.close()
    return store.read("clusters").select("cluster_id", "size")


def freeze_gate(spark, sf_dir):
    """What stands against freezing the tables, by rule."""
    tables = {t: _read(spark, sf_dir, t) for t in ("nation", "orders", "lineitem", "events", "labels", "documents")}
    unique = {"nation": ["n_nationkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["user_id", "event_type"]}
    found = quality.violations(tables, unique, [("labels", "doc_id", "documents", "doc_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey")])
    return spark.createDataFrame(found, "rule string, n bigint")


FREEZE_SQL = """WITH r AS (SELECT 'nation: repeated keys' AS rule, count(*) AS n FROM (SELECT n_nationkey FROM nation GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'orders: repeated keys', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'lineitem: repeated keys', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'events: repeated keys', count(*) FROM (SELECT 1 FROM events GROUP BY user_id, event_type HAVING count(*) > 1)
UNION ALL SELECT 'labels.doc_id: without documents', count(*) FROM labels WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'lineitem.l_orderkey: without orders', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) SELECT rule, n FROM r"""


#: What is put behind the pages in turn, so that every kind of place has digits that count and some that don't.
PLACES = ("", "\n<p title='in 3'>{n > 4 ? <b>at 5</b> : `to ${n + 6} of 7`}</p>", "\n<script>\nimport x from 'lib8';\nconst y = 'of 9', z = 10; // 11\n</script>", "\n<!-- 12 --><style>a { width: 13px }</style><a href='/14'>fifteen</a>", "\n<div set:html={x16} />")


def copy_digits(spark, sf_dir):
    """Digits in the copy of all pages, with templates and scripts behind them."""
    pages = _read(spark, sf_dir, "pages")
    more = F.element_at(F.array(*map(F.lit, PLACES)), (F.pmod("page_id", F.lit(len(PLACES))) + 1).cast("int"))
    found = copydigits.scan(pages, "page_id", F.concat(F.coalesce("html", F.lit("")), more))
    line = lambda x: F.concat(x["line"].cast("string"), F.lit(":"), x["text"])
    return found.select("page_id", F.size("found").alias("n"), F.get("found", F.lit(-1) + F.size("found"))["text"].alias("last"), F.sha2(F.array_join(F.transform("found", line), "\n"), 256).alias("digest"))


def digits_scan(spark, sf_dir):
    """Lines of pages that show a digit."""
    rows = _read(spark, sf_dir, "pages").select("page_id", F.explode(parse.digits(F.coalesce("html", F.lit("")))).alias("d"))
    return rows.select("page_id", F.col("d.line").cast("bigint").alias("line"), "d.snippet")


DIGITS_SQL = r"""WITH s AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g'), '<[^>\n]*>', ' ', 'g'), '&#?[0-9A-Za-z]+;', ' ', 'g'), chr(10)) AS l FROM pages),
e AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS x FROM s) SELECT page_id, line, substr(trim(x, ' '), 1, 60) AS snippet FROM e WHERE regexp_matches(x, '[0-9]')"""


def tree_counts(spark, sf_dir):
    """Entries below each region, nation and customer, by going down the tree."""
    edges = _read(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("up"), F.concat(F.lit("n"), "n_nationkey").alias("node"))
    edges = edges.unionByName(_read(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("up"), F.concat(F.lit("c"), "c_custkey").alias("node")))
    return sampling.below(edges)


TREE_SQL = """SELECT 'n' || n_nationkey AS node, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
UNION ALL SELECT 'r' || n_regionkey, count(c_custkey) + count(DISTINCT n_nationkey) FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, n_regionkey"""


QUERIES = {
    "copy_digits": (copy_digits, None),
    "digits_scan": (digits_scan, DIGITS_SQL),
    "tree_counts": (tree_counts, TREE_SQL),
    "entropy": (entropy, ENTROPY_SQL),
    "heading_scan": (headings, HEADINGS_SQL),
    "skip_reason": (skip_reasons, SKIP_SQL),
    "family_key": (family_keys, FAMILY_SQL),
    "normalized_clusters": (normalized_clusters, NORM_SQL),
    "lattice_totals": (lattice_totals, _lattice_sql()),
    "approved_labels": (approved_labels, LABELS_SQL),
    "text_representatives": (text_representatives, REPRESENTATIVES_SQL),
    "extraction_planted": (extraction_planted, EXTRACTION_SQL),
    "extraction_score": (extraction_score, SCORE_SQL),
    "edition_hash": (content_hashes, _hash_sql()),
    "runner_resume": (runner_resume, "SELECT n_name AS cluster_id, CAST(n_nationkey AS BIGINT) AS size FROM nation"),
    "freeze_gate": (freeze_gate, FREEZE_SQL),
}
