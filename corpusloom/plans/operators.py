"""Queries that go through the Python-side operators; SQL beside them where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import parse
from corpusloom.operators import dedup, graph, hierarchy, manifold, sampling, vectors
from corpusloom.sources.tables import settled
from corpusloom.streaming import runner


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").filter("text is not null")
    repo = F.concat("lang", F.lit("/"), "source")
    named = docs.select(
        F.concat(F.lit("a-"), F.col("doc_id").cast("string")).alias("artifact_id"), F.col("lang").alias("kind"), repo.alias("repo"),
        F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.sha2("text", 256).alias("blob_sha"), "text", "doc_id",
    )
    created = settled(docs.groupBy(repo.alias("repo")).agg(F.lpad(F.min("doc_id").cast("string"), 12, "0").alias("created_at")), "created")
    return named.join(created, "repo", "left")


def dedup_part(part: str):
    return lambda spark, sf_dir: dedup.lineage(dedup.cluster(artifacts(spark, sf_dir).drop("doc_id")), only=part)[part]


def tier_counts(spark, sf_dir):
    return dedup.tier_counts(artifacts(spark, sf_dir).drop("doc_id"), (0.5, 0.7, 0.8, 0.9))


def _dedup_sql(wanted: str, threshold: str = "0.8") -> str:
    """The same by all pairs that share a shingle, components by recursion, and set operations on shingles."""
    edge = "[^\\p{L}\\p{N}_-]"
    return f"""WITH RECURSIVE created AS (SELECT lang, source, lpad(CAST(min(doc_id) AS VARCHAR), 12, '0') AS created_at FROM documents WHERE text IS NOT NULL GROUP BY ALL),
d AS (SELECT 'a-' || doc_id AS id, t.lang AS kind, t.lang || '/' || t.source AS repo, t.source || '/doc' || doc_id || '.md' AS path, created_at, sha256(text) AS sha,
  trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS flat, trim(regexp_replace(regexp_replace(lower(text), '(^|{edge})' || lower(t.source) || '($|{edge})', '\\1{{repo}}\\2', 'g'), '\\s+', ' ', 'g')) AS norm
  FROM documents t JOIN created c ON t.lang = c.lang AND t.source = c.source WHERE text IS NOT NULL),
h AS (SELECT *, min(id) OVER (PARTITION BY kind, norm) AS head FROM d),
w AS (SELECT DISTINCT kind, head, regexp_extract_all(norm, '[\\p{{L}}\\p{{N}}_]+') AS w FROM h),
g AS (SELECT kind, head, unnest(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT head, count(*) AS n FROM g GROUP BY head),
p AS (SELECT x.head AS a, y.head AS b, count(*) AS shared FROM g x JOIN g y ON x.kind = y.kind AND x.g = y.g AND x.head < y.head GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.head = a JOIN n y ON y.head = b WHERE shared >= {threshold} * (x.n + y.n - shared)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT head AS node, head AS root FROM n UNION SELECT s.b, r.root FROM r JOIN s ON r.node = s.a),
lo AS (SELECT node, min(root) AS root FROM r GROUP BY node), c AS (SELECT h.*, lo.root FROM h JOIN lo ON lo.node = h.head),
o AS (SELECT kind, root, arg_min(id, (created_at, repo, path)) AS origin, 'c-' || substr(sha256('["' || kind || '", "' || min(sha) || '"]'), 1, 16) AS cluster_id, count(*) AS size FROM c GROUP BY kind, root),
t AS (SELECT c.*, o.cluster_id, o.origin, x.sha AS o_sha, x.norm AS o_norm, x.flat AS o_flat, x.head AS o_head, x.repo AS o_repo FROM c JOIN o ON c.kind = o.kind AND c.root = o.root JOIN c x ON x.id = o.origin),
m AS (SELECT t.*, a.n AS a, b.n AS b, coalesce(p.shared, 0) AS shared FROM t JOIN n a ON a.head = t.head JOIN n b ON b.head = t.o_head LEFT JOIN p ON p.a = least(t.head, t.o_head) AND p.b = greatest(t.head, t.o_head))
{wanted}"""


_CLUSTERS = "SELECT cluster_id, kind, origin AS canonical_artifact, size FROM o"
_MEMBERSHIP = "SELECT id AS artifact_id, cluster_id, CASE WHEN id = origin THEN 'origin' WHEN sha = o_sha THEN 'exact' WHEN norm = o_norm THEN 'normalized' ELSE 'minhash' END AS tier, CAST(NULL AS VARCHAR) AS family_key FROM t"
_LINEAGE = "SELECT cluster_id, o_repo AS origin_repo, 'repo_created_at' AS origin_basis, CAST(NULL AS VARCHAR) AS upstream_lib FROM t WHERE id = origin"
_MUTATIONS = """SELECT id AS artifact_id, cluster_id, CASE WHEN sha = o_sha THEN 'verbatim' WHEN norm = o_norm THEN CASE WHEN flat = o_flat THEN 'verbatim' ELSE 'retargeted' END
  WHEN shared >= 0.9 * a AND a < b THEN 'trimmed' WHEN shared >= 0.9 * b AND a > b THEN 'extended' ELSE 'rewritten' END AS mutation_class FROM m WHERE id <> origin"""
_TIERS = "SELECT kind, 'exact' AS tier, count(DISTINCT sha) AS n FROM c GROUP BY kind UNION ALL SELECT kind, 'normalized', count(DISTINCT norm) FROM c GROUP BY kind"
_TIER = "SELECT kind, 'minhash_{t}' AS tier, count(DISTINCT root) AS n FROM c GROUP BY kind"
TIERS_SQL = " UNION ALL ".join(f"SELECT * FROM ({q})" for q in [_dedup_sql(_TIERS), *(_dedup_sql(_TIER.format(t=t), t) for t in ("0.5", "0.7", "0.8", "0.9"))])


def shingle_jaccard_pairs(spark, sf_dir):
    """Pairs of one source by the full similarity of their shingles, and the documents with equal sets."""
    docs = _read(spark, sf_dir, "documents").filter("text is not null")
    sets = dedup.shingle_hashes(docs.select(F.col("doc_id").alias("key"), F.col("source").alias("block"), F.lower("text").alias("low")), "low")
    found = dedup.jaccard_pairs(sets, 0.5)
    return found.select(F.col("a").alias("doc_id"), F.col("b").alias("other"), F.round("jaccard", 9).alias("jaccard"))


SHINGLE_SQL = """WITH d AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, source, list_sort(CASE WHEN len(w) <= 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s FROM d),
r AS (SELECT *, min(doc_id) OVER (PARTITION BY source, s) AS rep FROM s), g AS (SELECT source, doc_id, len(s) AS n, unnest(s) AS g FROM r WHERE doc_id = rep),
p AS (SELECT a.doc_id, b.doc_id AS other, a.n + b.n AS both_n, count(*) AS shared FROM g a JOIN g b ON a.source = b.source AND a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_id, other, round(shared / CAST(both_n - shared AS DOUBLE), 9) AS jaccard FROM p WHERE shared >= 0.5 * (both_n - shared)
UNION ALL SELECT rep, doc_id, 1.0 FROM r WHERE doc_id <> rep"""


def connected_components(spark, sf_dir):
    """Documents joined by an equal first line or an equal last one."""
    docs = _read(spark, sf_dir, "documents").filter("text is not null")
    rows = docs.select("doc_id", F.md5(F.substring_index("text", "\n", 1)).alias("x"), F.md5(F.substring_index("text", "\n", -1)).alias("y"))
    edges = None
    for k in ("x", "y"):
        least = rows.groupBy(k).agg(F.min("doc_id").alias("a"))
        some = rows.join(least, k).select("a", F.col("doc_id").alias("b"))
        edges = some if edges is None else edges.unionByName(some)
    return graph.components(rows.select(F.col("doc_id").alias("node")), edges)


COMPONENTS_SQL = """WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10))[1] AS x, string_split(text, chr(10))[-1] AS y FROM documents WHERE text IS NOT NULL),
e AS (SELECT min(doc_id) OVER (PARTITION BY x) AS a, doc_id AS b FROM d UNION SELECT min(doc_id) OVER (PARTITION BY y), doc_id FROM d),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT s.b, r.root FROM r JOIN s ON r.node = s.a)
SELECT node, min(root) AS root FROM r GROUP BY node"""


def parse_documents(spark, sf_dir):
    files = _read(spark, sf_dir, "documents").filter("text is not null").select(F.concat("lang", F.lit("/"), "source").alias("repo"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/CLAUDE.md")).alias("path"), F.lit("claude_md").alias("kind"), "text")
    done = parse.parse(files)
    return done.select("path", F.get_json_object("parsed_json", "$.bytes").cast("bigint").alias("bytes"), F.get_json_object("parsed_json", "$.nested").alias("nested"), "error_class")


PARSE_SQL = """SELECT concat('d', doc_id, '/CLAUDE.md') AS path, CAST(strlen(text) AS BIGINT) AS bytes,
CASE WHEN trim(text, chr(10) || chr(9) || chr(13) || ' ') = '' THEN NULL ELSE 'true' END AS nested, CASE WHEN trim(text, chr(10) || chr(9) || chr(13) || ' ') = '' THEN 'empty' END AS error_class FROM documents WHERE text IS NOT NULL"""


def hash_embed(spark, sf_dir):
    found = vectors.hash_embed(_read(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.select("item_id", "place", F.round("value", 9).alias("value"))


HASH_SQL = """WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
c AS (SELECT item_id, CAST(concat('0x', right(md5(w), 2)) AS INT) AS place, count(*) AS n FROM w GROUP BY ALL),
t AS (SELECT item_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM c GROUP BY item_id)
SELECT item_id, place, round(n / norm, 9) AS value FROM c JOIN t USING (item_id)"""


def nn_distance(spark, sf_dir):
    found = vectors.nn_distance(_read(spark, sf_dir, "embeddings").filter("embedding is not null"))
    return found.select("vec_id", F.round("nn_distance", 6).alias("nn_distance"))


NN_SQL = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)
SELECT a.vec_id, round(1 - max(list_dot_product(a.v, b.v)), 6) AS nn_distance FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id"""


def rank_uncharted(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").filter("embedding is not null")
    sizes = rows.join(rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label").select("vec_id", F.when(F.col("label") < 5, F.col("n")).alias("size"))
    found = vectors.uncharted(vectors.nn_distance(rows).select("vec_id", F.round("nn_distance", 9).alias("nn_distance")), sizes, "vec_id")
    return found.select("vec_id", "rank")


RANK_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
d AS (SELECT a.vec_id, any_value(a.label) AS label, round(1 - max(list_dot_product(a.v, b.v)), 9) AS nn FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY a.vec_id),
r AS (SELECT vec_id, row_number() OVER (ORDER BY nn DESC, vec_id) AS rank FROM d WHERE label IS NULL OR label >= 5) SELECT vec_id, rank FROM r WHERE rank <= 50"""


def centroid_assign(spark, sf_dir):
    rows = _read(spark, sf_dir, "embeddings").filter("embedding is not null and label is not null")
    found = vectors.assign_noise(rows.filter("label < 5"), rows.filter("label >= 5"), least=0.2)
    return found.select("vec_id", F.coalesce("label", F.lit(-1)).alias("label"), F.round("similarity", 6).alias("similarity"))


CENTROID_SQL = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
p AS (SELECT label, i, avg(v[i]) AS m FROM e, (SELECT unnest(range(1, 65)) AS i) WHERE label < 5 GROUP BY label, i),
c AS (SELECT label, list(m ORDER BY i) AS c FROM p GROUP BY label),
n AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM c),
s AS (SELECT vec_id, n.label, list_dot_product(v, c) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(v, c) DESC, n.label) AS place FROM e JOIN n ON true WHERE e.label >= 5)
SELECT vec_id, CASE WHEN s >= 0.2 THEN CAST(label AS BIGINT) ELSE -1 END AS label, round(s, 6) AS similarity FROM s WHERE place = 1"""


def density_groups(spark, sf_dir):
    """Density clusters of all vectors: cores have three at a cosine of 0.5 or more."""
    found = vectors.density(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.5, F.lit(3))
    return found.select("vec_id", F.coalesce("grp", F.lit(-1)).alias("grp"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


_NEAR = """v AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings WHERE embedding IS NOT NULL),
x AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id{within})"""
_DENSE = """n AS (SELECT vec_id, count(a) AS n FROM v LEFT JOIN (SELECT a FROM x WHERE s >= {s}) k ON k.a = vec_id GROUP BY vec_id), core AS (SELECT vec_id FROM n WHERE n + 1 >= {least}),
e AS (SELECT a, b FROM x WHERE s >= {s} AND a IN (SELECT vec_id FROM core) AND b IN (SELECT vec_id FROM core)),
r AS (SELECT vec_id AS node, vec_id AS root FROM core UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a), c AS (SELECT node, min(root) AS root FROM r GROUP BY node),
f AS (SELECT a AS node, arg_max(b, (round(s, 9), -b)) AS b FROM x WHERE s >= {s} AND a NOT IN (SELECT vec_id FROM core) AND b IN (SELECT vec_id FROM core) GROUP BY a),
p AS (SELECT node, root FROM c UNION ALL SELECT f.node, c.root FROM f JOIN c ON f.b = c.node), z AS (SELECT *, count(*) OVER (PARTITION BY root) AS size FROM p)"""
DENSITY_SQL = f"""WITH RECURSIVE {_NEAR.format(within='')}, {_DENSE.format(s=0.5, least=3)}
SELECT e.vec_id, CASE WHEN size >= 3 THEN root ELSE -1 END AS grp, CASE WHEN size >= 3 THEN size ELSE 0 END AS size FROM embeddings e LEFT JOIN z ON z.node = e.vec_id""".replace("CASE WHEN size >= 3 THEN root ELSE -1 END", "coalesce(CASE WHEN size >= 3 THEN root END, -1)").replace("CASE WHEN size >= 3 THEN size ELSE 0 END", "coalesce(CASE WHEN size >= 3 THEN size END, 0)")


def density_within(spark, sf_dir):
    """Density clusters among the vectors of each label, as the second level has them."""
    rows = _read(spark, sf_dir, "embeddings").filter("label is not null")
    found = vectors.density(rows, "vec_id", "embedding", 0.6, F.lit(2), F.col("label"))
    return found.select("vec_id", F.coalesce("grp", F.lit(-1)).alias("grp"))


WITHIN_SQL = f"""WITH RECURSIVE {_NEAR.format(within=' AND a.label = b.label')}, {_DENSE.format(s=0.6, least=2)}
SELECT e.vec_id, coalesce(CASE WHEN size >= 2 THEN root END, -1) AS grp FROM embeddings e LEFT JOIN z ON z.node = e.vec_id WHERE label IS NOT NULL"""


def hierarchical(selection: str):
    """Hierarchical density clusters of four vectors or more, by stability or those without clusters below."""

    def run(spark, sf_dir):
        found = hierarchy.clusters(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.lit(4), selection, F.lit(2))
        return found.select("vec_id", F.coalesce("grp", F.lit(-1)).alias("grp"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))

    return run


def manifold_projection(spark, sf_dir):
    """Five numbers for each vector that keep who is near whom."""
    found = manifold.project(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", vectors.reduce)
    return found.select(F.col("key").alias("vec_id"), *[F.round(F.get("vector", F.lit(k)), 6).alias(f"x{k}") for k in range(5)])


def two_levels(spark, sf_dir):
    """Each vector's clusters in two levels, where noise has its nearest one, and the use case that it counts for."""
    rows = settled(_read(spark, sf_dir, "embeddings").filter("embedding is not null"), "rows")
    levels = settled(vectors.two_level(rows, "vec_id", "embedding"), "levels")
    at = rows.select("vec_id", "embedding").join(levels, "vec_id")
    near = vectors.assign_noise(at.filter("l1 is not null").withColumn("label", F.col("l1")), at.filter("l1 is null"), least=0.3)
    noise = near.select("vec_id", F.col("label").alias("l1"), F.lit(None).cast("bigint").alias("l2"))
    placed = settled(levels.filter("l1 is not null").unionByName(noise), "placed")
    members = placed.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("cluster_id"), F.col("l1").alias("parent"), F.col("l2").alias("leaf"))
    cases = vectors.taxonomy(members, keep=True).select("use_case_id", "parent", "leaf", F.col("size").alias("case_size"))
    own = placed.join(cases, placed["l1"].eqNullSafe(F.col("parent")) & placed["l2"].eqNullSafe(F.col("leaf")), "left")
    return own.select("vec_id", "l1", "l2", "use_case_id", "case_size")


#: What the techniques are about, in words that names are compared with.
CATALOG = {
    "agent_model_routing": "agent model routing: an agent names the model it runs on", "agent_restricted_tools": "agent restricted tools: an agent lists the tools it may use",
    "claude_md_imports": "guide imports: a guide imports other files", "claude_md_nested": "nested guide: a guide below the root",
    "command_arguments": "command arguments: a command takes arguments", "hook_notification": "notification hook: a hook on notifications",
    "hook_posttooluse_formatter": "formatter hook: code is formatted after a tool is used", "hook_pretooluse_guard": "guard hook: a hook before a tool is used",
    "hook_sessionstart_context": "session start hook: context at the start of a session", "hook_stop_gate": "stop gate: tests run before the end",
    "hook_userpromptsubmit": "prompt hook: a hook on what the user asks", "mcp_composition": "server composition: two servers or more",
    "permissions_bypass": "permissions bypass: no permission is asked for", "permissions_deny": "permissions deny: rules that deny", "permissions_sandbox": "sandbox: commands run in a sandbox",
    "plugin_manifest": "plugin manifest: a plugin is published", "skill_references": "skill references: a skill with references", "skill_scripts": "skill scripts: a skill with scripts",
}


def _catalog(spark: SparkSession) -> DataFrame:
    return vectors.hash_embed(spark.createDataFrame(list(CATALOG.items()), "id string, text string"), "id", "text")


def technique_nearest(spark, sf_dir):
    """The technique that the words of each benchmark passage are nearest to."""
    found = vectors.hash_embed(_read(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "key")
    return vectors.nearest(found, _catalog(spark)).select(F.col("key").alias("item_id"), "id", F.round("similarity", 9).alias("similarity"))


def technique_candidates(spark, sf_dir):
    """Sources as groups, with the first words of their documents as names."""
    docs = _read(spark, sf_dir, "documents")
    names = docs.select(F.col("source").alias("grp"), F.lower(F.regexp_extract(F.coalesce("text", F.lit("")), "^([A-Za-z]+)", 1)).alias("name")).filter("name != '' and grp is not null")
    found = vectors.technique_candidates(names, _catalog(spark))
    return found.select("grp", "size", "label", F.array_join("examples", ",").alias("examples"), "nearest_technique", F.round("similarity", 9).alias("similarity"), "is_candidate")


def _embedded_sql(name: str, rows: str) -> str:
    return f"""{name}_w AS (SELECT key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM ({rows})), {name}_c AS (SELECT key, CAST(concat('0x', right(md5(w), 2)) AS INT) AS place, count(*) AS n FROM {name}_w GROUP BY ALL),
{name}_t AS (SELECT key, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM {name}_c GROUP BY key), {name} AS (SELECT key, place, n / norm AS value FROM {name}_c JOIN {name}_t USING (key))"""


_CATALOG_SQL = _embedded_sql("cat", " UNION ALL ".join(f"SELECT '{k}' AS key, '{v}' AS text" for k, v in CATALOG.items()))
_NEAREST = "near AS (SELECT k.key, c.key AS id, round(coalesce(sum(r.value * cat.value), 0), 12) AS s FROM (SELECT DISTINCT key FROM rows_) k CROSS JOIN (SELECT DISTINCT key FROM cat) c LEFT JOIN cat ON cat.key = c.key LEFT JOIN rows_ r ON r.key = k.key AND r.place = cat.place GROUP BY ALL), best AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, id) AS place FROM near)"
NEAREST_SQL = f"WITH {_CATALOG_SQL}, {_embedded_sql('rows_', 'SELECT item_id AS key, text FROM benchmark')}, {_NEAREST} SELECT key AS item_id, id, round(s, 9) AS similarity FROM best WHERE place = 1"
CANDIDATES_SQL = f"""WITH {_CATALOG_SQL}, names AS (SELECT source AS grp, lower(regexp_extract(text, '^([A-Za-z]+)', 1)) AS name FROM documents WHERE source IS NOT NULL AND regexp_matches(text, '^[A-Za-z]')),
s AS (SELECT grp, CAST(concat('0x', right(md5(name), 2)) AS INT) AS place, count(*) AS n FROM names GROUP BY ALL), t AS (SELECT grp, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM s GROUP BY grp),
rows_ AS (SELECT grp AS key, place, n / norm AS value FROM s JOIN t USING (grp)), {_NEAREST},
o AS (SELECT grp, name, count(*) AS n FROM names GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY n DESC, name) AS place FROM o)
SELECT g.grp, g.size, p.name AS label, g.examples, b.id AS nearest_technique, round(b.s, 9) AS similarity, b.s < 0.6 AS is_candidate
FROM (SELECT grp, CAST(sum(n) AS BIGINT) AS size, string_agg(name, ',' ORDER BY place) FILTER (place <= 5) AS examples FROM p GROUP BY grp) g JOIN p ON p.grp = g.grp AND p.place = 1 JOIN best b ON b.key = g.grp AND b.place = 1"""


def label_samples(spark, sf_dir):
    return vectors.label_sample(_read(spark, sf_dir, "embeddings").filter("label is not null"), "label", "vec_id")


LABEL_SAMPLES_SQL = "SELECT label, unnest(list(vec_id ORDER BY vec_id)[1:12]) AS vec_id FROM embeddings WHERE label IS NOT NULL GROUP BY label"


def stratified_sample(spark, sf_dir):
    """The documents of a sample of 97, by language and length."""
    drawn = sampling.stratified(_read(spark, sf_dir, "documents").filter("lang is not null"), "doc_id", "n_chars", "lang", 97)
    return drawn.select("doc_id", "lang")


STRATIFIED_SQL = """WITH c AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), q AS (SELECT lang, 97 * n / CAST(sum(n) OVER () AS DOUBLE) AS raw FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY floor(raw) - raw, lang) AS place, sum(CAST(floor(raw) AS BIGINT)) OVER () AS given FROM q),
k AS (SELECT lang, CAST(floor(raw) + CASE WHEN place <= 97 - given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r),
w AS (SELECT doc_id, lang, CAST(floor(log10(greatest(coalesce(n_chars, 1), 1)) * 4) AS INT) AS w, md5(doc_id || ':7') AS h FROM documents WHERE lang IS NOT NULL),
t AS (SELECT *, (row_number() OVER (PARTITION BY lang, w ORDER BY h, doc_id) - 1) // 10 AS turn FROM w),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY turn, md5(w || ':3'), h, doc_id) AS place FROM t) SELECT doc_id, p.lang FROM p JOIN k ON k.lang = p.lang WHERE place <= quota"""


def size_bisection_lattice(spark, sf_dir):
    """Ranges over 0 .. 131,071, or as many levels more as the longest document needs."""
    docs = _read(spark, sf_dir, "documents").filter("n_chars is not null")
    return sampling.lattice(docs, "n_chars", 40, max(17, int(docs.agg(F.max("n_chars")).first()[0] or 0).bit_length()))


LATTICE_SQL = """WITH v AS (SELECT n_chars AS v, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 131071 GROUP BY 1),
r AS (SELECT level, (v // CAST(pow(2, level) AS BIGINT)) * CAST(pow(2, level) AS BIGINT) AS low, sum(n) AS total FROM v, (SELECT unnest(range(0, 18)) AS level) GROUP BY ALL)
SELECT a.low, a.low + CAST(pow(2, a.level) AS BIGINT) - 1 AS high, CAST(a.total AS BIGINT) AS total, CASE WHEN a.total <= 40 THEN 'leaf' ELSE 'overflow' END AS kind
FROM r a LEFT JOIN r p ON p.level = a.level + 1 AND p.low = (a.low // CAST(pow(2, a.level + 1) AS BIGINT)) * CAST(pow(2, a.level + 1) AS BIGINT)
WHERE (a.total <= 40 OR a.level = 0) AND coalesce(p.total, 41) > 40"""


def qualified_lattice(spark, sf_dir):
    """Lengths in steps of 500; what one step holds beyond 40 is told apart by two of the languages."""
    docs = _read(spark, sf_dir, "documents").filter("n_chars is not null").withColumn("step", F.floor(F.col("n_chars") / 500)).withColumn("known", F.when(F.col("lang").isin("de", "fr"), F.col("lang")))
    levels = max(8, int(docs.agg(F.max("step")).first()[0] or 0).bit_length())
    return sampling.qualified(docs, "step", "known", 40, levels)


QUALIFIED_SQL = """WITH d AS (SELECT n_chars // 500 AS v, CASE WHEN lang IN ('de', 'fr') THEN lang END AS qualifier FROM documents WHERE n_chars IS NOT NULL),
e AS (SELECT greatest(8, CAST(floor(log2(greatest(max(v), 1))) AS BIGINT) + 1) AS levels FROM d),
r AS (SELECT level, (v // CAST(pow(2, level) AS BIGINT)) * CAST(pow(2, level) AS BIGINT) AS low, count(*) AS total FROM d, (SELECT unnest(range(0, levels + 1)) AS level FROM e) GROUP BY ALL)
SELECT a.low, a.low + CAST(pow(2, a.level) AS BIGINT) - 1 AS high, CAST(NULL AS VARCHAR) AS qualifier, a.total, 'leaf' AS kind
FROM r a LEFT JOIN r p ON p.level = a.level + 1 AND p.low = (a.low // CAST(pow(2, a.level + 1) AS BIGINT)) * CAST(pow(2, a.level + 1) AS BIGINT) WHERE a.total <= 40 AND coalesce(p.total, 41) > 40
UNION ALL SELECT v, v, qualifier, count(*), CASE WHEN qualifier IS NULL THEN 'overflow' WHEN count(*) <= 40 THEN 'leaf' ELSE 'capped' END FROM d WHERE v IN (SELECT low FROM r WHERE level = 0 AND total > 40) GROUP BY v, qualifier"""


def greedy_batches(spark, sf_dir):
    """Documents in the order of their ids, 40 and 400,000 bytes to a batch at most."""
    return sampling.greedy(_read(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")), "doc_id", "size")


GREEDY_SQL = """WITH RECURSIVE d AS (SELECT doc_id, coalesce(strlen(text), 0) AS size, row_number() OVER (ORDER BY doc_id) AS i FROM documents),
g AS (SELECT i, doc_id, 0 AS batch, 1 AS n, size AS held FROM d WHERE i = 1
UNION ALL SELECT d.i, d.doc_id, g.batch + CASE WHEN g.n = 40 OR g.held + d.size > 400000 THEN 1 ELSE 0 END, CASE WHEN g.n = 40 OR g.held + d.size > 400000 THEN 1 ELSE g.n + 1 END,
  CASE WHEN g.n = 40 OR g.held + d.size > 400000 THEN d.size ELSE g.held + d.size END FROM g JOIN d ON d.i = g.i + 1) SELECT doc_id, batch FROM g"""


def batch_numbers(spark, sf_dir):
    return sampling.numbered(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


def windows(length: str, slide: str | None = None):
    def run(spark, sf_dir):
        found = runner.windowed(_read(spark, sf_dir, "events"), length, slide)
        return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")

    return run


def session_windows(spark, sf_dir):
    found = runner.sessions(_read(spark, sf_dir, "events"), "2 hours")
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "n")


_HOUR = "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL"
_SLIDE = """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM (
SELECT time_bucket(INTERVAL '30 minutes', ts) - k * INTERVAL '30 minutes' AS s, event_type FROM events, (SELECT unnest([0, 1]) AS k)) GROUP BY ALL"""
_SESSION = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k"""

QUERIES = {
    "dedup_clusters": (dedup_part("clusters"), _dedup_sql(_CLUSTERS)),
    "dedup_membership": (dedup_part("membership"), _dedup_sql(_MEMBERSHIP)),
    "dedup_lineage": (dedup_part("lineage"), _dedup_sql(_LINEAGE)),
    "mutation_class": (dedup_part("mutations"), _dedup_sql(_MUTATIONS)),
    "tier_counts": (tier_counts, TIERS_SQL),
    "shingle_jaccard_pairs": (shingle_jaccard_pairs, SHINGLE_SQL),
    "connected_components": (connected_components, COMPONENTS_SQL),
    "parse_documents": (parse_documents, PARSE_SQL),
    "hash_embed": (hash_embed, HASH_SQL),
    "nn_distance": (nn_distance, NN_SQL),
    "rank_uncharted": (rank_uncharted, RANK_SQL),
    "centroid_assign": (centroid_assign, CENTROID_SQL),
    "density_groups": (density_groups, DENSITY_SQL),
    "density_within": (density_within, WITHIN_SQL),
    "hierarchical_eom": (hierarchical("eom"), None),
    "hierarchical_leaf": (hierarchical("leaf"), None),
    "manifold_projection": (manifold_projection, None),
    "two_levels": (two_levels, None),
    "technique_nearest": (technique_nearest, NEAREST_SQL),
    "technique_candidates": (technique_candidates, CANDIDATES_SQL),
    "label_samples": (label_samples, LABEL_SAMPLES_SQL),
    "stratified_sample": (stratified_sample, STRATIFIED_SQL),
    "size_bisection_lattice": (size_bisection_lattice, LATTICE_SQL),
    "qualified_lattice": (qualified_lattice, QUALIFIED_SQL),
    "greedy_batches": (greedy_batches, GREEDY_SQL),
    "batch_numbers": (batch_numbers, "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS batch FROM orders"),
    "tumbling_window": (windows("1 hour"), _HOUR),
    "sliding_window": (windows("1 hour", "30 minutes"), _SLIDE),
    "session_window": (session_windows, _SESSION),
}
