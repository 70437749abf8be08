"""Operators over texts, paths and records."""

from __future__ import annotations

from .adapters import artifacts, features, views
from .dialect import Spark, Sql

def _norm(d: Spark, x: str) -> str:
    return f"trim({d.replace(f'lower({x})', '[ 	\\n\\r\\f]+', ' ')})"


def _tokens(d: Spark, x: str) -> str:
    return d.found(f"lower({x})", "[\\p{L}\\p{N}_]+")


_KAPPA = """WITH t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM {labels} WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality, toxic),
s AS (SELECT CAST(sum(n) AS DOUBLE) AS total, CAST(sum(CASE WHEN a = b THEN n ELSE 0 END) AS DOUBLE) AS agree,
  CAST(sum(CASE WHEN a = 1 THEN n ELSE 0 END) AS DOUBLE) AS a1, CAST(sum(CASE WHEN b = 1 THEN n ELSE 0 END) AS DOUBLE) AS b1 FROM t),
p AS (SELECT agree / total AS observed, (a1 * b1 + (total - a1) * (total - b1)) / (total * total) AS chance FROM s)
SELECT round(observed, 9) AS observed, round(chance, 9) AS chance, round((observed - chance) / nullif(1 - chance, 0), 9) AS kappa FROM p"""

TEXTS = {
    "classify_paths": Sql(lambda d: f"""WITH {artifacts(d)},
p AS (SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'CLAUDE.md' WHEN 1 THEN concat(kind, '/CLAUDE.md') WHEN 2 THEN '.mcp.json' WHEN 3 THEN '.claude/settings.json'
  WHEN 4 THEN concat('.claude/skills/', kind, '/SKILL.md') WHEN 5 THEN concat('.claude/skills/', kind, '/run.py') WHEN 6 THEN concat('.claude/agents/', path)
  WHEN 7 THEN '.claude/commands/x.md' WHEN 8 THEN '.claude/hooks/a.sh' WHEN 9 THEN '.claude/agents/notes.txt' WHEN 10 THEN '.claude/settings.local.json' ELSE path END AS path FROM artifacts)
SELECT doc_id, path, CASE
  WHEN path = 'CLAUDE.md' OR path LIKE '%/CLAUDE.md' THEN 'claude_md'
  WHEN path = '.mcp.json' THEN 'mcp' WHEN path = '.claude-plugin/plugin.json' THEN 'plugin' WHEN path = '.claude-plugin/marketplace.json' THEN 'marketplace'
  WHEN path = '.claude/settings.json' THEN 'settings' WHEN path = '.claude/settings.local.json' THEN 'settings_local'
  WHEN path LIKE '.claude/skills/%' THEN CASE WHEN path LIKE '%/SKILL.md' THEN 'skill' ELSE 'skill_file' END
  WHEN path LIKE '.claude/agents/%' AND path LIKE '%.md' THEN 'agent'
  WHEN path LIKE '.claude/commands/%' AND path LIKE '%.md' THEN 'command'
  WHEN path LIKE '.claude/hooks/%' THEN 'hook' WHEN path LIKE '.claude/%' THEN 'other_claude' END AS kind FROM p"""),
    "exact_clusters": Sql(lambda d: f"""WITH {artifacts(d)} SELECT concat('c-', substr({d.sha("concat(kind, ':', blob_sha)")}, 1, 16)) AS cluster_id, kind, count(*) AS size, min(doc_id) AS canonical
FROM artifacts GROUP BY kind, blob_sha"""),
    "origin_lineage": Sql(lambda d: f"""WITH {views(d)}, m AS (SELECT a.artifact_id, a.kind, a.blob_sha, a.repo, r.created_at,
  row_number() OVER (PARTITION BY a.kind, a.blob_sha ORDER BY coalesce(r.created_at, '9999'), a.repo, a.path) AS place,
  count(*) OVER (PARTITION BY a.kind, a.blob_sha) AS size FROM artifacts a LEFT JOIN repos r ON a.repo = r.repo)
SELECT concat('c-', substr({d.sha("concat(kind, ':', blob_sha)")}, 1, 16)) AS cluster_id, artifact_id AS canonical_artifact, repo AS origin_repo, size FROM m WHERE place = 1"""),
    "line_of": Sql(lambda d: f"""WITH {artifacts(d)}, l AS ({d.lines_of('artifacts', 'doc_id', 'text')}) SELECT doc_id, min(n) AS line FROM l WHERE line LIKE '%icensed under%' GROUP BY doc_id"""),
    "url_host": Sql(lambda d: f"""SELECT page_id, lower({d.first('url', '^[a-z]+://([^/:?#]+)', 1)}) AS host, {d.first('url', '^[a-z]+://[^/]+([^?#]*)', 1)} AS path FROM {{pages}}"""),
    "digit_names": Sql(lambda d: f"SELECT p_brand AS name, count(*) AS n FROM {{part}} WHERE NOT {d.matches('p_type', '[0-9]')} GROUP BY p_brand"),
    "quote_in_source": Sql(
        lambda d: f"""WITH {artifacts(d)}, s AS (SELECT doc_id, {_norm(d, 'text')} AS t FROM artifacts), q AS (SELECT item_id, {_norm(d, 'text')} AS t FROM {{benchmark}}),
sw AS (SELECT doc_id, split(t, ' ') AS w FROM s), blocks AS (SELECT doc_id, concat_ws(' ', slice(w, i, 4)) AS b FROM sw LATERAL VIEW explode(sequence(1, greatest(size(w) - 3, 1))) v AS i),
qb AS (SELECT item_id, t, concat_ws(' ', slice(split(t, ' '), 2, 4)) AS b FROM q WHERE size(split(t, ' ')) >= 6)
SELECT q.item_id, s.doc_id FROM (SELECT DISTINCT q.item_id, q.t, k.doc_id FROM blocks k JOIN qb q ON q.b = k.b) q JOIN s ON s.doc_id = q.doc_id WHERE contains(s.t, q.t)
UNION SELECT q.item_id, s.doc_id FROM q JOIN s ON contains(s.t, q.t) WHERE size(split(q.t, ' ')) < 6 AND q.t <> ''""",
        lambda d: f"""WITH {artifacts(d)}, s AS (SELECT doc_id, {_norm(d, 'text')} AS t FROM artifacts), q AS (SELECT item_id, {_norm(d, 'text')} AS t FROM {{benchmark}})
SELECT item_id, doc_id FROM q JOIN s ON contains(s.t, q.t) WHERE q.t <> ''""",
    ),
    "score_missing": Sql(lambda d: """SELECT d.doc_id, CASE WHEN l.doc_id2 IS NULL THEN 'missing' ELSE 'seen' END AS state FROM {documents} d
LEFT JOIN (SELECT DISTINCT doc_id AS doc_id2 FROM {labels}) l ON d.doc_id = l.doc_id2"""),
    "kappa": Sql(lambda d: _KAPPA),
    "precision_recall": Sql(lambda d: """WITH p AS (SELECT l.toxic AS truth, CASE WHEN lower(d.text) LIKE '%idiot%' OR lower(d.text) LIKE '%scum%' OR lower(d.text) LIKE '%trash%' THEN 1 ELSE 0 END AS said
  FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id),
c AS (SELECT CAST(sum(truth * said) AS DOUBLE) AS tp, CAST(sum((1 - truth) * said) AS DOUBLE) AS fp, CAST(sum(truth * (1 - said)) AS DOUBLE) AS fn FROM p)
SELECT round(tp / nullif(tp + fp, 0), 9) AS precision_, round(tp / nullif(tp + fn, 0), 9) AS recall_ FROM c"""),
    "top3_evidence": Sql(lambda d: f"""WITH {views(d)}, {features(d)}, ranked AS (SELECT technique_id, artifact_id, f.repo, coalesce(r.stars, 0) AS stars,
  row_number() OVER (PARTITION BY technique_id ORDER BY coalesce(r.stars, 0) DESC, f.repo, f.path) AS place FROM features f JOIN v_repos r ON f.repo = r.repo)
SELECT technique_id, place, artifact_id, repo, stars FROM ranked WHERE place <= 3"""),
    "richest_harness": Sql(lambda d: f"""WITH {views(d)}, {features(d)} SELECT f.repo, count(DISTINCT technique_id) AS kinds, max(r.stars) AS stars FROM features f JOIN v_repos r ON f.repo = r.repo
GROUP BY f.repo ORDER BY kinds DESC, stars DESC, f.repo LIMIT 1"""),
    "example_names": Sql(lambda d: f"""WITH {artifacts(d)}, c AS (SELECT repo, substr(text, 1, 20) AS name, count(*) AS n, min(doc_id) AS first_doc FROM artifacts GROUP BY repo, substr(text, 1, 20)),
r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, first_doc) AS place FROM c) SELECT repo, place, name, n FROM r WHERE place <= 5"""),
    "excerpt_clip": Sql(lambda d: f"""WITH {artifacts(d)}, l AS ({d.lines_of('artifacts', 'doc_id', 'text')}) SELECT doc_id, count(*) AS shown, CAST(sum(length(substr(line, 1, 200))) AS BIGINT) AS chars FROM l WHERE n <= 25 GROUP BY doc_id"""),
    "stable_prefix_limit": Sql(lambda d: "SELECT doc_id, md5(CAST(doc_id AS STRING)) AS key FROM {documents} ORDER BY key LIMIT 100"),
    "seeded_order": Sql(lambda d: "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(CAST(doc_id AS STRING), ':7')), doc_id) AS place FROM {documents}"),
    "excerpt_indent": Sql(lambda d: f"""WITH {artifacts(d)}, l AS ({d.lines_of('artifacts', 'doc_id', 'text')}) SELECT doc_id, min(length(line) - length(ltrim(line))) AS indent FROM l WHERE trim(line) <> '' GROUP BY doc_id"""),
}

NUMBERS = {
    "largest_remainder_quotas": Sql(lambda d: """WITH c AS (SELECT o_orderpriority AS kind, count(*) AS n FROM {orders} GROUP BY 1), t AS (SELECT CAST(sum(n) AS DOUBLE) AS s FROM c),
q AS (SELECT kind, 997 * n / s AS raw, CAST(floor(997 * n / s) AS BIGINT) AS base FROM c CROSS JOIN t), r AS (SELECT *, row_number() OVER (ORDER BY raw - base DESC, kind) AS place, sum(base) OVER () AS given FROM q)
SELECT kind, CAST(base + CASE WHEN place <= 997 - given THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r"""),
    "nearest_rank_p90": Sql(lambda d: """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS place, count(*) OVER (PARTITION BY event_type) AS n FROM {events})
SELECT event_type, max(value) AS p90 FROM r WHERE place = CAST(floor(0.9 * (n - 1)) AS BIGINT) + 1 GROUP BY event_type"""),
    "median_group": Sql(lambda d: "SELECT event_type, round(percentile(value, 0.5), 9) AS median FROM {events} GROUP BY event_type", lambda d: "SELECT event_type, round(quantile_cont(value, 0.5), 9) AS median FROM {events} GROUP BY event_type"),
    "share_below": Sql(lambda d: "SELECT lang, round(avg(CASE WHEN n_chars <= 1000 THEN 1.0E0 ELSE 0.0E0 END), 9) AS share FROM {documents} GROUP BY lang"),
    "call_summary": Sql(lambda d: """SELECT l_returnflag AS model, l_linenumber AS batch, count(*) AS calls, CAST(sum(l_quantity) AS BIGINT) AS sent, count(*) FILTER (WHERE l_linestatus = 'F') AS ok,
  round(CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) / nullif(count(*), 0), 9) AS valid_rate, round(sum(l_extendedprice) / nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0), 2) AS cost FROM {lineitem} GROUP BY 1, 2"""),
    "sustained_maximum": Sql(lambda d: "SELECT max(CASE WHEN event_type = 'view' THEN value END) AS best, round(max(CASE WHEN event_type = 'view' THEN value END) / nullif(max(value), 0), 9) AS ratio FROM {events}"),
    "distinct_ratio_at": Sql(lambda d: f"""WITH o AS (SELECT text, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS STRING))) AS place FROM {d.first_of("documents", 500)})
SELECT lang, n AS at, count(*) AS docs, round(CAST(count(DISTINCT text) AS DOUBLE) / count(*), 9) AS ratio FROM o JOIN (SELECT 100 AS n UNION ALL SELECT 250 UNION ALL SELECT 500) s ON place <= n GROUP BY lang, n"""),
    "upsert_by_key": Sql(lambda d: """WITH old AS (SELECT doc_id, quality FROM {labels}), new AS (SELECT doc_id, 9 AS quality FROM {labels} WHERE toxic = 1)
SELECT o.doc_id, o.quality FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id) UNION ALL SELECT doc_id, quality FROM new"""),
}
