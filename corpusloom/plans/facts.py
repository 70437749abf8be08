"""Published numbers over canary-safe views, and the checks on what lies under them."""

from __future__ import annotations

from .adapters import features, views
from .dialect import Sql

_STAR = """leaf AS (
  SELECT DISTINCT n.n_name AS use_case_id, r.r_name AS parent_id, o.o_custkey AS harness
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  JOIN {region} r ON n.n_regionkey = r.r_regionkey),
uc AS (SELECT use_case_id, harness FROM leaf UNION SELECT parent_id AS use_case_id, harness FROM leaf WHERE parent_id IS NOT NULL)"""

FACTS = {
    "facts_component_share": Sql(lambda d: f"""WITH {views(d)}
SELECT kind, count(DISTINCT repo) AS harnesses, round(CAST(count(DISTINCT repo) AS DOUBLE) / (SELECT count(*) FROM v_repos), 9) AS share
FROM v_artifacts GROUP BY kind ORDER BY kind"""),
    "facts_copy_rate": Sql(lambda d: f"""WITH {views(d)}
SELECT round(1 - CAST(count(DISTINCT cluster_id) AS DOUBLE) / nullif(count(*), 0), 9) AS copy_rate FROM v_membership"""),
    "facts_distinct": Sql(lambda d: f"WITH {views(d)} SELECT count(DISTINCT cluster_id) AS distinct_artifacts FROM v_membership"),
    "facts_totals": Sql(lambda d: f"WITH {views(d)} SELECT (SELECT count(*) FROM v_artifacts) AS artifacts, (SELECT count(*) FROM v_repos) AS harnesses"),
    "facts_without_forks": Sql(lambda d: f"""WITH {views(d)}
SELECT count(*) AS harnesses FROM v_repos WHERE NOT coalesce(is_fork, false) AND NOT coalesce(is_template, false)"""),
    "facts_technique_prevalence": Sql(lambda d: f"""WITH {views(d)}, {features(d)}
SELECT technique_id, count(DISTINCT f.repo) AS harnesses, round(CAST(count(DISTINCT f.repo) AS DOUBLE) / (SELECT count(*) FROM v_repos), 9) AS share
FROM features f JOIN v_repos r ON f.repo = r.repo GROUP BY technique_id ORDER BY technique_id"""),
    "facts_uc_sizes": Sql(lambda d: f"WITH {_STAR} SELECT use_case_id, count(DISTINCT harness) AS harnesses FROM uc GROUP BY use_case_id ORDER BY use_case_id"),
    "facts_uc_technique_matrix": Sql(lambda d: f"""WITH {_STAR},
tech AS (SELECT DISTINCT o.o_custkey AS harness, p.p_brand AS technique_id
  FROM {{lineitem}} l JOIN {{orders}} o ON l.l_orderkey = o.o_orderkey JOIN {{part}} p ON l.l_partkey = p.p_partkey)
SELECT use_case_id, technique_id, {d.count_unique("u.harness")} AS harnesses FROM uc u JOIN tech t ON u.harness = t.harness
GROUP BY use_case_id, technique_id ORDER BY use_case_id, technique_id"""),
    "view_semi_join": Sql(lambda d: f"""WITH {views(d)},
clusters AS (SELECT cluster_id, count(*) AS size FROM membership GROUP BY cluster_id)
SELECT cluster_id, size FROM clusters WHERE cluster_id IN (SELECT cluster_id FROM v_membership)"""),
    "hidden_rows": Sql(lambda d: f"WITH {views(d)} SELECT artifact_id, repo FROM artifacts a WHERE NOT EXISTS (SELECT 1 FROM v_repos r WHERE r.repo = a.repo)"),
    "domain_order": Sql(lambda d: f"""WITH {_STAR}, sizes AS (SELECT use_case_id, count(DISTINCT harness) AS n FROM uc GROUP BY use_case_id)
SELECT n.n_name AS use_case_id, coalesce(s.n, 0) AS size, row_number() OVER (ORDER BY coalesce(s.n, 0) DESC, n.n_name) AS place
FROM {{nation}} n LEFT JOIN sizes s ON n.n_name = s.use_case_id"""),
    "most_common_component": Sql(lambda d: f"""WITH {views(d)}
SELECT kind, count(DISTINCT repo) AS harnesses FROM v_artifacts GROUP BY kind ORDER BY harnesses DESC, kind LIMIT 1"""),
    "technique_default_join": Sql(lambda d: f"""WITH {views(d)}, {features(d)},
seen AS (SELECT technique_id, count(DISTINCT f.repo) AS n FROM features f JOIN v_repos r ON f.repo = r.repo GROUP BY technique_id)
SELECT p.p_brand AS technique_id, coalesce(max(s.n), 0) AS harnesses FROM {{part}} p LEFT JOIN seen s ON p.p_brand = s.technique_id GROUP BY p.p_brand
UNION ALL SELECT technique_id, n AS harnesses FROM seen"""),
}

QUALITY = {
    "not_in_anti_join": Sql(lambda d: "SELECT count(*) AS dangling FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_custkey IS NOT NULL)"),
    "full_outer_drift": Sql(lambda d: """WITH now AS (SELECT o_orderpriority AS fact, sum(o_totalprice) AS v FROM {orders} GROUP BY 1),
was AS (SELECT o_orderpriority AS fact, sum(o_totalprice) * CASE WHEN o_orderpriority LIKE '1%' THEN 1.01 ELSE 1.0 END AS v
  FROM {orders} WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1),
both_sides AS (SELECT coalesce(n.fact, w.fact) AS fact, n.v AS a, w.v AS b FROM now n FULL OUTER JOIN was w ON n.fact = w.fact)
SELECT fact, CASE WHEN b IS NULL THEN 'added' WHEN a IS NULL THEN 'removed'
  WHEN abs(a - b) <= greatest(1e-12, 1e-9 * greatest(abs(a), abs(b))) THEN 'same' ELSE 'drift' END AS state FROM both_sides"""),
    "integrity_unique": Sql(lambda d: " UNION ALL ".join(
        f"SELECT '{name}' AS rule, (SELECT count(*) FROM {{{table}}}) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {{{table}}}) x) AS violations"
        for name, table, key in (("documents.doc_id", "documents", "doc_id"), ("lineitem.key", "lineitem", "l_orderkey, l_linenumber"), ("orders.key", "orders", "o_orderkey"), ("labels.doc_id", "labels", "doc_id"), ("conversations.turn", "conversations", "conv_id, turn"), ("events.user", "events", "user_id, event_type"), ("pages.url", "pages", "url"), ("embeddings.vec_id", "embeddings", "vec_id")))),
    "integrity_refs": Sql(lambda d: " UNION ALL ".join(
        f"SELECT '{a}.{x}' AS rule, (SELECT count(*) FROM {{{a}}} t WHERE t.{x} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{{b}}} u WHERE u.{y} = t.{x})) AS dangling"
        for a, x, b, y in (("labels", "doc_id", "documents", "doc_id"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")))),
    "exclusive_key_union_all": Sql(lambda d: """WITH accepted AS (SELECT doc_id, quality AS pass_id FROM {labels} WHERE toxic = 0),
rejected AS (SELECT doc_id, quality AS pass_id FROM {labels} WHERE toxic = 1 OR quality = 0),
u AS (SELECT doc_id, pass_id FROM accepted UNION ALL SELECT doc_id, pass_id FROM rejected)
SELECT doc_id, pass_id, count(*) AS n FROM u GROUP BY doc_id, pass_id HAVING count(*) > 1"""),
    "audit_duplicates": Sql(lambda d: "SELECT user_id AS unit, event_type AS part, count(*) AS n FROM {events} GROUP BY user_id, event_type HAVING count(*) > 1"),
    "audit_parts": Sql(lambda d: f"""WITH parts AS (SELECT CAST(ts AS DATE) AS day, count(*) AS found FROM {{events}} GROUP BY 1),
journal AS (SELECT CAST(ts AS DATE) AS day, count(*) AS promised FROM {{events}} WHERE event_type <> 'error' GROUP BY 1)
SELECT CAST(coalesce(p.day, j.day) AS STRING) AS part, coalesce(found, 0) AS found, coalesce(promised, 0) AS promised,
  CASE WHEN j.day IS NULL THEN 'orphan' WHEN p.day IS NULL THEN 'missing' WHEN found < promised THEN 'short' WHEN found > promised THEN 'long' ELSE 'ok' END AS state
FROM parts p FULL OUTER JOIN journal j ON p.day = j.day"""),
    "privacy_projection": Sql(lambda d: f"""WITH {views(d)}, {features(d)}
SELECT artifact_id, technique_id, CASE WHEN technique_id IN ('secret_like', 'email', 'phone') THEN NULL ELSE repo END AS repo,
  CASE WHEN technique_id IN ('secret_like', 'email', 'phone') THEN {d.first("path", "[^/]+$")} ELSE path END AS path FROM features"""),
}

JOURNAL = {
    "journal_rollup": Sql(lambda d: """SELECT event_type AS stage, count(DISTINCT user_id) AS units, count(DISTINCT CAST(ts AS DATE)) AS parts, count(*) AS n_rows
FROM {events} GROUP BY event_type"""),
    "attempts_last": Sql(lambda d: "SELECT user_id AS unit, count(*) AS attempts, CAST(max(ts) AS STRING) AS last_at FROM {events} WHERE event_type = 'click' GROUP BY user_id".replace("CAST(max(ts) AS STRING)", d.epoch("max(ts)"))),
    "pending_units_anti": Sql(lambda d: """WITH units AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day FROM {events}),
done AS (SELECT DISTINCT user_id, CAST(CAST(ts AS DATE) AS STRING) AS day FROM {events} WHERE event_type = 'purchase')
SELECT u.user_id AS unit, u.day FROM units u WHERE NOT EXISTS (SELECT 1 FROM done f WHERE f.user_id = u.user_id AND f.day = u.day)"""),
    "retry_gap_filter": Sql(lambda d: f"""WITH last_try AS (SELECT user_id, max(ts) AS last_at FROM {{events}} WHERE event_type = 'click' GROUP BY user_id),
clock AS (SELECT max(ts) AS now_at FROM {{events}})
SELECT user_id AS unit FROM last_try CROSS JOIN clock WHERE {d.epoch('now_at')} - {d.epoch('last_at')} >= 3600"""),
    "give_up": Sql(lambda d: "SELECT user_id AS unit, count(*) AS attempts, count(*) >= 5 AS terminal FROM {events} WHERE event_type = 'click' GROUP BY user_id"),
    "quoted_list_distinct_filter": Sql(lambda d: f"""SELECT source, count(*) AS n, {d.sorted_set("CAST(doc_id AS STRING)", "lang = 'fr'")} AS extra_paths FROM {{documents}} GROUP BY source"""),
    "rate_over_window": Sql(lambda d: f"""SELECT event_type, round((count(*) - 1) / nullif(CAST({d.epoch('max(ts)')} - {d.epoch('min(ts)')} AS DOUBLE), 0), 9) AS per_second FROM {{events}} GROUP BY event_type"""),
}
