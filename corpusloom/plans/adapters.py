"""The corpus model as views over the stored tables: artifacts, repos, clusters, features and what hangs on them."""

from __future__ import annotations

from .dialect import Spark

# Technique rules over a document's text, in order of evidence.
TECHNIQUE_RULES = {
    "code_like": "[{}();]",
    "email": "[a-z0-9._]+@[a-z0-9.]+[.][a-z]+",
    "heading": "(^|\n)#+ ",
    "license_line": "[Ll]icensed under",
    "list_line": "(^|\n)[-*] ",
    "phone": "[+][0-9]+ ",
    "secret_like": "(password|secret|token|api_?key) ?[:=]",
    "table_row": "[|] ",
    "url": "https?://",
}


def artifacts(d: Spark) -> str:
    return f"""artifacts AS (
  SELECT concat('a-', CAST(doc_id AS STRING)) AS artifact_id, concat(lang, '/', source) AS repo, lang AS kind,
         concat(source, '/doc', CAST(doc_id AS STRING), '.md') AS path, {d.sha("text")} AS blob_sha, doc_id, text
  FROM {{documents}} WHERE text IS NOT NULL)"""


REPOS = """repos AS (
  SELECT concat(lang, '/', source) AS repo, source = 'src18' AS missing, source = 'src19' AS canary, source = 'src17' AS is_fork,
         source = 'src16' AS is_template, lpad(CAST(min(doc_id) AS STRING), 12, '0') AS created_at, count(*) AS stars
  FROM {documents} GROUP BY lang, source)"""

V_REPOS = "v_repos AS (SELECT * FROM repos WHERE NOT coalesce(missing, false) AND NOT coalesce(canary, false))"


def views(d: Spark) -> str:
    """artifacts, repos, v_repos, v_artifacts, membership, v_membership, clusters."""
    cluster = d.sha("concat(kind, ':', blob_sha)")
    return f"""{artifacts(d)}, {REPOS}, {V_REPOS},
v_artifacts AS (SELECT a.* FROM artifacts a LEFT SEMI JOIN v_repos r ON a.repo = r.repo),
membership AS (SELECT artifact_id, concat('c-', substr({cluster}, 1, 16)) AS cluster_id FROM artifacts),
v_membership AS (SELECT m.* FROM membership m LEFT SEMI JOIN v_artifacts a ON m.artifact_id = a.artifact_id)""".replace("LEFT SEMI", d.semi)


def features(d: Spark) -> str:
    """One row per (technique, artifact); each text is looked at once."""
    told = ", ".join(f"CASE WHEN {d.matches('text', rule)} THEN '{name}' END" for name, rule in TECHNIQUE_RULES.items())
    return f"features AS (SELECT artifact_id, repo, path, {d.explode(d.some(told))} AS technique_id FROM artifacts)"
