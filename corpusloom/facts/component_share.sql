-- kind: series
WITH held AS (SELECT DISTINCT kind, repo FROM v_artifacts)
SELECT kind, count(1) AS harnesses, try_divide(count(1), (SELECT count(1) FROM v_repos)) AS share FROM held GROUP BY kind ORDER BY kind
