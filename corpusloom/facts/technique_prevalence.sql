-- kind: series
WITH held AS (SELECT DISTINCT technique_id, repo FROM v_features)
SELECT technique_id, count(1) AS harnesses, try_divide(count(1), (SELECT count(1) FROM v_repos)) AS share FROM held GROUP BY technique_id ORDER BY technique_id
