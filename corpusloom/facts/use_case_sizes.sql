-- kind: series
WITH held AS (SELECT DISTINCT use_case_id, repo FROM v_uc_repos)
SELECT use_case_id, count(1) AS harnesses FROM held GROUP BY use_case_id ORDER BY use_case_id
