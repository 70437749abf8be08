-- kind: series
WITH pairs AS (SELECT DISTINCT u.use_case_id, f.technique_id, u.repo FROM v_uc_repos u INNER JOIN v_features f ON f.repo = u.repo)
SELECT use_case_id, technique_id, count(1) AS harnesses FROM pairs GROUP BY use_case_id, technique_id ORDER BY use_case_id, technique_id
