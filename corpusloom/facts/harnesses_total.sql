-- kind: scalar
SELECT count(1) AS harnesses FROM v_repos
