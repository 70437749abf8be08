-- kind: scalar
SELECT count(1) AS artifacts FROM v_artifacts
