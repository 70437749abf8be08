-- kind: scalar
SELECT told.n FROM (SELECT count(1) AS n FROM (SELECT DISTINCT cluster_id FROM v_membership) ids) told
