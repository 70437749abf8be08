-- kind: scalar
SELECT 1 - try_divide(count(DISTINCT cluster_id), count(1)) AS copy_rate FROM v_membership
