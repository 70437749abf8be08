-- kind: scalar
SELECT count_if(NOT (coalesce(is_fork, false) OR coalesce(is_template, false))) AS harnesses FROM v_repos
