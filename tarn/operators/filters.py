"""Filters, predicates, operators and subquery predicates."""

from tarn.plans.registry import register as q

q("filter_comparison", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'F' AND o_orderkey != 7")
q("filter_logic_not", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal > 0 OR c_nationkey = 3) AND c_mktsegment IS NOT NULL")
q("filter_is_null", "SELECT x.k AS k FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'F') AS s FROM orders) x WHERE x.s IS NULL")
q("filter_between", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20")
q("filter_not_between", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20")
q("filter_in_list", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
q("filter_not_in_list", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)")
q("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_'")
q("filter_not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%1%'")
q("filter_like_escape", "SELECT n_name FROM nation WHERE n_name LIKE 'NATION!_1%' ESCAPE '!'")
q("filter_ilike", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation%2'")
q("filter_not_ilike", "SELECT n_name FROM nation WHERE n_name NOT ILIKE '%1%'")
q("filter_regex", "SELECT n_name FROM nation WHERE n_name ~ '_[12]$'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '_[12]$')")
q("filter_iregex", "SELECT n_name FROM nation WHERE n_name ~* 'nation_1'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, 'nation_1', 'i')")
q("filter_not_regex", "SELECT n_name FROM nation WHERE n_name !~ '1' AND n_name !~* 'n_2'", "SELECT n_name FROM nation WHERE NOT regexp_matches(n_name, '1') AND NOT regexp_matches(n_name, 'n_2', 'i')")
q("filter_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'high' WHEN o_totalprice > 10000 THEN 'mid' ELSE 'low' END AS band FROM orders")
q("filter_simple_case", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders")
q("filter_boolean", "SELECT c_custkey FROM customer WHERE (c_acctbal > 0) = TRUE")
q("arithmetic_ops", "SELECT l_orderkey, l_linenumber, l_quantity / 4 AS d, l_quantity * 2 - 1 AS m, -l_tax AS neg FROM lineitem")
q("division_real", "SELECT (7 / 2)::double precision AS d", "SELECT CAST(7 / 2 AS DOUBLE) AS d")
q("concat_op", "SELECT n_name || '/' || n_regionkey::text AS s, n_name || NULL AS nothing FROM nation", "SELECT n_name || '/' || CAST(n_regionkey AS VARCHAR) AS s, CAST(n_name || NULL AS VARCHAR) AS nothing FROM nation")
q("cast_ops", "SELECT '12'::int AS i, 'x'::int AS bad, 1::text AS s, CAST('true' AS boolean) AS b, '2024-02-03'::date AS d, '1.5'::float8 AS f", "SELECT try_cast('12' AS INT) AS i, try_cast('x' AS INT) AS bad, CAST(1 AS VARCHAR) AS s, CAST('true' AS BOOLEAN) AS b, CAST('2024-02-03' AS DATE) AS d, CAST('1.5' AS DOUBLE) AS f")
q("array_literal", "SELECT array_to_string(ARRAY['a', 'b', 'c'], ',') AS s, (ARRAY[n_nationkey, n_regionkey])[2] AS second FROM nation", "SELECT array_to_string(['a', 'b', 'c'], ',') AS s, n_regionkey AS second FROM nation")
q("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
q("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
q("exists_corr", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > c.c_acctbal * 30)")
q("not_exists_corr", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
q("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
q("scalar_corr_subquery", "SELECT c_custkey, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS n FROM customer c")
q("scalar_corr_latest", "SELECT c_custkey, (SELECT max(o.o_orderkey) FROM orders o WHERE o.o_custkey = c.c_custkey) AS latest FROM customer c")
