"""Aggregation."""

from tarn.plans.registry import register as q

q("agg_group", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
q("agg_global", "SELECT count(*) AS n, count(o_orderstatus) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
q("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0")
q("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus")
q("agg_sum_distinct", "SELECT round(sum(DISTINCT l_discount), 6) AS s FROM lineitem")
q("agg_sum_avg_min_max", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS s, round(avg(c_acctbal), 6) AS a, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY c_mktsegment")
q("agg_sum_text", "SELECT sum(x::double precision) AS s FROM (VALUES ('150'), ('250')) AS t(x)", "SELECT sum(CAST(x AS DOUBLE)) AS s FROM (VALUES ('150'), ('250')) AS t(x)")
q("agg_filter", "SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 50000), 2) AS big, string_agg(lower(trim(concat(o_orderstatus, '('))), ',' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'F') AS listed FROM orders GROUP BY o_custkey")
q("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 1000")
q("agg_having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12")
q("agg_expression", "SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 4) AS mean FROM lineitem GROUP BY l_returnflag")
q("agg_group_expression", "SELECT o_orderkey % 7 AS bucket, count(*) AS n FROM orders GROUP BY o_orderkey % 7")
q("array_agg", "SELECT n_regionkey, array_to_string(array_agg(n_name ORDER BY n_nationkey), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey")
q("array_agg_ordered_desc", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
q("array_agg_nulls", "SELECT cardinality(array_agg(x)) AS n, count(x) AS c FROM (VALUES (1), (NULL), (3)) AS t(x)", "SELECT CAST(len(array_agg(x)) AS INTEGER) AS n, count(x) AS c FROM (VALUES (1), (NULL), (3)) AS t(x)")
q("json_agg", "SELECT n_regionkey, json_agg(n_nationkey ORDER BY n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list_sort(list(n_nationkey))) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
q("json_object_agg", "SELECT n_regionkey, json_object_agg(n_name, n_nationkey) ->> 'NATION_3' AS v FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(max(CASE WHEN n_name = 'NATION_3' THEN n_nationkey END) AS VARCHAR) AS v FROM nation GROUP BY n_regionkey")
q("agg_any_value", "SELECT c_custkey, c_name, upper(c_name) AS loud, count(*) AS n FROM customer GROUP BY c_custkey", "SELECT c_custkey, any_value(c_name) AS c_name, upper(any_value(c_name)) AS loud, count(*) AS n FROM customer GROUP BY c_custkey")
q("agg_with_subquery", "SELECT n.n_regionkey AS k, count(*) AS n, (SELECT max(r.r_name) FROM region r WHERE r.r_regionkey = n.n_regionkey) AS name FROM nation n GROUP BY n.n_regionkey HAVING count(*) > 1", "SELECT g.k, g.n, (SELECT max(r.r_name) FROM region r WHERE r.r_regionkey = g.k) AS name FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) g WHERE g.n > 1")
q("rollup_groups", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
q("bool_aggregates", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS every_one, bool_or(o_totalprice > 400000) AS any_one FROM orders GROUP BY o_orderstatus")
