"""Scans, sources and projections."""

from tarn.plans.registry import register as q

q("flagship", """SELECT c.c_name AS c_name, count(o.o_orderkey) AS order_count
FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
WHERE c.c_name LIKE 'Customer%' GROUP BY c.c_name ORDER BY order_count DESC, c_name""")
q("scan_project", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
q("scan_star", "SELECT * FROM supplier")
q("alias_star", "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'X'")
q("computed_columns", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue, l_quantity + 1 AS more FROM lineitem")
q("pk_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 500 AND o_totalprice > 0")
q("pk_lookup_residual", "SELECT o_orderkey FROM orders WHERE o_orderkey = 500 AND o_orderstatus = 'none'")
q("derived_table", "SELECT d.k AS k, d.total AS total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) FROM orders GROUP BY o_custkey) AS d(k, total) WHERE d.total > 1000")
q("values_rows", "VALUES (1, 'a'), (2, 'b'), (3, NULL)", "SELECT column1, column2 FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS v(column1, column2)")
q("select_without_from", "SELECT 1 AS one, 'x' AS x, NULL::int AS nothing")
q("unnest_source", "SELECT unnest FROM UNNEST(ARRAY[3, 1, 2])", "SELECT unnest AS unnest FROM (SELECT unnest([3, 1, 2]) AS unnest)")
q("unnest_ordinality", "SELECT ord, c FROM UNNEST(ARRAY['x', 'y', 'z']) WITH ORDINALITY AS u(c, ord)", "SELECT CAST(ord AS INTEGER) AS ord, c FROM (SELECT unnest(['x', 'y', 'z']) AS c, generate_subscripts(['x', 'y', 'z'], 1) AS ord)")
q("exists_empty_select_list", "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT FROM orders o WHERE o.o_custkey = c.c_custkey)", "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
q("default_alias_names", "SELECT upper(n_name), n_regionkey + 1, n_regionkey * 2, upper('x') FROM nation", "SELECT upper(n_name) AS upper, n_regionkey + 1 AS col, n_regionkey * 2 AS col1, 'X' AS upper1 FROM nation")
q("scan_count", "SELECT count(*) AS n FROM lineitem")
q("filtered_scan_count", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25")
