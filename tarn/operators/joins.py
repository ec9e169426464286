"""Joins."""

from tarn.plans.registry import register as q

q("inner_join", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
q("left_join", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
q("right_join", "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey")
q("full_join", "SELECT a.s_suppkey AS a, b.c_custkey AS b FROM supplier a FULL OUTER JOIN customer b ON a.s_suppkey = b.c_custkey + 50")
q("cross_join", "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n")
q("comma_join", "SELECT r.r_name AS r_name, n.n_name AS n_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey")
q("theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
q("theta_left_join", "SELECT a.r_regionkey AS a, b.n_nationkey AS b FROM region a LEFT JOIN nation b ON a.r_regionkey > b.n_nationkey")
q("multi_cond_join", "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_extendedprice > o.o_totalprice / 4")
q("multiway_join", """SELECT r.r_name, count(*) AS n, round(sum(l.l_extendedprice), 2) AS total FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name""")
q("join_on_true", "SELECT count(*) AS n FROM nation a JOIN region b", "SELECT count(*) AS n FROM nation a JOIN region b ON TRUE")
q("self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey")
q("join_derived", "SELECT c.c_name, t.n FROM customer c JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t ON t.o_custkey = c.c_custkey")
q("right_join_derived", "SELECT n.n_name, t.k FROM nation n RIGHT JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey) t ON t.k = n.n_nationkey")
q("values_join", "SELECT n.n_name, v.tag FROM nation n JOIN (VALUES (1, 'one'), (2, 'two')) AS v(k, tag) ON v.k = n.n_nationkey")
q("lateral_topk", """SELECT c.c_custkey, t.o_orderkey FROM customer c JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 2) t ON TRUE""")
q("lateral_left", """SELECT c.c_custkey, t.top AS top FROM customer c LEFT JOIN LATERAL (SELECT max(o.o_totalprice) AS top FROM orders o WHERE o.o_custkey = c.c_custkey) t ON TRUE""")
q("lateral_unnest", "SELECT n.n_nationkey, u.tag FROM nation n, UNNEST(ARRAY['a', 'b']) AS u(tag)", "SELECT n.n_nationkey, u.tag FROM nation n, (SELECT unnest(['a', 'b']) AS tag) u")
q("lateral_ordinality", "SELECT n.n_nationkey, u.ord, u.piece FROM nation n JOIN LATERAL UNNEST(string_to_array(n.n_name, '_')) WITH ORDINALITY AS u(piece, ord) ON TRUE", "SELECT n_nationkey, CAST(generate_subscripts(string_split(n_name, '_'), 1) AS INTEGER) AS ord, unnest(string_split(n_name, '_')) AS piece FROM nation")
q("lateral_json_each", "SELECT e.event_id, j.key, j.value FROM events e, LATERAL JSON_EACH(e.props) AS j", "SELECT e.event_id, j.key AS key, CAST(j.value AS VARCHAR) AS value FROM events e, json_each(e.props) j")
q("json_array_elements", "SELECT value, ord FROM JSON_ARRAY_ELEMENTS('[10, 20, 30]') WITH ORDINALITY AS j(value, ord)", "SELECT CAST(value AS VARCHAR) AS value, CAST(key AS INTEGER) + 1 AS ord FROM json_each('[10, 20, 30]')")
q("semi_join", "SELECT s.s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)")
q("anti_join", "SELECT p.p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey)")
