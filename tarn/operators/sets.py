"""Set operations, common table expressions and recursion."""

from tarn.plans.registry import register as q

q("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
q("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("intersect_distinct", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
q("intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
q("except_distinct", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 6000")
q("except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
q("set_precedence", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 3 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 10")
q("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000) SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey")
q("cte_multi", "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey), b(k, m) AS (SELECT k, n * 2 FROM a WHERE n > 3) SELECT a.k, a.n, b.m FROM a LEFT JOIN b ON a.k = b.k")
q("cte_nested", "SELECT t.k FROM (WITH inner_rows AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1) SELECT k FROM inner_rows) t")
q("cte_recursive_count", "WITH RECURSIVE cnt(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM cnt WHERE x < 50) SELECT x FROM cnt")
q("cte_recursive_tree", """WITH RECURSIVE tree(id, parent, depth) AS (SELECT id, parent, 0 FROM (VALUES (1, NULL), (2, 1), (3, 2), (4, 2), (5, NULL), (6, 5)) AS t(id, parent) WHERE parent IS NULL
UNION ALL SELECT c.id, c.parent, tree.depth + 1 FROM (VALUES (1, NULL), (2, 1), (3, 2), (4, 2), (5, NULL), (6, 5)) AS c(id, parent) JOIN tree ON c.parent = tree.id) SELECT id, depth FROM tree""")
q("correlated_exists_count", "SELECT n_nationkey FROM nation n WHERE (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 0) > 20")
