"""Window functions."""

from tarn.plans.registry import register as q

q("row_number", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
q("rank_window", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
q("dense_rank_window", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part")
q("first_value_window", "SELECT o_orderkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f FROM orders")
q("last_value_window", "SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders", "SELECT o_orderkey, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders")
q("lead_default", "SELECT o_orderkey, lead(o_orderkey, 2, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders")
q("lag_window", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders")
q("window_multi_partition", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem")
q("window_nulls", "SELECT k, row_number() OVER (PARTITION BY m ORDER BY s, k) AS up, row_number() OVER (PARTITION BY m ORDER BY s DESC, k) AS down FROM (SELECT c_custkey AS k, c_custkey % 7 AS m, nullif(c_nationkey, 2) AS s FROM customer)", "SELECT k, row_number() OVER (PARTITION BY m ORDER BY s NULLS LAST, k) AS up, row_number() OVER (PARTITION BY m ORDER BY s DESC NULLS FIRST, k) AS down FROM (SELECT c_custkey AS k, c_custkey % 7 AS m, nullif(c_nationkey, 2) AS s FROM customer)")
q("window_over_agg", "SELECT o_custkey, n, rank() OVER (ORDER BY n DESC) AS r FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)")
q("window_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS s FROM orders")
q("window_whole_partition", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation")
