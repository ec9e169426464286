"""Sorting, limits, top-k and distinct."""

from tarn.plans.registry import register as q

q("order_by_alias", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, o_orderkey LIMIT 50")
q("order_nulls", "SELECT k, s FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS s FROM nation) ORDER BY s DESC, k LIMIT 7", "SELECT k, s FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS s FROM nation) ORDER BY s DESC NULLS FIRST, k LIMIT 7")
q("order_nulls_first", "SELECT k, s FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS s FROM nation) ORDER BY s, k LIMIT 22", "SELECT k, s FROM (SELECT n_nationkey AS k, nullif(n_regionkey, 2) AS s FROM nation) ORDER BY s ASC NULLS LAST, k LIMIT 22")
q("order_limit_offset", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
q("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
q("distinct_rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
q("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
q("external_sort", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_shipdate DESC, l_orderkey, l_linenumber OFFSET 1000")
