"""Numeric functions."""

from tarn.plans.registry import register as q

q("mth_abs", "SELECT c_custkey, abs(c_acctbal) AS v FROM customer")
q("mth_ceil_floor", "SELECT c_custkey, ceil(c_acctbal)::double precision AS c, floor(c_acctbal)::double precision AS f FROM customer", "SELECT c_custkey, CAST(ceil(c_acctbal) AS DOUBLE) AS c, CAST(floor(c_acctbal) AS DOUBLE) AS f FROM customer")
q("mth_round", "SELECT c_custkey, round(c_acctbal, 1) AS a, round(2.5) AS b, round(-2.5) AS c FROM customer", "SELECT c_custkey, round(c_acctbal, 1) AS a, round(CAST(2.5 AS DOUBLE)) AS b, round(CAST(-2.5 AS DOUBLE)) AS c FROM customer")
q("mth_trunc", "SELECT c_custkey, trunc(c_acctbal)::double precision AS v FROM customer", "SELECT c_custkey, CAST(trunc(c_acctbal) AS DOUBLE) AS v FROM customer")
q("mth_power", "SELECT power(2, 10)::double precision AS a, 9 ^ 0.5 AS b, pow(c_custkey, 2)::double precision AS c FROM customer", "SELECT power(CAST(2 AS DOUBLE), 10) AS a, power(CAST(9 AS DOUBLE), 0.5) AS b, power(CAST(c_custkey AS DOUBLE), 2) AS c FROM customer")
q("mth_sqrt_exp", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS s, round(exp(1), 9) AS e FROM orders", "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS s, round(exp(CAST(1 AS DOUBLE)), 9) AS e FROM orders")
q("mth_ln_log", "SELECT round(ln(o_totalprice), 9) AS a, log(100) AS b FROM orders", "SELECT round(ln(o_totalprice), 9) AS a, log10(CAST(100 AS DOUBLE)) AS b FROM orders")
q("mth_mod", "SELECT o_orderkey, mod(o_orderkey, 7) AS m, -7 % 3 AS n FROM orders", "SELECT o_orderkey, o_orderkey % 7 AS m, -7 % 3 AS n FROM orders")
q("mth_sign", "SELECT c_custkey, sign(c_acctbal) AS s FROM customer", "SELECT c_custkey, CAST(sign(c_acctbal) AS INT) AS s FROM customer")
q("mth_pi_angles", "SELECT round(pi(), 9) AS p, round(degrees(pi()), 6) AS d, round(radians(180), 9) AS r", "SELECT round(pi(), 9) AS p, round(degrees(pi()), 6) AS d, round(radians(CAST(180 AS DOUBLE)), 9) AS r")
