"""String, conditional and miscellaneous functions."""

from tarn.plans.registry import register as q

q("str_upper_lower", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation")
q("str_length", "SELECT c_custkey, length(c_name)::bigint AS n FROM customer", "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n FROM customer")
q("str_trim", "SELECT trim('  x y ') AS a, ltrim('  x') AS b, rtrim('x  ') AS c")
q("str_replace", "SELECT n_nationkey, replace(n_name, 'NATION', 'N') AS s FROM nation")
q("str_substring", "SELECT substring('alphabet', 0, 2) AS a, substring('alphabet' FROM 3 FOR 2) AS b, substr(n_name, 3) AS c FROM nation", "SELECT substring('alphabet', 0, 2) AS a, substring('alphabet', 3, 2) AS b, substring(n_name, 3) AS c FROM nation")
q("str_concat", "SELECT concat('a', NULL, n_name) AS s FROM nation")
q("str_concat_ws", "SELECT concat_ws('-', 'a', NULL, n_name) AS s FROM nation")
q("str_left_right", "SELECT n, left('héllo', n) AS l, right('héllo', n) AS r FROM (VALUES (-7), (-2), (0), (2), (9)) AS t(n)")
q("str_pad", "SELECT lpad('5', 3, '0') AS a, rpad('ab', 4, '*') AS b, lpad('hello', 2, 'x') AS c")
q("str_initcap", "SELECT initcap('hello big world') AS s, initcap(lower(n_name)) AS t FROM nation", "SELECT 'Hello Big World' AS s, upper(n_name[1]) || lower(n_name[2:]) AS t FROM nation")
q("str_reverse", "SELECT n_nationkey, reverse(n_name) AS s FROM nation")
q("str_strpos", "SELECT strpos(n_name, 'ON')::bigint AS p, strpos(n_name, 'zz')::bigint AS z FROM nation", "SELECT CAST(strpos(n_name, 'ON') AS BIGINT) AS p, CAST(strpos(n_name, 'zz') AS BIGINT) AS z FROM nation")
q("str_repeat", "SELECT repeat('ab', 3) AS a, repeat('ab', 0) AS b")
q("str_split_part", "SELECT n_nationkey, split_part(n_name, '_', 2) AS a, split_part(n_name, '_', 9) AS b FROM nation")
q("str_quote_ident", """SELECT quote_ident(n_name) AS s, quote_ident('a"b') AS t FROM nation""", """SELECT concat('"', replace(n_name, '"', '""'), '"') AS s, '"a""b"' AS t FROM nation""")
q("msc_coalesce", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS v FROM nation")
q("msc_uuid", "SELECT length(gen_random_uuid()::text) AS n, substring(uuid_generate_v4()::text, 15, 1) AS version", "SELECT CAST(36 AS INTEGER) AS n, '4' AS version")
q("msc_random", "SELECT count(*) AS n FROM (SELECT random() AS r FROM nation) WHERE r >= 0 AND r < 1", "SELECT count(*) AS n FROM nation")
q("msc_greatest_least", "SELECT greatest(n_nationkey, n_regionkey) AS g, least(n_nationkey, n_regionkey) AS l FROM nation")
