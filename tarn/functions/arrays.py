"""Array functions and operators."""

from tarn.plans.registry import register as q

q("arr_overlap", "SELECT ARRAY[1, 2] && ARRAY[2, 3] AS a, ARRAY[1] && ARRAY[3] AS b, ARRAY[n_regionkey] && ARRAY[1, 4] AS c FROM nation", "SELECT list_has_any([1, 2], [2, 3]) AS a, list_has_any([1], [3]) AS b, n_regionkey IN (1, 4) AS c FROM nation")
q("arr_contains_all", "SELECT ARRAY[1, 2, 3] @> ARRAY[1, 3] AS a, ARRAY[1, 9] <@ ARRAY[1, 2, 3] AS b", "SELECT list_has_all([1, 2, 3], [1, 3]) AS a, list_has_all([1, 2, 3], [1, 9]) AS b")
q("arr_concat", "SELECT array_to_string(ARRAY['a'] || ARRAY['b', 'c'], ',') AS a, array_to_string(ARRAY['a'] || 'z', ',') AS b, array_to_string('y' || ARRAY['a'], ',') AS c", "SELECT array_to_string(list_concat(['a'], ['b', 'c']), ',') AS a, array_to_string(list_append(['a'], 'z'), ',') AS b, array_to_string(list_prepend('y', ['a']), ',') AS c")
q("arr_unnest_rows", "SELECT n_nationkey, piece FROM nation, UNNEST(string_to_array(n_name, '_')) AS x(piece)", "SELECT n_nationkey, unnest(string_split(n_name, '_')) AS piece FROM nation")
