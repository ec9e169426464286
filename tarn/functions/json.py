"""JSON functions and operators."""

from tarn.plans.registry import register as q

q("jsn_get_text", "SELECT event_id, props ->> 'k' AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events")
q("jsn_get_int", "SELECT event_id, (props::jsonb -> 'k')::bigint AS k FROM events", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events")
q("jsn_path", '''SELECT '{"a":{"b":[1,{"c":"x"}]}}'::json #>> '{a,b,1,c}' AS v, '{"a":{"b":[1,{"c":"x"}]}}'::json #> '{a,b,1}' AS w, json_extract_path_text(props, 'k') AS k FROM events''', '''SELECT '{"a":{"b":[1,{"c":"x"}]}}'::JSON ->> '$.a.b[1].c' AS v, '{"c":"x"}' AS w, props ->> '$.k' AS k FROM events''')
q("jsn_key_exists", "SELECT event_id, props::jsonb ? 'k' AS has, props::jsonb ? 'zz' AS no FROM events", "SELECT event_id, list_contains(json_keys(props), 'k') AS has, list_contains(json_keys(props), 'zz') AS no FROM events")
q("jsn_array_length", "SELECT json_array_length('[1,2,3]') AS n", "SELECT CAST(json_array_length('[1,2,3]') AS INTEGER) AS n")
q("jsn_build_object", "SELECT json_build_object('id', n_nationkey, 'name', n_name, 'none', NULL, 'in', json_build_array(n_regionkey, n_name = 'NATION_3')) AS j FROM nation", "SELECT CAST(json_object('id', n_nationkey, 'name', n_name, 'none', NULL, 'in', json_array(n_regionkey, n_name = 'NATION_3')) AS VARCHAR) AS j FROM nation")
q("jsn_build_array", "SELECT json_build_array(n_nationkey, 'x', n_name, 1.5, NULL, TRUE) AS v FROM nation", "SELECT CAST(json_array(n_nationkey, 'x', n_name, 1.5::DOUBLE, NULL, TRUE) AS VARCHAR) AS v FROM nation")
q("jsn_merge", """SELECT event_id, (props::jsonb || '{"b":3}'::jsonb) ->> 'b' AS b, props::jsonb || '{"k":"new"}'::jsonb AS j FROM events""", """SELECT event_id, '3' AS b, '{"k":"new"}' AS j FROM events""")
q("jsn_delete_key", """SELECT event_id, json_build_object('a', event_id, 'b', 2) - 'a' AS j, '["x","y","z"]'::jsonb - 1 AS i FROM events""", """SELECT event_id, '{"b":2}' AS j, '["x","z"]' AS i FROM events""")
q("jsn_typeof", '''SELECT json_typeof(j) AS kind FROM (VALUES ('[1]'), ('{"a":1}'), ('"s"'), ('true'), ('null'), ('7'), ('7.5')) AS v(j)''', "SELECT kind FROM (VALUES ('array'), ('object'), ('string'), ('boolean'), ('null'), ('number'), ('number')) AS v(kind)")
q("jsn_invalid_is_null", "SELECT '{oops'::json IS NULL AS bad, props::json IS NULL AS fine FROM events", "SELECT TRUE AS bad, FALSE AS fine FROM events")
