"""Statements that change tables, constraints, transactions, definitions and sessions. Each query returns the state after them."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tarn.engine import ConstraintError, Database
from tarn.plans.registry import register, register_steps
from tarn.sources.store import Conflict

_NATION = "CREATE TABLE n(id BIGINT PRIMARY KEY, name TEXT NOT NULL, region INT); INSERT INTO n SELECT n_nationkey, n_name, n_regionkey FROM nation;"
_ROWS = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, n_regionkey AS region FROM nation"
_PARTS = "CREATE TABLE kinds(size INT PRIMARY KEY, label TEXT); INSERT INTO kinds SELECT DISTINCT p_size, 'size ' || p_size::text FROM part; CREATE TABLE items(id BIGINT PRIMARY KEY, size INT DEFAULT 7 REFERENCES kinds(size) {}); INSERT INTO items SELECT p_partkey, p_size FROM part;"


def outcomes(db: Database, statements: Sequence[str]) -> DataFrame:
    """(place, outcome) of statements that each may fail: done, or the error's text."""
    found = []
    for k, text in enumerate(statements):
        try:
            db.exec(text)
            found.append((k, "done"))
        except (ConstraintError, Conflict, ValueError) as problem:
            found.append((k, str(problem)))
    return db.spark.createDataFrame(found, "place int, outcome string")


def _listed(*texts: str) -> str:
    return "SELECT CAST(k AS INTEGER) AS place, o AS outcome FROM (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in enumerate(texts)) + ") AS v(k, o)"


# rows
register("dml_insert", "SELECT id, name, region FROM n", f"{_ROWS} UNION ALL VALUES (100, 'x', NULL), (101, 'y', NULL)", before=_NATION + "INSERT INTO n(id, name) VALUES (100, 'x'), (101, 'y')")
register("dml_insert_select", "SELECT id, name, region FROM n", f"WITH n AS ({_ROWS}) SELECT * FROM n UNION ALL SELECT id + 100, lower(name), region FROM n WHERE region = 1", before=_NATION + "INSERT INTO n SELECT id + 100, lower(name), region FROM n WHERE region = 1")
register("dml_defaults", "SELECT id, v, n, twice FROM s", "SELECT * FROM (VALUES (1, 'd', 1, 2), (2, 'd', 2, 4), (3, 'd', 3, 6), (4, 'x', 4, 8)) AS t(id, v, n, twice)", before="CREATE TABLE s(id SERIAL, v TEXT DEFAULT 'd', n INT, twice INT GENERATED ALWAYS AS (n * 2) STORED); INSERT INTO s(n) VALUES (1), (2); INSERT INTO s(v, n) VALUES (DEFAULT, 3), ('x', 4)")
register("dml_serial_given", "SELECT id, v FROM s", "SELECT * FROM (VALUES (40, 'given'), (1, 'first'), (2, 'default'), (41, 'also given'), (3, 'last')) AS t(id, v)", before="CREATE TABLE s(id SERIAL, v TEXT); INSERT INTO s VALUES (40, 'given'); INSERT INTO s(v) VALUES ('first'); INSERT INTO s VALUES (DEFAULT, 'default'), (41, 'also given'); INSERT INTO s(v) VALUES ('last')")
register("dml_on_conflict_nothing", "SELECT id, region FROM n", f"SELECT id, region FROM ({_ROWS}) UNION ALL SELECT 200, 9", before=_NATION + "INSERT INTO n VALUES (3, 'again', 9), (200, 'new', 9), (200, 'newer', 8) ON CONFLICT (id) DO NOTHING")
register("dml_on_conflict_first", "SELECT k, o FROM f", "SELECT o_custkey AS k, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o FROM orders GROUP BY o_custkey", before="CREATE TABLE f(k BIGINT PRIMARY KEY, o BIGINT); INSERT INTO f SELECT o_custkey, o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey ON CONFLICT DO NOTHING")
register("dml_on_conflict_update", "SELECT id, name, region FROM n", f"WITH n AS ({_ROWS}) SELECT id, CASE WHEN id >= 20 THEN 'new' ELSE name END AS name, CASE WHEN id >= 20 THEN region + 7 ELSE region END AS region FROM n UNION ALL SELECT id + 20, 'new', 7 FROM n WHERE id >= 5", before=_NATION + "INSERT INTO n SELECT id + 20, 'new', 7 FROM n ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name, region = n.region + EXCLUDED.region")
register("dml_update", "SELECT id, name, region FROM n", f"SELECT id, CASE WHEN region < 2 THEN upper(name) || '!' ELSE name END AS name, CASE WHEN region < 2 THEN region + 10 ELSE region END AS region FROM ({_ROWS})", before=_NATION + "UPDATE n SET region = region + 10, name = upper(name) || '!' WHERE region < 2")
register("dml_update_from", "SELECT id, name, region FROM n", f"SELECT id, CASE WHEN region > 2 THEN r_name ELSE name END AS name, region FROM ({_ROWS}) JOIN region ON r_regionkey = region", before=_NATION + "UPDATE n SET name = r.r_name FROM region r WHERE r.r_regionkey = n.region AND r.r_regionkey > 2")
register("dml_update_from_first", "SELECT id, name FROM n", "SELECT CAST(n_nationkey AS BIGINT) AS id, coalesce((SELECT arg_min(c_name, (-c_acctbal, c_custkey)) FROM customer WHERE c_nationkey = n_nationkey), n_name) AS name FROM nation", before=_NATION + "CREATE TABLE c(k BIGINT, name TEXT); INSERT INTO c SELECT c_nationkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey; UPDATE n SET name = c.name FROM c WHERE c.k = n.id")
register("dml_delete", "SELECT id, name, region FROM n", f"SELECT * FROM ({_ROWS}) WHERE NOT (region IN (1, 2) OR name LIKE '%7')", before=_NATION + "DELETE FROM n WHERE region IN (1, 2) OR name LIKE '%7'")
register("dml_delete_using", "SELECT id FROM n", "SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)", before=_NATION + "DELETE FROM n USING supplier s WHERE s.s_nationkey = n.id AND s.s_acctbal > 5000")
register("dml_truncate", "SELECT count(*) AS n, max(id) AS next FROM s", "SELECT CAST(1 AS BIGINT) AS n, 1 AS next", before="CREATE TABLE s(id SERIAL, v TEXT); INSERT INTO s(v) SELECT n_name FROM nation; TRUNCATE TABLE s RESTART IDENTITY; INSERT INTO s(v) VALUES ('again')")


def _returning(db: Database) -> DataFrame:
    db.exec(_NATION)
    made = [("insert", r) for r in db.query("INSERT INTO n VALUES (300, 'a', 1), (301, 'b', 2) RETURNING id, name || '!' AS loud")]
    made += [("update", r) for r in db.query("UPDATE n SET region = region + 1 WHERE id >= 300 RETURNING id, region::text AS loud")]
    made += [("delete", r) for r in db.query("DELETE FROM n WHERE id > 300 OR region = 0 RETURNING id, name AS loud")]
    made += [("insert", r) for r in db.query("INSERT INTO n VALUES (300, 'c', 1), (302, 'd', 2) ON CONFLICT (id) DO UPDATE SET name = n.name || EXCLUDED.name RETURNING id, name AS loud")]
    return db.spark.createDataFrame([(kind, r["id"], r["loud"]) for kind, r in made], "kind string, id long, loud string")


register_steps("dml_returning", _returning, _NATION, "SELECT * FROM (VALUES ('insert', 300, 'a!'), ('insert', 301, 'b!'), ('update', 300, '2'), ('update', 301, '3'), ('delete', 301, 'b'), ('insert', 300, 'ac'), ('insert', 302, 'd')) AS v(kind, id, loud) UNION ALL SELECT 'delete', n_nationkey, n_name FROM nation WHERE n_regionkey = 0")

# constraints
register("fk_cascade", "SELECT id, size FROM items", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_size <= 20", before=_PARTS.format("ON DELETE CASCADE") + "DELETE FROM kinds WHERE size > 20")
register("fk_set_null", "SELECT id, size FROM items", "SELECT p_partkey AS id, CASE WHEN p_size <= 20 THEN p_size END AS size FROM part", before=_PARTS.format("ON DELETE SET NULL") + "DELETE FROM kinds WHERE size > 20")
register("fk_set_default", "SELECT id, size FROM items", "SELECT p_partkey AS id, CASE WHEN p_size <= 20 THEN p_size ELSE 7 END AS size FROM part", before=_PARTS.format("ON DELETE SET DEFAULT") + "INSERT INTO kinds VALUES (7, 'seven') ON CONFLICT DO NOTHING; DELETE FROM kinds WHERE size > 20")
register("fk_update_cascade", "SELECT i.id, i.size, k.label FROM items i JOIN kinds k ON k.size = i.size", "SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN p_size + 100 ELSE p_size END AS size, 'size ' || p_size AS label FROM part", before=_PARTS.format("ON UPDATE CASCADE") + "UPDATE kinds SET size = size + 100 WHERE size > 20")
register("fk_update_set_null", "SELECT id, size FROM items", "SELECT p_partkey AS id, CASE WHEN p_size <= 20 THEN p_size END AS size FROM part", before=_PARTS.format("ON UPDATE SET NULL") + "UPDATE kinds SET size = size + 100 WHERE size > 20")
register("fk_update_chain", "SELECT x.id, x.size FROM x", "SELECT p_partkey AS id, p_size + 1000 AS size FROM part", before=_PARTS.format("ON UPDATE CASCADE, UNIQUE (id, size)") + "CREATE TABLE x(id BIGINT, size INT, FOREIGN KEY (id, size) REFERENCES items(id, size) ON UPDATE CASCADE); INSERT INTO x SELECT id, size FROM items; UPDATE kinds SET size = size + 1000")
register_steps(
    "con_errors",
    lambda db: outcomes(db, [
        "CREATE TABLE t(id INT PRIMARY KEY, code TEXT UNIQUE, name TEXT NOT NULL, n INT CHECK (n < 10), a INT, b INT, UNIQUE (a, b))",
        "INSERT INTO t VALUES (1, 'x', 'one', 1, 1, 1)", "INSERT INTO t VALUES (NULL, 'y', 'two', 1, 1, 2)", "INSERT INTO t VALUES (1, 'y', 'two', 1, 1, 2)", "INSERT INTO t VALUES (2, 'x', 'two', 1, 1, 2)",
        "INSERT INTO t VALUES (2, 'y', NULL, 1, 1, 2)", "INSERT INTO t VALUES (2, 'y', 'two', 10, 1, 2)", "INSERT INTO t VALUES (2, 'y', 'two', 1, 1, 1)", "INSERT INTO t VALUES (2, NULL, 'two', NULL, NULL, 1), (3, NULL, 'three', 1, NULL, 1)",
        "CREATE TABLE c(t INT REFERENCES t, u INT, FOREIGN KEY (u) REFERENCES t(id))", "INSERT INTO c VALUES (1, 2), (NULL, 3)", "INSERT INTO c VALUES (9, 1)", "INSERT INTO c VALUES (1, 9)", "DELETE FROM t WHERE id = 1", "UPDATE t SET id = 8 WHERE id = 2", "TRUNCATE t", "TRUNCATE t CASCADE",
    ]),
    "",
    _listed(
        "done", "done", "Constraint Error: id cannot be null", "Constraint Error: id must be unique", "Constraint Error: code must be unique", "Constraint Error: name cannot be null", "Constraint Error: check t_n_check is violated", "Constraint Error: a, b must be unique", "done",
        "done", "done", "Foreign Key Violation (Insert): t of c is not in t", "Foreign Key Violation (Insert): u of c is not in t", "Foreign Key Violation (Delete): c refers to t", "Foreign Key Violation (Update): c refers to t", "Foreign Key Violation (Truncate): c refers to a table to be emptied", "done",
    ),
)
register("con_composite_key", "SELECT o, l, q FROM c", "SELECT l_orderkey AS o, l_linenumber AS l, max(l_quantity) AS q FROM lineitem GROUP BY ALL", before="CREATE TABLE c(o BIGINT, l INT, q DOUBLE PRECISION, PRIMARY KEY (o, l)); INSERT INTO c SELECT l_orderkey, l_linenumber, max(l_quantity) FROM lineitem GROUP BY l_orderkey, l_linenumber; INSERT INTO c SELECT l_orderkey, l_linenumber, -1 FROM lineitem ON CONFLICT (o, l) DO NOTHING")
register("con_generated", "SELECT k, whole FROM g", "SELECT o_orderkey AS k, CAST(floor(o_totalprice + 1) AS DOUBLE) AS whole FROM orders", before="CREATE TABLE g(k BIGINT, price DOUBLE PRECISION, whole DOUBLE PRECISION GENERATED ALWAYS AS (floor(price)) STORED); INSERT INTO g(k, price) SELECT o_orderkey, o_totalprice FROM orders; UPDATE g SET price = price + 1")

# transactions
register("txn_rollback", "SELECT id, name, region FROM n", _ROWS, before=_NATION + "BEGIN; DELETE FROM n; ROLLBACK")
register("txn_commit", "SELECT id, region FROM n", f"SELECT id, 0 AS region FROM ({_ROWS}) WHERE id <= 3", before=_NATION + "BEGIN; DELETE FROM n WHERE id > 3; UPDATE n SET region = 0; COMMIT")


def _atomic(db: Database) -> DataFrame:
    db.exec(_NATION)
    for text in ("INSERT INTO n SELECT id + 10, name, region FROM n", "UPDATE n SET id = 5 WHERE region = 1", "INSERT INTO n VALUES (500, 'fine', 1), (501, NULL, 1)"):
        try:
            db.exec(text)
        except ConstraintError:
            continue
    try:
        with db.transaction() as t:
            t.exec("DELETE FROM n WHERE id > 3")
            t.exec("INSERT INTO n VALUES (1, 'twice', 1)")
    except ConstraintError:
        pass
    with db.transaction() as t:
        t.exec("DELETE FROM n WHERE id > 20")
    return db.df("SELECT id, name FROM n")


register_steps("txn_atomicity", _atomic, _NATION, "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation WHERE n_nationkey <= 20")


def _two_connections(db: Database) -> DataFrame:
    """Another connection sees what is committed only, and of two that start from one state the second fails."""
    other = Database(db.spark, db.store.root)
    found = []
    db.exec("CREATE TABLE t(id INT); INSERT INTO t VALUES (1)")
    count = lambda d: d.query("SELECT count(*) AS n FROM t")[0]["n"]
    found.append(("committed", count(other)))
    db.exec("BEGIN; INSERT INTO t VALUES (2)")
    found += [("inside", count(db)), ("outside", count(other))]
    db.exec("COMMIT")
    found.append(("after", count(other)))
    late = db.store.load("main")
    other.exec("INSERT INTO t VALUES (3)")
    try:
        db.store.save("main", late)
        found.append(("lost", 1))
    except Conflict:
        found.append(("refused", count(db)))
    db.exec("BEGIN; DELETE FROM t")
    db.close()
    found += [("closed", count(other)), ("vacuumed", int(other.vacuum() >= 0)), ("left", count(Database(db.spark, db.store.root)))]
    other.close(destroy=True)
    found.append(("destroyed", len(other.query("SELECT table_name FROM information_schema.tables"))))
    return db.spark.createDataFrame(found, "what string, n long")


register_steps("ses_connections", _two_connections, "", "SELECT * FROM (VALUES ('committed', 1), ('inside', 2), ('outside', 1), ('after', 2), ('refused', 3), ('closed', 3), ('vacuumed', 1), ('left', 3), ('destroyed', 0)) AS v(what, n)")

# definitions
register("alter_table", "SELECT id, label, extra FROM n", f"SELECT id, name AS label, 5 AS extra FROM ({_ROWS})", before=_NATION + "ALTER TABLE n ADD COLUMN extra INT DEFAULT 5, RENAME COLUMN name TO label, DROP COLUMN region")
register("alter_types", "SELECT id, region, name FROM m", f"SELECT CAST(id AS VARCHAR) AS id, CAST(region * 2 AS BIGINT) AS region, 'none' AS name FROM ({_ROWS}) WHERE id = 4 UNION ALL SELECT '77', NULL, 'none'", before=_NATION + "DELETE FROM n WHERE id <> 4; ALTER TABLE n RENAME TO m; ALTER TABLE m ALTER COLUMN id TYPE TEXT; ALTER TABLE m ALTER COLUMN region SET DATA TYPE BIGINT USING region * 2; ALTER TABLE m ALTER COLUMN name SET DEFAULT 'none', ALTER COLUMN name DROP NOT NULL; UPDATE m SET name = DEFAULT; INSERT INTO m(id) VALUES (77)")
register_steps(
    "ddl_outcomes",
    lambda db: outcomes(db, [
        "CREATE SCHEMA s1", "CREATE SCHEMA s1", "CREATE SCHEMA IF NOT EXISTS s1", "CREATE TABLE s1.t(a INT)", "INSERT INTO s1.t VALUES (1)", "CREATE TABLE s2.t(a INT)", "DROP SCHEMA s1", "DROP SCHEMA s1 CASCADE", "SELECT * FROM s1.t", "DROP SCHEMA public",
        "CREATE TABLE d(a INT)", "CREATE TABLE d(a INT)", "CREATE TABLE IF NOT EXISTS d(a INT)", "CREATE INDEX i ON d(a)", "CREATE INDEX i ON d(a)", "CREATE UNIQUE INDEX u ON d USING btree (a DESC) WHERE a > 0", "INSERT INTO d VALUES (1), (1)", "DROP INDEX u", "INSERT INTO d VALUES (1), (1)", "DROP INDEX u", "DROP INDEX IF EXISTS u, i",
        "DROP TABLE d, d2", "DROP TABLE IF EXISTS d, d2", "SELECT * FROM d", "CREATE TYPE mood AS ENUM ('calm', 'glad')", "CREATE TABLE e(m mood)", "INSERT INTO e VALUES ('calm')", "INSERT INTO e VALUES ('angry')", "ALTER TYPE mood ADD VALUE 'angry'", "INSERT INTO e VALUES ('angry')", "DROP TYPE mood2", "DROP TYPE IF EXISTS mood2",
        "DROP VIEW IF EXISTS v; DROP SEQUENCE q; DROP EXTENSION x CASCADE", "DO $$ BEGIN IF NOT EXISTS (SELECT 1 FROM information_schema.tables WHERE table_name = 'made') THEN CREATE TABLE made(a INT); END IF; END $$", "INSERT INTO made VALUES (1)", "TABLES e",
    ]),
    "",
    _listed(
        "done", "schema s1 already exists", "done", "done", "done", "schema s2 does not exist", "schema s1 is not empty", "done", "relation s1.t does not exist", "schema public can''t be dropped",
        "done", "relation d already exists", "done", "done", "index i already exists", "done", "Constraint Error: a must be unique", "done", "done", "index u does not exist", "done",
        "relation d2 does not exist", "done", "relation d does not exist", "done", "done", "done", "Constraint Error: invalid value for m", "done", "done", "type mood2 does not exist", "done",
        "done", "done", "done", "unknown statement ''TABLES e''",
    ),
)
register("ddl_create_as", "SELECT k, n FROM t", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey", before="CREATE TABLE t AS SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey")
register("ddl_add_unchecked_key", "SELECT r FROM c", "SELECT 99 AS r UNION ALL SELECT 1", before="CREATE TABLE p(id INT PRIMARY KEY); INSERT INTO p VALUES (1); CREATE TABLE c(r INT); INSERT INTO c VALUES (99); ALTER TABLE c ADD CONSTRAINT to_p FOREIGN KEY (r) REFERENCES p(id); INSERT INTO c VALUES (1)")
register("info_schema_columns", "SELECT column_name, ordinal_position, is_nullable FROM information_schema.columns WHERE table_name = 'n'", "SELECT * FROM (VALUES ('id', 1, 'NO'), ('name', 2, 'NO'), ('region', 3, 'YES')) AS t(column_name, ordinal_position, is_nullable)", before=_NATION)
register("info_schema_rules", "SELECT r.constraint_name, r.update_rule, r.delete_rule, t.table_name, t.constraint_type FROM information_schema.referential_constraints r JOIN information_schema.table_constraints t ON t.constraint_name = r.constraint_name", "SELECT 'items_size_fkey' AS constraint_name, 'CASCADE' AS update_rule, 'SET NULL' AS delete_rule, 'items' AS table_name, 'FOREIGN KEY' AS constraint_type", before=_PARTS.format("ON DELETE SET NULL ON UPDATE CASCADE"))
register("info_schema_tables", "SELECT t.table_schema, t.table_name, s.schema_name IS NOT NULL AS listed FROM information_schema.tables t LEFT JOIN information_schema.schemata s ON s.schema_name = t.table_schema", "SELECT * FROM (VALUES ('public', 'n', TRUE), ('extra', 'm', TRUE)) AS t(table_schema, table_name, listed)", before=_NATION + "CREATE SCHEMA extra; CREATE TABLE extra.m(a INT)")
register("catalog_comments", "SELECT obj_description('n'::regclass) AS t, col_description('n'::regclass, 2) AS c, col_description('n'::regclass, 3) AS none", "SELECT 'nations' AS t, 'label' AS c, CAST(NULL AS VARCHAR) AS none", before=_NATION + "COMMENT ON TABLE n IS 'nations'; COMMENT ON COLUMN n.name IS 'label'; COMMENT ON COLUMN n.region IS 'x'; COMMENT ON COLUMN n.region IS NULL")
register("catalog_attributes", "SELECT c.relname, a.attname, a.attnum, a.attnotnull, format_type(a.atttypid, NULL) AS type, pg_get_expr(d.adbin, d.adrelid) AS made FROM pg_class c JOIN pg_attribute a ON a.attrelid = c.oid LEFT JOIN pg_attrdef d ON d.adrelid = c.oid AND d.adnum = a.attnum JOIN pg_namespace n ON n.oid = c.relnamespace WHERE n.nspname = 'public' AND c.relkind = 'r'", "SELECT * FROM (VALUES ('k', 'id', 1, TRUE, 'bigint', NULL), ('k', 'v', 2, FALSE, 'text', NULL), ('k', 'n', 3, FALSE, 'int', '7')) AS t(relname, attname, attnum, attnotnull, type, made)", before="CREATE TABLE k(id BIGINT PRIMARY KEY, v TEXT, n INT DEFAULT 7)")
register("catalog_indexes", "SELECT c.relname, i.relname AS index, x.indisunique, x.indisprimary, x.indkey FROM pg_index x JOIN pg_class c ON c.oid = x.indrelid JOIN pg_class i ON i.oid = x.indexrelid AND i.relkind = 'i'", "SELECT * FROM (VALUES ('k', 'k_pkey', TRUE, TRUE, '1'), ('k', 'k_v_key', TRUE, FALSE, '2'), ('k', 'plain', FALSE, FALSE, '3 2')) AS t(relname, index, indisunique, indisprimary, indkey)", before="CREATE TABLE k(id BIGINT PRIMARY KEY, v TEXT UNIQUE, n INT); CREATE INDEX plain ON k(n, v)")
register("catalog_constraints", "SELECT p.conname, p.contype, c.relname, f.relname AS to, p.conkey, p.confkey FROM pg_constraint p JOIN pg_class c ON c.oid = p.conrelid LEFT JOIN pg_class f ON f.oid = p.confrelid", "SELECT * FROM (VALUES ('kinds_pkey', 'p', 'kinds', NULL, '1', NULL), ('items_pkey', 'p', 'items', NULL, '1', NULL), ('items_size_fkey', 'f', 'items', 'kinds', '2', '1')) AS t(conname, contype, relname, \"to\", conkey, confkey)", before=_PARTS.format(""))
register("catalog_types", "SELECT t.typname, e.enumlabel, e.enumsortorder, t.oid = 'mood'::regtype AS by_name, 'public'::regnamespace = n.oid AS home FROM pg_type t JOIN pg_enum e ON e.enumtypid = t.oid JOIN pg_namespace n ON n.nspname = 'public'", "SELECT * FROM (VALUES ('mood', 'calm', 1, TRUE, TRUE), ('mood', 'glad', 2, TRUE, TRUE)) AS t(typname, enumlabel, enumsortorder, by_name, home)", before="CREATE TYPE other AS ENUM (); CREATE TYPE mood AS ENUM ('calm', 'glad')")

# queries that only the dialect has
register("cte_recursive_union", "WITH RECURSIVE c(x) AS (SELECT 1 UNION SELECT (x * 2) % 31 FROM c) SELECT x FROM c", "WITH RECURSIVE c(x) AS (SELECT 1 UNION SELECT (x * 2) % 31 FROM c) SELECT x FROM c")
register("dialect_distinct_on", "SELECT DISTINCT ON (l_suppkey, l_returnflag) l_suppkey, l_returnflag, l_orderkey FROM lineitem ORDER BY l_suppkey, l_returnflag, l_extendedprice DESC, l_orderkey")
register("dialect_ordered_agg", "SELECT n_regionkey, STRING_AGG(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY n_regionkey")
register("dialect_quantified", "SELECT p_partkey, p_size > ALL (SELECT n_regionkey FROM nation) AS every_one, 3 <= ANY (SELECT r_regionkey FROM region) AS some, p_size = ANY (ARRAY[1, 2, 3]) AS listed FROM part", "SELECT p_partkey, p_size > (SELECT max(n_regionkey) FROM nation) AS every_one, TRUE AS some, p_size IN (1, 2, 3) AS listed FROM part")
register("dialect_quantified_filter", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_acctbal < 5000) AND c_nationkey <> ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)", "SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT max(s_acctbal) FROM supplier WHERE s_acctbal < 5000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
register("dialect_json_path", "SELECT event_id, (props::jsonb->>'k')::bigint AS k FROM events WHERE props::jsonb @> '{\"k\": 5}'", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM events WHERE props ->> '$.k' = '5'")
register("dialect_json_contains", "SELECT event_id, json_build_object('u', user_id % 3, 'in', json_build_object('t', event_type, 'l', json_build_array(1, event_id % 2))) @> '{\"u\": 1, \"in\": {\"l\": [1]}}' AS has FROM events", "SELECT event_id, user_id % 3 = 1 AS has FROM events")
register("dialect_age", "SELECT event_id, AGE(ts, '2023-06-15 00:00:00'::timestamp) AS a, AGE(ts, ts) AS b FROM events", """WITH a AS (SELECT event_id, ts AS h, TIMESTAMP '2023-06-15' AS l FROM events), d AS (SELECT event_id, (year(h) - year(l)) * 12 + month(h) - month(l) - CAST(day(h) < day(l) AS INTEGER) AS m,
day(h) - day(l) + CASE WHEN day(h) < day(l) THEN day(date_trunc('month', h) - INTERVAL 1 DAY) ELSE 0 END AS d FROM a)
SELECT event_id, concat_ws(' ', CASE m // 12 WHEN 0 THEN NULL WHEN 1 THEN '1 year' ELSE m // 12 || ' years' END, CASE m % 12 WHEN 0 THEN NULL WHEN 1 THEN '1 month' ELSE m % 12 || ' months' END, CASE d WHEN 0 THEN NULL WHEN 1 THEN '1 day' ELSE d || ' days' END) AS a, '0 days' AS b FROM d""")
register("lateral_topk_widths", "SELECT n.n_nationkey, t.c_custkey FROM nation n JOIN LATERAL (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey::bigint = n.n_nationkey::int ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 2) t ON TRUE", "SELECT n_nationkey, c_custkey FROM nation JOIN (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) ON c_nationkey = n_nationkey AND rn <= 2")
for _name, _sql, _value in (
    ("jsn_set", "jsonb_set(json_build_object('k', event_id, 'in', json_build_object('t', event_type)), '{in,v}', '[8]')", "json_object('k', event_id, 'in', json_object('t', event_type, 'v', json_array(8)))"),
    ("jsn_insert", "jsonb_insert(json_build_array(event_id, user_id), '{1}', '\"mid\"')", "json_array(event_id, 'mid', user_id)"),
    ("jsn_delete_path", "json_build_object('k', json_build_object('a', event_id, 'b', user_id)) #- '{k,b}'", "json_object('k', json_object('a', event_id))"),
    ("jsn_strip_nulls", "jsonb_strip_nulls(json_build_object('u', nullif(user_id % 2, 0), 'k', event_id))", "CASE WHEN user_id % 2 = 1 THEN json_object('u', 1, 'k', event_id) ELSE json_object('k', event_id) END"),
    ("jsn_object_of", "jsonb_build_object('id', event_id, 'type', event_type, 'props', props::jsonb)", "json_object('id', event_id, 'type', event_type, 'props', json_object('k', CAST(props ->> '$.k' AS BIGINT)))"),
    ("jsn_concat", "json_build_object('id', event_id, 'k', 0) || props::jsonb", "json_object('id', event_id, 'k', CAST(props ->> '$.k' AS BIGINT))"),
    ("jsn_concat_arrays", "json_build_array(event_id) || json_build_array(user_id, event_type)", "json_array(event_id, user_id, event_type)"),
    ("jsn_extract", "json_extract(json_build_object('a', json_build_object('b', json_build_array(event_id, user_id))), 'a', 'b')", "json_array(event_id, user_id)"),
):
    register(_name, f"SELECT event_id, {_sql} AS v FROM events", f"SELECT event_id, CAST({_value} AS VARCHAR) AS v FROM events")
register("jsn_pretty", "SELECT event_id, jsonb_pretty(json_build_object('id', event_id)) AS v FROM events", "SELECT event_id, '{' || chr(10) || '  \"id\": ' || event_id || chr(10) || '}' AS v FROM events")

# parameters, names and literals
register("param_numbered", "SELECT o_orderkey FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2 AND o_custkey IN ($3, 2, 3)", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' AND o_custkey IN (1, 2, 3)", params=[1000, "F", 1])
register("param_named", "SELECT n_name, :tag AS tag FROM nation WHERE n_regionkey = :r AND n_name <> :tag", "SELECT n_name, 'it''s' AS tag FROM nation WHERE n_regionkey = 2", params={"r": 2, "tag": "it's"})
register("param_list_and_dates", "SELECT o_orderkey FROM orders WHERE o_custkey IN ($1) AND o_orderdate >= $2 AND o_orderdate < $3", "SELECT o_orderkey FROM orders WHERE o_custkey IN (5, 6, 7) AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < DATE '1999-01-01'", params=[[5, 6, 7], datetime.datetime(1994, 1, 1), datetime.date(1999, 1, 1)])
register("param_cast", "SELECT o_orderkey FROM orders WHERE o_custkey = $1::int AND o_totalprice > $2", "SELECT o_orderkey FROM orders WHERE o_custkey = 9 AND o_totalprice > 500", params=["9", 500.0])
register("param_column", "SELECT n.n_name, $1 AS region FROM nation n JOIN region r ON $2 = $3", "SELECT n.n_name, r.r_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", params=["r.r_name", "n.n_regionkey", "r.r_regionkey"])
register("quoted_word_text", 'SELECT n_name, "plain" AS p FROM nation WHERE "n_regionkey" = 1 AND n_name <> "NATION_1"', "SELECT n_name, 'plain' AS p FROM nation WHERE n_regionkey = 1 AND n_name <> 'NATION_1'")
register("lex_names_and_literals", """SELECT n_name AS "Case Kept", N_NationKey AS type, $$it's$$ AS dollar, $q$a $$ b$q$ AS tagged, 'it''s' AS quote, 'ü–漢😀' AS wide, 1e3 AS big, .5 AS half, 12.0 AS dot -- a comment
FROM nation /* another; one */ WHERE n_regionkey >= 0""", """SELECT n_name AS "Case Kept", n_nationkey AS type, 'it''s' AS dollar, 'a $$ b' AS tagged, 'it''s' AS quote, 'ü–漢😀' AS wide, CAST(1000 AS DOUBLE) AS big, CAST(0.5 AS DOUBLE) AS half, CAST(12 AS DOUBLE) AS dot FROM nation""")
register("lex_keyword_columns", 'SELECT k.order_, k.text, k.key, k."group" FROM k', "SELECT n_nationkey AS order_, n_name AS text, n_regionkey AS key, 1 AS \"group\" FROM nation", before='CREATE TABLE k(order_ INT, text TEXT, key INT, "group" INT); INSERT INTO k SELECT n_nationkey, n_name, n_regionkey, 1 FROM nation')


def _sessions(db: Database) -> DataFrame:
    """Names of databases, several results at once, fields of no rows, and a bare identifier that begins with digits."""
    db.exec("CREATE TABLE t(id TEXT); INSERT INTO t VALUES ('1f-2'), ('x')", db="second")
    several = db.query2("SELECT 1 AS a; SELECT id FROM t WHERE id = 'none'; SELECT id AS b FROM t", db="second")
    found = [("main", len(db.query("SELECT table_name FROM information_schema.tables"))), ("second", len(db.query("SELECT id FROM t", db="second")))]
    found += [(f"result {k}: {','.join(r.fields)}", r.row_count) for k, r in enumerate(several)]
    db.destroy("second")
    found.append(("destroyed", len(db.query("SELECT table_name FROM information_schema.tables", db="second"))))
    return db.spark.createDataFrame(found, "what string, n long")


register_steps("ses_results", _sessions, "", "SELECT * FROM (VALUES ('main', 0), ('second', 2), ('result 0: a', 1), ('result 1: id', 0), ('result 2: b', 2), ('destroyed', 0)) AS v(what, n)")
