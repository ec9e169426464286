"""Queries and statements of the dialect on small tables, with the results that the dialect promises."""

from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tarn.dialect.lexer import SqlError, tokens
from tarn.dialect.translate import translate
from tarn.engine import ConstraintError, Database
from tarn.sources.store import Conflict, scratch, short


@pytest.fixture(scope="module")
def db(spark, tmp_path_factory):
    made = Database(spark, f"file://{tmp_path_factory.mktemp('db')}")
    made.exec("""
        CREATE TABLE ships(id SERIAL PRIMARY KEY, name TEXT NOT NULL, crew INT);
        INSERT INTO ships(name, crew) VALUES ('Heron', 12), ('Osprey', 31), ('Tern', 7);
        CREATE TABLE calls(id SERIAL PRIMARY KEY, port TEXT, ship INT);
        INSERT INTO calls(port, ship) VALUES ('Bergen', 1), ('Aarhus', 1), ('Tallinn', 2), ('Gdansk', 77);
        CREATE TABLE gauges(station TEXT, river TEXT, level INT);
        INSERT INTO gauges VALUES ('g1','Elbe',310),('g2','Elbe',355),('g3','Oder',120),('g4','Elbe',310),('g5','Oder',120);
        CREATE TABLE loads(kind TEXT, tons INT);
        INSERT INTO loads VALUES ('ore',15),('ore',40),('grain',22),('grain',9),('ore',8)""")
    return made


def rows(db, sql, params=None):
    return [tuple(r.values()) for r in db.query(sql, params)]


def plan(db, sql):
    return db.df(sql)._jdf.queryExecution().toString()


def test_order_limit_offset(db):
    assert rows(db, "SELECT name FROM ships ORDER BY crew DESC LIMIT 2 OFFSET 1") == [("Heron",), ("Tern",)]


def test_joins(db):
    found = set(rows(db, "SELECT c.port, s.name FROM ships s RIGHT JOIN calls c ON s.id = c.ship"))
    assert found == {("Bergen", "Heron"), ("Aarhus", "Heron"), ("Tallinn", "Osprey"), ("Gdansk", None)}
    assert len(rows(db, "SELECT s.id AS a, c.id AS b FROM ships s FULL OUTER JOIN calls c ON s.id = c.ship")) == 5
    assert len(rows(db, "SELECT s.name, c.port FROM ships s, calls c")) == 12
    assert rows(db, "SELECT count(*) FROM ships s JOIN calls c") == [(12,)]


def test_grouping(db):
    assert rows(db, "SELECT ship, COUNT(id) FROM calls GROUP BY ship HAVING COUNT(id) > 1") == [(1, 2)]
    assert rows(db, "SELECT ARRAY_AGG(port ORDER BY port) FROM calls WHERE ship = 1") == [(["Aarhus", "Bergen"],)]
    assert rows(db, "SELECT COUNT(*) FILTER (WHERE kind = 'ore'), ARRAY_AGG(tons ORDER BY tons) FILTER (WHERE kind = 'grain') FROM loads") == [(3, [9, 22])]
    assert rows(db, "SELECT SUM(tons), COUNT(DISTINCT kind) FROM loads WHERE tons < 0") == [(None, 0)]


def test_filter_reaches_every_aggregate(db):
    deep = "upper(trim(concat(lower(replace(kind, 'o', 'o')), '(')))"
    assert rows(db, f"SELECT ARRAY_AGG({deep}) FILTER (WHERE kind = 'grain') FROM loads") == [(["GRAIN(", "GRAIN("],)]
    assert rows(db, f"SELECT STRING_AGG({deep}, ')' ORDER BY tons DESC) FILTER (WHERE kind <> 'ore' AND tons > 10) FROM loads") == [("GRAIN(",)]
    assert rows(db, "SELECT JSON_AGG(tons ORDER BY tons) FILTER (WHERE tons < 10) FROM loads") == [("[8,9]",)]
    with pytest.raises(SqlError, match="takes no FILTER"):
        db.query("SELECT concat(kind, 'x') FILTER (WHERE tons > 1) FROM loads")


def test_string_agg_of_no_value_is_null(db):
    ordered = "STRING_AGG(kind, ',' ORDER BY tons) FILTER (WHERE tons > 20)"
    assert set(rows(db, f"SELECT kind, {ordered}, STRING_AGG(kind, ',') FILTER (WHERE tons > 30) FROM loads GROUP BY kind")) == {("ore", "ore", "ore"), ("grain", "grain", None)}
    assert rows(db, f"SELECT {ordered}, STRING_AGG(kind, ',') FROM loads WHERE tons < 0") == [(None, None)]
    nulls = "(VALUES (1, NULL), (2, NULL), (3, ''), (4, 'a'), (4, NULL)) AS t(k, x)"
    assert rows(db, f"SELECT k, STRING_AGG(x, '-'), STRING_AGG(x, '-' ORDER BY x), STRING_AGG(DISTINCT x, '-' ORDER BY x) FROM {nulls} GROUP BY k ORDER BY k") == [(1, None, None, None), (2, None, None, None), (3, "", "", ""), (4, "a", "a", "a")]
    assert rows(db, "SELECT STRING_AGG(tons, '+' ORDER BY tons) FROM loads") == [("8+9+15+22+40",)]


def test_columns_beside_groups(db):
    assert set(rows(db, "SELECT s.id, s.name, upper(s.name), COUNT(c.id), (SELECT COUNT(*) FROM calls x WHERE x.ship = s.id) FROM ships s LEFT JOIN calls c ON c.ship = s.id GROUP BY s.id HAVING COUNT(c.id) > 0")) == {(1, "Heron", "HERON", 2, 2), (2, "Osprey", "OSPREY", 1, 1)}
    assert sorted(rows(db, "SELECT tons % 2, count(*), max(tons) - min(tons) FROM loads GROUP BY tons % 2")) == [(0, 3, 32), (1, 2, 6)]
    assert sorted(rows(db, "SELECT kind AS k, tons > 0, sum(tons) FROM loads GROUP BY k")) == [("grain", True, 31), ("ore", True, 63)]


def test_windows(db):
    found = rows(db, "SELECT station, RANK() OVER (PARTITION BY river ORDER BY level DESC) FROM gauges WHERE river = 'Elbe' ORDER BY 2, 1")
    assert found == [("g2", 1), ("g1", 2), ("g4", 2)]
    assert {r[1] for r in rows(db, "SELECT station, LAST_VALUE(station) OVER (PARTITION BY river ORDER BY level) FROM gauges WHERE river = 'Elbe'")} == {"g2"}
    assert rows(db, "SELECT station, LEAD(station, 2, 'end') OVER (ORDER BY station) FROM gauges ORDER BY station")[-1] == ("g5", "end")


def test_sets_and_values(db):
    one, two = "(VALUES (4),(4),(4),(6)) a(v)", "(VALUES (4),(4),(9)) b(v)"
    for op, expected in (("UNION ALL", 7), ("INTERSECT", 1), ("INTERSECT ALL", 2), ("EXCEPT", 1), ("EXCEPT ALL", 2)):
        assert len(rows(db, f"SELECT v FROM {one} {op} SELECT v FROM {two}")) == expected
    assert db.query("VALUES (7, 'p'), (8, 'q')") == [{"column1": 7, "column2": "p"}, {"column1": 8, "column2": "q"}]


def test_quantified_comparisons(db):
    assert rows(db, "SELECT 1 < ALL (SELECT 2), 3 < ALL (SELECT 2), 3 > ANY (SELECT 2 UNION ALL SELECT 9), 1 = ALL (SELECT tons FROM loads WHERE tons < 0), 5 <> ALL (ARRAY[4, 6])") == [(True, False, True, True, True)]
    assert sorted(rows(db, "SELECT tons FROM loads WHERE tons >= ALL (SELECT level / 20 FROM gauges)")) == [(22,), (40,)]
    assert sorted(rows(db, "SELECT kind, tons FROM loads l WHERE tons > ANY (SELECT o.tons FROM loads o WHERE o.kind = l.kind)")) == [("grain", 22), ("ore", 15), ("ore", 40)]


def test_distinct_on_and_nulls(db):
    assert rows(db, "SELECT DISTINCT ON (kind) kind, tons FROM loads ORDER BY kind, tons DESC") == [("grain", 22), ("ore", 40)]
    assert rows(db, "SELECT v FROM (VALUES (3),(NULL),(5)) t(v) ORDER BY v DESC NULLS LAST") == [(5,), (3,), (None,)]
    assert rows(db, "SELECT v FROM (VALUES (3),(NULL),(5)) t(v) ORDER BY v") == [(3,), (5,), (None,)]


def test_recursion(db):
    tree = "(VALUES (10,NULL,'sea'),(11,10,'bay'),(12,11,'cove'),(20,NULL,'lake')) t(id, above, name)"
    assert rows(db, f"WITH RECURSIVE r(id, name, depth) AS (SELECT id, name, 0 FROM {tree} WHERE above IS NULL UNION ALL SELECT c.id, c.name, r.depth + 1 FROM {tree.replace(' t(', ' c(')} JOIN r ON c.above = r.id) SELECT name, depth FROM r WHERE depth = 2") == [("cove", 2)]
    assert rows(db, "WITH RECURSIVE c(x) AS (SELECT 3 UNION SELECT (x * 3) % 13 FROM c) SELECT x FROM c ORDER BY x") == [(1,), (3,), (9,)]


def test_lateral_and_table_functions(db):
    assert rows(db, "SELECT s.name, t.port FROM ships s JOIN LATERAL (SELECT c.port FROM calls c WHERE c.ship = s.id ORDER BY c.id DESC LIMIT 1) t ON TRUE ORDER BY 1") == [("Heron", "Aarhus"), ("Osprey", "Tallinn")]
    assert rows(db, "SELECT s.name, t.port, t.n FROM ships s JOIN LATERAL (SELECT c.port, c.id AS n FROM calls c WHERE c.ship::bigint = s.id ORDER BY n OFFSET 1 LIMIT 5) t ON TRUE") == [("Heron", "Aarhus", 2)]
    with pytest.raises(SqlError, match="must compare columns"):
        db.query("SELECT s.name FROM ships s JOIN LATERAL (SELECT c.port FROM calls c WHERE c.ship % 2 = s.id LIMIT 1) t ON TRUE")
    assert rows(db, "SELECT u.v, u.o FROM unnest(ARRAY['up','down']) WITH ORDINALITY AS u(v, o)") == [("up", 1), ("down", 2)]
    assert rows(db, """SELECT e.key, e.value FROM jsonb_each('{"mast":3,"sail":["a"]}') AS e""") == [("mast", "3"), ("sail", '["a"]')]


def test_scalar_functions(db):
    sql = "SELECT LEFT('harbour', -3), SUBSTRING('lantern', 0, 3), SPLIT_PART('x;y', ';', 4), LOG(1000), TRUNC(-8.6), CONCAT('q', NULL, 'r'), RIGHT('harbour', -3), INITCAP('low tide'), STRPOS('tide', 'd'), QUOTE_IDENT('m\"n')"
    assert rows(db, sql) == [("harb", "la", "", 3.0, -8.0, "qr", "bour", "Low Tide", 3, '"m""n"')]
    sql = "SELECT AGE('2021-03-02'::timestamp, '2019-11-20'::timestamp), AGE('2019-11-20'::timestamp, '2021-03-02'::timestamp), TO_CHAR('2019-12-01 17:08:09'::timestamp, 'DD.MM.YYYY HH12:MI'), EXTRACT(DOW FROM '2023-07-09'::date), '2023-01-30'::timestamp + INTERVAL '1 month'"
    assert rows(db, sql) == [("1 year 3 months 10 days", "-1 year 3 months 10 days", "01.12.2019 05:08", 0, datetime(2023, 2, 28))]
    assert rows(db, "SELECT 'Fjord' ~* '^f', 'Fjord' !~ 'j', 'x%y' LIKE 'x#%y' ESCAPE '#', 9 BETWEEN 2 AND 8, ARRAY[5,6] && ARRAY[6], ARRAY[5,6,7] @> ARRAY[5,7]") == [(True, False, True, False, True, True)]


def test_json(db):
    sql = """SELECT '{"hold":{"deck":[4,"rope"]}}'::jsonb->'hold'->'deck'->>1, jsonb_set('{"hold":{"deck":4}}', '{hold,deck}', '6'), '{"p":1,"q":2}'::jsonb - 'p', '[3]'::jsonb || '[4]'::jsonb,
        '{"hold":[1,{"n":2.0}]}'::jsonb @> '{"hold":[{"n":2}]}'::jsonb, '{"p":1}'::jsonb ? 'p', jsonb_build_object('t', 5, 'none', NULL, 'in', '{"z":[1]}'), jsonb_typeof('[1]'), jsonb_strip_nulls('{"p":null,"q":1}'), '{"p":{"q":2,"r":3}}'::jsonb #- '{p,q}'"""
    assert rows(db, sql) == [("rope", '{"hold":{"deck":6}}', '{"q":2}', "[3,4]", True, True, '{"t":5,"none":null,"in":{"z":[1]}}', "array", '{"q":1}', '{"p":{"r":3}}')]
    assert rows(db, "SELECT JSONB_AGG(tons ORDER BY tons), JSONB_OBJECT_AGG(kind, tons) FROM loads WHERE tons > 20 AND kind = 'ore'") == [("[40]", '{"ore":40}')]
    sql = """SELECT j - 1, j - 'b', j ? 'b', j || '{"k":1}'::jsonb, j @> '"b"', j @> '[true]', j #>> '{0}' FROM (SELECT '["a","b",null]'::jsonb AS j)"""
    with pytest.raises(Exception, match="."):
        db.query("SELECT '[1' - 1")
    assert rows(db, sql.replace("j -", "j::json -").replace("j ||", "j::json ||")) == [('["a",null]', '["a",null]', True, '["a","b",null,{"k":1}]', True, False, "a")]


def test_json_stays_on_the_jvm(db, spark):
    db.attach("notes", spark.createDataFrame([(1, '{"a":{"b":[1,2]}}')], "id long, j string"))
    sql = """SELECT j::jsonb, j->'a', j->>'a', j #> '{a,b}', j @> '{"a":{"b":[2]}}', j ? 'a', jsonb_typeof(j), jsonb_build_object('x', id, 'y', j), jsonb_build_array(id, j), j::jsonb - 'a', j::jsonb || '{"c":1}'::jsonb FROM notes"""
    assert "Python" not in plan(db, sql) and "Arrow" not in plan(db, sql)
    assert rows(db, sql) == [('{"a":{"b":[1,2]}}', '{"b":[1,2]}', '{"b":[1,2]}', "[1,2]", True, True, "object", '{"x":1,"y":{"a":{"b":[1,2]}}}', '[1,{"a":{"b":[1,2]}}]', "{}", '{"a":{"b":[1,2]},"c":1}')]
    assert "Python" not in plan(db, "SELECT JSON_OBJECT_AGG(id, j) FROM notes GROUP BY id")


def test_parameters(db):
    assert rows(db, "SELECT name FROM ships WHERE id = $1 OR name = $2 ORDER BY 1", [1, "Tern"]) == [("Heron",), ("Tern",)]
    assert rows(db, "SELECT name FROM ships WHERE id = :id", {"id": 2}) == [("Osprey",)]
    assert rows(db, "SELECT name FROM ships WHERE id IN ($1) ORDER BY id", [[1, 3]]) == [("Heron",), ("Tern",)]
    assert rows(db, "SELECT s.name FROM ships s JOIN calls c ON $1 = $2 WHERE c.port = $3", ["s.id", "c.ship", "Tallinn"]) == [("Osprey",)]
    assert rows(db, "SELECT $1, $2 FROM ships s WHERE id = 1", ["a.b", "s.nothing"]) == [("a.b", "s.nothing")]
    assert rows(db, "SELECT $1::date, $2 FROM ships WHERE id = 1", ["2020-05-06", date(2021, 7, 8)]) == [(date(2020, 5, 6), date(2021, 7, 8))]
    with pytest.raises(SqlError, match="bind message supplies"):
        db.query("SELECT $1", [])


def test_quoted_words(db):
    assert rows(db, 'SELECT "name" FROM ships WHERE "name" = "Tern"') == [("Tern",)]
    assert rows(db, 'SELECT crew AS "how many" FROM ships ORDER BY "how many" LIMIT 1') == [(7,)]


def test_default_names(db):
    assert list(db.query("SELECT s.name, upper(name), crew + 1, crew * 2, count(*) OVER () FROM ships s LIMIT 1")[0]) == ["name", "upper", "col", "col1", "count"]
    assert db.query2("SELECT * FROM ships WHERE id < 0").fields == ["id", "name", "crew"]


def test_changes_of_rows(db):
    db.exec("CREATE TABLE stock(id INT PRIMARY KEY, qty INT, twice INT GENERATED ALWAYS AS (qty * 2) STORED); INSERT INTO stock(id, qty) VALUES (5, 50), (6, 60)")
    assert sorted(rows(db, "UPDATE stock SET qty = stock.qty + v.n FROM (VALUES (5, 3), (6, 4)) AS v(k, n) WHERE stock.id = v.k RETURNING id, qty, twice")) == [(5, 53, 106), (6, 64, 128)]
    assert rows(db, "INSERT INTO stock(id, qty) VALUES (5, 1), (7, 3) ON CONFLICT (id) DO NOTHING RETURNING id") == [(7,)]
    assert sorted(rows(db, "INSERT INTO stock(id, qty) VALUES (5, 1), (8, 4) ON CONFLICT (id) DO UPDATE SET qty = stock.qty + EXCLUDED.qty RETURNING id, qty, twice")) == [(5, 54, 108), (8, 4, 8)]
    assert rows(db, "DELETE FROM stock WHERE id = 8 RETURNING qty") == [(4,)]
    with pytest.raises(ConstraintError, match="must be unique"):
        db.exec("INSERT INTO stock(id, qty) VALUES (5, 1)")
    assert rows(db, "SELECT id, qty FROM stock ORDER BY id") == [(5, 54), (6, 64), (7, 3)]


def test_first_match_and_first_row_count(db):
    db.exec("CREATE TABLE tags(ship INT, tag TEXT); INSERT INTO tags VALUES (1, 'z'), (1, 'a'); INSERT INTO tags VALUES (2, 'm'), (1, 'b'); CREATE TABLE names(id INT PRIMARY KEY, tag TEXT); INSERT INTO names VALUES (1, ''), (2, '')")
    db.exec("UPDATE names SET tag = t.tag FROM tags t WHERE t.ship = names.id")
    assert rows(db, "SELECT tag FROM names ORDER BY id") == [("z",), ("m",)]
    db.exec("DELETE FROM names; INSERT INTO names SELECT ship, tag FROM tags ON CONFLICT DO NOTHING")
    assert rows(db, "SELECT tag FROM names ORDER BY id") == [("z",), ("m",)]


def test_only_touched_files_are_written_anew(db):
    db.exec("CREATE TABLE many(id INT PRIMARY KEY, v TEXT)")
    for k in range(4):
        db.exec(f"INSERT INTO many VALUES ({2 * k}, 'a'), ({2 * k + 1}, 'b')")
    files = lambda: {short(p) for p in db.store.load("main")["tables"]["many"]["parts"]}
    before = files()
    db.exec("UPDATE many SET v = 'new' WHERE id = 3")
    assert len(before & files()) == len(before) - 1
    db.exec("DELETE FROM many WHERE id IN (0, 7)")
    assert len(before & files()) == len(before) - 3
    assert sorted(rows(db, "SELECT id, v FROM many")) == [(1, "b"), (2, "a"), (3, "new"), (4, "a"), (5, "b"), (6, "a")]
    assert db.vacuum() >= 3 and len(rows(db, "SELECT id FROM many")) == 6 and not db.scratch


def test_serial_default_returning(db):
    db.exec("CREATE TABLE s(id SERIAL, v TEXT DEFAULT 'none', n INT NOT NULL)")
    assert rows(db, "INSERT INTO s(v, n) VALUES (DEFAULT, 1), ('x', 2) RETURNING id, v") == [(1, "none"), (2, "x")]
    assert rows(db, "INSERT INTO s(id, n) VALUES (30, 3), (DEFAULT, 4) RETURNING id") == [(30,), (3,)]
    assert rows(db, "INSERT INTO s(n) VALUES (5) RETURNING id") == [(4,)]
    with pytest.raises(ConstraintError, match="cannot be null"):
        db.exec("INSERT INTO s(v) VALUES ('y')")
    db.exec("TRUNCATE s RESTART IDENTITY")
    assert rows(db, "INSERT INTO s(n) SELECT 7 RETURNING id, v, n") == [(1, "none", 7)]


def test_foreign_keys(db):
    db.exec("CREATE TABLE a(id INT PRIMARY KEY); CREATE TABLE b(id INT PRIMARY KEY, a INT REFERENCES a(id) ON DELETE CASCADE ON UPDATE CASCADE); CREATE TABLE c(b INT REFERENCES b(id) ON DELETE SET NULL)")
    db.exec("INSERT INTO a VALUES (61), (62); INSERT INTO b VALUES (71, 61), (72, 62); INSERT INTO c VALUES (71), (72)")
    with pytest.raises(ConstraintError, match="Foreign Key Violation"):
        db.exec("INSERT INTO b VALUES (73, 69)")
    with pytest.raises(ConstraintError, match="Foreign Key Violation"):
        db.exec("UPDATE b SET id = 99 WHERE id = 71")
    db.exec("UPDATE a SET id = CASE id WHEN 61 THEN 62 ELSE 61 END")
    assert sorted(rows(db, "SELECT id, a FROM b")) == [(71, 62), (72, 61)]
    db.exec("DELETE FROM a WHERE id = 62")
    assert rows(db, "SELECT id FROM b") == [(72,)] and rows(db, "SELECT b FROM c ORDER BY b") == [(72,), (None,)]
    with pytest.raises(ConstraintError):
        db.exec("DROP TABLE a")


def test_transactions(db):
    db.exec("BEGIN; UPDATE ships SET crew = 0; ROLLBACK")
    assert rows(db, "SELECT max(crew) FROM ships") == [(31,)]
    with pytest.raises(RuntimeError), db.transaction():
        db.exec("DELETE FROM ships")
        raise RuntimeError
    assert rows(db, "SELECT count(*) FROM ships") == [(3,)]
    with db.transaction():
        db.exec("CREATE TABLE tx(x INT)")
        db.exec("INSERT INTO tx VALUES (1)")
    assert rows(db, "SELECT x FROM tx") == [(1,)]


def test_two_processes_do_not_lose_each_others_work(db, spark):
    """A state that another process has replaced meanwhile can't be saved; a single statement is tried again on the new one."""
    stale = db.store.load("main")
    db.exec("CREATE TABLE counted(x INT)")
    with pytest.raises(Conflict):
        db.store.save("main", stale)
    other = Database(spark, db.store.root)
    load, late = other.store.load, [True]

    def slow(name):
        found = load(name)
        if late.pop() if late else False:
            db.exec("INSERT INTO counted VALUES (1)")
        return found

    other.store.load = slow
    other.exec("INSERT INTO counted VALUES (2)")
    assert sorted(rows(db, "SELECT x FROM counted")) == [(1,), (2,)]


def test_definitions(db):
    db.exec("CREATE TABLE d(id INT, old TEXT); INSERT INTO d VALUES (1, 'x')")
    db.exec("ALTER TABLE d ADD COLUMN n INT DEFAULT 5, RENAME COLUMN old TO fresh, ADD CONSTRAINT k UNIQUE (id), ALTER COLUMN n TYPE BIGINT")
    assert rows(db, "SELECT id, fresh, n FROM d") == [(1, "x", 5)]
    db.exec("ALTER TABLE d DROP COLUMN fresh; COMMENT ON TABLE d IS 'text'; COMMENT ON COLUMN d.n IS 'number'")
    assert rows(db, "SELECT column_name FROM information_schema.columns WHERE table_name = 'd' ORDER BY ordinal_position") == [("id",), ("n",)]
    assert rows(db, "SELECT description FROM pg_description d JOIN pg_class c ON d.objoid = c.oid WHERE c.relname = 'd' ORDER BY objsubid") == [("text",), ("number",)]
    db.exec("CREATE TYPE wind AS ENUM ('calm', 'gale'); CREATE TABLE m(x wind); INSERT INTO m VALUES ('calm')")
    with pytest.raises(ConstraintError):
        db.exec("INSERT INTO m VALUES ('storm')")
    db.exec("CREATE UNIQUE INDEX IF NOT EXISTS mi ON m USING btree (x); CREATE SCHEMA app; CREATE TABLE app.t(x INT); DROP VIEW IF EXISTS v")
    with pytest.raises(SqlError):
        db.exec("DROP SCHEMA app")
    db.exec("DROP SCHEMA app CASCADE; DROP TABLE IF EXISTS nothing")
    db.exec("DO $$ BEGIN IF NOT EXISTS (SELECT 1 FROM d WHERE id = 2) THEN INSERT INTO d(id) VALUES (2); END IF; END $$")
    assert rows(db, "SELECT count(*) FROM d") == [(2,)]


@pytest.mark.parametrize("ending", ["", " ON CONFLICT DO NOTHING"])
def test_rows_lie_in_the_order_of_the_insert(spark, tmp_path, ending):
    """Also where it fills several files, which Spark reads by size; UPDATE ... FROM takes the first match."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "9000"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        db = Database(spark, f"file://{tmp_path}")
        # Later rows take more room, so later files are longer.
        db.attach("made", spark.range(4000).selectExpr("id AS k", "id % 3 AS owner", "repeat(sha2(CAST(id AS STRING), 256), CAST(id DIV 1000 AS INT)) AS text"))
        db.exec("CREATE TABLE n(id BIGINT, first BIGINT); INSERT INTO n VALUES (0, NULL), (1, NULL), (2, NULL); CREATE TABLE c(k BIGINT PRIMARY KEY, owner BIGINT, text TEXT)")
        db.exec(f"INSERT INTO c SELECT k, owner, text FROM made ORDER BY k{ending}")
        parts = db.store.load("main")["tables"]["c"]["parts"]
        assert len(parts) > 1
        assert [r["k"] for p in parts for r in spark.read.parquet(p).collect()] == list(range(4000))
        db.exec("UPDATE n SET first = c.k FROM c WHERE c.owner = n.id")
        assert rows(db, "SELECT id, first FROM n ORDER BY id") == [(0, 0), (1, 1), (2, 2)]
        db.exec("DELETE FROM c WHERE k < 30 OR k % 7 = 0")
        db.exec("UPDATE n SET first = c.k FROM c WHERE c.owner = n.id")
        assert rows(db, "SELECT id, first FROM n ORDER BY id") == [(0, 30), (1, 31), (2, 32)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.fixture
def dealt(spark, monkeypatch):
    """A table of few rows that counts as one too large for a task: numbers with nulls, ties and equal rows."""
    from tarn.plans import ranges

    monkeypatch.setattr(ranges, "MOST", 300)
    monkeypatch.setattr(ranges, "MOST_HEAP", 700)
    made = Database(spark, scratch(spark))
    # 2 groups of 2000 rows; a is null for a ninth of them, b ties a lot, and each row is there twice.
    made.attach("made", spark.range(4000).selectExpr("CAST(id DIV 2 % 2 AS INT) AS g", "nullif(CAST(id DIV 2 * 7919 % 900 AS DOUBLE), 0) AS a", "IF(id DIV 2 % 9 = 0, NULL, CAST(id DIV 2 % 31 AS STRING)) AS b", "id DIV 2 AS k"))
    return made


def spread(df):
    """Rows, and how many of them lie in each partition."""
    found = [tuple(r) for r in df.withColumn("__at", F.spark_partition_id()).collect()]
    return [r[:-1] for r in found], Counter(r[-1] for r in found)


def null_last(value, down=False):
    return (value is None, 0 if value is None else value) if not down else (value is not None, 0 if value is None else -value)


@pytest.mark.parametrize("most", [1, 500, 777, 3999, 5000])
def test_offset_without_limit_is_dealt_by_range(dealt, most):
    """all rows were gathered and sorted in one task."""
    every = [tuple(r) for r in dealt.views["made"].select("k", "a", "b").collect()]
    found, places = spread(dealt.df(f"SELECT k, a, b FROM made ORDER BY a DESC, k OFFSET {most}"))
    assert found == sorted(every, key=lambda r: (null_last(r[1], down=True), r[0]))[most:]
    assert most > 3000 or max(places.values()) < 1200
    # Equal order and equal rows: any of them may be skipped, but as many as there are.
    found, places = spread(dealt.df(f"SELECT b FROM made ORDER BY b OFFSET {most}"))
    assert [r[0] for r in found] == sorted((r[2] for r in every), key=lambda b: (b is None, b or ""))[most:]
    # An order that is no column of the result, over a subquery with a limit.
    found, _ = spread(dealt.df(f"SELECT b FROM (SELECT * FROM made ORDER BY k LIMIT 3000) ORDER BY k * 2 DESC OFFSET {most}"))
    assert [r[0] for r in found] == [r[2] for r in sorted(every, key=lambda r: -r[0])[1000:]][most:]


def test_places_in_a_large_group_are_dealt_by_range(dealt):
    """each group was sorted in one task."""
    rows_, places = spread(dealt.df("SELECT k, g, row_number() OVER (PARTITION BY g ORDER BY k) AS rn FROM made"))
    assert max(places.values()) < 1200
    assert sorted(rows_) == sorted((k, k % 2, 2 * (k // 2) + i + 1) for k in range(2000) for i in range(2))
    found = dealt.df("SELECT *, rank() OVER (PARTITION BY g ORDER BY b DESC) AS r, dense_rank() OVER (PARTITION BY g ORDER BY b DESC) AS d, row_number() OVER (ORDER BY a, b) AS n FROM made ORDER BY n LIMIT 3990 OFFSET 5")
    assert found.columns == ["g", "a", "b", "k", "r", "d", "n"]
    found = [tuple(r) for r in found.collect()]
    assert [r[6] for r in found] == list(range(6, 3996))
    every = [tuple(r) for r in dealt.views["made"].collect()]
    assert [(null_last(r[1]), r[2] is None, r[2] or "") for r in found] == sorted((null_last(r[1]), r[2] is None, r[2] or "") for r in every)[5:3995]
    for g, _, b, _, rank, dense, _ in found:
        before = [x[2] for x in every if x[0] == g and (x[2] is None) > (b is None) or x[0] == g and b is not None and x[2] is not None and x[2] > b]
        assert (rank, dense) == (len(before) + 1, len(set(before)) + 1)


def test_a_place_that_another_item_names_is_left_to_spark(dealt):
    assert dealt.df("SELECT k, row_number() OVER (PARTITION BY g ORDER BY k) AS rn, rn + 1 AS more FROM made").agg(F.sum("more")).first()[0] == 2 * (2000 * 2001 // 2) + 4000


def test_second_connection_sees_everything(db, spark):
    assert rows(Database(spark, db.store.root), "SELECT count(*) FROM ships") == [(3,)]


def test_attached_frames_and_plans(db, spark):
    db.attach("numbers", spark.range(100))
    assert rows(db, "SELECT count(*) FROM numbers WHERE id >= 90") == [(10,)]
    assert "PushedFilters: [IsNotNull(crew)" in plan(db, "SELECT name FROM ships WHERE crew > 27")


def test_lexer():
    assert [t.value for t in tokens("SELECT 'o''clock', $$a'b$$, \"x\"\"y\" -- end\n/* c */ .5")] == ["SELECT", "o'clock", ",", "a'b", ",", 'x"y', ".5", ""]
    with pytest.raises(SqlError):
        tokens("SELECT §")
    with pytest.raises(SqlError, match="does not exist"):
        translate("SELECT 1 FROM nowhere")
