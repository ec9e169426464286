"""The database: queries and statements of the dialect over tables of Parquet parts."""

from __future__ import annotations

import re
import threading
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.dialect.lexer import SqlError, quote_name
from tarn.dialect.statements import Statements
from tarn.dialect.translate import Shape
from tarn.functions import json_udf
from tarn.plans import ranges
from tarn.session import configure
from tarn.sources.store import Conflict, Store, fresh, schema_of, short

_LOCKS: dict[str, threading.RLock] = {}
#: A recursion that goes on for longer stops with an error; nothing is left out.
MOST_ROUNDS = 10_000
#: How often a statement is tried again after another process has saved first.
RETRIES = 5


class ConstraintError(ValueError):
    """A statement would break a constraint; nothing of it has been kept."""


@dataclass
class Result:
    rows: list[dict[str, Any]] = field(default_factory=list)
    row_count: int = 0
    fields: list[str] = field(default_factory=list)
    command: str = ""


class Database:
    """One root folder with any number of databases, named per call; an unknown one is created empty.

    Statements of one process on one root run one at a time. A statement is atomic; within a transaction nothing is
    visible to others until COMMIT.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = configure(spark)
        json_udf.register(spark)
        self.store = Store(spark, root)
        self.lock = _LOCKS.setdefault(self.store.root, threading.RLock())
        self.open: tuple[str, dict[str, Any]] | None = None
        self.views: dict[str, DataFrame] = {}
        self.scratch: list[str] = []

    # the interface
    def attach(self, name: str, df: DataFrame) -> None:
        """A DataFrame that queries can name like a table; it can't be changed."""
        self.views[name.lower()] = df

    def df(self, sql: str, params: Sequence | Mapping | None = None, db: str = "main") -> DataFrame:
        """One query, not yet run."""
        catalog = self._catalog(db)
        made = self._parser(sql, params, catalog).statement()
        if made["kind"] != "select":
            raise SqlError("df() takes a query")
        return self._planned(sql, params, catalog)

    def _planned(self, sql: str, params: Any, catalog: dict[str, Any]) -> DataFrame:
        """A query; where columns stand beside aggregates without being grouped by, they are read as those of some row of the group."""
        for loose in (False, True):
            parser = self._parser(sql, params, catalog)
            parser.loose = loose
            made = parser.statement()
            parser.accept(";")
            if parser.now.kind != "end":
                raise SqlError(f"unexpected {sql[parser.now.at : parser.now.at + 30]!r}")
            try:
                return self._select(made["sql"], parser, catalog)
            except AnalysisException as problem:
                if loose or not re.search("MISSING_AGGREGATION|MISSING_GROUP_BY|SCALAR_SUBQUERY", problem.getCondition() or ""):
                    raise
        raise AssertionError

    def query(self, sql: str, params: Sequence | Mapping | None = None, db: str = "main") -> Any:
        """Rows of one statement, or a list of them for several."""
        found = [r.rows for r in self._all(sql, params, db)]
        return found[0] if len(found) == 1 else found

    def query2(self, sql: str, params: Sequence | Mapping | None = None, db: str = "main") -> Any:
        """Like query, as Result with row_count, fields and command."""
        found = self._all(sql, params, db)
        return found[0] if len(found) == 1 else found

    def exec(self, sql: str, params: Sequence | Mapping | None = None, db: str = "main") -> None:
        self._all(sql, params, db)

    exec2 = query2

    @contextmanager
    def transaction(self, db: str = "main") -> Iterator[Database]:
        """Commits at the end, rolls back on an exception."""
        if self.open:
            raise SqlError("transactions do not nest")
        with self.lock:
            self.exec("BEGIN", db=db)
            try:
                yield self
            except BaseException:
                self.exec("ROLLBACK", db=db)
                raise
            self.exec("COMMIT", db=db)

    def close(self, destroy: bool = False) -> None:
        """Rolls back what is open; with destroy the database of the open transaction, or main, goes as well."""
        db = self.open[0] if self.open else "main"
        self.open = None
        self._forget()
        if destroy:
            self.destroy(db)

    def destroy(self, db: str = "main") -> None:
        self.store.drop(db)

    def vacuum(self, db: str = "main") -> int:
        """Deletes files that hold rows of older states only; how many."""
        with self.lock:
            return self.store.vacuum(db, self._catalog(db))

    # statements
    def _catalog(self, db: str) -> dict[str, Any]:
        if self.open:
            if self.open[0] != db:
                raise SqlError("the database can't be switched within a transaction")
            return self.open[1]
        return self.store.load(db)

    def _parser(self, sql: str, params: Any, catalog: dict[str, Any]) -> Statements:
        names = {n: n for n in self.views} | {n.lower(): n for n in catalog["tables"]} | {n: n for n in SYSTEM}
        parser = Statements(sql, params, names)
        parser.columns = {n: {c.lower() for c in df.columns} for n, df in self.views.items()} | {n.lower(): {c["name"].lower() for c in t["columns"]} for n, t in catalog["tables"].items()} | _SYSTEM_COLUMNS
        parser.oids = {n.lower(): t["oid"] for n, t in catalog["tables"].items()} | {s: _OIDS.get(s, 20000 + i) for i, s in enumerate(catalog["schemas"])} | {n: 30000 + i for i, n in enumerate(catalog["types"])}
        return parser

    def _all(self, sql: str, params: Any, db: str) -> list[Result]:
        with self.lock:
            parser = self._parser(sql, params, self._catalog(db))
            return [self._one(sql[parser.all[a].at : parser.all[b].at], params, db) for a, b in parser.split()] or [Result()]

    def _one(self, sql: str, params: Any, db: str) -> Result:
        """One statement; outside a transaction it is tried again where another process has been faster."""
        for again in range(RETRIES, -1, -1):
            kept = len(self.scratch)
            try:
                return self._once(sql, params, db)
            except Conflict:
                if self.open or not again:
                    self.open = None
                    raise
            finally:
                self._forget(kept)
        raise AssertionError

    def _once(self, sql: str, params: Any, db: str) -> Result:
        catalog = fresh(self._catalog(db))
        parser = self._parser(sql, params, catalog)
        made = parser.statement()
        if parser.now.kind != "end":
            raise SqlError(f"unexpected {sql[parser.now.at : parser.now.at + 30]!r}")
        kind = made["kind"]
        if kind == "begin":
            self.open = self.open or (db, catalog)
            return Result(command="BEGIN")
        if kind in ("commit", "rollback"):
            if self.open and kind == "commit":
                self.store.save(db, self.open[1])
            self.open = None
            return Result(command=kind.upper())
        if kind == "select":
            return _result(self._planned(sql, params, catalog), "SELECT")
        if kind == "do":
            return self._do(made, params, db)
        result = getattr(self, f"_{kind}")(made, parser, catalog, db)
        if self.open:
            self.open = (db, catalog)
        else:
            self.store.save(db, catalog)
        return result or Result(command=kind.upper().replace("_", " "))

    def _nothing(self, *_: Any) -> None:
        """Accepted without effect."""

    def _do(self, made: dict[str, Any], params: Any, db: str) -> Result:
        if made["query"] and bool(self.query(made["query"], params, db)) != made["no"]:
            self._all(made["then"], params, db)
        return Result(rows=[{"body": made["body"]}], row_count=1, fields=["body"], command="DO")

    # reading
    def _frames(self, used: set[str], catalog: dict[str, Any]) -> dict[str, DataFrame]:
        return {name: self._frame(name, catalog) for name in used}

    def _frame(self, name: str, catalog: dict[str, Any]) -> DataFrame:
        if name in catalog["tables"]:
            return self.store.read(catalog["tables"][name])
        if name in self.views:
            return self.views[name]
        return SYSTEM[name](self.spark, catalog)

    def _select(self, sql: str, parser: Statements, catalog: dict[str, Any]) -> DataFrame:
        frames = self._frames(parser.used, catalog)
        for name, columns, base, step in parser.rounds:
            frames[f"{name}__rounds"] = self._rounds(name, columns, base, step, frames)
        made = self._ranged(parser.shapes[sql], frames) if sql in parser.shapes else None
        return self._run(sql, frames) if made is None else made

    def _ranged(self, shape: Shape, frames: dict[str, DataFrame]) -> DataFrame | None:
        """A query that numbers or skips rows, dealt by range; None where one task can well sort each of its groups."""
        try:
            rows = self._run(shape.sql, frames)
        except AnalysisException:  # such as an item that names a place: the query is then planned as it stands
            return None
        names = rows.columns[: len(rows.columns) - shape.hidden]
        own = {n: f"__c{i}" for i, n in enumerate(names)} | {f"__hidden{i}": f"__hidden{i}" for i in range(shape.hidden)}
        if len(own) < len(rows.columns) and any(o not in own or names.count(o) > 1 for o, _, _ in shape.order):
            return None
        placed = {f"__place{i}": name for i, (*_, name) in enumerate(shape.places)}
        own |= {name: own[place] for place, name in placed.items()}
        if any(o not in own for o, _, _ in shape.order):
            return None
        rows = rows.toDF(*[f"__c{i}" for i in range(len(names))], *[f"__hidden{i}" for i in range(shape.hidden)])
        total = rows.count()
        skips = shape.skipped and shape.order and shape.most is None
        places = [(function, list(dict.fromkeys(own[k] for k in keys)), [(own[o], down, first) for o, down, first in order]) for function, keys, order, _ in shape.places]
        if total <= ranges.MOST or not (skips or any(ranges.largest(rows, keys) > ranges.MOST for _, keys, _ in places)):
            return None
        for i, (function, keys, order) in enumerate(places):
            rows = ranges.numbered(rows, function, keys, order, own[f"__place{i}"], total, self._stored)
        order = [(own[o], down, first) for o, down, first in shape.order]
        if skips:
            rows = ranges.skipped(rows, order, shape.skipped, total, self._stored)
            if rows is None:
                return None
        else:
            rows = rows.orderBy(*ranges.sorting(order)) if order else rows
            rows = rows.offset(shape.skipped) if shape.skipped else rows
            rows = rows.limit(shape.most) if shape.most is not None else rows
        return rows.select(*[f"__c{i}" for i in range(len(names))]).toDF(*[placed.get(n, n) for n in names])

    def _run(self, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
        """Spark SQL whose {name} stand for DataFrames."""
        keys = {name: f"t{i}_" for i, name in enumerate(sorted(frames)) if "{" + name + "}" in sql}
        if not keys:
            return self.spark.sql(sql)
        for name, key in keys.items():
            sql = sql.replace("{" + name + "}", f"\0{key}\1")
        # All other braces stand in literals.
        sql = sql.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
        return self.spark.sql(sql, **{key: frames[name] for name, key in keys.items()})

    def _rounds(self, name: str, columns: str, base: str, step: str, frames: dict[str, DataFrame]) -> DataFrame:
        """WITH RECURSIVE ... UNION: each round sees the rows that the last one added, until none is new."""
        first = self._run(base, frames).distinct()
        if columns:
            first = first.toDF(*[c.strip().strip("`") for c in columns.strip("()").split(",")])
        every = delta = self._stored(first)
        for _ in range(MOST_ROUNDS):
            new = self._run(step.replace(quote_name(name) + " AS", "{self__} AS"), frames | {"self__": delta}).toDF(*every.columns)
            delta = self._stored(new.distinct().subtract(every))
            if delta.isEmpty():
                return every
            every = every.union(delta)
        raise SqlError(f"{name} did not end within {MOST_ROUNDS} rounds")

    def _stored(self, df: DataFrame) -> DataFrame:
        """Rows kept until the statement ends, or for a query until close()."""
        made, path = self.store.scratch(df)
        self.scratch.append(path)
        return made

    def _forget(self, kept: int = 0) -> None:
        while len(self.scratch) > kept:
            self.store.delete(self.scratch.pop())

    # writing
    def _table(self, name: str, catalog: dict[str, Any]) -> dict[str, Any]:
        found = next((t for n, t in catalog["tables"].items() if n.lower() == name.lower()), None)
        if not found:
            raise SqlError(f"relation {name} does not exist")
        return found

    def _values(self, df: DataFrame, table: dict[str, Any], given: list[str], catalog: dict[str, Any]) -> DataFrame:
        """Rows of all columns of a table from those given: serial, default, generated, then cast."""
        place = {c.lower(): c for c in given}
        listed, first = [], table["next"]
        for c in table["columns"]:
            own = place.get(c["name"].lower())
            value = F.col(quote_name(own)) if own else None
            if c["serial"] and value is None:
                value = F.col("__place") + F.lit(first)
            elif value is None:
                value = F.expr(c["default"]) if c["default"] else F.lit(None)
            elif c["default"] and f"__default_{own}" in df.columns:
                value = F.when(F.col(quote_name(f"__default_{own}")), F.expr(c["default"])).otherwise(value)
            listed.append(value.cast(c["type"]).alias(c["name"]))
        return self._generated(df.select(*listed, "__place"), table)

    @staticmethod
    def _generated(df: DataFrame, table: dict[str, Any]) -> DataFrame:
        for c in table["columns"]:
            if c["generated"]:
                df = df.withColumn(c["name"], F.expr(c["generated"]).cast(c["type"]))
        return df

    def _insert(self, made: dict[str, Any], parser: Statements, catalog: dict[str, Any], db: str) -> Result:
        table = self._table(made["table"], catalog)
        own = [c["name"] for c in table["columns"]]
        frames = self._frames(parser.used, catalog)
        if "select" in made:
            df = self._select(made["select"], parser, catalog)
            given = made["columns"] or own[: len(df.columns)]
            df = df.toDF(*given)
        else:
            width = max(map(len, made["rows"]))
            given = made["columns"] or own[:width]
            if any(len(r) not in (0, len(given)) for r in made["rows"]):
                raise SqlError("INSERT has another number of values than of columns")
            self._number(made["rows"], given, table)
            df = self._literals(made["rows"], given, frames).coalesce(1)  # no more rows than the statement spells out
        # Places number the rows of this statement; a window without keys would gather them, so offsets come from partitions.
        df = self._stored(df.withColumn("__id", F.monotonically_increasing_id()))
        sizes = {r["p"]: r["n"] for r in df.groupBy((F.shiftright("__id", 33)).alias("p")).agg(F.count("*").alias("n")).collect()}
        base, count = {}, 0
        for p in sorted(sizes):
            base[p], count = count, count + sizes[p]
        offsets = F.create_map(*[F.lit(x) for p, b in base.items() for x in (p, b)]) if base else F.create_map(F.lit(0).cast("bigint"), F.lit(0))
        placed = df.withColumn("__place", offsets[F.shiftright("__id", 33)] + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")
        new = self._values(placed, table, given, catalog)
        new = self._stored(new)
        if any(c["serial"] and c["name"].lower() not in {g.lower() for g in given} for c in table["columns"]):
            table["next"] += count
        if made["conflict"]:
            return self._upsert(new, made, table, catalog, db)
        self._check(new.drop("__place"), table, catalog, inserted=True)
        # Spark reads files by size and not by name. Only rows that have always been in one file are in order as they are.
        ordered = new.orderBy("__place") if len(sizes) > 1 or len(new.inputFiles()) > 1 else new
        table["parts"] += self.store.write(db, ordered.drop("__place"))
        return self._returned(new, made, table, "INSERT", count)

    @staticmethod
    def _number(rows: list[list[str | None]], given: list[str], table: dict[str, Any]) -> None:
        """DEFAULT in the place of a serial number takes the next one; numbers that are given do not count."""
        serial = {c["name"].lower() for c in table["columns"] if c["serial"]}
        for row in rows:
            for k, value in enumerate(row):
                if value is None and given[k].lower() in serial:
                    row[k] = str(table["next"])
                    table["next"] += 1

    def _literals(self, rows: list[list[str | None]], given: list[str], frames: dict[str, DataFrame]) -> DataFrame:
        """Rows of VALUES as one relation, with a flag for each DEFAULT; rows with subqueries are queries of their own."""
        names = [x for c in given for x in (c, f"__default_{c}")] or ["__one"]
        listed = [", ".join(f"{'NULL' if v is None else v}, {str(v is None).upper()}" for v in (row or [None] * len(given))) or "1" for row in rows]
        columns = ", ".join(map(quote_name, names))
        if not any("SELECT" in x for x in listed):
            return self._run(f"SELECT * FROM VALUES {', '.join(f'({x})' for x in listed)} AS v({columns})", frames)
        return reduce(DataFrame.union, [self._run(f"SELECT {x}", frames).toDF(*names) for x in listed])

    def _upsert(self, new: DataFrame, made: dict[str, Any], table: dict[str, Any], catalog: dict[str, Any], db: str) -> Result:
        keys = [c["columns"] for c in table["constraints"] if c["kind"] in ("primary", "unique")]
        target = made["conflict"]["target"]
        if target:
            keys = [k for k in keys if {x.lower() for x in k} == {x.lower() for x in target}]
        if not keys:
            raise SqlError("ON CONFLICT needs a unique constraint on its columns")
        old = self.store.read(table)
        columns = [c["name"] for c in table["columns"]]
        if made["conflict"]["set"] is None:
            kept = new
            for k in keys:
                known = reduce(lambda a, b: a & b, [F.col(f"n.{quote_name(c)}") == F.col(f"o.{quote_name(c)}") for c in k])
                kept = kept.alias("n").join(old.select(*k).alias("o"), known, "left_anti")
                rank = F.row_number().over(Window.partitionBy(*k).orderBy("__place"))
                absent = reduce(lambda a, b: a | b, [F.col(quote_name(c)).isNull() for c in k])
                kept = kept.withColumn("__r", rank).where((F.col("__r") == 1) | absent).drop("__r")
            kept = self._stored(kept.select(*columns, "__place"))
            self._check(kept.drop("__place"), table, catalog, inserted=True)
            table["parts"] += self.store.write(db, kept.orderBy("__place").drop("__place"))
            return self._returned(kept, made, table, "INSERT", None)
        key = keys[0]
        ranked = new.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy("__place")))
        if ranked.where("__r > 1").where(" AND ".join(f"{quote_name(c)} IS NOT NULL" for c in key)).limit(1).count():
            raise SqlError("ON CONFLICT DO UPDATE can't change a row twice in one statement")
        new = new.drop("__place")
        name = made["table"].split(".")[-1]
        on = " AND ".join(f"{quote_name(name)}.{quote_name(c)} = EXCLUDED.{quote_name(c)}" for c in key)
        condition = made["conflict"]["where"] or "TRUE"
        changes = {c.lower(): e for c, e in made["conflict"]["set"]}
        changed = ", ".join((f"CAST({changes[c['name'].lower()]} AS {c['type']})" if changes.get(c["name"].lower()) else f"{quote_name(name)}.{quote_name(c['name'])}") + f" AS {quote_name(c['name'])}" for c in table["columns"])
        frames = {"old__": old, "new__": new}
        hit = self._stored(self._generated(self._run(f"SELECT {changed} FROM {{old__}} AS {quote_name(name)} JOIN {{new__}} AS EXCLUDED ON {on} WHERE {condition}", frames), table))
        placed = {"old__": self.store.read(table, places=True), "new__": new}
        struck = self._stored(self._run(f"SELECT {quote_name(name)}.`__file`, {quote_name(name)}.`__row` FROM {{old__}} AS {quote_name(name)} JOIN {{new__}} AS EXCLUDED ON {on} WHERE {condition}", placed))
        added = self._stored(self._run(f"SELECT EXCLUDED.* FROM {{new__}} AS EXCLUDED LEFT ANTI JOIN {{old__}} AS {quote_name(name)} ON {on}", frames))
        self._without(struck, table, db)
        touched = self._stored(added.union(hit))
        self._check(touched, table, catalog, inserted=True)
        table["parts"] += self.store.write(db, touched)
        return self._returned(touched, made, table, "INSERT", None)

    def _without(self, struck: DataFrame, table: dict[str, Any], db: str) -> None:
        """Takes rows (__file, __row) out of a table; only the files that hold one are written anew."""
        names = {r["__file"] for r in struck.select("__file").distinct().collect()}
        files = [p for p in table["parts"] if short(p) in names]
        if not files:
            return
        at = table["parts"].index(files[0])
        rest = self.store.read(table | {"parts": files}, places=True).join(struck.select("__file", "__row"), ["__file", "__row"], "left_anti")
        rest = rest.orderBy("__part", "__row").drop("__file", "__row", "__part")
        kept = [p for p in table["parts"] if p not in files]
        table["parts"] = [*kept[:at], *self.store.write(db, rest), *kept[at:]]

    @staticmethod
    def _referred(table: dict[str, Any], catalog: dict[str, Any]) -> list[str]:
        """Columns of a table that foreign keys of others refer to."""
        own = Database._primary(table)
        found = [x for t in catalog["tables"].values() for c in t["constraints"] if c["kind"] == "foreign" and c["table"].lower() == table["name"].lower() for x in (c["to"] or own)]
        names = {c["name"].lower(): c["name"] for c in table["columns"]}
        return list(dict.fromkeys(names[x.lower()] for x in found))

    def _update(self, made: dict[str, Any], parser: Statements, catalog: dict[str, Any], db: str) -> Result:
        table = self._table(made["table"], catalog)
        alias = quote_name(made["alias"] or made["table"].split(".")[-1])
        frames = self._frames(parser.used, catalog)
        changes = {c.lower(): (e, c) for c, e in made["set"]}
        unknown = [c for k, (_, c) in changes.items() if k not in {x["name"].lower() for x in table["columns"]}]
        if unknown:
            raise SqlError(f"column {unknown[0]} does not exist")
        listed = []
        for c in table["columns"]:
            e, _ = changes.get(c["name"].lower(), (f"{alias}.{quote_name(c['name'])}", None))
            listed.append(f"CAST({e or c['default'] or 'NULL'} AS {c['type']}) AS {quote_name(c['name'])}")
        own = [c["name"] for c in table["columns"]]
        old = [f"{alias}.{quote_name(c)} AS {quote_name(f'__old_{c}')}" for c in self._referred(table, catalog)]
        source = f" WHERE {made['where']}"
        if made["from"]:
            source = f" JOIN {made['from']} ON {made['where']}"
            # Of several matches the first counts, in the order in which the rows of the other tables were stored; else the one of least values.
            stored = [(n, a) for n, a in parser.named if n in catalog["tables"]]
            frames |= {n: self.store.read(catalog["tables"][n], places=True) for n, _ in stored}
            order = [f"{quote_name(a)}.`{c}`" for _, a in stored for c in ("__part", "__row")] or [x.rpartition(" AS ")[0] for x in listed]
            listed.append(f"row_number() OVER (PARTITION BY {alias}.`__file`, {alias}.`__row` ORDER BY {', '.join(order)}) AS `__match`")
        frames["rows__"] = self.store.read(table, places=True)
        hit = self._run(f"SELECT {', '.join([*listed, *old])}, {alias}.`__file`, {alias}.`__row` FROM {{rows__}} AS {alias}{source}", frames)
        hit = self._stored(hit.where("__match = 1").drop("__match") if made["from"] else hit)
        before = self._stored(self.store.read(table, places=True).join(hit.select("__file", "__row"), ["__file", "__row"], "left_semi")) if old else hit
        new = self._generated(hit, table)
        new = self._stored(new) if any(c["generated"] for c in table["columns"]) else new
        self._without(hit, table, db)
        self._check(new.select(*map(quote_name, own)), table, catalog, inserted=True)
        table["parts"] += self.store.write(db, new.select(*map(quote_name, own)))
        if old:
            self._changed(before, table, catalog, db, "on_update", new)
        return self._returned(new.select(*map(quote_name, own)), made, table, "UPDATE", None)

    def _delete(self, made: dict[str, Any], parser: Statements, catalog: dict[str, Any], db: str) -> Result:
        table = self._table(made["table"], catalog)
        alias = quote_name(made["alias"] or made["table"].split(".")[-1])
        frames = self._frames(parser.used, catalog) | {"rows__": self.store.read(table, places=True)}
        if made["from"]:
            ids = self._run(f"SELECT DISTINCT {alias}.`__file`, {alias}.`__row` FROM {{rows__}} AS {alias} JOIN {made['from']} ON {made['where']}", frames)
            gone = frames["rows__"].join(ids, ["__file", "__row"], "left_semi")
        else:
            gone = self._run(f"SELECT * FROM {{rows__}} AS {alias} WHERE {made['where']}", frames)
        gone = self._stored(gone)
        self._without(gone, table, db)
        gone = gone.select(*[quote_name(c["name"]) for c in table["columns"]])
        self._changed(gone, table, catalog, db, "on_delete")
        return self._returned(gone, made, table, "DELETE", None)

    def _changed(self, before: DataFrame, table: dict[str, Any], catalog: dict[str, Any], db: str, event: str, moved: DataFrame | None = None) -> None:
        """What foreign keys want when rows have gone or changed.

        before: the rows as they were; moved, of an update: the new rows, with the old values of the columns that are
        referred to as __old_c.
        """
        for other in catalog["tables"].values():
            for c in other["constraints"]:
                if c["kind"] != "foreign" or self._table(c["table"], catalog)["name"] != table["name"]:
                    continue
                to = c["to"] or self._primary(table)
                own = [f"__was_{x}" for x in c["columns"]]
                lost = before.select(*to).distinct().subtract(self.store.read(table).select(*to)).toDF(*own)
                if moved is not None and c[event] == "CASCADE":
                    # A key that has become another one is followed, though another row may hold the old one by now.
                    ways = moved.select(*[F.col(quote_name(f"__old_{t}")).alias(w) for t, w in zip(to, own, strict=True)], *[F.col(quote_name(t)).alias(f"__now_{x}") for t, x in zip(to, c["columns"], strict=True)])
                    lost = ways.where(" OR ".join(f"NOT ({quote_name(w)} <=> {quote_name(f'__now_{x}')})" for w, x in zip(own, c["columns"], strict=True))).dropDuplicates(own)
                child = self.store.read(other, places=True)
                on = reduce(lambda a, b: a & b, [child[x] == lost[w] for x, w in zip(c["columns"], own, strict=True)])
                hit = self._stored(child.join(lost, on))
                if hit.isEmpty():
                    continue
                if c[event] not in ("CASCADE", "SET NULL", "SET DEFAULT"):
                    raise ConstraintError(f"Foreign Key Violation ({'Delete' if event == 'on_delete' else 'Update'}): {other['name']} refers to {table['name']}")
                self._without(hit, other, db)
                names = [quote_name(x["name"]) for x in other["columns"]]
                if c[event] == "CASCADE" and event == "on_delete":
                    self._changed(hit.select(*names), other, catalog, db, event)
                    continue
                defaults = {x["name"]: x["default"] for x in other["columns"]}
                changed = hit.withColumns({f"__old_{x}": F.col(quote_name(x)) for x in self._referred(other, catalog)})
                for x in c["columns"]:
                    value = F.col(quote_name(f"__now_{x}")) if c[event] == "CASCADE" else F.expr(defaults[x]) if c[event] == "SET DEFAULT" and defaults[x] else F.lit(None)
                    changed = changed.withColumn(x, value.cast(hit.schema[x].dataType))
                changed = self._stored(self._generated(changed, other))
                self._check(changed.select(*names), other, catalog, inserted=True)
                other["parts"] += self.store.write(db, changed.select(*names))
                if self._referred(other, catalog):
                    self._changed(hit.select(*names), other, catalog, db, "on_update", changed)

    def _truncate(self, made: dict[str, Any], parser: Statements, catalog: dict[str, Any], db: str) -> None:
        names = {self._table(n, catalog)["name"] for n in made["tables"]}
        while True:
            more = {t["name"] for t in catalog["tables"].values() for c in t["constraints"] if c["kind"] == "foreign" and self._table(c["table"], catalog)["name"] in names} - names
            if not more:
                break
            if not made["cascade"]:
                raise ConstraintError(f"Foreign Key Violation (Truncate): {sorted(more)[0]} refers to a table to be emptied")
            names |= more
        for n in names:
            table = self._table(n, catalog)
            table["parts"] = []
            if made["restart"]:
                table["next"] = 1

    # constraints
    @staticmethod
    def _primary(table: dict[str, Any]) -> list[str]:
        return next((c["columns"] for c in table["constraints"] if c["kind"] == "primary"), [])

    def _check(self, new: DataFrame, table: dict[str, Any], catalog: dict[str, Any], inserted: bool) -> None:
        """All row checks in one pass over the new rows, then a join for each key."""
        required = {c["name"] for c in table["columns"] if c["not_null"]} | set(self._primary(table))
        checks = [(f"Constraint Error: {c} cannot be null", F.col(quote_name(c)).isNull()) for c in sorted(required)]
        checks += [(f"Constraint Error: check {c['name']} is violated", ~F.expr(c["check"])) for c in table["constraints"] if c["kind"] == "check"]
        enums = catalog["types"]
        checks += [(f"Constraint Error: invalid value for {c['name']}", ~F.col(quote_name(c["name"])).isin(enums[c["sql_type"].lower()])) for c in table["columns"] if c["sql_type"].lower() in enums]
        if checks:
            broken = new.agg(*[F.coalesce(F.max(bad.cast("int")), F.lit(0)) for _, bad in checks]).first()
            for (text, _), value in zip(checks, broken, strict=True):
                if value:
                    raise ConstraintError(text)
        for c in table["constraints"]:
            if c["kind"] in ("primary", "unique"):
                key = new.select(*map(quote_name, c["columns"])).dropna()
                old = self.store.read(table).select(*map(quote_name, c["columns"])) if table["parts"] else key.limit(0)
                twice = key.groupBy(*map(quote_name, c["columns"])).agg(F.count("*").alias("__n")).where("__n > 1").limit(1).count()
                if twice or key.join(old, c["columns"], "left_semi").limit(1).count():
                    raise ConstraintError(f"Constraint Error: {', '.join(c['columns'])} must be unique")
            elif c["kind"] == "foreign":
                parent = self._table(c["table"], catalog)
                to = c["to"] or self._primary(parent)
                known = self.store.read(parent).select(*map(quote_name, to)).toDF(*c["columns"])
                if parent["name"] == table["name"]:
                    known = known.union(new.select(*map(quote_name, to)).toDF(*c["columns"]))
                if new.select(*map(quote_name, c["columns"])).dropna().join(known, c["columns"], "left_anti").limit(1).count():
                    raise ConstraintError(f"Foreign Key Violation (Insert): {', '.join(c['columns'])} of {table['name']} is not in {parent['name']}")

    def _returned(self, rows: DataFrame, made: dict[str, Any], table: dict[str, Any], command: str, count: int | None) -> Result:
        if made.get("returning"):
            alias = quote_name(made.get("alias") or made["table"].split(".")[-1])
            own = rows.select(*[quote_name(c["name"]) for c in table["columns"]]) if "__place" not in rows.columns else rows.orderBy("__place").drop("__place")
            return _result(self._run(f"SELECT {made['returning']} FROM {{rows__}} AS {alias}", {"rows__": own}), command)
        return Result(row_count=rows.count() if count is None else count, command=command)

    # definitions
    def _oid(self, catalog: dict[str, Any]) -> int:
        catalog["next_oid"] += 1
        return catalog["next_oid"] - 1

    def _create_schema(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        if made["name"] in catalog["schemas"]:
            if not made["maybe"]:
                raise SqlError(f"schema {made['name']} already exists")
            return
        catalog["schemas"].append(made["name"])

    def _drop_schema(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        for name in made["names"]:
            if name in ("public", "pg_catalog", "information_schema"):
                raise SqlError(f"schema {name} can't be dropped")
            if name not in catalog["schemas"]:
                if made["maybe"]:
                    continue
                raise SqlError(f"schema {name} does not exist")
            inside = [t for t in catalog["tables"] if t.startswith(f"{name}.")]
            if inside and not made["cascade"]:
                raise SqlError(f"schema {name} is not empty")
            for t in inside:
                del catalog["tables"][t]
            catalog["schemas"].remove(name)

    def _create_table(self, made: dict[str, Any], parser: Statements, catalog: dict[str, Any], db: str) -> Result | None:
        name = made["name"]
        if "." in name and name.split(".")[0] not in catalog["schemas"]:
            raise SqlError(f"schema {name.split('.')[0]} does not exist")
        if any(t.lower() == name.lower() for t in catalog["tables"]):
            if made["maybe"]:
                return None
            raise SqlError(f"relation {name} already exists")
        table = {"name": name, "columns": made["columns"], "constraints": [], "parts": [], "next": 1, "indexes": [], "comment": None, "oid": self._oid(catalog)}
        if "select" in made:
            df = self._select(made["select"], parser, catalog)
            table["columns"] = [{"name": f.name, "type": f.dataType.simpleString(), "sql_type": f.dataType.simpleString().upper(), "not_null": False, "default": None, "generated": None, "serial": False, "comment": None} for f in df.schema.fields]
            table["parts"] = self.store.write(db, df)
        schema_of(table)
        catalog["tables"][name] = table
        for c in made["constraints"]:
            self._add(c, table, catalog)
        return None

    def _add(self, constraint: dict[str, Any], table: dict[str, Any], catalog: dict[str, Any]) -> None:
        short = table["name"].split(".")[-1]
        ends = {"primary": "pkey", "unique": f"{'_'.join(constraint['columns'])}_key", "foreign": f"{'_'.join(constraint['columns'])}_fkey", "check": f"{'_'.join(constraint['columns'])}_check".lstrip("_")}
        constraint["name"] = constraint["name"] or f"{short}_{ends[constraint['kind']]}"
        known = {c["name"].lower() for c in table["columns"]}
        for c in constraint["columns"]:
            if c.lower() not in known:
                raise SqlError(f"column {c} does not exist")
        if constraint["kind"] == "foreign":
            parent = self._table(constraint["table"], catalog)
            if not (constraint["to"] or self._primary(parent)):
                raise SqlError(f"{parent['name']} has no primary key")
        constraint["oid"] = self._oid(catalog)
        table["constraints"].append(constraint)

    def _drop_table(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        gone = set()
        for name in made["names"]:
            try:
                gone.add(self._table(name, catalog)["name"])
            except SqlError:
                if not made["maybe"]:
                    raise
        for t in catalog["tables"].values():
            if t["name"] in gone:
                continue
            for c in [c for c in t["constraints"] if c["kind"] == "foreign" and self._table(c["table"], catalog)["name"] in gone]:
                if not made["cascade"]:
                    raise ConstraintError(f"{t['name']} refers to {c['table']}")
                t["constraints"].remove(c)
        for name in gone:
            del catalog["tables"][name]

    def _create_index(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        table = self._table(made["table"], catalog)
        if any(i["name"] == made["name"] for t in catalog["tables"].values() for i in t["indexes"]):
            if made["maybe"]:
                return
            raise SqlError(f"index {made['name']} already exists")
        table["indexes"].append({"name": made["name"], "columns": made["columns"], "unique": made["unique"], "text": made["text"], "oid": self._oid(catalog)})
        if made["unique"] and made["columns"]:
            constraint = {"kind": "unique", "columns": made["columns"], "name": made["name"]}
            self._validate(constraint, table)
            self._add(constraint, table, catalog)

    def _drop_index(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        for name in made["names"]:
            held = [t for t in catalog["tables"].values() if any(i["name"] == name for i in t["indexes"])]
            if not held and not made["maybe"]:
                raise SqlError(f"index {name} does not exist")
            for t in held:
                t["indexes"] = [i for i in t["indexes"] if i["name"] != name]
                t["constraints"] = [c for c in t["constraints"] if c["name"] != name]

    def _create_type(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        if made["name"].lower() in catalog["types"]:
            raise SqlError(f"type {made['name']} already exists")
        catalog["types"][made["name"].lower()] = made["values"]

    def _drop_type(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        for name in made["names"]:
            if catalog["types"].pop(name.lower(), None) is None and not made["maybe"]:
                raise SqlError(f"type {name} does not exist")

    def _add_value(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        values = catalog["types"].get(made["name"].lower())
        if values is None:
            raise SqlError(f"type {made['name']} does not exist")
        if made["value"] in values:
            if not made["maybe"]:
                raise SqlError(f"{made['value']} is a value of {made['name']} already")
            return
        values.append(made["value"])

    def _comment(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        if made["on"] == "table":
            self._table(".".join(made["parts"]).removeprefix("public."), catalog)["comment"] = made["text"]
        elif made["on"] == "column":
            table = self._table(".".join(made["parts"][:-1]).removeprefix("public."), catalog)
            self._column(table, made["parts"][-1])["comment"] = made["text"]

    @staticmethod
    def _column(table: dict[str, Any], name: str) -> dict[str, Any]:
        found = next((c for c in table["columns"] if c["name"].lower() == name.lower()), None)
        if not found:
            raise SqlError(f"column {name} does not exist")
        return found

    def _validate(self, c: dict[str, Any], table: dict[str, Any]) -> None:
        key = self.store.read(table).select(*map(quote_name, c["columns"]))
        if c["kind"] == "primary" and key.where(" OR ".join(f"{quote_name(x)} IS NULL" for x in c["columns"])).limit(1).count():
            raise ConstraintError(f"Constraint Error: {c['columns'][0]} cannot be null")
        if key.dropna().groupBy(*map(quote_name, c["columns"])).agg(F.count("*").alias("__n")).where("__n > 1").limit(1).count():
            raise ConstraintError(f"Constraint Error: {', '.join(c['columns'])} must be unique")

    def _alter(self, made: dict[str, Any], parser: Any, catalog: dict[str, Any], db: str) -> None:
        try:
            table = self._table(made["table"], catalog)
        except SqlError:
            if made["maybe"]:
                return
            raise
        for a in made["actions"]:
            self._alter_once(a, table, catalog, db)

    def _alter_once(self, a: dict[str, Any], table: dict[str, Any], catalog: dict[str, Any], db: str) -> None:
        do = a["do"]
        if do == "add_column":
            c = a["column"]
            if any(x["name"].lower() == c["name"].lower() for x in table["columns"]):
                if a["maybe"]:
                    return
                raise SqlError(f"column {c['name']} already exists")
            df = self.store.read(table) if table["parts"] else None
            table["columns"].append(c)
            if df is not None:
                value = F.expr(c["generated"] or c["default"] or "NULL")
                if c["not_null"] and not (c["default"] or c["generated"]) and df.limit(1).count():
                    raise ConstraintError(f"Constraint Error: {c['name']} cannot be null")
                if c["default"] or c["generated"]:
                    table["parts"] = self.store.write(db, df.withColumn(c["name"], value.cast(c["type"])))
            for x in a["constraints"]:
                self._add(x, table, catalog)
        elif do == "drop_column":
            if not any(x["name"].lower() == a["name"].lower() for x in table["columns"]):
                if a["maybe"]:
                    return
                raise SqlError(f"column {a['name']} does not exist")
            own = self._column(table, a["name"])["name"]
            df = self.store.read(table).drop(own) if table["parts"] else None
            table["columns"] = [x for x in table["columns"] if x["name"] != own]
            table["constraints"] = [x for x in table["constraints"] if own not in x["columns"]]
            if df is not None:
                table["parts"] = self.store.write(db, df)
        elif do == "rename_column":
            column = self._column(table, a["name"])
            df = self.store.read(table).withColumnRenamed(column["name"], a["to"]) if table["parts"] else None
            renamed = lambda names: [a["to"] if x == column["name"] else x for x in names]
            for x in table["constraints"]:
                x["columns"] = renamed(x["columns"])
            for t in catalog["tables"].values():
                for x in t["constraints"]:
                    if x["kind"] == "foreign" and x["to"] and self._table(x["table"], catalog) is table:
                        x["to"] = renamed(x["to"])
            column["name"] = a["to"]
            if df is not None:
                table["parts"] = self.store.write(db, df)
        elif do == "rename_table":
            del catalog["tables"][table["name"]]
            schema, dot, _ = table["name"].rpartition(".")
            old, table["name"] = table["name"], f"{schema}{dot}{a['to']}"
            catalog["tables"][table["name"]] = table
            for t in catalog["tables"].values():
                for x in t["constraints"]:
                    if x["kind"] == "foreign" and x["table"].lower() == old.lower():
                        x["table"] = table["name"]
        elif do == "set_type":
            column = self._column(table, a["name"])
            df = self.store.read(table) if table["parts"] else None
            column["type"], column["sql_type"] = a["type"], a["sql_type"]
            if df is not None:
                value = F.expr(a["using"]) if a.get("using") else F.col(quote_name(column["name"]))
                table["parts"] = self.store.write(db, df.withColumn(column["name"], value.cast(a["type"])))
        elif do == "set_default":
            self._column(table, a["name"]).update(default=a["default"], default_text=a.get("text"))
        elif do == "set_not_null":
            column = self._column(table, a["name"])
            if a["value"] and self.store.read(table).where(F.col(quote_name(column["name"])).isNull()).limit(1).count():
                raise ConstraintError(f"Constraint Error: {column['name']} cannot be null")
            column["not_null"] = a["value"]
        elif do == "add_constraint":
            if a["constraint"]["kind"] in ("primary", "unique"):
                self._validate(a["constraint"], table)
            self._add(a["constraint"], table, catalog)
        elif do == "drop_constraint":
            if not any(x["name"] == a["name"] for x in table["constraints"]) and not a["maybe"]:
                raise SqlError(f"constraint {a['name']} does not exist")
            table["constraints"] = [x for x in table["constraints"] if x["name"] != a["name"]]


def _result(df: DataFrame, command: str) -> Result:
    names = df.columns
    rows = [dict(zip(names, r, strict=True)) for r in df.collect()]
    return Result(rows, len(rows), list(dict.fromkeys(names)), command)


# what the catalog tells of itself
@dataclass(frozen=True)
class View:
    """Rows that follow from the catalog; they lie with the driver, as the catalog does."""

    schema: str
    rows: Callable[[dict[str, Any]], Iterable[tuple]]

    def __call__(self, spark: SparkSession, catalog: dict[str, Any]) -> DataFrame:
        return spark.createDataFrame(list(self.rows(catalog)), self.schema)


_view = View


def _split(name: str) -> tuple[str, str]:
    schema, _, short = name.rpartition(".")
    return schema or "public", short


def _constraints(catalog: dict[str, Any]) -> Iterator[tuple[dict[str, Any], dict[str, Any]]]:
    for t in catalog["tables"].values():
        for c in t["constraints"]:
            yield t, c


def _default(column: dict[str, Any]) -> str | None:
    """As it was written; a literal text without its quotes."""
    text = column.get("default_text") or column["default"]
    return text[1:-1].replace("''", "'") if text and re.fullmatch(r"'(?:[^']|'')*'", text) else text


def _named(catalog: dict[str, Any], name: str) -> dict[str, Any]:
    return next(t for n, t in catalog["tables"].items() if n.lower() == name.lower())


def _places(table: dict[str, Any], columns: list[str]) -> str:
    numbers = {c["name"].lower(): i + 1 for i, c in enumerate(table["columns"])}
    return " ".join(str(numbers[c.lower()]) for c in columns)


def _indexes(catalog: dict[str, Any]) -> Iterator[tuple[dict[str, Any], dict[str, Any]]]:
    """Keys, and indexes that are not the one of a key."""
    for t, c in _constraints(catalog):
        if c["kind"] in ("primary", "unique"):
            yield t, c
    for t in catalog["tables"].values():
        names = {c["name"] for c in t["constraints"]}
        for i in t["indexes"]:
            if i["name"] not in names:
                yield t, i


def _schema_oid(table: str, catalog: dict[str, Any]) -> int:
    schema = _split(table)[0]
    return _OIDS.get(schema, 20000 + catalog["schemas"].index(schema))


_OIDS = {"public": 2200, "pg_catalog": 11, "information_schema": 12345}
SYSTEM = {
    "information_schema.schemata": _view("catalog_name string, schema_name string", lambda c: [("main", s) for s in c["schemas"]]),
    "information_schema.tables": _view("table_catalog string, table_schema string, table_name string, table_type string", lambda c: [("main", *_split(t), "BASE TABLE") for t in c["tables"]]),
    "information_schema.columns": _view(
        "table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string",
        lambda c: [(*_split(n), x["name"], i + 1, _default(x), "NO" if x["not_null"] else "YES", x["sql_type"].lower()) for n, t in c["tables"].items() for i, x in enumerate(t["columns"])],
    ),
    "information_schema.referential_constraints": _view("constraint_schema string, constraint_name string, update_rule string, delete_rule string", lambda c: [(_split(t["name"])[0], x["name"], x["on_update"], x["on_delete"]) for t, x in _constraints(c) if x["kind"] == "foreign"]),
    "information_schema.table_constraints": _view("table_schema string, table_name string, constraint_name string, constraint_type string", lambda c: [(*_split(t["name"]), x["name"], {"primary": "PRIMARY KEY", "unique": "UNIQUE", "foreign": "FOREIGN KEY", "check": "CHECK"}[x["kind"]]) for t, x in _constraints(c)]),
    "pg_namespace": _view("oid long, nspname string", lambda c: [(_OIDS.get(s, 20000 + i), s) for i, s in enumerate(c["schemas"])]),
    "pg_class": _view("oid long, relname string, relnamespace long, relkind string", lambda c: [(t["oid"], _split(n)[1], _schema_oid(n, c), "r") for n, t in c["tables"].items()] + [(i["oid"], i["name"], _schema_oid(t["name"], c), "i") for t, i in _indexes(c)]),
    "pg_attribute": _view("attrelid long, attname string, attnum int, attnotnull boolean, atttypid string, atthasdef boolean", lambda c: [(t["oid"], x["name"], i + 1, x["not_null"], x["sql_type"].lower(), x["default"] is not None) for t in c["tables"].values() for i, x in enumerate(t["columns"])]),
    "pg_attrdef": _view("adrelid long, adnum int, adbin string", lambda c: [(t["oid"], i + 1, _default(x)) for t in c["tables"].values() for i, x in enumerate(t["columns"]) if x["default"] is not None]),
    "pg_description": _view("objoid long, objsubid int, description string", lambda c: [(t["oid"], 0, t["comment"]) for t in c["tables"].values() if t["comment"]] + [(t["oid"], i + 1, x["comment"]) for t in c["tables"].values() for i, x in enumerate(t["columns"]) if x["comment"]]),
    "pg_index": _view("indexrelid long, indrelid long, indname string, indisunique boolean, indisprimary boolean, indkey string", lambda c: [(i["oid"], t["oid"], i["name"], i.get("unique", True), i.get("kind") == "primary", _places(t, i["columns"])) for t, i in _indexes(c)]),
    "pg_constraint": _view(
        "oid long, conname string, conrelid long, confrelid long, contype string, conkey string, confkey string",
        lambda c: [(x["oid"], x["name"], t["oid"], *((None,) if x["kind"] != "foreign" else (_named(c, x["table"])["oid"],)), x["kind"][0], _places(t, x["columns"]), None if x["kind"] != "foreign" else _places(_named(c, x["table"]), x["to"] or Database._primary(_named(c, x["table"])))) for t, x in _constraints(c)],
    ),
    "pg_type": _view("oid long, typname string, typtype string", lambda c: [(30000 + i, n, "e") for i, n in enumerate(c["types"])]),
    "pg_enum": _view("enumtypid long, enumsortorder int, enumlabel string", lambda c: [(30000 + i, k + 1, v) for i, vs in enumerate(c["types"].values()) for k, v in enumerate(vs)]),
}
_SYSTEM_COLUMNS = {name: {part.split()[0] for part in view.schema.split(", ")} for name, view in SYSTEM.items()}
