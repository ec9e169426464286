"""Recursive descent over the dialect; every method returns Spark SQL text.

Only what differs is rewritten: null order, DISTINCT ON, default names, casts, operators on JSON, arrays and patterns,
ordered aggregates, window frames. Resolution, typing and planning are left to Catalyst.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from tarn.dialect import calls
from tarn.dialect.lexer import SqlError, Token, quote_name, quote_text, tokens

#: Type names of the dialect that Spark calls otherwise.
TYPES = {
    "INT": "INT", "INTEGER": "INT", "INT4": "INT", "INT2": "SMALLINT", "SMALLINT": "SMALLINT", "INT8": "BIGINT", "BIGINT": "BIGINT", "OID": "BIGINT", "SERIAL": "INT", "BIGSERIAL": "BIGINT", "SMALLSERIAL": "SMALLINT",
    "NUMBER": "DOUBLE", "MONEY": "DOUBLE", "REAL": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE", "FLOAT": "DOUBLE", "DOUBLE": "DOUBLE", "DOUBLE PRECISION": "DOUBLE", "NUMERIC": "DOUBLE", "DECIMAL": "DOUBLE",
    "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP_NTZ", "TIMESTAMPTZ": "TIMESTAMP_NTZ", "DATETIME": "TIMESTAMP_NTZ",
}
_STOP = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "ON", "JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "USING", "AS", "SET", "RETURNING", "WINDOW", "WHEN", "THEN", "ELSE", "END", "AND", "OR", "NOT", "IN", "IS", "BETWEEN", "LIKE", "ILIKE", "VALUES", "SELECT", "WITH", "ASC", "DESC", "NULLS", "FETCH", "FOR", "DO", "CONFLICT", "LATERAL", "QUALIFY", "ESCAPE"}
_ORDERED = {"array_agg", "json_agg", "jsonb_agg", "string_agg"}
#: Functions that give the place of a row in its group.
PLACES = {"row_number", "rank", "dense_rank"}
#: Functions that take the rows of a group.
AGGREGATES = _ORDERED | {"count", "sum", "avg", "min", "max", "json_object_agg", "jsonb_object_agg", "bool_and", "bool_or", "every", "any_value", "first", "last", "stddev", "stddev_pop", "stddev_samp", "variance", "var_pop", "var_samp", "corr"}
_NOW = {"CURRENT_TIMESTAMP": "CAST(current_timestamp() AS TIMESTAMP_NTZ)", "LOCALTIMESTAMP": "CAST(current_timestamp() AS TIMESTAMP_NTZ)", "CURRENT_DATE": "current_date()", "CURRENT_TIME": "date_format(current_timestamp(), 'HH:mm:ss.SSS')", "LOCALTIME": "date_format(current_timestamp(), 'HH:mm:ss.SSS')"}


def literal(value: object) -> str:
    """A bound parameter as Spark SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return f"{value}" if -(2**31) <= value < 2**31 else f"{value}L"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, Decimal):
        return f"{value}BD"
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value:%Y-%m-%d %H:%M:%S.%f}'"
    if isinstance(value, date):
        return f"DATE '{value:%Y-%m-%d}'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    if isinstance(value, Mapping):
        import json

        return quote_text(json.dumps(value))
    return quote_text(str(value))


class Parser:
    def __init__(self, sql: str, params: Sequence | Mapping | None = None, tables: Mapping[str, str] | None = None) -> None:
        self.sql, self.all, self.k = sql, tokens(sql), 0
        self.params, self.tables = params if params is not None else (), tables or {}
        self.used: set[str] = set()
        self.ctes: list[set[str]] = []
        #: What 'name'::regclass, ::regnamespace and ::regtype stand for.
        self.oids: Mapping[str, int] = {}
        #: Recursions without ALL: name, column list, first rows and step.
        self.rounds: list[tuple[str, str, str, str]] = []
        #: Tables that FROM names, with their aliases.
        self.named: list[tuple[str, str]] = []
        #: Columns of each table, in lower case; a quoted word that names nothing is a text.
        self.columns: Mapping[str, set[str]] = {}
        #: Whether columns outside GROUP BY stand for their value in some row of the group.
        self.loose = False
        #: Whether the query that comes next stands behind LATERAL: its first rows are then taken by a rank.
        self.ranked = False
        #: Keys of the groupings that are being read, innermost last; None within an aggregate.
        self.grouping: list[set[str] | None] = [None]
        #: Places within groups that have been read, by their text: function, keys and order.
        self.places: dict[str, tuple[str, list[str], list[tuple[str, bool, bool]]]] = {}
        #: How deep the query that is being read lies in others.
        self.level = 0
        #: Pieces of outermost queries that number rows or skip some, by their text.
        self.shapes: dict[str, Shape] = {}

    # tokens
    @property
    def now(self) -> Token:
        return self.all[self.k]

    def ahead(self, n: int = 1) -> Token:
        return self.all[min(self.k + n, len(self.all) - 1)]

    def take(self) -> Token:
        self.k += 1
        return self.all[self.k - 1]

    def has(self, *words: str) -> bool:
        return all(self.ahead(i).upper == w or (self.ahead(i).kind == "op" and self.ahead(i).value == w) for i, w in enumerate(words))

    def accept(self, *words: str) -> bool:
        if self.has(*words):
            self.k += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.accept(*words):
            raise SqlError(f"expected {' '.join(words)} before {self.sql[self.now.at : self.now.at + 30]!r}")

    def name(self) -> str:
        if self.now.kind not in ("word", "name"):
            raise SqlError(f"expected a name before {self.sql[self.now.at : self.now.at + 30]!r}")
        return self.take().value

    def names(self) -> list[str]:
        """(a, b, ...)"""
        self.expect("(")
        found = [self.name()]
        while self.accept(","):
            found.append(self.name())
        self.expect(")")
        return found

    def table_name(self) -> str:
        found = self.name()
        if self.accept("."):
            found = f"{found}.{self.name()}"
        return found.removeprefix("public.")

    # types
    def type(self) -> str:
        word = self.name().upper()
        if word == "DOUBLE" and self.has("PRECISION"):
            self.take()
        if word == "CHARACTER" and self.has("VARYING"):
            self.take()
        sizes: list[str] = []
        if self.accept("("):
            while not self.accept(")"):
                sizes.append(self.take().value)
        for tail in (("WITH", "TIME", "ZONE"), ("WITHOUT", "TIME", "ZONE")):
            self.accept(*tail)
        made = TYPES.get(word, "STRING")
        if word in ("NUMERIC", "DECIMAL") and sizes:
            made = f"DECIMAL({''.join(sizes) if len(sizes) > 1 else sizes[0] + ',0'})"
        while self.accept("["):
            while not self.accept("]"):
                self.take()
            made = f"ARRAY<{made}>"
        return "ARRAY<STRING>" if word == "ARRAY" else made

    # expressions
    def expr(self) -> str:
        left = self.conjunction()
        while self.accept("OR"):
            left = f"({left} OR {self.conjunction()})"
        return left

    def conjunction(self) -> str:
        left = self.negation()
        while self.accept("AND"):
            left = f"({left} AND {self.negation()})"
        return left

    def negation(self) -> str:
        return f"(NOT {self.negation()})" if self.accept("NOT") else self.comparison()

    def comparison(self) -> str:
        left = self.json_ops()
        while True:
            no = "NOT " if self.has("NOT") and self.ahead().upper in ("IN", "LIKE", "ILIKE", "BETWEEN") else ""
            self.k += bool(no)
            if self.accept("IS"):
                no = "NOT " if self.accept("NOT") else ""
                if self.accept("DISTINCT", "FROM"):
                    left = f"({left} IS {no}DISTINCT FROM {self.json_ops()})"
                else:
                    left = f"({left} IS {no}{self.take().upper})"
            elif self.accept("BETWEEN"):
                low = self.json_ops()
                self.expect("AND")
                left = f"({left} {no}BETWEEN {low} AND {self.json_ops()})"
            elif self.has("LIKE") or self.has("ILIKE"):
                word = self.take().upper
                made = f"{left} {no}{word} {self.json_ops()}"
                if self.accept("ESCAPE"):
                    made += f" ESCAPE {self.primary()}"
                left = f"({made})"
            elif self.accept("IN"):
                left = f"({left} {no}IN {self.in_list()})"
            elif self.now.kind == "op" and self.now.value in ("=", "<>", "!=", "<", ">", "<=", ">="):
                op = self.take().value
                if self.has("ANY") or self.has("ALL") or self.has("SOME"):
                    left = self.quantified(left, op, self.take().upper == "ALL")
                else:
                    left = f"({left} {op} {self.json_ops()})"
            elif self.now.kind == "op" and self.now.value in ("~", "~*", "!~", "!~*", "~~", "~~*", "!~~", "!~~*"):
                op = self.take().value
                right = self.json_ops()
                no = "NOT " if op[0] == "!" else ""
                core = op.lstrip("!")
                if core == "~":
                    left = f"({left} {no}RLIKE {right})"
                elif core == "~*":
                    left = f"({left} {no}RLIKE concat('(?i)', {right}))"
                else:
                    left = f"({left} {no}{'ILIKE' if core.endswith('*') else 'LIKE'} {right})"
            else:
                return left

    def quantified(self, left: str, op: str, every: bool) -> str:
        """left op ANY (...) or ALL (...), over a query or an array."""
        self.expect("(")
        if not (self.has("SELECT") or self.has("WITH") or self.has("VALUES")):
            made = f"{'forall' if every else 'exists'}({self.expr()}, x -> {left} {op} x)"
        elif op == "=" and not every:
            made = f"({left} IN ({self.apart(self.query)}))"
        elif op in ("<>", "!=") and every:
            made = f"({left} NOT IN ({self.apart(self.query)}))"
        else:
            rows = f"({self.apart(self.query)}) AS `s__`(`v__`)"
            if "`" in left:
                made = f"NOT EXISTS (SELECT 1 FROM {rows} WHERE NOT coalesce({left} {op} `v__`, FALSE))" if every else f"EXISTS (SELECT 1 FROM {rows} WHERE {left} {op} `v__`)"
            else:
                made = f"(SELECT coalesce({'bool_and' if every else 'bool_or'}({left} {op} `v__`), {str(every).upper()}) FROM {rows})"
        self.expect(")")
        return f"({made})"

    def in_list(self) -> str:
        if self.now.kind == "param":
            value = self.value_of(self.take())
            return f"({', '.join(map(literal, value)) or 'NULL'})" if isinstance(value, (list, tuple)) else f"({literal(value)})"
        self.expect("(")
        if self.has("SELECT") or self.has("WITH") or self.has("VALUES"):
            made = self.apart(self.query)
        else:
            items = []
            while True:
                if self.now.kind == "param" and isinstance(value := self.value_of(self.now), (list, tuple)):
                    self.take()
                    items += [literal(v) for v in value]
                else:
                    items.append(self.expr())
                if not self.accept(","):
                    break
            made = ", ".join(items) or "NULL"
        self.expect(")")
        return f"({made})"

    def json_ops(self) -> str:
        left = self.sum()
        while self.now.kind == "op" and self.now.value in ("->", "->>", "#>", "#>>", "#-", "@>", "<@", "?", "&&"):
            op, right = self.take().value, self.sum()
            if op == "->":
                left = calls.json_get(left, [right])
            elif op == "->>":
                left = calls.json_text(left, [right])
            elif op in ("#>", "#>>"):
                keys = re.fullmatch(r"array\((.*)\)", self.path(right), re.S)
                parts = [x for x in re.findall(r"'(?:[^'\\]|\\.)*'", keys[1])] if keys else [right]
                left = (calls.json_text if op == "#>>" else calls.json_get)(left, parts) if keys else f"tarn_json_get({left}, {right}, {str(op == '#>>').lower()})"
            elif op == "#-":
                left = calls.json(f"tarn_json_delete({left}, {self.path(right)})")
            elif op == "?":
                left = f"array_contains({left}, {right})" if is_array(left) else calls.json_has(left, right)
            elif op == "&&":
                left = f"arrays_overlap({left}, {right})"
            else:
                a, b = (left, right) if op == "@>" else (right, left)
                left = f"(size(array_except({b}, {a})) = 0)" if is_array(a) or is_array(b) else calls.json_contains(a, b)
        return left

    def path(self, sql: str) -> str:
        """'{a,b}' as an array of text."""
        if m := re.fullmatch(r"'\{(.*)\}'", sql, re.S):
            return f"array({', '.join(quote_text(p.strip().strip(chr(34))) for p in m[1].split(',') if p)})"
        return sql

    def sum(self) -> str:
        left = self.product()
        while self.now.kind == "op" and self.now.value in ("+", "-", "||"):
            op, right = self.take().value, self.product()
            if op == "||":
                left = f"({self.concat(left, right)})"
            elif op == "-" and calls.is_json(left):
                left = calls.json_minus(left, right, right if is_array(right) else f"array(CAST({right} AS STRING))")
            else:
                left = f"({left} {op} {right})"
        return left

    def concat(self, left: str, right: str) -> str:
        if calls.is_json(left) or calls.is_json(right):
            return calls.json_concat(left, right)
        if is_array(left) and not is_array(right):
            return f"array_append({left}, {right})"
        if is_array(right) and not is_array(left):
            return f"array_prepend({right}, {left})"
        return f"{left} || {right}"

    def product(self) -> str:
        left = self.power()
        while self.now.kind == "op" and self.now.value in ("*", "/", "%"):
            op = self.take().value
            left = f"({left} {op} {self.power()})"
        return left

    def power(self) -> str:
        left = self.unary()
        while self.accept("^"):
            left = f"power({left}, {self.unary()})"
        return left

    def unary(self) -> str:
        if self.accept("-"):
            inner = self.unary()
            return f"-{inner}" if re.fullmatch(r"[0-9.]+", inner) else f"(-{inner})"
        if self.accept("+"):
            return self.unary()
        made = self.primary()
        while True:
            if self.accept("::"):
                made = self.cast(made, self.now.upper, self.type())
            elif self.now.kind == "op" and self.now.value == "[" and made:
                self.take()
                made = f"get({made}, {self.expr()} - 1)"
                self.expect("]")
            elif self.accept("AT", "TIME", "ZONE"):
                self.primary()
            else:
                return made

    def cast(self, made: str, word: str, kind: str) -> str:
        if word in ("REGCLASS", "REGTYPE", "REGNAMESPACE"):
            named = re.fullmatch(r"'([^']*)'", made)
            if not named:
                return made
            key = named[1].replace('"', "").removeprefix("public.").removeprefix("pg_catalog.").lower()
            if key not in self.oids:
                raise SqlError(f"{named[1]} does not exist")
            return f"{self.oids[key]}L"
        if word in ("JSON", "JSONB"):
            return calls.json_valid(made)
        if kind.startswith("ARRAY<") and (m := re.fullmatch(r"'\{(.*)\}'", made, re.S)):
            parts = [p.strip() for p in m[1].split(",") if p.strip()]
            return f"CAST(array({', '.join('NULL' if p.upper() == 'NULL' else quote_text(p.strip(chr(34))) for p in parts)}) AS {kind})"
        return f"try_cast({made} AS {kind})"

    def value_of(self, token: Token) -> object:
        if token.value.isdigit():
            if not isinstance(self.params, Sequence) or int(token.value) > len(self.params) or int(token.value) < 1:
                raise SqlError(f"bind message supplies {len(self.params)} parameters, but ${token.value} is needed")
            return self.params[int(token.value) - 1]
        if not isinstance(self.params, Mapping) or token.value not in self.params:
            raise SqlError(f"there is no parameter named {token.value}")
        return self.params[token.value]

    def primary(self) -> str:
        t = self.now
        if t.kind == "number":
            self.take()
            return f"{t.value}D" if re.search(r"[.eE]", t.value) else t.value if int(t.value) < 2**31 else f"{t.value}L"
        if t.kind == "text":
            self.take()
            return quote_text(t.value)
        if t.kind == "param":
            return self.parameter(self.value_of(self.take()))
        if self.accept("("):
            if self.has("SELECT") or self.has("WITH") or self.has("VALUES"):
                made = self.apart(self.query)
                self.expect(")")
                # Beside aggregates a subquery stands for its value in the group's first row.
                return f"first(({made}))" if self.grouping[-1] is not None else f"({made})"
            else:
                parts = [self.expr()]
                while self.accept(","):
                    parts.append(self.expr())
                made = ", ".join(parts)
            self.expect(")")
            return f"({made})"
        if self.has("EXISTS", "("):
            self.k += 2
            made = self.apart(self.query)
            self.expect(")")
            return f"EXISTS ({made})"
        if self.accept("CASE"):
            return self.case()
        if self.accept("CAST", "("):
            made = self.expr()
            self.expect("AS")
            word = self.now.upper
            made = self.cast(made, word, self.type())
            self.expect(")")
            return made
        if self.accept("EXTRACT", "("):
            part = self.take().value
            self.expect("FROM")
            made = calls.date_part(part, self.expr())
            self.expect(")")
            return made
        if self.has("INTERVAL") and self.ahead().kind == "text":
            self.take()
            n, _, unit = self.take().value.strip().partition(" ")
            if not unit:
                unit = self.take().value
            return f"INTERVAL '{n}' {unit.strip().upper().removesuffix('S')}"
        if t.upper in ("DATE", "TIMESTAMP") and self.ahead().kind == "text":
            self.take()
            return f"CAST({quote_text(self.take().value)} AS {TYPES[t.upper]})"
        if self.has("ARRAY", "["):
            self.k += 2
            parts = []
            while not self.accept("]"):
                parts.append(self.expr())
                self.accept(",")
            return f"array({', '.join(parts)})"
        if t.upper in ("NULL", "TRUE", "FALSE"):
            return self.take().upper
        if t.upper in _NOW and self.ahead().value != "(":
            self.take()
            return _NOW[t.upper]
        if t.kind in ("word", "name"):
            return self.reference()
        if self.accept("*"):
            return "*"
        raise SqlError(f"unexpected {self.sql[t.at : t.at + 30]!r}")

    def apart(self, read: Callable[[], str]) -> str:
        """What is read within a subquery or an aggregate: columns there have nothing to do with the grouping outside."""
        self.grouping.append(None)
        try:
            return read()
        finally:
            self.grouping.pop()

    def parameter(self, value: object) -> str:
        """A bound value; a text such as t.c stands for the column where the statement has a relation t with a column c."""
        if isinstance(value, str) and (m := re.fullmatch(r"([^\W\d]\w*)\.([^\W\d]\w*)", value)):
            named = any(t.kind in ("word", "name") and t.value.lower() == m[1].lower() for t in self.all)
            if named and any(m[2].lower() in c for c in self.columns.values()):
                return self.grouped(f"{quote_name(m[1])}.{quote_name(m[2])}")
        return literal(value)

    def grouped(self, column: str) -> str:
        keys = self.grouping[-1]
        if keys is None or column in keys or column.rpartition(".")[2] in {k.rpartition(".")[2] for k in keys}:
            return column
        return f"first({column})"

    def is_text(self, token: Token) -> bool:
        """Whether a word in double quotes names nothing: no column, and nothing else in the statement."""
        lower = token.value.lower()
        known = any(lower in c for c in self.columns.values()) or not self.columns
        return token.kind == "name" and not known and sum(t.value.lower() == lower for t in self.all if t.kind in ("word", "name")) == 1

    def case(self) -> str:
        made = "CASE"
        if not self.has("WHEN"):
            made += f" {self.expr()}"
        while self.accept("WHEN"):
            made += f" WHEN {self.expr()}"
            self.expect("THEN")
            made += f" THEN {self.expr()}"
        if self.accept("ELSE"):
            made += f" ELSE {self.expr()}"
        self.expect("END")
        return f"{made} END"

    def reference(self) -> str:
        first = self.take()
        if self.now.value == "(" and self.now.kind == "op":
            return self.function(first.value)
        parts = [first.value]
        while self.accept("."):
            if self.accept("*"):
                return ".".join(map(quote_name, parts)) + ".*"
            parts.append(self.name())
            if self.now.value == "(" and self.now.kind == "op":
                return self.function(parts[-1])
        if len(parts) == 1 and self.is_text(first):
            return quote_text(first.value)
        return self.grouped(".".join(map(quote_name, parts[-2:])))

    def function(self, name: str) -> str:
        self.expect("(")
        lower = name.lower()
        distinct = self.accept("DISTINCT")
        args: list[str] = []
        order: list[tuple[str, bool, bool]] = []
        closing = self.all[self.closes(self.k - 1) + 1].upper
        if lower in AGGREGATES and closing != "OVER":
            self.grouping.append(None)
        while not self.accept(")"):
            if self.accept("*"):
                args.append("*")
            elif self.accept("ORDER", "BY"):
                order = self.order_keys()
            elif self.has("FROM") or self.has("FOR"):  # substring(x FROM a FOR b)
                self.take()
                args.append(self.expr())
            else:
                args.append(self.expr())
            self.accept(",")
        if lower in ("obj_description", "col_description"):
            place = args[1] if lower == "col_description" else "0"
            made = f"(SELECT max(d.description) FROM {self.relation_name('pg_description')} AS d WHERE d.objoid = {args[0]} AND d.objsubid = {place})"
        elif order and lower in _ORDERED:
            made = self.ordered(lower, args, order, distinct)
        elif distinct:
            made = f"{lower}(DISTINCT {', '.join(args)})"
        else:
            if lower in ("jsonb_set", "json_set", "jsonb_insert", "json_insert") and len(args) > 1:
                args[1] = self.path(args[1])
            made = calls.call(lower, args)
        test = ""
        if self.accept("FILTER", "(", "WHERE"):
            test = f" FILTER (WHERE {self.expr()})"
            self.expect(")")
        if lower in AGGREGATES and closing != "OVER":
            self.grouping.pop()
        if calls.FILTER in made:
            made = made.replace(calls.FILTER, test)
        elif test and made.startswith(f"{lower}("):
            made += test
        elif test:
            raise SqlError(f"{name} takes no FILTER")
        if self.accept("OVER"):
            spec, keys, order = self.window(lower)
            made = f"{made} OVER ({spec})"
            if lower in PLACES and order and not args:
                self.places[made] = (lower, keys, order)
        return made

    def ordered(self, lower: str, args: list[str], order: list[tuple[str, bool, bool]], distinct: bool) -> str:
        fields = ", ".join(f"{e} AS k{i}" for i, (e, _, _) in enumerate(order))
        tests = ""
        for i, (_, down, nulls_first) in enumerate(order):
            less, first = (1, -1) if down else (-1, 1), -1 if nulls_first else 1
            tests += f" WHEN a.k{i} IS NULL AND b.k{i} IS NOT NULL THEN {first} WHEN a.k{i} IS NOT NULL AND b.k{i} IS NULL THEN {-first} WHEN a.k{i} < b.k{i} THEN {less[0]} WHEN a.k{i} > b.k{i} THEN {less[1]}"
        listed = f"transform(array_sort(collect_list(struct({fields}, {args[0]} AS x)){calls.FILTER}, (a, b) -> CASE{tests} ELSE 0 END), s -> s.x)"
        if distinct:
            listed = f"array_distinct({listed})"
        if lower == "string_agg":
            return calls.joined(listed, args[1])
        return listed if lower == "array_agg" else calls.json(f"to_json({listed}, map('ignoreNullFields', 'false'))")

    def window(self, function: str) -> tuple[str, list[str], list[tuple[str, bool, bool]]]:
        """The text of a window, its keys and its order."""
        self.expect("(")
        made, keys, order = "", [], []
        if self.accept("PARTITION", "BY"):
            keys = self.list()
            made += f"PARTITION BY {', '.join(keys)}"
        if self.accept("ORDER", "BY"):
            order = self.order_keys()
            made += f" ORDER BY {self.order_text(order)}"
        frame = ""
        while not self.accept(")"):
            frame += f" {self.take().value}"
        if function in ("row_number", "rank", "dense_rank", "lead", "lag", "ntile") and not order:
            made += " ORDER BY " + ("monotonically_increasing_id()" if function in ("row_number", "lead", "lag", "ntile") else "1")
        if function in ("first_value", "last_value") and not frame:
            frame = " ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
        return made.strip() + frame, keys, order

    def list(self) -> list[str]:
        found = [self.expr()]
        while self.accept(","):
            found.append(self.expr())
        return found

    def order_keys(self) -> list[tuple[str, bool, bool]]:
        """(expression, descending, nulls first)"""
        found = []
        while True:
            e = self.expr()
            down = self.accept("DESC")
            if not down:
                self.accept("ASC")
            first = down
            if self.accept("NULLS"):
                first = self.take().upper == "FIRST"
            found.append((e, down, first))
            if not self.accept(","):
                return found

    @staticmethod
    def order_text(keys: list[tuple[str, bool, bool]]) -> str:
        return ", ".join(f"{e} {'DESC' if down else 'ASC'} NULLS {'FIRST' if first else 'LAST'}" for e, down, first in keys)

    # queries
    def query(self) -> str:
        self.level += 1
        try:
            return self.queried()
        finally:
            self.level -= 1

    def queried(self) -> str:
        ranked, self.ranked = self.ranked, False
        head, pushed = "", False
        if self.accept("WITH"):
            recursive = self.accept("RECURSIVE")
            self.ctes.append(set())
            pushed = True
            parts = []
            while True:
                name = self.name()
                self.ctes[-1].add(name.lower())
                columns = f"({', '.join(map(quote_name, self.names()))})" if self.has("(") else ""
                self.expect("AS", "(")
                body = self.recursion(name, columns) if recursive else self.query()
                self.expect(")")
                level = " MAX RECURSION LEVEL 10000" if recursive and self.names_table(body, name) else ""
                parts.append(f"{quote_name(name)}{columns}{level} AS ({body})")
                if not self.accept(","):
                    break
            head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} "
        made, keys, simple = self.set_operation()
        if pushed:
            self.ctes.pop()
        tail, order, most, skipped = "", "", None, None
        if self.accept("ORDER", "BY"):
            keys = self.order_keys()
            order = f" ORDER BY {self.order_text(keys)}"
        while True:
            if self.accept("LIMIT"):
                if not self.accept("ALL"):
                    most = self.expr()
                    tail += f" LIMIT {most}"
            elif self.accept("OFFSET"):
                skipped = self.expr()
                tail += f" OFFSET {skipped}"
                self.accept("ROWS")
            elif self.accept("FETCH"):
                self.take()
                most = self.expr()
                tail += f" LIMIT {most}"
                self.take()
                self.accept("ONLY")
            else:
                break
        if isinstance(simple, DistinctOn):
            return head + simple.sql(self, keys) + tail
        if ranked and tail and isinstance(simple, Plain):
            return head + simple.ranked(self, keys, most, skipped)
        if self.level == 1 and (shape := self.shape(head, made, simple, keys, most, skipped)):
            self.shapes[head + made + order + tail] = shape
        return head + made + order + tail

    def shape(self, head: str, made: str, simple: object, keys: list[tuple[str, bool, bool]], most: str | None, skipped: str | None) -> Shape | None:
        """The pieces of a query that numbers rows, or skips some without a limit; None for others, and where its order can't be told apart from its columns."""
        plain = simple if isinstance(simple, Plain) else None
        if not all(x is None or x.isdigit() for x in (most, skipped)):
            return None
        items, places = list(plain.items) if plain else [], []
        listed = [i.rpartition(" AS ")[2] for i in items]
        shown = {i.rpartition(" AS ")[0]: n.strip("`") for i, n in zip(items, listed, strict=True) if " AS " in i and listed.count(n) == 1 and "*" not in items}
        hidden: list[str] = []

        def column(e: str) -> str:
            if e in shown:
                return shown[e]
            if e not in hidden:
                hidden.append(e)
            return f"__hidden{hidden.index(e)}"

        for i, item in enumerate(items):
            e, _, name = item.rpartition(" AS ")
            if e in self.places:
                function, by, order = self.places[e]
                items[i] = f"CAST(NULL AS INT) AS `__place{len(places)}`"
                places.append((function, [column(x) for x in by], [(column(x), down, first) for x, down, first in order], name.strip("`")))
        if not places and not (skipped and keys and not most):
            return None
        named = {i.rpartition(" AS ")[2]: i.rpartition(" AS ")[0] for i in (plain.items if plain else []) if " AS " in i}
        order = []
        for e, down, first in keys:
            if e in named or (not plain and re.fullmatch(r"`[^`]*`", e)):
                order.append((e.strip("`"), down, first))
            elif not plain or e.isdigit() or any(n in e and not re.fullmatch(rf"(?:`[^`]*`\.)?{re.escape(n)}", x) for n, x in named.items()):
                return None
            else:
                order.append((column(e), down, first))
        if plain:
            made = f"SELECT {', '.join([*items, *[f'{e} AS `__hidden{i}`' for i, e in enumerate(hidden)]])}{plain.body}"
        return Shape(head + made, places, order, int(most) if most else None, int(skipped or 0), len(hidden))

    def recursion(self, name: str, columns: str) -> str:
        """The body of a recursive query. Spark has no UNION without ALL there; the engine runs such a one round by round."""
        if self.has("WITH") or self.has("VALUES"):
            return self.query()
        base, _ = self.intersections()
        if not self.has("UNION"):
            return base
        self.take()
        every = self.accept("ALL")
        step, _ = self.intersections()
        if every or not self.names_table(step, name):
            return f"{base} UNION{' ALL' if every else ''} {step}"
        self.rounds.append((name, columns, base, step))
        return f"SELECT * FROM {{{name}__rounds}}"

    @staticmethod
    def names_table(body: str, name: str) -> bool:
        return re.search(rf"(?:FROM|JOIN|,)\s+{re.escape(quote_name(name))}", body) is not None

    def set_operation(self) -> tuple[str, list, object]:
        left, simple = self.intersections()
        while self.has("UNION") or self.has("EXCEPT"):
            word = self.take().upper
            every = " ALL" if self.accept("ALL") else ""
            self.accept("DISTINCT")
            right, _ = self.intersections()
            left, simple = f"{left} {word}{every} {right}", None
        return left, [], simple

    def intersections(self) -> tuple[str, object]:
        left, simple = self.core()
        while self.accept("INTERSECT"):
            every = " ALL" if self.accept("ALL") else ""
            right, _ = self.core()
            left, simple = f"({left} INTERSECT{every} {right})", None
        return left, simple

    def core(self) -> tuple[str, object]:
        if self.accept("("):
            made = self.query()
            self.expect(")")
            return f"({made})", None
        if self.accept("VALUES"):
            rows, width = self.values()
            return f"SELECT * FROM (VALUES {rows}) AS v({', '.join(f'column{i + 1}' for i in range(width))})", None
        if self.accept("TABLE"):
            return f"SELECT * FROM {self.relation_name(self.table_name())}", None
        return self.select()

    def values(self) -> tuple[str, int]:
        rows, width = [], 0
        while True:
            self.expect("(")
            parts = [self.expr()]
            while self.accept(","):
                parts.append(self.expr())
            self.expect(")")
            width = len(parts)
            rows.append(f"({', '.join(parts)})")
            if not self.accept(","):
                return ", ".join(rows), width

    def select(self) -> tuple[str, object]:
        self.expect("SELECT")
        on: list[str] = []
        self.grouping.append(None)
        try:
            return self.selected(on)
        finally:
            self.grouping.pop()

    def selected(self, on: list[str]) -> tuple[str, object]:
        distinct = self.accept("DISTINCT")
        if distinct and self.accept("ON", "("):
            on = [self.expr()]
            while self.accept(","):
                on.append(self.expr())
            self.expect(")")
        elif not distinct:
            self.accept("ALL")
        start = self.k
        items = [] if self.has("FROM") else self.items()
        body = ""
        if self.accept("FROM"):
            body = f" FROM {self.relations()}"
        if self.accept("WHERE"):
            body += f" WHERE {self.expr()}"
        keys: set[str] = set()
        if self.accept("GROUP", "BY"):
            listed = self.list()
            keys = set(listed)
            body += f" GROUP BY {', '.join(listed)}"
        if self.loose and keys:
            items = self.again(start, keys)
        if self.accept("HAVING"):
            self.grouping.append(keys if self.loose and keys else None)
            body += f" HAVING {self.expr()}"
            self.grouping.pop()
        listed = ", ".join(items) or "1 AS `one`"
        if on:
            return "", DistinctOn(on, items, body)
        made = f"SELECT {'DISTINCT ' if distinct else ''}{listed}{body}"
        return made, None if distinct else Plain(items, body)

    def again(self, start: int, keys: set[str]) -> list[str]:
        """The items once more, now that the keys of the groups are known: other columns stand for their first value."""
        end, self.k = self.k, start
        plain = self.items()
        self.k = start
        self.grouping.append(keys)
        loose = self.items()
        self.grouping.pop()
        self.k = end
        # What is grouped by (as an expression, by its place or by its new name) stays as it is.
        kept = lambda i, e: e.rpartition(" AS ")[0] in keys or str(i + 1) in keys or e.rpartition(" AS ")[2] in keys
        return [p if kept(i, p) else x for i, (p, x) in enumerate(zip(plain, loose, strict=True))]

    def items(self) -> list[str]:
        found: list[str] = []
        used: dict[str, int] = {}
        while True:
            start = self.k
            e = self.expr()
            if e == "*" or e.endswith(".*"):
                found.append(e)
            else:
                explicit = self.accept("AS")
                if explicit or (self.now.kind in ("word", "name") and self.now.upper not in _STOP):
                    name = self.name()
                else:
                    name = self.default_name(start)
                    n = used.get(name, 0)
                    used[name] = n + 1
                    name = f"{name}{n or ''}"
                found.append(f"{e} AS {quote_name(name)}")
            if not self.accept(","):
                return found

    def default_name(self, start: int) -> str:
        """A column keeps its name, a call the name of its function; anything else is col."""
        span = self.all[start : self.k]
        if all(t.kind in ("word", "name") or t.value == "." for t in span) and span[0].upper not in ("NULL", "TRUE", "FALSE"):
            return span[-1].value
        if span[0].kind == "word" and len(span) > 1 and span[1].value == "(" and self.closes(start + 1) in (self.k - 1, None):
            return span[0].value.lower()
        if span[0].kind == "word" and len(span) > 1 and span[1].value == "(" and self.all[min(self.closes(start + 1) + 1, len(self.all) - 1)].upper in ("OVER", "FILTER"):
            return span[0].value.lower()
        return "col"

    def closes(self, k: int) -> int:
        depth = 0
        while True:
            depth += {"(": 1, ")": -1}.get(self.all[k].value, 0) if self.all[k].kind == "op" else 0
            if depth == 0:
                return k
            k += 1

    def relations(self) -> str:
        made = self.joined()
        while self.accept(","):
            lateral = self.has("LATERAL") or self.is_table_function()
            made += f" CROSS JOIN {self.relation()[0]}" if lateral else f" CROSS JOIN {self.joined()}"
        return made

    def joined(self) -> str:
        made, _ = self.relation()
        while True:
            word = next((w for w in ("INNER", "LEFT", "RIGHT", "FULL", "CROSS", "NATURAL", "JOIN") if self.has(w)), None)
            if not word:
                return made
            self.take()
            if word != "JOIN":
                self.accept("OUTER")
                self.expect("JOIN")
            right, _ = self.relation()
            kind = "" if word == "JOIN" else f"{word} "
            if self.accept("ON"):
                made += f" {kind}JOIN {right} ON {self.expr()}"
            elif self.accept("USING"):
                made += f" {kind}JOIN {right} USING ({', '.join(map(quote_name, self.names()))})"
            else:
                made += f" {kind}JOIN {right}" + ("" if word in ("CROSS", "NATURAL") else " ON TRUE")

    def is_table_function(self) -> bool:
        return self.now.upper in ("UNNEST", "JSON_EACH", "JSONB_EACH", "JSON_ARRAY_ELEMENTS", "JSONB_ARRAY_ELEMENTS", "GENERATE_SERIES") and self.ahead().value == "("

    def relation(self) -> tuple[str, str]:
        lateral = self.accept("LATERAL")
        if self.is_table_function():
            return self.table_function()
        if self.accept("("):
            if self.has("SELECT") or self.has("WITH") or self.has("VALUES"):
                self.ranked = lateral
                inner = f"({self.query()})"
                self.expect(")")
                alias, columns = self.alias()
                if not alias:
                    alias = "t"
                shown = f" AS {quote_name(alias)}" + (f"({', '.join(map(quote_name, columns))})" if columns else "")
                return f"{'LATERAL ' if lateral else ''}{inner}{shown}", alias
            made = self.relations()
            self.expect(")")
            return f"({made})", ""
        name = self.table_name()
        alias, columns = self.alias()
        shown = f" AS {quote_name(alias or name.split('.')[-1])}" + (f"({', '.join(map(quote_name, columns))})" if columns else "")
        made = self.relation_name(name)
        self.named.append((made.strip("{}"), alias or name.split(".")[-1]))
        return made + shown, alias or name

    def relation_name(self, name: str) -> str:
        if any(name.lower() in level for level in self.ctes):
            return quote_name(name)
        found = self.tables.get(name.lower().removeprefix("pg_catalog."))
        if not found:
            raise SqlError(f"relation {name} does not exist")
        self.used.add(found)
        return f"{{{found}}}"

    def alias(self) -> tuple[str | None, list[str]]:
        alias = None
        if self.accept("AS") or (self.now.kind in ("word", "name") and self.now.upper not in _STOP):
            alias = self.name()
        return alias, self.names() if alias and self.has("(") else []

    def table_function(self) -> tuple[str, str]:
        word = self.take().upper.replace("JSONB", "JSON")
        self.expect("(")
        args = [self.expr()]
        while self.accept(","):
            args.append(self.expr())
        self.expect(")")
        numbered = self.accept("WITH", "ORDINALITY")
        alias, columns = self.alias()
        usual = {"UNNEST": ["unnest"], "JSON_EACH": ["key", "value"], "JSON_ARRAY_ELEMENTS": ["value"], "GENERATE_SERIES": ["generate_series"]}[word]
        if alias and not columns and len(usual) == 1 and word in ("UNNEST", "GENERATE_SERIES"):
            columns = [alias] if word == "GENERATE_SERIES" else []
        given = [*columns, *[*usual, "ordinality"][len(columns) :]][: len(usual) + numbered]
        if word == "JSON_EACH":
            source = f"posexplode(map_entries(from_json({args[0]}, 'map<string,variant>'))) AS (i, e)"
            shown = ["e.key", "to_json(e.value)"]
        elif word == "JSON_ARRAY_ELEMENTS":
            source, shown = f"posexplode(from_json({args[0]}, 'array<variant>')) AS (i, e)", ["to_json(e)"]
        else:
            array = args[0] if word == "UNNEST" else f"sequence({', '.join(args)})"
            source, shown = f"posexplode({array}) AS (i, e)", ["e"]
        shown = [*shown, "i + 1"][: len(given)] if numbered else shown
        listed = ", ".join(f"{s} AS {quote_name(c)}" for s, c in zip(shown, given, strict=False))
        alias = alias or "t"
        return f"LATERAL (SELECT {listed} FROM (SELECT {source}) AS f) AS {quote_name(alias)}", alias


@dataclass(frozen=True)
class Shape:
    """A query in pieces: its rows, with columns __placeN for places within groups and, at the end, hidden ones that keys and order name."""

    sql: str
    #: Function, keys, order and name of each place.
    places: list[tuple[str, list[str], list[tuple[str, bool, bool]], str]]
    order: list[tuple[str, bool, bool]]
    most: int | None
    skipped: int
    hidden: int


class Plain:
    """A query of one SELECT."""

    def __init__(self, items: list[str], body: str) -> None:
        self.items, self.body = items, body

    def ranked(self, parser: Parser, keys: list[tuple[str, bool, bool]], most: str | None, skipped: str | None) -> str:
        """The first rows by a rank: behind LATERAL Spark numbers rows for LIMIT without regard to ORDER BY, and loses some where types differ."""
        # Ranks are taken for each value of the columns that are compared with outer ones, so a comparison of other expressions would rank too finely.
        column = r"(?:`[^`]*`\.)?`[^`]*`"
        plain = rf"(?:{column}|try_cast\({column} AS (?:INT|BIGINT|STRING|DOUBLE)\)|'(?:[^'\\]|\\.)*'|-?[0-9.]+[DL]?)"
        where = self.body.partition(" WHERE ")[2]
        for side in re.findall(rf"\(([^()]*(?:\([^()]*\)[^()]*)*) = ([^()]*(?:\([^()]*\)[^()]*)*)\)", where):
            if not all(re.fullmatch(plain, x.strip()) for x in side):
                raise SqlError(f"behind LATERAL with LIMIT, {' = '.join(side)} must compare columns; name the expression in a query of its own")
        named = {i.rpartition(" AS ")[2]: i.rpartition(" AS ")[0] for i in self.items if " AS " in i}
        order = parser.order_text([(named.get(e, e), down, first) for e, down, first in keys]) if keys else "1"
        low = skipped or "0"
        test = f"`__place` > {low}" + (f" AND `__place` <= {low} + {most}" if most else "")
        return f"SELECT * EXCEPT (`__place`) FROM (SELECT {', '.join(self.items) or '1 AS `one`'}, row_number() OVER (ORDER BY {order}) AS `__place`{self.body}) WHERE {test}"


class DistinctOn:
    """SELECT DISTINCT ON (keys): the first row of each key in the order of the query."""

    def __init__(self, on: list[str], items: list[str], body: str) -> None:
        self.on, self.items, self.body = on, items, body

    def sql(self, parser: Parser, keys: list[tuple[str, bool, bool]]) -> str:
        order = parser.order_text(keys) if keys else "1"
        names = ", ".join(i.rpartition(" AS ")[2] for i in self.items) if all(" AS " in i for i in self.items) else "* EXCEPT (`__place`" + "".join(f", `__k{i}`" for i in range(len(keys))) + ")"
        hidden = "".join(f", {e} AS `__k{i}`" for i, (e, _, _) in enumerate(keys))
        place = f"row_number() OVER (PARTITION BY {', '.join(self.on)} ORDER BY {order}) AS `__place`"
        again = parser.order_text([(f"`__k{i}`", down, first) for i, (_, down, first) in enumerate(keys)])
        return f"SELECT {names} FROM (SELECT {', '.join(self.items)}{hidden}, {place}{self.body}) WHERE `__place` = 1" + (f" ORDER BY {again}" if keys else "")


def is_array(sql: str) -> bool:
    return bool(re.match(r"\(?(array|CAST\(array|array_append|array_prepend|array_distinct|split)\(", sql)) or bool(re.search(r"AS ARRAY<\w+>\)+$", sql))


def translate(sql: str, params: Sequence | Mapping | None = None, tables: Mapping[str, str] | None = None) -> str:
    """Spark SQL of one query; tables maps lower-case names to what stands for them."""
    parser = Parser(sql, params, tables)
    made = parser.query()
    parser.accept(";")
    if parser.now.kind != "end":
        raise SqlError(f"unexpected {sql[parser.now.at : parser.now.at + 30]!r}")
    return made
