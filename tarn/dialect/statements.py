"""Statements other than queries, parsed into plain dictionaries."""

from __future__ import annotations

import re
from typing import Any

from tarn.dialect.lexer import SqlError
from tarn.dialect.translate import Parser

_TRANSACTIONS = {"BEGIN": "begin", "START": "begin", "COMMIT": "commit", "END": "commit", "ROLLBACK": "rollback", "ABORT": "rollback"}
_IGNORED = {"VIEW", "SEQUENCE", "MATERIALIZED", "DOMAIN", "ROLE", "USER", "EXTENSION"}


class Statements(Parser):
    def split(self) -> list[tuple[int, int]]:
        """First and last token of each statement."""
        found, start = [], 0
        for k, t in enumerate(self.all):
            if t.kind == "end" or (t.kind == "op" and t.value == ";"):
                if k > start:
                    found.append((start, k))
                start = k + 1
        return found

    def statement(self) -> dict[str, Any]:
        word = self.now.upper
        if word in ("SELECT", "VALUES", "WITH", "TABLE") or self.has("("):
            return {"kind": "select", "sql": self.query()}
        if word in _TRANSACTIONS:
            while self.now.kind != "end" and self.now.value != ";":
                self.take()
            return {"kind": _TRANSACTIONS[word]}
        handler = getattr(self, f"on_{word.lower()}", None)
        if not handler:
            raise SqlError(f"unknown statement {self.sql[self.now.at : self.now.at + 30]!r}")
        self.take()
        return handler()

    # changes of rows
    def returning(self) -> str | None:
        return ", ".join(self.items()) if self.accept("RETURNING") else None

    def on_insert(self) -> dict[str, Any]:
        self.expect("INTO")
        made: dict[str, Any] = {"kind": "insert", "table": self.table_name(), "columns": None, "conflict": None}
        if self.accept("AS"):
            self.name()
        if self.has("(") and self.ahead().upper not in ("SELECT", "WITH"):
            made["columns"] = self.names()
        if self.accept("DEFAULT", "VALUES"):
            made["rows"] = [[]]
        elif self.accept("VALUES"):
            made["rows"] = []
            while True:
                self.expect("(")
                row: list[str | None] = []
                while not self.accept(")"):
                    row.append(None if self.accept("DEFAULT") else self.expr())
                    self.accept(",")
                made["rows"].append(row)
                if not self.accept(","):
                    break
        else:
            made["select"] = self.query()
        if self.accept("ON", "CONFLICT"):
            target = None
            if self.has("("):
                target = self.names()
            elif self.accept("ON", "CONSTRAINT"):
                self.name()
            self.expect("DO")
            if self.accept("NOTHING"):
                made["conflict"] = {"target": target, "set": None}
            else:
                self.expect("UPDATE", "SET")
                made["conflict"] = {"target": target, "set": self.assignments(), "where": self.expr() if self.accept("WHERE") else None}
        made["returning"] = self.returning()
        return made

    def assignments(self) -> list[tuple[str, str | None]]:
        found: list[tuple[str, str | None]] = []
        while True:
            if self.has("("):
                names = self.names()
                self.expect("=", "(")
                for i, name in enumerate(names):
                    if i:
                        self.expect(",")
                    found.append((name, self.expr()))
                self.expect(")")
            else:
                name = self.name()
                if self.accept("."):
                    name = self.name()
                self.expect("=")
                found.append((name, None if self.accept("DEFAULT") else self.expr()))
            if not self.accept(","):
                return found

    def on_update(self) -> dict[str, Any]:
        made: dict[str, Any] = {"kind": "update", "table": self.table_name()}
        made["alias"], _ = self.alias()
        self.expect("SET")
        made["set"] = self.assignments()
        made["from"] = self.relations() if self.accept("FROM") else None
        made["where"] = self.expr() if self.accept("WHERE") else "TRUE"
        made["returning"] = self.returning()
        return made

    def on_delete(self) -> dict[str, Any]:
        self.expect("FROM")
        made: dict[str, Any] = {"kind": "delete", "table": self.table_name()}
        made["alias"], _ = self.alias()
        made["from"] = self.relations() if self.accept("USING") else None
        made["where"] = self.expr() if self.accept("WHERE") else "TRUE"
        made["returning"] = self.returning()
        return made

    def on_truncate(self) -> dict[str, Any]:
        self.accept("TABLE")
        made: dict[str, Any] = {"kind": "truncate", "tables": [self.table_name()], "restart": False, "cascade": False}
        while self.accept(","):
            made["tables"].append(self.table_name())
        if self.accept("RESTART", "IDENTITY"):
            made["restart"] = True
        self.accept("CONTINUE", "IDENTITY")
        made["cascade"] = self.accept("CASCADE")
        self.accept("RESTRICT")
        return made

    # definitions
    def on_create(self) -> dict[str, Any]:
        unique = self.accept("UNIQUE")
        if self.accept("INDEX"):
            return self.index(unique)
        if self.accept("SCHEMA"):
            maybe = self.accept("IF", "NOT", "EXISTS")
            return {"kind": "create_schema", "name": self.name(), "maybe": maybe}
        if self.accept("TYPE"):
            name = self.table_name()
            self.expect("AS", "ENUM", "(")
            values = []
            while not self.accept(")"):
                values.append(self.take().value)
                self.accept(",")
            return {"kind": "create_type", "name": name, "values": values}
        self.accept("TEMP")
        self.accept("TEMPORARY")
        self.expect("TABLE")
        maybe = self.accept("IF", "NOT", "EXISTS")
        made: dict[str, Any] = {"kind": "create_table", "name": self.table_name(), "maybe": maybe, "columns": [], "constraints": []}
        if self.accept("AS"):
            return made | {"select": self.query()}
        self.expect("(")
        while not self.accept(")"):
            if self.now.upper in ("PRIMARY", "UNIQUE", "FOREIGN", "CHECK", "CONSTRAINT"):
                made["constraints"].append(self.constraint())
            else:
                column, constraints = self.column()
                made["columns"].append(column)
                made["constraints"] += constraints
            self.accept(",")
        return made

    def column(self) -> tuple[dict[str, Any], list[dict[str, Any]]]:
        name = self.name()
        start = self.now
        word = self.now.upper
        kind = self.type()
        column: dict[str, Any] = {"name": name, "type": kind, "sql_type": self.sql[start.at : self.now.at].strip().upper(), "not_null": False, "default": None, "generated": None, "serial": "SERIAL" in word, "comment": None}
        constraints: list[dict[str, Any]] = []
        label = None
        while True:
            if self.accept("CONSTRAINT"):
                label = self.name()
            elif self.accept("NOT", "NULL"):
                column["not_null"] = True
            elif self.accept("NULL"):
                pass
            elif self.accept("DEFAULT"):
                at = self.now.at
                column["default"] = self.sum()
                column["default_text"] = self.sql[at : self.now.at].strip()
            elif self.accept("GENERATED"):
                self.accept("ALWAYS")
                self.accept("BY", "DEFAULT")
                self.expect("AS")
                if self.accept("IDENTITY"):
                    column["serial"] = True
                    if self.accept("("):
                        while not self.accept(")"):
                            self.take()
                else:
                    self.expect("(")
                    column["generated"] = self.expr()
                    self.expect(")")
                    self.accept("STORED")
            elif self.accept("PRIMARY", "KEY"):
                constraints.append({"kind": "primary", "columns": [name], "name": label})
                column["not_null"] = True
            elif self.accept("UNIQUE"):
                constraints.append({"kind": "unique", "columns": [name], "name": label})
            elif self.accept("REFERENCES"):
                constraints.append({"kind": "foreign", "columns": [name], "name": label} | self.reference_to())
            elif self.accept("CHECK", "("):
                constraints.append({"kind": "check", "columns": [name], "name": label, "check": self.expr()})
                self.expect(")")
            else:
                return column, constraints

    def reference_to(self) -> dict[str, Any]:
        made: dict[str, Any] = {"table": self.table_name(), "to": self.names() if self.has("(") else None, "on_delete": "RESTRICT", "on_update": "RESTRICT"}
        while True:
            if self.accept("ON"):
                event = f"on_{self.take().value.lower()}"
                action = self.take().upper
                if action in ("SET", "NO"):
                    action += f" {self.take().upper}"
                made[event] = action
            elif self.accept("MATCH") or self.accept("INITIALLY"):
                self.take()
            elif not (self.accept("DEFERRABLE") or self.accept("NOT", "DEFERRABLE")):
                return made

    def constraint(self) -> dict[str, Any]:
        label = self.name() if self.accept("CONSTRAINT") else None
        if self.accept("PRIMARY", "KEY"):
            return {"kind": "primary", "columns": self.names(), "name": label}
        if self.accept("UNIQUE"):
            return {"kind": "unique", "columns": self.names(), "name": label}
        if self.accept("FOREIGN", "KEY"):
            columns = self.names()
            self.expect("REFERENCES")
            return {"kind": "foreign", "columns": columns, "name": label} | self.reference_to()
        self.expect("CHECK", "(")
        made = {"kind": "check", "columns": [], "name": label, "check": self.expr()}
        self.expect(")")
        return made

    def index(self, unique: bool) -> dict[str, Any]:
        self.accept("CONCURRENTLY")
        maybe = self.accept("IF", "NOT", "EXISTS")
        name = None if self.has("ON") else self.name()
        self.expect("ON")
        table = self.table_name()
        if self.accept("USING"):
            self.name()
        self.expect("(")
        columns, depth, span = [], 1, self.k
        while depth:
            t = self.take()
            depth += {"(": 1, ")": -1}.get(t.value, 0) if t.kind == "op" else 0
            if depth == 1 and t.kind in ("word", "name") and self.all[self.k - 2].value in ("(", ","):
                columns.append(t.value)
        while self.now.kind != "end" and self.now.value != ";":
            self.take()
        return {"kind": "create_index", "name": name or f"{table}_{'_'.join(columns)}_idx", "table": table, "columns": columns, "unique": unique, "maybe": maybe, "text": self.sql[self.all[span].at : self.now.at].strip()}

    def on_drop(self) -> dict[str, Any]:
        word = self.take().upper
        if word == "MATERIALIZED":
            self.take()
        self.accept("CONCURRENTLY")
        maybe = self.accept("IF", "EXISTS")
        names = [self.table_name()]
        while self.accept(","):
            names.append(self.table_name())
        cascade = self.accept("CASCADE")
        self.accept("RESTRICT")
        if word in _IGNORED:
            return {"kind": "nothing"}
        if word not in ("TABLE", "SCHEMA", "INDEX", "TYPE"):
            raise SqlError(f"can't drop {word}")
        return {"kind": f"drop_{word.lower()}", "names": names, "maybe": maybe, "cascade": cascade}

    def on_comment(self) -> dict[str, Any]:
        self.expect("ON")
        what = self.take().upper
        parts = [self.name()]
        while self.accept("."):
            parts.append(self.name())
        self.expect("IS")
        text = None if self.accept("NULL") else self.take().value
        return {"kind": "comment", "on": what.lower(), "parts": parts, "text": text}

    def on_alter(self) -> dict[str, Any]:
        if self.accept("TYPE"):
            name = self.table_name()
            self.expect("ADD", "VALUE")
            maybe = self.accept("IF", "NOT", "EXISTS")
            return {"kind": "add_value", "name": name, "value": self.take().value, "maybe": maybe}
        self.expect("TABLE")
        maybe = self.accept("IF", "EXISTS")
        self.accept("ONLY")
        made: dict[str, Any] = {"kind": "alter", "table": self.table_name(), "maybe": maybe, "actions": []}
        while True:
            made["actions"].append(self.action())
            if not self.accept(","):
                return made

    def action(self) -> dict[str, Any]:
        if self.accept("ADD"):
            if self.now.upper in ("CONSTRAINT", "PRIMARY", "UNIQUE", "FOREIGN", "CHECK"):
                return {"do": "add_constraint", "constraint": self.constraint()}
            self.accept("COLUMN")
            maybe = self.accept("IF", "NOT", "EXISTS")
            column, constraints = self.column()
            return {"do": "add_column", "column": column, "constraints": constraints, "maybe": maybe}
        if self.accept("DROP"):
            what = "constraint" if self.accept("CONSTRAINT") else "column"
            self.accept("COLUMN")
            maybe = self.accept("IF", "EXISTS")
            made = {"do": f"drop_{what}", "name": self.name(), "maybe": maybe}
            self.accept("CASCADE")
            return made
        if self.accept("RENAME"):
            if self.accept("TO"):
                return {"do": "rename_table", "to": self.name()}
            self.accept("COLUMN")
            old = self.name()
            self.expect("TO")
            return {"do": "rename_column", "name": old, "to": self.name()}
        self.expect("ALTER")
        self.accept("COLUMN")
        name = self.name()
        if self.accept("SET", "DEFAULT"):
            at = self.now.at
            return {"do": "set_default", "name": name, "default": self.sum(), "text": self.sql[at : self.now.at].strip()}
        if self.accept("DROP", "DEFAULT"):
            return {"do": "set_default", "name": name, "default": None}
        if self.accept("SET", "NOT", "NULL"):
            return {"do": "set_not_null", "name": name, "value": True}
        if self.accept("DROP", "NOT", "NULL"):
            return {"do": "set_not_null", "name": name, "value": False}
        self.accept("SET", "DATA")
        self.expect("TYPE")
        start = self.now
        kind = self.type()
        made = {"do": "set_type", "name": name, "type": kind, "sql_type": self.sql[start.at : self.now.at].strip().upper()}
        if self.accept("USING"):
            made["using"] = self.expr()
        return made

    def on_do(self) -> dict[str, Any]:
        body = self.take().value
        m = re.search(r"IF\s+(NOT\s+)?EXISTS\s*\((.*?)\)\s*THEN\s+(.*?)\s*END\s+IF\s*;", body, re.S | re.I)
        return {"kind": "do", "body": body, "query": m[2] if m else None, "no": bool(m and m[1]), "then": m[3] if m else None}
