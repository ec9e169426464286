"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SqlError(ValueError):
    """The text is not SQL of this dialect, or names something that does not exist."""


@dataclass(frozen=True)
class Token:
    """kind: word, name (quoted), text, number, param, op or end. value: without quotes. at: place in the text."""

    kind: str
    value: str
    at: int

    @property
    def upper(self) -> str:
        return self.value.upper() if self.kind == "word" else ""


_SKIP = re.compile(r"(?:\s+|--[^\n]*|/\*.*?(?:\*/|\Z))+", re.S)
_NUMBER = re.compile(r"(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?")
_WORD = re.compile(r"[^\W\d]\w*")
_BARE_ID = re.compile(r"\d\w*(?:-\w+)+|\d+[A-Za-z_]\w*")
_DOLLAR = re.compile(r"\$(\w*)\$(.*?)(?:\$\1\$|\Z)", re.S)
#: Operators of the dialect, longest first.
_OPERATORS = ["!~~*", "->>", "#>>", "!~*", "!~~", "~~*", "<=>", "::", "->", "#>", "#-", "@>", "<@", "&&", "||", "<=", ">=", "<>", "!=", "!~", "~*", "~~", "=", "<", ">", "+", "-", "*", "/", "%", "^", "~", "?", "(", ")", "[", "]", "{", "}", ",", ";", ".", ":"]


def tokens(sql: str) -> list[Token]:
    """All tokens, closed by an end token. An unterminated string or comment closes at the end of the text."""
    found, at = [], 0
    while at < len(sql):
        if m := _SKIP.match(sql, at):
            at = m.end()
            continue
        c = sql[at]
        if c in "'\"":
            value, after = _quoted(sql, at, c)
            found.append(Token("text" if c == "'" else "name", value, at))
        elif c == "$" and (m := re.compile(r"\$(\d+)").match(sql, at)):
            found.append(Token("param", m[1], at))
            after = m.end()
        elif c == "$" and (m := _DOLLAR.match(sql, at)):
            found.append(Token("text", m[2], at))
            after = m.end()
        elif c == "$":
            after = sql.find("$", at + 1)
            after = len(sql) if after < 0 else after + 1
            found.append(Token("text", sql[at + 1 : after - 1], at))
        elif c == ":" and (m := re.compile(r":([A-Za-z_]\w*)").match(sql, at)) and sql[at - 1 : at] != ":":
            found.append(Token("param", m[1], at))
            after = m.end()
        elif m := _BARE_ID.match(sql, at):
            number = _NUMBER.match(sql, at)
            m = number if number and number.end() >= m.end() else m
            found.append(Token("number" if m is number else "word", m[0], at))
            after = m.end()
        elif m := _NUMBER.match(sql, at):
            found.append(Token("number", m[0], at))
            after = m.end()
        elif m := _WORD.match(sql, at):
            found.append(Token("word", m[0], at))
            after = m.end()
        else:
            op = next((o for o in _OPERATORS if sql.startswith(o, at)), None)
            if not op:
                raise SqlError(f"unexpected character {c!r} at {at}")
            found.append(Token("op", op, at))
            after = at + len(op)
        at = after
    return [*found, Token("end", "", len(sql))]


def _quoted(sql: str, at: int, quote: str) -> tuple[str, int]:
    parts, start = [], at + 1
    while True:
        end = sql.find(quote, start)
        if end < 0:
            return "".join([*parts, sql[start:]]), len(sql)
        if sql[end + 1 : end + 2] == quote:
            parts.append(sql[start : end + 1])
            start = end + 2
            continue
        return "".join([*parts, sql[start:end]]), end + 1


def quote_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
