"""JSON functions that Spark lacks: paths and sides of @> that are not constant, changes at a path, and printing. Arrow carries the rows."""

from __future__ import annotations

import json
from typing import Any

import tarn
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Functions for Python workers travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(tarn)
_NOTHING = object()


def _load(text: str | None) -> Any:
    if text is None:
        return _NOTHING
    try:
        return json.loads(text)
    except ValueError:
        return _NOTHING


def _dump(value: Any) -> str | None:
    return None if value is _NOTHING else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _value(text: str | None) -> Any:
    """A JSON text, or else plain text as a JSON string."""
    found = _load(text)
    return text if found is _NOTHING else found


def _step(value: Any, key: str) -> Any:
    if isinstance(value, dict):
        return value.get(key, _NOTHING)
    if isinstance(value, list) and key.lstrip("-").isdigit() and -len(value) <= int(key) < len(value):
        return value[int(key)]
    return _NOTHING


def get(text: str | None, path: list[str] | None, as_text: bool) -> str | None:
    value = _load(text)
    for key in path or []:
        value = _step(value, key) if key is not None else _NOTHING
    if as_text and (value is None or isinstance(value, str)):
        return value
    return _dump(value)


def _changed(value: Any, path: list[str], change: Any) -> Any:
    """A copy in which change(container, key) has been applied where the path ends; the value itself where it leads nowhere."""
    if not path:
        return value
    copy = dict(value) if isinstance(value, dict) else list(value) if isinstance(value, list) else None
    if copy is None:
        return value
    key = path[0]
    if len(path) == 1:
        change(copy, key)
        return copy
    inner = _step(copy, key)
    if inner is not _NOTHING:
        copy[key if isinstance(copy, dict) else int(key)] = _changed(inner, path[1:], change)
    return copy


def set_(text: str | None, path: list[str] | None, new: str | None, create: bool) -> str | None:
    def change(at: Any, key: str) -> None:
        if isinstance(at, dict):
            if create or key in at:
                at[key] = _value(new)
        elif _step(at, key) is not _NOTHING:
            at[int(key)] = _value(new)
        elif create and key.lstrip("-").isdigit():
            at.insert(0 if int(key) < 0 else len(at), _value(new))

    value = _load(text)
    return _dump(value if value is _NOTHING else _changed(value, path or [], change))


def insert(text: str | None, path: list[str] | None, new: str | None, after: bool) -> str | None:
    def change(at: Any, key: str) -> None:
        if isinstance(at, dict):
            at.setdefault(key, _value(new))
        elif key.lstrip("-").isdigit():
            k = int(key) + len(at) * (int(key) < 0)
            at.insert(max(0, k + bool(after)), _value(new))

    value = _load(text)
    return _dump(value if value is _NOTHING else _changed(value, path or [], change))


def delete(text: str | None, path: list[str] | None) -> str | None:
    def change(at: Any, key: str) -> None:
        if _step(at, key) is not _NOTHING:
            del at[key if isinstance(at, dict) else int(key)]

    value = _load(text)
    return _dump(value if value is _NOTHING else _changed(value, path or [], change))


def _within(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and _within(a[k], v) for k, v in b.items())
    if isinstance(a, list):
        return all(any(_within(x, y) for x in a) for y in b) if isinstance(b, list) else b in a
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def contains(a: str | None, b: str | None) -> bool | None:
    x, y = _load(a), _load(b)
    return None if x is _NOTHING or y is _NOTHING else _within(x, y)


def _stripped(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _stripped(v) for k, v in value.items() if v is not None}
    return [_stripped(v) for v in value] if isinstance(value, list) else value


def strip(text: str | None) -> str | None:
    value = _load(text)
    return _dump(value if value is _NOTHING else _stripped(value))


def pretty(text: str | None) -> str | None:
    value = _load(text)
    return None if value is _NOTHING else json.dumps(value, ensure_ascii=False, indent=2)


FUNCTIONS = {
    "tarn_json_get": (get, "string"), "tarn_json_set": (set_, "string"), "tarn_json_insert": (insert, "string"), "tarn_json_delete": (delete, "string"), "tarn_json_strip": (strip, "string"), "tarn_json_pretty": (pretty, "string"), "tarn_json_contains": (contains, "boolean"),
}


_KNOWN: set[str] = set()


def register(spark: SparkSession) -> None:
    """Once for each session."""
    session = spark._jsparkSession.sessionUUID()
    if session not in _KNOWN:
        _KNOWN.add(session)
        for name, (function, kind) in FUNCTIONS.items():
            spark.udf.register(name, F.udf(function, kind, useArrow=True))
