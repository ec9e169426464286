"""Functions of the dialect as Spark SQL, where their meaning differs from Spark's function of that name."""

from __future__ import annotations

import re
from collections.abc import Callable
from json import loads

from tarn.dialect.lexer import SqlError, quote_text


def _substring(a: list[str]) -> str:
    start = f"CAST({a[1]} AS INT)"
    if len(a) == 2:
        return f"substring({a[0]}, greatest({start}, 1))"
    return f"substring({a[0]}, greatest({start}, 1), greatest(0, {start} + CAST({a[2]} AS INT) - greatest({start}, 1)))"


def _left(a: list[str]) -> str:
    return f"CASE WHEN {a[1]} >= 0 THEN left({a[0]}, {a[1]}) ELSE left({a[0]}, greatest(0, length({a[0]}) + {a[1]})) END"


def _right(a: list[str]) -> str:
    return f"CASE WHEN {a[1]} >= 0 THEN right({a[0]}, {a[1]}) ELSE substring({a[0]}, 1 - {a[1]}) END"


def _split_part(a: list[str]) -> str:
    return f"CASE WHEN {a[2]} <= 0 THEN '' ELSE split_part({a[0]}, {a[1]}, greatest({a[2]}, 1)) END"


def _trunc(a: list[str]) -> str:
    scale = f"power(10D, {a[1]})" if len(a) > 1 else "1D"
    return f"(signum({a[0]}) * floor(abs({a[0]}) * {scale}) / {scale})"


def _round(a: list[str]) -> str:
    return f"round({', '.join(a)})"


def _text_of(quoted: str) -> str:
    if not re.fullmatch(r"'(?:[^'\\]|\\.)*'", quoted, re.S):
        raise SqlError(f"a literal is needed instead of {quoted}")
    return re.sub(r"\\(.)", r"\1", quoted[1:-1])


#: Date patterns of to_char and of Spark.
_PATTERNS = {"YYYY": "yyyy", "YY": "yy", "HH24": "HH", "HH12": "hh", "HH": "hh", "MM": "MM", "DD": "dd", "MI": "mm", "SS": "ss", "MS": "SSS", "Month": "MMMM", "Mon": "MMM", "Day": "EEEE", "Dy": "EEE"}


def _to_char(a: list[str]) -> str:
    parts = re.split("(" + "|".join(sorted(_PATTERNS, key=len, reverse=True)) + ")", _text_of(a[1]))
    made = "".join(_PATTERNS.get(p, re.sub(r"[A-Za-z]+", lambda m: f"''{m[0]}''", p)) for p in parts)
    return f"date_format({a[0]}, '{made}')".replace("''", "\\'")


def date_part(field: str, x: str) -> str:
    x = f"CAST({x} AS TIMESTAMP_NTZ)"
    known = {
        "DOW": f"(dayofweek({x}) - 1)",
        "EPOCH": f"unix_timestamp(CAST({x} AS TIMESTAMP))",
        "SECOND": f"second({x})",
        "MILLISECONDS": f"CAST(date_format({x}, 'SSS') AS INT)",
    }
    return known.get(field.upper(), f"extract({field.upper()} FROM {x})")


def _age(a: list[str]) -> str:
    later, earlier = (a[0], a[1]) if len(a) > 1 else ("current_date()", a[0])
    later, earlier = (f"CAST({x} AS TIMESTAMP_NTZ)" for x in (later, earlier))
    hi, lo = f"greatest({later}, {earlier})", f"least({later}, {earlier})"
    # Calendar fields; days that are missing are borrowed from the month before the later date.
    short = f"(day({hi}) < day({lo}))"
    months = f"((year({hi}) - year({lo})) * 12 + month({hi}) - month({lo}) - CAST({short} AS INT))"
    days = f"(day({hi}) - day({lo}) + CASE WHEN {short} THEN day(last_day(add_months({hi}, -1))) ELSE 0 END)"
    part = lambda n, unit: f"CASE WHEN {n} = 0 THEN NULL WHEN {n} = 1 THEN '1 {unit}' ELSE concat({n}, ' {unit}s') END"
    text = f"concat_ws(' ', {part(f'({months} DIV 12)', 'year')}, {part(f'({months} % 12)', 'month')}, {part(f'({days})', 'day')})"
    return f"CASE WHEN {text} = '' THEN '0 days' WHEN {later} < {earlier} THEN concat('-', {text}) ELSE {text} END"


def _path(keys: list[str]) -> str | None:
    """The keys as a JSON path, if all are literals; such paths stay on the JVM."""
    steps = []
    for k in keys:
        if re.fullmatch(r"\d+", k):
            steps.append(f"[{k}]")
        elif re.fullmatch(r"'[\w ]+'", k):
            steps.append(f"[{k[1:-1]}]" if k[1:-1].isdigit() else f".{k[1:-1]}" if re.fullmatch(r"'[A-Za-z_]\w*'", k) else "?")
        else:
            return None
    return None if "?" in steps else "$" + "".join(steps)


#: Stands before the text of an expression whose value is JSON; Spark reads it as a comment.
JSON = "/*json*/ "


def json(sql: str) -> str:
    return f"({JSON}{sql})"


def is_json(sql: str) -> bool:
    return bool(re.match(r"\(*/\*json\*/", sql))


def _let(value: str, body: str) -> str:
    """body with j for the value, which is so written (and evaluated) once."""
    return f"get(transform(array({value}), j -> {body}), 0)"


def json_get(j: str, keys: list[str]) -> str:
    """JSON text of what lies at the path, NULL if nothing does."""
    if path := _path(keys):
        return json(f"to_json(try_variant_get(try_parse_json({j}), '{path}', 'variant'))")
    return json(f"tarn_json_get({j}, array({', '.join(f'CAST({k} AS STRING)' for k in keys)}), false)")


def json_text(j: str, keys: list[str]) -> str:
    if path := _path(keys):
        return f"get_json_object({j}, '{path}')"
    return f"tarn_json_get({j}, array({', '.join(f'CAST({k} AS STRING)' for k in keys)}), true)"


def json_valid(x: str) -> str:
    """The text if it is JSON, else NULL."""
    return x if is_json(x) else json(_let(f"CAST({x} AS STRING)", "CASE WHEN try_parse_json(j) IS NOT NULL THEN j END"))


def variant_of(x: str) -> str:
    """Any value as a variant; text that holds a JSON object or array is taken as such."""
    if is_json(x):
        return f"try_parse_json({x})"
    if re.fullmatch(r"-?[0-9.]+[DL]?|TRUE|FALSE|NULL", x):
        return f"CAST({x} AS VARIANT)"
    return f"CASE WHEN CAST({x} AS STRING) RLIKE '^[ \\\\t\\\\r\\\\n]*[\\\\[{{]' THEN coalesce(try_parse_json(CAST({x} AS STRING)), CAST({x} AS VARIANT)) ELSE CAST({x} AS VARIANT) END"


_NULLS = "map('ignoreNullFields', 'false')"


def _build_object(a: list[str]) -> str:
    entries = ", ".join(f"struct(CAST({k} AS STRING) AS k, {variant_of(v)} AS v)" for k, v in zip(a[0::2], a[1::2], strict=False))
    return json(f"to_json(map_from_entries(filter(array({entries}), e -> e.k IS NOT NULL)), {_NULLS})" if entries else "'{}'")


def _build_array(a: list[str]) -> str:
    return json(f"to_json(array({', '.join(map(variant_of, a))}), {_NULLS})" if a else "'[]'")


_KIND = "CASE WHEN try_parse_json(j) IS NULL THEN NULL ELSE CASE substring_index(schema_of_variant(try_parse_json(j)), '<', 1) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'STRING' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VOID' THEN 'null' ELSE 'number' END END"
_ARRAY = "try_variant_get(try_parse_json({}), '$', 'array<variant>')"


def json_typeof(x: str) -> str:
    return _let(x, _KIND)


def json_has(x: str, key: str) -> str:
    """Whether an object has the key, or an array or a text is or holds it."""
    inside = f"exists({_ARRAY.format('j')}, e -> schema_of_variant(e) = 'STRING' AND try_variant_get(e, '$', 'string') = {key})"
    return _let(x, f"coalesce(array_contains(json_object_keys(j), {key}), {inside}, get_json_object(j, '$') = {key})")


def json_minus(x: str, right: str, keys: str) -> str:
    """Without keys of an object, texts of an array, or the element at a place."""
    objects = f"to_json(map_filter(from_json(j, 'map<string,variant>'), (k, v) -> NOT array_contains({keys}, k)), {_NULLS})"
    if re.fullmatch(r"-?[0-9]+", right):
        left = f"filter({_ARRAY.format('j')}, (e, i) -> i <> {right} AND i <> size({_ARRAY.format('j')}) + {right})" if right.startswith("-") else f"filter({_ARRAY.format('j')}, (e, i) -> i <> {right})"
    else:
        left = f"filter({_ARRAY.format('j')}, e -> NOT (schema_of_variant(e) = 'STRING' AND array_contains({keys}, try_variant_get(e, '$', 'string'))))"
    return json(_let(x, f"CASE {_KIND} WHEN 'object' THEN {objects} WHEN 'array' THEN to_json({left}, {_NULLS}) ELSE j END"))


def json_concat(x: str, y: str) -> str:
    """Two objects merged, the right one first; else one array of both sides' elements."""
    kind = lambda f: _KIND.replace("(j)", f"(j.{f})")
    items = lambda f: f"CASE {kind(f)} WHEN 'array' THEN {_ARRAY.format(f'j.{f}')} ELSE array(try_parse_json(j.{f})) END"
    objects = f"to_json(map_concat(from_json(j.a, 'map<string,variant>'), from_json(j.b, 'map<string,variant>')), {_NULLS})"
    body = f"CASE WHEN try_parse_json(j.a) IS NULL OR try_parse_json(j.b) IS NULL THEN NULL WHEN {kind('a')} = 'object' AND {kind('b')} = 'object' THEN {objects} ELSE to_json(concat({items('a')}, {items('b')}), {_NULLS}) END"
    return json(_let(f"struct({x} AS a, {y} AS b)", body))


def json_contains(a: str, b: str) -> str:
    """Whether a holds b; a constant b becomes tests on a that stay on the JVM."""
    text = re.fullmatch(r"'(?:[^'\\]|\\.)*'", inner(b), re.S)
    if not text:
        return f"tarn_json_contains({a}, {b})"
    try:
        wanted = loads(_text_of(text[0]))
    except ValueError:
        return "CAST(NULL AS BOOLEAN)"
    return _let(a, f"CASE WHEN try_parse_json(j) IS NOT NULL THEN {_holds('try_parse_json(j)', wanted, 0)} END")


def inner(sql: str) -> str:
    """A constant without the parentheses, casts and checks about it."""
    m = re.fullmatch(r"\(/\*json\*/ get\(transform\(array\(CAST\(('(?:[^'\\]|\\.)*') AS STRING\)\), j -> .*\), 0\)\)", sql, re.S)
    return m[1] if m else sql.strip("()")


def _holds(v: str, wanted: object, depth: int) -> str:
    e = f"e{depth}"
    kind = f"coalesce(schema_of_variant({v}), '')"
    if isinstance(wanted, dict):
        parts = [f"{kind} LIKE 'OBJECT%'"]
        for key, value in wanted.items():
            step = key.replace("\\", "\\\\").replace("'", "\\'")
            parts.append(_holds(f"try_variant_get({v}, '$[\"{step}\"]', 'variant')", value, depth + 1))
        return f"({' AND '.join(parts)})"
    array = f"try_variant_get({v}, '$', 'array<variant>')"
    if isinstance(wanted, list):
        parts = [f"{kind} LIKE 'ARRAY%'", *[f"coalesce(exists({array}, {e} -> {_holds(e, x, depth + 1)}), FALSE)" for x in wanted]]
        return f"({' AND '.join(parts)})"

    def same(x: str) -> str:
        shape = f"coalesce(schema_of_variant({x}), '')"
        if wanted is None:
            return f"{shape} = 'VOID'"
        if isinstance(wanted, bool):
            return f"({shape} = 'BOOLEAN' AND try_variant_get({x}, '$', 'boolean') = {str(wanted).upper()})"
        if isinstance(wanted, str):
            return f"({shape} = 'STRING' AND try_variant_get({x}, '$', 'string') = {quote_text(wanted)})"
        return f"({shape} NOT IN ('', 'STRING', 'BOOLEAN', 'VOID') AND coalesce(try_variant_get({x}, '$', 'double') = {float(wanted)!r}D, FALSE))"

    return f"({same(v)} OR ({kind} LIKE 'ARRAY%' AND coalesce(exists({array}, {e} -> {same(e)}), FALSE)))"


#: Stands behind each aggregate of a call, where FILTER belongs.
FILTER = "\2"


def joined(listed: str, separator: str) -> str:
    """What string_agg gives: the values without nulls, NULL where there are none."""
    return f"array_join(nullif(array_compact({listed}), array()), {separator})"


CALLS: dict[str, Callable[[list[str]], str]] = {
    "substring": _substring, "substr": _substring, "left": _left, "right": _right, "split_part": _split_part,
    "concat": lambda a: f"concat_ws('', {', '.join(a)})",
    "strpos": lambda a: f"instr({a[0]}, {a[1]})",
    "quote_ident": lambda a: f"concat('\"', replace({a[0]}, '\"', '\"\"'), '\"')",
    "gen_random_uuid": lambda a: "uuid()", "uuid_generate_v4": lambda a: "uuid()", "random": lambda a: "rand()",
    "trunc": _trunc, "round": _round, "log": lambda a: f"log10({a[0]})" if len(a) == 1 else f"log({a[0]}, {a[1]})",
    "sign": lambda a: f"CAST(sign({a[0]}) AS INT)", "mod": lambda a: f"({a[0]} % {a[1]})", "pow": lambda a: f"power({a[0]}, {a[1]})",
    "now": lambda a: "CAST(current_timestamp() AS TIMESTAMP_NTZ)",
    "date_part": lambda a: date_part(_text_of(a[0]), a[1]),
    "date_trunc": lambda a: f"CAST(date_trunc({a[0]}, CAST({a[1]} AS TIMESTAMP_NTZ)) AS TIMESTAMP_NTZ)",
    "age": _age, "to_char": _to_char,
    "array_agg": lambda a: f"transform(collect_list(struct({a[0]} AS x)){FILTER}, s -> s.x)",
    "string_agg": lambda a: joined(f"collect_list({a[0]}){FILTER}", a[1]),
    "json_agg": lambda a: JSON + f"to_json(transform(collect_list(struct({a[0]} AS x)){FILTER}, s -> s.x), map('ignoreNullFields', 'false'))",
    "array_to_string": lambda a: f"array_join({', '.join(a)})", "string_to_array": lambda a: f"split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))",
    "json_object_agg": lambda a: json(f"to_json(map_from_entries(filter(collect_list(struct(CAST({a[0]} AS STRING) AS k, {variant_of(a[1])} AS v)){FILTER}, e -> e.k IS NOT NULL)), {_NULLS})"),
    "json_extract": lambda a: json_get(a[0], a[1:]), "json_extract_path": lambda a: json_get(a[0], a[1:]), "json_extract_path_text": lambda a: json_text(a[0], a[1:]),
    "json_build_object": _build_object,
    "json_build_array": _build_array,
    "json_set": lambda a: json(f"tarn_json_set({a[0]}, {a[1]}, {a[2]}, {a[3] if len(a) > 3 else 'true'})"),
    "json_insert": lambda a: json(f"tarn_json_insert({a[0]}, {a[1]}, {a[2]}, {a[3] if len(a) > 3 else 'false'})"),
    "json_typeof": lambda a: json_typeof(a[0]), "json_strip_nulls": lambda a: json(f"tarn_json_strip({a[0]})"), "json_pretty": lambda a: f"tarn_json_pretty({a[0]})",
    "format_type": lambda a: a[0], "pg_get_expr": lambda a: a[0],
    "array_length": lambda a: f"CASE WHEN size({a[0]}) = 0 THEN NULL ELSE size({a[0]}) END", "cardinality": lambda a: f"size({a[0]})",
}


def call(name: str, args: list[str]) -> str:
    """Spark SQL of a call; names that begin with jsonb_ mean what those with json_ do."""
    lower = re.sub(r"^jsonb_", "json_", name.lower())
    return CALLS[lower](args) if lower in CALLS else f"{lower}({', '.join(args)})"


__all__ = ["CALLS", "FILTER", "call", "date_part", "is_json", "joined", "json", "json_concat", "json_contains", "json_get", "json_has", "json_minus", "json_text", "json_valid"]
