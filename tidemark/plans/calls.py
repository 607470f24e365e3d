"""Function calls of the clients' dialects, as Spark expressions.

Each handler takes the texts of a call's arguments (already rewritten) and what follows the call, and returns an
expression. Calls that nothing is known of stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: What current_setting answers (fixed values).
SETTINGS = {
    "server_version": "14.0", "server_version_num": "140000", "search_path": "main", "client_encoding": "UTF8", "standard_conforming_strings": "on", "TimeZone": "UTC", "DateStyle": "ISO",
    "integer_datetimes": "on",
}
#: strftime's letters as date_format's (fixed values).
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "ss.SSS", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%R": "HH:mm", "%%": "%"}
#: Functions that clients ask for things which are never there, and what they answer (fixed values).
CONSTANTS = {
    "col_description": "CAST(NULL AS STRING)", "obj_description": "CAST(NULL AS STRING)", "pg_get_expr": "CAST(NULL AS STRING)", "pg_get_partkeydef": "CAST(NULL AS STRING)",
    "pg_relation_size": "CAST(NULL AS BIGINT)", "pg_stat_get_numscans": "CAST(NULL AS BIGINT)", "pg_total_relation_size": "0L", "pg_table_size": "0L", "pg_indexes_size": "0L",
    "pg_my_temp_schema": "0L", "pg_is_other_temp_schema": "false", "pg_get_userbyid": "'postgres'",
}
#: Functions that hold an array in text, in the session as SQL functions under other names, as Spark has its own of some.
NAMED = {
    "array_to_string": "tide_array_to_string", "string_to_array": "tide_string_to_array", "array_length": "tide_array_length", "array_lower": "tide_array_lower", "array_upper": "tide_array_upper",
    "quote_ident": "tide_quote_ident", "parse_ident": "tide_parse_ident", "format_type": "tide_format_type", "json_contains": "tide_json_contains", "pg_get_constraintdef": "tide_constraintdef",
    "pg_get_indexdef": "tide_indexdef", "pg_get_functiondef": "tide_functiondef", "pg_get_function_identity_arguments": "tide_function_arguments",
}
#: Calls whose value is a whole number, and those that have their arguments' type (fixed values).
WHOLE = {"count", "length", "char_length", "octet_length", "instr", "unicode", "ascii", "rank", "dense_rank", "row_number", "ntile", "json_array_length", "array_length", "sign", "datediff", "hour", "minute", "year", "month", "day"}
ALIKE = {"sum", "min", "max", "abs", "coalesce", "ifnull", "nullif", "greatest", "least"}


def literal(text: str) -> str | None:
    """The value of a string literal, None for anything else."""
    text = text.strip()
    return text[1:-1].replace("''", "'").replace("\\\\", "\\") if re.fullmatch(r"'(?:[^']|'')*'", text) else None


def quoted(value: str) -> str:
    """A string literal of Spark, in which a backslash escapes."""
    return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"


#: Marks around what is JSON already, and around a value with its JSON: calls around them look for these.
JSON, RAW, MIDDLE, END = "/*json*/", "/*raw*/", "/*or*/", "/*end*/"


def finished(text: str) -> str:
    """Without the marks."""
    text = re.sub(re.escape(RAW) + "(.*?)" + re.escape(MIDDLE) + ".*?" + re.escape(END), r"\1", text, flags=re.S)
    return text.replace(JSON, "").replace(END, "")


def json_value(arg: str) -> str:
    """The JSON text of a value; what json_object, json_array and json_extract give is JSON already."""
    if arg.startswith((JSON, RAW)) and arg.find(END) == len(arg) - len(END):
        return f"coalesce({arg[len(JSON) : -len(END)] if arg.startswith(JSON) else arg[: -len(END)].split(MIDDLE)[1]}, 'null')"
    member = quoted('(?s)^\\{"v":(.*)\\}$')
    return f"coalesce(nullif(regexp_extract(to_json(named_struct('v', {finished(arg)})), {member}, 1), ''), 'null')"


def json_object(args: list[str], _: str) -> str:
    if len(args) % 2:
        raise ValueError("json_object takes names and values in pairs")
    members = [f"{json_value(k)}, ':', {json_value(v)}" for k, v in zip(args[::2], args[1::2], strict=True)]
    return JSON + ("concat('{', " + ", ',', ".join(members) + ", '}')" if members else "'{}'") + END


def json_array(args: list[str], _: str) -> str:
    return JSON + ("concat('[', " + ", ',', ".join(json_value(a) for a in args) + ", ']')" if args else "'[]'") + END


def json_extract(args: list[str], _: str) -> str:
    """The value as text; within json_object and json_array the JSON as it stands, with its type."""
    if len(args) != 2:
        raise ValueError("json_extract takes one path")
    return f"{RAW}get_json_object({args[0]}, {args[1]}){MIDDLE}to_json(try_variant_get(try_parse_json({args[0]}), {args[1]}, 'variant')){END}"


def strftime(args: list[str], _: str) -> str:
    pattern, at = literal(args[0]), args[1] if len(args) > 1 else "'now'"
    if pattern is None:
        raise ValueError("strftime takes a literal format")
    moment = "current_timestamp()" if (literal(at) or "").lower() == "now" else f"timestamp_seconds({at})" if len(args) > 2 and literal(args[2]) == "unixepoch" else f"CAST({at} AS TIMESTAMP)"
    if pattern == "%s":
        return f"CAST(unix_timestamp({moment}) AS STRING)"
    parts = re.findall(r"%.|[^%]+", pattern)
    if unknown := [p for p in parts if p[0] == "%" and p not in STRFTIME]:
        raise ValueError(f"strftime knows no {unknown}")
    java = "".join(STRFTIME[p] if p[0] == "%" else "".join(f"'{c}'" if c.isalpha() else "''" if c == "'" else c for c in p) for p in parts)
    return f"date_format({moment}, {quoted(java)})"


def total(args: list[str], rest: str) -> str:
    return f"coalesce(sum(CAST({args[0]} AS DOUBLE)){rest}, 0.0D)"


def group_concat(args: list[str], rest: str, empty: str | None = None) -> str:
    """Joined texts; an ORDER BY within the call is kept. Without rows null, or for string_agg ''."""
    last, *order = re.split(r"(?i)\border\s+by\b", args[-1])
    args = [*args[:-1], last.strip()]
    by = f" WITHIN GROUP (ORDER BY {order[0].strip()})" if order else ""
    joined = f"listagg(CAST({args[0]} AS STRING), {args[1] if len(args) > 1 else quoted(',')}){by}{rest}"
    return joined if empty is None else f"coalesce({joined}, {empty})"


def regexp_replace(args: list[str], _: str) -> str:
    """The first match, or with g all; i ignores case; a pattern that can't be read leaves the text alone."""
    if len(args) < 3:
        return "''"
    pattern, replacement, flags = (literal(a) for a in [*args[1:3], args[3] if len(args) > 3 else "''"])
    if None in (pattern, replacement, flags):
        return f"tide_regexp_replace({', '.join([*args, *["''"] * (4 - len(args))])})"
    try:
        re.compile(pattern)
    except re.error:
        return args[0]
    head = "(?i)" if "i" in flags else ""
    back = re.sub(r"\\(\d)", r"$\1", replacement)
    if "g" in flags:
        return f"regexp_replace({args[0]}, {quoted(head + pattern)}, {quoted(back)})"
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", back)
    return f"regexp_replace({args[0]}, {quoted(f'(?s)^(.*?){head}(?-s:{pattern})')}, {quoted('$1' + shifted)})"


def current_setting(args: list[str], _: str) -> str:
    known = ", ".join(quoted(x) for pair in SETTINGS.items() for x in pair)
    return f"coalesce(try_element_at(map({known}), {args[0]}), '')"


def extreme(name: str) -> Callable[[list[str], str], str | None]:
    """max and min of several values: null if one is null."""

    def of(args: list[str], rest: str) -> str | None:
        if len(args) < 2:
            return None
        return f"if({' OR '.join(f'{a} IS NULL' for a in args)}, NULL, {name}({', '.join(args)}))"

    return of


HANDLERS: dict[str, Callable[[list[str], str], str | None]] = {
    "json_object": json_object, "json_array": json_array, "json_extract": json_extract, "strftime": strftime, "total": total, "group_concat": group_concat,
    "string_agg": lambda args, rest: group_concat(args, rest, "''"), "regexp_replace": regexp_replace, "current_setting": current_setting,
    "max": extreme("greatest"), "min": extreme("least"),
} | {name: (lambda args, rest, value=value: value) for name, value in CONSTANTS.items()}
#: Aggregates whose FILTER and OVER belong inside the expression that takes their place.
AGGREGATES = {"total", "group_concat", "string_agg"}
