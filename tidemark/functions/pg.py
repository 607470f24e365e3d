"""Functions that PostgreSQL clients expect, as column expressions that stay in the JVM where semantics allow."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine.catalog import TYPE_OIDS
from tidemark.plans.calls import SETTINGS, quoted

#: Names that must be quoted as identifiers (fixed values: SQL's reserved words that clients meet).
KEYWORDS = (
    "all", "and", "any", "as", "asc", "between", "by", "case", "check", "collate", "column", "constraint", "create", "cross", "default", "delete", "desc", "distinct", "drop", "else",
    "end", "except", "exists", "false", "for", "foreign", "from", "full", "group", "having", "in", "index", "inner", "insert", "intersect", "into", "is", "join", "left", "like", "limit",
    "natural", "not", "null", "offset", "on", "or", "order", "outer", "primary", "references", "right", "select", "set", "table", "then", "to", "true", "union", "unique", "update", "user",
    "using", "values", "when", "where", "with",
)

VERSION = "PostgreSQL 14.0 (tidemark)"


def array_to_string(arr: Column, delimiter: str) -> Column:
    """The elements of '{a,b}' text, joined; null gives ''."""
    inner = F.regexp_replace(F.trim(arr), r"^\{|\}$", "")
    return F.coalesce(F.array_join(F.split(inner, ","), delimiter), F.lit(""))


def string_to_array(text: Column, delimiter: str) -> Column:
    """Parts between delimiters; an empty delimiter gives the characters."""
    return F.split(text, re.escape(delimiter), -1)


def string_to_json_array(text: Column, delimiter: str) -> Column:
    return F.to_json(string_to_array(text, delimiter))


def array_length(arr: Column) -> Column:
    """Elements of JSON text '[..]' or of '{..}' text; null for anything else."""
    inner = F.trim(F.regexp_replace(F.trim(arr), r"^\{|\}$", ""))
    braces = F.when(inner == "", 0).otherwise(F.size(F.split(inner, ",")))
    return F.when(F.trim(arr).startswith("{"), braces).otherwise(F.json_array_length(arr)).cast("long")


def array_lower(arr: Column) -> Column:
    return F.when(array_length(arr) > 0, F.lit(1)).cast("long")


def array_upper(arr: Column) -> Column:
    return F.when(array_length(arr) > 0, array_length(arr))


def subscript(arr: Column, index: int) -> Column:
    """Element of a JSON array's text, counted from 1."""
    return F.get_json_object(arr, f"$[{index - 1}]")


def regexp_replace(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    """The first match, or with g all; i ignores case; a pattern that can't be read leaves the text alone."""
    try:
        re.compile(pattern)
    except re.error:
        return text
    head = "(?i)" if "i" in flags else ""
    back = re.sub(r"\\(\d)", r"$\1", replacement)
    if "g" in flags:
        return F.regexp_replace(text, head + pattern, back)
    shifted = re.sub(r"\$(\d)", lambda m: f"${int(m[1]) + 1}", back)
    return F.regexp_replace(text, f"(?s)^(.*?){head}(?-s:{pattern})", "$1" + shifted)


def quote_ident(name: Column) -> Column:
    """Quoted if empty, a keyword, or not made of letters, digits and _ with no digit first."""
    plain = name.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~F.lower(name).isin(*KEYWORDS)
    return F.when(plain, name).otherwise(F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"')))


def parse_ident(name: str) -> list[str]:
    """The parts of a qualified name; quotes keep dots and case."""
    parts = re.findall(r'\s*("(?:[^"]|"")*"|[^."]+)\s*(?:\.|$)', name)
    return [p[1:-1].replace('""', '"') if p.startswith('"') else p.strip().lower() for p in parts]


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_ident_column(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else parse_ident(x))


def current_setting(name: str) -> Column:
    return F.lit(SETTINGS.get(name, ""))


def version() -> Column:
    return F.lit(VERSION)


def format_type(oid: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in sorted(TYPE_OIDS.items()) for x in pair])
    return F.coalesce(F.try_element_at(known, oid), F.lit("unknown"))


def string_agg(value: Column, delimiter: str, order: Column) -> Column:
    """Joined in the given order, without nulls; '' if there is nothing. collect_list of structs keeps the order total."""
    pairs = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.transform(pairs, lambda p: p["v"].cast("string")), delimiter)


def unnest(*arrays: Column) -> Column:
    """Rows of several arrays side by side, the shorter padded with null: columns value0, value1, ..."""
    if not arrays or len(arrays) > 32:
        raise ValueError("unnest takes 1 to 32 arrays")
    return F.inline(F.arrays_zip(*[a.alias(f"value{n}") for n, a in enumerate(arrays)]))


def contains(selector: object, value: object) -> bool:
    """Objects: every key of the selector is there and contains; everything else: equality."""
    if isinstance(selector, dict) and isinstance(value, dict):
        return all(k in value and contains(v, value[k]) for k, v in selector.items())
    return type(selector) is type(value) and selector == value or isinstance(selector, int | float) and isinstance(value, int | float) and not isinstance(selector, bool) and not isinstance(value, bool) and selector == value


def _contains(selector: str | None, value: str | None) -> bool | None:
    if selector is None or value is None:
        return None
    try:
        return contains(json.loads(selector), json.loads(value))
    except ValueError:
        return None


@F.pandas_udf(T.BooleanType())
def json_contains_any(selector: pd.Series, value: pd.Series) -> pd.Series:
    """For selectors that differ by row; by Arrow batches."""
    return pd.Series([_contains(s, v) for s, v in zip(selector, value, strict=True)], dtype="object")


def json_contains(selector: str, value: Column) -> Column:
    """For a selector known beforehand: a conjunction of path lookups, without Python."""

    def walk(x: object, path: str) -> Column:
        if isinstance(x, dict):
            found = F.coalesce(F.get_json_object(value, path).startswith("{"), F.lit(False))
            for k, v in x.items():
                if "'" in k or "]" in k:
                    raise ValueError("such a key needs json_contains_any")
                found = found & walk(v, f"{path}['{k}']" if path != "$" else f"$['{k}']")
            return found
        got = F.get_json_object(value, path)
        text = x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))
        return F.lit(False) if x is None else F.coalesce(got == text, F.lit(False))

    return F.when(value.isNotNull(), walk(json.loads(selector), "$"))


@F.pandas_udf(T.StringType())
def regexp_replace_any(text: pd.Series, pattern: pd.Series, replacement: pd.Series, flags: pd.Series) -> pd.Series:
    """regexp_replace where the pattern differs by row; by Arrow batches."""

    def one(x: str | None, p: str | None, r: str | None, f: str | None) -> str | None:
        if None in (x, p, r):
            return None
        try:
            found = re.compile(p, re.I if "i" in (f or "") else 0)
        except re.error:
            return x
        return found.sub(re.sub(r"[$\\\\](\d)", r"\\\\g<\1>", r), x, count=0 if "g" in (f or "") else 1)

    return pd.Series([one(*z) for z in zip(text, pattern, replacement, flags, strict=True)], dtype="object")


def _mapped(pairs: dict) -> str:
    return "map(" + ", ".join(f"{k if isinstance(k, int) else quoted(k)}{'L' * isinstance(k, int)}, {quoted(v)}" for k, v in pairs.items()) + ")" if pairs else "CAST(map() AS MAP<BIGINT, STRING>)"


_BRACES = "regexp_replace(trim(arr), '^\\\\{|\\\\}$', '')"
_LENGTH = f"CAST(CASE WHEN startswith(trim(arr), '{{') THEN if(trim({_BRACES}) = '', 0, size(split({_BRACES}, ','))) ELSE json_array_length(arr) END AS BIGINT)"
#: Functions of one expression: (arguments, type, body). Their names are those of calls.NAMED's values.
BODIES = {
    "array_to_string": ("arr STRING, d STRING", "STRING", f"coalesce(array_join(split({_BRACES}, ','), d), '')"),
    "tide_array_to_string": ("arr STRING, d STRING, missing STRING DEFAULT NULL", "STRING", f"coalesce(array_join(split({_BRACES}, ','), d), '')"),
    "string_to_array": ("s STRING, d STRING", "ARRAY<STRING>", "if(d = '', split(s, ''), split(s, concat('\\\\Q', d, '\\\\E')))"),
    "tide_string_to_array": ("s STRING, d STRING", "STRING", "to_json(if(d = '', split(s, ''), split(s, concat('\\\\Q', d, '\\\\E'))))"),
    "tide_array_length": ("arr STRING, dim INT DEFAULT 1", "BIGINT", _LENGTH),
    "tide_array_lower": ("arr STRING, dim INT DEFAULT 1", "BIGINT", f"if({_LENGTH} > 0, 1L, NULL)"),
    "tide_array_upper": ("arr STRING, dim INT DEFAULT 1", "BIGINT", f"if({_LENGTH} > 0, {_LENGTH}, NULL)"),
    "tide_quote_ident": ("s STRING", "STRING", f"if(s rlike '^[A-Za-z_][A-Za-z0-9_]*$' AND lower(s) NOT IN ({', '.join(map(quoted, KEYWORDS))}), s, concat('\"', replace(s, '\"', '\"\"'), '\"'))"),
    "tide_format_type": ("oid BIGINT, typmod BIGINT DEFAULT NULL", "STRING", f"coalesce(try_element_at({_mapped(TYPE_OIDS)}, oid), 'unknown')"),
    "tide_version": ("", "STRING", quoted(VERSION)),
}
UDFS = {"json_contains": json_contains_any, "tide_json_contains": json_contains_any, "parse_ident": parse_ident_column, "tide_parse_ident": parse_ident_column, "tide_regexp_replace": regexp_replace_any}


def register(spark: SparkSession, names: set[str] | None = None, definitions: dict[str, dict[int, str]] | None = None) -> None:
    """The functions that SQL text may call, as SQL functions that the optimiser inlines, and Python where it must be.

    names: only these. definitions: for functions that look a definition up by its number, what they answer.
    """
    for name, udf in UDFS.items():
        if names is None or name in names:
            spark.udf.register(name, udf)
    bodies = BODIES | {n: ("oid BIGINT, col BIGINT DEFAULT 0, pretty BOOLEAN DEFAULT false", "STRING", f"try_element_at({_mapped(x)}, oid)") for n, x in (definitions or {}).items()}
    for name, (arguments, kind, body) in bodies.items():
        if names is None or name in names:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
