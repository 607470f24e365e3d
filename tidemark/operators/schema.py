"""Schemas from DDL text, their differences, and additive evolution."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine.catalog import TableSpec
from tidemark.plans import dialect


class SchemaError(ValueError):
    pass


@dataclass
class Difference:
    """What leads from one schema to another: new tables, new columns by table, and indexes to make or drop."""

    tables: list[str] = field(default_factory=list)
    columns: dict[str, list[str]] = field(default_factory=dict)
    new_indexes: dict[str, list[str]] = field(default_factory=dict)
    dropped_indexes: dict[str, list[str]] = field(default_factory=dict)


def spark_type(declared: str | None) -> T.DataType:
    """The type of a declared column type: by the affinity rules, then by well-known names for what is left."""
    name = re.sub(r"\(.*?\)", "", declared or "").strip().upper()
    if not name:
        return T.BinaryType()
    if "INT" in name:
        return T.LongType()
    if any(x in name for x in ("CHAR", "CLOB", "TEXT")) or name == "JSON":
        return T.StringType()
    if "BLOB" in name or name == "JSONB":
        return T.BinaryType()
    if any(x in name for x in ("REAL", "FLOA", "DOUB")) or name == "ANY":
        return T.DoubleType()
    known = {"BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(), "DATE": T.DateType(), "DECIMAL": T.DecimalType(38, 18), "NUMERIC": T.DecimalType(38, 18)}
    return known.get(name, T.DoubleType())


def parse(sql: str) -> dict[str, TableSpec]:
    """The tables of CREATE TABLE and CREATE INDEX statements; SchemaError for anything else that a schema can't hold."""
    tables: dict[str, TableSpec] = {}
    created: set[str] = set()
    dropped: set[str] = set()
    for text in dialect.statements(sql):
        words = [t for t in dialect.tokens(text) if not t.isspace() and not t.startswith(("--", "/*"))]
        low = [w.lower() for w in words]
        if low[:2] == ["create", "table"]:
            spec = _table(words[2:])
            if not _internal(spec.name):
                tables[spec.name] = spec
        elif low[0] == "create" and "index" in low[1:3]:
            if low[1] == "unique":
                raise SchemaError("unique indexes aren't allowed")
            at = low.index("on")
            name = _name(words[at - 1])
            end = _close(words, at + 2)
            table = _name(words[at + 1])
            if table not in tables:
                raise SchemaError(f"index {name} is on a table that isn't there: {table}")
            tables[table].indexes[name] = tuple(_name(w) for w in words[at + 3 : end] if w != ",")
            created.add(name)
        elif low[:4] == ["drop", "index", "if", "exists"]:
            dropped.add(_name(words[4]))
        else:
            raise SchemaError(f"not allowed in a schema: {' '.join(words[:4])}")
    if created & dropped:
        raise SchemaError(f"created and dropped: {sorted(created & dropped)}")
    return tables


def _internal(name: str) -> bool:
    return name.startswith(("sqlite_", "__"))


def _name(word: str) -> str:
    return word[1:-1].replace('""', '"') if word[0] in '"`[' else word


def _close(words: list[str], n: int) -> int:
    depth = 0
    for k in range(n, len(words)):
        depth += {"(": 1, ")": -1}.get(words[k], 0)
        if not depth:
            return k
    raise SchemaError("a bracket isn't closed")


def _parts(words: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    depth = 0
    for w in words:
        depth += {"(": 1, ")": -1}.get(w, 0)
        if w == "," and not depth:
            out.append([])
        else:
            out[-1].append(w)
    return [p for p in out if p]


def _table(words: list[str]) -> TableSpec:
    low = [w.lower() for w in words]
    if low[:3] == ["if", "not", "exists"]:
        words = words[3:]
    if len(words) < 2 or words[1] != "(":
        raise SchemaError("a table is made from columns, not from a query")
    name = _name(words[0])
    fields: list[T.StructField] = []
    key: list[str] = []
    defaults: dict[str, str] = {}
    generated: dict[str, str] = {}
    for part in _parts(words[2 : _close(words, 1)]):
        low = [w.lower() for w in part]
        if low[0] == "primary":
            inner = part[3:-1]
            if "(" in inner:
                raise SchemaError("a primary key holds no expressions")
            key = [_name(w) for w in inner if w != "," and w.lower() not in ("asc", "desc")]
        elif low[0] in ("foreign", "references") or "references" in low:
            raise SchemaError("foreign keys aren't allowed")
        elif low[0] in ("unique", "check", "constraint"):
            raise SchemaError(f"a {low[0]} constraint isn't allowed")
        else:
            column = _name(part[0])
            stop = next((n for n, w in enumerate(low) if n and w in ("not", "null", "default", "primary", "generated", "as", "collate", "check", "unique")), len(part))
            declared = "".join(w if w in "()," else f" {w}" for w in part[1:stop]).strip() or None
            required = any(low[n : n + 2] == ["not", "null"] for n in range(len(low)))
            if "default" in low:
                n = low.index("default") + 1
                defaults[column] = " ".join(part[n : _close(part, n) + 1]) if part[n] == "(" else part[n] + (part[n + 1] if part[n] in "+-" else "")
            if "as" in low:
                n = low.index("as") + 1
                generated[column] = "".join(w if w in "()," else f" {w}" for w in part[n + 1 : _close(part, n)]).strip()
            if "primary" in low:
                key.append(column)
            if "unique" in low:
                raise SchemaError("a unique constraint isn't allowed")
            fields.append(T.StructField(column, spark_type(declared), not required, {"declared": declared or ""}))
    for f in fields:
        if not f.nullable and f.name not in key and f.name not in defaults and f.name not in generated:
            raise SchemaError(f"{name}.{f.name} is NOT NULL and has no default")
    if not key:
        raise SchemaError(f"{name} has no primary key")
    return TableSpec(name, T.StructType(fields), tuple(key), defaults, generated)


def compare(old: dict[str, TableSpec], new: dict[str, TableSpec]) -> Difference:
    """What has to be added. Dropping tables or columns, changing a column and adding key columns are errors."""
    out = Difference()
    if gone := sorted(old.keys() - new.keys()):
        raise SchemaError(f"tables can't be dropped: {gone}")
    for name, spec in new.items():
        if name not in old:
            out.tables.append(name)
            out.new_indexes[name] = sorted(spec.indexes)
            continue
        before = {f.name: f for f in old[name].schema}
        after = {f.name: f for f in spec.schema}
        if missing := sorted(before.keys() - after.keys()):
            raise SchemaError(f"columns of {name} can't be dropped: {missing}")
        if old[name].key != spec.key:
            raise SchemaError(f"the primary key of {name} can't change")
        for c, f in before.items():
            changed = (f.dataType, f.nullable, old[name].defaults.get(c), old[name].generated.get(c)) != (after[c].dataType, after[c].nullable, spec.defaults.get(c), spec.generated.get(c))
            if changed:
                raise SchemaError(f"{name}.{c} can't change")
        if added := [c for c in after if c not in before]:
            out.columns[name] = added
        out.new_indexes[name] = sorted(k for k, v in spec.indexes.items() if old[name].indexes.get(k) != v)
        out.dropped_indexes[name] = sorted(k for k, v in old[name].indexes.items() if spec.indexes.get(k) != v)
    return out


def evolve(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows of an older schema in the newer one: missing columns by their default, generated ones computed."""
    out = df
    for f in spec.schema:
        if f.name not in df.columns and f.name not in spec.generated:
            default = spec.defaults.get(f.name)
            out = out.withColumn(f.name, (F.expr(default) if default is not None else F.lit(None)).cast(f.dataType))
    for c, expr in spec.generated.items():
        out = out.withColumn(c, F.expr(expr))
    return out.select(*[f.name for f in spec.schema])
