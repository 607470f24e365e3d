"""Statements that write: INSERT, REPLACE, UPDATE and DELETE, with ON CONFLICT and RETURNING, as new versions of tables.

A statement turns a table into another frame; nothing is changed in place. Rows are told apart by the table's key, in one
join by it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans import dialect

Reader = Callable[[str, Any, dict[str, DataFrame]], DataFrame]


class ConflictError(ValueError):
    """A key that is there already, occurs twice, or is null."""


@dataclass
class Write:
    """A statement that writes, in parts. Texts are in the client's dialect."""

    kind: str
    table: str
    columns: list[str] = field(default_factory=list)
    source: str = ""
    conflict: str = "abort"
    target: list[str] = field(default_factory=list)
    sets: list[tuple[str, str]] = field(default_factory=list)
    where: str = ""
    returning: str = ""
    before: str = ""  # a WITH list


def parse(sql: str) -> Write:
    """The parts of one statement that writes; ValueError if it can't be read."""
    word, start = dialect.verb(sql)
    ts = _solid(sql)
    if word not in ("insert", "replace", "update", "delete"):
        raise ValueError(f"not a statement that writes: {word}")
    head, ts = " ".join(ts[:start]), ts[start + 1 :]
    write = Write("insert" if word == "replace" else word, "", before=head, conflict="replace" if word == "replace" else "abort")
    ts, write.returning = _cut(ts, "returning")
    if word in ("insert", "replace"):
        if ts and ts[0].lower() == "or":
            write.conflict, ts = ts[1].lower(), ts[2:]
        if not ts or ts[0].lower() != "into":
            raise ValueError("INTO is missing")
        write.table, ts = _name(ts[1]), ts[2:]
        body, rest = _split(ts, "on", "conflict")
        if body and body[0] == "(" and body[1].lower() not in ("select", "values", "with"):
            end = body.index(")")
            write.columns, body = [_name(t) for t in body[1:end] if t != ","], body[end + 1 :]
        write.source = " ".join(body)
        if rest is not None:
            if rest[0] == "(":
                end = rest.index(")")
                write.target, rest = [_name(t) for t in rest[1:end] if t != ","], rest[end + 1 :]
            words = [t.lower() for t in rest]
            if words[:2] == ["do", "nothing"]:
                write.conflict = "ignore"
            elif words[:3] == ["do", "update", "set"]:
                rest, write.where = _cut(rest[3:], "where")
                write.conflict, write.sets = "update", _sets(rest)
            else:
                raise ValueError("ON CONFLICT takes DO NOTHING or DO UPDATE SET")
        if write.conflict not in ("abort", "fail", "rollback", "ignore", "replace", "update"):
            raise ValueError(f"no such conflict rule: {write.conflict}")
        return write
    if word == "delete":
        if not ts or ts[0].lower() != "from":
            raise ValueError("FROM is missing")
        ts = ts[1:]
    write.table, ts = _name(ts[0]), ts[1:]
    ts, write.where = _cut(ts, "where")
    if word == "update":
        if not ts or ts[0].lower() != "set":
            raise ValueError("SET is missing")
        write.sets, ts = _sets(ts[1:]), []
    if ts:
        raise ValueError(f"not understood: {' '.join(ts)}")
    return write


def _solid(sql: str) -> list[str]:
    return [t for t in dialect.tokens(sql) if not t.isspace() and not t.startswith(("--", "/*")) and t != ";"]


def _name(token: str) -> str:
    return token.strip('"`').lower() if token[0] in "\"`" else token.lower()


def _split(ts: list[str], *words: str) -> tuple[list[str], list[str] | None]:
    """What stands before and after words outside brackets; None after if they aren't there."""
    depth = 0
    for n, t in enumerate(ts):
        depth += {"(": 1, ")": -1}.get(t, 0)
        if not depth and [x.lower() for x in ts[n : n + len(words)]] == list(words):
            return ts[:n], ts[n + len(words) :]
    return ts, None


def _cut(ts: list[str], word: str) -> tuple[list[str], str]:
    head, rest = _split(ts, word)
    return head, " ".join(rest or [])


def _sets(ts: list[str]) -> list[tuple[str, str]]:
    out = []
    for part in dialect.split_arguments([x for t in ts for x in (t, " ")]):
        name, equals, value = part.strip().partition("=")
        if not equals:
            raise ValueError(f"not an assignment: {part}")
        out.append((_name(name.strip()), value.strip()))
    return out


def apply(write: Write, stored: DataFrame, key: tuple[str, ...], defaults: dict[str, str], read: Reader, values: Any) -> tuple[DataFrame, DataFrame]:
    """The table after a statement, and the rows that it has put in, changed or deleted."""
    if unknown := [c for c in [*write.columns, *(c for c, _ in write.sets)] if c not in stored.columns]:
        raise ValueError(f"{write.table} has no column {', '.join(unknown)}")
    if write.kind == "insert":
        return _insert(write, stored, key, defaults, read, values)
    condition = f"coalesce(({write.where}), false)" if write.where else "true"
    kept = read(f"SELECT * FROM {write.table} WHERE NOT {condition}", values, {write.table: stored})
    named = dict(write.sets)
    shown = ", ".join(f"CAST(({named[f.name]}) AS {f.dataType.simpleString()}) AS {f.name}" if f.name in named else f.name for f in stored.schema)
    hit = read(f"SELECT {shown} FROM {write.table} WHERE {condition}", values, {write.table: stored})
    if write.kind == "delete":
        return kept, hit
    after = kept.unionByName(hit)
    if set(named) & set(key):
        _unique(after, key, write.table)
    return after, hit


def _insert(write: Write, stored: DataFrame, key: tuple[str, ...], defaults: dict[str, str], read: Reader, values: Any) -> tuple[DataFrame, DataFrame]:
    columns = write.columns or stored.columns
    if write.source.lower() == "default values":
        columns, given = [], stored.sparkSession.range(1).drop("id")
    else:
        given = read(f"{write.before} SELECT * FROM ({write.source}) AS _given({', '.join(columns)})", values, {write.table: stored})
    new = given.withColumn("_n", F.monotonically_increasing_id())
    new = new.select(*[(F.col(f.name) if f.name in columns else F.expr(defaults.get(f.name, "NULL"))).cast(f.dataType).alias(f.name) for f in stored.schema], "_n")
    if not key:
        fresh = new.drop("_n")
        return stored.unionByName(fresh), fresh
    if write.target and set(write.target) != set(key):
        raise ValueError(f"{write.table} has no key on {', '.join(write.target)}")
    if write.conflict in ("ignore", "replace"):  # of rows that share a key the first stays, or the last
        order = F.col("_n") if write.conflict == "ignore" else F.desc("_n")
        new = new.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("_r = 1").drop("_r")
    else:
        _unique(new, key, write.table)
    new = new.drop("_n")
    if write.conflict == "replace":
        return stored.join(new.select(*key), list(key), "left_anti").unionByName(new), new
    if write.conflict == "ignore":
        fresh = new.join(stored.select(*key), list(key), "left_anti").select(*stored.columns)
        return stored.unionByName(fresh), fresh
    if write.conflict != "update":
        if not new.join(stored.select(*key), list(key), "left_semi").isEmpty():
            raise ConflictError(f"a key of {write.table} is there already")
        return stored.unionByName(new), new
    fresh = new.join(stored.select(*key), list(key), "left_anti").select(*stored.columns)
    renamed = new.select(*key, *[F.col(c).alias(f"excluded_{c}") for c in stored.columns if c not in key], *[F.col(c).alias(f"excluded_{c}") for c in key])
    both = stored.join(renamed, list(key))

    def told(text: str) -> str:
        """excluded.c as the name that the joined row has for it."""
        ts, out, n = _solid(text), [], 0
        while n < len(ts):
            own = ts[n].lower() == "excluded" and ts[n + 1 : n + 2] == ["."]
            out.append(f"excluded_{_name(ts[n + 2])}" if own else ts[n])
            n += 3 if own else 1
        return " ".join(out)

    named = {c: told(x) for c, x in write.sets}
    shown = ", ".join(f"CAST(({named[f.name]}) AS {f.dataType.simpleString()}) AS {f.name}" if f.name in named else f.name for f in stored.schema)
    condition = f"coalesce(({told(write.where)}), false)" if write.where else "true"
    changed = read(f"SELECT {shown} FROM {write.table} WHERE {condition}", values, {write.table: both})
    after = stored.join(changed.select(*key), list(key), "left_anti").unionByName(changed).unionByName(fresh)
    return after, changed.unionByName(fresh)


def _unique(rows: DataFrame, key: tuple[str, ...], table: str) -> None:
    null = rows.where(" OR ".join(f"{c} IS NULL" for c in key))
    twice = rows.groupBy(*key).agg(F.count("*").alias("_times")).where("_times > 1")
    if not null.isEmpty() or not twice.isEmpty():
        raise ConflictError(f"a key of {table} is null or occurs twice")
