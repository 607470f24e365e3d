"""Ingest by hash differences, upserts, and retention."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seconds of each unit.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}
REAP_LIMIT = 500


def record_hash(columns: list[str]) -> Column:
    """A hash of chosen columns; null and '' differ."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def hash_diff(stored: DataFrame, fetched: DataFrame, key: str, hashed: list[str]) -> DataFrame:
    """(key, action): upsert what is new or differs in the hashed columns, delete what is gone.

    Only keys and 8-byte hashes are shuffled.
    """
    a = stored.select(key, record_hash(hashed).alias("_old"))
    b = fetched.select(key, record_hash(hashed).alias("_new"))
    both = a.join(b, key, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(key, F.when(F.col("_new").isNull(), "delete").otherwise("upsert").alias("action"))


def upsert(stored: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """stored with rows put in, replacing those of the same key. The unchanged rows are found by an anti join."""
    return stored.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*stored.columns))


def upsert_if_newer(stored: DataFrame, rows: DataFrame, key: list[str], by: str, keep: list[str] | None = None) -> DataFrame:
    """The newer row of each key by a column (stored wins ties); columns in keep fall back to the stored value if null."""
    others = [c for c in stored.columns if c not in key]
    both = stored.select(*key, F.struct(*others).alias("r"), F.lit(1).alias("_held")).unionByName(rows.select(*key, F.struct(*others).alias("r"), F.lit(0).alias("_held")))
    merged = both.groupBy(*key).agg(F.max_by("r", F.struct(F.col(f"r.{by}"), F.col("_held"))).alias("r"), F.max(F.when(F.col("_held") == 1, F.col("r"))).alias("o"))
    return merged.select(*key, *[(F.coalesce(f"r.{c}", f"o.{c}") if c in (keep or []) else F.col(f"r.{c}")).alias(c) for c in others])


def delete_if_older(stored: DataFrame, ids: DataFrame, key: str, by: str, before: Column) -> DataFrame:
    """stored without the rows whose key is in ids and whose `by` lies before a bound."""
    doomed = stored.where(F.col(by) < before).select(key).join(ids.select(key), key, "left_semi")
    return stored.join(doomed, key, "left_anti")


def duration(text: str) -> int:
    """Seconds of '30s', '5m', '2h', '14d', '1w' or '1y'."""
    found = re.fullmatch(r"(\d+)([smhdwy])", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * UNITS[found[2]]


def reapable(changes: DataFrame, now: Column, retention: str, limit: int | None = REAP_LIMIT, where: str | None = None) -> DataFrame:
    """Keys of deleted rows whose deletion is older than the retention; the oldest first, up to a limit if there is one.

    A row's largest causal length says whether it is deleted now: one that came back after an old deletion is alive. Each
    key comes out once, with the time of its latest deletion.
    """
    latest = changes.groupBy("tbl", "pk").agg(F.max("cl").alias("cl"), F.max(F.when((F.col("cid") == "-1") & (F.col("cl") % 2 == 0), F.struct("cl", "ts"))).alias("gone"))
    old = latest.where("cl % 2 = 0 and gone.cl = cl").select("tbl", "pk", F.col("gone.ts").alias("ts")).where(F.col("ts") < now - F.expr(f"interval {duration(retention)} seconds"))
    old = old.where(where) if where else old
    return old.orderBy("ts", "tbl", "pk").limit(limit) if limit else old


def reap(changes: DataFrame, keys: DataFrame) -> DataFrame:
    return changes.join(keys.select("tbl", "pk"), ["tbl", "pk"], "left_anti")


def orphan_keys(keys: DataFrame, changes: DataFrame, on: list[str], limit: int | None = None) -> DataFrame:
    """Keys that no change mentions."""
    lost = keys.select(*on).join(changes.select(*on), on, "left_anti").distinct()
    return lost.orderBy(*on).limit(limit) if limit else lost
