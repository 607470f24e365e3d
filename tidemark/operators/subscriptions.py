"""Live queries: a snapshot with row ids, then inserts, updates and deletes with contiguous change ids.

A subscription is the exact difference of a query's result between two committed states, by primary key. That holds for
any query: what feeds it - joins, subqueries, unions - need not be known. With key tables of what changed, the query can
be narrowed to the keys concerned before it is compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.changes import settled, with_numbers

#: Changes that the log keeps before its newest.
LOG_KEEPS = 500


def initial(result: DataFrame, key: list[str]) -> DataFrame:
    """The snapshot: the result with row_id from 1 in the order of the key."""
    return with_numbers(result, key, "row_id")


def candidates(changed: DataFrame, table: str, used: list[str]) -> DataFrame:
    """Keys of the changes that may matter: those of a used column, and deletions; one per key."""
    return changed.where((F.col("tbl") == table) & (F.col("cid").isin(used) | (F.col("cid") == "-1"))).select("tbl", "pk").distinct()


def narrowed(result: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Only the rows of the keys concerned."""
    return result.join(keys.select(*on), on, "left_semi")


def difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(change_type, key, cells): inserted and updated rows with new cells, deleted ones with all their old cells.

    One full join; equal rows fall out before anything is numbered.
    """
    cells = [c for c in new.columns if c not in key]
    a = old.select(*key, F.struct(*cells).alias("_old") if cells else F.struct(F.lit(1)).alias("_old"))
    b = new.select(*key, F.struct(*cells).alias("_new") if cells else F.struct(F.lit(1)).alias("_new"))
    both = a.join(b, key, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    kind = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    shown = F.coalesce("_new", "_old")
    return both.select(kind.alias("change_type"), *key, *[shown[c].alias(c) for c in cells])


def keyed_difference(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """difference() where parts of the key may be null, as those of the tables on the right of a LEFT JOIN are."""
    parts = F.to_json(F.struct(*key), {"ignoreNullFields": "false"})
    moved = difference(old.withColumn("_key", parts).drop(*key), new.withColumn("_key", parts).drop(*key), ["_key"])
    kept = F.from_json("_key", new.select(*key).schema)
    return moved.select("change_type", *[kept[c].alias(c) for c in key], *[c for c in moved.columns if c not in ("change_type", "_key")])


def upserts(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return difference(old, new, key).where("change_type <> 'delete'")


def deletes(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return difference(old, new, key).where("change_type = 'delete'").drop("change_type")


def changes(stored: DataFrame, new: DataFrame, key: list[str], last_change: int = 0) -> DataFrame:
    """The change events after a commit: change_id, change_type, row_id, key, cells.

    stored: the materialised result with row_id. Upserts come before deletes, each in the order of the key; inserted rows
    get row ids after the largest so far.
    """
    moved = settled(difference(stored.drop("row_id"), new, key))
    held = stored.select(*key, F.col("row_id").alias("_row"))
    last_row = stored.agg(F.coalesce(F.max("row_id"), F.lit(0))).first()[0]
    inserted = with_numbers(moved.where("change_type = 'insert'").select(*key), key, "_fresh", first=last_row + 1, settle=False)
    rows = moved.join(held, key, "left").join(inserted, key, "left").withColumn("row_id", F.coalesce("_row", "_fresh")).drop("_row", "_fresh")
    ordered = rows.withColumn("_late", (F.col("change_type") == "delete").cast("int"))  # numbered by quantiles of (late, key)
    return with_numbers(ordered, ["_late", *key], "change_id", first=last_change + 1).drop("_late")


def applied(stored: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """The materialised result after change events."""
    kept = stored.join(events.select(*key), key, "left_anti")
    return kept.unionByName(events.where("change_type <> 'delete'").select(*stored.columns))


def purge(log: DataFrame, keeps: int = LOG_KEEPS) -> DataFrame:
    """The log without what lies more than `keeps` ids behind the newest; keeps + 1 rows stay."""
    newest = log.agg(F.max("change_id").alias("_max"))
    return log.join(F.broadcast(newest), F.col("change_id") >= F.col("_max") - keeps).drop("_max")


def catch_up(log: DataFrame, after: int) -> DataFrame:
    """Changes after an id, in order; an error if the log no longer reaches back that far."""
    oldest = log.agg(F.min("change_id")).first()[0]
    if oldest is not None and after + 1 < oldest:
        raise LookupError(f"changes after {after} are gone; the oldest is {oldest}")
    return log.where(F.col("change_id") > after).orderBy("change_id")


def breaks(log: DataFrame, width: int = 100_000) -> DataFrame:
    """Where change ids aren't contiguous: (after_id, next_id).

    Ids are compared within blocks of numbers, and then the blocks' ends with each other, so that no task sees them all.
    """
    block = F.floor(F.col("change_id") / width)
    order = Window.partitionBy("_block").orderBy("change_id")
    inner = log.select("change_id", block.alias("_block")).withColumn("next_id", F.lead("change_id").over(order)).where("next_id <> change_id + 1").select(F.col("change_id").alias("after_id"), "next_id")
    ends = log.groupBy(block.alias("_block")).agg(F.min("change_id").alias("first"), F.max("change_id").alias("last"))
    outer = ends.select(F.col("last").alias("after_id"), F.lead("first").over(Window.orderBy("_block")).alias("next_id")).where("next_id <> after_id + 1")
    return inner.unionByName(outer)


def replay(snapshot: DataFrame, logs: list[DataFrame], key: list[str]) -> DataFrame:
    """The snapshot with logs of changes applied one after another."""
    return reduce(lambda rows, log: applied(rows, log, key), logs, snapshot)


# Table updates: a stream of keys that changed, without cells.


def notifications(changes_: DataFrame, table: str) -> DataFrame:
    """(change_type, pk) of one table's changes: delete if the causal length is even, else update (inserts as well)."""
    return changes_.where(F.col("tbl") == table).select(F.when(F.col("cl") % 2 == 0, "delete").otherwise("update").alias("change_type"), "pk", "cl", "seq")


def last_per_key(notes: DataFrame) -> DataFrame:
    """The last notification of each key in a batch."""
    return notes.groupBy("pk").agg(F.max_by("change_type", F.struct("cl", "seq")).alias("change_type"), F.max("cl").alias("cl"))


def without_late(notes: DataFrame, order: str) -> DataFrame:
    """Notifications whose causal length isn't below one that their key had before. The batch form of the streaming guard."""
    seen = F.max("cl").over(Window.partitionBy("pk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return notes.withColumn("_seen", seen).where("cl >= _seen").drop("_seen")
