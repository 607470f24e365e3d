"""A live query kept by a stream of changes.

Everything that a batch does is written under its id, so a batch that runs again after a failure writes the same again:
its change events to log/batch=N, the last row and change ids to heads/batch=N. The current rows are the last event of
each key. Every so many batches these are written to state/batch=N by buckets of keys, and events that lie further back
than both the log is kept and the state before is old go. A batch reads the buckets of the keys that it names and the
events since the last state, so it costs as much as what changed lately, not as much as all history.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.changes import with_numbers
from tidemark.operators.subscriptions import LOG_KEEPS, difference


#: Buckets of keys in a state. Fixed, as states written before are read by it.
BUCKETS = 64


class LiveQuery:
    """Rows of one keyed table that a condition selects. Changes carry the key, all cells, `deleted` and `at`, their order.

    every: batches from one compacted state to the next; keeps: changes that stay in the log at least.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], cells: T.StructType, condition: str = "true", every: int = 16, keeps: int = LOG_KEEPS):
        self.spark, self.folder, self.key, self.cells, self.condition = spark, folder.rstrip("/"), key, cells, condition
        self.every, self.keeps = every, keeps

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _batches(self, part: str) -> list[int]:
        """The batches whose files of a part are complete."""
        fs, path = self._path(part)
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        ids = [int(x.removeprefix("batch=")) for x in names if x.startswith("batch=")]
        return sorted(n for n in ids if fs.exists(self._path(part, f"batch={n}", "_SUCCESS")[1]))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(BUCKETS)).cast("int").alias("_bucket")

    def _since(self, before: int | None = None) -> DataFrame | None:
        """The last state, of before a batch if one is given, and the events since, with the buckets of their keys."""
        events = self._events(before)
        if events is None:
            return None
        events = events.withColumn("_bucket", self._bucket())
        state = max((n for n in self._batches("state") if before is None or n < before), default=None)
        if state is None:
            return events
        compacted = self.spark.read.schema(events.schema).parquet(f"{self.folder}/state/batch={state}").withColumn("batch", F.lit(state))
        return events.where(F.col("batch") > state).unionByName(compacted)

    def _compact(self, batch_id: int) -> None:
        """Write the state after a batch, and free what neither it, a second run of the batch nor a late reader needs."""
        events = self._since(batch_id + 1)
        others = [c for c in events.columns if c not in self.key]
        last = events.groupBy(*self.key).agg(F.max_by(F.struct(*others), F.col("change_id")).alias("e")).where("e.change_type <> 'delete'")
        rows = last.select(*self.key, *[F.col(f"e.{c}").alias(c) for c in others if c != "batch"])
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/state/batch={batch_id}")
        before = max((n for n in self._batches("state") if n < batch_id), default=None)
        if before is None:
            return
        heads = self.spark.read.option("basePath", f"{self.folder}/heads").parquet(f"{self.folder}/heads").where(F.col("batch") <= batch_id)
        reach = {r["batch"]: r["change_id"] for r in heads.select("batch", "change_id").collect()}  # a row for each batch that is kept
        gone = [n for n, last_id in reach.items() if n < before and last_id < reach[batch_id] - self.keeps]
        for part, ids in (("log", gone), ("heads", gone), ("state", [n for n in self._batches("state") if n < before])):
            for n in ids:
                fs, path = self._path(part, f"batch={n}")
                fs.delete(path, True)

    def _events(self, before: int | None = None) -> DataFrame | None:
        """All events so far, or those of batches before one; None if there are none."""
        try:
            found = self.spark.read.option("basePath", f"{self.folder}/log").parquet(f"{self.folder}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise
        return found if before is None else found.where(F.col("batch") < before)

    def _heads(self, before: int) -> tuple[int, int]:
        try:
            rows = self.spark.read.option("basePath", f"{self.folder}/heads").parquet(f"{self.folder}/heads").where(F.col("batch") < before)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return 0, 0
            raise
        last = rows.orderBy(F.desc("batch")).select("row_id", "change_id").first()
        return (last["row_id"], last["change_id"]) if last else (0, 0)

    def _last(self, events: DataFrame) -> DataFrame:
        """The last event of each key, if it isn't a deletion: the current rows."""
        others = [c for c in events.columns if c not in self.key]
        last = events.groupBy(*self.key).agg(F.max_by(F.struct(*others), F.col("change_id")).alias("e"))
        return last.where("e.change_type <> 'delete'").select(*self.key, *[F.col(f"e.{f.name}").alias(f.name) for f in self.cells], F.col("e.row_id").alias("row_id"))

    def rows(self) -> DataFrame | None:
        """The current rows with their row ids."""
        events = self._since()
        return None if events is None else self._last(events)

    def log(self) -> DataFrame | None:
        return self._events()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Turn a batch of changes into events, numbered on from the batch before."""
        names = [f.name for f in self.cells]
        batch = batch.persist()
        try:
            newest = batch.groupBy(*self.key).agg(F.max_by(F.struct(*names, "deleted"), F.col("at")).alias("r"))
            flat = newest.select(*self.key, F.col("r.deleted").alias("deleted"), *[F.col(f"r.{c}").alias(c) for c in names])
            new = flat.where("not deleted").where(self.condition).select(*self.key, *names)
            events = self._since(batch_id)
            if events is None:
                stored = self.spark.createDataFrame([], T.StructType([*[batch.schema[k] for k in self.key], *self.cells.fields, T.StructField("row_id", T.LongType())]))
            else:
                touched = [row[0] for row in flat.select(self._bucket()).distinct().collect()]  # BUCKETS at most
                stored = self._last(events.where(F.col("_bucket").isin(touched)).join(flat.select(*self.key), self.key, "left_semi"))
            last_row, last_change = self._heads(batch_id)
            moved = difference(stored.drop("row_id"), new, self.key)
            fresh = with_numbers(moved.where("change_type = 'insert'").select(*self.key), self.key, "_fresh", first=last_row + 1)
            numbered = moved.join(stored.select(*self.key, F.col("row_id").alias("_row")), self.key, "left").join(fresh, self.key, "left")
            ordered = numbered.withColumn("row_id", F.coalesce("_row", "_fresh")).drop("_row", "_fresh").withColumn("_late", (F.col("change_type") == "delete").cast("int"))
            out = with_numbers(ordered, ["_late", *self.key], "change_id", first=last_change + 1).drop("_late")
            at = f"{self.folder}/log/batch={batch_id}"
            out.write.mode("overwrite").parquet(at)
            top = self.spark.read.schema(out.schema).parquet(at).agg(F.coalesce(F.max("row_id"), F.lit(0)).alias("row_id"), F.coalesce(F.max("change_id"), F.lit(0)).alias("change_id"))
            top.select(F.greatest("row_id", F.lit(last_row)).alias("row_id"), F.greatest("change_id", F.lit(last_change)).alias("change_id")).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/heads/batch={batch_id}")
            if (batch_id + 1) % self.every == 0:
                self._compact(batch_id)
        finally:
            batch.unpersist()

    def start(self, changes: DataFrame, **trigger: object) -> StreamingQuery:
        """Follow a stream of changes; by default until all that is there has been read."""
        writer = changes.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def catch_up(self, after: int, keeps: int | None = None) -> DataFrame:
        """Changes after an id in order; an error if they lie further back than the log is kept."""
        events = self._events()
        if events is None:
            raise LookupError("there are no changes yet")
        keeps = self.keeps if keeps is None else min(keeps, self.keeps)
        newest = events.agg(F.max("change_id")).first()[0] or 0
        if after + 1 < newest - keeps:
            raise LookupError(f"changes after {after} are gone; the oldest is {newest - keeps}")
        return events.where(F.col("change_id") > after).orderBy("change_id")


def guard_late(notes: DataFrame, idle: str = "1 hour") -> DataFrame:
    """A stream of notifications (pk, cl, at) without those whose causal length is lower than one seen for the key.

    A key's largest causal length is kept until the key has been quiet for a while.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        for batch in batches:
            batch = batch.sort_values("at", kind="stable")
            reach = batch["cl"].cummax().clip(lower=seen)
            yield batch[batch["cl"] >= reach][["pk", "cl", "at"]]
            seen = max(seen, int(batch["cl"].max()))
        state.update((seen,))
        state.setTimeoutDuration(_milliseconds(idle))

    out = "pk long, cl long, at long"
    return notes.select("pk", "cl", "at").groupBy("pk").applyInPandasWithState(keep, out, "seen long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _milliseconds(text: str) -> int:
    n, unit = text.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
