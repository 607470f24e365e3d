"""The change log: capturing, merging, chunking and buffering changes of cells.

A change is a row (tbl, pk, cid, val, col_version, db_version, seq, site_id, cl, ts). Merging is a maximum, so it gives
the same rows whatever the order and however often a change arrives.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranges

SENTINEL = "-1"
CELL = ["tbl", "pk", "cid"]
VERSION = ["site_id", "db_version"]
#: Sampled rows for each bucket of numbers.
SAMPLED = 24
#: Bytes of a chunk, and of a change's numbers.
CHUNK_BYTES, NUMBER_BYTES = 8192, 8


def is_sentinel(cid: Column) -> Column:
    return cid == SENTINEL


def alive(cl: Column) -> Column:
    """Odd causal lengths are live rows, even ones deleted."""
    return cl % 2 == 1


def storage_order(val: Column) -> Column:
    """Sort key of a tagged value (t, i, r, s, b): null, then numbers, then text, then bytes; our own choice, as none is fixed."""
    kind = F.when(val["t"].isin(1, 2), 1).when(val["t"] == 3, 2).when(val["t"] == 4, 3).otherwise(0)
    return F.struct(kind.alias("k"), F.coalesce(val["r"], val["i"].cast("double")).alias("n"), val["i"].alias("i"), val["s"].alias("s"), val["b"].alias("b"))


def lww_merge(changes: DataFrame, order: Column | None = None) -> DataFrame:
    """The winning change of each cell: larger col_version, then larger value, then larger site_id.

    One aggregation with partial maxima: only a row per cell and task is shuffled, however hot a cell is.
    """
    rank = F.struct(F.col("col_version"), (F.col("val") if order is None else order).alias("v"), F.col("site_id"))
    others = [c for c in changes.columns if c not in CELL]
    won = changes.groupBy(*CELL).agg(F.max_by(F.struct(*others), rank).alias("w"))
    return won.select(*CELL, *[F.col(f"w.{c}").alias(c) for c in others])


def live_rows(changes: DataFrame) -> DataFrame:
    """(tbl, pk, cl) of rows whose largest causal length is odd."""
    return changes.groupBy("tbl", "pk").agg(F.max("cl").alias("cl")).where(alive(F.col("cl")))


def live_cells(changes: DataFrame) -> DataFrame:
    """Winning cells of live rows; cells written before the row's last deletion are dropped."""
    rows = live_rows(changes)
    return lww_merge(changes.where(~is_sentinel(F.col("cid"))).join(rows, ["tbl", "pk", "cl"]))


def materialize_rows(cells: DataFrame, columns: list[str]) -> DataFrame:
    """A row per pk with a column per cid. The columns are given, so no job looks for them."""
    return cells.groupBy("tbl", "pk").pivot("cid", columns).agg(F.first("val"))


def capture(old: DataFrame, new: DataFrame, key: list[str], columns: list[str], site_id: int, db_version: int, tbl: str) -> DataFrame:
    """Changes that lead from one snapshot to the other: a change per differing cell, a sentinel per deleted row.

    One full join on the key. seq counts from 0 in the order of key and column.
    """
    mark = F.lit(True).alias("_there")
    a = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in columns], mark.alias("_was"))
    b = new.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns], mark.alias("_is"))
    both = a.join(b, key, "full")
    cells = [F.when(F.col("_is") & (F.col("_was").isNull() | ~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))), F.struct(F.lit(c).alias("cid"), F.col(f"_new_{c}").cast("string").alias("val"), F.lit(1).alias("cl"))) for c in columns]
    gone = F.when(F.col("_is").isNull(), F.struct(F.lit(SENTINEL).alias("cid"), F.lit(None).cast("string").alias("val"), F.lit(2).alias("cl")))
    changed = both.select(*key, F.inline(F.filter(F.array(*cells, gone), lambda x: x.isNotNull())))
    pk = F.to_json(F.struct(*key)) if len(key) > 1 else F.col(key[0])
    return with_numbers(changed.select(pk.alias("pk"), "cid", "val", "cl"), ["pk", "cid"], "seq", first=0).withColumns({"tbl": F.lit(tbl), "site_id": F.lit(site_id), "db_version": F.lit(db_version)})


def settled(df: DataFrame) -> DataFrame:
    """A frame that is read several times, computed once: a checkpoint, if the session has a shared folder for them."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df


def with_numbers(df: DataFrame, order: list[str], name: str, first: int = 1, buckets: int | None = None, settle: bool = True) -> DataFrame:
    """Gapless numbers in the order of columns that together are unique, without one task seeing all rows.

    Rows are dealt by quantiles of the whole sort key, from a sample (those of the smallest hashes); each bucket counts on
    from the rows of the buckets before it. There are as many buckets as the session shuffles to, and 64 at least.
    df is read three times, so it is settled first; without `settle` it must give the same rows each time.
    """
    df = settled(df) if settle else df
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    key = [F.col(c) for c in order]
    sample = df.select(*order).orderBy(F.xxhash64(*key)).limit(SAMPLED * buckets)
    rows = sorted((tuple(r) for r in sample.collect()), key=lambda r: [_sorted_as(x) for x in r])
    bounds = rows[:: -(-len(rows) // buckets)][1:] if rows else []
    bucket = _bucket(df, order, bounds, 0)
    dealt = df.withColumn("_bucket", bucket)
    counts = dealt.groupBy("_bucket").agg(F.count("*").alias("_n"))  # as many rows as buckets
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_bucket").withColumn(name, (F.col("_own") + F.col("_before") + (first - 1)).cast("long")).drop("_bucket", "_own", "_before")


def _sorted_as(x: object) -> tuple:
    """A sampled value as Spark sorts it: null first, what isn't a number last, texts by their bytes."""
    if x is None:
        return (0,)
    return (2,) if x != x else (1, x.encode() if isinstance(x, str) else bytes(x) if isinstance(x, bytearray) else x)


def _bucket(df: DataFrame, order: list[str], bounds: list[tuple], first: int) -> Column:
    """How many bounds a row's sort key reaches, by halving: a tree of comparisons of which a row goes down one path."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    reached = F.lit(True)
    for c, x in reversed(list(zip(order, bounds[half], strict=True))):  # as the sort does: column by column, null first
        if x is None:
            reached = F.col(c).isNotNull() | reached
        else:
            value = F.lit(x).cast(df.schema[c].dataType)
            reached = F.coalesce((F.col(c) > value) | ((F.col(c) == value) & reached), F.lit(False))
    return F.when(reached, _bucket(df, order, bounds[half + 1 :], first + half + 1)).otherwise(_bucket(df, order, bounds[:half], first))


def change_size(nested: bool = False) -> Column:
    """Bytes that a change takes on the wire: names, key, value and its numbers; nested ones share table and key."""
    texts = ["cid"] if nested else ["tbl", "pk", "cid"]
    named = reduce(lambda x, y: x + y, [F.octet_length(F.col(c).cast("string")) for c in texts])
    value = F.coalesce(F.octet_length(F.col("val").cast("string")), F.lit(1))
    return (named + value + F.lit((4 if nested else 6) * NUMBER_BYTES)).cast("long")


def chunk_changes(changes: DataFrame, most: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of each version, cut once their bytes reach the limit: (site_id, db_version, start_seq, end_seq, n, bytes).

    changes has seq, last_seq and size. Ranges are contiguous from 0, and the last ends at last_seq. The reset after each
    cut makes this a fold over the sorted rows of a version; it streams through a task and holds one chunk's sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        start = n = size = seq = last = 0

        def row(end: int) -> tuple:
            return (*now, start, end, n, size)

        for batch in batches:
            site, version, seqs, lasts, sizes = (c.to_pylist() for c in batch.columns)
            for key, s, e, b in zip(zip(site, version, strict=True), seqs, lasts, sizes, strict=True):
                if key != now:
                    if now is not None and (n or seq < last):
                        out.append(row(last))
                    now, start, n, size, last = key, 0, 0, 0, e
                n, size, seq = n + 1, size + b, s
                if size >= most:
                    out.append(row(last if s >= last else s))
                    start, n, size = s + 1, 0, 0
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        if now is not None and (n or seq < last):
            out.append(row(last))
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    names = [*VERSION, "start_seq", "end_seq", "n", "bytes"]
    schema = pa.schema([(x, pa.int64()) for x in names])
    columns = [F.col(c).cast("long").alias(c) for c in (*VERSION, "seq", "last_seq", "size")]
    dealt = changes.select(*columns).repartition(*VERSION).sortWithinPartitions(*VERSION, "seq")
    return dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def dedupe_changesets(sets: DataFrame, known: DataFrame) -> DataFrame:
    """Changesets (site_id, db_version, start_seq, end_seq) once each, without those that bookkeeping has."""
    key = [*VERSION, "start_seq", "end_seq"]
    return sets.dropDuplicates(key).join(known.select(*key).distinct(), key, "left_anti")


def route(sets: DataFrame) -> DataFrame:
    """complete if a changeset spans 0 to last_seq: it merges now; else it is buffered."""
    return sets.withColumn("route", F.when((F.col("start_seq") == 0) & (F.col("end_seq") == F.col("last_seq")), "merge").otherwise("buffer"))


def buffer_changes(buffered: DataFrame, arrived: DataFrame) -> DataFrame:
    """Buffered changes with the arrived ones that aren't there yet, by (site_id, db_version, seq)."""
    key = [*VERSION, "seq"]
    fresh = arrived.dropDuplicates(key).join(buffered.select(*key), key, "left_anti")
    return buffered.unionByName(fresh)


def complete_versions(buffered: DataFrame) -> DataFrame:
    """Versions whose buffered seqs run from 0 to last_seq without a gap. Counting distinct seqs suffices."""
    seen = buffered.where("seq between 0 and last_seq").groupBy(*VERSION).agg(F.count_distinct("seq").alias("n"), F.max("last_seq").alias("last_seq"))
    return seen.where("n = last_seq + 1").select(*VERSION)


def apply_buffered(changes: DataFrame, buffered: DataFrame) -> DataFrame:
    """The winners after the complete buffered versions have joined the log."""
    ready = buffered.join(complete_versions(buffered), VERSION, "left_semi").select(*changes.columns)
    return lww_merge(changes.unionByName(ready))


def impactful(before: DataFrame, arrived: DataFrame) -> DataFrame:
    """Arrived changes that win their cell and change its value or version. before: winners so far."""
    after = lww_merge(before.select(*arrived.columns).unionByName(arrived))
    old = before.select(*CELL, F.col("val").alias("_val"), F.col("col_version").alias("_version"), F.col("site_id").alias("_site"), F.lit(True).alias("_was"))
    joined = after.join(old, CELL, "left")
    same = F.col("_was") & F.col("val").eqNullSafe(F.col("_val")) & (F.col("col_version") == F.col("_version")) & (F.col("site_id") == F.col("_site"))
    return joined.where(~F.coalesce(same, F.lit(False))).select(*after.columns)


def fully_buffered(seqs: DataFrame) -> DataFrame:
    """Bookkeeping rows of versions that are all there."""
    return seqs.where("start_seq = 0 and end_seq = last_seq").select(*VERSION)


def orphans(buffered: DataFrame, seqs: DataFrame) -> DataFrame:
    """Buffered versions that bookkeeping doesn't know."""
    return buffered.select(*VERSION).join(seqs.select(*VERSION), VERSION, "left_anti").distinct()


def without_applied(buffered: DataFrame, applied: DataFrame) -> DataFrame:
    """Buffered changes that stay once versions have been applied."""
    return buffered.join(applied.select(*VERSION), VERSION, "left_anti")


def partial_versions(seqs: DataFrame) -> DataFrame:
    """Received seq ranges of each version merged, and whether they are complete: start, end, complete."""
    last = seqs.groupBy(*VERSION).agg(F.max("last_seq").alias("last_seq"))
    merged = ranges.coalesce(seqs.select(*VERSION, F.col("start_seq").alias("start"), F.col("end_seq").alias("end")), VERSION, blocked=False)
    whole = (F.col("start") == 0) & (F.col("end") >= F.col("last_seq"))
    return merged.join(last, VERSION).select(*VERSION, F.col("start").alias("start_seq"), F.col("end").alias("end_seq"), "last_seq", whole.alias("complete"))


def next_batch_cost(cost: int, step: int = 500, least: int = 100, most: int = 16_000) -> int:
    """How much queued cost the next apply batch takes: the step times the largest power of two that the queue fills, within
    bounds. A long queue is worked off in ever larger batches."""
    if cost <= step:
        return max(least, min(step, most))
    return max(least, min(step << (cost // step).bit_length() - 1, most))


def after_interrupt(batch: int, least: int = 100) -> int:
    """The batch size after one that was interrupted or ran out of memory: half, but not less than the least."""
    return max(least, batch // 2)


def next_batch(queue: list[tuple[int, str]], batch: int) -> tuple[list[str], list[tuple[int, str]]]:
    """The queued (cost, name) that fit a batch, the oldest first and one at least, and what is left."""
    taken, cost = 0, 0
    for size, _ in queue:
        if taken and cost + size > batch:
            break
        taken, cost = taken + 1, cost + size
    return [name for _, name in queue[:taken]], queue[taken:]
