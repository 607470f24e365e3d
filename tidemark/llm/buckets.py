"""Comparing rows that share a bucket, in blocks of a bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: Rows of one block; a bucket of more rows is dealt into blocks, and every two blocks meet in a task of their own.
BLOCK = 2048
#: Up to this size, the pairs of many buckets are made together.
SMALL = 48
#: Pairs that are compared at a time.
CHUNK = 1 << 16
#: Rows that are gathered before buckets are compared.
GATHER = 8192


def counted(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """(cold, hot): rows of buckets of 2 to `block` rows, and those of larger ones, each with n, the rows of the bucket.

    What is large is known before any row moves: hot rows learn it from a broadcast list of buckets (a bucket of more than
    `block` rows each, so few; beyond common.BROADCAST_IDS by a shuffle), and only cold ones are brought together by bucket.
    """
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    large = common.materialize(counts.where(F.col("n") > block), "hot-buckets")
    many = large.count()
    if not many:
        return rows.join(counts, "bucket"), None
    known = F.broadcast(large) if many <= common.BROADCAST_IDS else large
    cold = rows.join(known.select("bucket"), "bucket", "left_anti").join(counts.where(F.col("n") <= block), "bucket")
    return cold, rows.join(known, "bucket")


def blocks(rows: DataFrame, block: int = BLOCK, known: str | None = None) -> DataFrame:
    """From (bucket, id, ...) to the same with n, own, lo, hi: rows alone in their bucket go; a bucket of n rows over
    `block` is dealt into blocks by a hash of the id, and a row is repeated for each block that its own must meet.

    known: a column of groups within which nothing is left to find (null: a row by itself). Then the blocks of a bucket's
    largest group don't meet each other, only those of the other rows; a large bucket that is one group goes.
    """
    cold, hot = counted(rows, block)
    one = cold.withColumn("own", F.lit(0)).withColumn("lo", F.lit(0)).withColumn("hi", F.lit(0))
    return one if hot is None else one.unionByName(dealt(hot, block, known))


def dealt(hot: DataFrame, block: int = BLOCK, known: str | None = None) -> DataFrame:
    """The rows of large buckets (with n) in blocks, repeated for each block that their own must meet."""
    if known is None:
        parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
        placed = hot.withColumn("own", F.pmod(F.xxhash64("id", "bucket"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    else:
        group = F.coalesce(F.col(known), F.col("id"))
        sizes = hot.groupBy("bucket", group.alias("_group")).agg(F.count("*").alias("_size"))
        largest = sizes.groupBy("bucket").agg(F.max(F.struct("_size", "_group")).alias("_most"))
        # One row for each large bucket.
        with_most = hot.join(F.broadcast(largest) if largest.count() <= common.BROADCAST_IDS else largest, "bucket").where("_most._size < n")
        in_it = group == F.col("_most._group")
        rest = F.ceil((F.col("n") - F.col("_most._size")) / F.lit(block)).cast("int")
        whole = F.ceil(F.col("_most._size") / F.lit(block)).cast("int")
        mixed = F.xxhash64("id", "bucket")
        own = F.when(in_it, rest + F.pmod(mixed, whole)).otherwise(F.pmod(mixed, rest)).cast("int")
        met = F.sequence(F.lit(0), F.when(in_it, rest).otherwise(rest + whole) - 1)
        placed = with_most.withColumn("own", own).withColumn("other", F.explode(met)).drop("_most")
    return placed.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other")


def together(df: DataFrame) -> DataFrame:
    """Rows of a task's blocks side by side."""
    return df.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "own", "id")


def whole_groups(batches: Iterable[pa.RecordBatch], gather: int = GATHER) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of (bucket, lo, hi) from sorted batches, with where each group starts, and the end."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= gather:
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _starts(table)
            if len(starts) > 1:
                last = int(starts[-1])
                yield table.slice(0, last), starts
                table = table.slice(last)
            held = table.to_batches()
            size = table.num_rows if len(starts) > 1 else 0  # a group that goes on is looked at after as many rows again
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_starts(table), table.num_rows)


def _starts(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in ("bucket", "lo", "hi"):
        x = table.column(name).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def small_pairs(starts: np.ndarray, most: int = SMALL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within the groups of at most `most` rows, in chunks. Such groups are never dealt into blocks."""
    sizes = np.diff(starts)
    size = np.repeat(np.where(sizes <= most, sizes, 0), sizes)
    left = np.repeat(starts[1:], sizes) - np.arange(starts[0], starts[-1]) - 1  # rows after this one in its group
    at, n = [], 0
    rows = np.flatnonzero(size > 1)
    for d in range(1, most):
        rows = rows[left[rows] >= d]
        if not len(rows):
            break
        at.append((rows, rows + d))
        n += len(rows)
        if n >= CHUNK:
            yield np.concatenate([i for i, _ in at]), np.concatenate([j for _, j in at])
            at, n = [], 0
    if at:
        yield np.concatenate([i for i, _ in at]), np.concatenate([j for _, j in at])


def large_groups(starts: np.ndarray, most: int = SMALL) -> Iterator[tuple[int, int]]:
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a > most:
            yield int(a), int(b)


def tiles(a: int, b: int, own: np.ndarray, lo: int, hi: int, side: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Row ranges to compare within one large group: (rows, rows, whether they are one range). Two blocks meet crosswise."""
    rows = np.arange(a, b)
    if lo != hi:
        left, right = rows[own[a:b] == lo], rows[own[a:b] == hi]
        for i in range(0, len(left), side):
            for j in range(0, len(right), side):
                yield left[i : i + side], right[j : j + side], False
        return
    for i in range(0, len(rows), side):
        for j in range(i, len(rows), side):
            yield rows[i : i + side], rows[j : j + side], i == j


class Forest:
    """Union-find over the rows of a table."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True
