"""Inclusive integer ranges as rows: coalescing, gaps, set algebra.

Ranges have columns start and end beside their key columns. All of this is a sweep over the ranges' ends, with windows
by key and block of numbers: neither an inequality join nor a task that holds all of a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a block are 2 to the power of this. A block has no more ends than numbers, so this bounds a window; a key of
#: n numbers has n / 65536 blocks, whose sums meet in one task.
BLOCK_BITS = 16


def coalesce(ranges: DataFrame, keys: list[str], blocked: bool = True) -> DataFrame:
    """Overlapping and adjacent ranges merge. Ranges that end before they start are nothing.

    Here as in subtract, keys that hold few numbers each, such as the seqs of a version, needn't be split in blocks.
    """
    return _runs(_ends(ranges, keys, a=True), keys, lambda in_a, in_b: in_a, blocked)


def gaps(ranges: DataFrame, keys: list[str], lower: int = 1) -> DataFrame:
    """What is missing from `lower` up to each key's largest end."""
    reaching = ranges.where(F.col("end") >= lower).withColumn("start", F.lit(lower))  # all of them begin at one point
    return _runs(_ends(reaching, keys, a=True).unionByName(_ends(ranges, keys, a=False)), keys, lambda in_a, in_b: in_a & ~in_b)


def intersect(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return _runs(_ends(a, keys, a=True).unionByName(_ends(b, keys, a=False)), keys, lambda in_a, in_b: in_a & in_b)


def subtract(a: DataFrame, b: DataFrame, keys: list[str], blocked: bool = True) -> DataFrame:
    return _runs(_ends(a, keys, a=True).unionByName(_ends(b, keys, a=False)), keys, lambda in_a, in_b: in_a & ~in_b, blocked)


def union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return coalesce(a.select(*keys, "start", "end").unionByName(b.select(*keys, "start", "end")), keys)


def _ends(ranges: DataFrame, keys: list[str], a: bool) -> DataFrame:
    """Where ranges of side a, or else of side b, begin and are over: (keys, at, da, db) with what the depths change by."""
    begin, over = F.col("start").cast("long"), F.col("end").cast("long") + 1
    points = F.array(*[F.struct(at.alias("at"), F.lit(d if a else 0).alias("da"), F.lit(0 if a else d).alias("db")) for at, d in ((begin, 1), (over, -1))])
    return ranges.where("start <= end").select(*keys, F.inline(points))


def _runs(points: DataFrame, keys: list[str], keep: Callable[[Column, Column], Column], blocked: bool = True) -> DataFrame:
    """The longest stretches in which `keep` holds of being inside a range of side a and of side b.

    Runs are told by the points where `keep` turns true or false, in pairs. A pair is found within its block; the few
    points that lack their partner there, two of a block at most, find it in a window by key.
    """
    depths = points.groupBy(*keys, "at").agg(F.sum("da").alias("da"), F.sum("db").alias("db")).where("da <> 0 or db <> 0")
    run = _running(depths.withColumn("_kind", F.lit(0)), keys, ["da", "db"], blocked)
    on = keep(F.col("_da") > 0, F.col("_db") > 0)
    was = keep(F.col("_da") > F.col("da"), F.col("_db") > F.col("db"))
    turns = run.where(on != was).select(*keys, "_block", "at", on.alias("_on"))
    order = Window.partitionBy(*keys, *(["_block"] if blocked else [])).orderBy("at")
    found = turns.withColumns({"_next": F.lead("at").over(order), "_last": F.lag("at").over(order)})
    if blocked:
        loose = F.col("_next").isNull() | (~F.col("_on") & F.col("_last").isNull())
        rows = found.where("_on or _last is null").withColumn("_own", F.when(~loose, F.col("at")))  # a pair is a window of its own
        across = Window.partitionBy(*keys, "_own").orderBy("at")
        found = rows.withColumn("_next", F.coalesce(F.when(F.col("_on"), F.col("_next")), F.lead("at").over(across)))
    return found.where("_on").select(*keys, F.col("at").alias("start"), (F.col("_next") - 1).alias("end"))


def _running(rows: DataFrame, keys: list[str], sums: list[str], blocked: bool = True) -> DataFrame:
    """Rows (keys, at, _kind) with _block and, as _name, the running sum of each column in the order of at and _kind.

    A window holds one block of a key's numbers, so a key of any size is shared by many tasks. What the blocks before
    come to enters as a row ahead of the block's own; only those sums, one for each block, meet by key.
    """
    placed = rows.withColumn("_block", F.shiftright("at", BLOCK_BITS))
    if not blocked:
        order = Window.partitionBy(*keys).orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        return placed.select("*", *[F.sum(c).over(order).alias(f"_{c}") for c in sums])
    blocks = placed.groupBy(*keys, "_block").agg(*[F.sum(c).alias(c) for c in sums])
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "_block", F.lit(-1).alias("_kind"), *[F.sum(c).over(earlier).alias(c) for c in sums])
    order = Window.partitionBy(*keys, "_block").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = placed.unionByName(carried, allowMissingColumns=True)
    return both.select("*", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"_{c}") for c in sums]).where("_kind >= 0")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """Pairs of ranges of one key that overlap, with the part they share: a_start, a_end, b_start, b_end, start, end.

    Ranges meet by blocks of numbers of the given width, an equality that shuffles evenly; a pair counts in the block
    where its shared part begins.
    """

    def blocked(df: DataFrame, side: str) -> DataFrame:
        named = df.where("start <= end").select(*keys, F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))
        return named.withColumn("_block", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / width), F.floor(F.col(f"{side}_end") / width))))

    shared = blocked(a, "a").join(blocked(b, "b"), [*keys, "_block"]).withColumn("start", F.greatest("a_start", "b_start")).withColumn("end", F.least("a_end", "b_end"))
    return shared.where((F.col("start") <= F.col("end")) & (F.floor(F.col("start") / width) == F.col("_block"))).drop("_block")


def containing(points: DataFrame, ranges: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Points with `inside`: whether a range of their key holds them. A point that is null is in none.

    One window over points and the ranges' ends, by blocks of numbers; ends count before the points at their number.
    """
    ends = _ends(ranges, keys, a=True).groupBy(*keys, "at").agg(F.sum("da").alias("da")).where("da <> 0").withColumn("_kind", F.lit(0))
    asked = points.select(*keys, F.struct(*points.columns).alias("_row"), F.col(at).cast("long").alias("at"), F.lit(0).alias("da"), F.lit(1).alias("_kind"))
    run = _running(ends.unionByName(asked, allowMissingColumns=True), keys, ["da"]).where("_kind = 1")
    return run.select("_row.*", (F.col("at").isNotNull() & (F.col("_da") > 0)).alias("inside"))


def chunks(ranges: DataFrame, step: int) -> DataFrame:
    """Ranges cut in steps; each chunk begins where the one before ends, so neighbours share a number."""
    begin = F.sequence(F.col("start"), F.greatest(F.col("start"), F.col("end") - 1), F.lit(step))
    others = [c for c in ranges.columns if c not in ("start", "end")]
    cut = ranges.where("start <= end").select(*others, F.col("end").alias("_last"), F.explode(begin).alias("start"))
    return cut.select(*others, "start", F.least(F.col("start") + step, F.col("_last")).alias("end"))


def total(ranges: DataFrame) -> DataFrame:
    """How many numbers the ranges hold; 0 for none."""
    return ranges.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long").alias("total"))
