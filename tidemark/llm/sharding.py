"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, with u from a hash of the row's
key and the child's name; the smallest draw wins. A child is chosen in proportion to its weight, and when a weight
grows, rows move only into that child; draws of unchanged children stay as they were, so movement is confined to
subtrees whose weights change. Shards beyond the planned tree come as a region of their own: no other subtree's weight
changes, so a new shard takes rows only into itself.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common

ROW_OVERHEAD = 16
REGIONS, RACKS = 4, 2


@dataclass(frozen=True)
class Shard:
    region: str
    rack: str
    number: int
    weight: float = 1.0


def topology(shards: int, planned: int = 40) -> list[Shard]:
    """The first `planned` shards are spread evenly over regions and racks; each further one is a region of its own."""
    tree = [Shard(f"region{i % REGIONS}", f"rack{i // REGIONS % RACKS}", i) for i in range(min(shards, planned))]
    return tree + [Shard(f"added{i}", "rack0", i) for i in range(planned, shards)]


def _winner(key: Column, level: str, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the smallest draw; a child of weight 0 never wins against others."""
    draws = []
    for n, (name, weight, value) in enumerate(children):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}/{name}")), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(n).alias("n"), value.alias("value")))
    return F.least(*draws)["value"] if len(draws) > 1 else children[0][2]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard that a key descends to. A null key is a key like any other."""
    live = [s for s in tree if s.weight > 0]
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in live:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)

    def rack(name: str, shards: list[Shard]) -> Column:
        return _winner(key, name, [(str(s.number), s.weight, F.lit(s.number)) for s in shards])

    def region(name: str, racks: dict[str, list[Shard]]) -> Column:
        path = _winner(key, name, [(r, sum(s.weight for s in racks[r]), F.lit(r)) for r in racks])
        out = None
        for r, shards in racks.items():
            out = (F.when if out is None else out.when)(path == F.lit(r), rack(f"{name}/{r}", shards))
        return out if len(racks) > 1 else rack(f"{name}/{next(iter(racks))}", next(iter(racks.values())))

    path = _winner(key, "", [(n, sum(s.weight for x in racks.values() for s in x), F.lit(n)) for n, racks in regions.items()])
    if len(regions) == 1:
        return region(*next(iter(regions.items())))
    out = None
    for n, racks in regions.items():
        out = (F.when if out is None else out.when)(path == F.lit(n), region(n, racks))
    return out


def assign(docs: DataFrame, tree: list[Shard], grown: list[Shard] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard, slot and (with `grown`) grown_shard.

    size: UTF-8 bytes of the text plus 16, a null text as empty. slot: the row's place in its shard, gapless from 0, by
    salted ranks, so that no task holds a whole shard. Rows of equal doc_id go to one shard, in any order; so do rows
    with a null doc_id. An empty table gives no rows.
    """
    salts = common.partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.col(id_col).cast("long")
    placed = docs.select(
        key.alias("doc_id"), (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, tree).alias("shard"), shard_of(key, grown or tree).alias("grown_shard"), F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(salts)).cast("int").alias("salt"),
    )
    # As many rows as shards times salts; it reads only the ids.
    counts = docs.select(shard_of(key, tree).alias("shard"), F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(salts)).cast("int").alias("salt")).groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "text_crc32", "size")) - 1
    out = placed.withColumn("own", own).join(F.broadcast(before), ["shard", "salt"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("own") + F.col("before")).alias("slot"), "grown_shard")
