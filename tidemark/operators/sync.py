"""Anti-entropy: what each actor has, what is missing, and who can give it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import ranges

#: Missing seqs that count as one missing version.
SEQS_PER_VERSION = 50


def heads(applied: DataFrame) -> DataFrame:
    return applied.groupBy("actor").agg(F.max("end").alias("head"))


def known_actors(*tables: DataFrame) -> DataFrame:
    """Actors that any of the tables (column actor) knows."""
    out = tables[0].select("actor")
    for t in tables[1:]:
        out = out.union(t.select("actor"))
    return out.distinct()


def contains_versions(asked: DataFrame, applied: DataFrame) -> DataFrame:
    """asked (actor, version) with `contains`: no gap there, and not beyond the head."""
    return ranges.containing(asked, applied, ["actor"], "version").withColumnRenamed("inside", "contains")


def contains_seqs(asked: DataFrame, partial: DataFrame) -> DataFrame:
    """asked (actor, version, start, end) with `contains`: every seq inside the received ranges of the version."""
    held = ranges.coalesce(partial, ["actor", "version"], blocked=False).select("actor", "version", F.col("start").alias("_s"), F.col("end").alias("_e"))
    joined = asked.join(held, ["actor", "version"], "left")
    fits = F.coalesce((F.col("_s") <= F.col("start")) & (F.col("_e") >= F.col("end")), F.lit(False))
    return joined.groupBy("actor", "version", "start", "end").agg(F.max(fits).alias("contains"))


def sync_state(applied: DataFrame, partial: DataFrame) -> DataFrame:
    """One table of an actor's state: kind head, need or partial_need, with version and seq ranges.

    partial: (actor, version, start, end, last_seq) received so far; complete versions aren't needed any more.
    """
    null = F.lit(None).cast("long")
    head = heads(applied).select("actor", F.lit("head").alias("kind"), F.col("head").alias("v_start"), F.col("head").alias("v_end"), null.alias("s_start"), null.alias("s_end"))
    need = ranges.gaps(applied, ["actor"]).select("actor", F.lit("need").alias("kind"), F.col("start").alias("v_start"), F.col("end").alias("v_end"), null.alias("s_start"), null.alias("s_end"))
    missing = seq_gaps(partial).select("actor", F.lit("partial_need").alias("kind"), F.col("version").alias("v_start"), F.col("version").alias("v_end"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    return head.unionByName(need).unionByName(missing)


def seq_gaps(partial: DataFrame) -> DataFrame:
    """Seqs that each version lacks of 0 to last_seq."""
    key = ["actor", "version"]
    whole = partial.groupBy(*key).agg(F.max("last_seq").alias("end")).withColumn("start", F.lit(0).cast("long"))
    return ranges.subtract(whole, partial, key, blocked=False)


def need_len(state: DataFrame) -> DataFrame:
    """Missing versions, and missing seqs by fifties, of each actor's state."""
    versions = F.when(F.col("kind") == "need", F.col("v_end") - F.col("v_start") + 1).otherwise(0)
    seqs = F.when(F.col("kind") == "partial_need", F.col("s_end") - F.col("s_start") + 1).otherwise(0)
    out = state.groupBy("actor").agg(F.sum(versions).alias("v"), F.sum(seqs).alias("s"))
    return out.select("actor", (F.col("v") + F.floor(F.col("s") / SEQS_PER_VERSION)).cast("long").alias("need"))


def available_needs(ours: DataFrame, theirs: DataFrame, self_actor: Column | None = None) -> DataFrame:
    """What a peer can give us: (actor, kind, v_start, v_end, s_start, s_end) with kind full or partial.

    Both are states as of sync_state. A peer has 1 to its head, but for what it needs and its partial versions. Of that
    we take our gaps, our partial versions (whole, as all our missing seqs, or the seqs that the peer has of its own
    partial version), and what lies beyond our head.
    """
    their_heads = theirs.where("kind = 'head' and v_end > 0")
    if self_actor is not None:
        their_heads = their_heads.where(F.col("actor") != self_actor)
    head = their_heads.select("actor", F.lit(1).cast("long").alias("start"), F.col("v_end").alias("end"))
    lacks = theirs.where("kind in ('need', 'partial_need')").select("actor", F.col("v_start").alias("start"), F.col("v_end").alias("end"))
    haves = ranges.subtract(head, lacks, ["actor"])
    null = F.lit(None).cast("long")

    def full(df: DataFrame) -> DataFrame:
        return df.select("actor", F.lit("full").alias("kind"), F.col("start").alias("v_start"), F.col("end").alias("v_end"), null.alias("s_start"), null.alias("s_end"))

    gaps = ours.where("kind = 'need'").select("actor", F.col("v_start").alias("start"), F.col("v_end").alias("end"))
    from_gaps = full(ranges.intersect(gaps, haves, ["actor"]))

    our_partial = ours.where("kind = 'partial_need'").select("actor", F.col("v_start").alias("version"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    versions = our_partial.select("actor", "version").distinct()
    whole = ranges.containing(versions, haves, ["actor"], "version").where("inside").drop("inside")
    asked_whole = our_partial.join(whole, ["actor", "version"], "left_semi")
    their_partial = theirs.where("kind = 'partial_need'").select("actor", F.col("v_start").alias("version"), F.col("s_start").alias("start"), F.col("s_end").alias("end"))
    both_partial = our_partial.join(their_heads.select("actor"), "actor", "left_semi").join(their_partial.select("actor", "version").distinct(), ["actor", "version"], "left_semi")
    asked_part = ranges.subtract(both_partial, their_partial, ["actor", "version"], blocked=False)
    partial = asked_whole.select("actor", "version", "start", "end").unionByName(asked_part.select("actor", "version", "start", "end"))
    from_partial = partial.select("actor", F.lit("partial").alias("kind"), F.col("version").alias("v_start"), F.col("version").alias("v_end"), F.col("start").alias("s_start"), F.col("end").alias("s_end"))

    our_heads = ours.where("kind = 'head'").select("actor", F.col("v_end").alias("_ours"))
    beyond = head.join(our_heads, "actor", "left").withColumn("start", F.coalesce(F.col("_ours"), F.lit(0)) + 1).where("start <= end")
    return from_gaps.unionByName(from_partial).unionByName(full(beyond))


def serve_need(asked: DataFrame, changes: DataFrame, buffered: DataFrame, gaps: DataFrame) -> DataFrame:
    """The answer to asked ranges (actor, start, end): changes and buffered rows by version, and the ranges of empty versions.

    (actor, kind, v_start, v_end, n): a row per version with changes or buffered rows, a row per range of versions that
    are neither there, nor buffered, nor missing.
    """
    wanted = asked.select("actor", "start", "end")  # overlapping or not: the sweeps count how many ranges hold a number

    def of(df: DataFrame, kind: str) -> DataFrame:
        counted = df.groupBy("actor", "version").agg(F.count("*").alias("n"))
        return ranges.containing(counted, wanted, ["actor"], "version").where("inside").select("actor", F.lit(kind).alias("kind"), F.col("version").alias("v_start"), F.col("version").alias("v_end"), "n")

    full = of(changes, "changes")
    held = of(buffered, "buffered").join(full.select("actor", "v_start"), ["actor", "v_start"], "left_anti").select("actor", "kind", "v_start", "v_end", "n")
    there = full.unionByName(held)
    taken = there.select("actor", F.col("v_start").alias("start"), F.col("v_end").alias("end")).unionByName(gaps.select("actor", "start", "end"))
    empty = ranges.subtract(wanted, taken, ["actor"]).select("actor", F.lit("empty").alias("kind"), F.col("start").alias("v_start"), F.col("end").alias("v_end"), F.lit(0).cast("long").alias("n"))
    return there.unionByName(empty)


def rank_peers(peers: DataFrame, n_peers: int) -> DataFrame:
    """The peers to sync with: most needed first, then longest since the last sync, then nearest ring.

    peers: (actor, need, last_sync, ring). A random sample of candidates is left out, so the answer is the same each time.
    """
    k = max(3, min(10, n_peers // 100))
    return peers.orderBy(F.desc("need"), "last_sync", "ring", "actor").limit(k)


def one_peer_per_range(offers: DataFrame) -> DataFrame:
    """Of offers (actor, start, end, peer) each range once, from the peer with the smallest name."""
    return offers.groupBy("actor", "start", "end").agg(F.min("peer").alias("peer"))
