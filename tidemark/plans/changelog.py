"""Queries over the change log and over what versions are there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import changes as ops
from tidemark.operators import ranges, sync
from tidemark.plans import inputs as i
from tidemark.sources import tables

#: The value as a double, for results.
VAL = "CAST(val AS DOUBLE) AS val"


def changes_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.changes_scan(i.changes(spark, sf_dir), 1, 17).selectExpr("tbl", "pk", "cid", VAL, "col_version", "db_version", "seq", "site_id", "cl")


def sample_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = i.changes(spark, sf_dir)
    latest = tables.latest_versions(log, 20)
    return ops.chunk_changes(log.join(F.broadcast(latest.select("site_id", "db_version")), ["site_id", "db_version"]).withColumn("size", ops.change_size()), 200)


def capture_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = i.snapshots(spark, sf_dir)
    out = ops.capture(old, new, ["event_id"], ["event_type", "value"], 1, 1, "events")
    return out.select("pk", "cid", "val", F.col("cl").cast("long").alias("cl"), "seq")


def sentinel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.row_changes(spark, sf_dir).where(ops.is_sentinel(F.col("cid"))).select("tbl", "pk", "cl", "site_id", "db_version", "seq")


def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lww_merge(i.changes(spark, sf_dir).select("tbl", "pk", "cid", "val", "col_version", "site_id")).selectExpr("pk", "cid", VAL, "col_version", "site_id")


def causal_length_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.live_rows(i.row_changes(spark, sf_dir)).select("pk", "cl")


TYPES = ["click", "error", "login", "purchase", "view", "logout", "signup"]


def materialize_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = ops.live_cells(i.row_changes(spark, sf_dir).select("tbl", "pk", "cid", "val", "col_version", "site_id", "cl"))
    return ops.materialize_rows(cells, TYPES).select("pk", *[F.col(c).cast("double").alias(c) for c in TYPES])


def chunk_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.chunk_changes(i.received(spark, sf_dir).withColumn("size", ops.change_size()), 150)


def change_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.changes(spark, sf_dir).select("event_id", ops.change_size().alias("bytes"), ops.change_size(nested=True).alias("nested_bytes"))


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.received(spark, sf_dir).groupBy("site_id", "db_version").agg(F.min("seq").alias("start_seq"), F.max("seq").alias("end_seq"), F.max("last_seq").alias("last_seq"))


def changeset_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _sets(spark, sf_dir)
    return ops.dedupe_changesets(sets.unionAll(sets.where("db_version % 2 = 0")), sets.where("db_version % 3 = 0")).select("site_id", "db_version", "start_seq", "end_seq")


def route_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.route(_sets(spark, sf_dir)).select("site_id", "db_version", "route")


def buffer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = i.received(spark, sf_dir).select("site_id", "db_version", "seq", "event_id")
    return ops.buffer_changes(log.where("event_id % 3 = 0 OR event_id % 5 = 0"), log.where("event_id % 2 = 0").unionAll(log.where("event_id % 4 = 0"))).select("site_id", "db_version", "seq")


def apply_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = i.changes(spark, sf_dir)
    merged = log.where("db_version % 2 = 0").select("tbl", "pk", "cid", "val", "col_version", "site_id")
    return ops.apply_buffered(merged, i.received(spark, sf_dir).where("db_version % 2 = 1")).selectExpr("pk", "cid", VAL, "col_version", "site_id")


def impactful_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = i.changes(spark, sf_dir).select("tbl", "pk", "cid", "val", "col_version", "site_id", "event_id")
    before = ops.lww_merge(log.where("event_id % 4 <> 1").drop("event_id"))
    return ops.impactful(before, log.where("event_id % 4 = 1").drop("event_id")).selectExpr("pk", "cid", VAL, "col_version", "site_id")


def fully_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.fully_buffered(ops.partial_versions(i.seq_ranges(spark, sf_dir)))


def orphan_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.orphans(i.received(spark, sf_dir), i.seq_ranges(spark, sf_dir))


def buffered_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays buffered after a quarter of the versions has been applied."""
    return ops.without_applied(i.received(spark, sf_dir), _sets(spark, sf_dir).where("db_version % 4 = 1")).select("site_id", "db_version", "seq", "event_id")


def partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.partial_versions(i.seq_ranges(spark, sf_dir))


# Ranges of versions.


def gaps_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps after more versions have come: the complement of all that is applied, whatever the order."""
    more = i.theirs(spark, sf_dir).where("actor < 3 AND start % 2 = 0")
    return ranges.gaps(ranges.union(i.ours(spark, sf_dir), more, ["actor"]), ["actor"])


def version_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.gaps(i.ours(spark, sf_dir), ["actor"])


def collapse_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = i.ours(spark, sf_dir).selectExpr("actor", "start", "start + start % 3 AS end")
    return ranges.coalesce(wide, ["actor"])


def contains_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.contains_versions(i.versions(spark, sf_dir).select("actor", "version"), i.ours(spark, sf_dir))


def contains_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = i.versions(spark, sf_dir).selectExpr("actor", "version", "version % 4 AS start", "version % 4 + 2 AS end")
    return sync.contains_seqs(asked, i.our_partial(spark, sf_dir))


def known_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.known_actors(i.ours(spark, sf_dir), i.our_partial(spark, sf_dir), i.theirs(spark, sf_dir))


def gap_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.total(ranges.gaps(i.ours(spark, sf_dir), ["actor"]))


def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = i.ours(spark, sf_dir).selectExpr("actor", "start", "start + 4 AS end")
    b = i.theirs(spark, sf_dir).selectExpr("actor", "start", "start + start % 5 AS end")
    return ranges.overlaps(a, b, ["actor"], 16)


def chunk_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.chunks(ranges.coalesce(i.theirs(spark, sf_dir), ["actor"]), 4)


def consistency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two records of the same heads: missing on either side, or different."""
    a = i.ours(spark, sf_dir).groupBy("actor").agg(F.max("end").alias("a_head"))
    b = i.theirs(spark, sf_dir).where("actor <> 2").groupBy("actor").agg(F.max("end").alias("b_head"))
    both = a.join(b, "actor", "full").where(~F.col("a_head").eqNullSafe(F.col("b_head")))
    return both.select("actor", F.when(F.col("a_head").isNull(), "only in b").when(F.col("b_head").isNull(), "only in a").otherwise("differs").alias("finding"))


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return sync.sync_state(i.ours(spark, sf_dir), i.our_partial(spark, sf_dir)), sync.sync_state(i.theirs(spark, sf_dir), i.their_partial(spark, sf_dir))


def sync_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)[0]


def need_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.need_len(_states(spark, sf_dir)[0])


def available_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, peer = map(ops.settled, _states(spark, sf_dir))
    return sync.available_needs(mine, peer, F.lit(3))


def serve_need(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = i.versions(spark, sf_dir).selectExpr("actor", "version AS start", "version + 24 AS end")
    applied = i.ours(spark, sf_dir).where("start % 5 <> 1").selectExpr("actor", "start AS version")
    return sync.serve_need(asked, applied, i.our_partial(spark, sf_dir).select("actor", "version"), ranges.gaps(i.ours(spark, sf_dir), ["actor"]))


def one_peer_per_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every range is offered by two peers, now and then by one twice, and asked of one."""
    theirs = i.theirs(spark, sf_dir)
    offers = [theirs.selectExpr("actor", "start", "end", f"concat('peer', {n}) AS peer") for n in ("start % 3", "start % 5 + 1")]
    return sync.one_peer_per_range(offers[0].unionByName(offers[1]))


def rank_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS actor", "c_custkey % 50 AS need", "c_custkey % 13 AS last_sync", "c_nationkey % 6 AS ring")
    return sync.rank_peers(customers, 700)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        lww_merge, changes_scan, sample_changes, capture_changes, sentinel_filter, causal_length_live, materialize_rows, chunk_changes, change_size, changeset_dedupe, route_complete, buffer_changes,
        apply_buffered, impactful_changes, fully_buffered, orphan_buffered, partial_merge, gaps_insert, version_gaps, collapse_ranges, contains_version, contains_seqs, known_actors, gap_total,
        range_overlap, chunk_ranges, consistency_report, sync_state, need_len, available_needs, serve_need, rank_peers, buffered_cleanup, one_peer_per_range,
    )
}

_SIZE = "length(tbl) + length(CAST(pk AS VARCHAR)) + length(cid) + length(CAST(val AS VARCHAR)) + 48"
_WINNER = "row_number() OVER (PARTITION BY pk, cid ORDER BY col_version DESC, val DESC, site_id DESC) AS rn"


def _chunks(source: str, most: int) -> str:
    """The fold over a version's changes as a recursive query: (start, n, bytes) carried from change to change."""
    return f""", numbered AS (SELECT site_id, db_version, seq, last_seq, {_SIZE} AS size, row_number() OVER (PARTITION BY site_id, db_version ORDER BY seq) AS k, count(*) OVER (PARTITION BY site_id, db_version) AS m FROM {source}),
 fold AS (SELECT site_id, db_version, seq, last_seq, k, m, CAST(0 AS BIGINT) AS s, CAST(1 AS BIGINT) AS n, CAST(size AS BIGINT) AS b FROM numbered WHERE k = 1
  UNION ALL SELECT x.site_id, x.db_version, x.seq, x.last_seq, x.k, x.m, CASE WHEN f.b >= {most} THEN f.seq + 1 ELSE f.s END, CASE WHEN f.b >= {most} THEN 1 ELSE f.n + 1 END, CAST(CASE WHEN f.b >= {most} THEN x.size ELSE f.b + x.size END AS BIGINT)
  FROM fold f JOIN numbered x ON x.site_id = f.site_id AND x.db_version = f.db_version AND x.k = f.k + 1)
 SELECT site_id, db_version, s AS start_seq, CASE WHEN seq >= last_seq OR (k = m AND b < {most}) THEN last_seq ELSE seq END AS end_seq, n, b AS bytes FROM fold WHERE b >= {most} OR k = m
 UNION ALL SELECT site_id, db_version, seq + 1, last_seq, 0, 0 FROM fold WHERE k = m AND b >= {most} AND seq < last_seq"""


_SETS = "sets AS (SELECT site_id, db_version, min(seq) AS start_seq, max(seq) AS end_seq, max(last_seq) AS last_seq FROM received GROUP BY site_id, db_version)"
_ISLANDS = """SELECT {keys}, min(s) AS "start", max(e) AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY s, e) AS island FROM (SELECT *, CASE WHEN max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s - 1 THEN 0 ELSE 1 END AS new
 FROM (SELECT {keys}, "start" AS s, "end" AS e FROM {source}) q) r) t GROUP BY {keys}, island"""
_GAPS = """SELECT actor, "start", "end" FROM (SELECT actor, coalesce(lag("end") OVER (PARTITION BY actor ORDER BY "start") + 1, 1) AS "start", "start" - 1 AS "end" FROM ({islands}) q) r WHERE "start" <= "end\""""


def _islands(source: str, keys: str = "actor") -> str:
    return _ISLANDS.format(keys=keys, source=source)


def _gaps(source: str) -> str:
    return _GAPS.format(islands=_islands(source))


#: Seqs 0 to 9 that a partial version lacks, one by one, then as ranges.
def _seq_gaps(partial: str, name: str) -> str:
    return f"""{name}_one AS (SELECT v.actor, v.version, n AS "start", n AS "end" FROM (SELECT DISTINCT actor, version FROM {partial}) v, range(10) t(n) WHERE NOT EXISTS (SELECT 1 FROM {partial} p WHERE p.actor = v.actor AND p.version = v.version AND n BETWEEN p."start" AND p."end")),
 {name} AS ({_islands(f"{name}_one", "actor, version")})"""


_STATE = f"""WITH {i.VERSIONS}, {i.OURS}, {i.OUR_PARTIAL}, {_seq_gaps("our_partial", "lacking")},
 state AS (SELECT actor, 'head' AS kind, max("end") AS v_start, max("end") AS v_end, CAST(NULL AS BIGINT) AS s_start, CAST(NULL AS BIGINT) AS s_end FROM ours GROUP BY actor
 UNION ALL SELECT actor, 'need', "start", "end", NULL, NULL FROM ({_gaps("ours")}) g
 UNION ALL SELECT actor, 'partial_need', version, version, "start", "end" FROM lacking)"""

#: Version by version: what the peer has, and which of it we lack.
_NEEDS = f"""{_STATE}, {i.THEIRS}, {i.THEIR_PARTIAL}, {_seq_gaps("their_partial", "peer_lacking")},
 peer AS (SELECT actor, max("end") AS head FROM theirs WHERE actor <> 3 GROUP BY actor),
 haves AS (SELECT t.actor, t."start" AS v FROM theirs t JOIN peer USING (actor)),
 gap_one AS (SELECT g.actor, v AS "start", v AS "end" FROM state g JOIN haves h ON h.actor = g.actor AND h.v BETWEEN g.v_start AND g.v_end WHERE g.kind = 'need'),
 whole AS (SELECT s.actor, s.v_start AS version, s.s_start AS "start", s.s_end AS "end" FROM state s JOIN haves h ON h.actor = s.actor AND h.v = s.v_start WHERE s.kind = 'partial_need'),
 part_one AS (SELECT l.actor, l.version, n AS "start", n AS "end" FROM lacking l JOIN peer USING (actor), range(10) t(n) WHERE n BETWEEN l."start" AND l."end" AND EXISTS (SELECT 1 FROM peer_lacking p WHERE p.actor = l.actor AND p.version = l.version)
  AND NOT EXISTS (SELECT 1 FROM peer_lacking p WHERE p.actor = l.actor AND p.version = l.version AND n BETWEEN p."start" AND p."end"))
 SELECT actor, 'full' AS kind, "start" AS v_start, "end" AS v_end, CAST(NULL AS BIGINT) AS s_start, CAST(NULL AS BIGINT) AS s_end FROM ({_islands("gap_one")}) a
 UNION ALL SELECT actor, 'partial', version, version, "start", "end" FROM whole
 UNION ALL SELECT actor, 'partial', version, version, "start", "end" FROM ({_islands("part_one", "actor, version")}) b
 UNION ALL SELECT p.actor, 'full', coalesce(s.v_end, 0) + 1, p.head, NULL, NULL FROM peer p LEFT JOIN state s ON s.actor = p.actor AND s.kind = 'head' WHERE p.head > coalesce(s.v_end, 0)"""

ORACLES: dict[str, str] = {
    "lww_merge": f"WITH {i.CHANGES} SELECT pk, cid, CAST(val AS DOUBLE) AS val, col_version, site_id FROM (SELECT *, {_WINNER} FROM changes) t WHERE rn = 1",
    "changes_scan": f"WITH {i.CHANGES} SELECT tbl, pk, cid, CAST(val AS DOUBLE) AS val, col_version, db_version, seq, site_id, cl FROM changes WHERE site_id = 1 AND db_version = 17 ORDER BY seq",
    "sample_changes": f"WITH RECURSIVE {i.CHANGES}, latest AS (SELECT site_id, db_version FROM changes GROUP BY site_id, db_version ORDER BY max(ts) DESC, site_id DESC, db_version DESC LIMIT 20), picked AS (SELECT c.* FROM changes c JOIN latest USING (site_id, db_version)){_chunks('picked', 200)}",
    "capture_changes": f"""WITH {i.SNAPSHOTS}, cells AS (
 SELECT n.event_id AS pk, 'event_type' AS cid, n.event_type AS val, 1 AS cl FROM new_rows n LEFT JOIN old_rows o USING (event_id) WHERE o.event_id IS NULL OR o.event_type IS DISTINCT FROM n.event_type
 UNION ALL SELECT n.event_id, 'value', CAST(n.value AS VARCHAR), 1 FROM new_rows n LEFT JOIN old_rows o USING (event_id) WHERE o.event_id IS NULL OR o.value IS DISTINCT FROM n.value
 UNION ALL SELECT o.event_id, '-1', NULL, 2 FROM old_rows o WHERE NOT EXISTS (SELECT 1 FROM new_rows n WHERE n.event_id = o.event_id))
 SELECT pk, cid, val, CAST(cl AS BIGINT) AS cl, row_number() OVER (ORDER BY pk, cid) - 1 AS seq FROM cells""",
    "sentinel_filter": f"WITH {i.ROW_CHANGES} SELECT tbl, pk, cl, site_id, db_version, seq FROM row_changes WHERE cid = '-1'",
    "causal_length_live": f"WITH {i.ROW_CHANGES} SELECT pk, max(cl) AS cl FROM row_changes GROUP BY pk HAVING max(cl) % 2 = 1",
    "materialize_rows": f"""WITH {i.ROW_CHANGES}, live AS (SELECT pk, max(cl) AS cl FROM row_changes GROUP BY pk HAVING max(cl) % 2 = 1),
 won AS (SELECT pk, cid, val FROM (SELECT c.*, {_WINNER.replace('PARTITION BY pk', 'PARTITION BY c.pk')} FROM row_changes c JOIN live l ON l.pk = c.pk AND l.cl = c.cl WHERE cid <> '-1') t WHERE rn = 1)
 SELECT pk, {', '.join(f"CAST(max(CASE WHEN cid = '{c}' THEN val END) AS DOUBLE) AS {c}" for c in TYPES)} FROM won GROUP BY pk""",
    "chunk_changes": f"WITH RECURSIVE {i.CHANGES}, {i.RECEIVED}{_chunks('received', 150)}",
    "change_size": f"WITH {i.CHANGES} SELECT event_id, {_SIZE} AS bytes, length(cid) + length(CAST(val AS VARCHAR)) + 32 AS nested_bytes FROM changes",
    "changeset_dedupe": f"WITH {i.CHANGES}, {i.RECEIVED}, {_SETS} SELECT site_id, db_version, start_seq, end_seq FROM sets WHERE db_version % 3 <> 0",
    "route_complete": f"WITH {i.CHANGES}, {i.RECEIVED}, {_SETS} SELECT site_id, db_version, CASE WHEN start_seq = 0 AND end_seq = last_seq THEN 'merge' ELSE 'buffer' END AS route FROM sets",
    "buffer_changes": f"WITH {i.CHANGES}, {i.RECEIVED} SELECT site_id, db_version, seq FROM received WHERE event_id % 3 = 0 OR event_id % 5 = 0 OR event_id % 2 = 0",
    "apply_buffered": f"""WITH {i.CHANGES}, {i.RECEIVED}, ready AS (SELECT site_id, db_version FROM received WHERE db_version % 2 = 1 GROUP BY site_id, db_version HAVING count(DISTINCT seq) = 4),
 log AS (SELECT * FROM changes WHERE db_version % 2 = 0 UNION ALL SELECT r.* FROM received r JOIN ready USING (site_id, db_version))
 SELECT pk, cid, CAST(val AS DOUBLE) AS val, col_version, site_id FROM (SELECT *, {_WINNER} FROM log) t WHERE rn = 1""",
    "impactful_changes": f"""WITH {i.CHANGES}, after AS (SELECT * FROM (SELECT *, {_WINNER} FROM changes) t WHERE rn = 1), before AS (SELECT * FROM (SELECT *, {_WINNER} FROM changes WHERE event_id % 4 <> 1) t WHERE rn = 1)
 SELECT a.pk, a.cid, CAST(a.val AS DOUBLE) AS val, a.col_version, a.site_id FROM after a LEFT JOIN before b ON a.pk = b.pk AND a.cid = b.cid WHERE b.pk IS NULL OR (a.val, a.col_version, a.site_id) <> (b.val, b.col_version, b.site_id)""",
    "fully_buffered": f"WITH {i.CHANGES}, {i.RECEIVED}, {i.SEQ_RANGES} SELECT site_id, db_version FROM seq_ranges GROUP BY site_id, db_version HAVING count(DISTINCT start_seq) = 4",
    "orphan_buffered": f"WITH {i.CHANGES}, {i.RECEIVED} SELECT DISTINCT site_id, db_version FROM received WHERE db_version % 9 = 0",
    "partial_merge": f"""WITH {i.CHANGES}, {i.RECEIVED}, {i.SEQ_RANGES}, plain AS (SELECT site_id, db_version, start_seq AS "start", end_seq AS "end" FROM seq_ranges)
 SELECT site_id, db_version, "start" AS start_seq, "end" AS end_seq, CAST(3 AS BIGINT) AS last_seq, "start" = 0 AND "end" = 3 AS complete FROM ({_islands("plain", "site_id, db_version")}) t""",
    "gaps_insert": f"""WITH {i.VERSIONS}, {i.OURS}, {i.THEIRS}, both_sides AS (SELECT * FROM ours UNION ALL SELECT * FROM theirs WHERE actor < 3 AND "start" % 2 = 0) {_gaps("both_sides")}""",
    "version_gaps": f"WITH {i.VERSIONS}, {i.OURS} {_gaps('ours')}",
    "collapse_ranges": f"""WITH {i.VERSIONS}, {i.OURS}, wide AS (SELECT actor, "start", "start" + "start" % 3 AS "end" FROM ours) {_islands("wide")}""",
    "contains_seqs": f"""WITH {i.VERSIONS}, {i.OUR_PARTIAL}, asked AS (SELECT actor, version, version % 4 AS "start", version % 4 + 2 AS "end" FROM versions), held AS ({_islands("our_partial", "actor, version")})
 SELECT actor, version, "start", "end", EXISTS (SELECT 1 FROM held h WHERE h.actor = a.actor AND h.version = a.version AND h."start" <= a."start" AND h."end" >= a."end") AS contains FROM asked a""",
    "known_actors": f"WITH {i.VERSIONS} SELECT DISTINCT actor FROM versions",
    "gap_total": f"""WITH {i.VERSIONS}, {i.OURS} SELECT CAST(coalesce(sum("end" - "start" + 1), 0) AS BIGINT) AS total FROM ({_gaps("ours")}) g""",
    "chunk_ranges": f"""WITH {i.VERSIONS}, {i.THEIRS}, islands AS ({_islands("theirs")}) SELECT actor, s AS "start", least(s + 4, e) AS "end" FROM (SELECT actor, unnest(range("start", greatest("start", "end" - 1) + 1, 4)) AS s, "end" AS e FROM islands) t""",
    "consistency_report": f"""WITH {i.VERSIONS}, {i.OURS}, {i.THEIRS}, a AS (SELECT actor, max("end") AS h FROM ours GROUP BY actor), b AS (SELECT actor, max("end") AS h FROM theirs WHERE actor <> 2 GROUP BY actor)
 SELECT coalesce(a.actor, b.actor) AS actor, CASE WHEN a.h IS NULL THEN 'only in b' WHEN b.h IS NULL THEN 'only in a' ELSE 'differs' END AS finding FROM a FULL JOIN b ON a.actor = b.actor WHERE a.h IS DISTINCT FROM b.h""",
    "sync_state": f"{_STATE} SELECT * FROM state",
    "need_len": f"{_STATE} SELECT actor, CAST(sum(CASE WHEN kind = 'need' THEN v_end - v_start + 1 ELSE 0 END) + sum(CASE WHEN kind = 'partial_need' THEN s_end - s_start + 1 ELSE 0 END) // 50 AS BIGINT) AS need FROM state GROUP BY actor",
    "available_needs": _NEEDS,
    "contains_version": f"""WITH {i.VERSIONS}, {i.OURS} SELECT v.actor, v.version, EXISTS (SELECT 1 FROM ours o WHERE o.actor = v.actor AND o."start" = v.version) AS contains FROM versions v""",
    "range_overlap": f"""WITH {i.VERSIONS}, {i.OURS}, {i.THEIRS}, a AS (SELECT actor, "start" AS s, "start" + 4 AS e, unnest(range("start", "start" + 5)) AS n FROM ours), b AS (SELECT actor, "start" AS s, "start" + "start" % 5 AS e, unnest(range("start", "start" + "start" % 5 + 1)) AS n FROM theirs)
 SELECT a.actor, a.s AS a_start, a.e AS a_end, b.s AS b_start, b.e AS b_end, a.n AS "start", least(a.e, b.e) AS "end" FROM a JOIN b ON a.actor = b.actor AND a.n = b.n WHERE a.n = greatest(a.s, b.s)""",
    "serve_need": f"""WITH {i.VERSIONS}, {i.OURS}, {i.OUR_PARTIAL}, one AS (SELECT DISTINCT actor, unnest(range(version, version + 25)) AS v FROM versions),
 full_ AS (SELECT o.actor, 'changes' AS kind, v, count(*) AS n FROM ours o JOIN one ON one.actor = o.actor AND one.v = o."start" WHERE o."start" % 5 <> 1 GROUP BY o.actor, v),
 held AS (SELECT p.actor, 'buffered' AS kind, v, count(*) AS n FROM our_partial p JOIN one ON one.actor = p.actor AND one.v = p.version WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.actor = p.actor AND f.v = p.version) GROUP BY p.actor, v),
 missing AS (SELECT actor, unnest(range("start", "end" + 1)) AS v FROM ({_gaps("ours")}) g),
 none AS (SELECT actor, v AS "start", v AS "end" FROM (SELECT actor, v FROM one EXCEPT SELECT actor, v FROM full_ EXCEPT SELECT actor, v FROM held EXCEPT SELECT actor, v FROM missing) q)
 SELECT actor, kind, v AS v_start, v AS v_end, n FROM full_ UNION ALL SELECT actor, kind, v, v, n FROM held UNION ALL SELECT actor, 'empty', "start", "end", 0 FROM ({_islands("none")}) e""",
    "buffered_cleanup": f"WITH {i.CHANGES}, {i.RECEIVED} SELECT site_id, db_version, seq, event_id FROM received WHERE db_version % 4 <> 1",
    "one_peer_per_range": f"""WITH {i.VERSIONS}, {i.THEIRS} SELECT DISTINCT actor, "start", "end", 'peer' || least("start" % 3, "start" % 5 + 1) AS peer FROM theirs""",
    "rank_peers": "SELECT c_custkey AS actor, c_custkey % 50 AS need, c_custkey % 13 AS last_sync, c_nationkey % 6 AS ring FROM customer ORDER BY need DESC, last_sync, ring, actor LIMIT 7",
}
