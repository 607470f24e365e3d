"""Change logs, version logs and snapshots derived from the driver's tables, for Spark and as SQL for the oracle.

events: a change per event; twelve consecutive events make a db_version, dealt to three sites, so seq runs from 0 to 3.
orders: an order is a version of actor o_orderkey % 5; some are left out to make gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_COLUMNS = ["tbl", "pk", "cid", "val", "col_version", "db_version", "seq", "site_id", "cl", "ts"]


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a change of the cell (user_id, event_type)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "'event_state' AS tbl", "user_id AS pk", "event_type AS cid", "CAST(value AS DECIMAL(12,2)) AS val", "1 + event_id % 5 AS col_version", "event_id div 12 + 1 AS db_version",
        "(event_id % 12) div 3 AS seq", "event_id % 3 AS site_id", "CAST(1 AS BIGINT) AS cl", "ts", "event_id", "CAST(3 AS BIGINT) AS last_seq",
    )


CHANGES = """changes AS (SELECT 'event_state' AS tbl, user_id AS pk, event_type AS cid, CAST(value AS DECIMAL(12,2)) AS val, 1 + event_id % 5 AS col_version, event_id // 12 + 1 AS db_version,
 (event_id % 12) // 3 AS seq, event_id % 3 AS site_id, CAST(1 AS BIGINT) AS cl, ts, event_id, CAST(3 AS BIGINT) AS last_seq FROM events)"""


def row_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of many small rows, a part of which are deleted and come back: causal lengths 1, 2 and 3."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "'row_state' AS tbl", "user_id * 100 + event_id % 37 AS pk", "CASE WHEN event_id % 11 = 0 THEN '-1' ELSE event_type END AS cid", "CASE WHEN event_id % 11 <> 0 THEN CAST(value AS DECIMAL(12,2)) END AS val",
        "1 + event_id % 5 AS col_version", "event_id div 12 + 1 AS db_version", "(event_id % 12) div 3 AS seq", "event_id % 3 AS site_id",
        "CAST(CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 3 ELSE 1 END AS BIGINT) AS cl", "ts", "event_id", "CAST(3 AS BIGINT) AS last_seq",
    )


ROW_CHANGES = """row_changes AS (SELECT 'row_state' AS tbl, user_id * 100 + event_id % 37 AS pk, CASE WHEN event_id % 11 = 0 THEN '-1' ELSE event_type END AS cid,
 CASE WHEN event_id % 11 <> 0 THEN CAST(value AS DECIMAL(12,2)) END AS val, 1 + event_id % 5 AS col_version, event_id // 12 + 1 AS db_version, (event_id % 12) // 3 AS seq, event_id % 3 AS site_id,
 CAST(CASE WHEN event_id % 11 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 3 ELSE 1 END AS BIGINT) AS cl, ts, event_id, CAST(3 AS BIGINT) AS last_seq FROM events)"""


def received(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that have arrived in part: every seventh event is still on its way, so some versions lack seqs."""
    return changes(spark, sf_dir).where("event_id % 7 <> 3")


RECEIVED = "received AS (SELECT * FROM changes WHERE event_id % 7 <> 3)"


def seq_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Received seqs as bookkeeping has them, one range for each change; versions divisible by 9 aren't known yet."""
    return received(spark, sf_dir).where("db_version % 9 <> 0").selectExpr("site_id", "db_version", "seq AS start_seq", "seq AS end_seq", "last_seq")


SEQ_RANGES = "seq_ranges AS (SELECT site_id, db_version, seq AS start_seq, seq AS end_seq, last_seq FROM received WHERE db_version % 9 <> 0)"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey % 5 AS actor", "o_orderkey div 5 + 1 AS version", "o_custkey")


VERSIONS = "versions AS (SELECT o_orderkey % 5 AS actor, o_orderkey // 5 + 1 AS version, o_custkey FROM orders)"


def ours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What we have applied: (actor, start, end), a range for each version; actor 4 is unknown to us."""
    return versions(spark, sf_dir).where("version % 7 NOT IN (2, 3) AND version % 40 < 31 AND actor <> 4").selectExpr("actor", "version AS start", "version AS end")


OURS = 'ours AS (SELECT actor, version AS "start", version AS "end" FROM versions WHERE version % 7 NOT IN (2, 3) AND version % 40 < 31 AND actor <> 4)'


def theirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).where("version % 11 <> 5").selectExpr("actor", "version AS start", "version AS end")


THEIRS = 'theirs AS (SELECT actor, version AS "start", version AS "end" FROM versions WHERE version % 11 <> 5)'


def our_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial versions: two received stretches of seqs 0 to 9 each."""
    held = versions(spark, sf_dir).where("version % 7 = 2 AND actor <> 4").select("actor", "version")
    return held.selectExpr("actor", "version", "inline(array(struct(version % 3 AS start, CAST(4 AS BIGINT) AS end), struct(CAST(6 AS BIGINT) AS start, 6 + version % 4 AS end)))").withColumn("last_seq", F.lit(9).cast("long"))


OUR_PARTIAL = """our_partial AS (SELECT actor, version, version % 3 AS "start", CAST(4 AS BIGINT) AS "end", CAST(9 AS BIGINT) AS last_seq FROM versions WHERE version % 7 = 2 AND actor <> 4
 UNION ALL SELECT actor, version, CAST(6 AS BIGINT), 6 + version % 4, CAST(9 AS BIGINT) FROM versions WHERE version % 7 = 2 AND actor <> 4)"""


def their_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).where("version % 11 = 5").selectExpr("actor", "version", "CAST(0 AS BIGINT) AS start", "3 + version % 5 AS end", "CAST(9 AS BIGINT) AS last_seq")


THEIR_PARTIAL = 'their_partial AS (SELECT actor, version, CAST(0 AS BIGINT) AS "start", 3 + version % 5 AS "end", CAST(9 AS BIGINT) AS last_seq FROM versions WHERE version % 11 = 5)'


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two committed states of events: the later one lacks some rows, has new ones and changed ones."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", F.col("value").cast("decimal(12,2)").alias("value"))
    old = events.where("event_id % 10 <> 3")
    new = events.where("event_id % 10 <> 7").withColumn("value", F.when(F.col("event_id") % 10 == 5, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(12,2)")).withColumn("event_type", F.when(F.col("event_id") % 20 != 4, F.col("event_type")))
    return old, new


SNAPSHOTS = """old_rows AS (SELECT event_id, user_id, event_type, CAST(value AS DECIMAL(12,2)) AS value FROM events WHERE event_id % 10 <> 3),
 new_rows AS (SELECT event_id, user_id, CASE WHEN event_id % 20 <> 4 THEN event_type END AS event_type, CAST(CASE WHEN event_id % 10 = 5 THEN CAST(value AS DECIMAL(12,2)) + 1 ELSE CAST(value AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS value FROM events WHERE event_id % 10 <> 7)"""
