"""Queries over live queries, notifications, ingest, retention, schemas and metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.engine.api import Engine
from tidemark.engine.catalog import TableSpec
from tidemark.operators import changes as ch
from tidemark.operators import ingest, metrics, ranges, schema
from tidemark.operators import subscriptions as sub
from tidemark.plans import changelog, lineage
from tidemark.plans import inputs as i

KEY = ["event_id"]


def _result(df: DataFrame) -> DataFrame:
    """The subscribed query: SELECT event_id, event_type, value FROM events WHERE value > 20."""
    return df.where("value > 20").select("event_id", "event_type", F.col("value").cast("double").alias("value"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = i.snapshots(spark, sf_dir)
    return sub.changes(sub.initial(_result(old), KEY), _result(new), KEY)


def sub_initial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.initial(_result(i.snapshots(spark, sf_dir)[0]), KEY)


def sub_delta_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result narrowed to the keys that a batch of changes names."""
    old, new = i.snapshots(spark, sf_dir)
    keys = ch.capture(old, new, KEY, ["event_type", "value"], 1, 1, "events").select(F.col("pk").alias("event_id")).distinct()
    return sub.narrowed(_result(new), keys, KEY)


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.candidates(i.row_changes(spark, sf_dir), "row_state", ["click", "view"]).select("pk")


def sub_diff_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = i.snapshots(spark, sf_dir)
    return sub.upserts(_result(old), _result(new), KEY)


def sub_diff_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = i.snapshots(spark, sf_dir)
    return sub.deletes(_result(old), _result(new), KEY)


def sub_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)


def sub_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot with its changes applied: what a late joiner is given."""
    old, new = i.snapshots(spark, sf_dir)
    stored = sub.initial(_result(old), KEY)
    return sub.applied(stored, sub.changes(stored, _result(new), KEY), KEY)


JOINED = """SELECT json_object('targets', json_array(o.o_orderstatus || ':' || o.o_custkey), 'labels', json_object('segment', c.c_mktsegment, 'nation', n.n_name, 'region', r.r_name)) AS doc
 FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey < 4 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
 WHERE (c.c_mktsegment IS NULL OR c.c_mktsegment <> 'MACHINERY') AND o.o_orderstatus = 'P'"""


def _join_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """The subscribed join over two states: customers that go, come and change, and a nation that is renamed."""
    engine = Engine(spark, sf_dir)
    lineage.columns_used(JOINED, {t: engine.table(t).columns for t in engine.catalog.keys})
    sql, key = lineage.with_keys(JOINED, engine.catalog.keys)
    customer, nation = engine.table("customer"), engine.table("nation")
    before = {"customer": customer.where("c_custkey % 10 <> 3")}
    after = {"customer": customer.where("c_custkey % 10 <> 7").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 5, "MACHINERY").otherwise(F.col("c_mktsegment"))), "nation": nation.withColumn("n_name", F.when(F.col("n_nationkey") == 2, "RENAMED").otherwise(F.col("n_name")))}
    return engine.read(sql, None, before), engine.read(sql, None, after), key


def sub_join_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of customers and nations does to three chained LEFT JOINs, by the keys of all four tables."""
    return sub.keyed_difference(*_join_states(spark, sf_dir))


def sub_join_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join narrowed to the customers that changed: an inner join with their rows."""
    engine = Engine(spark, sf_dir)
    sql, _ = lineage.with_keys(lineage.narrowed(JOINED, "c"), engine.catalog.keys)
    return engine.read(sql, None, {"customer": engine.table("customer").where("c_custkey % 10 IN (3, 5)")})


def sub_log_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.purge(_log(spark, sf_dir), 50).select("change_id", "change_type", "event_id")


def sub_catchup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.catch_up(_log(spark, sf_dir), 40).select("change_id", "change_type", "row_id")


def sub_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks of a log from which every ninth change is lost."""
    return sub.breaks(_log(spark, sf_dir).where("change_id % 9 <> 4"), 64)


def updates_notify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.notifications(i.row_changes(spark, sf_dir), "row_state").select("pk", "change_type")


def updates_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = sub.notifications(i.row_changes(spark, sf_dir).drop("seq").withColumn("seq", F.col("event_id")), "row_state")
    return sub.last_per_key(notes).select("pk", "change_type")


def updates_late_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sub.without_late(i.row_changes(spark, sf_dir).select("pk", "cl", "event_id"), "event_id")


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored and fetched records: some gone, some new, some changed."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(12,2)"))
    fetched = customers.where("c_custkey % 9 <> 4").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 6 == 1, "MOVED").otherwise(F.col("c_mktsegment"))).withColumn("c_acctbal", (F.col("c_acctbal") + F.col("c_custkey") % 2).cast("decimal(12,2)"))
    return customers.where("c_custkey % 8 <> 5"), fetched


def registry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only name, nation and segment are hashed: a changed balance alone is no change."""
    stored, fetched = _customers(spark, sf_dir)
    return ingest.hash_diff(stored, fetched, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, fetched = _customers(spark, sf_dir)
    return ingest.upsert(stored, fetched, ["c_custkey"]).select("c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def upsert_if_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS id", "c_mktsegment AS state", "c_nationkey AS rtt_min", "c_custkey % 10 AS updated_at")
    arrived = members.where("id % 4 <> 0").selectExpr("id + id % 2 * 3 AS id", "'new' AS state", "CASE WHEN id % 5 = 0 THEN NULL ELSE rtt_min + 100 END AS rtt_min", "id % 7 AS updated_at").where("id % 2 = 0")
    return ingest.upsert_if_newer(members, arrived, ["id"], "updated_at", ["rtt_min"])


def delete_if_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate")
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderpriority = '5-LOW'").select("o_orderkey")
    return ingest.delete_if_older(orders, ids, "o_orderkey", "o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz"))


def reap_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.reapable(i.row_changes(spark, sf_dir), F.lit("2024-02-01").cast("timestamp_ntz"), "2w").select("tbl", "pk")


def reap_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("pk"))
    return ingest.orphan_keys(keys, i.changes(spark, sf_dir), ["pk"])


def schema_evolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer rows in a schema with two more columns and a computed one."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    fields = [*customers.schema.fields, T.StructField("tier", T.LongType()), T.StructField("note", T.StringType()), T.StructField("shout", T.StringType())]
    spec = TableSpec("customer", T.StructType(fields), ("c_custkey",), {"tier": "1"}, {"shout": "upper(c_name)"})
    return schema.evolve(customers, spec)


def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("lag", F.col("value") / 10)
    return metrics.bucket_counts(events, "lag", by=["event_type"]).withColumn("bucket", F.col("bucket").cast("long"))


def histogram_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("lag", F.col("value") / 10)
    counts = metrics.bucket_counts(events, "lag", by=["event_type"])
    return metrics.quantile(counts, 0.5, by=["event_type"]).select("event_type", F.round("quantile", 6).alias("p50"))


def rolling_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 0.9-quantile of five chunks of a day each, up to day 20."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("value / 10 AS lag", "event_type", "CAST(datediff(CAST(ts AS DATE), DATE'2024-01-01') AS BIGINT) AS chunk")
    counts = metrics.bucket_counts(events, "lag", by=["event_type", "chunk"])
    return metrics.quantile(metrics.rolling(counts, "chunk", 5, 20), 0.9, by=["event_type"]).select("event_type", F.round("quantile", 6).alias("p90"))


def ring_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", metrics.ring(F.col("value") * 3).cast("long").alias("ring"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's samples by day, in order: lists that don't grow with the table's length in time."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.to_date("ts"))
    pairs = events.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("pairs"))
    return pairs.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.transform("pairs", lambda p: p["value"]).alias("samples"))


def ring_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("user_id", "day", metrics.ring_steps(F.col("samples")).cast("long").alias("ring"))


def rolling_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rolling_min(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["user_id"], ["event_id"]).select("event_id", "rolling_min")


def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir).select("user_id", "day", metrics.ema(F.col("samples")).alias("ema"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of the five actors as members, with a state in JSON."""
    return spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 3").selectExpr("n_nationkey AS actor", "to_json(named_struct('id', n_nationkey, 'state', if(n_nationkey = 1, 'Suspect', 'Alive'))) AS foca_state")


def stats_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = i.our_partial(spark, sf_dir)
    state = F.coalesce(F.get_json_object("foca_state", "$.state"), F.lit("orphan"))
    return held.join(_members(spark, sf_dir), "actor", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("version").alias("oldest"))


def gap_stats_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = ranges.gaps(i.ours(spark, sf_dir), ["actor"])
    state = F.coalesce(F.get_json_object("foca_state", "$.state"), F.lit("orphan"))
    return gaps.join(_members(spark, sf_dir), "actor", "left").groupBy(state.alias("state")).agg(F.sum(F.col("end") - F.col("start") + 1).cast("long").alias("missing"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        sub_initial, sub_delta_candidates, match_candidates, sub_diff_upsert, sub_diff_delete, sub_changes, sub_rows, sub_join_changes, sub_join_candidates, sub_log_purge, sub_catchup, sub_contiguity, updates_notify, updates_dedupe,
        updates_late_guard, registry_diff, upsert_merge, upsert_if_newer, delete_if_older, reap_deleted, reap_orphans, schema_evolve, histogram_buckets, histogram_quantile, rolling_quantile,
        ring_bucket, ring_hysteresis, rolling_min, ema, stats_by_state, gap_stats_by_state,
    )
}

_RESULTS = f"""WITH {i.SNAPSHOTS}, a AS (SELECT event_id, event_type, CAST(value AS DOUBLE) AS value FROM old_rows WHERE value > 20), b AS (SELECT event_id, event_type, CAST(value AS DOUBLE) AS value FROM new_rows WHERE value > 20)"""
_LOG = f"""{_RESULTS}, stored AS (SELECT *, row_number() OVER (ORDER BY event_id) AS row_id FROM a),
 moved AS (SELECT 0 AS late, CASE WHEN s.event_id IS NULL THEN 'insert' ELSE 'update' END AS change_type, b.event_id, b.event_type, b.value, s.row_id AS held FROM b LEFT JOIN stored s ON s.event_id = b.event_id WHERE s.event_id IS NULL OR s.event_type IS DISTINCT FROM b.event_type OR s.value IS DISTINCT FROM b.value
  UNION ALL SELECT 1, 'delete', event_id, event_type, value, row_id FROM stored s WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.event_id = s.event_id)),
 log AS (SELECT row_number() OVER (ORDER BY late, event_id) AS change_id, change_type, event_id, event_type, value,
  coalesce(held, (SELECT max(row_id) FROM stored) + row_number() OVER (PARTITION BY change_type ORDER BY event_id)) AS row_id FROM moved)"""
_JOIN = """SELECT o_orderkey AS __key_o_o_orderkey, c_custkey AS __key_c_c_custkey, n_nationkey AS __key_n_n_nationkey, r_regionkey AS __key_r_r_regionkey,
 CAST(json_object('targets', json_array(o_orderstatus || ':' || o_custkey), 'labels', json_object('segment', c_mktsegment, 'nation', n_name, 'region', r_name)) AS VARCHAR) AS doc
 FROM orders {left} JOIN {customer} ON c_custkey = o_custkey LEFT JOIN {nation} ON n_nationkey = c_nationkey AND n_regionkey < 4 LEFT JOIN region ON r_regionkey = n_regionkey
 WHERE (c_mktsegment IS NULL OR c_mktsegment <> 'MACHINERY') AND o_orderstatus = 'P'"""
_JOIN_KEYS = ["__key_o_o_orderkey", "__key_c_c_custkey", "__key_n_n_nationkey", "__key_r_r_regionkey"]
_JOIN_SAME = " AND ".join(f"x.{k} IS NOT DISTINCT FROM y.{k}" for k in _JOIN_KEYS)
_JOIN_STATES = f"""WITH c1 AS (SELECT * FROM customer WHERE c_custkey % 10 <> 3), c2 AS (SELECT * REPLACE (CASE WHEN c_custkey % 10 = 5 THEN 'MACHINERY' ELSE c_mktsegment END AS c_mktsegment) FROM customer WHERE c_custkey % 10 <> 7),
 n2 AS (SELECT * REPLACE (CASE WHEN n_nationkey = 2 THEN 'RENAMED' ELSE n_name END AS n_name) FROM nation), a AS ({_JOIN.format(left='LEFT', customer='c1', nation='nation')}), b AS ({_JOIN.format(left='LEFT', customer='c2', nation='n2')})"""
_STORED = "stored AS (SELECT * FROM customer WHERE c_custkey % 8 <> 5), fetched AS (SELECT c_custkey, c_name, c_nationkey, CAST(c_acctbal AS DECIMAL(12,2)) + c_custkey % 2 AS c_acctbal, CASE WHEN c_custkey % 6 = 1 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 9 <> 4)"
_BOUNDS = list(metrics.BOUNDS)
_EDGES = f"edges AS (SELECT b AS bucket, ({_BOUNDS})[b + 1] AS hi, CASE WHEN b = 0 THEN NULL ELSE ({_BOUNDS})[b] END AS lo FROM range({len(_BOUNDS) + 1}) t(b))"


def _quantile(counts: str, q: float, name: str) -> str:
    last = _BOUNDS[-1]
    return f"""SELECT event_type, round(CASE WHEN bucket = 0 THEN hi WHEN bucket = {len(_BOUNDS)} THEN {last} ELSE lo + (hi - lo) * ({q} * total - (upto - n)) / n END, 6) AS {name}
 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS rn FROM (SELECT event_type, bucket, hi, lo, n, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM {counts} JOIN edges USING (bucket)) x WHERE n > 0 AND upto >= {q} * total) y WHERE rn = 1"""


_COUNTED = "SELECT event_type, {more}bucket, count(*) AS n FROM lags JOIN edges ON (edges.hi IS NULL OR lag <= edges.hi) AND (edges.lo IS NULL OR lag > edges.lo) GROUP BY ALL"
_FOLD = """WITH RECURSIVE s AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, value, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d')) AS m FROM events),
 f AS (SELECT user_id, day, k, m, {first} AS x FROM s WHERE k = 1 UNION ALL SELECT s.user_id, s.day, s.k, s.m, {step} FROM f JOIN s ON s.user_id = f.user_id AND s.day = f.day AND s.k = f.k + 1)"""
_RING = "CASE WHEN {v} < 6 THEN 0 WHEN {v} < 15 THEN 1 WHEN {v} < 50 THEN 2 WHEN {v} < 100 THEN 3 WHEN {v} < 200 THEN 4 ELSE 5 END"

ORACLES: dict[str, str] = {
    "sub_initial": f"{_RESULTS} SELECT *, row_number() OVER (ORDER BY event_id) AS row_id FROM a",
    "sub_delta_candidates": f"{_RESULTS} SELECT * FROM b WHERE EXISTS (SELECT 1 FROM new_rows n LEFT JOIN old_rows o USING (event_id) WHERE n.event_id = b.event_id AND (o.event_id IS NULL OR o.event_type IS DISTINCT FROM n.event_type OR o.value IS DISTINCT FROM n.value))",
    "match_candidates": f"WITH {i.ROW_CHANGES} SELECT DISTINCT pk FROM row_changes WHERE cid IN ('click', 'view', '-1')",
    "sub_diff_upsert": f"{_RESULTS}, d AS (SELECT * FROM b EXCEPT SELECT * FROM a) SELECT CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.event_id = d.event_id) THEN 'update' ELSE 'insert' END AS change_type, * FROM d",
    "sub_diff_delete": f"{_RESULTS} SELECT * FROM a WHERE event_id NOT IN (SELECT event_id FROM b)",
    "sub_changes": f"{_LOG} SELECT * FROM log",
    "sub_rows": f"{_LOG} SELECT b.*, coalesce(s.row_id, l.row_id) AS row_id FROM b LEFT JOIN stored s ON s.event_id = b.event_id LEFT JOIN log l ON l.event_id = b.event_id AND l.change_type = 'insert'",
    "sub_join_changes": f"""{_JOIN_STATES} SELECT 'insert' AS change_type, x.* FROM b x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE {_JOIN_SAME}) UNION ALL SELECT 'delete', x.* FROM a x WHERE NOT EXISTS (SELECT 1 FROM b y WHERE {_JOIN_SAME})
 UNION ALL SELECT 'update', x.* FROM b x JOIN a y ON {_JOIN_SAME} WHERE x.doc <> y.doc""",
    "sub_join_candidates": f"WITH c1 AS (SELECT * FROM customer WHERE c_custkey % 10 IN (3, 5)) {_JOIN.format(left='INNER', customer='c1', nation='nation')}",
    "sub_log_purge": f"{_LOG} SELECT change_id, change_type, event_id FROM log WHERE change_id >= (SELECT max(change_id) FROM log) - 50",
    "sub_catchup": f"{_LOG} SELECT change_id, change_type, row_id FROM log WHERE change_id > 40 ORDER BY change_id",
    "sub_contiguity": f"{_LOG}, kept AS (SELECT change_id FROM log WHERE change_id % 9 <> 4) SELECT after_id, next_id FROM (SELECT change_id AS after_id, lead(change_id) OVER (ORDER BY change_id) AS next_id FROM kept) t WHERE next_id <> after_id + 1",
    "updates_notify": f"WITH {i.ROW_CHANGES} SELECT pk, CASE WHEN cl % 2 = 0 THEN 'delete' ELSE 'update' END AS change_type FROM row_changes",
    "updates_dedupe": f"WITH {i.ROW_CHANGES} SELECT pk, CASE WHEN cl % 2 = 0 THEN 'delete' ELSE 'update' END AS change_type FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY cl DESC, event_id DESC) AS rn FROM row_changes) t WHERE rn = 1",
    "updates_late_guard": f"WITH {i.ROW_CHANGES} SELECT pk, cl, event_id FROM row_changes r WHERE NOT EXISTS (SELECT 1 FROM row_changes x WHERE x.pk = r.pk AND x.event_id < r.event_id AND x.cl > r.cl)",
    "registry_diff": f"WITH {_STORED} SELECT coalesce(s.c_custkey, f.c_custkey) AS c_custkey, CASE WHEN f.c_custkey IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM stored s FULL JOIN fetched f ON s.c_custkey = f.c_custkey WHERE s.c_custkey IS NULL OR f.c_custkey IS NULL OR s.c_mktsegment <> f.c_mktsegment",
    "upsert_merge": f"WITH {_STORED} SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DOUBLE) AS c_acctbal FROM fetched UNION ALL SELECT c_custkey, c_mktsegment, CAST(c_acctbal AS DOUBLE) FROM stored WHERE c_custkey NOT IN (SELECT c_custkey FROM fetched)",
    "upsert_if_newer": """WITH m AS (SELECT c_custkey AS id, c_mktsegment AS state, c_nationkey AS rtt_min, c_custkey % 10 AS updated_at FROM customer),
 n AS (SELECT * FROM (SELECT id + id % 2 * 3 AS id, 'new' AS state, CASE WHEN id % 5 = 0 THEN NULL ELSE rtt_min + 100 END AS rtt_min, id % 7 AS updated_at FROM m WHERE id % 4 <> 0) q WHERE id % 2 = 0),
 r AS (SELECT *, 1 AS held FROM m UNION ALL SELECT *, 0 FROM n), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, held DESC) AS rn FROM r) t WHERE rn = 1)
 SELECT w.id, w.state, coalesce(w.rtt_min, m.rtt_min) AS rtt_min, w.updated_at FROM w LEFT JOIN m ON m.id = w.id""",
    "delete_if_older": "SELECT o_orderkey, o_orderdate FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND o_orderdate < TIMESTAMP '1996-01-01')",
    "reap_deleted": f"""WITH {i.ROW_CHANGES}, latest AS (SELECT tbl, pk, cid, cl, ts, row_number() OVER (PARTITION BY tbl, pk ORDER BY cl DESC, (cid = '-1') DESC, ts DESC) AS rn FROM row_changes)
 SELECT tbl, pk FROM latest WHERE rn = 1 AND cid = '-1' AND cl % 2 = 0 AND ts < TIMESTAMP '2024-02-01' - INTERVAL 14 DAY ORDER BY ts, tbl, pk LIMIT 500""",
    "reap_orphans": f"WITH {i.CHANGES} SELECT c_custkey AS pk FROM customer WHERE c_custkey NOT IN (SELECT pk FROM changes)",
    "schema_evolve": "SELECT c_custkey, c_name, CAST(1 AS BIGINT) AS tier, CAST(NULL AS VARCHAR) AS note, upper(c_name) AS shout FROM customer",
    "histogram_buckets": f"WITH {_EDGES}, lags AS (SELECT event_type, value / 10 AS lag FROM events), counted AS ({_COUNTED.format(more='')}) SELECT k.event_type, e.bucket, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT event_type FROM events) k CROSS JOIN edges e LEFT JOIN counted c ON c.event_type = k.event_type AND c.bucket = e.bucket",
    "histogram_quantile": f"WITH {_EDGES}, lags AS (SELECT event_type, value / 10 AS lag FROM events), counted AS ({_COUNTED.format(more='')}) {_quantile('counted', 0.5, 'p50')}",
    "rolling_quantile": f"WITH {_EDGES}, lags AS (SELECT event_type, value / 10 AS lag FROM events WHERE date_diff('day', TIMESTAMP '2024-01-01', ts) BETWEEN 16 AND 20), counted AS ({_COUNTED.format(more='')}) {_quantile('counted', 0.9, 'p90')}",
    "ring_bucket": f"SELECT event_id, CAST({_RING.format(v='value * 3')} AS BIGINT) AS ring FROM events",
    "ring_hysteresis": _FOLD.format(first=f"CAST({_RING.format(v='value')} AS BIGINT)", step="CASE WHEN s.value >= ([6, 15, 50, 100, 200, 300])[f.x + 1] + 2 AND f.x < 5 THEN f.x + 1 WHEN s.value < ([0, 6, 15, 50, 100, 200])[f.x + 1] - 1 AND f.x > 0 THEN f.x - 1 ELSE f.x END") + " SELECT user_id, day, x AS ring FROM f WHERE k = m",
    "rolling_min": "SELECT event_id, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS rolling_min FROM events",
    "ema": _FOLD.format(first="value", step="f.x * (1 - CAST(0.3 AS DOUBLE)) + s.value * CAST(0.3 AS DOUBLE)") + " SELECT user_id, day, x AS ema FROM f WHERE k = m",
    "stats_by_state": f"WITH {i.VERSIONS}, {i.OUR_PARTIAL} SELECT CASE WHEN actor = 1 THEN 'Suspect' WHEN actor < 3 THEN 'Alive' ELSE 'orphan' END AS state, count(*) AS n, min(version) AS oldest FROM our_partial GROUP BY 1",
    "gap_stats_by_state": f"""WITH {i.VERSIONS}, {i.OURS} SELECT CASE WHEN actor = 1 THEN 'Suspect' WHEN actor < 3 THEN 'Alive' ELSE 'orphan' END AS state, CAST(sum("end" - "start" + 1) AS BIGINT) AS missing FROM ({changelog._gaps('ours')}) g GROUP BY 1""",
}
