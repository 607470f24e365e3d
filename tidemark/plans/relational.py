"""Relational queries and scalar functions, through the engine's SQL.

Each entry holds the statement as clients send it, and the oracle's spelling where it differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine.api import Engine
from tidemark.functions import pg

#: name: statement, or (statement, oracle's spelling).
SQL: dict[str, str | tuple[str, str]] = {
    "scan_nation": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "project_expr": "SELECT s_suppkey AS id, s_name || '/' || CAST(s_nationkey AS VARCHAR) AS label, s_nationkey * 10 + 1 AS code, s_acctbal > 0 AS in_credit FROM supplier",
    "filter_pred": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus IN ('F', 'O') AND NOT (o_custkey < 100 OR o_orderpriority IS NULL)",
    "filter_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%A%1%' AND p_type NOT LIKE 'zz_%'", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%A%1%' AND p_type NOT ILIKE 'zz_%'"),
    "filter_case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class FROM part WHERE CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END = 0",
    "null_safe_eq": ("SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation) a JOIN (SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation) b ON a.r <=> b.r WHERE a.n_nationkey < b.n_nationkey",
                     "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM (SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation) a JOIN (SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation) b ON a.r IS NOT DISTINCT FROM b.r WHERE a.n_nationkey < b.n_nationkey"),
    "join_inner": "SELECT o.o_orderkey, c.c_name, l.l_partkey, l.l_quantity FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'P'",
    "join_using": "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)",
    "join_left_chain": "SELECT c.c_custkey, n.n_name, r.r_name, o.o_orderkey FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey > 0 LEFT JOIN region r ON r.r_regionkey = n.n_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000",
    "join_left_cross": ("SELECT r.r_name, n.n_name FROM region r LEFT JOIN (SELECT n_name FROM nation WHERE n_nationkey < 4) n ON true", "SELECT r.r_name, n.n_name FROM region r LEFT JOIN (SELECT n_name FROM nation WHERE n_nationkey < 4) n ON true"),
    "join_full": "SELECT a.k AS a_key, b.k AS b_key FROM (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0) a FULL OUTER JOIN (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 0) b ON a.k = b.k",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3)",
    "join_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "agg_basic": "SELECT COUNT(*) AS n, COUNT(nullif(n_regionkey, 1)) AS n_some, CAST(SUM(n_nationkey) AS BIGINT) AS total, MIN(n_name) AS first_name, MAX(n_name) AS last_name FROM nation",
    "agg_group": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity, CAST(SUM(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(1 - l_discount AS DECIMAL(4,2))) AS DOUBLE) AS revenue FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_partkey) AS parts FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_partkey FROM lineitem) t GROUP BY l_returnflag",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / COUNT(*) AS mean_price FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND AVG(o_totalprice) > 100000",
    "agg_filter": "SELECT o_orderpriority, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, COALESCE(CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE), 0.0) AS pending FROM orders GROUP BY o_orderpriority",
    "agg_rollup": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "win_rank": "SELECT s_suppkey, CAST(RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS r, CAST(DENSE_RANK() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal % 10, s_suppkey) AS BIGINT) AS d, CAST(ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS n FROM supplier",
    "win_lag": "SELECT event_id, LAG(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before, LEAD(event_type, 2, 'none') OVER (PARTITION BY user_id ORDER BY event_id) AS later, FIRST_VALUE(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first_id FROM events",
    "win_frame": "SELECT event_id, CAST(SUM(CAST(value AS DECIMAL(12,2))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_four, COUNT(*) OVER (PARTITION BY user_id) AS n FROM events",
    "win_ntile": "SELECT c_custkey, CAST(NTILE(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter FROM customer",
    "sort_multi": "SELECT n_regionkey, n_name, n_nationkey FROM nation ORDER BY n_regionkey DESC, 2 ASC",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_partkey LIMIT 20 OFFSET 35",
    "set_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation",
    "set_except": "SELECT nullif(n_regionkey, 3) AS k, n_nationkey % 4 AS m FROM nation EXCEPT SELECT nullif(r_regionkey, 3), r_regionkey % 4 FROM region",
    "set_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "values_rows": "SELECT v.code, v.label, n.n_name FROM (VALUES (1, 'one'), (2, 'two'), (99, 'none')) AS v(code, label) LEFT JOIN nation n ON n.n_nationkey = v.code",
    "cte": "WITH spend AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS s FROM orders GROUP BY o_custkey), big AS (SELECT * FROM spend WHERE s > 1000000) SELECT c.c_custkey, CAST(b.s AS DOUBLE) AS spent FROM big b JOIN customer c ON c.c_custkey = b.o_custkey",
    "cte_recursive": "WITH RECURSIVE r(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 12) SELECT n, f FROM r",
    "subquery_scalar": "SELECT c_custkey, c_acctbal, (SELECT COUNT(*) FROM nation) AS nations FROM customer WHERE c_acctbal > (SELECT MAX(s_acctbal) FROM supplier) - 500",
    "subquery_correlated": "SELECT p.p_partkey, (SELECT COUNT(*) FROM lineitem l WHERE l.l_partkey = p.p_partkey) AS lines FROM part p WHERE p.p_retailprice > (SELECT AVG(CAST(q.p_retailprice AS DECIMAL(12,2))) FROM part q WHERE q.p_brand = p.p_brand)",
    "is_distinct_from": "SELECT n_nationkey, nullif(n_regionkey, 1) IS DISTINCT FROM nullif(n_nationkey % 5, 2) AS differs FROM nation",
    "pg_cast": ("SELECT c_custkey::int8 AS id, c_acctbal::varchar IS NOT NULL AS shown, CAST(c_acctbal AS int4) >= 0 AS positive, '12'::int2 + 1 AS n FROM customer", "SELECT c_custkey::BIGINT AS id, c_acctbal::VARCHAR IS NOT NULL AS shown, trunc(c_acctbal)::BIGINT >= 0 AS positive, '12'::BIGINT + 1 AS n FROM customer"),
    "fn_string": ("SELECT c_custkey, upper(c_mktsegment) AS up, substr(c_name, 3, 5) AS part, CAST(instr(c_name, '#') AS BIGINT) AS at, trim('  ' || c_mktsegment || ' ') AS cut, hex(c_mktsegment) AS hexed, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, 'Customer', 'C') AS short FROM customer",
                  "SELECT c_custkey, upper(c_mktsegment) AS up, substr(c_name, 3, 5) AS part, CAST(instr(c_name, '#') AS BIGINT) AS at, trim('  ' || c_mktsegment || ' ') AS cut, hex(c_mktsegment) AS hexed, CAST(length(c_name) AS BIGINT) AS n, replace(c_name, 'Customer', 'C') AS short FROM customer"),
    "fn_conditional": ("SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), -1) AS region, greatest(n_nationkey, 10) AS at_least, CASE WHEN nullif(n_regionkey, 1) IS NULL THEN NULL ELSE greatest(n_regionkey, 3) END AS strict_max FROM nation", ""),
    "fn_cast": ("SELECT event_id, CAST(value AS DECIMAL(10,1)) AS rounded, try_cast(event_type AS INTEGER) AS no_number, CAST(event_id AS DOUBLE) AS d, CAST(user_id AS VARCHAR) AS s FROM events", "SELECT event_id, CAST(value AS DECIMAL(10,1)) AS rounded, try_cast(event_type AS BIGINT) AS no_number, CAST(event_id AS DOUBLE) AS d, CAST(user_id AS VARCHAR) AS s FROM events"),
    "fn_math": ("SELECT o_orderkey, o_orderkey div 7 AS q, o_orderkey % 7 AS r, shiftright(o_orderkey, 2) AS sh, o_orderkey & 12 AS b, abs(3 - o_custkey) AS a, (1664525 * o_orderkey + 1013904223) & 4294967295 AS lcg FROM orders",
                "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, o_orderkey >> 2 AS sh, o_orderkey & 12 AS b, abs(3 - o_custkey) AS a, (1664525 * o_orderkey + 1013904223) & 4294967295 AS lcg FROM orders"),
    "fn_date": ("SELECT event_id, CAST(date_trunc('MONTH', ts) AS TIMESTAMP_NTZ) AS month_start, date_format(ts, 'yyyy-MM-dd') AS day, CAST(hour(ts) AS BIGINT) AS h, CAST(timestampdiff(SECOND, timestamp_ntz'2024-01-01 00:00:00', date_trunc('SECOND', ts)) AS BIGINT) AS secs FROM events",
                "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month_start, strftime(ts, '%Y-%m-%d') AS day, hour(ts) AS h, CAST(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS secs FROM events"),
    "fn_array": ("SELECT n_nationkey, array_join(array_sort(array(n_name, 'b', 'a')), '-') AS joined, CAST(size(sequence(1, n_nationkey + 1)) AS BIGINT) AS n, array_contains(array(1, 2, 3), n_regionkey) AS inside FROM nation",
                 "SELECT n_nationkey, array_to_string(list_sort([n_name, 'b', 'a']), '-') AS joined, len(range(1, n_nationkey + 2)) AS n, list_contains([1, 2, 3], n_regionkey) AS inside FROM nation"),
    "fn_array_subscript": ("SELECT n_nationkey, split(n_name, '_')[1] AS head, split(n_name, '_')[2] AS tail FROM nation", "SELECT n_nationkey, string_split(n_name, '_')[1] AS head, string_split(n_name, '_')[2] AS tail FROM nation"),
    "fn_position": "SELECT n_nationkey, CAST(POSITION('ION' IN n_name) AS BIGINT) AS at FROM nation",
    "generate_series": ("SELECT CAST(i AS BIGINT) AS i, n.n_name FROM generate_series(0, 40) AS i LEFT JOIN nation n ON n.n_nationkey = i", "SELECT CAST(i AS BIGINT) AS i, n.n_name FROM generate_series(0, 40) t(i) LEFT JOIN nation n ON n.n_nationkey = i"),
    "json_extract": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.none') AS none FROM events WHERE get_json_object(props, '$.k') > 50", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.none') AS none FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50"),
    "json_build": ("SELECT n_nationkey, to_json(named_struct('id', n_nationkey, 'name', n_name)) AS obj, to_json(array(n_nationkey, n_regionkey)) AS arr FROM nation", "SELECT n_nationkey, CAST(to_json({'id': n_nationkey, 'name': n_name}) AS VARCHAR) AS obj, CAST(to_json([n_nationkey, n_regionkey]) AS VARCHAR) AS arr FROM nation"),
    "join_unnest": ("SELECT n.n_name, u.v FROM nation n JOIN (SELECT explode(array(1, 3, 5, 99)) AS v) u ON u.v = n.n_nationkey", "SELECT n.n_name, u.v FROM nation n JOIN (SELECT unnest([1, 3, 5, 99]) AS v) u ON u.v = n.n_nationkey"),
}


def _sql(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).query(statement)


def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional, numbered and named parameters give the same rows."""
    engine = Engine(spark, sf_dir)
    positional = engine.query(["SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = ? AND o_totalprice > ?", [7, 1000.5]])
    numbered = engine.query(["SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = $1 AND o_totalprice > $2", [8, 1000.5]])
    named = engine.query({"query": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = :c AND o_totalprice > $low", "named_params": {":c": 9, "$low": 1000.5}})
    return positional.unionAll(numbered).unionAll(named)


def agg_string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.groupBy("n_regionkey").agg(pg.string_agg(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")), "; ", F.col("n_nationkey")).alias("names"))


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in bands of price: the bands are few and fixed, so they are broadcast."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bands = spark.createDataFrame([(n, n * 50_000.0, (n + 1) * 50_000.0) for n in range(12)], "band int, low double, high double")
    return orders.join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))).groupBy("band").agg(F.count("*").alias("n"))


def unnest_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nation.select("n_nationkey", F.array(F.lit(1), F.lit(2), F.lit(3)).alias("a"), F.split("n_name", "").alias("b")).select("n_nationkey", pg.unnest(F.col("a"), F.slice("b", 1, 5)))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet")


def fn_array_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_regionkey") == 3, F.lit(None)).otherwise(F.concat(F.lit("{"), "n_name", F.lit(",x,"), F.col("n_regionkey").cast("string"), F.lit("}")))
    return _nations(spark, sf_dir).select("n_nationkey", pg.array_to_string(text, "|").alias("joined"))


def fn_string_to_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).select("n_nationkey", pg.string_to_json_array(F.concat("n_name", F.lit(".b.c")), ".").alias("parts"), F.size(pg.string_to_array(F.col("n_name"), "")).cast("long").alias("signs"))


def fn_regexp_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("n_name")
    return _nations(spark, sf_dir).select("n_nationkey", pg.regexp_replace(name, "([NT])", r"<\1>").alias("first"), pg.regexp_replace(name, "n", "x", "gi").alias("every"), pg.regexp_replace(name, "(", "x").alias("bad"))


def fn_quote_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.when(F.col("n_regionkey") == 0, F.concat("n_name", F.lit(' "x"'))).when(F.col("n_regionkey") == 1, "select").when(F.col("n_regionkey") == 2, "").when(F.col("n_regionkey") == 3, F.concat(F.lit("9"), "n_name")).otherwise(F.col("n_name"))
    return _nations(spark, sf_dir).select("n_nationkey", pg.quote_ident(odd).alias("quoted"))


def fn_array_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("n_regionkey") == 0, "{}").when(F.col("n_regionkey") == 1, "{a,b,c}").otherwise(F.to_json(F.sequence(F.lit(1), F.col("n_regionkey"))))
    return _nations(spark, sf_dir).select("n_nationkey", pg.array_length(text).alias("n"))


def fn_array_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.to_json(F.sequence(F.lit(0), F.col("n_regionkey")))
    return _nations(spark, sf_dir).select("n_nationkey", pg.array_lower(text).alias("lower"), pg.array_upper(text).alias("upper"))


def fn_format_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nations(spark, sf_dir).select("n_nationkey", pg.format_type((F.col("n_nationkey") + 10).cast("long")).alias("type_name"))


def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.where(pg.json_contains('{"k": 42}', F.col("props"))).select("event_id", "user_id")


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources import sinks

    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    named = region.select("r_regionkey", "r_name", F.when(F.col("r_regionkey") > 1, F.col("r_name")).alias("maybe"))
    return sinks.json_rows(named).unionAll(sinks.json_rows(named, as_arrays=True))


def ndjson_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.sources import sinks

    return sinks.ndjson(spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("row_id", F.col("n_nationkey") + 1), "row_id", ["n_nationkey", "n_name"])


def info_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir)
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
    return engine.catalog.columns(names).select("table_name", "column_name", F.col("ordinal_position").cast("long").alias("ordinal_position"))


def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).table_stats(["nation", "orders", "events", "nothing"])[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _sql(x if isinstance(x, str) else x[0]) for name, x in SQL.items()} | {
    f.__name__: f
    for f in (
        param_query, agg_string_agg, join_range, unnest_zip, fn_array_to_string, fn_string_to_array, fn_regexp_replace, fn_quote_ident, fn_array_length, fn_array_bounds, fn_format_type,
        json_contains, json_rows, ndjson_events, info_columns, table_stats,
    )
}

ORACLES: dict[str, str] = {name: x if isinstance(x, str) else x[1] or x[0] for name, x in SQL.items()} | {
    "param_query": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (7, 8, 9) AND o_totalprice > 1000.5",
    "agg_string_agg": "SELECT n_regionkey, coalesce(string_agg(CASE WHEN n_nationkey % 4 <> 0 THEN n_name END, '; ' ORDER BY n_nationkey), '') AS names FROM nation GROUP BY n_regionkey",
    "join_range": "SELECT CAST(floor(o_totalprice / 50000) AS INTEGER) AS band, count(*) AS n FROM orders WHERE o_totalprice < 600000 GROUP BY 1",
    "unnest_zip": "SELECT n_nationkey, unnest([1, 2, 3]) AS value0, unnest(string_split(n_name, '')[1:5]) AS value1 FROM nation",
    "fn_array_to_string": "SELECT n_nationkey, CASE WHEN n_regionkey = 3 THEN '' ELSE n_name || '|x|' || n_regionkey END AS joined FROM nation",
    "fn_string_to_array": "SELECT n_nationkey, '[\"' || n_name || '\",\"b\",\"c\"]' AS parts, length(n_name) AS signs FROM nation",
    "fn_regexp_replace": "SELECT n_nationkey, regexp_replace(n_name, '([NT])', '<\\1>') AS first, regexp_replace(n_name, 'n', 'x', 'gi') AS every, n_name AS bad FROM nation",
    "fn_quote_ident": "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN '\"' || n_name || ' \"\"x\"\"\"' WHEN 1 THEN '\"select\"' WHEN 2 THEN '\"\"' WHEN 3 THEN '\"9' || n_name || '\"' ELSE n_name END AS quoted FROM nation",
    "fn_array_length": "SELECT n_nationkey, CAST(CASE n_regionkey WHEN 0 THEN 0 WHEN 1 THEN 3 ELSE n_regionkey END AS BIGINT) AS n FROM nation",
    "fn_array_bounds": "SELECT n_nationkey, CAST(1 AS BIGINT) AS lower, CAST(n_regionkey + 1 AS BIGINT) AS upper FROM nation",
    "fn_format_type": "SELECT n_nationkey, CASE n_nationkey + 10 WHEN 16 THEN 'boolean' WHEN 17 THEN 'bytea' WHEN 18 THEN '\"char\"' WHEN 19 THEN 'name' WHEN 20 THEN 'bigint' WHEN 21 THEN 'smallint' WHEN 23 THEN 'integer' WHEN 25 THEN 'text' WHEN 26 THEN 'oid' ELSE 'unknown' END AS type_name FROM nation",
    "json_contains": "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') = '42'",
    "json_rows": "WITH t AS (SELECT r_regionkey, r_name, CASE WHEN r_regionkey > 1 THEN r_name END AS maybe FROM region) SELECT CAST(to_json({'r_regionkey': r_regionkey, 'r_name': r_name, 'maybe': maybe}) AS VARCHAR) AS value FROM t UNION ALL SELECT CAST(json_array(r_regionkey, r_name, maybe) AS VARCHAR) FROM t",
    "ndjson_events": "SELECT '{\"row\":[' || (n_nationkey + 1) || ',[' || n_nationkey || ',\"' || n_name || '\"]]}' AS value FROM nation",
    "info_columns": "SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS ordinal_position FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events')",
    "table_stats": "SELECT 'nation' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events",
}
