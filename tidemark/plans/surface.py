"""What clients say to the engine in their own spelling: PostgreSQL's functions and catalog, the embedded engine's
functions, and statements that write. Each entry goes through Engine, with the oracle's spelling beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.engine.api import Engine
from tidemark.engine.catalog import FIRST_CONSTRAINT, FIRST_INDEX, FIRST_TABLE, KEYS

_KEYED = {t: k for t, k in KEYS.items() if k}


def _values(rows: list[tuple], names: str) -> str:
    """Literal rows for the oracle."""
    shown = ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {shown}) t({names})"


#: name: (statement, oracle).
SQL: dict[str, tuple[str, str]] = {
    "filter_like_any_case": (
        "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%O%WIDGET' AND p_type NOT LIKE 'promo'",
        "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%O%WIDGET' AND p_type NOT ILIKE 'promo'",
    ),
    "sql_json_object": (
        """SELECT json_object('targets', json_array(n_name || ':' || n_nationkey, n_regionkey), 'labels', json_object('path', JSON_EXTRACT('{"k": {"p": 7}}', '$.k'), 'none', NULL, 'up', n_nationkey > 3)) AS doc FROM nation""",
        """SELECT CAST(json_object('targets', json_array(n_name || ':' || n_nationkey, n_regionkey), 'labels', json_object('path', json('{"p":7}'), 'none', NULL, 'up', n_nationkey > 3)) AS VARCHAR) AS doc FROM nation""",
    ),
    "sql_json_extract": (
        "SELECT event_id, CAST(JSON_EXTRACT(props, '$.k') AS INTEGER) AS k, json_array_length(json_array(event_id, event_type)) AS n FROM events WHERE JSON_EXTRACT(props, '$.k') > 50",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 2 AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50",
    ),
    "sql_strftime": (
        "SELECT event_id, strftime('%Y-%m-%d %H:%M', ts) AS minute, CAST(strftime('%s', ts) AS INTEGER) AS secs, strftime('%s', 'now') > 0 AS later FROM events",
        "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS minute, CAST(floor(epoch(ts)) AS BIGINT) AS secs, true AS later FROM events",
    ),
    "sql_total": (
        "SELECT n_regionkey, total(n_nationkey) AS t, total(n_nationkey) FILTER (WHERE n_nationkey > 1000) AS none FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, CAST(sum(n_nationkey) AS DOUBLE) AS t, CAST(0 AS DOUBLE) AS none FROM nation GROUP BY n_regionkey",
    ),
    "sql_string_agg": (
        "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, group_concat(n_name, '+' ORDER BY n_nationkey) AS joined, string_agg(n_name, ',') FILTER (WHERE n_nationkey < 0) AS none FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name DESC) AS names, string_agg(n_name, '+' ORDER BY n_nationkey) AS joined, '' AS none FROM nation GROUP BY n_regionkey",
    ),
    "sql_division": (
        "SELECT o_orderkey, o_orderkey / 7 AS q, (o_orderkey - 50) / 7 AS back, 7 / 2 AS three, 7 / 2.0 AS half, o_orderkey / 2.0 > 1 AS big FROM orders",
        "SELECT o_orderkey, o_orderkey // 7 AS q, CAST(trunc((o_orderkey - 50) / 7) AS BIGINT) AS back, 3 AS three, CAST(3.5 AS DOUBLE) AS half, o_orderkey / 2.0 > 1 AS big FROM orders",
    ),
    "sql_scalar_max": (
        "SELECT n_nationkey, max(n_nationkey, 10) AS up, min(n_nationkey, n_regionkey, 3) AS low, max(nullif(n_regionkey, 1), 2) AS strict FROM nation",
        "SELECT n_nationkey, greatest(n_nationkey, 10) AS up, least(n_nationkey, n_regionkey, 3) AS low, CASE WHEN n_regionkey <> 1 THEN greatest(n_regionkey, 2) END AS strict FROM nation",
    ),
    "sql_is_values": (
        "SELECT n_nationkey, nullif(n_regionkey, 2) IS nullif(n_nationkey % 5, 2) AS same, nullif(n_regionkey, 1) IS NOT 3 AS other, n_name IS NOT NULL AS named FROM nation",
        "SELECT n_nationkey, nullif(n_regionkey, 2) IS NOT DISTINCT FROM nullif(n_nationkey % 5, 2) AS same, nullif(n_regionkey, 1) IS DISTINCT FROM 3 AS other, n_name IS NOT NULL AS named FROM nation",
    ),
    "sql_regexp_replace": (
        r"SELECT n_nationkey, regexp_replace(n_name, '([NT])', '<\1>') AS first, regexp_replace(n_name, 'n', 'x', 'gi') AS every, regexp_replace(n_name, '(', 'x') AS bad, regexp_replace(n_name, '_\d+$', '') AS head, regexp_replace(n_name, concat('[A', 'T]'), '-') AS made FROM nation",
        r"SELECT n_nationkey, regexp_replace(n_name, '([NT])', '<\1>') AS first, regexp_replace(n_name, 'n', 'x', 'gi') AS every, n_name AS bad, regexp_replace(n_name, '_\d+$', '') AS head, regexp_replace(n_name, '[AT]', '-') AS made FROM nation",
    ),
    "sql_arrays": (
        "SELECT n_nationkey, array_to_string('{' || n_name || ',x}', '|') AS joined, array_to_string(NULL, '|') AS nothing, string_to_array(n_name, '_') AS parts, array_length('{a,b,' || n_name || '}', 1) AS n, array_lower('[1]', 1) AS low, array_upper('[1, 2]', 1) AS up FROM nation",
        "SELECT n_nationkey, n_name || '|x' AS joined, '' AS nothing, CAST(to_json(string_split(n_name, '_')) AS VARCHAR) AS parts, CAST(3 AS BIGINT) AS n, CAST(1 AS BIGINT) AS low, CAST(2 AS BIGINT) AS up FROM nation",
    ),
    "sql_quote_ident": (
        "SELECT n_nationkey, quote_ident(n_name) AS plain, quote_ident(n_name || ' \"x\"') AS odd, quote_ident('select') AS word, quote_ident('') AS empty FROM nation",
        "SELECT n_nationkey, n_name AS plain, '\"' || n_name || ' \"\"x\"\"\"' AS odd, '\"select\"' AS word, '\"\"' AS empty FROM nation",
    ),
    "sql_parse_ident": (
        "SELECT n_nationkey, array_join(pg_catalog.parse_ident('A.\"' || n_name || '\"'), '/') AS parts FROM nation",
        "SELECT n_nationkey, 'a/' || n_name AS parts FROM nation",
    ),
    "sql_settings": (
        "SELECT pg_catalog.current_setting('TimeZone') AS tz, current_setting('no such') AS none, version() AS v, user, pg_catalog.format_type(25, -1) AS kind, format_type(7, NULL) AS unknown FROM region",
        "SELECT 'UTC' AS tz, '' AS none, 'PostgreSQL 14.0 (tidemark)' AS v, 'tidemark' AS user, 'text' AS kind, 'unknown' AS unknown FROM region",
    ),
    "sql_stubs": (
        "SELECT r_regionkey, col_description(1, 2) IS NULL AND obj_description(1) IS NULL AND pg_get_expr('x', 1) IS NULL AND pg_get_partkeydef(1) IS NULL AND pg_relation_size(1) IS NULL AND pg_stat_get_numscans(1) IS NULL AS nulls, "
        "pg_total_relation_size(1) + pg_table_size(1) + pg_indexes_size(1) + pg_my_temp_schema() AS zero, pg_is_other_temp_schema(1) AS other, pg_get_userbyid(10) AS owner FROM region",
        "SELECT r_regionkey, true AS nulls, CAST(0 AS BIGINT) AS zero, false AS other, 'postgres' AS owner FROM region",
    ),
    "sql_definitions": (
        "SELECT c.conname, pg_get_constraintdef(c.oid) AS def, pg_get_indexdef(c.conindid) AS idx, pg_get_indexdef(c.conindid, 1, true) AS again FROM pg_catalog.pg_constraint c",
        _values([(f"{t}_pkey", f"PRIMARY KEY ({', '.join(k)})", *[f"CREATE UNIQUE INDEX {t}_pkey ON {t} ({', '.join(k)})"] * 2) for t, k in sorted(_KEYED.items())], "conname, def, idx, again"),
    ),
    "sql_functions": (
        "SELECT proname, pg_get_functiondef(oid) AS def, pg_get_function_identity_arguments(oid) AS args FROM pg_proc WHERE proname IN ('abs', 'upper')",
        "SELECT * FROM (VALUES ('abs', 'CREATE OR REPLACE FUNCTION abs()', ''), ('upper', 'CREATE OR REPLACE FUNCTION upper()', '')) t(proname, def, args)",
    ),
    "sql_function_in_from": (
        "SELECT r.r_name, p.p, tz, joined FROM region r CROSS JOIN string_to_array('a.b', '.') AS p CROSS JOIN current_setting('TimeZone') AS tz CROSS JOIN array_to_string('{x,y}', '-') AS joined",
        "SELECT r_name, '[\"a\",\"b\"]' AS p, 'UTC' AS tz, 'x-y' AS joined FROM region",
    ),
    "sql_generate_series": (
        "SELECT generate_series AS i FROM generate_series(1, 9, 2) WHERE generate_series <> 5",
        "SELECT i FROM (VALUES (1), (3), (7), (9)) t(i)",
    ),
    "sql_keyword_alias": (
        "SELECT n_nationkey AS order, n_name AS user, n_regionkey AS \"group\" FROM nation AS select_ WHERE n_regionkey IS NOT NULL",
        "SELECT n_nationkey AS \"order\", n_name AS \"user\", n_regionkey AS \"group\" FROM nation",
    ),
    "catalog_tables": (
        "SELECT table_schema, table_name, table_type FROM information_schema.tables",
        _values([("main", t, "BASE TABLE") for t in sorted(KEYS)], "table_schema, table_name, table_type"),
    ),
    "catalog_columns": (
        "SELECT table_name, column_name, ordinal_position, is_nullable FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'conversations')",
        "SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position, CASE WHEN column_name IN ('r_regionkey', 'n_nationkey', 'conv_id', 'turn') THEN 'NO' ELSE 'YES' END AS is_nullable FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'conversations')",
    ),
    "catalog_keys": (
        "SELECT c.constraint_name, c.constraint_type, k.column_name, k.ordinal_position FROM information_schema.table_constraints c JOIN information_schema.key_column_usage k ON k.constraint_name = c.constraint_name",
        _values([(f"{t}_pkey", "PRIMARY KEY", c, n) for t, k in sorted(_KEYED.items()) for n, c in enumerate(k, 1)], "constraint_name, constraint_type, column_name, ordinal_position"),
    ),
    "catalog_classes": (
        "SELECT c.oid, c.relname, n.nspname, c.relkind, i.indexrelid, i.indisprimary, o.conname FROM pg_catalog.pg_class c JOIN pg_catalog.pg_namespace n ON n.oid = c.relnamespace LEFT JOIN pg_catalog.pg_index i ON i.indrelid = c.oid LEFT JOIN pg_catalog.pg_constraint o ON o.conrelid = c.oid",
        _values([(FIRST_TABLE + k, t, "main", "r", FIRST_TABLE + k + FIRST_INDEX if KEYS[t] else None, True if KEYS[t] else None, f"{t}_pkey" if KEYS[t] else None) for k, t in enumerate(sorted(KEYS))], "oid, relname, nspname, relkind, indexrelid, indisprimary, conname"),
    ),
    "catalog_attributes": (
        "SELECT c.relname, a.attname, a.attnum, t.typname FROM pg_attribute a JOIN pg_class c ON c.oid = a.attrelid JOIN pg_type t ON t.oid = a.atttypid WHERE c.relname IN ('region', 'nation') AND NOT a.attisdropped",
        "SELECT table_name AS relname, column_name AS attname, CAST(ordinal_position AS INTEGER) AS attnum, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'bigint' ELSE 'text' END AS typname FROM information_schema.columns WHERE table_name IN ('region', 'nation')",
    ),
    "catalog_constants": (
        "SELECT d.datname, a.amname, l.lanname FROM pg_database d CROSS JOIN pg_am a CROSS JOIN pg_language l",
        "SELECT 'main' AS datname, 'heap' AS amname, l AS lanname FROM (VALUES ('internal'), ('sql')) t(l)",
    ),
    "catalog_empty": (
        "SELECT (SELECT count(*) FROM information_schema.triggers) + (SELECT count(*) FROM pg_range WHERE rngtypid > 0) + (SELECT count(*) FROM pg_extension WHERE extname = 'x') + (SELECT count(*) FROM pg_statio_user_tables) + (SELECT count(description) FROM pg_description) "
        "+ (SELECT count(*) FROM pg_shdescription) + (SELECT count(adbin) FROM pg_attrdef) + (SELECT count(tgname) FROM pg_trigger) + (SELECT count(deptype) FROM pg_depend) + (SELECT count(inhparent) FROM pg_inherits) + (SELECT count(*) FROM pg_available_extensions) "
        "+ (SELECT count(*) FROM pg_conversion) + (SELECT count(opcname) FROM pg_opclass) + (SELECT count(opfname) FROM pg_opfamily) AS n",
        "SELECT CAST(0 AS BIGINT) AS n",
    ),
}


def _sql(statement: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine(spark, sf_dir).query(statement)


def typed_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bound lists with types, side by side."""
    return Engine(spark, sf_dir).query(["SELECT n.n_name, u.value1 AS tag FROM unnest(CAST($1 AS int8[]), CAST($2 AS text[])) AS u JOIN nation n ON n.n_nationkey = u.value0", [[1, 3, 5, 99], ["a", "b"]]])


def typed_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts bound to numbers: by the column that they are compared with, and after LIMIT."""
    return Engine(spark, sf_dir).query(["SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey <= $1 AND $2 < o_totalprice ORDER BY o_orderkey LIMIT $3 OFFSET $4", ["40", "1000.5", "9", "3"]])


def _after(spark: SparkSession, sf_dir: str, table: str, *statements: str | list) -> DataFrame:
    engine = Engine(spark, sf_dir)
    engine.execute(list(statements))
    return engine.query(f"SELECT * FROM {table}")


def write_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "nation", "INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (100, 'NEW', 1), (101, 'it''s', NULL)", "INSERT INTO nation SELECT n_nationkey + 200, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 2")


def write_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations moved on by 20: the keys that are there change if a condition holds, the others come in."""
    return _after(spark, sf_dir, "nation", "INSERT INTO nation SELECT n_nationkey + 20, n_name, n_regionkey FROM nation ON CONFLICT (n_nationkey) DO UPDATE SET n_name = excluded.n_name || '+' || n_name, n_regionkey = n_regionkey + 10 WHERE n_regionkey <> excluded.n_regionkey OR n_nationkey = 22")


def write_replace_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "region", "INSERT OR IGNORE INTO region (r_regionkey, r_name) VALUES (0, 'no'), (7, 'first'), (7, 'second')", "INSERT OR REPLACE INTO region (r_regionkey, r_name) VALUES (1, 'once'), (1, 'twice'), (8, 'eight')", "INSERT INTO region (r_regionkey, r_name) VALUES (2, 'no'), (9, 'nine') ON CONFLICT DO NOTHING")


def write_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "orders", ["UPDATE orders SET o_orderstatus = $1, o_custkey = o_custkey / 2 WHERE o_custkey % 7 = $2", ["X", 3]]).select("o_orderkey", "o_orderstatus", "o_custkey")


def write_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after(spark, sf_dir, "orders", "DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) OR o_orderstatus = 'F'").select("o_orderkey")


def write_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that a transaction's statements return, and how many each affected."""
    done = Engine(spark, sf_dir).execute([
        "UPDATE nation SET n_name = lower(n_name) WHERE n_regionkey = 1 RETURNING n_nationkey, n_name",
        "DELETE FROM nation WHERE n_name LIKE 'nation_1' OR n_regionkey = 3 RETURNING n_nationkey, n_name",
        "INSERT INTO nation (n_nationkey, n_name) VALUES (500, 'x') RETURNING n_nationkey + 1, n_name || '!'",
    ])
    rows = [(n, d["rows_affected"], r[0], r[1]) for n, d in enumerate(done) for r in d["rows"]]
    return spark.createDataFrame(rows, "step long, affected long, key long, name string")


def write_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list whose last statement fails changes nothing."""
    engine = Engine(spark, sf_dir)
    try:
        engine.execute(["DELETE FROM region WHERE r_regionkey > 2", "INSERT INTO region (r_regionkey, r_name) VALUES (1, 'there already')"])
    except ValueError:
        pass
    return engine.query("SELECT r_regionkey, r_name FROM region")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _sql(x[0]) for name, x in SQL.items()} | {
    f.__name__: f for f in (typed_unnest, typed_parameters, write_insert, write_conflict, write_replace_ignore, write_update, write_delete, write_returning, write_atomic)
}

ORACLES: dict[str, str] = {name: x[1] for name, x in SQL.items()} | {
    "typed_unnest": "SELECT n_name, t.tag FROM (VALUES (1, 'a'), (3, 'b'), (5, NULL)) t(k, tag) JOIN nation ON n_nationkey = t.k",
    "typed_parameters": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey <= 40 AND o_totalprice > 1000.5 ORDER BY o_orderkey LIMIT 9 OFFSET 3",
    "write_insert": "SELECT * FROM nation UNION ALL SELECT 100, 'NEW', 1 UNION ALL SELECT 101, 'it''s', NULL UNION ALL SELECT n_nationkey + 200, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 2",
    "write_conflict": """WITH e AS (SELECT n_nationkey + 20 AS k, n_name AS name, n_regionkey AS region FROM nation)
 SELECT n_nationkey, CASE WHEN k IS NOT NULL AND (n_regionkey <> region OR n_nationkey = 22) THEN name || '+' || n_name ELSE n_name END AS n_name, CASE WHEN k IS NOT NULL AND (n_regionkey <> region OR n_nationkey = 22) THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey
 FROM nation LEFT JOIN e ON k = n_nationkey UNION ALL SELECT k, name, region FROM e WHERE k NOT IN (SELECT n_nationkey FROM nation)""",
    "write_replace_ignore": "SELECT * FROM region WHERE r_regionkey <> 1 UNION ALL SELECT * FROM (VALUES (7, 'first'), (1, 'twice'), (8, 'eight'), (9, 'nine')) t(a, b)",
    "write_update": "SELECT o_orderkey, CASE WHEN o_custkey % 7 = 3 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey % 7 = 3 THEN o_custkey // 2 ELSE o_custkey END AS o_custkey FROM orders",
    "write_delete": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AND o_orderstatus <> 'F'",
    "write_returning": """WITH a AS (SELECT n_nationkey AS k, lower(n_name) AS n FROM nation WHERE n_regionkey = 1), s AS (SELECT n_nationkey AS k, n_regionkey AS r, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n FROM nation),
 b AS (SELECT k, n FROM s WHERE n ILIKE 'nation_1' OR r = 3)
 SELECT 0 AS step, (SELECT count(*) FROM a) AS affected, k AS key, n AS name FROM a UNION ALL SELECT 1, (SELECT count(*) FROM b), k, n FROM b UNION ALL SELECT 2, 1, 501, 'x!'""",
    "write_atomic": "SELECT r_regionkey, r_name FROM region",
}
