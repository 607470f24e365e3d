"""Operators on small literal cases."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions import pg
from tidemark.operators import changes, ingest, metrics, ranges, schema, sync
from tidemark.operators import subscriptions as sub
from tidemark.plans import dialect
from tidemark.sources import sinks, tables


def spans(df):
    return sorted((r.start, r.end) for r in df.collect())


@pytest.fixture(scope="module")
def frame(spark):
    def make(rows, names="actor long, start long, end long"):
        return spark.createDataFrame(rows, names)

    return make


STEPS = [
    ([(5, 20)], [(1, 4)]), ([(6, 7)], [(1, 4)]), ([(3, 7)], [(1, 2)]), ([(1, 2)], []), ([(25, 25)], [(21, 24)]), ([(30, 35)], [(21, 24), (26, 29)]), ([(19, 22)], [(23, 24), (26, 29)]),
    ([(24, 25)], [(23, 23), (26, 29)]), ([(23, 27)], [(28, 29)]), ([(1, 10)], [(28, 29)]), ([(27, 30)], []), ([(40, 45), (50, 55), (38, 47)], [(36, 37), (48, 49)]),
]


def test_gaps_step_by_step(frame):
    applied = []
    for more, want in STEPS:
        applied += [(1, *x) for x in more]
        random.Random(len(applied)).shuffle(applied)
        assert spans(ranges.gaps(frame(applied + applied[:2]), ["actor"])) == want


def test_range_algebra_against_sets(frame):
    rng = random.Random(7)

    def some():
        return [(n % 2, s, s + rng.randrange(-1, 6)) for n in range(12) for s in [rng.randrange(1, 40)]]

    def numbers(rows):
        return {(r[0], x) for r in rows for x in range(r[1], r[2] + 1)}

    for _ in range(4):
        a, b = some(), some()
        for op, want in ((ranges.intersect, numbers(a) & numbers(b)), (ranges.subtract, numbers(a) - numbers(b)), (ranges.union, numbers(a) | numbers(b))):
            got = [(r.actor, r.start, r.end) for r in op(frame(a), frame(b), ["actor"]).collect()]
            assert numbers(got) == want and len(numbers(got)) == sum(e - s + 1 for _, s, e in got)
    assert ranges.total(frame([])).first()[0] == 0


def test_chunks_share_a_number(frame):
    assert spans(ranges.chunks(frame([(1, 1, 10), (1, 20, 20)]), 4)) == [(1, 5), (5, 9), (9, 10), (20, 20)]


def needs(spark, ours, our_partial, theirs, their_partial):
    names, partial = "actor long, start long, end long", "actor long, version long, start long, end long, last_seq long"
    mine = sync.sync_state(spark.createDataFrame(ours, names), spark.createDataFrame(our_partial, partial))
    peer = sync.sync_state(spark.createDataFrame(theirs, names), spark.createDataFrame(their_partial, partial))
    return sorted((r.kind, r.v_start, r.v_end, r.s_start, r.s_end) for r in sync.available_needs(mine, peer).collect())


def test_available_needs(spark):
    beyond = ("full", 11, 13, None, None)
    assert needs(spark, [(1, 1, 10)], [], [(1, 1, 13)], []) == [beyond]
    ours = [(1, 1, 1), (1, 6, 6), (1, 8, 10)]
    assert needs(spark, ours, [], [(1, 1, 13)], []) == [("full", 2, 5, None, None), ("full", 7, 7, None, None), beyond]
    held = [(1, 9, 0, 99, 140), (1, 9, 121, 129, 140), (1, 9, 133, 140, 140)]  # seqs 100-120 and 130-132 are missing
    got = needs(spark, ours, held, [(1, 1, 13)], [])
    assert [x for x in got if x[0] == "partial"] == [("partial", 9, 9, 100, 120), ("partial", 9, 9, 130, 132)]
    peer = [(1, 9, 0, 99, 140), (1, 9, 111, 129, 140), (1, 9, 131, 140, 140)]  # 100-110 and 130 are missing there
    got = needs(spark, ours, held, [(1, 1, 8), (1, 10, 13)], peer)
    assert [x for x in got if x[0] == "partial"] == [("partial", 9, 9, 111, 120), ("partial", 9, 9, 131, 132)]


def chunked(spark, seqs, last, most, size=10):
    df = spark.createDataFrame([(1, 1, s, last, size) for s in seqs], "site_id long, db_version long, seq long, last_seq long, size long")
    return sorted((r.start_seq, r.end_seq, r.n) for r in changes.chunk_changes(df, most).collect())


def test_chunks_of_changes(spark):
    assert chunked(spark, [0, 1, 2], 100, 20) == [(0, 1, 2), (2, 100, 1)]
    assert chunked(spark, [0, 1], 1, 10) == [(0, 0, 1), (1, 1, 1)]
    assert chunked(spark, [0, 2], 100, 1000) == [(0, 100, 2)]
    assert chunked(spark, [2, 4, 7, 8], 100, 100_000) == [(0, 100, 4)]
    assert chunked(spark, [2, 4, 7, 8], 10, 20) == [(0, 4, 2), (5, 8, 2), (9, 10, 0)]


def test_merge_is_the_same_in_any_order(spark):
    rng = random.Random(3)
    rows = [("t", rng.randrange(4), rng.choice("ab"), rng.choice(["started", "destroyed", None, "x"]), rng.randrange(1, 4), rng.randrange(3)) for _ in range(80)]
    names = "tbl string, pk long, cid string, val string, col_version long, site_id long"
    seen = set()
    for _ in range(3):
        rng.shuffle(rows)
        got = changes.lww_merge(spark.createDataFrame(rows + rows[:20], names).repartition(5))
        seen.add(str(sorted(map(str, got.collect()))))
    assert len(seen) == 1
    tie = spark.createDataFrame([("t", 1, "s", "started", 2, 1), ("t", 1, "s", "destroyed", 2, 9)], names)
    assert changes.lww_merge(tie).first().val == "started"


def test_numbers_are_gapless(spark):
    df = spark.range(5000).selectExpr("id % 7 AS g", "id * 3 AS k", "concat('k', id) AS s")
    for order in (["g", "k"], ["s"], ["k"]):
        rows = changes.with_numbers(df, order, "n").orderBy(*order).select("n").collect()
        assert [r.n for r in rows] == list(range(1, 5001))
    assert changes.with_numbers(df.limit(0), ["k"], "n").count() == 0


def test_replayed_log_equals_the_query(spark):
    rng = random.Random(9)
    names = "id long, a string, b long"

    def state():
        return spark.createDataFrame([(n, rng.choice([None, "x", "y"]), rng.randrange(3)) for n in range(60) if rng.random() < 0.7], names)

    states = [state() for _ in range(3)]
    rows, last = sub.initial(states[0], ["id"]), 0
    for new in states[1:]:
        events = sub.changes(rows, new, ["id"], last).cache()
        ids = sorted(r.change_id for r in events.collect())
        assert ids == list(range(last + 1, last + 1 + len(ids)))
        last = ids[-1]
        rows = sub.applied(rows, events, ["id"]).cache()
        assert sorted(map(tuple, rows.drop("row_id").collect()), key=str) == sorted(map(tuple, new.collect()), key=str)
    log = spark.range(1, 1001).select(F.col("id").alias("change_id"))
    assert sub.purge(log).count() == 501
    with pytest.raises(LookupError):
        sub.catch_up(sub.purge(log), 10)
    assert sub.breaks(log, 100).count() == 0


CONTAINS = [("{}", "{}", True), ("{}", '{"key":"value"}', True), ('{"key":"value"}', "{}", False), ('{"key":"value"}', '{"key":"value"}', True), ('{"key":"value"}', '{"key":"value","key2":"value2"}', True),
            ('{"key":"value"}', '{"key":"wrong value"}', False), ('{"metadata":{"key":"value"}}', '{"metadata":{"key":"value"}}', True), ('{"metadata":{"key":"value"}}', '{"metadata":{"key":"wrong value"}}', False)]


def test_json_contains(spark):
    rows = spark.createDataFrame(CONTAINS, "s string, o string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", pg.json_contains_any("s", "o").alias("got")).collect())
    for s, o, want in CONTAINS:
        assert spark.createDataFrame([(o,)], "o string").select(pg.json_contains(s, F.col("o"))).first()[0] == want


def test_pg_functions(spark):
    one = spark.range(1)
    row = one.select(
        pg.regexp_replace(F.lit("a.b\na.b"), "A\\.", "<\\0>", "i").alias("first"), pg.array_length(F.lit("{a,b}")).alias("n"), pg.array_length(F.lit("[]")).alias("none"), pg.quote_ident(F.lit("Tab le")).alias("q"),
        pg.subscript(F.lit('["x","y"]'), 2).alias("second"), pg.string_to_json_array(F.lit("a|b"), "|").alias("parts"), pg.current_setting("TimeZone").alias("tz"),
    ).first()
    assert (row["n"], row.none, row.q, row.second, row.parts, row.tz) == (2, 0, '"Tab le"', "y", '["a","b"]', "UTC")
    assert pg.parse_ident('a."B.c".D') == ["a", "B.c", "d"]
    zipped = one.select(pg.unnest(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, "abcdef")))).collect()
    assert len(zipped) == 6 and [r.value0 for r in zipped[3:]] == [None] * 3
    pg.register(spark)
    assert spark.sql("SELECT array_to_string('{a,b}', '-') AS x, string_to_array('a.b', '.') AS y").first() == ("a-b", ["a", "b"])


def test_dialect(spark, sf_dir):
    assert dialect.rewrite("SELECT pg_catalog.version(), a[2], 'a[1]::int', x.y[1]::int8 -- done") == "SELECT version(), try_element_at(a, 2), 'a[1]::int', try_element_at(x.y, 1)::BIGINT"
    assert dialect.rewrite('SELECT "Odd ""x" FROM t INDEXED BY i WHERE b LIKE ?1') == 'SELECT `Odd "x` FROM t  WHERE b ILIKE :p1'
    assert dialect.normal("select  A,\n'B c' ;") == "select a , 'B c'"
    for bad in ("", "SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            dialect.normal(bad)
    with pytest.raises(PermissionError):
        Engine(spark, sf_dir).query("DELETE FROM nation")
    assert dialect.tag("with x as (select 1) select * from x") == "SELECT" and dialect.tag("insert into t values (1)") == "INSERT"
    engine = Engine(spark, sf_dir)
    lines = list(engine.events(["SELECT r_regionkey, r_name FROM region WHERE r_regionkey < ? ORDER BY 1", [2]]))
    assert lines[0] == '{"columns": ["r_regionkey", "r_name"]}' and lines[1].startswith('{"row": [1, [0, ') and '"eoq"' in lines[-1] and len(lines) == 4
    assert engine.table_stats(["nation", "nothing"])[1] == ["nothing"]
    assert engine.catalog.repeated_keys("orders").count() == 0
    assert engine.catalog.system_views()["pg_class"].count() == 14
    assert "Scan parquet" in engine.explain("SELECT * FROM nation")


def test_schema_parse_compare_and_evolve(spark):
    old = schema.parse("CREATE TABLE t (id INTEGER NOT NULL PRIMARY KEY, body TEXT NOT NULL DEFAULT '', n POINT, x ANY, j JSON); CREATE INDEX i ON t (body);")
    kinds = {f.name: f.dataType.simpleString() for f in old["t"].schema}
    assert kinds == {"id": "bigint", "body": "string", "n": "bigint", "x": "double", "j": "string"} and old["t"].key == ("id",) and old["t"].indexes == {"i": ("body",)}
    new = schema.parse("CREATE TABLE t (id INTEGER NOT NULL PRIMARY KEY, body TEXT NOT NULL DEFAULT '', n POINT, x ANY, j JSON, extra INT DEFAULT 4, up TEXT AS (upper(body))); CREATE TABLE u (a BLOB, b TEXT, PRIMARY KEY (a, b));")
    diff = schema.compare(old, new)
    assert diff.tables == ["u"] and diff.columns == {"t": ["extra", "up"]} and diff.dropped_indexes["t"] == ["i"]
    row = schema.evolve(spark.createDataFrame([(1, "a", 2, 0.5, "{}")], "id long, body string, n long, x double, j string"), new["t"]).first()
    assert (row.extra, row.up) == (4, "A")
    for sql in ("CREATE TABLE t (a TEXT NOT NULL, id INT PRIMARY KEY)", "CREATE TABLE t (id INT PRIMARY KEY, o INT REFERENCES x)", "CREATE TABLE t AS SELECT 1", "DROP TABLE t", "CREATE TABLE t (a INT)",
                "CREATE TABLE t (a INT PRIMARY KEY); CREATE UNIQUE INDEX i ON t (a)", "CREATE TABLE t (a INT PRIMARY KEY); CREATE INDEX i ON t (a); DROP INDEX IF EXISTS i", "CREATE TABLE t (a INT, PRIMARY KEY (a + 1, (a)))"):
        with pytest.raises(schema.SchemaError):
            schema.parse(sql)
    for sql in ("CREATE TABLE u (a INT PRIMARY KEY)", "CREATE TABLE t (id INTEGER NOT NULL PRIMARY KEY)", "CREATE TABLE t (id TEXT NOT NULL PRIMARY KEY, body TEXT NOT NULL DEFAULT '', n POINT, x ANY, j JSON)"):
        with pytest.raises(schema.SchemaError):
            schema.compare(old, schema.parse(sql))


def test_metrics(spark):
    bounds = (0.1, 0.5, 1.0, 5.0, 10.0)
    df = spark.createDataFrame([(x,) for x in (0.05, 0.3, 0.7, 2.0, 15.0)], "v double")
    assert [r.n for r in metrics.bucket_counts(df, "v", bounds).orderBy("bucket").collect()] == [1, 1, 1, 1, 0, 1]
    many = metrics.bucket_counts(spark.range(1, 101).selectExpr("id / 100 AS v"), "v", (0.1, 0.25, 0.5, 1.0))
    assert 0.4 < metrics.quantile(many, 0.5, (0.1, 0.25, 0.5, 1.0)).first()[0] < 0.6 and 0.9 < metrics.quantile(many, 0.99, (0.1, 0.25, 0.5, 1.0)).first()[0] <= 1.0
    assert metrics.quantile(many, 1.5, (0.1, 0.25, 0.5, 1.0)).first()[0] is None
    assert metrics.quantile(metrics.bucket_counts(df.limit(0), "v", bounds), 0.5, bounds).first()[0] is None
    a, b = (metrics.bucket_counts(spark.createDataFrame([(x,) for x in v], "v double"), "v", (1.0, 5.0, 10.0)) for v in ((0.5, 3.0), (0.7, 7.0)))
    assert [r.n for r in metrics.merge(a, b).orderBy("bucket").collect()] == [2, 1, 1, 0]
    # A first sample puts the ring in place, the second may move it by one.
    place = {0: 1.0, 1: 10.0, 2: 20.0}
    for ring, rtt, want in ((0, 7, 0), (0, 8, 1), (1, 5, 1), (1, 4, 0), (1, 16, 1), (1, 17, 2), (2, 14, 2), (2, 13, 1)):
        got = spark.range(1).select(metrics.ring_steps(F.array(F.lit(place[ring]), F.lit(float(rtt))))).first()[0]
        assert got == want, (ring, rtt)
    assert metrics.healthy(100, 20_000, 2.0) and not metrics.healthy(101, 0, 0) and not metrics.healthy(0, 20_000, 3.5)


def test_ingest(spark):
    assert [ingest.duration(x) for x in ("30s", "5m", "2h", "14d", "1w", "1y")] == [30, 300, 7200, 1209600, 604800, 31536000]
    for bad in ("", "5", "5x", "1h30m"):
        with pytest.raises(ValueError):
            ingest.duration(bad)
    a = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "id long, v string")
    b = spark.createDataFrame([(1, ""), (2, ""), (4, "y")], "id long, v string")
    assert sorted(map(tuple, ingest.hash_diff(a, b, "id", ["v"]).collect())) == [(1, "upsert"), (3, "delete"), (4, "upsert")]


def test_sinks_and_snapshots(spark, tmp_path):
    df = spark.createDataFrame([(1, None, bytearray(b"\x01\xff"), "a,\"b\""), (2, 1.5, None, "é")], "id long, x double, b binary, s string")
    sinks.write_csv(df, f"file://{tmp_path}/csv", one_file=True)
    lines = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*")).splitlines()
    assert lines[0] == "id,x,b,s" and lines[1] == '1,,01ff,"a,""b"""'
    sinks.write_csv(df.limit(0), f"file://{tmp_path}/none")
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")) == "id,x,b,s\n"
    assert sinks.json_document(df.select("id", "x", "s")) == '[{"id": 1, "x": null, "s": "a,\\"b\\""}, {"id": 2, "x": 1.5, "s": "é"}]'
    assert sinks.json_document(df.select("id", "x", "s"), as_arrays=True) == '[[1, null, "a,\\"b\\""], [2, 1.5, "é"]]'
    tables.backup({"t": df.withColumn("site_id", F.lit(4))}, f"file://{tmp_path}/backup")
    assert tables.restore(spark, f"file://{tmp_path}/backup", ["t"])["t"].columns == ["id", "x", "b", "s"]
    (tmp_path / "b.sql").write_text("B")
    (tmp_path / "a.sql").write_text("A")
    assert tables.sql_files([str(tmp_path)]) == ["A", "B"]


def test_engines_of_two_folders_see_their_own_tables(spark):
    small, large = Engine(spark, "/root/testdata/sf0.001"), Engine(spark, "/root/testdata/sf0.01")
    count = "SELECT count(*) FROM orders"
    late = small.query(count)
    assert [e.query(count).first()[0] for e in (small, large, small)] == [1500, 15000, 1500] and late.first()[0] == 1500


def test_only_statements_that_read_are_let_through(spark, sf_dir):
    for sql in ("WITH x AS (SELECT 1) INSERT INTO nation SELECT * FROM x", "EXPLAIN INSERT INTO nation VALUES (1)", "EXPLAIN EXTENDED WITH x AS (SELECT 1) DELETE FROM nation", "FROM nation INSERT INTO region SELECT 1, 'x'",
                "WITH a AS (DELETE FROM nation) SELECT 1", "UPDATE nation SET n_name = ''", "DROP TABLE nation", "SELECT 1; DELETE FROM nation", "SET x = 1", ""):
        with pytest.raises((PermissionError, ValueError)):
            Engine(spark, sf_dir).query(sql)
    assert Engine(spark, sf_dir).query("WITH insert_ AS (SELECT 1 AS a) SELECT a FROM insert_").first()[0] == 1
    assert dialect.tag("WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x") == "INSERT" and dialect.tag("WITH x AS (SELECT 1) SELECT 1") == "SELECT"


def test_a_query_ends_with_the_timeout(spark, sf_dir):
    with pytest.raises(TimeoutError):
        Engine(spark, sf_dir, timeout=1.0).collect("SELECT count(*) FROM range(10000000000000) WHERE id % 7 = 3")
    assert Engine(spark, sf_dir, timeout=60.0).collect("SELECT 1 AS x")[0].x == 1


def test_rows_that_came_back_are_not_reaped(spark):
    names = "tbl string, pk long, cid string, cl long, ts timestamp_ntz"
    rows = [("t", 1, "-1", 2, "2024-01-01"), ("t", 2, "-1", 2, "2024-01-01"), ("t", 2, "a", 3, "2024-01-02"), ("t", 3, "-1", 2, "2024-01-01"), ("t", 3, "-1", 4, "2024-03-01"), ("t", 4, "-1", 2, "2024-01-03"), ("t", 4, "-1", 2, "2024-01-01"), ("t", 5, "a", 1, "2024-01-01")]
    log = spark.createDataFrame([(*r[:4], __import__("datetime").datetime.fromisoformat(r[4])) for r in rows], names)
    got = ingest.reapable(log, F.lit("2024-02-20").cast("timestamp_ntz"), "2w")
    assert [r.pk for r in got.collect()] == [1, 4]
    assert [r.pk for r in ingest.reapable(log, F.lit("2024-02-20").cast("timestamp_ntz"), "2w", limit=1).collect()] == [1]
    assert {r.pk for r in ingest.reap(log, got).collect()} == {2, 3, 5}


def test_writes_are_refused_with_reasons(spark, sf_dir):
    engine = Engine(spark, sf_dir)
    for sql in ("INSERT INTO region (r_regionkey, r_name) VALUES (50, 'a'), (50, 'b')", "INSERT INTO region (r_name) VALUES ('no key')", "UPDATE region SET r_regionkey = 1", "INSERT INTO region (nothing) VALUES (1)",
                "INSERT INTO region (r_regionkey) VALUES (1) ON CONFLICT (r_name) DO NOTHING", "SELECT 1", "DELETE region", "UPDATE region"):
        with pytest.raises((ValueError, IndexError)):
            engine.execute([sql])
    with pytest.raises(LookupError):
        engine.execute(["DELETE FROM nowhere"])
    assert engine.query("SELECT count(*) FROM region").first()[0] == 5
    assert engine.execute(["DELETE FROM region WHERE r_name IS NULL", "UPDATE region SET r_name = NULL WHERE r_regionkey = 2"])[1]["rows_affected"] == 1
    assert engine.query("SELECT r_regionkey FROM region WHERE r_name IS NULL").first()[0] == 2
    assert Engine(spark, sf_dir).query("SELECT count(r_name) FROM region").first()[0] == 5


def test_no_task_numbers_more_than_its_share(spark, monkeypatch):
    seen = {}
    row_number = F.row_number
    df = spark.range(40_000).selectExpr("id % 2 AS late", "to_json(named_struct('tenant', 'same', 'n', id)) AS pk", "CAST(NULL AS STRING) AS nothing")
    monkeypatch.setattr(changes.F, "row_number", lambda: seen.setdefault("n", row_number()))
    out = changes.with_numbers(df, ["late", "nothing", "pk"], "n")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "_bucket" in plan and out.orderBy("late", "pk").select("n").limit(3).collect() == [(1,), (2,), (3,)]
    monkeypatch.undo()
    # The same bounds, counted by bucket.
    dealt = {}
    drop = type(out).drop
    monkeypatch.setattr(type(out), "drop", lambda self, *c: dealt.setdefault("rows", self) if "_bucket" in c else drop(self, *c))
    changes.with_numbers(df, ["late", "nothing", "pk"], "n")
    monkeypatch.undo()
    sizes = [r["count"] for r in dealt["rows"].groupBy("_bucket").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 40_000 / 20


def test_apply_batches_follow_the_queue():
    assert [changes.next_batch_cost(c) for c in (0, 500, 999, 1000, 2100, 8000, 10**6)] == [500, 500, 500, 1000, 2000, 8000, 16_000]
    assert changes.next_batch_cost(10, step=50) == 100
    assert [changes.after_interrupt(x) for x in (16_000, 150, 100)] == [8000, 100, 100]
    assert changes.next_batch([(60, "a"), (50, "b"), (1, "c")], 100) == (["a"], [(50, "b"), (1, "c")])
    assert changes.next_batch([(600, "a")], 100) == (["a"], []) and changes.next_batch([], 100) == ([], [])


def test_buffered_rows_of_applied_versions_go_and_ranges_have_one_peer(spark):
    names = "site_id long, db_version long, seq long"
    held = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 1, 0)], names)
    assert sorted(map(tuple, changes.without_applied(held, held.where("site_id = 1 AND db_version = 1")).collect())) == [(1, 2, 0), (2, 1, 0)]
    offers = spark.createDataFrame([(1, 1, 5, "b"), (1, 1, 5, "a"), (1, 6, 9, "b"), (2, 1, 5, "c")], "actor long, start long, end long, peer string")
    assert sorted(map(tuple, sync.one_peer_per_range(offers).collect())) == [(1, 1, 5, "a"), (1, 6, 9, "b"), (2, 1, 5, "c")]
    tagged = spark.createDataFrame([("t", 1, "c", 1, (4, None, None, "b", None), 1), ("t", 1, "c", 1, (1, 9, None, None, None), 2), ("t", 1, "c", 1, (3, None, None, "a", None), 0)], "tbl string, pk long, cid string, col_version long, val struct<t: int, i: long, r: double, s: string, b: string>, site_id long")
    assert changes.lww_merge(tagged, changes.storage_order(F.col("val"))).first().val.b is None


def test_lineage_of_a_join():
    from tidemark.plans import lineage

    schemas = {"a": ["id", "x", "y"], "b": ["id", "a_id", "z"], "c": ["k", "x"]}
    sql = "SELECT p.x, b.* FROM a AS p LEFT JOIN b ON b.a_id = p.id INDEXED BY i WHERE z > 3 AND p.id IN (SELECT k FROM c)"
    assert [(s.table, s.alias) for s in lineage.sources(sql)] == [("a", "p"), ("b", "b")]
    used = lineage.columns_used(sql, schemas)
    assert used == {"a": {"x", "id"}, "b": {"id", "a_id", "z"}}
    keyed, names = lineage.with_keys(sql, {"a": ("id",), "b": ("id", "a_id")})
    assert names == ["__key_p_id", "__key_b_id", "__key_b_a_id"] and keyed.startswith("SELECT p.id AS __key_p_id, b.id AS __key_b_id")
    assert "LEFT" not in lineage.narrowed(sql, "b") and "LEFT" in lineage.narrowed(sql, "p")
    for bad in ("SELECT 1", "SELECT x FROM a; SELECT 1", "DELETE FROM a", "SELECT x FROM (SELECT 1) t", "SELECT x FROM a UNION SELECT x FROM c", "SELECT p.x FROM a p JOIN c p ON true", "SELECT x FROM a JOIN c ON true", "SELECT z FROM nowhere", "SELECT y FROM a WHERE id IN b"):
        with pytest.raises(lineage.NotSupported):
            lineage.columns_used(bad, schemas)


def test_ranges_of_one_key_are_swept_in_blocks(spark, monkeypatch):
    """With blocks of 16 numbers, results stay and no window but that of the blocks' sums holds a large part of the key."""
    monkeypatch.setattr(ranges, "BLOCK_BITS", 4)
    rng = random.Random(11)
    schema = "actor long, start long, end long"
    for _ in range(2):
        a, b = ([(k, s, s + rng.choice([0, 1, 2, 40, 90])) for k in (1, None) for s in rng.choices(range(-50, 400), k=n)] for n in (30, 12))
        numbers = [{(k, v) for k, s, e in x for v in range(s, e + 1)} for x in (a, b)]
        left, right = (spark.createDataFrame(x, schema) for x in (a, b))
        for got, want in (
            (ranges.coalesce(left, ["actor"]), numbers[0]), (ranges.intersect(left, right, ["actor"]), numbers[0] & numbers[1]), (ranges.subtract(left, right, ["actor"]), numbers[0] - numbers[1]),
            (ranges.coalesce(left, ["actor"], blocked=False), numbers[0]), (ranges.subtract(left, right, ["actor"], blocked=False), numbers[0] - numbers[1]),
            (ranges.gaps(left, ["actor"], 7), {(k, v) for k in (1, None) for v in range(7, max(n for j, n in numbers[0] if j == k) + 1)} - numbers[0]),
        ):
            rows = [tuple(r) for r in got.select("actor", "start", "end").collect()]
            held = [(k, v) for k, s, e in rows for v in range(s, e + 1)]
            assert len(held) == len(set(held)) and set(held) == want
            assert not {(k, e + 1) for k, _, e in rows} & {(k, s) for k, s, _ in rows}  # runs are the longest
        asked = [(k, rng.choice([None, *range(-60, 420)]), i) for k in (1, 2, None) for i in range(60)]
        inside = ranges.containing(spark.createDataFrame(asked, "actor long, version long, at long"), left, ["actor"], "version")
        assert sorted(map(str, inside.select("actor", "version", "at", "inside").collect())) == sorted(str(Row(actor=k, version=v, at=i, inside=v is not None and (k, v) in numbers[0])) for k, v, i in asked)
    wide = spark.range(4000).selectExpr("1L AS actor", "id * 2 AS start", "id * 2 AS end")
    parts = ranges._running(ranges._ends(wide, ["actor"], a=True).withColumn("_kind", F.lit(0)), ["actor"], ["da"])
    assert parts.groupBy("_block").count().agg(F.max("count")).first()[0] <= 32
    assert ranges.gaps(wide, ["actor"], 0).count() == 3999
