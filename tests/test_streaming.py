"""Live queries and notifications on streams."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.streaming.live import LiveQuery, guard_late

CELLS = T.StructType([T.StructField("name", T.StringType()), T.StructField("n", T.LongType())])


def test_live_query_follows_a_stream(spark, tmp_path):
    rng = random.Random(4)
    schema = "id long, name string, n long, deleted boolean, at long"
    live = LiveQuery(spark, f"file://{tmp_path}/live", ["id"], CELLS, "n >= 3")
    now, at = {}, 0
    for step in range(3):
        rows = []
        for _ in range(40):
            at += 1
            key, gone = rng.randrange(25), rng.random() < 0.2
            row = (key, rng.choice("xyz"), rng.randrange(8))
            rows.append((*row, gone, at))
            now.pop(key, None) if gone else now.__setitem__(key, row)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        query = live.start(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"))
        query.awaitTermination(120)
        assert query.exception() is None
        want = sorted(r for r in now.values() if r[2] >= 3)
        assert sorted((r.id, r.name, r.n) for r in live.rows().collect()) == want
    ids = [r.change_id for r in live.log().orderBy("change_id").collect()]
    assert ids == list(range(1, len(ids) + 1))
    held = live.rows().select("row_id").collect()
    assert len({r.row_id for r in held}) == len(held)
    assert live.catch_up(len(ids) - 3).count() == 3
    # A batch that runs again writes the same again.
    before = sorted(map(str, live.log().collect()))
    live.process(spark.read.schema(schema).parquet(f"file://{tmp_path}/in").where(F.col("at") > 80), 2)
    assert sorted(map(str, live.log().collect())) == before


def test_live_query_compacts_its_state_and_purges_its_log(spark, tmp_path):
    rng = random.Random(9)
    live = LiveQuery(spark, f"file://{tmp_path}/live", ["id"], CELLS, "n >= 2", every=2, keeps=6)
    now, whole, frames = {}, {}, []
    for n in range(7):
        rows = []
        for at in range(8):
            key, gone = rng.randrange(12), rng.random() < 0.3
            row = (key, rng.choice("xyz"), rng.randrange(8))
            rows.append((*row, gone, n * 8 + at))
            now.pop(key, None) if gone else now.__setitem__(key, row)
        frames.append(spark.createDataFrame(rows, "id long, name string, n long, deleted boolean, at long"))
        live.process(frames[-1], n)
        whole |= {r.change_id: str(r) for r in live.log().collect()}
        assert sorted((r.id, r.name, r.n) for r in live.rows().collect()) == sorted(r for r in now.values() if r[2] >= 2)
    assert live._batches("state") == [3, 5] and live._batches("log")[0] > 0  # early events are gone
    assert sorted(whole) == list(range(1, max(whole) + 1))
    newest = max(whole)
    assert [r.change_id for r in live.catch_up(newest - 6).collect()] == list(range(newest - 5, newest + 1))
    with pytest.raises(LookupError):
        live.catch_up(0)
    # The batch of the last state, and the one after it, run again: the same events and rows.
    for n in (5, 6):
        live.process(frames[n], n)
    assert all(whole[r.change_id] == str(r) for r in live.log().collect())
    assert sorted((r.id, r.name, r.n) for r in live.rows().collect()) == sorted(r for r in now.values() if r[2] >= 2)


def test_late_notifications_are_dropped(spark, tmp_path):
    rows = [(1, 1, 1), (1, 2, 2), (1, 1, 3), (1, 3, 4), (2, 1, 5), (2, 1, 6)]
    spark.createDataFrame(rows, "pk long, cl long, at long").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    notes = spark.readStream.schema("pk long, cl long, at long").parquet(f"file://{tmp_path}/in")
    query = guard_late(notes).writeStream.format("memory").queryName("kept").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("kept").collect())) == [(1, 1, 1), (1, 2, 2), (1, 3, 4), (2, 1, 5), (2, 1, 6)]
