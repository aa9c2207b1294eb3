"""Timers on a stream against the same rows from a whole table, out of order and with restarts."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.streaming import timers

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = 2_000_000


@pytest.fixture()
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def streamed(spark, rows, schema, work, tmp_path, parts, restarts):
    """Rows in ``parts`` batches, with the query stopped and started anew between them."""
    columns = [c.split()[0] for c in schema.split(", ")][:-1]
    table = lambda some: spark.createDataFrame(some, schema).selectExpr(*columns, "timestamp_seconds(s) AS ts")
    kind, size = table(rows[:1]).schema, -(-len(rows) // parts)
    out = tmp_path / "out"
    for k in range(parts):
        table(rows[k * size : (k + 1) * size]).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k:03d}"))
        if k % restarts == restarts - 1 or k == parts - 1:
            stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
            query = work(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(out)).collect()))


def shuffled(rng, rows, reach=300):
    """Rows in the order of their times give or take ``reach`` seconds, then one that moves the watermark beyond all."""
    return [r for _, r in sorted((r[-1] + rng.uniform(0, reach), r) for r in rows)]


def test_attempts_on_a_stream_equal_the_whole_table(rocks, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        begin = rng.randrange(0, 6000)
        if i % 7:
            rows.append((i, "begin", begin))
        if i % 3:
            rows.append((i, "end", begin + rng.choice([0, 5, 59, 60, 61, 599, 600, 601, 900, -20])))
    rows = [r for r in rows if r[2] >= 0]
    tail = [(-1, "begin", LAST), (-2, "begin", LAST + 5000), (-3, "begin", LAST + 9000)]
    schema = "id long, kind string, s long"
    got = streamed(rocks, shuffled(rng, rows) + tail, schema, timers.attempt_events_stream, tmp_path, 8, 3)
    table = rocks.createDataFrame(rows, schema).selectExpr("id", "kind", "timestamp_seconds(s) AS ts")
    want = sorted(map(tuple, timers.attempt_events(table).collect()))
    assert [r for r in got if r[0] >= 0] == want and {r[1] for r in want} == {"stalled", "done", "failed"}


def test_late_rows_count_for_nothing(rocks, tmp_path):
    rows = [(1, "begin", 100), (9, "begin", 5000), (9, "begin", 5001), (1, "end", 120), (9, "begin", 90000), (9, "begin", 90001)]
    got = streamed(rocks, rows, "id long, kind string, s long", timers.attempt_events_stream, tmp_path, 6, 6)
    assert {r[1] for r in got if r[0] == 1} == {"stalled", "failed"}  # the end came after the watermark had passed it


def test_expiries_on_a_stream_equal_the_whole_table(rocks, tmp_path):
    rng = random.Random(6)
    rows = []
    for job in range(40):
        done = rng.randrange(1000, 6000)
        if job % 6:
            rows.append((job, "done", None, done))
        for d in range(rng.randrange(3)):
            begin = done + rng.choice([-500, 0, 500, 600, 601])
            rows.append((job, "begin", d, begin))
            if rng.random() < 0.7:
                rows.append((job, "finish", d, begin + rng.choice([10, 99, 100, 101, 2000])))
    schema = "job long, kind string, download long, s long"
    tail = [(-1, "done", None, LAST), (-2, "done", None, LAST + 5000), (-3, "done", None, LAST + 9000)]
    got = streamed(rocks, shuffled(rng, rows) + tail, schema, timers.expiries_stream, tmp_path, 6, 2)
    table = rocks.createDataFrame(rows, schema).selectExpr("job", "kind", "download", "timestamp_seconds(s) AS ts")
    want = sorted(map(tuple, timers.expiries(table).collect()))
    assert [r for r in got if r[0] >= 0] == want


def test_the_whole_table_stops_at_a_time(spark):
    table = spark.createDataFrame([(1, "begin", 0), (2, "end", 5), (3, "begin", 0), (3, "end", 10)], "id long, kind string, s long").selectExpr("id", "kind", "timestamp_seconds(s) AS ts")
    got = timers.attempt_events(table, F.timestamp_seconds(F.lit(60))).collect()
    assert sorted((r.id, r.event) for r in got) == [(1, "stalled"), (3, "done")]
