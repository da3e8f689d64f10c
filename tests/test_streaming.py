"""Metering and usage as streams, in any order of micro-batches and with batches run again."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chorale.operators import serve, usage
from chorale.streaming import usage as streams

LOG = "user_id string, ts timestamp, status string, cached boolean, force boolean, succeeded boolean"
PLAYS = "usage_key string, ms long, skipped boolean, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def streamed(spark, tmp_path, batches, late):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i:02}"))
    stream = streams.metered_stream(streams.read_events(spark, str(tmp_path / "in/*"), LOG), late)
    q = stream.writeStream.outputMode("append").format("memory").queryName(f"metered{random.randrange(10**9)}").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return [tuple(r) for r in spark.table(q.name).where("user_id <> 'end'").collect()]


def test_shuffled_batches_are_judged_as_the_replay(spark, tmp_path, rocks):
    draw = random.Random(6)
    log = [(u, T0 + dt.timedelta(seconds=draw.choice([10, 25, 40]) * i, days=draw.choice([0, 0, 31, 62])), draw.choice([None, None, "active"]), draw.random() < 0.2, draw.random() < 0.3, draw.random() < 0.9) for u in "abc" for i in range(25)]
    want = sorted(map(tuple, serve.metered(spark.createDataFrame(log, LOG)).collect()))
    assert {r[2] for r in want} == {"fresh", "rate", "quota", "cached", "failed"}
    draw.shuffle(log)
    batches = [log[k::4] for k in range(4)] + [[("end", T0 + dt.timedelta(days=400), None, False, False, True)]]
    assert sorted(streamed(spark, tmp_path, batches, "100 days")) == want


def test_requests_wait_for_the_watermark(spark, tmp_path, rocks):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    batches = [[("a", at(100), None, False, False, True)], [("a", at(80), None, False, False, True)], [("end", at(200), None, False, False, True)], [("a", at(10), None, False, False, True), ("a", at(195), None, False, False, True)]]
    got = streamed(spark, tmp_path, batches, "60 seconds")
    assert sorted(got) == [("a", at(80), "fresh", 1), ("a", at(100), "rate", 1)]  # 10 came too late, 195 is still open


def plays(spark, rows):
    return spark.createDataFrame([(k, ms, s, T0 + dt.timedelta(days=d)) for k, ms, s, d in rows], PLAYS)


def told(df):
    return sorted(tuple(r[c] for c in ("usage_key", "plays", "total_ms", "last_played", "skips", "skip_ms")) for r in df.collect())


def test_a_batch_run_again_adds_nothing(spark, tmp_path):
    batches = [plays(spark, [("a", 5, False, 0), ("b", 7, True, 1)]), plays(spark, [("a", 1, True, 3)]), plays(spark, [("c", 2, False, 2), ("a", 4, None, 1)])]
    every = told(usage.usage(batches[0].unionByName(batches[1]).unionByName(batches[2])))
    path, into = f"file://{tmp_path}/held", f"file://{tmp_path}/folded"
    add = streams.usage_sink(path)
    for i in (0, 1, 1, 0, 2, 2):
        add(batches[i], i)
    assert told(streams.usage_so_far(spark, path)) == every
    assert told(streams.folded(spark, path, into)) == every
    more = streams.usage_sink(into)
    more(batches[2], 2)
    more(batches[0], 1)
    assert told(streams.usage_so_far(spark, into)) == every
    more(plays(spark, [("d", 1, False, 0)]), 3)
    more(plays(spark, [("d", 1, False, 0)]), 3)
    assert told(streams.usage_so_far(spark, into)) == sorted([*every, ("d", 1, 1, T0, 0, 0)])


def test_a_stream_feeds_the_sink(spark, tmp_path):
    for i, rows in enumerate(([("a", 5, False, 0)], [("a", 6, True, 1), ("b", 1, False, 2)])):
        plays(spark, rows).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    path = f"file://{tmp_path}/held"
    q = streams.read_events(spark, str(tmp_path / "in/*"), PLAYS).writeStream.foreachBatch(streams.usage_sink(path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert told(streams.usage_so_far(spark, path)) == [("a", 2, 11, T0 + dt.timedelta(days=1), 1, 6), ("b", 1, 1, T0 + dt.timedelta(days=2), 0, 0)]
    assert spark.read.parquet(path).select(F.countDistinct("batch")).first()[0] == 2
