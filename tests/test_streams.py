"""Keyed state with timers, event-time joins and accounts of late rows, over several arrivals."""

import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.sources.readers import exists
from tessera.sources.scratch import folder
from tessera.streaming import episodes, lanes
from tessera.streaming.run import resumed, rocks

BASE = 1_700_000_000


def _arrived(spark, *parts):
    return [spark.createDataFrame([(lane, s) for lane, s in part], "lane long, s long").select("lane", F.timestamp_seconds(F.col("s") + BASE).alias("time")) for part in parts]


def _silences(spark, arrivals, quiet, late, started=None):
    with rocks(spark):
        out, accounts = resumed(arrivals, lambda s: lanes.silences(s, "lane", "time", quiet * 1000, late, started))
    return sorted(((r.lane, int(r.since.timestamp()) - BASE, r.reason) for r in out.collect()), key=str), accounts


def test_thinned_times_keep_all_silences():
    import random

    r = random.Random(3)
    for _ in range(200):
        times = [r.randrange(300) for _ in range(r.randrange(40))]
        more = [r.randrange(300) for _ in range(r.randrange(5))]
        gaps = lambda ts: [a for a, b in zip(sorted(set(ts)), [*sorted(set(ts))[1:], 10**9]) if b - a > 10]
        assert gaps([*lanes.thinned(times, 10), *more]) == gaps([*times, *more])
        assert len(lanes.thinned(times, 10)) <= 2 * (300 // 10) + 2


def test_silences_over_restarts_out_of_order_and_ties(spark):
    # Lane 1 is silent from 100 to 500; the row at 300 comes late but in time, so the silence is from 300. Null lanes are a lane.
    parts = [(1, 100), (1, 100), (2, 0), (None, 50)], [(1, 500), (3, 700)], [(1, 300), (2, 20)], [(9, 50_000)]
    got, accounts = _silences(spark, _arrived(spark, *parts), 100, "20 minutes")
    assert got == sorted([(1, 100, "stale"), (1, 300, "stale"), (1, 500, "stale"), (2, 20, "stale"), (3, 700, "stale"), (None, 50, "stale")], key=str) and accounts.dropped == 0


def test_lanes_that_are_only_started_and_late_rows(spark):
    started = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "lane long, s long").select("lane", F.timestamp_seconds(F.col("s") + BASE).alias("time"))
    parts = [(1, 0), (1, 50)], [(9, 10_000)], [(1, 60), (9, 10_001)], [(9, 20_000)]
    got, accounts = _silences(spark, _arrived(spark, *parts), 100, "10 seconds", started)
    # The row at 60 is behind the watermark (9,990): it is dropped, and counted.
    assert got == [(1, 50, "stale"), (2, 0, "no_activity"), (9, 10_001, "stale")] and accounts.dropped == 1


def test_heartbeats_in_processing_time(spark, tmp_path):
    with pytest.raises(ValueError, match="forgotten"):
        lanes.heartbeats(spark.range(1).select(F.col("id").alias("lane"), F.current_timestamp().alias("time")), "lane", "time", 10, 10)
    first, second = _arrived(spark, [(1, 100), (1, 40)], [(2, 7)])
    at = str(tmp_path)
    first.write.parquet(f"{at}/in")
    stream = spark.readStream.schema(first.schema).parquet(f"{at}/in")
    with rocks(spark):
        out = lanes.heartbeats(stream, "lane", "time", 1_500, 600_000)
        query = out.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(processingTime="500 milliseconds").foreachBatch(lambda rows, k: rows.write.mode("overwrite").parquet(f"{at}/out/batch={k}")).start()
        try:
            second.write.mode("append").parquet(f"{at}/in")
            for _ in range(120):
                time.sleep(0.5)
                found = sorted((r.lane, int(r.since.timestamp()) - BASE, r.reason) for r in spark.read.schema("lane long, since timestamp, reason string").parquet(f"{at}/out").collect()) if exists(spark, f"{at}/out") else []
                if len(found) == 2:
                    break
        finally:
            query.stop()
    assert found == [(1, 100, "stale"), (2, 7, "stale")]


def test_joined_streams_count_what_is_late(spark):
    rows = lambda *r: spark.createDataFrame(r, "k long, s long, kind string").select("k", "kind", F.timestamp_seconds(F.col("s") + BASE).alias("at"))
    parts = [rows((1, 0, "a"), (2, 100, "a"), (1, 50, "b")), rows((2, 9_000, "a"), (2, 9_030, "b")), rows((2, 120, "b"), (2, 9_020, "b"))]
    plan = lambda s: episodes.met(s.filter("kind = 'a'"), s.filter("kind = 'b'"), "k", "at", "at", "1 minute", "10 seconds")
    out, accounts = resumed(parts, plan)
    got = sorted((r.k, int(r.left["at"].timestamp()) - BASE, int(r.right["at"].timestamp()) - BASE) for r in out.collect())
    assert got == [(1, 0, 50), (2, 9_000, 9_020), (2, 9_000, 9_030)] and accounts.dropped == 1


def test_nothing_and_empty_arrivals(spark):
    with pytest.raises(ValueError, match="nothing"):
        resumed([], lambda s: s)
    out, accounts = resumed(_arrived(spark, []), lambda s: episodes.sessions(s, "time", "lane", "1 minute"))
    assert out.count() == 0 and accounts.dropped == 0 and "stream" in folder(spark, "stream")


def test_a_lane_is_read_and_written_once_a_call():
    """Each call on the state is a round trip to the JVM: one read, one write, and the timer's."""
    calls = []

    class Handle:
        held = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

        def __getattr__(self, name):
            return lambda *_: calls.append(name)

    lane = lanes.Silences(100)
    lane.init(Handle())
    for at in (1_000, 1_050):
        list(lane.handleInputRows((1,), iter([Row(at=at)]), None))
    assert calls == ["get", "registerTimer", "update", "get", "update"]
