"""Audits against plain loops, over one reading of the table."""

import random

from pyspark.sql import functions as F

from tessera.operators import audits
from tessera.operators.audits import Across, Rule


def _across():
    return Across(
        carried={"frame": F.col("frame"), "stop": F.col("stop")},
        neighbours={"order": lambda before: F.col("frame") <= before("frame")},
        groups={"stops": F.count_if("stop") > 1},
        keys={"twice": F.col("key")},
        inputs={"label": (F.col("input"), F.col("label"))},
    )


def _plain(rows):
    """rows: line, episode, key, frame, stop, input, label."""
    found, last, seen, first, stops = {}, {}, set(), {}, {}
    hit = lambda rule, key: found.__setitem__((rule, key), found.get((rule, key), 0) + 1)
    for line, episode, key, frame, stop, given, label in sorted(rows, key=lambda r: r[0]):
        if frame is None:
            hit("no_frame", key)
        elif frame > 8:
            hit("high", key)
        if episode in last and frame is not None and last[episode] is not None and frame <= last[episode]:
            hit("order", key)
        last[episode] = frame
        if key in seen:
            hit("twice", key)
        seen.add(key)
        if first.setdefault(given, label) != label:
            hit("label", None)
        stops[episode] = stops.get(episode, 0) + bool(stop)
    for episode, n in stops.items():
        if n > 1:
            hit("stops", None if episode is None else str(episode))
    return found


def test_rules_equal_plain_loops_over_hot_groups_and_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for seed in range(2):
            r = random.Random(seed)
            rows = [(k, r.choice([1, 1, 1, 1, 2, 3, None]), r.choice([f"k{k}", f"k{k // 2}", "same"]), r.choice([None, k % 7, k // 10, 9]), r.random() < 0.02, r.choice(["a", "b", None]), r.choice(["x", "x", "x", "y", None])) for k in range(400)]
            df = spark.createDataFrame(rows, "line long, episode int, key string, frame int, stop boolean, input string, label string").repartition(5)
            rules = [Rule("no_frame", F.col("frame").isNull(), last=True), Rule("high", F.col("frame") > 8)]
            got = audits.audit(df, F.col("key"), F.col("episode"), F.col("line"), rules, _across()).collect()
            want = _plain(rows)
            assert sum(x.times for x in got if x.rule == "label") == want.pop(("label", None))
            assert {(x.rule, x.key): x.times for x in got if x.rule != "label"} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_the_table_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(1_000).select(F.col("id").alias("line"), (F.col("id") % 3).alias("episode"), F.col("id").cast("string").alias("key"), (F.col("id") % 50).alias("frame"), (F.col("id") == 5).alias("stop"), F.lit("i").alias("input"), F.lit("l").alias("label"))
    df = df.mapInArrow(counted, df.schema)
    rules = [Rule(f"r{k}", F.col("line") % (k + 2) == 0) for k in range(25)]
    out = audits.summary(audits.audit(df, F.col("key"), F.col("episode"), F.col("line"), rules, _across()), 3).collect()
    assert read.value == 1_000
    assert {r.rule: (r.violations, r.examples) for r in out}["r0"] == (500, ["0", "10", "100"]) and len(out) == 26


def test_no_rules_no_rows_and_tests_that_are_null(spark):
    df = spark.createDataFrame([(1, None, "a", None, None, None, None)], "line long, episode int, key string, frame int, stop boolean, input string, label string")
    key = (F.col("key"), F.col("episode"), F.col("line"))
    assert audits.audit(df, *key, []).count() == 0
    assert audits.audit(df, *key, [Rule("null", F.col("frame") > 1)], _across()).count() == 0
    assert audits.summary(audits.audit(df.limit(0), *key, [Rule("all", F.lit(True))], _across())).count() == 0
    assert [tuple(r) for r in audits.summary(audits.audit(df, *key, [Rule("all", F.lit(True))])).collect()] == [("all", 1, ["a"])]
