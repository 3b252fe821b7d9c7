"""The ordered pass over an episode equals the aggregates, whatever the batches."""

import random

from pyspark.sql import functions as F

from tessera.operators import machines, outcomes

KIND = "episode long, step long, action string, distance double, collided boolean"


def _both(spark, rows, most):
    df = spark.createDataFrame(rows, KIND).repartition(4)
    own = {r.episode: r for r in outcomes.end_episodes(df, ["episode"], "step", "action", "distance", "collided", most).collect()}
    got = {r.episode: r for r in machines.end_episodes(df, most).collect()}
    assert set(got) == set(own)
    for k, r in got.items():
        assert r.asDict() == own[k].asDict(), k
    return got


def test_equal_to_the_aggregates(spark):
    r = random.Random(8)
    rows = [(e, s, r.choice(["go", "go", "go", "turn", "stop"] if r.random() < 0.2 else ["go", None]), r.choice([5.0, 20.0, 20.5, 300.0]), r.random() < 0.02) for e in range(60) for s in range(r.randint(1, 40))]
    got = _both(spark, rows, 25)
    assert {x.termination for x in got.values()} == {"collision", "stop", "step_limit", "unfinished"}
    _both(spark, [(1, 0, "stop", 20.0, True), (2, 0, "stop", 20.0, False), (3, 0, "go", 1.0, None or False)], 1)


def test_an_episode_of_many_batches(spark):
    most = 40_000
    df = spark.range(30_000).select(F.lit(7).cast("long").alias("episode"), F.col("id").alias("step"), F.when(F.col("id") == 25_000, "stop").otherwise("go").alias("action"), (F.lit(100.0) - F.col("id") / 300).alias("distance"), F.lit(False).alias("collided"))
    (one,) = machines.end_episodes(df.repartition(5), most).collect()
    assert (one.termination, one.steps, one.success, one.legacy_reach) == ("stop", 25_001, True, True)
    assert machines.end_episodes(df.limit(0), most).count() == 0
