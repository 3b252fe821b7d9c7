"""Choice of frames, rewrites and expansions on small cases: thresholds, empty sides, and what has to be an error."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.functions import contexts
from tessera.functions.visibility import Policy
from tessera.operators import frames, joins, repairs, tables

POLICY = replace(Policy(), min_pixels=dict.fromkeys(("small", "mid", "big", "unknown"), 40), min_short_side=dict.fromkeys(("small", "mid", "big", "unknown"), 5), min_relative_to_peak=0.10)
MASK = "struct<pixel_count:int,bbox_width:int,bbox_height:int,clipped_sides_count:int,edge_contact_fraction:double,pixel_fraction:double,touches_opposite_borders:boolean,bbox_fill_fraction:double>"


def _frames(spark, rows):
    return spark.createDataFrame([(e, k, (px, side, side, 0, 0.0, fraction, False, px / 1000), q) for e, k, px, side, fraction, q in rows], f"e int, k int, m {MASK}, q double")


def test_first_clear_frame(spark):
    rows = [(1, 3, 0, 0, 0.0, 0.0), (1, 4, 64, 8, 0.1, 0.4), (1, 5, 400, 20, 0.2, 0.9), (1, 6, 0, 0, 0.0, 0.0), (2, 0, 10_000, 100, 1.0, 0.9)]
    a = frames.assess(_frames(spark, rows), ["e"], "m", F.lit("small"), POLICY)
    (r,) = frames.choose(a, ["e"], "k", "q", POLICY).collect()
    assert (r["e"], r["selected"], r["peak"], r["candidates"]) == (1, 4, 400, 2)
    (b,) = frames.choose(a, ["e"], "k", "q", replace(POLICY, best_within=0.3)).collect()
    assert b["selected"] == 5
    full = a.filter("e = 2").first()
    assert full["reasons"] == ["severely_clipped_or_too_close"] and full["peak"] == 0 and full["relative_fill"] == 0
    assert a.filter("k = 4").first()["relative_fill"] == pytest.approx(0.16)


def test_rewrites(spark):
    rows = spark.createDataFrame([(1, k, f"1::{k}", "Move Forward") for k in range(4)], "e int, k int, key string, action string")
    sel = spark.createDataFrame([(1, 2)], "e int, selected int")
    a = spark.createDataFrame([(1, 0, True, 0.5)], "e int, k int, clear boolean, q double")
    bad = spark.createDataFrame([("1::1",), ("1::2",)], "key string")
    out = frames.production_rewrite(rows, a, sel, bad, ["e"], "k", "key", "action", "q").orderBy("k").collect()
    assert [(r["k"], r["action"], r["original_action"], r["kept_earlier"], r["overridden"]) for r in out] == [(0, "Move Forward", None, True, False), (2, "Stop", "Move Forward", False, True)]
    moves = spark.createDataFrame([(1, 0, "1::1", "Move Forward"), (1, 1, "1::7", "Turn Left"), (1, 2, "1::8", " stop ")], "e int, k int, key string, action string")
    assert [r["k"] for r in frames.navigation_rewrite(moves, bad, "key", "action", F.lit("x")).collect()] == [1]
    assert frames.removed(moves, bad, ["e"], "key", "action").first()[1:] == (1, 1)


@pytest.mark.parametrize("n", [[1, 2], [1, 2, 3, 4]])
def test_sides_of_different_lengths(spark, n):
    left, right = spark.createDataFrame([(k,) for k in range(3)], "a int"), spark.createDataFrame([(k,) for k in n], "b int")
    assert joins.zipped(left, right, ["a"], ["b"], strict=False).count() == max(3, len(n))
    with pytest.raises(Exception, match="different lengths"):
        joins.zipped(left, right, ["a"], ["b"]).collect()
    assert joins.zipped(left, right.limit(0), ["a"], ["b"], strict=False).count() == 3


def test_what_has_to_be_an_error(spark):
    stops = spark.createDataFrame([("s",), ("t",)], "key string")
    queue = lambda *rows: spark.createDataFrame(rows, "key string, members array<int>, n int")
    with pytest.raises(Exception, match="no entry"):
        repairs.represented(stops, queue(("s", [1], 1)), "key", "members", "n").collect()
    with pytest.raises(Exception, match="covered twice"):
        repairs.represented(stops, queue(("s", [1], 1), ("t", [1], 1)), "key", "members", "n").collect()
    with pytest.raises(Exception, match="no stop covers"):
        repairs.represented(stops, queue(("s", [1], 1), ("t", [2], 1)), "key", "members", "n", spark.createDataFrame([(3,)], "episode_key int")).collect()
    rows = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="no row of 2"):
        tables.restricted(rows, spark.createDataFrame([(2,)], "k int"), ["k"]).collect()
    with pytest.raises(Exception, match="strict rows"):
        repairs.salvaged(rows, rows, rows, "k", ["k"])[0].collect()
    for build in (lambda: contexts.build("memory", rows, ["k"], "k"), lambda: tables.redirects("memory")):
        with pytest.raises(ValueError):
            build()


def test_texts_round_by_the_exact_value(spark):
    values = [1.005, 2.675, 0.125, 0.375, 83.55, -0.001, 1e6 + 0.005, 0.0, 5.625]
    out = spark.createDataFrame([(v,) for v in values], "v double").select("v", contexts.fixed("v").alias("two"), contexts.fixed("v", 1).alias("one")).collect()
    assert [(r["two"].lstrip("-"), r["one"].lstrip("-")) for r in out] == [(f"{abs(v):.2f}", f"{abs(v):.1f}") for v in values]


def test_texts_keep_the_sign_of_a_zero(spark):
    values = [-0.03, -0.001, -0.004999, 0.0, 0.03, -0.06, -1e-300]
    out = spark.createDataFrame([(v,) for v in values], "v double").select(contexts.fixed("v").alias("two"), contexts.fixed("v", 1).alias("one")).collect()
    assert [(r["two"], r["one"]) for r in out] == [(f"{v:.2f}", f"{v:.1f}") for v in values]


def test_bounds_just_below_zero(spark):
    """A start at 49.97 has bounds from -0.0, in pose contexts and in chains of poses and actions."""
    steps = spark.createDataFrame([(1, 0, None, 49.97, 0.0, 0.0, 0.0), (1, 1, "forward 3m", 52.97, 0.0, 0.0, 0.0)], "k int, step int, action string, x double, y double, z double, yaw double")
    for name in ("pose_history", "pose_action_history"):
        assert all("SearchBounds: x=[-0.0, 100.0], y=[-50.0, 50.0]" in r["context"] for r in contexts.build(name, steps, ["k"], "step", bounds=True).collect())


def test_contexts_of_unknown_poses(spark):
    """Unknown poses are left out of the last n; a context without any of them is null."""
    steps = spark.createDataFrame([(1, k, "stop" if k else None, x, 0.0, 0.0, 0.0) for k, x in enumerate([1.0, None, None, None, 2.0])], "k int, step int, action string, x double, y double, z double, yaw double")
    poses = [r["context"] for r in contexts.build("pose_history", steps, ["k"], "step", n=3, bounds=True).orderBy("step").collect()]
    assert [p and p.count("  [(") for p in poses] == [1, 1, 1, None, 1]
    resting = steps.withColumn("action", F.when(F.col("step") < 4, F.col("action")))
    assert contexts.build("transition_history", resting, ["k"], "step", n=3).filter("step = 4").first()["context"] is None


def test_texts_of_numbers_that_are_not_finite(spark):
    values = [float("nan"), float("inf"), float("-inf"), 1.0]
    out = spark.createDataFrame([(v,) for v in values], "v double").select(contexts.fixed("v").alias("two")).collect()
    assert [r["two"] for r in out] == [f"{v:.2f}" for v in values]
