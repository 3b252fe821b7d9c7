"""Ranges of any length: each event meets each range that holds it, once, and a long range is two rows."""

import random

from tessera.operators.joins import interval


def test_equal_to_all_pairs(spark):
    r = random.Random(14)
    events = [(k, r.choice([1, 1, 1, 2, None]), r.choice([None, r.uniform(-50, 500), float(r.randrange(-5, 60))])) for k in range(300)]
    ranges = [(k, r.choice([1, 1, 2, None]), s, s + length) for k in range(80) for s, length in [(float(r.randrange(-20, 100)), r.choice([0.0, 0.5, 1.0, 2.0, 3.0, 64.0, 65.0, 1e6, -4.0]))]] + [(99, 1, None, 5.0), (98, 1, 5.0, None)]
    e, g = spark.createDataFrame(events, "id int, k int, at double"), spark.createDataFrame(ranges, "rid int, k int, s double, e double")
    got = sorted((x.id, x.rid) for x in interval(e, g, ["k"], "at", "s", "e", 1.0).collect())
    want = sorted((i, j) for i, k, at in events for j, q, s, t in ranges if k is not None and k == q and at is not None and s is not None and t is not None and s <= at < t)
    assert got == want
    assert interval(e, g.limit(0), ["k"], "at", "s", "e", 1.0).count() == 0 == interval(e.limit(0), g, ["k"], "at", "s", "e", 1.0).count()


def test_a_long_range_is_two_rows(spark):
    g = spark.createDataFrame([(1, 0.0, 365 * 86_400.0)], "k int, s double, e double")
    e = spark.range(10).selectExpr("1 AS k", "id * 3600.0D AS at")
    joined = interval(e, g, ["k"], "at", "s", "e", 3600.0)
    assert joined.count() == 10 and joined.columns == ["k", "at", "s", "e"]
