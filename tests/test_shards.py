"""Sharding by runs of equal costs against the plain rule: one row after another to the least loaded shard."""

import random
from fractions import Fraction

import pytest

from tessera.operators import sampling


def _plain(rows, shards):
    loads, out = [Fraction(0)] * shards, {}
    for key, cost in sorted(rows, key=lambda r: (-(r[1] or 0), r[0])):
        s = min(range(shards), key=lambda k: (loads[k], k))
        loads[s] += Fraction(cost or 0)
        out[key] = s
    return out


@pytest.mark.parametrize(("shards", "draw"), [
    (4, lambda r: float(r.randint(1, 9))), (7, lambda r: r.choice([1.0] * 20 + [100.0, 37.0])), (3, lambda r: r.random()), (5, lambda r: r.choice([0.1, 0.2, 0.3])),
    (1, lambda r: 2.0), (6, lambda r: r.choice([None, 0.0, 3.0, -2.0, -1.0])), (16, lambda r: 1.0), (9, lambda r: r.choice([50.0, 49.0, 1.0, 1.0])),
])
def test_equal_to_one_row_after_another(spark, shards, draw):
    r = random.Random(shards)
    rows = [(k, draw(r)) for k in r.sample(range(10_000), 700)]
    got = sampling.assign_shards(spark.createDataFrame(rows, "k long, c double").repartition(5), "k", "c", shards).collect()
    assert {x.k: x.shard for x in got} == _plain(rows, shards) and {x.k: x.c for x in got} == dict(rows)


def test_bulk_of_a_run_equals_single_steps():
    for seed in range(300):
        r = random.Random(seed)
        steps = [r.choice([0, 0, 1, 2, 5, 9]) for _ in range(r.randint(1, 7))]
        steps[r.randrange(len(steps))] = 0
        n, loads = r.randint(0, 40), list(steps)
        for _ in range(n):
            loads[min(range(len(loads)), key=lambda k: (loads[k], k))] += 1
        assert sampling.taken(steps, n) == [b - a for a, b in zip(steps, loads, strict=True)]


def test_no_rows_names_and_text_keys(spark):
    assert sampling.assign_shards(spark.createDataFrame([], "k string, c int"), "k", "c", 3).count() == 0
    rows = [("b", 2), ("a", 2), ("c", 5)]
    got = sampling.assign_shards(spark.createDataFrame(rows, "_part string, _cost int"), "_part", "_cost", 2)
    assert got.columns == ["_part", "_cost", "shard"] and {tuple(r) for r in got.collect()} == {("c", 5.0, 0), ("a", 2.0, 1), ("b", 2.0, 1)}
