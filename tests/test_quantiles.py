"""Exact quantiles by ranges against numpy and Spark's own, and merged sketches."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, quantiles


@pytest.mark.parametrize("shape", ["hot", "ties", "small", "wide"])
def test_equal_to_the_percentiles_of_one_task(spark, shape):
    r = random.Random(shape)
    draw = {"hot": lambda: (r.random() < 0.02, r.gauss(0, 1)), "ties": lambda: (r.random() < 0.5, float(r.choice([1, 1, 1, 2]))), "small": lambda: (r.randrange(2000), r.random()), "wide": lambda: (None, r.choice([-1, 1]) * 10.0 ** r.randint(-300, 300))}[shape]
    rows = [(None if k is None else int(k), v) for k, v in (draw() for _ in range(3_000))]
    df = spark.createDataFrame(rows, "k long, v double").repartition(5)
    qs = (0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0)
    got = {x.k: x for x in quantiles.describe(df, ["k"], "v", qs).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, v in by.items():
        assert got[k]["count"] == len(v) and (got[k]["min"], got[k]["max"]) == (min(v), max(v))
        assert np.allclose([got[k][n] for n in quantiles.names(qs)], np.quantile(v, qs), rtol=1e-12, atol=0)


def test_awkward_values_and_names(spark):
    rows = [("a", "1"), ("a", None), ("a", "x"), ("a", "NaN"), (None, "2"), (None, "4"), ("b", None), ("a", "1")]
    df = spark.createDataFrame(rows, "_k string, count string")
    got = {r["_k"]: (r["count"], r.mean, r.median, r.p95) for r in quantiles.describe(df, ["_k"], "count").collect()}
    assert got == {"a": (2, 1.0, 1.0, 1.0), None: (2, 3.0, 3.0, pytest.approx(3.9))}
    assert quantiles.describe(df.limit(0), ["_k"], "count").count() == 0
    own = {r["_k"]: r.median for r in df.groupBy("_k").agg(*aggregates.describe("count")).collect()}
    assert own["a"] == 1.0 and own[None] == 3.0


def test_no_task_holds_a_hot_group(spark):
    """Ranges of one key: none has much more than its share of the distinct values."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.hash("id").cast("double").alias("v"))
    each = df.groupBy(F.struct("k").alias("_k"), F.col("v").alias("_v")).count()
    sizes = each.repartitionByRange(8, "_k", "_v").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 7 and max(r["count"] for r in sizes) < 2 * 20_000 / 8


def test_merged_sketches_keep_their_bounds(spark):
    df = spark.range(50_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("part"), F.pmod(F.hash("id"), F.lit(10_000)).cast("double").alias("v"))
    kept = quantiles.sketched(df, ["k", "part"], "v")
    assert kept.select(F.max(F.octet_length("quantiles"))).first()[0] < 40_000
    got = {r.k: r for r in quantiles.merged(kept, ["k"], (0.5, 0.9), "TOTAL").collect()}
    assert set(got) == {*map(str, range(7)), "TOTAL"} and got["TOTAL"]["count"] == 50_000
    values = np.array([r.v for r in df.select("v").collect()])
    for q, name in ((0.5, "median"), (0.9, "p90")):
        assert abs((values <= got["TOTAL"][name]).mean() - q) < 0.02
    assert abs(got["TOTAL"].distinct / len(set(values)) - 1) < 0.06
    assert quantiles.merged(quantiles.sketched(df.limit(0), ["k"], "v"), ["k"]).count() == 0
    empty = quantiles.merged(quantiles.sketched(spark.createDataFrame([(1, None)], "k int, v double"), ["k"], "v"), ["k"]).first()
    assert (empty["count"], empty.median, empty.distinct) == (0, None, 0)
