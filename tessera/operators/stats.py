"""Paired statistics: exact binomial, Wilcoxon, Spearman, bootstrap, divergence, gates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written


def exact_paired_p(gains: Column, losses: Column) -> Column:
    """Two-sided exact p of gains against losses under even odds: twice the smaller tail, 1 at most; 1 without any.

    Terms are taken as exponentials of logarithms of binomial coefficients, so
    n may be large.
    """
    n, k = (gains + losses).cast("int"), F.least(gains, losses).cast("int")
    log_half = F.ln(F.lit(0.5))
    # Coefficients by running sums of ln((n - i + 1) / i), from i = 1 to k.
    steps = F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(0.0).alias("log"), F.exp(n * log_half).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.ln((n - i + 1) / i.cast("double"))
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log + n * log_half)).alias("sum"))

    tail = F.aggregate(steps, start, add, lambda acc: acc["sum"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def value_ranks(df: DataFrame, value: str, out: str, many: str | None = None, parts: int = 200) -> DataFrame:
    """_v, out: the mean rank from 1 of each distinct value; a row counts as often as its column ``many`` says.

    The distinct values are dealt to parts by cuts, of which ``parts`` numbers
    reach the driver; each part is ordered by itself, after the rows of the
    parts below it. The cuts need not be exact: they only share out the work.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(value).agg((F.sum(many) if many else F.count("*")).alias("_n"))
    per = written(per)
    cuts = per.agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 1_000)).first()[0] or []
    part = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c <= F.col(value))) if cuts else F.lit(0)
    per = per.withColumn("_part", part)
    sizes = per.groupBy("_part").agg(F.sum("_n").alias("_size"))
    sizes = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_below"))
    within = F.coalesce(F.sum("_n").over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.join(F.broadcast(sizes), "_part").select(F.col(value).alias("_v"), (F.col("_below") + within + (F.col("_n") + 1) / 2).alias(out))


def average_rank(df: DataFrame, value: str, out: str, parts: int = 200) -> DataFrame:
    """Ranks from 1, equal values sharing the mean of theirs; rows without a value go."""
    return df.join(value_ranks(df, value, out, parts=parts), F.col(value) == F.col("_v")).drop("_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho, t, p of the rank correlation; null under three rows. Pairs of equal values are one row with their number, and ranks are written once."""
    rows = written(df.select(x, y).dropna().groupBy(x, y).agg(F.count("*").alias("_many")))
    ranks = {c: written(value_ranks(rows, c, f"_r{c}", "_many")) for c in (x, y)}
    ranked = rows
    for c in (x, y):
        ranked = ranked.join(ranks[c].withColumnRenamed("_v", c), c)
    many, p, q = F.col("_many"), F.col(f"_r{x}"), F.col(f"_r{y}")
    total = {k: F.sum(many * c) for k, c in {"n": F.lit(1.0), "p": p, "q": q, "pp": p * p, "qq": q * q, "pq": p * q}.items()}
    spread = [total["n"] * total[c + c] - total[c] * total[c] for c in "pq"]
    out = ranked.agg(F.sum(many).alias("n"), F.try_divide(total["n"] * total["pq"] - total["p"] * total["q"], F.sqrt(spread[0] * spread[1])).alias("rho"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    rho = F.when(n >= 3, F.col("rho"))
    t = rho * F.sqrt(F.try_divide(n - 2, 1 - rho * rho))
    out = out.select(n.alias("n"), rho.alias("rho"), t.alias("t"))
    return out.withColumn("p", F.when(F.col("t").isNotNull(), student_p(F.col("t"), F.col("n") - 2)).when(F.abs("rho") >= 1, 0.0))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """n, w_plus, w_minus, z, p of the signed ranks of non-zero differences, normal approximation with tie correction."""
    rows = df.filter(F.col(difference) != 0).select(F.abs(difference).alias("_a"), (F.col(difference) > 0).alias("_up"))
    ranked = average_rank(rows, "_a", "_r")
    ties = rows.groupBy("_a").agg(F.count("*").alias("t")).agg(F.coalesce(F.sum(F.col("t") ** 3 - F.col("t")), F.lit(0.0)).alias("ties"))
    out = ranked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(F.col("_up"), F.col("_r"))), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum(F.when(~F.col("_up"), F.col("_r"))), F.lit(0.0)).alias("w_minus"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return out.crossJoin(ties).select("n", "w_plus", "w_minus", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, spread).alias("z")).withColumn("p", normal_p(F.col("z")))


def bootstrap_delta(df: DataFrame, difference: str, identity: Sequence[str], seed: int = 20260821, samples: int = 5_000) -> DataFrame:
    """mean, low, high: the mean difference with its 2.5 and 97.5 percentiles over Poisson resamples.

    Each row draws its weight in each resample from the hash of its identity,
    which must tell rows apart, so resampling is one pass whose partial sums
    have a fixed size; the quantiles are of ``samples`` means. Weights are made
    for blocks of rows at a time.
    """
    if not identity:
        raise ValueError("rows need an identity, or equal ones would share their weights")
    rows = df.filter(F.col(difference).isNotNull()).select(F.col(difference).cast("double").alias("d"), F.xxhash64(F.lit(seed), *identity).alias("h"))
    cdf = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(20)])
    counter = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def weights(h: np.ndarray) -> np.ndarray:
        x = h.astype(np.int64).view(np.uint64)[:, None] + counter
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
        return np.searchsorted(cdf, (x >> np.uint64(11)).astype(np.float64) / (1 << 53), "right").astype(np.float64)

    def partial(batches):
        total, weight, s, n = np.zeros(samples), np.zeros(samples), 0.0, 0
        for pdf in batches:
            d, h = pdf["d"].to_numpy(), pdf["h"].to_numpy()
            for at in range(0, len(d), 128):
                w = weights(h[at : at + 128])
                total, weight = total + d[at : at + 128] @ w, weight + w.sum(axis=0)
            s, n = s + d.sum(), n + len(d)
        yield pd.DataFrame({"k": np.arange(-1, samples), "total": [s, *total], "weight": [float(n), *weight]})

    means = rows.mapInPandas(partial, "k int, total double, weight double").groupBy("k").agg(F.try_divide(F.sum("total"), F.sum("weight")).alias("m"))
    q = F.percentile(F.when(F.col("k") >= 0, F.col("m")), F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.max(F.when(F.col("k") == -1, F.col("m"))).alias("mean"), q.alias("q")).select("mean", F.element_at("q", 1).alias("low"), F.element_at("q", 2).alias("high"))


def _fold(n: int, start: dict[str, Column], step) -> Column:
    """A struct of doubles after n steps; a step makes the new ones from the old struct and k."""
    first = F.struct(*(c.cast("double").alias(k) for k, c in start.items()))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), first, lambda acc, k: F.struct(*(c.cast("double").alias(name) for name, c in step(acc, k).items())))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal value: by the series of its distribution to 3, the continued fraction beyond."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    series = _fold(60, {"term": x, "total": x}, lambda a, k: {"term": a["term"] * x * x / (2 * k + 1), "total": a["total"] + a["term"] * x * x / (2 * k + 1)})["total"]
    tail = _fold(60, {"tail": x}, lambda a, k: {"tail": x + (61 - k) / a["tail"]})["tail"]
    return F.when(x < 3, 1 - 2 * density * series).otherwise(2 * density / tail)


def _log_gamma(x: Column) -> Column:
    """By Stirling's series, eight places up."""
    y = x + 8
    up = (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for k in range(8):
        up = up - F.ln(x + k)
    return up


def student_p(t: Column, degrees: Column) -> Column:
    """Two-sided p of Student's t: the regularised incomplete beta function by its continued fraction."""
    n = degrees.cast("double")
    x = n / (n + t * t)

    def ratio(x: Column, a: Column, b: Column) -> Column:
        front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
        least = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
        d0 = 1 / least(1 - (a + b) * x / (a + 1))

        def step(acc: Column, m: Column) -> dict[str, Column]:
            even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d1, c1 = 1 / least(1 + even * acc["d"]), least(1 + even / acc["c"])
            d2, c2 = 1 / least(1 + odd * d1), least(1 + odd / c1)
            return {"c": c2, "d": d2, "h": acc["h"] * d1 * c1 * d2 * c2}

        return front * _fold(200, {"c": F.lit(1.0), "d": d0, "h": d0}, step)["h"]

    a, b = n / 2, F.lit(0.5)
    return F.when(t == 0, 1.0).when(x < (a + 1) / (a + b + 2), ratio(x, a, b)).otherwise(1 - ratio(1 - x, b, a))


def gate(tests: dict[str, Column]) -> list[Column]:
    """Each test and whether all hold."""
    out = F.lit(True)
    for t in tests.values():
        out = out & F.coalesce(t, F.lit(False))
    return [*(F.coalesce(t, F.lit(False)).alias(k) for k, t in tests.items()), out.alias("passed")]
