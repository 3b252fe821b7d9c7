"""Quantiles of groups of any size: exact ones by selection in ranges, and sketches that are kept and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import col
from tessera.operators.aggregates import number
from tessera.sources.scratch import written

QUARTILES = (0.5, 0.75, 0.9, 0.95)


def names(quantiles: Sequence[float]) -> list[str]:
    return ["median" if q == 0.5 else f"p{round(q * 100)}" for q in quantiles]


def describe(df: DataFrame, keys: Sequence[str], value: Column | str, quantiles: Sequence[float] = QUARTILES) -> DataFrame:
    """keys, count, mean, exact quantiles by linear interpolation, min and max of the numbers of each key; keys without any have no row.

    Equal values of a key become one row with their number. These are dealt to
    ranges by key and value, so a key with nearly all rows is spread over nearly
    all ranges, and written. The ranges' counts, one row for each key and range,
    say which range holds which place; only those ranges are read again, and
    each is ordered by itself. No task holds more than one range of one key, or
    one key's counts of ranges.

    Null keys are a key; NaN, null and text that is no number are left out.
    """
    at = [c for c in keys]
    rows = df.select(F.struct(*(F.col(f"`{k}`") for k in at)).alias("_k"), number(value).alias("_v")).filter(F.col("_v").isNotNull())
    each = written(rows.groupBy("_k", "_v").agg(F.count("*").alias("_n")))
    dealt = written(each.repartitionByRange("_k", "_v").withColumn("_part", F.spark_partition_id()))
    whole = Window.partitionBy("_k")
    sizes = dealt.groupBy("_k", "_part").agg(F.sum("_n").alias("_size"))
    sizes = sizes.withColumn("_all", F.sum("_size").over(whole)).withColumn("_below", F.sum("_size").over(whole.orderBy("_part")) - F.col("_size"))
    places = [F.floor(q * (F.col("_all") - 1) + up * (1 - 1e-12)).cast("long") for q in quantiles for up in (0, 1)]
    wanted = F.array_distinct(F.filter(F.array(*places), lambda p: (p >= F.col("_below")) & (p < F.col("_below") + F.col("_size"))))
    needed = sizes.withColumn("_wanted", wanted).filter(F.size("_wanted") > 0).select("_k", "_part", "_below", "_wanted")
    before = F.sum("_n").over(Window.partitionBy("_k", "_part").orderBy("_v")) - F.col("_n") + F.col("_below")
    hit = dealt.join(needed, ["_k", "_part"]).withColumn("_at", before).withColumn("_place", F.explode(F.filter("_wanted", lambda p: (p >= F.col("_at")) & (p < F.col("_at") + F.col("_n")))))
    found = hit.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_found"))
    totals = each.groupBy("_k").agg(F.sum("_n").alias("count"), (F.sum(F.col("_v") * F.col("_n")) / F.sum("_n")).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    out = totals.join(found, "_k")

    def quantile(q: float) -> Column:
        place = q * (F.col("count") - 1)
        low, high = (F.element_at("_found", F.floor(place + up * (1 - 1e-12)).cast("long")) for up in (0, 1))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return out.select(*(F.col("_k").getField(k).alias(k) for k in at), "count", "mean", *(quantile(q).alias(n) for q, n in zip(quantiles, names(quantiles), strict=True)), "min", "max")


def sketched(df: DataFrame, keys: Sequence[str], value: Column | str, distinct: Column | str | None = None, k: int = 400, log_m: int = 12) -> DataFrame:
    """keys, quantiles (a KLL sketch of the numbers), distinct (an HLL sketch): a few kilobytes a key whatever its rows, to be stored and merged.

    KLL is exact up to k values, then off by about 1.3 / k of the ranks; HLL is
    exact for few values, then off by about 1 / sqrt(2^log_m).
    """
    kll = F.kll_sketch_agg_double(number(value), k)
    return df.groupBy(*keys).agg(kll.alias("quantiles"), F.hll_sketch_agg(col(distinct if distinct is not None else value).cast("string"), log_m).alias("distinct"))


def merged(sketches: DataFrame, keys: Sequence[str], quantiles: Sequence[float] = QUARTILES, total: str | None = None) -> DataFrame:
    """keys, count, the sketches' quantiles (values that occur) and distinct, of stored sketches merged by key; with ``total`` also a row of all, named so in the first key."""
    each = [F.kll_merge_agg_double("quantiles").alias("_q"), F.hll_union_agg("distinct").alias("_d")]
    out = sketches.groupBy(*keys).agg(*each)
    if total is not None:
        first, *rest = keys
        all_ = out.agg(F.kll_merge_agg_double("_q").alias("_q"), F.hll_union_agg("_d").alias("_d"))
        row = all_.select(F.lit(total).alias(first), *(F.lit(None).cast(out.schema[c].dataType).alias(c) for c in rest), "_q", "_d")
        out = out.withColumn(first, F.col(first).cast("string")).unionByName(row)
    n = F.kll_sketch_get_n_double("_q")
    at = [F.when(n > 0, F.kll_sketch_get_quantile_double("_q", F.lit(q))).alias(c) for q, c in zip(quantiles, names(quantiles), strict=True)]
    return out.select(*keys, n.alias("count"), *at, F.hll_sketch_estimate("_d").alias("distinct"))
