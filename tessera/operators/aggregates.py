"""Grouped summaries: descriptions, rates, crosstabs, confusion, buckets, overlapping groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import col


def rate(numerator: Column, denominator: Column, empty: float | None = 0.0) -> Column:
    """A ratio; for a zero denominator ``empty``."""
    out = F.try_divide(numerator.cast("double"), denominator)
    return out if empty is None else F.coalesce(out, F.lit(empty))


def percentage(numerator: Column, denominator: Column) -> Column:
    return F.try_divide(100.0 * numerator, denominator)


def number(c: Column | str) -> Column:
    """A double, with NaN as null, so that aggregates leave it out."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def describe(c: Column | str, quantiles: Sequence[float] = (0.5, 0.75, 0.9, 0.95), prefix: str = "") -> list[Column]:
    """count, mean, the exact quantiles by linear interpolation, min and max of the numbers."""
    x = number(c)
    names = ["median" if q == 0.5 else f"p{round(q * 100)}" for q in quantiles]
    return [
        F.count(x).alias(f"{prefix}count"),
        F.avg(x).alias(f"{prefix}mean"),
        *(F.percentile(x, F.lit(q)).alias(f"{prefix}{n}") for q, n in zip(quantiles, names, strict=True)),
        F.min(x).alias(f"{prefix}min"),
        F.max(x).alias(f"{prefix}max"),
    ]


def upper_median(column: str) -> Column:
    """The middle value, the upper of two: the discrete median from above, which counts distinct values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def counts(df: DataFrame, dimensions: dict[str, Column | str]) -> DataFrame:
    """dimension, bucket, count: the counts of several columns in long form, from one pass."""
    pairs = F.array(*(F.struct(F.lit(k).alias("dimension"), col(c).cast("string").alias("bucket")) for k, c in dimensions.items()))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.bucket").agg(F.count("*").alias("count"))


def array_histogram(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """source, value, count of the elements of several array columns."""

    def named(a: str) -> Column:
        return F.transform(F.coalesce(col(a).cast("array<string>"), F.array().cast("array<string>")), lambda v: F.struct(F.lit(a).alias("source"), v.alias("value")))

    pairs = F.concat(*map(named, arrays))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.source", "p.value").agg(F.count("*").alias("count"))


def with_total(df: DataFrame, key: str, measures: Sequence[Column], total: str = "TOTAL") -> DataFrame:
    """A row for each value of the key and one for all."""
    out = df.rollup(key).agg(F.grouping(key).alias("_g"), *measures)
    return out.withColumn(key, F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(key).cast("string"))).drop("_g")


def grouping_sets(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """The same measures by several sets of keys, told apart by the column grouping."""
    named = F.when(F.lit(False), "")
    for s in sets:
        mask = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in s)
        named = named.when(F.grouping_id(*keys) == mask, F.lit("+".join(s) or "all"))
    return df.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(named.alias("grouping"), *measures)


def conditional_counts(df: DataFrame, group: str, groups: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """How often each test holds by group, with zeros for groups of the list that no row has."""
    found = df.groupBy(group).agg(*(F.count_if(t).alias(k) for k, t in tests.items()))
    return groups.select(group).join(found, group, "left").select(group, *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in tests))


def confusion(df: DataFrame, truth: str, predicted: str, labels: Sequence, fallback) -> DataFrame:
    """truth, predicted, n for all pairs of labels; unknown predictions count as the fallback, rows of unknown truth are left out."""
    spark = df.sparkSession
    p = F.when(F.col(predicted).isin(*labels), F.col(predicted)).otherwise(F.lit(fallback))
    found = df.filter(F.col(truth).isin(*labels)).groupBy(F.col(truth).alias("truth"), p.alias("predicted")).agg(F.count("*").alias("n"))
    pairs = spark.createDataFrame([(a, b) for a in labels for b in labels], found.select("truth", "predicted").schema)
    return F.broadcast(pairs).join(found, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def label_metrics(table: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of a confusion table; 0 for empty denominators."""
    long = table.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p")))).alias("x"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    out = long.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), (F.sum("hit") / 2).alias("tp"))
    precision, recall = rate(F.col("tp"), F.col("predicted")), rate(F.col("tp"), F.col("support"))
    return out.select("label", "support", precision.alias("precision"), recall.alias("recall"), rate(2 * precision * recall, precision + recall).alias("f1"))


def binary_metrics(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, tn, fn, accuracy, precision, recall and false positive rate, 0 for empty denominators."""
    tp, fp, tn, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(~truth & ~predicted), F.count_if(truth & ~predicted)
    return [
        tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"),
        rate(tp + tn, tp + fp + tn + fn).alias("accuracy"), rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(fp, fp + tn).alias("fpr"),
    ]


def overlapping(df: DataFrame, groups: dict[str, Column], extra: Sequence[Column] = (), measures: Sequence[Column] = ()) -> DataFrame:
    """Measures by groups that may share rows: group names from tests, and further names from columns."""
    names = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in groups.items()), *extra))
    return df.withColumn("group", F.explode(names)).groupBy("group").agg(*measures)


def quantile_cuts(df: DataFrame, value: Column | str, quantiles: Sequence[float]) -> list[float]:
    """Exact quantiles of a column: as many numbers as asked for reach the driver."""
    return df.agg(F.percentile(number(value), F.array(*map(F.lit, quantiles)))).first()[0] or []


def quantile_bucket(value: Column, cuts: Sequence[Column]) -> Column:
    """The number of cuts that do not exceed the value: one equal to a cut goes up; null for null."""
    total = F.lit(0)
    for c in cuts:
        total = total + (value >= c).cast("int")
    return F.when(value.isNotNull(), total)


def invariant(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, variants, same: whether all rows of a key agree."""
    return df.groupBy(*keys).agg(F.count("*").alias("variants"), (F.count_distinct(value) <= 1).alias("same"))


def consistent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value; an error where a key has two values."""
    out = df.groupBy(*keys).agg(F.min(value).alias(value), F.max(value).alias("_max"))
    return out.withColumn("_ok", F.assert_true(F.col(value).eqNullSafe(F.col("_max")), F.lit(f"{value} differs within a key"))).filter(F.col("_ok").isNull()).drop("_ok", "_max")


def cell_density(df: DataFrame, keys: Sequence[str], point: Sequence[str], episode: str, size: float = 5.0) -> DataFrame:
    """keys, cell_*, samples, episodes of each occupied cell of a grid."""
    cells = [F.floor(F.col(c) / size).cast("long").alias(f"cell_{c}") for c in point]
    return df.groupBy(*(F.col(k) for k in keys), *cells).agg(F.count("*").alias("samples"), F.count_distinct(episode).alias("episodes"))


def top_share(df: DataFrame, key: str) -> DataFrame:
    """key, n, share of all rows; the total from a window over the few grouped rows."""
    out = df.groupBy(key).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))
