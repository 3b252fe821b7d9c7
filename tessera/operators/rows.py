"""Keys, duplicate policies, expectations and set operations over rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import col, falsy_coalesce
from tessera.sources.scratch import written


def sample_key(scene="scene_id", episode="episode_id", pose="pose_idx", frame="frame_idx") -> Column:
    """scene::episode::pose::frame, the frame as a whole number."""
    return F.concat_ws("::", col(scene), col(episode), col(pose), col(frame).cast("long").cast("string"))


def stored_or_built(key: Column | str, built: Column) -> Column:
    """A stored key unless it is null or empty."""
    return falsy_coalesce(col(key), built)


def key_from_image_path(path: Column | str, camera: str = "camera_0") -> Column:
    """scene::episode::pose::frame of .../images/scene/episode/pose/<camera>/frame.ext; null for other paths."""
    part = r"([^/\\]+)[/\\]"
    pattern = rf".*[/\\]images[/\\]{part}{part}{part}{camera}[/\\](\d+)\.[^./\\]+$"
    parts = [F.regexp_extract(col(path), pattern, k) for k in range(1, 5)]
    return F.when(parts[0] != "", F.concat_ws("::", *parts[:3], parts[3].try_cast("long").cast("string")))


def is_error(error: Column, failed: Column, status: Column) -> Column:
    return (F.length(F.coalesce(error, F.lit(""))) > 0) | F.coalesce(failed, F.lit(False)) | F.coalesce(status == "error", F.lit(False))


POLICIES = ("first", "last", "last_success", "success_over_error", "raise")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], policy: str = "last", error: Column | None = None, ties: Sequence[Column | str] = ()) -> DataFrame:
    """One row a key.

    first and last by ``order``; last_success: the last row without error, else
    the last; success_over_error: the last row without error, else the first;
    raise: the rows as they are, and an error where a key has two. ``order``
    must tell all rows of a key apart, or ``ties`` the ones that it leaves equal:
    of these the first is taken, under every policy.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    up, down = ([*(turned(col(c)) for c in order), *(col(c).asc_nulls_first() for c in ties)] for turned in (Column.asc_nulls_first, Column.desc_nulls_last))
    if policy == "raise":
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("_n", n).withColumn("_n", F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate key "), F.concat_ws("::", *(F.col(k).cast("string") for k in keys))))).filter(F.col("_n").isNull()).drop("_n")
    bad = F.coalesce(error, F.lit(False)).cast("int") if error is not None else F.lit(0)
    if policy == "success_over_error":
        n = F.when(bad == 0, F.row_number().over(Window.partitionBy(*keys, bad).orderBy(*down))).otherwise(F.row_number().over(Window.partitionBy(*keys, bad).orderBy(*up)))
        best = F.row_number().over(Window.partitionBy(*keys).orderBy("_bad", "_n"))
        return df.withColumns({"_bad": bad, "_n": n}).withColumn("_n", best).filter("_n = 1").drop("_bad", "_n")
    by = {"first": up, "last": down, "last_success": [bad.asc(), *down]}[policy]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_n = 1").drop("_n")


def require(df: DataFrame, test: Column, message: str) -> DataFrame:
    """The rows as they are; a row for which the test is not true makes the job fail when it is read."""
    return df.withColumn("_ok", F.assert_true(F.coalesce(test, F.lit(False)), F.lit(message))).filter(F.col("_ok").isNull()).drop("_ok")


def union_unique(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All rows of the parts; a key in two of them, or twice in one, is an error."""
    return dedupe(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), keys, [F.lit(1)], "raise")


def replace_partition(base: DataFrame, repair: DataFrame, part: Column) -> DataFrame:
    """The base without the rows of a partition, and the repair's rows of it."""
    return base.filter(~F.coalesce(part, F.lit(False))).unionByName(repair.filter(part), allowMissingColumns=True)


def coverage(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, expected, observed, status of every key: ok, missing, extra, duplicate."""
    e, o = expected.groupBy(*keys).agg(F.count("*").alias("expected")), observed.groupBy(*keys).agg(F.count("*").alias("observed"))
    n, m = F.coalesce("expected", F.lit(0)), F.coalesce("observed", F.lit(0))
    status = F.when(m == 0, "missing").when(n == 0, "extra").when(m > n, "duplicate").otherwise("ok")
    return e.join(o, list(keys), "full").select(*keys, n.cast("long").alias("expected"), m.cast("long").alias("observed"), status.alias("status"))


def violations(rules: dict[str, tuple[DataFrame, Column, Column]]) -> DataFrame:
    """rule, key of each row that breaks a rule; a rule is rows, a test that good rows pass, and the key to report."""
    parts = [df.filter(~F.coalesce(test, F.lit(False))).select(F.lit(name).alias("rule"), key.cast("string").alias("key")) for name, (df, test, key) in rules.items()]
    return reduce(DataFrame.unionAll, parts)


def violation_summary(found: DataFrame, examples: int = 10) -> DataFrame:
    """rule, violations, examples (the smallest keys, joined)."""
    w = Window.partitionBy("rule").orderBy("key")
    few = found.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= examples).groupBy("rule").agg(F.array_join(F.sort_array(F.collect_list("key")), ",").alias("examples"))
    return found.groupBy("rule").agg(F.count("*").alias("violations")).join(few, "rule", "left")


def conflicts(df: DataFrame, input_columns: Sequence[str], label: str, order: str) -> DataFrame:
    """Per distinct input (a sha2 digest): rows, exact duplicates, rows whose label differs from the first one's."""
    digest = F.sha2(F.concat_ws("\u0000", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in input_columns)), 256)
    rows = df.select(digest.alias("digest"), F.col(label).alias("label"), F.col(order).alias("ord"))
    first = rows.groupBy("digest").agg(F.min(F.struct("ord", "label"))["label"].alias("first_label"), F.count("*").alias("rows"))
    return rows.join(first, "digest").groupBy("digest").agg(
        F.first("rows").alias("rows"),
        (F.count_if(F.col("label").eqNullSafe(F.col("first_label"))) - 1).alias("exact_duplicates"),
        F.count_if(~F.col("label").eqNullSafe(F.col("first_label"))).alias("conflicts"),
    )


def numbered(df: DataFrame, order: Sequence[str], out: str = "place") -> DataFrame:
    """Adds the place of each row, from 0, in an order that tells rows apart: rows are dealt by ranges, numbered in each, and the sizes of the ranges before are added."""
    dealt = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn("_k", within).join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p").withColumn(out, F.col("_b") + F.col("_k") - 1).drop("_p", "_k", "_b")


def any_of(*tests: Column) -> Column:
    return reduce(or_, tests)


def all_of(*tests: Column) -> Column:
    return reduce(and_, tests)
