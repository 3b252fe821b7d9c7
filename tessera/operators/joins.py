"""Joins with the policies of episode data: missing sides, overrides, attempts, positions, nearest points, as-of."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import distance
from tessera.operators.rows import all_of, dedupe, numbered, require


def left_with_policy(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, policy: str, default: Column | None = None) -> DataFrame:
    """The value of the right side by key: missing ones raise (error), go (skip) or get the default (fill)."""
    out = left.join(right.select(*keys, F.col(value)), list(keys), "left")
    if policy == "error":
        return out.withColumn("_ok", F.assert_true(F.col(value).isNotNull(), F.lit(f"{value} is missing"))).filter(F.col("_ok").isNull()).drop("_ok")
    if policy == "skip":
        return out.filter(F.col(value).isNotNull())
    if policy == "fill":
        return out.withColumn(value, F.coalesce(F.col(value), default))
    raise ValueError(f"unknown policy {policy}")


def excluded_keys(original: DataFrame, repair: DataFrame, key: str, hit: Column, error: Column, order: Sequence[str], ties: Sequence[str] = ()) -> DataFrame:
    """The keys to leave out: repaired ones by their last repair without error (of equals in ``order`` the first in ``ties``), all others if any row is a hit or an unresolved error.

    A repair that may have an error is none. One without a known hit or place in
    ``order`` still makes its key a repaired one, but says nothing where another does.
    """
    told = all_of(hit.isNotNull(), *(F.col(c).isNotNull() for c in order))
    last = dedupe(repair.filter(F.coalesce(~error, F.lit(False))).withColumn("_told", told), [key], ["_told", *order], "last", ties=ties)
    bad = original.join(last.select(key), key, "left_anti").groupBy(key).agg(F.bool_or(F.coalesce(hit, F.lit(False)) | F.coalesce(error, F.lit(False))).alias("_bad")).filter("_bad").select(key)
    return bad.union(last.filter(F.col("_told") & hit).select(key)).distinct()


def exclude(rows: DataFrame, excluded: DataFrame, key: str, keep: Column) -> DataFrame:
    """Rows whose key is not excluded, and those that the test keeps all the same."""
    out = rows.join(excluded.select(key).withColumn("_x", F.lit(True)), key, "left")
    return out.filter(F.col("_x").isNull() | F.coalesce(keep, F.lit(False))).drop("_x")


def upsert(base: DataFrame, repair: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The base with the last repair of each key in place of its rows, and repairs of new keys; rows without a key stay."""
    last = dedupe(repair.filter(F.col(key).isNotNull()), [key], order, "last").select(*base.columns)
    return base.join(last.select(key), key, "left_anti").select(*base.columns).unionByName(last)


def positional(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Rows of both sides at the same place; where one side ends first, its columns are null. Both have the column ``by``."""
    return left.join(right, by, "full")


def zipped(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str], strict: bool = True, place: str = "place") -> DataFrame:
    """Rows of both sides side by side, each side in its own order, which tells its rows apart; sides of different lengths are an error where strict, else the longer one's rest has nulls beside it."""
    out = numbered(left.withColumn("_left", F.lit(True)), left_order, place).join(numbered(right.withColumn("_right", F.lit(True)), right_order, place), place, "full")
    if strict:
        out = require(out, F.col("_left").isNotNull() & F.col("_right").isNotNull(), "the sides have different lengths")
    return out.drop("_left", "_right")


def nested_left(frames: DataFrame, array: str, by: str, extra: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """Adds a field from ``extra`` (keys, by, field) to the structs of an array column, in the array's order, and how many were found."""
    rows = frames.select(*keys, F.posexplode(array).alias("_i", "_f"))
    rows = rows.withColumn("_by", F.col(f"_f.{by}")).join(extra.select(*keys, F.col(by).alias("_by"), F.col(field).alias("_v")), [*keys, "_by"], "left")
    out = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", F.col("_f").withField(field, F.col("_v")).alias("f")))), lambda s: s["f"]).alias(array), F.count("_v").alias("attached"))
    return frames.drop(array).join(out, list(keys), "left")


def paired(a: DataFrame, b: DataFrame, keys: Sequence[str], field: str) -> DataFrame:
    """pairs, gains, losses, both, neither of a boolean between two runs with the same keys."""
    met = a.select(*keys, F.col(field).alias("_a")).join(b.select(*keys, F.col(field).alias("_b")), list(keys))
    p, q = F.col("_a"), F.col("_b")
    return met.agg(F.count("*").alias("pairs"), F.count_if(~p & q).alias("gains"), F.count_if(p & ~q).alias("losses"), F.count_if(p & q).alias("both"), F.count_if(~p & ~q).alias("neither"))


def fallback_chain(rows: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], value: str, default) -> DataFrame:
    """A value from the first of several tables that has the row's keys, else the default."""
    out, names = rows, []
    for k, (t, keys) in enumerate(tables):
        out = out.join(t.select(*keys, F.col(value).alias(f"_v{k}")), list(keys), "left")
        names.append(f"_v{k}")
    return out.withColumn(value, F.coalesce(*names, F.lit(default))).drop(*names)


def override(rows: DataFrame, manual: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Fields of the manual table, where it has the key and no null, over those of the rows."""
    out = rows.join(manual.select(key, *(F.col(f).alias(f"_{f}") for f in fields)), key, "left")
    return out.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields}).drop(*(f"_{f}" for f in fields))


def nearest_point(queries: DataFrame, points: DataFrame, query_id: str, point_id: str, axes: Sequence[str], size: float, keys: Sequence[str] = ()) -> DataFrame:
    """query_id, point_id, distance of the nearest point (of equals the smallest id), by grid cells of a size, its doubles and its halves.

    One point of each cell of each level stands for it. The nearest of those in
    whose cells a query lies bounds its search: the nearest point is no farther,
    so it lies in the cells that this distance reaches, two an axis at the level
    whose cells are twice as wide; only points within it go on. Cells are halved
    until they are small beside the mean gap of the points, so that what a
    query meets does not grow with the table. At the last level all lie in one
    cell, so each query with any point under its keys has a row, however far
    away. Points and queries are reduced to one a place first, so a hot place is
    one row.
    """
    points = points.groupBy(*keys, *axes).agg(F.min(point_id).alias(point_id))
    both = points.select(*axes, F.lit(1).alias("_p")).unionByName(queries.select(*axes, F.lit(None).cast("int").alias("_p")))
    found = both.agg(F.count("_p").alias("n"), *(f(c).cast("double").alias(f"{name}{k}") for k, c in enumerate(axes) for name, f in (("h", F.max), ("l", F.min), ("s", F.stddev_pop)))).first()
    value = lambda name: [float(found[f"{name}{k}"] or 0) for k in range(len(axes))]
    low = value("l")
    wide, spread = (max(x, default=0.0) for x in ([h - b for h, b in zip(value("h"), low, strict=True)], value("s")))
    top = max(0, math.ceil(math.log2(wide / size)) + 1) if wide > size else 1
    finest = min(0, math.floor(math.log2(spread / size / max(found["n"], 1) ** (1 / len(axes)))) - 2) if spread > 0 else 0
    names, place = [f"_c{k}" for k in range(len(axes))], [f"_p{k}" for k in range(len(axes))]
    width = F.lit(float(size)) * F.pow(F.lit(2.0), "_level")
    cell = lambda c, k: F.floor((c - low[k]) / width).cast("long")
    cells = [cell(F.col(c), k).alias(n) for k, (n, c) in enumerate(zip(names, axes, strict=True))]
    levels = F.explode(F.sequence(F.lit(finest), F.lit(top)))
    gap = distance([F.col(c) for c in axes], [F.col(p) for p in place])

    stored = points.withColumn("_level", levels).select(*keys, "_level", *cells, point_id, *(F.col(c).alias(p) for p, c in zip(place, axes, strict=True)))
    asked = queries.select(*keys, *axes).distinct()
    one = stored.dropDuplicates([*keys, "_level", *names]).select(*keys, "_level", *names, *place)
    reach = asked.withColumn("_level", levels).select("*", *cells).join(one, [*keys, "_level", *names]).groupBy(*keys, *axes).agg(F.min(gap).alias("_far"))
    doubled = F.ceil(F.log2(F.col("_far") * 2 / size)).cast("int")  # null where a point lies at the place itself
    near = reach.withColumn("_level", F.least(F.greatest(doubled, F.lit(finest)), F.lit(top)))
    beyond = F.col("_far") * (1 + 1e-9)
    for k, (name, c) in enumerate(zip(names, axes, strict=True)):
        near = near.withColumn(name, F.explode(F.sequence(cell(F.col(c) - beyond, k), cell(F.col(c) + beyond, k))))
    met = near.join(stored, [*keys, "_level", *names]).withColumn("_gap", gap).filter(F.col("_gap") <= F.col("_far"))
    best = met.groupBy(*keys, *axes).agg(F.min(F.struct(F.col("_gap").alias("distance"), F.col(point_id))).alias("_b"))
    out = queries.select(*keys, query_id, *axes).join(best, [*keys, *axes])
    return out.select(*keys, query_id, F.col(f"_b.{point_id}").alias(point_id), F.col("_b.distance").alias("distance"))


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], tolerance: Column | None = None) -> DataFrame:
    """The latest right row of the key at or before each left row's time: both sides in one sort, the last right row carried on; no pairs are made."""
    r = right.select(*keys, time, F.struct(F.col(time).alias("_t"), *values).alias("_r"), F.lit(0).alias("_side"))
    pad = [F.lit(None).cast(f.dataType).alias(f.name) for f in left.schema if f.name not in (*keys, time)]
    both = r.select(*keys, time, "_r", "_side", *pad).unionByName(left.withColumns({"_r": F.lit(None).cast(r.schema["_r"].dataType), "_side": F.lit(1)}))
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    near = F.col("_r._t") >= F.col(time) - tolerance if tolerance is not None else F.lit(True)
    return out.select(*left.columns, *(F.when(near, F.col(f"_r.{v}")).alias(v) for v in values))


def interval(events: DataFrame, ranges: DataFrame, keys: Sequence[str], at: str, start: str, end: str, width: float) -> DataFrame:
    """Events within ranges [start, end) of the same keys, joined on equal keys, levels and bins.

    A range's level is the number of doublings of ``width`` that reach its
    length, so whatever its length it lies in two bins of its level. Events are
    laid out in a bin of each level that some range has (70 at most, found
    first): one, where ranges have about one length. Null bounds, and ranges that
    end before they start, hold nothing.
    """
    length = F.greatest((F.col(end) - F.col(start)).cast("double"), F.lit(width))
    level = F.ceil(F.log2(length / width)).cast("int")
    level = F.when(F.pow(F.lit(2.0), level) * width < length, level + 1).otherwise(level)
    bins = lambda c, l: F.floor(F.col(c) / (F.pow(F.lit(2.0), l) * width))  # noqa: E731, E741
    laid = ranges.filter(F.col(end) > F.col(start)).withColumn("_level", level)
    levels = sorted(r[0] for r in laid.select("_level").distinct().collect())
    laid = laid.withColumn("_bin", F.explode(F.sequence(bins(start, F.col("_level")), bins(end, F.col("_level")))))
    each = events.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", bins(at, F.col("_level")))
    return each.join(laid, [*keys, "_level", "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bin")


def all_equal(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(and_, (a[c].eqNullSafe(b[c]) for c in columns))


def any_differs(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(or_, (~a[c].eqNullSafe(b[c]) for c in columns))
