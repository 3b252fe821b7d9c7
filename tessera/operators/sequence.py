"""Windows over the ordered rows of an episode: runs, islands, prefixes, paths, histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import distance
from tessera.functions.text import col


def running(keys: Sequence[str], order: Sequence[str]):
    """From the episode's first row to the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def ordered(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def longest_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], action: str, turns: Sequence[str]) -> DataFrame:
    """keys, longest_same, longest_alternating, longest_turn_only: runs of equal, of alternating, and of any turns."""
    w = ordered(keys, order)
    turn, before = F.col(action).isin(*turns), F.lag(action).over(w)
    was = F.coalesce(before.isin(*turns), F.lit(False))
    # A new run starts where the row does not continue the one before.
    starts = {"same": ~(turn & was & (F.col(action) == before)), "alternating": ~(turn & was & (F.col(action) != before)), "turn_only": ~(turn & was)}
    out = df.select(*keys, turn.alias("turn"), *order, *(F.coalesce(s, F.lit(True)).cast("int").alias(f"{k}_start") for k, s in starts.items()))
    out = out.withColumns({f"{k}_run": F.sum(f"{k}_start").over(running(keys, order)) for k in starts})
    # A run's length so far is its row number within the episode less that of its first row.
    out = out.withColumn("n", F.row_number().over(w))
    for k in starts:
        out = out.withColumn(f"{k}_from", F.max(F.when(F.col(f"{k}_start") == 1, F.col("n"))).over(running(keys, order)))
    return out.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col("turn"), F.col("n") - F.col(f"{k}_from") + 1)), F.lit(0)).cast("long").alias(f"longest_{k}") for k in starts))


def path_metrics(df: DataFrame, keys: Sequence[str], order: Sequence[str], point: Sequence[str]) -> DataFrame:
    """keys, path_length (sum of steps), net_displacement (first to last), steps."""
    w = ordered(keys, order)
    step = distance([F.col(c) for c in point], [F.lag(c).over(w) for c in point])
    rows = df.withColumn("_step", step)
    place = F.struct(*(F.col(c) for c in order), *(F.col(c).alias(f"_p{k}") for k, c in enumerate(point)))
    out = rows.groupBy(*keys).agg(F.coalesce(F.sum("_step"), F.lit(0.0)).alias("path_length"), F.min(place).alias("_a"), F.max(place).alias("_b"), F.count("*").alias("steps"))
    ends = [[F.col(f"{e}._p{k}") for k in range(len(point))] for e in ("_a", "_b")]
    return out.select(*keys, "path_length", distance(*ends).alias("net_displacement"), "steps")


def reach(df: DataFrame, keys: Sequence[str], step: str, dist: str, radius: float) -> DataFrame:
    """keys, minimum_distance, closest_step (the first of equals), first_reach_step, steps, steps_after_reach; a step of -1 is the start."""
    out = df.groupBy(*keys).agg(
        F.min(F.struct(F.col(dist), F.col(step))).alias("_m"),
        F.min(F.when(F.col(dist) <= radius, F.col(step))).alias("first_reach_step"),
        F.count_if(F.col(step) >= 0).alias("steps"),
    )
    return out.select(*keys, F.col(f"_m.{dist}").alias("minimum_distance"), F.col(f"_m.{step}").alias("closest_step"), "first_reach_step", "steps", (F.col("steps") - F.col("first_reach_step") - 1).alias("steps_after_reach"))


def reachability(df: DataFrame, keys: Sequence[str], order: Sequence[str], barrier: Column, blocked: Column, place: str) -> DataFrame:
    """Adds reachable and barrier_at: a row is reachable iff no earlier row is a barrier and it is not blocked itself; barrier_at is the first earlier barrier."""
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(barrier, F.col(place))).over(earlier)
    return df.withColumn("barrier_at", first).withColumn("reachable", F.col("barrier_at").isNull() & ~F.coalesce(blocked, F.lit(True)))


def islands(df: DataFrame, keys: Sequence[str], place: str, out: str = "segment") -> DataFrame:
    """Numbers, from 0, the stretches of consecutive values of ``place`` in each episode."""
    rows = df.withColumn("_g", F.col(place) - F.row_number().over(ordered(keys, [place])))
    return rows.withColumn(out, F.dense_rank().over(ordered(keys, ["_g"])) - 1).drop("_g")


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], seconds: Column, gap: float, out: str = "session") -> DataFrame:
    """Numbers, from 0, the sessions of each key: a new one after a gap of more than so many seconds."""
    new = F.coalesce((seconds - F.lag(seconds).over(ordered(keys, order)) > gap).cast("int"), F.lit(0))
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(running(keys, order))).drop("_new")


def history(c: Column | str, keys: Sequence[str], order: Sequence[str], n: int) -> Column:
    """The last n values up to the current row, oldest first; fewer at the start."""
    return F.collect_list(col(c)).over(ordered(keys, order).rowsBetween(-(n - 1), 0))


def trailing_run(flag: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """How many rows up to the current one have the flag, without a break."""
    n = F.row_number().over(ordered(keys, order))
    return (n - F.coalesce(F.max(F.when(~F.coalesce(flag, F.lit(False)), F.col("_row"))).over(running(keys, order)), F.lit(0))).cast("long")


def with_row(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds _row, the place in the episode from 1, which trailing_run needs."""
    return df.withColumn("_row", F.row_number().over(ordered(keys, order)))


def truncate_at(df: DataFrame, selection: DataFrame, keys: Sequence[str], place: str, action: str, stop: str = "Stop") -> DataFrame:
    """Rows up to the selected one, which becomes the stop and keeps its action in original_action; episodes without a selection go."""
    rows = df.join(selection.select(*keys, F.col(place).alias("_sel")), list(keys)).filter(F.col(place) <= F.col("_sel"))
    chosen = F.col(place) == F.col("_sel")
    return rows.withColumn("original_action", F.when(chosen, F.col(action))).withColumn(action, F.when(chosen, F.lit(stop)).otherwise(F.col(action))).drop("_sel")


def append_stop(df: DataFrame, keys: Sequence[str], place: str, action: str, stop: str = "Stop") -> DataFrame:
    """A copy of each episode's last row one place further as its stop; an episode that has a stop is an error."""
    w = Window.partitionBy(*keys)
    last = df.withColumn("_last", F.max(place).over(w)).withColumn("_stops", F.count_if(F.col(action) == stop).over(w)).filter(F.col(place) == F.col("_last"))
    last = last.withColumn("_ok", F.assert_true(F.col("_stops") == 0, F.lit("the episode has a stop"))).filter(F.col("_ok").isNull())
    return df.unionByName(last.withColumn(place, F.col(place) + 1).withColumn(action, F.lit(stop)).select(*df.columns))


def contiguous_violations(df: DataFrame, keys: Sequence[str], line: str) -> DataFrame:
    """keys, pieces of the episodes whose rows do not stand together in line order."""
    g = F.col(line) - F.row_number().over(ordered(keys, [line]))
    return df.withColumn("_g", g).groupBy(*keys).agg(F.count_distinct("_g").alias("pieces")).filter("pieces > 1")


def not_increasing(df: DataFrame, keys: Sequence[str], line: str, value: str) -> DataFrame:
    """Rows whose value does not exceed that of the row before in line order."""
    return df.withColumn("previous", F.lag(value).over(ordered(keys, [line]))).filter(F.col(value) <= F.col("previous"))


def stop_rules(df: DataFrame, keys: Sequence[str], order: Sequence[str], action: str, stop: str = "Stop") -> DataFrame:
    """keys, stops, stop_is_last of every episode."""
    last = F.max(F.struct(*(F.col(c) for c in order), F.col(action).alias("_a")))["_a"]
    return df.groupBy(*keys).agg(F.count_if(F.col(action) == stop).alias("stops"), F.coalesce(last == stop, F.lit(False)).alias("stop_is_last"))


def later_improvement(df: DataFrame, keys: Sequence[str], place: str, selected: str, pixels: str, quality: str, growth: float, drop: float) -> DataFrame:
    """Per episode the best later row than the selected one: pixels grown by a factor at no more than a drop of quality; of those the largest (quality, pixels), the earliest of equals."""
    sel = df.filter(F.col(place) == F.col(selected)).select(*keys, F.col(pixels).alias("_px"), F.col(quality).alias("_q"))
    later = df.filter(F.col(place) > F.col(selected)).join(sel, list(keys)).filter((F.col(pixels) >= growth * F.col("_px")) & (F.col(quality) >= F.col("_q") - drop))
    best = F.max(F.struct(F.col(quality).alias("q"), F.col(pixels).alias("p"), (-F.col(place)).alias("at")))
    return later.groupBy(*keys).agg(best.alias("b")).select(*keys, (-F.col("b.at")).alias(place), F.col("b.q").alias(quality), F.col("b.p").alias(pixels))


def reuse_index(i: Column, bank: Column) -> Column:
    """(member, reuse): round-robin assignment of the i-th (from 0) to a bank of a size."""
    return F.struct(F.pmod(i, bank).alias("member"), (F.floor(i / bank) + 1).cast("long").alias("reuse"))


def similarity_rank(similarities: Column | str, target: Column) -> Column:
    """(rank, margin) of one place (from 1) in a vector: one more than the strictly greater ones; the lead over the best other."""
    own = F.element_at(col(similarities), target)
    others = F.filter(F.transform(col(similarities), lambda x, k: F.when(k + 1 != target, x)), lambda x: x.isNotNull())
    return F.struct((F.size(F.filter(col(similarities), lambda x: x > own)) + 1).alias("rank"), (own - F.array_max(others)).alias("margin"))
