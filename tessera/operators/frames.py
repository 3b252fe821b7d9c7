"""Choice of the frame that becomes an episode's stop, the rewrites that follow from it, and frames for a sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import col
from tessera.functions.visibility import Policy, clear_reasons, severe_clipping
from tessera.operators.sequence import ordered


def assess(frames: DataFrame, keys: Sequence[str], mask: str, size: Column, p: Policy, collided: Column | None = None, score: Column | None = None, rank: Column | None = None) -> DataFrame:
    """Adds peak, reasons, clear, relative_fill of each frame.

    The peak is the most pixels of an episode's frames that are not severely
    clipped, 0 without any. A frame's fill is compared with the largest fill of
    the clear frames alone; 0 without any.
    """
    w, m = Window.partitionBy(*keys), F.col(mask)
    pixels = F.coalesce(m["pixel_count"], F.lit(0))
    whole = (pixels > 0) & ~severe_clipping(m, p)
    out = frames.withColumn("peak", F.coalesce(F.max(F.when(whole, pixels)).over(w), F.lit(0)))
    out = out.withColumn("reasons", clear_reasons(m, size, F.col("peak"), p, collided, score, rank)).withColumn("clear", F.size("reasons") == 0)
    fill = F.coalesce(m["bbox_fill_fraction"], F.lit(0.0))
    best = F.max(F.when(F.col("clear"), fill)).over(w)
    return out.withColumn("relative_fill", F.when(best > 0, fill / best).otherwise(0.0))


def choose(assessed: DataFrame, keys: Sequence[str], place: str, quality: str, p: Policy) -> DataFrame:
    """keys, selected, quality, peak, candidates of the episodes that have a clear frame.

    Without ``best_within`` that is the first clear one; else the earliest whose
    quality is within it of the best clear one.
    """
    clear = assessed.filter("clear")
    if p.best_within is not None:
        best = F.max(quality).over(Window.partitionBy(*keys))
        clear = clear.withColumn("_best", best)
        near = F.col(quality) >= F.col("_best") - p.best_within
    else:
        near = F.lit(True)
    return clear.groupBy(*keys).agg(
        F.min(F.when(near, F.struct(F.col(place).alias("place"), F.col(quality).alias("quality")))).alias("_s"), F.max("peak").alias("peak"), F.count("*").alias("candidates")
    ).select(*keys, F.col("_s.place").alias("selected"), F.col("_s.quality").alias("quality"), "peak", "candidates")


def choose_safe(assessed: DataFrame, source: DataFrame, collisions: DataFrame, keys: Sequence[str], place: str, hit: str, quality: str, p: Policy) -> DataFrame:
    """As ``choose``, among frames that the source has and whose pose was tried without a hit."""
    safe = collisions.groupBy(*keys, place).agg(F.bool_or(F.coalesce(F.col(hit), F.lit(True))).alias("_hit")).filter("NOT _hit").drop("_hit")
    return choose(assessed.join(source.select(*keys, place).distinct(), [*keys, place], "left_semi").join(safe, [*keys, place], "left_semi"), keys, place, quality, p)


def production_rewrite(rows: DataFrame, assessed: DataFrame, selection: DataFrame, excluded: DataFrame, keys: Sequence[str], place: str, key: str, action: str, quality: str, stop: str = "Stop") -> DataFrame:
    """Rows up to the selected frame, which becomes the stop; excluded keys go but for the selected one.

    Adds original_action (of the stop alone), kept_earlier (a clear frame before
    the selected one, which stays motion, with its quality in earlier_quality) and
    overridden (an excluded key that stays since its motion is replaced).
    Episodes without a selection go.
    """
    sel = selection.select(*keys, F.col("selected").alias("_sel"))
    out = rows.join(sel, list(keys)).filter(F.col(place) <= F.col("_sel"))
    out = out.join(excluded.select(key).distinct().withColumn("_x", F.lit(True)), key, "left")
    out = out.join(assessed.select(*keys, place, F.col("clear").alias("_clear"), F.col(quality).alias("_q")), [*keys, place], "left")
    here, gone = F.col(place) == F.col("_sel"), F.coalesce(F.col("_x"), F.lit(False))
    earlier = ~here & F.coalesce(F.col("_clear"), F.lit(False))
    out = out.filter(here | ~gone).withColumns({"original_action": F.when(here, F.col(action)), "kept_earlier": earlier, "earlier_quality": F.when(earlier, F.col("_q")), "overridden": here & gone, action: F.when(here, F.lit(stop)).otherwise(F.col(action))})
    return out.drop("_sel", "_x", "_clear", "_q")


def navigation_rewrite(rows: DataFrame, excluded: DataFrame, key: str, action: str, cause: Column, reachable: DataFrame | None = None) -> DataFrame:
    """Motion alone: stops, excluded keys and, where a table of reachable keys is given, all others go; adds problem_cause."""
    out = rows.filter(F.lower(F.trim(F.coalesce(F.col(action), F.lit("")))) != "stop").join(excluded.select(key).distinct(), key, "left_anti")
    if reachable is not None:
        out = out.join(reachable.select(key).distinct(), key, "left_semi")
    return out.withColumn("problem_cause", cause)


def removed(rows: DataFrame, excluded: DataFrame, keys: Sequence[str], key: str, action: str) -> DataFrame:
    """keys, stops, removed: what a navigation rewrite takes from each episode."""
    out = rows.join(excluded.select(key).distinct().withColumn("_x", F.lit(True)), key, "left")
    stop = F.lower(F.trim(F.coalesce(F.col(action), F.lit("")))) == "stop"
    return out.groupBy(*keys).agg(F.count_if(stop).alias("stops"), F.count_if(~stop & F.col("_x").isNotNull()).alias("removed"))


def appended_stop(rows: DataFrame, bank: DataFrame, keys: Sequence[str], place: str, member: str, fields: Sequence[str], action: str, source: str, stop: str = "Stop") -> DataFrame:
    """A stop row for each episode from its member of a bank, one place after its last row: the bank's ``fields``, the episode's keys, and where it is from as a struct stop_source."""
    last = rows.groupBy(*keys).agg(F.max(place).alias("_last"), F.first(member).alias(member))
    out = last.join(bank.select(member, *(F.col(f).alias(f"_{f}") for f in fields)), member)
    note = F.struct(F.lit(source).alias("type"), F.col(member).alias("member"), F.col("_last").alias("after"), F.lit(True).alias("selected"))
    return out.select(*keys, (F.col("_last") + 1).alias(place), F.lit(stop).alias(action), *(F.col(f"_{f}").alias(f) for f in fields), note.alias("stop_source"))


def priority_frames(wanted: Column, frames: Column | str, most: int, fallback: bool = True) -> Column:
    """Up to ``most`` numbers of frames that are there, from an array of wanted ones by priority, without repeats, in order; the first frames if none of the wanted is there and a fallback is asked for."""
    there = F.transform(col(frames), lambda f: f.cast("long"))
    found = F.filter(F.transform(wanted, lambda k: k.cast("long")), lambda k: k.isNotNull() & (k >= 0) & F.array_contains(there, k))
    found = F.slice(F.array_distinct(found), 1, most)
    if fallback:
        found = F.when(F.size(found) > 0, found).otherwise(F.slice(there, 1, most))
    return F.array_sort(found)


def sheet(frames: DataFrame, keys: Sequence[str], place: str, quality: str, pixels: str, hit: str, selected: str, most: int) -> DataFrame:
    """Up to ``most`` frames of each episode without hits, for a sheet.

    Of visible ones the best by (quality, pixels), the earliest of equals, where
    the selected frame and that with most pixels always stay; without visible
    ones an even choice over the places.
    """
    safe = frames.filter(~F.coalesce(F.col(hit), F.lit(False)))
    w = Window.partitionBy(*keys)
    seen = F.coalesce(F.col(pixels), F.lit(0)) > 0
    out = safe.withColumn("_any", F.max(seen.cast("int")).over(w) == 1)
    out = out.withColumn("_seen", seen)
    largest = F.min(F.when(F.col("_seen"), F.struct((-F.col(pixels)).alias("p"), F.col(place).alias("k")))).over(w)["k"]
    out = out.withColumn("_kept", F.col("_any") & ((F.col(place) == F.col(selected)) | (F.col(place) == largest)))
    out = out.withColumn("_kept", F.coalesce(F.col("_kept"), F.lit(False)))
    by = Window.partitionBy(*keys).orderBy(F.col("_kept").desc(), F.col("_seen").desc(), F.coalesce(F.col(quality), F.lit(0.0)).desc(), F.col(pixels).desc(), place)
    out = out.withColumns({"_turn": F.row_number().over(by), "_at": F.row_number().over(Window.partitionBy(*keys).orderBy(place)) - 1, "_n": F.count("*").over(w)})
    even = (F.col("_n") <= most) | F.array_contains(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / max(1, most - 1)).cast("int")), F.col("_at").cast("int"))
    keep = F.when(F.col("_any"), (F.col("_kept") | F.col("_seen")) & (F.col("_turn") <= most)).otherwise(even)
    return out.filter(keep).drop("_any", "_seen", "_kept", "_turn", "_at", "_n")


def legacy_stops(rows: DataFrame, keys: Sequence[str], line: str, place: str, action: str, stop: str = "Stop") -> DataFrame:
    """keys, stop_at: the place of the last stop row in line order, else the largest place."""
    at = F.max_by(place, F.when(F.col(action) == stop, F.col(line)))
    return rows.groupBy(*keys).agg(F.coalesce(at, F.max(place)).alias("stop_at"))


def conflicts(steps: DataFrame, keys: Sequence[str], step: str, move: str, train: str, goal: str, least: float = 0.1, gap: float = 0.25) -> DataFrame:
    """keys, train_per_meter, goal_per_meter, conflict_share: over steps that move more than ``least``, progress toward two places, and how often one is neared while the other is left."""
    w = ordered(keys, [step])
    out = steps.withColumns({"_t": F.lag(train).over(w) - F.col(train), "_g": F.lag(goal).over(w) - F.col(goal)}).filter((F.col(move) > least) & F.col("_t").isNotNull())
    length = F.sum(move)
    return out.groupBy(*keys).agg((F.sum("_t") / length).alias("train_per_meter"), (F.sum("_g") / length).alias("goal_per_meter"), F.avg(((F.col("_t") > gap) & (F.col("_g") < -gap)).cast("int")).alias("conflict_share"))
