"""Why episodes fail: overlapping classes of them, and how each class divides, counted in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import quantiles

# Metres and steps that bound near misses, loops and standing still, and the bins of the least distance.
NEAR_MISS, LOOP_STEPS, LOOP_RUN, LOOP_SHARE, STILL_STEPS, STILL_M = 25.0, 20, 12, 0.85, 50, 6.0
BINS = ((20.0, 25.0, "[20,25)"), (25.0, 30.0, "[25,30)"), (30.0, 40.0, "[30,40)"), (40.0, float("inf"), "[40,inf)"))


def classes() -> dict[str, Column]:
    """Tests of an episode by name; an episode may meet several.

    Columns: success, official_osr, observed_reach, reached_then_collided,
    final_within, collision (booleans), termination, minimum_distance, steps,
    longest_turn_run, turn_fraction, net_displacement.
    """
    c, yes = F.col, lambda name: F.coalesce(F.col(name), F.lit(False))
    won, reached, stopped = yes("success"), yes("observed_reach"), c("termination").eqNullSafe("stop")
    return {
        "success": won,
        "official_osr_only": yes("official_osr") & ~won,
        "no_official_osr": ~yes("official_osr") & ~won,
        "stop_terminations": stopped,
        "false_stops": stopped & ~won,
        "false_stops_without_observed_reach": stopped & ~won & ~reached,
        "false_stops_at_step_0": stopped & ~won & (c("steps") == 1),
        "false_stops_within_first_5_actions": stopped & ~won & (c("steps") <= 5),
        "observed_reach_failures": reached & ~won,
        "reached_then_collided": yes("reached_then_collided"),
        "reached_but_never_stopped": reached & ~won & ~stopped,
        "ended_inside_without_stop": yes("final_within") & ~won & ~stopped,
        "never_observed_within": ~reached,
        "near_miss": ~reached & (c("minimum_distance") < NEAR_MISS),
        "collision_before_reach": ~reached & yes("collision"),
        "step_limit_before_reach": ~reached & c("termination").eqNullSafe("step_limit"),
        "turn_loop_candidates": ~reached & (c("steps") >= LOOP_STEPS) & ((c("longest_turn_run") >= LOOP_RUN) | (c("turn_fraction") >= LOOP_SHARE)),
        "low_net_displacement_candidates": ~reached & (c("steps") >= STILL_STEPS) & (c("net_displacement") < STILL_M),
        "collisions": yes("collision"),
    }


def distance_bin(distance: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, name in BINS:
        out = F.when((distance >= low) & (distance < high), name).otherwise(out)
    return out


def divisions() -> dict[str, tuple[str, Column]]:
    """By name a class and the value by which its episodes are counted: terminations, bins of the least distance, last actions, objects hit."""
    return {
        "reach_failure_terminations": ("observed_reach_failures", F.col("termination")),
        "inside_without_stop_terminations": ("ended_inside_without_stop", F.col("termination")),
        "minimum_distance_bins": ("never_observed_within", distance_bin(F.col("minimum_distance"))),
        "collision_final_actions": ("collisions", F.col("final_action")),
        "collision_objects": ("collisions", F.col("collision_object")),
    }


def counts(episodes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, measure, bucket, n: how many episodes are in each class (bucket null), and in each part of the divided ones.

    Each episode becomes the list of what it counts for; a task sends one number
    for each measure, bucket and key. A null part is "none"; classes that no
    episode is in have no row; distances below all bins are in none.
    """
    tests = classes()
    one = lambda name, bucket: F.struct(F.lit(name).alias("measure"), bucket.cast("string").alias("bucket"))
    found = [F.when(test, one(name, F.lit(None))) for name, test in tests.items()]
    for name, (of, value) in divisions().items():
        bucket = value if name == "minimum_distance_bins" else F.coalesce(value.cast("string"), F.lit("none"))
        found.append(F.when(tests[of] & bucket.isNotNull(), one(name, bucket)))
    rows = episodes.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("_c"))
    return rows.groupBy(*keys, "_c.measure", "_c.bucket").agg(F.count("*").alias("n"))


def stop_precision(counted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, stop_precision: successes over stops, 0 without stops; of the rows of ``counts``."""
    of = lambda name: F.coalesce(F.sum(F.when((F.col("measure") == name) & F.col("bucket").isNull(), F.col("n"))), F.lit(0))
    return counted.groupBy(*keys).agg(F.coalesce(F.try_divide(of("success").cast("double"), of("stop_terminations")), F.lit(0.0)).alias("stop_precision"))


def described(episodes: DataFrame, of: str, value: str) -> DataFrame:
    """count, mean, median, p75, p90, p95, min and max of a number over the episodes of a class."""
    rows = episodes.filter(classes()[of]).select(F.lit(of).alias("measure"), value)
    return quantiles.describe(rows, ["measure"], value)
