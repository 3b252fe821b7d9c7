"""How episodes end: success by two rules, outcomes, reports by group, and what stops are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import heading_alignment
from tessera.functions.text import col, safe_name
from tessera.operators.aggregates import number

# The success radius in metres, short names of actions, and in stop_category the names of sources and categories.
RADIUS = 20.0
ALIASES = {
    "move forward": "forward", "forward 3m": "forward", "turn left": "turn_left", "turn left 30 degree": "turn_left", "turn right": "turn_right",
    "turn right 30 degree": "turn_right", "ascend": "ascend", "ascend 3m": "ascend", "descend": "descend", "descend 3m": "descend", "stop": "stop",
}


def end_episodes(steps: DataFrame, keys: Sequence[str], step: str, action: str, distance: str, collided: str, most: int) -> DataFrame:
    """keys, termination, steps, final_distance, success, oracle_reach, legacy_success, legacy_reach of each episode.

    An episode ends at its first collision, its first stop or the step limit,
    whichever comes first; a collision is looked at before the stop of the same
    step, and later steps do not count. By the official rule a success is a
    stop within the radius without collision, and a reach is lost by a
    collision; by the legacy rule a success is any end within the radius, and a
    reach is strictly within it.
    """
    ends = F.when(F.col(collided), "collision").when(F.col(action) == "stop", "stop").when(F.col(step) == most - 1, "step_limit")
    first = steps.withColumn("_end", ends).groupBy(*keys).agg(F.min(F.when(F.col("_end").isNotNull(), F.struct(F.col(step).alias("at"), "_end"))).alias("_e"), F.max(step).alias("_last"))
    rows = steps.join(first, list(keys)).filter(F.col(step) <= F.coalesce(F.col("_e.at"), F.col("_last")))
    # A step that collides ends the episode before its distance counts as a reach.
    counts = ~F.col(collided)
    out = rows.groupBy(*keys).agg(
        F.coalesce(F.first("_e")["_end"], F.lit("unfinished")).alias("termination"),
        F.count("*").alias("steps"),
        F.max(F.struct(step, distance))[distance].alias("final_distance"),
        F.bool_or(counts & (F.col(distance) <= RADIUS)).alias("_reach"),
        F.bool_or(F.col(distance) < RADIUS).alias("legacy_reach"),
    )
    crashed = F.col("termination") == "collision"
    return out.select(
        *keys,
        "termination",
        "steps",
        "final_distance",
        (~crashed & (F.col("termination") == "stop") & (F.col("final_distance") <= RADIUS)).alias("success"),
        (~crashed & F.col("_reach")).alias("oracle_reach"),
        (F.col("final_distance") <= RADIUS).alias("legacy_success"),
        "legacy_reach",
    )


def outcome(success: Column, oracle_reach: Column) -> Column:
    return F.when(success, "success").when(oracle_reach, "osr_only").otherwise("no_official_osr")


def report(episodes: DataFrame, group: Column | str) -> DataFrame:
    """group, num, acc, osr, ne: counts and means; distances that are no numbers are left out."""
    return episodes.groupBy(col(group).alias("group")).agg(F.count("*").alias("num"), F.avg(F.col("success").cast("int")).alias("acc"), F.avg(F.col("oracle_reach").cast("int")).alias("osr"), F.avg(number("final_distance")).alias("ne"))


def canonical_action(c: Column | str) -> Column:
    """A short name of an action; other names stay, none is unknown."""
    t = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    found = F.try_element_at(F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv)), t)
    return F.coalesce(found, F.when(F.length(t) > 0, t), F.lit("unknown"))


def stop_category(source: Column, capture_group: Column, original_action: Column, repaired: Column) -> Column:
    """What a stop row was made of, with a prefix for episodes whose coordinates were repaired."""
    group = F.coalesce(capture_group, F.lit("unknown"))
    plain = (
        F.when(source == "target_facing_standoff_appended_to_original_episode", F.when(group == "repairable", "target_facing_repairable_appended").when(group == "rescue", "below_threshold_rescue_appended").otherwise(F.concat(F.lit("standoff_"), safe_name(group, "unknown"), F.lit("_appended"))))
        .when((source == "expert_path") & (F.lower(F.coalesce(original_action, F.lit(""))) == "stop"), "clear_candidate_stop_unchanged")
        .when(source == "expert_path", "expert_path_relabelled")
        .otherwise("other")
    )
    return F.when(source == "actor_stop_bank_appended_to_original_episode", "actor_stop_bank_appended").otherwise(F.when(repaired, F.concat(F.lit("neighborhood_coordinate_repaired__"), plain)).otherwise(plain))


def chosen_frame(answer: Column | str, frames: Column) -> Column:
    """The frame that an answer names: null for NONE, else that of "choice": "f<n>" or the first f<n>; what is not on offer is an error."""
    t = col(answer)
    quoted, bare = F.regexp_extract(t, r'(?i)"choice"\s*:\s*"?f(\d+)', 1), F.regexp_extract(t, r"(?i)\bf(\d+)\b", 1)
    n = F.coalesce(F.nullif(quoted, F.lit("")), F.nullif(bare, F.lit(""))).try_cast("long")
    ok = F.array_contains(frames, n)
    return F.when(t.rlike(r"(?i)\bNONE\b"), F.lit(None).cast("long")).when(F.coalesce(ok, F.lit(False)), n).otherwise(F.raise_error(F.concat(F.lit("no available frame in "), t)).cast("long"))


def replace_suffix(text: Column | str, marker: str, new: Column | str) -> Column:
    """The text up to the marker, and something else from there on; a text without it is an error."""
    t, suffix = col(text), F.lit(new) if isinstance(new, str) else new
    return F.when(F.instr(t, marker) > 0, F.concat(F.substring_index(t, marker, 1), suffix)).otherwise(F.raise_error(F.lit(f"no {marker!r} in the text")))


def out_of_bounds(x: Column, y: Column, start_x: Column, start_y: Column, radius: float = 50.0) -> Column:
    return (F.abs(x - start_x) > radius) | (F.abs(y - start_y) > radius)


def turn_to_start(x: Column, y: Column, yaw: Column, start_x: Column, start_y: Column, step: float = 0.5235987755982988) -> Column:
    """2 (left, yaw grows) or 3 (right): the turn after which the heading is closer to the start; left on a tie or at the start."""
    dx, dy = start_x - x, start_y - y
    return F.when(heading_alignment(yaw + step, dx, dy) >= heading_alignment(yaw - step, dx, dy), 2).otherwise(3)


def offset_lattice(spark, most: float, step: float = 3.0) -> DataFrame:
    """dx, dy, dz, rank of the offsets to try around a blocked start: a lattice within a radius, nearest first, then upward (negative dz), then the smaller moves."""
    n = int(most // step)
    flat = spark.range(-n, n + 1).select((F.col("id") * step).alias("dx")).crossJoin(spark.range(-n, n + 1).select((F.col("id") * step).alias("dy")))
    flat = flat.filter(F.hypot("dx", "dy") <= most + 1e-6)
    levels = F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.array(*map(F.lit, (-step, -2 * step, -3 * step, step)))).otherwise(F.array(*map(F.lit, (0.0, -step, -2 * step, step))))
    rows = flat.withColumn("dz", F.explode(levels))
    far = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2)
    order = F.array_sort(F.collect_list(F.struct(far.alias("far"), (F.col("dz") >= 0).cast("int").alias("down"), F.abs("dz").alias("level"), (F.abs("dx") + F.abs("dy")).alias("moves"), "dx", "dy", "dz")))
    return rows.agg(order.alias("o")).select(F.posexplode("o").alias("rank", "s")).select("s.dx", "s.dy", "s.dz", "rank")


def first_free_offset(starts: DataFrame, x: Column, y: Column, z: Column, blocked, most: float, step: float = 3.0) -> DataFrame:
    """Adds offset, the first (rank, dx, dy, dz) of the lattice around each start that is not ``blocked`` (a function of x, y and z); null if all are.

    The lattice is one row of a few hundred offsets, sent to every task.
    """
    o = offset_lattice(starts.sparkSession, most, step).agg(F.sort_array(F.collect_list(F.struct("rank", "dx", "dy", "dz"))).alias("_lattice"))
    free = F.filter("_lattice", lambda s: ~F.coalesce(blocked(x + s["dx"], y + s["dy"], z + s["dz"]), F.lit(False)))
    return starts.crossJoin(F.broadcast(o)).withColumn("offset", F.get(free, F.lit(0))).drop("_lattice")
