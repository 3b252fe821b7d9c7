"""What an agent remembers of its episode, as windows over its executed steps.

A step has its action and the pose after it (x, y, z, yaw in degrees); the pose
before the first one is the row of step 0 with a null action. All states are of
the moment after the step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.actions import TRANSLATIONS, TURNS
from tessera.functions.geometry import distance, wrap_degrees
from tessera.functions.actions import lookup
from tessera.operators.sequence import ordered, running

# Thresholds of the states, in metres and degrees.
STAGNANT_M = REVISIT_M = 1.0  # also how near a loop ends to its start
LOOP_TURN, LOOP_YAW, LOOP_STEPS = 300.0, 15.0, 10
DIRECTION = {TURNS[0]: "left", TURNS[1]: "right"}


def effects(df: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """Adds translation, heading_change, distance_traveled and mean_heading_change."""
    w, run = ordered(keys, [step]), running(keys, [step])
    p = [F.col(c) for c in ("x", "y", "z")]
    out = df.withColumns({"translation": distance(p, [F.lag(c).over(w) for c in ("x", "y", "z")]), "heading_change": F.abs(wrap_degrees(F.col("yaw") - F.lag("yaw").over(w)))})
    return out.withColumns({"distance_traveled": F.coalesce(F.sum("translation").over(run), F.lit(0.0)), "mean_heading_change": F.coalesce(F.avg("heading_change").over(run), F.lit(0.0))})


def _first_near(df: DataFrame, keys: Sequence[str], step: str, name: str, angle: float | None = None) -> DataFrame:
    """Adds the first (s, m, h) of the same keys with a pose nearer than REVISIT_M, and by less than an angle in yaw.

    Poses are reduced to one row a place before those of neighbouring cells meet.
    """
    at = ["x", "y", "z", *(["yaw"] if angle else [])]
    same = F.struct(*keys).alias("_k")  # equal for null keys too
    first = F.struct(F.col(step).alias("s"), F.col("_moves").alias("m"), F.col("_heading").alias("h"))
    poses = df.groupBy(same, *at).agg(F.min(first).alias(name))
    cell = {c: F.floor(F.col(c) / REVISIT_M).cast("long") for c in at[:3]}
    if angle:
        cell["yaw"] = F.floor(F.pmod(F.col("yaw"), F.lit(360.0)) / angle).cast("long")
    round_ = round(360 / angle) if angle else 0
    near = poses.select("_k", *at)
    for c in at:
        around = F.explode(F.sequence(cell[c] - 1, cell[c] + 1))
        near = near.withColumn(f"_c{c}", around)
        if c == "yaw":
            near = near.withColumn(f"_c{c}", F.pmod(F.col(f"_c{c}"), F.lit(round_)))
    stored = poses.select("_k", name, *(F.col(c).alias(f"_p{c}") for c in at), *((F.pmod(cell[c], F.lit(round_)) if c == "yaw" else cell[c]).alias(f"_c{c}") for c in at))
    met = distance([F.col(c) for c in at[:3]], [F.col(f"_p{c}") for c in at[:3]]) < REVISIT_M
    if angle:
        met = met & (F.abs(wrap_degrees(F.col("yaw") - F.col("_pyaw"))) < angle)
    found = near.join(stored, ["_k", *(f"_c{c}" for c in at)]).filter(met).groupBy("_k", *at).agg(F.min(name).alias(name))
    return df.withColumn("_k", F.struct(*keys)).join(found, ["_k", *at], "left").drop("_k")


def states(df: DataFrame, keys: Sequence[str], step: str, action: str = "action", n: int = 5) -> DataFrame:
    """Adds net_displacement, revisiting, motion_state, turn_state, action_pattern, last_translation, decision_mode and avoid_turn of each step.

    Steps are numbered from 0 without gaps. What lies back more than n steps is
    found by the first step with a pose near the current one, in the episode or in
    its run of turns: all that is asked of an earlier step holds for the first
    if it holds for any. So an episode can have any length.
    """
    w, run = ordered(keys, [step]), running(keys, [step])
    out = effects(df, keys, step)
    turn, moved = F.col(action).isin(*TURNS), F.col(action).isin(*TRANSLATIONS)
    out = out.withColumns(
        {
            "_turns": F.coalesce(F.sum(F.coalesce(turn, F.lit(False)).cast("int")).over(run), F.lit(0)),
            "_moves": F.coalesce(F.sum(F.coalesce(moved, F.lit(False)).cast("int")).over(run), F.lit(0)),
            "_heading": F.coalesce(F.sum("heading_change").over(run), F.lit(0.0)),
            "_turned": F.coalesce(F.max(F.when(~F.coalesce(turn, F.lit(False)), F.col(step))).over(run), F.lit(-1)),
            "_recent": F.filter(F.collect_list(action).over(w.rowsBetween(-(n - 1), 0)), lambda a: a.isNotNull()),
        }
    )
    first = w.rowsBetween(-n, 0)
    out = out.withColumn("net_displacement", distance([F.col(c) for c in ("x", "y", "z")], [F.first(c).over(first) for c in ("x", "y", "z")]))
    out = _first_near(out, keys, step, "_revisit")
    out = _first_near(out, [*keys, "_turned"], step, "_looped", LOOP_YAW)
    s, old, start = F.col(step), F.col("_revisit"), F.col("_looped")
    # A pose older than n steps, near the current one, with a translation since.
    revisit = (old["s"] <= s - n) & (F.col("_moves") > old["m"]) & (s > n)
    loop = (start["s"] <= s - LOOP_STEPS) & (F.col("_heading") - start["h"] >= LOOP_TURN)
    out = out.withColumns({"revisiting": F.coalesce(revisit, F.lit(False)), "_loop": F.coalesce(loop, F.lit(False))})
    recent = F.col("_recent")
    motion = (
        F.when(s == 0, "not_started")
        .when(F.col("revisiting"), "revisiting")
        .when(F.exists(recent, lambda a: a.isin(*TRANSLATIONS)), F.when(F.col("net_displacement") < STAGNANT_M, "stagnant").otherwise("progressing"))
        .otherwise("stationary_scanning")
    )
    four = F.slice(recent, -4, 4)
    pairs = F.zip_with(F.slice(four, 1, 3), F.slice(four, 2, 3), lambda a, b: a != b)
    oscillating = (F.size(recent) >= 4) & F.forall(F.when(F.size(recent) >= 4, four), lambda a: a.isin(*TURNS)) & F.forall(F.when(F.size(recent) >= 4, pairs), lambda d: d) & (F.col("net_displacement") < STAGNANT_M)
    same = Window.partitionBy(*keys).orderBy(step)
    out = out.withColumn("_changed", F.coalesce((F.col(action) != F.lag(action).over(same)).cast("int"), F.lit(1)))
    out = out.withColumn("_since", s - F.max(F.when(F.col("_changed") == 1, s)).over(run) + 1)
    direction = lookup(DIRECTION, action)
    turns = F.when(F.col("_loop"), "full_rotation_loop").when(F.coalesce(oscillating, F.lit(False)), "oscillating").when(direction.isNull(), "none").otherwise(F.concat(F.lit("scan_"), direction, F.lit("_x"), F.col("_since").cast("string")))
    out = out.withColumns({"motion_state": motion, "turn_state": turns})
    out = out.withColumn("action_pattern", pattern(recent))
    out = out.withColumns({"last_translation": F.last(F.when(moved, F.col(action)), ignorenulls=True).over(run), "_last_m": F.last(F.when(moved, F.col("translation")), ignorenulls=True).over(run)})
    mode = (
        F.when(F.col("turn_state") == "full_rotation_loop", "LOOP_RECOVERY")
        .when(F.col("turn_state") == "oscillating", "OSCILLATION_RECOVERY")
        .when(F.col("motion_state") == "revisiting", "POSITION_RECOVERY")
        .when(moved & (F.col("_last_m") < STAGNANT_M), "FAILED_TRANSLATION_RECOVERY")
        .otherwise("NORMAL")
    )
    out = out.withColumn("decision_mode", mode)
    avoid = F.when(direction.isNull(), "none").when(F.col("decision_mode") == "LOOP_RECOVERY", direction).when(F.col("decision_mode") == "OSCILLATION_RECOVERY", F.when(direction == "right", "left").otherwise("right")).otherwise("none")
    out = out.withColumn("avoid_turn", avoid)
    return out.drop(*(c for c in out.columns if c.startswith("_")))


def pattern(recent):
    """Recent actions in short: one turn n times, alternating or mixed turns, one motion n times, mixed motion, none."""
    names = F.transform(recent, lambda a: F.coalesce(lookup(DIRECTION, a), lookup({c: c.split()[0] for c in TRANSLATIONS}, a), F.lit("other")))
    size, one = F.size(names), F.size(F.array_distinct(names)) == 1
    all_turns = F.forall(names, lambda a: a.isin("left", "right"))
    alternating = F.forall(F.zip_with(F.slice(names, 1, F.greatest(size - 1, F.lit(0))), F.slice(names, 2, F.greatest(size - 1, F.lit(0))), lambda a, b: a != b), lambda d: d)
    head = F.element_at(names, 1)
    return (
        F.when(size == 0, "none")
        .when(all_turns & one, F.concat(head, F.lit("_turn_x"), size.cast("string")))
        .when(all_turns & alternating, "alternating_turns")
        .when(all_turns, "mixed_turns")
        .when(one, F.concat(head, F.lit("_x"), size.cast("string")))
        .otherwise("mixed_motion")
    )


def transitions(df: DataFrame, keys: Sequence[str], step: str, action: str = "action", n: int = 5) -> DataFrame:
    """Adds transitions: the last n (step, action, pose after) of each step, oldest first."""
    row = F.when(F.col(action).isNotNull(), F.struct(F.col(step).alias("step"), F.col(action).alias("action"), F.array("x", "y", "z", "yaw").alias("pose_after")))
    return df.withColumn("transitions", F.collect_list(row).over(ordered(keys, [step]).rowsBetween(-(n - 1), 0)))


def restart_reason(alive, stale_seconds, active, limit: float = 300.0, restart_if_idle: bool = True):
    """Why a worker is to be started anew: missing, then stale, then never active; null if it is not."""
    idle = F.when(~active, "no_activity") if restart_if_idle else F.lit(None).cast("string")
    return F.when(~alive, "screen_missing").when(stale_seconds > limit, F.concat(F.lit("stale_"), stale_seconds.cast("long").cast("string"), F.lit("s"))).otherwise(idle)
