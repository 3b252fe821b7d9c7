"""Classes of failed and repaired episodes, roll-ups by actor, expansions of what one row stands for, and shifts of coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.actions import TURNS
from tessera.functions.geometry import wrap_degrees, xyz
from tessera.functions.text import col, falsy_coalesce
from tessera.operators.aggregates import rate

# Names of scenes that are one, causes and classes.
SCENES = {"NeighborhoodTrain": "Neighborhood", "ModularNeighborhood": "Neighborhood"}
UNRESOLVED = "target_mapping_coordinate_or_scene_asset_unresolved"
STATES = ("full_rotation_loop", "oscillating", "stagnant", "revisiting")


def scene_name(c: Column | str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in SCENES.items() for x in kv)), col(c)), col(c))


def filled(*columns: Column | str) -> Column:
    """Whether all of the strings hold more than blanks."""
    return reduce(lambda a, b: a & b, (F.length(F.trim(F.coalesce(col(c), F.lit("")))) > 0 for c in columns))


def flag(c: Column | str) -> Column:
    """Whether a value, of any type, says yes."""
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "yes"), F.lit(False))


def seen_class(clear_near: Column, seen_near: Column, clear: Column, seen: Column) -> Column:
    """The first of four classes whose flag says yes; null without any."""
    return F.when(flag(clear_near), "within20_clear").when(flag(seen_near), "within20_weak").when(flag(clear), "outside20_clear").when(flag(seen), "outside20_weak")


def refined_cause(path_status: Column, cause: Column, xy_error: Column, standoff_pixels: Column) -> Column:
    """Why a path shows no target: null if it does; an unresolved cause by what was measured of the actor."""
    known = falsy_coalesce(cause, F.lit("unknown"))
    return (
        F.when(path_status == "clear_geometry_available", F.lit(None))
        .when(known != UNRESOLVED, known)
        .when(xy_error > 20.0, "dataset_simulator_xy_coordinate_mismatch")
        .when(F.coalesce(standoff_pixels, F.lit(0)) <= 0, "target_actor_at_expected_xy_but_no_pixels_in_path_or_standoff")
        .otherwise("target_pixels_exist_but_below_clear_threshold_after_standoff")
    )


def review_case(stop_clear: Column, selected: Column, stop: Column, clear_frames: Column, stop_pixels: Column, stop_reasons: Column, cause: Column, categories: dict[str, str] | None = None) -> Column:
    """What a stop has to be reviewed for: five cases of clear paths, else by the cause."""
    by_cause = F.try_element_at(F.create_map(*(F.lit(x) for kv in categories.items() for x in kv)), cause) if categories else F.lit(None)
    return (
        F.when(stop_clear, F.when(selected.eqNullSafe(stop), "01_valid_stop_control").otherwise("02_valid_stop_better_earlier"))
        .when(clear_frames > 0, F.when(F.coalesce(stop_pixels, F.lit(0)) == 0, "03_zero_pixel_stop_earlier_clear").when(F.coalesce(F.array_contains(stop_reasons, "severely_clipped_or_too_close"), F.lit(False)), "04_clipped_stop_earlier_clear").otherwise("05_weak_stop_earlier_clear"))
        .otherwise(F.coalesce(by_cause, F.lit("06_path_viewpoint_or_occlusion")))
    )


def actor_status(paths: DataFrame, actor: Sequence[str], clear_frames: str, standoff_clear: str) -> DataFrame:
    """Adds actor_status and no_target_cause to each path, by what all paths of its actor and its standoff views show; actors are rolled up first, then joined."""
    rolled = paths.groupBy(*actor).agg(F.bool_or(F.coalesce(F.col(clear_frames) > 0, F.lit(False))).alias("_any"), F.bool_or(F.coalesce(F.col(standoff_clear), F.lit(False))).alias("_standoff"))
    status = F.when(F.col("_any"), "clear_on_at_least_one_expert_path").when(F.col("_standoff"), "target_facing_standoff_repairable").otherwise("unresolved_after_target_facing_standoff")
    cause = F.when(F.col(clear_frames) > 0, F.lit(None)).when(F.col("_any"), "trajectory_viewpoint_distance_or_occlusion").when(F.col("_standoff"), "target_facing_standoff_repairable").otherwise(UNRESOLVED)
    return paths.join(rolled, list(actor)).withColumns({"actor_status": status, "no_target_cause": cause}).drop("_any", "_standoff")


def actor_sets(rows: DataFrame, actor: Sequence[str], value: str, episode: str) -> DataFrame:
    """actor, values (each once, sorted, joined by a bar), episodes: the kinds of a value that an actor's rows have; values first, so that a hot actor is a few rows."""
    kinds = rows.groupBy(*actor, value).agg(F.count("*").alias("_n"))
    out = kinds.groupBy(*actor).agg(F.array_join(F.array_sort(F.collect_list(value)), "|").alias("values"))
    return out.join(rows.groupBy(*actor).agg(F.count_distinct(episode).alias("episodes")), list(actor))


def view_summary(rows: DataFrame, keys: Sequence[str], frames: str, targets: str, stop: str, half: float = 45.0) -> DataFrame:
    """keys, any_in_view, in_view, stop_yaw, stop_pitch: frames (frame_idx, pose with yaw in radians) whose nearest target's centre lies in a square field of view, and its angles at the stop."""

    def one(f: Column) -> Column:
        def angles(t: Column) -> Column:
            dx, dy, dz = (q - p for p, q in zip(xyz(f["pose"]), xyz(t), strict=True))
            flat = F.sqrt(dx * dx + dy * dy)
            yaw = F.abs(wrap_degrees(F.degrees(F.atan2(dy, dx) - F.element_at(f["pose"], 4))))
            return F.struct(F.sqrt(flat * flat + dz * dz).alias("distance"), yaw.alias("yaw"), F.abs(F.degrees(F.atan2(dz, flat))).alias("pitch"))

        return F.array_min(F.transform(col(targets), angles))

    seen = F.transform(col(frames), lambda f: F.struct(f["frame_idx"].alias("frame_idx"), one(f).alias("a")))
    inside = F.filter("_f", lambda f: F.coalesce((f["a"]["yaw"] <= half) & (f["a"]["pitch"] <= half), F.lit(False)))
    at = F.try_element_at(F.filter("_f", lambda f: f["frame_idx"] == F.col(stop)), F.lit(1))
    return rows.withColumn("_f", seen).select(*keys, (F.size(inside) > 0).alias("any_in_view"), F.size(inside).alias("in_view"), at["a"]["yaw"].alias("stop_yaw"), at["a"]["pitch"].alias("stop_pitch"))


def represented(stops: DataFrame, queue: DataFrame, key: str, members: str, count: str, only: DataFrame | None = None, member: str = "episode_key") -> DataFrame:
    """A row for each episode that a stop stands for, from the queue's list of them.

    A stop without an entry, a list of another length than its count, and an
    episode that two stops cover are errors. With ``only``, just those episodes
    come out, and one of them that no stop covers is an error too.
    """
    met = stops.join(queue.select(key, members, count), key, "left")
    # Within what is exploded, so that no filter on it can come before the test.
    bad = F.raise_error(F.concat(F.lit("no entry, or another count, for "), F.col(key).cast("string"))).cast(met.schema[members].dataType)
    checked = F.when(F.coalesce(F.size(members) == F.col(count), F.lit(False)), F.col(members)).otherwise(bad)
    rows = met.withColumn(member, F.explode(checked)).drop(members, count)
    twice = rows.groupBy(member).agg(F.assert_true(F.count("*") == 1, F.concat(F.lit("covered twice: "), F.first(member).cast("string"))).alias("_once"))
    rows = rows.join(twice, member).filter(F.col("_once").isNull()).drop("_once")
    if only is None:
        return rows
    wanted = only.select(member).distinct().join(rows, member, "left")
    return wanted.withColumn("_ok", F.assert_true(F.col(key).isNotNull(), F.concat(F.lit("no stop covers "), F.col(member).cast("string")))).filter(F.col("_ok").isNull()).drop("_ok")


def capture_steps(captures: DataFrame, runs: DataFrame, keys: Sequence[str], steps: str, at: str) -> DataFrame:
    """Captures with found (step, no_episode, no_step) and step, the run's record at their place from 0."""
    met = captures.join(runs.select(*keys, F.col(steps).alias("_steps"), F.lit(True).alias("_run")), list(keys), "left")
    step = F.try_element_at("_steps", (F.col(at) + 1).cast("int"))
    return met.withColumns({"found": F.when(F.col("_run").isNull(), "no_episode").when(F.col(at) >= F.size("_steps"), "no_step").otherwise("step"), "step": step}).drop("_steps", "_run")


def salvaged(strict: DataFrame, salvage: DataFrame, quarantine: DataFrame, key: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows, what stays in quarantine): strict rows and salvaged ones, which must not share a key; salvaged keys leave the quarantine."""
    shared = strict.select(key).distinct().join(salvage.select(key).distinct(), key).agg(F.assert_true(F.count("*") == 0, F.lit("a salvaged key is in the strict rows")).alias("_ok"))
    rows = strict.select(*columns).withColumn("salvaged", F.lit(False)).unionByName(salvage.select(*columns).withColumn("salvaged", F.lit(True)))
    rows = rows.crossJoin(F.broadcast(shared)).filter(F.col("_ok").isNull()).drop("_ok")  # one row
    return rows, quarantine.join(salvage.select(key).distinct(), key, "left_anti")


def shifted(position: Column | str, dx: float, dy: float) -> Column:
    """A point moved in the plane."""
    p = col(position)
    return F.transform(p, lambda v, k: v + F.when(k == 0, dx).when(k == 1, dy).otherwise(0.0))


def shift_metadata(rows: DataFrame, scene: str, targets: str, start: str, dx: float, dy: float, only: str = "Neighborhood") -> DataFrame:
    """Targets and start of one scene moved, with what was done in coordinate_repair; other scenes stay."""
    here = scene_name(scene) == only
    note = F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(0.0).alias("dz"))
    return rows.withColumns({targets: F.when(here, F.transform(targets, lambda t: shifted(t, dx, dy))).otherwise(F.col(targets)), start: F.when(here, shifted(start, dx, dy)).otherwise(F.col(start)), "coordinate_repair": F.when(here, note)})


def planning_tasks(rows: DataFrame, keys: Sequence[str], start: str, targets: str) -> DataFrame:
    """A task for each target of a row, numbered within it (pose_idx), and in the order of start, target, keys (task)."""
    out = rows.select(*keys, start, F.posexplode(targets).alias("pose_idx", "target"))
    return out.select("*", F.row_number().over(Window.partitionBy(*[F.col(start)[0]]).orderBy(start, "target", *keys, "pose_idx")).alias("task"))


def unique_positions(rows: DataFrame, targets: str, order: str, digits: int = 5) -> DataFrame:
    """Each target position once, by its rounded values, as it stands in the last row."""
    out = rows.select(F.col(order).alias("_o"), F.posexplode(targets).alias("_k", "position"))
    key = F.transform("position", lambda v: F.bround(v, digits))
    return out.groupBy(key.alias("key")).agg(F.max_by("position", F.struct("_o", "_k")).alias("position"))


def new_collision(after: Column, before: Column, after_ts: Column, before_ts: Column) -> Column:
    """Whether a collision is new: there was none before, or its time differs or is not known."""
    return F.coalesce(after, F.lit(False)) & (~F.coalesce(before, F.lit(False)) | F.coalesce(after_ts != before_ts, F.lit(True)))


def state_response(steps: DataFrame, motion: str, turn: str, action: str, states: Sequence[str] = STATES) -> DataFrame:
    """state, steps, turn_share, forward_share: what is done in each state; a step counts for its motion state and for its turn state."""
    rows = steps.select(F.explode(F.array(motion, turn)).alias("state"), action).filter(F.col("state").isin(*states))
    return rows.groupBy("state").agg(
        F.count("*").alias("steps"), rate(F.count_if(F.col(action).isin(*TURNS)), F.count("*")).alias("turn_share"), rate(F.count_if(F.col(action) == "forward 3m"), F.count("*")).alias("forward_share")
    )


def exploration(rows: DataFrame, keys: Sequence[str], action: str, before: str, after: str) -> DataFrame:
    """keys, n, turn_rate, forward_rate, mean and median heading error after, mean improvement."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.col(action).isin(*TURNS).cast("int")).alias("turn_rate"),
        F.avg((F.col(action) == "forward 3m").cast("int")).alias("forward_rate"),
        F.avg(after).alias("mean_after"),
        F.percentile(after, F.lit(0.5)).alias("median_after"),
        F.avg(F.col(before) - F.col(after)).alias("mean_improvement"),
    )


def reference_costs(runs: DataFrame, keys: Sequence[str], order: str, steps: str) -> DataFrame:
    """keys, cost: the number of steps of a task's last run, 1 at least."""
    return runs.groupBy(*keys).agg(F.max_by(F.greatest(F.lit(1), F.coalesce(F.when(F.size(steps) >= 0, F.size(steps)), F.lit(1))), order).alias("cost"))


def conversation_parts(turns: Column | str, images: Column | str, commands: Sequence[str]) -> Column:
    """(prompt, command) of a sample with one human turn, one answer and one image; anything else, or an unknown command, is an error."""
    said = lambda who: F.filter(col(turns), lambda t: t["from"] == who)
    human, answer = said("human"), said("gpt")
    command = F.regexp_replace(F.try_element_at(answer, F.lit(1))["value"], r"^\s+|\s+$", "")
    ok = (F.size(human) == 1) & (F.size(answer) == 1) & (F.size(col(images)) == 1) & command.isin(*commands)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(F.try_element_at(human, F.lit(1))["value"].alias("prompt"), command.alias("command"))).otherwise(F.raise_error(F.lit("not one prompt, one known command and one image")))


def rotated(v: Sequence[Column], roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """A vector turned by roll, then pitch, then yaw (radians)."""
    cr, sr, cp, sp, cy, sy = (f(a) for a in (roll, pitch, yaw) for f in (F.cos, F.sin))
    m = [[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]]
    return [reduce(add, (a * x for a, x in zip(row, v, strict=True))) for row in m]


def from_euler(pitch: Column, roll: Column, yaw: Column) -> list[Column]:
    """The quaternion (x, y, z, w) of three angles in radians."""
    (cp, sp), (cr, sr), (cy, sy) = ((F.cos(a / 2), F.sin(a / 2)) for a in (pitch, roll, yaw))
    return [sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy, cr * cp * cy + sr * sp * sy]
