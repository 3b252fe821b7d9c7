"""Tables for review made of episodes, records and audits: lookups by path, frames and steps, selections, completeness."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.contexts import fixed
from tessera.functions.geometry import finite_xyz
from tessera.functions.prompts import redirect
from tessera.functions.text import SIZES, col, falsy_coalesce, lookup_number
from tessera.functions.visibility import Policy
from tessera.operators.repairs import scene_name
from tessera.operators.rows import dedupe


def remapped_path(path: Column | str, marker: str, root: str, files: Column | None = None) -> Column:
    """What follows the marker, below a root; a path without it stays. With ``files``, an array of known paths, only where the new one is among them."""
    plain = F.replace(col(path), F.lit("\\"), F.lit("/"))
    at = F.instr(plain, marker)
    new = F.when(at > 0, F.concat(F.lit(f"{root.rstrip('/')}/"), F.substring(plain, at + len(marker), F.length(plain))))
    return F.coalesce(F.when(F.array_contains(files, new), new) if files is not None else new, col(path))


def training_pose(rows: DataFrame, records: DataFrame, keys: Sequence[str], frame: str, inline: str, record_list: str) -> DataFrame:
    """Adds pose (three numbers) and pose_source: inline, aligned_record, missing_record, or unresolved_path for rows without keys; the record's pose at its frame from 0 where the row has none of its own."""
    met = rows.join(records.select(*keys, F.col(record_list).alias("_r")), list(keys), "left")
    own, named = finite_xyz(inline), reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    found = F.try_element_at("_r", (F.col(frame) + 1).cast("int"))
    source = F.when(own, "inline").when(~named, "unresolved_path").when(found.isNull(), "missing_record").otherwise("aligned_record")
    three = lambda p: F.when(finite_xyz(p), F.slice(p, 1, 3))
    return met.withColumns({"pose_source": source, "pose": F.when(own, three(F.col(inline))).otherwise(three(found))}).drop("_r")


def pose_at(rows: DataFrame, records: DataFrame, keys: Sequence[str], frame: str, record_list: str) -> DataFrame:
    """Adds pose, the record's first four numbers at the row's frame from 0; a frame out of range, or a shorter pose, is an error."""
    met = rows.join(records.select(*keys, F.col(record_list).alias("_r")), list(keys), "left")
    pose = F.try_element_at("_r", (F.col(frame) + 1).cast("int"))
    ok = F.coalesce((F.size(pose) >= 4) & (F.col(frame) >= 0), F.lit(False))
    return met.withColumn("pose", F.when(ok, F.slice(pose, 1, 4)).otherwise(F.raise_error(F.lit("no pose at that frame")).cast("array<double>"))).drop("_r")


def source_frames(records: DataFrame, keys: Sequence[str], images: str, poses: str, actions: str) -> DataFrame:
    """keys, frame_idx, image, pose, action: the arrays of a record side by side; images and poses of different numbers are an error, missing actions empty."""
    bad = F.raise_error(F.lit("as many poses as images are needed")).cast(records.schema[images].dataType)
    checked = F.when(F.coalesce(F.size(images), F.lit(0)) == F.coalesce(F.size(poses), F.lit(0)), F.col(images)).otherwise(bad)
    rows = records.select(*keys, F.posexplode(checked).alias("frame_idx", "image"), poses, F.coalesce(F.col(actions), F.array().cast("array<string>")).alias("_a"))
    return rows.select(*keys, "frame_idx", "image", F.get(poses, F.col("frame_idx")).alias("pose"), F.coalesce(F.get("_a", F.col("frame_idx")), F.lit("")).alias("action"))


def case_frames(frames: DataFrame, audit: DataFrame, assessed: DataFrame, keys: Sequence[str], audit_fields: Sequence[str], numbers: Sequence[str], reasons: str) -> DataFrame:
    """All frames with what the audit and the assessments say of them: reasons joined by a bar, numbers with six decimals, blanks where nothing is known."""
    out = frames.join(audit.select(*keys, *audit_fields), list(keys), "left").join(assessed.select(*keys, *numbers, reasons), list(keys), "left")
    return out.withColumns({**{n: F.coalesce(fixed(n, 6), F.lit("")) for n in numbers}, reasons: F.coalesce(F.array_join(reasons, "|"), F.lit(""))})


def step_table(episodes: DataFrame, keys: Sequence[str], steps: str, radius: float = 20.0) -> DataFrame:
    """keys, step, x, y, z, yaw (degrees), distance, inside: a row for each step of an array of (pose_after with yaw in radians, distance_after)."""
    rows = episodes.select(*keys, F.posexplode(steps).alias("step", "_s"))
    at = lambda k: F.get(F.col("_s.pose_after"), F.lit(k))
    return rows.select(*keys, "step", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.degrees(at(3)).alias("yaw"), F.col("_s.distance_after").alias("distance"), F.coalesce(F.col("_s.distance_after") <= radius, F.lit(False)).alias("inside"))


def mask_lookup(audits: DataFrame, keys: Sequence[str], frames: str, by: str, value: str, order: str | None = None) -> DataFrame:
    """A row for each frame of an array: keys, by, value. One that comes twice is an error, or with ``order`` the last counts, and keys do not."""
    rows = audits.select(*keys, *([order] if order else []), F.explode(frames).alias("_f"))
    rows = rows.select(*keys, *([order] if order else []), F.col(f"_f.{by}").alias(by), F.col(f"_f.{value}").alias(value))
    return dedupe(rows, [by], [order, *keys], "last").drop(order) if order else dedupe(rows, [*keys, by], [F.lit(1)], "raise")


def valid_mask(box: Column | str, pixels: Column | str) -> Column:
    """Whether a mask has a box of four and pixels."""
    return F.coalesce((F.size(col(box)) == 4) & (col(pixels) > 0), F.lit(False))


def mask_source(canonical: Column, dominant: Column, short_side: Column, changed: Column, baseline: Column, size: Column, p: Policy) -> Column:
    """canonical_id, else the dominant changed colour if it passes five tests (no canonical pixels, enough of its own, thick enough, half of the change, none before), else none."""
    fallback = (canonical == 0) & (dominant >= lookup_number(p.min_pixels, size)) & (short_side >= lookup_number(p.min_short_side, size)) & (dominant / F.greatest(F.lit(1), changed) >= 0.5) & (baseline == 0)
    return F.when(canonical > 0, "canonical_id").when(fallback, "dominant_changed_color_fallback").otherwise("none")


def restricted(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the targets alone; a target without a row, and a table without targets, is an error."""
    wanted = targets.select(*keys).distinct()
    found = wanted.join(rows.select(*keys).distinct().withColumn("_there", F.lit(True)), list(keys), "left")
    ok = found.withColumn("_ok", F.assert_true(F.col("_there").isNotNull(), F.concat(F.lit("no row of "), F.concat_ws("::", *(F.col(k).cast("string") for k in keys)))))
    return rows.join(ok.filter(F.col("_ok").isNull()).select(*keys), list(keys), "left_semi")


def quarantined(rows: DataFrame, scene: Column, reason: Column) -> DataFrame:
    """Rows of a scene and a reason."""
    return rows.filter(F.coalesce(scene & reason, F.lit(False)))


def training_rows(rows: DataFrame, wanted: DataFrame, episode: str, frame: str, line: str, action: str, commands: dict[str, str]) -> DataFrame:
    """The last row of each (episode, frame) of the wanted episodes, with its line and command as label; unknown actions go."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for kv in commands.items() for x in kv)), F.col(action))
    out = rows.join(wanted.select(episode).distinct(), episode, "left_semi").withColumn("label", label).filter(F.col("label").isNotNull())
    return dedupe(out, [episode, frame], [line], "last")


def metadata(rows: DataFrame, scene: str, map_name: str, episode: str, order: str) -> DataFrame:
    """The last row of each (scene, episode); names of scenes lose their set's suffix, and aliases become one."""
    name = F.regexp_replace(falsy_coalesce(F.col(scene), F.coalesce(F.col(map_name), F.lit(""))), "_TrainSets|_train", "")
    return dedupe(rows.withColumn("scene", scene_name(name)), ["scene", episode], [order], "last")


def small_selections(rows: DataFrame, key: str, size: str, scene: str, path: str, order: str, only: str, repaired: str) -> DataFrame:
    """The last row of each key of small targets; of one scene only those from a repaired source count."""
    t = F.lower(F.trim(F.coalesce(F.col(size), F.lit(""))))
    small = t.startswith(SIZES[0]) | t.contains(f" {SIZES[0]}")
    return dedupe(rows.filter(small & ((F.col(scene) != only) | F.col(path).contains(repaired))), [key], [order], "last")


def stop_queue(episodes: DataFrame, steps: str, termination: str, command: str = "stop") -> DataFrame:
    """Episodes that ended by a stop, whose last step must be one, with its place as stop_step."""
    last = F.try_element_at(steps, F.lit(-1))
    ok = F.assert_true(F.coalesce(last == command, F.lit(False)), F.lit("an episode that ended by a stop has another last step"))
    return episodes.filter(F.col(termination) == "stop").withColumn("_ok", ok).filter(F.col("_ok").isNull()).drop("_ok").withColumn("stop_step", F.size(steps) - 1)


def failed_episodes(episodes: DataFrame, success: str, scene: str, scenes: Sequence[str] = ()) -> DataFrame:
    """Episodes without success, of the scenes asked for."""
    out = episodes.filter(~F.coalesce(F.col(success).cast("boolean"), F.lit(False)))
    return out.filter(F.col(scene).isin(*scenes)) if scenes else out


def captures_by(captures: DataFrame, manual: DataFrame, key: str, fields: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """groups, n, overridden: counts of captures after what was decided by hand replaced their fields."""
    out = captures.join(manual.select(key, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_by_hand")), key, "left")
    out = out.withColumns({f: F.coalesce(F.col(f"_{f}"), F.col(f)) for f in fields})
    return out.groupBy(*groups).agg(F.count("*").alias("n"), F.count("_by_hand").alias("overridden"))


def candidate_steps(steps: DataFrame, needed: Sequence[str]) -> DataFrame:
    """Steps that have all that a prompt needs."""
    return steps.filter(reduce(lambda a, b: a & b, (F.col(c).isNotNull() & (F.length(F.col(c).cast("string")) > 0) for c in needed)))


def residuals(rows: DataFrame, keys: Sequence[str], residual: str, trajectory: str, visible: str, clear: str) -> DataFrame:
    """keys, n, least, median, most, within_01, within_1 of residuals, and how many trajectories have a visible and a clear frame."""
    x = F.col(residual)
    return rows.groupBy(*keys).agg(
        F.count(x).alias("n"), F.min(x).alias("least"), F.percentile(x, F.lit(0.5)).alias("median"), F.max(x).alias("most"), F.count_if(x <= 0.1).alias("within_01"), F.count_if(x <= 1.0).alias("within_1"),
        F.count_distinct(F.when(F.col(visible), F.col(trajectory))).alias("visible"), F.count_distinct(F.when(F.col(clear), F.col(trajectory))).alias("clear"),
    )


def complete(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, complete: whether as many rows are found as expected, and any."""
    e, f = expected.groupBy(*keys).agg(F.count("*").alias("_e")), found.groupBy(*keys).agg(F.count("*").alias("_f"))
    return e.join(f, list(keys), "left").select(*keys, (F.col("_e") == F.coalesce("_f", F.lit(0))).alias("complete"))


def last_activity(files: DataFrame, lane: str, modified: str) -> DataFrame:
    """lane, active_at: the latest change of a lane's files."""
    return files.groupBy(lane).agg(F.max(modified).alias("active_at"))


def causes(rows: DataFrame, audit: DataFrame, key: str, cause: str, order: str) -> DataFrame:
    """Adds problem_cause: the last one that the audit has for the key, else unknown."""
    last = dedupe(audit, [key], [order], "last").select(key, F.col(cause).alias("problem_cause"))
    return rows.join(last, key, "left").withColumn("problem_cause", falsy_coalesce(F.col("problem_cause"), F.lit("unknown")))


def distinct_poses(rows: DataFrame, pose: str) -> DataFrame:
    """Each pose once, by its exact four numbers."""
    return rows.select(F.struct(*(F.element_at(pose, k).alias(c) for k, c in enumerate(("x", "y", "z", "yaw"), 1))).alias("pose")).distinct()


def compact(rows: DataFrame, fields: dict[str, Column | str]) -> DataFrame:
    """The named fields alone, in their order."""
    return rows.select(*(col(c).alias(name) for name, c in fields.items()))


def redirects(name: str, **given):
    """A redirect by name (none, depth, bounds_depth): a function of the columns of ``redirect``; an unknown name is an error."""
    if name == "none":
        return lambda action_id, *_, **__: F.struct(action_id.alias("action_id"), F.lit(False).alias("changed"), F.lit(None).cast("string").alias("reason"))
    if name == "depth":
        return lambda action_id, clearance, left, right, **_: redirect(action_id, clearance, left, right, **given)
    if name == "bounds_depth":
        return lambda action_id, clearance, left, right, leaves, toward: redirect(action_id, clearance, left, right, leaves=leaves, toward=toward, **given)
    raise ValueError(f"unknown redirect {name!r}")


def first_steps(steps: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    """The first step of each episode."""
    return steps.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(step))).filter("_n = 1").drop("_n")
