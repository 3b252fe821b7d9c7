"""Audits of many rules in one reading of a table: rules of a row, of neighbours, of groups, of keys, of equal inputs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import written


@dataclass(frozen=True)
class Rule:
    """A row breaks it where ``broken`` is true; with ``last`` the rules after it are not asked of such a row."""

    name: str
    broken: Column
    last: bool = False


@dataclass(frozen=True)
class Across:
    """Rules that need more than a row; they see ``carried`` columns alone.

    neighbours: from the row before in its group (a function of a name, which
    gives that row's column) to whether the row breaks the rule; the first row
    of a group breaks none.
    groups: whether a group breaks the rule, by aggregates; its key is reported.
    keys: values that only one row may have; every further row breaks the rule.
    inputs: (input, label): a row whose label is not that of the first row with its input.
    """

    carried: dict[str, Column] = field(default_factory=dict)
    neighbours: dict[str, Callable[[Callable[[str], Column]], Column]] = field(default_factory=dict)
    groups: dict[str, Column] = field(default_factory=dict)
    keys: dict[str, Column] = field(default_factory=dict)
    inputs: dict[str, tuple[Column, Column]] = field(default_factory=dict)


def broken_rules(rules: Sequence[Rule]) -> Column:
    """The names of the rules that a row breaks, in their order; a test that is null counts as kept."""
    found, open_ = [], F.lit(True)
    for rule in rules:
        hit = open_ & F.coalesce(rule.broken, F.lit(False))
        found.append(F.when(hit, F.lit(rule.name)))
        if rule.last:
            open_ = open_ & ~F.coalesce(rule.broken, F.lit(False))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def audit(df: DataFrame, key: Column, group: Column, order: Column, rules: Sequence[Rule], across: Across | None = None) -> DataFrame:
    """rule, key, times: how often rows of each key break each rule.

    ``order`` tells rows apart. The table is read once: what each row breaks, and
    the few columns that rules across rows need, are written; the rest reads
    that. Neighbours are found in ranges of (group, order), and the first row of
    a group in a range gets its neighbour from the ranges' ends, so no task holds
    a whole group; all else combines before it is exchanged.

    Null groups are a group and are reported as null; null values of ``keys``
    and ``inputs`` count as a value.
    """
    across = across or Across()
    kept = {f"_c{k}": c for k, c in enumerate(across.carried.values())}
    place = {name: f"_c{k}" for k, name in enumerate(across.carried)}
    also = {f"_u{k}": c for k, c in enumerate(across.keys.values())} | {f"_i{k}": F.sha2(c.cast("string"), 256) for k, (c, _) in enumerate(across.inputs.values())} | {f"_l{k}": c.cast("string") for k, (_, c) in enumerate(across.inputs.values())}
    judged = written(df.select(key.cast("string").alias("_key"), F.struct(group.alias("g")).alias("_g"), order.alias("_o"), broken_rules(rules).alias("_rules"), *(c.alias(n) for n, c in (kept | also).items())))
    one = F.lit(1).cast("long").alias("times")
    parts = [judged.select(F.explode("_rules").alias("rule"), F.col("_key").alias("key"), one)]
    if across.neighbours:
        parts += _neighbours(judged, across, place, one)
    if across.groups:
        broken = F.array_compact(F.array(*(F.when(test, F.lit(n)) for n, test in across.groups.items())))
        groups = judged.select("_g", *(F.col(c).alias(n) for n, c in place.items())).groupBy("_g").agg(broken.alias("_rules"))
        parts.append(groups.select(F.explode("_rules").alias("rule"), F.col("_g.g").cast("string").alias("key"), one))
    for k, name in enumerate(across.keys):
        times = judged.groupBy(F.struct(f"_u{k}").alias("_u")).agg((F.count("*") - 1).alias("times"), F.min("_key").alias("key")).filter("times > 0")
        parts.append(times.select(F.lit(name).alias("rule"), "key", "times"))
    for k, name in enumerate(across.inputs):
        labels = judged.groupBy(F.struct(f"_i{k}").alias("_i"), F.struct(f"_l{k}").alias("_l")).agg(F.count("*").alias("times"), F.min(F.struct("_o", "_key")).alias("_first"))
        first = labels.groupBy(F.col("_i").alias("_j")).agg(F.min_by("_l", "_first").alias("_own"))
        other = labels.join(first, F.col("_i") == F.col("_j")).filter(F.col("_l") != F.col("_own"))
        parts.append(other.select(F.lit(name).alias("rule"), F.col("_first._key").alias("key"), "times"))
    return reduce(DataFrame.unionAll, parts).groupBy("rule", "key").agg(F.sum("times").alias("times"))


def _neighbours(judged: DataFrame, across: Across, place: dict[str, str], one: Column) -> list[DataFrame]:
    """Rows that break a rule of neighbours, of pairs inside a range and of pairs over a range's end."""
    row = F.struct(*(F.col(c).alias(n) for n, c in place.items()))
    dealt = written(judged.select("_key", "_g", "_o", row.alias("_row")).repartitionByRange("_g", "_o").withColumn("_p", F.spark_partition_id()))
    inside = dealt.withColumn("_before", F.lag("_row").over(Window.partitionBy("_p", "_g").orderBy("_o")))
    ends = dealt.groupBy("_g", "_p").agg(F.max_by("_row", "_o").alias("_end"), F.min_by(F.struct("_key", "_row"), "_o").alias("_start"))
    # A row for each range that a group reaches into.
    met = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("_g").orderBy("_p"))).select(F.col("_start._key").alias("_key"), F.col("_start._row").alias("_row"), "_before")
    pairs = inside.select("_key", "_row", "_before").unionAll(met).filter(F.col("_before").isNotNull())
    flat = pairs.select("_key", "_before", "_row.*")
    broken = F.array_compact(F.array(*(F.when(test(lambda n: F.col(f"_before.{n}")), F.lit(name)) for name, test in across.neighbours.items())))
    return [flat.select(F.explode(broken).alias("rule"), F.col("_key").alias("key"), one)]


def summary(found: DataFrame, examples: int = 10) -> DataFrame:
    """rule, violations, examples: how often each rule is broken, and the least keys that do, in order.

    Every task sends at most so many keys of a rule.
    """
    found = written(found)
    least = F.row_number().over(Window.partitionBy("rule").orderBy("key"))
    few = found.filter(F.col("key").isNotNull()).withColumn("_k", least).filter(F.col("_k") <= examples).groupBy("rule").agg(F.sort_array(F.collect_list("key")).alias("examples"))
    totals = found.groupBy("rule").agg(F.sum("times").alias("violations"))
    return totals.join(few, "rule", "left").select("rule", "violations", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def frame_rules(commands: Sequence[str], standoff: Sequence[str], appended: Sequence[str], most_depth: float = 100.0) -> list[Rule]:
    """The rules of a frame that is to be trained on.

    Columns: target_description, command (null if the action is none), depth_grid,
    image_path, image_bytes (null if there is no file), aligned (whether the path is
    below an allowed root), quarantined, source_type, has_marker, prompt and
    expected_prompt, label, roles (of its conversation), images.
    """
    c = F.col
    cells = F.flatten("depth_grid")
    stands, ends = c("source_type").isin(*standoff), c("source_type").isin(*appended)
    return [
        Rule("quarantined_trajectory", c("quarantined")),
        Rule("empty_target_description", F.trim(F.coalesce("target_description", F.lit(""))) == ""),
        Rule("unaligned_image_path", c("image_path").contains("record_output/images/") & ~c("aligned")),
        Rule("standoff_row_not_stop", stands & ~c("command").eqNullSafe("stop")),
        Rule("standoff_row_without_depth", stands & c("depth_grid").isNull()),
        Rule("appended_stop_without_marker", ends & ~F.coalesce("has_marker", F.lit(False))),
        Rule("invalid_source_action", c("command").isNull(), last=True),
        Rule("unknown_command", ~c("command").isin(*commands)),
        Rule("missing_depth_grid", c("depth_grid").isNull(), last=True),
        Rule("invalid_depth_shape", (F.size("depth_grid") != 3) | F.exists("depth_grid", lambda r: F.size(r) != 3), last=True),
        Rule("nonfinite_depth", F.exists(cells, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), last=True),
        Rule("depth_out_of_range", (F.array_min(cells) < 0) | (F.array_max(cells) > most_depth)),
        Rule("unresolvable_source_image", c("image_path").isNull(), last=True),
        Rule("invalid_conversation_structure", F.coalesce(F.size("roles"), F.lit(-1)) != 2, last=True),
        Rule("invalid_image_list", F.coalesce(F.size("images"), F.lit(-1)) != 1, last=True),
        Rule("invalid_conversation_roles", (F.get("roles", F.lit(0)) != "human") | (F.get("roles", F.lit(1)) != "gpt")),
        Rule("prompt_mismatch", ~c("prompt").eqNullSafe(c("expected_prompt"))),
        Rule("action_mismatch", ~c("label").eqNullSafe(c("command"))),
        Rule("image_path_mismatch", ~F.get("images", F.lit(0)).eqNullSafe(c("image_path"))),
        Rule("missing_image_file", c("image_bytes").isNull()),
        Rule("empty_image_file", c("image_bytes") <= 0),
    ]


def frame_rules_across() -> Across:
    """Rules of episodes, sample keys and equal inputs: columns sample_key, frame_idx, command, label, prompt and images."""
    c = F.col
    return Across(
        carried={"frame_idx": c("frame_idx"), "stop": c("command").eqNullSafe("stop")},
        neighbours={"nonincreasing_episode_frame_idx": lambda before: c("frame_idx") <= before("frame_idx")},
        groups={"multiple_stops_in_episode": F.count_if("stop") > 1, "stop_not_final_row": (F.count_if("stop") > 0) & ~F.max_by("stop", "frame_idx")},
        keys={"duplicate_sample_key": c("sample_key")},
        inputs={"identical_input_conflicting_label": (F.concat_ws("\u0000", F.get("images", F.lit(0)), "prompt"), c("label"))},
    )
