"""The production audit over frames made from orders: customers are episodes, orders their frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import audits
from tessera.plans.base import query, table

#: Columns that both dialects read alike.
_FRAME = {
    "episode": "o_custkey",
    "line": "o_orderkey",
    "frame_idx": "CAST(floor(o_orderkey / 40) AS INT) % 60",
    "sample_key": "o_custkey || '::' || CAST(floor(o_orderkey / 40) AS INT) % 60",
    "target_description": "CASE WHEN o_orderkey % 41 = 0 THEN '  ' WHEN o_orderkey % 43 <> 0 THEN o_orderpriority END",
    "command": "CASE o_orderkey % 9 WHEN 0 THEN 'stop' WHEN 1 THEN 'hover' WHEN 2 THEN CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'turn left 30 degree' END ELSE 'forward 3m' END",
    "lines": "CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 29 = 0 THEN 2 ELSE 3 END",
    "depth": "o_totalprice / 3000 - 2",
    "holey": "o_orderkey % 31 = 0",
    "image_path": "CASE WHEN o_orderkey % 37 <> 0 THEN CASE WHEN o_orderkey % 5 = 0 THEN 'record_output/images/' ELSE 'aligned/' END || o_orderkey % 800 END",
    "image_bytes": "CASE WHEN o_orderkey % 53 = 0 THEN 0 WHEN o_orderkey % 59 <> 0 THEN 9 END",
    "aligned": "o_orderkey % 3 = 0",
    "quarantined": "o_custkey % 61 = 0",
    "source_type": "CASE o_orderkey % 11 WHEN 0 THEN 'standoff' WHEN 1 THEN 'appended' END",
    "has_marker": "CASE WHEN o_orderkey % 2 = 0 THEN true END",
    "prompt": "'p' || o_orderkey % 70",
    "expected_prompt": "'p' || CASE WHEN o_orderkey % 47 = 0 THEN 1 ELSE o_orderkey % 70 END",
    "label": "CASE WHEN o_orderkey % 67 = 0 THEN 'stop' ELSE CASE o_orderkey % 9 WHEN 0 THEN 'stop' WHEN 1 THEN 'hover' ELSE 'forward 3m' END END",
    "speakers": "CASE WHEN o_orderkey % 71 = 0 THEN 1 ELSE 2 END",
    "swapped": "o_orderkey % 73 = 0",
    "pictures": "CASE WHEN o_orderkey % 79 = 0 THEN 2 ELSE 1 END",
    "other": "o_orderkey % 83 = 0",
}
_COMMANDS = ["stop", "forward 3m", "turn left 30 degree"]

#: Rules of a row with SQL of the same frames, in order; a star ends the row's tests.
_RULES = [
    ("quarantined_trajectory", "quarantined"), ("empty_target_description", "trim(coalesce(target_description, '')) = ''"), ("unaligned_image_path", "contains(image_path, 'record_output/images/') AND NOT aligned"),
    ("standoff_row_not_stop", "source_type IN ('standoff', 'appended') AND command IS DISTINCT FROM 'stop'"), ("standoff_row_without_depth", "source_type IN ('standoff', 'appended') AND lines IS NULL"),
    ("appended_stop_without_marker", "source_type = 'appended' AND has_marker IS NULL"), ("invalid_source_action*", "command IS NULL"), ("unknown_command", "command = 'hover'"), ("missing_depth_grid*", "lines IS NULL"), ("invalid_depth_shape*", "lines = 2"),
    ("nonfinite_depth*", "holey"), ("depth_out_of_range", "depth < 0 OR depth + 5 > 100"), ("unresolvable_source_image*", "image_path IS NULL"), ("invalid_conversation_structure*", "speakers = 1"), ("invalid_image_list*", "pictures = 2"),
    ("invalid_conversation_roles", "swapped"), ("prompt_mismatch", "prompt <> expected_prompt"), ("action_mismatch", "label IS DISTINCT FROM command"), ("image_path_mismatch", "other"), ("missing_image_file", "image_bytes IS NULL"), ("empty_image_file", "image_bytes = 0"),
]


def _audit_sql() -> str:
    parts, open_ = [], "true"
    for name, test in _RULES:
        parts.append(f"SELECT '{name.rstrip('*')}' AS rule, sample_key AS key FROM f WHERE ({open_}) AND coalesce({test}, false)")
        if name.endswith("*"):
            open_ += f" AND NOT coalesce({test}, false)"
    return f"""WITH f AS (SELECT {", ".join(f"{sql} AS {name}" for name, sql in _FRAME.items())} FROM orders), i AS (SELECT *, CASE WHEN other THEN 'elsewhere' ELSE image_path END AS image FROM f),
    first AS (SELECT coalesce(image || chr(0), '') || prompt AS input, arg_min(coalesce(label, '-'), line) AS label FROM i GROUP BY 1),
    found AS ({" UNION ALL ".join(parts)}
    UNION ALL SELECT 'nonincreasing_episode_frame_idx', sample_key FROM (SELECT *, lag(frame_idx) OVER (PARTITION BY episode ORDER BY line) AS before FROM f) WHERE frame_idx <= before
    UNION ALL SELECT 'multiple_stops_in_episode', '' || episode FROM f GROUP BY episode HAVING count(*) FILTER (command = 'stop') > 1
    UNION ALL SELECT 'stop_not_final_row', '' || episode FROM (SELECT episode, count(*) FILTER (command = 'stop') AS stops, bool_or(command = 'stop') FILTER (line = last) AS ends FROM (SELECT *, max(line) OVER (PARTITION BY episode) AS last FROM f) GROUP BY episode) WHERE stops > 0 AND NOT coalesce(ends, false)
    UNION ALL SELECT 'duplicate_sample_key', sample_key FROM (SELECT sample_key, row_number() OVER (PARTITION BY sample_key) AS k FROM f) WHERE k > 1
    UNION ALL SELECT 'identical_input_conflicting_label', min(sample_key) OVER (PARTITION BY i.image, i.prompt, i.label) FROM i JOIN first ON first.input = coalesce(i.image || chr(0), '') || i.prompt WHERE coalesce(i.label, '-') <> first.label)"""


@query(_audit_sql() + " SELECT rule, count(*) AS violations FROM found GROUP BY rule")
def production_audit(spark, d):
    return audits.summary(_found(spark, d)).select("rule", "violations")


@query(_audit_sql() + " SELECT rule, array_to_string(list_sort(list(DISTINCT key))[1:10], ',') AS examples FROM found WHERE rule <> 'identical_input_conflicting_label' GROUP BY rule")
def audit_examples(spark, d):
    return audits.summary(_found(spark, d)).filter("rule <> 'identical_input_conflicting_label'").select("rule", F.array_join("examples", ",").alias("examples"))


def _frames(spark, d):
    f = table(spark, d, "orders").select(*(F.expr(sql).alias(name) for name, sql in _FRAME.items()))
    cell = F.when(F.col("holey"), F.lit(float("inf"))).otherwise(F.col("depth") + 1)
    grid = F.array(F.array("depth", F.col("depth") + 5, cell), F.array("depth", "depth", "depth"), F.array("depth", "depth", "depth"))
    image = F.when(F.col("other"), "elsewhere").otherwise(F.col("image_path"))
    roles = F.when(F.col("swapped"), F.array(F.lit("gpt"), F.lit("human"))).otherwise(F.array(F.lit("human"), F.lit("gpt")))
    return f.select("*", F.when(F.col("lines").isNotNull(), F.slice(grid, F.lit(1), F.col("lines"))).alias("depth_grid"), F.slice(roles, F.lit(1), F.col("speakers")).alias("roles"), F.slice(F.array(image, image), F.lit(1), F.col("pictures")).alias("images"))


def _found(spark, d):
    rules = audits.frame_rules(_COMMANDS, ["standoff", "appended"], ["appended"])
    across = audits.frame_rules_across()
    across.groups["stop_not_final_row"] = (F.count_if("stop") > 0) & ~F.max_by("stop", "line")
    across.carried["line"] = F.col("line")
    return audits.audit(_frames(spark, d), F.col("sample_key"), F.col("episode"), F.col("line"), rules, across)
