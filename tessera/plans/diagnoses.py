"""The diagnosis of stops over episodes made from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import diagnoses
from tessera.plans.base import query, r, table

#: Columns that both dialects read alike.
_EPISODE = {
    "priority": "o_orderpriority", "success": "o_orderkey % 7 = 0", "official_osr": "o_orderkey % 3 = 0", "observed_reach": "CASE WHEN o_orderkey % 11 <> 4 THEN o_orderkey % 4 = 0 END", "reached_then_collided": "o_orderkey % 20 = 8", "final_within": "o_orderkey % 5 = 1",
    "collision": "o_orderkey % 10 = 8", "termination": "CASE o_orderkey % 6 WHEN 0 THEN 'stop' WHEN 1 THEN 'stop' WHEN 2 THEN 'collision' WHEN 3 THEN NULL ELSE 'step_limit' END", "minimum_distance": "o_totalprice / 8000", "steps": "o_custkey % 70", "longest_turn_run": "o_orderkey % 15",
    "turn_fraction": "(o_orderkey % 100) / 100.0", "net_displacement": "o_totalprice / 20000", "final_action": "CASE WHEN o_orderkey % 9 > 1 THEN 'forward 3m' WHEN o_orderkey % 9 = 1 THEN 'ascend 3m' END", "collision_object": "'wall' || o_orderkey % 4", "final_distance": "o_totalprice / 6000",
}
_WON, _REACHED, _STOPPED = "success", "coalesce(observed_reach, false)", "coalesce(termination = 'stop', false)"
_CLASSES = {
    "success": _WON, "official_osr_only": f"official_osr AND NOT {_WON}", "no_official_osr": f"NOT official_osr AND NOT {_WON}", "stop_terminations": _STOPPED, "false_stops": f"{_STOPPED} AND NOT {_WON}", "false_stops_without_observed_reach": f"{_STOPPED} AND NOT {_WON} AND NOT {_REACHED}",
    "false_stops_at_step_0": f"{_STOPPED} AND NOT {_WON} AND steps = 1", "false_stops_within_first_5_actions": f"{_STOPPED} AND NOT {_WON} AND steps <= 5", "observed_reach_failures": f"{_REACHED} AND NOT {_WON}", "reached_then_collided": "reached_then_collided",
    "reached_but_never_stopped": f"{_REACHED} AND NOT {_WON} AND NOT {_STOPPED}", "ended_inside_without_stop": f"final_within AND NOT {_WON} AND NOT {_STOPPED}", "never_observed_within": f"NOT {_REACHED}", "near_miss": f"NOT {_REACHED} AND minimum_distance < 25", "collision_before_reach": f"NOT {_REACHED} AND collision",
    "step_limit_before_reach": f"NOT {_REACHED} AND termination = 'step_limit'", "turn_loop_candidates": f"NOT {_REACHED} AND steps >= 20 AND (longest_turn_run >= 12 OR turn_fraction >= 0.85)", "low_net_displacement_candidates": f"NOT {_REACHED} AND steps >= 50 AND net_displacement < 6", "collisions": "collision",
}
_BIN = "CASE WHEN minimum_distance >= 40 THEN '[40,inf)' WHEN minimum_distance >= 30 THEN '[30,40)' WHEN minimum_distance >= 25 THEN '[25,30)' WHEN minimum_distance >= 20 THEN '[20,25)' END"
_PARTS = {
    "reach_failure_terminations": ("observed_reach_failures", "coalesce(termination, 'none')"), "inside_without_stop_terminations": ("ended_inside_without_stop", "coalesce(termination, 'none')"), "minimum_distance_bins": ("never_observed_within", _BIN),
    "collision_final_actions": ("collisions", "coalesce(final_action, 'none')"), "collision_objects": ("collisions", "coalesce(collision_object, 'none')"),
}
_FROM = "WITH e AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _EPISODE.items()) + " FROM orders)"


def _episodes(spark, d):
    return table(spark, d, "orders").select(*(F.expr(sql).alias(name) for name, sql in _EPISODE.items()))


@query(_FROM + " " + " UNION ALL ".join(
    [f"SELECT priority, '{n}' AS measure, CAST(NULL AS VARCHAR) AS bucket, count(*) AS n FROM e WHERE {t} GROUP BY priority" for n, t in _CLASSES.items()]
    + [f"SELECT priority, '{n}', {v} AS bucket, count(*) FROM e WHERE ({_CLASSES[of]}) AND {v} IS NOT NULL GROUP BY priority, {v}" for n, (of, v) in _PARTS.items()]
))
def stop_diagnosis(spark, d):
    return diagnoses.counts(_episodes(spark, d), ["priority"])


@query(_FROM + f""" SELECT count(*) AS count, round(avg(final_distance), 4) AS mean, round(quantile_cont(final_distance, 0.5), 4) AS median, round(quantile_cont(final_distance, 0.95), 4) AS p95,
    (SELECT round(count(*) FILTER (success) / CAST(count(*) FILTER ({_STOPPED}) AS DOUBLE), 6) FROM e) AS stop_precision FROM e WHERE {_CLASSES["false_stops"]}""")
def false_stop_distances(spark, d):
    e = _episodes(spark, d)
    one = diagnoses.described(e, "false_stops", "final_distance")
    return one.crossJoin(F.broadcast(diagnoses.stop_precision(diagnoses.counts(e)))).select("count", *(r(F.col(c), 4).alias(c) for c in ("mean", "median", "p95")), r(F.col("stop_precision")).alias("stop_precision"))
