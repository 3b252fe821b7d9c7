"""Queries over frame choice, rewrites, classes and contexts; orders stand for episodes, their lines for frames."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import actions, contexts, prompts
from tessera.functions.visibility import Policy
from tessera.operators import frames, repairs
from tessera.operators import sequence as seq
from tessera.plans.base import query, r, table

_POLICY = Policy()
_NUMBERED = "(SELECT * EXCLUDE (l_linenumber), CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS l_linenumber FROM lineitem)"
_FRAMES = f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_orderkey || '::' || l_linenumber AS key, CAST(l_quantity * 10 AS INT) AS px, CAST(l_quantity AS INT) AS side, l_partkey % 4 > 2 OR l_discount * 4 > 0.25 OR l_quantity / 60 > 0.75 OR l_tax > 0.07 AS severe, l_quantity / 50 AS fill, round(l_tax * 10 + l_discount, 4) AS quality, l_suppkey % 5 = 0 AS bad,
        CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'Stop' ELSE 'Move Forward' END AS action FROM {_NUMBERED}),
    p AS (SELECT *, coalesce(max(px) FILTER (px > 0 AND NOT severe) OVER (PARTITION BY l_orderkey), 0) AS peak FROM f),
    a AS (SELECT *, px >= 96 AND side >= 6 AND px >= ceil(peak * 0.12) AND NOT severe AS clear FROM p),
    c AS (SELECT *, max(fill) FILTER (clear) OVER (PARTITION BY l_orderkey) AS best_fill, max(quality) FILTER (clear) OVER (PARTITION BY l_orderkey) AS best FROM a),
    s AS (SELECT l_orderkey, min(l_linenumber) FILTER (clear AND quality >= best - 0.1) AS selected FROM c WHERE clear GROUP BY l_orderkey)"""


def _numbered(spark, d):
    """Lines with numbers that tell an order's apart."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").withColumn("l_linenumber", F.row_number().over(w))


def _lines(spark, d):
    q = F.col("l_quantity")
    mask = F.struct(
        (q * 10).cast("int").alias("pixel_count"), q.cast("int").alias("bbox_width"), q.cast("int").alias("bbox_height"), (F.col("l_partkey") % 4).cast("int").alias("clipped_sides_count"),
        (F.col("l_discount") * 4).alias("edge_contact_fraction"), (q / 60).alias("pixel_fraction"), (F.col("l_tax") > 0.07).alias("touches_opposite_borders"), (q / 50).alias("bbox_fill_fraction"),
    )
    return _numbered(spark, d).select(
        "l_orderkey", "l_linenumber", F.concat_ws("::", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key"), mask.alias("mask"),
        F.round(F.col("l_tax") * 10 + F.col("l_discount"), 4).alias("quality"), (F.col("l_suppkey") % 5 == 0).alias("bad"),
        F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 4 == 0, "Stop").otherwise("Move Forward").alias("action"),
    )


def _assessed(spark, d, p=_POLICY):
    return frames.assess(_lines(spark, d), ["l_orderkey"], "mask", F.lit("small"), p)


@query(_FRAMES + " SELECT l_orderkey, l_linenumber, peak, clear, round(CASE WHEN best_fill > 0 THEN fill / best_fill ELSE 0 END, 6) AS relative_fill FROM c")
def frame_assessments(spark, d):
    return _assessed(spark, d).select("l_orderkey", "l_linenumber", "peak", "clear", r(F.col("relative_fill")).alias("relative_fill"))


@query(_FRAMES + " SELECT l_orderkey, min(l_linenumber) AS selected, arg_min(quality, l_linenumber) AS quality, max(peak) AS peak, count(*) AS candidates FROM c WHERE clear GROUP BY l_orderkey")
def first_clear_frame(spark, d):
    return frames.choose(_assessed(spark, d), ["l_orderkey"], "l_linenumber", "quality", _POLICY)


_BEST = replace(_POLICY, best_within=0.1)


@query(_FRAMES + " SELECT c.l_orderkey, selected, quality, peak, n AS candidates FROM c JOIN s USING (l_orderkey) JOIN (SELECT l_orderkey, count(*) AS n FROM c WHERE clear GROUP BY 1) USING (l_orderkey) WHERE l_linenumber = selected")
def best_view_frame(spark, d):
    return frames.choose(_assessed(spark, d), ["l_orderkey"], "l_linenumber", "quality", _BEST)


@query(_FRAMES + " SELECT l_orderkey, min(l_linenumber) AS selected FROM c WHERE clear AND NOT bad AND l_linenumber < 6 GROUP BY l_orderkey")
def safe_clear_frame(spark, d):
    lines = _lines(spark, d)
    tried = lines.select("l_orderkey", "l_linenumber", F.col("bad").alias("hit"))
    return frames.choose_safe(_assessed(spark, d), lines.filter("l_linenumber < 6"), tried, ["l_orderkey"], "l_linenumber", "hit", "quality", _POLICY).select("l_orderkey", "selected")


@query(_FRAMES + """ SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = selected THEN 'Stop' ELSE action END AS action, CASE WHEN l_linenumber = selected THEN action END AS original_action,
    l_linenumber < selected AND clear AS kept_earlier, CASE WHEN l_linenumber < selected AND clear THEN quality END AS earlier_quality, l_linenumber = selected AND bad AS overridden FROM c JOIN s USING (l_orderkey) WHERE l_linenumber <= selected AND (NOT bad OR l_linenumber = selected)""")
def production_rewrite(spark, d):
    a = _assessed(spark, d)
    chosen = frames.choose(a, ["l_orderkey"], "l_linenumber", "quality", _BEST)
    rows = _lines(spark, d).select("l_orderkey", "l_linenumber", "key", "action")
    out = frames.production_rewrite(rows, a, chosen, _lines(spark, d).filter("bad").select("key"), ["l_orderkey"], "l_linenumber", "key", "action", "quality")
    return out.select("l_orderkey", "l_linenumber", "action", "original_action", "kept_earlier", "earlier_quality", "overridden")


@query(_FRAMES + " SELECT l_orderkey, l_linenumber, 'not_seen' AS problem_cause FROM f WHERE action <> 'Stop' AND NOT bad AND l_linenumber < 5")
def navigation_rewrite(spark, d):
    rows = _lines(spark, d)
    out = frames.navigation_rewrite(rows, rows.filter("bad"), "key", "action", F.lit("not_seen"), rows.filter("l_linenumber < 5"))
    return out.select("l_orderkey", "l_linenumber", "problem_cause")


@query(_FRAMES + " SELECT l_orderkey, count(*) FILTER (action = 'Stop') AS stops, count(*) FILTER (action <> 'Stop' AND bad) AS removed FROM f GROUP BY 1")
def removed_rows(spark, d):
    rows = _lines(spark, d)
    return frames.removed(rows, rows.filter("bad"), ["l_orderkey"], "key", "action")


@query("""SELECT l_orderkey, CAST(max(l_linenumber) + 1 AS INT) AS l_linenumber, 'Stop' AS action, p_name, p_size, max(l_linenumber) AS after, 'bank' AS type FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 20) + 1 AS p_partkey FROM lineitem) JOIN part USING (p_partkey) GROUP BY l_orderkey, p_name, p_size""")
def appended_bank_stops(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 20 + 1).alias("p_partkey"))
    out = frames.appended_stop(rows, table(spark, d, "part"), ["l_orderkey"], "l_linenumber", "p_partkey", ["p_name", "p_size"], "action", "bank")
    return out.select("l_orderkey", "l_linenumber", "action", "p_name", "p_size", F.col("stop_source.after").alias("after"), F.col("stop_source.type").alias("type"))


@query("""WITH e AS (SELECT l_orderkey, list_sort(list(CAST(l_linenumber AS BIGINT))) AS there, CAST(min(l_partkey) % 9 AS BIGINT) AS a, CAST(min(l_suppkey) % 9 AS BIGINT) AS b, CAST(max(l_linenumber) AS BIGINT) AS m FROM lineitem GROUP BY 1),
    w AS (SELECT l_orderkey, there, list_filter([a, NULL, -1, b, a, m], lambda k: k IS NOT NULL AND list_contains(there, k)) AS w FROM e)
    SELECT l_orderkey, array_to_string(list_sort(list_filter(w, lambda v, i: list_position(w, v) = i)[1:2]), ',') AS frames, array_to_string(CASE WHEN list_contains(there, 9) THEN [CAST(9 AS BIGINT)] ELSE there[1:2] END, ',') AS fallback FROM w""")
def priority_frames(spark, d):
    e = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("there"), (F.min("l_partkey") % 9).alias("a"), (F.min("l_suppkey") % 9).alias("b"), F.max("l_linenumber").cast("long").alias("m"))
    wanted = F.array("a", F.lit(None).cast("long"), F.lit(-1).cast("long"), "b", "a", "m")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return e.select("l_orderkey", text(frames.priority_frames(wanted, "there", 2, fallback=False)).alias("frames"), text(frames.priority_frames(F.array(F.lit(9)), "there", 2)).alias("fallback"))


@query(_FRAMES + """, g AS (SELECT *, px > 0 AND l_linenumber % 3 > 0 AS seen, CASE WHEN l_linenumber % 3 > 0 THEN px ELSE 0 END AS vis, 2 AS sel FROM f WHERE NOT bad),
    h AS (SELECT *, bool_or(seen) OVER w AS visible, arg_min(l_linenumber, -vis * 100 + l_linenumber) FILTER (seen) OVER w AS largest, count(*) OVER w AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos FROM g WINDOW w AS (PARTITION BY l_orderkey)),
    k AS (SELECT *, visible AND (l_linenumber = sel OR l_linenumber = largest) AS kept FROM h),
    t AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY kept DESC, seen DESC, quality DESC, vis DESC, l_linenumber) AS turn FROM k)
    SELECT l_orderkey, l_linenumber FROM t WHERE CASE WHEN visible THEN (kept OR seen) AND turn <= 3 ELSE n <= 3 OR pos IN (0, CAST(round_even((n - 1) / 2.0, 0) AS BIGINT), n - 1) END""")
def sheet_frames(spark, d):
    seen = F.when(F.col("l_linenumber") % 3 > 0, F.col("mask.pixel_count")).otherwise(0)
    rows = _lines(spark, d).select("l_orderkey", "l_linenumber", "quality", "bad", seen.alias("vis"), F.lit(2).alias("sel"))
    return frames.sheet(rows, ["l_orderkey"], "l_linenumber", "quality", "vis", "bad", "sel", 3).select("l_orderkey", "l_linenumber")


@query(_FRAMES + " SELECT l_orderkey, coalesce(max(l_linenumber) FILTER (action = 'Stop'), max(l_linenumber)) AS stop_at FROM f GROUP BY 1")
def legacy_stops(spark, d):
    return frames.legacy_stops(_lines(spark, d), ["l_orderkey"], "l_linenumber", "l_linenumber", "action")


@query(f"""WITH s AS (SELECT l_orderkey, l_discount AS move, lag(l_quantity) OVER w - l_quantity AS t, lag(l_tax * 100) OVER w - l_tax * 100 AS g FROM {_NUMBERED} WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber))
    SELECT l_orderkey, round(sum(t) / sum(move), 4) AS train_per_meter, round(sum(g) / sum(move), 4) AS goal_per_meter, round(avg(CAST(t > 0.25 AND g < -0.25 AS INT)), 6) AS conflict_share FROM s WHERE move > 0.02 AND t IS NOT NULL GROUP BY 1""")
def motion_conflicts(spark, d):
    steps = _numbered(spark, d).select("l_orderkey", "l_linenumber", F.col("l_discount").alias("move"), F.col("l_quantity").alias("train"), (F.col("l_tax") * 100).alias("goal"))
    out = frames.conflicts(steps, ["l_orderkey"], "l_linenumber", "move", "train", "goal", 0.02)
    return out.select("l_orderkey", r(F.col("train_per_meter"), 4).alias("train_per_meter"), r(F.col("goal_per_meter"), 4).alias("goal_per_meter"), r(F.col("conflict_share")).alias("conflict_share"))


@query(f"""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Neighborhood' ELSE 'Other' END AS scene, p_size % 3 > 0 AS filled, CASE WHEN p_size % 7 = 0 THEN 'within20_clear' WHEN p_size % 5 = 0 THEN 'within20_weak' WHEN p_size % 3 = 0 THEN 'outside20_clear' WHEN p_size % 2 = 0 THEN 'outside20_weak' END AS seen,
    CASE WHEN p_size % 6 = 0 THEN NULL WHEN p_size % 6 = 1 THEN 'unknown' WHEN p_size % 6 = 2 THEN 'occluded' WHEN p_size > 30 THEN 'dataset_simulator_xy_coordinate_mismatch' WHEN p_size % 6 <> 3 THEN 'target_actor_at_expected_xy_but_no_pixels_in_path_or_standoff' ELSE 'target_pixels_exist_but_below_clear_threshold_after_standoff' END AS cause,
    CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 8 = 0 THEN '01_valid_stop_control' ELSE '02_valid_stop_better_earlier' END WHEN p_size > 20 THEN CASE WHEN p_size % 3 = 0 THEN '03_zero_pixel_stop_earlier_clear' WHEN p_size % 5 = 0 THEN '04_clipped_stop_earlier_clear' ELSE '05_weak_stop_earlier_clear' END WHEN p_size % 6 = 2 THEN '07_occluded' ELSE '06_path_viewpoint_or_occlusion' END AS review,
    p_size % 2 = 0 AND (p_size % 3 > 0 OR p_size % 5 > 0) AS collided FROM part""")
def failure_classes(spark, d):
    size = F.col("p_size")
    yes = lambda n: F.when(size % n == 0, "Yes").otherwise("no")
    cause = F.when(size % 6 == 1, "").when(size % 6 == 2, "occluded").otherwise(repairs.UNRESOLVED)
    status = F.when(size % 6 == 0, "clear_geometry_available").otherwise("none")
    reasons = F.when(size % 5 == 0, F.array(F.lit("severely_clipped_or_too_close"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(
        "p_partkey",
        repairs.scene_name(F.when(size % 4 == 0, "NeighborhoodTrain").when(size % 2 == 0, "ModularNeighborhood").otherwise("Other")).alias("scene"),
        repairs.filled(F.lit("x"), F.when(size % 3 == 0, "  ").otherwise("y")).alias("filled"),
        repairs.seen_class(size % 7 == 0, yes(5), yes(3), F.when(size % 2 == 0, 1).otherwise(0)).alias("seen"),
        repairs.refined_cause(status, cause, F.when(size > 30, 21.0), F.when(size % 6 == 3, 7)).alias("cause"),
        repairs.review_case(size % 4 == 0, F.when(size % 8 == 0, size), size, F.when(size > 20, 1).otherwise(0), F.when(size % 3 > 0, 5), reasons, F.when(size % 6 == 2, "occluded"), {"occluded": "07_occluded"}).alias("review"),
        repairs.new_collision(size % 2 == 0, size % 3 == 0, F.lit(1), F.when(size % 5 > 0, 2).otherwise(1)).alias("collided"),
    )


@query("""WITH a AS (SELECT c_nationkey, bool_or(c_custkey % 7 = 0) AS any_clear, bool_or(c_custkey % 11 = 0) AS standoff FROM customer GROUP BY 1)
    SELECT c_custkey, CASE WHEN any_clear THEN 'clear_on_at_least_one_expert_path' WHEN standoff THEN 'target_facing_standoff_repairable' ELSE 'unresolved_after_target_facing_standoff' END AS actor_status,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN any_clear THEN 'trajectory_viewpoint_distance_or_occlusion' WHEN standoff THEN 'target_facing_standoff_repairable' ELSE 'target_mapping_coordinate_or_scene_asset_unresolved' END AS no_target_cause FROM customer JOIN a USING (c_nationkey)""")
def actor_statuses(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 7 == 0).cast("int").alias("clear"), (F.col("c_custkey") % 11 == 0).alias("standoff"))
    return repairs.actor_status(c, ["c_nationkey"], "clear", "standoff").select("c_custkey", "actor_status", "no_target_cause")


@query("""SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '|') AS "values", count(DISTINCT c_custkey % 50) AS episodes FROM customer GROUP BY 1""")
def actor_sets(spark, d):
    return repairs.actor_sets(table(spark, d, "customer").withColumn("e", F.col("c_custkey") % 50), ["c_nationkey"], "c_mktsegment", "e")


@query("""WITH p AS (SELECT vec_id, k, CAST(embedding[k * 4 + 1] AS DOUBLE) * 50 AS x, CAST(embedding[k * 4 + 2] AS DOUBLE) * 50 AS y, CAST(embedding[k * 4 + 3] AS DOUBLE) * 50 AS z, CAST(embedding[k * 4 + 4] AS DOUBLE) * 10 AS yaw FROM embeddings, range(6) t(k)),
    q AS (SELECT vec_id, j, CAST(embedding[30 + j * 3] AS DOUBLE) * 50 AS tx, CAST(embedding[31 + j * 3] AS DOUBLE) * 50 AS ty, CAST(embedding[32 + j * 3] AS DOUBLE) * 50 AS tz FROM embeddings, range(2) t(j)),
    a AS (SELECT vec_id, k, sqrt((tx - x) ** 2 + (ty - y) ** 2 + (tz - z) ** 2) AS dist, abs(((degrees(atan2(ty - y, tx - x) - yaw) + 180) % 360 + 360) % 360 - 180) AS yaw, abs(degrees(atan2(tz - z, sqrt((tx - x) ** 2 + (ty - y) ** 2)))) AS pitch FROM p JOIN q USING (vec_id)),
    n AS (SELECT vec_id, k, arg_min(yaw, dist) AS yaw, arg_min(pitch, dist) AS pitch FROM a GROUP BY 1, 2)
    SELECT vec_id, bool_or(yaw <= 45 AND pitch <= 45) AS any_in_view, CAST(count(*) FILTER (yaw <= 45 AND pitch <= 45) AS INT) AS in_view, round(max(yaw) FILTER (k = 5), 4) AS stop_yaw, round(max(pitch) FILTER (k = 5), 4) AS stop_pitch FROM n GROUP BY 1""")
def view_summaries(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    pose = lambda k: F.array(*(F.element_at("e", (k * 4 + i).cast("int")) * (50 if i < 4 else 10) for i in (1, 2, 3, 4)))
    seen = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct(k.alias("frame_idx"), pose(k).alias("pose")))
    targets = F.array(*(F.transform(F.slice("e", 30 + 3 * j, 3), lambda v: v * 50) for j in range(2)))
    out = repairs.view_summary(e.select("vec_id", seen.alias("frames"), targets.alias("targets"), F.lit(5).alias("stop")), ["vec_id"], "frames", "targets", "stop")
    return out.select("vec_id", "any_in_view", "in_view", r(F.col("stop_yaw"), 4).alias("stop_yaw"), r(F.col("stop_pitch"), 4).alias("stop_pitch"))


@query("SELECT o_custkey AS stop, o_orderkey AS episode_key, o_orderkey % 3 = 0 AS wanted FROM orders")
def represented_episodes(spark, d):
    o = table(spark, d, "orders")
    queue = o.groupBy(F.col("o_custkey").alias("stop")).agg(F.collect_list("o_orderkey").alias("members"), F.count("*").cast("int").alias("n"))
    stops = queue.select("stop")
    every = repairs.represented(stops, queue, "stop", "members", "n")
    some = repairs.represented(stops, queue, "stop", "members", "n", only=o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("episode_key")))
    return every.join(some.select("episode_key", F.lit(True).alias("wanted")), "episode_key", "left").select("stop", "episode_key", F.coalesce("wanted", F.lit(False)).alias("wanted"))


@query(f"""WITH r AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber) AS steps FROM {_NUMBERED} WHERE l_orderkey % 4 > 0 GROUP BY 1)
    SELECT o_orderkey, CASE WHEN steps IS NULL THEN 'no_episode' WHEN o_custkey % 6 >= len(steps) THEN 'no_step' ELSE 'step' END AS found, steps[o_custkey % 6 + 1] AS step FROM orders LEFT JOIN r ON o_orderkey = l_orderkey""")
def capture_steps(spark, d):
    line = F.struct("l_linenumber", "l_partkey")
    runs = _numbered(spark, d).filter("l_orderkey % 4 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda s: s["l_partkey"]).alias("steps"))
    captures = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 6).cast("int").alias("at"))
    return repairs.capture_steps(captures, runs, ["o_orderkey"], "steps", "at").select("o_orderkey", "found", "step")


@query("SELECT 'rows' AS part, count(*) AS n, count(*) FILTER (c_custkey % 3 = 1) AS salvaged FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT 'quarantine', count(*), 0 FROM customer WHERE c_custkey % 3 = 2 AND c_custkey % 6 <> 1")
def salvage_unions(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    rows, left = repairs.salvaged(c.filter("c_custkey % 3 = 0"), c.filter("c_custkey % 3 = 1"), c.filter("c_custkey % 3 > 0"), "c_custkey", ["c_custkey", "c_name"])
    return rows.agg(F.lit("rows").alias("part"), F.count("*").alias("n"), F.count_if("salvaged").alias("salvaged")).unionByName(left.agg(F.lit("quarantine").alias("part"), F.count("*").alias("n"), F.lit(0).cast("long").alias("salvaged")))


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE) + CASE WHEN label % 2 = 0 THEN 130 ELSE 0 END, 5) AS x, round(CAST(embedding[5] AS DOUBLE) + CASE WHEN label % 2 = 0 THEN 110 ELSE 0 END, 5) AS y, round(CAST(embedding[9] AS DOUBLE), 5) AS z, label % 2 = 0 AS repaired,
    CAST(row_number() OVER (PARTITION BY embedding[7] + CASE WHEN label % 2 = 0 THEN 130 ELSE 0 END ORDER BY embedding[8], vec_id) AS INT) * 0 + 1 AS pose FROM embeddings""")
def shifted_metadata(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.when(F.col("label") % 2 == 0, "NeighborhoodTrain").otherwise("Other").alias("scene"), F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    rows = e.select("vec_id", "scene", F.array(F.slice("e", 4, 3), F.array(F.element_at("e", 1), F.element_at("e", 5), F.element_at("e", 9))).alias("targets"), F.slice("e", 7, 3).alias("start"))
    moved = repairs.shift_metadata(rows, "scene", "targets", "start", 130.0, 110.0)
    tasks = repairs.planning_tasks(moved.withColumn("repaired", F.col("coordinate_repair").isNotNull()), ["vec_id", "repaired"], "start", "targets").filter("pose_idx = 1")
    at = lambda k: F.round(F.element_at("target", k), 5) + F.lit(0.0)
    return tasks.select("vec_id", at(1).alias("x"), at(2).alias("y"), at(3).alias("z"), "repaired", F.col("pose_idx").alias("pose"))


@query("""WITH p AS (SELECT vec_id, k, round(CAST(embedding[k * 2 + 1] AS DOUBLE), 1) AS a, round(CAST(embedding[k * 2 + 2] AS DOUBLE), 1) AS b FROM embeddings, range(3) t(k))
    SELECT a, b, CAST(max(vec_id * 10 + k) AS BIGINT) AS last FROM p GROUP BY 1, 2""")
def unique_positions(spark, d):
    e = table(spark, d, "embeddings")
    at = lambda k: F.round(F.element_at("embedding", k).cast("double"), 1) + F.lit(0.0)
    rows = e.select("vec_id", F.array(*(F.array(at(2 * k + 1), at(2 * k + 2)) for k in range(3))).alias("targets"))
    out = repairs.unique_positions(rows, "targets", "vec_id")
    where = rows.select("vec_id", F.posexplode("targets").alias("k", "position")).groupBy("position").agg(F.max(F.col("vec_id") * 10 + F.col("k")).alias("last"))
    return out.join(where, "position").select(F.element_at("position", 1).alias("a"), F.element_at("position", 2).alias("b"), "last")


_RESPONSE = "CASE WHEN event_type = 'view' THEN 'turn left 30 degree' WHEN event_type = 'click' THEN 'turn right 30 degree' WHEN event_type = 'purchase' THEN 'forward 3m' ELSE 'stop' END"


@query(f"""WITH s AS (SELECT {_RESPONSE} AS action, CASE WHEN value < 30 THEN 'stagnant' WHEN value < 50 THEN 'revisiting' ELSE 'progressing' END AS motion, CASE WHEN event_id % 3 = 0 THEN 'oscillating' WHEN event_id % 5 = 0 THEN 'full_rotation_loop' ELSE 'none' END AS turn FROM events),
    e AS (SELECT motion AS state, action FROM s UNION ALL SELECT turn, action FROM s)
    SELECT state, count(*) AS steps, round(avg(CAST(action LIKE 'turn%' AS INT)), 6) AS turn_share, round(avg(CAST(action = 'forward 3m' AS INT)), 6) AS forward_share FROM e WHERE state IN ('stagnant', 'revisiting', 'oscillating', 'full_rotation_loop') GROUP BY 1""")
def memory_rule_responses(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    action = F.when(kind == "view", actions.TURNS[0]).when(kind == "click", actions.TURNS[1]).when(kind == "purchase", "forward 3m").otherwise("stop")
    motion = F.when(F.col("value") < 30, "stagnant").when(F.col("value") < 50, "revisiting").otherwise("progressing")
    turn = F.when(F.col("event_id") % 3 == 0, "oscillating").when(F.col("event_id") % 5 == 0, "full_rotation_loop").otherwise("none")
    out = repairs.state_response(e.select(action.alias("action"), motion.alias("motion"), turn.alias("turn")), "motion", "turn", "action")
    return out.select("state", "steps", r(F.col("turn_share")).alias("turn_share"), r(F.col("forward_share")).alias("forward_share"))


@query(f"""WITH s AS (SELECT user_id, {_RESPONSE} AS action, value AS before, abs(((value * 3 - 30 + 180) % 360 + 360) % 360 - 180) AS after FROM events)
    SELECT user_id, count(*) AS n, round(avg(CAST(action LIKE 'turn%' AS INT)), 6) AS turn_rate, round(avg(CAST(action = 'forward 3m' AS INT)), 6) AS forward_rate, round(avg(after) + 1e-8, 5) AS mean_after, round(quantile_cont(after, 0.5) + 1e-8, 5) AS median_after, round(avg(before - after) + 1e-8, 5) AS mean_improvement FROM s GROUP BY 1""")
def exploration_metrics(spark, d):
    kind = F.col("event_type")
    action = F.when(kind == "view", actions.TURNS[0]).when(kind == "click", actions.TURNS[1]).when(kind == "purchase", "forward 3m").otherwise("stop")
    rows = table(spark, d, "events").select("user_id", action.alias("action"), F.col("value").alias("before"), prompts.heading_error(F.col("value") * 3, F.lit(30.0)).alias("after"))
    out = repairs.exploration(rows, ["user_id"], "action", "before", "after")
    near = lambda c: r(F.col(c) + 1e-8, 5).alias(c)
    return out.select("user_id", "n", r(F.col("turn_rate")).alias("turn_rate"), r(F.col("forward_rate")).alias("forward_rate"), near("mean_after"), near("median_after"), near("mean_improvement"))


@query("""SELECT o_custkey, CAST(arg_max(greatest(1, n), o_orderkey) AS INT) AS cost FROM (SELECT o_custkey, o_orderkey, count(l_linenumber) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber > 3 GROUP BY 1, 2) GROUP BY 1""")
def reference_costs(spark, d):
    steps = table(spark, d, "lineitem").filter("l_linenumber > 3").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("steps"))
    return repairs.reference_costs(table(spark, d, "orders").join(steps, "o_orderkey", "left"), ["o_custkey"], "o_orderkey", "steps")


@query("SELECT p_partkey, 'Where is ' || p_name || '?' AS prompt, CASE WHEN p_size % 2 = 0 THEN 'stop' ELSE 'forward 3m' END AS command FROM part")
def conversation_pairs(spark, d):
    turn = lambda who, v: F.struct(F.lit(who).alias("from"), v.alias("value"))
    command = F.when(F.col("p_size") % 2 == 0, " stop\n").otherwise("forward 3m")
    turns = F.array(turn("human", F.concat(F.lit("Where is "), F.col("p_name"), F.lit("?"))), turn("gpt", command), turn("system", F.lit("x")))
    return table(spark, d, "part").select("p_partkey", repairs.conversation_parts(turns, F.array(F.lit("a.png")), actions.COMMANDS).alias("c")).select("p_partkey", "c.prompt", "c.command")


@query("""WITH a AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) * 2 AS r, CAST(embedding[3] AS DOUBLE) * 2 AS y FROM embeddings)
    SELECT vec_id, round(p, 5) AS pitch, round(r, 5) AS roll, round(y, 5) AS yaw, round(cos(y) * cos(p), 5) AS ahead_x, round(sin(y) * cos(p), 5) AS ahead_y, round(-sin(p), 5) AS ahead_z FROM a""")
def rotations(spark, d):
    from tessera.functions.geometry import euler

    p, roll, yaw = (F.element_at("embedding", k).cast("double") * s for k, s in ((1, 1), (2, 2), (3, 2)))
    back = euler(*repairs.from_euler(p, roll, yaw))
    ahead = repairs.rotated([F.lit(1.0), F.lit(0.0), F.lit(0.0)], roll, p, yaw)
    e = table(spark, d, "embeddings").select("vec_id", back.alias("b"), *(a.alias(f"a{k}") for k, a in enumerate(ahead)))
    return e.select("vec_id", *(r(F.col(f"b.{c}"), 5).alias(c) for c in ("pitch", "roll", "yaw")), *(r(F.col(f"a{k}"), 5).alias(f"ahead_{c}") for k, c in enumerate("xyz")))


_WALK = """WITH s AS (SELECT user_id, row_number() OVER w - 1 AS step, CASE WHEN row_number() OVER w > 1 THEN event_type END AS action, value AS x, value * 2 AS y, 0.0 AS z, (event_id * 37) % 360 AS yaw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    e AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS t, abs(((yaw - lag(yaw) OVER w + 180) % 360 + 360) % 360 - 180) AS h, '[(' || printf('%.2f', x) || ', ' || printf('%.2f', y) || ', 0.00), ' || printf('%.2f', CAST(yaw AS DOUBLE)) || 'deg]' AS pose FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)),
    c AS (SELECT *, coalesce(sum(t) OVER r, 0) AS d, coalesce(avg(h) OVER r, 0) AS a, first_value(pose) OVER r AS start, first_value(x) OVER r AS sx, first_value(y) OVER r AS sy, lag(pose) OVER (PARTITION BY user_id ORDER BY step) AS before FROM e WINDOW r AS (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
    m AS (SELECT *, 'TrajectorySummary:' || chr(10) || 'StepsSoFar = ' || step || chr(10) || 'DistanceTraveled = ' || printf('%.2f', d) || 'm' || chr(10) || 'AvgHeadingChange = ' || printf('%.2f', a) || 'deg' || chr(10) || chr(10) || 'Memory rules:' || chr(10) AS summary,
        list(CASE WHEN action IS NOT NULL THEN {'step': step, 'action': action, 'pose': pose, 'before': before} END) OVER (PARTITION BY user_id ORDER BY step ROWS 2 PRECEDING) AS l FROM c),
    n AS (SELECT *, list_filter(l, lambda v: v IS NOT NULL) AS recent FROM m)"""


def _walk(spark, d):
    e = seq.with_row(table(spark, d, "events"), ["user_id"], ["event_id"])
    return e.select("user_id", (F.col("_row") - 1).cast("long").alias("step"), F.when(F.col("_row") > 1, F.col("event_type")).alias("action"), F.col("value").alias("x"), (F.col("value") * 2).alias("y"), F.lit(0.0).alias("z"), (F.col("event_id") * 37 % 360).cast("double").alias("yaw"))


@query(_WALK + """ SELECT user_id, step, 'EpisodeMemory:' || chr(10) || 'Pose format: [(x, y, z), yaw_degrees]' || chr(10) || 'EpisodeStartPose: ' || start || chr(10) || 'CurrentPose: ' || pose || chr(10) || 'RecentTransitions (last 3 executed steps, oldest to newest):' || chr(10) ||
    CASE WHEN len(recent) = 0 THEN '  none' ELSE array_to_string(list_transform(recent, lambda q: '  ' || q.step || '. ' || q.action || ' -> ' || q.pose), chr(10)) END || chr(10) || summary ||
    '- Use RecentTransitions to avoid revisiting the same place and repeating rotation loops.' || chr(10) || '- If several turns barely change position, choose a position-changing action only when CurrentViewDepth is safe.' || chr(10) || '- Before choosing forward 3m, consider CurrentViewDepth.' || chr(10) || '- Do not stop only because many steps were used; stop only when the target is visually confirmed.' AS context FROM n""")
def transition_contexts(spark, d):
    return contexts.build("transition_history", _walk(spark, d), ["user_id"], "step", n=3).select("user_id", "step", "context")


@query(_WALK + """ SELECT user_id, step, 'EpisodeMemory:' || chr(10) || 'SearchBounds are centered on the episode start position. Keep the next horizontal pose inside them.' || chr(10) || 'SearchBounds: x=[' || printf('%.1f', sx - 50) || ', ' || printf('%.1f', sx + 50) || '], y=[' || printf('%.1f', sy - 50) || ', ' || printf('%.1f', sy + 50) || ']' || chr(10) || 'Pose format: [(x, y, z), yaw_degrees]' || chr(10) || 'RecentPoseActionChain (up to last 3 executed transitions, oldest to newest):' || chr(10) ||
    '  Pose' || (step - len(recent)) || ': ' || CASE WHEN len(recent) = 0 THEN pose ELSE recent[1].before END || coalesce(array_to_string(list_transform(recent, lambda q: chr(10) || '  Action' || q.step || ': ' || q.action || chr(10) || '  Pose' || q.step || ': ' || q.pose), ''), '') || chr(10) || summary ||
    '- Read each Pose -> Action -> Pose segment as one executed transition.' || chr(10) || '- Use the chain to avoid revisiting the same place and repeating rotation loops.' || chr(10) || '- If several turns barely change position, choose a position-changing action only when CurrentViewDepth is safe.' || chr(10) || '- Before choosing forward 3m, consider both CurrentViewDepth and SearchBounds.' || chr(10) || '- Do not stop only because many steps were used; stop only when the target is visually confirmed.' AS context FROM n""")
def pose_action_contexts(spark, d):
    return contexts.build("pose_action_history", _walk(spark, d), ["user_id"], "step", n=3, bounds=True).select("user_id", "step", "context")


@query(_WALK + """, q AS (SELECT *, list('  ' || replace(pose, 'deg]', ']')) OVER o AS poses, list_filter(list(action) OVER o, lambda v: v IS NOT NULL) AS acts FROM n WINDOW o AS (PARTITION BY user_id ORDER BY step ROWS 2 PRECEDING))
    SELECT user_id, step, 'EpisodeMemory:' || chr(10) || 'SearchBounds are centered on the episode start position. Keep the next horizontal pose inside them.' || chr(10) || 'SearchBounds: x=[' || printf('%.1f', sx - 50) || ', ' || printf('%.1f', sx + 50) || '], y=[' || printf('%.1f', sy - 50) || ', ' || printf('%.1f', sy + 50) || ']' || chr(10) || 'Previous UAV Poses (up to last 3 actual poses, oldest to newest):' || chr(10) || 'Format: [(x, y, z), yaw_degrees]' || chr(10) || '[' || chr(10) || array_to_string(poses, ',' || chr(10)) || chr(10) || ']' || chr(10) ||
    'TrajectorySummary:' || chr(10) || 'StepsSoFar = ' || step || chr(10) || 'DistanceTraveled = ' || printf('%.2f', d) || 'm' || chr(10) || 'AvgHeadingChange = ' || printf('%.2f', a) || 'deg' || chr(10) || 'RecentActions = ' || CASE WHEN len(acts) = 0 THEN 'none' ELSE array_to_string(acts, ', ') END || chr(10) || chr(10) || 'Memory rules:' || chr(10) ||
    '- Use EpisodeMemory to avoid revisiting the same place and avoid repeated rotations.' || chr(10) || '- If RecentActions show repeated turns, prefer moving forward only when CurrentViewDepth is safe.' || chr(10) || '- Before choosing forward 3m, consider whether the next pose would remain inside SearchBounds.' || chr(10) || '- Do not stop only because memory shows many steps; stop only when the target is visually confirmed.' AS context FROM q""")
def pose_contexts(spark, d):
    return contexts.build("pose_history", _walk(spark, d), ["user_id"], "step", n=3, bounds=True).select("user_id", "step", "context")


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'A full visual scan is complete. Change position now: move forward when the complete 3m path is depth-safe; otherwise turn away from left once and reassess. Do not continue turning left.'
    WHEN 1 THEN 'Break the left-right alternation. Do not turn right next; move forward when depth-safe, otherwise continue left once and reassess.' WHEN 2 THEN 'Leave the revisited position: move forward when depth-safe; otherwise inspect a new direction without repeating the recent motion pattern.'
    WHEN 3 THEN 'The last ' || event_type || ' movement made less than 1m progress. Do not repeat it immediately; inspect another direction first.' ELSE 'Continue normal visual search; short directional scans are allowed.' END AS directive, round(degrees(value), 4) AS yaw, '' AS context FROM events""")
def directives(spark, d):
    k = F.col("event_id") % 5
    mode = F.element_at(F.array(*map(F.lit, (*contexts.DIRECTIVES, "NORMAL"))), (k + 1).cast("int"))
    avoid = F.when(k == 0, "left").when(k == 1, "right").otherwise("none")
    e = contexts.build("none", table(spark, d, "events"), ["user_id"], "event_id")
    pose = contexts.degrees_pose(F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("value")))
    return e.select("event_id", contexts.directive(mode, F.lit("left"), avoid, F.col("event_type")).alias("directive"), r(pose["yaw"], 4).alias("yaw"), "context")
