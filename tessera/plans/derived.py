"""Queries over derived rows: rasters made from table values, memory states, classes and flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import contexts, geometry, prompts, rasters, text, visibility
from tessera.operators import aggregates as agg
from tessera.operators import machines, outcomes, rows, stats
from tessera.operators import sequence as seq
from tessera.operators.memory import restart_reason, states
from tessera.plans.base import query, r, table


@query("""WITH m AS (SELECT vec_id, list_transform(range(8), lambda y: list_transform(range(8), lambda x: embedding[y * 8 + x + 1] > 0.1)) AS m FROM embeddings),
    c AS (SELECT vec_id, x, y FROM m, range(8) a(x), range(8) b(y) WHERE m[y + 1][x + 1])
    SELECT vec_id, count(*) AS pixels, CAST(max(x) - min(x) + 1 AS INT) AS width, CAST(max(y) - min(y) + 1 AS INT) AS height, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) FILTER (x < 2 OR x > 5 OR y < 2 OR y > 5) AS edge FROM c GROUP BY vec_id""")
def mask_summaries(spark, d):
    mask = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.transform(F.slice("embedding", y * 8 + 1, 8), lambda v: v > F.lit(0.1).cast("float")))
    m = table(spark, d, "embeddings").select("vec_id", rasters.mask_metrics(mask).alias("m")).filter("m.pixel_count > 0")
    return m.select("vec_id", F.col("m.pixel_count").alias("pixels"), F.col("m.bbox_width").alias("width"), F.col("m.bbox_height").alias("height"), r(F.element_at("m.centroid", 1)).alias("cx"), r(F.element_at("m.centroid", 2)).alias("cy"), F.col("m.edge_contact_pixels").alias("edge"))


@query("""SELECT vec_id, round(list_min(list_transform(range(16), lambda k: CAST(greatest(0, least(100, embedding[k + 1] * 100)) AS DOUBLE))), 1) AS least FROM embeddings""")
def depth_grids(spark, d):
    depth = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda y: F.transform(F.slice("embedding", y * 4 + 1, 4), lambda v: (v * F.lit(100.0).cast("float")).cast("double")))
    g = table(spark, d, "embeddings").select("vec_id", rasters.depth_grid(depth, 2).alias("g"))
    return g.select("vec_id", F.array_min(F.flatten("g")).alias("least"))


def _turning(spark, d):
    """Steps of agents that turn and go forward, from events."""
    e = seq.with_row(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    turn = F.element_at(F.create_map(F.lit("view"), F.lit("turn left 30 degree"), F.lit("click"), F.lit("turn right 30 degree"), F.lit("purchase"), F.lit("forward 3m"), F.lit("signup"), F.lit("ascend 3m"), F.lit("error"), F.lit("stop")), F.col("event_type"))
    w = seq.running(["user_id"], ["_row"])
    moved = F.sum((F.col("event_type") == "purchase").cast("int") * 3.0).over(w)
    yaw = geometry.wrap_degrees(F.sum((F.col("event_type") == "view").cast("int") * 30.0 - (F.col("event_type") == "click").cast("int") * 30.0).over(w))
    return e.select("user_id", (F.col("_row") - 1).cast("long").alias("step"), F.when(F.col("_row") > 1, turn).alias("action"), moved.alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), yaw.alias("yaw"))


_STATES = """WITH s AS (SELECT user_id, row_number() OVER w - 1 AS step, CASE WHEN row_number() OVER w > 1 THEN CASE event_type WHEN 'view' THEN 'left' WHEN 'click' THEN 'right' WHEN 'purchase' THEN 'forward' WHEN 'signup' THEN 'ascend' ELSE 'other' END END AS a,
        3.0 * count(*) FILTER (event_type = 'purchase') OVER r AS x, ((30.0 * (count(*) FILTER (event_type = 'view') OVER r - count(*) FILTER (event_type = 'click') OVER r) + 180) % 360 + 360) % 360 - 180 AS yaw
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, abs(x - lag(x) OVER w) AS moved, abs(((yaw - lag(yaw) OVER w + 180) % 360 + 360) % 360 - 180) AS h, coalesce(CAST(a <> lag(a) OVER w AS INT), 1) AS changed, coalesce(a IN ('left', 'right'), false) AS turn, coalesce(a IN ('forward', 'ascend'), false) AS go FROM s WINDOW w AS (PARTITION BY user_id ORDER BY step)),
    u AS (SELECT *, sum(CAST(go AS INT)) OVER r AS moves, coalesce(sum(h) OVER r, 0) AS heading, max(CASE WHEN NOT turn THEN step END) OVER r AS turned, step - max(CASE WHEN changed = 1 THEN step END) OVER r + 1 AS since,
        list_filter(list(a) OVER (PARTITION BY user_id ORDER BY step ROWS 4 PRECEDING), lambda v: v IS NOT NULL) AS recent, abs(x - first_value(x) OVER (PARTITION BY user_id ORDER BY step ROWS 5 PRECEDING)) AS net FROM t WINDOW r AS (PARTITION BY user_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
    v AS (SELECT *, step > 5 AND EXISTS (SELECT 1 FROM u o WHERE o.user_id = u.user_id AND o.step <= u.step - 5 AND abs(o.x - u.x) < 1 AND u.moves > o.moves) AS back,
        EXISTS (SELECT 1 FROM u o WHERE o.user_id = u.user_id AND o.turned = u.turned AND o.step <= u.step - 10 AND abs(o.x - u.x) < 1 AND abs(((o.yaw - u.yaw + 180) % 360 + 360) % 360 - 180) < 15 AND u.heading - o.heading >= 300) AS looped FROM u),
    m AS (SELECT *, CASE WHEN step = 0 THEN 'not_started' WHEN back THEN 'revisiting' WHEN list_has_any(recent, ['forward', 'ascend']) THEN CASE WHEN net < 1 THEN 'stagnant' ELSE 'progressing' END ELSE 'stationary_scanning' END AS motion_state,
        len(recent) >= 4 AND net < 1 AND len(list_filter(recent[-4:], lambda q: q NOT IN ('left', 'right'))) = 0 AND recent[-4] <> recent[-3] AND recent[-3] <> recent[-2] AND recent[-2] <> recent[-1] AS swings,
        len(list_filter(recent, lambda q: q NOT IN ('left', 'right'))) = 0 AS turns, len(list_filter(range(1, len(recent)), lambda k: recent[k] = recent[k + 1])) = 0 AS alternating, len(list_distinct(recent)) = 1 AS one FROM v),
    n AS (SELECT *, CASE WHEN looped THEN 'full_rotation_loop' WHEN coalesce(swings, false) THEN 'oscillating' WHEN NOT turn THEN 'none' ELSE 'scan_' || a || '_x' || since END AS turn_state FROM m),
    d AS (SELECT *, CASE WHEN turn_state = 'full_rotation_loop' THEN 'LOOP_RECOVERY' WHEN turn_state = 'oscillating' THEN 'OSCILLATION_RECOVERY' WHEN motion_state = 'revisiting' THEN 'POSITION_RECOVERY' WHEN go AND moved < 1 THEN 'FAILED_TRANSLATION_RECOVERY' ELSE 'NORMAL' END AS decision_mode FROM n)"""


@query(_STATES + """
    SELECT user_id, step, motion_state, turn_state, CASE WHEN len(recent) = 0 THEN 'none' WHEN turns AND one THEN recent[1] || '_turn_x' || len(recent) WHEN turns AND alternating THEN 'alternating_turns' WHEN turns THEN 'mixed_turns' WHEN one THEN recent[1] || '_x' || len(recent) ELSE 'mixed_motion' END AS action_pattern,
    decision_mode, CASE WHEN NOT turn THEN 'none' WHEN decision_mode = 'LOOP_RECOVERY' THEN a WHEN decision_mode = 'OSCILLATION_RECOVERY' THEN CASE WHEN a = 'right' THEN 'left' ELSE 'right' END ELSE 'none' END AS avoid_turn FROM d""")
def memory_states(spark, d):
    return states(_turning(spark, d), ["user_id"], "step").select("user_id", "step", "motion_state", "turn_state", "action_pattern", "decision_mode", "avoid_turn")


_COMMAND = "CASE v WHEN 'left' THEN 'turn left 30 degree' WHEN 'right' THEN 'turn right 30 degree' WHEN 'forward' THEN 'forward 3m' WHEN 'ascend' THEN 'ascend 3m' ELSE 'stop' END"


@query(_STATES + f""", p AS (SELECT *, list('  [(' || printf('%.2f', x) || ', 0.00, 0.00), ' || printf('%.2f', yaw) || ']') OVER (PARTITION BY user_id ORDER BY step ROWS 4 PRECEDING) AS poses FROM d)
    SELECT user_id, step, array_to_string(['EpisodeMemory:', 'Previous UAV Poses (up to last 5 actual poses, oldest to newest):', 'Format: [(x, y, z), yaw_degrees]', '[', array_to_string(poses, ',' || chr(10)), ']', 'TrajectorySummary:', 'StepsSoFar = ' || step || '/100', 'RecentNetDisplacementLast5 = ' || printf('%.2f', net) || 'm',
        'LastActionEffect = ' || CASE WHEN step = 0 THEN 'none' ELSE 'translation ' || printf('%.2f', moved) || 'm, heading_change ' || printf('%.1f', h) || 'deg' END, 'RecentMotionState = ' || motion_state, 'RecentTurnState = ' || turn_state,
        'RecentActions (oldest to newest) = ' || CASE WHEN len(recent) = 0 THEN 'none' ELSE array_to_string(list_transform(recent, lambda v: {_COMMAND}), ', ') END, '', 'Memory rules:', 'own rules'], chr(10)) AS context FROM p""")
def state_contexts(spark, d):
    return contexts.build("state_history", _turning(spark, d), ["user_id"], "step", rules="own rules").select("user_id", "step", "context")


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'screen_missing' WHEN value * 10 > 300 THEN 'stale_' || CAST(floor(value * 10) AS BIGINT) || 's' WHEN event_type = 'view' THEN 'no_activity' END AS reason FROM events""")
def restart_reasons(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select("event_id", restart_reason(kind != "error", F.col("value") * 10, kind != "view").alias("reason"))


@query("""SELECT doc_id, CASE WHEN quality = 1 THEN 'clear' WHEN n_chars > 2000 THEN 'weak' ELSE 'absent' END || '_' || CASE WHEN toxic = 1 THEN 'stop' ELSE 'motion' END AS grp,
    CASE WHEN quality = 1 THEN 'clear_seen' WHEN n_chars > 2000 THEN 'weak_seen' ELSE 'never_seen' END || '_' || CASE WHEN toxic = 1 THEN 'stopped' ELSE 'no_stop' END AS failure FROM documents JOIN labels USING (doc_id)""")
def visibility_classes(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    clear, seen, stop = F.col("quality") == 1, F.col("n_chars") > 2000, F.col("toxic") == 1
    return j.select("doc_id", visibility.visibility_group(clear, seen.cast("int"), F.when(stop, "stop").otherwise("go")).alias("grp"), visibility.failure_class(seen, clear, stop).alias("failure"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'none' WHEN o_totalprice / 10000 <= 4 THEN 'd0_4' WHEN o_totalprice / 10000 <= 8 THEN 'd4_8' WHEN o_totalprice / 10000 <= 12 THEN 'd8_12' WHEN o_totalprice / 10000 <= 16 THEN 'd12_16' ELSE 'd16_20' END AS bin,
    concat_ws('::', 'scene', CAST(o_custkey AS VARCHAR), '0', CAST(o_orderkey AS VARCHAR)) AS key FROM orders""")
def keys_and_bins(spark, d):
    o = table(spark, d, "orders")
    key = rows.sample_key(F.lit("scene"), F.col("o_custkey").cast("string"), F.lit("0"), "o_orderkey")
    return o.select("o_orderkey", text.bins(F.col("o_totalprice") / 10_000, text.DISTANCE_BINS, "d16_20", "none").alias("bin"), key.alias("key"))


@query("""SELECT p_partkey, 'a::b' || '::' || p_size || '::' || (p_partkey % 100) AS key FROM part""")
def keys_from_paths(spark, d):
    path = F.concat(F.lit("/data/images/a/b/"), F.col("p_size").cast("string"), F.lit("/camera_0/"), F.format_string("%06d", F.col("p_partkey") % 100), F.lit(".png"))
    return table(spark, d, "part").select("p_partkey", rows.key_from_image_path(path).alias("key"))


@query("""SELECT o_custkey, CAST(count(*) AS BIGINT) AS pieces FROM (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS gap FROM orders) WHERE gap IS NULL OR gap > 1 GROUP BY o_custkey HAVING count(*) > 1""")
def contiguity_violations(spark, d):
    return seq.contiguous_violations(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey")


@query("""SELECT o_orderkey, previous FROM (SELECT o_orderkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders) WHERE o_totalprice <= previous""")
def monotonic_violations(spark, d):
    return seq.not_increasing(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_orderkey", "previous")


@query("""SELECT c_nationkey, min(r) AS rank_region FROM (SELECT c_nationkey, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY c_nationkey""")
def consistent_values(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return agg.consistent(c, ["c_nationkey"], "n_regionkey").select("c_nationkey", F.col("n_regionkey").alias("rank_region"))


@query("""SELECT vec_id, CAST(1 + list_sum(list_transform(embedding, lambda v: CAST(v > embedding[5] AS INT))) AS INT) AS rank, round(CAST(embedding[5] AS DOUBLE) - CAST(list_max(list_concat(embedding[1:4], embedding[6:64])) AS DOUBLE), 6) AS margin FROM embeddings""")
def similarity_ranks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", seq.similarity_rank(F.col("embedding").cast("array<double>"), F.lit(5)).alias("s"))
    return e.select("vec_id", F.col("s.rank").alias("rank"), r(F.col("s.margin")).alias("margin"))


@query("""SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 7 AS BIGINT) AS member, CAST((row_number() OVER (ORDER BY event_id) - 1) // 7 + 1 AS BIGINT) AS reuse FROM events""")
def reuse_indices(spark, d):
    # Event ids count from 0 without gaps, so they are the places.
    e = table(spark, d, "events").select("event_id", seq.reuse_index(F.col("event_id"), F.lit(7)).alias("u"))
    return e.select("event_id", F.col("u.member").cast("long").alias("member"), F.col("u.reuse").alias("reuse"))


@query("""SELECT vec_id, round(CAST(acos(greatest(-1.0, least(1.0, dot / sqrt(a * b)))) AS DOUBLE), 4) AS angle, dot > 0 AS ahead FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * cos(1.0) + CAST(embedding[2] AS DOUBLE) * sin(1.0) AS dot, CAST(embedding[1] AS DOUBLE) ** 2 + CAST(embedding[2] AS DOUBLE) ** 2 AS a, 1.0 AS b FROM embeddings)""")
def heading_alignments(spark, d):
    x, y = (F.element_at("embedding", k).cast("double") for k in (1, 2))
    c = geometry.heading_alignment(F.lit(1.0), x, y)
    return table(spark, d, "embeddings").select("vec_id", r(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))), 4).alias("angle"), (c > 0).alias("ahead"))


@query("""SELECT vec_id, least(CAST(embedding[5] AS DOUBLE), CAST(embedding[8] AS DOUBLE)) AS clearance, CAST(embedding[5] AS DOUBLE) > 0.05 AND CAST(embedding[8] AS DOUBLE) > 0.05 AS clear FROM embeddings""")
def forward_clearances(spark, d):
    grid = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda y: F.slice(F.col("embedding").cast("array<double>"), y * 3 + 1, 3))
    e = table(spark, d, "embeddings").select("vec_id", grid.alias("g"))
    return e.select("vec_id", prompts.forward_clearance("g").alias("clearance"), prompts.forward_clear("g", 0.05).alias("clear"))


@query("""SELECT o_orderpriority, count(*) AS n, round(count(*) FILTER (o_totalprice > 150000) * 100.0 / count(*), 6) AS pct, count(*) FILTER (o_totalprice > 150000) > 10 AND count(*) > 20 AS passed FROM orders GROUP BY o_orderpriority""")
def gated_groups(spark, d):
    big = F.count_if(F.col("o_totalprice") > 150_000)
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), big.alias("big"))
    tests = stats.gate({"a": F.col("big") > 10, "b": F.col("n") > 20})
    return g.select("o_orderpriority", "n", r(agg.percentage(F.col("big"), F.col("n"))).alias("pct"), tests[-1])


@query("""SELECT lang, approx_unique BETWEEN 0.85 * exact AND 1.15 * exact AS close FROM (SELECT lang, count(DISTINCT source) AS exact, count(DISTINCT source) AS approx_unique FROM documents GROUP BY lang)""")
def approximate_distinct(spark, d):
    g = table(spark, d, "documents").groupBy("lang").agg(F.count_distinct("source").alias("exact"), F.approx_count_distinct("source").alias("about"))
    return g.select("lang", F.col("about").between(0.85 * F.col("exact"), 1.15 * F.col("exact")).alias("close"))


_STEPS = """WITH s AS (SELECT user_id AS episode, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, CASE event_type WHEN 'purchase' THEN 'stop' ELSE event_type END AS action, value / 2 AS distance, event_id % 29 = 0 AS hit FROM events),
    e AS (SELECT *, CASE WHEN hit THEN 'collision' WHEN action = 'stop' THEN 'stop' WHEN step = 19 THEN 'step_limit' END AS ended FROM s),
    f AS (SELECT episode, min(step) FILTER (ended IS NOT NULL) AS last, arg_min(ended, step) FILTER (ended IS NOT NULL) AS termination FROM e GROUP BY episode),
    k AS (SELECT e.*, termination FROM e JOIN f USING (episode) WHERE last IS NULL OR step <= last),
    g AS (SELECT episode, coalesce(min(termination), 'unfinished') AS termination, count(*) AS steps, arg_max(distance, step) AS final_distance, bool_or(NOT hit AND distance <= 20) AS reach, bool_or(distance < 20) AS legacy_reach FROM k GROUP BY episode),
    o AS (SELECT episode, termination, steps, final_distance, termination = 'stop' AND final_distance <= 20 AS success, termination <> 'collision' AND reach AS oracle_reach, final_distance <= 20 AS legacy_success, legacy_reach FROM g)"""


def _stepped(spark, d):
    e = seq.with_row(table(spark, d, "events"), ["user_id"], ["ts", "event_id"])
    action = F.when(F.col("event_type") == "purchase", "stop").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("episode"), (F.col("_row") - 1).cast("long").alias("step"), action.alias("action"), (F.col("value") / 2).alias("distance"), (F.col("event_id") % 29 == 0).alias("hit"))


def _ended(spark, d):
    return outcomes.end_episodes(_stepped(spark, d), ["episode"], "step", "action", "distance", "hit", 20)


@query(_STEPS + " SELECT * FROM o")
def episode_outcomes(spark, d):
    return _ended(spark, d)


@query(_STEPS + " SELECT * FROM o")
def episode_machine(spark, d):
    return machines.end_episodes(_stepped(spark, d).withColumnRenamed("hit", "collided"), 20)


@query(_STEPS + """ SELECT CASE WHEN success THEN 'success' WHEN oracle_reach THEN 'osr_only' ELSE 'no_official_osr' END AS "group", count(*) AS num, round(avg(CAST(success AS INT)), 6) AS acc, round(avg(CAST(oracle_reach AS INT)), 6) AS osr, round(avg(final_distance), 4) AS ne FROM o GROUP BY 1""")
def outcome_report(spark, d):
    out = outcomes.report(_ended(spark, d), outcomes.outcome(F.col("success"), F.col("oracle_reach")))
    return out.select("group", "num", r(F.col("acc")).alias("acc"), r(F.col("osr")).alias("osr"), r(F.col("ne"), 4).alias("ne"))


@query("""SELECT event_type, CASE event_type WHEN 'view' THEN 'turn_left' WHEN 'click' THEN 'forward' WHEN 'error' THEN 'unknown' ELSE event_type END AS action, count(*) AS n FROM events GROUP BY event_type""")
def action_aliases(spark, d):
    name = F.when(F.col("event_type") == "view", " Turn Left ").when(F.col("event_type") == "click", "Move Forward").when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    return table(spark, d, "events").groupBy("event_type", outcomes.canonical_action(name).alias("action")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT a.i * 3.0 AS dx, b.i * 3.0 AS dy FROM range(-4, 5) a(i), range(-4, 5) b(i) WHERE sqrt((a.i * 3.0) ** 2 + (b.i * 3.0) ** 2) <= 12.000001),
    l AS (SELECT dx, dy, unnest(CASE WHEN dx = 0 AND dy = 0 THEN [-3.0, -6.0, -9.0, 3.0] ELSE [0.0, -3.0, -6.0, 3.0] END) AS dz FROM f),
    o AS (SELECT dx, dy, dz, CAST(row_number() OVER (ORDER BY sqrt(CAST(dx * dx + dy * dy + dz * dz AS DOUBLE)), CAST(dz >= 0 AS INT), abs(dz), abs(dx) + abs(dy), dx, dy, dz) - 1 AS INT) AS rank FROM l),
    e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 40 AS x, CAST(embedding[2] AS DOUBLE) * 40 AS y, CAST(embedding[3] AS DOUBLE) * 40 AS z FROM embeddings),
    c AS (SELECT e.vec_id, min(rank) AS rank FROM e, o WHERE CAST(floor(x + dx) AS INT) % 5 = 0 AND CAST(floor(y + dy) AS INT) % 4 = 0 AND z + dz < 20 GROUP BY 1)
    SELECT e.vec_id, c.rank, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy, CAST(dz AS DOUBLE) AS dz FROM e LEFT JOIN c USING (vec_id) LEFT JOIN o ON o.rank = c.rank""")
def recovery_offsets(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", *((F.element_at("embedding", k).cast("double") * 40).alias(n) for k, n in enumerate("xyz", 1)))
    whole = lambda v: F.floor(v).cast("int")
    blocked = lambda x, y, z: ~((whole(x) % 5 == 0) & (whole(y) % 4 == 0) & (z < 20))
    out = outcomes.first_free_offset(e, F.col("x"), F.col("y"), F.col("z"), blocked, 12.0)
    return out.select("vec_id", "offset.*").select("vec_id", "rank", "dx", "dy", "dz")
