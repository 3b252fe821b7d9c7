"""Queries over review tables and lookups; customers stand for records, their orders for frames and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.visibility import Policy
from tessera.operators import joins, tables
from tessera.plans.base import query, r, table


def _records(spark, d):
    """A record for each customer: its orders in order of their key, as poses, statuses and prices."""
    o = table(spark, d, "orders")
    line = F.struct("o_orderkey", "o_totalprice", "o_orderstatus")
    return o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(line)).alias("o"))


def _poses():
    return F.transform("o", lambda s: F.array(s["o_orderkey"].cast("double"), s["o_totalprice"], F.lit(0.5), F.lit(1.0)))


_RECORDS = "WITH r AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS prices, list(o_orderkey ORDER BY o_orderkey) AS keys, list(o_orderstatus ORDER BY o_orderkey) AS states FROM orders GROUP BY 1)"


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '/data/aligned/images/a/' WHEN p_size % 3 = 1 THEN '/data/aligned/images/b/' ELSE 'C:/other/' END || p_partkey || '.png' AS path FROM part")
def remapped_paths(spark, d):
    k = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("D:\\x\\record_output\\images\\a\\"), k, F.lit(".png"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("/y/record_output/images/b/"), k, F.lit(".png"))).otherwise(F.concat(F.lit("C:/other/"), k, F.lit(".png")))
    return table(spark, d, "part").select("p_partkey", tables.remapped_path(raw, "record_output/images/", "/data/aligned/images").alias("path"))


@query(_RECORDS + """ SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'inline' WHEN c_custkey % 7 = 0 THEN 'unresolved_path' WHEN prices IS NULL OR c_custkey % 11 >= len(prices) THEN 'missing_record' ELSE 'aligned_record' END AS source,
    CASE WHEN c_custkey % 5 = 0 THEN c_acctbal WHEN c_custkey % 7 = 0 THEN NULL ELSE prices[c_custkey % 11 + 1] END AS y FROM customer LEFT JOIN r ON c_custkey = o_custkey""")
def training_poses(spark, d):
    key = F.col("c_custkey")
    own = F.when(key % 5 == 0, F.array(F.lit(1.0), F.col("c_acctbal"), F.lit(2.0))).when(key % 3 == 0, F.array(F.lit(1.0), F.lit(float("nan")), F.lit(2.0)))
    c = table(spark, d, "customer").select("c_custkey", F.when((key % 7 != 0) | (key % 5 == 0), key).alias("o_custkey"), (key % 11).cast("int").alias("frame"), own.alias("own"))
    out = tables.training_pose(c, _records(spark, d).select("o_custkey", _poses().alias("list")), ["o_custkey"], "frame", "own", "list")
    return out.select("c_custkey", F.col("pose_source").alias("source"), F.element_at("pose", 2).alias("y"))


@query(_RECORDS + " SELECT o_custkey, CAST(k AS INT) AS frame_idx, keys[k + 1] AS image, prices[k + 1] AS price, CASE WHEN k < len(keys) - 1 THEN states[k + 1] ELSE '' END AS action, CAST(keys[k + 1] AS DOUBLE) AS x FROM r, range(1000) t(k) WHERE k < len(keys)")
def source_frames(spark, d):
    rec = _records(spark, d).select("o_custkey", F.transform("o", lambda s: s["o_orderkey"]).alias("images"), _poses().alias("poses"), F.slice(F.transform("o", lambda s: s["o_orderstatus"]), 1, F.size("o") - 1).alias("actions"))
    frames = tables.source_frames(rec, ["o_custkey"], "images", "poses", "actions")
    out = tables.pose_at(frames.drop("pose"), rec.select("o_custkey", F.col("poses").alias("list")), ["o_custkey"], "frame_idx", "list")
    return out.select("o_custkey", "frame_idx", "image", F.element_at("pose", 2).alias("price"), "action", F.element_at("pose", 1).alias("x"))


@query(_RECORDS + " SELECT o_custkey, CAST(k AS INT) AS step, CAST(keys[k + 1] AS DOUBLE) AS x, round(degrees(1.0), 6) AS yaw, prices[k + 1] / 10000 AS distance, prices[k + 1] / 10000 <= 20 AS inside FROM r, range(1000) t(k) WHERE k < len(keys)")
def step_tables(spark, d):
    steps = F.transform("o", lambda s: F.struct(F.array(s["o_orderkey"].cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("pose_after"), (s["o_totalprice"] / 10_000).alias("distance_after")))
    return tables.step_table(_records(spark, d).select("o_custkey", steps.alias("steps")), ["o_custkey"], "steps").select("o_custkey", "step", "x", r(F.col("yaw")).alias("yaw"), "distance", "inside")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN printf('%.6f', o_totalprice / 8) ELSE '' END AS quality, CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 'thin|small' ELSE '' END ELSE '' END AS reasons FROM orders""")
def case_frames(spark, d):
    o = table(spark, d, "orders")
    reasons = F.when(F.col("o_orderkey") % 6 == 0, F.array(F.lit("thin"), F.lit("small"))).otherwise(F.array().cast("array<string>"))
    assessed = o.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") / 8).alias("quality"), reasons.alias("reasons"))
    return tables.case_frames(o.select("o_orderkey"), o.filter("o_orderkey % 2 = 0"), assessed, ["o_orderkey"], ["o_orderstatus"], ["quality"], "reasons")


@query("""SELECT o_orderkey, o_totalprice, o_custkey, o_totalprice > 50000 AND o_custkey % 2 = 0 AS valid, last FROM orders JOIN (SELECT o_custkey % 40 AS path, arg_max(o_totalprice, o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey % 40 = path""")
def mask_lookups(spark, d):
    frame = F.struct(F.col("o_orderkey"), F.col("o_totalprice"), (F.col("o_custkey") % 40).alias("path"))
    audits = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(frame).alias("frames"))
    one = tables.mask_lookup(audits, ["o_custkey"], "frames", "o_orderkey", "o_totalprice")
    each = table(spark, d, "orders").select("o_orderkey", F.array(F.struct((F.col("o_custkey") % 40).alias("path"), F.col("o_totalprice").alias("last"))).alias("frames"))
    by_path = tables.mask_lookup(each, [], "frames", "path", "last", order="o_orderkey")
    box = F.when(F.col("o_custkey") % 2 == 0, F.array(*(F.lit(k) for k in range(4)))).otherwise(F.array(F.lit(1)))
    out = one.withColumn("path", F.col("o_custkey") % 40).join(by_path, "path")
    return out.select("o_orderkey", "o_totalprice", "o_custkey", tables.valid_mask(box, F.col("o_totalprice") - 50_000).alias("valid"), "last")


@query("""SELECT l_orderkey, count(*) FILTER (c > 0) AS canonical, count(*) FILTER (c = 0 AND dom >= 96 AND side >= 6 AND dom / greatest(1, ch) >= 0.5 AND base = 0) AS fallback FROM
    (SELECT l_orderkey, CASE WHEN l_linenumber % 3 = 0 THEN 5 ELSE 0 END AS c, l_quantity * 10 AS dom, l_quantity AS side, l_quantity * 10 + l_tax * 5000 AS ch, l_suppkey % 2 AS base FROM lineitem) GROUP BY 1""")
def mask_sources(spark, d):
    q = F.col("l_quantity")
    source = tables.mask_source(F.when(F.col("l_linenumber") % 3 == 0, 5).otherwise(0), q * 10, q, q * 10 + F.col("l_tax") * 5_000, F.col("l_suppkey") % 2, F.lit("small"), Policy())
    g = table(spark, d, "lineitem").select("l_orderkey", source.alias("s")).groupBy("l_orderkey")
    return g.agg(F.count_if(F.col("s") == "canonical_id").alias("canonical"), F.count_if(F.col("s") == "dominant_changed_color_fallback").alias("fallback"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'")
def target_rows(spark, d):
    o = table(spark, d, "orders")
    c = tables.quarantined(table(spark, d, "customer"), F.col("c_nationkey") == 3, F.col("c_mktsegment") == "BUILDING").withColumnRenamed("c_custkey", "o_custkey")
    targets = c.join(o, "o_custkey", "left_semi")
    return tables.restricted(o, targets, ["o_custkey"]).select("o_orderkey")


@query("""SELECT o_custkey, frame, line, label FROM (SELECT o_custkey, o_orderkey % 4 AS frame, o_orderkey AS line, CASE o_orderstatus WHEN 'F' THEN 'forward 3m' WHEN 'O' THEN 'stop' END AS label, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 4 ORDER BY o_orderkey DESC) AS turn FROM orders WHERE o_custkey % 3 = 0 AND o_orderstatus IN ('F', 'O')) WHERE turn = 1""")
def training_rows(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 4).alias("frame"), F.col("o_orderkey").alias("line"), "o_orderstatus")
    return tables.training_rows(o, o.filter("o_custkey % 3 = 0"), "o_custkey", "frame", "line", "o_orderstatus", {"F": "forward 3m", "O": "stop"}).select("o_custkey", "frame", "line", "label")


@query("""SELECT scene, episode, max(c_custkey) AS c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'Neighborhood' ELSE 'Town' END AS scene, c_custkey % 30 AS episode FROM customer) GROUP BY 1, 2""")
def scene_metadata(spark, d):
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select("c_custkey", (k % 30).alias("episode"), F.when(k % 4 == 0, "NeighborhoodTrain_TrainSets").when(k % 4 == 2, "Town_train").otherwise("").alias("scene_key"), F.when(k % 4 == 1, "ModularNeighborhood").otherwise("Town").alias("map_name"))
    return tables.metadata(rows, "scene_key", "map_name", "episode", "c_custkey").select("scene", "episode", "c_custkey")


@query("""SELECT p_size % 10 AS key, max(p_partkey) AS p_partkey FROM part WHERE p_size % 5 < 2 AND (p_partkey % 3 <> 0 OR p_partkey % 2 = 0) GROUP BY 1""")
def small_selections(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select("p_partkey", (size % 10).alias("key"), F.when(size % 5 == 0, " Small(1)").when(size % 5 == 1, "very small").otherwise("big").alias("size"), F.when(k % 3 == 0, "Neighborhood").otherwise("Town").alias("scene"), F.when(k % 2 == 0, "/a/neighborhood_coordinate_repair/x").otherwise("/a/x").alias("path"))
    return tables.small_selections(rows, "key", "size", "scene", "path", "p_partkey", "Neighborhood", "neighborhood_coordinate_repair").select("key", "p_partkey")


@query(_RECORDS + " SELECT 'queue' AS part, count(*) AS n, CAST(sum(len(keys) - 1) AS BIGINT) AS steps FROM r WHERE states[-1] = 'F' UNION ALL SELECT 'failed', count(*), 0 FROM r WHERE states[-1] <> 'F' AND o_custkey % 2 = 0 AND o_custkey % 5 < 2")
def stop_queues(spark, d):
    e = _records(spark, d).select("o_custkey", F.transform("o", lambda s: F.when(s["o_orderstatus"] == "F", "stop").otherwise("forward 3m")).alias("steps"))
    last = F.element_at("steps", -1)
    e = e.withColumns({"termination": F.when(last == "stop", "stop").otherwise("step_limit"), "acc": (last == "stop").cast("int"), "scene": F.concat(F.lit("s"), (F.col("o_custkey") % 5).cast("string"))})
    queue = tables.stop_queue(e, "steps", "termination").agg(F.lit("queue").alias("part"), F.count("*").alias("n"), F.sum("stop_step").alias("steps"))
    failed = tables.failed_episodes(e, "acc", "scene", ["s0", "s1"]).withColumn("image", F.when(F.col("o_custkey") % 2 == 0, "x").otherwise(""))
    return queue.unionByName(tables.candidate_steps(failed, ["image", "steps"]).agg(F.lit("failed").alias("part"), F.count("*").alias("n"), F.lit(0).cast("long").alias("steps")))


@query("SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status, o_orderpriority, count(*) AS n, count(*) FILTER (o_orderkey % 10 = 0) AS overridden FROM orders GROUP BY 1, 2")
def captures_by_outcome(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    return tables.captures_by(o, o.filter("o_orderkey % 10 = 0").select("o_orderkey", F.lit("X").alias("status")), "o_orderkey", ["status"], ["status", "o_orderpriority"])


@query("""SELECT o_orderpriority, count(*) AS n, min(x) AS least, round(quantile_cont(x, 0.5), 6) AS median, max(x) AS most, count(*) FILTER (x <= 0.1) AS within_01, count(*) FILTER (x <= 1.0) AS within_1, count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END) AS visible, count(DISTINCT CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END) AS clear FROM (SELECT *, o_totalprice / 100000 AS x FROM orders) GROUP BY 1""")
def residual_summaries(spark, d):
    o = table(spark, d, "orders").withColumns({"x": F.col("o_totalprice") / 100_000, "v": F.col("o_orderkey") % 2 == 0, "c": F.col("o_orderkey") % 4 == 0})
    return tables.residuals(o, ["o_orderpriority"], "x", "o_custkey", "v", "c").withColumn("median", r(F.col("median")))


@query("""SELECT o_custkey, count(*) = count(*) FILTER (o_orderkey % 10 > 0) AS complete, max(o_orderdate) AS active_at, coalesce(nullif(arg_max(CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END, o_orderkey) FILTER (o_orderkey % 3 = 0), ''), 'unknown') AS cause FROM orders GROUP BY 1""")
def lane_states(spark, d):
    o = table(spark, d, "orders")
    done = tables.complete(o, o.filter("o_orderkey % 10 > 0"), ["o_custkey"]).join(tables.last_activity(o, "o_custkey", "o_orderdate"), "o_custkey")
    audit = o.filter("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus")).alias("cause"))
    out = tables.causes(done, audit, "o_custkey", "cause", "o_orderkey")
    return tables.compact(out, {"o_custkey": "o_custkey", "complete": "complete", "active_at": "active_at", "cause": "problem_cause"})


@query("""SELECT count(*) AS poses FROM (SELECT DISTINCT embedding[1] > 0, embedding[2] > 0, embedding[3] > 0, embedding[4] > 0.1 FROM embeddings)""")
def pose_keys(spark, d):
    pose = F.array(*((F.element_at("embedding", k) > F.lit(0.1 if k == 4 else 0.0).cast("float")).cast("double") for k in (1, 2, 3, 4)))
    return tables.distinct_poses(table(spark, d, "embeddings").select(pose.alias("p")), "p").agg(F.count("*").alias("poses"))


@query("""SELECT l_orderkey, l_linenumber, CAST(l_linenumber % 3 AS INT) AS none_, CASE WHEN l_linenumber % 3 = 1 AND l_quantity <= 10 THEN CASE WHEN l_tax >= l_discount THEN 2 ELSE 3 END ELSE l_linenumber % 3 END AS depth_, CASE WHEN l_linenumber % 3 = 1 AND l_suppkey % 2 = 0 THEN 3 WHEN l_linenumber % 3 = 1 AND l_quantity <= 10 THEN CASE WHEN l_tax >= l_discount THEN 2 ELSE 3 END ELSE l_linenumber % 3 END AS bounds_ FROM lineitem""")
def redirects(spark, d):
    a, q, left, right = F.col("l_linenumber") % 3, F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    given = {"near": 10.0}
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", tables.redirects("none")(a, q, left, right)["action_id"].alias("none_"), tables.redirects("depth", **given)(a, q, left, right)["action_id"].alias("depth_"),
        tables.redirects("bounds_depth", **given)(a, q, left, right, F.col("l_suppkey") % 2 == 0, F.lit(3))["action_id"].alias("bounds_"),
    )


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, o_orderkey AS cheap FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, o_orderkey AS early FROM orders),
    c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, c_custkey FROM customer) SELECT place, cheap, early, c_custkey FROM a JOIN b USING (place) LEFT JOIN c USING (place)""")
def zipped_rows(spark, d):
    o = table(spark, d, "orders")
    both = joins.zipped(o.select("o_totalprice", "o_orderkey", F.col("o_orderkey").alias("cheap")), o.select("o_orderdate", F.col("o_orderkey").alias("k"), F.col("o_orderkey").alias("early")), ["o_totalprice", "o_orderkey"], ["o_orderdate", "k"])
    return joins.zipped(both.withColumnRenamed("place", "first"), table(spark, d, "customer").select("c_custkey"), ["first"], ["c_custkey"], strict=False).select("place", "cheap", "early", "c_custkey")


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def first_steps(spark, d):
    return tables.first_steps(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id")
