"""Queries over columns: one wide query for the functions of a kind, each column with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import actions, geometry, prompts, rasters, text, visibility
from tessera.operators import aggregates as agg
from tessera.operators import memory, outcomes, rows, sampling
from tessera.operators import sequence as seq
from tessera.plans.base import query, r, table

_DESCRIBED = "'  the  ' || p_name || '   near ' || p_type || ' .,!'"


@query(rf"""SELECT p_partkey, regexp_replace(trim(regexp_replace({_DESCRIBED}, '\s+', ' ', 'g')), '[ .,;:!?]+$', '') AS description,
    CASE WHEN length(p_name || p_type || p_brand) <= 30 THEN p_name || p_type || p_brand ELSE (p_name || p_type || p_brand)[1:19] || '_' || sha1(p_name || p_type || p_brand)[1:10] END AS stem,
    regexp_replace(regexp_replace(lower(p_brand || '-C' || p_size), '[^a-z0-9]', '', 'g'), 'c\d+$', '') AS actor,
    coalesce(TRY_CAST(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE CAST(p_size AS VARCHAR) END AS INT), -1) AS number, sha1('7:' || p_partkey || ':' || p_brand) AS turn,
    CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS key, p_size % 4 = 0 OR p_size % 5 = 0 AS failed, CASE WHEN p_size % 4 = 0 THEN 'it failed' END IS NOT NULL OR p_size % 6 = 1 AS any_error,
    regexp_replace(lower(trim(p_name)), '[ .]+$', '') AS asked, p_brand || ' tail' AS rewritten, CASE WHEN p_size > 25 THEN p_size END AS frame
    FROM part""")
def text_columns(spark, d):
    described = F.concat(F.lit("  the  "), F.col("p_name"), F.lit("   near "), F.col("p_type"), F.lit(" .,!"))
    size = F.col("p_size")
    error = F.when(size % 4 == 0, "it failed")
    mixed = F.when(size % 3 == 0, F.col("p_brand")).otherwise(size.cast("string"))
    frames = F.array(size.cast("long"), F.lit(99).cast("long"))
    answer = F.when(size > 25, F.concat(F.lit('{"choice": "F'), size.cast("string"), F.lit('"}'))).otherwise("none of them: NONE")
    return table(spark, d, "part").select(
        "p_partkey",
        text.normalize_description(described).alias("description"),
        text.bounded_stem(F.concat("p_name", "p_type", "p_brand"), 30).alias("stem"),
        text.actor_name(F.concat(F.col("p_brand"), F.lit("-C"), size.cast("string"))).alias("actor"),
        text.lenient(mixed, "int", -1).alias("number"),
        text.order_key(7, "p_partkey", "p_brand").alias("turn"),
        rows.stored_or_built(F.when(size % 2 == 0, F.col("p_brand")).otherwise(""), F.col("p_type")).alias("key"),
        rows.any_of(size % 4 == 0, size % 5 == 0).alias("failed"),
        rows.is_error(error, F.lit(None).cast("boolean"), F.when(size % 6 == 1, "error").otherwise("ok")).alias("any_error"),
        prompts.extract_description(prompts.build_prompt("p_name")).alias("asked"),
        outcomes.replace_suffix(F.concat(F.col("p_brand"), F.lit(" [policy] old")), " [policy]", " tail").alias("rewritten"),
        outcomes.chosen_frame(answer, frames).cast("int").alias("frame"),
    )


_ACTION = "((l_orderkey * 7 + l_linenumber) % 6)"


@query(f"""SELECT l_orderkey, l_linenumber, ['stop', 'forward 3m', 'turn left 30 degree', 'turn right 30 degree', 'ascend 3m', 'descend 3m'][{_ACTION} + 1] AS command, CAST({_ACTION} AS INT) AS id,
    CASE WHEN l_linenumber % 2 = 0 THEN ['Stop', 'Move Forward', 'Turn Left', 'Turn Right', 'Ascend', 'Descend'][{_ACTION} + 1] END AS name, l_linenumber <> 3 AS known,
    round(abs(((l_quantity * 11 - 30 + 180) % 360 + 360) % 360 - 180), 6) AS error, round(((l_quantity * 13 - l_linenumber * 50 + 180) % 360 + 360) % 360 - 180, 6) AS apart FROM lineitem""")
def action_columns(spark, d):
    place = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 6
    name = F.element_at(F.array(*map(F.lit, actions.ACTIONS)), (place + 1).cast("int"))
    value = F.element_at(F.array(*(F.lit(v) for _, _, v in actions.ACTIONS.values())), (place + 1).cast("int"))
    off = F.when(F.col("l_linenumber") % 2 == 0, 0.0).otherwise(0.5)
    vector = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when(k == place, value + off).otherwise(0.0))
    odd = F.when(F.col("l_linenumber") == 3, "Hover").otherwise(name)
    command = actions.name_to_command(name)
    turn = geometry.angle_difference(F.col("l_quantity") * 13, F.col("l_linenumber") * 50)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", command.alias("command"), actions.command_id(command).cast("int").alias("id"), actions.vector_to_name(vector).alias("name"), actions.name_to_command(odd, strict=False).isNotNull().alias("known"),
        r(prompts.heading_error(F.col("l_quantity") * 11, F.lit(30.0))).alias("error"), r(turn).alias("apart"),
    )


_E = [f"CAST(embedding[{k}] AS DOUBLE) * 100" for k in range(1, 65)]


def _sql_gap(p: list[str], q: list[str]) -> str:
    return "sqrt(" + " + ".join(f"({a} - {b}) * ({a} - {b})" for a, b in zip(p, q)) + ")"


_NEAR, _FAR = _sql_gap(_E[:3], _E[3:6]), _sql_gap(_E[:3], _E[6:9])
_NEAR2, _FAR2 = _sql_gap(_E[:2], _E[3:5]), _sql_gap(_E[:2], _E[6:8])


def _sql_ahead(t: list[str]) -> str:
    return f"abs(((degrees(atan2({t[1]} - {_E[1]}, {t[0]} - {_E[0]})) - {_E[9]} * 5 + 180) % 360 + 360) % 360 - 180) <= 55"


@query(f"""SELECT vec_id, round(least({_NEAR}, {_FAR}), 6) AS nearest, round(CASE WHEN {_NEAR} <= {_FAR} THEN {_NEAR2} ELSE {_FAR2} END, 6) AS nearest_flat,
    {_sql_ahead(_E[3:6])} OR {_sql_ahead(_E[6:9])} AS seen, embedding[1] > 0 AS finite, CAST(floor({_E[0]} / 5) AS BIGINT) AS cell_x, CAST(floor({_E[1]} / 5) AS BIGINT) AS cell_y,
    abs({_E[0]}) > 10 OR abs({_E[1]} - 1) > 10 AS outside,
    CASE WHEN -({_E[0]} * cos({_E[2]} + radians(30)) + {_E[1]} * sin({_E[2]} + radians(30))) >= -({_E[0]} * cos({_E[2]} - radians(30)) + {_E[1]} * sin({_E[2]} - radians(30))) THEN 2 ELSE 3 END AS turn
    FROM embeddings""")
def geometry_columns(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100).alias("e"))
    x, y, z, yaw = (F.element_at("e", k) for k in (1, 2, 3, 10))
    position, targets = F.slice("e", 1, 3), F.array(F.slice("e", 4, 3), F.slice("e", 7, 3))
    nearest = geometry.nearest_target(position, targets)
    holey = F.when(x > 0, position).otherwise(F.array(x, F.lit(float("nan")), z))
    cells = geometry.cell([x, y])
    return e.select(
        "vec_id",
        r(geometry.nearest_distance(position, targets)).alias("nearest"),
        r(nearest["error_xy"]).alias("nearest_flat"),
        geometry.in_view(position, yaw * 5, targets, 90.0, 10.0).alias("seen"),
        geometry.finite_xyz(holey).alias("finite"),
        cells[0].alias("cell_x"),
        cells[1].alias("cell_y"),
        outcomes.out_of_bounds(x, y, F.lit(0.0), F.lit(1.0), 10.0).alias("outside"),
        outcomes.turn_to_start(x, y, z, F.lit(0.0), F.lit(0.0)).alias("turn"),
    )


@query("""WITH b AS (SELECT p_partkey, p_size AS x0, p_size + 3 AS y0, p_size * 2 + 5 AS x1, p_size + 30 AS y1, 120 AS w, 90 AS h FROM part)
    SELECT p_partkey, round(sqrt(pow((x0 + x1) / 2.0 / w - 0.5, 2) + pow((y0 + y1) / 2.0 / h - 0.5, 2)), 6) AS by_share, round(sqrt(pow(((x0 + x1) / 2.0 - 59.5) / 59.5, 2) + pow(((y0 + y1) / 2.0 - 44.5) / 44.5, 2)) / sqrt(2), 6) AS by_pixel,
    round((x0 + x1 + 1) / 240.0 - 0.5, 6) AS dx, round((y0 + y1 + 1) / 180.0 - 0.5, 6) AS dy, abs((x0 + x1 + 1) / 240.0 - 0.5) <= 0.25 AND abs((y0 + y1 + 1) / 180.0 - 0.5) <= 0.25 AS centered, x1 >= 119 OR y1 >= 89 AS border,
    CAST(round_even(x0 * 1.5, 0) AS BIGINT) AS left_, CAST(round_even(y1 * 0.5, 0) AS BIGINT) AS bottom, CAST(greatest(0, x0 - greatest(4, greatest(x1 - x0 + 1, y1 - y0 + 1) * 0.25)) AS DOUBLE) AS pad_x0, CAST(least(90, y1 + 1 + greatest(4, greatest(x1 - x0 + 1, y1 - y0 + 1) * 0.25)) AS DOUBLE) AS pad_y1,
    CASE WHEN p_partkey % 9 = 0 THEN 'absent' WHEN abs((x0 + x1 + 1) / 240.0 - 0.5) <= 0.15 THEN 'center' WHEN abs((x0 + x1 + 1) / 240.0 - 0.5) <= 0.35 THEN 'middle' ELSE 'edge' END AS bin FROM b""")
def box_columns(spark, d):
    size = F.col("p_size")
    x0, y0, x1, y1 = size, size + 3, size * 2 + 5, size + 30
    w, h = F.lit(120), F.lit(90)
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    box, scaled = geometry.center_offset_box(x0, y0, x1, y1, w, h), geometry.scale_box(F.array(x0, y0, x1, y1), F.lit(1.5), F.lit(0.5))
    padded = geometry.padded_box(F.array(x0, y0, x1, y1), w, h, 0.25, 4.0)
    return table(spark, d, "part").select(
        "p_partkey",
        r(geometry.center_offset(cx, cy, w, h)).alias("by_share"),
        r(geometry.center_offset_pixels(cx, cy, w, h)).alias("by_pixel"),
        r(box["dx"]).alias("dx"),
        r(box["dy"]).alias("dy"),
        box["centered"].alias("centered"),
        box["border"].alias("border"),
        F.element_at(scaled, 1).alias("left_"),
        F.element_at(scaled, 4).alias("bottom"),
        r(F.element_at(padded, 1)).alias("pad_x0"),
        r(F.element_at(padded, 4)).alias("pad_y1"),
        visibility.center_bin(F.when(F.col("p_partkey") % 9 != 0, F.abs(box["dx"]))).alias("bin"),
    )


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS sides, l_discount * 5 AS contact, l_quantity / 60 AS fraction, l_tax > 0.07 AS opposite, l_quantity * 10 AS px, l_discount * 4 AS score, CAST(l_quantity AS INT) % 13 AS rank FROM lineitem)
    SELECT l_orderkey, l_linenumber, sides > 2 OR contact > 0.25 OR fraction > 0.75 OR opposite AS severe,
    round((least(1, greatest(0, (score - 0.18) / (0.32 - 0.18))) + CASE WHEN rank <= 1 THEN 1 WHEN rank <= 3 THEN 0.85 WHEN rank <= 5 THEN 0.7 WHEN rank <= 10 THEN 0.45 ELSE 0.2 END) / 2, 6) AS semantics,
    CASE WHEN px <= 20 THEN 'absent' WHEN sides > 2 OR contact > 0.25 OR fraction > 0.75 OR opposite OR 1 - 0.15 * sides < 0.7 THEN 'clipped' ELSE 'complete' END AS whole,
    CASE WHEN px <= 20 THEN 'absent' WHEN opposite OR sides >= 2 THEN 'clipped' ELSE 'complete' END AS whole_by_sides FROM m""")
def visibility_columns(spark, d):
    m = F.struct(
        (F.col("l_linenumber") - 1).alias("clipped_sides_count"), (F.col("l_discount") * 5).alias("edge_contact_fraction"), (F.col("l_quantity") / 60).alias("pixel_fraction"), (F.col("l_tax") > 0.07).alias("touches_opposite_borders"),
        F.greatest(F.lit(0), F.col("l_quantity") * 10 - 20).alias("pixel_count"), F.lit(500).alias("bbox_width"), F.lit(500).alias("bbox_height"),
    )
    x = table(spark, d, "lineitem").withColumn("m", m)
    m, p = F.col("m"), visibility.Policy()
    reasons = visibility.clear_reasons(m, F.lit("small"), F.lit(0), p)
    clipping = 1.0 - 0.15 * m["clipped_sides_count"]
    return x.select(
        "l_orderkey",
        "l_linenumber",
        visibility.severe_clipping(m, p).alias("severe"),
        r(visibility.semantic_quality(F.col("l_discount") * 4, F.col("l_quantity").cast("int") % 13, p)).alias("semantics"),
        visibility.completeness(reasons, clipping, m["pixel_count"]).alias("whole"),
        visibility.completeness_by_sides(m["touches_opposite_borders"], m["clipped_sides_count"], m["pixel_count"] > 0).alias("whole_by_sides"),
    )


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'actor_stop_bank_appended' ELSE CASE WHEN p_size % 7 = 0 THEN 'neighborhood_coordinate_repaired__' ELSE '' END ||
    CASE p_size % 5 WHEN 1 THEN CASE p_size % 3 WHEN 0 THEN 'target_facing_repairable_appended' WHEN 1 THEN 'below_threshold_rescue_appended' ELSE 'standoff_' || regexp_replace(p_brand, '[^A-Za-z0-9_.-]+', '_', 'g') || '_appended' END WHEN 2 THEN 'clear_candidate_stop_unchanged' WHEN 3 THEN 'expert_path_relabelled' ELSE 'other' END END AS category FROM part""")
def stop_categories(spark, d):
    size = F.col("p_size")
    source = F.element_at(F.array(*map(F.lit, ("actor_stop_bank_appended_to_original_episode", "target_facing_standoff_appended_to_original_episode", "expert_path", "expert_path", "drawn"))), size % 5 + 1)
    group = F.when(size % 3 == 0, "repairable").when(size % 3 == 1, "rescue").otherwise(F.col("p_brand"))
    return table(spark, d, "part").select("p_partkey", outcomes.stop_category(source, group, F.when(size % 5 == 2, "Stop").otherwise("Move Forward"), size % 7 == 0).alias("category"))


@query("""WITH g AS (SELECT p_partkey, list_transform([p_size / 1.0, 0.125 * p_size, 100.0, p_size * 1.5, 7.0, 0.5, 1.0, 2.0, 12.25], lambda v: CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(CAST(v AS DOUBLE) AS VARCHAR) END) AS t, p_size FROM part)
    SELECT p_partkey, '[[' || array_to_string(t[1:3], ', ') || '],' || chr(10) || ' [' || array_to_string(t[4:6], ', ') || '],' || chr(10) || ' [' || array_to_string(t[7:9], ', ') || ']]' AS printed,
    p_size % 2 = 0 AS same, false AS same_shape, p_size % 3 = 0 AS far FROM g""")
def grid_columns(spark, d):
    size = F.col("p_size").cast("double")
    row = lambda *c: F.array(*(F.lit(v) if isinstance(v, float) else v for v in c))
    grid = F.array(row(size, size * 0.125, 100.0), row(size * 1.5, 7.0, 0.5), row(1.0, 2.0, 12.25))
    shifted = F.transform(grid, lambda g: F.transform(g, lambda v: v + F.when(F.col("p_size") % 2 == 0, 0.00005).otherwise(0.001)))
    distant = F.when(F.col("p_size") % 3 == 0, prompts.far_grid()).otherwise(grid)
    return table(spark, d, "part").select("p_partkey", prompts.grid_text(grid).alias("printed"), prompts.grids_match(grid, shifted).alias("same"), prompts.grids_match(grid, F.slice(grid, 1, 2)).alias("same_shape"), prompts.grids_match(distant, prompts.far_grid()).alias("far"))


@query("""WITH c AS (SELECT p_partkey, p_size + 4 AS n, CASE WHEN p_size % 3 > 0 THEN p_size // 2 END AS first_, p_size AS closest FROM part),
    w AS (SELECT p_partkey, n, list_concat([0, n - 1, first_, closest, first_ - 1, closest - 1, first_ + 1, closest + 1], list_transform(range(8), lambda k: CAST(round(k * (n - 1) / 7.0) AS INT))) AS wanted FROM c),
    f AS (SELECT p_partkey, n, list_filter(wanted, lambda k: k IS NOT NULL AND k >= 0 AND k <= n - 1) AS wanted FROM w),
    u AS (SELECT p_partkey, list_filter(wanted, lambda v, i: list_position(wanted, v) = i)[1:8] AS kept FROM f)
    SELECT p_partkey, array_to_string(list_sort(kept), ',') AS frames FROM u""")
def keyframe_choices(spark, d):
    size = F.col("p_size")
    frames = rasters.keyframes(size + 4, F.when(size % 3 > 0, F.floor(size / 2).cast("int")), size, 8)
    return table(spark, d, "part").select("p_partkey", F.array_join(frames.cast("array<string>"), ",").alias("frames"))


@query("""WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 10 AS x, CAST(embedding[2] AS DOUBLE) * 10 AS y, CAST(embedding[3] AS DOUBLE) * 10 AS z FROM embeddings),
    p AS (SELECT s.*, radius, height, k * 60.0 AS a FROM s, (VALUES (4.0), (8.0)) r(radius), (VALUES (1.5), (3.0)) h(height), range(6) t(k))
    SELECT vec_id, count(*) AS n, round(sum(x + radius * cos(radians(a))), 4) AS sx, round(sum(y + radius * sin(radians(a))), 4) AS sy, round(sum(z + height), 4) AS sz, CAST(sum((a + 360) % 360 - 180) AS DOUBLE) AS yaw FROM p GROUP BY vec_id""")
def standoff_grids(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 3), lambda v: v.cast("double") * 10).alias("t"))
    poses = e.select("vec_id", F.explode(rasters.standoff_poses("t", [4.0, 8.0], [1.5, 3.0], 6)).alias("p"))
    return poses.groupBy("vec_id").agg(F.count("*").alias("n"), r(F.sum("p.x"), 4).alias("sx"), r(F.sum("p.y"), 4).alias("sy"), r(F.sum("p.z"), 4).alias("sz"), r(F.sum("p.yaw"), 4).alias("yaw"))


@query("""WITH b AS (SELECT vec_id, list_transform(range(32), lambda k: embedding[k + 2] > embedding[k + 1]) AS bits, label FROM embeddings),
    h AS (SELECT vec_id, bits, label FROM b), f AS (SELECT label, arg_min(bits, vec_id) AS first_bits FROM b GROUP BY label)
    SELECT vec_id, list_sum(list_transform(range(1, 33), lambda k: CAST(bits[k] AS INT) * CAST(bits[k] <> first_bits[k] AS INT) + CAST(NOT bits[k] AS INT) * CAST(bits[k] <> first_bits[k] AS INT))) * 2 AS apart FROM h JOIN f USING (label)""")
def hash_distances(spark, d):
    # An 8 x 9 image whose rows 1 to 4 hold 33 components in steps of 8, and rows 5 to 8 the same again.
    image = lambda e: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.slice(e, (y % 4) * 8 + 1, 9))
    e = table(spark, d, "embeddings").select("vec_id", "label", rasters.difference_hash(image(F.col("embedding"))).alias("h"))
    first = e.groupBy("label").agg(F.min_by("h", "vec_id").alias("f"))
    return e.join(F.broadcast(first), "label").select("vec_id", sampling.hamming("h", "f").cast("long").alias("apart"))


@query("""WITH i AS (SELECT vec_id, list_transform(range(36), lambda k: CAST(floor((embedding[k + 1] + 1) * 6) AS INT)) AS a, list_transform(range(36), lambda k: CAST(floor((CASE WHEN embedding[k + 2] > 0.1 THEN embedding[k + 2] ELSE embedding[k + 1] END + 1) * 6) AS INT)) AS b FROM embeddings),
    p AS (SELECT vec_id, k // 6 AS y, k % 6 AS x, a[k + 1] AS a, b[k + 1] AS b FROM i, range(36) t(k)),
    top AS (SELECT vec_id, b AS colour FROM (SELECT vec_id, b, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, b) AS turn FROM p WHERE a <> b GROUP BY vec_id, b) WHERE turn = 1),
    hit AS (SELECT p.vec_id, x, y FROM p JOIN top USING (vec_id) WHERE a <> b AND b = colour),
    near AS (SELECT DISTINCT p.vec_id, p.x, p.y FROM p JOIN hit ON p.vec_id = hit.vec_id AND abs(p.x - hit.x) <= 2 AND abs(p.y - hit.y) <= 2 WHERE a <> b)
    SELECT i.vec_id, colour, coalesce(n, 0) AS pixels FROM i LEFT JOIN top USING (vec_id) LEFT JOIN (SELECT vec_id, count(*) AS n FROM near GROUP BY vec_id) USING (vec_id)""")
def changed_pixels(spark, d):
    shade = lambda v: F.floor((v + F.lit(1).cast("float")) * F.lit(6).cast("float")).cast("int")
    image = lambda pick: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(5)), lambda x: shade(pick(y * 6 + x))))
    at = lambda k: F.get("embedding", k)
    e = table(spark, d, "embeddings").select("vec_id", image(at).alias("a"), image(lambda k: F.when(at(k + 1) > F.lit(0.1).cast("float"), at(k + 1)).otherwise(at(k))).alias("b"))
    e = e.withColumn("colour", rasters.dominant_change("a", "b"))
    mask = rasters.changed_mask("a", "b", F.col("colour"))
    pixels = F.size(F.filter(F.flatten(mask), lambda v: F.coalesce(v, F.lit(False))))
    return e.select("vec_id", "colour", F.coalesce(pixels, F.lit(0)).cast("long").alias("pixels"))


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY TRY_CAST(k AS DOUBLE) IS NULL, TRY_CAST(k AS DOUBLE), k, c_custkey) AS INT) AS place, CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha1('11:' || c_mktsegment || ':' || c_custkey)) AS INT) AS shuffled
    FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'x' || (c_custkey % 17) ELSE CAST(c_custkey % 101 AS VARCHAR) END AS k FROM customer)""")
def episode_orders(spark, d):
    from pyspark.sql import Window

    key = F.col("c_custkey")
    c = table(spark, d, "customer").withColumn("k", F.when(key % 3 == 0, F.concat(F.lit("x"), (key % 17).cast("string"))).otherwise((key % 101).cast("string")))
    w = Window.partitionBy("c_mktsegment")
    return c.select(
        "c_custkey",
        F.row_number().over(w.orderBy(*sampling.numeric_order("k"), "c_custkey")).alias("place"),
        F.row_number().over(w.orderBy(text.order_key(11, "c_mktsegment", "c_custkey"))).alias("shuffled"),
    )


@query("""SELECT event_type, count(x) AS n, round(avg(x), 6) AS mean FROM (SELECT event_type, CASE WHEN event_id % 5 IN (0, 1) THEN NULL ELSE value END AS x FROM events) GROUP BY event_type""")
def means_of_numbers(spark, d):
    odd = F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 5 == 1, "none").otherwise(F.col("value").cast("string"))
    e = table(spark, d, "events").withColumn("x", odd)
    return e.groupBy("event_type").agg(F.count(agg.number("x")).alias("n"), r(F.avg(agg.number("x"))).alias("mean"))


@query("""WITH p AS (SELECT user_id, event_id, ts, value AS x, value * value / 50 AS y, (value * 7) AS yaw FROM events),
    s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS t, abs(((yaw - lag(yaw) OVER w + 180) % 360 + 360) % 360 - 180) AS h FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, round(coalesce(sum(t) OVER r, 0) + 1e-7, 4) AS distance, round(coalesce(avg(h) OVER r, 0) + 1e-7, 4) AS heading FROM s WINDOW r AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def motion_effects(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("x"), (F.col("value") * F.col("value") / 50).alias("y"), F.lit(0.0).alias("z"), (F.col("value") * 7).alias("yaw"))
    out = memory.effects(e, ["user_id"], "event_id")
    return out.select("event_id", r(F.col("distance_traveled") + 1e-7, 4).alias("distance"), r(F.col("mean_heading_change") + 1e-7, 4).alias("heading"))


_SHORT = "CASE event_type WHEN 'view' THEN 'left' WHEN 'click' THEN 'right' WHEN 'purchase' THEN 'forward' WHEN 'signup' THEN 'ascend' ELSE 'other' END"


@query(f"""WITH s AS (SELECT event_id, list({_SHORT}) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING) AS a FROM events),
    t AS (SELECT event_id, a, len(a) AS n, len(list_distinct(a)) AS kinds, len(list_filter(a, lambda v: v NOT IN ('left', 'right'))) = 0 AS turns, len(list_filter(range(1, len(a)), lambda k: a[k] = a[k + 1])) = 0 AS alternating FROM s)
    SELECT event_id, CASE WHEN turns AND kinds = 1 THEN a[1] || '_turn_x' || n WHEN turns AND alternating THEN 'alternating_turns' WHEN turns THEN 'mixed_turns' WHEN kinds = 1 THEN a[1] || '_x' || n ELSE 'mixed_motion' END AS pattern FROM t""")
def action_patterns(spark, d):
    names = F.create_map(*(F.lit(x) for kv in {"view": actions.TURNS[0], "click": actions.TURNS[1], "purchase": "forward 3m", "signup": "ascend 3m"}.items() for x in kv))
    e = table(spark, d, "events").withColumn("action", F.coalesce(F.element_at(names, F.col("event_type")), F.lit("stop")))
    return e.select("event_id", memory.pattern(seq.history("action", ["user_id"], ["event_id"], 5)).alias("pattern"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_suppkey, [CASE WHEN k = l_suppkey % 8 THEN [1.0, 3, 15, 15, 2, 2, 5, 5][k + 1] * CASE WHEN l_linenumber = 3 THEN 2 WHEN l_linenumber = 4 THEN 3 ELSE 1 END ELSE 0 END FOR k IN range(CASE WHEN l_linenumber = 5 THEN 7 ELSE 8 END)] AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN len(v) < 8 THEN 0 WHEN l_linenumber IN (3, 4) THEN CASE WHEN l_suppkey % 8 = 1 THEN l_linenumber + 5 ELSE 0 END ELSE CAST(l_suppkey % 8 AS INT) END AS id FROM v""")
def legacy_actions(spark, d):
    value = F.element_at(F.array(*(F.lit(float(v)) for _, v in actions.LEGACY[:8])), (F.col("l_suppkey") % 8 + 1).cast("int"))
    times = F.when(F.col("l_linenumber") == 3, 2).when(F.col("l_linenumber") == 4, 3).otherwise(1)
    vector = F.transform(F.sequence(F.lit(0), F.when(F.col("l_linenumber") == 5, 6).otherwise(7)), lambda k: F.when(k == F.col("l_suppkey") % 8, value * times).otherwise(0.0))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", actions.legacy_id(vector).alias("id"))
