"""Queries over JSON of several shapes, made from the properties of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import variants
from tessera.plans.base import query, r, table

#: A pose as text: nested, flat with a heading, an object, no position, and broken; k is the event's property.
_POSE = """CASE event_id % 7 WHEN 0 THEN '[[' || k || ', ' || u || ', 1.5], [' || u || ', ' || k || ', 2, 90]]' WHEN 1 THEN '[' || k || ', ' || u || ', -3.25, 180]' WHEN 2 THEN '{"position": [' || k || ', 0, ' || u || '], "yaw": 30}'
    WHEN 3 THEN '"' || k || '"' WHEN 4 THEN '[' || k || ', ' WHEN 5 THEN '[[' || k || ', 2], [' || k || ', "x", 1], [1, 2, ' || k || '], ' || u || ']' END"""


def _events(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("u"), "value", F.try_variant_get(variants.parsed("props"), "$.k", "int").alias("k"))
    return e.withColumn("u", F.col("u").cast("int"))


_SQL = """WITH e AS (SELECT event_id, CAST(user_id AS INT) AS u, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events)"""


@query(f"""{_SQL}, t AS (SELECT event_id, {_POSE} AS text FROM e), j AS (SELECT event_id, text, CASE WHEN json_valid(text) THEN CAST(text AS JSON) END AS v FROM t),
    a AS (SELECT event_id, v, CASE WHEN json_type(v) = 'OBJECT' THEN json_extract(v, '$.position') ELSE v END AS place FROM j),
    l AS (SELECT event_id, v, CASE WHEN json_type(place) <> 'ARRAY' THEN CAST([] AS JSON[]) WHEN json_type(place, '$[0]') <> 'ARRAY' THEN [place] ELSE CAST(place AS JSON[]) END AS lists FROM a),
    p AS (SELECT event_id, v, [[CAST(json_extract(x, '$[' || i || ']') AS DOUBLE) FOR i IN [0, 1, 2]] FOR x IN lists IF json_type(x) = 'ARRAY' AND json_array_length(x) >= 3 AND json_type(x, '$[0]') <> 'VARCHAR' AND json_type(x, '$[1]') <> 'VARCHAR' AND json_type(x, '$[2]') <> 'VARCHAR'] AS place FROM l)
    SELECT event_id, CASE json_type(v) WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'VARCHAR' THEN 'text' END AS shape, CAST(coalesce(len(place), 0) AS INT) AS n, place[1][1] AS x, place[1][2] AS y, place[len(place)][3] AS last_z FROM p""")
def polymorphic_poses(spark, d):
    v = _events(spark, d).select("event_id", variants.parsed(F.expr(_POSE)).alias("v"))
    p = v.select("event_id", variants.shape("v").alias("shape"), variants.positions("v").alias("at"))
    at = lambda i, k: F.get(F.get("at", i), F.lit(k))
    return p.select("event_id", "shape", F.size("at").alias("n"), at(F.lit(0), 0).alias("x"), at(F.lit(0), 1).alias("y"), at(F.size("at") - 1, 2).alias("last_z"))


#: The scores of a step as text: the second label has no mean, the third is there for even numbers alone.
_SCORES = """'{"step": ' || event_id || ', "candidate_scores": {"stop": {"sum_logprob": ' || (-k) || ', "mean_logprob": ' || (-k / 4.0) || ', "token_count": 4}, "forward 3m": {"sum_logprob": ' || (-u % 50) || ', "token_count": 5}'
    || CASE WHEN event_id % 2 = 0 THEN ', "ascend 3m": {"mean_logprob": -5.5}' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ', "hover": {"token_count": 0}' ELSE '' END || '}}'"""
_LABELS = "'stop', 'forward 3m', 'ascend 3m'"


@query(f"""{_SQL}, s AS (SELECT event_id, CAST({_SCORES} AS JSON) AS v FROM e), m AS (SELECT event_id, label, coalesce(CAST(json_extract(v, '$.candidate_scores."' || label || '".mean_logprob') AS DOUBLE), CAST(json_extract(v, '$.candidate_scores."' || label || '".sum_logprob') AS DOUBLE) / CAST(json_extract(v, '$.candidate_scores."' || label || '".token_count') AS DOUBLE)) AS mean FROM s, (SELECT unnest([{_LABELS}]) AS label)),
    k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY mean DESC, label) AS place FROM m WHERE mean IS NOT NULL)
    SELECT event_id, count(*) AS labels, arg_min(label, place) AS best, CAST(min(place) FILTER (label = 'stop') AS INT) AS stop_place, round(max(mean) FILTER (label = 'stop') - max(mean) FILTER (label = 'forward 3m'), 6) AS ahead,
    round(max(mean) FILTER (label = 'stop') + 1, 6) AS gap_stop, coalesce(count(*) FILTER (label = 'ascend 3m'), 0) = 0 AS ascend_missing FROM k GROUP BY event_id""")
def candidate_scores(spark, d):
    s = _events(spark, d).select("event_id", variants.candidate_scores(variants.parsed(F.expr(_SCORES))).alias("s"))
    m = s.select("event_id", variants.means("s").alias("m"))
    fixed = F.map_from_entries(F.array(F.struct(F.lit("stop"), F.lit(-1.0)), F.struct(F.lit("ascend 3m"), F.lit(-5.5))))
    gaps = variants.score_gaps("m", fixed)
    of = lambda label, from_: F.try_element_at(from_, F.lit(label))
    return m.select(
        "event_id", F.size("m").cast("long").alias("labels"), F.get(variants.ranked("m"), F.lit(0)).alias("best"), of("stop", variants.ranks("m")).alias("stop_place"),
        r(of("stop", F.col("m")) - of("forward 3m", F.col("m"))).alias("ahead"), r(of("stop", gaps)).alias("gap_stop"), of("ascend 3m", gaps).isNull().alias("ascend_missing"),
    )


#: Properties of which each kind of event has its own; ``mixed`` is a number or a text.
_PROPS = """CASE event_id % 4 WHEN 0 THEN '{"k": ' || k || ', "mixed": ' || u || '}' WHEN 1 THEN '{"k": ' || k || '.5, "note it": "n' || u || '"}' WHEN 2 THEN '{"tags": ["t' || k || '", "z"], "mixed": "m", "o": {"deep": ' || u || '}}' ELSE '[' || k || ']' END"""


@query(f"""{_SQL}, j AS (SELECT event_id, CAST({_PROPS} AS JSON) AS v FROM e)
    SELECT event_id, CAST(json_extract(v, '$.k') AS DOUBLE) AS k, json_extract_string(v, '$."note it"') AS note, json_extract_string(v, '$.tags[0]') AS tag, CAST(json_extract(v, '$.o.deep') AS BIGINT) AS deep, CAST(json_extract(v, '$.mixed') AS VARCHAR) AS mixed, 'k,mixed,note it,o,tags' AS fields FROM j""")
def shredded_props(spark, d):
    v = _events(spark, d).select("event_id", variants.parsed(F.expr(_PROPS)).alias("v"))
    out = variants.shredded(v, "v", prefix="f_")
    names = sorted(c[2:] for c in out.columns if c.startswith("f_"))
    return out.select("event_id", F.col("f_k").cast("double").alias("k"), F.col("f_note it").alias("note"), F.get("f_tags", F.lit(0)).alias("tag"), F.col("f_o.deep").cast("long").alias("deep"), F.to_json("f_mixed").alias("mixed"), F.lit(",".join(names)).alias("fields"))
