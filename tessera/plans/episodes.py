"""Queries over ordered events: a user is an episode, its events in (ts, event_id) order the steps, the type the action."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.actions import derive_action, normalize_command, parse_action, pose_after
from tessera.functions.geometry import wrap_degrees
from tessera.operators import sequence as seq
from tessera.operators.joins import as_of, interval
from tessera.operators.memory import transitions
from tessera.operators.rows import dedupe, require
from tessera.operators.sampling import first_n
from tessera.plans.base import micros, query, r, table

KEY, ORDER = ["user_id"], ["ts", "event_id"]
_RUNS = """
    SELECT user_id, ts, event_id, event_type, event_type IN ('view', 'click') AS turn,
           lag(event_type) OVER w AS before, coalesce(lag(event_type) OVER w IN ('view', 'click'), false) AS was,
           row_number() OVER w AS n
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def _runs(kind: str, test: str) -> str:
    return f"""{kind} AS (SELECT user_id, coalesce(max(CASE WHEN turn THEN len END), 0) AS best FROM (
        SELECT user_id, turn, n - max(CASE WHEN NOT coalesce({test}, false) THEN n END) OVER (PARTITION BY user_id ORDER BY n) + 1 AS len FROM base) GROUP BY user_id)"""


_LONGEST = f"""WITH base AS ({_RUNS}), {_runs("a", "turn AND was AND event_type = before")}, {_runs("b", "turn AND was AND event_type <> before")}, {_runs("c", "turn AND was")}
    SELECT a.user_id, CAST(a.best AS BIGINT) AS longest_same, CAST(b.best AS BIGINT) AS longest_alternating, CAST(c.best AS BIGINT) AS longest_turn_only
    FROM a JOIN b USING (user_id) JOIN c USING (user_id)"""


@query(_LONGEST)
def longest_runs(spark, d):
    return seq.longest_runs(table(spark, d, "events"), KEY, ORDER, "event_type", ["view", "click"])


@query(f"""WITH runs AS ({_LONGEST}), p AS (
    SELECT user_id, count(*) AS steps, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total
    FROM events GROUP BY user_id)
    SELECT p.user_id, p.steps, p.errors, p.total, longest_same, longest_alternating, longest_turn_only FROM p JOIN runs USING (user_id)""")
def episode_summary(spark, d):
    e = table(spark, d, "events")
    runs = seq.longest_runs(e, KEY, ORDER, "event_type", ["view", "click"])
    sums = e.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "error").alias("errors"), r(F.sum("value"), 4).alias("total"))
    return sums.join(runs, "user_id")


@query("""SELECT user_id, round(coalesce(sum(step), 0.0), 4) AS path_length, round(abs(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id))), 4) AS net_displacement, count(*) AS steps
    FROM (SELECT *, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS step FROM events) GROUP BY user_id""")
def path_metrics(spark, d):
    out = seq.path_metrics(table(spark, d, "events"), KEY, ORDER, ["value"])
    return out.select("user_id", r(F.col("path_length"), 4).alias("path_length"), r(F.col("net_displacement"), 4).alias("net_displacement"), "steps")


@query("""WITH s AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 2 AS step FROM events)
    SELECT user_id, min(value) AS minimum_distance, arg_min(step, (value, step)) AS closest_step, min(CASE WHEN value <= 20 THEN step END) AS first_reach_step,
           count(*) FILTER (step >= 0) AS steps, count(*) FILTER (step >= 0) - min(CASE WHEN value <= 20 THEN step END) - 1 AS steps_after_reach
    FROM s GROUP BY user_id""")
def first_reach(spark, d):
    e = seq.with_row(table(spark, d, "events"), KEY, ORDER).select("user_id", F.col("value").alias("distance"), (F.col("_row") - 2).cast("long").alias("step"))
    return seq.reach(e, KEY, "step", "distance", 20.0)


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
    SELECT event_id, min(CASE WHEN event_type = 'error' THEN place END) OVER w AS barrier_at,
           min(CASE WHEN event_type = 'error' THEN place END) OVER w IS NULL AND event_type <> 'error' AS reachable
    FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def reachability_prefix(spark, d):
    e = seq.with_row(table(spark, d, "events"), KEY, ORDER).withColumn("place", F.col("_row").cast("long"))
    error = F.col("event_type") == "error"
    return seq.reachability(e, KEY, ORDER, error, error, "place").select("event_id", "barrier_at", "reachable")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events),
    g AS (SELECT *, place - row_number() OVER (PARTITION BY user_id ORDER BY place) AS grp FROM s WHERE event_type <> 'error'),
    n AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY grp) - 1 AS segment FROM g)
    SELECT user_id, CAST(segment AS BIGINT) AS segment, min(place) AS first_place, count(*) AS n FROM n GROUP BY user_id, segment""")
def safe_segments(spark, d):
    e = seq.with_row(table(spark, d, "events"), KEY, ORDER).withColumn("place", F.col("_row").cast("long")).filter("event_type <> 'error'")
    return seq.islands(e, KEY, "place").groupBy("user_id", F.col("segment").cast("long").alias("segment")).agg(F.min("place").alias("first_place"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT *, coalesce(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 21600000000 AS INT), 0) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, round(sum(value), 4) AS total FROM n GROUP BY user_id, session""")
def session_windows(spark, d):
    out = seq.sessions(table(spark, d, "events"), KEY, ORDER, micros() / 1e6, 21_600)
    return out.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("events"), r(F.sum("value"), 4).alias("total"))


@query("""SELECT event_id, array_to_string(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), '>') AS history FROM events""")
def pose_history(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.array_join(seq.history("event_type", KEY, ORDER, 5), ">").alias("history"))


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id, n - coalesce(max(CASE WHEN event_type NOT IN ('view', 'click') THEN n END) OVER (PARTITION BY user_id ORDER BY n), 0) AS turns FROM s""")
def trailing_turns(spark, d):
    e = seq.with_row(table(spark, d, "events"), KEY, ORDER)
    return e.select("event_id", seq.trailing_run(F.col("event_type").isin("view", "click"), KEY, ORDER).alias("turns"))


@query("""WITH p AS (SELECT event_id, lead(value) OVER w - value AS dx, lead(event_id % 7) OVER w - event_id % 7 AS dz, (lead(event_id % 360) OVER w - event_id % 360) AS raw
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    q AS (SELECT event_id, dx, dz, abs(dx) AS move, raw, ((raw + 180) % 360 + 360) % 360 - 180 AS dyaw FROM p)
    SELECT event_id, CASE WHEN dx IS NULL THEN 'Stop' WHEN abs(dz) >= 1 AND abs(dz) >= move THEN CASE WHEN dz > 0 THEN 'Descend' ELSE 'Ascend' END
      WHEN abs(dyaw) >= 15 AND abs(dyaw) >= 3 * move THEN CASE WHEN dyaw > 0 THEN 'Turn Right' ELSE 'Turn Left' END
      WHEN move >= 1 THEN 'Move Forward' WHEN abs(dyaw) >= 15 THEN CASE WHEN dyaw > 0 THEN 'Turn Right' ELSE 'Turn Left' END ELSE 'Stop' END AS action FROM q""")
def derive_actions(spark, d):
    w = seq.ordered(KEY, ORDER)
    gap = lambda c: F.lead(c).over(w) - c
    e = table(spark, d, "events").select("event_id", gap(F.col("value")).alias("dx"), gap(F.col("event_id") % 7).alias("dz"), gap(F.col("event_id") % 360).alias("dyaw"))
    return e.select("event_id", derive_action(F.col("dx"), F.when(F.col("dx").isNotNull(), F.lit(0.0)), F.col("dz"), F.col("dyaw")).alias("action"))


@query("""SELECT event_id, round(((value * 7 + 180) % 360 + 360) % 360 - 180, 6) AS wrapped FROM events""")
def wrapped_angles(spark, d):
    return table(spark, d, "events").select("event_id", r(wrap_degrees(F.col("value") * 7)).alias("wrapped"))


_TEXT = {"signup": "Forward 3 m.", "view": "TURN RIGHT 30 DEGREE", "click": "go up 3m", "purchase": "descend 3 metres", "error": "look around"}
_PARSED = {"signup": ("forward 3m", 1, True), "view": ("turn right 30 degree", 3, True), "click": ("ascend 3m", 4, True), "purchase": ("descend 3m", 5, True), "error": ("stop", 0, False)}


@query("SELECT event_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _PARSED.items()) + " END AS command, CASE event_type " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in _PARSED.items()) + " END AS action_id, event_type <> 'error' AS matched FROM events")
def command_parse(spark, d):
    text = F.element_at(F.create_map(*(F.lit(x) for kv in _TEXT.items() for x in kv)), F.col("event_type"))
    return table(spark, d, "events").select("event_id", parse_action(text).alias("p")).select("event_id", "p.command", "p.action_id", "p.matched")


@query("""SELECT o_orderkey, CASE WHEN regexp_matches(lower(o_orderpriority), 'urgent') THEN 'stop' WHEN regexp_matches(lower(o_orderpriority), 'high') THEN 'turn left 30 degree' ELSE trim(regexp_replace(lower(o_orderpriority), '\\s+', ' ', 'g')) END AS command FROM orders""")
def command_normalize(spark, d):
    t = F.regexp_replace(F.regexp_replace(F.lower("o_orderpriority"), ".*urgent.*", "please STOP now"), ".*high.*", "a left turn")
    return table(spark, d, "orders").select("o_orderkey", normalize_command(t).alias("command"))


@query("""WITH p AS (SELECT event_id, value AS x, value / 2 AS y, value / 3 AS z, (event_id % 628) / 100.0 AS yaw, event_id % 10 AS a FROM events),
    q AS (SELECT *, CASE a WHEN 1 THEN 3.0 WHEN 8 THEN 6.0 WHEN 9 THEN 9.0 ELSE 0.0 END AS ahead, CASE a WHEN 6 THEN 3.0 WHEN 7 THEN -3.0 ELSE 0.0 END AS aside,
      CASE a WHEN 4 THEN 3.0 WHEN 5 THEN -3.0 ELSE 0.0 END AS rise, CASE a WHEN 2 THEN radians(30) WHEN 3 THEN -radians(30) ELSE 0.0 END AS turn FROM p)
    SELECT event_id, round(CAST(x + ahead * cos(yaw) - aside * sin(yaw) AS DOUBLE), 5) AS x, round(CAST(y + ahead * sin(yaw) + aside * cos(yaw) AS DOUBLE), 5) AS y, round(CAST(z + rise AS DOUBLE), 5) AS z,
      round(CAST(fmod(fmod(yaw + turn + pi(), 2 * pi()) + 2 * pi(), 2 * pi()) - pi() AS DOUBLE), 5) AS yaw FROM q""")
def pose_after_action(spark, d):
    v = F.col("value")
    e = table(spark, d, "events").select("event_id", pose_after(v, v / 2, v / 3, (F.col("event_id") % 628) / 100.0, F.col("event_id") % 10).alias("p"))
    return e.select("event_id", *(r(F.col(f"p.{c}"), 5).alias(c) for c in ("x", "y", "z", "yaw")))


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_type, value FROM events),
    sel AS (SELECT user_id, arg_max(place, (value, -place)) AS best FROM s GROUP BY user_id)
    SELECT s.user_id, place, CASE WHEN place = best THEN 'Stop' ELSE event_type END AS event_type, CASE WHEN place = best THEN event_type END AS original_action
    FROM s JOIN sel ON s.user_id = sel.user_id AND place <= best""")
def truncate_at_best(spark, d):
    e = seq.with_row(table(spark, d, "events"), KEY, ORDER).select("user_id", F.col("_row").cast("long").alias("place"), "event_type", "value")
    best = e.groupBy("user_id").agg((-F.max(F.struct("value", (-F.col("place")).alias("k")))["k"]).alias("place"))
    return seq.truncate_at(e, best, KEY, "place", "event_type").drop("value")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, event_type FROM events)
    SELECT * FROM s UNION ALL SELECT user_id, max(place) + 1, 'Stop' FROM s GROUP BY user_id""")
def append_stops(spark, d):
    e = seq.with_row(table(spark, d, "events"), KEY, ORDER).select("user_id", F.col("_row").cast("long").alias("place"), "event_type")
    return seq.append_stop(e, KEY, "place", "event_type")


@query("""SELECT user_id, count(*) FILTER (event_type = 'purchase') AS stops, arg_max(event_type, (ts, event_id)) = 'purchase' AS stop_is_last FROM events GROUP BY user_id""")
def stop_rules(spark, d):
    return seq.stop_rules(table(spark, d, "events"), KEY, ORDER, "event_type", "purchase")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, value, CAST(event_id % 100 AS DOUBLE) AS quality FROM events),
    p AS (SELECT user_id, value AS px, quality AS q FROM s WHERE place = 1),
    l AS (SELECT s.* FROM s JOIN p USING (user_id) WHERE place > 1 AND value >= 1.5 * px AND quality >= q - 10),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY quality DESC, value DESC, place) AS k FROM l)
    SELECT user_id, place, quality, value FROM b WHERE k = 1""")
def later_improvements(spark, d):
    e = seq.with_row(table(spark, d, "events"), KEY, ORDER).select("user_id", F.col("_row").cast("long").alias("place"), "value", (F.col("event_id") % 100).cast("double").alias("quality")).withColumn("sel", F.lit(1).cast("long"))
    return seq.later_improvement(e, KEY, "place", "sel", "value", "quality", 1.5, 10.0)


def _policy(order: str) -> str:
    return f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY {order}) AS k FROM events) WHERE k = 1"


def _deduped(spark, d, policy):
    return dedupe(table(spark, d, "events"), ["user_id", "event_type"], ORDER, policy, F.col("value") > 50).select("user_id", "event_type", "event_id")


@query(_policy("ts, event_id"))
def dedupe_first(spark, d):
    return _deduped(spark, d, "first")


@query(_policy("ts DESC, event_id DESC"))
def dedupe_last(spark, d):
    return _deduped(spark, d, "last")


@query(_policy("CAST(value > 50 AS INT), ts DESC, event_id DESC"))
def dedupe_last_success(spark, d):
    return _deduped(spark, d, "last_success")


@query("""WITH e AS (SELECT *, value > 50 AS bad FROM events),
    n AS (SELECT *, CASE WHEN bad THEN row_number() OVER (PARTITION BY user_id, event_type, bad ORDER BY ts, event_id) ELSE row_number() OVER (PARTITION BY user_id, event_type, bad ORDER BY ts DESC, event_id DESC) END AS k FROM e)
    SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(bad AS INT), k) AS b FROM n) WHERE b = 1""")
def dedupe_success_over_error(spark, d):
    return _deduped(spark, d, "success_over_error")


@query("SELECT event_id, user_id FROM events")
def dedupe_raise(spark, d):
    return dedupe(table(spark, d, "events"), ["event_id"], [F.lit(1)], "raise").select("event_id", "user_id")


@query("SELECT event_id, value FROM events")
def required_rows(spark, d):
    return require(table(spark, d, "events"), F.col("event_id") >= 0, "ids are not negative").select("event_id", "value")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events) WHERE k <= 5")
def first_n_per_group(spark, d):
    return first_n(table(spark, d, "events"), ["event_type"], ["event_id"], 5).select("event_type", "event_id")


@query("""SELECT e.event_id, p.event_id AS purchase_id, p.value AS purchase_value FROM (SELECT * FROM events WHERE event_type = 'view') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    bought = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max(F.struct("event_id", "value")).alias("m")).select("user_id", "ts", F.col("m.event_id").alias("purchase_id"), F.col("m.value").alias("purchase_value"))
    return as_of(e.filter("event_type = 'view'").select("user_id", "ts", "event_id"), bought, KEY, "ts", ["purchase_id", "purchase_value"]).select("event_id", "purchase_id", "purchase_value")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS s, epoch_us(ts) / 1000000.0 + 3600 AS e FROM events WHERE event_type = 'signup')
    SELECT events.event_id, count(*) AS n FROM events JOIN g ON events.user_id = g.user_id AND epoch_us(events.ts) / 1000000.0 >= g.s AND epoch_us(events.ts) / 1000000.0 < g.e GROUP BY events.event_id""")
def interval_join(spark, d):
    e = table(spark, d, "events").withColumn("at", micros() / 1e6)
    ranges = e.filter("event_type = 'signup'").select("user_id", F.col("at").alias("s"), (F.col("at") + 3600).alias("e"))
    return interval(e.select("event_id", "user_id", "at"), ranges, KEY, "at", "s", "e", 3600.0).groupBy("event_id").agg(F.count("*").alias("n"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def tumbling_hours(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"), "event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query("""SELECT event_id, len(list(event_id) OVER w) AS n, array_to_string(list((row_number) || ':' || event_type) OVER w, '>') AS steps
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_number FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY row_number ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def transition_history(spark, d):
    e = seq.with_row(table(spark, d, "events"), KEY, ORDER).withColumn("step", (F.col("_row") - 1).cast("long"))
    e = e.withColumns({"x": F.col("value"), "y": F.lit(0.0), "z": F.lit(0.0), "yaw": F.lit(0.0)})
    out = transitions(e, KEY, "step", "event_type", 5)
    return out.select("event_id", F.size("transitions").cast("long").alias("n"), F.array_join(F.transform("transitions", lambda t: F.concat_ws(":", t["step"].cast("string"), t["action"])), ">").alias("steps"))
