"""Queries that run as streams over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.rows import dedupe
from tessera.plans.base import query, r, table
from tessera.sources.readers import parquet_stream
from tessera.streaming import episodes, lanes
from tessera.streaming.run import available, resumed, rocks


def _events(spark, d):
    return parquet_stream(spark, f"{d}/events.parquet")


@query("""WITH s AS (SELECT user_id AS episode, row_number() OVER w AS n, event_type, value, abs(value - lag(value) OVER w) AS step, event_id % 29 = 0 AS hit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    e AS (SELECT *, CASE WHEN hit THEN 'collision' WHEN event_type = 'purchase' THEN 'stop' WHEN n >= 20 THEN 'step_limit' END AS ended FROM s),
    f AS (SELECT episode, coalesce(min(n) FILTER (ended IS NOT NULL), max(n)) AS last, arg_min(ended, n) FILTER (ended IS NOT NULL) AS ended FROM e GROUP BY episode)
    SELECT f.episode, CAST(f.last AS BIGINT) AS steps, CAST(f.last - coalesce(max(n) FILTER (event_type NOT IN ('view', 'click')), 0) AS BIGINT) AS turn_run, round(coalesce(sum(step), 0), 4) AS distance, CAST(min(n) FILTER (value <= 20) - 1 AS BIGINT) AS first_reach, f.ended
    FROM e JOIN f ON e.episode = f.episode AND n <= f.last GROUP BY f.episode, f.last, f.ended""")
def streamed_episodes(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("episode"), F.col("event_id").alias("step"), F.col("event_type").alias("action"), "value", (F.col("event_id") % 29 == 0).alias("collided"))
    out = available(episodes.episode_state(e, "purchase", ["view", "click"], 20.0, 20), "update")
    last = dedupe(out, ["episode"], ["batch"], "last")
    return last.select("episode", "steps", "turn_run", (F.round("distance", 4) + F.lit(0.0)).alias("distance"), "first_reach", "ended")


@query("SELECT DISTINCT user_id, event_type FROM events")
def streamed_distinct(spark, d):
    e = _events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    # The stream forgets a key after a week, so that its state ends, and may give it again; what it gave is made distinct.
    return available(episodes.distinct(e.select("at", "user_id", "event_type"), "at", ["user_id", "event_type"], "7 days")).select("user_id", "event_type").distinct()


@query("""SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def streamed_days(spark, d):
    e = _events(spark, d).withColumn("at", F.col("ts").cast("timestamp"))
    out = available(episodes.windowed(e, "at", ["event_type"], "1 day"), "update")
    last = dedupe(out, ["start", "event_type"], ["batch"], "last")
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


#: Days of a block, the order in which the blocks of a month arrive, and the stragglers that come two arrivals later.
_BLOCK, _TURNS = 5, [0, 2, 1, 3, 5, 4]


def _arrivals(spark, d, kinds=None):
    """The events, or those of some kinds, in as many tables as blocks, out of order in time."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    e = e if kinds is None else e.filter(F.col("event_type").isin(kinds))
    block = F.least(F.lit(len(_TURNS) - 1), F.floor((F.dayofmonth("at") - 1) / _BLOCK)).cast("int")
    turn = F.element_at(F.array(*map(F.lit, _TURNS)), block + 1)
    turn = F.when(F.col("event_id") % 50 == 7, F.least(F.lit(len(_TURNS) - 1), turn + 2)).otherwise(turn)
    return [e.filter(turn == k).drop("ts", "props") for k in range(len(_TURNS))]


def _sql_arrived(delay_days: int, kinds: str = "") -> str:
    """e: events in microseconds with the watermark (us) that stands when they arrive, the least of the kinds' own ones if there are several streams."""
    parts = [f"AND event_type = '{k}'" for k in kinds.split()] or [""]
    least = lambda upto: "least(" + ", ".join(f"(SELECT coalesce(max(us // 1000 * 1000), 0) FROM o q WHERE {upto} {p})" for p in parts) + f") - {delay_days} * 86400000000"
    return f"""WITH b AS (SELECT *, epoch_us(ts) AS us, {_TURNS}[least({len(_TURNS)}, (day(ts) - 1) // {_BLOCK} + 1)] AS turn FROM events),
    o AS (SELECT * EXCLUDE (turn), CASE WHEN event_id % 50 = 7 THEN least({len(_TURNS) - 1}, turn + 2) ELSE turn END AS turn FROM b),
    m AS (SELECT t.turn, greatest(0, {least("q.turn < t.turn")}) AS mark FROM (SELECT DISTINCT turn FROM o) t),
    e AS (SELECT o.*, mark FROM o JOIN m USING (turn)), ended AS (SELECT greatest(0, {least("true")}) AS mark)"""


_DAY = 86_400_000_000


@query(f"""{_sql_arrived(12)}, pairs AS (SELECT event_type, value, mark, us // {_DAY} * {_DAY} - k * {_DAY} AS start FROM e, range(2) AS r(k)), kept AS (SELECT * FROM pairs WHERE start + 2 * {_DAY} > mark)
    SELECT make_timestamp(start) AS start, make_timestamp(start + 2 * {_DAY}) AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean, (SELECT count(*) FROM pairs) - (SELECT count(*) FROM kept) AS late FROM kept GROUP BY start, event_type""")
def streamed_sliding(spark, d):
    out, accounts = resumed(_arrivals(spark, d), lambda s: episodes.windowed(s, "at", ["event_type"], "2 days", "1 day", "12 days", observed="seen"), "update")
    last = dedupe(out, ["start", "event_type"], ["batch"], "last")
    kept = last.agg(F.sum("n")).first()[0] or 0
    return last.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", r(F.col("mean")).alias("mean"), F.lit(accounts.observed["seen.n"] - kept).cast("long").alias("late"))


@query(f"""{_sql_arrived(20)}, g AS (SELECT *, us - lag(us) OVER w AS gap FROM e WHERE us > mark WINDOW w AS (PARTITION BY user_id ORDER BY us)),
    s AS (SELECT *, sum(CASE WHEN gap < 6 * 3600000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us) AS session FROM g)
    SELECT user_id, make_timestamp(min(us)) AS start, make_timestamp(max(us) + 6 * 3600000000) AS "end", count(*) AS n, (SELECT count(*) FROM e WHERE us <= mark) AS late FROM s GROUP BY user_id, session""")
def streamed_sessions(spark, d):
    arrivals = _arrivals(spark, d)
    # A last arrival moves the watermark beyond all sessions; its own stays open.
    tick = arrivals[0].sparkSession.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"), F.lit("2100-01-01").cast("timestamp").alias("at"))
    out, accounts = resumed([*arrivals, tick], lambda s: episodes.sessions(s, "at", "user_id", "6 hours", "20 days"), "append")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.lit(accounts.dropped).cast("long").alias("late"))


@query(f"""{_sql_arrived(12, "view purchase")}, kept AS (SELECT * FROM e WHERE us > mark)
    SELECT v.user_id, v.event_id AS view_id, p.event_id AS purchase_id, (SELECT count(*) FROM e WHERE us <= mark AND event_type IN ('view', 'purchase')) AS late
    FROM kept v JOIN kept p ON p.user_id = v.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.us BETWEEN v.us AND v.us + {_DAY}""")
def streamed_meetings(spark, d):
    def met(stream):
        kind = lambda k: stream.filter(F.col("event_type") == k).select("user_id", "event_id", "at")  # noqa: E731  # what the state holds of a row
        return episodes.met(kind("view"), kind("purchase"), "user_id", "at", "at", "1 day", "12 days")

    out, accounts = resumed(_arrivals(spark, d, ["view", "purchase"]), met, "append")
    return out.select("user_id", F.col("left.event_id").alias("view_id"), F.col("right.event_id").alias("purchase_id"), F.lit(accounts.dropped).cast("long").alias("late"))


_STARTED = "2024-01-01 00:00:00"


@query(f"""{_sql_arrived(12)}, a AS (SELECT user_id AS lane, us // 1000 AS ms, false AS started FROM e WHERE us > mark UNION ALL SELECT c_custkey, epoch_us(TIMESTAMP '{_STARTED}') // 1000, true FROM customer),
    l AS (SELECT lane, ms, bool_and(started) AS unused, lead(ms) OVER (PARTITION BY lane ORDER BY ms) AS next FROM a GROUP BY lane, ms)
    SELECT lane, make_timestamp(ms * 1000) AS since, CASE WHEN unused THEN 'no_activity' ELSE 'stale' END AS reason, (SELECT count(*) FROM e WHERE us <= mark) AS late
    FROM l, ended WHERE (next IS NULL OR next - ms > 36 * 3600000) AND ms + 36 * 3600000 < mark // 1000""")
def streamed_stale_lanes(spark, d):
    started = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(_STARTED).cast("timestamp").alias("at"))
    with rocks(spark):
        out, accounts = resumed(_arrivals(spark, d), lambda s: lanes.silences(s, "user_id", "at", 36 * 3_600_000, "12 days", started), "append")
    return out.select("lane", F.col("since").cast("timestamp_ntz").alias("since"), "reason", F.lit(accounts.dropped).cast("long").alias("late"))
