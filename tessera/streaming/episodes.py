"""Structured Streaming over episode steps: summaries by window, and per-episode state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(steps: DataFrame, time: str, keys: list[str], size: str, slide: str | None = None, late: str = "10 minutes", observed: str | None = None) -> DataFrame:
    """Counts and mean value by event-time window and keys; rows whose windows the watermark has passed are left out.

    With ``observed`` the query's progress has, under that name, the number n of
    rows by window before any is left out: less what the windows count in the
    end, it is what came too late.
    """
    w = F.window(time, size, slide) if slide else F.window(time, size)
    rows = steps.withWatermark(time, late).select(w.alias("w"), *keys, "value")
    if observed:
        rows = rows.observe(observed, F.count(F.lit(1)).alias("n"))
    out = rows.groupBy("w", *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "mean")


def sessions(steps: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Counts by session of a key: a new one after a gap. A session is given once the watermark has passed its end; rows whose own gap it has passed are left out."""
    out = steps.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def distinct(steps: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark.

    A key comes again after that time, and rows behind the watermark are left
    out (the query's progress counts them): where all keys are wanted once, the
    watermark's delay has to span the disorder, and what comes out is made
    distinct.
    """
    return steps.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def met(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Rows of two streams with the same key, the right one at most ``within`` after the left one.

    State ends on both sides: a left row's when the watermark has passed its
    time and ``within``, a right row's when it has passed its time. The watermark
    is the lesser one of both streams; rows behind it are left out (the query's
    progress counts them).
    """
    near = (F.col("l.k") == F.col("r.k")) & (F.col("r.t") >= F.col("l.t")) & (F.col("r.t") <= F.col("l.t") + F.expr(f"INTERVAL {within}"))
    a = left.withWatermark(left_time, late).select(F.col(key).alias("k"), F.col(left_time).alias("t"), F.struct("*").alias("row")).alias("l")
    b = right.withWatermark(right_time, late).select(F.col(key).alias("k"), F.col(right_time).alias("t"), F.struct("*").alias("row")).alias("r")
    return a.join(b, near).select(F.col("l.k").alias(key), F.col("l.row").alias("left"), F.col("r.row").alias("right"))


_STATE = "steps long, turns long, distance double, last double, reached long, ended string"
_OUT = "episode long, steps long, turn_run long, distance double, first_reach long, ended string"


def episode_state(steps: DataFrame, stop: str, turns: list[str], radius: float, most_steps: int, idle_ms: int | None = None) -> DataFrame:
    """Each episode's progress after every batch that has steps of it: steps, current run of turns, distance, first step within the radius, and how it ended.

    ``steps`` has episode (long), step (long), action (string), value (double,
    the distance to the target) and collided (boolean). An episode ends by
    collision, then by a stop, then by the step limit; later steps of it are
    ignored. With ``idle_ms``, one without steps for so long in processing time is
    given up as stale; such a plan never runs out of batches, so it is for
    services, not for a run over what is there. State is six numbers an episode.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, run_, far, last, reached, ended = state.get if state.exists else (0, 0, 0.0, None, None, None)
        if state.hasTimedOut:
            state.remove()
            ended = ended or "stale"
        else:
            rows = pd.concat(list(batches)).sort_values("step", kind="stable")
            for action, value, hit in zip(rows["action"], rows["value"], rows["collided"], strict=True):
                if ended is not None:
                    break
                far += abs(value - last) if last is not None else 0.0
                last, run_ = float(value), run_ + 1 if action in turns else 0
                reached = n if reached is None and value <= radius else reached
                n += 1
                ended = "collision" if hit else "stop" if action == stop else "step_limit" if n >= most_steps else None
            state.update((n, run_, far, last, reached, ended))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        out = pd.DataFrame({"episode": [key[0]], "steps": [n], "turn_run": [run_], "distance": [far], "first_reach": pd.array([reached], dtype="Int64"), "ended": pd.array([ended], dtype="object")})
        yield out

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return steps.groupBy("episode").applyInPandasWithState(run, _OUT, _STATE, "update", timeout)


def success(ended: Column, final_distance: Column, radius: float = 20.0) -> Column:
    """A success is a stop within the radius; a collision never is one."""
    return (ended == "stop") & (final_distance <= radius)


def oracle_success(first_reach: Column, ended: Column) -> Column:
    """Whether the target was ever reached, and the episode did not collide."""
    return first_reach.isNotNull() & ~F.coalesce(ended == "collision", F.lit(False))
