"""Machines that read an episode's rows in order: table functions over partitions, with a state of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.outcomes import RADIUS

_OUT = pa.schema([("episode", pa.int64()), ("termination", pa.string()), ("steps", pa.int64()), ("final_distance", pa.float64()), ("success", pa.bool_()), ("oracle_reach", pa.bool_()), ("legacy_success", pa.bool_()), ("legacy_reach", pa.bool_())])
_DDL = "episode long, termination string, steps long, final_distance double, success boolean, oracle_reach boolean, legacy_success boolean, legacy_reach boolean"


class EpisodeMachine:
    """Runs through the steps of one episode, a batch at a time, and gives its end as one row.

    It stops to look once the episode has ended: by a collision, by a stop, by
    the step limit, in that order within a step. State is seven values.
    """

    def __init__(self):
        self._episode, self._steps, self._distance, self._end = None, 0, None, None
        self._reach = self._near = self._any = False

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if batch.num_rows and self._end is None:
            self._episode, self._any = batch.column("episode")[0].as_py(), True
            hit = np.asarray(batch.column("collided").fill_null(False))
            stop = np.asarray(pc.equal(batch.column("action"), "stop").fill_null(False))
            full = np.asarray(batch.column("step")) == np.asarray(batch.column("most")) - 1
            ends = np.flatnonzero(hit | stop | full)
            n = int(ends[0]) + 1 if len(ends) else batch.num_rows
            distance = np.asarray(batch.column("distance").cast(pa.float64()).to_numpy(zero_copy_only=False))[:n]
            self._reach |= bool((~hit[:n] & (distance <= RADIUS)).any())
            self._near |= bool((distance < RADIUS).any())
            self._steps, self._distance = self._steps + n, float(distance[-1])
            if len(ends):
                k = ends[0]
                self._end = "collision" if hit[k] else "stop" if stop[k] else "step_limit"
        yield pa.Table.from_pylist([], _OUT)

    def terminate(self) -> Iterator[pa.Table]:
        if self._any:
            inside, crashed = self._distance <= RADIUS, self._end == "collision"
            row = (self._episode, self._end or "unfinished", self._steps, self._distance, self._end == "stop" and inside, self._reach and not crashed, inside, self._near)
            yield pa.Table.from_pylist([dict(zip(_OUT.names, row, strict=True))], _OUT)


def end_episodes(steps: DataFrame, most: int) -> DataFrame:
    """What outcomes.end_episodes says of each episode, by one ordered pass over its rows instead of aggregates and a join.

    ``steps`` has episode (long, not null), step (long, from 0, not null),
    action, distance (double, not null) and collided. An episode's rows stream
    through one task in order, none of them is held.
    """
    rows = steps.select(F.col("episode").cast("long"), F.col("step").cast("long"), "action", F.col("distance").cast("double"), "collided", F.lit(most).cast("long").alias("most"))
    return F.arrow_udtf(EpisodeMachine, returnType=_DDL)(rows.asTable().partitionBy("episode").orderBy("step"))
