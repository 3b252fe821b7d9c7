"""Runs a streaming plan over what is there now, as jobs and tests do; a service would start it with a trigger of its own."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sources.readers import exists
from tessera.sources.scratch import folder

#: The RocksDB state store, which takes disk as it needs it, not ahead.
_ROCKS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store for the queries that start meanwhile."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class Accounts:
    """What the progress of a query's batches says: observed metrics (``name.field``, summed), and rows that stateful operators dropped behind the watermark.

    An aggregate counts there what its tasks have combined, not rows; a join or a processor counts rows.
    """

    observed: Counter = field(default_factory=Counter)
    dropped: int = 0
    batches: int = 0

    def add(self, progress: Iterable) -> None:
        for p in progress:
            self.batches += 1
            self.dropped += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            for name, row in (p.observedMetrics or {}).items():
                self.observed.update({f"{name}.{k}": v for k, v in row.asDict().items() if v is not None})


def _run(stream: DataFrame, at: str, mode: str) -> list:
    """Runs to the end of what is there; gives the progress of every batch."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")  # a repeated batch takes its own place

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(write).start()
    told: dict[int, object] = {}
    while True:
        over = query.awaitTermination(5)
        told |= {p.batchId: p for p in query.recentProgress}
        if over:
            return list(told.values())


def _rows(spark: SparkSession, at: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(full).parquet(f"{at}/rows") if exists(spark, f"{at}/rows") else spark.createDataFrame([], full)


def available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything that the plan gives for the input at hand, in batches of which each is written as Parquet with its number as column batch."""
    at = folder(stream.sparkSession, "stream")
    _run(stream, at, mode)
    return _rows(stream.sparkSession, at, stream.schema)


def resumed(arrivals: Iterable[DataFrame], plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> tuple[DataFrame, Accounts]:
    """Rows with column batch, and accounts, of a plan to which tables arrive one after another.

    Each is written to a folder that the plan streams; the query runs to the end
    of what is there, stops, and is started anew from its checkpoint for the
    next. A repeated batch takes the place of its first attempt.
    """
    accounts, at = Accounts(), None
    for rows in arrivals:
        spark = rows.sparkSession
        at = at or folder(spark, "stream")
        rows.write.mode("append").parquet(f"{at}/arrived")
        stream = plan(spark.readStream.schema(rows.schema).parquet(f"{at}/arrived"))
        accounts.add(_run(stream, at, mode))
    if at is None:
        raise ValueError("nothing arrives")
    return _rows(spark, at, stream.schema), accounts
