"""Folders for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, path, True)
    return path


def folder(spark: SparkSession, kind: str = "table") -> str:
    """A new folder below the shared one of ``spark.checkpoint.dir``; where that is unset, below one of this process on a local master, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or _own_dir()}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Writes a table once, as it is partitioned, and reads it back, so that what follows does not run its plan again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
