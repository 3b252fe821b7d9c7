"""Small helpers that several operators of this package share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handled at a time inside a task, by number and by characters.
SLICE_ROWS, SLICE_CHARS = 1_000, 2_000_000
_MEMO_WORDS = 200_000


#: Rows and bytes that Spark hands to Python at a time; whole texts are long, and its defaults of 10,000 rows and 64 MB hold a few hundred MB a task.
BATCH_ROWS, BATCH_BYTES = 1_000, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the registered queries."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Sets batches of BATCH_ROWS and BATCH_BYTES for a session that does not set its own; the registered queries call it, operators never do."""
    own = spark.conf.getAll
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if (name := f"spark.sql.execution.arrow.{key}") not in own:
            spark.conf.set(name, value)


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, path, True)
    return path


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; where that is unset, a folder of this process on a local master, else an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_dir()


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder, as it is partitioned, and reads it back: cuts lineage, survives lost executors, keeps columns prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, whatever else ``docs`` has; null texts become empty."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice has a bounded number of rows and, beyond one row, of characters."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0))
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_CHARS):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered for a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (Stafford's variant 13)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def with_field(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with a last field of that name, which takes the place of any other of that name; kind is DDL."""
    return T.StructType([*df.drop(name).schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def crc_part(id_col: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


class Vectors:
    """The vectors of a list column: which rows hold one of finite components alone, and how long each is."""

    def __init__(self, column: pa.ListArray):
        self.lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
        self._flat = np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
        self._starts = np.cumsum(self.lengths) - self.lengths
        odd = np.concatenate([[0], np.cumsum(~np.isfinite(self._flat))])
        self.finite = np.asarray(column.is_valid()) & (odd[self._starts + self.lengths] == odd[self._starts])

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Which rows have a finite vector of that length, and these as a matrix."""
        rows = np.flatnonzero(self.finite & (self.lengths == length))
        return rows, self._flat[self._starts[rows][:, None] + np.arange(length)]


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as 64-bit integers; ValueError from 2^62 on."""
    out = np.floor(x * float(scale))
    if out.size and np.abs(out).max() >= 2.0**62:
        raise ValueError("a component is too large for a 64-bit integer")
    return out.astype(np.int64)


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the least of 2, 4 and 8 bytes that holds them all."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
