"""Conflict-constrained best-fit packing of documents into training sequences.

A document's size is its number of words; longer ones than the capacity are cut
into pieces of at most the capacity. Pieces are dealt to shards by a hash of the
document (their number follows the total size, so a shard holds about
``shard_words`` words at any scale, and a hot source or cluster spreads evenly),
and each shard packs its own, largest first. Open bins stand in order of what is
left in them and carry bitmaps of the sources and duplicate clusters inside. A
piece goes into the tightest bin with room whose bitmaps have neither its source
nor its cluster: the search starts at the first bin that is large enough and
goes on to its successors until one is compatible; else a new bin opens. Equal
residuals stand in the order of the bins' numbers.

Defined results: no piece is dropped; documents without words (null and empty
texts) get one piece of size 0 without a bin; a null source conflicts with
nothing; the duplicate cluster is the text in lower case with white space made
equal, unless a column names another; repeated ids are packed as separate rows,
told apart by nothing but their order; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices

CAPACITY, SHARD_WORDS = 2048, 2_000_000
_PACKED = "doc_id long, piece int, n_words int, bin_id long, start int"


def best_fit(items: Iterable[tuple[int, int | None, int | None]], capacity: int) -> Iterator[tuple[int, int]]:
    """(bin, start) for each item (size, source, cluster) in the order given."""
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    source_bit: dict[int, int] = {}
    cluster_bit: dict[int, int] = {}

    for size, source, cluster in items:
        s = 0 if source is None else 1 << source_bit.setdefault(source, len(source_bit))
        c = 0 if cluster is None else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        if left > size:
            insort(order, (left - size, b))
        yield b, capacity - left


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """doc_id, n_words, source (hashed) and cluster of each document."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.when(F.col(f"`{source_col}`").isNotNull(), F.xxhash64(F.col(f"`{source_col}`"))).alias("source"),
        (F.col(f"`{cluster_col}`").cast("long") if cluster_col else F.lit(None).cast("long")).alias("cluster"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = [t.encode("utf-8", "surrogatepass").lower().split() for t in part.column("text").to_pylist()]
            own = [xxhash.xxh3_64_intdigest(b" ".join(w)) - (1 << 63) for w in words]
            cluster = part.column("cluster") if cluster_col else pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(w) for w in words], pa.int32()), part.column("source"), cluster], ["doc_id", "n_words", "source", "cluster"])

    return rows.mapInArrow(run, "doc_id long, n_words int, source long, cluster long")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None) -> DataFrame:
    """doc_id, piece (from 0), n_words, bin_id, start (the piece's first word within its bin) of every piece."""
    rows = materialize(measured(docs, id_col, text_col, source_col, cluster_col))
    total = rows.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n_words") - 1) / capacity).cast("int")))))
    pieces = pieces.withColumn("n_words", F.least(F.lit(capacity), F.col("n_words") - F.col("piece") * capacity))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)).cast("int"))
    dealt = pieces.filter("n_words > 0").repartitionById(int(shards), "shard").sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "piece", "source", "cluster")

    def packed(shard: int, some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(some)
        size, source, cluster = (t.column(n).to_pylist() for n in ("n_words", "source", "cluster"))
        where = np.array(list(best_fit(zip(size, source, cluster, strict=True), capacity)), np.int64).reshape(-1, 2)
        columns = [t.column("doc_id"), t.column("piece"), t.column("n_words"), pa.array(where[:, 0] + (shard << 32)), pa.array(where[:, 1].astype(np.int32))]
        yield from pa.table(columns, ["doc_id", "piece", "n_words", "bin_id", "start"]).to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if now is not None and shard[a] != now:
                        yield from packed(now, held)
                        held = []
                    now = int(shard[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from packed(now, held)

    empty = pieces.filter("n_words = 0").select("doc_id", "piece", "n_words", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("start"))
    return dealt.mapInArrow(run, _PACKED).unionByName(empty)
