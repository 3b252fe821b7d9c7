"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, word pairs and pairs
with one word between (lower case, punctuation as white space), in a space of
``2**bits``. Training goes through a bounded sample of labelled rows (the
``max_rows`` with the smallest hash of their id, so the same rows at any
partitioning) with per-coordinate rates and L1; what is left is a sparse vector
of at most ``2**bits`` weights, a proven bound, which is broadcast. Scoring
takes every whole text, without a shuffle.

Defined results: null and empty texts get the score of the intercept alone;
rows with a null or other label than 0 and 1 are not trained on; a sample with
one class or none gives that class's rate (0.5 without rows); repeated labels
of an id count as often as they occur; further columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, mix, slices, with_field

_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() or c == 39 else 32 for c in range(256))


@dataclass(frozen=True)
class Weights:
    """A sparse linear model: sorted feature indices, their weights, the intercept."""

    bits: int
    index: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits, np.float32)
        out[self.index] = self.value
        return out


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def features(texts: list[str], bits: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(position of the text, feature index) for all n-grams and skip-grams of the texts, with repeats."""
    split = [words_of(t) for t in texts]
    owner = np.repeat(np.arange(len(split)), [len(w) for w in split])
    h = hashes.of([w for ws in split for w in ws])
    mask = np.uint64((1 << bits) - 1)
    same, apart = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    pair, skip = mix(h[:-1] * _PAIR + h[1:])[same], mix(h[:-2] * _SKIP + h[2:] + np.uint64(1))[apart]
    return np.concatenate([owner, owner[:-1][same], owner[:-2][apart]]), (np.concatenate([mix(h), pair, skip]) & mask).astype(np.int64)


class Learner:
    """FTRL-proximal: takes examples one by one, each a set of distinct feature indices with its label."""

    def __init__(self, bits: int, rate: float = 0.5, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0):
        self._bits, self._alpha, self._beta, self._l1, self._l2 = bits, alpha, beta, l1, l2
        self._z, self._n = np.zeros(1 << bits), np.zeros(1 << bits)
        rate = float(np.clip(rate, 1e-3, 1 - 1e-3))
        self._bias, self._bias_n = float(np.log(rate / (1 - rate))), 0.0

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self._l1, 0.0, (np.sign(z) * self._l1 - z) / ((self._beta + np.sqrt(n)) / self._alpha + self._l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        z, n = self._z[at], self._n[at]
        w = self._weights(z, n)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + self._bias, -35, 35))) - label
        self._z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / self._alpha * w
        self._n[at] = n + g * g
        self._bias_n += g * g
        self._bias -= 0.02 * g / (1.0 + np.sqrt(self._bias_n))

    def weights(self) -> Weights:
        kept = np.flatnonzero(np.abs(self._z) > self._l1)
        return Weights(self._bits, kept.astype(np.int32), self._weights(self._z[kept], self._n[kept]).astype(np.float32), self._bias)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bits: int = 20, max_rows: int = 50_000, epochs: int = 2) -> Weights:
    """Fits on at most ``max_rows`` rows of ``labels`` for which ``usable`` (over id_col) holds.

    The ids of the sample are broadcast, and its features are made where the
    texts are. One task then reads them in the order of the ids' hashes, ``epochs``
    times, and holds no more than a batch of them and two numbers a feature.
    """
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).withColumn(id_col, F.col("doc_id")).filter(usable)
    chosen = chosen.withColumn("turn", F.xxhash64("doc_id")).select("doc_id", "label", "turn").orderBy("turn", "doc_id", "label").limit(max_rows)
    rate = chosen.agg(F.avg("label")).first()[0]
    if rate is None:
        return Learner(bits).weights()
    sample = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            owner, at = features(part.column("text").to_pylist(), bits, hashes)
            at = np.unique(owner << bits | at)
            ends = np.searchsorted(at, np.arange(part.num_rows + 1) << bits)
            own = (at & ((1 << bits) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("turn"), part.column("label"), pa.array([own[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["turn", "label", "at"]
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(bits, rate)
        for batch in batches:
            for at, label in zip(batch.column("at"), batch.column("label").to_pylist(), strict=True):
                learner.learn(np.frombuffer(at.as_buffer(), np.int32), label)
        w = learner.weights()
        yield pa.RecordBatch.from_arrays([pa.array([w.index.tobytes()]), pa.array([w.value.tobytes()]), pa.array([w.bias])], ["index", "value", "bias"])

    passes = F.sequence(F.lit(1), F.lit(epochs)) if 0 < rate < 1 else F.array().cast("array<int>")
    made = sample.mapInArrow(featurize, "turn long, label int, at binary").withColumn("epoch", F.explode(passes)).repartition(1).sortWithinPartitions("epoch", "turn", "label", "at")
    out = made.mapInArrow(learn, "index binary, value binary, bias double").collect()
    if not out:
        return Learner(bits, rate).weights()
    return Weights(bits, np.frombuffer(out[0]["index"], np.int32), np.frombuffer(out[0]["value"], np.float32), out[0]["bias"])


def score(docs: DataFrame, weights: Weights, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds ``score_col`` (0 to 1) to every row, from its whole text alone; takes the place of a column of that name."""
    model = docs.sparkSession.sparkContext.broadcast((weights.index, weights.value))
    bits, bias = weights.bits, weights.bias
    schema = with_field(docs, score_col, "double")
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        dense = Weights(bits, *model.value, bias).dense()
        for part in slices(batches, text_col):
            owner, at = features([t or "" for t in part.column(text_col).to_pylist()], bits, hashes)
            has = dense[at] != 0
            own = np.unique(owner[has] << bits | at[has])
            total = bias + np.bincount(own >> bits, dense[own & ((1 << bits) - 1)], part.num_rows)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))], [*names, score_col])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)
