"""Text quality by Bradley-Terry pairwise ranking.

A labelled good text is preferred to a labelled bad one. With s(x) = w.x for
the features x of a text, the chance that a is preferred to b is
1 / (1 + exp(s(b) - s(a))), so w comes from a logistic loss on differences of
features. The latent scores of all labelled rows are then cut at a quantile: the
share of bad rows. Scores are put on 0 to 1 by a logistic curve which has 0.7 at
that cut. Every usable labelled row takes part in pairs: rows of both labels are
numbered by a hash of their id and dealt to blocks in turn, about eight of the
rarer label to each, and all pairs of a block count; so the pairs grow with the
rows, and only sums over blocks reach the driver. Scoring takes every whole
text, without a shuffle; labels, source, language and id are no inputs of it.

Defined results: null and empty texts are scored on all-zero features; labels
other than 0 and 1 are not used; without rows of both labels all scores are 0.7
(nothing says which texts to reject); further columns are kept as they are.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices, with_field
from tessera.operators.rows import numbered

CUT = 0.7
FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_next", "upper_words", "symbol_ends", "lone_symbols", "upper_letters", "digits",
    "spaces", "high_bytes", "bars", "marks", "exclaims", "stops", "commas", "other_punctuation", "line_words", "repeated_lines", "short_words",
)
_CLASSES = np.zeros((256, 10))
for _k, _members in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\n", bytes(range(128, 256)), b"|", b"*#$%&~^@", b"!", b".?;:", b",", b"\"'()[]{}<>/\\_-+=`")):
    _CLASSES[list(_members), _k] = 1
_MARKS = tuple("*#$%&~^|@")


def features(text: str) -> list[float]:
    """The feature vector of a whole text; all shares are of words, bytes or lines."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, lines = len(words), [x for x in text.split("\n") if x.strip()]
    upper, digits, spaces, high, bars, marks, exclaims, stops, commas, other = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256) @ _CLASSES
    size = float(len(text))
    sizes = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(n),
        min(float(sizes.mean()), 20.0),
        len(set(words)) / n**0.8,
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(w.endswith(_MARKS) for w in words) / n,
        sum(not w.isalnum() for w in words if len(w) == 1) / n,
        upper / size, digits / size, spaces / size, high / size, bars / size, marks / size, exclaims / size, stops / n, commas / n, other / size,
        np.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        float((sizes <= 2).mean()),
    ]


@dataclass(frozen=True)
class Ranking:
    """Weights of the features, the latent cut, and the slope of the curve that puts scores on 0 to 1."""

    weights: tuple[float, ...]
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = self.slope * (x @ np.array(self.weights) - self.cut) + np.log(CUT / (1 - CUT))
        return 1.0 / (1.0 + np.exp(-np.clip(at, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, seed: int = 7, l2: float = 1e-4, steps: int = 25) -> Ranking:
    """Newton's method on the logistic loss of the differences of drawn (good, bad) pairs, for rows at hand; ``train`` fits tables, on pairs of all rows."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking((0.0,) * x.shape[1], 0.0, 1.0)
    scale = np.maximum(x.std(axis=0), 1e-6)
    draw = np.random.default_rng(seed)
    d = (x[draw.choice(good, pairs)] - x[draw.choice(bad, pairs)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -35, 35)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + l2 * np.eye(len(w)), d.T @ p / pairs - l2 * w)
        w = w + step * min(1.0, 5.0 / max(np.linalg.norm(step), 1e-12))
    w = w / scale
    latent = x @ w
    cut = float(np.quantile(latent, len(bad) / len(y), method="midpoint"))
    return Ranking(tuple(w), cut, float(1.0 / max(latent.std() / 4, 1e-9)))


#: Rows of the rarer label in a block, and the most of the other one.
_RARE, _MOST = 8, 4_096


def _featured(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """turn, label, x of each chosen row that has a document; features are taken where the texts lie, so that no text is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = pa.array([features(t) for t in part.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), x], ["doc_id", "x"])

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, x array<double>").join(chosen, "doc_id").select("turn", "label", "x")


def _blocks(rows: DataFrame, bad: int, good: int) -> DataFrame:
    """block, good, bad: the features of a block's rows, one after another; each row is in a block that has both labels."""
    rare, most = min(bad, good), max(bad, good)
    n = max(1, rare // _RARE, -(-most // _MOST))
    place = F.when(F.col("label") == 0, F.col("place")).otherwise(F.col("place") - bad)
    turns = F.when(F.col("label") == (0 if bad == rare else 1), F.sequence(place % n, F.lit(n - 1).cast("long"), F.lit(rare).cast("long"))).otherwise(F.array(place % n)) if n > rare else F.array(place % n)
    dealt = numbered(rows, ["label", "turn", "x"]).withColumn("block", F.explode(turns))
    side = lambda label: F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("label") == label, F.struct("place", "x")))), lambda r: r["x"]))
    return dealt.groupBy("block").agg(side(1).alias("good"), side(0).alias("bad"))


def _sums(blocks: DataFrame, w: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Pairs, gradient and curvature of the loss at w, summed over all pairs of the blocks."""
    m = len(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, total = None, np.zeros(1 + m + m * m)
        for part in batches:
            for block, good, bad in zip(part.column("block").to_pylist(), part.column("good"), part.column("bad"), strict=True):
                a, b = (c.values.to_numpy(zero_copy_only=False).reshape(-1, m) / scale for c in (good, bad))
                d = (a[:, None, :] - b[None, :, :]).reshape(-1, m)
                p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -35, 35)))
                total += np.concatenate([[len(d)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
                least = block if least is None else min(block, least)
        if least is not None:
            yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["block", "total"])

    total = np.sum([r["total"] for r in sorted(blocks.mapInArrow(run, "block long, total array<double>").collect())], axis=0)
    return total[0], total[1 : m + 1], total[m + 1 :].reshape(m, m)


def _rounded(x) -> np.ndarray:
    """Ten digits, which do not depend on the order of a sum."""
    return np.array([float(f"{v:.10g}") for v in x])


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", l2: float = 1e-4, steps: int = 25) -> Ranking:
    """Fits on all rows of ``labels`` for which ``usable`` (over id_col) holds."""
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).withColumn(id_col, F.col("doc_id")).filter(usable)
    chosen = chosen.withColumn("turn", F.xxhash64("doc_id")).select("doc_id", "label", "turn")
    rows = materialize(_featured(docs.filter(usable).select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), chosen))
    m = len(FEATURES)
    found = rows.agg(F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("good"), *(F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(m))).first()
    bad, good = found["bad"], found["good"]
    if not bad or not good:
        return fit(np.zeros((0, m)), np.zeros(0))
    scale = np.maximum(_rounded(found[f"s{k}"] for k in range(m)), 1e-6)
    blocks = materialize(_blocks(rows, bad, good))
    w = np.zeros(m)
    for _ in range(steps):
        pairs, slope, curve = _sums(blocks, w, scale)
        step = np.linalg.solve(curve / pairs + l2 * np.eye(m), slope / pairs - l2 * w)
        size = np.linalg.norm(step)
        w = w + step * min(1.0, 5.0 / max(size, 1e-12))
        if size < 1e-11 * max(1.0, np.linalg.norm(w)):
            break
    w = _rounded(w / scale)

    def latent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            yield pa.RecordBatch.from_arrays([pa.array((x * w).sum(axis=1)), part.column("turn")], ["latent", "turn"])

    scores = numbered(rows.mapInArrow(latent, "latent double, turn long"), ["latent", "turn"])  # so that copies of a text go to several ranges
    at = (bad / (bad + good)) * (bad + good - 1)
    middle = [r["latent"] for r in scores.filter(F.col("place").isin(int(np.floor(at)), int(np.ceil(at)))).collect()]
    spread = _rounded([scores.agg(F.stddev_pop("latent")).first()[0]])[0]
    return Ranking(tuple(map(float, w)), float((min(middle) + max(middle)) / 2), float(1.0 / max(spread / 4, 1e-9)))


def score(docs: DataFrame, ranking: Ranking, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds ``score_col`` (0 to 1) to every row, from its whole text alone; takes the place of a column of that name."""
    schema = with_field(docs, score_col, "double")
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            x = np.array([features(t or "") for t in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(ranking.scores(x))], [*names, score_col])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)
