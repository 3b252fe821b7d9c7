"""Secret scan: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters are counted over the whole corpus
from samples that the patterns label: the values they catch, of 16 characters or
more with a digit, are random strings; all other text is ordinary words and
identifiers. The counts of pairs of symbols are a table of fixed size, summed by
Spark. Runs of key characters are cut at the patterns' spans. What is left of 20
characters or more is a secret if the random model explains it better by
``least`` nats at least, and by ``per_char`` nats a character; else its stretch of
the largest ratio is, if it has that length and ratio, to the next signs (of
``/_=-+``) around it where that holds too, and what stands beside it is looked at
in turn. So a key within a path or beside a known secret is found by itself.

Kinds and their order are fixed: assign, access, hex, markov. Spans are
kind:start:end in code points, end exclusive. Matches are leftmost and do not
overlap within a kind; a match that fails its length is dropped after it has
consumed its text.

Defined results: null and empty texts have no spans; without any labelled
random string the random model is uniform; further columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, with_field

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
#: Key characters; all other bytes are one symbol, which also starts a run.
_KEY = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(_KEY) + 1
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[list(_KEY)] = np.arange(1, SYMBOLS)
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
RUN = 20
#: What parts of a path or identifier are joined by.
_SIGNS = b"/_=-+"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans, by start, then kind; regular expressions run only over texts that can have a match."""
    found, data = [], text.encode("utf-8", "surrogatepass")
    lower = data.lower()
    if any(w in lower for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in data:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if len(_runs(_IS_HEX[np.frombuffer(data, np.uint8)], 24)[0]):
        found += [("hex", *m.span()) for m in _HEX.finditer(text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _runs(member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True of that length or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], member.view(np.int8), [0]])))
    long = edge[1::2] - edge[::2] >= least
    return edge[::2][long], edge[1::2][long]


def secret_value(text: str, span: tuple[str, int, int]) -> str:
    """What a pattern caught, without the name that it is assigned to."""
    return _ASSIGN.match(text[span[1] : span[2]])[2] if span[0] == "assign" else text[span[1] : span[2]]


def _pairs(data: bytes) -> np.ndarray:
    s = _SYMBOL[np.frombuffer(b" " + data, np.uint8)]
    return np.bincount(s[:-1] * SYMBOLS + s[1:], minlength=SYMBOLS * SYMBOLS)


@dataclass(frozen=True)
class Models:
    """Log-likelihood ratio of each pair of symbols: random over ordinary."""

    ratio: np.ndarray

    def score(self, value: str) -> float:
        s = _SYMBOL[np.frombuffer(b" " + value.encode(), np.uint8)]
        return float(self.ratio[s[:-1], s[1:]].sum())


def fit(random: np.ndarray, ordinary: np.ndarray, prior: float = 20.0) -> Models:
    """Models from counts of pairs; ``prior`` uniform observations of each symbol after each other one go into the random model, 0.5 into the ordinary one."""

    def logs(counts: np.ndarray, extra: float) -> np.ndarray:
        c = counts.reshape(SYMBOLS, SYMBOLS)[:, 1:] + extra  # what ends a run is no part of it
        return np.log(c / c.sum(axis=1, keepdims=True))

    out = np.zeros((SYMBOLS, SYMBOLS))
    out[:, 1:] = logs(random, prior) - logs(ordinary, 0.5)
    return Models(out)


def train(docs: DataFrame, text_col: str = "text") -> Models:
    """Counts both models over all texts; at most 2 * SYMBOLS ** 2 sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                at = 0
                for span in base_spans(text):
                    value = secret_value(text, span)
                    if len(value) >= 16 and any(c.isdigit() for c in value):
                        total[0] += _pairs(value.encode())
                    if span[1] > at:
                        total[1] += _pairs(text[at : span[1]].encode("utf-8", "surrogatepass"))
                    at = max(at, span[2])
                total[1] += _pairs(text[at:].encode("utf-8", "surrogatepass"))
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[label, pair])], ["label", "pair", "n"])

    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(count, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    total = np.zeros((2, SYMBOLS * SYMBOLS))
    for r in rows:
        total[r["label"], r["pair"]] = r["n"]
    return fit(*total)


def _stretches(value: bytes, models: Models, least: float, per_char: float) -> Iterator[tuple[int, int]]:
    """The secrets within a run of key characters, which do not overlap."""
    todo = [(0, len(value))]
    while todo:
        a, b = todo.pop()
        if b - a < RUN:
            continue
        s = _SYMBOL[np.frombuffer(b" " + value[a:b], np.uint8)]
        total = np.concatenate([[0.0], np.cumsum(models.ratio[s[:-1], s[1:]])])
        lowest = np.minimum.accumulate(total)
        end = int((total - lowest).argmax())
        start = int(np.argmin(total[: end + 1]))
        wide, far = start, end
        while wide > 0 and value[a + wide - 1] not in _SIGNS:
            wide -= 1
        while far < b - a and value[a + far] not in _SIGNS:
            far += 1
        for x, y in ((0, b - a), (wide, far), (start, end)):
            if y - x >= RUN and total[y] - total[x] >= max(least, per_char * (y - x)):
                yield a + x, a + y
                todo += [(a, a + x), (a + y, b)]
                break


def markov_spans(text: str, base: list[tuple[str, int, int]], models: Models, least: float = 12.0, per_char: float = 0.5) -> list[tuple[str, int, int]]:
    """Stretches of key characters outside the base spans that the random model explains better."""
    data, out = text.encode("utf-8", "surrogatepass"), []
    for a, b in zip(*_runs(_SYMBOL[np.frombuffer(data, np.uint8)] > 0, RUN), strict=True):
        first = len(data[:a].decode("utf-8", "surrogatepass"))
        at, last = first, first + int(b - a)
        for _, s, e in sorted((x for x in base if x[1] < last and x[2] > first), key=lambda x: x[1:]) + [("", last, last)]:
            if s - at >= RUN:
                out += [("markov", at + x, at + y) for x, y in _stretches(data[a + at - first : a + s - first], models, least, per_char)]
            at = max(at, min(e, last))
    return sorted(out, key=lambda x: x[1])


def scan(docs: DataFrame, models: Models, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """Adds ``out_col``: the secrets of each whole text as structs (kind, start, end), by start, then kind."""
    schema = with_field(docs, out_col, "array<struct<kind:string,start:int,end:int>>")
    names = [f.name for f in schema][:-1]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            found = []
            for text in part.column(text_col).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + markov_spans(text or "", base, models), key=lambda s: (s[1], KINDS.index(s[0])))
                found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(found, kind)], [*names, out_col])

    return docs.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)
