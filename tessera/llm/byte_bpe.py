"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

A text is cut by the tokenizer's pattern. A piece that is a token is that token;
of all others, the distinct ones of a slice become rows (word, position, token),
first one token a byte. A recursive query joins neighbours to the merge table
(left, right, merged), takes each word's leftmost pair of least rank and
contracts it, and goes on with the words that changed until none does. Pieces of
more than ``LONG`` bytes go through a query that holds only the current tokens
(USING KEY) and contracts, in one round, all occurrences of a word's least pair
up to the first after which a pair of lower rank would arise: the same result,
in as many rounds as there are ranks. Decoding joins the ids to the vocabulary
and puts the bytes together by an ordered aggregation.

The results of pieces are remembered, for a bounded number of them, by the
process that a Python worker is. The vocabulary is read from a file of an
installed package on each executor; nothing is shuffled.

Defined results: null and empty texts have no tokens; ids that the vocabulary
lacks make decoding fail; further columns are kept as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import slices, with_field

LONG = 96
_REMEMBERED = 500_000

_CONTRACT = """
WITH RECURSIVE step(w, p, t, live) AS (
    SELECT w, p, t, true FROM pieces
    UNION ALL
    (WITH paired AS (
        SELECT w, p, t, lead(t) OVER s AS right_t, lead(p) OVER s AS right_p FROM step WHERE live WINDOW s AS (PARTITION BY w ORDER BY p)
    ), least AS (
        SELECT w, min((m.merged::BIGINT << 32) | p) AS best, arg_min(right_p, (m.merged::BIGINT << 32) | p) AS gone
        FROM paired JOIN merges m ON m.l = t AND m.r = right_t GROUP BY w
    )
    SELECT q.w, q.p, CASE WHEN (b.best & 4294967295) = q.p THEN (b.best >> 32)::INTEGER ELSE q.t END, b.best IS NOT NULL
    FROM paired q LEFT JOIN least b ON b.w = q.w WHERE b.gone IS DISTINCT FROM q.p)
)
SELECT w, list(t ORDER BY p) AS ids FROM step WHERE NOT live GROUP BY w ORDER BY w
"""

_CONTRACT_LONG = """
WITH RECURSIVE step(w, p, t) USING KEY (w, p) AS (
    SELECT w, p, t FROM pieces
    UNION ALL
    (WITH placed AS (
        SELECT w, p, t, row_number() OVER s AS i, lag(t) OVER s AS left_t, lead(t) OVER s AS right_t, lead(p) OVER s AS right_p, lead(t, 2) OVER s AS next_t
        FROM recurring.step WHERE t >= 0 WINDOW s AS (PARTITION BY w ORDER BY p)
    ), ranked AS (
        SELECT q.*, m.merged FROM placed q JOIN merges m ON m.l = q.t AND m.r = q.right_t
    ), hits AS (
        SELECT *, i - row_number() OVER (PARTITION BY w ORDER BY i) AS run
        FROM (SELECT *, min(merged) OVER (PARTITION BY w) AS least FROM ranked) WHERE merged = least
    ), chosen AS (
        SELECT *, lag(i) OVER (PARTITION BY w ORDER BY i) = i - 2 AS follows
        FROM (SELECT *, row_number() OVER (PARTITION BY w, run ORDER BY i) AS turn FROM hits) WHERE turn % 2 = 1
    ), checked AS (
        SELECT c.w, c.p, c.right_p, c.merged, c.i, a.merged < c.merged OR b.merged < c.merged AS lowers
        FROM chosen c
        LEFT JOIN merges a ON a.l = CASE WHEN c.follows THEN c.merged ELSE c.left_t END AND a.r = c.merged
        LEFT JOIN merges b ON b.l = c.merged AND b.r = c.next_t
    ), kept AS (
        SELECT * FROM (SELECT *, min(CASE WHEN lowers THEN i END) OVER (PARTITION BY w) AS last FROM checked) WHERE last IS NULL OR i <= last
    )
    SELECT w, p, merged FROM kept UNION ALL SELECT w, right_p, -1 FROM kept)
)
SELECT w, list(t ORDER BY p) AS ids FROM step WHERE t >= 0 GROUP BY w ORDER BY w
"""

_DECODE = "SELECT d, array_to_string(list(v.bytes ORDER BY p), '') AS text FROM tokens JOIN vocabulary v ON v.t = tokens.t GROUP BY d ORDER BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes slices of texts with one vocabulary, in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._ranks, self._find = ranks, regex.compile(pattern).findall
        self._bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self._known: dict[str, bytes] = {}
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        pairs = [(ranks[t[:k]], ranks[t[k:]], rank) for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self._load("merges", np.array(pairs, np.int32).reshape(-1, 3), ["l", "r", "merged"])
        # Bytes as the characters of the same numbers, since a token may be a part of a character.
        self._db.register("given", pa.table({"t": pa.array(list(ranks.values()), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]}))
        self._db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")

    def _load(self, name: str, rows: np.ndarray, columns: list[str]) -> None:
        self._db.register("given", pa.table(dict(zip(columns, rows.T, strict=True))))
        self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")

    def _contract(self, pieces: list[bytes], query: str) -> list[bytes]:
        if not pieces:
            return []
        sizes = np.array([len(p) for p in pieces])
        rows = {
            "w": np.repeat(np.arange(len(pieces), dtype=np.int32), sizes),
            "p": (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
            "t": self._bytes[np.frombuffer(b"".join(pieces), np.uint8)],
        }
        self._db.register("pieces", pa.table(rows))
        ids = self._db.sql(query).to_arrow_table().column("ids").combine_chunks()
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4")
        return [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self._known]
        if len(self._known) + len(new) > _REMEMBERED:
            self._known.clear()
            new = list(pieces)
        short, long = [], []
        for piece in new:
            data = piece.encode("utf-8")
            if (rank := self._ranks.get(data)) is not None:
                self._known[piece] = rank.to_bytes(4, "little")
            else:
                (short if len(data) <= LONG else long).append((piece, data))
        for some, query in ((short, _CONTRACT), (long, _CONTRACT_LONG)):
            self._known |= zip((p for p, _ in some), self._contract([d for _, d in some], query), strict=True)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [self._find(t) for t in texts]
        self._learn(set().union(*cut))
        return [b"".join(map(self._known.__getitem__, pieces)) for pieces in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes that each sequence of ids stands for."""
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        tokens = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if len(tokens) and (tokens.min() < 0 or tokens.max() >= len(self._ranks)):
            raise ValueError("an id is not of this vocabulary")
        place = (np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        self._db.register("tokens", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "p": place, "t": tokens}))
        found, out = self._db.sql(_DECODE).to_arrow_table(), [b""] * len(ids)
        for d, text in zip(found.column("d").to_pylist(), found.column("text").to_pylist(), strict=True):
            out[d] = text.encode("latin-1")
        return out


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _over(df: DataFrame, column: str, made: str, kind: str, run) -> DataFrame:
    schema = with_field(df, made, kind)
    names = [f.name for f in schema][:-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(run(part.column(column).to_pylist()), pa.binary())], [*names, made])

    return df.select(*(f"`{n}`" for n in names)).mapInArrow(each, schema)


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col``: the ids of each whole text as little-endian unsigned 32-bit integers in one binary value."""
    return _over(docs, text_col, ids_col, "binary", lambda texts: codec(path, pattern).encode([t or "" for t in texts]))


def decode(rows: DataFrame, path: str, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Adds ``bytes_col``: the bytes that the ids of ``ids_col`` stand for."""
    return _over(rows, ids_col, bytes_col, "binary", lambda ids: codec(path, pattern).decode([x or b"" for x in ids]))
