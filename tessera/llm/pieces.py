"""SentencePiece encoding and decoding (byte-pair models) by vectorised merge rounds.

A text becomes words, each a space mark and what follows it; the distinct new
words of a slice are one flat array of symbols, a character each. In every round
the least rank of a neighbouring pair is found for each word (a segmented
minimum), and all its occurrences are merged at once from the left, up to the
first after which a pair of the same or a lower rank would arise: that one has
to go first, so it waits for the next round. The arrays are then compacted and
words without a pair leave, until none is left. This is the rule of the best
score first, leftmost of equals. Characters that are no pieces become the pieces
of their bytes. Runs of spaces beyond one a word are divided by their length
alone, if the model's pieces of several spaces are runs of spaces and have one
score below all others: then they merge last, and from the left, so a run is as
many of the longest piece as fit and what a shorter run becomes. In any other
model a whole text is one word.

Decoding gathers the bytes of all ids of a slice from one flat table.

The results of words are remembered, for a bounded number of them, by the
process that a Python worker is. The model is read from a file of an installed
package on each executor; nothing is shuffled.

Models: byte pairs with byte fallback, texts taken as they are (identity), a
space before the text, no symbols of the user's; others are refused.

Defined results: null and empty texts have no ids, and no ids give the empty
text; ids that the model lacks, and null ids, make decoding fail; bytes that are
no character give U+FFFD, each; the space mark U+2581 in a text comes back as a
space; further columns are kept as they are, but for those of the names that
are added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from tessera.llm.common import slices, with_field

SPACE = "▁"
_REMEMBERED, _LONG, _HASH_BITS = 400_000, 64, 20
_NONE = np.iinfo(np.int32).max
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6


class Merges:
    """Ranks of pairs of symbols, and merge rounds over flat arrays of them."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        order = np.argsort(pairs)
        self._pairs, self._ranks, self._merged = pairs[order], np.append(ranks[order], _NONE).astype(np.int32), np.append(merged[order], -1).astype(np.int32)
        # A pair's place by its hash; pairs that share a hash are searched for.
        self._place = np.full(1 << _HASH_BITS, len(pairs), np.int32)
        slot = self._slot(self._pairs)
        self._place[slot] = np.arange(len(pairs))
        self._place[slot[self._place[slot] != np.arange(len(pairs))]] = -1
        self._keys = np.append(self._pairs, -1)

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _HASH_BITS)

    def _of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and merged symbols of pairs; _NONE and -1 where they are none."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._place[self._slot(key)]
        if len(shared := np.flatnonzero(at < 0)):
            at[shared] = np.minimum(np.searchsorted(self._pairs, key[shared]), len(self._pairs))
        at[self._keys[at] != key] = len(self._pairs)
        return self._ranks[at], self._merged[at]

    def contract(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words when no pair remains, in the order in which they were done: (their numbers, sizes, symbols); sizes given are 1 or more and add up to the symbols."""
        gone = []
        names, word = np.arange(len(sizes)), np.repeat(np.arange(len(sizes)), sizes)
        rank, merged = self._neighbours(symbols, word, np.arange(len(symbols)))
        while True:
            least = np.minimum.reduceat(rank, np.cumsum(sizes) - sizes)
            if (done := least == _NONE).any():
                leave = done[word]
                gone.append((names[done], sizes[done], symbols[leave]))
                symbols, rank, merged = symbols[~leave], rank[~leave], merged[~leave]
                sizes, names, least = sizes[~done], names[~done], least[~done]
                word = np.repeat(np.arange(len(sizes)), sizes)
                if not len(sizes):
                    return tuple(map(np.concatenate, zip(*gone, strict=True)))
            hit = self._chosen(symbols, word, rank, merged, least)
            symbols[hit] = merged[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            sizes = sizes - np.bincount(word[hit], minlength=len(sizes))
            symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
            at = hit - np.arange(len(hit))  # each chosen pair before it has left out one symbol
            at = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[at], merged[at] = self._neighbours(symbols, word, at)

    def _neighbours(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of the pair that begins at each of those places."""
        next_ = np.minimum(at + 1, len(symbols) - 1)
        rank, merged = self._of(symbols[at], symbols[next_])
        rank[(next_ == at) | (word[next_] != word[at])] = _NONE
        return rank, merged

    def _chosen(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, merged: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Places of the pairs of this round: of each word those of least rank that do not overlap, up to the first that lets a pair of that rank or a lower one arise."""
        hit = np.flatnonzero(rank == least[word])
        fresh = np.diff(hit, prepend=-2) != 1
        run = hit[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        hit = hit[(hit - run) % 2 == 0]
        own, made, last = word[hit], merged[hit], len(symbols) - 1
        before = np.maximum(hit - 1, 0)
        follows = np.diff(hit, prepend=-9) == 2
        left = np.where(follows, np.roll(made, 1), symbols[before])
        after = np.minimum(hit + 2, last)
        a = np.where((hit > 0) & (word[before] == own), self._of(left, made)[0], _NONE)
        b = np.where((hit + 2 <= last) & (word[after] == own), self._of(made, symbols[after])[0], _NONE)
        lowers = np.minimum(a, b) <= least[own]
        ahead = np.cumsum(lowers) - lowers
        first = np.flatnonzero(np.diff(own, prepend=-1) != 0)
        return hit[ahead == ahead[first][np.cumsum(np.diff(own, prepend=-1) != 0) - 1]]


class Codec:
    """Encodes and decodes slices of texts with one model, in one process."""

    def __init__(self, model: sentencepiece_model_pb2.ModelProto):
        trained, normal = model.trainer_spec, model.normalizer_spec
        kinds = np.array([p.type for p in model.pieces])
        if trained.model_type != 2 or not trained.byte_fallback or trained.treat_whitespace_as_suffix:
            raise ValueError("the model is not of byte pairs with byte fallback")
        if normal.precompiled_charsmap or not normal.add_dummy_prefix or normal.remove_extra_whitespaces or not set(kinds) <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("the model changes texts or has symbols of its own")
        names = [p.piece for p in model.pieces]
        score = np.array([p.score for p in model.pieces])
        self._size = len(names)
        self._ids = {n: i for i, n in enumerate(names) if kinds[i] == _NORMAL}
        rank = np.unique(-score, return_inverse=True)[1]
        split = [(self._ids[n[:k]], self._ids[n[k:]], i) for n, i in self._ids.items() for k in range(1, len(n)) if n[:k] in self._ids and n[k:] in self._ids]
        left, right, whole = np.array(split, np.int64).reshape(-1, 3).T
        self._merges = Merges(left << 32 | right, rank[whole], whole)
        # Characters by their numbers: a piece, or beyond all pieces the character itself, which merges with nothing.
        self._chars = np.arange(0x110000, dtype=np.int32) + self._size
        for n, i in self._ids.items():
            if len(n) == 1:
                self._chars[ord(n)] = i
        # A character that is no piece but stands in one would have to merge.
        if any(c not in self._ids for n in self._ids for c in n):
            raise ValueError("a piece has a character that is none")
        self._byte = np.zeros(256, np.int32)
        for i in np.flatnonzero(kinds == _BYTE):
            self._byte[int(names[i][3:-1], 16)] = i
        self._longest, self._shorter = self._space_runs(score)
        self._cut = re.compile(" ?[^ ]+| +(?= |$)").findall if self._longest else None
        self._known: dict[str, bytes] = {}
        self._table(model, names, kinds)

    def _space_runs(self, score: np.ndarray) -> tuple[bytes, list[bytes]]:
        """The ids of the longest run of spaces that is a piece, and of all shorter runs, if runs can be divided by length alone; else none."""
        several = {n: i for n, i in self._ids.items() if SPACE in n[1:]}
        others = [score[i] for n, i in self._ids.items() if n not in several and len(n) > 1]
        scores = {score[i] for i in several.values()}
        if SPACE not in self._ids or any(n.strip(SPACE) for n in several) or len(scores) > 1 or (others and max(scores, default=-np.inf) >= min(others)):
            return b"", []
        longest = max(map(len, several), default=1)
        found = self._contracted([" " * n for n in range(1, longest + 1)])
        runs = [b"", *(found[" " * n] for n in range(1, longest + 1))]
        return (runs[-1], runs[:-1]) if len(runs[-1]) == 4 else (b"", [])

    def _table(self, model, names: list[str], kinds: np.ndarray) -> None:
        said = [
            bytes([int(n[3:-1], 16)]) if k == _BYTE else b"" if k == _CONTROL else (model.trainer_spec.unk_surface if k == _UNKNOWN else n.replace(SPACE, " ")).encode("utf-8")
            for n, k in zip(names, kinds, strict=True)
        ]
        self._lengths = np.array([len(s) for s in said], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._said = np.frombuffer(b"".join(said), np.uint8)
        self._kinds, self._spaced = kinds, np.array([n.startswith(SPACE) and k == _NORMAL for n, k in zip(names, kinds, strict=True)])

    def _contracted(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word, as 32-bit integers."""
        symbols = self._chars[np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.uint32)]
        names, sizes, ids = self._merges.contract(symbols, np.fromiter(map(len, words), np.int64, len(words)))
        ends, odd = np.cumsum(sizes), ids >= self._size
        data, out = ids.tobytes(), {}
        for k, a, b, strange in zip(names.tolist(), ((ends - sizes) * 4).tolist(), (ends * 4).tolist(), np.logical_or.reduceat(odd, ends - sizes).tolist(), strict=True):
            out[words[k]] = self._with_bytes(data[a:b]) if strange else data[a:b]
        return out

    def _with_bytes(self, data: bytes) -> bytes:
        """With the pieces of its bytes for each character that is no piece."""
        ids = np.frombuffer(data, np.int32).tolist()
        return np.concatenate([[i] if i < self._size else self._byte[list(chr(i - self._size).encode("utf-8"))] for i in ids]).astype(np.int32).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        marked = [f" {t.replace(SPACE, ' ')}" if t else "" for t in texts]
        if self._cut is None:
            known = self._contracted([*{t for t in marked if t}])
            return [np.frombuffer(known.get(t, b""), np.int32) for t in marked]
        cut = [self._cut(t) for t in marked]
        double = ["  " in t for t in marked]
        words = set().union(*cut)
        if any(double):
            words = {w for w in words if w.strip(" ")}
        words.add(" ")
        new = [w for w in words if w not in self._known]
        if len(self._known) + len(new) > _REMEMBERED:
            self._known.clear()
            new = [*words]
        if new:
            self._known |= self._contracted(new)
        out = [np.frombuffer(self._spaced_out(parts) if two else b"".join(map(self._known.__getitem__, parts)), np.int32) for parts, two in zip(cut, double, strict=True)]
        for w in new:
            if len(w) > _LONG:
                del self._known[w]
        return out

    def _spaced_out(self, parts: list[str]) -> bytes:
        """Joins words and runs of spaces: a space that its word left alone belongs to the run before it."""
        out, run, one = [], 0, self._run(1)
        for w in parts:
            if not w.strip(" "):
                run += len(w)
                continue
            ids = self._known[w]
            if w[0] == " " and ids[:4] == one:
                run, ids = run + 1, ids[4:]
            out += [self._run(run), ids]
            run = 0
        return b"".join([*out, self._run(run)])

    def _run(self, n: int) -> bytes:
        most = len(self._shorter)
        return self._longest * (n // most) + self._shorter[n % most]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each sequence of ids, which lie one after another."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self._size):
            raise ValueError("an id is not of this model")
        lengths = self._lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        said = self._said[np.repeat(self._starts[ids] - total[:-1], lengths) + np.arange(total[-1])].tobytes()
        out, ends = [], np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends, strict=True):
            marks = np.flatnonzero(self._kinds[ids[a:b]] == _CONTROL) + a  # these say nothing, but end a run of bytes
            parts = [said[total[p] : total[q]] for p, q in zip([a, *marks], [*marks, b], strict=True)] if len(marks) else [said[total[a] : total[b]]]
            first = a + next((k for k, m in enumerate(marks) if m != a + k), len(marks))
            if first < b and self._spaced[ids[first]]:  # the space that encoding puts before a text
                parts[first - a] = parts[first - a][1:]
            out.append("".join(map(_text, parts)))
        return out


def _text(data: bytes) -> str:
    """UTF-8, with U+FFFD for every single byte that begins no character."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, k = [], 0
    while k < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[k : k + n].decode("utf-8"))
            except UnicodeDecodeError:
                continue
            k += n
            break
        else:
            out.append("�")
            k += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    return Codec(model)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Adds ``ids_col``: the ids of each whole text by the model at ``path``, an array of int."""

    def run(part: pa.RecordBatch) -> pa.Array:
        found = codec(path).encode([t or "" for t in part.column(text_col).to_pylist()])
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))

    return _over(docs, text_col, ids_col, "array<int>", run)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds ``text_col``: the text that the ids of ``ids_col`` stand for."""

    def run(part: pa.RecordBatch) -> pa.Array:
        column = part.column(ids_col)
        sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
        flat = column.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        return pa.array(codec(path).decode(np.asarray(flat, np.int64), sizes), pa.string())

    return _over(rows, ids_col, text_col, "string", run)


def _over(df: DataFrame, column: str, made: str, kind: str, run) -> DataFrame:
    schema = with_field(df, made, kind)
    names = [f.name for f in schema][:-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], column) if pa.types.is_string(batch.column(column).type) else [batch]:
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), run(part)], [*names, made])

    return df.select(*(f"`{n}`" for n in names)).mapInArrow(each, schema)
