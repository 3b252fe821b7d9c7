"""N-gram Jaccard self-join by parity sketches.

Each document is the set of its distinct word shingles. A shingle's hash names
one bit; a set's sketch is the XOR of its bits. The XOR of two sketches is the
sketch of the symmetric difference, so the Hamming distance of the sketches
never exceeds the size of the symmetric difference. For sets of sizes a and b
with Jaccard similarity of num/den or more, that size is at most
d = (a + b) * (den - num) / (den + num).

Pigeonhole: a sketch is cut into d + 1 + s parts, of which s + 1 agree at least.
A part with few bits set says little and agrees by chance, so a set leaves such
parts out if it has at most s of them: of the s + 1 parts that agree one at
least is then another one, and what agrees is poor on both sides or on neither.
(A set with more poor parts sends them all, so nothing is lost.) Sizes are cut
into bands, each with the d of its largest pair; a set also joins the next band
if it is large enough to have partners there. Parts have 2**40 bits, of which
only those set are held, so parts agree by their shingles and hardly by chance at
any number of documents; rows meet on a hash of (band, place, part).

Equal sets are one node from the start. Within a bucket the links to its first
and last node are tried first. Pairs of a bucket that are still in different
components are compared after that. Of either kind those are verified on the sets
whose sketches allow it: 1024 bits for all, and for large sets sketches of four
bits and more for each allowed difference. So no component is missed, and copies or
near copies are never expanded into all pairs. A bucket's first and last node, and
its first and last component, come from aggregates; what joins them back is
written first, so that adaptive execution can split a join on a hot key.

Defined results: null and empty texts and those without words have an empty
set, no links and themselves as component; texts shorter than a shingle are one
shingle of all their words; repeated ids keep one row each; further columns of
the input are ignored; rows without an id link with nothing and have a null
component; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WordHashes, materialize, mix, slices, texts

_STEP = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a word sequence."""
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = hashes.of(words)
    n = len(words) - width + 1
    x = np.zeros(n, np.uint64)
    for k in range(width):
        x = mix(x + h[k : k + n] * _STEP[k % len(_STEP)] + np.uint64(k))
    return np.unique(x)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: exactly what bytes.lower and bytes.split do."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_PART = np.uint64((1 << 40) - 1)
_SEEN = 1_000_000  # nodes that a task remembers to have sent
_LONGS = 16  # of the sketch that a pair is compared by before it is verified
_WIDE_FROM = 1_500  # shingles, from which a set also has a wider sketch


def bands(largest: int, num: int, den: int) -> list[int]:
    """Lower ends of the size bands up to one that lies above ``largest``; wider than the largest size ratio of a pair."""
    ends, ratio = [1], 0.9 * num / den
    while ends[-1] <= largest:
        ends.append(max(ends[-1] + 1, int(np.ceil(ends[-1] / ratio))))
    return [*ends, max(ends[-1] + 1, int(np.ceil(ends[-1] / ratio)))]


def plan(low: int, high: int, num: int, den: int) -> tuple[int, int, int]:
    """For a band of sizes from low to under high: number of parts, spare parts s, and the most bits of a poor part.

    Poor parts are those with up to so many bits that, at the band's least size,
    half of s of them are expected.
    """
    d = 2 * (high - 1) * (den - num) // (den + num)
    spare = (d + 1) // 4
    places = d + 1 + spare
    mean, poor, chance = low / places, -1, 0.0
    while (chance := chance + np.exp(-mean + (poor + 1) * np.log(mean)) / float(math.factorial(poor + 1))) <= 0.5 * spare / places:
        poor += 1
    return places, spare, poor


def sketch_keys(values: np.ndarray, num: int, den: int, ends: list[int]) -> np.ndarray:
    """The join keys of one set: a 64-bit hash of (band, place, part of the sketch)."""
    n, out = len(values), []
    k = int(np.searchsorted(ends, n, "right")) - 1
    for band in (k, k + 1) if den * n >= num * ends[k + 1] else (k,):
        # The next band's least size is for its own sets; one from below has fewer bits a part, and then may send all.
        places, spare, poor = plan(ends[band], ends[band + 1], num, den)
        spread = mix(values + np.uint64(band))
        at, times = np.unique((spread >> np.uint64(40)) % np.uint64(places) << np.uint64(40) | (mix(spread) & _PART), return_counts=True)
        at = at[times & 1 == 1]
        place = (at >> np.uint64(40)).astype(np.int64)
        bits = np.bincount(place, minlength=places)
        part = np.zeros(places, np.uint64)
        if len(at):
            first = np.flatnonzero(np.diff(place, prepend=-1))
            part[place[first]] = np.bitwise_xor.reduceat(mix(at), first)
        key = mix(mix(part) + np.arange(places, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band << 40))
        rich = bits > poor
        out.append(key[rich] if places - np.count_nonzero(rich) <= spare else key)
    return np.concatenate(out)


def sketch(values: np.ndarray) -> np.ndarray:
    """The parity sketch of a whole set, as 64-bit integers."""
    return _parity(values, 64 * _LONGS).view(np.int64)


def _parity(values: np.ndarray, bits: int) -> np.ndarray:
    set_bits = np.bincount((mix(values ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(set_bits.astype(np.uint8), bitorder="little")


def wide_sketch(values: np.ndarray, num: int, den: int) -> bytes | None:
    """For large sets a sketch of four bits and more for each allowed difference; its size is a power of two, so that halves fold into a smaller one."""
    if len(values) < _WIDE_FROM:
        return None
    return _parity(values, 1 << (8 * len(values) * (den - num) // (den + num)).bit_length()).tobytes()


def _wide_gap(x: bytes, y: bytes) -> int:
    """Hamming distance of two wide sketches, the larger one folded to the size of the other."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) != len(q):
        small, large = (p, q) if len(p) < len(q) else (q, p)
        p, q = small, large[: len(large) // 2] ^ large[len(large) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def _node(values: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes()))))


def _sets(docs: DataFrame, width: int, emit, schema: str) -> DataFrame:
    """Runs ``emit`` over (ids, sets) of each slice of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for part in slices(batches):
            sets = [shingle_set(words_of(t), width, hashes) for t in part.column("text").to_pylist()]
            yield from emit(part.column("doc_id").to_pylist(), sets, seen)

    return docs.mapInArrow(run, schema)


_SKETCH = tuple(f"s{k}" for k in range(_LONGS))
_NODES = "doc_id long, node long, n long, wide binary, " + ", ".join(f"{c} long" for c in _SKETCH)


def _emit_nodes(num: int, den: int):
    def emit(ids, sets, _):
        narrow = np.array([sketch(s) for s in sets]).reshape(-1, _LONGS)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([_node(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([wide_sketch(s, num, den) for s in sets], pa.binary()),
                *(pa.array(narrow[:, k]) for k in range(_LONGS)),
            ],
            ["doc_id", "node", "n", "wide", *_SKETCH],
        )

    return emit


def _emit_sets(ids, sets, _):
    for at in range(0, len(ids), 100):
        some = sets[at : at + 100]
        yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in some], pa.int64()), pa.array([s.tobytes() for s in some], pa.binary())], ["node", "members"])


def _emit_keys(num: int, den: int):
    def emit(ids, sets, seen):
        keys, nodes = [], []
        ends = bands(max((len(s) for s in sets), default=0), num, den)
        for s in sets:
            if not len(s) or (node := _node(s)) in seen:
                continue
            if len(seen) >= _SEEN:
                seen.clear()
            seen.add(node)  # a task's copies of a set send its keys once
            keys.append(k := sketch_keys(s, num, den, ends))
            nodes.append(np.full(len(k), node, np.int64))
        if keys:
            key, node = np.concatenate(keys).view(np.int64), np.concatenate(nodes)
            for at in range(0, len(key), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[at : at + 100_000]), pa.array(node[at : at + 100_000])], ["key", "node"])

    return emit


def _close(num: int, den: int):
    """Whether the sketches p.* and q.* allow the similarity for sizes p.n and q.n."""
    apart = reduce(operator.add, (F.bit_count(F.col(f"p.{c}").bitwiseXOR(F.col(f"q.{c}"))) for c in _SKETCH))
    return apart * (den + num) <= (F.col("p.n") + F.col("q.n")) * (den - num)


def _plausible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity."""
    p, q = sketches.alias("p"), sketches.alias("q")
    near = pairs.join(p, F.col("a") == F.col("p.node")).join(q, F.col("b") == F.col("q.node")).filter(_close(num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y")), strict=True)
            keep = [x is None or y is None or _wide_gap(x, y) * (den + num) <= n * (den - num) for n, x, y in rows]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return near.select("a", "b", (F.col("p.n") + F.col("q.n")).alias("n"), F.col("p.wide").alias("x"), F.col("q.wide").alias("y")).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, source: DataFrame, holders: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, exactly counted; sets are made again from the texts of the pairs' nodes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int(np.count_nonzero(large[at] == small))
                keep.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    ids = holders.join(nodes, "node", "left_semi").select("doc_id")
    sets = materialize(_sets(source.join(ids, "doc_id", "left_semi"), width, _emit_sets, "node long, members binary"))
    met = pairs.join(sets.select(F.col("node").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("members").alias("x")), "a")
    return materialize(met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable over the edges (a, b); by least neighbours and pointer jumping, a written table a round."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        moved = materialize(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("via")))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("far"))
        new = materialize(moved.join(jump, "via", "left").select("node", "old", F.least("via", F.coalesce("far", "via")).alias("component")))
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the component) and links_found of each document.

    ``links_found`` counts the linked nodes that were found while components were
    sought; links inside a component that is already whole are not looked for.
    """
    every = texts(docs, id_col, text_col)
    source = every.filter("doc_id IS NOT NULL")
    nodes = materialize(_sets(every, width, _emit_nodes(num, den), _NODES))
    nameless, nodes = nodes.filter("doc_id IS NULL"), nodes.filter("doc_id IS NOT NULL")
    # One exchange serves both sides: the ends of each bucket, and its rows.
    rows = _sets(source, width, _emit_keys(num, den), "key long, node long").repartition("key")
    ends = rows.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last")
    met = materialize(rows.join(ends, "key").select("key", "node", "first", "last").distinct())
    holders = nodes.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    one_each = nodes.select("node", "n", "wide", *_SKETCH).dropDuplicates(["node"])  # each task first, so that copies do not meet as rows
    sketches = materialize(one_each.join(met.select("node").distinct(), "node", "left_semi"))

    stars = met.select(F.col("first").alias("a"), F.col("node").alias("b")).union(met.select(F.col("last").alias("a"), F.col("node").alias("b")))
    stars = stars.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = materialize(_plausible(stars, sketches, num, den))
    edges = _verified(stars, source, holders, width, num, den)
    labels = components(edges)

    left = materialize(met.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c")))
    apart = materialize(left.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key"))
    left = materialize(left.join(apart, "key").join(sketches.drop("wide"), "node"))
    met_again = (F.col("p.key") == F.col("q.key")) & (F.col("p.c") != F.col("q.c")) & (F.col("p.node") < F.col("q.node")) & _close(num, den)
    rest = left.alias("p").join(left.alias("q"), met_again).select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()
    rest = materialize(_plausible(rest.join(stars, ["a", "b"], "left_anti"), sketches, num, den))
    if not rest.isEmpty():
        edges = edges.union(_verified(rest, source, holders, width, num, den))
        labels = components(edges)
    links = edges.select("a").union(edges.select(F.col("b").alias("a"))).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links_found"))
    # Documents of a set meet at its node first, so a component's least doc_id comes from one row a node.
    linked = materialize(holders.join(labels, "node").join(links, "node").select("node", "component", "doc_id", "links_found"))
    least = materialize(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    alone = holders.join(labels, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("links_found"))
    named = materialize(linked.join(least, "component").select("node", "component_id", "links_found").unionByName(alone))
    full = nodes.select("doc_id", "node", "n").filter("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "links_found")
    rest_of = nodes.filter("n = 0").select("doc_id", "n").unionByName(nameless.select("doc_id", "n"))
    return full.unionByName(rest_of.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("links_found")))
