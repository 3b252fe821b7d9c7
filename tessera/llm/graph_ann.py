"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one a shard.

Equal vectors are one node (with the k + 1 smallest ids that have it, all that
a result of k can need). Nodes are dealt to bands by the power of two of their
norm, and within a band to shards around pivots, stored vectors drawn by a hash;
what a pivot gathers beyond ``shard_rows`` is split by a hash. Within a shard
norms differ by less than two, so scaled by the largest norm M and with one more
component, sqrt(1 - |x|^2 / M^2), vectors have one length, and the largest inner
product is the least Euclidean distance; components are centred on the shard's
mean before they are held in single precision. Nodes are inserted in batches: a
greedy search over the graph so far proposes neighbours, and a proposal is kept
unless a nearer kept one is ``alpha`` times closer to it than the node is;
reverse edges are pruned likewise. Graphs are written as a table, a row each.

A query first searches the ``PROBES`` shards whose mean has the largest inner
product with it. What it finds gives a least score, and it then searches every
other shard whose bound (norm and angle around the mean) reaches that score, so
no shard that could hold a better one is left out. Queries meet a shard's graph
in groups of at most about ``QUERY_ROWS``, a beam search each, and candidates are
scored in double precision on the original vectors.

Bounds: there are at most about ``MOST_SHARDS`` pivots, beyond that shards grow;
their means and bounds are broadcast (32 MB at 512 components), the graphs never.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, those of another length than most (of the longer one in a tie), and
rows without an id take no part; repeated ids with different vectors are rows of
their own; a query with fewer candidates than k gets them all; equal scores
stand in the order of the ids; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize

DEGREE, BEAM, ALPHA, SHARD_ROWS = 32, 64, 1.2, 8_192
#: Of a query's search, which is cheap beside building.
QUERY_BEAM = 128
PROBES, QUERY_ROWS, MOST_SHARDS = 3, 8_192, 8_192
#: Nodes that every search starts from, besides the one nearest to the mean.
ENTRIES = 16


class Distance:
    """Squared distances from some rows to nodes."""

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self._x, self._rows = x, rows

    def __call__(self, some: np.ndarray, at: np.ndarray) -> np.ndarray:
        """From the rows of that number (b,) to x[at] for at (b, k); infinite where at is negative."""
        apart = self._x[at]
        apart -= self._rows[some][:, None]
        return np.where(at < 0, np.inf, np.einsum("bkd,bkd->bk", apart, apart))


class Inner(Distance):
    """Inner products with the sign turned, so that the least is the nearest."""

    def __call__(self, some: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at < 0, np.inf, -np.einsum("bd,bkd->bk", self._rows[some], self._x[at]))


def beam_search(gap: Distance, edges: np.ndarray, entry: np.ndarray, b: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes found for each of b rows by greedy search from the entry nodes: (nodes, gaps), nearest first, -1 where fewer."""
    nodes = np.full((b, beam), -1, np.int64)
    gaps = np.full((b, beam), np.inf, np.float32)
    done = np.zeros((b, beam), bool)
    first = np.broadcast_to(entry[:beam], (b, min(len(entry), beam)))
    nodes[:, : first.shape[1]], gaps[:, : first.shape[1]] = first, gap(np.arange(b), first)
    active = np.arange(b)
    while len(active):
        n, g, d = nodes[active], gaps[active], done[active]
        open_gap = np.where(d | (n < 0), np.inf, g)
        best = open_gap.argmin(axis=1)
        going = np.isfinite(open_gap[np.arange(len(active)), best])
        active, n, g, d, best = active[going], n[going], g[going], d[going], best[going]
        if not len(active):
            break
        pick = np.arange(len(active))
        d[pick, best] = True
        near = edges[n[pick, best]]
        near = np.where((near[:, :, None] == n[:, None, :]).any(axis=2), -1, near)
        n, g, d = np.hstack([n, near]), np.hstack([g, gap(active, near)]), np.hstack([d, np.zeros(near.shape, bool)])
        order = np.argpartition(g, beam - 1, axis=1)[:, :beam] if g.shape[1] > beam else np.argsort(g, axis=1)
        rowwise = np.arange(len(active))[:, None]
        nodes[active], gaps[active], done[active] = n[rowwise, order], g[rowwise, order], d[rowwise, order]
    order = np.argsort(gaps, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(gaps, order, 1)


def robust_prune(x: np.ndarray, own: np.ndarray, near: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node of own (b,), the kept ones of its proposals near (b, k): -1 where fewer than degree."""
    b = len(own)
    near = np.where(near == own[:, None], -1, near)
    rowwise = np.arange(b)
    gaps = Distance(x, x[own])(rowwise, near)
    order = np.argsort(gaps, axis=1, kind="stable")
    near, gaps = np.take_along_axis(near, order, 1), np.take_along_axis(gaps, order, 1)
    gaps[:, 1:][near[:, 1:] == near[:, :-1]] = np.inf
    kept = np.full((b, degree), -1, np.int64)
    for k in range(degree):
        best = gaps.argmin(axis=1)
        live = np.isfinite(gaps[rowwise, best])
        if not live.any():
            break
        chosen = np.where(live, near[rowwise, best], -1)
        kept[:, k] = chosen
        to_chosen = Distance(x, x[chosen])(rowwise, near)
        gaps[live[:, None] & (alpha * alpha * to_chosen <= gaps)] = np.inf
        gaps[rowwise, best] = np.inf
    return kept


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entry nodes) of the graph over the rows of x, which stand in an arbitrary fixed order."""
    n = len(x)
    edges = np.full((n, degree), -1, np.int64)
    start = min(n, 2 * degree)
    some = np.arange(start)
    edges[:start] = robust_prune(x, some, np.broadcast_to(some, (start, start)).copy(), degree, alpha)
    middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1)[:start].argmin()) if n else 0
    entry = np.unique([middle, *range(min(n, ENTRIES))]) if n > BEAM else some
    at = start
    while at < n:
        own = np.arange(at, min(n, at + min(batch, max(32, at // 4))))
        found, _ = beam_search(Distance(x, x[own]), edges, entry, len(own), beam)
        edges[own] = robust_prune(x, own, found, degree, alpha)
        source, target = np.repeat(own, degree), edges[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        touched, first, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(touched), int(count.max())), -1, np.int64)
        back[np.repeat(np.arange(len(touched)), count), np.arange(len(target)) - np.repeat(first, count)] = source
        have = (edges[touched] >= 0).sum(axis=1)
        room = have + count <= degree
        for t, h, row, c in zip(touched[room], have[room], back[room], count[room], strict=True):
            edges[t, h : h + c] = row[:c]
        if (~room).any():
            edges[touched[~room]] = robust_prune(x, touched[~room], np.hstack([edges[touched[~room]], back[~room]]), degree, alpha)
        at = int(own[-1]) + 1
    return edges, entry


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, band) of the rows that take part; v is an array of doubles, band the power of two of its norm."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.coalesce(fine, F.lit(False)) & F.exists("v", lambda c: c != 0))
    most = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    rows = rows.filter(F.size("v") == (most["width"] if most else 0))
    top = F.array_max(F.transform("v", F.abs))
    # Of the largest component and the rest beside it, so that no square is too large or too small.
    return rows.withColumn("band", F.floor(F.log2(top) + F.log2(F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / top) * (c / top))) / 2).cast("int"))


_GRAPH = "shard int, band int, size int, mean binary, angle double, low double, high double, edges binary, entry binary, vectors binary, ids binary, starts binary"


def index(vectors: DataFrame, k: int = 20, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", most_shards: int = MOST_SHARDS) -> DataFrame:
    """A table of graphs, a row a shard: its nodes' vectors and ids, edges, mean and bounds."""
    return _graphs(usable(vectors, id_col, vector_col), k, shard_rows, most_shards)


def _graphs(rows: DataFrame, k: int, shard_rows: int, most_shards: int) -> DataFrame:
    rows = rows.withColumn("node", F.xxhash64("v"))
    w = Window.partitionBy("node", "v").orderBy("vec_id")
    some = rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= k + 1)
    nodes = materialize(some.groupBy("band", "node", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    sizes = {r["band"]: r["count"] for r in nodes.groupBy("band").count().collect()}  # of powers of two: 2,100 at most
    shard_rows = max(shard_rows, -(-sum(sizes.values()) // most_shards))
    wanted = {band: -(-n // shard_rows) for band, n in sizes.items()}
    pivots: dict[int, np.ndarray] = {}
    if many := {b: n for b, n in wanted.items() if n > 1}:
        drawn = _drawn(nodes, sizes, many).toArrow()
        bands, turns, flat = drawn.column("band").to_numpy(), drawn.column("turn").to_numpy(), _matrix(drawn.column("v").combine_chunks())
        for b, n in many.items():
            least = np.flatnonzero(bands == b)
            least = least[np.argsort(turns[least], kind="stable")][:n]
            if len(least):
                pivots[b] = _directions(np.ldexp(flat[least], -b))
    held = rows.sparkSession.sparkContext.broadcast(pivots)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, cell = batch.column("band").to_numpy(), np.zeros(batch.num_rows, np.int32)
            x = _matrix(batch.column("v"))
            for b in np.unique(band):
                if int(b) in held.value:
                    cell[band == b] = (np.ldexp(x[band == b], -int(b)) @ held.value[int(b)].T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    celled = materialize(nodes.mapInArrow(dealt, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in nodes.schema)}, cell int"))
    cells = celled.groupBy("band", "cell").count().orderBy("band", "cell").collect()  # one a pivot at most
    if not cells:
        return rows.sparkSession.createDataFrame([], _GRAPH)
    splits = [-(-r["count"] // shard_rows) for r in cells]
    base = np.concatenate([[0], np.cumsum(splits)])
    numbered = rows.sparkSession.createDataFrame([(r["band"], r["cell"], int(b), s) for r, b, s in zip(cells, base, splits)], "band int, cell int, base int, splits int")
    placed = celled.join(F.broadcast(numbered), ["band", "cell"]).withColumn("shard", (F.col("base") + F.pmod(F.xxhash64("node", F.lit(5)), F.col("splits"))).cast("int"))
    placed = placed.select("shard", "band", "node", "v", "ids").repartitionById(int(base[-1]), "shard").sortWithinPartitions("shard", "node", "v")
    return materialize(placed.mapInArrow(_builder, _GRAPH))


def _drawn(nodes: DataFrame, sizes: dict[int, int], wanted: dict[int, int]) -> DataFrame:
    """(band, turn, v) of the nodes whose hash is low enough for a few more than the wanted ones of their band to be so: a filter alone, without a shuffle."""
    few = {b: -(2**63) + min(2**64 - 1, (n + 4 * int(n**0.5) + 8) * 2**64 // sizes[b]) for b, n in wanted.items()}
    most = F.element_at(F.create_map(*(F.lit(x) for kv in few.items() for x in kv)).cast("map<int,bigint>"), F.col("band"))
    return nodes.filter(F.col("band").isin(*few)).withColumn("turn", F.xxhash64("node", F.lit(3))).filter(F.col("turn") <= most).select("band", "turn", "v")


def _directions(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of batches that are sorted by key, each of one key."""
    for batch in batches:
        keys = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield int(keys[a]), batch.slice(a, b - a)


def _builder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []
    for shard, part in _runs(batches, "shard"):
        if held and shard != now:
            yield _built(now, held)
            held = []
        now = shard
        held.append(part)
    if held:
        yield _built(now, held)


def _augmented(plain: np.ndarray, band: int) -> np.ndarray:
    """Vectors scaled to a largest norm of 1, with the component that makes all of length 1."""
    x = np.ldexp(plain, -band)
    x /= np.linalg.norm(x, axis=1).max()
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - np.einsum("nd,nd->n", x, x)))[:, None]])


def _single(x: np.ndarray) -> np.ndarray:
    """Centred and scaled, in single precision."""
    x = x - x.mean(axis=0)
    return (x / max(float(np.abs(x).max()), 1e-300)).astype(np.float32)


def _built(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    band = parts[0].column("band")[0].as_py()
    plain = np.vstack([_matrix(p.column("v")) for p in parts])
    edges, entry = build(_single(_augmented(plain, band)))
    ids = pa.concat_arrays([p.column("ids") for p in parts])
    starts = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))]).astype(np.int64)
    x = np.ldexp(plain, -band)
    norms, mean = np.linalg.norm(x, axis=1), x.mean(axis=0)
    cosine = _directions(x) @ (mean / max(float(np.linalg.norm(mean)), 1e-300))
    row = {
        "shard": pa.array([shard], pa.int32()), "band": pa.array([band], pa.int32()), "size": pa.array([len(x)], pa.int32()), "mean": pa.array([mean.tobytes()]),
        "angle": pa.array([float(np.arccos(np.clip(cosine.min(), -1, 1)))]), "low": pa.array([float(norms.min())]), "high": pa.array([float(norms.max())]),
        "edges": pa.array([edges.astype(np.int32).tobytes()]), "entry": pa.array([entry.astype(np.int64).tobytes()]), "vectors": pa.array([plain.tobytes()]),
        "ids": pa.array([np.asarray(ids.flatten()).astype(np.int64).tobytes()]), "starts": pa.array([starts.tobytes()]),
    }
    return pa.RecordBatch.from_arrays(list(row.values()), list(row))


class Shards:
    """Means and bounds of all shards, to choose those that a query searches."""

    def __init__(self, rows: pa.Table):
        self.shard, self.size = rows.column("shard").to_numpy(), rows.column("size").to_numpy()
        self._band, self._angle, self._low, self._high = (rows.column(c).to_numpy() for c in ("band", "angle", "low", "high"))
        self._mean = np.array([np.frombuffer(m, np.float64) for m in rows.column("mean").to_pylist()])

    def first(self, q: np.ndarray, k: int) -> np.ndarray:
        """(b, shards) of those searched first: the nearest by their mean, PROBES or as many as hold 4 k nodes."""
        with np.errstate(over="ignore"):
            order = np.argsort(-np.ldexp(q @ self._mean.T, self._band), axis=1, kind="stable")
        before = np.cumsum(self.size[order], axis=1) - self.size[order]
        taken = (np.arange(order.shape[1]) < PROBES) | (before < 4 * k)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, taken, axis=1)
        return out

    def bound(self, q: np.ndarray) -> np.ndarray:
        """(b, shards): no inner product of the query with a vector of the shard is larger."""
        own, means = np.linalg.norm(q, axis=1), np.linalg.norm(self._mean, axis=1)
        cosine = (q @ self._mean.T) / np.maximum(own[:, None] * means, 1e-300)
        least = np.maximum(0.0, np.arccos(np.clip(cosine, -1, 1)) - self._angle - 1e-6)
        with np.errstate(over="ignore"):
            return np.ldexp(own[:, None] * (np.cos(least) + 1e-9) * np.where(np.cos(least) > 0, self._high, self._low), self._band)


def search(vectors: DataFrame, queries: Column, k: int = 20, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = QUERY_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row for which ``queries`` (over vec_id) holds, itself left out."""
    rows = usable(vectors, id_col, vector_col)
    graphs = _graphs(rows, k, shard_rows, MOST_SHARDS)
    shards = graphs.select("shard", "band", "size", "mean", "angle", "low", "high").orderBy("shard").toArrow()
    asked = materialize(rows.filter(queries).select(F.col("vec_id").alias("query_id"), "v"))
    if not shards.num_rows or asked.isEmpty():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    known = rows.sparkSession.sparkContext.broadcast(Shards(shards))

    def routed(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    q, all_shards = _matrix(part.column("v")), known.value
                    some = all_shards.first(q, k)
                    if not first:
                        with np.errstate(invalid="ignore"):
                            some = ~some & (all_shards.bound(q) >= np.asarray(part.column("least").fill_null(-np.inf))[:, None])
                    which, shard = np.nonzero(some)
                    taken = part.take(pa.array(which))
                    yield pa.RecordBatch.from_arrays([taken.column("query_id"), taken.column("v"), pa.array(all_shards.shard[shard])], ["query_id", "v", "shard"])

        return run

    kind = "query_id long, v array<double>, shard int"
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = materialize(_searched(graphs, asked.mapInArrow(routed(True), kind), k, beam))
    least = found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    more = _searched(graphs, asked.join(least, "query_id", "left").select("query_id", "v", "least").mapInArrow(routed(False), kind), k, beam)
    ranked = found.unionByName(more).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _searched(graphs: DataFrame, pairs: DataFrame, k: int, beam: int) -> DataFrame:
    """(query_id, vec_id, score) of the nodes found in the shards that queries are sent to; those of a shard in groups of about QUERY_ROWS."""
    spark, pairs = graphs.sparkSession, materialize(pairs)
    counts = pairs.groupBy("shard").count().orderBy("shard").collect()  # one a shard at most
    kind = "query_id long, vec_id long, score double"
    if not counts:
        return spark.createDataFrame([], kind)
    groups = [-(-r["count"] // QUERY_ROWS) for r in counts]
    base = np.concatenate([[0], np.cumsum(groups)])
    numbered = F.broadcast(spark.createDataFrame([(r["shard"], int(b), g) for r, b, g in zip(counts, base, groups)], "shard int, base int, groups int"))
    each = F.explode(F.sequence(F.col("base"), F.col("base") + F.col("groups") - 1)).alias("part")
    content = ("edges", "entry", "vectors", "ids", "starts")
    stored = graphs.join(numbered, "shard").select(each, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), "band", *content)
    part = (F.col("base") + F.pmod(F.xxhash64("query_id", "v"), F.col("groups"))).cast("int").alias("part")
    sent = pairs.join(numbered, "shard").select(part, F.lit(1).alias("kind"), "query_id", "v", F.lit(None).cast("int").alias("band"), *(F.lit(None).cast("binary").alias(c) for c in content))
    dealt = stored.unionByName(sent).repartitionById(int(base[-1]), "part").sortWithinPartitions("part", "kind", "query_id")
    return dealt.mapInArrow(_searcher(k, beam), kind).filter("query_id <> vec_id")


def _searcher(k: int, beam: int):
    def found(graph, batch: pa.RecordBatch) -> pa.RecordBatch:
        (x, edges, entry, plain, ids, starts), q = graph, _matrix(batch.column("v"))
        query = np.asarray(batch.column("query_id"))
        turned = np.hstack([q / np.abs(q).max(axis=1, keepdims=True), np.zeros((len(q), 1))]).astype(np.float32)
        nodes, _ = beam_search(Inner(x, turned), edges, entry, len(q), max(beam, k + 1))
        nodes = nodes[:, : k + 1]
        at, place = np.nonzero(nodes >= 0)
        node = nodes[at, place]
        with np.errstate(over="ignore"):
            score = np.einsum("md,md->m", q[at], plain[node])
        many = starts[node + 1] - starts[node]
        own = ids[np.repeat(starts[node] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(query[at], many)), pa.array(own), pa.array(np.repeat(score, many))], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = None
        for batch in batches:
            for kind, part in _runs(iter([batch]), "kind"):
                if kind == 0:
                    graph = _loaded(part.slice(part.num_rows - 1))
                else:
                    for at in range(0, part.num_rows, 512):
                        yield found(graph, part.slice(at, 512))

    return run


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _loaded(row: pa.RecordBatch):
    edges, entry, vectors, ids, starts = (row.column(c)[0].as_py() for c in ("edges", "entry", "vectors", "ids", "starts"))
    starts = np.frombuffer(starts, np.int64)
    plain = np.frombuffer(vectors, np.float64).reshape(len(starts) - 1, -1)
    x = _single(_augmented(plain, row.column("band")[0].as_py()))
    return x, np.frombuffer(edges, np.int32).reshape(len(plain), -1).astype(np.int64), np.frombuffer(entry, np.int64), plain, np.frombuffer(ids, np.int64), starts
