"""Whitening, centroids and pieces against brute force, the installed library and exact round trips."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import centroids, pieces, registry, whitening

VECTORS = "vec_id long, embedding array<float>, n long, whitened string"
PATH = public_tokenizers.path("piece_bpe_32k.model")


def _rows(n, dims, seed, scale=1.0):
    r = random.Random(seed)
    return [(k, [scale * r.gauss(0, 1 + j) for j in range(dims)], None, "extra") for k in range(n)]


def _awkward(dims):
    same = [0.5] * dims
    return [(1, same, 1, "a"), (1, same, 1, "a"), (None, [0.25] * dims, None, None), (2, None, 1, "a"), (3, [None] + [0.5] * (dims - 1), 1, "a"), (4, [float("nan")] * dims, 1, "a"), (5, [float("-inf")] + [0.0] * (dims - 1), 1, "a"), (6, [], 1, "a"), (7, [1.0], 1, "a")]


def _integers(rows, dims, scale=1024):
    out = []
    for i, v, *_ in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    return out


def _clusters(rows, dims, k=8, rounds=10):
    """Plain: Python's integers, a distance at a time."""
    kept = _integers(rows, dims)
    known = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    c = [x for _, x in known][:k]
    apart = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    near = lambda x: min((apart(x, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            if mine := [x for (_, x), o in zip(kept, of, strict=True) if o == j]:
                c[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    last = [near(x) for _, x in kept]
    spent = [sum(d for d, o in last if o == j) for j in range(len(c))]
    return sorted(((i, o, d, spent[o], sum(spent), tuple(c[o])) for (i, _), (d, o) in zip(kept, last, strict=True)), key=repr)


@pytest.mark.parametrize("scale", [1.0, 60.0])
def test_clusters_equal_plain_ones(spark, scale):
    rows = [*_rows(300, 64, 3, scale), *_rows(40, 64, 3, scale), *_awkward(64)]
    got = centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(5)).collect()
    assert sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got), key=repr) == _clusters(rows, 64)


def test_distances_are_exact_beyond_doubles_and_beyond_64_bits():
    r = np.random.default_rng(1)
    for bits in (10, 24, 27, 31, 40):
        x = r.integers(-(1 << bits), 1 << bits, (50, 64))
        c = r.integers(-(1 << bits), 1 << bits, (5, 64)).tolist()
        want = [[sum((int(a) - b) ** 2 for a, b in zip(row, m, strict=True)) for m in c] for row in x]
        got = centroids.distances(x, c)
        assert [[int(v) for v in row] for row in got] == want
        assert got.dtype == (np.float64 if bits < 22 else np.int64 if bits < 28 else object)


def test_clusters_of_few_equal_and_no_rows(spark):
    few = centroids.cluster(spark.createDataFrame(_awkward(64), VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.cluster) for r in few) == [(0, 2), (1, 0), (1, 0)]
    assert {r.inertia for r in few} == {sum(r.distance for r in few)}
    assert centroids.cluster(spark.createDataFrame([], VECTORS)).count() == 0
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, 1, "a")], VECTORS)).collect()


def test_the_query_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    got = registry.op12_centroids_gemm(spark, folder)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    cursor = db.execute(registry.oracle_sql()["op12_centroids_gemm"])
    names = [c[0] for c in cursor.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


def _whitened(spark, rows, **more):
    return whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(5), **more).collect()


@pytest.mark.parametrize(("dims", "scale"), [(5, 1.0), (20, 1.0), (33, 2e6)])
def test_whitening_equals_plain_numbers(spark, dims, scale):
    rows = [*_rows(400, dims, 5, scale), *_rows(30, dims, 5, scale), *_awkward(dims)]
    kept = _integers(rows, dims)
    x = [[v + 100_000 for v in row] for _, row in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    mean = [Fraction(s, n) for s in sums]
    centred = np.array([[float(v - m) for v, m in zip(row, mean, strict=True)] for row in x])
    values, columns = np.linalg.eigh(centred.T @ centred / n)
    values, columns = values[::-1], columns[:, ::-1]
    got = _whitened(spark, rows)
    assert len(got) == n * min(8, dims) and {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for k, some in by.items():
        assert abs(some[0].explained - values[k - 1] / values.sum()) < 1e-9
        want = sorted((repr(i), sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)), z) for (i, _), row, z in zip(kept, x, (centred @ columns[:, k - 1] / math.sqrt(values[k - 1])).tolist(), strict=True))
        own = sorted((repr(r.vec_id), int(r.deviation), r.whitened) for r in some)
        assert [w[:2] for w in want] == [g[:2] for g in own]
        a, b = (np.array(sorted(abs(t[2]) for t in some)) for some in (want, own))
        assert np.allclose(a, b, atol=1e-8)


def test_tiles_of_any_width_give_one_covariance(spark):
    df = spark.createDataFrame(_rows(257, 19, 8), VECTORS).repartition(3)
    of = whitening.fit(df)
    one = whitening.covariance(df, of, tile=64)
    x = np.array([row for _, row in _integers(_rows(257, 19, 8), 19)], float)
    assert np.allclose(one, np.cov(x.T, bias=True), rtol=1e-12)
    for tile in (1, 4, 16):
        assert np.allclose(whitening.covariance(df, of, tile=tile), one, rtol=1e-12, atol=1e-9)


def test_whitening_of_constant_single_and_no_vectors(spark):
    flat = _whitened(spark, [(k, [float(k % 3), 1.0], 1, "a") for k in range(9)])
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True)} and flat[0].identity_error < 1e-12
    one = _whitened(spark, [(1, [1.0, 2.0], 1, "a")])
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, None, None, 0)] * 2
    assert _whitened(spark, [(1, [], 1, "a"), (2, None, 1, "a")]) == [] == _whitened(spark, [])
    with pytest.raises(Exception, match="too large"):
        _whitened(spark, [(1, [1e30], 1, "a")])


LETTERS = [" ", "  ", "a", "b", "e", "t", "h", "n", "x", "\n", "\t", "▁", "é", "日", "本", "ﷺ", "🙂", "\x00", "1", "2", "=", "-", "ing", "the ", " the", "   ", "\r\n", "Ａ", "aaaa", " " * 15]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pieces_equal_the_library(library):
    r = random.Random(7)
    texts = ["".join(r.choices(LETTERS, k=r.randint(0, 80))) for _ in range(3_000)]
    texts += [" " * n for n in range(70)] + [" " * n + "the" + " " * (n % 19) for n in range(40)] + ["x" * 5_000, "ab" * 3_000, "▁" * 100, "".join(r.choices("abcdefgh0123/+", k=20_000))]
    codec = pieces.codec(PATH)
    got = [ids for k in range(0, len(texts), 700) for ids in codec.encode(texts[k : k + 700])]
    assert [g.tolist() for g in got] == library.encode(texts)
    assert codec.decode(np.concatenate(got).astype(np.int64), np.array([len(g) for g in got])) == library.decode([g.tolist() for g in got])


def test_any_ids_are_decoded_as_by_the_library(library):
    r = random.Random(9)
    ids = [[r.choice([r.randrange(32_000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randint(0, 12))] for _ in range(3_000)]
    ids += [[1, 259, 259], [259, 1, 264], [1, 2], [2, 13, 264]]
    got = pieces.codec(PATH).decode(np.array(sum(ids, []), np.int64), np.array([len(x) for x in ids]))
    assert got == [library.decode(x) for x in ids]


def test_a_whole_text_as_one_word_is_the_same(library):
    codec = pieces.Codec.__new__(pieces.Codec)
    codec.__dict__ |= pieces.codec(PATH).__dict__ | {"_cut": None}
    texts = ["", " ", "the  cat   sat on  thee", "日本 é\n\n x", "a" * 300]
    assert [x.tolist() for x in codec.encode(texts)] == library.encode(texts)


def test_words_that_are_forgotten_are_learnt_again(library, monkeypatch):
    monkeypatch.setattr(pieces, "_REMEMBERED", 50)
    codec = pieces.Codec.__new__(pieces.Codec)
    codec.__dict__ |= pieces.codec(PATH).__dict__ | {"_known": {}}
    r = random.Random(2)
    for _ in range(20):
        texts = [" ".join("".join(r.choices("abcde", k=r.choice([3, 3, 3, 100]))) for _ in range(20)) for _ in range(3)]
        assert [x.tolist() for x in codec.encode(texts)] == library.encode(texts)
        assert all(len(w) <= 64 for w in codec._known)


def _merged(rules, word):
    """Plain: the least rank, the leftmost of equals, one pair at a time."""
    word = list(word)
    while found := min(((rules[pair][0], k) for k, pair in enumerate(zip(word, word[1:])) if pair in rules), default=None):
        k = found[1]
        word[k : k + 2] = [rules[word[k], word[k + 1]][1]]
    return word


def test_rounds_equal_single_merges_with_any_ranks():
    """Merges that lower ranks, and equal ranks: symbols add up, so a pair is known by its sum."""
    for seed in range(60):
        r = random.Random(seed)
        ranks = {n: r.randrange(6) for n in range(2, 14) if r.random() < 0.8}
        rules = {(a, b): (ranks[a + b], a + b) for a in range(1, 14) for b in range(1, 14) if a + b in ranks}
        if not rules:
            continue
        keys = np.array([a << 32 | b for a, b in rules], np.int64)
        merges = pieces.Merges(keys, np.array([v[0] for v in rules.values()]), np.array([v[1] for v in rules.values()]))
        words = [[r.choice([1, 1, 1, 2, 3]) for _ in range(r.randint(1, 30))] for _ in range(40)]
        names, sizes, flat = merges.contract(np.array(sum(words, []), np.int32), np.array([len(w) for w in words]))
        ends = np.cumsum(sizes)
        got = {int(k): flat[a:b].tolist() for k, a, b in zip(names, ends - sizes, ends, strict=True)}
        assert [got[k] for k in range(len(words))] == [_merged(rules, w) for w in words]


def test_columns_awkward_rows_and_wrong_ids(spark, library, awkward, nothing):
    clashing = awkward.selectExpr("doc_id", "text", "1 AS ids", "'x' AS decoded", "lang AS n_tokens")
    back = pieces.decode(pieces.encode(clashing, PATH), PATH)
    assert sorted(back.columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"]
    for r in back.collect():
        assert list(r.ids) == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert pieces.decode(pieces.encode(nothing, PATH), PATH).count() == 0
    assert [r.decoded for r in pieces.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), PATH).collect()] == ["", ""]
    for ids in ([32_000], [-1], [None]):
        with pytest.raises(Exception, match="an id is"):
            pieces.decode(spark.createDataFrame([(ids,)], "ids array<int>"), PATH).collect()


def test_the_queries_digests(spark, library):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = registry.op13_sentencepiece(spark, folder).collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
