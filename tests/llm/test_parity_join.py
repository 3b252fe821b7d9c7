"""The parity-sketch join against all pairs of a small corpus."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import parity_join as P


def brute(rows, width, num, den):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(seed, n):
    """Texts of many lengths with chains of edited copies around the threshold."""
    rnd, rows = random.Random(seed), []
    while len(rows) < n:
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([2, 5, 12, 40, 90, 300]))]
        for _ in range(rnd.choice([1, 1, 3, 8])):
            rows.append((len(rows), " ".join(words)))
            for _ in range(rnd.randrange(1, 1 + max(1, len(words) // 25))):
                words[rnd.randrange(len(words))] = f"w{rnd.randrange(400)}"
    return rows[:n]


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (1, 60)])
def test_components_equal_all_pairs(spark, width, num):
    rows = corpus(width, 260)
    out = P.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, width, num, 100)


def test_a_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = base[:]
        for _ in range(rnd.randrange(8)):
            words[rnd.randrange(120)] = f"e{rnd.randrange(50)}"
        rows.append((i, " ".join(words)))
    out = P.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, 3, 90, 100)


def test_awkward_rows(spark, awkward, nothing):
    out = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in P.jaccard_components(awkward).collect()}
    assert {(1, 6, 1), (2, 6, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 1, 6), (7, 1, 7), (8, 3, 8)} <= out
    assert [r for r in out if r[0] is None] == [(None, 3, None)]  # linked with nothing
    assert P.jaccard_components(awkward).count() == 11  # one row a document, the repeated one too
    assert P.jaccard_components(nothing).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 60), st.sampled_from([(90, 100), (80, 100), (60, 100)]))
def test_similar_sets_share_a_key(shared, left, right, share):
    """No pair at or over the threshold is missed, whatever its sizes."""
    num, den = share
    rnd = np.random.default_rng(shared * 7919 + left * 61 + right)
    both, x, y = (np.sort(rnd.integers(0, 1 << 63, k).astype(np.uint64)) for k in (shared, left, right))
    a, b = np.unique(np.concatenate([both, x])), np.unique(np.concatenate([both, y]))
    n = len(np.intersect1d(a, b))
    if den * n >= num * (len(a) + len(b) - n):
        ends = P.bands(max(len(a), len(b)), num, den)
        assert set(P.sketch_keys(a, num, den, ends)) & set(P.sketch_keys(b, num, den, ends))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 5_000), st.integers(0, 800), st.integers(0, 800))
def test_sketches_never_exceed_the_difference(shared, left, right):
    rnd = np.random.default_rng(shared + left * 3 + right * 5)
    both, x, y = (rnd.integers(0, 1 << 63, k).astype(np.uint64) for k in (shared, left, right))
    a, b = np.unique(np.concatenate([both, x])), np.unique(np.concatenate([both, y]))
    apart = len(np.setxor1d(a, b))
    assert int(np.bitwise_count((P.sketch(a) ^ P.sketch(b)).view(np.uint64)).sum()) <= apart
    wide = [P.wide_sketch(s, 80, 100) for s in (a, b)]
    if all(wide):
        assert P._wide_gap(*wide) <= apart
