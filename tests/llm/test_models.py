"""Toxicity and quality: held-out accuracy, awkward rows, and that nothing but the text counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bradley_terry, ftrl
from tessera.llm.common import WordHashes, crc_part


def _labelled(spark, n=900, seed=1):
    rnd, docs, labels = random.Random(seed), [], []
    for i in range(n):
        words = [f"w{int(rnd.paretovariate(0.7)) % 600}" for _ in range(rnd.randrange(20, 120))]
        toxic, good = i % 6 == 0, i % 4 != 0
        if toxic:
            for w in rnd.sample(["vile", "rotten", "nasty"], 2):
                words.insert(rnd.randrange(len(words)), w)
        if not good:
            words = [w + rnd.choice("*#$%&") * 3 for w in words]
        docs.append((i, " ".join(words) + ("." if good else ""), "en", "s"))
        labels.append((i, int(good), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def _accuracy(scored, labels, column, held_out, cut):
    rows = scored.join(labels, "doc_id").filter(held_out).select(((F.col("score") >= cut).cast("int") == F.col(column)).cast("int").alias("ok"))
    return rows.agg(F.avg("ok")).first()[0]


def test_toxicity_held_out(spark):
    docs, labels = _labelled(spark)
    weights = ftrl.train(docs, labels, crc_part("doc_id", 5) != 0)
    assert 0 < len(weights.index) < 2_000  # sparse
    assert _accuracy(ftrl.score(docs, weights), labels, "toxic", crc_part("doc_id", 5) == 0, 0.5) > 0.95


def test_quality_held_out(spark):
    docs, labels = _labelled(spark)
    ranking = bradley_terry.train(docs, labels, crc_part("doc_id", 4) != 2)
    assert _accuracy(bradley_terry.score(docs, ranking), labels, "quality", crc_part("doc_id", 4) == 2, bradley_terry.CUT) > 0.97


def test_same_rows_at_any_partitioning(spark):
    docs, labels = _labelled(spark, 200)
    a, b = (ftrl.train(docs.repartition(n), labels.repartition(n), F.lit(True), max_rows=80) for n in (1, 7))
    assert np.array_equal(a.index, b.index) and np.array_equal(a.value, b.value) and a.bias == b.bias
    assert bradley_terry.train(docs.repartition(3), labels, F.lit(True)) == bradley_terry.train(docs, labels.repartition(5), F.lit(True))


def test_awkward_rows(spark, awkward, nothing):
    docs, labels = _labelled(spark, 200)
    weights, ranking = ftrl.train(docs, labels, F.lit(True)), bradley_terry.train(docs, labels, F.lit(True))
    for module, model in ((ftrl, weights), (bradley_terry, ranking)):
        out = module.score(awkward.withColumn("score", F.lit("old")), model)
        assert out.columns == ["doc_id", "text", "lang", "source", "score"]
        rows = out.collect()
        assert len(rows) == 11 and all(0 <= r["score"] <= 1 for r in rows)
        empty = {r["score"] for r in rows if not (r["text"] or "").strip()}
        assert len(empty) == 1
        assert module.score(nothing, model).count() == 0


def test_without_labels(spark, awkward):
    for rows in ([], [(1, 1, 1)], [(1, None, None), (2, 7, 7)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        assert ftrl.score(awkward, ftrl.train(awkward, labels, F.lit(True))).count() == 11
        scores = {round(r["score"], 9) for r in bradley_terry.score(awkward, bradley_terry.train(awkward, labels, F.lit(True))).collect()}
        assert scores == {bradley_terry.CUT}


def test_features_are_n_grams_and_skip_grams():
    h = WordHashes()
    _, one = ftrl.features(["a b c d"], 20, h)
    assert len(one) == 4 + 3 + 2
    owner, at = ftrl.features(["a b", "", "A, b!"], 20, h)
    assert list(owner) == [0, 0, 2, 2, 0, 2] and set(at[owner == 0]) == set(at[owner == 2])


def test_pairwise_loss_orders_the_pairs():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(400, 3))
    y = (x @ [2.0, -1.0, 0.0] + rnd.normal(size=400) * 0.1 > 0).astype(float)
    ranking = bradley_terry.fit(x, y, 20_000)
    assert ((ranking.scores(x) >= bradley_terry.CUT) == (y == 1)).mean() > 0.95


def test_ftrl_equals_its_plain_form(spark):
    """The rule of FTRL-proximal written out feature by feature, over the same examples in the same order."""
    import math

    docs, labels = _labelled(spark, 120)
    got = ftrl.train(docs, labels, F.lit(True), bits=16, epochs=2)
    hashes, alpha, beta, l1 = WordHashes(), 2.0, 1.0, 6.0
    rows = docs.join(labels, "doc_id").select(F.xxhash64("doc_id").alias("turn"), "text", "toxic").orderBy("turn").collect()
    rate = sum(r["toxic"] for r in rows) / len(rows)
    z, n, bias, bias_n = {}, {}, math.log(rate / (1 - rate)), 0.0
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= l1 else (math.copysign(l1, z[k]) - z[k]) / ((beta + math.sqrt(n[k])) / alpha)
    for _ in range(2):
        for r in rows:
            at = sorted(set(ftrl.features([r["text"]], 16, hashes)[1].tolist()))
            w = [weight(k) for k in at]
            g = 1 / (1 + math.exp(-(sum(w) + bias))) - r["toxic"]
            for k, wk in zip(at, w, strict=True):
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / alpha * wk
                n[k] = n.get(k, 0.0) + g * g
            bias_n += g * g
            bias -= 0.02 * g / (1 + math.sqrt(bias_n))
    expected = {k: weight(k) for k in z if weight(k)}
    assert set(got.index.tolist()) == set(expected) and abs(got.bias - bias) < 1e-9
    assert all(abs(v - expected[int(k)]) < 1e-5 for k, v in zip(got.index, got.value, strict=True))


def test_ranking_minimises_the_pairwise_loss():
    """No small change of a weight lowers the loss over the drawn pairs; the cut is the quantile of the share of bad rows."""
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(300, 5))
    y = (x @ np.array([1.0, -2.0, 0.5, 0.0, 0.3]) + rnd.normal(size=300) > 0.2).astype(int)
    ranking = bradley_terry.fit(x, y, pairs=4_000)
    good, bad, draw = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(7)
    d = x[draw.choice(good, 4_000)] - x[draw.choice(bad, 4_000)]
    scale = x.std(axis=0)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + 1e-4 / 2 * ((w * scale) ** 2).sum()
    w = np.array(ranking.weights)
    for k in range(5):
        for step in (1e-3, -1e-3):
            assert loss(w + step * np.eye(5)[k]) > loss(w)
    assert abs((x @ w < ranking.cut).mean() - (y == 0).mean()) < 0.01
    assert abs(ranking.scores(x).round(6)[np.abs(x @ w - ranking.cut).argmin()] - 0.7) < 0.05


@pytest.mark.parametrize("bad", [3, 100, 137])
def test_every_labelled_row_is_in_a_pair(spark, bad):
    """Blocks have rows of both labels and together all rows, however few have one label."""
    rows = spark.createDataFrame([(k * 7919 % 1000, int(k >= bad), [float(k)] * 2) for k in range(240)], "turn long, label int, x array<double>")
    blocks = bradley_terry._blocks(rows, bad, 240 - bad).collect()
    assert all(b["good"] and b["bad"] for b in blocks)
    assert {v for b in blocks for v in (*b["good"], *b["bad"])} == set(map(float, range(240)))


def test_no_text_is_shuffled_for_the_ranking(spark):
    """Features are taken below the join with the labels, and of whole texts."""
    docs, labels = _labelled(spark, 60)
    chosen = labels.select("doc_id", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("turn"))
    found = bradley_terry._featured(docs, chosen)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")
    texts = {r["turn"]: r["text"] for r in docs.select(F.xxhash64("doc_id").alias("turn"), "text").collect()}
    assert {r["turn"]: r["x"] for r in found.collect()} == {k: bradley_terry.features(t) for k, t in texts.items()}
