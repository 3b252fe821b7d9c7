"""Choices by rule against the plain loops that they stand for."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from tessera.operators import choices


def _representatives(rows, n, priority):
    """rows: (key, scene, target, size, peak, frames); one category."""
    if len(rows) <= n:
        return sorted(r[0] for r in rows)
    by = {r[0]: r for r in rows}
    chosen = [by[k] for k in priority if k in by][:n]
    value = {r[0]: math.log1p(max(0, r[4] or 0)) for r in rows}
    centre = median(value.values())
    spread = max(1.0, max(abs(v - centre) for v in value.values()))
    while len(chosen) < n:
        score = lambda r: (round(sum(w * (r[c] not in {x[c] for x in chosen}) for c, w in ((1, 5.0), (2, 3.0), (3, 2.0))) + round(1 - abs(value[r[0]] - centre) / spread, 12), 12), -(r[5] or 0), r[0])  # noqa: E731, B023
        chosen.append(max((r for r in rows if r not in chosen), key=score))
    return [r[0] for r in chosen]


@pytest.mark.parametrize("seed", range(3))
def test_representatives(spark, seed):
    r = random.Random(seed)
    rows = [(c, f"k{k}", r.choice([None, "s1", "s2", "s3"]), r.choice("abcd"), r.choice(["x", None]), r.choice([None, -5, 0, 3, 50, 900]), r.choice([None, 1, 2])) for c in ("a", None) for k in r.sample(range(500), 25)]
    rows = list({x[1]: x for x in rows}.values()) + [("few", "z2", "s", "t", "u", 1, 1), ("few", "z1", "s", "t", "u", 1, 1)]
    keys = [x[1] for x in rows]
    priority = [*r.sample(keys, 3), "not there", "z2"]
    df = spark.createDataFrame(rows, "category string, key string, scene string, target string, size string, peak long, frames long")
    first = spark.createDataFrame([(k, i) for i, k in enumerate(priority)] + [(priority[0], 99)], "key string, at int")
    got = choices.representatives_by_rule(df, "category", 5, {"scene": 5.0, "target": 3.0, "size": 2.0}, F.col("peak"), "frames", "key", first)
    assert got.columns == [*df.columns, "pick"]
    got = got.collect()
    for c in ("a", None, "few"):
        mine = [x.key for x in sorted((g for g in got if g.category == c), key=lambda g: g.pick)]
        assert mine == _representatives([x[1:] for x in rows if x[0] == c], 5, priority)


def test_diverse(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(k, r.choice(["t1", "t2", None]), r.randrange(6), r.choice([None, "i1", "i2", "i3", "i4"])) for k in range(40)]
        order = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[0]))
        chosen = []
        for strict in (True, False):
            for x in order:
                if len(chosen) < 4 and not (strict and x[1] in [c[1] for c in chosen]) and x[2] not in [c[2] for c in chosen] and x[3] not in [c[3] for c in chosen]:
                    chosen.append(x)
        got = choices.diverse_examples(spark.createDataFrame(rows, "id long, target string, episode long, image string"), ["target", "id"], 4, "target", ["episode", "image"], "id").orderBy("pick").collect()
        assert [g.id for g in got] == [c[0] for c in chosen] and [g.pick for g in got] == list(range(1, len(chosen) + 1))


def test_coverage_of_classes(spark):
    r = random.Random(5)
    actors = [(f"n{k % 12}", r.choice([None, 1.0, 170.29386, 400.0])) for k in range(20)] + [(None, 9.0)]
    rows = [(f"n{r.randrange(14)}", r.choice(["A", "B", None]), k, r.randrange(100)) for k in range(60)] + [(None, "C", 0, 5)]
    own, seen, chosen = {}, set(), []
    for x in sorted(rows, key=lambda x: x[2]):
        own.setdefault(x[0] or "", []).append(x)
    order = sorted(((abs((e or 0.0) - 170.29386), n or "") for n, e in actors), reverse=True)
    for _, n in order:
        if own.get(n) and (own[n][0][1] or n) not in seen:
            seen.add(own[n][0][1] or n)
            chosen.append((n, own[n][0][1] or n, min(x[3] for x in own[n])))
    for _, n in order:
        if own.get(n) and n not in [c[0] for c in chosen]:
            chosen.append((n, own[n][0][1] or n, min(x[3] for x in own[n])))
    got = choices.class_coverage(spark.createDataFrame(actors, "name string, error double"), spark.createDataFrame(rows, "name string, kind string, place int, episode int"), 9, "name", "error", 170.29386, "kind", ["place"], "episode").orderBy("pick").collect()
    assert [(g.name, g.kind, g.episode) for g in got] == chosen[:9]


def test_nothing_to_choose_from(spark):
    df = spark.createDataFrame([], "category string, key string, scene string, peak long, frames long")
    assert choices.representatives_by_rule(df, "category", 3, {"scene": 1.0}, F.col("peak"), "frames", "key").count() == 0
    assert choices.diverse_examples(df, ["key"], 3, "scene", ["peak"], "key").count() == 0
