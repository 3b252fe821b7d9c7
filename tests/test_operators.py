"""Operators on small fixtures, and readers and writers on temporary folders."""

import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.functions import actions, geometry, prompts, text, visibility
from tessera.operators import aggregates, joins, rows, sampling, sequence, stats
from tessera.plans.registry import ORACLES, QUERIES
from tessera.sources import readers, writers
from tessera.streaming import episodes


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_commands(spark):
    texts = ["Forward 3 m.", "TURN RIGHT 30 DEGREE", "go up 3m", "descend 3 metres", "look around", "left turn now", "", None]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(actions.parse_action("t").alias("p")).select("p.*").collect()
    assert [r["action_id"] for r in out] == [1, 3, 4, 5, 0, 2, 0, 0]
    assert [r["matched"] for r in out] == [True] * 4 + [False, True, False, False]
    names = spark.createDataFrame([(n,) for n in actions.ACTIONS], "n string").select(actions.name_to_command("n").alias("c")).collect()
    assert [r["c"] for r in names] == list(actions.COMMANDS)
    with pytest.raises(Exception, match="unknown action"):
        one(spark, actions.name_to_command(F.lit("Hover")))
    v = one(spark, actions.vector_to_name(F.array(*map(F.lit, [0.0, 0, 30.00001, 0, 0, 0, 0, 0]))).alias("a"), actions.vector_to_name(F.array(*map(F.lit, [0.0] * 8))).alias("b"))
    assert (v["a"], v["b"]) == ("Turn Left", None)


def test_angles_wrap_as_floored(spark):
    got = one(spark, *(geometry.wrap_degrees(F.lit(float(a))).alias(f"a{k}") for k, a in enumerate((-190, 190, 180, -180, 540, 0))))
    assert list(got) == [170.0, -170.0, -180.0, -180.0, -180.0, 0.0]


def test_sizes(spark):
    texts = [" small(1*1=1 square)", "mid(2)", " big(3)", "", "rather big", "midsize"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(text.size_bucket("t"), text.size_prefix("t"), text.size_word("t")).collect()
    assert [tuple(r) for r in out] == [("small",) * 3, ("mid",) * 3, ("big",) * 3, ("unknown", "unknown", None), ("big", "unknown", "big"), ("mid", "mid", None)]


def test_prompt(spark):
    d, grid = F.lit(" A Red Car. "), F.array(F.array(F.lit(100.0), F.lit(2.5)), F.array(F.lit(0.0), F.lit(12.25)))
    r = one(spark, prompts.build_prompt(d).alias("a"), prompts.build_prompt(d, F.lit("depth "), F.lit("")).alias("b"), prompts.grid_text(grid).alias("g"))
    assert "find a red car? Choose" in r["a"] and "Target: a red car\n\ndepth\n\nWhat" in r["b"]
    assert r["g"] == "[[100, 2.5],\n [0, 12.25]]"
    assert one(spark, prompts.extract_description(F.lit(r["a"])).alias("d"))["d"] == "a red car"


def test_visibility(spark):
    mask = "struct<pixel_count:long,bbox_width:int,bbox_height:int,clipped_sides_count:int,edge_contact_fraction:double,pixel_fraction:double,touches_opposite_borders:boolean>"
    policy = visibility.Policy(min_pixels={"small": 40, "unknown": 40}, min_short_side={"small": 5, "unknown": 5}, min_relative_to_peak=0.10)
    data = [(3, (0, 0, 0, 0, 0.0, 0.0, False)), (4, (64, 8, 8, 0, 0.0, 0.01, False)), (5, (400, 20, 20, 0, 0.0, 0.04, False)), (6, (10000, 100, 100, 4, 0.08, 1.0, True))]
    df = spark.createDataFrame(data, f"frame long, m {mask}")
    out = {r["frame"]: r["why"] for r in df.select("frame", visibility.clear_reasons(F.col("m"), F.lit("small"), F.lit(400), policy).alias("why")).collect()}
    assert out[4] == [] and out[5] == [] and out[6] == ["severely_clipped_or_too_close"] and out[3][0] == "too_few_pixels"


def test_duplicate_policies(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, True), ("b", 1, True), ("b", 2, True)], "k string, n int, bad boolean")
    pick = lambda policy: {r["k"]: r["n"] for r in rows.dedupe(df, ["k"], ["n"], policy, F.col("bad")).collect()}
    assert pick("first") == {"a": 1, "b": 1} and pick("last") == {"a": 3, "b": 2}
    assert pick("last_success") == {"a": 2, "b": 2} and pick("success_over_error") == {"a": 2, "b": 1}
    with pytest.raises(Exception, match="duplicate key"):
        rows.dedupe(df, ["k"], ["n"], "raise").collect()
    with pytest.raises(ValueError, match="unknown policy"):
        rows.dedupe(df, ["k"], ["n"], "any")


def test_repair_overrides_original(spark):
    original = spark.createDataFrame([("a", True, False), ("b", False, False), ("c", False, True), ("d", True, False)], "k string, hit boolean, err boolean")
    repair = spark.createDataFrame([("a", 1, False, False), ("a", 2, True, True), ("b", 1, True, False)], "k string, n int, hit boolean, err boolean")
    assert {r["k"] for r in joins.excluded_keys(original, repair, "k", F.col("hit"), F.col("err"), ["n"]).collect()} == {"b", "c", "d"}


def test_key_from_path(spark):
    p = ["/x/images/Park/12/0/camera_0/0007.png", "C:\\images\\A\\b\\1\\camera_0\\3.jpg", "/images/A/b/1/other/3.jpg", None]
    out = spark.createDataFrame([(x,) for x in p], "p string").select(rows.key_from_image_path("p").alias("k")).collect()
    assert [r["k"] for r in out] == ["Park::12::0::7", "A::b::1::3", None, None]


def test_longest_runs(spark):
    data = [(1, i, a) for i, a in enumerate("LLRLRRFRL")]
    r = sequence.longest_runs(spark.createDataFrame(data, "e int, i int, a string"), ["e"], ["i"], "a", ["L", "R"]).first()
    assert (r["longest_same"], r["longest_alternating"], r["longest_turn_only"]) == (2, 4, 6)


def test_reachability(spark):
    data = [(1, k, b, x) for k, (b, x) in enumerate([(False, False), (False, True), (True, True), (False, False)])]
    out = sequence.reachability(spark.createDataFrame(data, "e int, i int, barrier boolean, blocked boolean"), ["e"], ["i"], F.col("barrier"), F.col("blocked"), "i").orderBy("i").collect()
    assert [(r["reachable"], r["barrier_at"]) for r in out] == [(True, None), (False, None), (False, None), (False, 2)]


def test_round_robin_equals_going_round(spark):
    rnd = random.Random(2)
    data = [(g, s, i) for i in range(200) for g, s in [(rnd.choice("xy"), rnd.choice("abcd"))]]
    out = sampling.stratified_rounds(spark.createDataFrame(data, "g string, s string, i int"), "g", ["s"], ["i"], {"x": 17, "y": 9}).collect()
    for g, limit in (("x", 17), ("y", 9)):
        strata = {s: [i for gg, ss, i in data if gg == g and ss == s] for s in "abcd"}
        expected = []
        while len(expected) < limit and any(strata.values()):
            for s in "abcd":
                if strata[s] and len(expected) < limit:
                    expected.append(strata[s].pop(0))
        assert [r["i"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["pick"])] == expected


def test_shards_balance(spark):
    df = spark.createDataFrame([(k, c) for k, c in enumerate([9, 7, 6, 5, 5, 4, 2])], "k int, c int")
    load = {}
    for r in sampling.assign_shards(df, "k", "c", 3).collect():
        load[r["shard"]] = load.get(r["shard"], 0) + r["c"]
    assert sorted(load.values()) == [12, 13, 13]


@pytest.mark.parametrize("size", [0.3, 5.0])
def test_nearest_points_equal_all_pairs(spark, size):
    rnd = random.Random(3)
    p = [(i, rnd.uniform(-5, 5), rnd.uniform(-5, 5)) for i in range(80)] + [(900, 1.0, 1.0), (901, 1.0, 1.0)]
    q = [(i, rnd.uniform(-9, 9), rnd.uniform(-9, 9)) for i in range(30)] + [(99, 1.0, 1.0)]
    out = joins.nearest_point(spark.createDataFrame(q, "q int, x double, y double"), spark.createDataFrame(p, "p int, x double, y double"), "q", "p", ["x", "y"], size).collect()
    best = {a: min((math.dist(s, t), b) for b, *t in p) for a, *s in q}
    assert {r["q"]: r["p"] for r in out} == {a: b for a, (_, b) in best.items()}


def test_exact_p(spark):
    def plain(g, l):
        n = g + l
        return 1.0 if not n else min(1.0, 2 * sum(math.comb(n, i) for i in range(min(g, l) + 1)) / 2**n)

    pairs = [(0, 0), (1, 0), (5, 9), (30, 10), (400, 460), (0, 2000)]
    out = spark.createDataFrame(pairs, "g long, l long").select("g", "l", stats.exact_paired_p(F.col("g"), F.col("l")).alias("p")).collect()
    assert all(math.isclose(r["p"], plain(r["g"], r["l"]), rel_tol=1e-9, abs_tol=1e-300) for r in out)


@pytest.mark.parametrize("values", [[3.0, 1.0, 3.0, None, 2.0, 3.0], [float(v % 37) for v in range(900)], [float(v) for v in range(700)], [5.0] * 40, []])
def test_average_ranks(spark, values):
    known = sorted(v for v in values if v is not None)
    expected = sorted((v, known.index(v) + (known.count(v) + 1) / 2) for v in known)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert sorted((r["v"], r["rank"]) for r in stats.average_rank(df, "v", "rank", 20).collect()) == expected


def test_bootstrap_covers_the_mean(spark):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, rnd.gauss(2, 1)) for i in range(400)], "i int, d double")
    r = stats.bootstrap_delta(df, "d", ["i"], samples=400).first()
    assert r["low"] < r["mean"] < r["high"] and 0.1 < r["high"] - r["low"] < 0.4
    ties = stats.bootstrap_delta(df.select("i", (F.col("i") % 2).alias("d")), "d", ["i"], samples=2_000).first()
    assert ties["mean"] == 0.5 and 0.44 < ties["low"] < 0.46 and 0.54 < ties["high"] < 0.56
    with pytest.raises(ValueError):
        stats.bootstrap_delta(df, "d", [])


def test_p_values(spark):
    """Against the normal distribution of the standard library, and Student's by integration."""
    import math

    z = [0.0, 0.3, 1.0, 1.96, 2.999, 3.001, 5.0, -2.5]
    out = spark.createDataFrame([(v,) for v in z], "z double").select("z", stats.normal_p(F.col("z")).alias("p")).collect()
    assert all(math.isclose(r["p"], math.erfc(abs(r["z"]) / math.sqrt(2)), rel_tol=1e-8, abs_tol=1e-15) for r in out)

    def student(t, n):
        x = [i * abs(t) / 20_000 for i in range(20_001)]
        y = [(1 + v * v / n) ** (-(n + 1) / 2) for v in x]
        area = (sum(y) - (y[0] + y[-1]) / 2) * abs(t) / 20_000
        return 1 - 2 * area * math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)

    pairs = [(0.5, 1), (2.0, 3), (-2.1, 10), (1.3, 50), (3.0, 400), (0.0, 5)]
    out = spark.createDataFrame(pairs, "t double, n int").select("t", "n", stats.student_p(F.col("t"), F.col("n")).alias("p")).collect()
    assert all(math.isclose(r["p"], student(r["t"], r["n"]), rel_tol=1e-5, abs_tol=1e-9) for r in out)


def test_cuts_go_up(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)] + [(None,), (float("nan"),)], "v double")
    cuts = aggregates.quantile_cuts(df, "v", [0.5])
    assert cuts == [3.0]
    assert [r[0] for r in df.select(aggregates.quantile_bucket(aggregates.number("v"), [F.lit(c) for c in cuts])).collect()] == [0, 0, 1, 1, 1, None, None]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"k": 1, "s": "x"}\n\n{"k": 2}\n')
    (tmp_path / "in" / "failed_b.jsonl").write_text('{"k": 9}\n')
    df = readers.partitioned_lines(spark, str(tmp_path / "in"), "k long, s string")
    assert {(r["k"], r["scene"]) for r in df.collect()} == {(1, "a"), (2, "a")}
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\nnot json\n{"k": 3}\n')
    from pyspark.sql import types as T

    schema = T.StructType().add("k", "long")
    assert {r["k"] for r in readers.tolerant_json_lines(spark, str(tmp_path / "bad.jsonl"), schema).collect()} == {1, 3}
    with pytest.raises(Exception, match="[Mm]alformed"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    (tmp_path / "lines.txt").write_text("\n".join(f"l{k}" for k in range(1, 2001)))
    numbered = readers.numbered_lines(spark, str(tmp_path / "lines.txt")).collect()
    assert all(r["value"] == f"l{r['line']}" for r in numbered) and len(numbered) == 2000
    (tmp_path / "keys.txt").write_text('# c\n\na::b::c\n{"trajectory_key": "d::e::f"}\n')
    assert {r["key"] for r in readers.key_list(spark, str(tmp_path / "keys.txt")).collect()} == {"a::b::c", "d::e::f"}
    (tmp_path / "lanes.tsv").write_text("l1\t0\ta, b,\nl2\t1\tc\tset.json\n")
    assert [r["scenes"] for r in readers.lanes(spark, str(tmp_path / "lanes.tsv")).orderBy("lane").collect()] == [["a", "b"], ["c"]]
    (tmp_path / "log.txt").write_text("step 5/100\nstep 40/100 x 7/9\n")
    assert readers.progress(spark, str(tmp_path / "log.txt"), 100).first()["step"] == 40
    writers.json_lines(df, str(tmp_path / "out"))
    assert {json.loads(r["value"])["s"] for r in spark.read.text(str(tmp_path / "out")).collect()} == {"x", None}
    with pytest.raises(Exception, match="exists"):
        writers.json_lines(df, str(tmp_path / "out"))
    for _ in range(2):
        done = readers.json_lines(spark, str(tmp_path / "log"), "k long, s string") if (tmp_path / "log").exists() else None
        writers.append_new(df.select("k", "s"), done, ["k"], str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    assert json.loads(writers.manifest(df, {"rows": F.count("*")}, {"by": "test"}).first()["value"]) == {"rows": 2, "by": "test"}


def _stream(spark, folder, rows, schema, build, mode, name):
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        if k == 0:
            src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = build(src).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


def test_streamed_episodes(spark, tmp_path):
    schema = "episode long, step long, action string, value double, collided boolean"
    parts = [[(1, 0, "view", 50.0, False), (1, 1, "click", 40.0, False), (2, 0, "view", 10.0, False)], [(1, 2, "stop", 15.0, False), (2, 1, "move", 30.0, True), (2, 2, "stop", 1.0, False)]]
    out = _stream(spark, tmp_path / "s", parts, schema, lambda s: episodes.episode_state(s, "stop", ["view", "click"], 20.0, 100), "update", "streamed")
    last = {}
    for r in out:
        if r["episode"] not in last or r["steps"] >= last[r["episode"]]["steps"]:
            last[r["episode"]] = r
    assert (last[1]["steps"], last[1]["first_reach"], last[1]["ended"], last[1]["distance"]) == (3, 2, "stop", 35.0)
    assert (last[2]["steps"], last[2]["first_reach"], last[2]["ended"]) == (2, 0, "collision")


def test_streamed_windows(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    parts = [[(at(1), "a", 1.0), (at(4), "a", 3.0), (at(12), "b", 5.0)], [(at(59), "a", 1.0)], [(at(2), "a", 9.0)]]
    out = _stream(spark, tmp_path / "w", parts, "ts timestamp, k string, value double", lambda s: episodes.windowed(s, "ts", ["k"], "10 minutes"), "append", "windows")
    assert all(r["n"] in (1, 2, 3) for r in out)


def test_greedy_choices(spark):
    import pandas as pd

    pdf = pd.DataFrame({"k": range(6), "scene": list("aabbcc"), "target": list("xyxyxy"), "t": [0.1, 0.9, 0.2, 0.3, 0.0, 0.5]})
    rows = spark.createDataFrame(pdf).withColumn("g", F.lit(1))
    picks = sampling.covering(rows, ["g"], 3, {"scene": 5, "target": 3}, "t", "k").orderBy("pick").collect()
    assert [r["k"] for r in picks] == [1, 2, 5]
    few = sampling.best_of_pool(rows, ["g"], 6, ["k"], sampling.unique_first(["scene"], ["t"], "k", 4)).collect()
    assert [r["k"] for r in few] == [0, 2, 4, 1]
    df = spark.createDataFrame([(k, s, c, float(v)) for k, (s, c, v) in enumerate([("small", "p", 1), ("small", "p", 5), ("mid", "p", 9), ("mid", "q", 4), ("mid", "r", 6), ("small", "q", 5)])], "k int, size string, scene string, v double")
    picked = [r["k"] for r in sampling.representatives(df, "v", "size", "scene", "k", 3).collect()]
    assert picked[0] == 1 and len(set(picked)) == 3
    assert [r["k"] for r in sampling.rounds_from_end(df, "scene", ["k"], 4).collect()] == [2, 5, 4, 1]
    some = [r["k"] for r in sampling.subset_in_order(df, "k", 3, 7).collect()]
    assert some == sorted(some) and len(some) == 3
    near = {r["k"]: r["typicality"] for r in sampling.typicality(df, F.col("v"), ["size"]).collect()}
    assert near[1] == 1.0 and near[4] == 1.0 and near[0] < 1


def test_nearest_points_far_away(spark):
    rnd = random.Random(8)
    p = [(i, "a", rnd.gauss(0, 1), rnd.gauss(0, 1), 0.0) for i in range(40)] + [(50, "b", 7.0, 7.0, 7.0), (51, "b", 7.0, 7.0, 7.0), (60, "a", 5000.0, 0.0, 1.0), (61, "a", 4990.0, 99.0, 1.0)]
    q = [(i, "a", rnd.uniform(-9000, 9000), rnd.uniform(-90, 90), rnd.uniform(-2, 2)) for i in range(40)] + [(70, "b", 1e6, 0.0, 0.0), (71, "b", 7.0, 7.0, 7.3), (72, "c", 0.0, 0.0, 0.0)]
    cols = "k string, x double, y double, z double"
    out = joins.nearest_point(spark.createDataFrame(q, f"q int, {cols}"), spark.createDataFrame(p, f"p int, {cols}"), "q", "p", ["x", "y", "z"], 0.05, ["k"]).collect()
    best = {a: min((math.dist(s, t), b) for b, m, *t in p if m == k) for a, k, *s in q if k != "c"}
    assert {r["q"]: r["p"] for r in out} == {a: b for a, (_, b) in best.items()}
    one = joins.nearest_point(spark.createDataFrame([(1, 3.0)], "q int, x double"), spark.createDataFrame([(2, 1.0)], "p int, x double"), "q", "p", ["x"], 0.05).collect()
    assert [(r["q"], r["p"], r["distance"]) for r in one] == [(1, 2, 2.0)]


def test_legacy_vectors(spark):
    from tessera.functions import actions

    rows = [([0.0, 9.0, 0, 0, 0, 0, 0, 0],), ([0.0, 3.0, 0, 0, 0, 0, 0, 0],), ([1.0] + [0.0] * 7,), ([0.0] * 8,), ([0.0, 9.0],), (None,), ([0.0, 3.0000001, 0, 0, 0, 0, 0, 0],), ([0.0, 3.1, 0, 0, 0, 0, 0, 0],), ([None] * 8,)]
    df = spark.createDataFrame([([None if x is None else float(x) for x in r[0]] if r[0] else None,) for r in rows], "v array<double>")
    assert [r.id for r in df.select(actions.legacy_id("v").alias("id")).collect()] == [9, 1, 0, 0, 0, 0, 1, 0, 0]


def test_dearest_order_of_equals(spark, tmp_path):
    spark.createDataFrame([(7, 1, 9.0), (3, 1, 9.0), (5, 1, 9.0), (1, 1, 2.0), (4, 2, None)], "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    assert {r["o_custkey"]: r["best"] for r in QUERIES["best_rows"](spark, str(tmp_path)).collect()} == {1: 3, 2: None}


def test_equal_repairs_go_by_their_place(spark):
    """Of last repairs with one number the first in ``ties`` holds, in whatever order the rows come."""
    original = spark.createDataFrame([("a", False, False)], "k string, hit boolean, err boolean")
    for turned in (False, True):
        rows_ = [("a", 2, True, False, 1), ("a", 2, False, False, 2), ("a", 1, False, False, 0), ("b", 2, False, False, 3), ("b", 2, True, False, 4)]
        repair = spark.createDataFrame(rows_[::-1] if turned else rows_, "k string, n int, hit boolean, err boolean, place int").coalesce(1)
        assert [r["k"] for r in joins.excluded_keys(original, repair, "k", F.col("hit"), F.col("err"), ["n"], ["place"]).collect()] == ["a"]


def test_repairs_of_which_something_is_unknown(spark, tmp_path):
    """As the SQL has them: without a known error none, without a known hit or number only where no other repair is."""
    lines = [
        (1, 1, 1.0, 0.1, 0.0, "N"), (1, 2, 30.0, 0.0, None, "R"),  # tax unknown: no repair, the original's hit holds
        (2, 1, 1.0, 0.0, 0.0, "N"), (2, 3, None, 0.0, 0.0, "R"), (2, 2, 30.0, 0.0, 0.0, "R"),  # the last known hit
        (3, 1, 1.0, 0.1, 0.0, "N"), (3, 2, None, 0.0, 0.0, "R"),  # repaired, by a hit that is unknown
        (4, 1, 1.0, 0.1, 0.0, "N"), (4, None, 30.0, 0.0, 0.0, "R"),  # repaired, by a line without a number
        (5, 1, 1.0, 0.0, None, "N"), (None, 1, 1.0, 0.1, 0.0, "N"),
    ]
    rows_ = [(*line, f"s{n}") for n, line in enumerate(lines)]
    spark.createDataFrame(rows_, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = con.execute(ORACLES["collision_filter"]).fetchall()
    assert sorted((r["key"], r["l_linestatus"]) for r in QUERIES["collision_filter"](spark, str(tmp_path)).collect()) == sorted(want)


def test_added_orders_stand_beside_stored_ones(spark, tmp_path):
    """An added order whose number is taken, and two rows of one number."""
    spark.createDataFrame([(14, "O"), (1000014, "P"), (21, "O"), (21, "P"), (None, "O")], "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    out = QUERIES["upsert_merge"](spark, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, [(14, "F"), (1000014, "F"), (1000014, "P"), (21, "F"), (21, "F"), (None, "O")]))


def test_action_vector_is_made_once(spark):
    """A vector that is computed, not stored, is not computed again for each comparison."""
    rows = spark.createDataFrame([([0.0, 3.0] + [0.0] * 6,), ([0.0, 3.1] + [0.0] * 6,), ([0.0] * 7,), ([None] * 8,), (None,)], "v array<double>")
    out = rows.select(actions.vector_to_name(F.reverse(F.reverse("v"))).alias("name"))
    assert [r["name"] for r in out.collect()] == ["Move Forward", None, None, None, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("reverse(v") <= 1


def _joined_rows(df):
    """Rows that each join of a collected plan has made."""
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if "Join" in name:
                made.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(k) for k in range(node.children().size())]
    return made


def test_nearest_points_meet_few(spark):
    """Of points that lie closer than a cell of the size, what is met to find the nearest ones does not grow with their square; copies of a query each have a row."""
    rnd = random.Random(5)
    p, q = ([(i, rnd.gauss(0, 0.1), rnd.gauss(0, 0.1)) for i in range(n)] for n in (4000, 400))
    q += [(1000 + i, *q[0][1:]) for i in range(5)]
    out = joins.nearest_point(spark.createDataFrame(q, "q int, x double, y double"), spark.createDataFrame(p, "p int, x double, y double"), "q", "p", ["x", "y"], 1.0)
    rows_ = out.collect()
    best = {a: min((math.dist(s, t), b) for b, *t in p) for a, *s in q}
    assert {r["q"]: r["p"] for r in rows_} == {a: b for a, (_, b) in best.items()} and len(rows_) == len(q)
    made = _joined_rows(out)
    assert made and max(made) < 40 * len(p)
