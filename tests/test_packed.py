"""Packed rasters against nested arrays and numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import rasters
from tessera.operators import packed


def _df(spark, images, kind="boolean"):
    return spark.createDataFrame([(k, None if m is None else [None if r is None else list(r) for r in m]) for k, m in enumerate(images)], f"k int, m array<array<{kind}>>")


def test_metrics_equal_those_of_nested_arrays(spark):
    rnd = np.random.default_rng(4)
    masks = [(rnd.random((h, w)) < p).tolist() for h, w, p in ((1, 1, 1), (1, 9, 0.5), (3, 2, 0.4), (5, 6, 1), (4, 4, 0), (13, 17, 0.1), (40, 60, 0.01), (8, 8, 0.3))]
    df = packed.packed(_df(spark, masks), "m", "bits", "p").withColumn("own", rasters.mask_metrics("m"))
    for band in (1, 2):
        got = packed.mask_metrics(df.withColumn("own", rasters.mask_metrics("m", band)), "p", "x", band).orderBy("k").collect()
        for r in got:
            assert r.x.asDict() == r.own.asDict() or all(np.allclose(a, b) if isinstance(a, (float, list)) and a and not isinstance(a[0] if isinstance(a, list) else 0, str) else a == b for a, b in zip(r.x, r.own, strict=True)), r.k
    assert [r.p["data"] for r in df.select("p").limit(1).collect()] == [b"\x80"]


def test_changes_equal_those_of_nested_arrays(spark):
    rnd = np.random.default_rng(5)
    rows = [(rnd.integers(0, 3, s).tolist(), rnd.integers(0, 3, s).tolist(), c) for s, c in (((12, 15), 2), ((1, 1), 0), ((5, 1), 1), ((1, 7), 0), ((6, 6), 9))] + [([[1, 2]], [[1, 2]], 1), ([[1, 2]], [[3]], 1), ([[1, 2]], None, 1)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a array<array<int>>, b array<array<int>>, c int")
    df = df.withColumn("own", rasters.changed_mask("a", "b", F.col("c"))).withColumn("top", rasters.dominant_change("a", "b"))
    for side in "ab":
        df = packed.packed(df, side, "i4", side)
    got = packed.dominant_change(packed.nested(packed.changed_mask(df, "a", "b", "c", "mask"), "mask", "mask"), "a", "b", "colour").orderBy("k").collect()
    for r in got[:6]:
        assert (r.mask, r.colour) == (r.own, r.top), r.k
    assert all(r.mask is None and r.colour is None for r in got[6:])


def test_halo_of_any_width():
    rnd = np.random.default_rng(6)
    for halo in (0, 1, 2, 5, 40):
        m = rnd.random((11, 19)) < 0.02
        want = np.zeros_like(m)
        for y, x in zip(*np.nonzero(m), strict=True):
            want[max(0, y - halo) : y + halo + 1, max(0, x - halo) : x + halo + 1] = True
        assert np.array_equal(packed.grown(m, halo), want)


def test_grids_of_depths(spark):
    rnd = np.random.default_rng(7)
    depth = rnd.uniform(-5, 130, (11, 10))
    depth[0, 0], depth[5, 5] = np.nan, np.inf
    df = packed.packed(_df(spark, [depth.tolist(), [[1.25]], [[float("nan")] * 3] * 3], "double").withColumn("own", rasters.depth_grid("m")), "m", "f8", "m")
    a, b, c = packed.depth_grid(df, "m", "own2").orderBy("k").collect()
    assert a.own2 == a.own and b.own2 == [[1.3, None, None], [None] * 3, [None] * 3] and c.own2 == [[100.0] * 3] * 3
    assert packed.depth_grid(df, "m", "g", n=1).orderBy("k").first().g == [[0.0]]


def test_what_is_no_image(spark):
    df = _df(spark, [None, [], [[]], [[True], [True, False]], [[None]], [None], [[True]]])
    out = packed.mask_metrics(packed.packed(df, "m", "bits", "m"), "m", "k2").orderBy("k").collect()
    assert [r.k2 is None for r in out] == [True] * 6 + [False] and [r.m is None for r in out] == [True] * 6 + [False]
    assert packed.pixel_count(packed.packed(df.limit(0), "m", "bits", "m"), "m", "k").columns == ["m", "k"]


def test_whole_screens(spark):
    """1,080 lines of 1,920 pixels, made in tasks: as masks, colours and depths."""

    kind, arrow = packed.RASTER, to_arrow_type(T._parse_datatype_string(packed.RASTER))

    def made(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                y, x = np.mgrid[:1080, :1920]
                one = {"m": packed.raster((x - 900) ** 2 + (y - 500) ** 2 < (50 + k) ** 2, "bits"), "a": packed.raster(np.zeros((1080, 1920)), "i4"), "b": packed.raster(np.where(x > 1900 - k, 7, 0), "i4"), "d": packed.raster(x / 20 + k, "f4")}
                yield pa.RecordBatch.from_arrays([pa.array([k]), *(pa.array([one[c]], arrow) for c in "mabd")], ["k", *"mabd"])

    df = spark.range(3, numPartitions=1).mapInArrow(made, f"k long, m {kind}, a {kind}, b {kind}, d {kind}").withColumn("c", F.lit(7))
    out = packed.depth_grid(packed.pixel_count(packed.changed_mask(packed.mask_metrics(df, "m", "m"), "a", "b", "c", "b"), "b", "n"), "d", "d").select("k", "m", "n", "d").orderBy("k").collect()
    assert [r.n for r in out] == [(19 + k) * 1080 for k in range(3)] and [r.d[0] for r in out] == [[float(k), 32.0 + k, 64.0 + k] for k in range(3)]
    assert [r.m["bbox_width"] for r in out] == [2 * (50 + k) - 1 for k in range(3)]
