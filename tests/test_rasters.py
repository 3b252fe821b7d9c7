"""Rasters against numpy."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import rasters


def test_mask_metrics(spark):
    mask = np.zeros((40, 60), bool)
    mask[10:20, 0:8] = True
    full, none = np.ones((5, 6), bool), np.zeros((4, 4), bool)
    rows = spark.createDataFrame([(k, m.tolist()) for k, m in enumerate((mask, full, none))], "k int, m array<array<boolean>>")
    a, b, c = (r["x"] for r in rows.select("k", rasters.mask_metrics("m").alias("x")).orderBy("k").collect())
    assert (a["pixel_count"], a["bbox"], a["border_sides"], a["centroid"]) == (80, [0, 10, 7, 19], ["left"], [3.5, 14.5])
    assert a["edge_contact_pixels"] == 20 and a["bbox_fill_fraction"] == 1.0 and not a["touches_opposite_borders"]
    assert b["clipped_sides_count"] == 4 and b["touches_opposite_borders"] and b["edge_contact_pixels"] == 30 - 1 * 2
    assert c["pixel_count"] == 0 and c["bbox"] is None and c["border_sides"] == []


def test_changed_mask(spark):
    rnd = np.random.default_rng(1)
    base, marked = rnd.integers(0, 3, (12, 15)), rnd.integers(0, 3, (12, 15))
    changed = base != marked
    grown = seed = changed & (marked == 2)
    for _ in range(2):
        p = np.pad(grown, 1)
        grown = np.any([p[y : y + 12, x : x + 15] for y in range(3) for x in range(3)], axis=0)
    df = spark.createDataFrame([(base.tolist(), marked.tolist())], "a array<array<int>>, b array<array<int>>")
    r = df.select(rasters.changed_mask("a", "b", 2).alias("m"), rasters.dominant_change("a", "b").alias("c")).first()
    assert np.array_equal(np.array(r["m"]), seed | (changed & grown))
    colours, n = np.unique(marked[changed], return_counts=True)
    assert r["c"] == colours[n.argmax()]


def test_depth_grid(spark):
    rnd = np.random.default_rng(2)
    depth = rnd.uniform(-5, 130, (11, 10))
    depth[0, 0], depth[5, 5] = np.nan, np.inf
    clean = np.clip(np.where(np.isfinite(depth), depth, 100.0), 0, 100)
    expected = [[round(float(c.min()), 1) for c in np.array_split(r, 3, axis=1)] for r in np.array_split(clean, 3, axis=0)]
    df = spark.createDataFrame([(depth.tolist(),)], "d array<array<double>>")
    assert np.allclose(df.select(rasters.depth_grid("d").alias("g")).first()["g"], expected, atol=0.051)


def test_difference_hash(spark):
    grey = np.random.default_rng(3).integers(0, 255, (8, 9))
    bits = int("".join(str(int(b)) for b in (grey[:, 1:] > grey[:, :-1]).ravel()), 2)
    got = spark.createDataFrame([(grey.tolist(),)], "g array<array<int>>").select(rasters.difference_hash("g").alias("h")).first()["h"]
    assert got & (1 << 64) - 1 == bits


def test_standoff_and_keyframes(spark):
    row = spark.range(1).select(rasters.standoff_poses(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), [5.0], [0.0, 2.0], 4).alias("p"), rasters.keyframes(F.lit(50), F.lit(10), F.lit(30), 8).alias("k")).first()
    assert len(row["p"]) == 8 and abs(row["p"][0]["x"] - 6.0) < 1e-9 and abs(abs(row["p"][0]["yaw"]) - 180) < 1e-9
    assert row["k"] == [0, 9, 10, 11, 29, 30, 31, 49]
