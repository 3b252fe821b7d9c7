"""The raster queries over packed rasters: the same results as over nested arrays, and every cell of a grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import packed
from tessera.plans import columns, derived  # noqa: F401  their SQL is registered first
from tessera.plans.base import ORACLES, query, r, table


def _square(n, pick):
    """n lines of n values of ``pick`` (of a place in the vector, from 0)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda y: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: pick(y * n + x)))


def _value(k):
    return F.get("embedding", k)


@query(ORACLES["mask_summaries"])
def packed_masks(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", _square(8, lambda k: _value(k) > F.lit(0.1).cast("float")).alias("m"))
    m = packed.mask_metrics(packed.packed(e, "m", "bits", "m"), "m", "m").filter("m.pixel_count > 0")
    return m.select("vec_id", F.col("m.pixel_count").alias("pixels"), F.col("m.bbox_width").alias("width"), F.col("m.bbox_height").alias("height"), r(F.element_at("m.centroid", 1)).alias("cx"), r(F.element_at("m.centroid", 2)).alias("cy"), F.col("m.edge_contact_pixels").alias("edge"))


@query(ORACLES["changed_pixels"])
def packed_changes(spark, d):
    shade = lambda v: F.floor((v + F.lit(1).cast("float")) * F.lit(6).cast("float")).cast("int")
    image = lambda pick: _square(6, lambda k: shade(pick(k)))
    e = table(spark, d, "embeddings").select("vec_id", image(_value).alias("a"), image(lambda k: F.when(_value(k + 1) > F.lit(0.1).cast("float"), _value(k + 1)).otherwise(_value(k))).alias("b"))
    e = packed.packed(packed.packed(e, "a", "i4", "a"), "b", "i4", "b")
    e = packed.changed_mask(packed.dominant_change(e, "a", "b", "colour"), "a", "b", "colour", "mask")
    return packed.pixel_count(e, "mask", "pixels").select("vec_id", "colour", "pixels")


@query("""WITH v AS (SELECT vec_id, k // 8 AS y, k % 8 AS x, CAST(CASE WHEN k % 11 = 5 THEN 100 ELSE greatest(0, least(100, embedding[k + 1] * 100)) END AS DOUBLE) AS depth FROM embeddings, range(64) t(k)),
    g AS (SELECT vec_id, CASE WHEN y < 3 THEN 0 WHEN y < 6 THEN 1 ELSE 2 END AS gy, CASE WHEN x < 3 THEN 0 WHEN x < 6 THEN 1 ELSE 2 END AS gx, round(min(depth), 1) AS least FROM v GROUP BY ALL)
    SELECT vec_id, CAST(gy AS INT) AS line, CAST(gx AS INT) AS place, least FROM g""")
def packed_depths(spark, d):
    depth = _square(8, lambda k: F.when(k % 11 == 5, F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))).otherwise((_value(k) * F.lit(100.0).cast("float")).cast("double")))
    g = packed.depth_grid(packed.packed(table(spark, d, "embeddings").select("vec_id", depth.alias("g")), "g", "f8", "g"), "g", "g")
    lines = g.select("vec_id", F.posexplode("g").alias("line", "cells"))
    return lines.select("vec_id", "line", F.posexplode("cells").alias("place", "least"))
