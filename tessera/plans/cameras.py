"""Camera transforms of poses made from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import cameras
from tessera.plans.base import query, r, table

_POSE = {"roll": 1, "pitch": 2, "yaw": 3, "x": 4, "y": 5, "z": 6}
_SCALE = {"roll": 600.0, "pitch": 200.0, "yaw": 900.0, "x": 50.0, "y": 50.0, "z": 50.0}


@query(f"""WITH p AS (SELECT vec_id, {", ".join(f"CAST(embedding[{k}] AS DOUBLE) * {_SCALE[n]} AS {n}" for n, k in _POSE.items())} FROM embeddings),
    h AS (SELECT *, cos(radians(roll)) AS cr, sin(radians(roll)) AS sr, cos(radians(pitch)) AS cp, sin(radians(pitch)) AS sp, cos(radians(yaw)) AS cy, sin(radians(yaw)) AS sy, cos(radians(roll / 2)) AS a, sin(radians(roll / 2)) AS b, cos(radians(pitch / 2)) AS c, sin(radians(pitch / 2)) AS d, cos(radians(yaw / 2)) AS e, sin(radians(yaw / 2)) AS f FROM p),
    q AS (SELECT *, e * c * a + f * d * b AS qw, e * c * b - f * d * a AS qx, f * c * b + e * d * a AS qy, f * c * a - e * d * b AS qz FROM h),
    u AS (SELECT *, CASE WHEN qw < 0 THEN -1 ELSE 1 END AS s FROM q)
    SELECT vec_id, round(s * qw, 6) + 0.0 AS w, round(s * qx, 6) + 0.0 AS i, round(s * qy, 6) + 0.0 AS j, round(s * qz, 6) + 0.0 AS k,
    round(-(cy * cp * x + (cy * sp * sr - sy * cr) * y + (cy * sp * cr + sy * sr) * z), 6) + 0.0 AS tx, round(-(sy * cp * x + (sy * sp * sr + cy * cr) * y + (sy * sp * cr - cy * sr) * z), 6) + 0.0 AS ty, round(-(-sp * x + cp * sr * y + cp * cr * z), 6) + 0.0 AS tz,
    round(x, 6) + 0.0 AS px, round(y, 6) + 0.0 AS py, round(z, 6) + 0.0 AS pz, round(degrees(atan2(cp * sr, cp * cr)), 6) + 0.0 AS roll, round(degrees(asin(sp)), 6) + 0.0 AS pitch, true AS undone, true AS inverted FROM u""")
def camera_transforms(spark, d):
    c = F.col
    e = table(spark, d, "embeddings").select("vec_id", *((F.element_at("embedding", k).cast("double") * _SCALE[n]).alias(n) for n, k in _POSE.items()))
    e = e.select("vec_id", F.array("x", "y", "z").alias("p"), cameras.euler_matrix(c("roll"), c("pitch"), c("yaw")).alias("m"))
    e = e.withColumn("q", cameras.matrix_quaternion("m")).withColumn("t", cameras.camera_translation("m", "p"))
    e = e.withColumn("own", cameras.camera_position("q", "t")).withColumn("angles", cameras.matrix_euler(cameras.quaternion_matrix("q"))).withColumn("pose", cameras.rigid("m", "t"))
    sign = F.when(F.get("q", F.lit(0)) < 0, -1.0).otherwise(1.0)
    off = lambda a, n: F.array_max(F.transform(F.flatten(cameras.plus(a, cameras.identity(n), -1.0)), F.abs)) < 1e-9
    at = lambda name, k: r(F.get(name, F.lit(k)))
    return e.select(
        "vec_id", *(r(sign * F.get("q", F.lit(k))).alias(n) for k, n in enumerate("wijk")), *(at("t", k).alias(n) for k, n in enumerate(("tx", "ty", "tz"))), *(at("own", k).alias(n) for k, n in enumerate(("px", "py", "pz"))),
        at("angles", 0).alias("roll"), at("angles", 1).alias("pitch"), off(cameras.product(cameras.rigid_inverse("pose"), "pose"), 4).alias("undone"), off(cameras.product(cameras.inverse("m"), "m"), 3).alias("inverted"),
    )
