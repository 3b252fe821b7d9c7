"""Rotations and poses against numpy, with every branch of the quaternion."""

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import cameras


def test_matrices_equal_numpy(spark):
    r = np.random.default_rng(3)
    rows = [(r.normal(size=(3, 3)).tolist(), r.normal(size=(3, 4)).tolist(), r.normal(size=3).tolist()) for _ in range(20)]
    df = spark.createDataFrame(rows, "a array<array<double>>, b array<array<double>>, v array<double>")
    for x in df.select("*", cameras.product("a", "b").alias("p"), cameras.moved("a", "v").alias("m"), cameras.inverse("a").alias("i"), cameras.transposed("b").alias("t"), cameras.determinant(F.col("a")).alias("d")).collect():
        assert np.allclose(x.p, np.array(x.a) @ np.array(x.b)) and np.allclose(x.m, np.array(x.a) @ x.v) and np.allclose(x.i, np.linalg.inv(x.a)) and np.allclose(x.t, np.array(x.b).T) and np.isclose(x.d, np.linalg.det(x.a))
    flat = spark.createDataFrame([([[1.0, 2.0, 3.0]] * 3,), (None,)], "a array<array<double>>")
    assert [x.i for x in flat.select(cameras.inverse("a").alias("i")).collect()] == [None, None]


def test_quaternions_and_angles_round_trip(spark):
    r = np.random.default_rng(4)
    q = r.normal(size=(200, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    q = np.vstack([q, np.eye(4), [[0, 0.6, 0.8, 0], [0, 0, 0.6, 0.8], [1e-9, 0, 0, 1]]])
    df = spark.createDataFrame([(row.tolist(),) for row in q], "q array<double>")
    m = df.withColumn("m", cameras.quaternion_matrix("q"))
    e = m.withColumn("e", cameras.matrix_euler("m"))
    at = lambda k: F.get("e", F.lit(k))
    for x in e.select("q", "m", cameras.matrix_quaternion("m").alias("back"), cameras.euler_matrix(at(0), at(1), at(2)).alias("again")).collect():
        turn = np.array(x.m)
        assert np.allclose(turn @ turn.T, np.eye(3), atol=1e-6) and np.isclose(np.linalg.det(turn), 1, atol=1e-6)
        assert np.allclose(np.abs(np.dot(x.back, x.q)), 1, atol=1e-6) and np.allclose(x.again, turn, atol=1e-6)
    locked = spark.range(1).select(cameras.matrix_euler(cameras.euler_matrix(F.lit(30.0), F.lit(90.0), F.lit(0.0))).alias("e")).first().e
    assert np.allclose(np.abs(locked[1]), 90, atol=1e-5)


def test_cameras_stand_where_they_were_put(spark):
    df = spark.range(1).select(cameras.euler_matrix(F.lit(10.0), F.lit(-20.0), F.lit(30.0)).alias("m"), F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("p"))
    x = df.withColumn("t", cameras.camera_translation("m", "p")).select(cameras.camera_position(cameras.matrix_quaternion("m"), "t").alias("own"), cameras.product(cameras.rigid("m", "t"), cameras.rigid_inverse(cameras.rigid("m", "t"))).alias("i")).first()
    assert np.allclose(x.own, [1, 2, 3]) and np.allclose(x.i, np.eye(4))
