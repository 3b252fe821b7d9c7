"""Columns over rotations, poses and cameras: matrices as arrays of rows, quaternions as arrays (w, x, y, z), angles in degrees."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col


def matrix(rows: Sequence[Sequence[Column | float]]) -> Column:
    number = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.array(*(F.array(*map(number, row)) for row in rows))


def cell(m: Column, i: int, j: int) -> Column:
    return F.get(F.get(m, F.lit(i)), F.lit(j))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def moved(m: Column | str, v: Column | str) -> Column:
    """A matrix times a vector."""
    return F.transform(col(m), lambda row: dot(row, col(v)))


def transposed(m: Column | str) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(col(m), F.lit(0))) - 1), lambda j: F.transform(col(m), lambda row: F.get(row, j)))


def product(a: Column | str, b: Column | str) -> Column:
    """A matrix times a matrix, of any sizes that fit."""
    turned = transposed(b)
    return F.transform(col(a), lambda row: F.transform(turned, lambda column: dot(row, column)))


def plus(a: Column, b: Column, times: Column | float = 1.0) -> Column:
    """a + times b, of matrices."""
    return F.zip_with(a, b, lambda p, q: F.zip_with(p, q, lambda x, y: x + times * y))


def identity(n: int) -> Column:
    return matrix([[float(i == j) for j in range(n)] for i in range(n)])


def determinant(m: Column) -> Column:
    """Of a 3 x 3 matrix."""
    return reduce(add, (cell(m, 0, j) * (cell(m, 1, (j + 1) % 3) * cell(m, 2, (j + 2) % 3) - cell(m, 1, (j + 2) % 3) * cell(m, 2, (j + 1) % 3)) for j in range(3)))


def inverse(m: Column | str) -> Column:
    """Of a 3 x 3 matrix; null where it has none."""
    m = col(m)
    minor = lambda i, j: cell(m, (i + 1) % 3, (j + 1) % 3) * cell(m, (i + 2) % 3, (j + 2) % 3) - cell(m, (i + 1) % 3, (j + 2) % 3) * cell(m, (i + 2) % 3, (j + 1) % 3)
    det = determinant(m)
    return F.when(det != 0, matrix([[minor(j, i) / det for j in range(3)] for i in range(3)]))


def quaternion_matrix(q: Column | str) -> Column:
    """The rotation of a unit quaternion: I + 2 w K + 2 K K, with K the cross product by (x, y, z)."""
    w, x, y, z = (F.get(col(q), F.lit(k)) for k in range(4))
    k = matrix([[0.0, -z, y], [z, 0.0, -x], [-y, x, 0.0]])
    return plus(plus(identity(3), k, 2 * w), product(k, k), 2.0)


def axis_matrix(axis: int, degrees: Column) -> Column:
    """The rotation about an axis (0, 1, 2 for x, y, z)."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    i, j = (axis + 1) % 3, (axis + 2) % 3
    entry = {(i, i): c, (j, j): c, (i, j): -s, (j, i): s, (axis, axis): 1.0}
    return matrix([[entry.get((a, b), 0.0) for b in range(3)] for a in range(3)])


def euler_matrix(roll: Column, pitch: Column, yaw: Column) -> Column:
    """Roll about x, then pitch about y, then yaw about z."""
    return product(axis_matrix(2, yaw), product(axis_matrix(1, pitch), axis_matrix(0, roll)))


def matrix_euler(m: Column | str) -> Column:
    """(roll, pitch, yaw) of a rotation; at a pitch of 90 degrees either way the yaw is 0."""
    m = col(m)
    down = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cell(m, 2, 0)))
    locked = F.abs(down) == 1
    roll = F.when(locked, F.atan2(-cell(m, 1, 2), cell(m, 1, 1))).otherwise(F.atan2(cell(m, 2, 1), cell(m, 2, 2)))
    yaw = F.when(locked, F.lit(0.0)).otherwise(F.atan2(cell(m, 1, 0), cell(m, 0, 0)))
    return F.array(F.degrees(roll), F.degrees(F.asin(-down)), F.degrees(yaw))


def matrix_quaternion(m: Column | str) -> Column:
    """The unit quaternion of a rotation: with a positive w if the trace is positive, else with a positive part along the largest diagonal."""
    m = col(m)
    d = [cell(m, k, k) for k in range(3)]
    trace = d[0] + d[1] + d[2]
    twist = [cell(m, (k + 2) % 3, (k + 1) % 3) - cell(m, (k + 1) % 3, (k + 2) % 3) for k in range(3)]
    s = 2 * F.sqrt(F.greatest(trace + 1, F.lit(0.0)))
    out = F.when(trace > 0, F.array(s / 4, *(t / s for t in twist)))
    for k in range(3):
        i, j = (k + 1) % 3, (k + 2) % 3
        s = 2 * F.sqrt(F.greatest(1 + d[k] - d[i] - d[j], F.lit(0.0)))
        part = {k: s / 4, i: (cell(m, k, i) + cell(m, i, k)) / s, j: (cell(m, k, j) + cell(m, j, k)) / s}
        first = (d[k] >= d[i]) & (d[k] >= d[j]) if k < 2 else F.lit(True)
        out = out.when(first, F.array(twist[k] / s, *(part[n] for n in range(3))))
    return out


def rigid(rotation: Column | str, translation: Column | str) -> Column:
    """The 4 x 4 matrix of a rotation and a translation after it."""
    rows = F.zip_with(col(rotation), col(translation), lambda row, t: F.concat(row, F.array(t)))
    return F.concat(rows, matrix([[0.0, 0.0, 0.0, 1.0]]))


def rigid_inverse(pose: Column | str) -> Column:
    """The inverse of a 4 x 4 matrix of a rotation and a translation."""
    rows = F.slice(col(pose), 1, 3)
    turned = transposed(F.transform(rows, lambda row: F.slice(row, 1, 3)))
    back = F.transform(moved(turned, F.transform(rows, lambda row: F.get(row, F.lit(3)))), lambda x: -x)
    return rigid(turned, back)


def camera_position(q: Column | str, translation: Column | str) -> Column:
    """Where a camera stands in the world: minus the transposed rotation times its translation."""
    return F.transform(moved(transposed(quaternion_matrix(q)), translation), lambda x: -x)


def camera_translation(rotation: Column | str, position: Column | str) -> Column:
    """The translation of a camera that stands there: minus the rotation times the position."""
    return F.transform(moved(rotation, position), lambda x: -x)
