"""Columns over angles, points, boxes and targets."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col


def wrap_degrees(a: Column) -> Column:
    """An angle in [-180, 180): the remainder is floored, not truncated."""
    return F.pmod(a + 180.0, F.lit(360.0)) - 180.0


def angle_difference(a: Column, b: Column) -> Column:
    return wrap_degrees(a - b)


def distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(reduce(add, ((p - q) * (p - q) for p, q in zip(a, b, strict=True))))


def xyz(p: Column | str, n: int = 3) -> list[Column]:
    return [F.try_element_at(col(p), F.lit(k + 1)) for k in range(n)]


def nearest_distance(position: Column | str, targets: Column | str) -> Column:
    """The least Euclidean distance to an array of points; null without targets."""
    return F.array_min(F.transform(col(targets), lambda t: distance(xyz(position), xyz(t))))


def nearest_target(position: Column | str, targets: Column | str) -> Column:
    """(error_3d, error_xy, target) of the target with the least 3-D error, then the least horizontal one."""
    return F.array_min(F.transform(col(targets), lambda t: F.struct(distance(xyz(position), xyz(t)).alias("error_3d"), distance(xyz(position, 2), xyz(t, 2)).alias("error_xy"), t.alias("target"))))


def bearing(position: Column | str, yaw_degrees: Column, targets: Column | str) -> Column:
    """(distance, yaw, pitch) to the target that is least in (distance, |yaw|, |pitch|); angles in degrees, yaw relative to the heading."""

    def one(t: Column) -> Column:
        dx, dy, dz = (q - p for p, q in zip(xyz(position), xyz(t), strict=True))
        flat = F.sqrt(dx * dx + dy * dy)
        yaw, pitch = wrap_degrees(F.degrees(F.atan2(dy, dx)) - yaw_degrees), F.degrees(F.atan2(-dz, flat))
        return F.struct(F.sqrt(flat * flat + dz * dz).alias("distance"), F.abs(yaw).alias("abs_yaw"), F.abs(pitch).alias("abs_pitch"), yaw.alias("yaw"), pitch.alias("pitch"))

    least = F.array_min(F.transform(col(targets), one))
    return F.struct(least["distance"].alias("distance"), least["yaw"].alias("yaw"), least["pitch"].alias("pitch"))


def view_relation(yaw: Column, pitch: Column, fov: float = 90.0) -> Column:
    """behind, outside_horizontal, outside_vertical or inside a square field of view."""
    return F.when(F.abs(yaw) > 90, "behind").when(F.abs(yaw) > fov / 2, "outside_horizontal").when(F.abs(pitch) > fov / 2, "outside_vertical").otherwise("inside")


def in_view(position: Column | str, yaw_degrees: Column, targets: Column | str, fov: float, margin: float = 0.0) -> Column:
    """Whether any target may lie in the horizontal field of view, widened by a margin to 90 degrees at most; true without a pose."""
    half = min(90.0, fov / 2 + margin)

    def one(t: Column) -> Column:
        dx, dy = (q - p for p, q in zip(xyz(position, 2), xyz(t, 2), strict=True))
        return F.abs(wrap_degrees(F.degrees(F.atan2(dy, dx)) - yaw_degrees)) <= half

    return F.coalesce(F.exists(col(targets), one), col(position).isNull() | yaw_degrees.isNull())


def cell(c: list[Column], size: float = 5.0) -> list[Column]:
    return [F.floor(x / size).cast("long") for x in c]


def finite_xyz(p: Column | str) -> Column:
    """Whether the first three components are there and finite."""
    return F.coalesce(reduce(lambda a, b: a & b, (x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")) for x in xyz(p))), F.lit(False))


def euler(x: Column, y: Column, z: Column, w: Column) -> Column:
    """(pitch, roll, yaw) of a quaternion, in radians."""
    return F.struct(
        F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * (w * y - z * x)))).alias("pitch"),
        F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)).alias("roll"),
        F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)).alias("yaw"),
    )


def quaternion_error(p: list[Column], q: list[Column]) -> Column:
    """The angle between two rotations in degrees; their quaternions need not be of length 1."""
    dot = reduce(add, (a * b for a, b in zip(p, q, strict=True)))
    sizes = [F.sqrt(reduce(add, (a * a for a in v))) for v in (p, q)]
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(F.try_divide(dot, sizes[0] * sizes[1])))))


def heading_alignment(yaw: Column, dx: Column, dy: Column) -> Column:
    """Cosine between a heading (radians) and a direction; -1 for no direction."""
    size = F.sqrt(dx * dx + dy * dy)
    return F.when(size > 0, (F.cos(yaw) * dx + F.sin(yaw) * dy) / size).otherwise(-1.0)


def center_offset(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Distance of the centroid from the middle, in shares of width and height."""
    return F.hypot(cx / F.greatest(F.lit(1), width) - 0.5, cy / F.greatest(F.lit(1), height) - 0.5)


def center_offset_pixels(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    """Distance from the middle pixel, each axis by its half length, over the square root of two."""
    x, y = (width - 1) / 2.0, (height - 1) / 2.0
    return F.hypot(F.try_divide(cx - x, x), F.try_divide(cy - y, y)) / math.sqrt(2)


def center_offset_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """(dx, dy, centered, border) of a box's middle in shares; centered within a quarter."""
    dx, dy = (x0 + x1 + 1) / (2.0 * width) - 0.5, (y0 + y1 + 1) / (2.0 * height) - 0.5
    border = (x0 <= 0) | (y0 <= 0) | (x1 >= width - 1) | (y1 >= height - 1)
    return F.struct(dx.alias("dx"), dy.alias("dy"), ((F.abs(dx) <= 0.25) & (F.abs(dy) <= 0.25)).alias("centered"), border.alias("border"))


def scale_box(box: Column | str, sx: Column, sy: Column) -> Column:
    """A box in another image's pixels, rounded half to even."""
    return F.array(*(F.bround(F.element_at(col(box), k + 1) * (sx, sy)[k % 2]).cast("long") for k in range(4)))


def padded_box(box: Column | str, width: Column, height: Column, ratio: float, least: float) -> Column:
    """A box grown on each side by a share of its longer side, ``least`` at least, inside the image."""
    x0, y0, x1, y1 = (F.element_at(col(box), k + 1) for k in range(4))
    pad = F.greatest(F.lit(least), F.greatest(x1 - x0 + 1, y1 - y0 + 1) * ratio)
    return F.array(F.greatest(F.lit(0.0), x0 - pad), F.greatest(F.lit(0.0), y0 - pad), F.least(width.cast("double"), x1 + 1 + pad), F.least(height.cast("double"), y1 + 1 + pad))
