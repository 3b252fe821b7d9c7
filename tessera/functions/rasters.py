"""Columns over small rasters held as nested arrays: masks, segmentations, depth images, grey images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import col


def _count(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, v: s + v.cast("int"))


def mask_metrics(mask: Column | str, band: int = 2) -> Column:
    """Size, pixels, box, centroid, touched sides and edge contact of a mask, an array of rows of booleans.

    An empty mask has no box and no centroid; a side is touched if a pixel lies
    within ``band`` of it.
    """
    m = col(mask)
    high, wide = F.size(m), F.size(F.element_at(m, 1))
    rows = F.transform(m, _count)
    columns = F.transform(F.sequence(F.lit(0), wide - 1), lambda x: F.aggregate(m, F.lit(0), lambda s, r: s + F.element_at(r, x + 1).cast("int")))
    pixels = F.aggregate(rows, F.lit(0), lambda s, v: s + v)
    at = lambda a: F.filter(F.transform(a, lambda v, k: F.when(v > 0, k)), lambda k: k.isNotNull())
    x0, x1, y0, y1 = F.array_min(at(columns)), F.array_max(at(columns)), F.array_min(at(rows)), F.array_max(at(rows))
    mean = lambda a: F.try_divide(F.aggregate(F.transform(a, lambda v, k: v * k), F.lit(0), lambda s, v: s + v), pixels)
    left, right, top, bottom = x0 < band, x1 >= wide - band, y0 < band, y1 >= high - band
    sides = F.array_compact(F.array(F.when(left, "left"), F.when(right, "right"), F.when(top, "top"), F.when(bottom, "bottom")))
    near_x = lambda x: (x < band) | (x >= wide - band)
    near_y = lambda y: (y < band) | (y >= high - band)
    edge = F.aggregate(
        F.transform(m, lambda r, y: F.when(near_y(y), _count(r)).otherwise(_count(F.transform(r, lambda v, x: v & near_x(x))))),
        F.lit(0),
        lambda s, v: s + v,
    )
    w, h = F.coalesce(x1 - x0 + 1, F.lit(0)), F.coalesce(y1 - y0 + 1, F.lit(0))
    return F.struct(
        high.alias("height"), wide.alias("width"), pixels.cast("long").alias("pixel_count"), (pixels / (high * wide)).alias("pixel_fraction"),
        F.when(pixels > 0, F.array(x0, y0, x1, y1)).alias("bbox"), w.alias("bbox_width"), h.alias("bbox_height"), (w * h).cast("long").alias("bbox_area"),
        F.coalesce(F.try_divide(pixels, w * h), F.lit(0.0)).alias("bbox_fill_fraction"), F.when(pixels > 0, F.array(mean(columns), mean(rows))).alias("centroid"),
        sides.alias("border_sides"), F.size(sides).alias("clipped_sides_count"), F.coalesce((left & right) | (top & bottom), F.lit(False)).alias("touches_opposite_borders"),
        edge.cast("long").alias("edge_contact_pixels"), F.coalesce(F.try_divide(edge, pixels), F.lit(0.0)).alias("edge_contact_fraction"),
    )


def changed_mask(baseline: Column | str, marked: Column | str, colour: Column | int, halo: int = 2) -> Column:
    """Pixels that changed to a colour, and changed ones within ``halo`` of them (with diagonals); colours are packed integers."""
    changed = F.zip_with(col(baseline), col(marked), lambda a, b: F.zip_with(a, b, lambda p, q: p != q))
    wanted = F.lit(colour) if isinstance(colour, int) else colour
    seed = F.zip_with(changed, col(marked), lambda c, b: F.zip_with(c, b, lambda x, q: x & (q == wanted)))
    grown = seed
    for _ in range(halo):
        grown = _dilated(grown)
    return F.zip_with(F.zip_with(grown, changed, lambda g, c: F.zip_with(g, c, lambda x, y: x & y)), seed, lambda a, b: F.zip_with(a, b, lambda x, y: x | y))


def _dilated(m: Column) -> Column:
    def around(r: Column) -> Column:
        return F.transform(r, lambda v, x: v | F.coalesce(F.get(r, x - 1), F.lit(False)) | F.coalesce(F.get(r, x + 1), F.lit(False)))

    flat = F.transform(m, around)
    either = lambda a, b: F.zip_with(a, b, lambda x, y: x | F.coalesce(y, F.lit(False)))
    none = F.transform(F.element_at(m, 1), lambda _: F.lit(False))
    return F.transform(flat, lambda r, y: either(either(r, F.coalesce(F.get(flat, y - 1), none)), F.coalesce(F.get(flat, y + 1), none)))


def dominant_change(baseline: Column | str, marked: Column | str) -> Column:
    """The most frequent colour of changed pixels, the smallest of equals; null without changes."""
    new = F.filter(F.flatten(F.zip_with(col(baseline), col(marked), lambda a, b: F.zip_with(a, b, lambda p, q: F.when(p != q, q)))), lambda q: q.isNotNull())
    counted = F.transform(F.array_distinct(new), lambda c: F.struct(F.size(F.filter(new, lambda v: v == c)).alias("n"), (-c).alias("c")))
    return -F.array_max(counted)["c"]


def depth_grid(depth: Column | str, n: int = 3, most: float = 100.0) -> Column:
    """An n x n grid of the least depth in each part, rounded to a tenth; values that are not finite count as ``most``, all are clipped to 0..most.

    The first parts of an uneven split are one longer.
    """
    clean = F.transform(col(depth), lambda r: F.transform(r, lambda v: F.when(F.isnan(v) | F.isnull(v) | (F.abs(v) == float("inf")), most).otherwise(F.least(F.lit(most), F.greatest(F.lit(0.0), v)))))

    def parts(a: Column) -> Column:
        size, extra = F.floor(F.size(a) / n).cast("int"), F.size(a) % n
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(a, k * size + F.least(k, extra) + 1, size + F.when(k < extra, 1).otherwise(0)))

    return F.transform(parts(clean), lambda rows: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.round(F.array_min(F.transform(rows, lambda r: F.array_min(F.element_at(parts(r), k + 1)))), 1)))


def difference_hash(grey: Column | str) -> Column:
    """64 bits of an 8 x 9 grey image: whether each pixel is darker than its right neighbour, first row in the highest bits."""
    bits = F.flatten(F.transform(col(grey), lambda r: F.zip_with(F.slice(r, 1, 8), F.slice(r, 2, 8), lambda a, b: (b > a).cast("long"))))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda s, b: F.shiftleft(s, 1).bitwiseOR(b))


def standoff_poses(target: Column | str, radii: list[float], heights: list[float], azimuths: int) -> Column:
    """Poses (x, y, z, yaw in degrees) around a target that face it: radii by heights by azimuths."""
    x, y, z = (F.element_at(col(target), k) for k in (1, 2, 3))
    steps = [(r, h, 360.0 * k / azimuths) for r in radii for h in heights for k in range(azimuths)]
    grid = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(h).alias("h"), F.lit(a).alias("a")) for r, h, a in steps))
    return F.transform(
        grid,
        lambda s: F.struct(
            (x + s["r"] * F.cos(F.radians(s["a"]))).alias("x"), (y + s["r"] * F.sin(F.radians(s["a"]))).alias("y"), (z + s["h"]).alias("z"), (F.pmod(s["a"] + 360.0, F.lit(360.0)) - 180.0).alias("yaw")
        ),
    )


def keyframes(count: Column, first_reach: Column, closest: Column, most: int) -> Column:
    """Up to ``most`` frame numbers: first, last, first reach and closest with their neighbours by priority, then an even fill; in order."""
    last = count - 1
    wanted = F.array(F.lit(0), last, first_reach, closest, first_reach - 1, closest - 1, first_reach + 1, closest + 1)
    even = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.round(k * last / max(1, most - 1)).cast("int"))
    all_ = F.array_distinct(F.filter(F.concat(wanted, even), lambda k: k.isNotNull() & (k >= 0) & (k <= last)))
    return F.array_sort(F.slice(all_, 1, most))
