"""Columns that judge how well a target is seen in a frame."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bins, col, lookup_number


def _by_size(small, mid, big, unknown):
    return field(default_factory=lambda: {"small": small, "mid": mid, "big": big, "unknown": unknown})


@dataclass(frozen=True)
class Policy:
    """Thresholds by size bucket, and what else a clear frame needs. The defaults are fixed values."""

    min_pixels: dict[str, int] = _by_size(96, 160, 256, 160)
    min_short_side: dict[str, int] = _by_size(6, 8, 10, 8)
    strong_pixels: dict[str, int] = _by_size(96, 160, 256, 160)
    preferred_fraction: dict[str, float] = _by_size(0.02, 0.10, 0.25, 0.10)
    min_relative_to_peak: float = 0.12
    max_pixel_fraction: float = 0.75
    max_edge_contact: float = 0.25
    max_clipped_sides: int = 2
    reject_opposite_borders: bool = True
    reject_collided: bool = False
    min_semantic_score: float | None = None
    max_semantic_rank: int | None = None
    weak_needs_semantics: bool = False
    saturating: bool = False
    geometric: bool = False
    weights: dict[str, float] = field(default_factory=lambda: {"occupancy": 0.30, "center": 0.25, "clipping": 0.15, "distance": 0.20, "semantic": 0.10, "mask_density": 0.0})
    near_m: float = 8.0
    far_m: float = 20.0
    center_most: float = 0.55
    semantic_low: float = 0.18
    semantic_high: float = 0.32
    best_within: float | None = None  # None: the first clear frame is taken


def severe_clipping(m: Column, p: Policy) -> Column:
    """Whether the mask m touches too many borders or too much of them, or fills the image."""
    tests = [
        F.coalesce(m["clipped_sides_count"], F.lit(0)) > p.max_clipped_sides,
        F.coalesce(m["edge_contact_fraction"], F.lit(0.0)) > p.max_edge_contact,
        F.coalesce(m["pixel_fraction"], F.lit(0.0)) > p.max_pixel_fraction,
    ]
    if p.reject_opposite_borders:
        tests.append(F.coalesce(m["touches_opposite_borders"], F.lit(False)))
    return reduce(or_, tests)


def clear_reasons(m: Column, size: Column, peak: Column, p: Policy, collided: Column | None = None, score: Column | None = None, rank: Column | None = None) -> Column:
    """Why a frame is not clear, as an array of codes in a fixed order; empty for a clear one."""
    pixels = F.coalesce(m["pixel_count"], F.lit(0))
    short = F.least(F.coalesce(m["bbox_width"], F.lit(0)), F.coalesce(m["bbox_height"], F.lit(0)))
    supported = F.lit(False)
    if score is not None and p.min_semantic_score is not None:
        supported = supported | F.coalesce(score >= p.min_semantic_score, F.lit(False))
    if rank is not None and p.max_semantic_rank is not None:
        supported = supported | F.coalesce(rank <= p.max_semantic_rank, F.lit(False))
    tests = [
        ("too_few_pixels", pixels < lookup_number(p.min_pixels, size)),
        ("bbox_too_thin", short < lookup_number(p.min_short_side, size)),
        ("too_small_relative_to_peak", pixels < F.ceil(F.greatest(F.lit(0), peak) * p.min_relative_to_peak)),
        ("severely_clipped_or_too_close", severe_clipping(m, p)),
        ("candidate_pose_collided", F.coalesce(collided, F.lit(False)) if p.reject_collided and collided is not None else F.lit(False)),
        ("weak_geometry_without_semantic_support", (pixels < lookup_number(p.strong_pixels, size)) & ~supported if p.weak_needs_semantics else F.lit(False)),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def semantic_quality(score: Column, rank: Column, p: Policy) -> Column:
    """The mean of the clipped score and the rank's step; 0.5 with neither."""
    by_score = F.when(score.isNotNull(), _unit((score - p.semantic_low) / max(1e-6, p.semantic_high - p.semantic_low)))
    by_rank = F.when(rank <= 1, 1.0).when(rank <= 3, 0.85).when(rank <= 5, 0.70).when(rank <= 10, 0.45).when(rank.isNotNull(), 0.20)
    both = F.array_compact(F.array(by_score, by_rank))
    return F.when(F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / F.size(both)).otherwise(0.5)


def view_quality(m: Column, size: Column, distance: Column, score: Column, rank: Column, density: Column, p: Policy) -> Column:
    """How recognisable a view is, 0 to 1: a weighted mean of six components."""
    fraction, preferred = F.coalesce(m["pixel_fraction"], F.lit(0.0)), lookup_number(p.preferred_fraction, size)
    rising = F.try_divide(fraction, preferred)
    falling = 1.0 - (fraction - preferred) / (F.greatest(preferred + 1e-6, F.lit(p.max_pixel_fraction)) - preferred)
    occupancy = F.when(preferred <= 0, 0.0).otherwise(_unit(rising if p.saturating else F.when(fraction <= preferred, rising).otherwise(falling)))
    cx, cy = F.try_element_at(m["centroid"], F.lit(1)), F.try_element_at(m["centroid"], F.lit(2))
    wide, high = F.greatest(F.lit(1), F.coalesce(m["width"], F.lit(1))), F.greatest(F.lit(1), F.coalesce(m["height"], F.lit(1)))
    center = F.coalesce(_unit(1.0 - F.hypot(cx / wide - 0.5, cy / high - 0.5) / max(1e-6, p.center_most)), F.lit(0.0))
    center = F.when(m["centroid"].isNull(), 0.0).otherwise(center)
    clipping = _unit(1.0 - 0.15 * F.coalesce(m["clipped_sides_count"], F.lit(0))) * F.when(F.coalesce(m["touches_opposite_borders"], F.lit(False)), 0.5).otherwise(1.0)
    near = F.when(distance.isNull(), 0.5).otherwise(_unit((p.far_m - distance) / max(1e-6, p.far_m - p.near_m)))
    parts = {"occupancy": occupancy, "center": center, "clipping": clipping, "distance": near, "semantic": semantic_quality(score, rank, p), "mask_density": _unit(F.coalesce(density, F.lit(0.0)))}
    weights = {k: max(0.0, p.weights.get(k, 0.0)) for k in parts}
    total = sum(weights.values())
    if not total:
        return F.lit(0.0)
    if p.geometric:
        return F.exp(reduce(add, (weights[k] * F.ln(F.greatest(F.lit(0.02), c)) for k, c in parts.items())) / total)
    return reduce(add, (weights[k] * c for k, c in parts.items())) / total


def visibility_group(clear: Column, pixels: Column, action: Column | str) -> Column:
    """clear, weak or absent, with stop or motion."""
    seen = F.when(clear, "clear").when(pixels > 0, "weak").otherwise("absent")
    return F.concat_ws("_", seen, F.when(col(action) == "stop", "stop").otherwise("motion"))


def failure_class(present: Column, clear: Column, stopped: Column) -> Column:
    """Six classes of failed episodes: what was seen, and whether a stop was ever asked for."""
    seen = F.when(clear, "clear_seen").when(present, "weak_seen").otherwise("never_seen")
    return F.concat_ws("_", seen, F.when(stopped, "stopped").otherwise("no_stop"))


def completeness(reasons: Column, clipping: Column, pixels: Column) -> Column:
    return F.when(pixels <= 0, "absent").when(F.array_contains(reasons, "severely_clipped_or_too_close") | (clipping < 0.7), "clipped").otherwise("complete")


def completeness_by_sides(opposite: Column, sides: Column, present: Column) -> Column:
    return F.when(~present, "absent").when(opposite | (sides >= 2), "clipped").otherwise("complete")


def failure_distance_bucket(distance: Column) -> Column:
    """Half-open bins from the success radius on."""
    return F.when(distance < 20, "within_20").when(distance < 25, "20_25").when(distance < 30, "25_30").when(distance < 40, "30_40").otherwise("40_plus")


def center_bin(offset: Column) -> Column:
    return bins(offset, [(0.15, "center"), (0.35, "middle")], "edge", "absent")
