"""Operators on rasters of any size, packed into one binary value each, by Arrow kernels.

A raster is (kind, height, width, data): row by row, ``bits`` of a mask eight
pixels a byte (the first in the highest bit), ``i4`` packed colours, ``f4`` or
``f8`` depths, all little-endian. An image of 1,080 lines of 1,920 pixels is a
quarter of a megabyte as a mask and 8 MB as colours; inside a task one image at a
time is unpacked, beside an Arrow batch (its bytes are bounded by
``spark.sql.execution.arrow.maxBytesPerBatch``).

Defined results: null rasters give null; images without pixels, lists of unequal
length and lists with nulls make no raster (null); two rasters of different size
have no difference (null). Each operator adds one column, which takes the place of
another of its name; further columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

RASTER = "struct<kind:string,height:int,width:int,data:binary>"
_METRICS = (
    "struct<height:int,width:int,pixel_count:long,pixel_fraction:double,bbox:array<int>,bbox_width:int,bbox_height:int,bbox_area:long,bbox_fill_fraction:double,"
    "centroid:array<double>,border_sides:array<string>,clipped_sides_count:int,touches_opposite_borders:boolean,edge_contact_pixels:long,edge_contact_fraction:double>"
)


def image(kind: str, height: int, width: int, data: bytes) -> np.ndarray:
    """A raster as an array of two dimensions: booleans, or numbers of its kind."""
    if kind == "bits":
        return np.unpackbits(np.frombuffer(data, np.uint8), count=height * width).view(bool).reshape(height, width)
    return np.frombuffer(data, f"<{kind}").reshape(height, width)


def raster(a: np.ndarray, kind: str) -> dict:
    data = np.packbits(a) if kind == "bits" else np.ascontiguousarray(a, f"<{kind}")
    return {"kind": kind, "height": a.shape[0], "width": a.shape[1], "data": data.tobytes()}


def _images(column: pa.Array) -> Iterator:
    """The images of a column of rasters, one at a time; plain values of any other column."""
    for value in column:
        row = value.as_py()
        yield row if not isinstance(row, dict) else image(**row) if row["data"] is not None else None


def _added(df: DataFrame, out: str, kind: str, kernel: Callable[..., pa.Array | list], *columns: str) -> DataFrame:
    """Adds a column: ``kernel`` of the Arrow columns of each batch."""
    kept = [f for f in df.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T._parse_datatype_string(kind))])
    arrow, names = to_arrow_type(schema[out].dataType), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = kernel(*(batch.column(c) for c in columns))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made if isinstance(made, pa.Array) else pa.array(made, arrow)], [*names, out])

    return df.mapInArrow(run, schema)


def _each(df: DataFrame, out: str, kind: str, made: Callable, *columns: str) -> DataFrame:
    """Adds ``made`` of the images and values of each row; null where the first is."""

    def kernel(*given: pa.Array) -> list:
        return [None if row[0] is None else made(*row) for row in zip(*map(_images, given), strict=True)]

    return _added(df, out, kind, kernel, *columns)


def packed(df: DataFrame, nested: str, kind: str, out: str) -> DataFrame:
    """A raster of nested arrays, a list for each line."""

    def kernel(lines: pa.Array) -> list:
        made, values = [], lines.flatten().flatten()
        flat = np.asarray(values.cast({"bits": pa.bool_(), "i4": pa.int32()}.get(kind, pa.float64())).to_numpy(zero_copy_only=False))
        wide = np.asarray(pc.fill_null(pc.list_value_length(lines.flatten()), -1), np.int64)
        nulls = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
        row, at = 0, 0
        for high in pc.fill_null(pc.list_value_length(lines), 0).to_pylist():
            widths, start = wide[row : row + high], at
            row, at = row + high, at + int(widths.clip(0).sum())
            whole = high > 0 and widths[0] > 0 and (widths == widths[0]).all() and nulls[at] == nulls[start]
            made.append(raster(flat[start:at].reshape(high, widths[0]), kind) if whole else None)
        return made

    return _added(df, out, RASTER, kernel, nested)


def nested(df: DataFrame, raster_: str, out: str, kind: str = "bits") -> DataFrame:
    """Nested arrays of a raster, for small ones."""
    of = {"bits": "boolean", "i4": "int"}.get(kind, "double")
    return _each(df, out, f"array<array<{of}>>", lambda a: a.tolist(), raster_)


def _metrics(m: np.ndarray, band: int) -> dict:
    high, wide = m.shape
    rows, columns = m.sum(axis=1, dtype=np.int64), m.sum(axis=0, dtype=np.int64)
    pixels = int(rows.sum())
    out = {"height": high, "width": wide, "pixel_count": pixels, "pixel_fraction": pixels / (high * wide), "bbox": None, "bbox_width": 0, "bbox_height": 0, "bbox_area": 0, "bbox_fill_fraction": 0.0, "centroid": None}
    out |= {"border_sides": [], "clipped_sides_count": 0, "touches_opposite_borders": False, "edge_contact_pixels": 0, "edge_contact_fraction": 0.0}
    if not pixels:
        return out
    (y0, y1), (x0, x1) = (np.flatnonzero(a)[[0, -1]].tolist() for a in (rows, columns))
    w, h = x1 - x0 + 1, y1 - y0 + 1
    sides = [name for name, met in (("left", x0 < band), ("right", x1 >= wide - band), ("top", y0 < band), ("bottom", y1 >= high - band)) if met]
    edge = pixels - int(m[band : max(band, high - band), band : max(band, wide - band)].sum())
    return out | {
        "bbox": [x0, y0, x1, y1], "bbox_width": w, "bbox_height": h, "bbox_area": w * h, "bbox_fill_fraction": pixels / (w * h),
        "centroid": [float(columns @ np.arange(wide)) / pixels, float(rows @ np.arange(high)) / pixels], "border_sides": sides, "clipped_sides_count": len(sides),
        "touches_opposite_borders": {"left", "right"} <= set(sides) or {"top", "bottom"} <= set(sides), "edge_contact_pixels": edge, "edge_contact_fraction": edge / pixels,
    }


def mask_metrics(df: DataFrame, mask: str, out: str, band: int = 2) -> DataFrame:
    """Size, pixels, box, centroid, touched sides and edge contact of a mask, as of nested arrays (rasters.mask_metrics)."""
    return _each(df, out, _METRICS, lambda m: _metrics(m, band), mask)


def pixel_count(df: DataFrame, mask: str, out: str) -> DataFrame:
    """Set pixels of a mask."""
    return _each(df, out, "long", lambda m: int(np.count_nonzero(m)), mask)


def grown(m: np.ndarray, halo: int) -> np.ndarray:
    """A mask and all pixels within ``halo`` of it, diagonals included: along lines first, then across."""
    for axis in (0, 1):
        m, before = m.copy(), np.moveaxis(m, axis, 0)
        view = np.moveaxis(m, axis, 0)
        for k in range(1, min(halo, len(before) - 1) + 1):
            view[k:] |= before[:-k]
            view[:-k] |= before[k:]
    return m


def changed_mask(df: DataFrame, baseline: str, marked: str, colour: str, out: str, halo: int = 2) -> DataFrame:
    """The mask of pixels that changed to a colour (of a column), and of changed ones within ``halo`` of them; no pixel for a null colour."""

    def made(a: np.ndarray, b: np.ndarray | None, wanted: int | None) -> dict | None:
        if b is None or a.shape != b.shape:
            return None
        changed = a != b
        seed = changed & (b == wanted) if wanted is not None else np.zeros_like(changed)
        return raster(seed | (changed & grown(seed, halo)), "bits")

    return _each(df, out, RASTER, made, baseline, marked, colour)


def dominant_change(df: DataFrame, baseline: str, marked: str, out: str) -> DataFrame:
    """The most frequent colour of changed pixels, the smallest of equals; null without changes."""

    def made(a: np.ndarray, b: np.ndarray | None) -> int | None:
        if b is None or a.shape != b.shape:
            return None
        colours, n = np.unique(b[a != b], return_counts=True)
        return int(colours[n.argmax()]) if len(colours) else None

    return _each(df, out, "int", made, baseline, marked)


def depth_grid(df: DataFrame, depth: str, out: str, n: int = 3, most: float = 100.0) -> DataFrame:
    """An n x n grid of the least depth in each part, rounded to a tenth; values that are not finite count as ``most``, all are clipped to 0..most.

    The first parts of an uneven split are one longer; a part without pixels has null.
    """

    def made(a: np.ndarray) -> list:
        clean = np.clip(np.where(np.isfinite(a), a, a.dtype.type(most)), 0, most)
        return [[float(c.min()) if c.size else None for c in np.array_split(r, n, axis=1)] for r in np.array_split(clean, n, axis=0)]

    rounded = F.transform(F.col(f"`{out}`"), lambda r: F.transform(r, lambda v: F.round(v, 1)))
    return _each(df, out, "array<array<double>>", made, depth).withColumn(out, rounded)
