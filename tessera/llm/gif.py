"""Media columns of GIF: LZW code streams, palettes, disposal, transparency, timed frames, colour histograms.

``read`` takes any GIF87a or GIF89a: global and local palettes, interlace,
extensions, disposal 0 to 3, transparent colours. ``write`` stores samples of 8
bits as the palette indices of frames of ``WIDTH`` samples by up to ``HEIGHT``
rows, so that nothing is lost; ``payload`` gets them back from the code streams.

Code streams are handled a run between clear codes at a time: the width of a
code depends on its place in the run alone, so codes are packed and cut by array
operations, and only the table itself is walked code by code.

Defined results: null and empty texts are one row of spaces; null media and data
that are not a GIF have null frames and summaries (``read`` alone raises
ValueError); a file that is cut off has the frames before that place; further
columns are kept, one of the made column's name gives way to it.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, with_field

WIDTH, HEIGHT, DELAY_MS = 192, 64, 100
_MOST = 4096
_BINS = 8


def _widths(n: int, bits: int) -> np.ndarray:
    """Widths of the first n codes of a run: one more bit whenever the reader's table is full."""
    free = np.arange(1, n + 1) + (1 << bits)
    free[:1] = 0
    return np.clip(np.ceil(np.log2(free + 1)), bits + 1, 12).astype(np.int64)


_WIDTHS = {bits: _widths(3 * _MOST, bits) for bits in range(2, 9)}


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples under 2**bits: a clear code first and whenever the table is full, an end code last."""
    clear = 1 << bits
    codes, starts = [clear], [1]
    table: dict[int, int] = {}
    get, put, free, full = table.get, codes.append, clear + 2, _MOST
    prefix = -1
    for sample in data:
        if prefix < 0:
            prefix = sample
            continue
        pair = prefix << 8 | sample
        code = get(pair)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix = sample
        table[pair] = free
        free += 1
        if free == full:
            put(clear)
            starts.append(len(codes))
            table.clear()
            free = clear + 2
    if prefix >= 0:
        put(prefix)
    put(clear + 1)
    ends = [*starts[1:], len(codes)]
    width = np.concatenate([[bits + 1], *(_WIDTHS[bits][: b - a] for a, b in zip(starts, ends, strict=True))])
    at = np.cumsum(width) - width
    value = np.array(codes, np.int64) << (at & 7)
    size = int(at[-1] + width[-1] + 7) // 8 + 2
    out = sum(np.bincount((at >> 3) + k, (value >> 8 * k) & 255, size) for k in range(3))
    return out.astype(np.uint8).tobytes()[: size - 2]


def lzw_decode(stream: bytes, bits: int = 8) -> bytes:
    """The samples of a code stream; what follows the end code is ignored."""
    clear, widths = 1 << bits, _WIDTHS[bits]
    ends = np.cumsum(widths)
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.int64)
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    out, table, previous, at, place, total = [], base[:], b"", 0, 0, 8 * len(stream)
    put = out.append
    while True:
        n = min(len(widths) - place, (total - at) // (bits + 1) + 1)
        w = widths[place : place + n]
        start = at + ends[place : place + n] - ends[place] + widths[place] - w
        n = int(np.searchsorted(start + w, total, "right"))
        if n == 0:
            return b"".join(out)
        start, w = start[:n], w[:n]
        byte = start >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (start & 7) & ((1 << w) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        stop = int(stop[0]) if len(stop) else n
        run = iter(codes[:stop].tolist())
        if not previous:
            for code in run:
                previous = table[code]
                put(previous)
                break
        free, add = len(table), table.append
        for code in run:
            entry = table[code] if code < free else previous + previous[:1]
            put(entry)
            if free < _MOST:
                add(previous + entry[:1])
                free += 1
            previous = entry
        if stop < n:
            if codes[stop] == clear + 1:
                return b"".join(out)
            at, place, table, previous = int(start[stop] + w[stop]), 0, base[:], b""
        else:
            at, place = int(start[-1] + w[-1]), min(place + n, 2 * _MOST)  # full tables go on with 12 bits


@dataclass(frozen=True)
class Frame:
    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]  # left, top, width, height
    samples: bytes  # palette indices, in rows from the top
    canvas: np.ndarray  # height x width x 3, what is shown


_PALETTE = bytes(c for k in range(256) for c in (k, 255 - k, k // 16 * 17))


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def write(samples: bytes) -> bytes:
    """A GIF whose frames hold the samples, a positive multiple of WIDTH, row by row."""
    rows = len(samples) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, HEIGHT), 0xF7, 0, 0), _PALETTE]
    for top in range(0, rows, HEIGHT):
        high = min(HEIGHT, rows - top)
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 4, DELAY_MS // 10, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, high, 0), b"\x08"]
        out.append(_blocks(lzw_encode(samples[top * WIDTH : (top + high) * WIDTH])))
    return b"".join([*out, b"\x3b"])


def _is_gif(data: bytes | None) -> bool:
    return data is not None and data[:6] in (b"GIF87a", b"GIF89a")


def read(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, each with the canvas as shown after it is drawn; of one that is cut off or goes wrong within, those before that place."""
    if not _is_gif(data):
        raise ValueError("not a GIF")
    try:
        yield from _frames(data)
    except (IndexError, ValueError, struct.error):
        return


def _frames(data: bytes) -> Iterator[Frame]:
    wide, high, flags, _background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        shared, at = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size
    canvas, now, control = np.zeros((high, wide, 3), np.uint8), 0, (0, 0, None)

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            if at + 1 + data[at] > len(data):
                raise IndexError("a block that the data end within")
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                packed, delay, colour = struct.unpack_from("<BHB", body)
                control = packed >> 2 & 7, 10 * delay, colour if packed & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError(f"unknown block {data[at]}")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if flags & 0x80:
            size = 3 << (flags & 7) + 1
            palette, at = np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size
        bits = data[at]
        stream, at = blocks(at + 1)
        samples = lzw_decode(stream, bits)[: w * h].ljust(w * h, b"\0")
        index = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 0x40:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            index = index[np.argsort(order)]
            samples = index.tobytes()
        disposal, delay, clear = control
        before = canvas.copy() if disposal == 3 else None
        view = canvas[top : top + h, left : left + w]
        shown = index[: view.shape[0], : view.shape[1]]
        colours = palette[np.minimum(shown, len(palette) - 1)] if palette is not None else np.repeat(shown[..., None], 3, axis=2)
        view[...] = colours if clear is None else np.where((shown == clear)[..., None], view, colours)
        yield Frame(now, delay, (left, top, w, h), samples, canvas.copy())
        now += delay
        if disposal == 2:
            view[...] = 0
        elif disposal == 3:
            canvas = before
        control = (0, 0, None)


def payload(data: bytes) -> bytes:
    """The samples of all frames, in their order."""
    return b"".join(f.samples for f in read(data))


def histogram(canvas: np.ndarray) -> list[int]:
    """Pixels by channel and eighth of its range: red, green, blue."""
    level = canvas.reshape(-1, 3) >> 5
    return np.bincount((level + np.array([0, _BINS, 2 * _BINS], np.uint8)).ravel(), minlength=3 * _BINS).tolist()


def padded(text: str) -> bytes:
    """UTF-8 of a text with bytes 32 up to a positive multiple of WIDTH."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b" " * (WIDTH - len(data) if len(data) < WIDTH else -len(data) % WIDTH)


def _with(df: DataFrame, column: str, made: str, kind: str, arrow: pa.DataType, each) -> DataFrame:
    schema = with_field(df, made, kind)
    names = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array([each(x) for x in part.column(column).to_pylist()], arrow)], [*names, made])

    return df.select(*(F.col(f"`{n}`") for n in names)).mapInArrow(run, schema)


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """Adds ``media_col``: each whole text, padded, as a GIF."""
    return _with(docs, text_col, media_col, "binary", pa.binary(), lambda text: write(padded(text or "")))


_FRAMES = pa.list_(pa.struct([("start_ms", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int32()))]))


def frames(media: DataFrame, media_col: str = "media", out_col: str = "frames") -> DataFrame:
    """Adds ``out_col``: each GIF's timed frames with their samples and the colour histogram of the canvas shown."""

    def each(data: bytes | None) -> list[dict] | None:
        if not _is_gif(data):
            return None
        return [{"start_ms": f.start_ms, "delay_ms": f.delay_ms, "width": f.box[2], "height": f.box[3], "samples": f.samples, "histogram": histogram(f.canvas)} for f in read(data)]

    kind = "array<struct<start_ms:int,delay_ms:int,width:int,height:int,samples:binary,histogram:array<int>>>"
    return _with(media, media_col, out_col, kind, _FRAMES, each)


def summaries(media: DataFrame, media_col: str = "media", out_col: str = "summary") -> DataFrame:
    """Adds ``out_col``: each GIF's samples in one value, its number of frames, duration and colour histogram over all frames; null of a null GIF."""

    def each(data: bytes | None) -> dict | None:
        if not _is_gif(data):
            return None
        parts, duration, colours = [], 0, np.zeros(3 * _BINS, np.int64)
        for f in read(data):
            parts.append(f.samples)
            duration += f.delay_ms
            colours += histogram(f.canvas)
        return {"payload": b"".join(parts), "n_frames": len(parts), "duration_ms": duration, "histogram": colours.tolist()}

    arrow = pa.struct([("payload", pa.binary()), ("n_frames", pa.int32()), ("duration_ms", pa.int64()), ("histogram", pa.list_(pa.int64()))])
    return _with(media, media_col, out_col, "struct<payload:binary,n_frames:int,duration_ms:long,histogram:array<long>>", arrow, each)
