"""Ink gates over cell crops. Kernels are plain numpy; the wrappers are Arrow UDFs over (image, h, w), or ``judged`` for whole rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StringType, StructField, StructType


def to_gray(image: np.ndarray) -> np.ndarray:
    """Gray uint8 of an image in any range: floats up to one are scaled, NaN is white."""
    x = np.nan_to_num(np.asarray(image, dtype=np.float64), nan=255.0)
    if x.ndim == 3:
        x = x[..., 0] * 0.299 + x[..., 1] * 0.587 + x[..., 2] * 0.114
    if np.issubdtype(np.asarray(image).dtype, np.floating) and x.size and x.max() <= 1.0:
        x = x * 255
    return np.clip(x, 0, 255).astype(np.uint8)


def is_blank(gray: np.ndarray | None, threshold: float = 0.015, margin_y: int | None = None, margin_x: int | None = None) -> bool:
    """Whether the inner part has too few dark pixels; crops under 20 pixels are never blank, no crop is."""
    if gray is None or gray.size == 0:
        return True
    h, w = gray.shape
    if h < 20 or w < 20:
        return False
    my, mx = max(4, h // 6) if margin_y is None else margin_y, max(4, w // 8) if margin_x is None else margin_x
    inner = gray[my : h - my, mx : w - mx]
    return inner.size == 0 or float((inner < 200).mean()) < threshold


def otsu(gray: np.ndarray) -> int:
    """Threshold with the greatest variance between the classes."""
    counts = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    below = np.cumsum(counts)
    mass = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = (mass[-1] * below / below[-1] - mass) ** 2 / (below * (below[-1] - below))
    return int(np.nan_to_num(spread, nan=-1, posinf=-1).argmax())


def _long_runs(mask: np.ndarray, least: int) -> np.ndarray:
    """Opening with a line: along each row, runs shorter than ``least`` vanish."""
    padded = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(padded, axis=1)
    out = np.zeros_like(mask)
    rows, starts = np.nonzero(step == 1)
    _, ends = np.nonzero(step == -1)
    for r, a, b in zip(rows, starts, ends, strict=True):
        if b - a >= least:
            out[r, a:b] = True
    return out


def strip_borders(gray: np.ndarray) -> np.ndarray:
    """Whiten printed rules: long vertical or horizontal strokes whose centre lies in the outer 22 %."""
    h, w = gray.shape
    if h < 12 or w < 12:
        return gray
    dark = gray <= otsu(gray)
    out = gray.copy()
    upright = _long_runs(dark.T, max(1, int(0.72 * h))).T
    flat = _long_runs(dark, max(1, int(0.55 * w)))
    for strokes, axis, extent in ((upright, 1, w), (flat, 0, h)):
        lines = np.flatnonzero(strokes.any(axis=1 - axis))
        for group in np.split(lines, np.flatnonzero(np.diff(lines) > 1) + 1) if len(lines) else []:
            centre = group.mean()
            if centre < 0.22 * extent or centre > 0.78 * extent:
                lo, hi = max(0, group[0] - 2), min(extent, group[-1] + 3)
                across = strokes[:, group].any(axis=1) if axis == 1 else strokes[group].any(axis=0)
                touched = np.flatnonzero(across)
                reach = slice(max(0, touched[0] - 2), touched[-1] + 3)
                if axis == 1:
                    out[reach, lo:hi] = 255
                else:
                    out[lo:hi, reach] = 255
    return out


def crop_center(gray: np.ndarray, width: int = 200, height: int = 50) -> np.ndarray:
    h, w = gray.shape
    x, y = max(0, (w - width) // 2), max(0, (h - height) // 2)
    return gray[y : y + height, x : x + width]


def _cubic(t: np.ndarray) -> list[np.ndarray]:
    """Weights of four neighbours for a place ``t`` past the second one (cubic convolution, a = -0.75)."""
    a = -0.75
    far = lambda x: ((a * x - 5 * a) * x + 8 * a) * x - 4 * a
    near = lambda x: ((a + 2) * x - (a + 3)) * x * x + 1
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def rotate(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Turn about the top left corner, cubic interpolation, edge pixels continued outside."""
    h, w = gray.shape
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:h, 0:w].astype(np.float64)
    sx, sy = c * x - s * y, s * x + c * y
    ix, iy = np.floor(sx).astype(np.int64), np.floor(sy).astype(np.int64)
    wx, wy = _cubic(sx - ix), _cubic(sy - iy)
    out = np.zeros((h, w))
    for j in range(4):
        rows = np.clip(iy + j - 1, 0, h - 1)
        out += wy[j] * sum(wx[i] * gray[rows, np.clip(ix + i - 1, 0, w - 1)] for i in range(4))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def turned(image: Column, h: Column, w: Column, degrees: Column) -> Column:
    """The crop turned by ``degrees``; unchanged where they are null or 0."""

    def turn(image: pa.Array, h: pa.Array, w: pa.Array, degrees: pa.Array) -> pa.Array:
        out = []
        for data, rows, cols, by in zip(*(c.to_pylist() for c in (image, h, w, degrees)), strict=True):
            out.append(rotate(np.frombuffer(data, dtype=np.uint8).reshape(rows, cols), by).tobytes() if data is not None and by else data)
        return pa.array(out, pa.binary())

    return F.arrow_udf(turn, "binary")(image, h, w, degrees)


def ditto_by_ink(gray: np.ndarray) -> bool:
    return bool(gray.size) and float((gray < 250).mean()) < 0.05


def ditto_by_shape(gray: np.ndarray) -> bool:
    """A small mark near the centre."""
    h, w = gray.shape
    if h < 16 or w < 40:
        return False
    my, mx = max(4, h // 6), max(4, w // 8)
    ink = gray[my : h - my, mx : w - mx] < 200
    if ink.sum() < 8 or ink.mean() > 0.15:
        return False
    ys, xs = np.nonzero(ink)
    ih, iw = ink.shape
    narrow = xs.max() - xs.min() + 1 <= 0.35 * iw
    return bool(narrow and abs(xs.mean() - iw / 2) <= 0.25 * iw and abs(ys.mean() - ih / 2) <= 0.25 * ih)


def _gate(kernel):
    def gate(image: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        out = []
        for data, rows, cols in zip(image.to_pylist(), h.to_pylist(), w.to_pylist(), strict=True):
            out.append(kernel(None if data is None else np.frombuffer(data, dtype=np.uint8).reshape(rows, cols)))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(gate, "boolean")


def judged(cells: DataFrame, name: str, crops: list[str], looked: str | None, kernel: Callable[[np.ndarray], object], kind: DataType, arrow: pa.DataType) -> DataFrame:
    """``cells`` with a column ``name``: ``kernel`` of the first of ``crops`` that a row has (h by w bytes), where ``looked`` holds.

    Null without a crop. Equal crops of a batch are judged once. Rows pass through Python as they are: beside
    an Arrow UDF Spark would queue them, with their crops, until the verdict is back, and on disk beyond its memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.names.index(c))  # noqa: B023, E731
            seen = pc.dictionary_encode(pc.coalesce(*[column(c) for c in crops]))
            codes = seen.indices if looked is None else pc.if_else(column(looked), seen.indices, None)
            known: dict[tuple, object] = {(None, None, None): None}
            keys = [(None,) * 3 if key[0] is None else key for key in zip(*(c.to_pylist() for c in (codes, column("h"), column("w"))), strict=True)]
            for code, h, w in dict.fromkeys(keys):
                if code is not None:
                    known[code, h, w] = kernel(np.frombuffer(seen.dictionary[code].as_buffer(), dtype=np.uint8).reshape(h, w))
            verdicts = pa.array([known[key] for key in keys], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, verdicts], schema=batch.schema.append(pa.field(name, arrow)))

    fields = [StructField(f.name, f.dataType, True, f.metadata) for f in cells.schema.fields]
    return cells.mapInArrow(run, StructType([*fields, StructField(name, kind)]))


def with_blank(cells: DataFrame, name: str, crops: list[str]) -> DataFrame:
    """Whether a crop is blank after the printed rules are gone."""
    return judged(cells, name, crops, None, lambda g: is_blank(strip_borders(g), 0.004, 3, 3), BooleanType(), pa.bool_())


def ditto_gate(image: Column, h: Column, w: Column, by_shape: bool) -> Column:
    return _gate(lambda g: g is not None and (ditto_by_ink(g) or by_shape and ditto_by_shape(g)))(image, h, w)


def with_mark(cells: DataFrame, name: str, crops: list[str], looked: str) -> DataFrame:
    """What a crop shows: 'blank', a ditto mark by 'ink' or by 'shape', or '' for anything else; null for no crop."""

    def kind(gray: np.ndarray) -> str:
        if is_blank(gray, 0.004):
            return "blank"
        return "ink" if ditto_by_ink(gray) else "shape" if ditto_by_shape(gray) else ""

    return judged(cells, name, crops, looked, kind, StringType(), pa.string())


def ink_share(pixels: Column, dark: float) -> Column:
    """Share of pixels of an array column that are darker than ``dark``; stays in the JVM."""
    return F.size(F.filter(pixels, lambda p: p < dark)) / F.greatest(F.size(pixels), F.lit(1))


def pixel_gate(pixels: Column, dark: float, threshold: float) -> Column:
    """``is_blank`` of an array column drawn as a crop of two tones, repeated to the 20 pixels a side that the gate needs."""
    row = F.array_join(F.transform(pixels, lambda p: F.when(p < dark, "00").otherwise("ff")), "")
    times = F.ceil(F.lit(20) / F.greatest(F.size(pixels), F.lit(1))).cast("int")
    image = F.unhex(F.repeat(row, F.lit(20) * times))
    blank = _gate(lambda g: is_blank(g, threshold, 0, 0))(image, F.lit(20), F.size(pixels) * times)
    return F.when(F.size(pixels) > 0, blank).when(F.size(pixels) == 0, F.lit(False))
