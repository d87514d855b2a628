"""Frames of one size stacked into arrays (n, h, w), one Arrow batch at a time.

Batches are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType

from framemetry.functions import arrays

PIXELS = ArrayType(DoubleType())


def on_stacks(
    frames: DataFrame, keep: list[str], columns: list[str], fields: dict[str, DataType],
    fn: Callable[..., dict[str, np.ndarray]],
) -> DataFrame:
    """``keep`` and the ``fields`` that ``fn`` makes of the stacks of ``columns``: one number or one
    picture per frame. A frame with a NULL picture or size has NULL fields."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            whole = batch[["h", "w", *columns]].notna().all(axis=1)
            if not whole.all():
                missing = batch.loc[~whole, keep]
                yield missing.assign(**{n: None for n in fields})
            for (h, w), part in batch[whole].groupby(["h", "w"], sort=False):
                h, w = int(h), int(w)
                stacks = [np.stack(part[c].to_numpy()).astype(float).reshape(-1, h, w) for c in columns]
                made = {}
                for name, values in fn(*stacks).items():
                    values = np.asarray(values)
                    made[name] = values if values.ndim == 1 else list(values.reshape(len(part), -1))
                yield part[keep].assign(**made)

    slim = frames.select(*dict.fromkeys([*keep, "h", "w", *columns]))
    kept = [f for f in frames.select(*keep).schema.fields]
    return slim.mapInPandas(run, StructType([*kept, *[StructField(n, t) for n, t in fields.items()]]))


# --- pictures ------------------------------------------------------------------------------------


def np_filter(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The same taps along both axes, zero padding."""
    r = len(taps) // 2
    p = np.pad(x, ((0, 0), (0, 0), (r, r)))
    x = sum(k * p[:, :, j : j + x.shape[2]] for j, k in enumerate(taps))
    p = np.pad(x, ((0, 0), (r, r), (0, 0)))
    return sum(k * p[:, j : j + x.shape[1], :] for j, k in enumerate(taps))


def np_sobel(x: np.ndarray) -> np.ndarray:
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    row = p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    col = p[:, :, :-2] + 2 * p[:, :, 1:-1] + p[:, :, 2:]
    gx, gy = row[:, :, 2:] - row[:, :, :-2], col[:, 2:] - col[:, :-2]
    return np.sqrt(gx * gx + gy * gy + 1e-12)


def np_minmax(e: np.ndarray) -> np.ndarray:
    """(e - min) / (max - min + 1e-6) per frame."""
    lo, hi = e.min((1, 2), keepdims=True), e.max((1, 2), keepdims=True)
    return (e - lo) / (hi - lo + 1e-6)


def _one_picture(frames: DataFrame, column: str, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    keep = [c for c in frames.columns if c != column]
    out = on_stacks(frames, keep, [column], {column: PIXELS}, lambda x: {column: fn(x)})
    return out.select(*frames.columns)


def sobel(frames: DataFrame, column: str = "pixels") -> DataFrame:
    """Edge magnitude in place of the picture."""
    return _one_picture(frames, column, np_sobel)


def minmax_norm(frames: DataFrame, column: str = "pixels") -> DataFrame:
    return _one_picture(frames, column, np_minmax)


def gaussian_filter(frames: DataFrame, column: str = "pixels", size: int = 11, sigma: float = 1.5) -> DataFrame:
    taps = np.array(arrays.gaussian_taps(size, sigma))
    return _one_picture(frames, column, lambda x: np_filter(x, taps))


def stencil(frames: DataFrame, kernel: list[list[float]], column: str = "pixels") -> DataFrame:
    """Correlation with an odd square kernel, zero padding."""
    k = np.array(kernel)
    r = len(k) // 2

    def run(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, ((0, 0), (r, r), (r, r)))
        h, w = x.shape[1:]
        return sum(v * p[:, i : i + h, j : j + w] for (i, j), v in np.ndenumerate(k) if v)

    return _one_picture(frames, column, run)


def resize_weights(size: int, wanted: int) -> np.ndarray:
    """(wanted, size) triangle-filter weights of one axis, rows summing to 1; when shrinking, the
    triangle is as wide as the step."""
    step = size / wanted
    reach = max(step, 1.0)
    centre = (np.arange(wanted) + 0.5) * step
    away = np.abs(np.arange(size)[None, :] + 0.5 - centre[:, None]) / reach
    weight = np.clip(1.0 - away, 0.0, None)
    return weight / weight.sum(axis=1, keepdims=True)


def resize(frames: DataFrame, oh: int, ow: int, column: str = "pixels") -> DataFrame:
    """Bilinear resize by two small matrices per pair of sizes; h and w follow."""
    keep = [c for c in frames.columns if c not in (column, "h", "w")]

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        h, w = x.shape[1:]
        out = x if (h, w) == (oh, ow) else resize_weights(h, oh) @ x @ resize_weights(w, ow).T
        n = len(x)
        return {column: out, "h": np.full(n, oh, np.int32), "w": np.full(n, ow, np.int32)}

    out = on_stacks(frames, keep, [column], {column: PIXELS, "h": IntegerType(), "w": IntegerType()}, run)
    return out.select(*frames.columns)
