"""Frames cut into blocks, for frames that do not fit into a row.

A block is a row (keys, h, w, top, left, bh, bw, pixels). ``resize_blocks`` is linear in the pixels, so every block
gives its part of each output pixel it reaches and parts are added: no block needs its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

BLOCK = 256


def block_rows(pixels: DataFrame, keys: list[str], block: int = BLOCK, value: str = "v") -> DataFrame:
    """A pixel table (keys, h, w, y, x, value) as blocks; at most ``block`` x ``block`` pixels meet in a group."""
    by, bx = (F.floor(F.col(c) / block).cast("int") for c in ("y", "x"))
    gathered = pixels.groupBy(*keys, "h", "w", by.alias("_by"), bx.alias("_bx")).agg(
        F.array_sort(F.collect_list(F.struct("y", "x", F.col(value).cast("double").alias("v")))).alias("_p")
    )
    top, left = F.col("_by") * block, F.col("_bx") * block
    return gathered.select(
        *keys, F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), top.alias("top"), left.alias("left"),
        F.least(F.lit(block), F.col("h") - top).cast("int").alias("bh"), F.least(F.lit(block), F.col("w") - left).cast("int").alias("bw"),
        F.col("_p.v").alias("pixels"),
    )


def axis_part(size: int, wanted: int, start: int, stop: int) -> tuple[int, np.ndarray]:
    """The first output place that the samples from ``start`` to ``stop`` of an axis reach, and the weights (places,
    samples) of these samples in it and the ones after. Weights are a triangle as wide as the step when
    shrinking; those of a place add up to 1 over the whole axis."""
    step = size / wanted
    reach = max(step, 1.0)
    low = max(0, int(np.floor((start + 0.5 - reach) / step - 0.5)))
    high = min(wanted, int(np.ceil((stop - 0.5 + reach) / step - 0.5)) + 1)
    centre = (np.arange(low, high) + 0.5) * step
    around = np.floor(centre - reach)[:, None] + np.arange(int(np.ceil(2 * reach)) + 2)[None, :]
    weight = np.clip(1.0 - np.abs(around + 0.5 - centre[:, None]) / reach, 0.0, None)
    whole = np.where((around >= 0) & (around < size), weight, 0.0).sum(axis=1)
    own = np.clip(1.0 - np.abs(np.arange(start, stop)[None, :] + 0.5 - centre[:, None]) / reach, 0.0, None)
    return low, own / whole[:, None]


def resize_blocks(blocks: DataFrame, keys: list[str], oh: int, ow: int) -> DataFrame:
    """The pixels (keys, y, x, v) of frames resized to ``oh`` x ``ow``, as ``resize_frames`` gives them.

    Every block multiplies its pixels with its part of the weights of both axes; parts of one output pixel are added
    with map-side combine. A task holds a block, and what it reaches, whatever the size of the frame.
    """
    names = [*keys, "y", "x", "v"]
    schema = T.StructType([*blocks.select(*keys).schema.fields, *T.StructType().add("y", "integer").add("x", "integer").add("v", "double")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in ("h", "w", "top", "left", "bh", "bw")}
            for i in range(batch.num_rows):
                h, w, top, left, bh, bw = (batch.column(at[n])[i].as_py() for n in at)
                pixels = batch.column(len(keys) + 6)[i].values.to_numpy(zero_copy_only=False).reshape(bh, bw)
                y0, down = axis_part(h, oh, top, top + bh)
                x0, across = axis_part(w, ow, left, left + bw)
                part = down @ pixels @ across.T
                n = part.size
                own = [batch.column(k).slice(i, 1).take(pa.array(np.zeros(n, np.int64))) for k in range(len(keys))]
                y, x = (np.repeat(np.arange(part.shape[0]), part.shape[1]) + y0, np.tile(np.arange(part.shape[1]), part.shape[0]) + x0)
                made = [pa.array(y, pa.int32()), pa.array(x, pa.int32()), pa.array(part.ravel())]
                reached = (down.any(axis=1)[:, None] & across.any(axis=1)[None, :]).ravel()
                yield pa.RecordBatch.from_arrays([*own, *made], names=names).filter(pa.array(reached))

    slim = blocks.select(*keys, "h", "w", "top", "left", "bh", "bw", "pixels")
    return slim.mapInArrow(run, schema).groupBy(*keys, "y", "x").agg(F.sum("v").alias("v"))
