"""Tiling, per-tile functions and recombination with a Hann window."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from framemetry.functions.arrays import let, upto
EPS = 1e-6
TWO_PI = 6.283185307179586


def hann(i: Column, n: int) -> Column:
    """Periodic Hann weight of position ``i`` of ``n``: zero at 0, never again below n."""
    return 0.5 - F.cos(i * (TWO_PI / n)) * 0.5


def hann_weights(n: Column | int) -> Column:
    """Flat n x n array of window weights, 1e-6 added so that no weight is zero."""
    size = F.lit(n) if isinstance(n, int) else n

    def one(i):
        return 0.5 - F.cos(i * TWO_PI / size) * 0.5

    return F.flatten(
        F.transform(upto(size), lambda y: F.transform(upto(size), lambda x: one(y) * one(x) + EPS))
    )


def grid_offsets(n: Column, tile: int, overlap: int, trim: bool = False) -> Column:
    """Tile starts along one axis. ``trim`` leaves out tiles that begin inside the last overlap."""
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be at least 0 and below the tile size")
    last = F.greatest(n - overlap, F.lit(1)) - 1 if trim else n - 1
    return F.sequence(F.lit(0), last.cast("int"), F.lit(tile - overlap))


def tile_frames(
    frames: DataFrame, tile: int, overlap: int, column: str = "pixels",
    keys: tuple[str, ...] = ("frame_id",), trim: bool = False,
) -> DataFrame:
    """Square tiles with their offsets; what hangs over the edge is zero.

    A frame is cast once and cut into an array of tiles inside its row, which then become rows: what
    a row holds is the frame and its tiles, never a copy of the frame per tile."""
    h, w = F.col("h"), F.col("w")
    blank = F.array_repeat(F.lit(0.0), F.lit(tile))

    def one(p: Column, top: Column, left: Column) -> Column:
        wide = F.least(F.lit(tile), w - left)
        rest = F.array_repeat(F.lit(0.0), F.lit(tile) - wide)
        lines = F.transform(
            upto(tile),
            lambda i: F.when(
                top + i < h, F.concat(F.slice(p, (top + i) * w + left + 1, wide), rest)
            ).otherwise(blank),
        )
        return F.struct(top.alias("top"), left.alias("left"), F.flatten(lines).alias("pixels"))

    def cut(p: Column) -> Column:
        return F.flatten(
            F.transform(
                grid_offsets(h, tile, overlap, trim),
                lambda t: F.transform(grid_offsets(w, tile, overlap, trim), lambda s: one(p, t, s)),
            )
        )

    every = let(F.transform(F.col(column), lambda v: v.cast("double")), cut)
    return frames.select(*keys, "h", "w", F.lit(tile).alias("tile"), F.inline(every))


def overlap_add_pixels(
    tiles: DataFrame, tile: int, keys: tuple[str, ...] = ("frame_id",), edge: str = "reference"
) -> DataFrame:
    """Weighted mean of overlapping tiles as pixel rows (keys, h, w, pos, y, x, v).

    ``edge='reference'`` adds 1e-6 to the sum of weights, which halves row 0 and column 0, where
    the window has only its own 1e-6; ``edge='exact'`` does not.
    """
    i, j = F.floor(F.col("_at") / tile).cast("int"), F.col("_at") % tile
    spread = (
        tiles.select(*keys, "h", "w", "top", "left", F.posexplode("pixels").alias("_at", "_v"))
        .withColumn("_weight", hann(i, tile) * hann(j, tile) + EPS)
        .withColumn("y", F.col("top") + i)
        .withColumn("x", F.col("left") + j)
        .filter((F.col("y") < F.col("h")) & (F.col("x") < F.col("w")))
    )
    total = F.sum("_weight") + (EPS if edge == "reference" else 0.0)
    return (
        spread.groupBy(*keys, "h", "w", "y", "x")
        .agg((F.sum(F.col("_weight") * F.col("_v")) / total).alias("v"))
        .withColumn("pos", F.col("y") * F.col("w") + F.col("x"))
    )


def overlap_add(
    tiles: DataFrame, tile: int, keys: tuple[str, ...] = ("frame_id",), edge: str = "reference"
) -> DataFrame:
    """The same as whole frames: the blocks of ``overlap_add_blocks`` put together. What is gathered for
    a frame is the frame, not its overlapping tiles."""
    blocks = overlap_add_blocks(tiles, tile, keys, edge)
    gathered = blocks.groupBy(*keys, "h", "w").agg(F.collect_list(F.struct("y", "x", "bh", "bw", "pixels")).alias("_b"))

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frames = []
            for h, w, parts in zip(batch["h"], batch["w"], batch["_b"]):
                whole = np.zeros((h, w))
                for b in parts:
                    y, x, bh, bw = b["y"], b["x"], b["bh"], b["bw"]
                    whole[y : y + bh, x : x + bw] = np.asarray(b["pixels"]).reshape(bh, bw)
                frames.append(whole.ravel())
            yield batch[[*keys, "h", "w"]].assign(pixels=frames)

    return gathered.mapInPandas(join, _frame_schema(gathered, keys))


def overlap_add_blocks(
    tiles: DataFrame, tile: int, keys: tuple[str, ...] = ("frame_id",), edge: str = "reference",
    block: int | None = None,
) -> DataFrame:
    """Weighted mean of overlapping tiles as blocks (keys, h, w, y, x, bh, bw, pixels) of the frame.

    A tile goes to the blocks it touches, at most four as a block is at least a tile wide, and a block
    gathers the tiles that touch it: the group is bounded by block and overlap, however large the frame.
    """
    block = max(block or 4 * tile, tile)
    window = _np_window(tile)
    extra = EPS if edge == "reference" else 0.0

    def touched(at: str, n: str) -> Column:
        last = F.least(F.col(at) + (tile - 1), F.col(n) - 1)
        return F.sequence(F.floor(F.col(at) / block).cast("int"), F.floor(last / block).cast("int"))

    spread = tiles.select(
        *keys, "h", "w", F.struct("top", "left", "pixels").alias("_t"), F.explode(touched("top", "h")).alias("_by"),
        F.col("left"),
    )
    spread = spread.select(*keys, "h", "w", "_t", "_by", F.explode(touched("left", "w")).alias("_bx"))
    stacked = spread.groupBy(*keys, "h", "w", "_by", "_bx").agg(F.array_sort(F.collect_list("_t")).alias("_t"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for h, w, by, bx, parts in zip(*[batch[c] for c in ("h", "w", "_by", "_bx", "_t")]):
                y, x = by * block, bx * block
                bh, bw = min(block, h - y), min(block, w - x)
                # a margin of one tile on every side, so that no tile needs cutting
                total = np.zeros((2, bh + 2 * tile, bw + 2 * tile))
                for t in parts:
                    one = np.asarray(t["pixels"]).reshape(tile, tile)
                    top, left = t["top"] - y + tile, t["left"] - x + tile
                    total[:, top : top + tile, left : left + tile] += (one * window, window)
                inner = total[:, tile : tile + bh, tile : tile + bw]
                rows.append((y, x, bh, bw, (inner[0] / (inner[1] + extra)).ravel()))
            made = pd.DataFrame(rows, columns=["y", "x", "bh", "bw", "pixels"], index=batch.index)
            yield pd.concat([batch[[*keys, "h", "w"]], made], axis=1)

    kept = stacked.select(*keys, "h", "w").schema.fields
    ints = [StructField(n, IntegerType()) for n in ("y", "x", "bh", "bw")]
    schema = StructType([*kept, *ints, StructField("pixels", ArrayType(DoubleType()))])
    return stacked.mapInPandas(add, schema)


def _np_window(tile: int) -> np.ndarray:
    line = 0.5 - 0.5 * np.cos(TWO_PI * np.arange(tile) / tile)
    return np.outer(line, line) + EPS


def _frame_schema(df: DataFrame, keys: tuple[str, ...]) -> StructType:
    kept = df.select(*keys, "h", "w").schema.fields
    return StructType([*kept, StructField("pixels", ArrayType(DoubleType()))])


def apply_to_tiles(tiles: DataFrame, fn: Callable[[np.ndarray], np.ndarray], tile: int) -> DataFrame:
    """Run ``fn`` on stacks of tiles, an (n, tile, tile) array in and out, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                stack = np.stack(batch["pixels"].to_numpy()).reshape(-1, tile, tile)
                out = np.asarray(fn(stack), dtype=float).reshape(len(batch), -1)
                yield batch.assign(pixels=list(out))

    return tiles.mapInPandas(run, tiles.schema)


def box_filter(k: int = 3) -> Callable[[np.ndarray], np.ndarray]:
    """Mean over k x k neighbours with zero padding, an example of a tile function."""

    def run(x: np.ndarray) -> np.ndarray:
        r = k // 2
        p = np.pad(x, ((0, 0), (r, r), (r, r)))
        h, w = x.shape[1:]
        return sum(p[:, i : i + h, j : j + w] for i in range(k) for j in range(k)) / (k * k)

    return run


def _apply_in_rows(
    frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], tile: int, overlap: int,
    column: str, keys: tuple[str, ...], edge: str,
) -> DataFrame:
    """Tile, apply and recombine inside the row of each frame; frames of one size go together."""
    window = _np_window(tile)
    extra = EPS if edge == "reference" else 0.0
    step = tile - overlap

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (h, w), part in batch.groupby(["h", "w"], sort=False):
                stack = np.stack(part[column].to_numpy()).astype(float).reshape(-1, h, w)
                padded = np.pad(stack, ((0, 0), (0, tile), (0, tile)))
                total = np.zeros_like(padded)
                weight = np.zeros(padded.shape[1:])
                for y, x in np.ndindex(-(-h // step), -(-w // step)):
                    at = np.s_[y * step : y * step + tile, x * step : x * step + tile]
                    total[(slice(None), *at)] += fn(padded[(slice(None), *at)]) * window
                    weight[at] += window
                done = (total / (weight + extra + (weight == 0)))[:, :h, :w].reshape(len(part), -1)
                yield part[[*keys, "h", "w"]].assign(pixels=list(done))

    slim = frames.select(*keys, "h", "w", column)
    return slim.mapInPandas(run, _frame_schema(slim, keys))


def tiled_apply(
    frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray] | None, tile: int = 256,
    overlap: int = 32, column: str = "pixels", keys: tuple[str, ...] = ("frame_id",),
    edge: str = "reference", distribute: bool = False,
) -> DataFrame:
    """Tile, apply ``fn`` to every tile (identity if None), recombine. Not clamped.

    By default a frame stays in its row: no shuffle, and the unit of work is a frame. With
    ``distribute`` every tile is a row of its own, which spreads one very large frame or a very slow
    function over many tasks, at the price of one shuffle of tiles before and one after ``fn``.
    """
    if not distribute:
        if not 0 <= overlap < tile:
            raise ValueError("overlap must be at least 0 and below the tile size")
        return _apply_in_rows(frames, fn or (lambda x: x), tile, overlap, column, keys, edge)
    tiles = tile_frames(frames, tile, overlap, column, keys)
    if fn is not None:
        tiles = apply_to_tiles(tiles.repartition(*keys, "top", "left"), fn, tile)
    return overlap_add(tiles, tile, keys, edge)
