"""Seeded augmentation. Decisions are columns of the frame row; pixels move by index arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from framemetry.functions import draws
from framemetry.functions.arrays import flip, let, remap
from framemetry.functions.scalars import clamp01


def _draw(seed: int, key: str, what: str, lane: int) -> Column:
    return draws.uniform(seed, F.col(key), what, lane=lane)


def draw_parameters(frames: DataFrame, seed: int, key: str = "frame_id") -> DataFrame:
    """One struct ``aug`` per frame: shift, flips, brightness, gamma; neutral where not drawn."""

    def when(p: float, what: str, value: Column, neutral: float) -> Column:
        return F.when(_draw(seed, key, what, 0) < p, value).otherwise(F.lit(neutral))

    def shift(lane: int) -> Column:
        step = F.floor(_draw(seed, key, "roll", lane) * 9).cast("int") - 4
        return F.when(_draw(seed, key, "roll", 0) < 0.5, step).otherwise(F.lit(0))

    return frames.withColumn(
        "aug",
        F.struct(
            shift(1).alias("dy"),
            shift(2).alias("dx"),
            (_draw(seed, key, "hflip", 0) < 0.5).alias("hflip"),
            (_draw(seed, key, "vflip", 0) < 0.2).alias("vflip"),
            when(0.7, "light", _draw(seed, key, "light", 1) * 0.2 + 0.9, 1.0).alias("scale"),
            when(0.7, "light", _draw(seed, key, "light", 2) * 0.1 - 0.05, 0.0).alias("bias"),
            when(0.7, "gamma", _draw(seed, key, "gamma", 1) * 0.2 + 0.9, 1.0).alias("gamma"),
        ),
    )


def apply_parameters(frames: DataFrame, column: str = "pixels") -> DataFrame:
    """Cyclic shift, horizontal flip, vertical flip, brightness with clamp, gamma with clamp."""
    h, w = F.col("h"), F.col("w")

    def changed(a: Column) -> Column:
        def row(y, x):
            return F.pmod(F.when(a["vflip"], h - 1 - y).otherwise(y) - a["dy"], h)

        def col(y, x):
            return F.pmod(F.when(a["hflip"], w - 1 - x).otherwise(x) - a["dx"], w)

        return F.transform(
            remap(F.col(column), w, h, w, row, col),
            lambda v: clamp01(F.pow(clamp01(v * a["scale"] + a["bias"]), a["gamma"])),
        )

    # bound once per frame: otherwise the draws would be repeated for every pixel
    return frames.withColumn(column, let(F.col("aug"), changed))


def augment(frames: DataFrame, seed: int, column: str = "pixels") -> DataFrame:
    return apply_parameters(draw_parameters(frames, seed), column).drop("aug")


def augment_pair(
    pairs: DataFrame, seed: int, columns: tuple[str, ...] = ("noisy", "clean"), key: str = "frame_id"
) -> DataFrame:
    """The same horizontal (p = .5) and vertical (p = .2) flip for both sides."""
    vertical = _draw(seed, key, "pair", 1) < 0.2
    horizontal = _draw(seed, key, "pair", 0) < 0.5
    out = pairs
    for c in columns:
        out = out.withColumn(c, flip(F.col(c), F.col("h"), F.col("w"), vertical, horizontal))
    return out


def rotate(px: Column, h: Column, w: Column, degrees: Column) -> Column:
    """Counter-clockwise rotation about the centre, nearest pixel, zero where nothing maps."""
    cy, cx = (h - 1) / 2.0, (w - 1) / 2.0

    def turned(angle):
        def source(y, x):
            sx = F.cos(angle) * (x - cx) - F.sin(angle) * (y - cy)
            sy = F.sin(angle) * (x - cx) + F.cos(angle) * (y - cy)
            return F.rint(sy + cy).cast("int"), F.rint(sx + cx).cast("int")

        def row(y, x):
            sy, sx = source(y, x)
            inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
            # a negative index reads as zero
            return F.when(inside, sy).otherwise(-h)

        def col(y, x):
            return F.greatest(F.lit(0), F.least(source(y, x)[1], w - 1))

        return remap(px, w, h, w, row, col)

    return let(degrees * (math.pi / 180.0), turned)


def augment_classifier(
    frames: DataFrame, seed: int, column: str = "pixels", key: str = "frame_id"
) -> DataFrame:
    """Each with p = .5: flip rows, flip columns, rotate by up to 10 degrees either way."""
    h, w = F.col("h"), F.col("w")
    vertical = _draw(seed, key, "rows", 0) > 0.5
    horizontal = _draw(seed, key, "cols", 0) > 0.5
    angle = _draw(seed, key, "turn", 1) * 20.0 - 10.0
    flipped = frames.withColumn(column, flip(F.col(column), h, w, vertical, horizontal))
    return flipped.withColumn(
        column,
        F.when(
            _draw(seed, key, "turn", 0) > 0.5, rotate(F.col(column), h, w, angle)
        ).otherwise(F.col(column)),
    )
