"""Stencils on the pixel view: every pixel is sent to the neighbours it contributes to.

The kernel is a literal list unpacked by a generator, so there is no join. Pictures are cut into
blocks with a halo; one shuffle on (frame, block) brings a block's pixels together and every
later step stays inside it, so the largest task holds one block however large the picture is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framemetry.functions.arrays import gaussian_taps

BLOCK = 64

# Correlation weights (dy, dx) -> (horizontal, vertical) of the Sobel pair (fixed values).
SOBEL = {
    (-1, -1): (-1.0, -1.0), (-1, 0): (0.0, -2.0), (-1, 1): (1.0, -1.0),
    (0, -1): (-2.0, 0.0), (0, 0): (0.0, 0.0), (0, 1): (2.0, 0.0),
    (1, -1): (-1.0, 1.0), (1, 0): (0.0, 2.0), (1, 1): (1.0, 1.0),
}


def blocked(pixels: DataFrame, keys: list[str], halo: int, block: int = BLOCK) -> DataFrame:
    """Copy each pixel to every block whose haloed area holds it; needs h and w."""

    def blocks(c: str, n: str) -> Column:
        return F.sequence(
            F.greatest(F.floor((F.col(c) - halo) / block), F.lit(0)),
            F.least(F.floor((F.col(c) + halo) / block), F.floor((F.col(n) - 1) / block)),
        )

    return (
        pixels.withColumn("_by", F.explode(blocks("y", "h")))
        .withColumn("_bx", F.explode(blocks("x", "w")))
        .repartition(*keys, "_by", "_bx")
    )


def scatter(
    blocks: DataFrame,
    keys: list[str],
    taps: dict[tuple[int, int], tuple[float, ...]],
    values: dict[str, tuple[str, int]],
) -> DataFrame:
    """Zero-padded cross-correlation: output name -> (value column, index into the tap weights).

    Targets outside the picture are dropped; targets near a block's rim are incomplete and must be
    removed by ``core``.
    """
    kernel = F.array(
        *[
            F.struct(
                F.lit(dy).alias("dy"), F.lit(dx).alias("dx"),
                *[F.lit(float(k)).alias(f"k{i}") for i, k in enumerate(ws)],
            )
            for (dy, dx), ws in taps.items()
        ]
    )
    sent = blocks.select("*", F.inline(kernel))
    ty, tx = F.col("y") - F.col("dy"), F.col("x") - F.col("dx")
    inside = (ty >= 0) & (ty < F.col("h")) & (tx >= 0) & (tx < F.col("w"))
    return (
        sent.withColumn("_ty", ty)
        .withColumn("_tx", tx)
        .filter(inside)
        .groupBy(*keys, "_by", "_bx", "h", "w", F.col("_ty").alias("y"), F.col("_tx").alias("x"))
        .agg(*[F.sum(F.col(c) * F.col(f"k{i}")).alias(n) for n, (c, i) in values.items()])
    )


def core(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Keep each pixel in its own block only."""
    mine = (F.floor(F.col("y") / block) == F.col("_by")) & (
        F.floor(F.col("x") / block) == F.col("_bx")
    )
    return blocks.filter(mine).drop("_by", "_bx")


def stencil_join(
    pixels: DataFrame, keys: list[str], kernel: list[list[float]], value: str = "v",
    block: int = BLOCK,
) -> DataFrame:
    """Any odd k x k kernel on a pixel table; output column ``value``."""
    r = len(kernel) // 2
    taps = {
        (i - r, j - r): (k,) for i, row in enumerate(kernel) for j, k in enumerate(row)
    }
    out = scatter(blocked(pixels, keys, r, block), keys, taps, {value: (value, 0)})
    return core(out, block)


def sobel_pixels(
    pixels: DataFrame, keys: list[str], value: str = "v", block: int = BLOCK
) -> DataFrame:
    """Gradient magnitude, column ``edge``."""
    out = core(
        scatter(
            blocked(pixels, keys, 1, block), keys, SOBEL, {"_gx": (value, 0), "_gy": (value, 1)}
        ),
        block,
    )
    gx, gy = F.col("_gx"), F.col("_gy")
    return out.withColumn("edge", F.sqrt(gx * gx + gy * gy + 1e-12)).drop("_gx", "_gy")


def gaussian_pixels(
    pixels: DataFrame, keys: list[str], values: list[str], size: int = 11, sigma: float = 1.5,
    block: int = BLOCK,
) -> DataFrame:
    """Separable Gaussian of several columns at once: 2 x size rows per pixel, not size squared."""
    taps = gaussian_taps(size, sigma)
    r = size // 2
    across = {(0, j - r): (k,) for j, k in enumerate(taps)}
    down = {(j - r, 0): (k,) for j, k in enumerate(taps)}
    same = {c: (c, 0) for c in values}
    once = scatter(blocked(pixels, keys, r, block), keys, across, same)
    return core(scatter(once, keys, down, same), block)


def ssim_pixels(
    pixels: DataFrame, keys: list[str], a: str = "a", b: str = "b", block: int = BLOCK
) -> DataFrame:
    """Windowed structural similarity per frame from the pixel view of a pair."""
    m = pixels.select(
        *keys, "h", "w", "y", "x", F.col(a).alias("_a"), F.col(b).alias("_b"),
        (F.col(a) * F.col(a)).alias("_aa"), (F.col(b) * F.col(b)).alias("_bb"),
        (F.col(a) * F.col(b)).alias("_ab"),
    )
    g = gaussian_pixels(m, keys, ["_a", "_b", "_aa", "_bb", "_ab"], block=block)
    return (
        g.withColumn("_s", ssim_of_moments(*[F.col(c) for c in ("_a", "_b", "_aa", "_bb", "_ab")]))
        .groupBy(*keys)
        .agg(F.avg("_s").alias("ssim"))
    )


def ssim_of_moments(ma: Column, mb: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """Similarity of one window from its weighted first and second moments."""
    c1, c2 = 0.01**2, 0.03**2
    cross = ab - ma * mb
    spread = (aa - ma * ma) + (bb - mb * mb)
    return ((ma * mb * 2.0 + c1) * (cross * 2.0 + c2)) / (
        (ma * ma + mb * mb + c1) * (spread + c2) + 1e-12
    )
