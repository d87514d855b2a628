"""Synthetic disturbance. Draws are hashes of (seed, frame, pixel), so a frame gets the same noise
wherever and however often it is computed.

``algo='xxhash64'`` is the fast choice for pixels; ``md5`` gives numbers any SQL engine reproduces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framemetry.functions import draws
from framemetry.functions.arrays import array_mean, let
from framemetry.functions.scalars import clamp, clamp01

# Shape and scale of the Burr-XII speckle (fixed values).
BURR_C = 4.687
BURR_K = 1189.53


def _normals(seed: int, i: Column, what: str, frame: str, algo: str) -> Column:
    return draws.normal(seed, F.col(frame), i, what, algo=algo)


def gaussian(
    px: Column, sigma: float, seed: int, frame: str = "frame_id", algo: str = "xxhash64"
) -> Column:
    """x + sigma N, not clamped."""
    return F.transform(px, lambda v, i: v + _normals(seed, i, "gauss", frame, algo) * sigma)


def speckle_gauss(
    px: Column, strength: float, seed: int, frame: str = "frame_id", algo: str = "xxhash64"
) -> Column:
    """x times a normal factor around one, the factor limited to [0, 3]."""
    return F.transform(
        px,
        lambda v, i: v
        * clamp(_normals(seed, i, "speckle", frame, algo) * strength + 1.0, 0.0, 3.0),
    )


def burr_multiplier(u: Column) -> Column:
    """Inverse Burr-XII distribution function."""
    u = F.greatest(F.lit(1e-6), F.least(F.lit(1.0 - 1e-6), u))
    return F.pow(F.greatest(F.pow(1.0 - u, F.lit(-1.0 / BURR_K)) - 1.0, F.lit(0.0)), F.lit(1.0 / BURR_C))


def speckle_burr(
    px: Column, strength: float, seed: int, frame: str = "frame_id", algo: str = "xxhash64"
) -> Column:
    """x times a Burr factor scaled to mean one over the frame; result limited to [0, 3]."""
    factors = F.transform(
        px,
        lambda v, i: F.struct(
            v.alias("v"),
            burr_multiplier(draws.uniform(seed, F.col(frame), i, "burr", algo=algo)).alias("m"),
        ),
    )
    return let(
        factors,
        lambda f: let(
            array_mean(F.transform(f, lambda s: s["m"])),
            lambda mean: F.transform(
                f,
                lambda s: clamp(
                    s["v"] * ((s["m"] / (mean + 1e-9) - 1.0) * strength + 1.0), 0.0, 3.0
                ),
            ),
        ),
    )


def noisy(
    px: Column, sigma: float, speckle: float, kind: str, seed: int,
    frame: str = "frame_id", algo: str = "xxhash64",
) -> Column:
    """Speckle first, then Gaussian, then clamp to [0, 1]; a part is off at 0."""
    makers = {"": speckle_gauss, "gauss": speckle_gauss, "burr": speckle_burr}
    make = makers.get((kind or "").lower())
    if make is None:
        raise ValueError(f"unknown speckle kind {kind!r}")
    out = px
    if speckle > 0:
        out = make(out, speckle, seed, frame, algo)
    if sigma > 0:
        out = gaussian(out, sigma, seed, frame, algo)
    return F.transform(out, clamp01)


def add_noise(
    frames: DataFrame, sigma: float = 0.02, speckle: float = 0.2, kind: str = "gauss",
    seed: int = 0, column: str = "pixels", out: str | None = None, algo: str = "xxhash64",
) -> DataFrame:
    return frames.withColumn(
        out or column, noisy(F.col(column), sigma, speckle, kind, seed, algo=algo)
    )


def add_stress(
    frames: DataFrame, sigma_8bit: float = 25.0, seed: int = 0, column: str = "pixels",
    algo: str = "xxhash64",
) -> DataFrame:
    """Gaussian noise given on the 8-bit scale, clamped; nothing happens at 0."""
    return add_noise(frames, sigma_8bit / 255.0, 0.0, "gauss", seed, column, algo=algo)


def add_additive(
    frames: DataFrame, sigma: float, speckle: float, seed: int = 0, column: str = "pixels",
    algo: str = "xxhash64",
) -> DataFrame:
    """Older form: both parts are additive and independent, one clamp at the end."""

    def disturb(v, i):
        return clamp01(
            v
            + _normals(seed, i, "gauss", "frame_id", algo) * sigma
            + _normals(seed, i, "speckle", "frame_id", algo) * speckle
        )

    return frames.withColumn(column, F.transform(F.col(column), disturb))
