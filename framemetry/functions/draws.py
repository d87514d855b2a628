"""Reproducible pseudo-random columns.

A draw is a function of (seed, row key, purpose) only, so it does not change with partitioning,
retries or executor loss. ``md5`` gives the same numbers in any SQL engine; ``xxhash64`` is cheaper.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from framemetry.functions.arrays import let

_SCALE = float(2**32)
_LOW = 2**32 - 1


def _columns(seed: int | Column, parts: tuple) -> list[Column]:
    return [p if isinstance(p, Column) else F.lit(p) for p in (seed, *parts)]


def _digest(seed: int | Column, parts: tuple, lane: int, algo: str) -> Column:
    """The hash a lane is taken from: lanes 0-3 of one md5, or pairs of lanes of one xxhash64."""
    key = _columns(seed, parts)
    if algo == "md5":
        return F.md5(F.concat_ws("|", *[k.cast("string") for k in key]))
    if algo == "xxhash64":
        return F.xxhash64(*key, F.lit(lane // 2))
    raise ValueError(f"unknown hash {algo!r}")


def _word(digest: Column, lane: int, algo: str) -> Column:
    """32 bits of a digest as a bigint."""
    if algo == "md5":
        return F.conv(F.substring(digest, 1 + 8 * lane, 8), 16, 10).cast("bigint")
    return digest.bitwiseAND(_LOW) if lane % 2 else F.shiftrightunsigned(digest, 32)


def _unit(word: Column) -> Column:
    return (word + F.lit(0.5)) / F.lit(_SCALE)


def bits32(seed: int | Column, *parts, lane: int = 0, algo: str = "md5") -> Column:
    """32 hash bits as a bigint. ``lane`` 0-3 picks one of four independent words."""
    return _word(_digest(seed, parts, lane, algo), lane, algo)


def uniform(seed: int | Column, *parts, lane: int = 0, algo: str = "md5") -> Column:
    """Uniform on the open interval (0, 1)."""
    return _unit(bits32(seed, *parts, lane=lane, algo=algo))


def uniform52(seed: int | Column, *parts, algo: str = "md5") -> Column:
    """Uniform on (0, 1) from 52 hash bits: every position of a table of any size can be met."""
    digest = _digest(seed, parts, 0, algo)
    word = (
        F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")
        if algo == "md5"
        else F.shiftrightunsigned(digest, 12)
    )
    return (word + F.lit(0.5)) / F.lit(float(2**52))


def normal(seed: int | Column, *parts, algo: str = "md5") -> Column:
    """Standard normal by Box-Muller from two words of one digest, computed once."""

    def box_muller(d: Column) -> Column:
        u, v = _unit(_word(d, 0, algo)), _unit(_word(d, 1, algo))
        return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)

    return let(_digest(seed, parts, 0, algo), box_muller)
