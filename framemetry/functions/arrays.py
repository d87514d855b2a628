"""Pictures as row-major arrays: index arithmetic in array expressions, one row per picture.

Nothing here moves rows between tasks. ``let`` names an intermediate array inside an expression;
without it the optimiser may inline the array into a lambda and recompute it per element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def at(a: Column, i: Column) -> Column:
    """Element ``i`` from 0, zero outside the array (zero padding)."""
    return F.coalesce(F.get(a, i.cast("int")), F.lit(0.0))


def upto(n: Column | int) -> Column:
    """[0, 1, ..., n-1]; empty for n = 0."""
    n = (F.lit(n) if isinstance(n, int) else n).cast("int")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def image_rows(px: Column, h: Column, w: Column) -> Column:
    """Flat pixels to an array of picture rows."""
    return let(px, lambda p: F.transform(upto(h), lambda y: F.slice(p, y * w + 1, w)))


def crop(px: Column, w: Column, top: Column, left: Column, ch: Column, cw: Column) -> Column:
    """Flat pixels of the ``ch`` x ``cw`` window at (top, left)."""
    corner = F.struct(top.alias("top"), left.alias("left"))
    return let(
        corner,
        lambda c: let(
            px,
            lambda p: F.flatten(
                F.transform(
                    upto(ch), lambda y: F.slice(p, (c["top"] + y) * w + c["left"] + 1, cw)
                )
            ),
        ),
    )


def remap(px: Column, w: Column, oh: Column, ow: Column, src_y, src_x) -> Column:
    """Flat pixels of an ``oh`` x ``ow`` picture whose (y, x) comes from (src_y(y, x), src_x(y, x));
    a source outside the picture is NULL to the caller's functions and 0 in the result."""

    def pixel(p, i):
        y, x = F.floor(i / ow).cast("int"), (i % ow).cast("int")
        return at(p, src_y(y, x) * w + src_x(y, x))

    return let(px, lambda p: F.transform(upto(oh * ow), lambda i: pixel(p, i)))


def mirror(i: Column, n: Column) -> Column:
    """Source index of reflection without repeating the edge, any distance beyond it."""
    period = F.greatest((n - 1) * 2, F.lit(1))
    m = i % period
    return F.when(m < n, m).otherwise(period - m)


def reflect_pad(px: Column, h: Column, w: Column, oh: Column, ow: Column) -> Column:
    """Grow to at least ``oh`` x ``ow`` by mirroring at the bottom and right."""
    th, tw = F.greatest(h, oh), F.greatest(w, ow)
    return remap(px, w, th, tw, lambda y, x: mirror(y, h), lambda y, x: mirror(x, w))


def flip(px: Column, h: Column, w: Column, vertical: Column, horizontal: Column) -> Column:
    """Mirror rows (vertical) and columns (horizontal) as decided per picture."""
    return let(
        F.struct(vertical.alias("v"), horizontal.alias("h")),
        lambda f: remap(
            px, w, h, w,
            lambda y, x: F.when(f["v"], h - 1 - y).otherwise(y),
            lambda y, x: F.when(f["h"], w - 1 - x).otherwise(x),
        ),
    )


# --- filters with zero padding --------------------------------------------------------------------------


def gaussian_taps(size: int = 11, sigma: float = 1.5) -> list[float]:
    """Normalised one-dimensional Gaussian; its outer product is the two-dimensional window."""
    half = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(size // 2 + 1)]
    total = 2.0 * math.fsum(half) - half[0]
    return [half[abs(d)] / total for d in range(-(size // 2), size // 2 + 1)]


def _weighted(taps: list[float], take: Callable[[int], Column]) -> Column:
    half = len(taps) // 2
    out = None
    for j, k in enumerate(taps):
        term = F.lit(k) * take(j - half)
        out = term if out is None else out + term
    return out


def blur(px: Column, h: Column, w: Column, taps: list[float]) -> Column:
    """Separable filter: along rows, then along columns."""
    along_rows = F.transform(
        image_rows(px, h, w),
        lambda r: F.transform(r, lambda v, x: _weighted(taps, lambda d: at(r, x + d))),
    )
    return let(
        along_rows,
        lambda rows: F.flatten(
            F.transform(
                rows,
                lambda r, y: F.transform(
                    r, lambda v, x: _weighted(taps, lambda d: at(F.get(rows, y + d), x))
                ),
            )
        ),
    )


def sobel(px: Column, h: Column, w: Column) -> Column:
    """Gradient magnitude of the 3x3 Sobel pair, 1e-12 under the root."""

    def magnitude(up, mid, dn, x):
        gx = (
            at(up, x + 1) - at(up, x - 1) + (at(mid, x + 1) - at(mid, x - 1)) * 2.0
            + at(dn, x + 1) - at(dn, x - 1)
        )
        gy = (
            at(dn, x - 1) + at(dn, x) * 2.0 + at(dn, x + 1)
            - at(up, x - 1) - at(up, x) * 2.0 - at(up, x + 1)
        )
        return let(F.struct(gx.alias("x"), gy.alias("y")),
                   lambda g: F.sqrt(g["x"] * g["x"] + g["y"] * g["y"] + 1e-12))

    return let(
        image_rows(px, h, w),
        lambda rows: F.flatten(
            F.transform(
                rows,
                lambda r, y: F.transform(
                    r, lambda v, x: magnitude(F.get(rows, y - 1), r, F.get(rows, y + 1), x)
                ),
            )
        ),
    )


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def array_mean(a: Column) -> Column:
    return let(a, lambda p: array_sum(p) / F.size(p))


def array_quantile(a: Column, q: float) -> Column:
    """Quantile with linear interpolation between order statistics."""

    def pick(s):
        pos = F.lit(q) * (F.size(s) - 1)
        lo = F.floor(pos).cast("int")
        hi = F.least(lo + 1, F.size(s) - 1)
        return F.get(s, lo) + (pos - lo) * (F.get(s, hi) - F.get(s, lo))

    return let(F.sort_array(a), pick)
