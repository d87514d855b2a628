"""Scalar and array column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from framemetry.functions.arrays import let

INF = float("inf")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- missing values: NaN means "no value" on output, NULL inside aggregates ---------------


def finite(c: Column | str) -> Column:
    """True for ordinary numbers; NaN orders above infinity, so one comparison is enough."""
    return F.abs(_col(c)) < F.lit(INF)


def finite_or_null(c: Column | str) -> Column:
    return F.when(finite(c), _col(c))


def nan_if_null(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(float("nan")))


def finite_mean(c: Column | str) -> Column:
    """Aggregate: mean over finite values, NaN when there are none."""
    return nan_if_null(F.avg(finite_or_null(c)))


def decimal_mean(c: Column | str) -> Column:
    """Aggregate: mean of doubles that are decimals of at most nine places, whatever the order of the rows.

    A sum of doubles depends on the order of addition, and equal means so may come out unequal. Decimals are added
    exactly, so equal means are equal. Groups with a value that is no such decimal have the plain mean.
    """
    exact = _col(c).cast("double").try_cast("decimal(28,9)")
    whole = F.count(_col(c)) == F.count_if(exact.cast("double") == _col(c))
    return F.when(whole, F.avg(exact).cast("double")).otherwise(F.avg(c))


def l2_norm(c: Column | str) -> Column:
    """Aggregate: Euclidean norm, NaN as soon as one element is not finite."""
    x = _col(c).cast("double")
    return F.when(
        F.bool_and(F.coalesce(finite(x), F.lit(False))), F.sqrt(F.sum(x * x))
    ).otherwise(F.lit(float("nan")))


# --- ranges -------------------------------------------------------------------------------


def clamp(c: Column | str, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NaN stays NaN."""
    c = _col(c)
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def clamp01(c: Column | str) -> Column:
    return clamp(c, 0.0, 1.0)


def clamp01_pixels(px: Column | str) -> Column:
    return F.transform(_col(px), clamp01)


def pixels_finite(px: Column | str) -> Column:
    """True when every element of the array is finite."""
    return F.forall(_col(px), lambda v: F.coalesce(finite(v), F.lit(False)))


def normalise_samples(samples: Column | str, bit_depth: Column | str) -> Column:
    """Integer samples to [0, 1]: 16-bit by 65535, everything else by 255."""
    top = F.when(_col(bit_depth) == 16, F.lit(65535.0)).otherwise(F.lit(255.0))
    return F.transform(
        _col(samples), lambda s: F.greatest(F.lit(0.0), F.least(F.lit(1.0), s / top))
    )


# --- picture scores from the mean squared error ---------------------------------------------


def psnr(mse: Column | str, variant: str = "full") -> Column:
    """Peak signal-to-noise ratio in dB for pixels in [0, 1].

    ``full``: 99 for a perfect match, else with 1e-12 added; ``plain``: 1e-8 added, no special
    case; ``pairs``: 50 below 1e-10, nothing added.
    """
    m = _col(mse)
    if variant == "full":
        return F.when(m <= 0, F.lit(99.0)).otherwise(-10.0 * F.log10(m + F.lit(1e-12)))
    if variant == "plain":
        return -10.0 * F.log10(m + F.lit(1e-8))
    if variant == "pairs":
        # the logarithm's argument is kept positive because both branches are typed eagerly
        return F.when(m < 1e-10, F.lit(50.0)).otherwise(
            -10.0 * F.log10(F.greatest(m, F.lit(1e-10)))
        )
    raise ValueError(f"unknown variant {variant!r}")


# --- strings and paths ------------------------------------------------------------------------


def slug(c: Column | str) -> Column:
    """Runs of anything but ASCII letters and digits become one underscore; trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(_col(c), "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def parse_position_list(c: Column | str) -> Column:
    """``"0,1, x,2"`` to ``[0, 1, 2]``: unreadable items dropped, nothing left gives NULL."""
    items = F.filter(
        F.transform(F.split(_col(c), ","), lambda s: F.trim(s)),
        lambda s: s.rlike("^[+-]?[0-9]+$"),
    )
    ints = F.filter(F.transform(items, lambda s: s.try_cast("int")), lambda i: i.isNotNull())
    return let(ints, lambda i: F.when(F.size(i) > 0, i))


def positions_in_range(c: Column | str, n: Column | int) -> Column:
    """Sorted list restricted to 0 <= i < n."""
    top = n if isinstance(n, Column) else F.lit(n)
    return F.array_sort(F.filter(_col(c), lambda i: (i >= 0) & (i < top)))


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def first_folder(path: Column | str) -> Column:
    """First path component; the empty string for a file that lies in the root."""
    parts = F.split(_col(path), "/")
    return F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(F.lit(""))


def last_two_parts(path: Column | str) -> Column:
    """Short path for reports. It can repeat across groups, so never use it as a key."""
    parts = F.split(_col(path), "/")
    return F.array_join(
        F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/"
    )


def _glob_pattern(glob: str) -> str:
    """The regular expression of a path glob; no wildcard crosses a slash."""
    made = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}

    def one(m: re.Match) -> str:
        piece = m.group()
        if piece[0] == "[":
            return piece.replace("[!", "[^", 1)
        if piece[0] == "{" and len(piece) > 1:
            return "".join(made.get(c) or re.escape(c) for c in piece)
        return made[piece] if piece in "*?" else re.escape(piece)

    return re.sub(r"\[[^\]]+\]|\{[^}]+\}|.", one, glob)


def relative_path(path: Column | str, root: str) -> Column:
    """Part of ``path`` below ``root``, whatever scheme and host stand in front of either.

    An absolute root, which may be a glob, matches from the start of the path; a relative one where it
    first occurs (``scan_frames`` resolves it before). A path that is not below the root is kept."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/")
    start = "^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?" + ("" if bare.startswith("/") else ".*?/")
    return F.regexp_replace(_col(path), f"{start}{_glob_pattern(bare)}/", "")


def fixed(c: Column | str, digits: int) -> Column:
    """Fixed-decimal text; values that are no ordinary numbers are written nan, inf and -inf."""
    c = _col(c)
    return (
        F.when(F.isnan(c) | c.isNull(), F.lit("nan"))
        .when(finite(c), F.format_string(f"%.{digits}f", c))
        .otherwise(F.when(c > 0, F.lit("inf")).otherwise(F.lit("-inf")))
    )


def mean_std_label(mean: Column | str, sd: Column | str) -> Column:
    return F.format_string("%.2f±%.2f", _col(mean), _col(sd))


def default_lower(c: Column | str, default: str) -> Column:
    """Lower-cased option with a default for NULL and empty text."""
    return F.lower(F.coalesce(F.nullif(_col(c), F.lit("")), F.lit(default)))


# --- small maths ---------------------------------------------------------------------------------


def sigmoid(c: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(c)))


def softplus(c: Column | str) -> Column:
    """log(1 + e^x) without overflow for large x."""
    c = _col(c)
    return F.greatest(c, F.lit(0.0)) + F.log1p(F.exp(-F.abs(c)))


def logit(c: Column | str) -> Column:
    c = _col(c)
    return F.log(c / (1.0 - c))
