"""Re-weighting of channel vectors by a gate computed from their neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framemetry.functions.arrays import at, let
from framemetry.functions.scalars import finite_mean, sigmoid, softplus

TEMP_MIN = 1e-6
GAIN_MIN = 0.01
GAIN_MAX = 1.5


def conv1d(v: Column, kernel: list[float]) -> Column:
    """Zero-padded cross-correlation of a vector with an odd kernel."""
    half = len(kernel) // 2

    def tap(p, i):
        out = F.lit(0.0)
        for j, k in enumerate(kernel):
            out = out + F.lit(float(k)) * at(p, i + (j - half))
        return out

    return let(v, lambda p: F.transform(p, lambda x, i: tap(p, i)))


def _mean_of(arrays: list[Column]) -> Column:
    total = arrays[0]
    for a in arrays[1:]:
        total = F.zip_with(total, a, lambda p, q: p + q)
    return F.transform(total, lambda v: v / F.lit(float(len(arrays))))


def learned_temp(log_temp: float | Column) -> Column:
    """Learnable temperature: softplus of the stored parameter plus the floor."""
    return softplus(F.lit(log_temp) if not isinstance(log_temp, Column) else log_temp) + TEMP_MIN


def learned_gain(raw: float | Column, lo: float = GAIN_MIN, hi: float = GAIN_MAX) -> Column:
    """Learnable gain: sigmoid of the stored parameter stretched to [lo, hi]."""
    return sigmoid(F.lit(raw) if not isinstance(raw, Column) else raw) * (hi - lo) + lo


def gate(
    avg: Column, kernels: list[list[float]], temp: float | Column = 0.75,
    maxed: Column | None = None, max_kernel: list[float] | None = None,
) -> Column:
    """Gate in (0, 1) per channel.

    One kernel: its correlation with the average branch, averaged with that of ``max_kernel`` and
    the maximum branch when given. Several kernels (multi-scale): branches are averaged first, then
    the results of all kernels.
    """
    if len(kernels) > 1:
        base = avg if maxed is None else _mean_of([avg, maxed])
        y = let(base, lambda b: _mean_of([conv1d(b, k) for k in kernels]))
    elif maxed is not None:
        y = _mean_of([conv1d(avg, kernels[0]), conv1d(maxed, max_kernel or kernels[0])])
    else:
        y = conv1d(avg, kernels[0])
    t = temp if isinstance(temp, Column) else F.lit(float(temp))
    return F.transform(y, lambda v: sigmoid(v / F.greatest(t, F.lit(TEMP_MIN))))


def apply_gate(
    v: Column, g: Column, gain: float | Column = 0.5, centered: bool = True,
    gain_range: tuple[float, float] | None = None,
) -> Column:
    """v (1 + 2 gain (g - 1/2)), or v g when not centred. ``gain_range`` limits the gain."""
    if not centered:
        return F.zip_with(v, g, lambda x, y: x * y)
    k = gain if isinstance(gain, Column) else F.lit(float(gain))
    if gain_range:
        k = F.greatest(F.lit(gain_range[0]), F.least(F.lit(gain_range[1]), k))
    return F.zip_with(v, g, lambda x, y: x * ((y - 0.5) * 2.0 * k + 1.0))


def channel_gate(
    df: DataFrame, column: str, kernels: list[list[float]], temp: float | Column = 0.75,
    gain: float | Column = 0.5, centered: bool = True, max_column: str | None = None,
    max_kernel: list[float] | None = None, gain_range: tuple[float, float] | None = None,
    out: str = "gated", gate_out: str = "gate",
) -> DataFrame:
    """Adds the gate and the re-weighted vector; a row-local operation."""
    maxed = F.col(max_column) if max_column else None
    return df.withColumn(gate_out, gate(F.col(column), kernels, temp, maxed, max_kernel)).withColumn(
        out, apply_gate(F.col(column), F.col(gate_out), gain, centered, gain_range)
    )


def gate_stats(gates: DataFrame, layer: str, gate: str = "gate", temp: str = "temp", gain: str = "gain"):
    """Per layer: mean gate over rows and channels, finite mean of temperature and gain."""
    return gates.groupBy(layer).agg(
        (F.sum(F.aggregate(gate, F.lit(0.0), lambda s, v: s + v)) / F.sum(F.size(gate))).alias(
            "gate_mean"
        ),
        finite_mean(temp).alias("temp_mean"),
        finite_mean(gain).alias("gain_mean"),
    )


def calibration_means(df: DataFrame, gate: str = "gate") -> Column:
    """Mean gate per channel as one array (a scalar subquery of one row, one entry per channel).

    Gates are unpacked where they are and reduced to one row per channel and task.
    """
    per_channel = df.select(F.posexplode(gate).alias("channel", "g")).groupBy("channel").agg(
        F.avg("g").alias("g")
    )
    return per_channel.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("channel", "g"))), lambda s: s["g"])
    ).scalar()


def gate_mean_intervention(
    df: DataFrame, column: str, gate: str = "gate", gain: float = 0.5, centered: bool = True,
    replace: str | tuple[str, ...] = "mean",
) -> DataFrame:
    """Adds ``original`` and the same vectors with every row's own gate replaced by the mean over all
    rows (``mean``) or by one (``ones``): ``intervened``, or for several replacements in one pass
    ``intervened_<name>`` each."""
    several = not isinstance(replace, str)
    out = df.withColumn("original", apply_gate(F.col(column), F.col(gate), gain, centered))
    for how in replace if several else (replace,):
        other = F.transform(F.col(gate), lambda g: F.lit(1.0)) if how == "ones" else F.col("_mean_gate")
        if how == "mean":
            out = out.withColumn("_mean_gate", calibration_means(df, gate))
        name = f"intervened_{how}" if several else "intervened"
        out = out.withColumn(name, apply_gate(F.col(column), other, gain, centered))
    return out.drop("_mean_gate")
