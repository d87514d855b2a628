"""Tables behind figures: order, labels, text, axis limits. Nothing is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framemetry.functions.scalars import mean_std_label, slug
from framemetry.operators.checks import pick_column, require_columns
from framemetry.operators.prefix import placed
from framemetry.operators.runs import group_spans

# Label columns in order of preference (fixed values).
LABEL_COLUMNS = ["pipeline_label_short", "pipeline_label_full", "pipeline"]


def _limits(wanted_lo: Column, wanted_hi: Column) -> list[Column]:
    return [wanted_lo.alias("axis_lo"), wanted_hi.alias("axis_hi")]


def axis_by_spread(mean: Column, sd: Column) -> list[Column]:
    """Aggregates: range of mean -+ SD plus max(0.5, 20 %) on both sides, kept within 0..100."""
    lo, hi = F.min(mean - sd), F.max(mean + sd)
    margin = F.greatest(F.lit(0.5), (hi - lo) * 0.2)
    return _limits(F.greatest(F.lit(0.0), lo - margin), F.least(F.lit(100.0), hi + margin))


def axis_by_range(value: Column, margin: float = 1.0) -> list[Column]:
    """Aggregates: tight for ranges below 3, looser below 10, from zero above; within 0..100."""
    lo, hi = F.min(value), F.max(value)
    spread = hi - lo
    wanted_lo = (
        F.when(spread < 3, F.greatest(F.lit(0.0), lo - margin))
        .when(spread < 10, F.greatest(F.lit(0.0), lo - 1.5))
        .otherwise(F.lit(0.0))
    )
    more = F.when(spread < 3, F.lit(margin)).when(spread < 10, F.lit(1.0)).otherwise(F.lit(2.0))
    return _limits(wanted_lo, F.least(F.lit(100.0), hi + more))


def axis_by_margin(value: Column) -> list[Column]:
    """Aggregates: 8 % of the range (at least 0.2) below, twice that above, not below zero."""
    lo, hi = F.min(value), F.max(value)
    margin = F.greatest(F.lit(0.2), F.when(hi > lo, hi - lo).otherwise(F.lit(1.0)) * 0.08)
    return _limits(F.greatest(F.lit(0.0), lo - margin), hi + margin * 2)


def axis_title(metric: str) -> Column:
    m = F.lower(metric)
    return (
        F.when(F.startswith(m, F.lit("macro")), F.lit("Macro-F1 (%)"))
        .when(F.startswith(m, F.lit("accuracy")), F.lit("Accuracy (%)"))
        .otherwise(F.col(metric))
    )


def robustness_plot_data(df: DataFrame) -> DataFrame:
    """Per metric and arm: value, spread, ``mean±sd`` text, figure name, axis title and limits.

    ``plot_order`` is carried along if present; sorting is left to whoever prints the table.
    """
    require_columns(df, ["model_label", "metric", "mean", "std"])
    rows = df.filter(F.col("metric").isNotNull())
    limits = rows.groupBy("metric").agg(*axis_by_spread(F.col("mean"), F.col("std")))
    order = ["plot_order"] if "plot_order" in df.columns else []
    return rows.join(limits, "metric").select(
        "metric", *order, "model_label", "mean", "std",
        mean_std_label("mean", "std").alias("text"),
        F.concat(F.lit("robustness_"), slug("metric")).alias("figure"),
        axis_title("metric").alias("axis"),
        "axis_lo", "axis_hi",
    )


def downstream_plot_data(df: DataFrame, metric: str) -> DataFrame:
    """One bar per pipeline: label, value, its text, order and regime, with axis limits."""
    require_columns(df, [metric])
    label = pick_column(df, LABEL_COLUMNS)
    limits = df.agg(F.struct(*axis_by_range(F.col(metric).cast("double"))).alias("l"))
    extra = [c for c in ("group_order", "regime_group") if c in df.columns]
    return (
        df.withColumn("_l", limits.select("l").scalar())
        .select(
            *extra, F.col(label).cast("string").alias("label"),
            F.col(metric).cast("double").alias("value"),
            F.format_string("%.2f", F.col(metric).cast("double")).alias("text"),
            F.col("_l.axis_lo").alias("axis_lo"), F.col("_l.axis_hi").alias("axis_hi"),
        )
    )


def downstream_spans(df: DataFrame) -> DataFrame:
    """(regime_group, start, end) along ``group_order``."""
    return group_spans(df, ["group_order"], "regime_group")


def latency_plot_data(df: DataFrame, with_params: bool = False) -> DataFrame:
    """Model, latency and, on request and if present, parameter count, with axis limits each."""
    require_columns(df, ["model", "latency_ms"])
    columns = ["latency_ms"] + (["params"] if with_params and "params" in df.columns else [])
    digits = {"latency_ms": "%.3f", "params": "%.0f"}
    limits = df.agg(*[F.struct(*axis_by_margin(F.col(c).cast("double"))).alias(c) for c in columns])
    out = df
    for c in columns:
        out = out.withColumn(f"_{c}", limits.select(c).scalar())
    return out.select(
        "model",
        *[
            col
            for c in columns
            for col in (
                F.col(c).cast("double").alias(c),
                F.format_string(digits[c], F.col(c).cast("double")).alias(f"{c}_text"),
                F.col(f"_{c}.axis_lo").alias(f"{c}_axis_lo"),
                F.col(f"_{c}.axis_hi").alias(f"{c}_axis_hi"),
            )
        ],
    )


def place_in_order(df: DataFrame, keys: list[str], order: list[str], name: str = "plot_order") -> DataFrame:
    """Position of each row within its key along ``order``, from 1, for keys of any size."""
    return placed(df, keys, order, name)
