"""Classifier scores. Rows are reduced to a confusion table first; everything else works on that."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType

from framemetry.operators import stacks
from framemetry.operators.prefix import join_same


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class and the inverse-frequency weight."""
    return (
        df.groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("weight", 1.0 / F.col("n"))
    )


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Every row with the weight of its class. The class table is small unless proven otherwise,
    so the choice of join is left to the planner, which knows its measured size. NULL is a class."""
    return join_same(df, class_counts(df, label), [label])


def confusion_table(df: DataFrame, keys: list[str], true: str, pred: str) -> DataFrame:
    return df.groupBy(*keys, true, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_counts(
    df: DataFrame, keys: list[str] | None = None, true: str = "true", pred: str = "pred"
) -> DataFrame:
    """Per class of the union of true and predicted classes: tp, support, predicted."""
    keys = keys or []
    zero = F.lit(0).cast("bigint")
    cells = F.array(
        F.struct(
            F.col(true).alias("class"),
            F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(zero).alias("tp"),
            F.col("n").alias("support"),
            zero.alias("predicted"),
        ),
        F.struct(
            F.col(pred).alias("class"), zero.alias("tp"), zero.alias("support"),
            F.col("n").alias("predicted"),
        ),
    )
    return (
        confusion_table(df, keys, true, pred)
        .select(*keys, F.inline(cells))
        .groupBy(*keys, "class")
        .agg(
            F.sum("tp").alias("tp"),
            F.sum("support").alias("support"),
            F.sum("predicted").alias("predicted"),
        )
    )


def per_class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class; a zero denominator scores 0."""

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return (
        counts.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("tp"), F.col("support")))
        .withColumn("f1", ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support")))
    )


def classification_report(
    df: DataFrame, keys: list[str] | None = None, true: str = "true", pred: str = "pred"
) -> DataFrame:
    """Accuracy and unweighted mean F1 over the classes seen on either side, per key."""
    keys = keys or []
    return (
        per_class_scores(confusion_counts(df, keys, true, pred))
        .groupBy(*keys)
        .agg(
            (F.sum("tp") / F.sum("support")).alias("accuracy"),
            F.avg("precision").alias("macro_precision"),
            F.avg("recall").alias("macro_recall"),
            F.avg("f1").alias("macro_f1"),
            F.sum("support").alias("n"),
        )
    )


def group_classification(df: DataFrame, board: str, arm: str, **cols) -> DataFrame:
    """The report per board and arm."""
    return classification_report(df, [board, arm], **cols)


def balanced_class_f1(df: DataFrame, board: str, arm: str, **cols) -> DataFrame:
    """Per arm and class, the mean over boards of the class's F1 on that board, so that a large
    board weighs no more than a small one."""
    scores = per_class_scores(confusion_counts(df, [board, arm], **cols))
    return scores.groupBy(arm, "class").agg(
        F.avg("f1").alias("balanced_f1"), F.count(F.lit(1)).alias("boards")
    )


# --- a classifier behind a denoiser -----------------------------------------------------------------


def classify_frames(
    frames: DataFrame, classify: Callable[[np.ndarray], np.ndarray], denoise: Callable[[np.ndarray], np.ndarray] | None = None,
    column: str = "pixels", pred: str = "pred",
) -> DataFrame:
    """``frames`` without their pixels and with the class that ``classify`` gives each: a function of a stack (n, h, w) that
    gives n whole numbers. ``denoise``, if given, runs before it on the same stack, and what it gives is clamped to
    [0, 1]. A frame without pixels, or whose pixels are not all finite after the denoiser, has no class (NULL)."""
    keep = [c for c in frames.columns if c not in (column, pred)]

    def run(x: np.ndarray) -> dict[str, np.ndarray]:
        if denoise is not None:
            x = np.clip(denoise(x), 0.0, 1.0)
        usable = np.isfinite(x).all((1, 2))
        found = np.full(len(x), None, object)
        if usable.any():
            found[usable] = np.asarray(classify(x[usable])).astype(np.int64).tolist()
        return {pred: found}

    return stacks.on_stacks(frames, keep, [column], {pred: LongType()}, run)


def denoised_report(
    frames: DataFrame, true: str, classify: Callable[[np.ndarray], np.ndarray], denoise: Callable[[np.ndarray], np.ndarray] | None = None,
    keys: list[str] | None = None, column: str = "pixels",
) -> DataFrame:
    """The classification report of frames with and, if given, behind a denoiser: clamp, classify and report in one plan.
    Frames without a class are left out and counted as ``skipped``."""
    keys = keys or []
    found = classify_frames(frames.select(*dict.fromkeys([*keys, true, "h", "w", column])), classify, denoise, column, "_pred")
    report = classification_report(found.where(F.col("_pred").isNotNull()), keys, true, "_pred")
    skipped = found.groupBy(*keys).agg(F.count_if(F.col("_pred").isNull()).alias("skipped"))
    return join_same(skipped, report, keys, "left") if keys else report.withColumn("skipped", skipped.scalar())
