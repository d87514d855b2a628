"""Training-run logs: roll-ups, best-so-far, patience, budgets, checkpoint choice, spans."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from framemetry.functions.scalars import finite, finite_or_null, nan_if_null
from framemetry.operators.prefix import BUCKET, bucket_of, in_bucket, in_ranges, join_same, smallest_rows, with_carry
from framemetry.operators.selection import countable, nth_place
from framemetry.session import written

# Rows of one bucket of a running aggregate; a run of any length is cut into such pieces.
WIDTH = 65536


def _usable(loss: str, grad_norm: str | None) -> Column:
    ok = F.coalesce(finite(loss), F.lit(False))
    return ok & F.coalesce(finite(grad_norm), F.lit(False)) if grad_norm else ok


def epoch_rollup(
    batches: DataFrame,
    keys: list[str],
    loss: str = "loss",
    grad_norm: str | None = None,
    empty: str = "nan",
) -> DataFrame:
    """Mean loss over usable batches with seen / used / bad counters.

    ``empty`` is the mean when nothing was usable: ``nan``, or ``zero`` for logs that divide by
    max(n, 1).
    """
    ok = _usable(loss, grad_norm)

    def mean(c: str) -> Column:
        m = F.avg(F.when(ok, F.col(c)))
        return nan_if_null(m) if empty == "nan" else F.coalesce(m, F.lit(0.0))

    return batches.groupBy(*keys).agg(
        mean(loss).alias("loss"),
        F.count_if(~ok).alias("bad"),
        F.count(F.lit(1)).alias("seen"),
        F.count_if(ok).alias("used"),
        *([mean(grad_norm).alias("grad_norm")] if grad_norm else []),
    )


def every_n_epochs(log: DataFrame, n: int, epoch: str = "epoch") -> DataFrame:
    """Epochs on which a periodic evaluation runs; none when n <= 0."""
    return log.filter(F.col(epoch) % n == 0) if n > 0 else log.filter(F.lit(False))


# --- best so far -----------------------------------------------------------------------------------


def best_so_far(
    log: DataFrame,
    keys: list[str],
    metric: str,
    mode: str = "min",
    epoch: str = "epoch",
    start_value: float | None = None,
    start_epoch: int = 0,
    width: int = WIDTH,
) -> DataFrame:
    """Add ``best``, ``best_epoch`` and ``is_best`` as known after each epoch.

    Non-finite values never improve anything, nor do rows without an epoch, which come first in their
    run. Improvements are strict.
    """
    return best_of_each(log, keys, {"": (metric, mode, start_value)}, epoch, start_epoch, width)


def best_of_each(
    log: DataFrame,
    keys: list[str],
    metrics: dict[str, tuple[str, str, float | None]],
    epoch: str = "epoch",
    start_epoch: int = 0,
    width: int = WIDTH,
) -> DataFrame:
    """``best_so_far`` of several metrics in one pass: ``metrics`` maps the prefix of the new columns to
    (metric, mode, start value).

    The running minimum of (metric, epoch) names the first epoch of the best value, so one window
    carries both; all metrics share the buckets, the carry and the sort.
    """

    def candidate(metric: str, mode: str, start_value: float | None) -> Column:
        ok = F.coalesce(finite(metric), F.lit(False)) & F.col(epoch).isNotNull()
        if start_value is not None:
            ok = ok & ((F.col(metric) < start_value) if mode == "min" else (F.col(metric) > start_value))
        value = F.col(metric) if mode == "min" else -F.col(metric)
        return F.when(ok, F.struct(value.alias("m"), F.col(epoch).cast("bigint").alias("e")))

    made = {f"_cand_{p}": candidate(*spec) for p, spec in metrics.items()}
    carried = with_carry(
        log.withColumns(made), keys, bucket_of(F.col(epoch), width),
        {f"_carry_{p}": (F.min(f"_cand_{p}"), "min") for p in metrics},
    )
    w = in_bucket(keys, [epoch])
    out = carried.withColumns(
        {f"_run_{p}": F.least(F.col(f"_carry_{p}"), F.min(f"_cand_{p}").over(w)) for p in metrics}
    )
    for p, (_, mode, _) in metrics.items():
        best = F.col(f"_run_{p}.m")
        out = out.withColumns({
            f"{p}best": best if mode == "min" else -best,
            f"{p}best_epoch": F.coalesce(F.col(f"_run_{p}.e"), F.lit(start_epoch).cast("bigint")),
            f"{p}is_best": F.coalesce(F.col(f"_run_{p}.e") == F.col(epoch), F.lit(False)),
        })
    return out.drop(BUCKET, *[f"{kind}_{p}" for p in metrics for kind in ("_cand", "_carry", "_run")])


def early_stop(
    log: DataFrame,
    keys: list[str],
    metric: str = "val_loss",
    patience: int = 12,
    epoch: str = "epoch",
    start_epoch: int = 0,
    width: int = WIDTH,
) -> DataFrame:
    """Per run: first epoch with ``epoch - best_epoch >= patience`` (NULL if none), the best so far
    then (or at the end of the log) and the number of epochs up to there."""
    b = best_so_far(log, keys, metric, "min", epoch, None, start_epoch, width)
    waiting = F.col(epoch) - F.col("best_epoch") >= patience
    stops = b.withColumn("_stop", waiting)
    seen = F.struct(F.col("best_epoch"), F.col("best"))
    return (
        stops.groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_stop"), F.col(epoch))).alias("stop_epoch"),
            F.min_by(seen, F.when(F.col("_stop"), F.col(epoch))).alias("_at_stop"),
            F.max_by(seen, F.col(epoch)).alias("_at_end"),
        )
        .withColumn("_at", F.coalesce("_at_stop", "_at_end"))
        .select(
            *keys,
            "stop_epoch",
            F.col("_at.best_epoch").alias("best_epoch"),
            F.col("_at.best").alias("best"),
        )
    )


def best_checkpoint(
    log: DataFrame, keys: list[str], by: dict[str, str], epoch: str = "epoch"
) -> DataFrame:
    """Per run and criterion, the epoch to keep: arg-min or arg-max, first epoch on ties.

    ``by`` maps a metric column to ``min`` or ``max``. A plain aggregate, so runs may be any size.
    """
    aggs = []
    for metric, mode in by.items():
        m = finite_or_null(metric)
        if mode == "min":
            key = F.when(m.isNotNull(), F.struct(m.alias("m"), F.col(epoch).alias("e")))
            pick = F.min(key)
            first = pick["e"]
        else:
            key = F.when(m.isNotNull(), F.struct(m.alias("m"), (-F.col(epoch)).alias("e")))
            pick = F.max(key)
            first = -pick["e"]
        aggs += [first.alias(f"{metric}_epoch"), pick["m"].alias(f"{metric}_best")]
    return log.groupBy(*keys).agg(*aggs)


def matched_epoch(log: DataFrame, at: int, epoch: str = "epoch") -> DataFrame:
    """All arms at one fixed epoch, instead of each at its own best."""
    return log.filter(F.col(epoch) == at)


def latest_state(
    log: DataFrame, keys: list[str], columns: list[str], epoch: str = "epoch"
) -> DataFrame:
    """Last row per run and the epoch to resume from."""
    last = F.max_by(F.struct(*columns), F.col(epoch))
    return (
        log.groupBy(*keys)
        .agg(F.max(epoch).alias("last_epoch"), last.alias("_row"))
        .select(
            *keys, "last_epoch", (F.col("last_epoch") + 1).alias("resume_epoch"), "_row.*"
        )
    )


# --- budget of bad batches -------------------------------------------------------------------------


def nonfinite_budget(
    batches: DataFrame,
    keys: list[str],
    order: str = "batch",
    loss: str = "loss",
    grad_norm: str | None = None,
    max_bad: int = 3,
    action: str = "stop",
    width: int = WIDTH,
) -> DataFrame:
    """Batches an epoch really processes, with ``is_bad`` and the running ``bad_so_far``.

    With ``action='stop'`` the batch that exceeds the budget is the last one seen; it is kept here
    (it was seen and counted) and marked ``is_stop``.
    """
    bad = (~_usable(loss, grad_norm)).cast("bigint")
    carried = with_carry(
        batches.withColumn("_bad", bad),
        keys,
        bucket_of(F.col(order), width),
        {"_before": (F.sum("_bad"), "sum")},
    )
    so_far = F.coalesce(F.col("_before"), F.lit(0)) + F.sum("_bad").over(in_bucket(keys, [order]))
    out = (
        carried.withColumn("bad_so_far", so_far)
        .withColumn("is_bad", F.col("_bad") == 1)
        .withColumn(
            "is_stop",
            (F.lit(action) == "stop") & F.col("is_bad") & (F.col("bad_so_far") > max_bad),
        )
    )
    if action == "stop":
        out = out.filter(F.col("bad_so_far") - F.col("_bad") <= max_bad)
    return out.drop("_bad", "_before", BUCKET)


def budget_rollup(
    batches: DataFrame, run: list[str], epoch: str = "epoch", **budget
) -> DataFrame:
    """Per run and epoch: seen, used, bad, whether the budget stopped it and whether it was empty."""
    kept = nonfinite_budget(batches, [*run, epoch], **budget)
    return kept.groupBy(*run, epoch).agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~F.col("is_bad")).alias("used"),
        F.count_if("is_bad").alias("bad"),
        F.bool_or("is_stop").alias("stopped"),
        (F.count_if(~F.col("is_bad")) == 0).alias("empty"),
    )


def run_stop_epoch(rollup: DataFrame, run: list[str], epoch: str = "epoch") -> DataFrame:
    """First epoch in which a run used nothing, which ends the run; NULL if there is none."""
    return rollup.groupBy(*run).agg(F.min(F.when(F.col("empty"), F.col(epoch))).alias("stop_epoch"))


# --- warm-up, latency -------------------------------------------------------------------------------


FEW_FIRST = 1000


def warmup_drop(df: DataFrame, keys: list[str], order: list[str], n: int = 50) -> DataFrame:
    """Rows after the first ``n`` of each key in the order of a unique ``order``.

    Only the n-th place of each key is looked for; the rows are compared with it, never ranked. Up to ``FEW_FIRST`` places
    are kept per key and input task; a larger n is found by counting (``selection.nth_place``), so n and keys may
    have any size. Keys with fewer rows than ``n`` have nothing left. Orders by columns that are no numbers,
    dates or times keep n places whatever n is.
    """
    if n <= 0:
        return df
    place = F.struct(*order)
    if n > FEW_FIRST and countable(df, order):
        last = nth_place(df, keys, order, n)
    else:
        last = smallest_rows(df.select(*keys, place.alias("_place")), keys, "_place", n)
        last = last.groupBy(*keys).agg(F.max("_place").alias("_last"))
    return join_same(df, last, keys).filter(place > F.col("_last")).drop("_last")


def latency_summary(
    log: DataFrame, model: str, order: list[str], ms: str, warmup: int = 50
) -> DataFrame:
    """Measured iterations and their mean latency per model, warm-up left out."""
    measured = warmup_drop(log.select(model, *order, ms), [model], order, warmup)
    return measured.groupBy(model).agg(
        F.count(ms).alias("iterations"), F.avg(ms).alias("latency_ms")
    )


# --- spans ---------------------------------------------------------------------------------------------


def _equal(a, b) -> bool:
    """Of values of one column: NULL equals NULL, and not-a-number itself."""
    return a == b or (a is not None and b is not None and a != a and b != b)


def _range_spans(keys: list[str], group: str, schema: pa.Schema):
    """Spans of one sorted partition: (range, keys, group, place in the key, first and last row). A batch is cut at
    the ends of runs as arrays; only where batches meet are values compared one by one."""
    names = [*keys, group]

    def ends_of(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
        ends = [pc.run_end_encode(batch.column(c)).run_ends.to_numpy() for c in columns]
        return np.unique(np.concatenate([*ends, [batch.num_rows]]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple | None = None  # the last span so far: its values as a row, place in the key, first and last row
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(names)
            stops, key_stops = ends_of(batch, names), ends_of(batch, keys)
            starts, key_starts = np.concatenate([[0], stops[:-1]]), np.concatenate([[0], key_stops[:-1]])
            of = np.searchsorted(key_stops, starts, "right")  # the key of each span
            nth = np.arange(len(starts)) - np.searchsorted(starts, key_starts)[of]
            first, last = starts - key_starts[of], stops - 1 - key_starts[of]
            rows = batch.take(pa.array(starts))
            if held is not None:
                row, place, begin, end = held
                same = [_equal(row.column(c)[0].as_py(), rows.column(c)[0].as_py()) for c in names]
                if all(same[:-1]):
                    nth[of == 0] += place + (not same[-1])
                    first[of == 0] += end + 1
                    last[of == 0] += end + 1
                if all(same):
                    first[0] = begin
                else:
                    yield spans_of(part, row, [place], [begin], [end])
            yield spans_of(part, rows.slice(0, len(rows) - 1), nth[:-1], first[:-1], last[:-1])
            held = rows.slice(len(rows) - 1), int(nth[-1]), int(first[-1]), int(last[-1])
        if held is not None:
            yield spans_of(part, held[0], *[[x] for x in held[1:]])

    def spans_of(part: int, rows: pa.RecordBatch, *numbers) -> pa.RecordBatch:
        cols = [pa.array(np.full(len(rows), part), pa.int32()), *rows.columns, *[pa.array(n, pa.int64()) for n in numbers]]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def group_spans(df: DataFrame, order: list[str], group: str, keys: list[str] | None = None) -> DataFrame:
    """Runs of equal ``group`` values along ``order``: (keys, span, group, start, end), positions from 0.

    The table is dealt out by ranges of (keys, order); each range is reduced to its spans where it is
    sorted, and only those are numbered across ranges, where a range that begins as the one before
    ended continues its last span. NULL groups and keys are values like any other.
    """
    keys = keys or []
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [f"`{c}` {kinds[c].simpleString()}" for c in (*keys, group)]
    spec = ", ".join([f"{BUCKET} int", *fields, "_nth bigint", "_from bigint", "_to bigint"])
    empty = df.sparkSession.createDataFrame([], spec)
    sorted_rows = in_ranges(df.select(*dict.fromkeys([*keys, *order, group])), [*keys, *order])
    local = written(sorted_rows.mapInArrow(_range_spans(keys, group, empty.toArrow().schema), spec), "spans")
    ends = F.struct(F.col("_nth"), F.struct(group).alias("g"))
    per_bucket = local.groupBy(*keys, BUCKET).agg(
        (F.max("_to") + 1).cast("bigint").alias("_rows"),
        F.count(F.lit(1)).alias("_spans"),
        F.min(ends).alias("_first"),
        F.max(ends).alias("_last"),
    )
    along = Window.partitionBy(*keys).orderBy(BUCKET)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    continues = F.coalesce(F.lag("_last.g").over(along).eqNullSafe(F.col("_first.g")), F.lit(False))
    carry = (
        per_bucket.withColumn("_joined", continues.cast("bigint"))
        .withColumn("_rows_before", F.sum("_rows").over(so_far) - F.col("_rows"))
        .withColumn(
            "_spans_before",
            F.sum("_spans").over(so_far) - F.col("_spans") - F.sum("_joined").over(so_far),
        )
        .select(*keys, BUCKET, "_rows_before", "_spans_before")
    )
    return (
        join_same(local, carry, [*keys, BUCKET])
        .withColumn("span", F.col("_spans_before") + F.col("_nth") + 1)
        .groupBy(*keys, "span", group)
        .agg(
            F.min(F.col("_from") + F.col("_rows_before")).alias("start"),
            F.max(F.col("_to") + F.col("_rows_before")).alias("end"),
        )
    )


def change_points(spans: DataFrame) -> DataFrame:
    """Positions where the group changes (half a step before the new span begins)."""
    return spans.filter(F.col("start") > 0).withColumn("separator", F.col("start") - 0.5)


# --- scalar stream -----------------------------------------------------------------------------------------

# Log column -> tag (fixed values); the second set is written only when present and finite.
SCALAR_TAGS = {
    "train_loss": "loss/train",
    "val_loss": "loss/val",
    "val_psnr": "val/psnr",
    "val_ssim": "val/ssim",
    "val_edgeF1": "val/edgeF1",
    "lr": "opt/lr",
    "train_nonfinite": "debug/train_nonfinite",
    "val_nonfinite": "debug/val_nonfinite",
}
OPTIONAL_SCALAR_TAGS = {
    "grad_norm": "opt/grad_norm_mean",
    "real_psnr": "real/psnr",
    "real_ssim": "real/ssim",
    "real_edgeF1": "real/edgeF1",
    "gate_mean": "eca/gate_mean_avg",
    "gate_temp": "eca/temp_avg",
    "gate_gain": "eca/gain_avg",
}


def log_to_scalars(log: DataFrame, keys: list[str], epoch: str = "epoch") -> DataFrame:
    """Epoch log to (keys, tag, value, step)."""
    known = {**SCALAR_TAGS, **OPTIONAL_SCALAR_TAGS}
    cols = [c for c in known if c in log.columns]
    cells = F.array(
        *[
            F.struct(F.lit(known[c]).alias("tag"), F.col(c).cast("double").alias("value"))
            for c in cols
        ]
    )
    long = log.select(*keys, F.col(epoch).alias("step"), F.inline(cells))
    optional = F.col("tag").isin(list(OPTIONAL_SCALAR_TAGS.values()))
    return long.filter(~optional | F.coalesce(finite("value"), F.lit(False)))
