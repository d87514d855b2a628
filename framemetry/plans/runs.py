"""Run logs: users are runs, days are epochs, events are batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from framemetry.functions.scalars import finite_mean, l2_norm
from framemetry.operators import runs, stats
from framemetry.plans.bindings import (
    BATCHES_SQL, EPOCH_LOG_SQL, K, batches, big, epoch_log, r6, rounded, table,
)
from framemetry.plans.registry import query


@query("epoch_rollup", f"""WITH {BATCHES_SQL}
SELECT run, epoch, round(coalesce(avg(loss) FILTER (isfinite(loss)), -1), 6) AS loss,
       (count(*) FILTER (NOT isfinite(loss)))::BIGINT AS bad, count(*)::BIGINT AS seen,
       (count(*) FILTER (isfinite(loss)))::BIGINT AS used,
       round(coalesce(avg(grad_norm) FILTER (isfinite(loss)), -1), 6) AS grad_norm
FROM batches GROUP BY run, epoch""")
def _epoch_rollup(spark, sf):
    out = runs.epoch_rollup(batches(spark, sf), ["run", "epoch"], "loss", "grad_norm")
    # shown as -1 only here: not-a-number does not compare equal between engines
    for c in ("loss", "grad_norm"):
        out = out.withColumn(c, F.nanvl(F.col(c), F.lit(-1.0)))
    return rounded(out, ["loss", "grad_norm"], ["bad", "seen", "used"], ["run", "epoch"])


@query("epoch_rollup_zero", f"""WITH {BATCHES_SQL}
SELECT run, epoch, round(coalesce(avg(loss) FILTER (isfinite(loss)), 0), 6) AS loss,
       (count(*) FILTER (isfinite(loss)))::BIGINT AS used FROM batches GROUP BY run, epoch""")
def _epoch_rollup_zero(spark, sf):
    out = runs.epoch_rollup(batches(spark, sf), ["run", "epoch"], "loss", empty="zero")
    return rounded(out, ["loss"], ["used"], ["run", "epoch"])


@query("drop_nonfinite", f"""WITH {BATCHES_SQL}
SELECT count(*)::BIGINT AS seen, (count(*) FILTER (isfinite(loss)))::BIGINT AS used,
       (count(*) FILTER (NOT isfinite(loss)))::BIGINT AS skipped,
       round(avg(loss) FILTER (isfinite(loss)), 6) AS loss FROM batches""")
def _drop_nonfinite(spark, sf):
    out = runs.epoch_rollup(batches(spark, sf), [], "loss")
    return out.select(big("seen"), big("used"), F.col("bad").alias("skipped"), r6("loss"))


@query("finite_mean", f"""WITH {BATCHES_SQL}
SELECT run, round(coalesce(avg(loss) FILTER (isfinite(loss)), -1), 6) AS loss
FROM batches GROUP BY run""")
def _finite_mean(spark, sf):
    out = batches(spark, sf).groupBy("run").agg(finite_mean("loss").alias("loss"))
    return out.select("run", r6(F.nanvl("loss", F.lit(-1.0)), "loss"))


@query("l2_norm", f"""WITH {BATCHES_SQL}
SELECT run, CASE WHEN bool_and(isfinite(loss)) THEN round(sqrt(sum(loss * loss)), 6) ELSE -1 END AS norm,
       round(sqrt(sum(grad_norm * grad_norm)), 6) AS grad_norm
FROM batches GROUP BY run""")
def _l2_norm(spark, sf):
    out = batches(spark, sf).groupBy("run").agg(
        l2_norm("loss").alias("norm"), l2_norm("grad_norm").alias("grad_norm")
    )
    return out.select("run", r6(F.nanvl("norm", F.lit(-1.0)), "norm"), r6("grad_norm"))


@query("every_n_epochs", f"""WITH {EPOCH_LOG_SQL}
SELECT run, epoch, round(val_loss, 6) AS val_loss FROM epoch_log WHERE epoch % 5 = 0""")
def _every_n_epochs(spark, sf):
    return rounded(
        runs.every_n_epochs(epoch_log(spark, sf), 5), ["val_loss"], keep=["run", "epoch"]
    )


def _log_with_gaps(spark, sf):
    """The epoch log with a non-finite loss now and then."""
    return epoch_log(spark, sf).withColumn(
        "val_loss",
        F.when((F.col("run") + F.col("epoch")) % 11 == 0, F.lit(float("nan"))).otherwise(
            F.col("val_loss")
        ),
    )


GAPS_SQL = f"""{EPOCH_LOG_SQL},
gaps AS (SELECT run, epoch, CASE WHEN (run + epoch) % 11 = 0 THEN NULL ELSE val_loss END AS val_loss,
         val_ssim FROM epoch_log)"""


@query("best_so_far", f"""WITH {GAPS_SQL},
prev AS (SELECT *,
  min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo,
  max(val_ssim) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hi
  FROM gaps)
SELECT run, epoch, coalesce(val_loss < coalesce(lo, 'inf'::DOUBLE), false) AS is_best_loss,
       val_ssim > greatest(coalesce(hi, -1), -1) AS is_best_ssim,
       round(least(lo, val_loss), 6) AS best_loss,
       round(greatest(hi, val_ssim), 6) AS best_ssim
FROM prev""")
def _best_so_far(spark, sf):
    both = runs.best_of_each(
        _log_with_gaps(spark, sf), ["run"],
        {"loss_": ("val_loss", "min", None), "ssim_": ("val_ssim", "max", -1.0)}, width=8,
    )
    return both.select(
        "run", "epoch", F.col("loss_is_best").alias("is_best_loss"), F.col("ssim_is_best").alias("is_best_ssim"),
        r6("loss_best", "best_loss"), r6("ssim_best", "best_ssim"),
    )


@query("best_epoch", f"""WITH {GAPS_SQL},
prev AS (SELECT *,
  min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo
  FROM gaps)
SELECT run, epoch, coalesce(max(CASE WHEN val_loss < coalesce(lo, 'inf'::DOUBLE) THEN epoch END)
  OVER (PARTITION BY run ORDER BY epoch), 0)::BIGINT AS best_epoch FROM prev""")
def _best_epoch(spark, sf):
    out = runs.best_so_far(_log_with_gaps(spark, sf), ["run"], "val_loss", "min", width=8)
    return out.select("run", "epoch", big("best_epoch"))


@query("early_stop", f"""WITH {EPOCH_LOG_SQL},
prev AS (SELECT *,
  min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo
  FROM epoch_log),
b AS (SELECT run, epoch, min(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS best,
  coalesce(max(CASE WHEN val_loss < coalesce(lo, 'inf'::DOUBLE) THEN epoch END)
    OVER (PARTITION BY run ORDER BY epoch), 0)::BIGINT AS best_epoch FROM prev),
s AS (SELECT run, min(epoch) FILTER (epoch - best_epoch >= 12) AS stop_epoch, max(epoch) AS last
      FROM b GROUP BY run)
SELECT run, stop_epoch, best_epoch, round(best, 6) AS best
FROM s JOIN b USING (run) WHERE b.epoch = coalesce(stop_epoch, last)""")
def _early_stop(spark, sf):
    out = runs.early_stop(epoch_log(spark, sf), ["run"], "val_loss", patience=12)
    return rounded(out, ["best"], ["stop_epoch", "best_epoch"], ["run"])


@query("best_checkpoint", f"""WITH {EPOCH_LOG_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS a,
  row_number() OVER (PARTITION BY run ORDER BY val_ssim DESC, epoch) AS b,
  row_number() OVER (PARTITION BY run ORDER BY val_f1 DESC, epoch) AS c,
  row_number() OVER (PARTITION BY run ORDER BY val_acc DESC, epoch) AS d FROM epoch_log)
SELECT run, max(epoch) FILTER (a = 1) AS val_loss_epoch, round(max(val_loss) FILTER (a = 1), 6) AS val_loss_best,
  max(epoch) FILTER (b = 1) AS val_ssim_epoch, round(max(val_ssim) FILTER (b = 1), 6) AS val_ssim_best,
  max(epoch) FILTER (c = 1) AS val_f1_epoch, round(max(val_f1) FILTER (c = 1), 6) AS val_f1_best,
  max(epoch) FILTER (d = 1) AS val_acc_epoch, round(max(val_acc) FILTER (d = 1), 6) AS val_acc_best
FROM r GROUP BY run""")
def _best_checkpoint(spark, sf):
    by = {"val_loss": "min", "val_ssim": "max", "val_f1": "max", "val_acc": "max"}
    out = runs.best_checkpoint(epoch_log(spark, sf), ["run"], by)
    return rounded(out, [f"{m}_best" for m in by], [f"{m}_epoch" for m in by], ["run"])


@query("matched_epoch", f"""WITH log AS (
  SELECT event_type AS arm, user_id % 6 AS unit, day(ts)::BIGINT AS epoch, avg(value) * {K} AS value
  FROM events GROUP BY 1, 2, 3)
SELECT l.unit, round(l.value - r.value, 6) AS delta
FROM log l JOIN log r USING (unit, epoch)
WHERE epoch = 15 AND l.arm = 'click' AND r.arm = 'error'""")
def _matched_epoch(spark, sf):
    log = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("arm"), (F.col("user_id") % 6).alias("unit"),
        F.dayofmonth("ts").alias("epoch"), F.lit("value").alias("metric"),
    ).agg((F.avg("value") * K).alias("value"))
    out = stats.pair_arms(
        runs.matched_epoch(log, 15), ["unit"], [("click_minus_error", "click", "error")]
    )
    return rounded(out, ["delta"], keep=["unit"])


@query("latest_state", f"""WITH {EPOCH_LOG_SQL}
SELECT run, epoch AS last_epoch, epoch + 1 AS resume_epoch, round(val_loss, 6) AS val_loss
FROM epoch_log e WHERE epoch = (SELECT max(epoch) FROM epoch_log i WHERE i.run = e.run)""")
def _latest_state(spark, sf):
    out = runs.latest_state(epoch_log(spark, sf), ["run"], ["val_loss"])
    return rounded(out, ["val_loss"], ["last_epoch", "resume_epoch"], ["run"])


# Per run instead of per (run, epoch), so that the budget of 1 really runs out on the small tables.
BUDGET_SQL = f"""{BATCHES_SQL},
cum AS (SELECT *, sum(CASE WHEN isfinite(loss) THEN 0 ELSE 1 END)
          OVER (PARTITION BY run ORDER BY batch) AS bad_so_far,
          NOT isfinite(loss) AS is_bad FROM batches),
kept AS (SELECT *, is_bad AND bad_so_far > 1 AS is_stop FROM cum
         WHERE bad_so_far - CASE WHEN is_bad THEN 1 ELSE 0 END <= 1)"""


@query("nonfinite_budget", f"""WITH {BUDGET_SQL}
SELECT run, batch, bad_so_far::BIGINT AS bad_so_far, is_bad, is_stop FROM kept""")
def _nonfinite_budget(spark, sf):
    out = runs.nonfinite_budget(batches(spark, sf), ["run"], max_bad=1, width=1024)
    return out.select("run", "batch", big("bad_so_far"), "is_bad", "is_stop")


@query("budget_rollup", f"""WITH {BATCHES_SQL},
cum AS (SELECT *, sum(CASE WHEN isfinite(loss) THEN 0 ELSE 1 END)
          OVER (PARTITION BY run, epoch ORDER BY batch) AS bad_so_far,
          NOT isfinite(loss) AS is_bad FROM batches),
kept AS (SELECT *, is_bad AND bad_so_far > 0 AS is_stop FROM cum
         WHERE bad_so_far - CASE WHEN is_bad THEN 1 ELSE 0 END <= 0),
r AS (SELECT run, epoch, count(*) AS seen, count(*) FILTER (NOT is_bad) AS used,
             count(*) FILTER (is_bad) AS bad, bool_or(is_stop) AS stopped FROM kept GROUP BY 1, 2)
SELECT run, sum(seen)::BIGINT AS seen, sum(used)::BIGINT AS used, sum(bad)::BIGINT AS bad,
       (count(*) FILTER (stopped))::BIGINT AS stopped, min(epoch) FILTER (used = 0) AS stop_epoch
FROM r GROUP BY run""")
def _budget_rollup(spark, sf):
    r = runs.budget_rollup(batches(spark, sf), ["run"], max_bad=0, width=1024)
    out = r.groupBy("run").agg(
        F.sum("seen").alias("seen"), F.sum("used").alias("used"), F.sum("bad").alias("bad"),
        F.count_if("stopped").alias("stopped"),
        F.min(F.when(F.col("empty"), F.col("epoch"))).alias("stop_epoch"),
    )
    return rounded(out, [], ["seen", "used", "bad", "stopped", "stop_epoch"], ["run"])


@query("warmup_drop", """WITH r AS (SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
SELECT event_type, event_id FROM r WHERE rn > 50""")
def _warmup_drop(spark, sf):
    e = table(spark, sf, "events")
    return runs.warmup_drop(e, ["event_type"], ["ts", "event_id"], 50).select(
        "event_type", "event_id"
    )


@query("latency_summary", f"""WITH r AS (SELECT event_type AS model, value * {K} AS ms,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT model, count(*) AS iterations, avg(ms) AS latency_ms FROM r WHERE rn > 50 GROUP BY model)
SELECT model, iterations::BIGINT AS iterations, round(latency_ms, 6) AS latency_ms,
  round((latency_ms - (SELECT latency_ms FROM g WHERE model = 'click')) * 100
        / (SELECT latency_ms FROM g WHERE model = 'click'), 6) AS overhead_pct FROM g""")
def _latency_summary(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), "ts", "event_id", (F.col("value") * K).alias("ms")
    )
    g = runs.latency_summary(e, "model", ["ts", "event_id"], "ms")
    out = stats.baseline_delta(g, "model", "click", "latency_ms")
    return rounded(out, ["latency_ms", "overhead_pct"], ["iterations"], ["model"])


@query("group_spans", """WITH r AS (SELECT o_orderstatus,
  row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos,
  lag(o_orderstatus) OVER (ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
s AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM o_orderstatus THEN 1 ELSE 0 END)
        OVER (ORDER BY pos) AS span FROM r)
SELECT span::BIGINT AS span, any_value(o_orderstatus) AS o_orderstatus, min(pos)::BIGINT AS "start",
       max(pos)::BIGINT AS "end" FROM s GROUP BY span""")
def _group_spans(spark, sf):
    o = table(spark, sf, "orders")
    out = runs.group_spans(o, ["o_orderdate", "o_orderkey"], "o_orderstatus")
    return rounded(out, [], ["span", "start", "end"], ["o_orderstatus"])


@query("log_to_scalars", f"""WITH {GAPS_SQL}
SELECT run, epoch AS step, 'loss/val' AS tag, round(coalesce(val_loss, -1), 6) AS value FROM gaps
UNION ALL SELECT run, epoch, 'val/ssim', round(val_ssim, 6) FROM gaps
UNION ALL SELECT run, epoch, 'opt/grad_norm_mean', round(val_loss, 6) FROM gaps
  WHERE val_loss IS NOT NULL""")
def _log_to_scalars(spark, sf):
    log = _log_with_gaps(spark, sf).select(
        "run", "epoch", "val_loss", "val_ssim", F.col("val_loss").alias("grad_norm")
    )
    out = runs.log_to_scalars(log, ["run"])
    return out.select("run", "step", "tag", r6(F.nanvl("value", F.lit(-1.0)), "value"))
