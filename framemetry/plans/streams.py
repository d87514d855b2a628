"""Streaming queries: the log is replayed as files, results are read back as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framemetry.plans.bindings import (
    K, batches, big, epoch_log, r6, rounded, table,
)
from framemetry.plans.registry import ORACLES, query
from framemetry.plans.runs import BUDGET_SQL
from framemetry.session import shared_dir, written
from framemetry.streaming import runs as sr


def _stream_session(spark: SparkSession) -> SparkSession:
    """Own settings for the stream: UTC windows, as many state partitions as cores."""
    s = spark.newSession()
    s.conf.set("spark.sql.session.timeZone", "UTC")
    s.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return s


def _replay(df: DataFrame, run: str, order: str, edges: list, path: str) -> None:
    """Write a log in pieces along its order, a run's rows of a piece in one file, as one ordered
    writer per run would. The log itself is worked out once."""
    rows = written(df, "stream-rows")
    low = None
    for high in [*edges, None]:
        piece = rows
        if low is not None:
            piece = piece.filter(F.col(order) > low)
        if high is not None:
            piece = piece.filter(F.col(order) <= high)
        piece.repartition(run).write.mode("append").parquet(path)
        low = high


@query("stream_epoch_rollup", f"""WITH b AS (
  SELECT user_id AS run, date_trunc('day', ts) AS day, CASE WHEN event_id % 97 = 0 THEN NULL ELSE value * {K} END AS loss
  FROM events)
SELECT strftime(day, '%Y-%m-%d') AS day, run, round(coalesce(avg(loss), -1), 6) AS loss, count(*)::BIGINT AS seen,
  count(loss)::BIGINT AS used, (count(*) - count(loss))::BIGINT AS bad FROM b
WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY day, run""")
def _stream_epoch_rollup(spark, sf):
    s = _stream_session(spark)
    stream = sr.read_stream(
        s, f"{sf}/events*.parquet",
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    ).select(
        "ts", F.col("user_id").alias("run"),
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value") * K).alias("loss"),
    )
    out = sr.stream_epoch_rollup(stream, "run", "loss").select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "run", "loss", "seen", "used", "bad"
    )
    path = shared_dir(spark, "stream-rollup")
    sr.run_to_table(out, path, shared_dir(spark, "stream-rollup-checkpoint"))
    back = spark.read.parquet(path).withColumn("loss", F.nanvl("loss", F.lit(-1.0)))
    return rounded(back, ["loss"], ["seen", "used", "bad"], ["day", "run"])


def _log_stream(spark, sf, columns, max_files=None):
    source = shared_dir(spark, "stream-log")
    log = epoch_log(spark, sf).select("run", "epoch", *columns)
    _replay(log, "run", "epoch", [10, 20], source)
    schema = "run BIGINT, epoch BIGINT, " + ", ".join(f"{c} DOUBLE" for c in columns)
    return sr.read_stream(
        _stream_session(spark), source, schema, max_files=max_files or spark.sparkContext.defaultParallelism
    )


@query("stream_early_stop", ORACLES["early_stop"])
def _stream_early_stop(spark, sf):
    out = sr.stream_early_stop(_log_stream(spark, sf, ["val_loss"]), "run")
    path = shared_dir(spark, "stream-stop")
    sr.run_to_table(out, path, shared_dir(spark, "stream-stop-checkpoint"))
    last = F.max_by(F.struct("best", "best_epoch"), F.col("epoch"))
    done = spark.read.parquet(path).groupBy("run").agg(
        F.min(F.when(F.col("is_stop"), F.col("epoch"))).alias("stop_epoch"), last.alias("_at")
    )
    return done.select("run", big("stop_epoch"), F.col("_at.best_epoch").alias("best_epoch"),
                       r6("_at.best", "best"))


@query("stream_nonfinite_budget", f"""WITH {BUDGET_SQL}
SELECT run, batch, bad_so_far::BIGINT AS bad_so_far, is_bad, is_stop FROM kept""")
def _stream_nonfinite_budget(spark, sf):
    source = shared_dir(spark, "stream-batches")
    rows = batches(spark, sf).select("run", "batch", "loss")
    middle = table(spark, sf, "events").agg((F.max("event_id") / 2).cast("bigint")).scalar()
    _replay(rows, "run", "batch", [middle], source)
    stream = sr.read_stream(
        _stream_session(spark), source, "run BIGINT, batch BIGINT, loss DOUBLE", max_files=spark.sparkContext.defaultParallelism
    )
    path = shared_dir(spark, "stream-budget")
    sr.run_to_table(
        sr.stream_nonfinite_budget(stream, "run", max_bad=1), path,
        shared_dir(spark, "stream-budget-checkpoint"),
    )
    return spark.read.parquet(path).select("run", "batch", "bad_so_far", "is_bad", "is_stop")


@query("stream_best_checkpoint", """WITH l AS (
  SELECT run, val_loss_epoch, val_loss_best, val_ssim_epoch, val_ssim_best FROM (
""" + ORACLES["best_checkpoint"] + ")) SELECT * FROM l")
def _stream_best_checkpoint(spark, sf):
    by = {"val_loss": "min", "val_ssim": "max"}
    stream = _log_stream(spark, sf, list(by))
    path = shared_dir(spark, "stream-best")
    q = sr.stream_best_checkpoint(
        stream, ["run"], by, path, shared_dir(spark, "stream-best-checkpoint")
    )
    q.awaitTermination()
    out = sr.read_best(spark, path, ["run"], by)
    return rounded(out, [f"{m}_best" for m in by], [f"{m}_epoch" for m in by], ["run"])


@query("stream_resume", ORACLES["early_stop"])
def _stream_resume(spark, sf):
    """The early stop over a log that grows after the first stream has ended: the second continues from
    the checkpoint of the first."""
    source, path, checkpoint = (shared_dir(spark, f"stream-resume-{p}") for p in ("log", "sink", "checkpoint"))
    log = written(epoch_log(spark, sf).select("run", "epoch", "val_loss"), "stream-rows")
    for piece in (F.col("epoch") <= 13, F.col("epoch") > 13):
        log.filter(piece).repartition("run").write.mode("append").parquet(source)
        stream = sr.read_stream(_stream_session(spark), source, "run BIGINT, epoch BIGINT, val_loss DOUBLE")
        sr.run_to_table(sr.stream_early_stop(stream, "run"), path, checkpoint)
    last = F.max_by(F.struct("best", "best_epoch"), F.col("epoch"))
    done = spark.read.parquet(path).groupBy("run").agg(
        F.min(F.when(F.col("is_stop"), F.col("epoch"))).alias("stop_epoch"), last.alias("_at")
    )
    return done.select("run", big("stop_epoch"), F.col("_at.best_epoch").alias("best_epoch"),
                       r6("_at.best", "best"))
