"""The operators over keys that are NULL and over groups beyond the usual sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framemetry.functions.special import QUANTILE_TERMS, Z_975, t_critical
from framemetry.operators import classify, frames as fr, runs, splits, stats
from framemetry.plans.bindings import (
    K, PAIRED_COUNTS, PAIRED_DOUBLES, big, md5_uniform_sql, r6, rounded, table,
)
from framemetry.plans.registry import query

SEED = 42


def _null_run():
    return F.nullif(F.col("user_id") % 11, F.lit(0))


def _log(spark, sf):
    return table(spark, sf, "events").groupBy(
        _null_run().alias("run"), F.dayofmonth("ts").cast("bigint").alias("epoch")
    ).agg((F.avg("value") * K).alias("val_loss"))


LOG_SQL = f"""
log AS (SELECT nullif(user_id % 11, 0) AS run, day(ts)::BIGINT AS epoch, avg(value) * {K} AS val_loss
        FROM events GROUP BY 1, 2),
prev AS (SELECT *,
  min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lo
  FROM log),
b AS (SELECT run, epoch, min(val_loss) OVER (PARTITION BY run ORDER BY epoch) AS best,
  coalesce(max(CASE WHEN val_loss < coalesce(lo, 'inf'::DOUBLE) THEN epoch END)
    OVER (PARTITION BY run ORDER BY epoch), 0)::BIGINT AS best_epoch FROM prev)"""


@query("best_so_far_null_keys", f"""WITH {LOG_SQL}
SELECT run, epoch, best_epoch, round(best, 6) AS best FROM b""")
def _best_so_far(spark, sf):
    out = runs.best_so_far(_log(spark, sf), ["run"], "val_loss", width=8)
    return out.select("run", "epoch", big("best_epoch"), r6("best"))


@query("early_stop_null_keys", f"""WITH {LOG_SQL},
s AS (SELECT run, min(epoch) FILTER (epoch - best_epoch >= 5) AS stop_epoch, max(epoch) AS last FROM b GROUP BY run)
SELECT s.run, stop_epoch, best_epoch, round(best, 6) AS best
FROM s JOIN b ON s.run IS NOT DISTINCT FROM b.run WHERE b.epoch = coalesce(stop_epoch, last)""")
def _early_stop(spark, sf):
    out = runs.early_stop(_log(spark, sf), ["run"], "val_loss", patience=5, width=8)
    return rounded(out, ["best"], ["stop_epoch", "best_epoch"], ["run"])


@query("nonfinite_budget_null_keys", f"""WITH
batches AS (SELECT nullif(user_id % 11, 0) AS run, event_id AS batch, event_id % 97 = 0 AS is_bad FROM events),
cum AS (SELECT *, sum(is_bad::INT) OVER (PARTITION BY run ORDER BY batch) AS bad_so_far FROM batches)
SELECT run, batch, bad_so_far::BIGINT AS bad_so_far, is_bad, is_bad AND bad_so_far > 1 AS is_stop FROM cum
WHERE bad_so_far - is_bad::INT <= 1""")
def _nonfinite_budget(spark, sf):
    batches = table(spark, sf, "events").select(
        _null_run().alias("run"), F.col("event_id").alias("batch"),
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"),
    )
    out = runs.nonfinite_budget(batches, ["run"], max_bad=1, width=1024)
    return out.select("run", "batch", big("bad_so_far"), "is_bad", "is_stop")


@query("warmup_drop_null_keys", """WITH r AS (SELECT event_id, nullif(event_type, 'click') AS model,
  row_number() OVER (PARTITION BY nullif(event_type, 'click') ORDER BY ts, event_id) AS rn FROM events)
SELECT model, event_id FROM r WHERE rn > 30""")
def _warmup_drop(spark, sf):
    e = table(spark, sf, "events").withColumn("model", F.nullif("event_type", F.lit("click")))
    return runs.warmup_drop(e, ["model"], ["ts", "event_id"], 30).select("model", "event_id")


@query("warmup_drop_long", """WITH r AS (SELECT event_id, event_type,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
SELECT event_type, event_id FROM r WHERE rn > 1500""")
def _warmup_drop_long(spark, sf):
    e = table(spark, sf, "events")
    return runs.warmup_drop(e, ["event_type"], ["ts", "event_id"], 1500).select("event_type", "event_id")


@query("group_spans_null_groups", """WITH r AS (SELECT nullif(o_orderstatus, 'F') AS g, nullif(o_custkey % 3, 0) AS k,
  row_number() OVER (PARTITION BY nullif(o_custkey % 3, 0) ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders),
p AS (SELECT *, lag(coalesce(g, 'none')) OVER (PARTITION BY k ORDER BY pos) AS prev FROM r),
s AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM coalesce(g, 'none') THEN 1 ELSE 0 END)
        OVER (PARTITION BY k ORDER BY pos) AS span FROM p)
SELECT k, span::BIGINT AS span, any_value(g) AS g, min(pos)::BIGINT AS "start", max(pos)::BIGINT AS "end"
FROM s GROUP BY k, span""")
def _group_spans(spark, sf):
    o = table(spark, sf, "orders").select(
        F.nullif(F.col("o_custkey") % 3, F.lit(0)).alias("k"), F.nullif("o_orderstatus", F.lit("F")).alias("g"),
        "o_orderdate", "o_orderkey",
    )
    out = runs.group_spans(o, ["o_orderdate", "o_orderkey"], "g", ["k"])
    return rounded(out, [], ["span", "start", "end"], ["k", "g"])


@query("class_weights_null_class", """WITH c AS (
  SELECT nullif(quality, 0) AS class, count(*) AS n FROM labels GROUP BY 1)
SELECT doc_id, class, n::BIGINT AS n, round(1.0::DOUBLE / n, 9) AS weight
FROM labels JOIN c ON nullif(quality, 0) IS NOT DISTINCT FROM class""")
def _class_weights(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("class"))
    out = classify.class_weights(rows, "class")
    return out.select("doc_id", "class", big("n"), F.round("weight", 9).alias("weight"))


def _hash(parts: str) -> str:
    return f"('0x' || substr(md5('{SEED}|' || {parts}), 1, 8))::BIGINT"


def _labels(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.nullif("quality", F.lit(0)).alias("class"))


@query("split_stratified_null_label", f"""WITH r AS (SELECT doc_id, nullif(quality, 0) AS class,
  row_number() OVER (PARTITION BY nullif(quality, 0) ORDER BY {_hash('doc_id')}, doc_id) AS rn,
  count(*) OVER (PARTITION BY nullif(quality, 0)) AS n FROM labels)
SELECT doc_id, class, CASE WHEN rn <= floor(n * 0.5::DOUBLE + 0.5) THEN 'val' ELSE 'train' END AS split FROM r""")
def _split_stratified(spark, sf):
    return splits.split_stratified(_labels(spark, sf), "doc_id", "class", 0.5, SEED, "md5")


@query("weighted_draws_null_class", f"""WITH l AS (SELECT doc_id, nullif(quality, 0) AS class FROM labels),
idx AS (SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY {_hash('doc_id')}, doc_id) - 1 AS idx FROM l),
sizes AS (SELECT class, count(*) AS n,
            row_number() OVER (ORDER BY ('0x' || substr(md5(concat_ws('|', '{SEED}', class)), 1, 8))::BIGINT, class) - 1 AS c,
            count(*) OVER () AS k FROM l GROUP BY class),
u AS (SELECT {md5_uniform_sql(SEED, "doc_id || '|draw'")} AS u,
             (('0x' || substr(md5('{SEED}|' || doc_id || '|place'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS v FROM l),
picks AS (SELECT class, floor(v * n)::BIGINT AS idx, count(*) AS draws FROM u JOIN sizes ON floor(u * k)::BIGINT = c GROUP BY 1, 2)
SELECT doc_id, idx.class, draws::BIGINT AS draws
FROM idx JOIN picks ON idx.class IS NOT DISTINCT FROM picks.class AND idx.idx = picks.idx""")
def _weighted_draws(spark, sf):
    out = splits.weighted_draws(_labels(spark, sf), "doc_id", "class", SEED, algo="md5")
    return out.select("doc_id", "class", big("draws"))


@query("ordered_paths_null", """SELECT row_number() OVER (ORDER BY p NULLS FIRST, doc_id) AS place, p AS rel_path
FROM (SELECT doc_id, CASE WHEN doc_id % 50 <> 0 THEN 'run1/frame_' || lpad(doc_id::VARCHAR, 8, '0') END AS p FROM documents)""")
def _ordered_paths(spark, sf):
    """Names of one folder that differ late, some missing."""
    name = F.concat(F.lit("run1/frame_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    docs = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 50 != 0, name).alias("rel_path"))
    return fr.ordered_paths(docs).select("place", "rel_path")


# --- sizes -----------------------------------------------------------------------------------------


def _t_sql() -> str:
    """The quantile beyond the table, and the table's values for the sizes that occur."""
    out = str(Z_975)
    for k, (factors, divisor) in enumerate(QUANTILE_TERMS, 1):
        powers = range(2 * len(factors) - 1, 0, -2)
        out += f" + {sum(f * Z_975**p for f, p in zip(factors, powers)) / divisor!r}::DOUBLE / power(n - 1, {k})"
    return f"(CASE WHEN n > 31 THEN {out} END)"


@query("critical_value_large", f"""WITH g AS (
  SELECT nullif(o_orderstatus, 'O') AS arm, count(*) AS n FROM orders GROUP BY 1)
SELECT arm, n::BIGINT AS n, round({_t_sql()}, 9) AS t_critical FROM g WHERE n > 31""")
def _critical_value(spark, sf):
    n = table(spark, sf, "orders").groupBy(F.nullif("o_orderstatus", F.lit("O")).alias("arm")).agg(F.count("*").alias("n"))
    return n.where("n > 31").select("arm", big("n"), F.round(t_critical(F.col("n")), 9).alias("t_critical"))


@query("paired_summary_large_groups", f"""WITH
d AS (SELECT nullif(o_custkey % 4, 0) AS board, (o_totalprice - 20000) * {K} AS delta FROM orders),
g AS (SELECT board, count(*) AS n, avg(delta) AS m, stddev_samp(delta) AS s, count(*) FILTER (delta > 0) AS wins,
             count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses FROM d GROUP BY board)
SELECT board, n::BIGINT AS n, round(m, 6) AS mean_delta, round(s, 6) AS sd_delta,
  round(m - {_t_sql()} * s / sqrt(n), 6) AS ci95_low, round(m + {_t_sql()} * s / sqrt(n), 6) AS ci95_high,
  wins::BIGINT AS wins, ties::BIGINT AS ties, losses::BIGINT AS losses, round(m / s, 6) AS cohens_dz,
  NULL::DOUBLE AS exact_sign_flip_p FROM g""")
def _paired_summary(spark, sf):
    """Groups too large for the exact test keep everything else."""
    pairs = table(spark, sf, "orders").select(
        F.nullif(F.col("o_custkey") % 4, F.lit(0)).alias("board"), ((F.col("o_totalprice") - 20000) * K).alias("delta")
    )
    return rounded(stats.paired_summary(pairs, ["board"]), PAIRED_DOUBLES, PAIRED_COUNTS, ["board"])
