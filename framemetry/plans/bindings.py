"""How the driver tables stand in for frames, runs, arms and boards (same arithmetic as the SQL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framemetry.functions.scalars import clamp01, decimal_mean

# Makes averages of two-decimal inputs irregular, so rounding never meets an exact tie.
K = 0.0123456789
STRENGTH = 0.1987654321  # of the disturbance of a frame, irregular for the same reason


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded for comparison; adding 0.0 turns a negative zero into a positive one."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def big(c: str) -> Column:
    return F.col(c).cast("bigint").alias(c)


def rounded(df: DataFrame, doubles: list[str], counts: list[str] = (), keep: list[str] = ()):
    return df.select(*keep, *[big(c) for c in counts], *[r6(c) for c in doubles])


# --- arms x units -----------------------------------------------------------------------------------


def outcomes(spark, sf) -> DataFrame:
    """arm = event type, unit = user mod 6, two metrics."""
    e = table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 6).alias("unit")).agg(
        (F.avg("value") * K).alias("score"), (F.stddev_samp("value") * K).alias("spread")
    )


OUTCOMES_SQL = f"""
outcomes AS (
  SELECT event_type AS arm, user_id % 6 AS unit,
         avg(value) * {K} AS score, stddev_samp(value) * {K} AS spread
  FROM events GROUP BY 1, 2),
long AS (
  SELECT arm, unit, 'score' AS metric, score AS value FROM outcomes
  UNION ALL SELECT arm, unit, 'spread', spread FROM outcomes)"""

T_CRIT_SQL = "(CASE n WHEN 3 THEN 4.3026527297 WHEN 5 THEN 2.7764451052 WHEN 6 THEN 2.5705818356 END)"


def paired_sql(source: str, keys: str) -> str:
    """SQL of the paired summary over a CTE with columns (keys, unit, delta)."""
    return f"""
numbered AS (SELECT {keys}, delta, row_number() OVER (PARTITION BY {keys} ORDER BY delta) - 1 AS i
             FROM {source}),
base AS (SELECT {keys}, count(delta) AS n, avg(delta) AS mean_delta, stddev_samp(delta) AS sd_delta,
                count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties,
                count(*) FILTER (delta < 0) AS losses
         FROM {source} GROUP BY {keys}),
masks AS (SELECT {keys}, n, mean_delta,
                 unnest(generate_series(0, (1::BIGINT << n::INT) - 1)) AS mask FROM base),
flips AS (SELECT {keys}, m.mask, abs(sum(CASE WHEN (m.mask >> i::INT) & 1 = 1 THEN -delta ELSE delta END)
                 / any_value(m.n)) AS stat, abs(any_value(m.mean_delta)) AS obs
          FROM masks m JOIN numbered USING ({keys}) GROUP BY {keys}, m.mask),
pvals AS (SELECT {keys}, avg(CASE WHEN stat >= obs - greatest(1e-15, 1e-12 * obs)
                                  THEN 1.0 ELSE 0.0 END) AS p FROM flips GROUP BY {keys})
SELECT {keys}, n::BIGINT AS n, round(mean_delta, 6) AS mean_delta, round(sd_delta, 6) AS sd_delta,
       round(mean_delta - {T_CRIT_SQL} * sd_delta / sqrt(n), 6) AS ci95_low,
       round(mean_delta + {T_CRIT_SQL} * sd_delta / sqrt(n), 6) AS ci95_high,
       wins::BIGINT AS wins, ties::BIGINT AS ties, losses::BIGINT AS losses,
       round(mean_delta / sd_delta, 6) AS cohens_dz, round(p, 6) AS exact_sign_flip_p
FROM base JOIN pvals USING ({keys})"""


PAIRED_DOUBLES = [
    "mean_delta", "sd_delta", "ci95_low", "ci95_high", "cohens_dz", "exact_sign_flip_p",
]
PAIRED_COUNTS = ["n", "wins", "ties", "losses"]

# --- runs and epochs -----------------------------------------------------------------------------------


def batches(spark, sf) -> DataFrame:
    """run = user, epoch = day of month, batch = event; a NaN loss on every 97th event."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        F.dayofmonth("ts").cast("bigint").alias("epoch"),
        F.col("event_id").alias("batch"),
        F.when(F.col("event_id") % 97 == 0, F.lit(float("nan")))
        .otherwise(F.col("value") * K)
        .alias("loss"),
        (F.col("value") * K * 0.7).alias("grad_norm"),
    )


BATCHES_SQL = f"""
batches AS (
  SELECT user_id AS run, day(ts)::BIGINT AS epoch, event_id AS batch,
         CASE WHEN event_id % 97 = 0 THEN 'NaN'::DOUBLE ELSE value * {K} END AS loss,
         value * {K} * 0.7 AS grad_norm
  FROM events)"""


def epoch_log(spark, sf) -> DataFrame:
    """One row per run and epoch: validation loss, similarity, F1. The loss does not depend on the order of the
    events, so epochs of equal loss tie wherever their rows lie."""
    e = table(spark, sf, "events")
    return e.groupBy(
        F.col("user_id").alias("run"), F.dayofmonth("ts").cast("bigint").alias("epoch")
    ).agg(
        (decimal_mean("value") * K).alias("val_loss"),
        (F.stddev_pop("value") * K).alias("val_ssim"),
        (F.max("value") * K).alias("val_f1"),
        (F.min("value") * K).alias("val_acc"),
    )


EPOCH_LOG_SQL = f"""
epoch_log AS (
  SELECT user_id AS run, day(ts)::BIGINT AS epoch, avg(value) * {K} AS val_loss,
         stddev_pop(value) * {K} AS val_ssim, max(value) * {K} AS val_f1, min(value) * {K} AS val_acc
  FROM events GROUP BY 1, 2)"""

# --- frames ----------------------------------------------------------------------------------------------


def frames(spark, sf) -> DataFrame:
    """8x8 frames from the 64 floats of each vector, scaled into [0, 1]."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame_id"),
        F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.col("label"),
        F.transform("embedding", lambda e: clamp01((e.cast("double") + 0.6) / 1.2)).alias("pixels"),
    )


def pairs(spark, sf) -> DataFrame:
    """(frame_id, h, w, label, noisy, clean): a deterministic disturbance of each frame."""

    def disturb(v, i):
        k = (F.col("frame_id") * 7919 + i.cast("bigint") * 104729) % 1000
        return clamp01(v + STRENGTH * (k / 1000.0 - 0.5))

    return frames(spark, sf).select(
        "frame_id", "h", "w", "label",
        F.transform("pixels", disturb).alias("noisy"),
        F.col("pixels").alias("clean"),
    )


PIXELS_SQL = """
px AS (
  SELECT frame_id, label, pos, pos // 8 AS y, pos % 8 AS x,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CAST(e AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE)) AS v
  FROM (SELECT vec_id AS frame_id, label, unnest(embedding) AS e,
               unnest(range(len(embedding))) AS pos FROM embeddings)),
pr AS (
  SELECT frame_id, label, pos, y, x, v AS b,
         greatest(0.0::DOUBLE, least(1.0::DOUBLE,
           v + {strength}::DOUBLE * (((frame_id * 7919 + pos * 104729) % 1000)::DOUBLE / 1000 - 0.5::DOUBLE))) AS a
  FROM px)""".replace("{strength}", str(STRENGTH))


def md5_uniform_sql(seed: int, parts: str, lane: int = 0) -> str:
    """SQL twin of ``draws.uniform``; ``parts`` is an SQL text expression joined with '|'."""
    return (
        f"((('0x' || substr(md5('{seed}|' || {parts}), {1 + 8 * lane}, 8))::BIGINT + 0.5::DOUBLE)"
        " / 4294967296::DOUBLE)"
    )


def md5_normal_sql(seed: int, parts: str, lanes: tuple[int, int] = (0, 1)) -> str:
    u = md5_uniform_sql(seed, parts, lanes[0])
    v = md5_uniform_sql(seed, parts, lanes[1])
    return f"(sqrt(-2 * ln({u})) * cos(6.283185307179586::DOUBLE * {v}))"


# --- labels and predictions ---------------------------------------------------------------------------------


def predictions(spark, sf) -> DataFrame:
    """True and predicted class; board and arm for grouped reports."""
    e = table(spark, sf, "embeddings")
    wrong = (F.col("label") + 1) % 10
    arms = F.array(
        F.struct(F.lit("every7").alias("arm"), F.lit(7).alias("m")),
        F.struct(F.lit("every5").alias("arm"), F.lit(5).alias("m")),
    )
    return e.select("vec_id", "label", F.inline(arms)).select(
        F.col("vec_id").alias("item"),
        "arm",
        (F.col("vec_id") % 6).alias("board"),
        F.when(F.col("vec_id") % 6 < 3, "carbon").otherwise("wood").alias("material"),
        F.col("label").alias("true"),
        F.when(F.col("vec_id") % F.col("m") == 0, wrong).otherwise(F.col("label")).alias("pred"),
    )


PREDICTIONS_SQL = """
predictions AS (
  SELECT vec_id AS item, arm, vec_id % 6 AS board,
         CASE WHEN vec_id % 6 < 3 THEN 'carbon' ELSE 'wood' END AS material,
         label AS "true", CASE WHEN vec_id % m = 0 THEN (label + 1) % 10 ELSE label END AS pred
  FROM embeddings, (VALUES ('every7', 7), ('every5', 5)) AS t(arm, m))"""
