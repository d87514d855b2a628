"""Mixing sources to target weights, in DataFrame functions only.

A source's target is what its weight gives it of a budget, stopped at a number of epochs of the source;
the excess is shared again by weight until no source is above its stop. Whole epochs come first; what is
left of a target is drawn by Efraimidis-Spirakis sampling: a row's key is an exponential draw divided by
its quality weight, rows are taken in key order while their running size stays nearest to the budget.

Cases: a null text has size 0. The null source is one source and comes last. Null ids draw one number,
ordered by size and text. Equal rows are interchangeable, so reruns agree. An empty table, or one of empty
texts, takes nothing. A row is taken at most ``ceil(epochs)`` times. Other columns pass through.

At scale: only (id, source, size, key) is shuffled. The key axis of each source is cut into ``BUCKETS``
equal parts of probability; sizes are summed by part map-side, the running sum before a part is a window
over at most ``BUCKETS`` rows a source, and rows are sorted within their part only, so no task sorts a
whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framemetry.llm.common import WORD, distinct_rows, row_key, set_aside, table, whole_row
from framemetry.llm.registry import query

WEIGHTS = (5, 2, 1)  # of the sources in code-point order, repeating
BUDGET = 1.5  # of all sizes
EPOCHS = 2  # a source's target stops at so many times its size
QUALITY = {1: 2.0, 0: 0.5}  # weight of a labelled row; others weigh 1
BUCKETS = 4096
SEED = 17
_SCALE = float(2**52)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> and target. One row per source: a small table, handled in order."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(w) for w in WEIGHTS]), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")
    )
    cap = F.lit(EPOCHS) * F.col("source_size")
    # sources reach their stop in the order of stop over weight
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.lit(BUDGET) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ) / F.sum("w").over(after)
    levelled = (
        sizes.withColumn("w", weight).withColumn("cap", cap).withColumn("level", level)
        # the level of the first source that stays under its stop holds for all after it
        .withColumn("level", F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"])
    )
    return levelled.select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("w")), F.col("cap").cast("double")).alias("target"),
    )


def mix(docs: DataFrame, quality: DataFrame | None = None, sized: bool = False) -> DataFrame:
    """``docs`` with size, source_size, target and copies (in place of columns of these names).
    ``quality``: (doc_id, weight), one row an id. ``sized`` rows bring ``_words`` and ``_th`` in place of
    ``text``."""
    used = ("doc_id", "source", *(("_words", "_th") if sized else ("text",)))
    docs, names = set_aside(docs, *used, made=("size", "source_size", "target", "copies"))
    own = [n for n in docs.columns if n != "_th"]
    uniform = (
        F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(SEED)), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("bigint")
        + F.lit(0.5)
    ) / F.lit(_SCALE)
    if sized:
        rows = docs.select(*own, F.col("_words").alias("size"), F.col("doc_id").alias("_id"), "_th")
    else:
        rows = docs.select(*own, word_count().alias("size"), *row_key())
    if quality is not None:
        q = quality.select(F.col("doc_id").alias("_q"), F.col("weight").alias("_w"))
        rows = rows.join(q, rows["_id"] == q["_q"], "left").drop("_q")
    else:
        rows = rows.withColumn("_w", F.lit(1.0))
    rows = rows.withColumn("_e", -F.log(uniform) / F.coalesce("_w", F.lit(1.0))).withColumn(
        "_b", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("_e"))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    )
    parts = rows.groupBy("source", "_b").agg(F.sum("size").alias("part"))
    goal = targets(parts.groupBy("source").agg(F.sum("part").alias("source_size")))
    run = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.withColumn("_before", F.coalesce(F.sum("part").over(run), F.lit(0)))
    g = goal.withColumnRenamed("source", "_s")
    carry = carry.join(g, carry["source"].eqNullSafe(g["_s"])).select(
        F.col("source").alias("_s"), F.col("_b").alias("_c"), "_before", "source_size", "target"
    )
    at = Window.partitionBy("source", "_b").orderBy("_e", F.col("_id").asc_nulls_last(), "size", "_th")
    joined = rows.join(carry, rows["source"].eqNullSafe(carry["_s"]) & (rows["_b"] == carry["_c"])).withColumn(
        "_before",
        F.col("_before") + F.coalesce(F.sum("size").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.col("target") - epochs * F.col("source_size")
    drawn = ((F.col("_before") + F.col("size") / F.lit(2.0)) <= left) & (left > 0)
    return joined.select(
        *[F.col(n).alias(c) for c, n in names.items()], "size", "source_size", "target", (epochs + drawn.cast("int")).cast("bigint").alias("copies")
    )


def mixed_rows(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with size, source_size, target and copies; equal rows
    come back as one, their copies added. Only sizes and keys go through the mix; texts are shuffled once."""
    docs = docs.drop("size", "source_size", "target", "copies")
    slim = docs.select("doc_id", "source", word_count().alias("_words"), *row_key()[1:], *whole_row(docs))
    taken = (
        mix(slim, quality, sized=True).groupBy("_k1", "_k2")
        .agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("copies").alias("copies"))
        .where("copies > 0")
    )
    return distinct_rows(docs).join(taken, ["_k1", "_k2"]).select(
        "_row.*", "size", "source_size", "target", "copies"
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from labels; an id labelled twice takes its best label."""
    q = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("q"))
    weight = F.lit(1.0)
    for label, w in QUALITY.items():
        weight = F.when(F.col("q") == label, F.lit(w)).otherwise(weight)
    return q.select("doc_id", weight.alias("weight"))


SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS th,
         len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
q AS (SELECT doc_id, CASE max(quality) WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS weight
      FROM labels GROUP BY doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, {EPOCHS} * source_size AS cap,
             ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM s),
l AS (SELECT *, ({BUDGET}::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w, source NULLS LAST)),
t AS (SELECT source, source_size,
             coalesce(least(cap::DOUBLE, w * (SELECT arg_min(level, cap::DOUBLE / w) FROM l WHERE cap > level * w)), cap::DOUBLE) AS target FROM l),
k AS (SELECT d.*, source_size, target,
             -ln((('0x' || substr(md5('{SEED}|' || d.doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / {_SCALE}::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN q ON d.doc_id = q.doc_id),
r AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY e, doc_id, size, th
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
             CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN prior + size / 2 <= target - epochs * source_size AND target > epochs * source_size
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""


@query("op9_mixing", SQL)
def op9_mixing(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, quality_weights(table(spark, sf, "labels")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
