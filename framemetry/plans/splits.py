"""Splits and sampling over documents, vectors and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from framemetry.functions import draws
from framemetry.operators import splits
from framemetry.plans.bindings import big, r6, table
from framemetry.plans.registry import query

SEED = 42


def _hash(col: str, seed: int = SEED) -> str:
    return f"('0x' || substr(md5('{seed}|' || {col}), 1, 8))::BIGINT"


@query("split_random", f"""WITH r AS (SELECT doc_id,
  row_number() OVER (ORDER BY {_hash('doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= greatest(1, floor(n * 0.15::DOUBLE)) THEN 'val' ELSE 'train' END AS split
FROM r""")
def _split_random(spark, sf):
    return splits.split_random(
        table(spark, sf, "documents").select("doc_id"), "doc_id", 0.15, SEED, "md5"
    )


@query("split_fixed_floor", f"""WITH r AS (SELECT doc_id,
  row_number() OVER (ORDER BY {_hash('doc_id')}, doc_id) AS rn, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN rn <= greatest(200, floor(n * 0.1::DOUBLE)) THEN 'val' ELSE 'train' END AS split
FROM r""")
def _split_fixed_floor(spark, sf):
    return splits.split_fixed_floor(table(spark, sf, "documents").select("doc_id"), "doc_id", SEED, algo="md5")


@query("split_stratified", f"""WITH r AS (SELECT doc_id, quality,
  row_number() OVER (PARTITION BY quality ORDER BY {_hash('doc_id')}, doc_id) AS rn,
  count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN rn <= floor(n * 0.2::DOUBLE + 0.5) THEN 'val' ELSE 'train' END AS split
FROM r""")
def _split_stratified(spark, sf):
    return splits.split_stratified(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.2, SEED, "md5"
    )


def _paths(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path")
    )


@query("split_lofo", """SELECT doc_id, source AS grp,
  CASE WHEN source = (SELECT max(source) FROM documents) THEN 'val' ELSE 'train' END AS split
FROM documents""")
def _split_lofo(spark, sf):
    return splits.split_lofo(_paths(spark, sf), "path").select("doc_id", "grp", "split")


@query("last_group", "SELECT max(source) AS held_out, count(*)::BIGINT AS n FROM documents")
def _last_group(spark, sf):
    docs = splits.with_folder(_paths(spark, sf), "path")
    return docs.agg(F.max("grp").alias("held_out"), F.count(F.lit(1)).alias("n"))


@query("complement_groups", """SELECT doc_id, source AS grp FROM documents
WHERE source <> (SELECT min(source) FROM documents)""")
def _complement_groups(spark, sf):
    docs = splits.with_folder(_paths(spark, sf), "path")
    return splits.complement_groups(
        docs, "grp", docs.select(F.min("grp")).scalar()
    ).select("doc_id", "grp")


@query("board_folds", """WITH b AS (SELECT DISTINCT vec_id % 6 AS board FROM embeddings),
r AS (SELECT board, row_number() OVER (ORDER BY board) - 1 AS i, count(*) OVER () AS n FROM b)
SELECT f.board AS fold, r.board, CASE WHEN f.i = r.i THEN 'test'
  WHEN r.i = (f.i + 1) % f.n THEN 'val' ELSE 'train' END AS role FROM r f, r""")
def _board_folds(spark, sf):
    boards = table(spark, sf, "embeddings").select((F.col("vec_id") % 6).alias("board"))
    return splits.board_folds(boards, "board")


@query("fold_sizes", """WITH e AS (SELECT vec_id % 6 AS board, count(*) AS n FROM embeddings GROUP BY 1),
r AS (SELECT board, n, row_number() OVER (ORDER BY board) - 1 AS i, count(*) OVER () AS k FROM e)
SELECT f.board AS fold, CASE WHEN f.i = r.i THEN 'test'
  WHEN r.i = (f.i + 1) % f.k THEN 'val' ELSE 'train' END AS role, sum(r.n)::BIGINT AS n
FROM r f, r GROUP BY 1, 2""")
def _fold_sizes(spark, sf):
    boards = table(spark, sf, "embeddings").select((F.col("vec_id") % 6).alias("board"))
    sizes = boards.groupBy("board").agg(F.count(F.lit(1)).alias("n"))
    folds = splits.board_folds(boards, "board")
    return sizes.join(folds, "board").groupBy("fold", "role").agg(F.sum("n").alias("n"))


@query("weighted_draws", f"""WITH idx AS (SELECT doc_id, quality,
  row_number() OVER (PARTITION BY quality ORDER BY {_hash('doc_id')}, doc_id) - 1 AS idx FROM labels),
sizes AS (SELECT quality, count(*) AS n, row_number() OVER (ORDER BY {_hash('quality')}, quality) - 1 AS c,
                 count(*) OVER () AS k FROM labels GROUP BY quality),
u AS (SELECT (({_hash("doc_id || '|draw'")}) + 0.5::DOUBLE) / 4294967296 AS u,
             (('0x' || substr(md5('{SEED}|' || doc_id || '|place'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS v
      FROM labels),
picks AS (SELECT quality, floor(v * n)::BIGINT AS idx, count(*) AS draws
          FROM u JOIN sizes ON floor(u * k)::BIGINT = c GROUP BY 1, 2)
SELECT doc_id, quality, draws::BIGINT AS draws FROM idx JOIN picks USING (quality, idx)""")
def _weighted_draws(spark, sf):
    rows = table(spark, sf, "labels").select("doc_id", "quality")
    out = splits.weighted_draws(rows, "doc_id", "quality", SEED, algo="md5")
    return out.select("doc_id", "quality", big("draws"))


# Seeds of the replicated experiment (fixed values).
SEEDS = (42, 13, 37, 101, 202)


@query("seed_registry", """WITH u AS (
  SELECT seed, doc_id, (('0x' || substr(md5(seed || '|' || doc_id || '|split'), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS u
  FROM documents, (VALUES (42), (13), (37), (101), (202)) AS s(seed))
SELECT seed, count(*)::BIGINT AS n, (count(*) FILTER (u < 0.15))::BIGINT AS held_out, round(avg(u), 6) AS mean
FROM u GROUP BY seed""")
def _seed_registry(spark, sf):
    """The same rows under every registered seed: the seed is part of each draw's key."""
    rows = table(spark, sf, "documents").select(
        "doc_id", F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed")
    )
    u = draws.uniform(F.col("seed"), F.col("doc_id"), "split")
    out = rows.withColumn("u", u).groupBy("seed").agg(
        F.count("u").alias("n"), F.count_if(F.col("u") < 0.15).alias("held_out"),
        F.avg("u").alias("mean"),
    )
    return out.select("seed", big("n"), big("held_out"), r6("mean"))
