"""Queries of the forms for large inputs: the picture source, exact selection by counting, scopes by grouping sets,
exact tests by counting sums, runs that come in chunks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framemetry.functions.registry import register_criterion
from framemetry.operators import blocks, classify, frames as fr, observed, quality, runs, selection, splits, stats
from framemetry.plans.bindings import (
    K, PAIRED_COUNTS, PAIRED_DOUBLES, big, epoch_log, frames, paired_sql, pairs, r6, rounded, table,
)
from framemetry.plans.frames import F1_SQL, PIXELS_SQL, _pair_pixels
from framemetry.plans.nulls import _t_sql
from framemetry.plans.registry import ORACLES, query
from framemetry.plans.statistics import PAIRS_SQL, _pairs
from framemetry.plans.streams import _log_stream, _stream_session
from framemetry.plans.tables import _picture_files
from framemetry.session import shared_dir, written
from framemetry.sources import images, pictures
from framemetry.streaming import runs as sr

# --- pictures -----------------------------------------------------------------------------------------------

PICTURES_SQL = """SELECT (vec_id % 5) || '/' || vec_id || '.png' AS rel_path, (vec_id % 5)::VARCHAR AS grp,
  CASE WHEN vec_id % 10 = 0 THEN NULL WHEN vec_id % 2 = 1 THEN 16 ELSE 8 END AS bit_depth,
  CASE WHEN vec_id % 10 = 0 THEN NULL ELSE pos END::INT AS pos,
  CASE WHEN vec_id % 10 = 0 THEN NULL ELSE floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CAST(e AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE)) * m) END::BIGINT AS sample,
  vec_id % 10 = 0 AS rejected
FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 65535.0::DOUBLE ELSE 255.0::DOUBLE END AS m,
        unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings)
WHERE vec_id % 10 <> 0 OR pos = 0"""


def _folders(spark, sf):
    """Picture files of 8 and 16 bits, every tenth broken, in five folders."""
    files = _picture_files(spark, sf)
    number = F.regexp_extract("rel_path", r"(\d+)", 1).cast("bigint")
    return files.select(F.concat((number % 5).cast("string"), F.lit("/"), "rel_path").alias("rel_path"), "content", number.alias("_n"))


def _samples(found):
    """A row per pixel of a decoded picture, one per rejected file."""
    return found.select(
        "rel_path", "grp", "bit_depth", F.col("reason").isNotNull().alias("rejected"), F.posexplode_outer("pixels").alias("pos", "_v")
    ).select(
        "rel_path", "grp", "bit_depth", "pos",
        F.round(F.col("_v").cast("double") * (F.pow(F.lit(2.0), "bit_depth") - 1)).cast("bigint").alias("sample"), "rejected",
    )


@query("picture_source", PICTURES_SQL)
def _picture_source(spark, sf):
    """Good and broken files of both depths, each opened once."""
    root = shared_dir(spark, "pictures")
    images.write_files(_folders(spark, sf), root)
    return _samples(pictures.read_pictures(spark, root))


@query("picture_headers", """SELECT (vec_id % 5) || '/' || vec_id || '.png' AS rel_path, 8::INT AS h, 8::INT AS w,
  CASE WHEN vec_id % 2 = 1 THEN 16 ELSE 8 END AS bit_depth FROM embeddings WHERE vec_id % 5 IN (1, 3) AND vec_id % 10 <> 0""")
def _picture_headers(spark, sf):
    """Sizes of the pictures of two folders: only headers are read, and only of these."""
    root = shared_dir(spark, "pictures")
    images.write_files(_folders(spark, sf).where("_n % 10 <> 0"), root)
    some = pictures.read_pictures(spark, root, ["rel_path", "grp", "h", "w", "bit_depth"]).where(F.col("grp").isin("1", "3"))
    return some.select("rel_path", "h", "w", "bit_depth")


@query("picture_stream", PICTURES_SQL)
def _picture_stream(spark, sf):
    """Files that arrive in two parts, read by a stream that ends between them and continues from its checkpoint."""
    root, path, checkpoint = (shared_dir(spark, f"pictures-{p}") for p in ("arriving", "sink", "checkpoint"))
    files = written(_folders(spark, sf), "picture-files")
    for part in (0, 1):
        images.write_files(files.where(F.col("_n") % 2 == part), root)
        sr.run_to_table(pictures.stream_pictures(spark, root), path, checkpoint)
    return _samples(spark.read.parquet(path))


# --- exact selection ------------------------------------------------------------------------------------------


@query("exact_quantile", """SELECT l_returnflag, round(quantile_cont(l_extendedprice * 1.0::DOUBLE, 0.85), 6) AS price_q85 FROM lineitem GROUP BY 1""")
def _exact_quantile(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("double").alias("price"))
    out = selection.exact_quantile(rows, ["l_returnflag"], "price", 0.85, "price_q85", few=256)
    return out.select("l_returnflag", r6("price_q85"))


@query("kth_values", """WITH r AS (SELECT l_linenumber, l_shipdate, row_number() OVER w AS k, count(*) OVER (PARTITION BY l_linenumber) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_linenumber ORDER BY l_shipdate))
SELECT l_linenumber, max(epoch(l_shipdate)::BIGINT // 86400) FILTER (k = 100) AS hundredth,
  max(epoch(l_shipdate)::BIGINT // 86400) FILTER (k = (n + 1) // 2) AS middle FROM r GROUP BY 1""")
def _kth_values(spark, sf):
    """Ranks from the front and from the number of values, of a column with many ties."""
    rows = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    ranks = {"hundredth": lambda n: F.lit(100), "middle": lambda n: F.floor((n + 1) / 2)}
    return selection.kth_values(rows, ["l_linenumber"], "day", ranks, few=64)


@query("edge_f1_pixels", f"""WITH {PIXELS_SQL}, {F1_SQL}
SELECT frame_id, round(edge_f1, 6) AS edge_f1 FROM f1""")
def _edge_f1_pixels(spark, sf):
    """The score of the array form from pixels and an exact quantile by counting."""
    out = quality.edge_f1_pixels(_pair_pixels(spark, sf), ["frame_id"], "a", "b", block=4)
    return rounded(out, ["edge_f1"], keep=["frame_id"])


@query("warmup_drop_large", """WITH r AS (SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (
  PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, l_orderkey, l_linenumber FROM r WHERE rn > 2000""")
def _warmup_drop_large(spark, sf):
    """A warm-up far above what a task would rank: the place of its last row is found by counting."""
    rows = table(spark, sf, "lineitem")
    out = runs.warmup_drop(rows, ["l_returnflag"], ["l_shipdate", "l_orderkey", "l_linenumber"], 2000)
    return out.select("l_returnflag", "l_orderkey", "l_linenumber")


# --- statistics ---------------------------------------------------------------------------------------------------


@query("scope_rollup_sets", f"""WITH {PAIRS_SQL},
scoped AS (
  SELECT '' AS scope, NULL::VARCHAR AS material, NULL::BIGINT AS half, comparison, metric, delta FROM pairs
  UNION ALL SELECT 'material', CASE WHEN unit < 3 THEN 'carbon' ELSE 'wood' END, NULL, comparison, metric, delta FROM pairs
  UNION ALL SELECT 'half', NULL, unit % 2, comparison, metric, delta FROM pairs),
named AS (SELECT scope || '/' || coalesce(material, '') || '/' || coalesce(half::VARCHAR, '') AS part, comparison, metric, delta FROM scoped),
{paired_sql('named', 'part, comparison, metric')}""")
def _scope_rollup_sets(spark, sf):
    """All units, each material and each half, with the exact test."""
    pairs = _pairs(spark, sf).select(
        "*", F.when(F.col("unit") < 3, "carbon").otherwise("wood").alias("material"), (F.col("unit") % 2).alias("half")
    )
    out = stats.scopes_rollup(pairs, ["material", "half"], ["comparison", "metric"])
    part = F.concat_ws("/", "scope", F.coalesce("material", F.lit("")), F.coalesce(F.col("half").cast("string"), F.lit("")))
    return rounded(out.withColumn("part", part), PAIRED_DOUBLES, PAIRED_COUNTS, ["part", "comparison", "metric"])


@query("scope_rollup_three", f"""WITH d AS (
  SELECT l_returnflag AS flag, l_linestatus AS status, nullif(l_linenumber, 4)::BIGINT AS line, (l_quantity - 25.5) * {K} AS delta FROM lineitem),
g AS (SELECT flag, status, line, grouping(flag) AS gf, grouping(status) AS gs, grouping(line) AS gl, count(*) AS n, avg(delta) AS m,
  stddev_samp(delta) AS s, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta = 0) AS ties, count(*) FILTER (delta < 0) AS losses
  FROM d GROUP BY GROUPING SETS ((), (flag), (status), (line), (flag, line), (flag, status, line)))
SELECT flag, status, line, concat_ws(',', CASE WHEN gf = 0 THEN 'flag' END, CASE WHEN gs = 0 THEN 'status' END, CASE WHEN gl = 0 THEN 'line' END) AS scope,
  n::BIGINT AS n, round(m, 6) AS mean_delta, round(s, 6) AS sd_delta,
  round(m - {_t_sql()} * s / sqrt(n), 6) AS ci95_low, round(m + {_t_sql()} * s / sqrt(n), 6) AS ci95_high,
  wins::BIGINT AS wins, ties::BIGINT AS ties, losses::BIGINT AS losses, round(m / s, 6) AS cohens_dz FROM g WHERE n > 31""")
def _scope_rollup_three(spark, sf):
    """Three dimensions, one of them with NULLs, over whole line items."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.nullif("l_linenumber", F.lit(4)).cast("bigint").alias("line"), ((F.col("l_quantity") - 25.5) * K).alias("delta"),
    )
    sets = [[], ["flag"], ["status"], ["line"], ["flag", "line"], ["flag", "status", "line"]]
    out = stats.scopes_rollup(rows, ["flag", "status", "line"], [], sets).where("n > 31")
    return rounded(out, PAIRED_DOUBLES[:-1], PAIRED_COUNTS, ["flag", "status", "line", "scope"])


def _grid_sql(orders: int, most: int = stats.GRID_MAX_N) -> str:
    """Exact p of the line items of some orders, by the number of sign vectors for each sum; none above ``most`` items."""
    return f"""WITH RECURSIVE d AS (
  SELECT l_orderkey // {orders} AS grp, (l_quantity - 25)::BIGINT AS delta, row_number() OVER (
    PARTITION BY l_orderkey // {orders} ORDER BY l_orderkey, l_linenumber, l_quantity) AS i FROM lineitem),
sums(grp, i, s, p) AS (
  SELECT DISTINCT grp, 0::BIGINT, 0::BIGINT, 1.0::DOUBLE FROM d
  UNION ALL
  SELECT grp, i + 1, s, sum(p) FROM (
    SELECT sums.grp, sums.i, unnest([s - delta, s + delta]) AS s, p / 2 AS p FROM sums JOIN d ON d.grp = sums.grp AND d.i = sums.i + 1)
  GROUP BY grp, i, s),
whole AS (SELECT grp, count(*) AS n, abs(sum(delta)) AS observed FROM d GROUP BY grp)
SELECT grp::BIGINT AS grp, n::BIGINT AS n, CASE WHEN n <= {most} THEN round(sum(CASE WHEN abs(s) >= observed THEN p ELSE 0 END), 9) END AS p
FROM sums JOIN whole USING (grp) WHERE i = n GROUP BY grp, n"""


def _items(spark, sf, orders: int):
    return table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / orders).cast("bigint").alias("grp"), (F.col("l_quantity") - 25).cast("double").alias("delta")
    )


def _with_sizes(tested, rows):
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    return tested.join(sizes, "grp").select("grp", big("n"), F.round("exact_sign_flip_p", 9).alias("p"))


@query("sign_flip_large", _grid_sql(4, 32))
def _sign_flip_large(spark, sf):
    """Groups of some sixteen units, up to 32: two halves of 2^(n/2) sums. Larger ones have no p here."""
    rows = _items(spark, sf, 4)
    return _with_sizes(stats.sign_flip_p(rows, ["grp"], max_n=32, large="null"), rows)


@query("sign_flip_grid", _grid_sql(12))
def _sign_flip_grid(spark, sf):
    """Groups of some fifty units, by counting sums on the grid of whole numbers."""
    rows = _items(spark, sf, 12)
    return _with_sizes(stats.sign_flip_grid(rows, ["grp"]), rows)


# --- runs in chunks -------------------------------------------------------------------------------------------------


@query("stream_early_stop_chunks", "SELECT *, CASE WHEN run % 3 = 0 THEN 1 ELSE 0 END::BIGINT AS null_rows FROM (" + ORACLES["early_stop"] + ")")
def _stream_early_stop_chunks(spark, sf):
    """A whole run in one micro-batch and many chunks, with a row without an epoch in every third run."""
    source = shared_dir(spark, "stream-chunks")
    log = epoch_log(spark, sf).select("run", "epoch", "val_loss")
    none = log.where("run % 3 = 0").select("run").distinct().select("run", F.lit(None).cast("bigint").alias("epoch"), F.lit(0.0).alias("val_loss"))
    log.unionByName(none).write.parquet(source)
    s = _stream_session(spark)
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    path = shared_dir(spark, "stream-chunks-sink")
    stream = sr.read_stream(s, source, "run BIGINT, epoch BIGINT, val_loss DOUBLE")
    sr.run_to_table(sr.stream_early_stop(stream, "run", bucket=16), path, shared_dir(spark, "stream-chunks-checkpoint"))
    last = F.max_by(F.struct("best", "best_epoch", "null_rows"), F.col("epoch"))
    done = spark.read.parquet(path).groupBy("run").agg(
        F.min(F.when(F.col("is_stop"), F.col("epoch"))).alias("stop_epoch"), last.alias("_at")
    )
    return done.select(
        "run", big("stop_epoch"), F.col("_at.best_epoch").alias("best_epoch"), r6("_at.best", "best"), F.col("_at.null_rows").alias("null_rows")
    )


@query("stream_upsert_small_batches", """WITH l AS (
  SELECT run, val_loss_epoch, val_loss_best, val_ssim_epoch, val_ssim_best FROM (
""" + ORACLES["best_checkpoint"] + ")) SELECT * FROM l")
def _stream_upsert(spark, sf):
    """The best checkpoints over many micro-batches of one file each, in a table that stays as small."""
    by = {"val_loss": "min", "val_ssim": "max"}
    stream = _log_stream(spark, sf, list(by), max_files=2)
    path = shared_dir(spark, "stream-upsert")
    sr.stream_best_checkpoint(stream, ["run"], by, path, shared_dir(spark, "stream-upsert-checkpoint"), parts=4).awaitTermination()
    out = sr.read_best(spark, path, ["run"], by)
    return rounded(out, [f"{m}_best" for m in by], [f"{m}_epoch" for m in by], ["run"])


# --- blocks ------------------------------------------------------------------------------------------------------------


@query("resize_blocks", ORACLES["resize_frames"])
def _resize_blocks(spark, sf):
    """The resize of the row form, from blocks of 3 x 3 pixels."""
    pixels = fr.pixel_view(frames(spark, sf), ["frame_id", "h", "w"], v="pixels")
    out = blocks.resize_blocks(blocks.block_rows(pixels, ["frame_id"], 3), ["frame_id"], 5, 12)
    return out.select("frame_id", (F.col("y") * 12 + F.col("x")).cast("int").alias("pos"), r6("v"))


# --- checks of a table that is written --------------------------------------------------------------------------------------


def _rules():
    return [
        observed.RowCount("lineitem", 6), observed.one_of("l_returnflag", ["A", "N"]), observed.between("l_quantity", 2, 49),
        observed.not_null("l_linestatus"), observed.all_finite("l_extendedprice"),
        observed.close("l_discount", "l_tax", 0.1, "l_linenumber"),
    ]


RULES_SQL = """SELECT 'row_count' AS "check", 'lineitem' AS "key", count(*) || ' rows, expected 6' AS detail FROM lineitem HAVING count(*) <> 6
UNION ALL SELECT 'values', 'l_returnflag', count(*) || ' rows, such as ' || min(l_returnflag) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') HAVING count(*) > 0
UNION ALL SELECT 'between', 'l_quantity', count(*) || ' rows, such as ' || min(l_quantity::BIGINT::VARCHAR) FROM lineitem WHERE NOT l_quantity BETWEEN 2 AND 49 HAVING count(*) > 0
UNION ALL SELECT 'close', 'l_discount:l_tax', count(*) || ' rows, such as ' || min(l_linenumber::VARCHAR) FROM lineitem WHERE abs(l_discount - l_tax) > 0.1 HAVING count(*) > 0"""


def _whole(df):
    return df.withColumn("l_quantity", F.col("l_quantity").cast("bigint"))


@query("run_checks_once", RULES_SQL)
def _run_checks_once(spark, sf):
    """All rules of a table in the job that writes it."""
    path = shared_dir(spark, "checked")
    return observed.checked_write(_whole(table(spark, sf, "lineitem")), _rules(), lambda df: df.write.parquet(path))


@query("stream_checks", RULES_SQL)
def _stream_checks(spark, sf):
    """The same rules over a stream of several files, added up over its micro-batches. A larger table has more files,
    not larger ones, in as many micro-batches."""
    source, path, checkpoint = (shared_dir(spark, f"stream-checks-{p}") for p in ("in", "out", "checkpoint"))
    rows = _whole(table(spark, sf, "lineitem"))
    files = rows.rdd.getNumPartitions()
    if files < 4:
        rows, files = rows.repartition(4), 4
    rows.write.parquet(source)
    s = _stream_session(spark)
    watch = observed.StreamChecks(s, _rules())
    stream = watch.watch(s.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(source))
    q = sr.stream_append_log(stream, path, checkpoint)
    q.awaitTermination()
    found = watch.violations(q)
    watch.stop()
    return spark.createDataFrame(found.collect(), observed.VIOLATIONS)


# --- a folder held out of stored frames ---------------------------------------------------------------------------------------

HELD_SQL = """SELECT vec_id AS frame_id, (label % 4)::VARCHAR AS grp, CASE WHEN label % 4 = {held} THEN 'val' ELSE 'train' END AS split FROM embeddings"""


def _stored(spark, sf):
    path = shared_dir(spark, "frames-by-group")
    rows = frames(spark, sf).select(
        "frame_id", F.concat(F.col("frame_id").cast("string"), F.lit(".png")).alias("rel_path"),
        (F.col("label") % 4).cast("string").alias("grp"), "h", "w", F.lit(16).alias("bit_depth"), F.col("pixels").cast("array<float>").alias("pixels"),
    )
    images.write_frames(rows, path)
    return images.read_frames(spark, path)


def _sides(train, val):
    sides = [side.select("frame_id", "grp", F.lit(name).alias("split")) for name, side in (("train", train), ("val", val))]
    return sides[0].unionByName(sides[1])


@query("held_out_folder", HELD_SQL.format(held=3))
def _held_out_folder(spark, sf):
    """The last folder is held out; each side reads the files of its folders."""
    return _sides(*splits.held_out_frames(_stored(spark, sf)))


@query("held_out_table", HELD_SQL.format(held="(SELECT max_by(label % 4, vec_id) FROM embeddings)"))
def _held_out_table(spark, sf):
    """The folders held out are what another table says: here the one of the frame taken last."""
    chosen = table(spark, sf, "embeddings").agg(F.max_by(F.col("label") % 4, "vec_id").cast("string").alias("grp"))
    return _sides(*splits.held_out_frames(_stored(spark, sf), chosen))


# --- criteria of the caller ---------------------------------------------------------------------------------------------------


@query("user_criteria", f"""WITH {PIXELS_SQL}
SELECT frame_id, round(avg((a - b) * (a - b)), 6) AS mse, round(avg(CASE WHEN abs(a - b) <= 0.05 THEN (a - b) * (a - b) / 2 ELSE 0.05 * (abs(a - b) - 0.025) END), 6) AS huber,
  round(max(abs(a - b)), 6) AS worst FROM pr GROUP BY frame_id""")
def _user_criteria(spark, sf):
    """Two scores of the caller's own beside a named one, from the same stacks."""

    def huber(x, y):
        d = abs(x - y)
        return np.where(d <= 0.05, d * d / 2, 0.05 * (d - 0.025)).mean((1, 2))

    own = {"huber": huber, "worst": lambda x, y: abs(x - y).max((1, 2))}
    out = quality.pair_scores(pairs(spark, sf), ["frame_id"], scores=["mse"], criteria=own)
    return rounded(out, ["mse", "huber", "worst"], keep=["frame_id"])


@query("sql_criterion", f"""SELECT l_returnflag, l_linenumber, round(sqrt(avg(power((l_discount - l_tax) * {K}, 2))), 6) AS rms FROM lineitem GROUP BY 1, 2""")
def _sql_criterion(spark, sf):
    """A criterion registered as an SQL aggregate."""
    s = spark.newSession()
    register_criterion(s, "rms_apart", lambda a, b: float(np.sqrt(np.mean((a - b) ** 2))))
    s.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("items")
    found = s.sql(f"""SELECT l_returnflag, l_linenumber, round(rms_apart(l_discount * {K}, l_tax * {K}), 6) AS rms
      FROM items GROUP BY l_returnflag, l_linenumber""")
    return found


CLASS_SQL = f"""WITH {PIXELS_SQL},
around(d) AS (VALUES (-1), (0), (1)),
box AS (SELECT p.frame_id, p.y, p.x, avg(n.v) AS v FROM px p, around dy, around dx
        JOIN px n ON n.frame_id = p.frame_id AND n.y = p.y + dy.d AND n.x = p.x + dx.d GROUP BY ALL),
seen AS (SELECT frame_id, sum(CASE WHEN v >= 0.5123456 THEN 1 ELSE 0 END) AS bright FROM {{source}} GROUP BY frame_id),
c AS (SELECT label % 2 AS truth, CASE WHEN bright >= 30 THEN 1 ELSE 0 END AS pred FROM seen JOIN embeddings ON vec_id = frame_id),
k AS (SELECT class, sum(tp) AS tp, sum(support) AS support, sum(predicted) AS predicted FROM (
  SELECT truth AS class, (truth = pred)::INT AS tp, 1 AS support, 0 AS predicted FROM c UNION ALL SELECT pred, 0, 0, 1 FROM c) GROUP BY class)
SELECT round(sum(tp) / sum(support)::DOUBLE, 6) AS accuracy, round(avg(coalesce(2.0::DOUBLE * tp / nullif(predicted + support, 0), 0)), 6) AS macro_f1,
  sum(support)::BIGINT AS n, 0::BIGINT AS skipped FROM k"""


def _bright(x):
    return (x >= 0.5123456).sum((1, 2)) >= 30


def _box(x):
    padded = np.pad(np.ones(x.shape[1:]), 1)
    wide = np.pad(x, ((0, 0), (1, 1), (1, 1)))
    h, w = x.shape[1:]
    cells = [(i, j) for i in range(3) for j in range(3)]
    return sum(wide[:, i : i + h, j : j + w] for i, j in cells) / sum(padded[i : i + h, j : j + w] for i, j in cells)


def _class_report(spark, sf, denoise):
    rows = frames(spark, sf).withColumn("true", (F.col("label") % 2).cast("bigint"))
    out = classify.denoised_report(rows, "true", _bright, denoise)
    return rounded(out, ["accuracy", "macro_f1"], ["n", "skipped"])


@query("classifier_report", CLASS_SQL.format(source="px"))
def _classifier_report(spark, sf):
    return _class_report(spark, sf, None)


@query("denoised_report", CLASS_SQL.format(source="box"))
def _denoised_report(spark, sf):
    """Denoise, clamp, classify and report in one plan."""
    return _class_report(spark, sf, _box)
