"""Sources, sinks, text functions and plot tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from framemetry.functions import scalars as sc
from framemetry.functions.registry import register_functions
from framemetry.operators import checks, plotdata, quality, stats
from framemetry.plans.bindings import (
    EPOCH_LOG_SQL, K, OUTCOMES_SQL, PIXELS_SQL, big, epoch_log, frames, outcomes, pairs, r6, rounded,
    table,
)
from framemetry.plans.frames import SCORES_SQL
from framemetry.plans.registry import query
from framemetry.plans.statistics import PAIRS_SQL, _pairs
from framemetry.session import shared_dir
from framemetry.sources import images, tables

# --- text ---------------------------------------------------------------------------------------------------


def _position_texts(spark, sf):
    """Comma lists with junk in them, one per order."""
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_linenumber").alias("a"), F.max("l_linenumber").alias("b"),
            F.min("l_returnflag").alias("c"), F.sum("l_partkey").alias("d"),
        )
        .select(
            "l_orderkey",
            F.when(F.col("l_orderkey") % 5 == 0, F.lit(""))
            .when(F.col("l_orderkey") % 5 == 1, F.col("c"))
            .otherwise(
                F.concat_ws(", ", F.col("b").cast("string"), F.col("c"), F.col("a").cast("string"),
                            F.lit(""), F.lit("-3"), F.col("d").cast("string"))
            )
            .alias("text"),
        )
    )


@query("parse_position_list", """WITH t AS (
  SELECT l_orderkey, min(l_linenumber) AS a, max(l_linenumber) AS b, min(l_returnflag) AS c,
         sum(l_partkey) AS d FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN '' WHEN l_orderkey % 5 = 1 THEN c
        ELSE b || ', ' || c || ', ' || a || ', , -3, ' || d END AS text FROM t),
p AS (SELECT l_orderkey, list_filter([try_cast(trim(s) AS INT) FOR s IN string_split(text, ',')],
        lambda i: i IS NOT NULL) AS ids FROM x)
SELECT l_orderkey, CASE WHEN len(ids) > 0 THEN array_to_string(ids, ';') END AS ids,
  array_to_string(list_sort(list_filter(ids, lambda i: i >= 0 AND i < 6)), ';') AS low FROM p""")
def _parse_position_list(spark, sf):
    out = _position_texts(spark, sf).withColumn("ids", sc.parse_position_list("text"))

    def text(c):
        return F.array_join(F.transform(c, lambda i: i.cast("string")), ";")

    return out.select(
        "l_orderkey", text(F.col("ids")).alias("ids"),
        text(F.coalesce(sc.positions_in_range("ids", 6), F.array().cast("array<int>"))).alias("low"),
    )


@query("slug", """SELECT page_id,
  lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS slug FROM pages""")
def _slug(spark, sf):
    return table(spark, sf, "pages").select("page_id", sc.slug("url").alias("slug"))


@query("option_default", """SELECT doc_id, lower(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN ''
  WHEN doc_id % 3 = 1 THEN NULL ELSE upper(lang) END, ''), 'gauss')) AS kind FROM documents""")
def _option_default(spark, sf):
    raw = F.when(F.col("doc_id") % 3 == 0, F.lit("")).when(
        F.col("doc_id") % 3 == 2, F.upper("lang")
    )
    return table(spark, sf, "documents").select("doc_id", sc.default_lower(raw, "gauss").alias("kind"))


@query("scalar_maths", """SELECT event_id, round(ln(1 + exp(value / 10 - 3)), 6) AS softplus,
  round(1 / (1 + exp(-(value / 10 - 3))), 6) AS sigmoid,
  round(ln(((event_id % 97) + 1) / (98.0::DOUBLE - (event_id % 97) - 0)), 6) AS logit FROM events""")
def _scalar_maths(spark, sf):
    v = F.col("value") / 10 - 3.0
    p = ((F.col("event_id") % 97) + 1) / 99.0
    return table(spark, sf, "events").select(
        "event_id", r6(sc.softplus(v), "softplus"), r6(sc.sigmoid(v), "sigmoid"),
        r6(sc.logit(p), "logit"),
    )


@query("scan_path_leaks", """SELECT doc_id AS "key", '@' AS marker FROM documents WHERE contains(text, '@')
UNION ALL SELECT doc_id, 'License' FROM documents WHERE contains(text, 'License')
UNION ALL SELECT doc_id, ':\\' FROM documents WHERE contains(text, ':\\')""")
def _scan_path_leaks(spark, sf):
    return tables.leaks_in(
        table(spark, sf, "documents"), "doc_id", "text", ("@", "License", *tables.LEAK_MARKERS)
    )


@query("scan_page_leaks", """SELECT page_id AS "key", 'script' AS marker FROM pages WHERE contains(html, 'script')
UNION ALL SELECT page_id, 'DOCTYPE' FROM pages WHERE contains(html, 'DOCTYPE')""")
def _scan_page_leaks(spark, sf):
    return tables.leaks_in(table(spark, sf, "pages"), "page_id", "html", ("script", "DOCTYPE"))


# --- columns ----------------------------------------------------------------------------------------------------


@query("require_columns", "SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY 1")
def _require_columns(spark, sf):
    rows = checks.require_columns(table(spark, sf, "lineitem"), ["l_returnflag", "l_orderkey"])
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("set_difference_columns", """SELECT 'lang' AS "column", count(lang)::BIGINT AS filled FROM documents
UNION ALL SELECT 'n_chars', count(n_chars) FROM documents UNION ALL SELECT 'source', count(source) FROM documents
UNION ALL SELECT 'text', count(text) FROM documents""")
def _set_difference_columns(spark, sf):
    """What documents have and labels lack, and in how many rows it is filled."""
    docs = table(spark, sf, "documents")
    lacking = checks.missing_columns(table(spark, sf, "labels"), docs.columns)
    counts = docs.agg(*[F.count(c).alias(c) for c in lacking])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled")) for c in lacking])
    return counts.select(F.inline(cells))


# --- pictures ------------------------------------------------------------------------------------------------


@query("ingest_frames", """SELECT vec_id || '.png' AS rel_path, pos::INT AS pos, 
  CASE WHEN vec_id % 2 = 1 THEN 16 ELSE 8 END AS bit_depth,
  floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CAST(e AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE)) * m)::BIGINT AS sample
FROM (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 65535.0::DOUBLE ELSE 255.0::DOUBLE END AS m,
        unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings)
WHERE vec_id % 10 <> 0""")
def _ingest_frames(spark, sf):
    """Frames encoded as picture files (every tenth one broken) and decoded again."""
    good = images.decoded_frames(images.ingest_frames(_picture_files(spark, sf)))
    return good.select("rel_path", "bit_depth", F.posexplode("pixels").alias("pos", "_v")).select(
        "rel_path", "bit_depth", "pos",
        F.round(F.col("_v").cast("double") * (F.pow(F.lit(2.0), "bit_depth") - 1)).cast("bigint").alias("sample"),
    )


def _picture_files(spark, sf):
    f = frames(spark, sf).select("frame_id", "h", "w", "pixels")

    def encode(batches):
        for b in batches:
            content = []
            for i, h, w, px in zip(b["frame_id"], b["h"], b["w"], b["pixels"]):
                depth = 16 if i % 2 else 8
                samples = (px * (2**depth - 1)).astype(int).reshape(h, w)
                data = images.encode_gray_png(samples, depth)
                content.append(data[:20] if i % 10 == 0 else data)
            yield pd.DataFrame(
                {"rel_path": b["frame_id"].astype(str) + ".png", "content": content}
            )

    return f.mapInPandas(encode, "rel_path STRING, content BINARY")


@query("scan_frames", """SELECT label || '/' || vec_id || '.png' AS rel_path, 8::INT AS h, 8::INT AS w, 16::INT AS bit_depth,
  pos::INT AS pos, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CAST(e AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE)) * 65535)::BIGINT AS sample
FROM (SELECT vec_id, label, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings)""")
def _scan_frames(spark, sf):
    """Frames written as a folder of picture files, scanned, and decoded."""
    f = frames(spark, sf).withColumn(
        "rel_path", F.concat(F.col("label").cast("string"), F.lit("/"), F.col("frame_id").cast("string"), F.lit(".png"))
    )
    root = shared_dir(spark, "frame-files")
    images.write_frame_files(f, root, depth=16)
    good = images.decoded_frames(images.ingest_frames(images.scan_frames(spark, root)))
    return good.select("rel_path", "h", "w", "bit_depth", F.posexplode("pixels").alias("pos", "_v")).select(
        "rel_path", "h", "w", "bit_depth", "pos", F.round(F.col("_v").cast("double") * 65535).cast("bigint").alias("sample")
    )


@query("ingest_folder", """SELECT CASE WHEN vec_id % 2 = 1 THEN 'odd/' ELSE 'even/' END || vec_id || '.png' AS rel_path,
  CASE WHEN vec_id % 2 = 1 THEN 'odd' ELSE 'even' END AS grp, CASE WHEN vec_id % 2 = 1 THEN 16 ELSE 8 END AS bit_depth, pos::INT AS pos,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CAST(e AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE))
        * CASE WHEN vec_id % 2 = 1 THEN 65535 ELSE 255 END)::BIGINT AS sample
FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings)""")
def _ingest_folder(spark, sf):
    """Files of 8 and of 16 bits in two folders of one root, by the two sources they need."""
    f = frames(spark, sf)
    root = shared_dir(spark, "frame-folder")
    for name, left, depth in (("even", 0, 8), ("odd", 1, 16)):
        path = F.concat(F.lit(f"{name}/"), F.col("frame_id").cast("string"), F.lit(".png"))
        images.write_frame_files(f.where(F.col("frame_id") % 2 == left).withColumn("rel_path", path), root, depth)
    good = images.decoded_frames(images.ingest_folder(spark, root))
    return good.select("rel_path", "grp", "bit_depth", F.posexplode("pixels").alias("pos", "_v")).select(
        "rel_path", "grp", "bit_depth", "pos",
        F.round(F.col("_v").cast("double") * (F.pow(F.lit(2.0), "bit_depth") - 1)).cast("bigint").alias("sample"),
    )


@query("rejected_files", """SELECT vec_id || '.png' AS rel_path FROM embeddings WHERE vec_id % 10 = 0""")
def _rejected_files(spark, sf):
    return images.rejected_files(images.ingest_frames(_picture_files(spark, sf))).select("rel_path")


# --- written tables ------------------------------------------------------------------------------------------


@query("write_frame_metrics", f"""WITH {SCORES_SQL}
SELECT label || '/' || frame_id AS rel_path, printf('%.4f', psnr) AS "PSNR", printf('%.6f', ssim) AS "SSIM",
  printf('%.6f', edge_f1) AS "EdgeF1" FROM sc JOIN (SELECT DISTINCT frame_id, label FROM px) USING (frame_id)""")
def _write_frame_metrics(spark, sf):
    scores = quality.pair_scores(pairs(spark, sf), ["frame_id", "label"]).withColumn(
        "rel_path", F.concat_ws("/", F.col("label").cast("string"), F.col("frame_id").cast("string"))
    )
    path = shared_dir(spark, "frame-metrics")
    tables.write_frame_metrics(quality.report_rows(scores), path)
    return tables.read_result_csv(
        spark, path, "rel_path STRING, PSNR STRING, SSIM STRING, EdgeF1 STRING"
    )


@query("append_epoch_log", f"""WITH {EPOCH_LOG_SQL}
SELECT run, epoch, round(val_loss, 6) AS val_loss, round(val_ssim, 6) AS val_ssim FROM epoch_log""")
def _append_epoch_log(spark, sf):
    """The first half of the epochs written, the rest appended, all read back."""
    log = epoch_log(spark, sf).select("run", "epoch", "val_loss", "val_ssim")
    path = shared_dir(spark, "epoch-log")
    tables.append_epoch_log(log.filter(F.col("epoch") <= 15), path)
    tables.append_epoch_log(log.filter(F.col("epoch") > 15), path)
    return tables.read_epoch_log(
        spark, path, "run BIGINT, epoch BIGINT, val_loss DOUBLE, val_ssim DOUBLE"
    )


@query("quarantine_malformed", """SELECT doc_id, source, n_chars, doc_id % 9 = 0 AS rejected FROM documents""")
def _quarantine_malformed(spark, sf):
    """Documents as lines; every ninth has a surplus field."""
    docs = table(spark, sf, "documents")
    line = F.concat_ws(
        ",", F.col("doc_id").cast("string"), "source", F.col("n_chars").cast("string"),
        F.when(F.col("doc_id") % 9 == 0, "surplus"),
    )
    path = shared_dir(spark, "lines")
    docs.select(line.alias("value")).write.text(path)
    schema = "doc_id BIGINT, source STRING, n_chars BIGINT"
    # the lines have no header of their own
    good, bad = tables.quarantine_malformed(spark, path, schema, header=False)
    parts = F.split("line", ",")
    rejected = bad.select(
        F.get(parts, F.lit(0)).cast("bigint").alias("doc_id"), F.get(parts, F.lit(1)).alias("source"),
        F.get(parts, F.lit(2)).cast("bigint").alias("n_chars"), F.lit(True).alias("rejected"),
    )
    return good.withColumn("rejected", F.lit(False)).unionByName(rejected)


@query("read_manifest", """SELECT event_type AS family, count(*)::BIGINT AS runs,
  sum(CASE WHEN user_id % 2 = 0 THEN 3 ELSE 0 END)::BIGINT AS positions,
  (count(*) FILTER (user_id % 2 = 1))::BIGINT AS without
FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY 1""")
def _read_manifest(spark, sf):
    """A run matrix over users and event types, written as CSV with quoted lists and read back."""
    runs = table(spark, sf, "events").select("event_type", "user_id").distinct()
    path = shared_dir(spark, "manifest")
    runs.select(
        F.col("user_id").alias("seed"), F.col("event_type").alias("model_family"),
        F.lit("light").alias("eca_setting"),
        F.when(F.col("user_id") % 2 == 0, "0,1,2").alias("eca_positions"),
        F.lit("GroupNorm(8)").alias("normalization"), F.lit("none").alias("supervision"),
        F.lit(25).alias("stress_sigma_8bit"), F.lit("complete").alias("status"),
    ).write.option("header", True).csv(path)
    back = tables.read_manifest(spark, path).withColumn(
        "ids", sc.parse_position_list("eca_positions")
    )
    return back.groupBy(F.col("model_family").alias("family")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum(F.coalesce(F.size("ids"), F.lit(0))).cast("bigint").alias("positions"),
        F.count_if(F.col("ids").isNull()).alias("without"),
    )


@query("parse_provenance", """SELECT user_id AS seed, event_type AS family,
  list_sum([user_id % 3, event_id % 5])::BIGINT AS layer_sum, event_id % 2 = 0 AS canonical FROM events""")
def _parse_provenance(spark, sf):
    """Nested run documents built from events."""
    e = table(spark, sf, "events")
    doc = F.to_json(
        F.struct(
            F.col("user_id").alias("seed"),
            F.struct((F.col("event_id") % 2 == 0).alias("canonical")).alias("project"),
            F.struct(
                F.col("event_type").alias("family"),
                F.array(F.col("user_id") % 3, F.col("event_id") % 5).alias("eca_layers"),
            ).alias("model"),
        )
    )
    run = tables.parse_provenance(e.select(doc.alias("doc")), "doc")
    return run.select(
        F.col("run.seed").cast("bigint").alias("seed"), F.col("run.model.family").alias("family"),
        F.aggregate("run.model.eca_layers", F.lit(0), lambda a, v: a + v).cast("bigint").alias("layer_sum"),
        F.col("run.project.canonical").alias("canonical"),
    )


# --- plot tables -----------------------------------------------------------------------------------------------


def _plot_rows(spark, sf):
    long = stats.outcomes_long(outcomes(spark, sf), ["arm", "unit"], ["score", "spread"])
    named = long.withColumn(
        "metric", F.when(F.col("metric") == "score", "Macro-F1@BestF1").otherwise("Accuracy@BestF1")
    )
    return named.groupBy(F.col("arm").alias("model_label"), "metric").agg(
        (F.avg("value") * 100).alias("mean"), (F.stddev_samp("value") * 100).alias("std")
    )


@query("robustness_plot_data", f"""WITH {OUTCOMES_SQL},
g AS (SELECT arm AS model_label, CASE WHEN metric = 'score' THEN 'Macro-F1@BestF1' ELSE 'Accuracy@BestF1' END AS metric,
        avg(value) * 100 AS mean, stddev_samp(value) * 100 AS std FROM long GROUP BY 1, 2),
l AS (SELECT metric, min(mean - std) AS lo, max(mean + std) AS hi FROM g GROUP BY metric)
SELECT metric, model_label, round(mean, 6) AS mean, round(std, 6) AS std, printf('%.2f±%.2f', mean, std) AS text,
  CASE WHEN metric LIKE 'Macro%' THEN 'robustness_macro_f1_bestf1' ELSE 'robustness_accuracy_bestf1' END AS figure,
  CASE WHEN metric LIKE 'Macro%' THEN 'Macro-F1 (%)' ELSE 'Accuracy (%)' END AS axis,
  round(greatest(0, lo - greatest(0.5, 0.2 * (hi - lo))), 6) AS axis_lo,
  round(least(100, hi + greatest(0.5, 0.2 * (hi - lo))), 6) AS axis_hi FROM g JOIN l USING (metric)""")
def _robustness_plot_data(spark, sf):
    out = plotdata.robustness_plot_data(_plot_rows(spark, sf))
    return rounded(
        out, ["mean", "std", "axis_lo", "axis_hi"],
        keep=["metric", "model_label", "text", "figure", "axis"],
    )


def _pipelines(spark, sf):
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("pipeline"))
        .agg((F.avg("o_totalprice") * K / 100).alias("accuracy_pct"))
        .withColumn("group_order", F.substring("pipeline", 1, 1).cast("int"))
        .withColumn(
            "regime_group", F.when(F.col("group_order").isin(1, 4), "baseline").otherwise("other")
        )
    )


@query("downstream_plot_data", f"""WITH g AS (
  SELECT o_orderpriority AS label, avg(o_totalprice) * {K} / 100 AS value,
         substr(o_orderpriority, 1, 1)::INT AS group_order FROM orders GROUP BY 1),
l AS (SELECT min(value) AS lo, max(value) AS hi FROM g)
SELECT group_order, CASE WHEN group_order IN (1, 4) THEN 'baseline' ELSE 'other' END AS regime_group, label,
  round(value, 6) AS value, printf('%.2f', value) AS text,
  round(CASE WHEN hi - lo < 3 THEN greatest(0, lo - 1) WHEN hi - lo < 10 THEN greatest(0, lo - 1.5) ELSE 0 END, 6) AS axis_lo,
  round(least(100, hi + CASE WHEN hi - lo < 3 THEN 1 WHEN hi - lo < 10 THEN 1 ELSE 2 END), 6) AS axis_hi FROM g, l""")
def _downstream_plot_data(spark, sf):
    out = plotdata.downstream_plot_data(_pipelines(spark, sf), "accuracy_pct")
    return rounded(
        out, ["value", "axis_lo", "axis_hi"], keep=["group_order", "regime_group", "label", "text"]
    )


@query("downstream_spans", """WITH g AS (
  SELECT DISTINCT substr(o_orderpriority, 1, 1)::INT AS group_order FROM orders),
r AS (SELECT row_number() OVER (ORDER BY group_order) - 1 AS pos,
             CASE WHEN group_order IN (1, 4) THEN 'baseline' ELSE 'other' END AS regime_group FROM g),
p AS (SELECT *, lag(regime_group) OVER (ORDER BY pos) AS prev FROM r),
s AS (SELECT *, sum(CASE WHEN prev IS DISTINCT FROM regime_group THEN 1 ELSE 0 END) OVER (ORDER BY pos) AS span FROM p)
SELECT any_value(regime_group) AS regime_group, min(pos)::BIGINT AS "start", max(pos)::BIGINT AS "end"
FROM s GROUP BY span""")
def _downstream_spans(spark, sf):
    out = plotdata.downstream_spans(_pipelines(spark, sf))
    return rounded(out, [], ["start", "end"], ["regime_group"])


@query("latency_plot_data", f"""WITH g AS (SELECT event_type AS model, avg(value) * {K} AS ms, count(*) AS params
  FROM events GROUP BY 1),
l AS (SELECT min(ms) AS lo, max(ms) AS hi, min(params) AS plo, max(params) AS phi FROM g)
SELECT model, round(ms, 6) AS latency_ms, printf('%.3f', ms) AS latency_ms_text,
  round(greatest(0, lo - greatest(0.2, 0.08 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END)), 6) AS latency_ms_axis_lo,
  round(hi + 2 * greatest(0.2, 0.08 * CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 6) AS latency_ms_axis_hi,
  params::BIGINT AS params, params::VARCHAR AS params_text,
  round(greatest(0, plo - greatest(0.2, 0.08 * CASE WHEN phi > plo THEN phi - plo ELSE 1 END)), 6)::DOUBLE AS params_axis_lo,
  round(phi + 2 * greatest(0.2, 0.08 * CASE WHEN phi > plo THEN phi - plo ELSE 1 END), 6)::DOUBLE AS params_axis_hi
FROM g, l""")
def _latency_plot_data(spark, sf):
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(
        (F.avg("value") * K).alias("latency_ms"), F.count(F.lit(1)).alias("params")
    )
    out = plotdata.latency_plot_data(g, with_params=True)
    return rounded(
        out,
        ["latency_ms", "latency_ms_axis_lo", "latency_ms_axis_hi", "params_axis_lo", "params_axis_hi"],
        ["params"], ["model", "latency_ms_text", "params_text"],
    )


@query("plot_order", """SELECT o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS plot_order FROM orders""")
def _plot_order(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    out = plotdata.place_in_order(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", big("plot_order"))


# --- SQL functions ------------------------------------------------------------------------------------------------


@query("sql_functions", f"""WITH {PIXELS_SQL},
e AS (SELECT frame_id, avg((a - b) * (a - b)) AS mse FROM pr GROUP BY frame_id)
SELECT frame_id, round(20 * log10(1 / sqrt(mse + 1e-12)), 6) AS psnr, round(greatest(0, least(1, mse * 300 - 0.2)), 6) AS clamped,
  'frame_' || frame_id AS name FROM e""")
def _sql_functions(spark, sf):
    register_functions(spark)
    m = pairs(spark, sf).select("frame_id", quality.mse(F.col("noisy"), F.col("clean")).alias("mse"))
    return spark.sql(
        "SELECT frame_id, round(psnr(mse), 6) + 0D AS psnr, round(clamp01(mse * 300 - 0.2D), 6) AS clamped, "
        "slug('Frame ' || frame_id || '!') AS name FROM {m}",
        m=m,
    )


@query("sql_sign_flip_p", f"""WITH {PAIRS_SQL},
numbered AS (SELECT comparison, metric, delta,
  row_number() OVER (PARTITION BY comparison, metric ORDER BY delta) - 1 AS i FROM pairs),
masks AS (SELECT comparison, metric, count(*) AS n, avg(delta) AS m,
            unnest(generate_series(0, (1::BIGINT << count(*)::INT) - 1)) AS mask FROM pairs GROUP BY 1, 2),
flips AS (SELECT comparison, metric, mask, abs(any_value(m)) AS obs,
    abs(sum(CASE WHEN (mask >> i::INT) & 1 = 1 THEN -delta ELSE delta END) / any_value(n)) AS stat
  FROM masks JOIN numbered USING (comparison, metric) GROUP BY 1, 2, 3)
SELECT comparison, metric, round(avg(CASE WHEN stat >= obs * (1 - 1e-12) - 1e-15 THEN 1.0 ELSE 0 END), 6) AS p
FROM flips GROUP BY 1, 2""")
def _sql_sign_flip_p(spark, sf):
    register_functions(spark)
    lists = stats._bounded_lists(_pairs(spark, sf), ["comparison", "metric"], "delta", stats.SIGN_FLIP_MAX_N + 1)
    return spark.sql(
        "SELECT comparison, metric, round(sign_flip_p(_values), 6) AS p FROM {lists}", lists=lists
    )


@query("tile_grid", """SELECT vec_id AS frame_id, t::INT AS top, l::INT AS "left"
FROM embeddings, (SELECT unnest([0, 3, 6]) AS t) a, (SELECT unnest([0, 3, 6]) AS l) b""")
def _tile_grid(spark, sf):
    register_functions(spark)
    return spark.sql(
        "SELECT frame_id, top, left FROM {f}, LATERAL tile_grid(h, w, 4, 1)",
        f=frames(spark, sf).select("frame_id", "h", "w"),
    )
