"""Frames: 8 x 8 pictures from the vectors, pairs from a deterministic disturbance."""

from __future__ import annotations

from pyspark.sql import functions as F

from framemetry.functions import arrays
from framemetry.functions.scalars import (
    clamp01, last_two_parts, normalise_samples, pixels_finite, psnr,
)
from framemetry.operators import frames as fr, quality, stacks, stencil
from framemetry.plans.bindings import (
    PIXELS_SQL, frames, md5_uniform_sql, pairs, r6, rounded, table,
)
from framemetry.plans.registry import query

def _hw():
    return F.col("h"), F.col("w")


def _pixel_rows(df, column="pixels", name="v"):
    """(frame_id, pos, value) for comparison."""
    return df.select("frame_id", F.posexplode(column).alias("pos", "_v")).select(
        "frame_id", "pos", r6("_v", name)
    )


def _pair_pixels(spark, sf):
    return fr.pixel_view(pairs(spark, sf), ["frame_id", "h", "w"], a="noisy", b="clean")


# --- scans and filters on frames ------------------------------------------------------------------------


@query("pixel_view", f"""WITH {PIXELS_SQL}
SELECT frame_id, pos::INT AS pos, y::INT AS y, x::INT AS x, round(a, 6) AS a, round(b, 6) AS b FROM pr""")
def _pixel_view(spark, sf):
    return _pair_pixels(spark, sf).select("frame_id", "pos", "y", "x", r6("a"), r6("b"))


@query("normalise_samples", """WITH s AS (
  SELECT vec_id, vec_id % 2 AS odd, pos, CAST(floor((CAST(e AS DOUBLE) + 0.6::DOUBLE) * 70000) AS BIGINT) AS s
  FROM (SELECT vec_id, unnest(embedding) AS e, unnest(range(len(embedding))) AS pos FROM embeddings))
SELECT vec_id AS frame_id, pos::INT AS pos,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, s / CASE WHEN odd = 1 THEN 65535.0::DOUBLE ELSE 255.0::DOUBLE END)), 6) AS v
FROM s""")
def _normalise_samples(spark, sf):
    raw = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame_id"),
        F.when(F.col("vec_id") % 2 == 1, 16).otherwise(8).alias("bit_depth"),
        F.transform(
            "embedding", lambda e: F.floor((e.cast("double") + 0.6) * 70000.0)
        ).alias("samples"),
    )
    return _pixel_rows(raw.withColumn("pixels", normalise_samples("samples", "bit_depth")))


def _damaged(spark, sf):
    """Frames with a non-finite first pixel now and then."""
    f = frames(spark, sf)
    bad = F.when(F.col("frame_id") % 11 == 0, F.lit(float("nan"))).when(
        F.col("frame_id") % 13 == 0, F.lit(float("inf"))
    )
    return f.withColumn(
        "pixels",
        F.transform("pixels", lambda v, i: F.coalesce(F.when(i == 0, bad), v)),
    )


@query("is_finite", """SELECT vec_id AS frame_id,
  NOT (vec_id % 11 = 0 OR vec_id % 13 = 0) AS ok FROM embeddings""")
def _is_finite(spark, sf):
    return _damaged(spark, sf).select("frame_id", pixels_finite("pixels").alias("ok"))


@query("drop_nonfinite_frames", """SELECT count(*)::BIGINT AS used FROM embeddings
WHERE NOT (vec_id % 11 = 0 OR vec_id % 13 = 0)""")
def _drop_nonfinite_frames(spark, sf):
    kept = fr.drop_nonfinite(_damaged(spark, sf), ["pixels"])
    return kept.agg(F.count(F.lit(1)).alias("used"))


@query("clamp01", """SELECT event_id,
  coalesce(round(CASE WHEN event_id % 97 = 0 THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, value / 50 - 0.3::DOUBLE)) END, 6), -1) AS v
FROM events""")
def _clamp01(spark, sf):
    e = table(spark, sf, "events")
    v = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(
        F.col("value") / 50 - 0.3
    )
    return e.select("event_id", r6(F.nanvl(clamp01(v), F.lit(-1.0)), "v"))


# --- pairing -------------------------------------------------------------------------------------------------


def _doc_frames(spark, sf, root: str):
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".png"))).alias(
            "rel_path"
        ),
        F.lit(1).alias("h"), F.lit(1).alias("w"),
        F.array((F.col("n_chars") / 20000.0)).alias("pixels"),
    )
    if root == "clean":
        return docs
    labelled = table(spark, sf, "labels").select("doc_id")
    return docs.join(labelled, "doc_id")


@query("pair_frames", """SELECT source || '/' || doc_id || '.png' AS rel_path,
  round(n_chars / 20000.0::DOUBLE, 6) AS noisy, round(n_chars / 20000.0::DOUBLE, 6) AS clean
FROM documents JOIN labels USING (doc_id)""")
def _pair_frames(spark, sf):
    out = fr.pair_frames(_doc_frames(spark, sf, "noisy"), _doc_frames(spark, sf, "clean"))
    return out.select(
        "rel_path", r6(F.get("noisy", F.lit(0)), "noisy"), r6(F.get("clean", F.lit(0)), "clean")
    )


@query("pair_frames_by_name", """SELECT source || '/' || doc_id || '.png' AS rel_path,
  source || '/' || doc_id || '.png' AS noisy_path FROM documents JOIN labels USING (doc_id)""")
def _pair_frames_by_name(spark, sf):
    out = fr.pair_frames(
        _doc_frames(spark, sf, "noisy"), _doc_frames(spark, sf, "clean"), on="name"
    )
    return out.select("rel_path", "noisy_path")


@query("unpaired_frames", """SELECT 'clean' AS side, source || '/' || doc_id || '.png' AS rel_path
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _unpaired_frames(spark, sf):
    return fr.unpaired_frames(_doc_frames(spark, sf, "noisy"), _doc_frames(spark, sf, "clean"))


@query("common_names", """SELECT doc_id || '.png' AS name FROM documents
INTERSECT SELECT doc_id || '.png' FROM labels""")
def _common_names(spark, sf):
    return fr.common_names(_doc_frames(spark, sf, "noisy"), _doc_frames(spark, sf, "clean"))


@query("duplicate_keys", """SELECT source AS "key", count(*)::BIGINT AS n FROM documents
GROUP BY source HAVING count(*) > 1""")
def _duplicate_keys(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat_ws("/", F.col("doc_id").cast("string"), "source").alias("rel_path")
    )
    return fr.duplicate_keys(docs)


@query("label_join", """SELECT doc_id || '.png' AS filename, quality AS label
FROM documents JOIN labels USING (doc_id)""")
def _label_join(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".png")).alias("filename"),
        F.col("quality").alias("label"),
    )
    return fr.label_join(_doc_frames(spark, sf, "clean"), labels).select("filename", "label")


@query("ordered_paths", """SELECT row_number() OVER (ORDER BY source || '/' || doc_id) AS place,
  source || '/' || doc_id AS rel_path FROM documents""")
def _ordered_paths(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("rel_path")
    )
    return fr.ordered_paths(docs).select("place", "rel_path")


@query("path_parts", """SELECT page_id, split_part(u, '/', 1) AS first_part,
  list_extract(string_split(u, '/'), -1) AS base, array_to_string(string_split(u, '/')[-2:], '/') AS last_two
FROM (SELECT page_id, replace(replace(url, 'https://', ''), 'http://', '') AS u FROM pages)
WHERE len(string_split(u, '/')) > 1
UNION ALL SELECT page_id, '', u, u
FROM (SELECT page_id, replace(replace(url, 'https://', ''), 'http://', '') AS u FROM pages)
WHERE len(string_split(u, '/')) = 1""")
def _path_parts(spark, sf):
    from framemetry.functions.scalars import base_name, first_folder

    pages = table(spark, sf, "pages").select(
        "page_id", F.regexp_replace("url", "^https?://", "").alias("u")
    )
    return pages.select(
        "page_id", first_folder("u").alias("first_part"), base_name("u").alias("base"),
        last_two_parts("u").alias("last_two"),
    )


# --- geometry ---------------------------------------------------------------------------------------------------


@query("crop_common", f"""WITH {PIXELS_SQL}
SELECT frame_id, sum(a)::DOUBLE - sum(a)::DOUBLE AS zero, count(*)::BIGINT AS n,
  round(sum(a * (y * 5 + x + 1)), 6) AS noisy, round(sum(b * (y * 5 + x + 1)), 6) AS clean
FROM pr WHERE y < 6 AND x < 5 GROUP BY frame_id""")
def _crop_common(spark, sf):
    """The noisy side is cut to 6 x 8, the clean side to 8 x 5; common is 6 x 5."""
    p = pairs(spark, sf)
    six, five, zero = F.lit(6), F.lit(5), F.lit(0)
    h, w = _hw()
    cut = p.select(
        "frame_id",
        arrays.crop(F.col("noisy"), w, zero, zero, six, w).alias("noisy"),
        arrays.crop(F.col("clean"), w, zero, zero, h, five).alias("clean"),
        six.alias("noisy_h"), w.alias("noisy_w"), h.alias("clean_h"), five.alias("clean_w"),
    )
    out = fr.crop_common(cut)

    def weighted(c):
        return F.aggregate(
            F.transform(c, lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v
        )

    return out.select(
        "frame_id", F.lit(0.0).alias("zero"), F.size("noisy").cast("bigint").alias("n"),
        r6(weighted("noisy"), "noisy"), r6(weighted("clean"), "clean"),
    )


@query("reflect_pad", f"""WITH {PIXELS_SQL},
g AS (SELECT unnest(range(13 * 11)) AS i),
m AS (SELECT i, CASE WHEN (i // 11) % 14 < 8 THEN (i // 11) % 14 ELSE 14 - (i // 11) % 14 END AS sy,
        CASE WHEN (i % 11) % 14 < 8 THEN (i % 11) % 14 ELSE 14 - (i % 11) % 14 END AS sx FROM g)
SELECT frame_id, i::INT AS pos, round(v, 6) AS v FROM px JOIN m ON y = sy AND x = sx""")
def _reflect_pad(spark, sf):
    return _pixel_rows(fr.reflect_pad(frames(spark, sf), 13, 11))


def _crop_offset(lane: int) -> str:
    return f"CAST(floor({md5_uniform_sql(7, 'frame_id || ' + chr(39) + '|crop' + chr(39), lane)} * 4) AS INT)"


@query("random_crop", f"""WITH {PIXELS_SQL},
o AS (SELECT DISTINCT frame_id, {_crop_offset(0)} AS top, {_crop_offset(1)} AS lft FROM px)
SELECT frame_id, top, lft AS "left", ((y - top) * 5 + x - lft)::INT AS pos, round(v, 6) AS v
FROM px JOIN o USING (frame_id) WHERE y >= top AND y < top + 5 AND x >= lft AND x < lft + 5""")
def _random_crop(spark, sf):
    out = fr.random_crop(frames(spark, sf), 5, seed=7)
    return out.select("frame_id", "top", "left", F.posexplode("pixels").alias("pos", "_v")).select(
        "frame_id", "top", "left", "pos", r6("_v", "v")
    )


@query("resize_frames", f"""WITH {PIXELS_SQL},
gy AS (SELECT oy, y, greatest(0, 1 - abs(y + 0.5 - (oy + 0.5) * 1.6) / 1.6)::DOUBLE AS ky
       FROM (SELECT unnest(range(5)) AS oy), (SELECT unnest(range(8)) AS y)),
gx AS (SELECT ox, x, greatest(0, 1 - abs(x + 0.5::DOUBLE - (ox + 0.5::DOUBLE) * 8 / 12))::DOUBLE AS kx
       FROM (SELECT unnest(range(12)) AS ox), (SELECT unnest(range(8)) AS x))
SELECT frame_id, (oy * 12 + ox)::INT AS pos, round(sum(v * ky * kx) / sum(ky * kx), 6) AS v
FROM px JOIN gy USING (y) JOIN gx USING (x) WHERE ky > 0 AND kx > 0 GROUP BY frame_id, oy, ox""")
def _resize_frames(spark, sf):
    return _pixel_rows(fr.resize_frames(frames(spark, sf), 5, 12))


# --- stencils -----------------------------------------------------------------------------------------------------

SOBEL_SQL = """
sk(dy, dx, kx, ky) AS (VALUES (-1,-1,-1,-1), (-1,0,0,-2), (-1,1,1,-1), (0,-1,-2,0), (0,0,0,0),
  (0,1,2,0), (1,-1,-1,1), (1,0,0,2), (1,1,1,1)),
es AS (SELECT p.frame_id, p.y, p.x,
         sqrt(power(sum(n.a * kx), 2) + power(sum(n.a * ky), 2) + 1e-12) AS ea,
         sqrt(power(sum(n.b * kx), 2) + power(sum(n.b * ky), 2) + 1e-12) AS eb
       FROM pr p, sk JOIN pr n ON n.frame_id = p.frame_id AND n.y = p.y + dy AND n.x = p.x + dx
       GROUP BY p.frame_id, p.y, p.x)"""


@query("sobel", f"""WITH {PIXELS_SQL}, {SOBEL_SQL}
SELECT frame_id, (y * 8 + x)::INT AS pos, round(eb, 6) AS edge FROM es""")
def _sobel(spark, sf):
    return _pixel_rows(stacks.sobel(frames(spark, sf)), name="edge")


@query("sobel_pixels", f"""WITH {PIXELS_SQL}, {SOBEL_SQL}
SELECT frame_id, y::INT AS y, x::INT AS x, round(ea, 6) AS edge FROM es""")
def _sobel_pixels(spark, sf):
    out = stencil.sobel_pixels(_pair_pixels(spark, sf), ["frame_id"], "a", block=4)
    return out.select("frame_id", "y", "x", r6("edge"))


STENCIL_SQL = f"""WITH {PIXELS_SQL},
k(dy, dx, k) AS (VALUES (-1,-1,0.0), (-1,0,-1.0), (-1,1,0.5), (0,-1,-1.0), (0,0,4.25), (0,1,-1.0),
  (1,-1,0.25), (1,0,-1.0), (1,1,0.0))
SELECT p.frame_id, p.y::INT AS y, p.x::INT AS x, round(sum(n.v * k::DOUBLE), 6) AS v
FROM px p, k JOIN px n ON n.frame_id = p.frame_id AND n.y = p.y + dy AND n.x = p.x + dx
GROUP BY p.frame_id, p.y, p.x"""
KERNEL = [[0.0, -1.0, 0.5], [-1.0, 4.25, -1.0], [0.25, -1.0, 0.0]]


@query("stencil_join", STENCIL_SQL)
def _stencil_join(spark, sf):
    """Frames in rows: no shuffle."""
    out = fr.pixel_view(stacks.stencil(frames(spark, sf), KERNEL), ["frame_id"], v="pixels")
    return out.select("frame_id", "y", "x", r6("v"))


@query("stencil_pixels", STENCIL_SQL)
def _stencil_pixels(spark, sf):
    """The same on a pixel table, in haloed blocks."""
    px = fr.pixel_view(frames(spark, sf), ["frame_id", "h", "w"], v="pixels")
    out = stencil.stencil_join(px, ["frame_id"], KERNEL, block=4)
    return out.select("frame_id", "y", "x", r6("v"))


GAUSS_SQL = """
gk AS (SELECT d, exp(-d * d / 4.5::DOUBLE) / (SELECT sum(exp(-i * i / 4.5::DOUBLE)) FROM range(-5, 6) t(i)) AS k
       FROM range(-5, 6) t(d)),
mom AS (SELECT p.frame_id, p.y, p.x, sum(n.a * g1.k * g2.k) AS ma, sum(n.b * g1.k * g2.k) AS mb,
          sum(n.a * n.a * g1.k * g2.k) AS aa, sum(n.b * n.b * g1.k * g2.k) AS bb,
          sum(n.a * n.b * g1.k * g2.k) AS ab
        FROM pr p, gk g1, gk g2 JOIN pr n
          ON n.frame_id = p.frame_id AND n.y = p.y + g1.d AND n.x = p.x + g2.d
        GROUP BY p.frame_id, p.y, p.x),
ss AS (SELECT frame_id, avg(((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4))
         / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4) + 1e-12)) AS ssim
       FROM mom GROUP BY frame_id)"""


@query("gaussian_filter", f"""WITH {PIXELS_SQL}, {GAUSS_SQL}
SELECT frame_id, y::INT AS y, x::INT AS x, round(ma, 6) AS a, round(mb, 6) AS b FROM mom""")
def _gaussian_filter(spark, sf):
    both = pairs(spark, sf)
    for side in ("noisy", "clean"):
        both = stacks.gaussian_filter(both, side)
    out = fr.pixel_view(both, ["frame_id"], a="noisy", b="clean")
    return out.select("frame_id", "y", "x", r6("a"), r6("b"))


@query("gaussian_pixels", f"""WITH {PIXELS_SQL}, {GAUSS_SQL}
SELECT frame_id, y::INT AS y, x::INT AS x, round(ma, 6) AS a, round(mb, 6) AS b FROM mom""")
def _gaussian_pixels(spark, sf):
    out = stencil.gaussian_pixels(_pair_pixels(spark, sf), ["frame_id"], ["a", "b"])
    return out.select("frame_id", "y", "x", r6("a"), r6("b"))


# --- scores -----------------------------------------------------------------------------------------------------------

ERR_SQL = """
er AS (SELECT frame_id, avg((a - b) * (a - b)) AS mse, avg(abs(a - b)) AS mae,
         avg(sqrt((a - b) * (a - b) + 1e-12)) AS ch FROM pr GROUP BY frame_id)"""


def _scores(spark, sf, *names: str):
    out = quality.pair_scores(pairs(spark, sf), ["frame_id"], scores=list(names))
    return rounded(out, list(names), keep=["frame_id"])


@query("mse", f"WITH {PIXELS_SQL}, {ERR_SQL} SELECT frame_id, round(mse, 6) AS mse FROM er")
def _mse(spark, sf):
    return _scores(spark, sf, "mse")


@query("mae", f"WITH {PIXELS_SQL}, {ERR_SQL} SELECT frame_id, round(mae, 6) AS mae FROM er")
def _mae(spark, sf):
    return _scores(spark, sf, "mae")


@query("charbonnier_loss", f"""WITH {PIXELS_SQL}, {ERR_SQL}
SELECT frame_id, round(0.7 * ch + 0.3 * mse, 6) AS charbonnier FROM er""")
def _charbonnier_loss(spark, sf):
    return _scores(spark, sf, "charbonnier")


@query("edge_l1", f"""WITH {PIXELS_SQL}, {SOBEL_SQL}
SELECT frame_id, round(avg(abs(ea - eb)), 6) AS edge_l1 FROM es GROUP BY frame_id""")
def _edge_l1(spark, sf):
    return _scores(spark, sf, "edge_l1")


@query("psnr", f"""WITH {PIXELS_SQL}, {ERR_SQL}
SELECT frame_id, round(CASE WHEN mse <= 0 THEN 99 ELSE 20 * log10(1 / sqrt(mse + 1e-12)) END, 6) AS "full",
  round(20 * log10(1 / sqrt(mse + 1e-8)), 6) AS plain,
  round(CASE WHEN mse < 1e-10 THEN 50 ELSE 10 * log10(1 / mse) END, 6) AS pairs FROM er""")
def _psnr(spark, sf):
    m = pairs(spark, sf).select("frame_id", quality.mse(F.col("noisy"), F.col("clean")).alias("m"))
    return m.select("frame_id", *[r6(psnr("m", v), v) for v in ("full", "plain", "pairs")])


@query("ssim_global", f"""WITH {PIXELS_SQL}
SELECT frame_id, round(((2 * avg(a) * avg(b) + 1e-4) * (2 * covar_pop(a, b) + 9e-4))
  / ((avg(a) * avg(a) + avg(b) * avg(b) + 1e-4) * (var_samp(a) + var_samp(b) + 9e-4)), 6) AS ssim_global
FROM pr GROUP BY frame_id""")
def _ssim_global(spark, sf):
    return _scores(spark, sf, "ssim_global")


SSIM_SQL = f"WITH {PIXELS_SQL}, {GAUSS_SQL} SELECT frame_id, round(ssim, 6) AS ssim FROM ss"


@query("ssim_windowed", SSIM_SQL)
def _ssim_windowed(spark, sf):
    return _scores(spark, sf, "ssim")


@query("ssim_pixels", SSIM_SQL)
def _ssim_pixels(spark, sf):
    out = stencil.ssim_pixels(_pair_pixels(spark, sf), ["frame_id"])
    return rounded(out, ["ssim"], keep=["frame_id"])


@query("minmax_norm", f"""WITH {PIXELS_SQL}, {SOBEL_SQL}
SELECT frame_id, (y * 8 + x)::INT AS pos, round((eb - min(eb) OVER w) / (max(eb) OVER w - min(eb) OVER w + 1e-6), 6) AS v
FROM es WINDOW w AS (PARTITION BY frame_id)""")
def _minmax_norm(spark, sf):
    return _pixel_rows(stacks.minmax_norm(stacks.sobel(frames(spark, sf))))


F1_SQL = f"""{SOBEL_SQL},
nm AS (SELECT frame_id, (ea - min(ea) OVER w) / (max(ea) OVER w - min(ea) OVER w + 1e-6) AS na,
              (eb - min(eb) OVER w) / (max(eb) OVER w - min(eb) OVER w + 1e-6) AS nb
       FROM es WINDOW w AS (PARTITION BY frame_id)),
th AS (SELECT frame_id, quantile_cont(nb, 0.85) AS t FROM nm GROUP BY frame_id),
cf AS (SELECT frame_id, count(*) FILTER (na >= t AND nb >= t) AS tp,
              count(*) FILTER (na >= t AND nb < t) AS fp, count(*) FILTER (na < t AND nb >= t) AS fn
       FROM nm JOIN th USING (frame_id) GROUP BY frame_id),
pq AS (SELECT frame_id, tp / (tp + fp + 1e-9) AS p, tp / (tp + fn + 1e-9) AS r FROM cf),
f1 AS (SELECT frame_id, 2 * p * r / (p + r + 1e-9) AS edge_f1 FROM pq)"""


@query("edge_f1", f"""WITH {PIXELS_SQL}, {F1_SQL}
SELECT frame_id, round(edge_f1, 6) AS edge_f1 FROM f1""")
def _edge_f1(spark, sf):
    return _scores(spark, sf, "edge_f1")


@query("edge_f1_fixed", f"""WITH {PIXELS_SQL}, {SOBEL_SQL},
cf AS (SELECT frame_id, count(*) FILTER (ea > 0.1 AND eb > 0.1) AS tp,
              count(*) FILTER (ea > 0.1 AND eb <= 0.1) AS fp, count(*) FILTER (ea <= 0.1 AND eb > 0.1) AS fn
       FROM es GROUP BY frame_id),
pq AS (SELECT frame_id, tp / (tp + fp + 1e-8) AS p, tp / (tp + fn + 1e-8) AS r FROM cf)
SELECT frame_id, round(2 * p * r / (p + r + 1e-8), 6) AS edge_f1 FROM pq""")
def _edge_f1_fixed(spark, sf):
    return _scores(spark, sf, "edge_f1_fixed").withColumnRenamed("edge_f1_fixed", "edge_f1")


SCORES_SQL = f"""{PIXELS_SQL}, {ERR_SQL}, {GAUSS_SQL}, {F1_SQL},
ed AS (SELECT frame_id, avg(abs(ea - eb)) AS edge_l1 FROM es GROUP BY frame_id),
sc AS (SELECT frame_id, mse, mae, CASE WHEN mse <= 0 THEN 99 ELSE 20 * log10(1 / sqrt(mse + 1e-12)) END AS psnr,
         ssim, edge_l1, edge_f1, 0.8 * mae + 0.2 * (1 - ssim) + 0.1 * edge_l1 AS loss
       FROM er JOIN ss USING (frame_id) JOIN ed USING (frame_id) JOIN f1 USING (frame_id))"""
SCORES_SELECT = "SELECT frame_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in quality.SCORES) + " FROM sc"


@query("pair_scores", f"WITH {SCORES_SQL} {SCORES_SELECT}")
def _pair_scores(spark, sf):
    out = quality.pair_scores(pairs(spark, sf), ["frame_id"], form="jvm")
    return rounded(out, quality.SCORES, keep=["frame_id"])


@query("pair_scores_arrow", f"WITH {SCORES_SQL} {SCORES_SELECT}")
def _pair_scores_arrow(spark, sf):
    out = quality.pair_scores(pairs(spark, sf), ["frame_id"])
    return rounded(out, quality.SCORES, keep=["frame_id"])


@query("edge_aware_loss", f"""WITH {SCORES_SQL}
SELECT frame_id, round(edge_l1, 6) AS edge_l1, round(loss, 6) AS loss FROM sc""")
def _edge_aware_loss(spark, sf):
    return _scores(spark, sf, "edge_l1", "loss")


@query("dataset_quality", f"""WITH {SCORES_SQL}
SELECT round(avg(psnr) FILTER (ok), 6) AS psnr, round(avg(ssim) FILTER (ok), 6) AS ssim,
  round(avg(edge_f1) FILTER (ok), 6) AS edge_f1, count(*)::BIGINT AS seen,
  (count(*) FILTER (ok))::BIGINT AS used, (count(*) FILTER (NOT ok))::BIGINT AS skipped
FROM (SELECT *, frame_id % 17 <> 0 AS ok FROM sc)""")
def _dataset_quality(spark, sf):
    scores = quality.pair_scores(pairs(spark, sf), ["frame_id"]).withColumn(
        "psnr", F.when(F.col("frame_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("psnr"))
    )
    out = quality.dataset_quality(scores, ["psnr", "ssim", "edge_f1"])
    return rounded(out, ["psnr", "ssim", "edge_f1"], ["seen", "used", "skipped"])


@query("signal_audit", f"""WITH {PIXELS_SQL}, {SOBEL_SQL}
SELECT label, round(avg(a), 6) AS output_mean, round(corr(b, a), 6) AS input_output_correlation,
  round(stddev_pop(a) / stddev_pop(b), 6) AS contrast_retention,
  round(avg(ea) / avg(eb), 6) AS gradient_retention, round(avg(abs(a - b)), 6) AS mean_absolute_change,
  round(avg(CASE WHEN a >= 1 - 1e-6 THEN 1.0 ELSE 0.0 END), 6) AS fraction_at_one
FROM pr JOIN es USING (frame_id, y, x) GROUP BY label""")
def _signal_audit(spark, sf):
    out = quality.signal_audit(pairs(spark, sf), ["label"], "clean", "noisy")
    return rounded(
        out,
        ["output_mean", "input_output_correlation", "contrast_retention", "gradient_retention",
         "mean_absolute_change", "fraction_at_one"],
        keep=["label"],
    )


@query("output_change", f"""WITH {PIXELS_SQL}
SELECT label, round(sqrt(sum((a - b) * (a - b)) / sum(b * b)), 6) AS relative_l2,
  round(corr(b, a), 6) AS correlation FROM pr GROUP BY label""")
def _output_change(spark, sf):
    out = quality.output_change(pairs(spark, sf), ["label"], "clean", "noisy")
    return rounded(out, ["relative_l2", "correlation"], keep=["label"])
