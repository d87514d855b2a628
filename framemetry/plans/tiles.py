"""Tiling, noise, augmentation and channel gates on the 8 x 8 frames and 64-channel vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from framemetry.operators import augment as ag, frames as fr, noise, quality, tiles, vectors
from framemetry.plans.bindings import (
    PIXELS_SQL, frames, md5_normal_sql, md5_uniform_sql, pairs, r6, rounded, table,
)
from framemetry.plans.registry import query

TILE, OVERLAP = 4, 1

TILES_SQL = f"""{PIXELS_SQL},
grid AS (SELECT t AS top, l AS lft, i, j FROM (SELECT unnest([0, 3, 6]) AS t), (SELECT unnest([0, 3, 6]) AS l),
         (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)),
ids AS (SELECT DISTINCT frame_id FROM px),
tp AS (SELECT ids.frame_id, top, lft, i, j, coalesce(v, 0) AS v
       FROM ids CROSS JOIN grid LEFT JOIN px ON px.frame_id = ids.frame_id AND px.y = top + i AND px.x = lft + j)"""

HANN_SQL = """(0.5 - 0.5 * cos(2 * pi() * i / 4)) * (0.5 - 0.5 * cos(2 * pi() * j / 4)) + 1e-6"""


def _pixel_rows(df, column="pixels", name="v"):
    return df.select("frame_id", F.posexplode(column).alias("pos", "_v")).select(
        "frame_id", "pos", r6("_v", name)
    )


@query("tile_frames", f"""WITH {TILES_SQL}
SELECT frame_id, top::INT AS top, lft::INT AS "left", count(*)::BIGINT AS n, round(sum(v * (i * 4 + j + 1)), 6) AS v
FROM tp GROUP BY frame_id, top, lft""")
def _tile_frames(spark, sf):
    t = tiles.tile_frames(frames(spark, sf), TILE, OVERLAP)
    weighted = F.aggregate(
        F.transform("pixels", lambda v, i: v * (i + 1)), F.lit(0.0), lambda s, v: s + v
    )
    return t.select(
        "frame_id", "top", "left", F.size("pixels").cast("bigint").alias("n"), r6(weighted, "v")
    )


@query("tile_frames_trimmed", """SELECT vec_id AS frame_id, t::INT AS top, l::INT AS "left"
FROM embeddings, (SELECT unnest([0, 3, 6]) AS t) a, (SELECT unnest([0, 3, 6]) AS l) b
WHERE t < 7 AND l < 7""")
def _tile_frames_trimmed(spark, sf):
    out = tiles.tile_frames(frames(spark, sf), TILE, OVERLAP, trim=True)
    return out.select("frame_id", "top", "left")


@query("hann_weights", """SELECT label, (i * n + j)::INT AS pos,
  round((0.5 - 0.5 * cos(2 * pi() * i / n)) * (0.5 - 0.5 * cos(2 * pi() * j / n)) + 1e-6, 6) AS v
FROM (SELECT label, label + 4 AS n FROM embeddings GROUP BY label) a,
     (SELECT unnest(range(20)) AS i) b, (SELECT unnest(range(20)) AS j) c WHERE i < n AND j < n""")
def _hann_weights(spark, sf):
    sizes = table(spark, sf, "embeddings").select("label").distinct()
    return sizes.select(
        "label", F.posexplode(tiles.hann_weights(F.col("label") + 4)).alias("pos", "v")
    ).select("label", "pos", r6("v"))


def add_sql(source: str, eps: str) -> str:
    return f"""
oa AS (SELECT frame_id, (top + i) * 8 + lft + j AS pos, sum(v * ({HANN_SQL})) / (sum({HANN_SQL}) + {eps}) AS v
       FROM {source} WHERE top + i < 8 AND lft + j < 8 GROUP BY 1, 2)"""


@query("overlap_add", f"""WITH {TILES_SQL}, {add_sql('tp', '1e-6')}
SELECT frame_id, pos::INT AS pos, round(v, 6) AS v FROM oa""")
def _overlap_add(spark, sf):
    t = tiles.tile_frames(frames(spark, sf), TILE, OVERLAP)
    return _pixel_rows(tiles.overlap_add(t, TILE))


@query("overlap_add_pixels", f"""WITH {TILES_SQL}, {add_sql('tp', '0')}
SELECT frame_id, pos::INT AS pos, round(v, 6) AS v FROM oa""")
def _overlap_add_pixels(spark, sf):
    t = tiles.tile_frames(frames(spark, sf), TILE, OVERLAP)
    out = tiles.overlap_add_pixels(t, TILE, edge="exact")
    return out.select("frame_id", "pos", r6("v"))


@query("tiled_apply", f"""WITH {TILES_SQL},
bx AS (SELECT p.frame_id, p.top, p.lft, p.i, p.j, sum(n.v) / 9 AS v
       FROM tp p JOIN tp n ON n.frame_id = p.frame_id AND n.top = p.top AND n.lft = p.lft
         AND n.i BETWEEN p.i - 1 AND p.i + 1 AND n.j BETWEEN p.j - 1 AND p.j + 1
       GROUP BY ALL), {add_sql('bx', '1e-6')}
SELECT frame_id, pos::INT AS pos, round(v, 6) AS v FROM oa""")
def _tiled_apply(spark, sf):
    return _pixel_rows(tiles.tiled_apply(frames(spark, sf), tiles.box_filter(3), TILE, OVERLAP))


@query("tiled_apply_distributed", f"""WITH {TILES_SQL},
bx AS (SELECT p.frame_id, p.top, p.lft, p.i, p.j, sum(n.v) / 9 AS v
       FROM tp p JOIN tp n ON n.frame_id = p.frame_id AND n.top = p.top AND n.lft = p.lft
         AND n.i BETWEEN p.i - 1 AND p.i + 1 AND n.j BETWEEN p.j - 1 AND p.j + 1
       GROUP BY ALL), {add_sql('bx', '0')}
SELECT frame_id, pos::INT AS pos, round(v, 6) AS v FROM oa""")
def _tiled_apply_distributed(spark, sf):
    return _pixel_rows(
        tiles.tiled_apply(
            frames(spark, sf), tiles.box_filter(3), TILE, OVERLAP, edge="exact", distribute=True
        )
    )


@query("tiled_evaluation", f"""WITH {TILES_SQL}, {add_sql('tp', '1e-6')}
SELECT frame_id, round(avg((o.v - p.v) * (o.v - p.v)), 6) AS mse FROM oa o JOIN px p USING (frame_id, pos)
GROUP BY frame_id""")
def _tiled_evaluation(spark, sf):
    """Restore tile by tile (identity), then score against the frame itself."""
    f = frames(spark, sf)
    restored = tiles.tiled_apply(f, None, TILE, OVERLAP).select(
        "frame_id", F.col("pixels").alias("restored")
    )
    both = f.join(restored, "frame_id")
    return both.select("frame_id", r6(quality.mse(F.col("restored"), F.col("pixels")), "mse"))


# --- noise ----------------------------------------------------------------------------------------------------

SEED = 11


def _normal(what: str) -> str:
    return md5_normal_sql(SEED, f"frame_id || '|' || pos || '|{what}'")


def _clip(x: str, hi: str = "1") -> str:
    return f"greatest(0.0::DOUBLE, least({hi}.0::DOUBLE, {x}))"


@query("add_gaussian", f"""WITH {PIXELS_SQL}
SELECT frame_id, pos::INT AS pos, round({_clip(f"v + 25.0::DOUBLE / 255 * {_normal('gauss')}")}, 6) AS v FROM px""")
def _add_gaussian(spark, sf):
    return _pixel_rows(noise.add_stress(frames(spark, sf), 25.0, seed=SEED, algo="md5"))


@query("add_speckle", f"""WITH {PIXELS_SQL}
SELECT frame_id, pos::INT AS pos, round({_clip(f"v * {_clip(f'1 + 0.2::DOUBLE * {_normal(chr(115) + 'peckle')}', '3')}")}, 6) AS v
FROM px""")
def _add_speckle(spark, sf):
    return _pixel_rows(noise.add_noise(frames(spark, sf), 0.0, 0.2, "gauss", seed=SEED, algo="md5"))


BURR_SQL = f"""{PIXELS_SQL},
u AS (SELECT *, greatest(1e-6, least(1 - 1e-6, {md5_uniform_sql(SEED, "frame_id || '|' || pos || '|burr'")})) AS u FROM px),
m AS (SELECT *, power(greatest(power(1 - u, -1 / 1189.53::DOUBLE) - 1, 0), 1 / 4.687::DOUBLE) AS m FROM u),
b AS (SELECT *, {_clip("v * (1 + 0.25::DOUBLE * (m / (avg(m) OVER (PARTITION BY frame_id) + 1e-9) - 1))", "3")} AS s FROM m)"""


@query("add_speckle_burr", f"""WITH {BURR_SQL}
SELECT frame_id, pos::INT AS pos, round({_clip("s")}, 6) AS v FROM b""")
def _add_speckle_burr(spark, sf):
    return _pixel_rows(noise.add_noise(frames(spark, sf), 0.0, 0.25, "burr", seed=SEED, algo="md5"))


@query("add_noise", f"""WITH {BURR_SQL}
SELECT frame_id, pos::INT AS pos, round({_clip(f"s + 0.02::DOUBLE * {_normal('gauss')}")}, 6) AS v FROM b""")
def _add_noise(spark, sf):
    return _pixel_rows(noise.add_noise(frames(spark, sf), 0.02, 0.25, "burr", seed=SEED, algo="md5"))


@query("add_additive", f"""WITH {PIXELS_SQL}
SELECT frame_id, pos::INT AS pos, round({_clip(f"v + 0.05::DOUBLE * {_normal('gauss')} + 0.1::DOUBLE * {_normal('speckle')}")}, 6) AS v
FROM px""")
def _add_additive(spark, sf):
    return _pixel_rows(noise.add_additive(frames(spark, sf), 0.05, 0.1, seed=SEED, algo="md5"))


# --- augmentation ---------------------------------------------------------------------------------------------------


def _draw(what: str, lane: int) -> str:
    return md5_uniform_sql(SEED, f"frame_id || '|{what}'", lane)


AUG_SQL = f"""{PIXELS_SQL},
aug AS (SELECT frame_id,
  CASE WHEN {_draw('roll', 0)} < 0.5 THEN floor({_draw('roll', 1)} * 9)::INT - 4 ELSE 0 END AS dy,
  CASE WHEN {_draw('roll', 0)} < 0.5 THEN floor({_draw('roll', 2)} * 9)::INT - 4 ELSE 0 END AS dx,
  {_draw('hflip', 0)} < 0.5 AS hf, {_draw('vflip', 0)} < 0.2 AS vf,
  CASE WHEN {_draw('light', 0)} < 0.7 THEN 0.9 + 0.2 * {_draw('light', 1)} ELSE 1 END AS sc,
  CASE WHEN {_draw('light', 0)} < 0.7 THEN -0.05 + 0.1 * {_draw('light', 2)} ELSE 0 END AS bi,
  CASE WHEN {_draw('gamma', 0)} < 0.7 THEN 0.9 + 0.2 * {_draw('gamma', 1)} ELSE 1 END AS ga
  FROM (SELECT DISTINCT frame_id FROM px))"""


@query("augment", f"""WITH {AUG_SQL},
moved AS (SELECT frame_id, v, sc, bi, ga,
  CASE WHEN vf THEN 7 - (y + dy + 16) % 8 ELSE (y + dy + 16) % 8 END AS ty,
  CASE WHEN hf THEN 7 - (x + dx + 16) % 8 ELSE (x + dx + 16) % 8 END AS tx
  FROM px JOIN aug USING (frame_id))
SELECT frame_id, (ty * 8 + tx)::INT AS pos, round({_clip(f"power({_clip('v * sc + bi')}, ga)")}, 6) AS v FROM moved""")
def _augment(spark, sf):
    return _pixel_rows(ag.augment(frames(spark, sf), SEED))


@query("augment_pair", f"""WITH {PIXELS_SQL},
moved AS (SELECT frame_id, a, b, CASE WHEN {_draw('pair', 1)} < 0.2 THEN 7 - y ELSE y END AS ty,
  CASE WHEN {_draw('pair', 0)} < 0.5 THEN 7 - x ELSE x END AS tx FROM pr)
SELECT frame_id, (ty * 8 + tx)::INT AS pos, round(a, 6) AS a, round(b, 6) AS b FROM moved""")
def _augment_pair(spark, sf):
    p = ag.augment_pair(pairs(spark, sf), SEED)
    return fr.pixel_view(p, ["frame_id", "w"], a="noisy", b="clean").select(
        "frame_id", "pos", r6("a"), r6("b")
    )


@query("augment_classifier", f"""WITH {PIXELS_SQL},
d AS (SELECT frame_id, {_draw('rows', 0)} > 0.5 AS vf, {_draw('cols', 0)} > 0.5 AS hf,
  CASE WHEN {_draw('turn', 0)} > 0.5 THEN radians({_draw('turn', 1)} * 20 - 10) ELSE 0 END AS t
  FROM (SELECT DISTINCT frame_id FROM px)),
g AS (SELECT d.*, y, x,
  round_even(sin(t) * (x - 3.5) + cos(t) * (y - 3.5) + 3.5, 0)::INT AS sy,
  round_even(cos(t) * (x - 3.5) - sin(t) * (y - 3.5) + 3.5, 0)::INT AS sx
  FROM d, (SELECT unnest(range(8)) AS y) a, (SELECT unnest(range(8)) AS x) b)
SELECT g.frame_id, (g.y * 8 + g.x)::INT AS pos, round(coalesce(v, 0), 6) AS v
FROM g LEFT JOIN px ON px.frame_id = g.frame_id AND px.y = CASE WHEN vf THEN 7 - sy ELSE sy END
  AND px.x = CASE WHEN hf THEN 7 - sx ELSE sx END""")
def _augment_classifier(spark, sf):
    return _pixel_rows(ag.augment_classifier(frames(spark, sf), SEED))


# --- channel gates ------------------------------------------------------------------------------------------------------

KERNEL = [0.8, 1.7, -0.6]
WIDE = [0.3, -0.2, 0.9, 0.4, -0.5]
WIDEST = [0.1, 0.2, -0.3, 0.6, 0.5, -0.1, 0.05]

CHANNELS_SQL = """
ch AS (SELECT vec_id, label, i, v::DOUBLE AS v FROM (
  SELECT vec_id, label, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings))"""


def conv_sql(name: str, kernel: list[float], value: str = "n.v") -> str:
    half = len(kernel) // 2
    taps = ", ".join(f"({j - half}, {k}::DOUBLE)" for j, k in enumerate(kernel))
    return f"""
{name} AS (SELECT c.vec_id, c.i, sum(k * {value}) AS y FROM ch c, (VALUES {taps}) AS t(d, k)
  JOIN ch n ON n.vec_id = c.vec_id AND n.i = c.i + d GROUP BY c.vec_id, c.i)"""


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("v")
    )


def _channel_rows(df, **cols):
    zipped = F.arrays_zip(*[F.col(c) for c in cols.values()])
    return df.select("vec_id", F.posexplode(zipped).alias("i", "_z")).select(
        "vec_id", "i", *[r6(F.col(f"_z.{c}"), n) for n, c in cols.items()]
    )


@query("channel_gate", f"""WITH {CHANNELS_SQL}, {conv_sql('cv', KERNEL)},
g AS (SELECT vec_id, i, v, 1 / (1 + exp(-y / 0.75)) AS g FROM cv JOIN ch USING (vec_id, i))
SELECT vec_id, i::INT AS i, round(g, 6) AS gate, round(v * (1 + 0.5 * 2 * (g - 0.5)), 6) AS gated FROM g""")
def _channel_gate(spark, sf):
    out = vectors.channel_gate(_vectors(spark, sf), "v", [KERNEL])
    return _channel_rows(out, gate="gate", gated="gated")


@query("channel_gate_two_branches", f"""WITH {CHANNELS_SQL}, {conv_sql('cv', KERNEL)},
{conv_sql('cm', WIDE, 'abs(n.v)')},
g AS (SELECT vec_id, i, v, 1 / (1 + exp(-(cv.y + cm.y) / 2 / 0.5)) AS g
      FROM cv JOIN cm USING (vec_id, i) JOIN ch USING (vec_id, i))
SELECT vec_id, i::INT AS i, round(g, 6) AS gate, round(v * g, 6) AS gated FROM g""")
def _channel_gate_two_branches(spark, sf):
    rows = _vectors(spark, sf).withColumn("m", F.transform("v", F.abs))
    out = vectors.channel_gate(
        rows, "v", [KERNEL], temp=0.5, centered=False, max_column="m", max_kernel=WIDE
    )
    return _channel_rows(out, gate="gate", gated="gated")


@query("channel_gate_multi_scale", f"""WITH {CHANNELS_SQL},
{conv_sql('c3', KERNEL, '(n.v + abs(n.v)) / 2')}, {conv_sql('c5', WIDE, '(n.v + abs(n.v)) / 2')},
{conv_sql('c7', WIDEST, '(n.v + abs(n.v)) / 2')},
p AS (SELECT ln(1 + exp(-0.3::DOUBLE)) + 1e-6 AS temp, 0.01 + 1.49 / (1 + exp(-0.4::DOUBLE)) AS gain),
g AS (SELECT vec_id, i, v, gain, 1 / (1 + exp(-(c3.y + c5.y + c7.y) / 3 / temp)) AS g
      FROM c3 JOIN c5 USING (vec_id, i) JOIN c7 USING (vec_id, i) JOIN ch USING (vec_id, i), p)
SELECT vec_id, i::INT AS i, round(g, 6) AS gate, round(v * (1 + gain * 2 * (g - 0.5)), 6) AS gated FROM g""")
def _channel_gate_multi_scale(spark, sf):
    rows = _vectors(spark, sf).withColumn("m", F.transform("v", F.abs))
    out = vectors.channel_gate(
        rows, "v", [KERNEL, WIDE, WIDEST], temp=vectors.learned_temp(-0.3),
        gain=vectors.learned_gain(0.4), max_column="m",
        gain_range=(vectors.GAIN_MIN, vectors.GAIN_MAX),
    )
    return _channel_rows(out, gate="gate", gated="gated")


@query("gate_stats", f"""WITH {CHANNELS_SQL}, {conv_sql('cv', KERNEL)},
g AS (SELECT vec_id, label, i, 1 / (1 + exp(-y / 0.75)) AS g FROM cv JOIN ch USING (vec_id, i)),
t AS (SELECT label, avg(vec_id * 0.0123456789::DOUBLE) AS temp_mean,
        avg(vec_id * 0.0987654321::DOUBLE) FILTER (vec_id % 5 <> 0) AS gain_mean FROM embeddings GROUP BY label)
SELECT label, round(avg(g), 6) AS gate_mean, round(any_value(temp_mean), 6) AS temp_mean,
  round(any_value(gain_mean), 6) AS gain_mean FROM g JOIN t USING (label) GROUP BY label""")
def _gate_stats(spark, sf):
    rows = vectors.channel_gate(_vectors(spark, sf), "v", [KERNEL]).select(
        "label", "gate", (F.col("vec_id") * 0.0123456789).alias("temp"),
        F.when(F.col("vec_id") % 5 == 0, F.lit(float("nan")))
        .otherwise(F.col("vec_id") * 0.0987654321)
        .alias("gain"),
    )
    out = vectors.gate_stats(rows, "label")
    return rounded(out, ["gate_mean", "temp_mean", "gain_mean"], keep=["label"])


@query("gate_mean_intervention", f"""WITH {CHANNELS_SQL}, {conv_sql('cv', KERNEL)},
g AS (SELECT vec_id, label, i, v, 1 / (1 + exp(-y / 0.75)) AS g FROM cv JOIN ch USING (vec_id, i)),
o AS (SELECT label, v * (1 + g - 0.5) AS a, v * (1 + avg(g) OVER (PARTITION BY i) - 0.5) AS b, v * 1.5 AS c FROM g)
SELECT label, round(sqrt(sum((a - b) * (a - b)) / sum(a * a)), 6) AS mean_l2, round(corr(a, b), 6) AS mean_corr,
  round(sqrt(sum((a - c) * (a - c)) / sum(a * a)), 6) AS ones_l2, round(corr(a, c), 6) AS ones_corr
FROM o GROUP BY label""")
def _gate_mean_intervention(spark, sf):
    rows = vectors.channel_gate(_vectors(spark, sf), "v", [KERNEL])
    done = vectors.gate_mean_intervention(rows, "v", replace=("mean", "ones"))
    change = quality.output_change(
        done, ["label"], "original", {"mean_": "intervened_mean", "ones_": "intervened_ones"}
    )
    return change.select(
        "label",
        *[r6(f"{how}_{c}", f"{how}_{n}") for how in ("mean", "ones") for c, n in (("relative_l2", "l2"), ("correlation", "corr"))],
    )
