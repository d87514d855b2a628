"""Small cases worked out by hand, and properties."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framemetry.functions import arrays, scalars as sc
from framemetry.functions.draws import normal, uniform
from framemetry.operators import classify, frames as fr, noise, quality, runs, splits, stats, stencil, tiles, vectors


def _frame(spark, px, h, w, frame_id=1):
    return spark.createDataFrame(
        [(frame_id, h, w, [float(v) for v in px])], "frame_id BIGINT, h INT, w INT, pixels ARRAY<DOUBLE>"
    )


def _one(df, expr):
    return df.select(expr.alias("v")).first()["v"]


def _pair(spark, x, y):
    h, w = x.shape
    return spark.createDataFrame(
        [(1, h, w, x.ravel().tolist(), y.ravel().tolist())],
        "frame_id BIGINT, h INT, w INT, noisy ARRAY<DOUBLE>, clean ARRAY<DOUBLE>",
    )


@pytest.mark.parametrize(
    "mse,full,plain,pairs", [(0.01, 20.0, 20.0, 20.0), (0.0, 99.0, 80.0, 50.0)]
)
def test_psnr(spark, mse, full, plain, pairs):
    df = spark.createDataFrame([(mse,)], "m DOUBLE")
    for variant, want in (("full", full), ("plain", plain), ("pairs", pairs)):
        assert _one(df, sc.psnr("m", variant)) == pytest.approx(want, abs=1e-5)


@pytest.mark.parametrize("form", ["arrow", "jvm"])
def test_identical_pictures(spark, form):
    x = np.random.default_rng(0).random((16, 20))
    p = quality.pair_scores(_pair(spark, x, x), ["frame_id"], form=form).first()
    assert p["psnr"] == 99.0 and p["mse"] == 0.0
    assert p["ssim"] == pytest.approx(1.0, abs=1e-9)
    assert p["edge_f1"] == pytest.approx(1.0, abs=1e-6)


def test_score_forms_agree(spark):
    """JVM expressions, Arrow batches and the pixel table give the same scores on odd sizes."""
    rng = np.random.default_rng(1)
    rows = []
    for i, (h, w) in enumerate([(9, 14), (30, 70), (5, 5), (9, 14), (64, 65)]):
        y = rng.random((h, w))
        x = np.clip(y + 0.1 * rng.standard_normal((h, w)), 0, 1)
        rows.append((i, h, w, x.ravel().tolist(), y.ravel().tolist()))
    df = spark.createDataFrame(
        rows, "frame_id BIGINT, h INT, w INT, noisy ARRAY<DOUBLE>, clean ARRAY<DOUBLE>"
    )
    a = {r["frame_id"]: r for r in quality.pair_scores(df, ["frame_id"], form="jvm").collect()}
    b = {r["frame_id"]: r for r in quality.pair_scores(df, ["frame_id"]).collect()}
    px = fr.pixel_view(df, ["frame_id", "h", "w"], a="noisy", b="clean")
    c = {r["frame_id"]: r["ssim"] for r in stencil.ssim_pixels(px, ["frame_id"], block=16).collect()}
    assert set(a) == set(b) == set(c) == set(range(5))
    for i in a:
        for s in quality.SCORES:
            assert a[i][s] == pytest.approx(b[i][s], abs=1e-9), (i, s)
        assert c[i] == pytest.approx(a[i]["ssim"], abs=1e-9)


def test_sobel_of_a_constant(spark):
    out = _one(_frame(spark, [1.0] * 25, 5, 5), arrays.sobel(F.col("pixels"), F.col("h"), F.col("w")))
    assert out[12] == pytest.approx(1e-6)
    assert out[0] == pytest.approx(math.sqrt(18.0), abs=1e-6)


def test_blocks_do_not_change_a_stencil(spark):
    px = np.random.default_rng(2).random(23 * 17)
    view = fr.pixel_view(_frame(spark, px, 23, 17), ["frame_id", "h", "w"], v="pixels")
    small = stencil.sobel_pixels(view, ["frame_id"], block=4)
    whole = stencil.sobel_pixels(view, ["frame_id"], block=64)
    both = small.join(whole.withColumnRenamed("edge", "other"), ["frame_id", "y", "x"])
    assert both.count() == 23 * 17
    assert both.filter(F.abs(F.col("edge") - F.col("other")) > 1e-12).count() == 0


@pytest.mark.parametrize("size,tile,overlap,starts", [(16, 8, 2, [0, 6, 12]), (512, 256, 32, [0, 224, 448])])
def test_grid(spark, size, tile, overlap, starts):
    df = spark.createDataFrame([(size,)], "n INT")
    assert _one(df, tiles.grid_offsets(F.col("n"), tile, overlap)) == starts


def test_overlap_add_of_ones(spark):
    f = _frame(spark, [1.0] * 256, 16, 16)
    out = np.array(tiles.tiled_apply(f, None, 8, 2).first()["pixels"]).reshape(16, 16)
    # k tiles cover a border pixel, each with weight 1e-6: k / (k + 1)
    covers = np.array([sum(s <= x < s + 8 for s in (0, 6, 12)) for x in range(16)])
    assert out[0] == pytest.approx(covers / (covers + 1.0), abs=1e-3)
    assert out[:, 0] == pytest.approx(covers / (covers + 1.0), abs=1e-3)
    assert (out[1:, 1:] >= 0.99995).all() and (out[1:, 1:] <= 1.0).all()
    exact = tiles.tiled_apply(f, None, 8, 2, edge="exact").first()["pixels"]
    assert exact == pytest.approx([1.0] * 256, abs=1e-9)


@pytest.mark.parametrize("h,w,tile,overlap", [(16, 16, 8, 2), (11, 7, 5, 3), (20, 9, 16, 1), (6, 6, 9, 4)])
def test_overlap_add_forms_agree(spark, h, w, tile, overlap):
    px = np.random.default_rng(3).random(h * w)
    f = _frame(spark, px, h, w)
    t = tiles.tile_frames(f, tile, overlap)
    rows = tiles.overlap_add(t, tile).first()["pixels"]
    in_rows = tiles.tiled_apply(f, None, tile, overlap).first()["pixels"]
    assert in_rows == pytest.approx(rows, abs=1e-12)
    blur = tiles.box_filter(3)
    one, many = (
        tiles.tiled_apply(f, blur, tile, overlap, distribute=d).first()["pixels"] for d in (False, True)
    )
    assert one == pytest.approx(many, abs=1e-12)
    dots = fr.assemble(tiles.overlap_add_pixels(t, tile), ["frame_id"]).first()["pixels"]
    assert rows == pytest.approx(dots, abs=1e-12)
    trimmed = tiles.tile_frames(f, tile, overlap, trim=True)
    again = tiles.overlap_add(trimmed, tile, edge="exact").first()["pixels"]
    assert again == pytest.approx(px.tolist(), abs=1e-9)


def test_reflect_pad(spark):
    out = fr.reflect_pad(_frame(spark, [1, 2, 3], 1, 3), 1, 5).first()
    assert out["pixels"] == [1, 2, 3, 2, 1] and out["w"] == 5
    x = np.arange(6).reshape(2, 3)
    far = fr.reflect_pad(_frame(spark, x.ravel(), 2, 3), 7, 9).first()["pixels"]
    assert far == np.pad(x, ((0, 5), (0, 6)), mode="reflect").ravel().tolist()


def test_random_crop_of_small_and_large(spark):
    big = np.arange(12 * 10.0)
    df = _frame(spark, big, 12, 10, 1).union(_frame(spark, np.arange(6.0), 2, 3, 2))
    out = {r["frame_id"]: r for r in fr.random_crop(df, 4, seed=5).collect()}
    t, l = out[1]["top"], out[1]["left"]
    assert out[1]["pixels"] == big.reshape(12, 10)[t : t + 4, l : l + 4].ravel().tolist()
    assert out[2]["pixels"] == np.pad(
        np.arange(6.0).reshape(2, 3), ((0, 2), (0, 1)), mode="reflect"
    ).ravel().tolist()


def test_resize_keeps_the_mean_and_the_right_size(spark):
    x = np.random.default_rng(4).random((10, 20))
    f = _frame(spark, x.ravel(), 10, 20)
    half = np.array(fr.resize_frames(f, 5, 10).first()["pixels"])
    assert len(half) == 50 and half.mean() == pytest.approx(x.mean(), abs=0.03)
    assert fr.resize_frames(f, 10, 20).first()["pixels"] == x.ravel().tolist()


def test_clamp(spark):
    df = spark.createDataFrame([(math.nan,), (-0.2,), (1.4,)], "v DOUBLE")
    out = [r["c"] for r in df.select(sc.clamp01("v").alias("c")).collect()]
    assert math.isnan(out[0]) and out[1:] == [0.0, 1.0]


def test_text_functions(spark):
    df = spark.createDataFrame(
        [("0,1, x,2", [0, 1, 2]), ("", None), ("x", None), ("9999999999,3", [3])], "s STRING, want ARRAY<INT>"
    )
    for r in df.select("want", sc.parse_position_list("s").alias("got")).collect():
        assert r["got"] == r["want"]
    slug = df.limit(1).select(sc.slug(F.lit("Macro-F1@BestF1")).alias("s")).first()["s"]
    assert slug == "macro_f1_bestf1"
    one = df.limit(1).select(
        sc.relative_path(F.lit("file:/data/root/a/x.png"), "file:///data/root/").alias("r"),
        sc.last_two_parts(F.lit("a/b/c.png")).alias("l"),
        sc.fixed(F.lit(math.nan), 4).alias("n"), sc.fixed(F.lit(1.23456), 4).alias("f"),
        sc.mean_std_label(F.lit(94.221), F.lit(0.857)).alias("m"),
    ).first()
    nested = df.limit(1).select(
        sc.relative_path(F.lit("hdfs://host/data/root/a/data/root/x.png"), "/data/root").alias("r"),
        sc.fixed(F.lit(math.inf), 4).alias("i"), sc.fixed(F.lit(-math.inf), 4).alias("j"),
    ).first()
    assert nested == ("a/data/root/x.png", "inf", "-inf")
    assert one == ("a/x.png", "b/c.png", "nan", "1.2346", "94.22±0.86")


def test_finite_means(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", math.nan), ("a", 3.0), ("b", math.inf)], "k STRING, v DOUBLE")
    out = {r["k"]: r for r in df.groupBy("k").agg(sc.finite_mean("v").alias("m"), sc.l2_norm("v").alias("n")).collect()}
    assert out["a"]["m"] == 2.0 and math.isnan(out["b"]["m"]) and math.isnan(out["a"]["n"])


# --- splits -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,val", [(100, 15), (10, 1), (3, 1)])
def test_split_sizes(spark, n, val):
    out = splits.split_random(spark.range(n), "id", 0.15, 42)
    assert out.filter(F.col("split") == "val").count() == val and out.count() == n


def test_split_does_not_depend_on_partitioning(spark):
    a = splits.split_random(spark.range(0, 500, 1, 3), "id", 0.2, 7)
    b = splits.split_random(spark.range(0, 500, 1, 3).repartition(5), "id", 0.2, 7)
    assert a.exceptAll(b).count() == 0
    other = splits.split_random(spark.range(500), "id", 0.2, 8)
    assert a.exceptAll(other).count() > 0


def test_fixed_floor_refuses_small_sets(spark):
    assert splits.split_fixed_floor(spark.range(3000), "id", 1).filter("split = 'val'").count() == 300
    with pytest.raises(Exception, match="at least that many rows"):
        splits.split_fixed_floor(spark.range(150), "id", 1).collect()


def test_lofo(spark):
    df = spark.createDataFrame([("a/x.png",), ("b/y.png",), ("r.png",)], "path STRING")
    out = {r["path"]: (r["grp"], r["split"]) for r in splits.split_lofo(df, "path").collect()}
    assert out == {"a/x.png": ("a", "train"), "b/y.png": ("b", "val"), "r.png": ("", "train")}
    named = splits.split_lofo(df, "path", "a").filter("split = 'val'").collect()
    assert [r["path"] for r in named] == ["a/x.png"]


def test_stratified_with_a_dominant_label(spark):
    df = spark.range(3001).select("id", F.when(F.col("id") < 2900, "hot").otherwise("cold").alias("label"))
    out = splits.split_stratified(df, "id", "label", 0.2, 3).groupBy("label", "split").count()
    got = {(r["label"], r["split"]): r["count"] for r in out.collect()}
    assert got == {("hot", "val"): 580, ("hot", "train"): 2320, ("cold", "val"): 20, ("cold", "train"): 81}


def test_folds(spark):
    df = spark.createDataFrame([(b,) for b in "ABCA"], "board STRING")
    folds = {(r["fold"], r["board"]): r["role"] for r in splits.board_folds(df, "board").collect()}
    assert folds[("A", "A")] == "test" and folds[("A", "B")] == "val" and folds[("A", "C")] == "train"
    assert folds[("C", "A")] == "val" and len(folds) == 9
    assert splits.fold_rows(df, "board", splits.board_folds(df, "board"), "A").count() == 4


def test_weighted_draws(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 1900, 0).otherwise(1).alias("label"))
    out = splits.weighted_draws(df, "id", "label", 9)
    per = {r["label"]: r["n"] for r in out.groupBy("label").agg(F.sum("draws").alias("n")).collect()}
    assert sum(per.values()) == 2000 and abs(per[0] - 1000) < 120
    assert splits.weighted_draws(df, "id", "label", 9, expand=True).count() == 2000


# --- runs --------------------------------------------------------------------------------------------------


def _log(spark, values, column="val_loss"):
    return spark.createDataFrame(
        [(1, i + 1, float(v)) for i, v in enumerate(values)], f"run INT, epoch INT, {column} DOUBLE"
    )


def test_early_stop(spark):
    out = runs.early_stop(_log(spark, [5, 4, 4, 4]), ["run"], patience=2).first()
    assert (out["stop_epoch"], out["best_epoch"], out["best"]) == (4, 2, 4.0)


def test_best_checkpoint_keeps_the_first(spark):
    log = _log(spark, [0.5, 0.7, 0.7, math.nan], "val_ssim")
    out = runs.best_checkpoint(log, ["run"], {"val_ssim": "max"}).first()
    assert (out["val_ssim_epoch"], out["val_ssim_best"]) == (2, 0.7)
    low = runs.best_so_far(log, ["run"], "val_ssim", "max", start_value=0.9)
    assert low.filter("is_best").count() == 0


@pytest.mark.parametrize("width", [1, 3, 65536])
def test_bucket_width_does_not_change_a_running_best(spark, width):
    rng = np.random.default_rng(5)
    values = [math.nan if v < 0.1 else round(v, 1) for v in rng.random(200)]
    got = [
        (r["best"], r["best_epoch"], r["is_best"])
        for r in runs.best_so_far(_log(spark, values), ["run"], "val_loss", width=width).orderBy("epoch").collect()
    ]
    best, at, want = None, 0, []
    for e, v in enumerate(values, 1):
        better = math.isfinite(v) and (best is None or v < best)
        if better:
            best, at = v, e
        want.append((best, at, better))
    assert got == want


def test_budget(spark):
    rows = [(1, i, math.nan) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "run INT, batch INT, loss DOUBLE")
    out = runs.nonfinite_budget(df, ["run"], max_bad=3).orderBy("batch").collect()
    assert [r["batch"] for r in out] == [1, 2, 3, 4] and out[-1]["is_stop"]
    assert runs.nonfinite_budget(df, ["run"], max_bad=3, action="skip").count() == 5
    r = runs.budget_rollup(df.withColumn("epoch", F.lit(1)), ["run"]).first()
    assert (r["seen"], r["used"], r["bad"], r["stopped"], r["empty"]) == (4, 0, 4, True, True)
    assert runs.run_stop_epoch(runs.budget_rollup(df.withColumn("epoch", F.lit(1)), ["run"]), ["run"]).first()["stop_epoch"] == 1


def test_group_spans(spark):
    names = ["baseline", "pseudo", "pseudo", "baseline"] + ["real"] * 4
    df = spark.createDataFrame(list(enumerate(names)), "i INT, g STRING")
    out = runs.group_spans(df, ["i"], "g")
    spans = sorted((r["start"], r["end"], r["g"]) for r in out.collect())
    assert spans == [(0, 0, "baseline"), (1, 2, "pseudo"), (3, 3, "baseline"), (4, 7, "real")]
    assert sorted(r["separator"] for r in runs.change_points(out).collect()) == [0.5, 2.5, 3.5]


def test_every_n(spark):
    log = _log(spark, [1] * 10)
    assert [r["epoch"] for r in runs.every_n_epochs(log, 4).collect()] == [4, 8]
    assert runs.every_n_epochs(log, 0).count() == 0


def test_warmup(spark):
    df = spark.range(60).select(F.lit("m").alias("m"), "id")
    assert sorted(r["id"] for r in runs.warmup_drop(df, ["m"], ["id"], 50).collect()) == list(range(50, 60))
    assert runs.warmup_drop(df, ["m"], ["id"], 100).count() == 0


# --- classification, vectors, noise --------------------------------------------------------------------------


def test_report_with_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "true INT, pred INT")
    out = classify.classification_report(df).first()
    assert out["accuracy"] == pytest.approx(1 / 3)
    assert out["macro_f1"] == pytest.approx(0.5 / 3)  # class 0: p = r = 1/2, classes 1 and 2: 0


def test_report_on_the_larger_tables(spark):
    from framemetry.plans.bindings import predictions

    df = predictions(spark, "/root/testdata/sf0.01").filter("arm = 'every7'")
    out = classify.classification_report(df).first()
    assert out["accuracy"] == pytest.approx(0.856) and out["macro_f1"] == pytest.approx(0.855724, abs=1e-6)


def test_early_stop_on_the_larger_tables(spark):
    from framemetry.plans.bindings import epoch_log

    out = runs.early_stop(epoch_log(spark, "/root/testdata/sf0.01"), ["run"], patience=12)
    assert (out.filter("stop_epoch IS NOT NULL").count(), out.count()) == (122, 150)


def test_zero_kernel_gate_changes_nothing(spark):
    df = spark.createDataFrame([([0.1, -0.5, 0.7],)], "v ARRAY<DOUBLE>")
    out = vectors.channel_gate(df, "v", [[0.0, 0.0, 0.0]]).first()
    assert out["gate"] == [0.5] * 3 and out["gated"] == pytest.approx([0.1, -0.5, 0.7])


def test_noise_is_the_same_for_any_partitioning(spark):
    base = spark.range(50).select(
        F.col("id").alias("frame_id"), F.lit(2).alias("h"), F.lit(3).alias("w"),
        F.array_repeat(F.lit(0.5), 6).alias("pixels"),
    )
    a = noise.add_noise(base, 0.05, 0.25, "burr", seed=3)
    b = noise.add_noise(base.repartition(7), 0.05, 0.25, "burr", seed=3)
    assert a.exceptAll(b).count() == 0
    assert a.exceptAll(noise.add_noise(base, 0.05, 0.25, "burr", seed=4)).count() == 50
    off = noise.add_noise(base, 0.0, 0.0)
    assert off.exceptAll(base).count() == 0


@pytest.mark.parametrize("algo", ["md5", "xxhash64"])
def test_draws_look_random(spark, algo):
    out = spark.range(20000).agg(
        F.avg(uniform(1, F.col("id"), algo=algo)).alias("u"),
        F.avg(normal(1, F.col("id"), algo=algo)).alias("m"),
        F.stddev(normal(1, F.col("id"), algo=algo)).alias("s"),
    ).first()
    assert out["u"] == pytest.approx(0.5, abs=0.01)
    assert out["m"] == pytest.approx(0.0, abs=0.03) and out["s"] == pytest.approx(1.0, abs=0.03)


def test_dataset_without_a_usable_frame(spark):
    df = spark.createDataFrame([(math.nan,), (math.inf,)], "psnr DOUBLE")
    out = quality.dataset_quality(df, ["psnr"]).first()
    assert math.isnan(out["psnr"]) and (out["seen"], out["used"], out["skipped"]) == (2, 0, 2)


def test_sign_flip_smallest_p(spark):
    for n, p in ((5, 0.0625), (6, 0.03125), (1, 1.0)):
        df = spark.range(n).select((F.col("id") + 1.0).alias("delta"))
        assert stats.sign_flip_p(df, []).first()["exact_sign_flip_p"] == p
