"""NULL keys, empty pairings, large frames, names that differ late."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framemetry.operators import classify, frames as fr, plotdata, quality, runs, splits, stacks, stats, tiles


def test_null_keys_are_keys(spark):
    log = spark.createDataFrame(
        [(None, 1, 3.0), (None, 2, 1.0), (1, None, 0.1), (1, 1, 2.0), (1, 2, 5.0)], "run INT, epoch INT, val_loss DOUBLE"
    )
    best = {(r["run"], r["epoch"]): r["best"] for r in runs.best_so_far(log, ["run"], "val_loss").collect()}
    assert best == {(None, 1): 3.0, (None, 2): 1.0, (1, None): None, (1, 1): 2.0, (1, 2): 2.0}
    stops = {r["run"]: r["stop_epoch"] for r in runs.early_stop(log, ["run"], patience=1).collect()}
    assert stops == {None: None, 1: 2}
    kept = runs.nonfinite_budget(log, ["run"], order="epoch", loss="val_loss")
    assert kept.count() == 5
    assert runs.warmup_drop(log, ["run"], ["epoch"], 1).count() == 3
    assert classify.class_weights(log, "run").count() == 5
    spans = runs.group_spans(log.where("epoch IS NOT NULL"), ["epoch"], "run").collect()
    assert sum(r["end"] - r["start"] + 1 for r in spans) == 4
    pairs = log.select(F.col("run").alias("k"), F.col("val_loss").alias("delta"))
    assert {r["k"]: r["n"] for r in stats.paired_summary(pairs, ["k"]).collect()} == {None: 2, 1: 3}


def test_null_labels_are_split_and_drawn(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, F.lit("a")).alias("label"))
    out = splits.split_stratified(df, "id", "label", 0.25, 3)
    assert {r["label"]: r["n"] for r in out.where("split = 'val'").groupBy("label").agg(F.count("*").alias("n")).collect()} == {None: 25, "a": 25}
    drawn = splits.weighted_draws(df, "id", "label", 3)
    assert drawn.agg(F.sum("draws")).first()[0] == 200
    assert drawn.where("label IS NULL").agg(F.sum("draws")).first()[0] > 60


def test_pairing_nothing_fails(spark):
    schema = "rel_path STRING, h INT, w INT, pixels ARRAY<DOUBLE>"
    a = spark.createDataFrame([("x/1.png", 1, 1, [0.5])], schema)
    b = spark.createDataFrame([("y/1.png", 1, 1, [0.5]), (None, 1, 1, [0.5])], schema)
    with pytest.raises(Exception, match="no two frames pair"):
        fr.pair_frames(a, b).collect()
    assert [r["noisy_path"] for r in fr.pair_frames(a, b, on="name").collect()] == ["x/1.png"]
    with pytest.raises(Exception, match="not unique"):
        fr.pair_frames(a.union(a), b.union(a)).collect()


def test_names_that_differ_late(spark):
    df = spark.range(5000, 0, -1).select(F.format_string("run1/frame_%08d.png", "id").alias("rel_path"))
    got = fr.ordered_paths(df).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 5001))
    assert [r["rel_path"] for r in got] == sorted(r["rel_path"] for r in got)


def test_places_of_one_large_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 7 > 0, F.lit(1)).alias("k"), F.hash("id").alias("o"), "id")
    got = plotdata.place_in_order(df, ["k"], ["o", "id"]).toPandas()
    for _, part in got.groupby("k", dropna=False):
        assert part.sort_values(["o", "id"])["plot_order"].tolist() == list(range(1, len(part) + 1))


def test_large_frames_in_tiles(spark):
    """Two frames of 1024 x 1024 in small tiles, tiled, put together again in blocks."""
    rng = np.random.default_rng(1)
    x = rng.random((2, 1024 * 1024)).astype("float32")
    df = spark.createDataFrame([(i, 1024, 1024, x[i].tolist()) for i in range(2)], "frame_id INT, h INT, w INT, pixels ARRAY<FLOAT>")
    cut = tiles.tile_frames(df, 64, 16)
    assert cut.count() == 2 * 22 * 22
    out = tiles.overlap_add(cut, 64, edge="exact").collect()
    for r in out:
        np.testing.assert_allclose(np.array(r["pixels"]), x[r["frame_id"]], atol=1e-9)


@pytest.mark.parametrize("block", [5, 8, 64])
def test_blocks_are_the_frame(spark, block):
    rng = np.random.default_rng(2)
    x = rng.random((17, 13))
    df = spark.createDataFrame([(1, 17, 13, x.ravel().tolist())], "frame_id INT, h INT, w INT, pixels ARRAY<DOUBLE>")
    cut = tiles.tile_frames(df, 5, 2)
    whole = np.array(tiles.overlap_add(cut, 5).first()["pixels"]).reshape(17, 13)
    seen = np.zeros((17, 13))
    for r in tiles.overlap_add_blocks(cut, 5, block=block).collect():
        at = np.s_[r["y"] : r["y"] + r["bh"], r["x"] : r["x"] + r["bw"]]
        np.testing.assert_array_equal(np.array(r["pixels"]).reshape(r["bh"], r["bw"]), whole[at])
        seen[at] += 1
    assert (seen == 1).all()


def test_stacks_of_several_sizes_and_missing_frames(spark):
    rng = np.random.default_rng(3)
    rows = [(i, h, w, rng.random(h * w).tolist()) for i, (h, w) in enumerate([(4, 6), (6, 4), (4, 6)])] + [(9, 4, 6, None)]
    df = spark.createDataFrame(rows, "frame_id INT, h INT, w INT, pixels ARRAY<DOUBLE>")
    got = {r["frame_id"]: r["pixels"] for r in stacks.sobel(df).collect()}
    assert got[9] is None and len(got[1]) == 24
    pairs = df.withColumns({"noisy": F.col("pixels"), "clean": F.col("pixels")})
    scores = {r["frame_id"]: r for r in quality.pair_scores(pairs, ["frame_id"], scores=["mse", "ssim_global", "edge_f1_fixed"]).collect()}
    assert scores[0]["mse"] == 0 and abs(scores[1]["ssim_global"] - 1) < 0.2 and scores[9]["mse"] is None


def test_resize_weights_are_the_triangle_filter():
    for size, wanted in ((8, 5), (5, 8), (7, 7), (9, 1)):
        w = stacks.resize_weights(size, wanted)
        assert w.shape == (wanted, size)
        np.testing.assert_allclose(w.sum(1), 1)
    np.testing.assert_array_equal(stacks.resize_weights(6, 6), np.eye(6))


def test_sums_of_a_constant_picture(spark):
    df = spark.createDataFrame([(1, 2, 2, [0.5] * 4, [0.25] * 4)], "k INT, h INT, w INT, a ARRAY<DOUBLE>, b ARRAY<DOUBLE>")
    r = quality.signal_audit(df, ["k"], "a", "b").first()
    assert r["contrast_retention"] is None and r["input_output_correlation"] is None and r["mean_absolute_change"] == 0.25
