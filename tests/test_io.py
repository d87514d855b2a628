"""Picture files, result tables, logs, scans, streams."""

from __future__ import annotations

import math
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framemetry import schemas
from framemetry.functions.registry import register_functions
from framemetry.functions import scalars as sc
from framemetry.functions.scalars import parse_position_list
from framemetry.operators import frames as fr, plotdata, quality, runs, tiles
from framemetry.session import shared_dir
from framemetry.sources import images, tables
from framemetry.streaming import runs as sr


def _png(samples, depth=8, colour=0, kind=0):
    """A picture file whose rows use one of the five row predictions."""
    h, w = samples.shape[:2]
    n = images.CHANNELS[colour]
    body = samples.reshape(h, w * n).astype(">u2" if depth == 16 else np.uint8).view(np.uint8).reshape(h, -1)
    bpp = n * depth // 8
    lines = b""
    up = np.zeros(body.shape[1], int)
    for row in body.astype(int):
        left = np.concatenate([np.zeros(bpp, int), row[:-bpp]])
        corner = np.concatenate([np.zeros(bpp, int), up[:-bpp]])
        if kind == 4:
            p = left + up - corner
            pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        else:
            guess = [0 * row, left, up, (left + up) // 2][kind]
        lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        up = row

    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)
    return images.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
@pytest.mark.parametrize("depth", [8, 16])
def test_decode_gray(kind, depth):
    x = np.random.default_rng(kind).integers(0, 2**depth, (7, 9))
    h, w, d, px = images.decode_png(_png(x, depth, 0, kind))
    assert (h, w, d) == (7, 9, depth) and px.tolist() == x.ravel().tolist()


@pytest.mark.parametrize("colour", [2, 4, 6])
def test_decode_colour(colour):
    n = images.CHANNELS[colour]
    x = np.random.default_rng(colour).integers(0, 256, (5, 6, n))
    _, _, d, px = images.decode_png(_png(x, 8, colour, 4))
    want = x[..., 0] if n == 2 else np.floor(x[..., :3] @ [0.299, 0.587, 0.114] + 0.5)
    assert d == 8 and abs(px.reshape(5, 6) - want).max() <= 1


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pictures")
    rng = np.random.default_rng(9)
    for sub, names in (("clean", ["a/1.png", "a/2.png", "b/1.png", "r.png"]), ("noisy", ["a/1.png", "b/1.png", "c/9.png"])):
        for name in names:
            path = root / sub / name
            path.parent.mkdir(parents=True, exist_ok=True)
            h, w = (12, 10) if sub == "clean" else (11, 12)
            depth = 16 if name.startswith("b") else 8
            path.write_bytes(images.encode_gray_png(rng.integers(0, 2**depth, (h, w)), depth))
    (root / "clean" / "broken.png").write_bytes(b"not a picture")
    (root / "clean" / "note.txt").write_text("no picture at all")
    return root


def test_folders_to_scores(spark, folder, tmp_path):
    clean_all = images.ingest_frames(images.scan_frames(spark, f"{folder}/clean"))
    clean = images.decoded_frames(clean_all)
    noisy = images.decoded_frames(images.ingest_frames(images.scan_frames(spark, f"{folder}/noisy")))
    assert [r["rel_path"] for r in images.rejected_files(clean_all).collect()] == ["broken.png"]
    assert {r["rel_path"]: r["grp"] for r in clean.collect()} == {
        "a/1.png": "a", "a/2.png": "a", "b/1.png": "b", "r.png": ""
    }
    flat = images.scan_frames(spark, f"{folder}/clean", recursive=False)
    assert sorted(r["rel_path"] for r in flat.collect()) == ["broken.png", "r.png"]

    left = {(r["side"], r["rel_path"]) for r in fr.unpaired_frames(noisy, clean).collect()}
    assert left == {("noisy", "c/9.png"), ("clean", "a/2.png"), ("clean", "r.png")}
    pairs = fr.crop_common(fr.pair_frames(noisy, clean)).withColumn("frame_id", F.xxhash64("rel_path"))
    assert {(r["h"], r["w"], len(r["noisy"])) for r in pairs.collect()} == {(11, 10, 110)}

    restored = tiles.tiled_apply(pairs, tiles.box_filter(3), 6, 2, column="noisy", keys=("rel_path",))
    both = restored.select("rel_path", F.col("pixels").alias("noisy"), "h", "w").join(
        pairs.select("rel_path", F.transform("clean", lambda v: v.cast("double")).alias("clean")), "rel_path"
    )
    both = fr.clamp_frames(fr.drop_nonfinite(both, ["noisy", "clean"]), "noisy")
    report = quality.report_rows(quality.pair_scores(both, ["rel_path"]))
    tables.write_frame_metrics(report, f"{tmp_path}/metrics")
    back = tables.read_result_csv(spark, f"{tmp_path}/metrics", schemas.FRAME_METRICS)
    assert back.count() == 2 and back.filter("PSNR > 0 AND SSIM < 1").count() == 2


def test_empty_folder(spark, tmp_path):
    with pytest.raises(ValueError, match="no PNG files"):
        images.scan_frames(spark, str(tmp_path))


def test_frames_on_disk_prune_folders(spark, folder, tmp_path):
    frames = images.decoded_frames(images.ingest_frames(images.scan_frames(spark, f"{folder}/clean")))
    images.write_frames(frames.filter("grp <> ''"), f"{tmp_path}/frames")
    held_out = images.read_frames(spark, f"{tmp_path}/frames").filter("grp = 'b'")
    assert held_out.count() == 1
    plan = held_out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(grp" in plan


def test_malformed_rows(spark, tmp_path):
    path = tmp_path / "plot.csv"
    path.write_text(
        "pipeline_label_full,pipeline_label_short,accuracy_pct,macro_f1_pct,group_order,regime_group\n"
        "Raw,Raw,97.70,93.99,1,baseline\n"
        "A (light, 3 layers),A,98.87,96.64,5,real\n"
        "B,B,98.76,96.07,6,real\n"
        "C (wide, 7 layers),C,98.16,94.27,8,real\n"
        "D,D,oops,94.27,9,real\n"
        " \n"
    )
    good, bad = tables.quarantine_malformed(spark, str(path), schemas.PLOT_DOWNSTREAM)
    assert sorted(r["pipeline_label_short"] for r in good.collect()) == ["B", "Raw"]
    assert len(bad.collect()) == 3 and bad.count() == 3
    assert good.select("regime_group").count() == 2
    with pytest.raises(Exception):
        tables.read_result_csv(spark, str(path), schemas.PLOT_DOWNSTREAM).collect()
    out = plotdata.downstream_plot_data(good, "accuracy_pct").collect()
    assert {(r["label"], r["text"]) for r in out} == {("Raw", "97.70"), ("B", "98.76")}
    assert {(round(r["axis_lo"], 2), round(r["axis_hi"], 2)) for r in out} == {(96.70, 99.76)}


def test_manifest_and_provenance(spark, tmp_path):
    (tmp_path / "m.csv").write_text(
        "seed,model_family,eca_setting,eca_positions,normalization,supervision,stress_sigma_8bit,status\n"
        "42,Raw,none,,none,none,25,complete\n"
        '42,Net,light,"0,1,2",GroupNorm(8),real-aligned,25,complete\n'
    )
    m = tables.read_manifest(spark, str(tmp_path / "m.csv"))
    ids = {r["model_family"]: r["p"] for r in m.select("model_family", parse_position_list("eca_positions").alias("p")).collect()}
    assert ids == {"Raw": None, "Net": [0, 1, 2]}
    (tmp_path / "run.json").write_text(
        '{"run_id": "x", "seed": 42,\n "model": {"eca_layers": [0, 1, 2], "normalization": {"type": "group"}},\n'
        ' "evaluation": {"robustness": {"seeds_evaluated": [42, 13]}}}'
    )
    p = tables.read_provenance(spark, str(tmp_path / "run.json")).first()
    assert p["model"]["eca_layers"] == [0, 1, 2] and p["model"]["normalization"]["type"] == "group"
    assert p["evaluation"]["robustness"]["seeds_evaluated"] == [42, 13] and p["training"] is None


def test_epoch_log_round_trip(spark, tmp_path):
    cols = [c.strip().split()[0] for c in schemas.EPOCH_LOG.split(",")]
    rows = [tuple([e, 0.5, 0.25 / e, 20.0, 0.9, 0.8, math.nan, math.nan, math.nan, 1e-4, 0, 0, 10, 5, 1.5]) for e in (1, 2)]
    log = spark.createDataFrame(rows, schemas.EPOCH_LOG)
    assert log.columns == cols
    tables.append_epoch_log(log.filter("epoch = 1"), f"{tmp_path}/log")
    tables.append_epoch_log(log.filter("epoch = 2"), f"{tmp_path}/log")
    back = tables.read_epoch_log(spark, f"{tmp_path}/log").orderBy("epoch").collect()
    assert [r["val_loss"] for r in back] == [0.25, 0.125] and math.isnan(back[0]["real_psnr"])
    scalars = runs.log_to_scalars(log.withColumn("run", F.lit(1)), ["run"])
    tags = {r["tag"] for r in scalars.collect()}
    assert "loss/train" in tags and "opt/grad_norm_mean" in tags and "real/psnr" not in tags


def test_path_leaks(spark, tmp_path):
    (tmp_path / "ok.csv").write_text("a,b\n1,2\n")
    (tmp_path / "bad.csv").write_text("a,b\n1,C:\\data\nprivate-folder,3\n")
    out = tables.scan_path_leaks(spark, f"{tmp_path}/*.csv", (*tables.LEAK_MARKERS, "private-folder", "PRIVATE"))
    assert {(os.path.basename(r["file"]), r["marker"]) for r in out.collect()} == {
        ("bad.csv", ":\\"), ("bad.csv", "private-folder")
    }


def test_sql_functions(spark):
    assert "psnr" in register_functions(spark)
    r = spark.sql(
        "SELECT psnr(0.01) p, psnr(0) q, slug('Macro-F1@BestF1') s, clamp01(1.4) c, "
        "sign_flip_p(array(1D, 2D, 3D, 4D, 5D)) f, sign_flip_p(array(-1D, 2D, 0.5D)) g, "
        "(SELECT count(*) FROM tile_grid(16, 16, 8, 2)) n, sign_flip_p(array(1D, 2D), 1) o"
    ).first()
    assert r["p"] == pytest.approx(20.0, abs=1e-5) and r["q"] == 99.0
    assert (r["s"], r["c"], r["f"], r["n"]) == ("macro_f1_bestf1", 1.0, 0.0625, 9)
    assert r["o"] is None
    assert r["g"] == 0.75  # |1.5| or more: all but one of the four sign classes


def _raw_png(w, h, depth, colour, lines, palette=b"", interlace=0):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)
    body = zlib.compress(b"".join(b"\0" + line for line in lines))
    plte = chunk(b"PLTE", palette) if palette else b""
    return images.SIGNATURE + chunk(b"IHDR", head) + plte + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_every_kind_of_png(spark, tmp_path):
    """Palette, interlaced, low bit depths and 16-bit files in one folder, among a broken one."""
    (tmp_path / "a").mkdir()
    files = {
        "a/gray8.png": _raw_png(2, 1, 8, 0, [bytes([0, 51])]),
        "a/gray1.png": _raw_png(2, 1, 1, 0, [bytes([0b01000000])]),
        "a/palette.png": _raw_png(2, 1, 8, 3, [bytes([1, 0])], palette=bytes([255, 255, 255, 0, 0, 0])),
        "a/colour.png": _raw_png(1, 1, 8, 2, [bytes([255, 0, 0])]),
        "a/interlaced.png": _raw_png(1, 1, 8, 0, [bytes([102])], interlace=1),
        "deep.png": images.encode_gray_png(np.array([[1, 65535]]), 16),
        "broken.png": b"no picture",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r["rel_path"]: r for r in images.ingest_folder(spark, str(tmp_path)).collect()}
    assert set(got) == set(files)
    px = {k: [round(v * 255, 3) for v in r["pixels"]] for k, r in got.items() if r["reason"] is None}
    assert px == {
        "a/gray8.png": [0, 51], "a/gray1.png": [0, 255], "a/palette.png": [0, 255], "a/colour.png": [76],
        "a/interlaced.png": [102], "deep.png": [round(255 / 65535, 3), 255],
    }
    assert got["broken.png"]["reason"] and got["deep.png"]["bit_depth"] == 16 and got["a/gray8.png"]["grp"] == "a"


def test_a_gray_folder_is_opened_once(spark, tmp_path):
    """The image source, which opens every file again, is left out where no file needs it."""
    files = {f"{depth}/{k}.png": images.encode_gray_png(np.array([[k, 2**depth - 1]]), depth) for depth in (8, 16) for k in range(3)}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)

    def sources(out):
        return out._jdf.queryExecution().optimizedPlan().toString().count("image")

    out = images.ingest_folder(spark, str(tmp_path))
    assert sources(out) == 0
    px = {r["rel_path"]: [round(v * (2 ** r["bit_depth"] - 1)) for v in r["pixels"]] for r in out.collect()}
    assert px == {name: [int(name[-5]), 2 ** int(name.split("/")[0]) - 1] for name in files}
    (tmp_path / "short.png").write_bytes(files["8/1.png"][:40])
    out = images.ingest_folder(spark, str(tmp_path))
    assert sources(out) > 0
    reasons = {r["rel_path"]: r["reason"] for r in out.collect()}
    assert set(reasons) == {*files, "short.png"} and {k for k, v in reasons.items() if v} == {"short.png"}


def test_roots(spark):
    cases = [
        ("file:/data/x/data/1.png", "/data", "x/data/1.png"), ("file:///data/a/run1/b/2.png", "file:/data/*/run[0-9]", "b/2.png"),
        ("s3a://b/k/c/3.png", "s3a://b/{k,l}/", "c/3.png"), ("file:/w/rel/rel/4.png", "rel", "rel/4.png"), ("hdfs://n/e/5.png", "/f", "hdfs://n/e/5.png"),
    ]
    df = spark.range(1).select(*[sc.relative_path(F.lit(p), root).alias(f"c{i}") for i, (p, root, _) in enumerate(cases)])
    assert list(df.first()) == [want for *_, want in cases]


# --- streams ------------------------------------------------------------------------------------------------

LOG = "run BIGINT, epoch BIGINT, val_loss DOUBLE"


def _write(spark, rows, path):
    spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(path)


def test_restart_continues_with_its_state(spark):
    source, sink, checkpoint = (shared_dir(spark, n) for n in ("log", "out", "chk"))
    losses = [5.0, 4.0, 4.5, 4.2, 4.1, 4.3, 3.0]
    rows = [(1, e, v) for e, v in enumerate(losses, 1)] + [(2, e, 1.0 / e) for e in range(1, 8)]
    want = runs.early_stop(spark.createDataFrame(rows, LOG), ["run"], patience=3).collect()

    def go():
        stream = sr.read_stream(spark, source, LOG)
        sr.run_to_table(sr.stream_early_stop(stream, "run", patience=3), sink, checkpoint)

    _write(spark, [r for r in rows if r[1] <= 3], source)
    go()
    _write(spark, [r for r in rows if r[1] > 3] + [(2, 2, 0.0)], source)  # one row comes too late
    go()
    out = spark.read.parquet(sink)
    stops = {r["run"]: r["epoch"] for r in out.filter("is_stop").collect()}
    assert stops == {r["run"]: r["stop_epoch"] for r in want if r["stop_epoch"] is not None} == {1: 5}
    assert out.filter("run = 1").count() == 5  # nothing after the stop
    assert out.filter("run = 2").agg(F.max("late_rows")).first()[0] == 1
    assert out.filter("run = 2").count() == 7


def test_best_checkpoint_stream_is_replay_safe(spark):
    source, table, checkpoint = (shared_dir(spark, n) for n in ("log", "best", "chk"))
    by = {"val_loss": "min"}
    for part in ([(1, 1, 3.0), (1, 2, 1.0)], [(1, 3, 1.0), (1, 4, math.nan)]):
        _write(spark, part, source)
        q = sr.stream_best_checkpoint(sr.read_stream(spark, source, LOG), ["run"], by, table, checkpoint)
        q.awaitTermination()
    best = sr.read_best(spark, table, ["run"], by).first()
    assert (best["val_loss_epoch"], best["val_loss_best"]) == (2, 1.0)
