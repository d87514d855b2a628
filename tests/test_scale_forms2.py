"""Blocks, checks while writing, held-out folders, criteria of the caller."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framemetry.functions.registry import register_criterion
from framemetry.operators import blocks, checks, classify, observed, quality, splits, stacks
from framemetry.session import shared_dir
from framemetry.sources import images
from framemetry.streaming import runs as sr

# --- blocks ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size,wanted", [(7, 7), (100, 13), (13, 100), (1, 5), (5, 1), (64, 63), (10, 3)])
def test_axis_parts_make_the_whole(size, wanted):
    whole = stacks.resize_weights(size, wanted)
    for step in (1, 3, size):
        out = np.zeros((wanted, size))
        for start in range(0, size, step):
            stop = min(size, start + step)
            low, part = blocks.axis_part(size, wanted, start, stop)
            assert low >= 0 and low + len(part) <= wanted
            out[low : low + len(part), start:stop] = part
        assert np.allclose(out, whole, atol=1e-12)


@pytest.mark.parametrize("oh,ow", [(5, 40), (31, 7), (20, 23)])
def test_resize_of_blocks(spark, oh, ow):
    r = np.random.default_rng(oh)
    rows = [(k, None if k == 2 else "f", h, w, r.random(h * w).tolist()) for k, (h, w) in enumerate([(20, 23), (9, 50), (1, 1)])]
    frames = spark.createDataFrame(rows, "k int, g string, h int, w int, pixels array<double>")
    want = {x["k"]: np.array(x["pixels"]).reshape(oh, ow) for x in stacks.resize(frames, oh, ow).collect()}
    pos = F.posexplode("pixels").alias("pos", "v")
    pixels = frames.select("k", "g", "h", "w", pos).select(
        "k", "g", "h", "w", F.floor(F.col("pos") / F.col("w")).alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v"
    )
    cut = blocks.block_rows(pixels, ["k", "g"], 8)
    assert {(x["bh"], x["bw"], len(x["pixels"])) for x in cut.where("k = 0").collect()} == {(8, 8, 64), (8, 7, 56), (4, 8, 32), (4, 7, 28)}
    got = {k: np.full((oh, ow), np.nan) for k in want}
    for x in blocks.resize_blocks(cut, ["k", "g"], oh, ow).collect():
        got[x["k"]][x["y"], x["x"]] = x["v"]
        assert x["g"] == (None if x["k"] == 2 else "f")
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-12)
    assert blocks.resize_blocks(cut.limit(0), ["k", "g"], oh, ow).count() == 0


# --- checks while writing ---------------------------------------------------------------------------------------


def checked_rows():
    rows = [("a", 1.0, 1.0), ("b", 2.0, 2.5), ("x", float("nan"), 1.0), (None, None, None), ("a", 50.0, 50.0)]
    rules = [
        observed.RowCount("t", 4), observed.one_of("k", ["a", "b"]), observed.not_null("k"), observed.all_finite("v"),
        observed.between("v", 0, 10), observed.close("v", "w", 0.1, "k"), observed.RowCount("right", 5), observed.not_null("w"),
    ]
    want = {
        ("row_count", "t", "5 rows, expected 4"), ("values", "k", "2 rows, such as NULL"), ("not_null", "k", "1 rows, such as NULL"),
        ("finite", "v", "2 rows, such as NULL"), ("between", "v", "3 rows, such as 50.0"), ("close", "v:w", "2 rows, such as b"),
        ("not_null", "w", "1 rows, such as NULL"),
    }
    return rows, rules, want


def test_checks_of_one_job(spark):
    rows, rules, want = checked_rows()
    df = spark.createDataFrame(rows, "k string, v double, w double").repartition(3)
    path = shared_dir(spark, "checked")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("checked", "checked")
    found = observed.checked_write(df, rules, lambda x: x.write.parquet(path))
    jobs = len(tracker.getJobIdsForGroup("checked"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {tuple(r) for r in found.collect()}
    assert got == want and spark.read.parquet(path).count() == 5
    assert jobs <= 2  # the shuffle of the input and the write
    # the rules of several scans agree on what is wrong
    assert checks.expect_row_count(df, 4, "t").first()["detail"] == "5 rows, expected 4"
    assert checks.expect_values(df, "k", ["a", "b"], "k").count() == 2
    clean = observed.checked_write(df.limit(0), rules[1:6], lambda x: x.write.mode("append").parquet(path))
    assert clean.count() == 0 and clean.columns == ["check", "key", "detail"]


def test_checks_of_a_stream(spark):
    rows, rules, want = checked_rows()
    source, sink, checkpoint = (shared_dir(spark, f"watched-{p}") for p in ("in", "out", "check"))
    schema = "k string, v double, w double"
    watch = observed.StreamChecks(spark, rules)
    try:
        for part in (rows[:2], rows[2:]):
            spark.createDataFrame(part, schema).repartition(len(part)).write.mode("append").parquet(source)
        stream = watch.watch(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        q = sr.stream_append_log(stream, sink, checkpoint)
        q.awaitTermination()
        found = watch.violations(q)
    finally:
        watch.stop()
    assert len(watch.batches) >= 3
    got = {tuple(r) for r in found.collect()}
    assert {(c, k) for c, k, _ in got} == {(c, k) for c, k, _ in want} and ("row_count", "t", "5 rows, expected 4") in got


# --- held-out folders --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "frames")
    rows = spark.range(60).selectExpr(
        "id AS frame_id", "concat(id, '.png') AS rel_path", "CASE WHEN id % 6 = 5 THEN NULL ELSE concat('g', id % 6) END AS grp",
        "2 AS h", "2 AS w", "8 AS bit_depth", "array(float(0), float(0), float(0), float(id)) AS pixels",
    )
    images.write_frames(rows, path)
    return images.read_frames(spark, path)


def files_read(df):
    """Partitions that the scans of a finished query have read."""
    df.select("frame_id").write.format("noop").mode("overwrite").save()
    return sorted(r["grp"] or "" for r in df.select("grp").distinct().collect())


def test_each_side_reads_its_folders(spark, stored):
    for held, want in ((None, {"g4"}), (["g0", "g2"], {"g0", "g2"}), (["none"], set())):
        train, val = splits.held_out_frames(stored, held)
        assert {r["grp"] for r in val.select("grp").distinct().collect()} == want
        assert {r["grp"] for r in train.select("grp").distinct().collect()} == {"g0", "g1", "g2", "g3", "g4", None} - want
        assert train.count() + val.count() == 60
    for side in splits.held_out_frames(stored):
        plan = side._jdf.queryExecution().executedPlan().toString()
        scan = next(x for x in plan.split("\n") if "PartitionFilters" in x and "pixels" in x)
        assert "grp" in scan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: []" in scan


def test_a_table_of_folders_prunes_at_run_time(spark, stored):
    chosen = spark.createDataFrame([("g1", 5), ("g3", 1), (None, 9)], "grp string, n int").where("n < 9")
    train, val = splits.held_out_frames(stored, chosen)
    assert {r["grp"] for r in val.collect()} == {"g1", "g3"} and train.count() == 40 and val.count() == 20
    plan = val._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


# --- criteria of the caller ---------------------------------------------------------------------------------------


def some_pairs(spark):
    r = np.random.default_rng(5)
    rows = [(k, h, w, r.random(h * w).tolist(), r.random(h * w).tolist()) for k, (h, w) in enumerate([(4, 5), (4, 5), (7, 3)])]
    rows.append((9, 2, 2, None, [0.0] * 4))
    return rows, spark.createDataFrame(rows, "k int, h int, w int, noisy array<double>, clean array<double>")


def test_criteria(spark):
    rows, pairs = some_pairs(spark)
    out = quality.pair_scores(pairs, ["k"], scores=["mae"], criteria={"worst": lambda x, y: abs(x - y).max((1, 2))})
    got = {r["k"]: r for r in out.collect()}
    for k, h, w, a, b in rows[:3]:
        assert got[k]["worst"] == pytest.approx(max(abs(np.array(a) - b))) and got[k]["mae"] == pytest.approx(np.mean(abs(np.array(a) - b)))
    assert got[9]["worst"] is None
    with pytest.raises(Exception, match="one number per pair"):
        quality.pair_scores(pairs, ["k"], scores=[], criteria={"bad": lambda x, y: x.mean()}).collect()
    with pytest.raises(ValueError, match="form 'arrow'"):
        quality.pair_scores(pairs, ["k"], form="jvm", criteria={"x": lambda x, y: x.mean((1, 2))})


def test_criterion_in_sql(spark):
    register_criterion(spark, "rms_between", lambda a, b: math.sqrt(np.nanmean((a - b) ** 2)))
    register_criterion(spark, "middle", lambda a: float(np.median(a)))
    spark.sql("SELECT id % 3 AS k, double(id) AS a, double(id + id % 3) AS b FROM range(30)").createOrReplaceTempView("measured")
    got = spark.sql("SELECT k, rms_between(a, b) AS r, middle(a) AS m FROM measured GROUP BY k ORDER BY k").collect()
    assert [(x["k"], x["r"], x["m"]) for x in got] == [(0, 0.0, 13.5), (1, 1.0, 14.5), (2, 2.0, 15.5)]


def test_classifier_behind_a_denoiser(spark):
    rows = [(0, 0, 2, 2, [0.1] * 4), (1, 1, 2, 2, [0.9] * 4), (2, 1, 2, 2, [0.4] * 4), (3, 0, 1, 3, [2.0, 0.0, 0.0]), (4, 1, 2, 2, None), (5, 0, 2, 2, [float("nan")] * 4)]
    frames = spark.createDataFrame(rows, "k int, true long, h int, w int, pixels array<double>")

    def bright(x):
        return x.mean((1, 2)) >= 0.5

    plain = {r["k"]: r["pred"] for r in classify.classify_frames(frames, bright).collect()}
    assert plain == {0: 0, 1: 1, 2: 0, 3: 1, 4: None, 5: None}
    lifted = {r["k"]: r["pred"] for r in classify.classify_frames(frames, bright, lambda x: x + 0.2).collect()}
    assert lifted == {0: 0, 1: 1, 2: 1, 3: 0, 4: None, 5: None}  # the frame of 2.0 is clamped after the denoiser
    report = classify.denoised_report(frames, "true", bright, lambda x: x + 0.2).first()
    assert (report["accuracy"], report["macro_f1"], report["n"], report["skipped"]) == (1.0, 1.0, 4, 2)
    by = {r["h"]: r for r in classify.denoised_report(frames, "true", bright, keys=["h"]).collect()}
    assert by[1]["accuracy"] == 0.0 and by[2]["skipped"] == 2 and by[2]["n"] == 3


# --- means whatever the order of rows ---------------------------------------------------------------------------


def test_equal_means_tie_in_any_order(spark, tmp_path):
    """Epochs 22 and 27 of a run have the mean 17.04; six copies added one by one come out apart."""
    from framemetry.plans import QUERIES

    values = {22: [10.28, 23.8], 27: [10.9, 4.45, 25.67, 18.84, 25.34]}
    rows = [(i, d, v) for i in range(6) for d, of in values.items() for v in of]
    best = []
    for n, order in enumerate([rows, rows[::-1], sorted(rows, key=lambda r: r[2])]):
        at = tmp_path / str(n)
        events = spark.createDataFrame(order, "i int, d int, value double").coalesce(1).select(
            F.monotonically_increasing_id().alias("event_id"), F.make_timestamp_ntz(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)).alias("ts"),
            F.lit(1312).cast("bigint").alias("user_id"), F.lit("view").alias("event_type"), "value", F.lit("{}").alias("props"),
        )
        events.write.parquet(f"{at}/events.parquet")
        best += [QUERIES["best_checkpoint"](spark, str(at)).first()["val_loss_epoch"], QUERIES["early_stop"](spark, str(at)).first()["best_epoch"]]
    assert best == [22] * 6


def test_decimal_mean_of_other_values(spark):
    from framemetry.functions.scalars import decimal_mean

    rows = [("nan", float("nan")), ("nan", 1.0), ("thirds", 1 / 3), ("thirds", 1.0), ("large", 1e300), ("large", 1e300), ("null", None), ("some", None), ("some", 0.3)]
    df = spark.createDataFrame(rows, "k string, v double").coalesce(1)
    got = {r["k"]: r["m"] for r in df.groupBy("k").agg(decimal_mean("v").alias("m")).collect()}
    assert math.isnan(got.pop("nan")) and got == {"thirds": (1 / 3 + 1) / 2, "large": 1e300, "null": None, "some": 0.3}


def test_stream_checks_reads_more_files_of_a_larger_table(spark, sf, tmp_path, monkeypatch):
    from framemetry.plans import QUERIES, scale

    spark.read.parquet(f"{sf}/lineitem.parquet").repartition(40).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = {}

    def kept(session, purpose):
        made[purpose] = shared_dir(session, purpose)
        return made[purpose]

    monkeypatch.setattr(scale, "shared_dir", kept)
    found = {tuple(r) for r in QUERIES["stream_checks"](spark, str(tmp_path)).collect()}
    assert found == {tuple(r) for r in QUERIES["run_checks_once"](spark, sf).collect()}
    source = spark.read.parquet(made["stream-checks-in"])
    assert source.select(F.input_file_name()).distinct().count() >= spark.sparkContext.defaultParallelism
    assert source.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


# --- runs that share a call ---------------------------------------------------------------------------------------


class _Map(dict):
    exists, containsKey, getValue, removeKey, updateValue = dict.__len__, dict.__contains__, dict.get, dict.pop, dict.__setitem__


class _Handle:
    def getMapState(self, name, key, value):
        return _Map()


def _budget(rows, max_bad):
    """Rows (run, batch, bad) in order of batch: the running count up to the stop, the first of equal batches."""
    out, seen = [], {}
    for run, batch, bad in sorted(rows, key=lambda x: x[1]):
        last, n, stopped = seen.get(run, (-1, 0, False))
        if not stopped and batch > last:
            n += bad
            seen[run] = batch, n, bool(bad) and n > max_bad
            out.append((run, batch, n, bool(bad), bool(bad) and n > max_bad))
    return sorted(out, key=str)


@pytest.mark.parametrize("held", [3, 50, 10**6])
def test_runs_share_a_call(held):
    """Five hundred runs of a part come back in a few frames, not one each, over two micro-batches."""
    r = np.random.default_rng(held)
    rows = [(None if k == 0 else f"r{k}", b, float(r.random() < 0.3)) for k in range(500) for b in range(6)]
    rows += [(run, 1, 1.0 - bad) for run, b, bad in rows if b == 1 and r.random() < 0.2]  # a batch once more
    steps = sr.NonfiniteBudget("run", None, 4, "batch", 1, True, held)
    steps.init(_Handle())
    got = []
    for piece in ([x for x in rows if x[1] < 3], [x for x in rows if x[1] >= 3]):
        frame = pd.DataFrame(piece, columns=["run", "place", "value"]).assign(missing=False)
        chunks = [frame[i : i + 700] for i in range(0, len(frame), 700)]
        frames = list(steps.handleInputRows((0,), iter(chunks), None))
        assert len(frames) <= 1 + len(frame) // held
        got += [tuple(x) for f in frames for x in f[["run", "batch", "bad_so_far", "is_bad", "is_stop"]].itertuples(index=False)]
    assert sorted(got, key=str) == _budget(rows, 1)
    assert not steps.waiting and len(steps.runs) == 500


def test_budget_of_runs_of_any_type(spark):
    r = random.Random(8)
    names = {"timestamp": [datetime.datetime(2024, 1, k + 1) for k in range(5)], "binary": [bytes([k, 255 - k]) for k in range(5)], "bigint": [2**53 + k for k in range(5)]}
    for kind, runs in names.items():
        rows = [(run, b, r.choice([1.0, 1.0, float("nan")])) for run in [None, *runs] for b in range(40)]
        source, sink, checkpoint = (shared_dir(spark, f"kinds-{p}") for p in ("in", "out", "check"))
        spark.createDataFrame(r.sample(rows, len(rows)), f"run {kind}, batch bigint, loss double").repartition(2).write.parquet(source)
        stream = sr.read_stream(spark.newSession(), source, f"run {kind}, batch bigint, loss double")
        sr.run_to_table(sr.stream_nonfinite_budget(stream, "run", max_bad=5, bucket=8, parts=2, held=16), sink, checkpoint)
        back = spark.read.parquet(sink)
        assert back.schema["run"].dataType.simpleString() == kind
        got = [(bytes(x["run"]) if isinstance(x["run"], bytearray) else x["run"], x["batch"], x["bad_so_far"], x["is_bad"], x["is_stop"]) for x in back.collect()]
        assert sorted(got, key=str) == _budget([(a, b, int(math.isnan(v))) for a, b, v in rows], 5)
