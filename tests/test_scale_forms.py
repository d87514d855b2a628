"""The forms for large inputs against brute force: pictures, selection, scopes, exact tests, runs in chunks."""

from __future__ import annotations

import itertools
import math
import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framemetry.operators import quality, runs, selection, stats
from framemetry.session import shared_dir
from framemetry.sources import images, pictures
from framemetry.streaming import runs as sr
from test_io import _png

# --- pictures ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def album(tmp_path_factory):
    root = tmp_path_factory.mktemp("album")
    r = np.random.default_rng(3)
    want = {}
    for k in range(30):
        depth, colour = ((8, 0), (16, 0), (8, 2))[k % 3]
        n = images.CHANNELS[colour]
        x = r.integers(0, 2**depth, (6 + k % 2, 9, n) if n > 1 else (6 + k % 2, 9))
        name = f"{'abc'[k % 3]}/{k}.png" if k % 5 else f"{k}.png"
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(_png(x, depth, colour, r.integers(0, 5)))
        want[name] = images.decode_png((root / name).read_bytes())
    whole = (root / "a/3.png").read_bytes() if (root / "a/3.png").exists() else next(root.glob("*/*.png")).read_bytes()
    for name, content in {
        "bad/text.png": b"nothing", "bad/empty.png": b"", "bad/short.png": whole[:40], "bad/head.png": whole[:20],
        "bad/filter.png": images.SIGNATURE + whole[8:33] + _chunk(b"IDAT", zlib.compress(bytes([9]) * 10000)),
    }.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(content)
    (root / "note.txt").write_text("no picture")
    return root, want


def _chunk(name, data):
    return len(data).to_bytes(4, "big") + name + data + zlib.crc32(name + data).to_bytes(4, "big")


def test_picture_source(spark, album):
    root, want = album
    rows = {r["rel_path"]: r for r in pictures.read_pictures(spark, str(root)).collect()}
    assert set(rows) == set(want) | {f"bad/{n}.png" for n in ("text", "empty", "short", "head", "filter")}
    for name, r in rows.items():
        if name not in want:
            assert r["reason"] and r["pixels"] is None and r["h"] is None and r["grp"] == "bad"
            continue
        h, w, depth, samples = want[name]
        assert (r["h"], r["w"], r["bit_depth"], r["reason"]) == (h, w, depth, None)
        assert r["grp"] == (name.split("/")[0] if "/" in name else "") and r["bytes"] == (root / name).stat().st_size
        assert np.allclose(r["pixels"], images.unit_pixels(samples, depth))
    frames = pictures.frames_of(pictures.read_pictures(spark, str(root)))
    assert frames.count() == 30 and frames.columns[0] == "frame_id"
    flat = pictures.read_pictures(spark, str(root), ["rel_path"], recursive="false")
    assert sorted(r[0] for r in flat.collect()) == sorted(n for n in want if "/" not in n)


def test_pictures_are_dealt_by_bytes(spark, album):
    root, want = album
    one = pictures.read_pictures(spark, str(root), ["rel_path"])
    many = pictures.read_pictures(spark, str(root), ["rel_path"], partitionBytes=str(2 * pictures.OPEN_BYTES + 4000))
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() >= 15 and many.count() == 35
    sizes = [3, 50, 3, 3, 90, 1]
    parts = pictures.dealt([(str(i), n << 20) for i, n in enumerate(sizes)], 64 << 20)
    assert [[f[0] for f in p.files] for p in parts] == [["0", "1", "2", "3"], ["4"], ["5"]] and pictures.dealt([], 10) == []


def test_pixels_that_are_not_asked_for_are_not_read(spark, tmp_path):
    """Only headers: a picture whose data is broken counts as one, and filters keep files closed."""
    x = np.zeros((4, 5), int)
    for name in ("a/1", "a/2", "b/1"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.png").write_bytes(images.encode_gray_png(x, 8)[:33])
    slim = pictures.read_pictures(spark, str(tmp_path), ["rel_path", "grp", "h", "w", "reason"])
    assert {(r["h"], r["w"], r["reason"]) for r in slim.collect()} == {(4, 5, None)}
    some = slim.where("grp = 'a' AND h = 4")
    assert some.count() == 2 and slim.where("rel_path LIKE 'b/%'").count() == 1 and slim.where("grp IN ('b', 'q')").count() == 1
    whole = pictures.read_pictures(spark, str(tmp_path))
    assert whole.where("reason = 'wrong amount of data'").count() == 3
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("pictures").schema("colour int").load(str(tmp_path)).collect()


def test_filters_decide_which_files_are_opened(tmp_path):
    from pyspark.sql.datasource import EqualTo, In, IsNotNull, StringStartsWith
    from pyspark.sql.types import StructType

    for name in ("a/1", "a/2", "b/1"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.png").write_bytes(b"x")
    schema = StructType().add("rel_path", "string")

    def opened(*filters):
        reader = pictures.PictureReader(pictures.Folder(schema, {"path": str(tmp_path)}))
        left = list(reader.pushFilters(list(filters)))
        return sorted(name for p in reader.partitions() for name, _ in p.files), left

    assert opened(EqualTo(("grp",), "a"))[0] == ["a/1.png", "a/2.png"]
    assert opened(In(("grp",), ("b",)), StringStartsWith(("rel_path",), "b/")) == (["b/1.png"], [])
    keep = IsNotNull(("h",))
    assert opened(keep) == (["a/1.png", "a/2.png", "b/1.png"], [keep])


def test_picture_stream_takes_each_file_once(spark, tmp_path):
    root, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    root.mkdir()
    x = np.arange(20).reshape(4, 5)

    def arrive(names):
        for n in names:
            (root / n).write_bytes(images.encode_gray_png(x, 8) if n != "4.png" else b"broken")
        sr.run_to_table(pictures.stream_pictures(spark, str(root), ["rel_path", "h", "reason"]), sink, checkpoint)
        return sorted((r["rel_path"], r["h"], bool(r["reason"])) for r in spark.read.parquet(sink).collect())

    assert arrive(["1.png", "2.png"]) == [("1.png", 4, False), ("2.png", 4, False)]
    assert arrive([]) == [("1.png", 4, False), ("2.png", 4, False)]
    assert arrive(["0.png", "4.png"]) == [("0.png", 4, False), ("1.png", 4, False), ("2.png", 4, False), ("4.png", None, True)]


def test_code_for_the_drivers_workers_travels_along(tmp_path):
    """The source and the state steps can be read where the package is not installed."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    path = tmp_path / "code"
    path.write_bytes(cloudpickle.dumps((pictures.PictureSource, sr.EarlyStop("run", None, 4, 3, 0), pictures.Pictures([("a", 1)]))))
    code = (
        "import pickle, sys; source, steps, part = pickle.load(open(sys.argv[1], 'rb')); "
        "assert source.name() == 'pictures' and steps.begin()[-1] == 0 and part.files; assert 'framemetry' not in sys.modules"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, env=env, check=True, timeout=60)


def test_fresh_files_settle(tmp_path):
    from pyspark.sql.types import StructType

    (tmp_path / "1.png").write_bytes(b"x")
    schema = StructType().add("rel_path", "string")
    waiting = pictures.PictureStream(pictures.Folder(schema, {"path": str(tmp_path), "settle": "60"}))
    ready = pictures.PictureStream(pictures.Folder(schema, {"path": str(tmp_path)}))
    assert waiting.latestOffset() == waiting.initialOffset() and ready.latestOffset()["path"] == "1.png"
    assert len(ready.partitions(ready.initialOffset(), ready.latestOffset())) == 1
    assert list(ready.partitions(ready.latestOffset(), ready.latestOffset())) == []


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (13, 17)])
def test_row_filters_by_diagonals(shape):
    """Every row with a prediction of its own, in stacks of pictures of one size."""
    r = np.random.default_rng(sum(shape))
    contents, want = [], []
    for _ in range(6):
        x = r.integers(0, 256, (*shape, 3))
        kinds = r.integers(0, 5, shape[0])
        lines, up = b"", np.zeros(shape[1] * 3, int)
        for row, kind in zip(x.reshape(shape[0], -1), kinds):
            left = np.concatenate([np.zeros(3, int), row[:-3]])
            corner = np.concatenate([np.zeros(3, int), up[:-3]])
            p = left + up - corner
            near = [min(((abs(q - v), i, v) for i, v in enumerate((a, b, c))))[2] for q, a, b, c in zip(p, left, up, corner)]
            guess = [0 * row, left, up, (left + up) // 2, np.array(near)][kind]
            lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
            up = row
        head = shape[1].to_bytes(4, "big") + shape[0].to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
        contents.append(images.SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b""))
        px = x.reshape(-1, 3)
        want.append(((px[:, 0] * 19595 + px[:, 1] * 38470 + px[:, 2] * 7471 + 32768) >> 16).tolist())
    assert [found[3].tolist() for found in images.decode_pngs(contents)] == want


# --- selection -------------------------------------------------------------------------------------------------


def numbers(r):
    """Keys of very different values: ties, huge and tiny, negative, NULLs, NULL key."""
    rows = [("ties", float(v)) for v in r.integers(0, 4, 3000)]
    rows += [("wide", float(v)) for v in 10.0 ** r.uniform(-12, 12, 3000) * r.choice([-1, 1], 3000)]
    rows += [("even", float(v)) for v in r.random(5000)]
    rows += [("far", float(v)) for v in np.concatenate([r.random(3000), [1e300, -1e300, float("inf"), float("-inf")]])]
    rows += [("one", 5.0), ("same", 2.5), ("same", 2.5), (None, 1.0), (None, 3.0), ("gaps", None), ("gaps", 4.0), ("none", None)]
    return rows


@pytest.mark.parametrize("few", [60, 4096])
def test_kth_values(spark, few):
    rows = numbers(np.random.default_rng(2))
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    ranks = {"first": lambda n: F.lit(1), "tenth": lambda n: F.lit(10), "middle": lambda n: F.ceil(n / 2), "last": lambda n: n}
    got = {r["k"]: r for r in selection.kth_values(df, ["k"], "v", ranks, few).collect()}
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, values in by.items():
        values.sort()
        r = got[k]
        assert (r["first"], r["last"], r["middle"]) == (values[0], values[-1], values[math.ceil(len(values) / 2) - 1])
        assert r["tenth"] == (values[9] if len(values) > 9 else None)
    assert selection.kth_values(df.limit(0), ["k"], "v", ranks).count() == 0


@pytest.mark.parametrize("few", [1, 100])
def test_exact_quantile(spark, few):
    r = np.random.default_rng(4)
    rows = [(k, float(v)) for k in range(4) for v in r.normal(size=997 + k)]
    df = spark.createDataFrame(rows, "k int, v double")
    for q in (0.0, 0.85, 1.0):
        got = {x["k"]: x["quantile"] for x in selection.exact_quantile(df, ["k"], "v", q, few=few).collect()}
        for k in range(4):
            assert got[k] == pytest.approx(np.quantile([v for i, v in rows if i == k], q), abs=1e-15)


def test_types_of_order(spark):
    df = spark.sql(
        "SELECT id, id % 7 AS i, date_add('2020-01-01', int(id % 50)) AS d, timestamp_micros(id * 1000 % 7777) AS t, "
        "CASE WHEN id % 11 > 0 THEN timestamp_ntz '2020-01-01 00:00:00' END AS z, CAST(id % 13 AS FLOAT) AS f, string(id) AS s FROM range(3000)"
    )
    rows = [tuple(r) for r in df.collect()]
    for order in (["i", "id"], ["d", "t", "id"], ["z", "f", "id"]):
        at = [df.columns.index(c) for c in order]
        ranked = sorted((tuple((r[i] is not None, r[i]) if r[i] is not None else (False, 0) for i in at) for r in rows))
        for n in (1, 1500):
            got = selection.nth_place(df, [], order, n, few=20).first()["_last"]
            assert tuple((v is not None, v) if v is not None else (False, 0) for v in got) == ranked[n - 1]
    assert selection.nth_place(df, [], ["id"], 3001).count() == 0
    assert not selection.countable(df, ["id", "s"])


@pytest.mark.parametrize("n", [0, 5, 1200, 5000])
def test_warmup_of_any_size(spark, n):
    r = random.Random(n)
    rows = [(k, r.randint(0, 20), i) for i in range(3000) for k in ("a", "b", None) if k != "b" or i < 300]
    df = spark.createDataFrame(rows, "k string, t int, id int").repartition(5)
    want = []
    for k in ("a", "b", None):
        want += sorted((x for x in rows if x[0] == k), key=lambda x: x[1:])[n:]
    got = runs.warmup_drop(df, ["k"], ["t", "id"], n).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_edge_f1_of_pixels(spark):
    """Frames of several blocks, one of them flat, against the array form."""
    r = np.random.default_rng(8)
    rows = []
    for k, (h, w) in enumerate([(20, 31), (9, 9), (1, 1), (16, 16)]):
        clean = np.ones(h * w) * 0.5 if k == 3 else r.random(h * w)
        rows.append((k, h, w, np.clip(clean + r.normal(0, 0.1, h * w), 0, 1).tolist(), clean.tolist()))
    pairs = spark.createDataFrame(rows, "k int, h int, w int, noisy array<double>, clean array<double>")
    want = {x["k"]: x["edge_f1"] for x in quality.pair_scores(pairs, ["k"], scores=["edge_f1"]).collect()}
    pos = F.posexplode(F.arrays_zip("noisy", "clean")).alias("pos", "v")
    pixels = pairs.select("k", "h", "w", pos).select(
        "k", "h", "w", F.floor(F.col("pos") / F.col("w")).alias("y"), (F.col("pos") % F.col("w")).alias("x"), "v.noisy", "v.clean"
    )
    got = {x["k"]: x["edge_f1"] for x in quality.edge_f1_pixels(pixels, ["k"], block=8).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


# --- scopes and exact tests --------------------------------------------------------------------------------------


def test_scopes_against_filters(spark):
    """Every scope by hand, NULLs in dims and values, groups with and without an exact test; far from zero."""
    r = random.Random(6)
    rows = [(r.choice("abcd"), r.choice(["x", "y", None]), r.randint(0, 2), r.choice([None, *[1e6 + r.gauss(0, 1)] * 9])) for _ in range(90)]
    df = spark.createDataFrame(rows, "m string, d1 string, d2 int, delta double").repartition(4)
    sets = [[], ["d1"], ["d2"], ["d1", "d2"]]
    out = stats.scopes_rollup(df, ["d1", "d2"], ["m"], sets).collect()
    seen = set()
    for x in out:
        kept = x["scope"].split(",") if x["scope"] else []
        own = [v for m, a, b, v in rows if m == x["m"] and ("d1" not in kept or a == x["d1"]) and ("d2" not in kept or b == x["d2"])]
        own = sorted(v for v in own if v is not None)
        assert ("d1" in kept or x["d1"] is None) and ("d2" in kept or x["d2"] is None)
        assert x["n"] == len(own) and x["wins"] == len(own)
        if own:
            assert x["mean_delta"] == pytest.approx(np.mean(own), rel=1e-12)
        if len(own) > 1:
            assert x["sd_delta"] == pytest.approx(np.std(own, ddof=1), rel=1e-6)
        assert (x["exact_sign_flip_p"] is None) == (not 0 < len(own) <= 20)
        if 0 < len(own) <= 20:
            assert x["exact_sign_flip_p"] == pytest.approx(2 / 2 ** len(own))
        seen.add((x["scope"], x["d1"], x["d2"], x["m"]))
    groups = {(",".join(s), a if "d1" in s else None, b if "d2" in s else None, m) for m, a, b, _ in rows for s in sets}
    assert seen == groups and len(out) == len(groups)
    assert stats.scopes_rollup(df.limit(0), ["d1", "d2"], ["m"]).count() == 0


def test_scopes_do_not_multiply_the_input(spark):
    df = spark.range(10000).selectExpr("id % 3 AS a", "id % 2 AS b", "id % 5 AS c", "double(id) AS delta")
    seen = {}

    def kept(frame, purpose, own=stats.written):
        seen[purpose] = own(frame, purpose)
        return seen[purpose]

    stats.written, before = kept, stats.written
    try:
        out = stats.scopes_rollup(df, ["a", "b", "c"], [])
        assert out.count() == 1 + 3 + 2 + 5
    finally:
        stats.written = before
    assert seen["scope-cells"].count() == 30


def enumerated(values):
    whole = abs(sum(values))
    return np.mean([abs(sum(s * v for s, v in zip(signs, values))) >= whole - 1e-9 for signs in itertools.product((1, -1), repeat=len(values))])


def test_grid_against_enumeration():
    r = random.Random(9)
    for case in range(40):
        digits = case % 4
        values = [round(r.gauss(0.2, 1), digits) * r.choice([1, 1, 0]) for _ in range(r.randint(1, 13))]
        assert stats.grid_share(np.array(values)) == pytest.approx(enumerated(values), abs=1e-12)
    assert stats.grid_share(np.array([1 / 3, 2.0])) is None
    assert stats.grid_share(np.array([])) is None and stats.grid_share(np.zeros(5)) == 1.0
    assert stats.grid_share(np.array([1e-9, 1.0])) is None  # on the grid, but over too many steps


def test_grid_of_small_steps_sorts_nothing(monkeypatch):
    """Whole numbers below 26 fill their grid: an array takes the place of sorted lists, with the same shares."""
    r = np.random.default_rng(3)
    groups = [(r.integers(1, 51, n) - 25.0) for n in (1, 2, 7, 20, 48, 82)] + [np.array([0.0, 5.0, 0.0, -5.0])]
    far = np.array([1e-2, 3e4, 7.0, -2e4])
    listed = [stats.grid_share(g) for g in groups]
    with monkeypatch.context() as m:
        m.setattr(stats, "DENSE_CELLS", -1)
        assert listed == pytest.approx([stats.grid_share(g) for g in groups], abs=1e-15)
    assert stats.grid_share(far) == enumerated(far.tolist())
    monkeypatch.setattr(stats.np, "argsort", None)
    assert [stats._dense_sums([3, 4], 7)[0].tolist(), stats._dense_sums([3, 4], 7)[1].tolist()] == [list(range(-7, 8, 2)), [0.25, 0, 0, 0.25, 0.25, 0, 0, 0.25]]


def test_grid_beyond_enumeration(spark):
    """Forty units agree with two halves; two hundred with the binomial they are."""
    r = random.Random(10)
    rows = [("a", round(r.gauss(0.3, 1), 2)) for _ in range(38)] + [("b", 1.0)] * 120 + [("b", -1.0)] * 80 + [(None, 0.5)] * 3 + [("c", None)]
    df = spark.createDataFrame(rows, "k string, delta double")
    got = {x["k"]: x["exact_sign_flip_p"] for x in stats.sign_flip_grid(df, ["k"]).collect()}
    halves = stats.sign_flip_p(df.where("k = 'a'"), ["k"], max_n=40).first()["exact_sign_flip_p"]
    assert got["a"] == pytest.approx(halves, abs=1e-12) and got[None] == 0.25 and "c" not in got
    assert got["b"] == pytest.approx(2 * sum(math.comb(200, i) for i in range(120, 201)) / 2**200, rel=1e-12)
    with pytest.raises(Exception, match="no exact sign-flip test"):
        stats.sign_flip_grid(df, ["k"], max_n=100).collect()
    none = {x["k"]: x["exact_sign_flip_p"] for x in stats.sign_flip_grid(df, ["k"], max_n=100, large="null").collect()}
    assert none["b"] is None and none["a"] == got["a"]


# --- runs in chunks, closing, upsert ----------------------------------------------------------------------------------


def log_rows(r, run, epochs):
    return [(run, e, r.choice([r.random(), float("nan")]) if e % 4 else r.random()) for e in epochs]


def best_so_far(rows, patience):
    best, at, out = math.inf, 0, []
    for _, e, v in sorted(rows, key=lambda x: x[1]):
        better = math.isfinite(v) and v < best
        if better:
            best, at = v, e
        out.append((e, best, at, better, e - at >= patience))
        if e - at >= patience:
            break
    return out


@pytest.mark.parametrize("bucket", [1, 5, 1024])
def test_run_in_many_chunks(spark, bucket):
    r = random.Random(bucket)
    rows = {run: log_rows(r, run, range(1, 200, 1 + run)) for run in range(3)}
    source, sink, checkpoint = (shared_dir(spark, f"chunks-{p}") for p in ("in", "out", "check"))
    every = [x for v in rows.values() for x in v]
    extra = [(0, None, 1.0), (0, None, 2.0), (1, 3, 9.0), (1, 3, 8.0)]
    shuffled = spark.createDataFrame(r.sample(every, len(every)), "run int, epoch bigint, val_loss double")
    # repeats of an epoch come in a file of their own, after the others in order of their names
    shuffled.repartition(4).write.parquet(source)
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    stream = sr.read_stream(session, source, "run int, epoch bigint, val_loss double")
    out = sr.stream_early_stop(stream, "run", patience=60, bucket=bucket)
    sr.run_to_table(out, sink, checkpoint)
    got = spark.read.parquet(sink).collect()
    for run, own in rows.items():
        mine = sorted((x["epoch"], x["best"], x["best_epoch"], x["is_best"], x["is_stop"]) for x in got if x["run"] == run)
        assert mine == best_so_far(own, 60)
    spark.createDataFrame(extra, "run int, epoch bigint, val_loss double").write.mode("append").parquet(source)
    later = spark.createDataFrame([(0, 500, 0.5), (1, 501, 0.5)], "run int, epoch bigint, val_loss double")
    later.coalesce(1).write.mode("append").parquet(source)
    sr.run_to_table(sr.stream_early_stop(sr.read_stream(session, source, "run int, epoch bigint, val_loss double"), "run", patience=60, bucket=bucket), sink, checkpoint)
    after = {x["run"]: x for x in spark.read.parquet(sink).where("epoch >= 500").collect()}
    stopped = {x["run"] for x in got if x["is_stop"]}
    assert set(after) == {0, 1} - stopped
    if 0 in after:
        assert (after[0]["null_rows"], after[0]["late_rows"]) == (2, 0)
    if 1 in after:
        assert (after[1]["null_rows"], after[1]["late_rows"]) == (0, 2)


def test_budget_in_chunks(spark):
    r = random.Random(3)
    rows = [(run, b, float("nan") if r.random() < 0.05 else 1.0) for run in range(4) for b in range(300)]
    source, sink, checkpoint = (shared_dir(spark, f"budget-{p}") for p in ("in", "out", "check"))
    spark.createDataFrame(r.sample(rows, len(rows)), "run int, batch bigint, loss double").repartition(3).write.parquet(source)
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    stream = sr.read_stream(session, source, "run int, batch bigint, loss double")
    sr.run_to_table(sr.stream_nonfinite_budget(stream, "run", max_bad=5, bucket=32), sink, checkpoint)
    got = spark.read.parquet(sink).collect()
    for run in range(4):
        want, bad = [], 0
        for _, b, v in (x for x in rows if x[0] == run):
            bad += math.isnan(v)
            want.append((b, bad, math.isnan(v), math.isnan(v) and bad > 5))
            if want[-1][3]:
                break
        assert sorted((x["batch"], x["bad_so_far"], x["is_bad"], x["is_stop"]) for x in got if x["run"] == run) == want


def test_silent_runs_are_closed(spark):
    source, sink, checkpoint = (shared_dir(spark, f"idle-{p}") for p in ("in", "out", "check"))
    spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.4), (2, 1, 0.9)], "run int, epoch bigint, val_loss double").write.parquet(source)
    stream = sr.read_stream(spark.newSession(), source, "run int, epoch bigint, val_loss double")
    q = sr.stream_append_log(sr.stream_early_stop(stream, "run", idle=2), sink, checkpoint, processingTime="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            done = spark.read.schema("run int, epoch bigint, best double, is_closed boolean").parquet(sink) if q.lastProgress else None
            if done is not None and done.where("is_closed").count() == 2:
                break
    finally:
        q.stop()
    closed = spark.read.parquet(sink).where("is_closed").collect()
    assert sorted((x["run"], x["epoch"], x["best"], x["is_stop"]) for x in closed) == [(1, 2, 0.4, False), (2, 1, 0.9, False)]
    assert spark.read.parquet(sink).where("NOT is_closed").count() == 3


def files_of(spark, path):
    return len(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path").collect())


def test_upsert_keeps_few_files(spark):
    """Twenty micro-batches with a restart and a replay: the best of all rows, in at most two files a part."""
    r = random.Random(12)
    source, table, checkpoint = (shared_dir(spark, f"upsert-{p}") for p in ("in", "table", "check"))
    by, schema = {"loss": "min", "ssim": "max"}, "run int, epoch bigint, loss double, ssim double"
    every = []
    for k in range(20):
        rows = [(r.choice([1, 2, 3, 4, 5, None]), 10 * k + i, r.choice([r.randint(0, 30) / 10, float("nan")]), r.randint(0, 9) / 3) for i in range(6)]
        every += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if k in (9, 19):
            stream = sr.read_stream(spark, source, schema, max_files=1)
            sr.stream_best_checkpoint(stream, ["run"], by, table, checkpoint, parts=3).awaitTermination()
            assert files_of(spark, table) <= 6

    def check():
        got = {x["run"]: x for x in sr.read_best(spark, table, ["run"], by).collect()}
        assert set(got) == {x[0] for x in every}
        for run, x in got.items():
            own = [y for y in every if y[0] == run]
            loss = min(((y[2], y[1]) for y in own if not math.isnan(y[2])), default=(None, None))
            ssim = max((y[3], -y[1]) for y in own)
            assert (x["loss_best"], x["loss_epoch"]) == loss and (x["ssim_best"], x["ssim_epoch"]) == (ssim[0], -ssim[1])

    check()
    last = spark.read.parquet(table).agg(F.max("version")).first()[0]
    again = spark.createDataFrame(every[-6:], schema)
    for _ in range(2):  # the last batch once more, as after a failure between the table and the checkpoint
        sr.upsert_best(again, last, ["run"], by, table, "epoch", 3)
        check()
    assert files_of(spark, table) <= 6
