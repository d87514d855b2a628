"""Skew and plan shape: one key holds a third of the rows or more, results stay whole, and no plan
pairs everything with everything or sends a large input to one task."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framemetry.operators import frames as fr, plotdata, runs, splits, stats
from framemetry.operators.prefix import exact_index
from framemetry.plans import QUERIES

N = 30000


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows on one key."""
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame(
        {
            "run": np.where(rng.random(N) < 0.66, 0, rng.integers(1, 40, N)),
            "epoch": np.arange(N),
            "loss": np.where(rng.random(N) < 0.02, np.nan, rng.random(N).round(4)),
            "group": rng.choice(["a", "b", "c"], N, p=[0.9, 0.05, 0.05]),
        }
    )
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_running_best(skewed):
    pdf, df = skewed
    got = runs.best_so_far(df, ["run"], "loss", width=512).toPandas().sort_values("epoch")
    low = pdf.groupby("run")["loss"].cummin().groupby(pdf["run"]).ffill()
    assert len(got) == N
    np.testing.assert_array_equal(got["best"].to_numpy(float), low.to_numpy())


def test_budget(skewed):
    pdf, df = skewed
    got = runs.nonfinite_budget(df, ["run"], "epoch", "loss", max_bad=20, width=512).toPandas()
    bad = pdf["loss"].isna()
    before = bad.groupby(pdf["run"]).cumsum() - bad
    assert sorted(got["epoch"]) == pdf["epoch"][before <= 20].tolist()


def test_spans(skewed):
    pdf, df = skewed
    got = runs.group_spans(df, ["epoch"], "group", ["run"]).toPandas()
    for run, part in pdf.groupby("run"):
        g = part["group"].tolist()
        want, start = [], 0
        for i in range(1, len(g) + 1):
            if i == len(g) or g[i] != g[i - 1]:
                want.append((start, i - 1, g[start]))
                start = i
        mine = got[got["run"] == run].sort_values("start")
        assert list(zip(mine["start"], mine["end"], mine["group"])) == want
        assert mine["span"].tolist() == list(range(1, len(want) + 1))


def test_places(skewed):
    pdf, df = skewed
    got = plotdata.place_in_order(df, ["run"], ["epoch"]).toPandas()
    want = pdf.groupby("run").cumcount() + 1
    assert got.sort_values("epoch")["plot_order"].tolist() == want.tolist()


def test_warm_up(skewed):
    pdf, df = skewed
    got = runs.warmup_drop(df, ["run"], ["epoch"], 50)
    want = pdf[pdf.groupby("run").cumcount() >= 50]
    assert sorted(r["epoch"] for r in got.select("epoch").collect()) == want["epoch"].tolist()
    assert plan_of(got).count("WindowGroupLimit") >= 2  # cut before and after the shuffle


def test_stratified_sizes(skewed):
    pdf, df = skewed
    got = splits.split_stratified(df.select("run", "epoch"), "epoch", "run", 0.2, 1).toPandas()
    assert len(got) == N
    sizes = got.assign(v=got["split"] == "val").groupby("run")["v"].agg(["sum", "count"])
    assert (sizes["sum"] == np.floor(sizes["count"] * 0.2 + 0.5)).all()


def test_index_is_a_permutation_of_each_key(skewed):
    _, df = skewed
    got = exact_index(df.select("run", "epoch"), ["run"], "epoch", 5).toPandas()
    for _, part in got.groupby("run"):
        assert sorted(part["idx"]) == list(range(len(part)))


def test_draws_with_many_classes(spark):
    df = spark.range(3000).select("id", (F.col("id") % 1000).alias("label"))
    out = splits.weighted_draws(df, "id", "label", 2)
    assert out.agg(F.sum("draws")).first()[0] == 3000


def test_paths_in_order(spark):
    paths = [f"{g}/{i}" for g in ("x", "y/z", "hot", "hot-1") for i in range(700 if g == "hot" else 40)] + ["r"]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path STRING")
    got = {r["rel_path"]: r["place"] for r in fr.ordered_paths(df).collect()}
    want = sorted(paths, key=lambda p: p.split("/"))
    assert [p for p, _ in sorted(got.items(), key=lambda kv: kv[1])] == want


def test_sign_flip_lists_are_cut_before_the_shuffle(spark):
    df = spark.range(100000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("delta"))
    plan = plan_of(stats.sign_flip_p(df, ["k"]))
    assert plan.count("WindowGroupLimit") >= 2


def test_random_split_does_not_move_the_table(spark):
    """The table is compared with one threshold; only bucket counts and one bucket are exchanged."""
    df = splits.split_random(spark.range(N), "id", 0.1, 3)
    top = plan_of(df).split("Subquery")[0]
    assert "Exchange" not in top and "Join" not in top


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("stream")])
def test_no_plan_pairs_everything(spark, sf, name):
    plan = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_what_they_need(spark, sf):
    plan = plan_of(QUERIES["split_random"](spark, sf))
    assert "text" not in plan.split("ReadSchema: ")[1].split(">")[0]
    plan = plan_of(QUERIES["pair_arms"](spark, sf))
    assert "PushedFilters: [In(event_type" in plan


def test_both_halves_of_a_paired_summary_share_one_scan(spark, sf):
    df = QUERIES["paired_summary"](spark, sf)
    df.collect()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_names_used_twice_are_not_paired_crosswise(spark):
    rows = [("a/1.png", 1, 1, [0.5]), ("b/1.png", 1, 1, [0.5]), ("c/2.png", 1, 1, [0.1])]
    df = spark.createDataFrame(rows, "rel_path STRING, h INT, w INT, pixels ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="not unique"):
        fr.pair_frames(df, df, on="name").collect()
    assert fr.pair_frames(df, df).count() == 3
    assert [r["key"] for r in fr.duplicate_keys(df).collect()] == ["1.png"]


def test_unneeded_columns_are_not_read(spark, sf):
    plan = plan_of(QUERIES["pair_arms"](spark, sf))
    assert "props" not in plan
