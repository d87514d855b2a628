"""Experiment statistics: intervals, paired effects, exact sign-flip tests, interactions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from framemetry.functions.special import t_critical, t_p_value
from framemetry.operators.prefix import join_same
from framemetry.session import written

SIGN_FLIP_MAX_N = 20


# --- shaping ------------------------------------------------------------------------------------


def outcomes_long(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    """Wide outcome table to (ids..., metric, value).

    A generator instead of ``unpivot``: filters on the ids still reach the scan when the result is
    used twice in one plan, so both uses share one exchange.
    """
    cells = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
            for m in metrics
        ]
    )
    return df.select(*ids, F.inline(cells))


def select_metric(df: DataFrame, ids: list[str], metrics: list[str], wanted: DataFrame) -> DataFrame:
    """Values of the columns that another table names in its ``metric`` column."""
    return outcomes_long(df, ids, metrics).join(wanted.select("metric").distinct(), "metric")


def pair_arms(
    long: DataFrame, unit: list[str], comparisons: list[tuple[str, str, str]], arm: str = "arm"
) -> DataFrame:
    """Deltas ``a - b`` on the same unit and metric, one row per comparison (name, a, b).

    One grouped pass with map-side combine instead of a self-join per comparison. A unit that lacks
    an arm gives no row for that comparison; an arm measured twice on a unit fails.
    """
    arms = sorted({a for _, x, y in comparisons for a in (x, y)})
    keys = [*unit, "metric"]
    wide = long.filter(F.col(arm).isin(arms)).groupBy(*keys).agg(
        *[
            F.when(
                F.count_if(F.col(arm) == name) > 1,
                F.raise_error(F.lit(f"arm {name} measured twice on one unit")).cast("double"),
            )
            .otherwise(F.max(F.when(F.col(arm) == name, F.col("value"))))
            .alias(f"_arm{i}")
            for i, name in enumerate(arms)
        ]
    )
    made = F.array(
        *[
            F.struct(
                F.lit(name).alias("comparison"),
                F.col(f"_arm{arms.index(a)}").alias("a"),
                F.col(f"_arm{arms.index(b)}").alias("b"),
            )
            for name, a, b in comparisons
        ]
    )
    return (
        wide.select(*keys, F.inline(made))
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
        .withColumn("delta", F.col("a") - F.col("b"))
    )


# --- one-sample summaries ------------------------------------------------------------------------


def mean_sd_ci(
    df: DataFrame, keys: list[str], value: str = "value", missing: str = "error"
) -> DataFrame:
    """n, mean, sample SD and the 95 % t interval. A size without an interval (below 2) fails."""
    base = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std_sample"),
    )
    half = t_critical(F.col("n"), missing) * F.col("std_sample") / F.sqrt(F.col("n"))
    return base.withColumn("ci95_low", F.col("mean") - half).withColumn(
        "ci95_high", F.col("mean") + half
    )


def mean_sd_pop(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """n, mean and population SD, the convention of older tables."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std_pop"),
    )


def group_summary(df: DataFrame, arm: str, metrics: list[str]) -> DataFrame:
    """One row per arm: n, then ``<metric>_mean`` and ``<metric>_sd`` for every metric."""
    return df.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            c
            for m in metrics
            for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_sd"))
        ],
    )


# --- paired effects -------------------------------------------------------------------------------


def sign_sums(values: Column) -> Column:
    """All sums of a non-empty array with either sign per element, first sign fixed.

    The other half of the 2^n sums is their mirror image, which the two-sided test does not need.
    Doubling the list per element costs 2^n additions in a fixed order, not n * 2^n.
    """
    return F.aggregate(
        F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))),
        F.array(F.element_at(values, 1)),
        lambda acc, v: F.concat(
            F.transform(acc, lambda s: s + v), F.transform(acc, lambda s: s - v)
        ),
    )


def sign_flip_share(values: Column) -> Column:
    """Two-sided exact p of a sorted array: share of sign vectors with |mean| >= |observed|."""
    n = F.size(values)
    observed = F.abs(F.aggregate(values, F.lit(0.0), lambda a, v: a + v)) / n
    floor = observed - F.greatest(F.lit(1e-15), observed * 1e-12)
    sums = sign_sums(values)
    hits = F.size(F.filter(sums, lambda s: F.abs(s) / n >= floor))
    return F.when(n > 0, hits / F.size(sums))


def _bounded_lists(df: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """Sorted values of each group, never more than ``most`` per group on any task.

    The row-number filter is pushed below the shuffle, so a huge group sends at most ``most``
    rows per input task.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    return (
        df.filter(F.col(value).isNotNull())
        .withColumn("_rank", F.row_number().over(w))
        .filter(F.col("_rank") <= most)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_values"))
    )


@F.pandas_udf(DoubleType())
def _meet_in_the_middle(values: pd.Series) -> pd.Series:
    """The share of ``sign_flip_share`` from the sums of two halves, 2^(n/2) each instead of 2^n."""

    def sums(half: np.ndarray) -> np.ndarray:
        out = np.zeros(1)
        for v in half:
            out = np.concatenate([out + v, out - v])
        return out

    def share(v) -> float | None:
        if v is None or not len(v):
            return None
        v = np.asarray(v, float)
        floor = abs(np.add.accumulate(v)[-1]) / len(v)
        floor = (floor - max(1e-15, floor * 1e-12)) * len(v)
        one, two = sums(v[: len(v) // 2]), np.sort(sums(v[len(v) // 2 :]))
        above = len(two) - np.searchsorted(two, floor - one, "left")
        below = np.searchsorted(two, -floor - one, "right")
        both = (above + below).sum() if floor > 0 else len(one) * len(two)
        return float(both / (len(one) * len(two)))

    return values.map(share)


def exact_share(values: Column, max_n: int) -> Column:
    """Exact p of a sorted array of at most ``max_n`` values; up to 20 it needs no Python."""
    if max_n <= SIGN_FLIP_MAX_N:
        return sign_flip_share(values)
    return _meet_in_the_middle(values)


def sign_flip_p(
    df: DataFrame, keys: list[str], value: str = "delta", max_n: int = SIGN_FLIP_MAX_N, large: str = "error"
) -> DataFrame:
    """Exact sign-flip test per group.

    The test goes through 2^n sign vectors for up to 20 units, and through two halves of 2^(n/2) for a
    larger ``max_n``, of which 40 is practical. Groups above ``max_n`` fail, or give NULL with
    ``large='null'``; no group is ever cut. A NULL key is a key."""
    lists = _bounded_lists(df, keys, value, max_n + 1)
    few = F.when(F.size("_values") <= max_n, F.col("_values"))
    if large == "error":
        few = few.otherwise(
            F.raise_error(F.lit(f"exact sign-flip test needs at most {max_n} units")).cast("array<double>")
        )
    return lists.select(*keys, few.alias("_few")).select(*keys, exact_share(F.col("_few"), max_n).alias("exact_sign_flip_p"))


GRID_DECIMALS = 9
GRID_CELLS = 20_000_000
GRID_MAX_N = 1000
DENSE_CELLS = 64  # an array holds up to so many places for each sum of the values


def grid_share(values: np.ndarray, decimals: int = GRID_DECIMALS, cells: int = GRID_CELLS) -> float | None:
    """Two-sided exact p of values on a grid, by counting how many sign vectors give each sum.

    Values of at most ``decimals`` decimals are whole numbers of a common step. The sums of the first i values
    are few on that grid, however many sign vectors there are, so they are kept as places and shares, value by value. None
    where the values are on no such grid, or reach over more than ``cells`` of its steps.
    """
    if not len(values):
        return None
    steps = np.abs(np.rint(values * 10.0**decimals))
    if not np.isfinite(values).all() or np.abs(values).max() * 10.0**decimals >= 2**53:
        return None
    if (np.abs(steps - np.abs(values) * 10.0**decimals) > 1e-6 * np.maximum(steps, 1)).any():
        return None
    steps = steps.astype(np.int64)
    common = int(np.gcd.reduce(steps))
    if common == 0:
        return 1.0
    steps = np.sort(steps // common)
    observed = abs(int((np.sign(values[np.argsort(np.abs(values), kind="stable")]).astype(np.int64) * steps).sum()))
    if int(steps.sum()) > cells:
        return None
    steps, total = steps[steps > 0].tolist(), int(steps.sum())
    places, share = _dense_sums(steps, total) if total <= DENSE_CELLS << min(len(steps), 20) else _sparse_sums(steps)
    return float(min(1.0, share[np.abs(places) >= observed].sum()))


def _dense_sums(steps: list[int], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and shares of all sums, kept as an array over every place they may reach: a value is added or not."""
    share, reach = np.zeros(total + 1), 0
    share[0] = 1.0
    for step in steps:
        with_it = share[: reach + 1] / 2
        share[: reach + 1] = with_it
        share[step : step + reach + 1] += with_it
        reach += step
    return np.arange(-total, total + 1, 2), share


def _sparse_sums(steps: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The same of values far apart, whose sums are few: only places with a share are kept."""
    places, share = np.zeros(1, np.int64), np.ones(1)
    for step in steps:
        # the two shifted lists are sorted already; equal places are added
        both = np.concatenate([places - step, places + step])
        order = np.argsort(both, kind="stable")
        both, halves = both[order], np.concatenate([share, share])[order] / 2
        first = np.flatnonzero(np.diff(both, prepend=both[0] - 1))
        places, share = both[first], np.add.reduceat(halves, first)
    return places, share


def sign_flip_grid(
    df: DataFrame, keys: list[str], value: str = "delta", decimals: int = GRID_DECIMALS, max_n: int = GRID_MAX_N,
    large: str = "error",
) -> DataFrame:
    """The exact sign-flip test for groups of up to ``max_n`` units, where values are decimals.

    Published tables hold decimals of a few digits, so the sums under all 2^n sign vectors fall on few places of a
    grid; counting them takes n steps over these places instead of 2^n sums. Groups above ``max_n``, of values
    that are on no grid of ``decimals`` digits, or that reach over more than ``GRID_CELLS`` steps fail, or give NULL with ``large='null'``;
    none is cut. NULL values do not count; a NULL key is a key.
    """

    @F.pandas_udf(DoubleType())
    def share(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else grid_share(np.asarray(v, float), decimals))

    lists = _bounded_lists(df, keys, value, max_n + 1)
    few = F.when(F.size("_values") <= max_n, F.col("_values"))
    tested = lists.select(*keys, F.size("_values").alias("_n"), share(few).alias("_p"))
    p = F.col("_p")
    if large == "error":
        problem = F.concat(
            F.lit("no exact sign-flip test: a group of "), F.col("_n").cast("string"),
            F.lit(f" or more units, or values on no grid of {decimals} decimals"),
        )
        p = F.when(p.isNull(), F.raise_error(problem).cast("double")).otherwise(p)
    return tested.select(*keys, p.alias("exact_sign_flip_p"))


def sign_cross(
    df: DataFrame, keys: list[str], value: str = "delta", max_n: int = SIGN_FLIP_MAX_N
) -> DataFrame:
    """Column ``s``: the sum of each group's values under every sign vector, the first sign fixed.
    Groups above ``max_n`` units fail, as 2^(n - 1) rows are too many; none is ever cut."""
    too_many = F.raise_error(F.lit(f"sign vectors need at most {max_n} units")).cast("array<double>")
    few = F.when(F.size("_values") <= max_n, F.col("_values")).otherwise(too_many)
    lists = _bounded_lists(df, keys, value, max_n + 1).select(*keys, few.alias("_few"))
    return lists.select(*keys, F.explode(sign_sums(F.col("_few"))).alias("s"))


def paired_summary(
    pairs: DataFrame, keys: list[str], value: str = "delta", max_n: int = SIGN_FLIP_MAX_N
) -> DataFrame:
    """Everything reported about paired deltas: interval, wins/ties/losses, effect size, exact p.

    Groups above ``max_n`` units have no exact p (NULL) and everything else. The values of a group for
    the test come on their own, at most ``max_n + 1`` a group and input task; a NULL key is a key."""
    d = F.col(value)
    base = pairs.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean_delta"),
        F.stddev_samp(value).alias("sd_delta"),
        F.count_if(d > 0).alias("wins"),
        F.count_if(d == 0).alias("ties"),
        F.count_if(d < 0).alias("losses"),
    )
    half = t_critical(F.col("n"), "null") * F.col("sd_delta") / F.sqrt(F.col("n"))
    return join_same(base, sign_flip_p(pairs, keys, value, max_n, large="null"), keys, "left").select(
        *keys,
        "n",
        "mean_delta",
        "sd_delta",
        (F.col("mean_delta") - half).alias("ci95_low"),
        (F.col("mean_delta") + half).alias("ci95_high"),
        "wins",
        "ties",
        "losses",
        F.try_divide("mean_delta", "sd_delta").alias("cohens_dz"),
        "exact_sign_flip_p",
    )


def scoped(df: DataFrame, group: str, everything: str = "all") -> DataFrame:
    """Each row once under the overall scope and once under its own group, column ``scope``."""
    return df.withColumn("scope", F.explode(F.array(F.lit(everything), F.col(group))))


def scope_rollup(
    pairs: DataFrame, group: str, keys: list[str], value: str = "delta", everything: str = "all"
) -> DataFrame:
    """The paired summary for all units and for each group of units."""
    return paired_summary(scoped(pairs, group, everything), ["scope", *keys], value)


SCOPE_COUNTS = ["n", "wins", "ties", "losses"]


def _list_of_few(df: DataFrame, keys: list[str], value: str, max_n: int) -> DataFrame:
    """(keys, _values): the sorted values of groups of at most ``max_n``; NULL for larger ones."""
    return _bounded_lists(df, keys, value, max_n + 1).select(
        *keys, F.when(F.size("_values") <= max_n, F.col("_values")).alias("_values")
    )


def scopes_rollup(
    pairs: DataFrame, dims: list[str], keys: list[str], sets: list[list[str]] | None = None, value: str = "delta",
    max_n: int = SIGN_FLIP_MAX_N,
) -> DataFrame:
    """The paired summary of every scope: the grouping sets over ``dims``, by default each dimension alone and all
    together.

    Returns the dims (NULL where rolled up), ``scope`` (the names of the dims that the scope is split by, joined
    by commas; empty for everything), ``keys`` and the columns of ``paired_summary``. A NULL in a dim is a value
    like any other; ``scope`` tells it from a dim that is rolled up.

    The input is reduced once, to one row of mergeable moments per combination of dims and keys; grouping sets
    go over these. Moments are about a centre per keys, so that they can be added without cancelling. The values for
    the exact test travel only to scopes small enough to have one.
    """
    sets = [[], *[[d] for d in dims]] if sets is None else sets
    d = F.col(value).cast("double")
    fine = [*dims, *keys]
    cells = pairs.groupBy(*fine).agg(
        F.count(value).alias("n"), F.avg(d).alias("_mean"), (F.var_pop(d) * F.count(value)).alias("_m2"),
        F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"),
    )
    cells = written(cells, "scope-cells")
    centre = cells.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_mean") * F.col("n")), F.sum("n")).alias("_centre"))
    off = F.col("_mean") - F.col("_centre")
    cells = join_same(cells, centre, keys) if keys else cells.withColumn("_centre", centre.scalar())
    cells = cells.select(
        *fine, *SCOPE_COUNTS, "_centre",
        (F.col("n") * off).alias("_s"), (F.col("_m2") + F.col("n") * off * off).alias("_q"),
    )
    wanted = [[*one, *keys] for one in sets]
    merged = cells.groupingSets(wanted, *fine).agg(
        F.grouping_id().alias("_gid"), *[F.sum(c).cast("bigint").alias(c) for c in SCOPE_COUNTS], F.sum("_s").alias("_s"),
        F.sum("_q").alias("_q"), F.max("_centre").alias("_centre"),
    )
    of = {_grouping_id(fine, one): ",".join(d for d in dims if d in one) for one in wanted}
    names = F.create_map(*[F.lit(x) for pair in of.items() for x in pair])
    merged = merged.withColumn("scope", F.element_at(names, F.col("_gid")))
    n = F.col("n")
    spread = F.greatest(F.col("_q") - F.try_divide(F.col("_s") * F.col("_s"), n), F.lit(0.0))
    base = written(
        merged.select(
            "scope", *fine, *SCOPE_COUNTS, (F.col("_centre") + F.try_divide("_s", n)).alias("mean_delta"),
            F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1))).alias("sd_delta"),
        ),
        "scopes",
    )
    small = base.where(n <= max_n).select("scope", *fine)
    lists = _list_of_few(pairs, fine, value, max_n).where(F.col("_values").isNotNull())
    marks = F.array(*[F.struct(F.lit(scope).alias("scope"), *[(F.col(c) if c in one else F.lit(None)).cast(lists.schema[c].dataType).alias(c) for c in dims])
                      for one, scope in ((one, ",".join(d for d in dims if d in one)) for one in wanted)])
    placed = lists.select(*keys, "_values", F.explode(marks).alias("_m")).select(*keys, "_values", "_m.*")
    few = (
        join_same(placed, small, ["scope", *fine]).groupBy("scope", *fine)
        .agg(F.array_sort(F.flatten(F.collect_list("_values"))).alias("_few"))
    )
    tested = few.select("scope", *fine, exact_share(F.col("_few"), max_n).alias("exact_sign_flip_p"))
    half = t_critical(n, "null") * F.col("sd_delta") / F.sqrt(n)
    return join_same(base, tested, ["scope", *fine], "left").select(
        *dims, "scope", *keys, "n", "mean_delta", "sd_delta",
        (F.col("mean_delta") - half).alias("ci95_low"), (F.col("mean_delta") + half).alias("ci95_high"),
        "wins", "ties", "losses", F.try_divide("mean_delta", "sd_delta").alias("cohens_dz"), "exact_sign_flip_p",
    )


def _grouping_id(columns: list[str], kept: list[str]) -> int:
    """What ``grouping_id`` says: a bit per column, the first the highest, 1 where it is rolled up."""
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in kept)


def paired_t_test(pairs: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """Paired t statistic, degrees of freedom, two-sided p and Cohen's d."""
    base = pairs.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean_delta"), F.stddev_samp(value).alias("_sd")
    )
    d = F.try_divide("mean_delta", "_sd")
    return (
        base.withColumn("cohens_d", d)
        .withColumn("t", F.col("cohens_d") * F.sqrt(F.col("n")))
        .withColumn("df", F.col("n") - 1)
        .withColumn("p_two_sided", t_p_value(F.col("t"), F.col("df").cast("double")))
        .drop("_sd")
    )


def effect_union(effects: dict[str, DataFrame]) -> DataFrame:
    """Stack effect tables of one schema under an ``effect`` column."""
    out = None
    for name, df in effects.items():
        part = df.withColumn("effect", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def interaction_deltas(
    first: DataFrame, second: DataFrame, unit: list[str], names: tuple[str, str, str]
) -> DataFrame:
    """(effect, unit..., metric, delta) for both effects and for second minus first on each unit.

    One grouped pass over both: a unit that lacks an effect gives nothing, one that has it twice fails,
    and a NULL unit is a unit.
    """
    keys = [*unit, "metric"]
    sides = [df.select(*keys, F.lit(i).alias("_side"), "delta") for i, df in enumerate((first, second))]

    def of(side: int) -> Column:
        mine = F.col("_side") == side
        twice = F.raise_error(F.lit(f"effect {names[side]} given twice on one unit")).cast("double")
        return F.when(F.count_if(mine) > 1, twice).otherwise(F.max(F.when(mine, F.col("delta"))))

    joined = (
        sides[0].unionByName(sides[1])
        .groupBy(*keys)
        .agg(of(0).alias("_first"), of(1).alias("_second"))
        .filter(F.col("_first").isNotNull() & F.col("_second").isNotNull())
    )
    arms = F.array(
        F.struct(F.lit(names[0]).alias("effect"), F.col("_first").alias("delta")),
        F.struct(F.lit(names[1]).alias("effect"), F.col("_second").alias("delta")),
        F.struct(
            F.lit(names[2]).alias("effect"), (F.col("_second") - F.col("_first")).alias("delta")
        ),
    )
    return joined.select(*keys, F.inline(arms))


def interaction_effect(
    first: DataFrame, second: DataFrame, unit: list[str], names: tuple[str, str, str]
) -> DataFrame:
    """Paired summaries of two effects and of their difference of differences."""
    # written: the summary and its exact test both read them
    deltas = written(interaction_deltas(first, second, unit, names), "effects")
    return paired_summary(deltas, ["effect", "metric"])


# --- relative to a baseline -----------------------------------------------------------------------


def baseline_delta(
    df: DataFrame, arm: str, baseline: str, value: str, keys: list[str] | None = None
) -> DataFrame:
    """Difference in points and overhead in percent against the baseline arm.

    Without ``keys`` the baseline is a single row and enters as a scalar subquery.
    """
    ref = df.filter(F.col(arm) == baseline)
    if keys:
        out = join_same(df, ref.select(*keys, F.col(value).alias("baseline")), keys)
    else:
        out = df.withColumn("baseline", ref.select(F.max(value)).scalar())
    points = F.col(value) - F.col("baseline")
    return out.withColumn("delta", points).withColumn(
        "overhead_pct", F.try_divide(points * 100.0, F.col("baseline"))
    )


def to_percent(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c) * 100.0


def selection_summary(
    log: DataFrame, arm: str, seed: str, epoch: str, criterion: str, metrics: list[str]
) -> DataFrame:
    """Per arm, mean and population SD over seeds of each metric at the epoch best by ``criterion``.

    Ties go to the first epoch.
    """
    best = F.struct(F.col(criterion), -F.col(epoch))
    picked = log.filter(F.col(criterion).isNotNull() & ~F.isnan(criterion)).groupBy(arm, seed).agg(
        *[F.max_by(F.col(m), best).alias(m) for m in metrics]
    )
    return picked.groupBy(arm).agg(
        F.count(F.lit(1)).alias("n_seeds"),
        *[
            c
            for m in metrics
            for c in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))
        ],
    )
