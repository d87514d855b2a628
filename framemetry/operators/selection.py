"""The exact k-th value of every key by counting, for keys of any size; nothing is sorted.

A key's range is cut into ``CELLS`` equal cells and its rows are counted per cell, map-side first. The cell that
holds the wanted rank is the next range, tightened to the smallest and largest value in it, until few rows
(``FEW``) or one value are left; only those few rows are ranked. Every pass cuts the range by ``CELLS``, and
outliers go with the first, so two or three passes do for all but strange distributions, which only take more of them.
What travels per pass is a row per task, key and cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from framemetry.operators.prefix import join_same
from framemetry.session import written

CELLS = 1024
FEW = 4096

_LARGE = 1.7e308  # stands for infinity while cells are computed


def number(df: DataFrame, column: str) -> Column:
    """An order-keeping number of a column: bigint of whole numbers, dates and times, else double. NULL comes first."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.TimestampType):
        c = F.unix_micros(c)
    elif isinstance(kind, T.TimestampNTZType):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c).cast("bigint")
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        c = c.cast("bigint")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(c.cast("double"), F.lit(float("-inf")))
    else:
        raise ValueError(f"{column} of type {kind.simpleString()} has no number")
    return F.coalesce(c, F.lit(-(2**63)))


def countable(df: DataFrame, columns: list[str]) -> bool:
    """Whether ``number`` can be had of all columns."""
    kinds = (T.IntegralType, T.BooleanType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return all(isinstance(df.schema[c].dataType, kinds) for c in columns)


def _finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d), _LARGE).otherwise(F.greatest(F.least(d, F.lit(_LARGE)), F.lit(-_LARGE)))


def _cell(v: Column, low: Column, high: Column) -> Column:
    """0 for ``low`` up to CELLS - 1 for ``high``; never falls as v grows."""
    at = _finite(v) / 2 - _finite(low) / 2
    width = _finite(high) / 2 - _finite(low) / 2
    return F.coalesce(F.least(F.floor(F.try_divide(at, width) * (CELLS - 1)), F.lit(CELLS - 1)), F.lit(0)).cast("int")


def narrowed(rows: DataFrame, on: list[str], wanted: DataFrame, few: int = FEW) -> DataFrame:
    """``wanted`` (on, rank) with the range that holds the value of that rank, counted from 1: (on, low, high, n, left),
    n rows, of which it is the ``left``-th. Either ``low`` is ``high`` or n is at most ``few``. ``rows`` has (on, _v); ranks beyond
    a key's rows are left out."""
    whole = rows.groupBy(*on).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n"))
    now = join_same(wanted, whole, on).where((F.col("rank") >= 1) & (F.col("rank") <= F.col("n")))
    now = written(now.withColumn("left", F.col("rank").cast("bigint")), "ranges")
    done = None
    while True:
        ready = (F.col("low") == F.col("high")) | (F.col("n") <= few)
        ended = now.where(ready)
        done = ended if done is None else done.unionByName(ended)
        open_ = now.where(~ready)
        if open_.isEmpty():
            return done
        targets = open_.select(*on, "rank", "low", "high", "left")
        met = join_same(rows, targets, on).where((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
        counts = (
            met.withColumn("_cell", _cell(F.col("_v"), F.col("low"), F.col("high")))
            .groupBy(*on, "rank", "_cell")
            .agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
        )
        along = Window.partitionBy(*on, "rank").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("left", F.col("left") - F.coalesce(F.sum("n").over(along), F.lit(0)))
        held = placed.where((F.col("left") >= 1) & (F.col("left") <= F.col("n")))
        now = written(held.select(*on, "rank", "low", "high", "n", "left"), "ranges")


def kth_values(
    df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]], few: int = FEW
) -> DataFrame:
    """Per key, the value of each rank: ``ranks`` maps a column name to the rank (from 1) out of the number of
    values. NULL values do not count; NULL keys are a key. A key without values is absent, a rank beyond a key's values is
    NULL."""
    rows = df.where(F.col(value).isNotNull()).select(*keys, number(df, value).alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    sizes = written(sizes.select(*keys, *[take(F.col("_n")).cast("bigint").alias(n) for n, take in ranks.items()]), "ranks")
    each = sizes.select(*keys, F.explode(F.array_distinct(F.array(*ranks))).alias("rank"))
    found = written(narrowed(rows, keys, each, few), "found")
    one = found.where("low = high").select(*keys, "rank", F.col("low").alias("_value"))
    more = found.where("low <> high")
    order = Window.partitionBy(*keys, "rank").orderBy("_v")
    ranked = (
        join_same(rows, more, keys).where((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
        .withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == F.col("left"))
        .select(*keys, "rank", F.col("_v").alias("_value"))
    )
    by_rank = one.unionByName(ranked).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_value"))).alias("_by"))
    out = join_same(sizes, by_rank, keys, "left")
    return out.select(*keys, *[F.try_element_at("_by", F.col(n)).alias(n) for n in ranks])


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile", few: int = FEW) -> DataFrame:
    """The linearly interpolated quantile of each key, exact however large the key is."""

    def at(n: Column) -> Column:
        return F.lit(float(q)) * (n - 1)

    ends = kth_values(df, keys, value, {"_low": lambda n: F.floor(at(n)) + 1, "_high": lambda n: F.ceil(at(n)) + 1, "_n": lambda n: n}, few)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_count"))
    both = join_same(ends.drop("_n"), counts, keys)
    part = at(F.col("_count")) - F.floor(at(F.col("_count")))
    return both.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * part).alias(name))


def nth_place(df: DataFrame, keys: list[str], order: list[str], n: int, few: int = FEW) -> DataFrame:
    """Per key with at least ``n`` rows, the place (a struct of ``order``) of the n-th row along ``order``, NULLs
    first. Keys may have any number of rows, and n any size."""
    wanted = df.select(*keys).distinct().withColumn("rank", F.lit(n).cast("bigint"))
    return _nth(df.select(*dict.fromkeys([*keys, *order])), keys, order, order, wanted, few)


def _nth(rows: DataFrame, keys: list[str], order: list[str], rest: list[str], wanted: DataFrame, few: int) -> DataFrame:
    numbered = rows.withColumn("_v", number(rows, rest[0]))
    found = written(narrowed(numbered.select(*keys, "_v"), keys, wanted, few), "found")
    inside = join_same(numbered, found.select(*keys, "low", "high", "left", F.col("n").alias("_rows")), keys)
    inside = inside.where((F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high")))
    small = F.col("_rows") <= few if len(rest) > 1 else F.lit(True)
    last = Window.partitionBy(*keys).orderBy(*order)
    ties_only = F.lit(len(rest) == 1) & (F.col("low") == F.col("high"))
    place = F.struct(*order)
    ranked = (
        inside.where(small & ~ties_only).withColumn("_nth", F.row_number().over(last)).where(F.col("_nth") == F.col("left"))
        .select(*keys, place.alias("_last"))
    )
    if len(rest) == 1:  # all that is left is equal in every column of the order
        equal = inside.where(ties_only).groupBy(*keys).agg(F.max(place).alias("_last")).where(F.col("_last").isNotNull())
        return ranked.unionByName(equal)
    further = found.where((F.col("low") == F.col("high")) & (F.col("n") > few))
    if further.isEmpty():
        return ranked
    ties = written(inside.where(~small).select(*rows.columns), "ties")
    return ranked.unionByName(_nth(ties, keys, order, rest[1:], further.select(*keys, F.col("left").alias("rank")), few))
