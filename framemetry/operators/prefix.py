"""Running aggregates and ordered selection for keys of any size.

A plain window over a key sorts the whole key in one task. Here the order axis is cut into
buckets: each bucket is reduced on its own (map-side first), the running value *before* each bucket
comes from the small bucket table, and only rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from framemetry.functions import draws
from framemetry.session import written

_COMBINE: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda c: F.last(c, ignorenulls=True),
}

BUCKET = "_bucket"


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of one name in which NULL matches NULL, as it does in groups and windows."""
    other = right.select(
        *[F.col(c).alias(f"_right_{c}") for c in on], *[c for c in right.columns if c not in on]
    )
    same = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_right_{c}"))
        same = one if same is None else same & one
    return left.join(other, same, how).drop(*[f"_right_{c}" for c in on])


def bucket_of(order: Column, width: int) -> Column:
    """Bucket of an integer order column; with unique order values a bucket holds ``width`` rows."""
    return F.floor(order / F.lit(width)).cast("bigint")


def with_carry(
    df: DataFrame,
    keys: list[str],
    bucket: Column,
    parts: dict[str, tuple[Column, str]],
) -> DataFrame:
    """Add the bucket and, per entry of ``parts``, the running value of all earlier buckets.

    ``parts`` maps a column name to (aggregate, how to combine aggregates of earlier buckets). Rows with
    a NULL key are a key of their own; those with a NULL bucket come first.
    """
    rows = df.withColumn(BUCKET, bucket)
    on = [*keys, BUCKET]
    per_bucket = rows.groupBy(*on).agg(*[agg.alias(n) for n, (agg, _) in parts.items()])
    before = (
        Window.partitionBy(*keys)
        .orderBy(BUCKET)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow - 1)
    )
    carry = per_bucket.select(
        *on, *[_COMBINE[how](F.col(n)).over(before).alias(n) for n, (_, how) in parts.items()]
    )
    return join_same(rows, carry, on)


def in_bucket(keys: list[str], order: list[Column | str]):
    """Running window inside one bucket, current row included."""
    return (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


# --- exact selection in hash order ------------------------------------------------------------

HASH = "_hash"
_HASH_BUCKETS_SHIFT = 16  # 2**16 equally filled buckets of the 32-bit hash


def hash_order(df: DataFrame, id_col: str, seed: int, algo: str = "xxhash64") -> DataFrame:
    """Add the shuffle order of a seeded permutation and its coarse bucket.

    ``xxhash64`` is several times faster; ``md5`` gives the same order in any SQL engine.
    """
    h = draws.bits32(seed, F.col(id_col), algo=algo)
    return df.withColumn(HASH, h).withColumn(
        BUCKET, F.shiftright(F.col(HASH), _HASH_BUCKETS_SHIFT)
    )


def smallest_threshold(
    ordered: DataFrame, keys: list[str], id_col: str, take: Callable[[Column], Column]
) -> DataFrame:
    """Per key, the (hash, id) of the last of the first ``take(total)`` rows in hash order.

    Bucket counts find the one bucket that holds the boundary; only that bucket is ranked.
    Keys that take nothing are absent from the result.
    """
    counts = ordered.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    run = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.withColumn("_end", F.sum("_n").over(run))
        .withColumn("_take", take(F.sum("_n").over(whole)))
        .withColumn("_left", F.col("_take") - (F.col("_end") - F.col("_n")))
    )
    edge = ranked.filter((F.col("_left") > 0) & (F.col("_end") >= F.col("_take"))).select(
        *keys, BUCKET, "_left"
    )
    order = Window.partitionBy(*keys, BUCKET).orderBy(HASH, id_col)
    return (
        join_same(ordered.select(*keys, BUCKET, HASH, id_col), edge, [*keys, BUCKET])
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") == F.col("_left"))
        .select(*keys, F.struct(F.col(HASH), F.col(id_col)).alias("_last"))
    )


def exact_index(
    df: DataFrame, keys: list[str], id_col: str, seed: int, algo: str = "xxhash64"
) -> DataFrame:
    """0-based position of every row within its key in hash order, column ``idx``."""
    rows = hash_order(df, id_col, seed, algo)
    carried = with_carry(
        rows, keys, F.col(BUCKET), {"_before": (F.count(F.lit(1)), "sum")}
    )
    pos = F.row_number().over(Window.partitionBy(*keys, BUCKET).orderBy(HASH, id_col))
    return carried.withColumn(
        "idx", (F.coalesce(F.col("_before"), F.lit(0)) + pos - 1).cast("bigint")
    ).drop("_before", BUCKET, HASH)


def smallest_rows(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The rows of the ``n`` smallest values of each key, however large keys are and whatever n is.

    Keys are cut into pieces by a hash of the value. Each piece gives its n smallest (a row-number filter,
    which Spark also applies before the shuffle while n is small), and only those are ranked by key."""
    pieces = F.pmod(F.xxhash64(value), F.lit(64))
    fine = Window.partitionBy(*keys, "_piece").orderBy(value)
    some = df.withColumn("_piece", pieces).withColumn("_rank", F.row_number().over(fine)).filter(F.col("_rank") <= n)
    whole = Window.partitionBy(*keys).orderBy(value)
    return (
        some.withColumn("_rank", F.row_number().over(whole))
        .filter(F.col("_rank") <= n)
        .drop("_piece", "_rank")
    )


# --- order of a whole table ---------------------------------------------------------------------


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows dealt to partitions by ranges of ``order`` and sorted inside each. The ranges come from a
    sample, so what depends on them must be computed once and written, not planned twice."""
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def placed(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Position of each row within its key along ``order``, from 1. NULL keys are a key, NULLs come first.

    One range shuffle whatever the sizes of keys; the row number inside a range is free, and only counts
    per (range, key) are added up across ranges."""
    shift = 33  # monotonically_increasing_id: partition above, row below
    local = written(in_ranges(df, [*keys, *order]).withColumn("_at", F.monotonically_increasing_id()), "placed")
    local = local.withColumn("_range", F.shiftright("_at", shift)).withColumn(
        "_at", F.col("_at").bitwiseAND(F.lit((1 << shift) - 1))
    )
    on = [*keys, "_range"]
    counts = local.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_begin"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(*on, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_begin")).alias("_shift"))
    return join_same(local, carry, on).select(
        *df.columns, (F.col("_at") + F.col("_shift") + 1).cast("bigint").alias(name)
    )
