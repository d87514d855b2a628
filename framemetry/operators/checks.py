"""Consistency checks. Every check returns violations (check, key, detail); no rows means pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

TABLE_TOLERANCE = 2e-9


def _violation(check: str, key: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), key.alias("key"), detail.alias("detail")]


def _key_text(keys: list[str]) -> Column:
    return F.concat_ws("/", *[F.col(k).cast("string") for k in keys])


def expect_row_count(df: DataFrame, n: int, name: str) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("_n"))
    return counted.filter(F.col("_n") != n).select(
        *_violation("row_count", F.lit(name), F.format_string(f"%d rows, expected {n}", "_n"))
    )


def expect_values(df: DataFrame, column: str, allowed: list[str], name: str) -> DataFrame:
    """Values outside an enumeration, one row per distinct value."""
    bad = df.filter(F.col(column).isNull() | ~F.col(column).isin(allowed)).groupBy(column).count()
    return bad.select(
        *_violation(
            "values",
            F.lit(name),
            F.concat(F.coalesce(F.col(column), F.lit("NULL")), F.lit(" x"), F.col("count")),
        )
    )


def reconcile(
    actual: DataFrame,
    published: DataFrame,
    keys: list[str],
    values: list[str],
    tolerance: float = TABLE_TOLERANCE,
) -> DataFrame:
    """Differences between two tables: keys on one side only, values apart by more than tolerance.

    Output: keys, column, actual, published. Missing on both sides or NaN on both sides agrees.
    """
    a = actual.select(*keys, F.struct(*[F.col(v).cast("double").alias(v) for v in values]).alias("_a"))
    b = published.select(*keys, F.struct(*[F.col(v).cast("double").alias(v) for v in values]).alias("_b"))
    cells = F.array(
        *[
            F.struct(
                F.lit(v).alias("column"),
                F.col(f"_a.{v}").alias("actual"),
                F.col(f"_b.{v}").alias("published"),
            )
            for v in values
        ]
    )
    apart = F.abs(F.col("actual") - F.col("published")) > tolerance
    one_sided = (
        F.col("_only")
        | (F.col("actual").isNull() != F.col("published").isNull())
        | (F.isnan("actual") != F.isnan("published"))
    )
    both_nan = F.isnan("actual") & F.isnan("published")
    return (
        a.join(b, keys, "full_outer")
        .withColumn("_only", F.col("_a").isNull() | F.col("_b").isNull())
        .select(*keys, "_only", F.inline(cells))
        .filter(one_sided | (~both_nan & F.coalesce(apart, F.lit(False))))
        .drop("_only")
    )


def expect_close(
    actual: DataFrame,
    published: DataFrame,
    keys: list[str],
    values: list[str],
    name: str,
    tolerance: float = TABLE_TOLERANCE,
) -> DataFrame:
    return reconcile(actual, published, keys, values, tolerance).select(
        *_violation(
            name,
            F.concat(_key_text(keys), F.lit(":"), F.col("column")),
            F.concat(
                F.lit("actual="),
                F.coalesce(F.col("actual").cast("string"), F.lit("NULL")),
                F.lit(" expected="),
                F.coalesce(F.col("published").cast("string"), F.lit("NULL")),
            ),
        )
    )


def expect_counts_equal(
    actual: DataFrame, published: DataFrame, keys: list[str], counts: list[str], name: str
) -> DataFrame:
    """Integer columns must agree exactly (wins, ties, losses, n)."""
    return expect_close(actual, published, keys, counts, name, tolerance=0.0)


def align_units(first: DataFrame, second: DataFrame, unit: str, position: str | None = None) -> DataFrame:
    """Units that are not in both tables, or not at the same position. No rows means aligned."""
    cols = [unit] + ([position] if position else [])
    place = F.col(position).cast("bigint") if position else F.lit(0).cast("bigint")
    a = first.select(*cols).withColumn("_pa", place).select(unit, "_pa")
    b = second.select(*cols).withColumn("_pb", place).select(unit, "_pb")
    return (
        a.join(b, unit, "full_outer")
        .filter(~F.col("_pa").eqNullSafe(F.col("_pb")))
        .select(
            unit,
            F.when(F.col("_pa").isNull(), F.lit("missing in first"))
            .when(F.col("_pb").isNull(), F.lit("missing in second"))
            .otherwise(F.lit("position differs"))
            .alias("problem"),
        )
    )


def expect_same_order(
    first: DataFrame, second: DataFrame, unit: str, position: str, name: str
) -> DataFrame:
    return align_units(first, second, unit, position).select(
        *_violation(name, F.col(unit).cast("string"), F.col("problem"))
    )


def protocol_guard(df: DataFrame, keys: list[str], protocol: str = "protocol") -> DataFrame:
    """Groups that pool results of more than one protocol; such groups must not be averaged.

    Rows are reduced to distinct (group, protocol) pairs first, by hash and before the shuffle.
    """
    return (
        df.select(*keys, protocol)
        .distinct()
        .groupBy(*keys)
        .agg(F.min(protocol).alias("_lo"), F.max(protocol).alias("_hi"))
        .filter(F.col("_lo") != F.col("_hi"))
        .select(*_violation("protocol", _key_text(keys), F.concat_ws(" + ", "_lo", "_hi")))
    )


def require_one_protocol(df: DataFrame, keys: list[str], protocol: str = "protocol") -> Column:
    """Aggregate expression that fails a group holding two protocols, else names the protocol."""
    return F.when(
        F.min(protocol) == F.max(protocol), F.min(protocol)
    ).otherwise(F.raise_error(F.lit("results of different protocols must not be pooled")).cast("string"))


def run_all_checks(checks: list[DataFrame]) -> DataFrame:
    """All violations in one table (every mismatch, not only the first)."""
    return reduce(DataFrame.unionByName, checks)


# --- driver-side checks on the schema --------------------------------------------------------------


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def pick_column(df: DataFrame, candidates: list[str]) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {candidates} is present")


def assert_nonempty(df: DataFrame, what: str) -> DataFrame:
    """Fail early on an empty input; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"no {what} found")
    return df
