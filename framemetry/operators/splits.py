"""Splits, folds and sampling. Every choice is a function of (seed, row id): no global sort, no
driver-side list, the same answer for any partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from framemetry.functions import draws
from framemetry.functions.scalars import first_folder
from framemetry.operators.prefix import BUCKET, HASH, exact_index, hash_order, join_same, placed, smallest_threshold
from framemetry.session import written


def _split_column(last: Column) -> Column:
    held_out = F.struct(F.col(HASH), F.col("_id")) <= last
    return F.when(F.coalesce(held_out, F.lit(False)), "val").otherwise("train")


def _split_exact(
    df: DataFrame, id_col: str, seed: int, take: Callable[[Column], Column], keys: list[str],
    algo: str,
) -> DataFrame:
    ordered = hash_order(df.withColumn("_id", F.col(id_col)), "_id", seed, algo)
    slim = ordered.select(*keys, "_id", HASH, BUCKET)
    last = smallest_threshold(slim, keys, "_id", take)
    if keys:
        out = join_same(ordered, last, keys, "left").withColumn("split", _split_column(F.col("_last")))
    else:
        # one row: a scalar subquery, so the big table is neither shuffled nor joined
        out = ordered.withColumn("_last", last.select("_last").scalar()).withColumn(
            "split", _split_column(F.col("_last"))
        )
    return out.drop("_last", "_id", HASH, BUCKET)


def split_random(
    df: DataFrame, id_col: str, ratio: float, seed: int, algo: str = "xxhash64"
) -> DataFrame:
    """Column ``split``: exactly max(1, int(n * ratio)) rows are ``val``.

    Rows that repeat an id are on one side, so with repeated ids there may be more, by the repeats of one id."""

    def take(n: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(n * F.lit(float(ratio)))).cast("bigint")

    return _split_exact(df, id_col, seed, take, [], algo)


def split_fixed_floor(
    df: DataFrame, id_col: str, seed: int, floor: int = 200, ratio: float = 0.1,
    algo: str = "xxhash64",
) -> DataFrame:
    """Exactly max(floor, int(n * ratio)) rows are ``val``; fewer rows than that is an error."""

    def take(n: Column) -> Column:
        k = F.greatest(F.lit(floor), F.floor(n * F.lit(float(ratio)))).cast("bigint")
        return F.when(k <= n, k).otherwise(
            F.raise_error(F.lit(f"a validation set of {floor} needs at least that many rows")).cast(
                "bigint"
            )
        )

    return _split_exact(df, id_col, seed, take, [], algo)


def split_stratified(
    df: DataFrame, id_col: str, label: str, ratio: float, seed: int, algo: str = "xxhash64"
) -> DataFrame:
    """Per label, round(n * ratio) rows are ``val`` (half up; the rounding rule is ours)."""

    def take(n: Column) -> Column:
        return F.floor(n * F.lit(float(ratio)) + 0.5).cast("bigint")

    return _split_exact(df, id_col, seed, take, [label], algo)


def with_folder(df: DataFrame, path: str, group: str = "grp") -> DataFrame:
    return df.withColumn(group, first_folder(path))


def last_group(df: DataFrame, group: str) -> Column:
    """Greatest group key as a scalar subquery: the group held out by default."""
    return df.select(F.max(group)).scalar()


def split_lofo(df: DataFrame, path: str, held_out: str | None = None) -> DataFrame:
    """Leave one folder out: ``val`` is one first-level folder, ``train`` everything else."""
    grouped = with_folder(df, path)
    target = F.lit(held_out) if held_out is not None else last_group(grouped, "grp")
    return grouped.withColumn("split", F.when(F.col("grp") == target, "val").otherwise("train"))


def held_out_frames(stored: DataFrame, held_out: list[str] | DataFrame | None = None, group: str = "grp") -> tuple[DataFrame, DataFrame]:
    """(train, val) of a table stored by ``group``: the groups held out are ``val``, by default the greatest one.

    Groups may be given by name or as a table with a column ``group``. Each side reads the files of its own groups only: names and
    the greatest group become partition filters, a table of groups prunes partitions at run time. A NULL group is
    never held out and trains.
    """
    if isinstance(held_out, DataFrame):
        wanted = held_out.select(F.col(group).alias("_held")).where(F.col("_held").isNotNull()).distinct()
        mine = stored[group] == wanted["_held"]
        return stored.join(wanted, mine, "left_anti"), stored.join(wanted, mine, "left_semi")
    if held_out is None:
        target = last_group(stored, group)
        here, other = F.col(group) == target, F.col(group) != target
    else:
        here, other = F.col(group).isin(held_out), ~F.col(group).isin(held_out)
    return stored.where(F.col(group).isNull() | other), stored.where(here)


def complement_groups(df: DataFrame, group: str, held_out: str) -> DataFrame:
    return df.filter(F.col(group) != held_out)


def board_folds(df: DataFrame, board: str) -> DataFrame:
    """(fold, board, role): each board is the test board once, the next one cyclically is the
    validation board (the rule is ours), the rest train.

    The listing has boards x boards rows by definition; each is made from a board and a place, so no row
    holds all boards. A NULL board is a board.
    """
    places = written(placed(df.select(board).distinct(), [], [board], "_at"), "boards")
    n = places.select(F.count(F.lit(1))).scalar()
    sides = places.select(F.col(board).alias("fold"), F.col("_at").alias("_of"), n.alias("_n"))
    each = sides.select("fold", "_of", "_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_at"))
    role = F.when(F.col("_of") == F.col("_at"), "test").when(F.col("_at") == F.col("_of") % F.col("_n") + 1, "val").otherwise("train")
    return each.join(places, "_at").select("fold", board, role.alias("role"))


def fold_rows(df: DataFrame, board: str, folds: DataFrame, fold) -> DataFrame:
    """Rows of one fold with their role; other folds are not materialised."""
    return join_same(df, folds.filter(F.col("fold").eqNullSafe(F.lit(fold))).drop("fold"), [board])


def weighted_draws(
    df: DataFrame, id_col: str, label: str, seed: int, expand: bool = False,
    algo: str = "xxhash64",
) -> DataFrame:
    """Draw as many rows as there are, with replacement, weight 1 / class size.

    Such weights make classes equally likely, so a draw picks a class and a position inside it.
    Draws are counted per position before the last join: a rare class, whose rows are drawn very
    often, sends one counter per row instead of all its draws. NULL is a class. Output: drawn rows with ``draws``, or
    one row per draw with ``expand``.
    """
    sizes = written(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), "class-sizes")
    classes = exact_index(sizes, [], label, seed, algo).select(
        F.col("idx").alias("_class"), F.col(label), F.col("n")
    )
    how_many = sizes.select(F.count(F.lit(1))).scalar()
    u = draws.uniform(seed, F.col(id_col), "draw", lane=0, algo=algo)
    v = draws.uniform52(seed, F.col(id_col), "place", algo=algo)
    picks = (
        df.select(F.floor(u * how_many).cast("bigint").alias("_class"), v.alias("_v"))
        .join(classes, "_class")
        .select(label, F.floor(F.col("_v") * F.col("n")).cast("bigint").alias("idx"))
        .groupBy(label, "idx")
        .agg(F.count(F.lit(1)).alias("draws"))
    )
    out = join_same(exact_index(df, [label], id_col, seed, algo), picks, [label, "idx"])
    if expand:
        out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("draws").cast("int"))))
        return out.drop("_copy", "idx", "draws")
    return out
