"""Frames as rows: pixel view, pairing, cropping, padding, resizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from framemetry.functions import arrays, draws
from framemetry.functions.scalars import base_name, clamp01_pixels, pixels_finite
from framemetry.operators import stacks
from framemetry.operators.prefix import placed


def pixel_view(frames: DataFrame, keep: list[str], **values: str) -> DataFrame:
    """One row per pixel: kept columns, y, x and one column per named array.

    All arrays are unpacked together, so two pictures never need a join on pixels.
    """
    cols = [F.col(c).alias(n) for n, c in values.items()]
    zipped = F.arrays_zip(*cols) if len(cols) > 1 else F.transform(
        cols[0], lambda v: F.struct(v.alias(next(iter(values))))
    )
    names = list(values)
    return frames.select(
        *keep, F.col("w").alias("_w"), F.posexplode(zipped).alias("pos", "_p")
    ).select(
        *keep,
        "pos",
        F.floor(F.col("pos") / F.col("_w")).cast("int").alias("y"),
        (F.col("pos") % F.col("_w")).alias("x"),
        *[F.col(f"_p.{n}").alias(n) for n in names],
    )


def assemble(pixels: DataFrame, keys: list[str], value: str = "v", name: str = "pixels") -> DataFrame:
    """Pixel rows back to one array per frame; a frame is one row, so the group is bounded by it."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("pos"), F.col(value).alias("v"))))
    return pixels.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias(name))


# --- pairing ------------------------------------------------------------------------------------------


def _pair_key(df: DataFrame, on: str) -> DataFrame:
    if on == "rel_path":
        return df.withColumn("_pair", F.col("rel_path"))
    if on == "name":
        return df.withColumn("_pair", base_name("rel_path"))
    raise ValueError(f"pair on 'rel_path' or 'name', not {on!r}")


def pair_frames(noisy: DataFrame, clean: DataFrame, on: str = "rel_path") -> DataFrame:
    """Noisy and clean pictures of the same path below their roots, or of the same file name.

    One shuffle of frames: both sides are grouped by the key together. A key used twice
    on one side would pair every combination and fails instead (``duplicate_keys`` lists such keys). If
    nothing pairs at all the result fails too: two folders without a common name are a mistake. NULL
    paths pair with nothing.
    """
    side = [
        _pair_key(df, on).select("_pair", F.lit(name).alias("_side"), F.struct("rel_path", "h", "w", "pixels").alias("_row"))
        for name, df in (("clean", clean), ("noisy", noisy))
    ]
    both = side[0].unionByName(side[1]).filter(F.col("_pair").isNotNull())

    def one(name: str) -> tuple[Column, Column]:
        mine = F.col("_side") == name
        twice = F.raise_error(F.concat(F.lit(f"{name} key is not unique: "), F.col("_pair"))).cast("boolean")
        return F.when(F.count_if(mine) > 1, twice).otherwise(F.lit(True)), F.max_by("_row", F.when(mine, 1))

    (clean_ok, clean_row), (noisy_ok, noisy_row) = one("clean"), one("noisy")
    pairs = (
        both.groupBy("_pair")
        .agg(clean_row.alias("_clean"), noisy_row.alias("_noisy"), clean_ok.alias("_c"), noisy_ok.alias("_n"))
        .filter(F.col("_c") & F.col("_n") & F.col("_clean").isNotNull() & F.col("_noisy").isNotNull())
        .select(
            F.col("_clean.rel_path").alias("rel_path"), F.col("_clean.h").alias("clean_h"), F.col("_clean.w").alias("clean_w"),
            F.col("_clean.pixels").alias("clean"), F.col("_noisy.rel_path").alias("noisy_path"),
            F.col("_noisy.h").alias("noisy_h"), F.col("_noisy.w").alias("noisy_w"), F.col("_noisy.pixels").alias("noisy"),
        )
    )
    # whether anything pairs is asked of the keys alone: neither pixels nor sizes are read for it
    sides = both.groupBy("_pair").agg(F.countDistinct("_side").alias("_sides"))
    nothing = F.raise_error(F.lit("no two frames pair")).cast("boolean")
    guard = sides.agg(F.count_if(F.col("_sides") == 2).alias("_n")).filter(F.when(F.col("_n") == 0, nothing).otherwise(F.lit(False)))
    return pairs.unionByName(guard.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in pairs.schema.fields]))


def unpaired_frames(noisy: DataFrame, clean: DataFrame, on: str = "rel_path") -> DataFrame:
    """What pairing leaves out, with the side it is on."""
    n = _pair_key(noisy, on).select("_pair", "rel_path")
    c = _pair_key(clean, on).select("_pair", "rel_path")
    left = n.join(c, "_pair", "left_anti").withColumn("side", F.lit("noisy"))
    right = c.join(n, "_pair", "left_anti").withColumn("side", F.lit("clean"))
    return left.unionByName(right).select("side", "rel_path")


def common_names(first: DataFrame, second: DataFrame) -> DataFrame:
    """Base names present on both sides."""
    return first.select(base_name("rel_path").alias("name")).intersect(
        second.select(base_name("rel_path").alias("name"))
    )


def ordered_paths(df: DataFrame, path: str = "rel_path") -> DataFrame:
    """Position of every path in path order (from 1), column ``place``; NULL paths come first.

    Paths are ordered component by component, by ranges of a sample: however names are formed, no
    task sorts more than its range."""
    parts = df.withColumn("_parts", F.split(path, "/"))
    return placed(parts, [], ["_parts"], "place").drop("_parts")


def duplicate_keys(df: DataFrame, on: str = "name") -> DataFrame:
    return (
        _pair_key(df, on)
        .groupBy(F.col("_pair").alias("key"))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )


def label_join(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames with the label of their file name."""
    return frames.withColumn("filename", base_name("rel_path")).join(labels, "filename")


def crop_common(pairs: DataFrame) -> DataFrame:
    """Cut both sides to the smaller height and width; adds h and w."""
    h, w = F.least("noisy_h", "clean_h"), F.least("noisy_w", "clean_w")
    zero = F.lit(0)
    out = pairs.withColumn("h", h).withColumn("w", w)
    for side in ("noisy", "clean"):
        out = out.withColumn(
            side,
            arrays.crop(F.col(side), F.col(f"{side}_w"), zero, zero, F.col("h"), F.col("w")),
        )
    return out.drop("noisy_h", "noisy_w", "clean_h", "clean_w")


# --- row transforms -------------------------------------------------------------------------------------


def drop_nonfinite(frames: DataFrame, columns: list[str]) -> DataFrame:
    """Frames whose arrays are finite throughout; applied before anything is shuffled."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & pixels_finite(c)
    return frames.filter(ok)


def clamp_frames(frames: DataFrame, column: str = "pixels") -> DataFrame:
    return frames.withColumn(column, clamp01_pixels(column))


def reflect_pad(frames: DataFrame, oh: int, ow: int, column: str = "pixels") -> DataFrame:
    """Mirror small frames up to ``oh`` x ``ow``; larger ones keep their size."""
    h, w = F.col("h"), F.col("w")
    return (
        frames.withColumn(column, arrays.reflect_pad(F.col(column), h, w, F.lit(oh), F.lit(ow)))
        .withColumn("h", F.greatest("h", F.lit(oh)))
        .withColumn("w", F.greatest("w", F.lit(ow)))
    )


def random_crop(
    frames: DataFrame, tile: int, seed: int, columns: tuple[str, ...] = ("pixels",)
) -> DataFrame:
    """One ``tile`` x ``tile`` window per frame at a seeded offset, small frames mirrored first.

    Several columns (a pair) share the window. Adds top and left.
    """

    def offset(n: str, lane: int) -> Column:
        u = draws.uniform(seed, F.col("frame_id"), "crop", lane=lane)
        return F.floor(u * (F.greatest(F.col(n), F.lit(tile)) - tile + 1)).cast("int")

    out = frames.withColumn("top", offset("h", 0)).withColumn("left", offset("w", 1))
    small = (F.col("h") < tile) | (F.col("w") < tile)
    side = F.lit(tile)
    for c in columns:
        padded = F.when(
            small, arrays.reflect_pad(F.col(c), F.col("h"), F.col("w"), side, side)
        ).otherwise(F.col(c))
        out = out.withColumn(
            c,
            arrays.crop(
                padded, F.greatest(F.col("w"), side), F.col("top"), F.col("left"), side, side
            ),
        )
    return out.withColumn("h", side).withColumn("w", side)


def resize_frames(frames: DataFrame, oh: int = 256, ow: int = 256, column: str = "pixels") -> DataFrame:
    """Frames of another size resized, when shrinking with a wider filter so that no pixel is skipped; a
    frame of the right size passes unchanged. Results are real numbers, not rounded to 8 bits."""
    return stacks.resize(frames, oh, ow, column)
