"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framemetry.session import written  # noqa: F401  (for the operators)

# Words are runs of anything but the six ASCII white-space characters; bytes.split() agrees with it.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def row_key(text: str = "text", key: str = "doc_id") -> list[Column]:
    """What names a row when ids may be null or repeat: the id and a hash of the text."""
    return [F.col(key).alias("_id"), F.xxhash64(F.col(text)).alias("_th")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_th"] == b["_th"])


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a number of rows, so that Python objects made of one stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def whole_row(df: DataFrame) -> list[Column]:
    """128 bits that name a row by all of its columns, never null; equal rows share them."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return [F.xxhash64(*cols).alias("_k1"), F.xxhash64(F.lit("second"), *cols).alias("_k2")]


def distinct_rows(df: DataFrame) -> DataFrame:
    """``_k1``, ``_k2`` and the row as ``_row``, one of equal rows; reduced before the shuffle."""
    keyed = df.select(*whole_row(df), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"))
    return keyed.groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"))


def set_aside(df: DataFrame, *used: str, made: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with all columns but the ``used`` ones under names that clash with nothing, and what they are
    called now. Columns that a result ``made`` of the same name replaces are left out."""
    now = {c: c if c in used else f"_aside{i}" for i, c in enumerate(df.columns) if c not in made}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in now.items()]), now
