"""Result tables, manifests and logs as CSV, JSON and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framemetry.functions.scalars import fixed
from framemetry.schemas import EPOCH_LOG, RUN_MANIFEST, RUN_PROVENANCE

CORRUPT = "_malformed"

# Decimals of each written column (fixed values); columns not named are written as they are.
FRAME_METRICS_DECIMALS = {"PSNR": 4, "SSIM": 6, "EdgeF1": 6}
EPOCH_LOG_DECIMALS = {
    "train_loss": 6, "val_loss": 6, "val_psnr": 4, "val_ssim": 6, "val_edgeF1": 6,
    "real_psnr": 4, "real_ssim": 6, "real_edgeF1": 6, "lr": 8, "grad_norm": 6,
}


def read_result_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table with a header. Types come from the schema; a malformed row fails the read,
    whichever columns are used."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)
        .csv(path)
    )


def quarantine_malformed(
    spark: SparkSession, path: str, schema: str, header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines). A row with too many or too few fields, or a value of the wrong
    type, is rejected as the raw line; blank lines are dropped.

    Whether a row is good must not depend on which columns the caller uses later. With fewer
    columns wanted, the reader would neither count fields nor convert the others, so the verdict is
    tied to all of them.
    """
    wanted = spark.createDataFrame([], schema).columns
    raw = (
        spark.read.schema(f"{schema}, {CORRUPT} STRING")
        .option("header", header)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("columnPruning", False)
        .csv(path)
    )
    nothing = F.left(F.hash(*wanted).cast("string"), F.lit(0))
    judged = raw.withColumn("line", F.concat(CORRUPT, nothing))
    good = judged.filter(F.col("line").isNull()).select(*wanted)
    bad = judged.filter(F.col("line").isNotNull() & (F.trim("line") != "")).select("line")
    return good, bad


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return read_result_csv(spark, path, RUN_MANIFEST)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Nested run provenance, one JSON document per file."""
    return spark.read.schema(RUN_PROVENANCE).option("multiLine", True).json(path)


def parse_provenance(df: DataFrame, column: str) -> DataFrame:
    """The same from a text column."""
    return df.withColumn("run", F.from_json(column, RUN_PROVENANCE))


# --- writing ---------------------------------------------------------------------------------------------


def with_fixed_decimals(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    return df.select(
        *[fixed(c, decimals[c]).alias(c) if c in decimals else F.col(c) for c in df.columns]
    )


def frame_metrics_text(scores: DataFrame) -> DataFrame:
    """(rel_path, PSNR, SSIM, EdgeF1) as text with fixed decimals."""
    return with_fixed_decimals(scores, FRAME_METRICS_DECIMALS)


def write_frame_metrics(scores: DataFrame, path: str) -> None:
    frame_metrics_text(scores).write.mode("overwrite").option("header", True).csv(path)


def append_epoch_log(log: DataFrame, path: str) -> None:
    """Add epochs to a log folder; existing files are never rewritten."""
    with_fixed_decimals(log, EPOCH_LOG_DECIMALS).write.mode("append").option("header", True).csv(path)


def read_epoch_log(spark: SparkSession, path: str, schema: str = EPOCH_LOG) -> DataFrame:
    """The log back; ``nan`` is read as not-a-number."""
    return spark.read.schema(schema).option("header", True).option("nanValue", "nan").csv(path)


# --- scanning ----------------------------------------------------------------------------------------------

# A drive letter followed by a backslash marks a path of somebody's own machine (fixed value).
# Names of private folders are for the caller to add; matching is case-sensitive.
LEAK_MARKERS = (":\\",)


def leaks_in(
    df: DataFrame, key: str, text: str, markers: tuple[str, ...] = LEAK_MARKERS
) -> DataFrame:
    """(key, marker) for every marker a text contains, over the whole text."""
    found = F.filter(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(F.col(text), m))
    return df.select(F.col(key).alias("key"), F.explode(found).alias("marker"))


def scan_path_leaks(
    spark: SparkSession, path: str, markers: tuple[str, ...] = LEAK_MARKERS
) -> DataFrame:
    """(file, marker) found in text files. Lines are scanned, so large files are split."""
    lines = spark.read.text(path).select(F.input_file_name().alias("_file"), "value")
    hits = leaks_in(lines, "_file", "value", markers)
    return hits.distinct().select(F.col("key").alias("file"), "marker")


