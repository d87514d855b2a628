"""The corpus pipeline: language, lines, near copies, benchmark items, and a mix of the sources.

Every stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of
``documents``. Null and repeated rows, empty texts and empty tables are handled as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from framemetry.llm import near_copies as copies, op5_language, op6_lines, op8_benchmark, op9_mixing
from framemetry.llm.common import table, written
from framemetry.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, or several, whatever their shares; those without a letter go."""
    ship(spark)
    found = op5_language.identify(docs, docs.where(~op5_language.held_out()))
    return found.where(F.col("lang_pred") != op5_language.UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of windows that an earlier place has."""
    out = op6_lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 0.8 or more of their five-word shingles are the same."""
    ship(spark)
    return copies.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    ship(spark)
    return op8_benchmark.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often."""
    return op9_mixing.mixed_rows(docs, op9_mixing.quality_weights(table(spark, sf_dir, "labels")))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("mixing", mixing),
]

# No SQL: the first stage is a trained model. tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
