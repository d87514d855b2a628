"""Unit hashing: of lines and sentences that say the same, the earliest stays.

Units are normalised to their lower-cased letters and digits with single spaces and named by 128 hash bits. Of
units with one name, the one ranked first by (doc_id, offset) stays, and the others go. Their offsets in the
original text, in code points, are retained, with the documents that keep their units. Neighbouring units that
go are one passage.

``WHOLE_LINES`` takes whole lines as units, of any length: every later line goes. ``SENTENCES`` cuts lines
further after their sentence marks, since repeated passages begin and end inside lines too; a short common sentence
is no copied passage, so units below ``LEAST`` words do not count (nor part their neighbours), and passages of at
least ``PASSAGE`` words go. The query takes sentences; the README has the figures of both.

Cases: a null or empty text has no units. Null ids rank last. Rows that repeat an id rank by offset only,
so units at one offset of one id all stay, and rows equal in id and text share their passages. Texts are
read whole, of any length. An empty table gives an empty result. Other columns pass through in
``without_passages``.

At scale: units are made once and written, and one row of 60 bytes per unit is shuffled. First places are a partial aggregate, so a unit in a
third of all documents is one row per map task; the join back is an equi-join whose hot keys adaptive
execution splits. Passages are found within one text's own units.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from framemetry.llm.common import row_key, same_row, set_aside, slices, table, written
from framemetry.llm.registry import query

LEAST = 5
PASSAGE = 25

MARKS = ".!?…。！？"


class Kind(NamedTuple):
    """How texts are cut, and the words that a unit and a passage need."""

    pattern: str
    least: int
    passage: int


WHOLE_LINES = Kind(r"[^\n]+", 1, 1)
SENTENCES = Kind(rf"[^{MARKS}\n]+[{MARKS}]*|[{MARKS}]+", LEAST, PASSAGE)
_TOKENS = re.compile(r"[^\W_]+")
UNIT = "_id bigint, _th bigint, unit int, start bigint, stop bigint, words int, h1 bigint, h2 bigint"


def units(text: str, kind: Kind = SENTENCES) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(number, start, stop, words, digest) of each unit of a text."""
    number = 0
    for m in re.finditer(kind.pattern, text):
        words = _TOKENS.findall(m.group().lower())
        if len(words) >= kind.least:
            yield number, m.start(), m.end(), len(words), xxhash.xxh3_128_digest(" ".join(words).encode())
            number += 1


def unit_rows(docs: DataFrame, kind: Kind = SENTENCES) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            out = []
            for key, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                out.extend((key, th, *u) for u in units(text.as_py() or "", kind))
            cols = list(zip(*out)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
            halves = np.frombuffer(b"".join(cols[6]), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, k) for c, k in zip(cols, kinds)], pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=[c.split()[0] for c in UNIT.split(", ")],
            )

    return docs.select(*row_key(), "text").mapInArrow(run, UNIT)


def repeats(docs: DataFrame, kind: Kind = SENTENCES) -> DataFrame:
    """(_id, _th, start, stop, n_units, n_words, kept_doc_ids): the passages that go."""
    rows = written(unit_rows(docs, kind), "units")
    rank = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), F.col("start").alias("s"))
    first = (
        rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1")
        .select("h1", "h2", "first")
    )
    later = rows.join(first, ["h1", "h2"]).where(rank > F.col("first"))
    # equal rows give equal units: one of each
    own = later.groupBy("_id", "_th", "unit").agg(
        F.first("start").alias("start"), F.first("stop").alias("stop"), F.first("words").alias("words"),
        F.first(F.col("first")["d"]).alias("kept"),
    )
    along = Window.partitionBy("_id", "_th").orderBy("unit")
    apart = F.coalesce((F.col("unit") - F.lag("unit").over(along) != 1).cast("int"), F.lit(1))
    numbered = own.withColumn("_new", apart).withColumn("_passage", F.sum("_new").over(along))
    return (
        numbered.groupBy("_id", "_th", "_passage")
        .agg(
            F.min("start").alias("start"), F.max("stop").alias("stop"), F.count("*").alias("n_units"),
            F.sum("words").alias("n_words"), F.array_sort(F.collect_set("kept")).alias("kept_doc_ids"),
        )
        .where(F.col("n_words") >= kind.passage)
        .drop("_passage")
    )


def without_passages(docs: DataFrame, kind: Kind = SENTENCES) -> DataFrame:
    """``docs`` with the repeated passages gone from ``text``, and ``removed`` (in place of a column of that
    name), their (start, stop) in the original text."""
    plain, names = set_aside(docs, "doc_id", "text", made=("removed",))
    keyed = plain.select("*", *row_key())
    gone = repeats(docs, kind).groupBy("_id", "_th").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("removed"))
    both = keyed.join(gone, same_row(keyed, gone), "left").select(*[keyed[c] for c in names.values()], "removed")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("bigint").alias("at"))
    cut = F.aggregate(
        "removed",
        start,
        lambda s, r: F.struct(
            F.concat(s["kept"], F.substr("text", (s["at"] + 1).cast("int"), (r["start"] - s["at"]).cast("int"))).alias("kept"),
            r["stop"].alias("at"),
        ),
        lambda s: F.concat(s["kept"], F.substr("text", (s["at"] + 1).cast("int"))),
    )
    text = F.when(F.col("removed").isNotNull(), cut).otherwise(F.col("text"))
    return both.select(*[text.alias(c) if c == "text" else F.col(n).alias(c) for c, n in names.items()], "removed")


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS l
  FROM documents),
placed AS (
  SELECT doc_id, l, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o
  FROM lines),
cut AS (
  SELECT doc_id, l, o, unnest(regexp_extract_all(line, '[^{MARKS}]+[{MARKS}]*|[{MARKS}]+')) AS u,
         unnest(range(len(regexp_extract_all(line, '[^{MARKS}]+[{MARKS}]*|[{MARKS}]+')))) AS k FROM placed),
offsets AS (
  SELECT doc_id, l, k, u,
         o + coalesce(sum(length(u)) OVER (PARTITION BY doc_id, l ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM cut),
normal AS (
  SELECT doc_id, l, k, start, start + length(u) AS stop, trim(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM offsets),
sized AS (
  SELECT *, len(string_split(t, ' ')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY l, k) AS unit
  FROM normal WHERE len(string_split(t, ' ')) >= {LEAST}),
ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept, row_number() OVER w AS r
  FROM sized WINDOW w AS (PARTITION BY t ORDER BY doc_id, start)),
later AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM ranked WHERE r > 1)
SELECT doc_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS stop, count(*)::BIGINT AS n_units, sum(words)::BIGINT AS n_words,
       min(kept) AS kept_doc_id, count(DISTINCT kept)::BIGINT AS n_kept_docs
FROM later GROUP BY doc_id, island HAVING sum(words) >= {PASSAGE}"""


@query("op7_units", SQL)
def op7_units(spark, sf):
    return repeats(table(spark, sf, "documents")).select(
        F.col("_id").alias("doc_id"), "start", "stop", "n_units", "n_words",
        F.get("kept_doc_ids", F.lit(0)).alias("kept_doc_id"), F.size("kept_doc_ids").cast("bigint").alias("n_kept_docs"),
    )
