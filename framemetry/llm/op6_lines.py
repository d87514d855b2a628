"""Line dedup by overlapping three-line windows, in DataFrame functions only.

Lines are what ``\\n`` splits; blank lines stand in no window and always stay. Every three consecutive
lines that are not blank form a window, named by 128 hash bits. The first occurrence of a window, by
(doc_id, line number), stays; every later one covers its three lines, and covered lines go. Occurrences
in the same document count too.

Cases: a null or empty text, and one of fewer than three such lines, is returned as it is. Null ids rank
last. Rows that repeat an id share its rank, so none of them is later than another at the same line.
Other columns pass through unchanged. An empty table gives an empty result.

At scale: windows are exploded to 40-byte rows, first occurrences come from a partial aggregate, so a
window in a third of all documents is one row per map task; the join back is an ordinary equi-join
whose hot keys adaptive execution splits. Texts are shuffled once, beside their covered lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from framemetry.llm.common import WORD, row_key, same_row, set_aside, table
from framemetry.llm.registry import query


def _rank(at: Column) -> Column:
    return F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("d"), at.alias("p"))


def windows(docs: DataFrame) -> DataFrame:
    """(_id, _th, h1, h2, a, b, c): one row per three-line window, with its line numbers."""

    def line(text: Column, at: Column) -> Column:
        return F.when(
            text.rlike(WORD),
            F.struct(at.alias("i"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("g")),
        )

    lines = docs.select(
        *row_key(), F.filter(F.transform(F.split("text", "\n"), line), lambda x: x.isNotNull()).alias("_l")
    ).where(F.size("_l") > 2)

    def window(k: Column) -> Column:
        x, y, z = (F.get(F.col("_l"), k + d) for d in range(3))
        return F.struct(
            F.xxhash64(x["h"], y["h"], z["h"]).alias("h1"),
            F.xxhash64(x["g"], y["g"], z["g"]).alias("h2"),
            x["i"].alias("a"), y["i"].alias("b"), z["i"].alias("c"),
        )

    every = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_l") - 3, F.lit(0))), window)
    return lines.select("_id", "_th", F.inline(every))


def covered(docs: DataFrame) -> DataFrame:
    """(_id, _th, _cut): the numbers of the lines that go, for rows that lose any."""
    w = windows(docs)
    first = (
        w.groupBy("h1", "h2")
        .agg(F.count("*").alias("n"), F.min(_rank(F.col("a"))).alias("first"))
        .where("n > 1")
        .select("h1", "h2", "first")
    )
    later = w.join(first, ["h1", "h2"]).where(_rank(F.col("a")) > F.col("first"))
    return later.groupBy("_id", "_th").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array("a", "b", "c"))))).alias("_cut")
    )


def dedup_lines(docs: DataFrame, cut: str | None = None) -> DataFrame:
    """``docs`` with the later occurrences gone from ``text``; ``cut`` names a column for their numbers."""
    plain, names = set_aside(docs, "doc_id", "text")
    keyed = plain.select("*", *row_key())
    gone = covered(docs)
    both = keyed.join(gone, same_row(keyed, gone), "left").select(
        *[keyed[c] for c in names.values()],
        gone["_cut"],
        F.when(gone["_cut"].isNotNull(), F.split(keyed["text"], "\n")).alias("_l"),
    )
    rest = F.array_except(F.sequence(F.lit(0), F.size("_l") - 1), "_cut")
    text = F.when(
        F.col("_cut").isNotNull(), F.array_join(F.transform(rest, lambda i: F.get(F.col("_l"), i)), "\n")
    ).otherwise(F.col("text"))
    extra = [F.coalesce("_cut", F.array().cast("array<int>")).alias(cut)] if cut else []
    return both.select(*[text.alias(c) if c == "text" else F.col(n).alias(c) for c, n in names.items()], *extra)


SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents),
seq AS (
  SELECT doc_id, i AS a, lead(i, 1) OVER w AS b, lead(i, 2) OVER w AS c,
         line AS x, lead(line, 1) OVER w AS y, lead(line, 2) OVER w AS z
  FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, a) AS r FROM seq WHERE c IS NOT NULL),
cut AS (
  SELECT DISTINCT doc_id, unnest([a, b, c]) AS i FROM ranked WHERE r > 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(removed, '') AS removed, md5(CASE WHEN coalesce(n_removed, 0) = 0 THEN text ELSE coalesce(kept, '') END) AS kept_md5
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(cut.i) AS n_removed,
         string_agg(l.i::VARCHAR, ',' ORDER BY l.i) FILTER (cut.i IS NOT NULL) AS removed,
         string_agg(line, chr(10) ORDER BY l.i) FILTER (cut.i IS NULL) AS kept
  FROM lines l LEFT JOIN cut ON l.doc_id = cut.doc_id AND l.i = cut.i GROUP BY l.doc_id) USING (doc_id)"""


@query("op6_lines", SQL)
def op6_lines(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("lines"))
    return dedup_lines(docs, "cut").select(
        "doc_id",
        F.greatest(F.coalesce("lines", F.lit(0)), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size("cut").cast("bigint").alias("n_removed"),
        F.array_join(F.col("cut").cast("array<string>"), ",").alias("removed"),
        F.md5("text").alias("kept_md5"),
    )
