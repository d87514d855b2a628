"""Exact dedup by recipes: texts are cut into content-defined chunks, and ordered lists of chunks are compared.

Texts are equal if they are identical after each run of white space is one space. A normalised text is cut
where a rolling hash of the last 32 bytes has ``BITS`` zeros, but never below ``SMALLEST`` or above
``LARGEST`` bytes, so equal texts give equal chunks. A chunk is named by 128 hash bits. All distinct
(name, bytes) are brought together once: a name that stands for several contents is split by the rank of the
content, which makes names verified identifiers. A text is then its recipe, the list of its chunks'
identifiers (some 16 bytes for a kilobyte of text), and recipes, not texts, are grouped and joined. Lists are
compared whole, never by a hash of them.

Of equal texts the row of the smallest id stays; null ids rank last, then the smallest row hash and, of rows
equal in every column, the first that was read.

Cases: null texts count as empty, and all empty texts are equal; a text of white space is one space. Repeated
rows are equal texts. Empty tables give an empty result. Other columns pass through in ``representatives``.

At scale: every distinct chunk crosses the network once, after copies were put together in the task that read
them; beyond that only recipes move. Groups are partial aggregates; the join back is an equi-join whose hot keys
adaptive execution splits. Very long texts are one row of some thousands of chunks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from framemetry.llm.common import SPACE, distinct_rows, slices, table, whole_row, written
from framemetry.llm.registry import query

BITS = 10  # a cut in some 1024 bytes
SMALLEST, LARGEST = 256, 8192
NAME_BYTES = 16
PIECE = 1 << 20  # bytes whose rolling hashes are made at once
BATCH_BYTES = 1 << 24

_REACH = 32
_GEAR = np.random.default_rng(42).integers(0, 1 << 32, 256, np.uint32)
_WHITE = SPACE.encode()


def normal(text: str | None) -> bytes:
    """UTF-8 of the text with one space for each run of white space."""
    raw = (text or "").encode()
    core = b" ".join(raw.split())
    if not core:
        return b" " if raw else b""
    return b" " * (raw[0] in _WHITE) + core + b" " * (raw[-1] in _WHITE)


def marks(data: bytes) -> Iterator[int]:
    """Ends of the places whose last 32 bytes hash to BITS zeros."""
    for at in range(0, len(data), PIECE):
        lead = min(at, _REACH - 1)
        rolled = _GEAR[np.frombuffer(data, np.uint8, min(PIECE, len(data) - at) + lead, at - lead)]
        for span in (1, 2, 4, 8, 16):  # sums of twice as many bytes
            longer = rolled.copy()
            longer[span:] += rolled[:-span] << np.uint32(span)
            rolled = longer
        yield from (np.flatnonzero(rolled[lead:] >> np.uint32(32 - BITS) == 0) + at + 1).tolist()


def chunks(data: bytes) -> list[bytes]:
    """The text in chunks; a text without bytes has none."""
    cuts, last = [], 0
    for end in (*marks(data), len(data)):
        while end - last > LARGEST:
            cuts.append(data[last : last + LARGEST])
            last += LARGEST
        if end - last >= SMALLEST or (end == len(data) and end > last):
            cuts.append(data[last:end])
            last = end
    return cuts


def _name(chunk: bytes, size: int) -> bytes:
    return xxhash.xxh3_128_digest(chunk)[:size]


def recipes(docs: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """(_row, _k1, _k2, doc_id, recipe, text_sha256): one row per row of ``docs``, written, so that ``_row``
    names it from then on."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists, digests = [], []
            for text in batch.column(4):
                data = normal(text.as_py())
                lists.append(b"".join(_name(c, name_bytes) for c in chunks(data)))
                digests.append(hashlib.sha256(data).hexdigest())
            own = [pa.array(lists, pa.binary()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(4)], *own], names=["_row", "_k1", "_k2", "doc_id", "recipe", "text_sha256"]
            )

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *whole_row(docs), "doc_id", F.col("text").alias("_text"))
    made = rows.mapInArrow(run, "_row bigint, _k1 bigint, _k2 bigint, doc_id bigint, recipe binary, text_sha256 string")
    return written(made, "recipes")


def contents(docs: DataFrame, name_bytes: int = NAME_BYTES, placed: bool = False) -> DataFrame:
    """(name, content) of every chunk of every row; ``placed`` adds (_k1, _k2, place)."""
    names = ["name", "content", "_k1", "_k2", "place"][: 5 if placed else 2]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int32()][: len(names)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, size = [], 0
            for i in range(batch.num_rows):
                keys = [batch.column(k)[i].as_py() for k in (1, 2)] if placed else []
                for place, chunk in enumerate(chunks(normal(batch.column(0)[i].as_py()))):
                    rows.append((_name(chunk, name_bytes), chunk, *keys, place)[: len(names)])
                    size += len(chunk)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    rows = docs.select(F.col("text").alias("_text"), *(whole_row(docs) if placed else []))
    return rows.mapInArrow(run, "name binary, content binary" + ", _k1 bigint, _k2 bigint, place int" * placed)


def verified(listed: DataFrame, docs: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """``listed`` with ``others``: where in a recipe a name stands for another content than its first, and for
    the how manieth. Empty unless two contents share a name."""
    distinct = contents(docs, name_bytes).select("name", "content").distinct()
    shared = written(distinct.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "shared-names")
    if shared.isEmpty():
        return listed.withColumn("others", F.lit(""))
    ranked = distinct.join(shared, "name").withColumn(
        "rank", F.row_number().over(Window.partitionBy("name").orderBy("content")) - 1
    )
    ranked = written(ranked.where("rank > 0"), "ranked-names")
    found = contents(docs, name_bytes, placed=True).join(ranked, ["name", "content"]).select("_k1", "_k2", "place", "rank").distinct()
    others = found.groupBy("_k1", "_k2").agg(F.to_json(F.sort_array(F.collect_list(F.struct("place", "rank")))).alias("others"))
    return written(listed.join(others, ["_k1", "_k2"], "left").fillna("", ["others"]), "verified")


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "_k1", "_k2", "_row")


def groups(docs: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """(_row, _k1, _k2, doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    listed = verified(recipes(docs, name_bytes), docs, name_bytes)
    same = (
        listed.groupBy("recipe", "others").agg(F.count("*").alias("n"), F.min(_rank()).alias("first"))
        .where("n > 1")
    )
    # written, so that both sides of the join are plain exchanges, whose hot keys can be split
    met = listed.join(written(same, "same-recipes"), ["recipe", "others"], "left")
    single = F.col("n").isNull()
    return met.select(
        "_row", "_k1", "_k2", "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("first.d")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("first._row") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their own texts."""
    stay = groups(docs).where("kept").select("_k1", "_k2")
    return distinct_rows(docs).join(stay, ["_k1", "_k2"]).select("_row.*")


SQL = """WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)"""


@query("op12_recipes", SQL)
def op12_recipes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
