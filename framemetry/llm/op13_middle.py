"""Fill-in-middle: a text is cut at two ranks of its units and put together in another order.

A unit is a word with the white space before it, or the white space at the end. The units of a text stand
in an indexable skip list: the lowest lane links every boundary to the next, express lanes link a quarter
of those below them, and every link carries how many units and how many code points it spans. A search
descends from the highest lane, adds up both widths while it stays at or before the wanted rank, and so
reaches a cut and its code point without counting the units between.

Prefix, middle and suffix follow from draws named by (seed, doc_id): nothing depends on the order of rows.
``spm`` puts the suffix first, ``psm`` the prefix; ``plain`` texts stay as they are.

Cases: a null text counts as empty, empty texts are plain, and so are texts that hold one of the three
marks, since these could not be told apart from it. A null id is drawn as an empty one. Repeated rows are
cut alike. Empty tables give an empty result. Other columns pass through; those named like a result are
replaced. Texts are read whole, in pieces of ``PIECE`` code points while their units are measured.

At scale: one pass over the rows, no shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from framemetry.llm.common import set_aside, slices, table
from framemetry.llm.registry import query

SEED = 42
RATE = 50  # of a hundred texts that are cut
SPM = 80  # of a hundred cut texts whose suffix comes first
PRE, SUF, MID = "<P>", "<S>", "<M>"
PIECE = 1 << 20
CHUNK_CHARS = 1 << 24

_HALF = np.uint64(0x9E3779B97F4A7C15)


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit."""
    starts, white_before = [np.zeros(min(len(text), 1), np.int64)], True
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
        white = (codes == 32) | (codes - np.uint32(9) <= 4)
        before = np.concatenate([[white_before], white[:-1]])
        starts.append(np.flatnonzero(white & ~before) + at)
        white_before = bool(white[-1])
    return np.diff(np.concatenate([*starts, [len(text)]])) if text else np.zeros(0, np.int64)


class SkipList:
    """Boundaries of units under express lanes. Link j of a lane leads from its node j to node j + 1; ``down``
    is where node j stands in the lane below."""

    def __init__(self, widths: np.ndarray):
        self.size = len(widths)
        nodes = np.arange(self.size + 1)
        chars = np.concatenate([[0], np.cumsum(widths)])
        # coins by position: a boundary rises one lane more with a chance of a quarter
        coins = (nodes.astype(np.uint64) + np.uint64(1)) * _HALF
        coins ^= coins >> np.uint64(32)
        self.lanes = [(np.diff(nodes), np.diff(chars), nodes)]
        lane = 0
        while len(nodes) > 4:
            rises = (coins >> np.uint64(2 * lane)) & np.uint64(3) == 0
            rises[0] = True  # the head stands in every lane
            down = np.flatnonzero(rises)
            if len(down) == len(nodes) or lane == 30:
                break
            nodes, chars, coins, lane = nodes[down], chars[down], coins[down], lane + 1
            self.lanes.append((np.diff(nodes), np.diff(chars), down))

    def code_point(self, rank: int) -> int:
        """Code points before the boundary of that rank, from 0 to the number of units."""
        units = chars = node = 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            unit_width, char_width, down = self.lanes[lane]
            while node < len(unit_width) and units + unit_width[node] <= rank:
                units += int(unit_width[node])
                chars += int(char_width[node])
                node += 1
            if lane:
                node = int(down[node])
        return chars


def draws(key: int | None, seed: int = SEED) -> list[int]:
    """Four numbers below 2 to the 32."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(text: str, key: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple:
    """(units, form, code points of the prefix, of the middle, output)."""
    units = SkipList(unit_widths(text))
    h1, h2, h3, h4 = draws(key, seed)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PRE, SUF, MID)):
        return units.size, "plain", None, None, text
    low, high = sorted((h1 % (units.size + 1), h2 % (units.size + 1)))
    a, b = units.code_point(low), units.code_point(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return units.size, "spm", a, b - a, f"{SUF}{suffix}{PRE}{prefix}{MID}{middle}"
    return units.size, "psm", a, b - a, f"{PRE}{prefix}{SUF}{suffix}{MID}{middle}"


MADE = (
    T.StructType().add("n_units", "long").add("form", "string").add("prefix_chars", "long")
    .add("middle_chars", "long").add("output", "string")
)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``docs`` with the columns of MADE."""
    plain, names = set_aside(docs, "doc_id", "text", made=tuple(MADE.names))
    id_at, text_at = plain.columns.index("doc_id"), plain.columns.index("text")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            first, size, rows = 0, 0, []
            for i in range(batch.num_rows):
                text = batch.column(text_at)[i].as_py() or ""
                rows.append(cut(text, batch.column(id_at)[i].as_py(), seed, rate, spm))
                size += len(text)
                if size >= CHUNK_CHARS or i + 1 == batch.num_rows:
                    made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                    own = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*own.columns, *made], names=[*batch.schema.names, *MADE.names])
                    first, size, rows = i + 1, 0, []

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, *MADE.fields]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *MADE.names)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output was made of. Its marks occur once each, so they split it."""
    out, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(left: str, right: str | None) -> Column:
        tail = F.split_part(out, F.lit(left), F.lit(2))
        return tail if right is None else F.split_part(tail, F.lit(right), F.lit(1))

    return (
        F.when(form == "psm", F.concat(between(PRE, SUF), between(MID, None), between(SUF, MID)))
        .when(form == "spm", F.concat(between(PRE, MID), between(MID, None), between(SUF, PRE)))
        .otherwise(out)
    )


_SQL_WORD = "[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+"
SQL = f"""WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}') AS w,
         sha256(concat('{SEED}:', doc_id)) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, w, len(w)::BIGINT AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM units),
cuts AS (
  SELECT doc_id, t, w, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{PRE}') OR contains(t, '{SUF}') OR contains(t, '{MID}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(w[1 : a], ''), '') AS p, coalesce(array_to_string(w[a + 1 : b], ''), '') AS m,
         coalesce(array_to_string(w[b + 1 : n], ''), '') AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PRE}' || p || '{SUF}' || s || '{MID}' || m
              ELSE '{SUF}' || s || '{PRE}' || p || '{MID}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM parts"""


@query("op13_middle", SQL)
def op13_middle(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return fill_in_middle(docs).select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored("output", "form").cast("binary"), 256).alias("restored_sha256"),
    )
