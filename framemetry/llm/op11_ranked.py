"""Ranked lexical search by NRA: sorted lists are read in sequence, and scores are kept as intervals.

The score of a document for an item is the sum of whole-number impacts, one for each term of the item. Documents
are dealt into shards of ``SHARD_POSTINGS`` postings. In a shard every term has a list of (document, impact), largest
impact first. The lists of an item are read from the top, twice as deep in every round. What has been read of a document is its
lower bound; with the next impact of every list in which it was not met yet, its upper bound. There is no random
access. Reading ends when no document outside the result can still reach its last place, a document never met
included, and when every document that can has both bounds equal: membership, ties and final scores are then
certain. The last place so far of the same task's earlier shards is where the next shard begins, and each task
hands on its ``TOP`` documents of each item; the best of those are the result.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A to Z are lower-cased. Counts
of documents and terms are those of the whole table.

Cases: null texts have no terms; documents and items without terms meet nothing, and nor do documents whose score is 0.
Repeated rows count as documents of their own; repeated items each get the full result, as do null item ids. Null document ids rank after all
others of their score. Empty tables give an empty result. Columns besides the id and the text are not read. Very long
texts are cut into pieces of ``PIECE`` bytes while their terms are counted.

At scale: documents are read once per block of items; a block is broadcast and holds some ``BLOCK_WORDS`` words of
distinct items. What is written is a slim table of term numbers and counts. Postings are never shuffled: only
counts per term and the best documents of tasks are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from framemetry.llm.common import slices, table, written
from framemetry.llm.registry import query

TOP = 20
BLOCK_WORDS = 100_000
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 16
FIRST_READ = 32  # postings of a list in the first round
PIECE = 1 << 20
BATCH_WORDS = 1 << 20
SALTS = 64

# ASCII that is no letter or digit parts terms; capitals become small letters
_FOLD = bytes(ord(chr(c).lower()) if c > 127 or chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))

FORWARD = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
FOUND = "query bigint, doc_id bigint, score bigint"


def term_pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, in pieces."""
    data = (text or "").encode().translate(_FOLD)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def terms(text: str | None) -> list[bytes]:
    return [t for piece in term_pieces(text) for t in piece]


def _lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32()))


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The documents with a term: how many they have, and the numbers and counts of those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def flush(ids: list, sizes: list, held: list[np.ndarray], size: int) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
        every = np.concatenate(held)
        pairs, counts = np.unique((owner * size + every)[every >= 0], return_counts=True)
        ends = np.searchsorted(pairs, np.arange(1, len(held) + 1) * size)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(pairs % size, ends), _lists(counts, ends)],
            names=["doc_id", "n", "terms", "counts"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, size = shared.value.get, max(1, len(shared.value))
        for batch in slices(batches):
            ids, sizes, held, words = [], [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, own = 0, []
                for piece in term_pieces(text.as_py()):
                    n += len(piece)
                    own.append(np.fromiter(map(get, piece, repeat(-1)), np.int64, len(piece)))
                if n:
                    ids.append(key)
                    sizes.append(n)
                    held.append(np.concatenate(own))
                    words += n
                if words >= BATCH_WORDS:
                    yield flush(ids, sizes, held, size)
                    ids, sizes, held, words = [], [], [], 0
            if ids:
                yield flush(ids, sizes, held, size)

    return docs.select("doc_id", "text").mapInArrow(run, FORWARD)


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], docs: int, top: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of all that score at least the ``top``-th best score and ``least``, both exact.

    ``lists`` has documents and impacts, largest first. No document twice in a list; impacts are positive.
    """
    lower, met = np.zeros(docs, np.int64), np.zeros((len(lists), docs), bool)
    high = np.array([impacts[0] for _, impacts in lists], np.int64)
    at, depth, least = 0, FIRST_READ, max(least, 1)
    while True:
        for t, (ids, impacts) in enumerate(lists):
            if at < len(ids):
                read = ids[at : at + depth]
                lower[read] += impacts[at : at + depth]
                met[t, read] = True
                high[t] = impacts[at + depth] if at + depth < len(ids) else 0
        at, depth = at + depth, 2 * depth
        some = lower[lower >= least]
        if len(some) >= top:
            least = max(least, int(np.partition(some, len(some) - top)[len(some) - top]))
        unmet = int(high.sum())
        near = np.flatnonzero(lower >= max(1, least - unmet))
        slack = high @ ~met[:, near]
        able = lower[near] + slack >= least
        if unmet < least and not slack[able].any():
            return near[able], lower[near[able]]


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, rows: list[pa.RecordBatch], weight: np.ndarray, count: int, total: int):
        columns = pa.Table.from_batches(rows)
        self.ids = columns["doc_id"].combine_chunks()
        n = columns["n"].to_numpy()
        sizes = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in rows])
        term = np.concatenate([b.column(2).flatten().to_numpy() for b in rows])
        tf = np.concatenate([b.column(3).flatten().to_numpy() for b in rows]).astype(np.int64)
        doc = np.repeat(np.arange(len(n), dtype=np.int32), sizes)
        m = 75 + (25 * n * count) // total
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((-impact, term))
        order = order[impact[order] > 0]
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        self.at = dict(zip(term[starts].tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(term)])))

    def best(self, wanted: list[tuple[int, int]], top: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        lists = []
        for t, times in wanted:
            if t in self.at:
                a, z = self.at[t]
                lists.append((self.doc[a:z], self.impact[a:z] * times))
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return resolve(lists, len(self.ids), top, least)


class Best:
    """The best documents of each query in one task."""

    def __init__(self, top: int):
        self.top, self.rows = top, {}

    def least(self, name: int) -> int:
        rows = self.rows.get(name, ())
        return -rows[-1][0] if len(rows) == self.top else 1

    def add(self, name: int, ids: list, scores: list) -> None:
        own = [(-s, i is None, i or 0) for i, s in zip(ids, scores)]
        if own:
            self.rows[name] = sorted([*self.rows.get(name, ()), *own])[: self.top]

    def batch(self) -> pa.RecordBatch:
        rows = [(q, None if null else i, -s) for q, own in self.rows.items() for s, null, i in own]
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query", "doc_id", "score"])


def search(index: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], weight: np.ndarray, count: int, total: int, top: int) -> DataFrame:
    """FOUND rows, at most ``top`` per query and task. ``queries`` has (query, [(term, times)])."""
    shared = index.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        best, held, postings, docs = Best(top), [], 0, 0

        def flush() -> None:
            shard = Shard(held, weight, count, total)
            for name, wanted in queries:
                at, scores = shard.best(wanted, top, best.least(name))
                if len(at) > top:  # ties beyond the last place, by id
                    own = shard.ids.take(pa.array(at))
                    keep = np.lexsort((own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), -scores))[:top]
                    at, scores = at[keep], scores[keep]
                best.add(name, shard.ids.take(pa.array(at)).to_pylist(), scores.tolist())

        for batch in slices(batches, 4096):
            held.append(batch)
            docs += batch.num_rows
            postings += len(batch.column(2).flatten())
            if postings >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                flush()
                held, postings, docs = [], 0, 0
        if held:
            flush()
        yield best.batch()

    return index.mapInArrow(run, FOUND)


def highest(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each query with their ``rank``; first within salts, so that no task sees all of a query."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)).alias("_salt")
    parts = found.select("*", salt).withColumn("_n", F.row_number().over(Window.partitionBy("query", "_salt").orderBy(*order)))
    parts = parts.where(F.col("_n") <= top).select("query", "doc_id", "score")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    return ranked.where(F.col("rank") <= top)


def distinct_queries(items: DataFrame) -> DataFrame:
    """(query, text, words): the distinct texts that have terms, numbered and written."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes = [sum(len(p) for p in term_pieces(t.as_py())) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["text", "words"])

    counted = items.select("text").distinct().mapInArrow(count, "text string, words bigint").where("words > 0")
    return written(counted.select(F.monotonically_increasing_id().alias("query"), "text", "words"), "queries")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each row of ``items`` (item_id, text)."""
    queries = distinct_queries(items)
    words = queries.agg(F.sum("words")).first()[0] or 0
    blocks, found = -(-words // BLOCK_WORDS), None
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block)
        numbers: dict[bytes, int] = {}
        wanted = []
        for row in own.select("query", "text").toLocalIterator():
            times: dict[int, int] = {}
            for piece in term_pieces(row["text"]):
                for t in piece:
                    number = numbers.setdefault(t, len(numbers))
                    times[number] = times.get(number, 0) + 1
            wanted.append((row["query"], list(times.items())))
        if not wanted:
            continue
        index = written(forward(docs, numbers), "forward")
        count, total = index.agg(F.count("*"), F.sum("n")).first()
        if not count:
            continue
        weight = np.zeros(len(numbers), np.int64)
        holding = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        for row in holding.toLocalIterator():
            weight[row["term"]] = floor(1000 * log((2 * count + 2) / (2 * row["df"] + 1)))
        part = search(index, sorted(wanted), weight, count, total, top)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return items.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    best = highest(found, top)
    named = items.select("item_id", "text").join(queries.select("query", "text"), "text").select("item_id", "query")
    return named.join(written(best, "ranked"), "query").select("item_id", "rank", "doc_id", "score")


_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SQL = f"""WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS w
  FROM documents),
st AS (SELECT count(*)::BIGINT AS c, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
q AS (SELECT item_id, t, count(*)::BIGINT AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS t
  FROM benchmark) GROUP BY ALL),
p AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d)
      WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, st GROUP BY t),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * c) // l))))::BIGINT AS score
      FROM q JOIN p USING (t) JOIN w USING (t), st GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {TOP}"""


@query("op11_ranked", SQL)
def op11_ranked(spark, sf):
    return ranked(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
