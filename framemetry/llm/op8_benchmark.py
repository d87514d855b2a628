"""Benchmark decontamination: a BM25 index of the test items, queried by every passage.

Items are indexed once, in inverted lists over item numbers: each posting holds the item's BM25 score for
the term divided by the score the item has against itself, so one threshold fits all items; items are cut
into blocks of ``BLOCK``, and each term keeps its largest posting in each block. Passages are windows of
words that overlap by half; half a window is at least the longest item, so every item that stands in a
text stands whole in some passage. Retrieval is block-max WAND with a fixed threshold: lists advance to
the pivot, the first item that the terms' maxima could lift to the threshold; if the block maxima around
it cannot, the whole block is skipped; else the item is scored. Passages none of whose blocks can reach
the threshold, by the same bounds, are set aside for a whole batch at once.

A retrieved item is verified against the words around its passage: ``OVERLAP`` of the five-word shingles
of its question, and of its answer if it has one, must stand there. The answer is what follows
``Answer:`` or, if there is no such mark, the last question mark; otherwise all is question. Parts of one
to four words are one shingle.

A word is a run of letters and digits; each character of a script without spaces (Chinese, Japanese, Thai, Lao,
Khmer, Burmese) is one.

Cases: null or empty texts and items match nothing. Items of any length count: one of one to four words is one shingle, so it
matches where it stands word for word. Longer items than ``LONGEST`` words are retrieved by pieces, each of which leads to
the whole item, verified like any. Null ids come back as null; rows that repeat each report their matches. Empty tables
give an empty result. Whole texts are read, in groups of passages that bound what a task holds beside the text.

At scale: documents are scanned once per shard of the items and never shuffled. A shard is broadcast; it
holds some ``SHARD_WORDS`` words of items, whatever the size of the benchmark; document frequencies are
those of all items.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from framemetry.llm.common import slices, table
from framemetry.llm.registry import query

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of an item's score against itself
OVERLAP = 0.8
SHINGLE = 5
BLOCK = 4
HALF = 64  # words of half a passage, if no item is longer
LONGEST = 512
SHARD_WORDS = 500_000
BATCH_WORDS = 1 << 16
CELLS = 1 << 22  # passages times blocks whose bounds are added at once
GROUP = 1 << 12  # passages at once

# Scripts written without spaces, as ranges of code points (fixed values)
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"

_NARROW = bytes(range(0xE0))
_UNSPACED = re.compile(f"([{UNSPACED}])")
_TOKENS = re.compile(r"[^\W_]+")
_ANSWER = re.compile(r"\banswer\s*:", re.IGNORECASE)

MATCH = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double, word_start bigint"


def tokens(text: str | None) -> list[str]:
    text = (text or "").lower()
    if text.encode("utf-8", "replace").translate(None, _NARROW):  # some character of three bytes or more
        text = _UNSPACED.sub(r" \1 ", text)
    return _TOKENS.findall(text)


def parts(text: str) -> tuple[list[str], list[str]]:
    """Words of the question and of the answer."""
    mark = _ANSWER.search(text)
    if mark:
        return tokens(text[: mark.start()]), tokens(text[mark.end() :])
    at = text.rfind("?") + 1
    return (tokens(text[:at]), tokens(text[at:])) if at else (tokens(text), [])


def pieces(words: list[str]) -> list[list[str]]:
    """The words in as many equal pieces as LONGEST asks for."""
    size = -(-len(words) // max(1, -(-len(words) // LONGEST)))
    return [words[at : at + size] for at in range(0, len(words), size)] if words else [words]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(SHINGLE)]))


def overlap(part: list[str], around: list[str], grams: set) -> float:
    """Share of the part's shingles that stand in the words around; 1 for an empty part."""
    own = shingles(part)
    if not own:
        return 1.0
    if len(part) < SHINGLE:
        n = len(part)
        return float(any(around[i : i + n] == part for i in range(len(around) - n + 1)))
    return len(own & grams) / len(own)


class Index:
    """Inverted lists of one shard. ``frequency`` and ``mean`` are those of all items."""

    def __init__(self, items: list[tuple[int, list[str], list[str]]], count: int, mean: float, frequency: dict[str, int]):
        self.items = items
        cut = [(at, words) for at, (_, question, answer) in enumerate(items) for words in pieces(question + answer)]
        self.whole = [at for at, _ in cut]  # the item of each piece; numbers below are those of pieces
        lists: dict[str, list[tuple[int, float]]] = {}
        for number, (_, words) in enumerate(cut):
            tf: dict[str, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            length = K1 * (1 - B + B * len(words) / mean)
            weight = {
                w: log(1 + (count - frequency[w] + 0.5) / (frequency[w] + 0.5)) * n * (K1 + 1) / (n + length)
                for w, n in tf.items()
            }
            whole = sum(weight.values())
            for w, x in weight.items():
                lists.setdefault(w, []).append((number, x / whole))
        self.term = {w: t for t, w in enumerate(lists)}
        self.posting = [[n for n, _ in found] for found in lists.values()]
        self.score = [[x for _, x in found] for found in lists.values()]
        self.top = np.array([max(s) for s in self.score] or [0.0])
        self.block_max: list[dict[int, float]] = []
        for found in lists.values():
            best: dict[int, float] = {}
            for n, x in found:
                best[n // BLOCK] = max(best.get(n // BLOCK, 0.0), x)
            self.block_max.append(best)
        self.blocks = -(-len(cut) // BLOCK)
        sizes = np.array([len(b) for b in self.block_max] or [0])
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.block = np.array([b for best in self.block_max for b in best], np.int64)
        self.bound = np.array([x for best in self.block_max for x in best.values()])
        self.half = max([HALF, *[len(words) for _, words in cut]])

    def hopeful(self, passage: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Passages (of pairs passage, term) some block of which could reach the threshold."""
        out = np.zeros(n, bool)
        sizes = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        cell = np.repeat(passage, sizes) * self.blocks + self.block[at]
        reach = np.bincount(cell, weights=self.bound[at], minlength=n * self.blocks)
        out[np.unique(np.flatnonzero(reach >= THRESHOLD - 1e-9) // self.blocks)] = True
        return out

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """Items that score the threshold or more, by block-max WAND."""
        found, end = [], len(self.whole)
        cursors = [[self.posting[t][0], 0, t] for t in terms]
        while True:
            cursors = sorted(c for c in cursors if c[0] < end)
            reach, pivot = 0.0, None
            for k, c in enumerate(cursors):
                reach += self.top[c[2]]
                if reach >= THRESHOLD - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                return found
            while k + 1 < len(cursors) and cursors[k + 1][0] == pivot:
                k += 1
            block = pivot // BLOCK
            bound = sum(self.block_max[c[2]].get(block, 0.0) for c in cursors[: k + 1])
            if bound < THRESHOLD - 1e-9:
                # nothing before the block's end, or before the next list begins, can reach it
                goal = (block + 1) * BLOCK
                if k + 1 < len(cursors):
                    goal = min(goal, cursors[k + 1][0])
                moving = cursors[: k + 1]
            elif cursors[0][0] == pivot:
                score = sum(self.score[c[2]][c[1]] for c in cursors[: k + 1])
                if score >= THRESHOLD - 1e-9:
                    found.append((pivot, score))
                goal, moving = pivot + 1, cursors[: k + 1]
            else:
                goal, moving = pivot, [c for c in cursors if c[0] < pivot]
            for c in moving:
                if c[0] < goal:
                    own = self.posting[c[2]]
                    c[1] = bisect_left(own, goal, c[1])
                    c[0] = own[c[1]] if c[1] < len(own) else end

    def search(self, texts: list[list[str]]) -> Iterator[tuple[int, int, float, float, float, int]]:
        """(text, item, score, question overlap, answer overlap, first word of the passage), the best
        passage of each verified pair."""
        best: dict[tuple[int, int], tuple] = {}
        for group in self.groups(texts):
            self._search(texts, group, best)
        yield from best.values()

    def groups(self, texts: list[list[str]]) -> Iterator[list[tuple[int, int, int]]]:
        """(text, first passage, passage after the last) of all passages, a bounded number of them together."""
        most = max(16, min(GROUP, CELLS // max(1, self.blocks)))
        group, size = [], 0
        for i, words in enumerate(texts):
            count, at = max(1, -(-len(words) // self.half) - 1), 0
            while at < count:
                to = min(count, at + most - size)
                group.append((i, at, to))
                size += to - at
                at = to
                if size == most:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def _search(self, texts: list[list[str]], group: list[tuple[int, int, int]], best: dict[tuple[int, int], tuple]) -> None:
        width, get = 2 * self.half, self.term.get
        ids, places, n_windows = [], [], 0
        windows: list[tuple[int, int]] = []
        for i, begin, end in group:
            words = texts[i][begin * self.half : (end + 1) * self.half]
            term = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
            at = np.flatnonzero(term >= 0)
            last = at // self.half  # the later of the two passages that hold a word
            for lead in (0, 1):
                inside = (last - lead >= 0) & (last - lead < end - begin)
                ids.append(term[at[inside]])
                places.append(last[inside] - lead + n_windows)
            windows.extend((i, k * self.half) for k in range(begin, end))
            n_windows += end - begin
        pairs = np.unique(np.concatenate(places) * len(self.term) + np.concatenate(ids)) if ids else np.empty(0, np.int64)
        passage, term = pairs // max(1, len(self.term)), pairs % max(1, len(self.term))
        hope = np.bincount(passage, weights=self.top[term], minlength=n_windows) >= THRESHOLD - 1e-9
        keep = hope[passage]
        passage, term = passage[keep], term[keep]
        keep = self.hopeful(passage, term, n_windows)[passage]
        passage, term = passage[keep], term[keep]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(passage)) + 1, [len(passage)]]) if len(passage) else [0]
        for a, z in zip(cut[:-1], cut[1:]):
            i, start = windows[passage[a]]
            for number, score in self.retrieve(term[a:z].tolist()):
                item, question, answer = self.items[self.whole[number]]
                size = len(question) + len(answer)
                around = texts[i][max(0, start - size) : start + width + size]
                grams = shingles(around) if len(around) >= SHINGLE else set()
                q, w = overlap(question, around, grams), overlap(answer, around, grams)
                if q >= OVERLAP and w >= OVERLAP:
                    match = (i, item, score, q, w, start)
                    old = best.get((i, item))
                    if old is None or (round(score, 9), -start) > (round(old[2], 9), -old[5]):
                        best[i, item] = match


def indexes(items: DataFrame) -> Iterator[Index]:
    """The shards of ``items`` (item_id, text)."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                question, answer = parts(text or "")
                words = question + answer
                if words:
                    rows.append((item, question, answer))
            cols = list(zip(*rows)) or [()] * 3
            kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["item_id", "question", "answer"])

    cut = items.select("item_id", "text").mapInArrow(split, "item_id bigint, question array<string>, answer array<string>")
    cut = cut.select("*", F.concat("question", "answer").alias("words"))
    count, total = cut.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not count:
        return
    shards = -(-total // SHARD_WORDS)
    terms = cut.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    for shard in range(shards):
        own = cut.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(shards)) == shard)
        rows = sorted(
            ((r["item_id"], r["question"], r["answer"]) for r in own.toLocalIterator()),
            key=lambda r: (r[0] is None, r[0] or 0, r[1]),
        )
        used = own.select(F.explode("words").alias("term")).distinct()
        frequency = {r["term"]: r["df"] for r in terms.join(used, "term").toLocalIterator()}
        if rows:
            yield Index(rows, count, total / count, frequency)


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[list[str]]]]:
    """(first row, words of rows) with a bounded number of words together."""
    first, held, size = 0, [], 0
    for i, text in enumerate(batch.column(column)):
        words = tokens(text.as_py())
        held.append(words)
        size += len(words)
        if size >= BATCH_WORDS:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item that it holds."""
    out = None
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = [c.split()[0] for c in MATCH.split(", ")]
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 3, pa.int64()]
            for batch in slices(batches):
                ids, rows = batch.column(0).to_pylist(), []
                for first, texts in _batches(batch, 1):
                    rows.extend((ids[first + i], *rest) for i, *rest in shared.value.search(texts))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        found = docs.select("doc_id", "text").mapInArrow(run, MATCH)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCH)


def without_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                clean = np.ones(batch.num_rows, bool)
                for first, texts in _batches(batch, at):
                    for i, *_ in shared.value.search(texts):
                        clean[first + i] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


_SQL_WORDS = f"regexp_extract_all(regexp_replace(lower(text), '([{UNSPACED}])', ' \\1 ', 'g'), '[\\p{{L}}\\p{{N}}]+')"
# For items that are all question, none longer than a piece, and unique ids.
SQL = f"""WITH items AS (
  SELECT item_id, w, len(w) AS n, least(len(w), {SHINGLE}) AS g FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
st AS (SELECT count(*) AS c, avg(n) AS mean, greatest({HALF}, max(n)) AS half FROM items),
tf AS (SELECT item_id, n, t, count(*) AS f FROM (SELECT item_id, n, unnest(w) AS t FROM items) GROUP BY ALL),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
wt AS (SELECT item_id, t, ln(1 + (c - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS x
       FROM tf JOIN df USING (t), st),
im AS (SELECT item_id, t, x / sum(x) OVER (PARTITION BY item_id) AS x FROM wt),
dt AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
win AS (SELECT doc_id, half, w, unnest(range(greatest(1, ceil(len(w) / half) - 1)::BIGINT)) * half AS word_start FROM dt, st),
terms AS (SELECT DISTINCT doc_id, word_start, unnest(w[word_start + 1 : word_start + 2 * half]) AS t FROM win),
sc AS (SELECT doc_id, word_start, item_id, sum(x) AS score FROM terms JOIN im USING (t)
       GROUP BY ALL HAVING sum(x) >= {THRESHOLD} - 1e-9),
around AS (SELECT doc_id, word_start, item_id, score, n, g AS m, win.w[greatest(0, word_start - n) + 1 : word_start + 2 * half + n] AS a
           FROM sc JOIN win USING (doc_id, word_start) JOIN items i USING (item_id)),
have AS (SELECT DISTINCT doc_id, word_start, item_id, a[k : k + m - 1] AS g
         FROM (SELECT *, unnest(range(1, len(a) - m + 2)) AS k FROM around)),
want AS (SELECT DISTINCT item_id, w[k : k + m - 1] AS g FROM (SELECT item_id, w, g AS m, unnest(range(1, n - g + 2)) AS k FROM items)),
size AS (SELECT item_id, count(*) AS m FROM want GROUP BY item_id),
met AS (SELECT doc_id, word_start, item_id, count(*) AS hits FROM have JOIN want USING (item_id, g) GROUP BY ALL),
ver AS (SELECT doc_id, item_id, word_start, score, hits / m AS question_overlap,
               row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(score, 9) DESC, word_start) AS r
        FROM met JOIN size USING (item_id) JOIN sc USING (doc_id, word_start, item_id) WHERE hits / m >= {OVERLAP})
SELECT doc_id, item_id, round(score, 6) AS score, question_overlap, 1.0::DOUBLE AS answer_overlap, word_start::BIGINT AS word_start
FROM ver WHERE r = 1"""


@query("op8_benchmark", SQL)
def op8_benchmark(spark, sf):
    found = matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.withColumn("score", F.round("score", 6))
