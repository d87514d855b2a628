"""Removal of every byte that lies in a repeated 200-byte string.

Texts are UTF-8 bytes. A byte goes if some 200-byte string that covers it also starts anywhere else, in
the same text or another; both places lose it. Work is done on distinct texts; texts that occur twice or
more go whole from 200 bytes on.

Each of a text's windows of 200 bytes is assigned to an anchor: the string of ``GRAM`` bytes inside it
whose polynomial hash is smallest, the leftmost of equals. Equal windows have equal anchors at the same
place inside, and neighbouring windows share anchors, so a text has one anchor for some 50 bytes. Only
anchors are shuffled:

* an anchor that occurs once has no repeated window;
* if all places of an anchor have the same windows around it (one hash of their bytes), all are repeated;
* otherwise the bytes around its places are brought together, and the suffixes that start at their
  windows are sorted, among those with the same distance to the anchor. Two suffixes are compared by their
  common extension, found by binary search over prefix polynomial hashes, inside a mergesort. Neighbours
  that agree over 200 bytes are verified byte by byte;
* anchors at more than ``CROWD`` places would make such a group large. Their windows are counted instead
  by two hashes of 64 bits, as a partial aggregate.

Cases: a null text has no bytes. Texts below 200 bytes lose nothing. Null and repeated ids and extra
columns do not matter: results belong to the text and are joined to every row that has it. An empty table
gives an empty result. Texts of any length are hashed in pieces of ``PIECE`` windows, short ones together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from framemetry.llm.common import set_aside, slices, table
from framemetry.llm.registry import query

LENGTH = 200
GRAM = 100
REACH = LENGTH - GRAM + 1  # grams in a window
PIECE = 1 << 14
CROWD = 2048
SALTS = 16
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64

U = np.uint64
_CODES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        p = np.full(size, base, U)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


class Prefix:
    """Prefix polynomial hashes of a byte string: the hash of any part in two operations."""

    def __init__(self, raw: np.ndarray):
        size = max(1 << 16, 1 << int(len(raw)).bit_length())
        power, self.inverse = _powers(size)
        self.sums = np.zeros(len(raw) + 1, U)
        np.cumsum(_CODES[raw] * power[: len(raw)], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Hashes of all parts of one length, by start."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.inverse[:n]

    def at(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(29))


def _window_minimum(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: running minima of blocks, from both sides."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, U)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(parts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(part, hash, first window, windows after the first, distance of the anchor from the first window,
    hash of the bytes of these windows, windows after the first of a run). The parts are hashed in one
    string; windows stay inside a part. Neighbouring places that are equal, as periodic text has them, are
    a run: one place, whose windows are repeated."""
    text = b"".join(parts)
    size = np.array([len(p) for p in parts])
    begin, count = np.cumsum(size) - size, np.maximum(size - LENGTH + 1, 0)
    if not count.any():
        return tuple(np.empty(0, np.int64) for _ in range(7))
    part = np.repeat(np.arange(len(parts)), count)
    window = np.arange(len(part)) + (begin - np.cumsum(count) + count)[part]
    grams = _mix(Prefix(np.frombuffer(text, np.uint8)).every(GRAM))
    place = np.arange(len(grams), dtype=U)
    least = _window_minimum((grams & U(0xFFFFFFFF00000000)) | place, REACH)[window] & U(0xFFFFFFFF)
    least = least.astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero((np.diff(least) != 0) | (np.diff(part) != 0)) + 1])
    more = np.diff(first, append=len(least)) - 1
    owner, start, least = part[first], window[first], least[first]
    digest, back = xxhash.xxh3_64_intdigest, least - start
    ends = (start + more + LENGTH).tolist()
    around = np.array([digest(text[a:z], d) for a, z, d in zip(start.tolist(), ends, back.tolist())], U).view(np.int64)
    name = grams[least].view(np.int64)
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (np.diff(owner) != 0) | (np.diff(name) != 0) | (np.diff(around) != 0)
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(owner)) - 1
    run = np.where(tail > head, start[tail] + more[tail] - start[head], 0)
    return owner[head], name[head], (start - begin[owner])[head], more[head], back[head], around[head], run


ANCHOR = "h1 bigint, h2 bigint, anchor bigint, place bigint, around bigint, run bigint"


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A place is packed as first window, number of windows after it and distance: one column."""

    def rows(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        owner, name, first, more, back, around, run = anchors([h[3] for h in held])
        h1, h2, at = (np.array([h[k] for h in held], np.int64)[owner] for k in range(3))
        cols = [h1, h2, name, (first + at) << 16 | more << 8 | back, around, run]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in ANCHOR.split(", ")])

    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for batch in slices(batches, 200):
        h1, h2 = (batch.column(i).to_pylist() for i in (0, 1))
        for i, text in enumerate(batch.column(2)):
            data = text.as_py().encode()
            for at in range(0, len(data) - LENGTH + 1, PIECE):
                held.append((h1[i], h2[i], at, data[at : at + PIECE + LENGTH - 1]))
                size += len(held[-1][3])
                if size >= PIECE:
                    yield rows(held)
                    held, size = [], 0
    if held:
        yield rows(held)


PIECES = "h1 bigint, h2 bigint, anchor bigint, place bigint, piece binary"


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around each place that needs them."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [*[pa.int64()] * 4, pa.binary()]
    for batch in slices(batches, 200):
        out = []
        for row in batch.to_pylist():
            data = row["text"].encode()
            for p in row["places"]:
                first, more = p["place"] >> 16, p["place"] >> 8 & 255
                out.append((row["h1"], row["h2"], p["anchor"], p["place"], data[first : first + more + LENGTH]))
        for i in range(0, len(out), 20000):
            cols = list(zip(*out[i : i + 20000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def compare(prefix: Prefix, raw: np.ndarray, full: np.ndarray, start: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order (-1, 0, 1) of suffixes x and y over LENGTH bytes: the common extension by binary search."""
    out = np.zeros(len(x), np.int8)
    differ = np.flatnonzero(full[x] != full[y])
    if len(differ):
        a, b = start[x[differ]], start[y[differ]]
        low, high = np.zeros(len(a), np.int64), np.full(len(a), LENGTH - 1)
        for _ in range(int(LENGTH).bit_length()):
            middle = (low + high + 1) >> 1
            same = prefix.at(a, middle) == prefix.at(b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        out[differ] = np.where(raw[a + low] < raw[b + low], -1, 1)
    return out


def sort_suffixes(prefix: Prefix, raw: np.ndarray, full: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes by (group, bytes); ``group`` is sorted. A mergesort whose merges all run at
    once: each element's place is its own plus its rank in the run it is merged with."""
    order = np.arange(len(start))
    base = np.searchsorted(group, group)
    size = np.searchsorted(group, group, side="right") - base
    width = 1
    while len(size) and width < size.max():
        busy = np.flatnonzero(size > width)
        rank = busy - base[busy]
        run = rank // width
        other = base[busy] + (run ^ 1) * width
        low, high = np.zeros(len(busy), np.int64), np.clip(base[busy] + size[busy] - other, 0, width)
        count = high.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            c = compare(prefix, raw, full, start, order[other[open_] + middle], order[busy[open_]])
            # of equals, those of the left run come first
            before = (c < 0) | ((c == 0) & (run[open_] % 2 == 1))
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        to = base[busy] + (run // 2) * 2 * width + rank % width + np.minimum(low, count)
        order[to] = order[busy].copy()
        width *= 2
    return order


def repeated(anchor: np.ndarray, place: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(piece, window) of the windows that another piece with the same anchor has at the same distance."""
    more, back = place >> 8 & 255, place & 255
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    offset = np.concatenate([[0], np.cumsum(more + LENGTH)[:-1]])
    piece = np.repeat(np.arange(len(place)), more + 1)
    window = np.arange(len(piece)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    start = offset[piece] + window
    _, number = np.unique(anchor, return_inverse=True)
    group = number[piece] * 256 + back[piece] - window
    prefix = Prefix(raw)
    full = prefix.at(start, LENGTH)
    # a window that no other has the hash of is not repeated, and needs no place in the order
    both = _mix(full + group.astype(U) * U(BASE))
    by = np.argsort(both)
    equal = both[by[1:]] == both[by[:-1]]
    twice = np.concatenate([equal, [False]]) | np.concatenate([[False], equal])
    left = np.sort(by[twice])
    left = left[np.argsort(group[left], kind="stable")]
    if not len(left):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start, full, group, piece, window = (x[left] for x in (start, full, group, piece, window))
    order = sort_suffixes(prefix, raw, full, start, group)
    a, b = order[:-1], order[1:]
    near = np.flatnonzero((group[a] == group[b]) & (full[a] == full[b]))
    hit = np.zeros(len(order), bool)
    for i in range(0, len(near), 1 << 14):
        x, y = a[near[i : i + (1 << 14)]], b[near[i : i + (1 << 14)]]
        span = np.arange(LENGTH)
        same = (raw[start[x][:, None] + span] == raw[start[y][:, None] + span]).all(axis=1)
        hit[x[same]] = hit[y[same]] = True
        for k in np.unique(group[x[~same]]):  # equal hashes of unequal bytes: this group by its bytes
            seen: dict[bytes, int] = {}
            for j in np.flatnonzero(group == k):
                key = raw[start[j] : start[j] + LENGTH].tobytes()
                if key in seen:
                    hit[j] = hit[seen[key]] = True
                seen.setdefault(key, j)
    return piece[hit], window[hit]


SPAN = "h1 bigint, h2 bigint, start bigint, stop bigint"


def _spans(h1: np.ndarray, h2: np.ndarray, place: np.ndarray, piece: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    """Neighbouring windows of a piece joined to byte spans."""
    by = np.lexsort((window, piece))
    piece, window = piece[by], window[by]
    cut = np.flatnonzero((np.diff(piece) != 0) | (np.diff(window) != 1)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(piece)]]) - 1
    if not len(piece):
        first = last = np.empty(0, np.int64)
    at = (place >> 16)[piece[first]]
    cols = [h1[piece[first]], h2[piece[first]], at + window[first], at + window[last] + LENGTH]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in SPAN.split(", ")])


def _sorted_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans from a partition sorted by anchor; an anchor has at most CROWD places here."""

    def solve(part: pa.Table) -> pa.RecordBatch:
        h1, h2, anchor, place = (part.column(n).to_numpy() for n in ("h1", "h2", "anchor", "place"))
        return _spans(h1, h2, place, *repeated(anchor, place, part.column("piece").to_pylist()))

    rest: pa.Table | None = None
    for batch in slices(batches, 1000):
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        anchor = now.column("anchor").to_numpy()
        cut = np.flatnonzero(np.diff(anchor)) + 1
        rest = now.slice(cut[-1] if len(cut) else 0)
        if len(cut):
            yield solve(now.slice(0, cut[-1]))
    if rest is not None and rest.num_rows:
        yield solve(rest)


WINDOW = "h1 bigint, h2 bigint, at bigint, w1 bigint, w2 bigint"


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each window of crowded places under two hashes."""
    for batch in slices(batches, 500):
        place = batch.column(2).to_numpy()
        parts: list[list] = [[], [], [], [], []]
        for i, piece in enumerate(batch.column(3)):
            data = piece.as_py()
            n = len(data) - LENGTH + 1
            parts[0].append(np.full(n, batch.column(0)[i].as_py()))
            parts[1].append(np.full(n, batch.column(1)[i].as_py()))
            parts[2].append((place[i] >> 16) + np.arange(n))
            parts[3].append(Prefix(np.frombuffer(data, np.uint8)).every(LENGTH).view(np.int64))
            other = [xxhash.xxh3_64_intdigest(data[j : j + LENGTH]) for j in range(n)]
            parts[4].append(np.array(other, U).view(np.int64))
        cols = [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in WINDOW.split(", ")])


RESULT = "h1 bigint, h2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>"


def cut(data: bytes, found: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and what is left."""
    runs: list[list[int]] = []
    for a, z in sorted(found):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    kept, at = [], 0
    for a, z in runs:
        kept.append(data[at:a])
        at = z
    kept.append(data[at:])
    return [(a, z) for a, z in runs], b"".join(kept)


def _results(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["h1", "h2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))]
    for batch in slices(batches, 200):
        out = []
        for row in batch.to_pylist():
            data = row["text"].encode()
            found = [(s["start"], s["stop"]) for s in row["spans"] or ()]
            if row["copies"] > 1 and len(data) >= LENGTH:
                found = [(0, len(data))]
            runs, kept = cut(data, found)
            spans = [{"start": a, "stop": z} for a, z in runs]
            out.append((row["h1"], row["h2"], len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), spans))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) and n_bytes, n_removed, n_spans, kept_sha256, spans (in bytes), in place of
    columns of these names.

    The distinct texts are one exchange, which all steps that need texts read again."""
    text = F.coalesce("text", F.lit(""))
    made = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
    docs, names = set_aside(docs, "text", made=made)
    keyed = docs.select("*", F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("second"), text).alias("h2"))
    texts = keyed.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.first(text).alias("text"))
    places = texts.where("copies > 0").select("h1", "h2", "text").mapInArrow(_anchor_rows, ANCHOR)
    shared = (
        places.groupBy("anchor")
        .agg(
            F.sum(F.when(F.col("run") > 0, 2).otherwise(1)).alias("n"),
            F.min("around").alias("lo"),
            F.max("around").alias("hi"),
        )
        .where("n > 1")
        .select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"), (F.col("n") > CROWD).alias("crowd"))
    )
    met = places.select("h1", "h2", "anchor", "place", "run").join(shared, "anchor")
    first = F.shiftright("place", 16)
    more = F.greatest("run", F.shiftright("place", 8).bitwiseAND(255))
    plain = met.where("NOT mixed OR run > 0").select("h1", "h2", first.alias("start"), (first + more + LENGTH).alias("stop"))

    def pieces(some: Column) -> DataFrame:
        # run is carried only so that these steps and the plain spans read one and the same exchange
        places = F.collect_list(F.struct("anchor", "place", "run")).alias("places")
        wanted = met.where("mixed").where(some).groupBy("h1", "h2").agg(places)
        own = texts.where("copies > 0").join(wanted, ["h1", "h2"]).select("h1", "h2", "text", "places")
        return own.mapInArrow(_pieces, PIECES)

    few = (
        pieces(~F.col("crowd")).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_groups, SPAN)
    )
    # a window of a crowd may be in a large share of all texts: its places are dealt out by salt
    windows = pieces(F.col("crowd")).select("h1", "h2", "place", "piece").mapInArrow(_windows, WINDOW)
    again = (
        windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1")
        .select("w1", "w2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("h1", "at"), F.lit(SALTS)).cast("int"))
    many = dealt.join(again, ["w1", "w2", "salt"]).select("h1", "h2", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("stop"))
    spans = plain.unionByName(few).unionByName(many)
    gone = spans.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    results = (
        texts.where("copies > 0").join(gone, ["h1", "h2"], "left").select("h1", "h2", "copies", "text", "spans").mapInArrow(_results, RESULT)
    )
    return keyed.join(results, ["h1", "h2"]).select(
        *[F.col(n).alias(c) for c, n in names.items()], *made
    )


SQL = f"""WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS d FROM documents),
w AS (SELECT doc_id, d, unnest(range(octet_length(d) - {LENGTH - 1})) AS s FROM b WHERE octet_length(d) >= {LENGTH}),
c AS (SELECT doc_id, s, count(*) OVER (PARTITION BY md5(array_slice(d, s + 1, s + {LENGTH}))) AS n FROM w),
g AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LENGTH}, true) AS fresh FROM c WHERE n > 1),
i AS (SELECT doc_id, s, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g),
r AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS z FROM i GROUP BY doc_id, island),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT p.doc_id, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
             string_agg(hex(array_slice(d, before + 1, a)), '' ORDER BY a) || hex(array_slice(any_value(d), max(z) + 1, octet_length(any_value(d)))) AS kept
      FROM p JOIN b ON p.doc_id = b.doc_id GROUP BY p.doc_id)
SELECT doc_id, octet_length(d)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN kept IS NULL THEN d ELSE unhex(kept) END) AS kept_sha256
FROM b LEFT JOIN k USING (doc_id)"""


@query("op10_suffix", SQL)
def op10_suffix(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
