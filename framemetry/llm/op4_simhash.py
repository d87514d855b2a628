"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint has bit i set if more than half of its three-word shingles, repeats included, have
it set in their XXH64. Fingerprints that differ in at most ``RADIUS`` = 3 bits are linked.

Search: a fingerprint has two segments of 32 bits. Of two fingerprints within 3 bits, one segment differs
in at most 1. So the table of each segment is probed with the ball of radius 1 around a segment's value;
as one of two values that differ in one bit has that bit set, only set bits are cleared, and each pair is
met once. Members of a probed entry are compared in full. An entry gives links that join its members as
far as they are within 3 bits, not all pairs: a spanning forest is enough for components.

Entries above ``DENSE`` members (families of near copies whose fingerprints share a segment) are handled
exactly in another way: two fingerprints within 3 bits have a 64-bit word within 1 bit of the one and 2
of the other. Each member enumerates its balls of radius 1 and 2; a word at radius 1 of some member links
everything that reaches it. A word is reached by at most 2145 fingerprints, so its group is bounded.

Cases: a null or empty text, or one without words, has fingerprint zero and links like any other. A text
of one or two words has one shingle, its words. Null ids have no rank: a component's id is its smallest
id that is not null. Repeated rows share fingerprint and component. An empty table gives an empty result.
Other columns pass through in
``representatives``.

At scale: everything after the scan works on distinct fingerprints; copies are one row per map task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framemetry.llm.common import distinct_rows, slices, table, whole_row, written
from framemetry.llm.components import components
from framemetry.llm.registry import query

SHINGLE = 3
SEED = 42
RADIUS = 3
DENSE = 1024

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, len(words)
    if n <= SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])]
    raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(raw[:, 7 - i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = batch.column(batch.schema.get_field_index("_text"))
        prints = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
        keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in keep], pa.array(prints)], names=[*[batch.schema.names[i] for i in keep], "_fp"]
        )


def probes(prints: DataFrame) -> DataFrame:
    """(seg, key, fp, own): each fingerprint under its two segment values and under each of them with
    one set bit cleared."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = F.array(
        F.struct(F.lit(0).alias("seg"), low.alias("v")), F.struct(F.lit(1).alias("seg"), high.alias("v"))
    )
    bits = F.array(F.lit(0), *[F.lit(1 << i) for i in range(32)]).cast("array<bigint>")
    each = prints.select("fp", F.inline(halves)).select("fp", "seg", "v", F.explode(bits).alias("bit"))
    return each.where((F.col("bit") == 0) | (F.col("v").bitwiseAND(F.col("bit")) != 0)).select(
        "seg", F.col("v").bitwiseXOR(F.col("bit")).alias("key"), "fp", (F.col("bit") == 0).alias("own")
    )


def forest(fp: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the members of one entry as far as some pair within RADIUS, of which one has
    the entry as its own value, does."""
    left = np.arange(len(fp))
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            near = np.bitwise_count(fp[reached][:, None] ^ fp[left][None, :]) <= RADIUS
            near &= own[reached][:, None] | own[left][None, :]
            hit = near.any(axis=0)
            for j in np.flatnonzero(hit):
                yield int(fp[reached[near[:, j].argmax()]]), int(fp[left[j]])
            reached, left = left[hit], left[~hit]


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the entries of a partition sorted by (seg, key); an entry may span batches.
    Entries hold at most DENSE members here."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols)]
        cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
        last = cut[-1] if len(cut) else 0
        rest = [c[last:] for c in cols]
        yield from _entry_links(cols[2], cols[3], np.concatenate([[0], cut]) if len(cut) else np.array([0]))
    if rest is not None:
        yield from _entry_links(rest[2], rest[3], np.array([0, len(rest[2])]))


def _entry_links(fp: np.ndarray, own: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    fp, own = fp.view(np.uint64), own.astype(bool)
    found: list[tuple[int, int]] = []
    for i in np.flatnonzero(np.diff(bounds) > 1):
        at, to = bounds[i], bounds[i + 1]
        if own[at:to].any():
            found.extend(forest(fp[at:to], own[at:to]))
    ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def _masks() -> np.ndarray:
    single = [1 << i for i in range(64)]
    return np.array([0, *single, *[x | y for x, y in combinations(single, 2)]], np.uint64)


def _balls(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    masks = _masks()
    for batch in slices(batches, 32):
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        words = (fp[:, None] ^ masks[None, :]).ravel().view(np.int64)
        near = np.tile(np.arange(len(masks)) <= 64, len(fp))
        yield pa.RecordBatch.from_arrays(
            [pa.array(words), pa.array(np.repeat(fp, len(masks)).view(np.int64)), pa.array(near)], names=["word", "fp", "near"]
        )


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) that give the components of radius 3."""
    every = probes(prints)
    dense = written(
        every.groupBy("seg", "key").agg(F.count("*").alias("n")).where(F.col("n") > DENSE).select("seg", "key"),
        "dense",
    )
    sparse = every.join(dense, ["seg", "key"], "left_anti")
    usual = sparse.repartition("seg", "key").sortWithinPartitions("seg", "key").mapInArrow(_links, "a bigint, b bigint")
    members = every.join(dense, ["seg", "key"], "left_semi").select("fp").distinct()
    met = (
        members.mapInArrow(_balls, "word bigint, fp bigint, near boolean")
        .groupBy("word")
        .agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("all"))
        .where(F.col("a").isNotNull() & (F.size("all") > 1))
        .select("a", F.explode("all").alias("b"))
        .where("a <> b")
    )
    return usual.unionByName(met).distinct()


def groups(printed: DataFrame, key: str = "doc_id") -> DataFrame:
    """``printed`` (with ``_fp``) and ``_component``, the smallest ``key`` that links reach."""
    prints = written(printed.groupBy(F.col("_fp").alias("fp")).agg(F.min(key).alias("least")), "fingerprints")
    found = components(links(prints.select("fp"))).withColumnRenamed("node", "fp")
    linked = prints.join(found, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("low"))
    named = prints.join(linked.join(least, "component").select("fp", "low"), "fp", "left").select(
        F.col("fp").alias("_k"), F.coalesce("low", "least").alias("_component")
    )
    # written, so that both sides of the last join are plain exchanges, whose hot keys can be split
    named = written(named, "named")
    return printed.join(named, printed["_fp"] == named["_k"]).drop("_k")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one of the smallest id (null last), then of the
    smallest row hash. Texts are shuffled once, to meet the keys that stay."""
    slim = docs.select("doc_id", *whole_row(docs), F.col("text").alias("_text")).mapInArrow(
        _fingerprints, "doc_id bigint, _k1 bigint, _k2 bigint, _fp bigint"
    )
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "_k1", "_k2")
    # copies are one row before the groups are joined
    first = written(slim, "prints").groupBy("_fp").agg(F.min(rank).alias("r"))
    kept = groups(first, "_fp").groupBy("_component").agg(F.min("r").alias("r"))
    return distinct_rows(docs).join(kept.select("r._k1", "r._k2"), ["_k1", "_k2"]).select("_row.*")


@query("op4_simhash")
def op4_simhash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    slim = docs.select("doc_id", F.col("text").alias("_text")).mapInArrow(_fingerprints, "doc_id bigint, _fp bigint")
    return groups(written(slim, "prints")).select(
        "doc_id",
        F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )
