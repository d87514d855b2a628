"""Near copies of texts: Jaccard similarity of five-word shingles, found by SimHash and MinHash and verified exactly.

Two texts are linked if they share ``SIMILAR`` = 8 tenths of the distinct shingles they have together.
Candidates are the members of a group of ``op4_simhash``, and texts that share a MinHash band: ``BANDS`` bands
of ``ROWS`` minima each. Fingerprints alone would miss most links, as a text that is 0.8 alike has about 10 of 64
bits changed, more than any selective search of them allows. Texts that are just 0.8 alike share a band with
probability 0.99999; those that share none are found if one group of fingerprints holds them. A group is one more
band value of its texts, so all its pairs are held against each other, not only those that its links join.

Every link is verified exactly. Texts that share many band values without being alike (a family around one
text, each with edits of its own) are not compared in pairs of whole sets. Every text has a hub: of the texts it shares
band values with, the one that shares most, or that one's hub. It is compared with its hub, and kept as what
it lacks of the hub's shingles and what it adds. Links to hubs give components. Texts of a band value
outside the component of its most central text are then held against the others of the value: two texts
with one hub by those two short lists, which give the exact similarity, numbers first, since few pairs of such texts
have sizes that allow it; texts of different hubs by their sizes, and then by whole sets. Pairs within one component
join nothing more and pairs that cannot be alike are no links, so the components are those of all candidate pairs.

Cases: words are as in ``op4_simhash``. A text of one to five words has one shingle, its words; texts
without words are copies of each other. Null ids rank last. Other columns pass through.

At scale: after the scan, copies are one row; only band values of several texts are joined, and only the
sets of candidates are made. Whole sets are joined once per text and for the few pairs of different hubs. The rows
of a crowded band value are dealt into blocks of ``BLOCK``, each of which meets the value's others.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from framemetry.llm import op4_simhash
from framemetry.llm.common import distinct_rows, slices, whole_row, written
from framemetry.llm.components import components

SHINGLE = 5
SIMILAR = 8  # tenths
BANDS, ROWS = 30, 5
CROWD = 32  # texts of a band value above which shingles of a single text are counted
BLOCK = 1024
SEED = 42
BATCH_SHINGLES = 1 << 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the shingles in their order, at least one."""
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    grams = zip(*[words[i:] for i in range(SHINGLE)])
    return np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64, len(words) - SHINGLE + 1)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set, one column per band."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = (key ^ np.minimum.reduceat(every * _FACTORS[0, k] + _FACTORS[1, k], starts)) * _MIX
            key ^= key >> np.uint64(29)
        out[:, band] = key
    return out


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, _k1, _k2, _text) to (doc_id, _k1, _k2, id, keys, _fp)."""

    def flush(batch, at, to, names, sets, prints):
        keys = pa.array(band_keys(sets).view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), keys)
        cut = batch.slice(at, to - at)
        return pa.RecordBatch.from_arrays(
            [*[cut.column(i) for i in range(3)], pa.array(names, pa.binary()), lists, pa.array(np.array(prints, np.uint64).view(np.int64))],
            names=["doc_id", "_k1", "_k2", "id", "keys", "_fp"],
        )

    for batch in slices(batches):
        at, size, names, sets, prints = 0, 0, [], [], []
        for i, value in enumerate(batch.column(3)):
            text = value.as_py()
            words = normal(text)
            names.append(xxhash.xxh3_128_digest(b" ".join(words)))
            sets.append(shingles(words))
            prints.append(op4_simhash.fingerprint(text))
            size += len(sets[-1])
            if size >= BATCH_SHINGLES:
                yield flush(batch, at, i + 1, names, sets, prints)
                at, size, names, sets, prints = i + 1, 0, [], [], []
        if sets:
            yield flush(batch, at, batch.num_rows, names, sets, prints)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 100):
        sets = [pa.array(np.unique(shingles(normal(t.as_py()))).view(np.int64)) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "own"])


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that share SIMILAR tenths of their shingles."""
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("_x"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("_y"))
    both = F.size("_x") + F.size("_y")
    small, large = F.least(F.size("_x"), F.size("_y")), F.greatest(F.size("_x"), F.size("_y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .where(10 * small >= SIMILAR * large)
        .where((10 + SIMILAR) * F.size(F.array_intersect("_x", "_y")) >= SIMILAR * both)
        .select("a", "b")
    )


def members(bands: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, size, crowded, alone): the shingles of each text, whether it has a crowded band value, and how many of
    its shingles no other such text has."""
    crowded = bands.where(F.col("n") > CROWD).select("id").distinct().withColumn("crowded", F.lit(True))
    each = sets.join(crowded, "id").select("id", F.explode("own").alias("s"))
    alone = (
        each.groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
        .groupBy("id").agg(F.count("*").alias("alone"))
    )
    sized = sets.select("id", F.size("own").alias("size")).join(crowded, "id", "left")
    return sized.join(alone, "id", "left").fillna(0, ["alone"]).fillna(False, ["crowded"])


def hubs(bands: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bands with ``mid``, the most central text of the value) and (id, hub, lacks, adds, ...) of each text. A text
    that shares less than half with its hub is its own."""
    weight = bands.groupBy("id").agg(F.sum("n").alias("weight"))
    about = written(members(bands, sets).join(weight, "id"), "members")
    rank = F.struct("weight", "id", "crowded")
    middles = bands.join(about.select("id", "weight", "crowded"), "id").groupBy("key").agg(F.max(rank).alias("_mid"))
    placed = written(bands.join(middles, "key"), "bands")
    step = written(placed.groupBy("id").agg(F.max("_mid").alias("_hub")), "steps")
    further = step.select(F.col("id").alias("_at"), F.col("_hub").alias("_further"))
    chosen = step.join(further, F.col("_hub")["id"] == F.col("_at")).join(about, "id")
    # what is in no other crowded text may be in a hub that is none
    chosen = chosen.select(
        "id", "size", "crowded", F.col("_further")["id"].alias("hub"),
        F.when(F.col("_further")["crowded"], F.col("alone")).otherwise(0).alias("alone"),
    )
    own = sets.select("id", "own").join(chosen, "id")
    both = own.join(sets.select(F.col("id").alias("hub"), F.col("own").alias("_hub")), "hub").select(
        "id", "hub", "size", "crowded", "alone", F.size("_hub").alias("whole"),
        F.array_except("_hub", "own").alias("lacks"), F.array_except("own", "_hub").alias("adds"),
    )
    common = F.col("whole") - F.size("lacks")
    union = F.col("size") + F.size("lacks")
    near = 2 * common >= union
    none = F.array().cast("array<bigint>")
    kept = written(
        both.select(
            "id", "size", "crowded", "alone", F.col("hub").alias("met"), (10 * common >= SIMILAR * union).alias("linked"),
            *[F.when(near, F.col(c)).otherwise(other).alias(c) for c, other in (("hub", F.col("id")), ("whole", F.col("size")), ("lacks", none), ("adds", none))],
        ),
        "hubs",
    )
    return placed.select("key", "id", "n", F.col("_mid")["id"].alias("mid")), kept


def _alone(t: str, other: str) -> Column:
    """How many shingles of a text cannot be in the other."""
    return F.when(F.col(f"{other}.crowded"), F.col(f"{t}.alone")).otherwise(0)


def _able(a: str, b: str) -> Column:
    """Whether two texts may be alike, as far as numbers only say."""
    size_a, size_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    at_most = F.least(size_a - _alone(a, b), size_b - _alone(b, a))
    return (10 + SIMILAR) * at_most >= SIMILAR * (size_a + size_b)


def _alike_by_hub(a: str, b: str) -> Column:
    """Whether two texts of one hub are alike: first the most they can share by numbers, then by the lists."""

    def common(lacking: Column, adding: Column) -> Column:
        shared = F.col(f"{a}.whole") - F.size(f"{a}.lacks") - F.size(f"{b}.lacks") + lacking + adding
        return (10 + SIMILAR) * shared >= SIMILAR * (F.col(f"{a}.size") + F.col(f"{b}.size"))

    def able(t: str, other: str) -> Column:  # shingles of one text alone are among those it adds, unless it is the hub
        return F.greatest(F.size(f"{t}.adds") - _alone(t, other), F.lit(0))

    numbers = common(F.least(F.size(f"{a}.lacks"), F.size(f"{b}.lacks")), F.least(able(a, b), able(b, a)))
    lists = common(
        F.size(F.array_intersect(f"{a}.lacks", f"{b}.lacks")), F.size(F.array_intersect(f"{a}.adds", f"{b}.adds"))
    )
    return numbers & lists


def links(bands: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that give the components of all candidate pairs that are alike. ``bands`` (key, id, n) has the
    values of several texts, ``n`` being how many."""
    placed, kept = hubs(bands, sets)
    first = kept.where("linked and met <> id").select(F.col("met").alias("a"), F.col("id").alias("b"))
    named = written(components(first), "named")
    own = kept.join(named.select(F.col("node").alias("id"), "component"), "id", "left").withColumn(
        "component", F.coalesce("component", "id")
    )
    middle = named.select(F.col("node").alias("mid"), F.col("component").alias("_m"))
    slim = placed.join(own.select("id", "component"), "id").join(middle, "mid", "left")
    slim = written(slim.withColumn("apart", F.col("component") != F.coalesce("_m", "mid")).select("key", "id", "n", "apart"), "apart")
    mixed = slim.where("apart").select("key").distinct()
    part = written(slim.join(mixed, "key").join(own.drop("linked", "met"), "id"), "mixed")
    blocks = F.floor(F.col("n") / BLOCK).cast("int")
    a = part.where("apart").withColumn("block", F.pmod(F.xxhash64("id"), blocks + 1).cast("int")).alias("a")
    b = part.withColumn("block", F.explode(F.sequence(F.lit(0), blocks))).alias("b")
    new = (
        (F.col("a.component") != F.col("b.component"))
        & (~F.col("b.apart") | (F.col("a.id") < F.col("b.id")))
        & (F.col("a.hub") != F.col("b.id")) & (F.col("b.hub") != F.col("a.id"))
    )
    one = F.col("a.hub") == F.col("b.hub")
    met = a.join(
        b,
        (F.col("a.key") == F.col("b.key")) & (F.col("a.block") == F.col("b.block")) & new & _able("a", "b")
        & (~one | _alike_by_hub("a", "b")),
    ).select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), one.alias("sure"))
    met = written(met.distinct(), "met")
    sure = met.where("sure").select("a", "b")
    return first.unionByName(sure).unionByName(alike(met.where("not sure").select("a", "b"), sets))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one of the smallest id (null last), then of the
    smallest row hash."""
    slim = docs.select("doc_id", *whole_row(docs), F.col("text").alias("_text")).mapInArrow(
        _signed, "doc_id bigint, _k1 bigint, _k2 bigint, id binary, keys array<bigint>, _fp bigint"
    )
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), "_k1", "_k2")
    first = written(
        written(slim, "signed").groupBy("id").agg(F.min(rank).alias("r"), F.first("keys").alias("keys"), F.first("_fp").alias("_fp")),
        "copies",
    )
    grouped = op4_simhash.groups(first.select("id", "_fp"), "_fp").select("id", F.xxhash64(F.lit("simhash"), "_component").alias("key"))
    each = first.select("id", F.explode("keys").alias("key")).unionByName(written(grouped, "grouped"))
    shared = each.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    bands = written(each.join(shared, "key"), "bands")
    wanted = first.join(bands.select("id").distinct(), "id").select("id", "r._k1", "r._k2")
    texts = docs.select(*whole_row(docs), "text").join(wanted, ["_k1", "_k2"]).groupBy("id").agg(F.first("text").alias("text"))
    sets = written(texts.mapInArrow(_sets, "id binary, own array<bigint>"), "sets")
    named = components(links(bands, sets)).withColumnRenamed("node", "id")
    kept = (
        first.select("id", "r").join(named, "id", "left")
        .groupBy(F.coalesce("component", "id").alias("_component")).agg(F.min("r").alias("r"))
    )
    return distinct_rows(docs).join(kept.select("r._k1", "r._k2"), ["_k1", "_k2"]).select("_row.*")
