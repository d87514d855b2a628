"""Language identification as mixture inference.

Each language is a distribution over hashed three-letter sequences, counted over all documents that may
be learned from. A document is taken as drawn from a mixture of languages: expectation-maximisation
estimates its proportions, and languages are added one at a time, in the order of their proportions under
the full mixture, while the likelihood gains more than the penalty of a further language. The prediction
is the language of the largest proportion, the score that proportion.

Cases: a null text and one without a letter is ``und`` with score 0 and no languages; so is every text
if nothing can be learned. Rows with a null ``lang`` are not learned from. A null id is not held out. Ties
go to the language first by code point. Other columns pass through. Whole texts are used, of any length.

At scale: one pass counts (a task sends at most one row per language and sequence), one pass predicts.
The model has ``BUCKETS`` numbers for each language, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framemetry.llm.common import slices, table
from framemetry.llm.registry import query

BUCKETS = 1 << 16
SMOOTHING = 0.1
STEPS = 12  # of expectation-maximisation
PENALTY = 4.0  # times the logarithm of the number of sequences, for each further language
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def sequences(text: str | None) -> np.ndarray:
    """Hashed three-letter sequences of a text; runs of other characters count as one boundary."""
    if not text:
        return np.empty(0, np.int64)
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.empty(0, np.int64)
    padded = np.zeros(len(code) + 2, np.uint32)
    padded[1:-1] = np.where(letter, code, 0)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 0) | (padded[:-1] != 0)
    c = padded[keep]
    mixed = c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(16)).astype(np.int64)


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, np.int64)
            found = sequences(text.as_py())
            if len(found) > 8192:
                counts[lang] += np.bincount(found, minlength=BUCKETS)
            else:
                np.add.at(counts[lang], found, 1)
    for lang, n in counts.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])],
            names=["lang", "bucket", "n"],
        )


def learn(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log probabilities (languages x BUCKETS) from ``rows`` (lang, text)."""
    found = (
        rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .select("lang", "text")
        .mapInArrow(_count, "lang string, bucket int, n bigint")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    langs = sorted(set(found.column("lang").to_pylist()))
    if not langs:
        return [], np.empty((0, BUCKETS))
    counts = np.full((len(langs), BUCKETS), SMOOTHING)
    at = {lang: i for i, lang in enumerate(langs)}
    row = np.array([at[x] for x in found.column("lang").to_pylist()])
    counts[row, found.column("bucket").to_numpy()] += found.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def mixture(logs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log likelihood of counts ``n`` under the rows of ``logs`` (languages x sequences)."""
    if len(logs) == 1:
        return np.ones(1), float(logs[0] @ n)
    top = logs.max(axis=0)
    p = np.exp(logs - top)
    share = np.full(len(logs), 1 / len(logs))
    for _ in range(STEPS):
        whole = share @ p
        share = share * (p @ (n / whole)) / n.sum()
    return share, float(np.log(share @ p) @ n + top @ n)


def predict(text: str | None, langs: list[str], model: np.ndarray) -> tuple[str, float, list[str], list[float]]:
    """(language, score, languages, proportions) of a whole text."""
    found = sequences(text)
    if not len(found) or not langs:
        return UNKNOWN, 0.0, [], []
    which, n = np.unique(found, return_counts=True)
    logs, n = model[:, which].astype(np.float64), n.astype(np.float64)
    share, _ = mixture(logs, n)
    order = sorted(range(len(langs)), key=lambda i: -share[i])
    first = int(np.argmax(logs @ n))  # the best single language opens the set
    order = [first, *[i for i in order if i != first]]
    chosen, (share, best) = order[:1], mixture(logs[order[:1]], n)
    for k in range(2, len(order) + 1):
        wider, likelihood = mixture(logs[order[:k]], n)
        if likelihood - best <= PENALTY * np.log(n.sum() + 1):
            break
        chosen, share, best = order[:k], wider, likelihood
    top = min(range(len(chosen)), key=lambda i: (-share[i], langs[chosen[i]]))
    return langs[chosen[top]], min(1.0, float(share[top])), [langs[i] for i in chosen], [float(x) for x in share]


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``docs`` with lang_pred, score, languages and proportions (in place of columns of these names),
    learned from ``train`` (lang, text)."""
    made = ("lang_pred", "score", "languages", "proportions")
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made])
    langs, model = learn(train)
    shared = docs.sparkSession.sparkContext.broadcast((langs, model.astype(np.float32)))
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        for batch in slices(batches):
            texts = batch.column(at)
            out = list(zip(*[predict(t.as_py(), known, logs) for t in texts]))
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c, k) for c, k in zip(out, kinds)]], names=[*names, *made]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(
        run, f"{schema}, lang_pred string, score double, languages array<string>, proportions array<double>"
    )


@query("op5_language")
def op5_language(spark, sf):
    docs = table(spark, sf, "documents")
    train = docs.where(~held_out()).select("lang", "text")
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return identify(rows, train).drop("text")
