"""Every query of the subpackage: against its SQL, or for rows; and the pipeline."""

from __future__ import annotations

import pytest

import corpus_pipeline
from framemetry.llm import ORACLES, QUERIES
from oracle import compare, connect


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    if name in ORACLES:
        ok, note = compare(spark, connect(sf), QUERIES[name], ORACLES[name], sf)
        assert ok, note
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf):
    """Each stage against plain Python over the rows that the stage before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas())
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.columns == columns or name == "mixing"
    language, lines, copies, bench, mixed = seen.values()
    source = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(language) == {k for k, r in source.items() if any(c.isalpha() for c in r["text"])}
    assert set(lines) == set(language)
    firsts = {}
    for k in sorted(language):
        text = language[k]["text"].split("\n")
        at = [i for i, x in enumerate(text) if x.encode().split()]
        cut = set()
        for w in zip(at, at[1:], at[2:]):
            if firsts.setdefault(tuple(text[i] for i in w), (k, w[0])) != (k, w[0]):
                cut |= set(w)
        assert lines[k]["text"] == "\n".join(x for i, x in enumerate(text) if i not in cut)
    # brute force over all pairs that share a shingle
    grams, holders, label = {}, {}, {k: k for k in lines}
    for k, r in lines.items():
        words = r["text"].translate(str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})).encode().split()
        grams[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
        for g in grams[k]:
            holders.setdefault(g, []).append(k)
    near = {(a, b) for own in holders.values() for a in own for b in own if a < b}
    near = {(a, b) for a, b in near if 10 * len(grams[a] & grams[b]) >= 8 * len(grams[a] | grams[b])}
    changed = True
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    assert set(copies) == set(label.values()) and len(copies) < len(lines)
    assert set(bench) <= set(copies) and set(mixed) <= set(bench) and mixed
    assert all(r["copies"] in (1, 2) for r in mixed.values())


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
