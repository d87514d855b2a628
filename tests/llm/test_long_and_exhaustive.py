"""Very long texts for every operator, and models against exhaustive search."""

from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest

from framemetry.llm import (
    near_copies, op1_quality, op2_html, op3_warc, op4_simhash, op5_language, op6_lines, op7_units, op8_benchmark, op9_mixing,
    op11_ranked, op12_recipes, op13_middle,
)
from test_operators import WORDS, brute_fingerprint, prose, rows_of

LONG = 150_000  # words, about a megabyte


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(99)
    return "\n".join(prose(r, 50) for _ in range(LONG // 50))


def test_long_quality(documents, long_text):
    got = op1_quality.quality(documents([(1, long_text)])).first()
    words = long_text.encode().split()
    assert got["n_words"] == len(words) and got["word_chars"] == sum(map(len, words)) and got["kept"]


def test_long_page(spark):
    r = random.Random(1)
    parts = [prose(r, 40) for _ in range(1500)]
    html = "<html><body><nav><a href='/'>Home</a><a href='/x'>More</a></nav><article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article></body></html>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    text = op2_html.extract(pages).first()["text"]
    assert text.split("\n\n") == parts


def test_long_payload(spark, long_text):
    html = long_text * 3  # above one batch of the reader
    pages = spark.createDataFrame([(1, "u", html), (2, "v", html), (3, "w", "x")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r for r in op3_warc.archived(spark, pages).collect()}
    assert got[2]["payload"] == html and got[1]["record_type"] == "revisit" and got[1]["refers_to"] == 2
    assert got[2]["payload_digest"] == hashlib.sha1(html.encode()).hexdigest() and got[3]["payload"] == "x"


def test_long_fingerprints(documents, long_text):
    words = long_text.split()[:20_000]
    assert op4_simhash.fingerprint(" ".join(words)) == brute_fingerprint(" ".join(words))
    docs = documents([(1, long_text), (2, long_text.replace("\n", " ")), (3, long_text + " one more"), (4, "short")])
    assert rows_of(op4_simhash.representatives(docs), "doc_id") == [(1,), (4,)]
    assert rows_of(near_copies.representatives(docs), "doc_id") == [(1,), (4,)]


def test_long_language(documents, long_text):
    train = documents([(k, " ".join(random.Random(k).choices(WORDS[:10] if k % 2 else WORDS[10:], k=200)), "ab"[k % 2]) for k in range(8)])
    mixed = " ".join(random.Random(5).choices(WORDS[:10], k=LONG))
    got = {r["doc_id"]: r for r in op5_language.identify(documents([(1, mixed), (2, long_text)]), train).collect()}
    assert got[1]["lang_pred"] == "b" and got[1]["score"] > 0.9 and got[2]["lang_pred"] in ("a", "b")


def test_long_lines_and_units(documents, long_text):
    tail = "\n".join(long_text.split("\n")[-4:])
    docs = documents([(1, long_text), (2, "a first line of its own\n" + tail + "\nand a last line of its own")])
    kept = {r["doc_id"]: r["text"] for r in op6_lines.dedup_lines(docs).collect()}
    assert kept == {1: long_text, 2: "a first line of its own\nand a last line of its own"}
    gone = op7_units.repeats(docs).collect()
    assert [(r["_id"], r["start"], r["stop"]) for r in gone] == [(2, 24, 24 + len(tail))]


def test_long_texts_and_benchmark(documents, spark, long_text):
    r = random.Random(7)
    item = prose(r, 40)
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    docs = documents([(1, long_text), (2, long_text + "\n" + item), (3, item + "\n" + long_text)])
    assert {x["doc_id"] for x in op8_benchmark.matches(docs, bench).collect()} == {2, 3}
    best = op11_ranked.ranked(documents([(1, long_text), (2, item), (3, prose(r, 40))]), bench).collect()
    assert min(best, key=lambda x: x["rank"])["doc_id"] == 2


def test_long_sizes(documents, spark, long_text):
    labels = spark.createDataFrame([(1, 1.0)], "doc_id bigint, weight double")
    rows = [(1, long_text, "en", "a"), *[(k, "one two three", "en", "b") for k in range(2, 40)]]
    got = {x["doc_id"]: x for x in op9_mixing.mix(documents(rows), labels).collect()}
    assert got[1]["size"] == LONG and got[1]["copies"] <= 2


def test_long_recipes_and_middles(documents, long_text):
    docs = documents([(1, long_text), (2, long_text.replace("\n", " \t")), (3, long_text + "x")])
    assert rows_of(op12_recipes.groups(docs), "doc_id", "keep_id", "group_size") == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    cut = op13_middle.fill_in_middle(docs, rate=100).select("text", op13_middle.restored("output", "form").alias("back"), "n_units").collect()
    assert all(r["text"] == r["back"] and r["n_units"] == LONG for r in cut)


# ---- models ---------------------------------------------------------------------------------------


def counted(r, model, share, size):
    p = share @ np.exp(model)
    n = r.multinomial(size, p / p.sum()).astype(float)
    return n


def test_mixture_against_a_grid():
    """The likelihood that expectation-maximisation reaches is that of the best proportions."""
    r = np.random.default_rng(1)
    model = np.log(r.dirichlet(np.ones(30) * 0.3, 3) + 1e-6)
    for share in ([1, 0, 0], [0.6, 0.4, 0], [0.5, 0.3, 0.2]):
        n = counted(r, model, np.array(share), 400)
        got, likelihood = op5_language.mixture(model, n)
        grid = [np.array([a, b, 100 - a - b]) / 100 for a in range(101) for b in range(101 - a)]
        best = max(grid, key=lambda s: float(np.log(s @ np.exp(model) + 1e-300) @ n))
        assert abs(got - best).max() < 0.08 and got.sum() == pytest.approx(1)
        assert likelihood >= float(np.log(best @ np.exp(model) + 1e-300) @ n) - 2.0


def test_language_set_against_all_sets(monkeypatch):
    """The set that is found is the best of all sets by penalised likelihood."""
    r = np.random.default_rng(2)
    langs = list("abcde")
    model = np.log(r.dirichlet(np.ones(400) * 0.2, 5) + 1e-6)
    for share in ([1, 0, 0, 0, 0], [0, 0.5, 0.5, 0, 0], [0.4, 0, 0.3, 0, 0.3], [0, 0, 0, 0.9, 0.1], [0.2] * 5):
        n = counted(r, model, np.array(share, float), 3000)
        found = np.repeat(np.arange(400), n.astype(int))
        monkeypatch.setattr(op5_language, "sequences", lambda text: found)
        pred, score, chosen, parts = op5_language.predict("x", langs, model)

        def value(some):
            return op5_language.mixture(model[list(some)], n)[1] - (len(some) - 1) * op5_language.PENALTY * np.log(n.sum() + 1)

        sets = [s for k in range(1, 6) for s in itertools.combinations(range(5), k)]
        best = max(sets, key=value)
        assert sorted(chosen) == [langs[i] for i in best] == [langs[i] for i in range(5) if share[i]]
        assert sum(parts) == pytest.approx(1) and pred == chosen[int(np.argmax(parts))] and score == pytest.approx(max(parts))


def test_page_model_is_at_the_top_of_its_likelihood():
    """The trained weights against the likelihood by enumeration of all labellings: no small step raises it much, and
    steps of random weights lower it."""
    weight, change = op2_html.train(60, 400)
    pages = [(p, y) for p, y in op2_html.labelled_pages(60) if len(p) <= 10][:12] or [(p[:9], y[:9]) for p, y in op2_html.labelled_pages(12)]

    def loglik(w, c):
        total = 0.0
        for page, labels in pages:
            scores = [sum(w.get(n, 0.0) for n in row) for row in op2_html.features(page)]

            def value(y):
                return sum(s for s, b in zip(scores, y) if b) + sum(c[a][b] for a, b in zip(y, y[1:]))

            every = [value([bool(k >> i & 1) for i in range(len(scores))]) for k in range(1 << len(scores))]
            total += value([bool(b) for b in labels]) - np.logaddexp.reduce(every)
        return total

    at = loglik(weight, change)
    assert at / len(pages) > -0.5 and at > loglik({}, [[0, 0], [0, 0]]) + 10
    r = random.Random(3)
    for _ in range(5):
        other = {n: x + r.gauss(0, 1.5) for n, x in weight.items()}
        assert loglik(other, change) < at
