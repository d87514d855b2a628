"""Ranked search, chunk recipes and fill-in-middle against brute force and their stated cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from framemetry.llm import op11_ranked, op12_recipes, op13_middle
from test_operators import prose, rows_of

# ---- 11: ranked search --------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranking(docs, items, top=20):
    """(item, rank, doc, score) by the formula over all documents; ids None last."""
    words = [(k, terms_of(t)) for k, t in docs]
    words = [(k, w, Counter(w)) for k, w in words if w]
    n, total, df = len(words), sum(len(w) for _, w, _ in words), Counter(t for _, _, c in words for t in c)
    out = []
    for item, text in items:
        scored = []
        for key, w, counts in words:
            m = 75 + (25 * len(w) * n) // total
            score = sum(
                floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m))
                for t in terms_of(text) if t in counts
            )
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, r, None if null else key, -s) for r, (s, null, key) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def frame(spark, rows, schema="doc_id bigint, text string, query string, score int, rank int, terms int"):
    return spark.createDataFrame([(*r, "q", 1, 2, 3) for r in rows], schema)


def ranking(df):
    return rows_of(df, "item_id", "rank", "doc_id", "score")


def test_terms():
    assert op11_ranked.terms("Été-B2 x_y[z]{}~\x7f\x80 W\nA") == [t.encode() for t in ["Été", "b2", "x", "y", "z", "\x80 w", "a"]]
    for text in (None, "", " .,", "A1 b2" * 50, "日本語 ÀB"):
        assert [t.decode() for t in op11_ranked.terms(text)] == terms_of(text)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(op11_ranked, "PIECE", 50)
    text = prose(random.Random(1), 400) + " " + "x" * 200 + " end"
    assert [t.decode() for t in op11_ranked.terms(text)] == terms_of(text)
    assert max(len(p) for p in op11_ranked.term_pieces(text)) < 50


@pytest.mark.parametrize("first", [1, 4, 32])
def test_intervals_against_all_scores(monkeypatch, first):
    """Random lists with many ties: the result holds all documents at or above the last place, with exact scores."""
    monkeypatch.setattr(op11_ranked, "FIRST_READ", first)
    r = np.random.default_rng(5)
    for case in range(60):
        docs, lists, total = int(r.integers(1, 80)), [], None
        total = np.zeros(docs, np.int64)
        for _ in range(int(r.integers(1, 9))):
            ids = r.permutation(docs)[: int(r.integers(1, docs + 1))]
            impact = np.sort(r.integers(1, 6 if case % 2 else 1000, len(ids)))[::-1]
            total[ids] += impact
            lists.append((ids, impact))
        top, least = int(r.integers(1, 8)), int(r.integers(0, 6))
        got, scores = op11_ranked.resolve(lists, docs, top, least)
        last = np.sort(total)[::-1][top - 1] if top <= docs else 0
        want = {d: s for d, s in enumerate(total.tolist()) if s >= max(last, least, 1)}
        assert dict(zip(got.tolist(), scores.tolist())) == want


def test_reading_ends_early():
    """A clear winner in short lists: the long list of small impacts is not read to its end."""

    class Watched(np.ndarray):
        deepest = 0

        def __getitem__(self, at):
            if isinstance(at, slice):
                Watched.deepest = max(Watched.deepest, at.start or 0)
            return super().__getitem__(at)

    n = 1 << 16
    long = np.arange(n).view(Watched)
    impact = np.concatenate([np.arange(3000, 1000, -1), np.ones(n - 2000, np.int64)])
    got, scores = op11_ranked.resolve([(long, impact), (np.arange(3), np.array([9000, 8000, 7000]))], n, 2)
    assert dict(zip(got.tolist(), scores.tolist())) == {0: 12000, 1: 10999} and Watched.deepest < n // 8


def test_ranking_cases(spark, monkeypatch):
    r = random.Random(31)
    docs = [(k, prose(r, r.randint(1, 80))) for k in range(300)]
    same = prose(r, 30)
    docs += [(1000 + k, same) for k in range(40)] + [(None, same), (7, docs[7][1]), (2000, None), (2001, ""), (2002, " ... "), (2003, prose(r, 30000))]
    items = [(k, prose(r, r.randint(1, 40)).upper()) for k in range(15)] + [
        (50, same), (50, same), (None, same + " " + same), (51, None), (52, ""), (53, "nowhereword"), (54, "ka " * 30), (55, "...")
    ]
    want = brute_ranking(docs, items)
    bench = spark.createDataFrame([(*i, 1, 2) for i in items], "item_id bigint, text string, query int, words int")
    frames = frame(spark, docs).repartition(5)
    assert ranking(op11_ranked.ranked(frames, bench)) == want
    assert [k for i, _, k, _ in want if i == 50][:2] == [1000, 1000]
    monkeypatch.setattr(op11_ranked, "BLOCK_WORDS", 100)
    assert ranking(op11_ranked.ranked(frames, bench)) == want
    assert ranking(op11_ranked.ranked(frames, bench, 60)) == brute_ranking(docs, items, 60)
    assert op11_ranked.ranked(frames.limit(0), bench).count() == 0
    assert op11_ranked.ranked(frames, bench.limit(0)).count() == 0


def test_shards_follow_each_other(spark):
    """Many small shards in one task give what one shard gives: ties across shards included."""
    r = random.Random(32)
    docs = [(k, " ".join(r.choices("a b c d e".split(), k=3))) for k in range(4000)]
    items = [(1, "a b c"), (2, "e e d")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert op11_ranked.SHARD_DOCS >= 4096  # one batch of the reader is the least a shard can be
    index = op11_ranked.forward(frame(spark, docs).coalesce(1), {t.encode(): i for i, t in enumerate("abcde")})
    assert index.count() == 4000
    assert ranking(op11_ranked.ranked(frame(spark, docs).coalesce(1), bench)) == brute_ranking(docs, items)


# ---- 12: recipes --------------------------------------------------------------------------------


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_groups(rows):
    """(doc, keep, size, kept, digest) of rows; of rows of one id and text any one stays."""
    by = {}
    for k, t in rows:
        by.setdefault(normal(t), []).append(k)
    out = []
    for text, ids in by.items():
        ids = sorted(ids, key=lambda k: (k is None, k or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, ids[0], len(ids), i == 0, digest) for i, k in enumerate(ids)]
    return sorted(out, key=repr)


def recipe_rows():
    r = random.Random(41)
    long = prose(r, 60000)  # some hundred chunks
    rows = [(k, prose(r, r.randint(1, 900))) for k in range(60)]
    rows += [(100 + k, rows[k][1].replace(" ", r.choice([" ", "  ", "\n", "\t \r\x0b\x0c"]))) for k in range(30)]
    rows += [(200, long), (201, long[:-1]), (199, long.replace(" ", "\n")), (202, long[:30000] + "x" + long[30000:]), (None, long)]
    rows += [(300, None), (301, ""), (302, " "), (303, "\n\t"), (304, "a"), (305, " a"), (306, "a "), (307, "a b"), (308, "a b")]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, None), (None, rows[2][1])]
    return rows


def test_chunks_are_defined_by_content(monkeypatch):
    r = random.Random(40)
    data = prose(r, 40000).encode()
    cut = op12_recipes.chunks(data)
    assert b"".join(cut) == data and all(256 <= len(c) <= 8192 for c in cut[:-1])
    assert 600 < len(data) / len(cut) < 2500
    # an edit changes the chunks around it only
    other = op12_recipes.chunks(data[:50000] + b"edit" + data[50000:])
    assert len(set(cut) - set(other)) <= 4
    monkeypatch.setattr(op12_recipes, "PIECE", 1000)
    assert op12_recipes.chunks(data) == cut
    assert op12_recipes.chunks(b"") == [] and op12_recipes.chunks(b"a") == [b"a"]
    assert [len(c) for c in op12_recipes.chunks(b"a" * 20000)] == [8192, 8192, 3616] or len(op12_recipes.chunks(b"a" * 20000)) > 3


def test_normal_texts():
    for _, t in recipe_rows():
        assert op12_recipes.normal(t) == normal(t).encode()


@pytest.mark.parametrize("name_bytes", [16, 1])
def test_groups_against_texts(documents, name_bytes):
    """With names of one byte most names stand for several contents: these are told apart by their bytes."""
    rows = recipe_rows()
    docs = documents(rows).repartition(4)
    got = rows_of(op12_recipes.groups(docs, name_bytes), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_groups(rows)


def test_names_of_two_contents_are_met(documents):
    listed = op12_recipes.verified(op12_recipes.recipes(documents(recipe_rows()), 1), documents(recipe_rows()), 1)
    assert listed.where("others <> ''").count() > 50


def test_representatives(documents):
    rows = recipe_rows()
    docs = documents(rows)
    stay = op12_recipes.representatives(docs)
    assert stay.columns == docs.columns
    want = sorted([(k, t or "") for k, t in {normal(t): (k, t) for k, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0), reverse=True)}.values()], key=repr)
    got = sorted([(x["doc_id"], x["text"] or "") for x in stay.collect()], key=repr)
    assert [k for k, _ in got] == [k for k, _ in want] and [normal(t) for _, t in got] == [normal(t) for _, t in want]
    assert op12_recipes.representatives(docs.limit(0)).count() == 0
    assert op12_recipes.groups(docs.limit(0)).count() == 0


# ---- 13: fill-in-middle -------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_cut(key, text):
    text, units = text or "", UNIT.findall(text or "")
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middle_rows():
    r = random.Random(51)
    rows = [(k, prose(r, r.randint(0, 60)).replace(" ", r.choice([" ", "  ", "\n\t", "  é"]))) for k in range(300)]
    rows += [(400 + k, t) for k, t in enumerate([None, "", " ", "\n\n", "a", " a ", "x <P> y", "x<S>", "<M>", "< P> y", "<P<S", "日本 語\x1c x", "\U0001f600 \U0001f600"] * 4)]
    rows += [(500 + k, "<S" + " >P>" * k + "M>") for k in range(20)]
    return rows + [(None, prose(r, 20)), (1, rows[1][1]), (600, prose(r, 40000)), (601, prose(r, 40000)), (602, prose(r, 40000))]


def test_units_and_ranks(monkeypatch):
    monkeypatch.setattr(op13_middle, "PIECE", 7)
    r = random.Random(52)
    for _, text in middle_rows()[:380]:
        units = UNIT.findall(text or "")
        widths = op13_middle.unit_widths(text or "")
        assert widths.tolist() == [len(u) for u in units]
        lanes = op13_middle.SkipList(widths)
        for rank in {0, len(units), *r.choices(range(len(units) + 1), k=5)}:
            assert lanes.code_point(rank) == len("".join(units[:rank]))


def test_lanes_are_few_and_searches_short():
    widths = np.random.default_rng(1).integers(1, 9, 100_000)
    lanes = op13_middle.SkipList(widths)
    assert 6 <= len(lanes.lanes) <= 14
    for units, chars, _ in lanes.lanes:
        assert units.sum() <= 100_000 and chars.sum() <= widths.sum()

    class Counted(np.ndarray):
        reads = 0

        def __getitem__(self, at):
            Counted.reads += 1
            return super().__getitem__(at)

    lanes.lanes = [(u.view(Counted), c, d) for u, c, d in lanes.lanes]
    total = np.concatenate([[0], np.cumsum(widths)])
    for rank in range(0, 100_001, 997):
        assert lanes.code_point(rank) == total[rank]
    assert Counted.reads / 101 < 150


def test_middle_against_brute_force(documents):
    rows = middle_rows()
    docs = documents(rows).withColumnRenamed("spans", "output").repartition(3)
    got = op13_middle.fill_in_middle(docs)
    assert got.columns == [c for c in docs.columns if c != "output"] + op13_middle.MADE.names
    assert rows_of(got, "doc_id", "n_units", "form", "prefix_chars", "middle_chars", "output") == sorted([brute_cut(*r) for r in rows], key=repr)
    forms = Counter(x["form"] for x in got.collect())
    assert len(forms) == 3 and forms["spm"] > forms["psm"] > 5
    back = got.select("text", op13_middle.restored("output", "form").alias("back")).collect()
    assert all((x["text"] or "") == x["back"] for x in back)
    assert op13_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_rates_are_parameters(documents):
    docs = documents([(k, f"one two three {k}") for k in range(50)])
    forms = {x["form"] for x in op13_middle.fill_in_middle(docs, rate=100, spm=0).collect()}
    assert forms == {"psm"}
    assert {x["form"] for x in op13_middle.fill_in_middle(docs, rate=0).collect()} == {"plain"}
