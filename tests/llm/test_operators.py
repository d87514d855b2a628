"""The text operators against brute force and their stated cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from framemetry.llm import (
    near_copies, op1_quality, op2_html, op3_warc, op4_simhash, op5_language, op6_lines, op7_units, op8_benchmark, op9_mixing,
    op10_suffix,
)

WORDS = "ka lo mi ren tu sha vel dor pa is en qu ar tion ber che na ul gri som".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choices(WORDS, k=r.randint(1, 4))) for _ in range(n)) + "."


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- 1: quality rules ---------------------------------------------------------------------------


def test_quality_cases(documents):
    r = random.Random(1)
    good = "\n".join(prose(r, 30) for _ in range(3))
    table = " | ".join(prose(r, 1) for _ in range(80))
    docs = documents([(1, good), (2, None), (3, ""), (None, good), (1, good), (4, table), (5, "same words here " * 40)])
    got = {(x["doc_id"], x["n_words"]): x for x in op1_quality.quality(docs).collect()}
    assert op1_quality.quality(docs).count() == 7
    assert got[1, 90]["kept"] and not got[1, 90]["base_failed"]
    assert got[None, 90]["kept"]
    assert got[2, 0]["base_failed"] and not got[3, 0]["kept"] and got[3, 0]["word_chars"] == 0
    t = got[4, 159]
    assert t["n_symbols"] == 79 and not t["base_failed"] and not t["kept"] and t["n_navigation"] == 1
    assert got[5, 120]["n_repeat_words"] == 120 and got[5, 120]["base_failed"]
    assert op1_quality.quality(docs.limit(0)).count() == 0


def test_quality_signals_by_hand():
    # a line equal to an earlier one; separators of other scripts are no white space
    n, chars, symbols, dup, repeat, *_ = op1_quality.measure("a b c#\n\x1cd\na b c#\n \n \n")
    assert (n, chars, symbols, dup, repeat) == (5, 12, 2, 1, 0)
    assert op1_quality.repeat_words("a b c d a b c".encode().split()) == 6
    assert op1_quality.clean_text("A line. \n| a | b | c |\n\nEnd.") == "A line. \n\nEnd."


# ---- 2: pages -----------------------------------------------------------------------------------


def test_page_accuracy():
    weight, change = op2_html.train()
    right = total = 0
    for page, labels in op2_html.labelled_pages(150, seed=77):
        scores = [sum(weight.get(n, 0.0) for n in row) for row in op2_html.features(page)]
        decoded = op2_html.decode(scores, change)
        right += sum(a == b for a, b in zip(labels, decoded))
        total += len(labels)
    assert right / total > 0.98


def test_viterbi_against_all_labellings():
    r = np.random.default_rng(3)
    for _ in range(50):
        scores, change = r.normal(size=6).tolist(), r.normal(size=(2, 2)).tolist()

        def value(y):
            return sum(s for s, b in zip(scores, y) if b) + sum(change[a][b] for a, b in zip(y, y[1:]))

        best = max(([bool(k >> i & 1) for i in range(6)] for k in range(64)), key=value)
        assert op2_html.decode(scores, change) == best


def test_page_cases(spark):
    body = "<p>" + prose(random.Random(2), 60) + "</p>"
    html = f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Title &amp; more</h1><p>One  two&nbsp;&lt;b&gt;\n three, four five six seven.{body}</article><footer>&copy; me</footer>"
    pages = spark.createDataFrame(
        [(1, "u", html, 5), (None, None, None, 5), (3, "v", "", 5), (1, "u", html, 5)], "page_id bigint, url string, html string, text int"
    )
    got = op2_html.extract(pages).collect()
    texts = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 4 and texts[None] == "" and texts[3] == ""
    assert texts[1].startswith("Title & more\n\nOne two <b> three, four five six seven.\n\n")
    assert "Home" not in texts[1] and "me" not in texts[1].split()
    assert op2_html.extract(pages.limit(0)).count() == 0


# ---- 3: WARC ------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    long = "é" * 600
    data = [
        (1, "http://a/ü?x=1", long), (2, "http://b/", long), (3, None, "short"), (4, "c", None), (None, "n\r\nx", long), (5, "d", "short"),
        (6, "e", "x\r\n\r\nWARC/1.1\r\n\r\n" * 100), (2, "http://b/", long),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in data], "page_id bigint, url string, html string, offset int").repartition(3)
    got = op3_warc.archived(spark, pages).collect()
    assert len(got) == len(data)
    for r in got:
        html = next(h for i, _, h in data if i == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        if r["record_type"] == "response":
            assert r["payload"] == html and r["refers_to"] is None
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == Counter({(1, "revisit", 2): 1, (2, "response", None): 2, (None, "revisit", 2): 1, (3, "response", None): 1,
                             (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1})
    assert {r["url"] for r in got} >= {"http://a/ü?x=1", None, "n%0D%0Ax"}
    assert op3_warc.archived(spark, pages.limit(0)).count() == 0


def test_warc_selection_is_read_in_few_ranges(spark):
    from framemetry.session import shared_dir

    r = random.Random(4)
    pages = spark.createDataFrame([(i, f"u{i}", prose(r, 50)) for i in range(300)], "page_id bigint, url string, html string")
    folder = shared_dir(spark, "warc")
    index = op3_warc.write_archive(pages.coalesce(1), folder)
    some = index.where("page_id % 3 = 0")
    assert op3_warc.byte_ranges(some).count() == 1
    assert rows_of(op3_warc.read_archive(some, folder), "page_id") == sorted([(i,) for i in range(0, 300, 3)], key=repr)


@pytest.mark.parametrize("task_bytes", [1000, 5000, 1 << 20])
def test_runs_are_dealt_by_bytes(spark, task_bytes):
    """No partition reads more than the bound and one run, whatever the sizes of runs and files; none is lost."""
    r = random.Random(task_bytes)
    rows = []
    for file in ("a", "b", "c", "d"):
        at = 0
        for _ in range(r.choice([1, 40, 200])):
            size = r.choice([10, 30, 900])
            rows.append((file, at, at + size))
            at += size + r.randint(0, 50)
    out = op3_warc.dealt(spark.createDataFrame(rows, "file string, start bigint, stop bigint"), task_bytes)
    parts = [[tuple(x) for x in p] for p in out.rdd.glom().collect()]
    assert sorted(x for p in parts for x in p) == sorted(rows)
    assert max(sum(b - a for _, a, b in p) for p in parts) < task_bytes + 900
    assert len(parts) == sum(b - a for _, a, b in rows) // task_bytes + 1
    assert op3_warc.dealt(out.limit(0), task_bytes).count() == 0


# ---- 4: SimHash ---------------------------------------------------------------------------------


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = lowered.encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if hashes and 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {p: p for p in prints}
    todo = set(prints)
    while todo:
        start = min(todo)
        reach, front = {start}, [start]
        while front:
            x = front.pop()
            near = {y for y in todo if (x ^ y).bit_count() <= 3} - reach
            reach |= near
            front += near
        for y in reach:
            label[y] = start
        todo -= reach
    return label


def test_fingerprints():
    r = random.Random(5)
    for text in (None, "", "One", "One two", "ÉTÉ ABC", prose(r, 300), "a a a a a a"):
        assert op4_simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("dense", [4, 1024])
def test_simhash_links(spark, monkeypatch, dense):
    """Random families around some centres, by either way of searching."""
    monkeypatch.setattr(op4_simhash, "DENSE", dense)
    r = random.Random(6)
    prints = set()
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))))
    prints |= {r.getrandbits(64) for _ in range(200)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in sorted(prints)]
    found = op4_simhash.components(op4_simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()
    got = {}
    for row in found:
        got.setdefault(row["component"], set()).add(row["node"] % (1 << 64))
    want = {}
    for p, c in brute_components(prints).items():
        want.setdefault(c, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_simhash_cases(documents):
    r = random.Random(7)
    text = prose(r, 200)
    docs = documents([(5, text), (3, text), (None, text), (8, None), (9, ""), (9, ""), (12, prose(r, 100))])
    kept = op4_simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert rows_of(kept, "doc_id") == sorted([(3,), (8,), (12,)], key=repr)
    assert op4_simhash.representatives(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    got = dict(rows_of(op4_simhash.components(spark.createDataFrame(path, "a bigint, b bigint")), "node", "component"))
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}


def brute_near(texts):
    """Smallest member of each component of texts whose five-word Jaccard similarity is 0.8 or more."""
    sets = {}
    for k, t in texts.items():
        words = (t or "").lower().encode().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    label = {k: k for k in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return set(label.values()), pairs


def test_near_copies_of_the_pipeline(spark, documents):
    """Families of copies around 0.8: each pair above it is linked, whatever its fingerprints, none below."""
    r = random.Random(17)
    texts = {}
    for _ in range(12):
        base = prose(r, r.randint(60, 300)).split()
        for _ in range(12):
            words = list(base)
            for at in r.sample(range(len(words)), r.randint(0, len(words) // 22)):
                words[at] = "edit" + str(r.random())
            texts[len(texts)] = " ".join(words)
    want, pairs = brute_near(texts)
    prints = {k: op4_simhash.fingerprint(t) for k, t in texts.items()}
    assert sum((prints[a] ^ prints[b]).bit_count() > 3 for a, b in pairs) > len(pairs) / 2
    assert 12 < len(want) < len(texts) - 12
    docs = documents([*texts.items(), *[(k + 1000, t.upper()) for k, t in texts.items()]])
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("crowd", [8])
def test_crowded_families(documents, monkeypatch, crowd):
    """A family around one text, each with edits of its own, some alike and most not: links are those of brute
    force, and what is held against each other grows with the family, not its square."""
    r = random.Random(19)
    rows = {}
    for size in (150, 300):
        base, texts = prose(r, 200).split(), {}
        for k in range(size):
            words = list(base)
            for at in r.sample(range(len(words)), r.choice([1, 3, 6, 6, 6, 9])):
                words[at] = "edit" + str(r.random())
            texts[k] = " ".join(words)
        for k in range(0, size, 10):  # copies of copies
            texts[size + k] = texts[k] + " and some more words at its end"
        want, _ = brute_near(texts)
        seen = {}

        def kept(df, purpose, own=near_copies.written):
            seen[purpose] = own(df, purpose)
            return seen[purpose]

        monkeypatch.setattr(near_copies, "CROWD", crowd)
        monkeypatch.setattr(near_copies, "written", kept)
        got = near_copies.representatives(documents(texts.items()))
        assert sorted(x["doc_id"] for x in got.collect()) == sorted(want)
        monkeypatch.undo()
        rows[size] = seen["met"].count()
    assert rows[300] < 4 * 300


def test_near_copies_cases(spark, documents):
    r = random.Random(18)
    text = prose(r, 200)
    docs = documents([(5, text), (3, text), (None, text), (8, None), (9, ""), (9, ""), (12, prose(r, 100)), (13, "a b"), (14, "A b"), (15, "a c")])
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert rows_of(kept, "doc_id") == sorted([(3,), (8,), (12,), (13,), (15,)], key=repr)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def test_near_copies_by_fingerprints(spark, documents):
    """A pair of 0.8 that shares no band is linked through its group of fingerprints."""
    words = [f"w{i}" for i in range(78016159, 78016171)]
    texts = {k: " ".join([*words, end]) for k, end in ((1, "x1"), (2, "x3"))}
    keys = near_copies.band_keys([near_copies.shingles(near_copies.normal(t)) for t in texts.values()])
    prints = [op4_simhash.fingerprint(t) for t in texts.values()]
    assert not (keys[0] == keys[1]).any() and (prints[0] ^ prints[1]).bit_count() == 2
    assert brute_near(texts) == ({1}, [(1, 2)])
    docs = documents([*texts.items(), (3, " ".join([*words[:6], "x4"])), (4, prose(random.Random(20), 100))])
    assert rows_of(corpus_pipeline.near_copies(spark, docs, ""), "doc_id") == [(1,), (3,), (4,)]


def test_near_copies_of_fingerprints_alone(documents, monkeypatch):
    """Without bands, what is linked are all pairs of a group of fingerprints that are alike, not only those that its
    links join."""
    r = random.Random(21)
    base, texts = prose(r, 200).split(), {}
    for k in range(150):
        words = list(base)
        for at in r.sample(range(len(words)), r.choice([1, 2, 3, 4, 6])):
            words[at] = "edit" + str(r.random())
        texts[k] = " ".join(words)
    prints = {k: op4_simhash.fingerprint(t) for k, t in texts.items()}
    group = {k: k for k in texts}
    near = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    for _ in texts:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    _, pairs = brute_near(texts)
    pairs = [(a, b) for a, b in pairs if group[a] == group[b]]
    label = {k: k for k in texts}
    for _ in texts:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert len(set(group.values())) < len(set(label.values())) < len(texts) and not set(pairs) <= set(near)

    def bandless(batches, own=near_copies._signed):
        for batch in own(batches):
            at = batch.schema.get_field_index("keys")
            none = pa.array([[]] * batch.num_rows, batch.schema.field(at).type)
            yield batch.set_column(at, "keys", none)

    monkeypatch.setattr(near_copies, "_signed", bandless)
    got = near_copies.representatives(documents(texts.items()))
    assert rows_of(got, "doc_id") == sorted([(k,) for k in set(label.values())], key=repr)


# ---- 5: language --------------------------------------------------------------------------------


def test_language_mixtures(documents):
    r = random.Random(8)
    kinds = {"xx": WORDS[:7], "yy": WORDS[7:14], "zz": WORDS[13:]}

    def text(lang, n):
        return " ".join("".join(r.choices(kinds[lang], k=3)) for _ in range(n))

    train = documents([(i, text(lang, 60), lang) for lang in kinds for i in range(20)])
    cases = [(1, text("xx", 40), None), (2, text("yy", 60) + " " + text("zz", 30), None), (3, None, None), (4, "12 !?", None), (None, text("zz", 9), None), (6, "", "xx")]
    got = {x["doc_id"]: x for x in op5_language.identify(documents(cases), train).collect()}
    assert got[1]["lang_pred"] == "xx" and got[1]["languages"] == ["xx"] and got[1]["score"] == 1
    assert got[2]["lang_pred"] == "yy" and sorted(got[2]["languages"]) == ["yy", "zz"] and abs(got[2]["score"] - 2 / 3) < 0.1
    assert [got[k]["lang_pred"] for k in (3, 4, 6)] == ["und"] * 3 and got[3]["score"] == 0
    assert got[None]["lang_pred"] == "zz"
    assert {x["lang_pred"] for x in op5_language.identify(documents(cases), train.limit(0)).collect()} == {"und"}
    assert op5_language.identify(documents(cases).limit(0), train).count() == 0


def test_language_held_out(spark, sf):
    from framemetry.llm import QUERIES

    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op5_language"](spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    import zlib

    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)


def test_pipeline_keeps_texts_of_three_languages(spark, documents):
    r = random.Random(19)
    kinds = {"xx": WORDS[:7], "yy": WORDS[7:14], "zz": WORDS[13:]}

    def text(lang, n):
        return " ".join("".join(r.choices(kinds[lang], k=3)) for _ in range(n))

    rows = [(i * 3 + k, text(lang, 60), lang) for k, lang in enumerate(kinds) for i in range(30)]
    mixed = text("xx", 80) + " " + text("yy", 70) + " " + text("zz", 50)
    docs = documents([*rows, (1000, mixed, None), (1001, "12 !?", None)])
    found = op5_language.identify(docs, docs.where(~op5_language.held_out())).where("doc_id = 1000").first()
    assert found["score"] < 0.5 and len(found["languages"]) == 3
    assert {x["doc_id"] for x in corpus_pipeline.language(spark, docs, "").collect()} == {*range(90), 1000}


# ---- 6: line windows ----------------------------------------------------------------------------


def test_line_windows(documents):
    a = "one\ntwo\n\nthree\nfour"
    docs = documents([(1, a), (2, "x\none\ntwo\nthree\ny"), (3, "one\ntwo"), (4, None), (5, ""), (None, "two\nthree\nfour"), (6, "p\np\np\np\np"), (2, "x\none\ntwo\nthree\ny")])
    got = op6_lines.dedup_lines(docs, "cut")
    assert got.columns == [*docs.columns, "cut"]
    assert rows_of(got, "doc_id", "text") == sorted(
        [(1, a), (2, "x\ny"), (2, "x\ny"), (3, "one\ntwo"), (4, None), (5, ""), (None, ""), (6, "p")], key=repr
    )
    assert op6_lines.dedup_lines(docs.limit(0)).count() == 0


# ---- 7: units -----------------------------------------------------------------------------------


def test_units(documents):
    r = random.Random(9)
    p, q = prose(r, 55), prose(r, 55)
    short = prose(r, 10)
    inside = f"Two words {p[:-1]}. And so. {q} more after it"
    docs = documents([
        (4, f"Head.\n{p}"), (2, f"{p.upper()}!\nTail."), (7, f"{q}\nmid\n{q}"), (8, short), (9, short), (None, q),
        (9, None), (10, ""), (4, f"Head.\n{p}"), (11, f"{p} {q}"), (12, inside),
    ])
    got = rows_of(op7_units.repeats(docs), "_id", "start", "stop", "n_words", "kept_doc_ids")
    n, m = len(p), len(q)
    at = inside.index(q) - 1
    assert got == sorted(
        [(4, 6, 6 + n, 55, [2]), (7, m + 5, 2 * m + 5, 55, [7]), (None, 0, m, 55, [7]), (11, 0, n + m + 1, 110, [2, 7]), (12, at, at + m + 1, 55, [7])],
        key=repr,
    )
    clean = {(x["doc_id"], x["text"]) for x in op7_units.without_passages(docs).collect()}
    assert {(4, "Head.\n"), (7, f"{q}\nmid\n"), (None, ""), (2, f"{p.upper()}!\nTail."), (9, short), (9, None), (10, ""), (11, ""),
            (12, inside[:at] + " more after it")} <= clean
    assert op7_units.repeats(docs.limit(0)).count() == 0


def test_every_later_line_goes(documents):
    """Whole lines of any length as units, against brute force: nothing is left of a line but its earliest place."""
    r = random.Random(29)
    pool = [prose(r, r.randint(1, 30)) for _ in range(40)] + ["...", "", "One", "one!", "中文 行"]
    rows = [(k, "\n".join(r.choices(pool, k=r.randint(0, 8)))) for k in range(60)] + [(None, "\n".join(pool)), (70, None)]
    seen, want, left = {}, [], {}
    for k, text in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        at, runs, last, number = 0, [], None, 0
        for line in (text or "").split("\n"):
            words = op7_units._TOKENS.findall(line.lower())
            if words:
                first = seen.setdefault(" ".join(words), (k, at))
                if first != (k, at):
                    if last == number - 1 and runs:
                        runs[-1][1:] = [at + len(line), runs[-1][2] + 1, runs[-1][3] + len(words)]
                    else:
                        runs.append([at, at + len(line), 1, len(words)])
                    last = number
                number += 1
            at += len(line) + 1
        want += [(k, *run) for run in runs]
        cut, at = "", 0
        for a, z, *_ in runs:
            cut, at = cut + (text or "")[at:a], z
        left[k] = cut + (text or "")[at:] if text is not None else None
    docs = documents(rows)
    got = op7_units.repeats(docs, op7_units.WHOLE_LINES)
    assert rows_of(got, "_id", "start", "stop", "n_units", "n_words") == sorted(want, key=repr) and len(want) > 40
    clean = op7_units.without_passages(docs, op7_units.WHOLE_LINES)
    assert {x["doc_id"]: x["text"] for x in clean.collect()} == left
    again = op7_units.repeats(clean.drop("removed"), op7_units.WHOLE_LINES)
    assert again.count() == 0


# ---- 8: benchmark -------------------------------------------------------------------------------


def bm25(passage: list[str], item: list[str], items: list[list[str]]) -> float:
    """By the formula, divided by the score of the item against itself."""
    mean, out = sum(map(len, items)) / len(items), [0.0, 0.0]
    for t in set(item):
        n = sum(t in i for i in items)
        tf = item.count(t)
        s = np.log(1 + (len(items) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(item) / mean))
        out[1] += s
        out[0] += s * (t in passage)
    return out[0] / out[1]


def test_retrieval_against_all_scores():
    r = random.Random(10)
    items = [prose(r, r.randint(8, 40)) for _ in range(60)]
    words = [op8_benchmark.tokens(i) for i in items]
    frequency = Counter(w for i in words for w in set(i))
    index = op8_benchmark.Index([(k, w, []) for k, w in enumerate(words)], 60, sum(map(len, words)) / 60, frequency)
    for _ in range(60):
        passage = op8_benchmark.tokens(" ".join(r.choices(items, k=2)) if r.random() < 0.7 else prose(r, 100))
        r.shuffle(passage)
        passage = passage[: r.randint(10, 80)]
        terms = sorted({index.term[w] for w in passage if w in index.term})
        want = {k: bm25(passage, w, words) for k, w in enumerate(words)}
        got = dict(index.retrieve(terms))
        assert set(got) == {k for k, s in want.items() if s >= op8_benchmark.THRESHOLD - 1e-9}
        assert all(abs(want[k] - s) < 1e-9 for k, s in got.items())
        pairs = np.zeros(len(terms), np.int64), np.array(terms, np.int64)
        assert not got or index.hopeful(*pairs, 1)[0]


def test_matches_against_shingles(spark, documents, monkeypatch):
    r = random.Random(11)
    items = [(k, prose(r, r.randint(15, 60))) for k in range(20)] + [(None, prose(r, 20)), (30, None), (31, ""), (32, "too short"), (33, "What is that thing over there now? Answer: some blue kite"), (34, "哪个城市是首都"), (35, "zyxw"), (36, "Qqq? Answer: pp oo")]
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, score int")
    docs = [(k, prose(r, 400)) for k in range(30)]
    for k in range(0, 30, 3):
        cut = docs[k][1].split(" ")
        at = r.randrange(len(cut))
        docs[k] = (k, " ".join(cut[:at] + [items[k % 21][1].upper()] + cut[at:]))
    docs += [(100, "What is that thing over there now? It was some blue kite."), (101, "What is that thing over there now? Nobody knows."), (102, None), (103, ""), (0, docs[0][1])]
    docs += [(104, "前文哪个城市是首都后文"), (105, "哪个城市不是首都"), (106, prose(r, 300) + " Zyxw. " + prose(r, 300)), (107, "qqq pp oo"), (108, "qqq pp x oo")]
    want = set()
    for d, text in docs:
        for i, item in items:
            q, a = op8_benchmark.parts(item or "")
            words = op8_benchmark.tokens(text)
            grams = op8_benchmark.shingles(words)
            if q + a and op8_benchmark.overlap(q, words, grams) >= 0.8 and op8_benchmark.overlap(a, words, grams) >= 0.8:
                want.add((d, i))
    assert {(104, 34), (106, 35), (107, 36)} <= want and not {d for d, _ in want} & {105, 108}
    frame = documents(docs)
    assert {(x["doc_id"], x["item_id"]) for x in op8_benchmark.matches(frame, bench).collect()} == want and len(want) >= 11
    clean = op8_benchmark.without_items(frame, bench)
    assert clean.columns == frame.columns
    assert rows_of(clean, "doc_id") == sorted([(d,) for d, _ in docs if d not in {x for x, _ in want}], key=repr)
    monkeypatch.setattr(op8_benchmark, "SHARD_WORDS", 200)
    assert {(x["doc_id"], x["item_id"]) for x in op8_benchmark.matches(frame, bench).collect()} == want
    assert op8_benchmark.matches(frame.limit(0), bench).count() == 0
    assert op8_benchmark.matches(frame, bench.limit(0)).count() == 0


def test_groups_of_passages(monkeypatch):
    """Small groups find what one group finds, and hold a bounded number of passages."""
    r = random.Random(23)
    items = [op8_benchmark.tokens(prose(r, r.randint(3, 40))) for _ in range(40)]
    frequency = Counter(w for i in items for w in set(i))
    index = op8_benchmark.Index([(k, w, []) for k, w in enumerate(items)], 40, sum(map(len, items)) / 40, frequency)
    texts = [[], ["one"], *[op8_benchmark.tokens(prose(r, 900)) + items[k] + op8_benchmark.tokens(prose(r, r.randint(0, 2000))) for k in range(12)]]
    whole = sorted(index.search(texts))
    assert {(m[0], m[1]) for m in whole} >= {(k + 2, k) for k in range(12)}
    monkeypatch.setattr(op8_benchmark, "GROUP", 1)
    assert sorted(index.search(texts)) == whole
    groups = list(index.groups(texts))
    assert all(sum(to - at for _, at, to in g) <= 16 for g in groups)
    assert sum(to - at for g in groups for _, at, to in g) == sum(max(1, -(-len(t) // index.half) - 1) for t in texts)


def test_words_of_scripts_without_spaces():
    assert op8_benchmark.tokens("Das ist 3.5 中文ok ไทย\nX_y") == ["das", "ist", "3", "5", "中", "文", "ok", "ไ", "ท", "ย", "x", "y"]


def test_long_items_are_verified_whole(documents, spark):
    """A document with a piece of a long item is no match; one with the whole item is, once."""
    r = random.Random(21)
    reading = " ".join(prose(r, 1500).replace(".", "").split())
    item = f"{reading} what is it? {prose(r, 20)}"
    words = item.split()
    docs = documents([(1, " ".join(words[:600])), (2, prose(r, 300) + " " + item), (3, " ".join(words[: len(words) - 22])), (4, item + " " + item)])
    bench = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    got = rows_of(op8_benchmark.matches(docs, bench), "doc_id", "item_id", "question_overlap", "answer_overlap")
    assert got == [(2, 7, 1.0, 1.0), (4, 7, 1.0, 1.0)]
    assert rows_of(op8_benchmark.without_items(docs, bench), "doc_id") == [(1,), (3,)]


# ---- 9: mixing ----------------------------------------------------------------------------------


def test_mix(documents, spark):
    r = random.Random(12)
    rows = [(i, prose(r, r.randint(1, 60)), "en", r.choice(["a", "b", "b", "c", "d", None])) for i in range(800)]
    rows += [(900, None, "en", "a"), (None, "one two", "en", "b"), (1, rows[1][1], "en", rows[1][3]), (901, "", "en", "zero")]
    docs = documents(rows)
    labels = spark.createDataFrame([(1, 1.0), (2, 0.5)], "doc_id bigint, weight double")
    got = op9_mixing.mix(docs, labels).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        assert x["size"] == len((x["text"] or "").encode().split()) and 0 <= x["copies"] <= 2
        by.setdefault(x["source"], []).append(x)
    sizes = {s: sum(x["size"] for x in v) for s, v in by.items()}
    # share again by weight until none is above its stop
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    for s, v in by.items():
        assert {x["source_size"] for x in v} == {sizes[s]} and abs(v[0]["target"] - target[s]) < 1e-6
        assert abs(sum(x["size"] * x["copies"] for x in v) - target[s]) <= max(x["size"] for x in v) / 2
    again = op9_mixing.mix(docs.repartition(5), labels).collect()
    assert Counter((x["doc_id"], x["size"], x["copies"]) for x in got) == Counter((x["doc_id"], x["size"], x["copies"]) for x in again)
    assert op9_mixing.mix(docs.limit(0), labels).count() == 0
    whole = op9_mixing.mixed_rows(documents(rows[:300]), labels).collect()
    assert sum(x["copies"] * x["size"] for x in whole) > 0


# ---- 10: suffixes -------------------------------------------------------------------------------


def brute_bytes(texts):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for d in data:
        seen.update(d[i : i + 200] for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        runs = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def suffix_texts():
    r = random.Random(13)
    shared = prose(r, 80)
    base = prose(r, 300)
    texts = [None, "", "short", base, base, "Is " * 200, "Is " * 150 + "at " * 90, "é" * 300, prose(r, 5000)]
    for _ in range(25):
        words = base.split(" ")
        words[r.randrange(len(words))] = "edit"
        texts.append(" ".join(words[: r.randint(150, 300)]))
        at = r.randrange(0, 60)
        texts.append(prose(r, 40) + shared[at : at + r.randint(190, 330)] + prose(r, 30))
    return texts


@pytest.mark.parametrize("crowd", [2, 2048])
def test_repeated_bytes(documents, monkeypatch, crowd):
    monkeypatch.setattr(op10_suffix, "CROWD", crowd)
    texts = suffix_texts()
    docs = documents([(i if i else None, t) for i, t in enumerate(texts)])
    got = {x["doc_id"] or 0: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in op10_suffix.repeated_bytes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_bytes(texts)
    assert op10_suffix.repeated_bytes(docs.limit(0)).count() == 0


def test_suffix_order_is_byte_order():
    r = random.Random(14)
    raw = np.frombuffer("".join(r.choices("ab", k=3000)).encode() + b"ab" * 800, np.uint8)
    prefix = op10_suffix.Prefix(raw)
    start = np.array(r.sample(range(len(raw) - 200), 700))
    group = np.sort(np.array([r.randrange(5) for _ in start]))
    order = op10_suffix.sort_suffixes(prefix, raw, prefix.at(start, 200), start, group)
    got = [(group[i], raw[start[i] : start[i] + 200].tobytes()) for i in order]
    assert got == sorted(got)


def test_hash_collisions_are_verified(monkeypatch):
    """With a hash that cannot tell pieces apart, the bytes decide."""
    r = random.Random(15)
    a, b = (prose(r, 90).encode()[:260] for _ in range(2))
    monkeypatch.setattr(op10_suffix, "_CODES", np.zeros(256, np.uint64))
    op10_suffix._powers.cache_clear()
    place = np.array([60 << 8 | 90] * 3)
    piece, window = op10_suffix.repeated(np.array([1, 1, 1]), place, [a, b, a])
    assert sorted(set(piece.tolist())) == [0, 2] and len(window) == 122


def test_long_texts_are_hashed_in_pieces():
    r = random.Random(16)
    text = prose(r, 9000).encode()
    whole = op10_suffix.anchors([text])
    assert len(whole[0]) > 100 and (whole[3] + 1).sum() == len(text) - 199
