"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is read as a sequence of leaf blocks: the text between block-level tags, with the tags, classes
and ids it stands in. Each block has features of its ancestors and of its text; the field weighs them and
the change from block to block, and Viterbi's algorithm decodes which blocks are main text. The field is
trained by gradient ascent on the likelihood of labelled pages, ``labelled_pages``: pages of varied
layouts whose blocks are known to be article or not, written by a generator of ``PAGES`` pages.

Character references are decoded, white space inside a block becomes one space, and main blocks are
joined in page order by an empty line. Scripts, styles, comments and hidden parts are never blocks.

Cases: a null or empty html, or a page without main text, gives an empty string. Tags that are never
closed, or closed twice, do not matter. Null ids and urls come back as null, repeated rows each give a
row, other columns are ignored, an empty table gives an empty result. Pages of any length are read whole.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framemetry.llm.common import slices, table
from framemetry.llm.registry import query

PAGES = 400
ROUNDS = 150
RIDGE = 0.02

# Names of tags and the words that class and id names use for parts of a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary "
    "table tbody td textarea tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script|style|noscript|template|svg|iframe|object|canvas|math"
ANCESTORS = (
    "article main section nav header footer aside form ul ol table td blockquote figure head button select dialog menu "
    "address title label textarea details".split()
)
HINTS = {
    "content": "content article post entry story main body text prose copy page",
    "comment": "comment comments reply replies discussion disqus respond thread",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs links skip",
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion banner",
    "side": "sidebar side aside widget related recommended rail trending popular more",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe gdpr disclaimer warning message",
    "foot": "footer foot copyright colophon legal bottom",
    "head": "header masthead logo brand topbar top",
    "share": "share sharing social follow",
    "form": "form search login signup register",
}
_HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SKIPPED})\b(?:[^\"'>]|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*|[^>]*)>|<[!?][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|\shidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_PART = re.compile(r"[a-z]+")


class Element:
    """An open element: its tag, and the features that it and its ancestors give to blocks inside."""

    __slots__ = ("tag", "inside", "hidden", "own")

    def __init__(self, tag: str, attributes: str, above: Element | None):
        self.tag = tag
        names: set[str] = set()
        for found in _NAMES.findall(attributes) if attributes else ():
            for part in _PART.findall("".join(found).lower()):
                if part in _HINT:
                    names.add(_HINT[part])
        if tag in ("body", "html"):
            names.clear()
        own = {f"hint {n}" for n in names}
        if tag in ANCESTORS:
            own.add(f"in {tag}")
        self.own = {f"own {n}" for n in names}
        self.inside = above.inside | own if above else frozenset(own)
        self.hidden = bool(above and above.hidden) or bool(attributes and _HIDDEN.search(attributes))


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: Element, linked: int):
        self.text, self.element, self.linked = text, element, linked


def blocks(html: str) -> list[Block]:
    """Leaf blocks with text, in page order."""
    out: list[Block] = []
    stack = [Element("", "", None)]
    pieces: list[str] = []
    linked, in_link, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            holder = next((e for e in reversed(stack) if e.tag in BLOCK_TAGS), stack[0])
            if text and not holder.hidden:
                out.append(Block(text, holder, linked))
            pieces.clear()
        linked = 0

    for m in _TAG.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            pieces.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag in BLOCK_TAGS:
                flush()
            if tag == "a":
                in_link = 0
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK_TAGS:
            flush()
            in_link = in_link if tag not in ("p", "li", "div") else 0
            closes = _CLOSES.get(tag)
            if closes:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in closes:
                        del stack[i:]
                        break
                    if stack[i].tag in BLOCK_TAGS:
                        break
        elif tag == "br":
            pieces.append(" ")
        if tag not in VOID_TAGS:
            if tag == "a":
                in_link = 1
            stack.append(Element(tag, m.group(4), stack[-1]))
    if at < len(html):
        pieces.append(html[at:])
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of the features of each block."""
    has = {f"page {t}" for t in ("article", "main") if any(f"in {t}" in b.element.inside for b in page)}
    content = any("hint content" in b.element.inside for b in page)
    out = []
    for b in page:
        text, words = b.text, b.text.count(" ") + 1
        link = min(1.0, b.linked / max(1, len(text)))
        names = ["bias", f"tag {b.element.tag if b.element.tag in BLOCK_TAGS else 'other'}", *b.element.inside, *b.element.own]
        names.append("words " + ("1" if words < 2 else "4" if words < 5 else "10" if words < 11 else "25" if words < 26 else "60" if words < 61 else "more"))
        names.append("linked " + ("none" if link < 0.05 else "some" if link < 0.4 else "most" if link < 0.85 else "all"))
        if text.rstrip("\"'”’)»")[-1:] in ".!?…。":
            names.append("sentence")
        if "©" in text:
            names.append("rights")
        if "|" in text or "»" in text or "›" in text:
            names.append("separator")
        for h in has:
            if f"in {h[5:]}" not in b.element.inside:
                names.append("outside " + h[5:])
        if content and "hint content" not in b.element.inside:
            names.append("outside content")
        out.append(names)
    return out


# ---- labelled pages ------------------------------------------------------------------------------

_SYLLABLES = "ka lo mi ren tu sha vel dor pa is en qu ar tion ber che na ul gri som".split()


class _Writer:
    """Writes one page; ``main`` collects the first words of main blocks."""

    def __init__(self, r: random.Random):
        self.r, self.main, self.serial = r, set(), 0

    def words(self, n: int) -> str:
        r = self.r
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n))

    def text(self, low: int, high: int, main: bool, end: str | None = None) -> str:
        self.serial += 1
        first = f"Z{self.serial}q"
        if main:
            self.main.add(first)
        end = end if end is not None else self.r.choice([".", ".", ".", ".", "!", "?", ""])
        body = self.words(self.r.randint(low, high))
        if self.r.random() < 0.15:
            body = " ".join(w + self.r.choice(["", "&amp;&amp;&amp;", "###", "%%%"]) for w in body.split())
        return f"{first} {body}{end}"

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{i}">{self.text(0, 3, False, "")}</a></{tag}>' for i in range(n))

    def paragraphs(self, n: int, main: bool, tag: str = "p") -> str:
        out = []
        for _ in range(n):
            low = self.r.choice([2, 5, 12, 30])
            body = self.text(low, low + self.r.choice([5, 40, 100]), main)
            if self.r.random() < 0.15:
                cut = body.split(" ")
                k = self.r.randrange(1, len(cut))
                cut[k] = f'<a href="/x">{cut[k]}</a>'
                body = " ".join(cut)
            out.append(f"<{tag}><b>{body}<br>" if self.r.random() < 0.1 and tag == "p" else f"<{tag}>{body}</{tag}>")
        return "".join(out)

    def chrome(self, kind: str) -> str:
        t, r = self.text, self.r
        if kind == "nav":
            return f'<nav><ul>{self.links(r.randint(3, 8))}</ul></nav>'
        if kind == "menu":
            return f'<div class="{r.choice(["menu", "navbar", "main-nav"])}">{self.links(r.randint(3, 8), "span")}</div>'
        if kind == "header":
            return f'<header><div class="logo">{t(0, 2, False, "")}</div>{r.choice(["", f"<p>{t(3, 8, False)}</p>"])}<ul>{self.links(4)}</ul></header>'
        if kind == "head":
            return f'<div id="{r.choice(["header", "masthead", "top"])}"><h2>{t(1, 3, False, "")}</h2><p>{t(3, 10, False)}</p></div>'
        if kind == "ad":
            return f'<div class="{r.choice(["ad", "ads", "advert", "ad-slot", "sponsored", "promo banner"])}">{t(3, 30, False)}</div>'
        if kind == "cookie":
            return f'<div {r.choice(["class", "id"])}="{r.choice(["cookie", "cookie-banner", "notice", "consent", "alert", "popup"])}"><p>{t(5, 30, False)}</p><button>{t(0, 2, False, "")}</button></div>'
        if kind == "aside":
            return f'<aside><h3>{t(0, 3, False, "")}</h3>{r.choice([f"<ul>{self.links(4)}</ul>", self.paragraphs(2, False)])}</aside>'
        if kind == "side":
            return f'<div class="{r.choice(["sidebar", "widget", "related", "right-rail", "trending"])}"><h3>{t(0, 3, False, "")}</h3>{r.choice([f"<ul>{self.links(4)}</ul>", self.paragraphs(2, False)])}</div>'
        if kind == "form":
            return f'<form action="/s"><label>{t(0, 3, False, "")}</label><input name="q"><button>{t(0, 1, False, "")}</button>{r.choice(["", f"<p>{t(4, 20, False)}</p>"])}</form>'
        if kind == "letter":
            return f'<div class="{r.choice(["newsletter", "subscribe", "signup"])}"><p>{t(5, 25, False)}</p><form><input><button>{t(0, 1, False, "")}</button></form></div>'
        if kind == "share":
            return f'<div class="{r.choice(["share", "social"])}">{self.links(3, "span")}</div>'
        if kind == "crumbs":
            return f'<div class="breadcrumb"><a href="/">{t(0, 0, False, "")}</a> &gt; <a href="/a">{t(0, 1, False, "")}</a></div>'
        if kind == "comments":
            name = r.choice(["comments", "comment-list", "replies", "discussion"])
            each = "".join(
                r.choice([
                    f'<div class="comment"><b>{t(0, 1, False, "")}</b><p>{t(5, 80, False)}</p></div>',
                    f'<li class="comment"><p>{t(5, 80, False)}</p></li>',
                    f"<p>{t(5, 60, False)}</p>",
                ])
                for _ in range(r.randint(1, 5))
            )
            tag = r.choice(["div", "section", "ul", "aside"])
            return f'<{tag} {r.choice(["id", "class"])}="{name}"><h3>{t(0, 2, False, "")}</h3>{each}</{tag}>'
        if kind == "footer":
            return f'<footer>{r.choice(["&copy; ", ""])}{t(2, 20, False)} &middot; {t(2, 15, False)}</footer>'
        return f'<div class="{r.choice(["footer", "copyright", "legal"])}"><p>&copy; {t(2, 20, False)}</p></div>'

    def article(self) -> str:
        t, r = self.text, self.r
        out = [r.choice([f"<h1>{t(2, 9, True, '')}</h1>", f"<h1>{t(2, 9, True, '')}</h1>", ""])]
        for _ in range(r.choice([1, 2, 3, 5, 9])):
            kind = r.random()
            if kind < 0.6:
                out.append(self.paragraphs(r.randint(1, 3), True))
            elif kind < 0.67:
                out.append(f"<h2>{t(1, 6, True, '')}</h2>")
            elif kind < 0.73:
                out.append("<ul>" + "".join(f"<li>{t(3, 20, True)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.77:
                out.append(f"<blockquote>{t(5, 40, True)}</blockquote>")
            elif kind < 0.8:
                out.append(f"<table><tr><td>{t(1, 4, True, '')}</td><td>{t(1, 4, True, '')}</td></tr></table>")
            else:
                out.append(self.chrome(r.choice(["ad", "ad", "letter", "side", "aside", "share", "form"])))
        if r.random() < 0.25:
            out.append(self.chrome("comments"))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        body = r.choice([
            "<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>",
            '<div class="content">{}</div>', '<div id="content">{}</div>', '<div class="post-body">{}</div>',
            '<section class="story">{}</section>', '<div class="entry-content">{}</div>', "<div>{}</div>", "{}",
            "<table><tr><td>{}</td></tr></table>", '<div role="main"><div class="text">{}</div></div>',
        ]).format(self.article())
        before = r.sample(["nav", "menu", "header", "head", "ad", "cookie", "form", "crumbs", "side", "letter"], r.randint(1, 4))
        after = r.sample(["share", "aside", "side", "letter", "ad", "cookie"], r.randint(0, 3))
        after += ["comments"] * (r.random() < 0.35) + [r.choice(["footer", "foot", "footer"])] * (r.random() < 0.9)
        return (
            f"<!DOCTYPE html><html><head><title>{self.text(2, 9, False, '')}</title></head><body>"
            + "".join(map(self.chrome, before)) + body + "".join(map(self.chrome, after)) + "</body></html>"
        )


def labelled_pages(count: int = PAGES, seed: int = 5) -> Iterator[tuple[list[Block], list[bool]]]:
    """Pages as blocks, and for each block whether it is main text."""
    r = random.Random(seed)
    for _ in range(count):
        writer = _Writer(r)
        page = blocks(writer.page())
        yield page, [b.text.split(" ", 1)[0].lstrip("© ") in writer.main for b in page]


# ---- the field -------------------------------------------------------------------------------------


def _training_set(count: int):
    pages = [(features(p), y) for p, y in labelled_pages(count) if p]
    names = sorted({name for rows, _ in pages for row in rows for name in row})
    number = {name: i for i, name in enumerate(names)}
    longest = max(len(y) for _, y in pages)
    y = np.zeros((len(pages), longest), np.int64)
    size = np.array([len(labels) for _, labels in pages])
    x = np.zeros((size.sum(), len(names)), np.float32)
    for at, row in zip(x, (row for rows, _ in pages for row in rows)):
        at[[number[name] for name in row]] = 1
    for i, (_, labels) in enumerate(pages):
        y[i, : len(labels)] = labels
    return x, y, size, names


@lru_cache(maxsize=2)
def train(count: int = PAGES, rounds: int = ROUNDS) -> tuple[dict[str, float], list[list[float]]]:
    """(weight of each feature for main over not, log weights of the four changes)."""
    x, y, size, names = _training_set(count)
    (n, longest), f = y.shape, x.shape[1]
    real = np.arange(longest)[None, :] < size[:, None]
    weight, change = np.zeros(f), np.zeros((2, 2))
    empirical = x.T @ y[real].astype(np.float32)
    steps = real[:, 1:]
    pair = np.zeros((2, 2))
    np.add.at(pair, (y[:, :-1][steps], y[:, 1:][steps]), 1)
    moment, spread = np.zeros(f + 4), np.zeros(f + 4)
    for k in range(1, rounds + 1):
        node = np.zeros((n, longest, 2))
        node[real, 1] = x @ weight.astype(np.float32)
        ahead, back = np.zeros_like(node), np.zeros_like(node)
        ahead[:, 0] = node[:, 0]
        for t in range(1, longest):
            step = np.logaddexp(ahead[:, t - 1, 0, None] + change[0], ahead[:, t - 1, 1, None] + change[1]) + node[:, t]
            ahead[:, t] = np.where(real[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            into = node[:, t + 1] + back[:, t + 1]
            step = np.logaddexp(into[:, 0, None] + change[:, 0], into[:, 1, None] + change[:, 1])
            back[:, t] = np.where(real[:, t + 1, None], step, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        main = np.exp(ahead[..., 1] + back[..., 1] - total[:, None]) * real
        pairs = np.exp(
            ahead[:, :-1, :, None] + change + (node + back)[:, 1:, None, :] - total[:, None, None, None]
        ) * steps[..., None, None]
        gradient = np.concatenate([
            (empirical - x.T @ main[real].astype(np.float32)) / n - RIDGE * weight / 10,
            ((pair - pairs.sum((0, 1))) / n - RIDGE * change / 10).ravel(),
        ])
        moment = 0.9 * moment + 0.1 * gradient
        spread = 0.99 * spread + 0.01 * gradient**2
        move = 0.1 * (moment / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.99**k)) + 1e-8)
        weight, change = weight + move[:f], change + move[f:].reshape(2, 2)
    return dict(zip(names, weight.tolist())), change.tolist()


def decode(scores: list[float], change) -> list[bool]:
    """Viterbi: the best labelling of a page from the scores of main over not."""
    if not scores:
        return []
    best, back = (0.0, scores[0]), []
    for s in scores[1:]:
        from_no = (best[0] + change[0][0], best[1] + change[1][0])
        from_yes = (best[0] + change[0][1], best[1] + change[1][1])
        back.append((from_no[1] > from_no[0], from_yes[1] > from_yes[0]))
        best = (max(from_no), max(from_yes) + s)
    now = best[1] > best[0]
    out = [now]
    for step in reversed(back):
        now = step[now]
        out.append(now)
    return out[::-1]


def main_text(html: str | None, model) -> str:
    weight, change = model
    page = blocks(html or "")
    scores = [sum(weight.get(name, 0.0) for name in row) for row in features(page)]
    return "\n\n".join(b.text for b, keep in zip(page, decode(scores, change)) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html); no shuffle."""
    model = pages.sparkSession.sparkContext.broadcast(train())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            texts = [main_text(h.as_py(), model.value) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


@query("op2_html")
def op2_html(spark, sf):
    return extract(table(spark, sf, "pages"))
