"""Line-first quality rules.

Every line of a text that has a word is tried against three rules; lines that fail are dropped, and a
document that loses too much of its text that way is rejected.

* punctuation: no sentence ends in the line, inside or at its end, or symbols stand in place of text
  (``SYMBOLS`` more often than one in five words);
* navigation: separators (``|``, ``>``, ``»``, ``•``, ``·``) stand between its words, one for every three words or
  more, or the line is a bare link;
* boilerplate: it holds a fixed phrase of web furniture and is no longer than a furniture line.

Cases: a null text counts as no words (kept is false); an empty text likewise. Null ids and repeated
rows are kept as they come, one result row per input row. An empty table gives an empty result. Other
columns of the input are ignored. Text is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framemetry.llm.common import SPACE, slices, table
from framemetry.llm.registry import query

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
ENDINGS = ".!?…:;\"'”’»)]。！？"
SEPARATORS = "|>»•·"
PHRASES = (
    "all rights reserved|accept cookies|cookie policy|privacy policy|terms of use|terms of service"
    "|javascript is disabled|enable javascript|subscribe to our newsletter|sign up for|log in to"
    "|share on facebook|follow us on|click here|read more|skip to content|back to top|lorem ipsum"
)
BOILERPLATE_WORDS = 40  # longer lines are prose that happens to hold a phrase
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 50

_ENDING = tuple(ENDINGS)
_PHRASE = re.compile(PHRASES, re.IGNORECASE)
_INSIDE = re.compile("[.!?…。！？] ")
_LINK = re.compile(r"(https?://|www\.)\S+")

COLUMNS = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
    "n_repeat_words bigint, base_failed boolean, kept boolean, n_lines bigint, n_bad_punctuation bigint, "
    "n_navigation bigint, n_boilerplate bigint, lost_chars bigint"
)


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    seen: set = set()
    add = seen.add
    again = {w for w in windows if w in seen or add(w)}
    if not again:
        return 0
    covered = np.zeros(n + 2, bool)
    at = np.fromiter((w in again for w in windows), bool, n)
    for shift in range(3):
        covered[shift : shift + n] |= at
    return int(covered.sum())


def line_rules(line: str) -> tuple[bool, bool, bool]:
    """(punctuation, navigation, boilerplate): which rules the stripped line fails."""
    words = len(line.encode().split())
    symbols = sum(line.count(c) for c in SYMBOLS)
    separators = sum(line.count(c) for c in SEPARATORS)
    return (
        not (line.endswith(_ENDING) or _INSIDE.search(line)) or symbols * 5 > words,
        (separators > 1 and separators * 3 >= words - separators) or _LINK.fullmatch(line) is not None,
        words <= BOILERPLATE_WORDS and _PHRASE.search(line) is not None,
    )


def measure(text: str | None) -> tuple:
    """The result columns after doc_id, for one whole text."""
    text = text or ""
    words = text.encode().split()
    n_words = len(words)
    word_chars = len(text) - sum(text.count(c) for c in SPACE)
    lines = [s for s in ((x, x.strip(SPACE)) for x in text.split("\n")) if s[1]]
    dup_lines = len(lines) - len({x for x, _ in lines})
    repeats = repeat_words(words)
    base_failed = n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n_words
    counts, lost = [0, 0, 0], 0
    for _, line in lines:
        failed = line_rules(line)
        if any(failed):
            lost += len(line) - sum(line.count(c) for c in SPACE)
            for i, f in enumerate(failed):
                counts[i] += f
    kept = not base_failed and 100 * lost <= MAX_LOST_PERCENT * word_chars
    symbols = sum(text.count(c) for c in SYMBOLS)
    return (n_words, word_chars, symbols, dup_lines, repeats, base_failed, kept, len(lines), *counts, lost)


def clean_text(text: str | None) -> str | None:
    """The text without the lines that fail a rule; blank lines stay."""
    if text is None:
        return None
    return "\n".join(x for x in text.split("\n") if not x.strip(SPACE) or not any(line_rules(x.strip(SPACE))))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ids = batch.column(0)
        out = list(zip(*[measure(t.as_py()) for t in batch.column(1)]))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 5
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), *[pa.array(c, k) for c, k in zip(out, kinds)]], names=names
        )


def quality(docs: DataFrame) -> DataFrame:
    """Signals and verdict per row of ``docs`` (doc_id, text); no shuffle, one pass."""
    return docs.select("doc_id", "text").mapInArrow(_rows, COLUMNS)


def _sql() -> str:
    """The same rules in SQL; doc_id must be a key there."""
    quote = lambda s: s.replace("'", "''")
    symbols = f"length(regexp_replace({{0}}, '[^{SYMBOLS}]', '', 'g'))"
    endings = "[" + quote(ENDINGS).replace("]", "\\]") + "]$"
    space = "[\\x20\\x09-\\x0D]"
    seps = f"length(regexp_replace(s, '[^{SEPARATORS}]', '', 'g'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, list_filter(string_split_regex(text, '{space}+'), lambda x: x <> '') AS w, text FROM d),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
stripped AS (SELECT doc_id, line, regexp_replace(line, '^{space}+|{space}+$', '', 'g') AS s FROM lines),
ruled AS (
  SELECT doc_id, line, s, n,
    NOT (regexp_matches(s, '{endings}') OR regexp_matches(s, '{_INSIDE.pattern}')) OR {symbols.format('s')} * 5 > n AS p,
    (seps > 1 AND seps * 3 >= n - seps) OR regexp_full_match(s, '(https?://|www\\.)\\S+') AS v,
    n <= {BOILERPLATE_WORDS} AND regexp_matches(s, '{PHRASES}', 'i') AS b
  FROM (SELECT *, {seps} AS seps, len(string_split_regex(s, '{space}+')) AS n FROM stripped WHERE s <> '')),
byline AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (p) AS n_bad_punctuation, count(*) FILTER (v) AS n_navigation,
    count(*) FILTER (b) AS n_boilerplate,
    coalesce(sum(length(regexp_replace(s, '{space}', '', 'g'))) FILTER (p OR v OR b), 0)::BIGINT AS lost_chars
  FROM ruled GROUP BY doc_id),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM words WHERE len(w) > 2),
win3 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM win),
rep AS (SELECT doc_id, count(DISTINCT i + o)::BIGINT AS n FROM win3, (VALUES (0), (1), (2)) AS t(o)
        WHERE c > 1 GROUP BY doc_id),
base AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{space}', '', 'g'))::BIGINT AS word_chars,
    {symbols.format('text')}::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_bad_punctuation, 0)::BIGINT AS n_bad_punctuation, coalesce(n_navigation, 0)::BIGINT AS n_navigation,
    coalesce(n_boilerplate, 0)::BIGINT AS n_boilerplate, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM words LEFT JOIN byline USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
    AND 100 * lost_chars <= {MAX_LOST_PERCENT} * word_chars AS kept
FROM base"""


@query("op1_quality", _sql())
def op1_quality(spark, sf):
    return quality(table(spark, sf, "documents"))
