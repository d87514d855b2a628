from __future__ import annotations

import pytest

NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, _k1 string, size string, _id int, _text string, h1 string, spans int, score int"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text[, lang[, source]]) as documents, with further columns of clashing names."""

    def make(rows):
        full = [
            (r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), "k", "s", 7, "t", "h", 1, 2)
            for r in rows
        ]
        return spark.createDataFrame(full, NAMES)

    return make
