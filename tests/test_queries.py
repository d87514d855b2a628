"""Every query against its SQL on the smallest tables; queries without SQL must return rows."""

from __future__ import annotations

import pytest

from framemetry.plans import ORACLES, QUERIES
from oracle import compare, connect

# On the smallest tables these find nothing to report.
MAY_BE_EMPTY = {"scan_path_leaks"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    if name in ORACLES:
        ok, note = compare(spark, con, QUERIES[name], ORACLES[name], sf)
        assert ok, note
    else:
        assert name in MAY_BE_EMPTY or QUERIES[name](spark, sf).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
