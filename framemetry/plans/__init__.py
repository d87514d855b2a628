"""Queries: operators bound to the driver tables, each with the equivalent SQL where one exists."""

from framemetry.plans import (  # noqa: F401  (import registers the queries)
    classification,
    frames,
    nulls,
    runs,
    scale,
    splits,
    statistics,
    streams,
    tables,
    tiles,
)
from framemetry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
