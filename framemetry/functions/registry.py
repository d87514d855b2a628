"""The same expressions for SQL users, as temporary SQL functions of the session.

The scalar functions are expanded into the query's plan and cost what the written-out expression costs;
``tile_grid`` is a table function in Python, of a few rows per frame.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

_SCALAR = {
    "clamp01(v DOUBLE) RETURNS DOUBLE": "CASE WHEN isnan(v) THEN v ELSE greatest(0D, least(1D, v)) END",
    "psnr(mse DOUBLE) RETURNS DOUBLE": "CASE WHEN mse <= 0 THEN 99D ELSE -10 * log10(mse + 1e-12D) END",
    "slug(s STRING) RETURNS STRING": "lower(trim(BOTH '_' FROM regexp_replace(s, '[^a-zA-Z0-9]+', '_')))",
    # NULL above max_n units; 2^(max_n - 1) sums are held at once
    "sign_flip_p(deltas ARRAY<DOUBLE>, max_n INT DEFAULT 20) RETURNS DOUBLE": """
      CASE WHEN size(deltas) > max_n THEN NULL
           WHEN size(deltas) > 0 THEN
             aggregate(
               aggregate(slice(array_sort(deltas), 2, greatest(size(deltas) - 1, 0)),
                         array(element_at(array_sort(deltas), 1)),
                         (acc, v) -> concat(transform(acc, s -> s + v), transform(acc, s -> s - v))),
               0D,
               (hits, s) -> hits + CASE WHEN abs(s) >=
                 abs(aggregate(array_sort(deltas), 0D, (a, v) -> a + v)) * (1 - 1e-12D) - 1e-15D * size(deltas)
                 THEN 1 ELSE 0 END)
             / shiftleft(1, size(deltas) - 1)
      END""",
}

class TileGrid:
    """Table function: one row per tile. SELECT ... FROM frames, LATERAL tile_grid(h, w, tile, overlap)"""

    def eval(self, h: int, w: int, tile: int, overlap: int):
        if None in (h, w, tile, overlap):
            return
        for top in range(0, h, tile - overlap):
            for left in range(0, w, tile - overlap):
                yield top, left


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for head, body in _SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("tile_grid", udtf(TileGrid, returnType="top INT, left INT"))
    return [*[head.split("(")[0] for head in _SCALAR], "tile_grid"]


def register_criterion(spark: SparkSession, name: str, fn: Callable[..., float]) -> None:
    """Make a criterion of the caller's own an SQL aggregate: ``SELECT k, name(a, b) FROM t GROUP BY k``.

    ``fn`` gets the values of a group as one array per argument, NULLs as not-a-number, and gives one number. A
    group is held by one task, as numbers only, so groups should be of the size of a frame or a run; scores of a
    whole table are means of scores of such groups.
    """

    def aggregate(*values: pd.Series) -> float:
        return float(fn(*[np.asarray(v, float) for v in values]))

    # the kind of a function over groups is read from its hints
    two = aggregate

    def criterion(first: pd.Series, *more: pd.Series) -> float:
        return two(first, *more)

    spark.udf.register(name, pandas_udf(criterion, "double", 202))
