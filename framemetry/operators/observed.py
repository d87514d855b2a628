"""Checks of a table while it is written: every rule is an observed metric, so all rules cost one pass.

The rules are aggregates that travel with the job that computes the table anyway (``observe``); no rule scans it
again. Violations come in the columns of ``checks``: (check, key, detail). A stream's rules are added up
over its micro-batches by a listener.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

VIOLATIONS = "check string, key string, detail string"


@dataclass(frozen=True)
class Rule:
    """Rows where ``bad`` holds violate it; ``shown`` is what an example of them shows."""

    check: str
    key: str
    bad: Column
    shown: Column


@dataclass(frozen=True)
class RowCount:
    """The table has ``n`` rows."""

    key: str
    n: int


def one_of(column: str, allowed: list) -> Rule:
    c = F.col(column)
    return Rule("values", column, c.isNull() | ~c.isin(allowed), F.coalesce(c.cast("string"), F.lit("NULL")))


def not_null(column: str) -> Rule:
    return Rule("not_null", column, F.col(column).isNull(), F.lit("NULL"))


def all_finite(column: str) -> Rule:
    c = F.col(column).cast("double")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return Rule("finite", column, bad, F.coalesce(c.cast("string"), F.lit("NULL")))


def between(column: str, low, high) -> Rule:
    c = F.col(column)
    return Rule("between", column, ~F.coalesce(c.between(low, high), F.lit(False)), F.coalesce(c.cast("string"), F.lit("NULL")))


def close(actual: str, published: str, tolerance: float, key: str) -> Rule:
    """Two columns of a table that was joined anyway agree; ``key`` names the rows."""
    a, b = F.col(actual).cast("double"), F.col(published).cast("double")
    apart = ~F.coalesce(F.abs(a - b) <= tolerance, a.isNull() & b.isNull())
    return Rule("close", f"{actual}:{published}", apart, F.col(key).cast("string"))


def _metrics(rules: list[Rule | RowCount]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    for i, rule in enumerate(rules):
        if isinstance(rule, Rule):
            out += [F.count_if(rule.bad).alias(f"n{i}"), F.min(F.when(rule.bad, rule.shown)).alias(f"example{i}")]
    return out


def _violations(rules: list[Rule | RowCount], found: dict) -> list[tuple[str, str, str]]:
    out = []
    for i, rule in enumerate(rules):
        if isinstance(rule, RowCount):
            if found["rows"] != rule.n:
                out.append(("row_count", rule.key, f"{found['rows']} rows, expected {rule.n}"))
        elif found[f"n{i}"]:
            out.append((rule.check, rule.key, f"{found[f'n{i}']} rows, such as {found[f'example{i}']}"))
    return out


def checked_write(df: DataFrame, rules: list[Rule | RowCount], write: Callable[[DataFrame], None]) -> DataFrame:
    """Writes ``df`` by ``write``, one job, and returns the violations that were seen on the way. The table is written
    whatever they are: the caller decides what to do with it."""
    watch = Observation("checks")
    write(df.observe(watch, *_metrics(rules)))
    return df.sparkSession.createDataFrame(_violations(rules, watch.get), VIOLATIONS)


class StreamChecks(StreamingQueryListener):
    """The rules of a stream: ``watch`` the stream, start it, and ask for ``violations`` at any time.

    Counts are added over micro-batches; a batch that is replayed counts once."""

    def __init__(self, spark: SparkSession, rules: list[Rule | RowCount], name: str = "checks"):
        self.rules, self.name, self.spark = rules, name, spark
        self.batches: dict[int, dict] = {}

    def watch(self, stream: DataFrame) -> DataFrame:
        self.spark.streams.addListener(self)
        return stream.observe(self.name, *_metrics(self.rules))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get(self.name)
        if seen is not None:
            self.batches[event.progress.batchId] = seen.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def found(self) -> dict:
        """The metrics of all micro-batches together."""
        out: dict = {"rows": 0}
        for seen in self.batches.values():
            for name, value in seen.items():
                if name.startswith("example"):
                    out[name] = min((v for v in (out.get(name), value) if v is not None), default=None)
                else:
                    out[name] = out.get(name, 0) + value
        return {**{f"n{i}": 0 for i, r in enumerate(self.rules) if isinstance(r, Rule)}, **out}

    def violations(self, query: StreamingQuery | None = None) -> DataFrame:
        """What was found so far; with an ended ``query``, after all its micro-batches were told of."""
        if query is not None:
            import time

            last = query.lastProgress
            for _ in range(200):
                if last is None or last.batchId in self.batches or last.numInputRows == 0:
                    break
                time.sleep(0.05)
        return self.spark.createDataFrame(_violations(self.rules, self.found()), VIOLATIONS)

    def stop(self) -> None:
        self.spark.streams.removeListener(self)
