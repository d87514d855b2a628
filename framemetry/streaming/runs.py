"""Streaming forms of the run-log operators.

The log of a run has one ordered writer. Rows are put in order inside each micro-batch; a row not newer than the
last one accepted is dropped and counted (``late_rows``), and so is one without a place (``null_rows``). On ordered
input the results equal those of the batch operators. State per run is a handful of numbers. Runs are hashed into
``PARTS`` parts, and the rows of a part come in chunks: up to ``HELD`` rows are put in order in memory; more wait in
the state store, in buckets of ``BUCKET`` places of a run, and are taken bucket by bucket, so a run may have any
number of rows in one micro-batch.

With ``idle`` (seconds), a run that wrote nothing for so long is closed by a timer of its part: it gives one more row
with ``is_closed``, and its state goes. Rows that come later begin it anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from framemetry.functions.scalars import finite, finite_or_null, nan_if_null
from framemetry.session import pickled_by_value

pickled_by_value(__name__)

BUCKET = 1024
HELD = 65536  # rows of a part in memory
PARTS = 1024  # groups of runs; not to be changed under a checkpoint
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """Files appearing under a path (a glob works for single files)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_epoch_rollup(
    batches: DataFrame, run: str, loss: str, ts: str = "ts", window: str = "1 day", delay: str = "1 hour"
) -> DataFrame:
    """Mean usable loss with seen / used / bad per run and time window.

    A window is final once the watermark passes its end; rows later than ``delay`` are dropped.
    """
    ok = F.coalesce(finite(loss), F.lit(False))
    return (
        batches.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, window).alias("window"), run)
        .agg(
            nan_if_null(F.avg(finite_or_null(loss))).alias("loss"),
            F.count(F.lit(1)).alias("seen"),
            F.count_if(ok).alias("used"),
            F.count_if(~ok).alias("bad"),
        )
    )


def _until(stop: np.ndarray) -> int:
    """Rows up to the first stop, that one included."""
    return int(stop.argmax()) + 1 if stop.any() else len(stop)


def _unique(place: np.ndarray, value: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending places, the first value of each, and how many more rows each had."""
    order = np.argsort(place, kind="stable")
    place, value, more = place[order], value[order], more[order]
    first = np.flatnonzero(np.diff(place, prepend=place[0] - 1) != 0) if len(place) else np.zeros(0, int)
    rows = np.add.reduceat(more + 1, first) if len(first) else first
    return place[first], value[first], rows - 1


class RunSteps(StatefulProcessor):
    """Rows (run, place, value) of the runs of a part, those of a run in the order of their places, against a state
    per run that begins as ``begin`` and is led on by ``step``. Runs share the cost of a call, which for a few rows
    of one run is far above that of the rows."""

    STATE = "last BIGINT, late BIGINT, nulls BIGINT, stopped BOOLEAN, seen BIGINT"

    def __init__(self, run: str, idle: float | None, bucket: int, held: int = HELD):
        self.run, self.idle, self.bucket, self.held = run, idle, bucket, held

    def begin(self) -> tuple:
        """The own fields of a new state."""
        raise NotImplementedError

    def step(self, own: tuple, place: np.ndarray, value: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple]]:
        """The result rows, and the own fields of the state after each of them."""
        raise NotImplementedError

    def closing(self, last: int, own: tuple) -> dict:
        raise NotImplementedError

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getMapState("runs", "run STRING", self.STATE)
        self.waiting = handle.getMapState(
            "waiting", "run STRING, bucket BIGINT", "places ARRAY<BIGINT>, found ARRAY<DOUBLE>, more ARRAY<BIGINT>"
        )

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = 0 if self.idle is None else timerValues.getCurrentProcessingTimeInMs()
        before, states = {}, {}
        known = self.runs.exists()
        held, size, waits = [], 0, set()
        for chunk in rows:
            held.append(self._fresh(chunk, before, states, known, now))
            size += len(held[-1][0])
            if size > self.held:
                waits |= self._wait(held)
                held, size = [], 0
        if waits:
            waits |= self._wait(held)
            pieces = ((at[0], *self._taken(at)) for at in sorted(waits, key=lambda at: (at[0] or "", at[0] is None, at[1])))
        else:
            pieces = self._by_run(held)
        found, size = [], 0
        for name, place, value, more in pieces:
            states[name], result = self._lead(states[name], place, value, more)
            found.append((name, result))
            size += len(result["is_stop"])
            if size >= self.held:
                yield self._frame(found)
                found, size = [], 0
        if size:
            yield self._frame(found)
        for name, state in states.items():
            if state != before[name]:
                self.runs.updateValue((name,), state)
        if self.idle is not None and next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer(now + int(self.idle * 1000))

    def _fresh(self, chunk: pd.DataFrame, before: dict, states: dict, known: bool, now: int) -> tuple:
        """Rows that count as arrays; the others are counted in the state of their run, which is read when it is met."""
        of, names = pd.factorize(chunk["run"], use_na_sentinel=False)
        names = [None if pd.isna(name) else name for name in names]
        for name in names:
            if name not in states:
                stored = known and self.runs.containsKey((name,))
                before[name] = tuple(self.runs.getValue((name,))) if stored else None
                state = before[name] or (-(2**62), 0, 0, False, 0, *self.begin())
                states[name] = (*state[:4], now, *state[5:])
        live = ~np.array([states[name][3] for name in names], bool)[of]
        placed = ~chunk["missing"].to_numpy(bool)
        place = chunk["place"].to_numpy(np.int64)
        new = live & placed & (place > np.array([states[name][0] for name in names], np.int64)[of])
        nulls = np.bincount(of[live & ~placed], minlength=len(names))
        late = np.bincount(of[live & placed & ~new], minlength=len(names))
        for i in np.flatnonzero(nulls + late).tolist():
            state = states[names[i]]
            states[names[i]] = (state[0], state[1] + int(late[i]), state[2] + int(nulls[i]), *state[3:])
        return np.array(names, object)[of[new]], place[new], chunk["value"].to_numpy(float)[new]

    def _by_run(self, held: list[tuple]) -> Iterator[tuple]:
        """The rows of each run, its places ascending."""
        if not held:
            return
        run, place, value = (np.concatenate(arrays) for arrays in zip(*held))
        of, names = pd.factorize(run, use_na_sentinel=False)
        order = np.argsort(of, kind="stable")
        place, value, ends = place[order], value[order], np.cumsum(np.bincount(of, minlength=len(names)))
        for name, low, high in zip(names, np.concatenate([[0], ends]), ends):
            yield None if pd.isna(name) else name, *_unique(place[low:high], value[low:high], np.zeros(high - low, np.int64))

    def _wait(self, held: list[tuple]) -> set[tuple]:
        """Rows added to the buckets that wait in the state store."""
        met = set()
        for name, place, value, more in self._by_run(held):
            of = place // self.bucket
            for bucket in np.unique(of).tolist():
                mine, at = of == bucket, (name, bucket)
                arrays = place[mine], value[mine], more[mine]
                if self.waiting.containsKey(at):
                    held_there = self.waiting.getValue(at)
                    arrays = tuple(np.concatenate([np.array(h, a.dtype), a]) for h, a in zip(held_there, arrays))
                self.waiting.updateValue(at, tuple(a.tolist() for a in _unique(*arrays)))
                met.add(at)
        return met

    def _taken(self, at: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, value, more = self.waiting.getValue(at)
        self.waiting.removeKey(at)
        return np.array(place, np.int64), np.array(value, float), np.array(more, np.int64)

    def _lead(self, state: tuple, place: np.ndarray, value: np.ndarray, more: np.ndarray) -> tuple[tuple, dict]:
        """The state after the rows, and the result rows up to a stop."""
        last, late, nulls, stopped, seen, *own = state
        result, after = self.step(own, place, value)
        n = 0 if stopped else _until(result["is_stop"])
        missed = late + np.concatenate([[0], np.cumsum(more)])
        result = {c: rows[:n] for c, rows in result.items()}
        result |= {"late_rows": missed[:n], "null_rows": np.full(n, nulls), "is_closed": np.zeros(n, bool)}
        if n:
            last, stopped, own = int(place[n - 1]), bool(result["is_stop"][-1]), after(n - 1)
            late = int(missed[n - 1] if stopped else missed[-1])
        return (last, late, nulls, stopped, seen, *own), result

    def _frame(self, found: list[tuple]) -> pd.DataFrame:
        run = np.repeat(np.array([name for name, _ in found], object), [len(result["is_stop"]) for _, result in found])
        return pd.DataFrame({self.run: run} | {c: np.concatenate([result[c] for _, result in found]) for c in found[0][1]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Closes the silent runs of the part; the next timer is for the one that is silent longest then."""
        now, idle = timerValues.getCurrentProcessingTimeInMs(), int(self.idle * 1000)
        closed, due = [], None
        for (name,), (last, late, nulls, _, seen, *own) in self.runs.iterator():
            if seen + idle <= now:
                closed.append({self.run: name, **self.closing(last, own), "late_rows": late, "null_rows": nulls, "is_closed": True})
            else:
                due = min(due or seen + idle, seen + idle)
        for row in closed:
            self.runs.removeKey((row[self.run],))
        if due is not None:
            self.handle.registerTimer(due)
        if closed:
            yield pd.DataFrame(closed)


class EarlyStop(RunSteps):
    STATE = RunSteps.STATE + ", best DOUBLE, best_epoch BIGINT"

    def __init__(self, run: str, idle: float | None, bucket: int, patience: int, start_epoch: int, held: int = HELD):
        super().__init__(run, idle, bucket, held)
        self.patience, self.start_epoch = patience, start_epoch

    def begin(self) -> tuple:
        return math.inf, self.start_epoch

    def step(self, own: tuple, place: np.ndarray, value: np.ndarray):
        best, best_epoch = own
        value = np.where(np.isfinite(value), value, np.inf)
        low = np.minimum.accumulate(np.concatenate([[best], value]))
        improved = value < low[:-1]
        at = np.maximum.accumulate(np.where(improved, place, best_epoch)) if len(place) else place
        rows = {"epoch": place, "best": low[1:], "best_epoch": at, "is_best": improved, "is_stop": place - at >= self.patience}
        return rows, lambda i: (float(low[i + 1]), int(at[i]))

    def closing(self, last: int, own: tuple) -> dict:
        return {"epoch": last, "best": own[0], "best_epoch": own[1], "is_best": False, "is_stop": False}


class NonfiniteBudget(RunSteps):
    STATE = RunSteps.STATE + ", bad BIGINT"

    def __init__(self, run: str, idle: float | None, bucket: int, order: str, max_bad: int, stops: bool, held: int = HELD):
        super().__init__(run, idle, bucket, held)
        self.order, self.max_bad, self.stops = order, max_bad, stops

    def begin(self) -> tuple:
        return (0,)

    def step(self, own: tuple, place: np.ndarray, value: np.ndarray):
        is_bad = value != 0
        so_far = own[0] + np.cumsum(is_bad)
        rows = {self.order: place, "bad_so_far": so_far, "is_bad": is_bad, "is_stop": is_bad & (so_far > self.max_bad) & self.stops}
        return rows, lambda i: (int(so_far[i]),)

    def closing(self, last: int, own: tuple) -> dict:
        return {self.order: last, "bad_so_far": own[0], "is_bad": False, "is_stop": False}


def _as_text(run: Column, kind: str) -> Column:
    """A run as text, equal for equal runs; columns of whole numbers with NULLs do not survive in pandas."""
    if kind == "timestamp":
        return F.unix_micros(run).cast("string")
    if kind in ("double", "float"):
        run = F.when(run == 0, F.lit(0).cast(kind)).otherwise(run)  # the negative zero is the same
    return F.hex(run) if kind == "binary" else run.cast("string")


def _from_text(text: Column, kind: str) -> Column:
    if kind == "timestamp":
        return F.timestamp_micros(text.cast("bigint"))
    return F.unhex(text) if kind == "binary" else text.cast(kind)


def _stateful(rows: DataFrame, run: str, place: str, value: Column, steps: RunSteps, made: str, parts: int) -> DataFrame:
    # this kind of state is kept by the RocksDB store only
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at, kind = F.col(place).cast("bigint"), rows.schema[run].dataType.simpleString()
    name = _as_text(F.col(run), kind)
    slim = rows.select(
        F.pmod(F.xxhash64(name), F.lit(parts)).alias("part"), name.alias("run"), F.coalesce(at, F.lit(0)).alias("place"),
        at.isNull().alias("missing"), value.alias("value"),
    )
    out = slim.groupBy("part").transformWithStateInPandas(
        steps,
        f"{run} STRING, {made}, is_stop BOOLEAN, late_rows BIGINT, null_rows BIGINT, is_closed BOOLEAN",
        "append",
        "None" if steps.idle is None else "ProcessingTime",
    )
    return out.withColumn(run, _from_text(F.col(run), kind))


def stream_early_stop(
    log: DataFrame, run: str, metric: str = "val_loss", patience: int = 12, epoch: str = "epoch",
    start_epoch: int = 0, idle: float | None = None, bucket: int = BUCKET, parts: int = PARTS, held: int = HELD,
) -> DataFrame:
    """One row per accepted epoch: best so far, its epoch, whether to stop now. A stopped run
    accepts nothing more."""
    steps = EarlyStop(run, idle, bucket, patience, start_epoch, held)
    value = nan_if_null(F.col(metric).cast("double"))
    return _stateful(log, run, epoch, value, steps, "epoch BIGINT, best DOUBLE, best_epoch BIGINT, is_best BOOLEAN", parts)


def stream_nonfinite_budget(
    batches: DataFrame, run: str, order: str = "batch", loss: str = "loss", max_bad: int = 3,
    action: str = "stop", idle: float | None = None, bucket: int = BUCKET, parts: int = PARTS, held: int = HELD,
) -> DataFrame:
    """One row per batch seen: running count of bad ones and whether the budget is exceeded now."""
    steps = NonfiniteBudget(run, idle, bucket, order, max_bad, action == "stop", held)
    bad = (~F.coalesce(finite(loss), F.lit(False))).cast("double")
    return _stateful(batches, run, order, bad, steps, f"{order} BIGINT, bad_so_far BIGINT, is_bad BOOLEAN", parts)


def _candidate(metric: str, mode: str, epoch: str) -> Column:
    """Smaller is better; of equal values the first epoch."""
    m = finite_or_null(metric)
    return F.when(m.isNotNull(), F.struct((m * (1 if mode == "min" else -1)).alias("m"), F.col(epoch).cast("bigint").alias("e")))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _latest(stored: DataFrame) -> DataFrame:
    """Of the two slots of each part, the one written last."""
    last = stored.groupBy("part").agg(F.max("version").alias("version"))
    return stored.join(last, ["part", "version"])


def upsert_best(changed: DataFrame, batch_id: int, keys: list[str], by: dict[str, str], table: str, epoch: str, parts: int) -> None:
    """Merge the best rows of a micro-batch into the table.

    The table is hashed on the keys into parts, and a part has two slots. A batch rewrites only the parts whose
    keys it has: the rows of the slot written last, merged with its own, go to the other slot, by dynamic
    partition overwrite. Old versions so never pile up, readers find one whole slot at any time, and a replayed
    batch, which ignores what it wrote itself, writes the same rows again.
    """
    spark = changed.sparkSession
    names = list(by)
    own = changed.groupBy(*keys).agg(*[F.min(_candidate(m, mode, epoch)).alias(m) for m, mode in by.items()])
    own = own.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
    merged, slots = own, own.select("part").distinct().withColumn("slot", F.lit(0))
    if _exists(spark, table):
        stored = spark.read.parquet(table).where(F.col("version") < batch_id)
        last = stored.groupBy("part").agg(F.max_by("slot", "version").alias("_last"))
        slots = slots.drop("slot").join(last, "part", "left").select("part", F.coalesce(1 - F.col("_last"), F.lit(0)).alias("slot"))
        kept = _latest(stored).join(slots, "part", "left_semi")
        merged = kept.select(*keys, *names, "part").unionByName(own)
    out = (
        merged.groupBy("part", *keys).agg(*[F.min(m).alias(m) for m in names])
        .join(slots, "part").withColumn("version", F.lit(batch_id).cast("bigint"))
    )
    (
        out.repartition(parts, "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("part", "slot").parquet(table)
    )


def stream_best_checkpoint(
    log: DataFrame, keys: list[str], by: dict[str, str], table: str, checkpoint: str,
    epoch: str = "epoch", parts: int = 16, **trigger,
) -> StreamingQuery:
    """Keep the best epoch per run and criterion in a table of at most two files a part; no state is kept
    besides. ``read_best`` gives it back."""
    return (
        log.writeStream.foreachBatch(lambda changed, batch_id: upsert_best(changed, batch_id, keys, by, table, epoch, parts))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_best(spark: SparkSession, table: str, keys: list[str], by: dict[str, str]) -> DataFrame:
    """The table of ``stream_best_checkpoint`` in the columns of the batch operator. It may be read while it is
    written: files that go meanwhile are of slots that are not the last."""
    cols = []
    for metric, mode in by.items():
        cols += [
            F.col(f"{metric}.e").alias(f"{metric}_epoch"),
            (F.col(f"{metric}.m") * (1 if mode == "min" else -1)).alias(f"{metric}_best"),
        ]
    return _latest(spark.read.option("ignoreMissingFiles", "true").parquet(table)).select(*keys, *cols)


def stream_append_log(log: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append-only file sink; the checkpoint makes a restart continue where the last run ended. By
    default it ends when everything there is has been processed; ``processingTime`` keeps it running."""
    return (
        log.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available into a Parquet folder and wait for the end."""
    stream_append_log(stream, path, checkpoint).awaitTermination()
