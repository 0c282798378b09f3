"""Streams that act when nothing comes: breakers that try again and batches that leave, by event-time timers.

Rows wait in state until the watermark has passed them and are then taken in order of time, so that the
result doesn't depend on how rows fall into micro-batches.  What happens without a row is a timer: an open
breaker lets one call through after the reset time, and a batch leaves when its first item has waited long enough.
State of a key is its waiting rows (as many as come within the watermark's delay) and one small record.

Rows without key or time are left out.  Rows later than the watermark are dropped by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptorium.session import ship_code
from scriptorium.streaming.breaker import CLOSED, HALF_OPEN, OPEN

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: A waiting row in state, rows of a chunk of state, and rows that are sorted at once.
ROW = np.dtype([("at", "<i8"), ("row", "<i8"), ("failed", "?")])
CHUNK, RUN = 10_000, 200_000


def _sorted(rows: list[np.ndarray]) -> np.ndarray:
    some = np.concatenate(rows)
    return some[np.lexsort((some["failed"], some["row"], some["at"]))]


class _InOrder(StatefulProcessor):
    """Hands on a key's rows in order of (at, row) once the watermark has passed them.

    Waiting rows are sorted runs of at most ``RUN`` rows, in chunks of ``CHUNK``; small runs are merged as they come, so that
    there are few.  Due rows come from a merge that holds one chunk of each run, so a key may have more rows than memory takes.
    """

    columns: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "number long", "rows binary")
        self.index = handle.getValueState("index", "next long, runs string")
        self.held = handle.getValueState("held", self.held_schema)

    def _index(self) -> list:
        """The next chunk's number, and the runs: of each chunk its number, its rows and the time of the first."""
        if not self.index.exists():
            return [0, []]
        number, runs = self.index.get()
        return [number, json.loads(runs)]

    def _chunk(self, number: int) -> np.ndarray:
        return np.frombuffer(bytes(self.chunks.getValue((number,))[0]), dtype=ROW)

    def _add(self, index: list, new: list[np.ndarray]) -> None:
        runs, n = index[1], sum(map(len, new))
        while runs and (size := sum(c[1] for c in runs[-1])) <= n and size + n <= RUN:
            for number, _, _ in runs.pop():
                new.append(self._chunk(number))
                self.chunks.removeKey((number,))
            n += size
        rows, run = _sorted(new), []
        for i in range(0, len(rows), CHUNK):
            some = rows[i : i + CHUNK]
            self.chunks.updateValue((index[0],), (some.tobytes(),))
            run.append([index[0], len(some), int(some["at"][0])])
            index[0] += 1
        runs.append(run)

    def _due(self, index: list, now: int) -> Iterator[np.ndarray]:
        """The rows up to ``now`` in order, in pieces; they leave the state."""
        runs, open_ = index[1], {}
        while True:
            for k, run in enumerate(runs):
                if k not in open_ and run and run[0][2] <= now:
                    open_[k] = self._chunk(run[0][0])
            if not any(rows["at"][0] <= now for rows in open_.values()):
                break
            end = min(rows[-1].item() for rows in open_.values())  # later chunks of a run are behind its first one's end
            taken = []
            for k, rows in list(open_.items()):
                at, row = rows["at"], rows["row"]
                upto = (at < end[0]) | (at == end[0]) & ((row < end[1]) | (row == end[1]) & (rows["failed"] <= end[2]))
                n = np.count_nonzero(upto & (at <= now))
                taken.append(rows[:n])
                open_[k] = rows[n:]
                if n == len(rows):
                    self.chunks.removeKey((runs[k].pop(0)[0],))
                    del open_[k]
            yield _sorted(taken)
        for k, rows in open_.items():
            if len(rows) < runs[k][0][1]:
                self.chunks.updateValue((runs[k][0][0],), (rows.tobytes(),))
                runs[k][0][1:] = [len(rows), int(rows["at"][0])]
        index[1] = [run for run in runs if run]

    def _keep(self, index: list) -> None:
        if index[1]:
            self.index.update((index[0], json.dumps(index[1])))
            self.handle.registerTimer(min(run[0][2] for run in index[1]))
        else:
            self.index.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        index, new = self._index(), []
        for batch in rows:
            some = np.empty(len(batch), dtype=ROW)
            for c in ROW.names:
                some[c] = batch[c].to_numpy()
            new.append(some)
            if sum(map(len, new)) >= RUN:
                self._add(index, new)
                new = []
        if sum(map(len, new)):
            self._add(index, new)
        self._keep(index)
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        index = self._index()
        held = tuple(self.held.get()) if self.held.exists() else self.fresh
        for piece in self._due(index, now):
            for i in range(0, len(piece), CHUNK):
                due = piece[i : i + CHUNK].tolist()
                held, out = self.advance(held, due, due[-1][0])
                if out:
                    yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)
        held, out = self.advance(held, [], now)
        self._keep(index)
        self.held.update(held)
        if (timer := self.timer(held)) is not None:
            self.handle.registerTimer(max(timer, now + 1))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=self.columns)

    def close(self) -> None:
        pass


class BreakerTimers(_InOrder):
    """Changes of a circuit breaker's state.  ``threshold`` failures open it; ``reset`` ms later it is half open, event or not;
    a failure then opens it again, and a success ``stable`` ms behind the last failure closes it.  Calls to an open one change nothing."""

    held_schema = "state string, failures long, opened long, last long"
    columns = ("key", "at", "state")
    fresh = (CLOSED, 0, -(1 << 60), -(1 << 60))

    def __init__(self, threshold: int, reset: int, stable: int):
        self.threshold, self.reset, self.stable = threshold, reset, stable

    def timer(self, held: tuple) -> int | None:
        return held[2] + self.reset + 1 if held[0] == OPEN else None

    def advance(self, held: tuple, due: list[tuple], now: int) -> tuple[tuple, list[tuple]]:
        out: list[tuple] = []

        def ripen(held: tuple, at: int) -> tuple:
            if held[0] == OPEN and at > held[2] + self.reset:
                out.append((held[2] + self.reset + 1, HALF_OPEN))
                return (HALF_OPEN, *held[1:])
            return held

        for at, _, failed in due:
            state, failures, opened, last = held = ripen(held, at)
            if state == OPEN:
                continue
            if failed:
                failures += 1
                held = (OPEN, failures, at, at) if failures >= self.threshold else (state, failures, opened, at)
            elif at - last >= self.stable:
                held = (CLOSED, 0, opened, last)
            if held[0] != state:
                out.append((at, held[0]))
        return ripen(held, now), out


class BatchTimers(_InOrder):
    """Batches of a lane: one leaves with its ``size``-th item, or ``wait`` ms after its first."""

    held_schema = "number long, n long, first long, low long, high long"
    columns = ("key", "number", "n", "first_at", "left_at", "cause", "low", "high")
    fresh = (0, 0, 0, 0, 0)

    def __init__(self, size: int, wait: int):
        self.size, self.wait = size, wait

    def timer(self, held: tuple) -> int | None:
        return held[2] + self.wait + 1 if held[1] else None

    def advance(self, held: tuple, due: list[tuple], now: int) -> tuple[tuple, list[tuple]]:
        out: list[tuple] = []

        def ripen(held: tuple, at: int) -> tuple:
            number, n, first, low, high = held
            if n and at > first + self.wait:
                out.append((number, n, first, first + self.wait, "wait", low, high))
                return (number + 1, 0, 0, 0, 0)
            return held

        for at, row, _ in due:
            number, n, first, low, high = ripen(held, at)
            held = (number, n + 1, first if n else at, min(low, row) if n else row, max(high, row))
            if held[1] == self.size:
                number, n, first, low, high = held
                out.append((number, n, first, at, "size", low, high))
                held = (number + 1, 0, 0, 0, 0)
        return ripen(held, now), out


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that lists and timers need; small tables of a test still shuffle to the session's partitions."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _rows(stream: DataFrame, key: str, row: str, at: str, failed: Column, delay: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    ship_code(stream.sparkSession)
    kept = stream.withWatermark(at, delay).filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    return kept.select(F.col(key).alias("key"), F.col(row).cast("long").alias("row"), F.unix_millis(at).alias("at"), F.coalesce(failed, F.lit(False)).alias("failed"), at)


def breaker_changes(stream: DataFrame, key: str, row: str, at: str, failed: Column, threshold: int = 5, reset: int = 300_000, stable: int = 60_000, delay: str = "1 minute") -> DataFrame:
    """key, at (ms), state: every change of each key's breaker up to the watermark."""
    rows = _rows(stream, key, row, at, failed, delay)
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(BreakerTimers(threshold, reset, stable), f"key {kind}, at long, state string", "append", "EventTime")


def timed_batches(stream: DataFrame, key: str, row: str, at: str, size: int = 32, wait: int = 2_000, delay: str = "1 minute") -> DataFrame:
    """key, number, n, first_at, left_at (ms), cause, low and high row of every batch that has left up to the watermark."""
    rows = _rows(stream, key, row, at, F.lit(False), delay)
    kind = rows.schema["key"].dataType.simpleString()
    out = f"key {kind}, number long, n long, first_at long, left_at long, cause string, low long, high long"
    return rows.groupBy("key").transformWithStateInPandas(BatchTimers(size, wait), out, "append", "EventTime")
