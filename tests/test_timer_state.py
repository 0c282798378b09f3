import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from scriptorium.streaming import timers


class State(dict):
    """A handle with its states and timers, in memory."""

    def __init__(self):
        super().__init__()
        self.timers, self.now = set(), 0

    def getMapState(self, name, key, value):
        part = self.setdefault(name, {})
        part_of = type("M", (), {"getValue": lambda _, k: part[k], "updateValue": lambda _, k, v: part.__setitem__(k, v), "removeKey": lambda _, k: part.pop(k)})
        return part_of()

    def getValueState(self, name, schema):
        part = self.setdefault(name, {})
        return type("V", (), {"exists": lambda _: bool(part), "get": lambda _: part[0], "update": lambda _, v: part.__setitem__(0, v), "clear": lambda _: part.clear()})()

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def play(make, batches):
    """Micro-batches of (watermark, pieces of rows) for one key; every row that comes out."""
    state, out = State(), []
    processor = make()
    processor.init(state)
    for now, pieces in batches:
        if pieces:
            list(processor.handleInputRows((1,), iter(pieces), state))
        state.now = now
        while due := [t for t in state.timers if t <= now]:
            state.timers.difference_update(due)
            for got in processor.handleExpiredTimer((1,), state, None):
                out += list(got.itertuples(index=False, name=None))
    return out, state


def frame(rows):
    return pd.DataFrame(rows, columns=["at", "row", "failed"])


@pytest.mark.parametrize("make", [lambda: timers.BatchTimers(7, 500), lambda: timers.BreakerTimers(3, 300, 100)])
def test_runs_and_chunks_do_not_matter(monkeypatch, make):
    r = random.Random(4)
    rows = [(r.randrange(0, 20_000), k, r.random() < 0.5) for k in range(3000)]
    whole, state = play(make, [(0, [frame(rows)]), (30_000, [])])
    assert whole and not state["chunks"] and not state["index"]
    monkeypatch.setattr(timers, "CHUNK", 20)
    monkeypatch.setattr(timers, "RUN", 150)
    assert play(make, [(0, [frame(rows[i : i + 40]) for i in range(0, 3000, 40)]), (30_000, [])])[0] == whole
    late = sorted(rows, key=lambda x: x[0] + r.randrange(900))  # as they come when the watermark is 1000 behind
    steps = [(max(x[0] for x in late[: i + 60]) - 1000, [frame(late[i : i + 60])]) for i in range(0, 3000, 60)]
    assert play(make, [*steps, (30_000, [])])[0] == whole


def test_a_lane_of_many_rows():
    r, n = np.random.default_rng(1), 1_500_000
    at = r.integers(0, 1 << 31, n)
    pieces = [pd.DataFrame({"at": at[i : i + 10_000], "row": np.arange(i, i + 10_000), "failed": False}) for i in range(0, n, 10_000)]
    state, processor, most = State(), timers.BatchTimers(32, 1 << 40), 0
    processor.init(state)
    tracemalloc.start()
    list(processor.handleInputRows((1,), iter(pieces), state))
    state.now, before, got = 1 << 31, tracemalloc.get_traced_memory()[0], 0
    assert before < 17.5 * n + 5e6
    tracemalloc.reset_peak()
    for some in processor.handleExpiredTimer((1,), state, None):
        got += len(some)
    most = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert got == n // 32 and most < 60e6
