"""A circuit breaker for each key of a stream, by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.session import ship_code

CLOSED, OPEN, HALF_OPEN = "CLOSED", "OPEN", "HALF_OPEN"


def advance(held: tuple, at: float, failed: bool, threshold: int, reset: float, stable: float) -> tuple:
    """(state, failures, opened at, last failure) after a call at ``at``.

    ``threshold`` failures without a reset between open the breaker; after ``reset`` seconds one call is let through.
    A failure then opens it again; a success ``stable`` seconds after the last failure closes it.  Calls to an open
    breaker are turned away and change nothing.
    """
    state, failures, opened, last = held
    if state == OPEN:
        if at - opened <= reset:
            return held
        state = HALF_OPEN
    if failed:
        failures, last = failures + 1, at
        return (OPEN, failures, at, last) if failures >= threshold else (state, failures, opened, last)
    if at - last >= stable:
        return CLOSED, 0, opened, last
    return state, failures, opened, last


def states(stream: DataFrame, key: str, row: str, at: str, failed: Column, threshold: int = 5, reset: float = 300.0, stable: float = 60.0) -> DataFrame:
    """key, row, state: the breaker's state after each row.  Rows of a micro-batch are taken in order of time and row."""
    ship_code(stream.sparkSession)
    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, row)}

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (CLOSED, 0, float("-inf"), float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["at", "row"])
        out = []
        for at_, bad in zip(rows["at"], rows["failed"], strict=True):
            held = advance(held, at_, bool(bad), threshold, reset, stable)
            out.append(held[0])
        state.update(held)
        yield pd.DataFrame({key: [k[0]] * len(rows), row: rows["row"].to_numpy(), "state": out})

    calls = stream.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("key"), F.col(row).alias("row"), (F.unix_micros(F.col(at)) / 1e6).alias("at"), F.coalesce(failed, F.lit(False)).alias("failed")
    )
    return calls.groupBy("key").applyInPandasWithState(step, f"{key} {kinds[key]}, {row} {kinds[row]}, state string", "state string, failures long, opened double, last double", "append", "NoTimeout")
