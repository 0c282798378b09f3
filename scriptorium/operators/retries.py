"""Work on rows that may fail: tries, and what is left for the dead letters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import ship_code


class Fatal(Exception):
    """Failing again would be no different: not tried again."""


def with_retries(rows: DataFrame, load: Callable, value: str, retries: int = 3) -> DataFrame:
    """``rows`` with result, attempts and error of a worker (value, attempt) -> text.

    ``load`` gives the worker, once a task.  A row is tried once and up to ``retries`` times more; :class:`Fatal` ends it at
    once.  error is null exactly where there is a result; rows with an error are the dead letters.  There is no waiting between tries:
    a task that waits holds a core.
    """
    ship_code(rows.sparkSession)

    @F.pandas_udf("result string, attempts int, error string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker = load()

        def one(v) -> tuple:
            for attempt in range(1, retries + 2):
                try:
                    return worker(v, attempt), attempt, None
                except Fatal as e:
                    return None, attempt, f"fatal: {e}"
                except Exception as e:  # noqa: BLE001 (whatever a worker raises is the row's error)
                    error = f"{type(e).__name__}: {e}"
            return None, retries + 1, error

        for batch in batches:
            yield pd.DataFrame([one(v) for v in batch], columns=["result", "attempts", "error"])

    return rows.withColumn("_w", work(value)).select(*rows.columns, "_w.result", "_w.attempts", "_w.error")
