"""What the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors from which an index is fitted: those first in the order of a hash.
SAMPLE_ROWS = 20_000


def usable(vector: str) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def lengths(rows: DataFrame, vector: str) -> list[int]:
    """The lengths that occur: vectors are compared with those of their own length."""
    return sorted(r[0] for r in rows.select(F.size(vector)).distinct().collect())


def sample(rows: DataFrame, key: str, vector: str, n: int = SAMPLE_ROWS) -> np.ndarray:
    """At most ``n`` unit vectors, chosen by a hash of the key, of rows whose vectors have one length."""
    got = rows.select(key, vector).orderBy(F.xxhash64(F.col(key)), key).limit(n).select(vector).toArrow().column(0).to_pylist()
    return unit(np.asarray(got, dtype=np.float64)) if got else np.zeros((0, 1))


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that squares of very large or small components stay finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which is exact, so that their squares stay finite."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same for a pair wherever it is computed."""
    x, y = _scaled(x), _scaled(y)
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
