"""Bounds of vector components by mergeable quantile sketches.

A sketch for each component of vectors of a length, of absolute values, is one aggregate with partial sums; sketches of
days or shards merge without reading vectors again.  The bound of a component is its quantile, within the sketch's rank error
(about 1.3 % at the default size).  There are as many rows as components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILE = 0.99
#: Size of a sketch: its rank error is about 2.3 over this, at 99 % confidence.
SKETCH = 400


def component_sketches(vectors: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """length, component, sketch of absolute values; null and non-finite ones take no part."""
    each = vectors.filter("embedding is not null").select(F.size("embedding").alias("length"), F.posexplode("embedding").alias("component", "x"))
    size = F.abs(F.col("x").cast("double"))
    finite = each.filter(F.col("x").isNotNull() & ~F.isnan("x") & (size < float("inf")))
    return finite.groupBy("length", "component").agg(F.kll_sketch_agg_double(size, F.lit(sketch)).alias("sketch"))


def merged(sketches: DataFrame, sketch: int = SKETCH) -> DataFrame:
    """One sketch for each component of several tables of sketches put together."""
    return sketches.groupBy("length", "component").agg(F.kll_merge_agg_double("sketch", F.lit(sketch)).alias("sketch"))


def bounds(sketches: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """length, component, bound, n."""
    return sketches.select("length", "component", F.kll_sketch_get_quantile_double("sketch", F.lit(quantile)).alias("bound"), F.kll_sketch_get_n_double("sketch").alias("n"))


def clip_of(found: DataFrame, length: int) -> np.ndarray:
    """The bounds of vectors of one length as an array."""
    rows = sorted(found.filter(F.col("length") == length).select("component", "bound").collect())  # one a component
    out = np.zeros(length)
    for r in rows:
        out[r["component"]] = r["bound"]
    return out
