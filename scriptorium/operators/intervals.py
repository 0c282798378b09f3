"""Closed integer intervals: merging and gaps, as gaps-and-islands windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", touch: int = 1) -> DataFrame:
    """Islands of intervals that overlap or are at most ``touch`` apart."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.coalesce(F.col(start) > F.max(end).over(before) + touch, F.lit(True)).cast("int")
    islands = df.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(upto))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def gaps(merged: DataFrame, keys: list[str], low: int, high: int, start: str = "start", end: str = "end") -> DataFrame:
    """What merged intervals leave of [low, high], for keys that have any interval."""
    clipped = merged.filter((F.col(end) >= low) & (F.col(start) <= high))
    marks = merged.select(*keys).distinct().select(*keys, F.lit(high + 1).alias(start), F.lit(high + 1).alias(end))
    w = Window.partitionBy(*keys).orderBy(start)
    from_ = F.greatest(F.lit(low), F.coalesce(F.lag(end).over(w) + 1, F.lit(low)))
    spans = clipped.select(*keys, start, end).unionByName(marks).withColumn("_from", from_).withColumn("_to", F.least(F.lit(high), F.col(start) - 1))
    return spans.filter("_from <= _to").select(*keys, F.col("_from").alias("gap_start"), F.col("_to").alias("gap_end"))
