"""Mix sources to target weights by Efraimidis-Spirakis sampling; built-in functions only.

Each source gets a word target: its weight's share of ``share`` times all words,
never above ``max_epochs`` times its own size; what a source cannot take goes to
the others by weight.  A source first gives whole epochs; the rest of its target
comes from its documents in the order of exponential keys -ln(u)/quality, taken
until their prefix sum is nearest to the rest.

The prefix sum is two-level: documents fall into key ranges, range totals are
summed, and only the range in which the budget ends is ordered document by
document.  A source with a third of all rows is therefore never gathered.

A document's quality weight is a column of the table, if one is named; where it is null,
or none is named, the closeness of its mean word length to six stands in for it.  A weight
of zero or less comes last.

Defined results: a null text has size 0 and takes 0; a null source is a source
of its own, ordered last; documents of size 0 take 0; repeated rows count as
separate documents; an empty table gives no rows; a run repeated on the same rows
takes the same words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
RANGES = 4096
_HEX = 13  # hex digits of the hash behind u: 52 bits


def quality(size: Column, chars: Column) -> Column:
    """Sampling weight in (0, 1]: 1 at six characters a word, falling with the distance from it."""
    return F.when(size > 0, 1 / (1 + F.abs(F.ln(chars / size / 6)))).otherwise(F.lit(1.0))


def row_key() -> Column:
    """With doc_id it tells a document's rows apart."""
    return F.xxhash64("source", "text")


def sized(docs: DataFrame, weight: str | None = None) -> DataFrame:
    """doc_id, row_key, source, size and the sampling key of every document; ``weight`` names its quality column."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", row_key().alias("row_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.length(text).alias("chars"), F.col(weight).cast("double").alias("weight") if weight else F.lit(None).alias("weight"))
    digits = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, _HEX)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**_HEX))
    given = F.when(F.col("weight") > 0, F.col("weight")).when(F.col("weight").isNotNull(), F.lit(1e-9)) if weight else F.lit(None)
    return rows.select("doc_id", "row_key", "source", "size", (-F.ln(u) / F.coalesce(given, quality(F.col("size"), F.col("chars")))).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """source, source_size, target from rows (source, source_size): one row a source.

    Filling in the order of cap / weight gives what repeated resharing ends at:
    the first sources stop at their caps, the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, onward = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    rows = rows.withColumn("fill", F.col("cap") / F.col("weight")).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    # the first source whose fill exceeds the level of its place sets the common level
    common = F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "level"))).over(everything)["level"]
    return rows.withColumn("common", common).select("source", "source_size", F.round(F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))), 6).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, weight: str | None = None) -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, taken for every row of ``docs``; ``weight``: see :func:`sized`."""
    rows = cut(sized(docs, weight).withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * RANGES)), "sized")
    by_range = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    plan = targets(by_range.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = by_range.withColumn("passed", F.coalesce(F.sum("words").over(before), F.lit(0)))
    ends = ends.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    last = F.max(F.when(F.col("passed") < F.col("rest"), F.struct("range", "passed")))
    ends = cut(ends.groupBy("source", "source_size", "target", "epochs", "rest").agg(last.alias("last")), "mix_plan")
    ends = ends.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", F.coalesce("last.range", F.lit(-1)).alias("last_range"), F.coalesce("last.passed", F.lit(0)).alias("passed"))
    dealt = rows.join(ends, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = dealt.filter(F.col("range") != F.col("last_range")).withColumn("extra", F.col("range") < F.col("last_range"))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = dealt.filter(F.col("range") == F.col("last_range"))
    edge = edge.withColumn("start", F.col("passed") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    edge = edge.withColumn("extra", F.col("start") + F.col("size") / 2.0 <= F.col("rest")).drop("start")
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("extra"), 1).otherwise(0))
    return whole.unionByName(edge).select("doc_id", "row_key", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))
