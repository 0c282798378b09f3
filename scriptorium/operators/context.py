"""From ranked hits to the numbered text that a question's answer is written from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.search import cap_per_group, numbered, within_budget

BETWEEN = "\n\n---\n\n"


def distinct_hits(hits: DataFrame, words: str, most: float = 0.8) -> DataFrame:
    """Each question's hits in rank order; one that shares more than ``most`` of its words with a kept one goes.

    The pass is one expression over a question's hits, whose number is that of the search's top k.
    """
    rest = [c for c in hits.columns if c not in ("query_id", "rank")]
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *rest))).alias("_hits"))

    def alike(a: Column, b: Column) -> Column:
        return F.size(F.array_intersect(a[words], b[words])) > F.size(F.array_union(a[words], b[words])) * F.lit(most)

    kept = F.aggregate("_hits", F.slice("_hits", 1, 0), lambda kept, hit: F.when(F.exists(kept, lambda k: alike(k, hit)), kept).otherwise(F.concat(kept, F.array(hit))))
    return listed.select("query_id", F.inline(kept))


def assemble(hits: DataFrame, group: str, words: str, text: str, reference: str, per_group: int = 2, groups: int = 150, budget: int = 12_000, least: int = 200) -> DataFrame:
    """query_id, context, used, references, shortened: the hits' texts under numbered references.

    At most ``per_group`` hits of a group; near copies go; groups stand together in order of first appearance, numbered
    by it, ``groups`` at most; hits without a group take no part.  The first text that no longer fits is cut if more
    than ``least`` characters are left.  A missing reference becomes a link to the group.
    """
    kept = distinct_hits(cap_per_group(hits, group, per_group), words)
    placed = numbered(kept.filter(F.col(group).isNotNull()), group, groups)
    link = F.coalesce(F.nullif(F.col(reference), F.lit("")), F.concat(F.lit("https://doi.org/"), F.col(group).cast("string")))
    # the reference of a group's first hit stands for all of them
    link = F.first(link).over(Window.partitionBy("query_id", "number").orderBy("rank"))
    placed = placed.withColumn("_ref", link).withColumn("_part", F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] "), F.col("_ref"), F.lit("\n"), F.coalesce(text, F.lit(""))))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("number", "rank"))
    within = within_budget(placed.withColumn("rank", order).withColumn("_chars", F.length("_part")), "_chars", budget, least)
    cut = F.when(F.col("shortened"), F.concat(F.substr("_part", F.lit(1), F.col("taken").cast("int")), F.lit("..."))).otherwise(F.col("_part"))
    rows = F.array_sort(F.collect_list(F.struct("rank", "number", F.col("_ref").alias("ref"), cut.alias("part"))))
    made = within.groupBy("query_id").agg(rows.alias("r"), F.max("shortened").alias("shortened"))
    references = F.array_distinct(F.transform("r", lambda x: F.concat(F.lit("["), x["number"].cast("string"), F.lit("] "), x["ref"])))
    return made.select("query_id", F.array_join(F.transform("r", lambda x: x["part"]), BETWEEN).alias("context"), F.size("r").alias("used"), references.alias("references"), "shortened")
