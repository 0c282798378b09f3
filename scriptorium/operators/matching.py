"""Records against a catalogue by several keys of falling strength, and groups of duplicates made one record.

All keys of a record are rows of one table, and one join finds every match; the strongest is the least (step, id).  There
is no join for each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _filled(c: Column) -> Column:
    return F.coalesce(F.length(F.trim(c.cast("string"))), F.lit(0)) > 0


def first_match(new: DataFrame, known: DataFrame, keys: dict[str, tuple[Column, Column]], id_: str = "id", status: str = "status") -> DataFrame:
    """id, matched_by, matched, status of every new record.

    ``keys``: name -> (expression over ``new``, expression over ``known``), strongest first.  Null and empty keys match nothing; of
    known records with one key the smallest id counts.
    """

    def steps(side: int) -> Column:
        found = [F.when(_filled(k[side]), F.struct(F.lit(i).alias("step"), k[side].cast("string").alias("key"))) for i, k in enumerate(keys.values())]
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    held = known.select(F.col(id_).alias("matched"), F.col(status).alias("status"), F.explode(steps(1)).alias("k"))
    held = held.groupBy("k.step", "k.key").agg(F.min(F.struct("matched", "status")).alias("m"))
    asked = new.select(F.col(id_).alias("id"), F.explode_outer(steps(0)).alias("k")).select("id", "k.step", "k.key")
    best = asked.join(held, ["step", "key"], "left").groupBy("id").agg(F.min(F.when(F.col("m").isNotNull(), F.struct("step", "m"))).alias("best"))
    names = F.array(*map(F.lit, keys))
    return best.select("id", F.get(names, F.col("best.step")).alias("matched_by"), F.col("best.m.matched").alias("matched"), F.col("best.m.status").alias("status"))


def import_action(matched: Column, status: Column, done: str = "embedded") -> Column:
    """What becomes of a file: known and done, known, or new."""
    return F.when(matched.isNull(), "insert").when(status == done, "skip").otherwise("upgrade")


def _first_of(c: str, order: str) -> Column:
    """The first filled value in the order, as a struct whose least is it."""
    value = F.col(c)
    return F.min(F.when(_filled(value), F.struct(F.col(order).alias("o"), value.alias("v"))))


def smart_merged(records: DataFrame, key: str, order: str = "id") -> DataFrame:
    """One record for each key: doi, arxiv, openalex, pdf_url, authors of the first that has them, the longest abstract, the most citations,
    and the sources in order of arrival, each that isn't part of what stands there already."""
    firsts = ["doi", "arxiv", "openalex", "pdf_url", "authors"]
    longest = F.max(F.when(_filled(F.col("abstract")), F.struct(F.length("abstract").alias("n"), (-F.col(order)).alias("o"), F.col("abstract").alias("v"))))
    by_source = records.groupBy(key, "source").agg(F.min(order).alias("o"), F.count(F.lit(1)).alias("n"), *[_first_of(c, order).alias(c) for c in firsts], longest.alias("abstract"), F.max("citations").alias("citations"))
    sources = F.array_sort(F.collect_list(F.struct("o", "source")))
    one = by_source.groupBy(key).agg(F.min("o").alias("first_id"), F.sum("n").alias("n"), *[F.min(c)["v"].alias(c) for c in firsts], F.max("abstract")["v"].alias("abstract"), F.max("citations").alias("citations"), sources.alias("s"))
    joined = F.aggregate("s", F.lit(""), lambda a, x: F.when(a == "", x["source"]).when(F.contains(a, x["source"]), a).otherwise(F.concat(a, F.lit("|"), x["source"])))
    return one.withColumn("sources", joined).drop("s")


TITLE_FIELDS = ("doi", "abstract", "authors", "year", "venue", "url", "created_at")


def title_score() -> Column:
    """A file 100, a DOI 20, an abstract of over fifty characters 10, authors of over five 5."""
    points = {100: _filled(F.col("pdf_path")), 20: _filled(F.col("doi")), 10: F.coalesce(F.length("abstract"), F.lit(0)) > 50, 5: F.coalesce(F.length("authors"), F.lit(0)) > 5}
    return sum((F.when(c, n).otherwise(0) for n, c in points.items()), F.lit(0))


def title_survivors(records: DataFrame, order: str = "id") -> DataFrame:
    """title_key, survivor, score, victims and the filled fields of every group of records with one title (but for case).

    The record with the highest score survives, of equal ones the first; its empty fields come from the others in their order.  Records
    without a title are in no group.
    """
    ranked = records.filter(_filled(F.col("title"))).withColumn("title_key", F.lower("title")).withColumn("score", title_score())
    ranked = ranked.withColumn("rank", F.struct((-F.col("score")).alias("s"), F.col(order).alias("o")))
    filled = [F.min(F.when(_filled(F.col(c)), F.struct("rank", F.col(c).alias("v"))))["v"].alias(c) for c in TITLE_FIELDS]
    grouped = ranked.groupBy("title_key").agg(F.min("rank").alias("top"), F.max("score").alias("score"), (F.count(F.lit(1)) - 1).alias("victims"), *filled)
    return grouped.select("title_key", F.col("top.o").alias("survivor"), "score", "victims", *TITLE_FIELDS)
