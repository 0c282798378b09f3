"""References against texts: a surname near a year, or the reference's number in brackets.

One pass over a text gives its mentions: each word, or words joined by hyphens and apostrophes, that a year of
the nineteenth hundred on follows within ``NEAR`` characters of the same line, with that year and the distance.  Mentions
and references then meet in an equi-join on the surname; numbers in brackets meet the places in the list.  Work
grows with the texts and the matches, not with texts times references, and no pattern is made for a reference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.biblio import reference_surname
from scriptorium.session import cut, ship_code

#: Most characters between a surname and its year.
NEAR = 30
#: References of a surname that meet a text at once.
BLOCK = 1000
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_WORD = re.compile(r"\w+")
MENTION = "array<struct<surname: string, year: int, gap: int>>"


def mentions_of(text: str, near: int = NEAR) -> list[tuple[str, int, int]]:
    """(surname, year, gap) of every word that ends within ``near`` characters before a year, in small letters."""
    low = text.lower()
    words = [m.span() for m in _WORD.finditer(low)]
    found: set[tuple[str, int, int]] = set()
    first = 0
    for m in _YEAR.finditer(low):
        start, year = m.start(), int(m.group())
        line = low.rfind("\n", 0, start) + 1
        while first < len(words) and words[first][1] < start - near:
            first += 1
        k = first
        while k < len(words) and words[k][1] <= start:
            if words[k][1] >= line:
                j = k
                while True:  # the word, and those in front that a hyphen or an apostrophe joins to it
                    found.add((low[words[j][0] : words[k][1]], year, start - words[k][1]))
                    if j == 0 or words[j][0] - words[j - 1][1] != 1 or low[words[j][0] - 1] not in "-'":
                        break
                    j -= 1
            k += 1
    return sorted(found)


def with_mentions(texts: DataFrame, text: str = "text", near: int = NEAR) -> DataFrame:
    """``texts`` with its ``mentions`` and the ``numbers`` it has in brackets, each once."""
    ship_code(texts.sparkSession)

    @F.pandas_udf(MENTION)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [{"surname": s, "year": y, "gap": g} for s, y, g in mentions_of(t, near)])

    numbers = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[([1-9]\d*)\]"), F.lit(1)), lambda n: n.try_cast("long")), lambda n: n.isNotNull())
    return texts.withColumns({"mentions": found(F.coalesce(text, F.lit(""))), "numbers": F.array_distinct(F.coalesce(numbers, F.array().cast("array<long>")))})


def _named(references: DataFrame) -> DataFrame:
    return references.withColumn("surname", F.lower(reference_surname(F.trim("reference"))))


def _merged_pairs(read: DataFrame, refs: DataFrame, key: list[str]) -> DataFrame:
    """The pairs of references of which several have one ref_id: their flags are put together."""
    yes, no = F.lit(True), F.lit(False)
    near = read.select(*key, F.explode("mentions").alias("m")).select(*key, "m.surname", "m.year").join(refs, "surname")
    by_name = near.select(*key, "ref_id", yes.alias("by_name"), F.coalesce(F.col("year") == F.col("own_year"), no).alias("by_year"), no.alias("by_number"))
    numbered = read.select(*key, F.explode("numbers").alias("place")).join(refs.select("ref_id", "place"), "place")
    by_number = numbered.select(*key, "ref_id", no.alias("by_name"), no.alias("by_year"), yes.alias("by_number"))
    return by_name.unionByName(by_number).groupBy(*key, "ref_id").agg(*[F.max(c).alias(c) for c in ("by_name", "by_year", "by_number")])


def cited_pairs(texts: DataFrame, references: DataFrame, key: list[str]) -> DataFrame:
    """key, ref_id, by_name, by_year, by_number of every text and reference that belong together in one of the ways.

    ``texts``: key columns and text; ``references``: ref_id, place (from 1), reference, year, for all texts alike.  by_name: the
    surname is near any year; by_year: near the reference's own; by_number: its place stands in brackets.

    The pairs may be far more than the rows, so they are not shuffled: a text meets blocks of ``BLOCK`` references of a
    surname, which are spread over the tasks, and each pair is made once with all its flags.
    """
    read = with_mentions(texts).select(*key, "mentions", "numbers")
    read = cut(read.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("mentions"))).alias("mentions"), F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers")), "mentions")
    refs = _named(references).filter("surname is not null").select("ref_id", "place", "surname", F.col("year").cast("int").alias("own_year"))
    one = cut(refs.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("surname", "place", "own_year")).alias("r")), "cited_references")
    once = one.filter("n = 1").select("ref_id", "r.*")

    sizes = once.groupBy("surname").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    listed = once.join(sizes, "surname").withColumn("block", F.pmod(F.xxhash64("ref_id"), F.col("blocks")))
    listed = listed.groupBy("surname", "block").agg(F.collect_list(F.struct("ref_id", "place", "own_year")).alias("refs"))
    near = read.select(*key, "numbers", F.explode("mentions").alias("m")).groupBy(*key, F.col("m.surname").alias("surname")).agg(F.first("numbers").alias("numbers"), F.collect_set("m.year").alias("years"))
    near = near.join(sizes, "surname").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = near.join(listed.hint("shuffle_hash"), ["surname", "block"]).select(*key, "numbers", "years", F.explode("refs").alias("r"))
    flag = lambda array, value: F.coalesce(F.array_contains(array, value), F.lit(False))
    named = met.select(*key, "r.ref_id", F.lit(True).alias("by_name"), flag("years", F.col("r.own_year")).alias("by_year"), flag("numbers", F.col("r.place").cast("long")).alias("by_number"))

    surnames = F.transform("mentions", lambda m: m["surname"])
    numbered = read.select(*key, surnames.alias("surnames"), F.explode("numbers").alias("place")).join(once, "place").filter(~F.array_contains("surnames", F.col("surname")))
    pairs = named.unionByName(numbered.select(*key, "ref_id", *[F.lit(c == "by_number").alias(c) for c in ("by_name", "by_year", "by_number")]))
    again = one.filter("n > 1").select(F.col("ref_id").alias("again_id"))
    return pairs if again.isEmpty() else pairs.unionByName(_merged_pairs(read, refs.join(again, F.col("ref_id").eqNullSafe(F.col("again_id")), "left_semi"), key))


def split_references(texts: DataFrame, lists: DataFrame, key: list[str]) -> DataFrame:
    """Each text's own list (key, place, reference) with ``cited``: by name near a year, or by number.

    A reference without a surname in front is never cited; of references that are equal in a list, the first one's number counts
    for all.  A list whose text is null or empty is uncited.
    """
    own = _named(lists)
    first = own.groupBy(*key, "reference").agg(F.min("place").alias("number"))
    read = with_mentions(texts).select(*[F.col(k).alias(f"t_{k}") for k in key], F.array_distinct(F.transform("mentions", lambda m: m["surname"])).alias("surnames"), "numbers")
    on = [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in key]
    first = first.select(*[F.col(k).alias(f"f_{k}") for k in key], F.col("reference").alias("f_reference"), "number")
    same = [F.col(k).eqNullSafe(F.col(f"f_{k}")) for k in key] + [F.col("reference").eqNullSafe(F.col("f_reference"))]
    joined = own.join(first, same).join(read, on, "left")
    cited = F.array_contains("surnames", F.col("surname")) | F.array_contains("numbers", F.col("number").cast("long"))
    return joined.select(*key, "place", "reference", F.coalesce(F.col("surname").isNotNull() & cited, F.lit(False)).alias("cited"))
