"""Questions in rounds: search, see what is missing, ask again; facts in rounds until there are enough.

Each round is one search for all questions that are still open.  What a question has seen leaves its hits by an
anti-join; what its hits leave open becomes the next question; questions stop one by one.  Rounds are bounded by the
questions' own number, which their depth gives, and every round's result is a table, so that a lost executor reads
it again.

Hooks: ``search`` takes (query_id, text) and gives hits (query_id, doc_id, rank); ``follow_up`` takes the
columns named below and gives the next question, null where the evidence is sufficient; ``write`` takes a text and gives its
facts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.session import cut

ENOUGH = 12
SAMPLE, BATCH, LEAST_DENSITY, SPARE = 8, 5, 0.5, 3


def asks_for_gaps(text: Column, n_sources: Column, gaps: Column, enough: int = ENOUGH) -> Column:
    """The next question of a stand-in: more about the terms that no hit holds, while there are few sources."""
    return F.when((n_sources < enough) & (F.size(gaps) > 0), F.concat(F.lit("additional evidence for "), F.array_join(gaps, " ")))


def open_terms(questions: DataFrame, hits: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, gaps: the key terms of each question that none of its hits' texts holds, sorted."""
    terms = questions.select("query_id", F.explode(X.key_terms(F.col("text"))).alias("term"))
    held = hits.select("query_id", "doc_id").join(texts.select("doc_id", "text"), "doc_id").join(questions.select("query_id", X.key_terms(F.col("text")).alias("asked")), "query_id")
    held = held.select("query_id", F.explode(F.array_intersect("asked", X.key_terms(F.col("text")))).alias("term")).distinct()
    return terms.join(held, ["query_id", "term"], "left_anti").groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("gaps"))


def question_rounds(questions: DataFrame, texts: DataFrame, search: Callable[[DataFrame], DataFrame], follow_up: Callable[[Column, Column, Column], Column] = asks_for_gaps) -> tuple[DataFrame, DataFrame]:
    """(hits, log) of ``questions`` (query_id, text, rounds: how many searches each may have).

    hits: query_id, doc_id, round, rank, number (of the source, by first appearance).  log: query_id, round, asked, n_new,
    n_sources, gaps, decision: ``follow_up``, ``sufficient``, or ``last`` where the rounds were over.
    A question without text is searched like any other; one whose rounds are null or below one is not asked.
    """
    most = questions.agg(F.max("rounds")).first()[0] or 0  # a number of the presets
    first = questions.filter("rounds >= 1")
    open_ = cut(first.select("query_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("text", F.lit("")).alias("asked"), "rounds"), "open_questions")
    found: list[DataFrame] = []
    logs: list[DataFrame] = []
    for k in range(1, most + 1):
        hits = search(open_.select("query_id", F.col("asked").alias("text"))).select("query_id", "doc_id", "rank")
        for before in found:
            hits = hits.join(before.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        found.append(cut(hits.withColumn("round", F.lit(k)), "round_hits"))
        seen = reduce(DataFrame.unionByName, found)
        counts = seen.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sources"), F.sum((F.col("round") == k).cast("long")).alias("n_new"))
        gaps = open_terms(open_.select("query_id", "text"), seen.join(open_.select("query_id"), "query_id", "left_semi"), texts)
        now = open_.join(counts, "query_id", "left").fillna(0, ["n_sources", "n_new"]).join(gaps, "query_id", "left")
        now = now.withColumn("gaps", F.coalesce("gaps", F.array().cast("array<string>"))).withColumn("next", follow_up(F.col("text"), F.col("n_sources"), F.col("gaps")))
        decision = F.when(F.col("rounds") <= k, "last").when(F.col("next").isNull(), "sufficient").otherwise("follow_up")
        logs.append(cut(now.withColumn("decision", decision).withColumn("round", F.lit(k)), "round_log"))
        open_ = cut(logs[-1].filter("decision = 'follow_up'").select("query_id", "text", F.col("next").alias("asked"), "rounds"), "open_questions")
        if open_.isEmpty():
            break
    empty = questions.sparkSession.createDataFrame([], f"query_id {questions.schema['query_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}, rank long, round int")
    all_hits = reduce(DataFrame.unionByName, found, empty)
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("round", "rank", "doc_id"))
    log = ["query_id", "round", "asked", "n_new", "n_sources", "gaps", "decision"]
    kinds = f"query_id {questions.schema['query_id'].dataType.simpleString()}, round int, asked string, n_new long, n_sources long, gaps array<string>, decision string"
    return all_hits.withColumn("number", number.cast("long")), reduce(DataFrame.unionByName, [x.select(log) for x in logs], questions.sparkSession.createDataFrame([], kinds))


def fact_rounds(chunks: DataFrame, write: Callable[[Column], Column], most: int = 60, sample: int = SAMPLE, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(facts, sums) of ``chunks`` (query_id, place from 0, text): facts of each question until there are ``most``.

    The first ``sample`` chunks give the facts a chunk; as many further chunks as that leaves wanting (with ``SPARE``) come in
    batches, a round each, and a question with enough facts drops out before the next.  Equal facts count once, by the first 12
    digits of their hash, the first one stays.  facts: query_id, place, at, fact; sums: query_id, density, chunks, facts.
    ``most`` and the least density bound the rounds: 2 * ``most`` / ``batch`` and one.
    """

    def extracted(some: DataFrame, label: str) -> DataFrame:
        return cut(some.select("query_id", "place", F.posexplode(write(F.col("text"))).alias("at", "fact")), label)

    first = chunks.filter(F.col("place") < sample)
    made = [extracted(first, "sample_facts")]
    sampled = made[0].groupBy("query_id").agg(F.count(F.lit(1)).alias("n_facts"))
    n_chunks = chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_all"), F.sum((F.col("place") < sample).cast("long")).alias("n_read"))
    state = n_chunks.join(sampled, "query_id", "left").fillna(0, ["n_facts"]).withColumn("density", F.col("n_facts") / F.col("n_read"))
    wanted = F.floor((F.lit(most) - F.col("n_facts")) / F.greatest("density", F.lit(LEAST_DENSITY))) + SPARE
    state = cut(state.withColumn("until", F.least("n_all", F.when(F.col("n_facts") >= most, 0).otherwise(F.col("n_read") + wanted))), "fact_state")
    while True:
        due = state.filter((F.col("n_facts") < most) & (F.col("n_read") < F.col("until")))
        if due.isEmpty():
            break
        ask = due.select("query_id", F.col("n_read").alias("lo"), F.least(F.col("n_read") + batch, F.col("until")).alias("hi"))
        some = chunks.join(ask, "query_id").filter((F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
        made.append(extracted(some, "round_facts"))
        new = made[-1].groupBy("query_id").agg(F.count(F.lit(1)).alias("n_new"))
        joined = state.join(ask, "query_id", "left").join(new, "query_id", "left")
        state = cut(joined.select("query_id", "n_all", F.coalesce("hi", "n_read").alias("n_read"), (F.col("n_facts") + F.coalesce("n_new", F.lit(0))).alias("n_facts"), "density", "until"), "fact_state")
    facts = reduce(DataFrame.unionByName, made).withColumn("hash", F.substring(F.md5("fact"), 1, 12))
    facts = facts.groupBy("query_id", "hash").agg(F.min(F.struct("place", "at", "fact")).alias("f")).select("query_id", "f.*")
    kept = facts.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "at"))).filter(F.col("_k") <= most).drop("_k")
    counted = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("facts"))
    sums = state.join(counted, "query_id", "left").select("query_id", "density", F.col("n_read").alias("chunks"), F.coalesce("facts", F.lit(0)).alias("facts"))
    return kept, sums
