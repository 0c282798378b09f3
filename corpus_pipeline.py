"""Corpus cleaning: five stages over ``documents``, from raw rows to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the next stage's docs.  All stages but the last return
the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import kneser_ney, mixing, ngram_join, packing, substring_dedup
from scriptorium.operators.tables import fresh, one_row_each
from scriptorium.session import cut, table


def _small(keys: DataFrame, label: str) -> DataFrame:
    """``keys`` as a table, broadcast while it has at most ``BROADCAST_IDS`` rows."""
    keys = cut(keys, label)
    return F.broadcast(keys) if keys.count() <= ngram_join.BROADCAST_IDS else keys


def _join_rows(docs: DataFrame, keys: DataFrame, row_key: Column, how: str) -> DataFrame:
    """``docs`` joined to rows (doc_id, row_key, ...) of a stage, whatever columns ``docs`` has; null ids match each other."""
    a, b = fresh(docs, "of_doc_id"), fresh(docs, "of_row_key")
    keys = keys.withColumnsRenamed({"doc_id": a, "row_key": b})
    return docs.join(keys, F.col("doc_id").eqNullSafe(F.col(a)) & (row_key == F.col(b)), how)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Kneser-Ney model of the trusted ones accepts."""
    judged = kneser_ney.classify(docs, table(spark, sf_dir, "labels"))
    rejected = judged.filter("not kept").select("doc_id", F.col("key").alias("row_key")).distinct()
    return _join_rows(docs, _small(rejected, "rejected"), kneser_ney.text_key("lang", "text"), "left_anti")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id; of a document's rows, the one with the greatest text."""
    copies = ngram_join.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    rows, _ = one_row_each(docs, "doc_id", "text", ngram_join.BROADCAST_IDS)
    return rows.join(_small(copies, "near_copies"), "doc_id", "left_anti").select(docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of repeated 200-byte strings; documents of which nothing remains go."""
    made = substring_dedup.remove_repeats(docs, keep_columns=True)
    left = made.filter((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text")}
    kind = {f.name: f.dataType for f in docs.schema.fields}
    of = lambda c: F.col(f"row.`{c}`")
    return left.select(*[(F.when(F.col("n_removed") == 0, of(c)).otherwise(new[c].cast(kind[c])) if c in new else of(c)).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    times = fresh(docs, "times")
    mixed = mixing.mix(docs).filter("taken > 0").groupBy("doc_id", "row_key").agg(F.max(F.expr("CAST(taken / size AS INT)")).alias(times))
    taken = _join_rows(docs, _small(mixed, "mix_times"), mixing.row_key(), "inner")
    return taken.withColumn(fresh(taken, "copy"), F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Shingle similarity, suffix arrays and tokenisers are beyond SQL: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
