import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import kneser_ney, mixing, ngram_join, packing, substring_dedup


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["quality classifier"](spark, docs, sf).cache()
    judged = kneser_ney.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in judged.filter("kept").collect()}
    one = stages["n-gram Jaccard join"](spark, kept, sf).cache()
    assert {r.doc_id for r in one.collect()} == {r.component_id for r in ngram_join.near_duplicates(kept).collect()}
    cut = stages["suffix-array dedup"](spark, one, sf).cache()
    n = {r.doc_id: r.n_bytes - r.n_removed for r in substring_dedup.remove_repeats(one).collect()}
    assert cut.columns == docs.columns and {r.doc_id: len(r.text.encode()) for r in cut.collect()} == {i: x for i, x in n.items() if x}
    mixed = stages["source mixing"](spark, cut, sf).cache()
    taken = {r.doc_id: r.taken // r.size for r in mixing.mix(cut).filter("taken > 0").collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken
    packed = stages["best-fit packing"](spark, mixed, sf)
    assert packed.filter("piece = 0").count() == mixed.count() and packed.agg({"length": "max"}).first()[0] <= packing.CAPACITY


def test_stages_keep_a_document_delivered_twice(spark, sf, docs):
    stages = dict(corpus_pipeline.STAGES)
    rows = docs.filter("doc_id in (9, 13)")  # 9 is there twice
    one = stages["n-gram Jaccard join"](spark, rows, sf).cache()
    assert sorted(r.doc_id for r in one.collect()) == [9, 13] and one.columns == docs.columns
    text = docs.filter("doc_id = 9").first().text
    for given in (one, rows):
        left = stages["suffix-array dedup"](spark, given, sf).filter("doc_id = 9").collect()
        assert [r.text for r in left] == [text] * given.filter("doc_id = 9").count()


CLASHES = "lang_ of_doc_id of_row_key row_key key times copy doc row id n_removed cuts kept_text r _cuts size taken kept perplexity component_id n_shingles".split()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages_keep_columns_and_rows_of_null_ids(spark, sf, docs, no_docs, name, stage):
    given = docs
    for c in CLASHES:
        given = given.withColumn(c, F.lit(f"own {c}"))
    null_id = docs.filter("doc_id is null")
    given = given.unionByName(null_id.withColumn("text", F.concat("text", F.lit(" more"))), allowMissingColumns=True)
    made = stage(spark, given, sf).cache()
    assert made.columns == given.columns and made.schema["n_chars"].dataType == given.schema["n_chars"].dataType
    assert made.filter("doc_id is not null and kept_text <> 'own kept_text'").count() == 0
    if name != "source mixing":
        assert made.filter("doc_id is null").count() == 2
    else:
        assert made.filter("doc_id is null").select("text").distinct().count() >= 1
    empty = stage(spark, no_docs, sf)
    assert empty.columns == no_docs.columns and empty.count() == 0


def test_packing_takes_clashing_columns(docs, no_docs, spark, sf):
    stage = dict(corpus_pipeline.STAGES)["best-fit packing"]
    given = docs
    for c in ("piece", "start", "length", "sequence_id", "offset", "ids"):
        given = given.withColumn(c, F.lit("own"))
    assert stage(spark, given, sf).filter("piece = 0").count() == docs.count() and stage(spark, no_docs, sf).count() == 0
