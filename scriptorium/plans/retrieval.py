"""Search over ``documents`` and ``embeddings``; the questions are ``benchmark`` items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import text as X
from scriptorium.functions import vectors as V
from scriptorium.operators import context as C
from scriptorium.operators import search as S
from scriptorium.session import cut, table

_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_TERMS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: length(t) > 2 AND NOT list_contains(" + _STOP + ", t))"
_BM25 = f"""t AS (SELECT doc_id, {_TERMS} AS terms FROM documents), p AS (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM t), f AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL),
  c AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM t), dfs AS (SELECT term, count(*) AS df FROM f GROUP BY 1), q AS (SELECT DISTINCT item_id AS query_id, unnest({_TERMS}) AS term FROM benchmark),
  b AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25_score FROM q JOIN f USING (term) JOIN dfs USING (term), c GROUP BY 1, 2),
  kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, doc_id) AS bm25_rank FROM b) WHERE bm25_rank <= 20)"""
_VEC = """qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
  sv AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS similarity FROM qv, embeddings),
  sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS semantic_rank FROM sv) WHERE semantic_rank <= 20)"""
_FUSED = f"""{_BM25}, {_VEC}, j AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.doc_id, k.doc_id) AS doc_id, semantic_rank, bm25_rank FROM sem s FULL JOIN kw k ON s.query_id = k.query_id AND s.doc_id = k.doc_id),
  h AS (SELECT *, round(coalesce(0.7::DOUBLE / (60 + semantic_rank), 0) + coalesce(0.3::DOUBLE / (60 + bm25_rank), 0), 9) AS score FROM j),
  fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, semantic_rank NULLS LAST, bm25_rank NULLS LAST, doc_id) AS rank FROM h) WHERE rank <= 10)"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings")
    asked = _questions(spark, sf_dir).join(v, F.col("vec_id") == F.col("query_id")).select("query_id", F.col("embedding").alias("query_vector"))
    return v.select(F.col("vec_id").alias("doc_id"), "embedding", "label"), asked


def fused(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    keyword = S.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _questions(spark, sf_dir), 20)
    return S.fuse(S.nearest(vectors, asked, 20, "doc_id"), keyword, k)


@query(f"WITH {_BM25} SELECT c.n, round(c.avgdl, 6) AS avgdl, (SELECT count(*) FROM dfs) AS n_terms, (SELECT CAST(sum(tf) AS BIGINT) FROM f) AS n_tokens FROM c")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lengths = docs.select(F.size(X.index_terms(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("n_tokens"))
    terms = S.postings(docs).agg(F.countDistinct("term").alias("n_terms"))
    return lengths.join(F.broadcast(terms)).select("n", "avgdl", "n_terms", "n_tokens")


@query(f"WITH {_BM25} SELECT query_id, doc_id, bm25_score, bm25_rank FROM kw")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _questions(spark, sf_dir), 20).select("query_id", "doc_id", "bm25_score", "bm25_rank")


@query(f"WITH {_VEC} SELECT query_id, doc_id, similarity, semantic_rank FROM sem")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    return S.nearest(vectors, asked, 20, "doc_id").select("query_id", "doc_id", "similarity", "semantic_rank")


@query("""WITH qv AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS qe FROM benchmark JOIN embeddings ON vec_id = item_id), v AS (SELECT * FROM embeddings WHERE label IN (1, 3, 5) AND vec_id % 4 <> 0),
  s AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(qe, embedding::DOUBLE[]), 6) AS similarity FROM qv, v)
  SELECT query_id, doc_id, similarity, semantic_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS semantic_rank FROM s) WHERE semantic_rank <= 5""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter stands before the search, so every query gets its five."""
    vectors, asked = _vectors(spark, sf_dir)
    return S.nearest(vectors.filter(F.col("label").isin(1, 3, 5) & (F.col("doc_id") % 4 != 0)), asked, 5, "doc_id").select("query_id", "doc_id", "similarity", "semantic_rank")


_OWNED = "(SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'u' || (doc_id % 5) END AS user_id FROM documents)"


def _owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("u"), (F.col("doc_id") % 5).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", owner.alias("user_id"))


@query(f"SELECT doc_id FROM {_OWNED} WHERE user_id IS NULL")
def visibility_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).filter(S.visible(F.col("user_id"), "u2", "shared_only")).select("doc_id")


@query(f"SELECT doc_id FROM {_OWNED} WHERE user_id = 'u2'")
def visibility_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).filter(S.visible(F.col("user_id"), "u2", "user_only")).select("doc_id")


@query(f"SELECT doc_id FROM {_OWNED} WHERE user_id = 'u2' OR user_id IS NULL")
def visibility_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _owned(spark, sf_dir).filter(S.visible(F.col("user_id"), "u2", "both")).select("doc_id")


@query(f"WITH {_FUSED} SELECT query_id, doc_id, score, rank, semantic_rank, bm25_rank FROM fused")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "doc_id", "score", "rank", "semantic_rank", "bm25_rank")


@query(f"WITH {_FUSED} SELECT query_id, min(score) AS lowest, max(score) AS highest, count(*) AS n FROM fused GROUP BY 1")
def score_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).groupBy("query_id").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_BM25}, {_VEC}, first_list AS (SELECT query_id, source, min(semantic_rank) AS r FROM sem JOIN documents USING (doc_id) GROUP BY ALL), later AS (SELECT query_id, source, min(bm25_rank) AS r FROM kw JOIN documents USING (doc_id) GROUP BY ALL),
  listed AS (SELECT query_id, source, 0 AS list, r FROM first_list UNION ALL SELECT query_id, source, 1, r FROM later), placed AS (SELECT query_id, source, min(list * 1000000 + r) AS place FROM listed GROUP BY ALL)
  SELECT query_id, source, row_number() OVER (PARTITION BY query_id ORDER BY place) AS number FROM placed""")
def number_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources keep the numbers of the first list; those that only a later list has get the numbers behind."""
    vectors, asked = _vectors(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    lists = (S.nearest(vectors, asked, 20, "doc_id").withColumnRenamed("semantic_rank", "r"), S.bm25(docs.select("doc_id", "text"), _questions(spark, sf_dir), 20).withColumnRenamed("bm25_rank", "r"))
    places = [x.join(docs.drop("text"), "doc_id").groupBy("query_id", "source").agg(F.min("r").alias("r")).withColumn("list", F.lit(i)) for i, x in enumerate(lists)]
    first = places[0].unionByName(places[1]).groupBy("query_id", "source").agg(F.min(F.struct("list", "r")).alias("place"))
    return first.select("query_id", "source", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).cast("long").alias("number"))


_WITH_DOCS = f"{_FUSED}, d AS (SELECT f.*, source, n_chars FROM fused f JOIN documents USING (doc_id))"


def _with_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")


@query(f"WITH {_WITH_DOCS} SELECT query_id, source, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM d) WHERE k <= 1")
def per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.cap_per_group(_with_docs(spark, sf_dir), "source", 1).select("query_id", "source", "doc_id", "rank")


@query(f"""WITH {_WITH_DOCS}, m AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source) AS f FROM d), n AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY f) AS number FROM m)
  SELECT query_id, source, doc_id, number FROM n WHERE number <= 5""")
def paper_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numbered(_with_docs(spark, sf_dir), "source", 5).select("query_id", "source", "doc_id", "number")


@query(f"""WITH {_WITH_DOCS}, bg AS (SELECT *, 4000 - coalesce(sum(n_chars) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM d)
  SELECT query_id, doc_id, rank, CAST(least(n_chars, room) AS BIGINT) AS taken, n_chars > room AS shortened FROM bg WHERE (n_chars <= room OR room > 200) AND least(n_chars, room) > 0""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.within_budget(_with_docs(spark, sf_dir), "n_chars", 4000).select("query_id", "doc_id", "rank", F.col("taken").cast("long").alias("taken"), "shortened")


@query(f"""WITH {_WITH_DOCS}, m AS (SELECT *, min(rank) OVER (PARTITION BY query_id, source) AS f FROM d)
  SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY f, doc_id) AS place FROM m""")
def ordered_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min("rank").over(Window.partitionBy("query_id", "source"))
    rows = _with_docs(spark, sf_dir).withColumn("f", first)
    return rows.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("f", "doc_id")).cast("long").alias("place"))


@query(f"""WITH {_FUSED}, s AS (SELECT query_id, doc_id, rank, round(len(list_intersect(list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+')), list_distinct(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}_]+'))))
   / greatest(len(list_distinct(regexp_extract_all(lower(b.text), '[\\p{{L}}\\p{{N}}_]+'))), 1)::DOUBLE, 6) AS overlap FROM fused JOIN benchmark b ON item_id = query_id JOIN documents d USING (doc_id))
  SELECT query_id, doc_id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS reranked FROM s""")
def rerank_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline scorer: the share of a question's words that a document holds."""
    asked = _questions(spark, sf_dir).select("query_id", F.array_distinct(X.tokens(F.col("text"))).alias("q"))
    hits = cut(fused(spark, sf_dir), "hits")
    docs = table(spark, sf_dir, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")  # before it's tokenised
    rows = hits.join(asked, "query_id").join(docs.select("doc_id", F.array_distinct(X.tokens(F.col("text"))).alias("d")), "doc_id")
    rows = rows.withColumn("overlap", F.round(F.size(F.array_intersect("q", "d")) / F.greatest(F.size("q"), F.lit(1)), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank")
    return rows.select("query_id", "doc_id", "overlap", F.row_number().over(order).cast("long").alias("reranked"))


@query(f"""WITH {_BM25}, {_VEC}, u AS (SELECT query_id, doc_id, 1 AS list, semantic_rank AS r FROM sem UNION ALL SELECT query_id, doc_id, 2, bm25_rank FROM kw)
  SELECT query_id, doc_id, list, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list, r) AS k FROM u) WHERE k = 1""")
def multi_query_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, asked = _vectors(spark, sf_dir)
    a = S.nearest(vectors, asked, 20, "doc_id").select("query_id", "doc_id", F.lit(1).alias("list"), F.col("semantic_rank").alias("r"))
    b = S.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), _questions(spark, sf_dir), 20).select("query_id", "doc_id", F.lit(2).alias("list"), F.col("bm25_rank").alias("r"))
    w = Window.partitionBy("query_id", "doc_id").orderBy("list", "r")
    return a.unionByName(b).withColumn("k", F.row_number().over(w)).filter("k = 1").drop("k")


@query(f"""WITH {_BM25}, truth AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))
  SELECT t.query_id, count(*) AS relevant, count(k.doc_id) AS found, round(count(k.doc_id) / count(*)::DOUBLE, 6) AS recall FROM truth t LEFT JOIN kw k ON k.query_id = t.query_id AND k.doc_id = t.doc_id GROUP BY 1""")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword search against the documents that hold the question's text verbatim."""
    docs, asked = table(spark, sf_dir, "documents").select("doc_id", "text"), _questions(spark, sf_dir)
    # a document that holds the text holds its terms: candidates come from the index, not from all pairs
    terms = asked.select("query_id", F.array_distinct(X.index_terms(F.col("text"))).alias("terms"))
    wanted = terms.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    full = wanted.join(S.postings(docs), "term").groupBy("query_id", "n", "doc_id").agg(F.count(F.lit(1)).alias("m")).filter("m >= n - 2")
    truth = full.join(asked.withColumnRenamed("text", "q"), "query_id").join(docs, "doc_id").filter(F.col("text").contains(F.col("q"))).select("query_id", "doc_id")
    hits = S.bm25(docs, asked, 20).select("query_id", "doc_id", F.lit(1).alias("hit"))
    scored = truth.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"), F.count("hit").alias("found"))
    return scored.withColumn("recall", F.round(F.col("found") / F.col("relevant"), 6))


@query(f"""WITH {_WITH_DOCS}, sg AS (SELECT query_id, count(*) AS n, count(*) FILTER (score > 0.012) AS high, count(DISTINCT source) AS sources FROM d GROUP BY 1),
  cf AS (SELECT *, 0.35 * high / n + 0.30 * least(1.0, sources / 10.0) + 0.25 * 0.5 AS v FROM sg)
  SELECT query_id, sources, round(v, 6) AS confidence, CASE WHEN v >= 0.85 THEN 'generate' WHEN v >= 0.65 THEN 'expand' ELSE 'full_sequential' END AS recommendation,
   CASE WHEN sources >= 10 THEN 'HIGH' WHEN sources >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM cf""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance, diversity and (neutral) term coverage of each question's hits."""
    by = _with_docs(spark, sf_dir).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") > 0.012).cast("int")).alias("high"), F.countDistinct("source").alias("sources"))
    v = 0.35 * F.col("high") / F.col("n") + 0.30 * F.least(F.lit(1.0), F.col("sources") / 10.0) + 0.25 * 0.5
    advice = F.when(v >= 0.85, "generate").when(v >= 0.65, "expand").otherwise("full_sequential")
    level = F.when(F.col("sources") >= 10, "HIGH").when(F.col("sources") >= 5, "MEDIUM").otherwise("LOW")
    return by.select("query_id", "sources", F.round(v, 6).alias("confidence"), advice.alias("recommendation"), level.alias("level"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x)) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS unit_sum FROM embeddings""")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.aggregate(V.unit(F.col("embedding")), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(unit, 6).alias("unit_sum"))


@query(None)
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's hits in rank order; one that shares over 0.8 of its words with a kept one goes."""
    words = table(spark, sf_dir, "documents").select("doc_id", X.word_set(F.col("text")).alias("words"))
    return C.distinct_hits(_hits_with(spark, sf_dir, words), "words").select("query_id", "doc_id", "rank")


@query(None)
def assembled_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search, two hits a source, no near copies, numbered sources, 6000 characters: a question's context and references."""
    reference = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("Doc "), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text", X.word_set(F.col("text")).alias("words"), reference.alias("reference"))
    return C.assemble(_hits_with(spark, sf_dir, docs), "source", "words", "text", "reference", budget=6000)


def _hits_with(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """The fused hits with columns of their documents."""
    hits = cut(fused(spark, sf_dir).select("query_id", "doc_id", "rank"), "hits")
    return hits.join(docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
