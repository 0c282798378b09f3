"""Questions in rounds, references against answers, similar questions asked before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators import models as M
from scriptorium.operators import proximity, search
from scriptorium.operators.question_cache import cached_questions
from scriptorium.operators.rounds import fact_rounds, question_rounds
from scriptorium.operators.series import placed
from scriptorium.session import table

def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference for each document, by the first word of four letters that ends one of its sentences."""
    surname, year = F.regexp_extract("text", r"([A-Z]?[a-z]{3,})\.", 1), 2000 + F.col("doc_id") % 25
    reference = F.concat(surname, F.lit(", A. ("), year.cast("string"), F.lit("). A title."))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), (F.col("doc_id") + 1).alias("place"), reference.alias("reference"), year.alias("year"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers whose sentences end with a year, and with a number in brackets at the end."""
    dated = F.replace("text", F.lit(". "), F.concat(F.lit(" ("), (2000 + F.col("conv_id") % 25).cast("string"), F.lit("). ")))
    text = F.concat(dated, F.lit(" ["), (F.col("conv_id") % 60).cast("string"), F.lit("]"))
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", text.alias("text"))


@query(None)
def references_in_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' references against all answers: by surname near a year, near their own year, or by number."""
    return proximity.cited_pairs(_said(spark, sf_dir), _references(spark, sf_dir), ["conv_id", "turn"])


def _asked_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's turn asked, asked a little differently, and asked once more a quarter of an hour later."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    number, at = (F.col("conv_id") * 100 + F.col("turn")) * 3, F.col("conv_id") * 60 + F.col("turn") * 7
    other = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), F.col("text"), F.lit(" "))).when(F.col("turn") % 3 == 1, F.concat("text", F.lit(" please"))).otherwise(F.concat("text", F.lit(" and tell me more of all this now")))
    ask = lambda k, later, text: F.struct((number + k).alias("id"), (at + later).alias("at"), text.alias("text"))
    asks = F.explode(F.array(ask(0, 0, F.col("text")), ask(1, 5, other), ask(2, 900, F.col("text"))))
    return turns.select((F.col("conv_id") % 10).alias("session"), asks.alias("a")).select("session", "a.*")


@query(r"""WITH RECURSIVE u AS (SELECT conv_id % 10 AS session, (conv_id * 100 + turn) * 3 AS id, conv_id * 60 + turn * 7 AS t, text, CASE turn % 3 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN text || ' please' ELSE text || ' and tell me more of all this now' END AS other FROM conversations WHERE role = 'user'),
  q AS (SELECT session, id, t, text FROM u UNION ALL SELECT session, id + 1, t + 5, other FROM u UNION ALL SELECT session, id + 2, t + 900, text FROM u),
  k AS (SELECT session, id, t, lower(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS key FROM q WHERE length(trim(text)) > 0),
  o AS (SELECT *, list_distinct(string_split_regex(key, '\s+')) AS words, row_number() OVER (PARTITION BY session ORDER BY t, id) AS rn FROM k),
  r AS (
    SELECT DISTINCT session, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::VARCHAR AS kind, NULL::BIGINT AS answered_by, NULL::DOUBLE AS similarity, []::STRUCT(k VARCHAR, n BIGINT, id BIGINT, t BIGINT, w VARCHAR[])[] AS st FROM o
    UNION ALL
    SELECT session, rn, id, CASE WHEN hit IS NOT NULL THEN 'exact' WHEN best IS NOT NULL THEN 'similar' ELSE 'new' END, CASE WHEN hit IS NOT NULL THEN hit.id ELSE best.id END, CASE WHEN hit IS NOT NULL THEN 1.0 ELSE -best.s END,
      CASE WHEN hit IS NOT NULL THEN list_append(rest, hit) ELSE list_append(rest[-7:], struct_pack(k := key, n := rn, id := id, t := t, w := words)) END
    FROM (SELECT o.session, o.rn, o.id, o.t, o.key, o.words, list_filter(r.st, lambda e: e.k = o.key AND o.t - e.t <= 1800)[1] AS hit, list_filter(r.st, lambda e: e.k <> o.key) AS rest,
      list_sort(list_filter(list_transform(list_filter(r.st, lambda e: e.k <> o.key AND o.t - e.t <= 1800), lambda e: struct_pack(s := -(len(list_intersect(e.w, o.words)) / len(list_distinct(list_concat(e.w, o.words)))::DOUBLE), n := e.n, id := e.id)), lambda b: b.s <= -0.8))[1] AS best
      FROM r JOIN o ON o.session = r.session AND o.rn = r.rn + 1)
  )
  SELECT session, id, kind, answered_by, round(similarity, 9) AS similarity FROM r WHERE rn > 0""")
def question_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of ten sessions from caches of eight entries and half an hour: exact, similar or new."""
    return cached_questions(_asked_again(spark, sf_dir), size=8, ttl=1800).withColumn("similarity", F.round("similarity", 9))


_LINES = "len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 60))"


@query(f"""WITH c AS (SELECT source, doc_id, text, {_LINES} AS facts, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
  s AS (SELECT source, sum(facts) AS sampled, count(*) AS chunks FROM c WHERE place < 8 GROUP BY 1), n AS (SELECT *, sampled / chunks::DOUBLE AS density, CASE WHEN sampled >= 60 THEN 0 ELSE CAST(floor((60 - sampled) / greatest(sampled / chunks::DOUBLE, 0.5)) AS BIGINT) + 3 END AS needed FROM s),
  b AS (SELECT source, (place - 8) // 5 AS batch, sum(facts) AS facts, count(*) AS chunks FROM c JOIN n USING (source) WHERE place >= 8 AND place < 8 + needed GROUP BY 1, 2),
  r AS (SELECT *, coalesce(sum(facts) OVER (PARTITION BY source ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
  k AS (SELECT n.source, density, n.chunks + coalesce((SELECT sum(r.chunks) FROM r WHERE r.source = n.source AND sampled + before < 60), 0) AS chunks FROM n),
  f AS (SELECT source, unnest(list_filter(string_split(text, chr(10)), lambda x: length(x) > 60)) AS fact FROM c JOIN k USING (source) WHERE place < k.chunks)
  SELECT source AS query_id, round(density, 6) AS density, CAST(chunks AS BIGINT) AS chunks, least(60, (SELECT count(DISTINCT substr(md5(fact), 1, 12)) FROM f WHERE f.source = k.source)) AS facts FROM k""")
def facts_until_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts (lines of over 60 characters) of each source's documents, a sample first and then batches, until there are 60."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", "text")
    chunks = placed(docs, ["query_id"], F.floor(F.col("doc_id") / 4096), ["doc_id"])
    _, sums = fact_rounds(chunks, lambda t: F.filter(F.split(t, "\n"), lambda x: F.length(x) > 60))
    return sums.withColumn("density", F.round("density", 6))


@query(None)
def searched_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions of one to three rounds: keyword search, reranked, and what each round decided."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text", (F.col("item_id") % 3 + 1).cast("int").alias("rounds"))

    def search_(asked: DataFrame) -> DataFrame:
        hits = search.bm25(docs, asked, 6).select("query_id", "doc_id", F.col("bm25_rank").alias("rank"))
        pairs = hits.join(docs, "doc_id").join(asked.withColumnRenamed("text", "question"), "query_id")
        return M.reranked(pairs, M.word_share, 4).select("query_id", "doc_id", F.col("reranked").alias("rank"))

    _, log = question_rounds(items, docs, search_)
    return log.select("query_id", "round", F.md5("asked").alias("asked_md5"), "n_new", "n_sources", F.size("gaps").cast("long").alias("gaps"), "decision")
