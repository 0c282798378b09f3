"""Records of bibliographic APIs, lookups by DOI, vocabulary, rates and retries, follow-up questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import ORACLES, query
from scriptorium.functions import questions as Q
from scriptorium.functions import text as X
from scriptorium.functions import validation as V
from scriptorium.operators import models as M
from scriptorium.operators import search
from scriptorium.operators.tables import count_if
from scriptorium.plans import retrieval
from scriptorium.plans.answers import _ANSWERED, _ASKED, _answered, _asked
from scriptorium.session import cut, table
from scriptorium.sources import readers


def _json(docs: DataFrame, schema: str, *fields) -> DataFrame:
    """Each row as a line of JSON, parsed by ``schema``."""
    line = F.to_json(F.struct(*fields))
    return docs.select(F.from_json(line, schema).alias("r")).select("r.*")


@query("""SELECT lower('10.1000/' || source || '.' || doc_id) AS doi, CASE WHEN doc_id % 7 = 0 THEN 'Unknown Title' ELSE substr(text, 1, 60) END AS title, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang || ' ' || source END AS authors,
  CAST(2000 + doc_id % 25 AS INTEGER) AS year, source AS venue, CAST(n_chars AS BIGINT) AS citation_count, md5(text) AS abstract_md5 FROM documents WHERE doc_id % 5 <> 0""")
def crossref_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossref records, one a document, parsed into papers."""
    is_ = lambda n: F.col("doc_id") % n == 0
    raw = _json(
        table(spark, sf_dir, "documents"), readers.CROSSREF,
        F.when(~is_(5), F.concat(F.lit("10.1000/"), F.upper("source"), F.lit("."), F.col("doc_id").cast("string"))).alias("DOI"), F.when(is_(7), F.array().cast("array<string>")).otherwise(F.array(F.substring("text", 1, 60))).alias("title"),
        F.array(F.struct(F.when(~is_(3), F.col("lang")).alias("given"), F.col("source").alias("family")), F.struct(F.col("lang").alias("given"), F.lit(None).cast("string").alias("family"))).alias("author"),
        F.struct(F.array(F.array((2000 + F.col("doc_id") % 25).cast("int"))).alias("date-parts")).alias("created"), F.array("source").alias("container-title"), F.col("n_chars").cast("long").alias("is-referenced-by-count"), F.col("text").alias("abstract"),
    )
    return readers.crossref_papers(raw).select("doi", "title", F.array_join("authors", "; ").alias("authors"), "year", "venue", "citation_count", F.md5("abstract").alias("abstract_md5"))


@query("""SELECT CASE WHEN doc_id % 4 <> 0 THEN '10.1000/' || doc_id END AS doi, substr(text, 1, 60) AS title, CAST(least(doc_id % 14, 10) AS INTEGER) AS authors, CAST(2000 + doc_id % 25 AS INTEGER) AS year, lang AS venue,
  coalesce(CASE WHEN doc_id % 6 <> 0 THEN CAST(n_chars AS BIGINT) END, 0) AS citation_count, 'https://example.org/' || doc_id || '.pdf' AS pdf_url FROM documents WHERE 2000 + doc_id % 25 BETWEEN 2005 AND 2020 AND doc_id % 3 = 0""")
def scholar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic Scholar records, one a document: the open ones of 2005 to 2020 as papers."""
    doc = F.col("doc_id").cast("string")
    open_ = F.col("doc_id") % 3 == 0
    raw = _json(
        table(spark, sf_dir, "documents"), readers.SCHOLAR,
        F.concat(F.lit("p"), doc).alias("paperId"), F.struct(F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("10.1000/"), doc)).alias("DOI")).alias("externalIds"), F.substring("text", 1, 60).alias("title"),
        F.transform(F.array_repeat("lang", (F.col("doc_id") % 14).cast("int")), lambda n: F.struct(n.alias("name"))).alias("authors"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), F.col("lang").alias("venue"), F.col("text").alias("abstract"),
        F.when(open_, F.struct(F.concat(F.lit("https://example.org/"), doc, F.lit(".pdf")).alias("url"))).alias("openAccessPdf"), open_.alias("isOpenAccess"), F.when(F.col("doc_id") % 6 != 0, F.col("n_chars").cast("long")).alias("citationCount"),
    )
    return readers.scholar_papers(raw, (2005, 2020), True).select("doi", "title", F.size("authors").alias("authors"), "year", "venue", "citation_count", "pdf_url")


@query("SELECT p_partkey, '10.1000/' || p_partkey AS doi FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def papers_by_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch lookup: papers whose DOI a list names, as a link or in capitals."""
    papers = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("10.1000/"), F.col("p_partkey").cast("string")).alias("doi"))
    wanted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("https://doi.org/10.1000/"), F.col("l_partkey").cast("string")).alias("doi"))
    return readers.by_dois(papers, wanted)


_TYPES = ", ".join("(" + ", ".join([str(k), *("NULL" if t is None else f"'{t}'" for t in row)]) + ")" for k, row in enumerate(readers.PUBLICATION_TYPES))


@query(f"""WITH m(k, kind, works, crossref, semantic_scholar) AS (VALUES {_TYPES})
  SELECT doc_id, kind, works, crossref, semantic_scholar FROM documents JOIN m ON doc_id % {len(readers.PUBLICATION_TYPES)} = k""")
def publication_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's type in the terms of three APIs."""
    kinds = F.array(*[F.lit(row[0]) for row in readers.PUBLICATION_TYPES])
    rows = table(spark, sf_dir, "documents").select("doc_id", F.get(kinds, (F.col("doc_id") % len(readers.PUBLICATION_TYPES)).cast("int")).alias("kind"))
    return rows.select("doc_id", "kind", *[readers.source_term(F.col("kind"), F.lit(a)).alias(a) for a in readers.APIS])


@query("""WITH s AS (SELECT user_id, epoch(max(ts)) - epoch(min(ts)) AS secs, count(*) FILTER (event_type = 'signup') AS dl, count(*) FILTER (event_type = 'click') AS em, count(*) FILTER (event_type = 'view') AS ch, count(*) FILTER (event_type = 'purchase') AS pdf FROM events GROUP BY 1)
  SELECT user_id, round(CASE WHEN secs > 0 THEN dl / secs * 60 ELSE 0 END, 9) AS downloads_per_minute, round(CASE WHEN secs > 0 THEN em / secs ELSE 0 END, 9) AS embeddings_per_second, round(CASE WHEN pdf > 0 THEN ch / pdf::DOUBLE ELSE 0 END, 6) AS chunks_per_pdf FROM s""")
def phase_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of three phases, 0 where nothing was measured."""
    of = lambda kind: count_if(F.col("event_type") == kind)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg((seconds(F.max("ts")) - seconds(F.min("ts"))).alias("secs"), of("signup").alias("dl"), of("click").alias("em"), of("view").alias("ch"), of("purchase").alias("pdf"))
    over = lambda a, b, k, digits: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b) * k).otherwise(0.0), digits)
    return sums.select("user_id", over("dl", "secs", 60, 9).alias("downloads_per_minute"), over("em", "secs", 1, 9).alias("embeddings_per_second"), over("ch", "pdf", 1, 6).alias("chunks_per_pdf"))


@query("""WITH s AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, max(ts) FILTER (event_type = 'error') AS last_bad, max(ts) FILTER (event_type <> 'error') AS last_good FROM events GROUP BY 1)
  SELECT user_id, failures, CASE WHEN last_good > last_bad THEN 'retried' WHEN failures >= 3 THEN 'abandoned' ELSE 'pending' END AS status, CASE WHEN last_good > last_bad OR failures >= 3 THEN NULL ELSE least(2.0 * pow(2, failures), 60.0) END AS delay FROM s WHERE failures > 0""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed items: retried once a later attempt succeeded, given up after three failures, else due again after a delay."""
    bad = F.col("event_type") == "error"
    sums = table(spark, sf_dir, "events").groupBy("user_id").agg(count_if(bad).alias("failures"), F.max(F.when(bad, F.col("ts"))).alias("last_bad"), F.max(F.when(~bad, F.col("ts"))).alias("last_good")).filter("failures > 0")
    status = F.when(F.col("last_good") > F.col("last_bad"), "retried").when(F.col("failures") >= 3, "abandoned").otherwise("pending")
    return sums.select("user_id", "failures", status.alias("status"), F.when(status == "pending", F.least(F.lit(2.0) * F.pow(F.lit(2.0), "failures"), F.lit(60.0))).alias("delay"))


@query("""WITH r AS (SELECT item_id, b.text, CASE WHEN item_id % 2 = 0 THEN '2010 and 2020' END AS timeframe, CASE WHEN item_id % 3 = 0 THEN lang END AS context, CASE WHEN item_id % 5 = 0 THEN source END AS include FROM benchmark b JOIN documents d ON doc_id = item_id),
  p AS (SELECT *, concat_ws(', ', 'published between ' || timeframe, 'in ' || context || ' contexts', 'including ' || include) AS added FROM r)
  SELECT item_id, CASE WHEN added = '' THEN text ELSE text || ' (' || added || ')' END AS refined FROM p""")
def refined_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the answers to what was asked back."""
    asked = table(spark, sf_dir, "benchmark").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source"), "item_id")
    when = lambda n, c: F.when(F.col("item_id") % n == 0, c)
    return asked.select("item_id", Q.refined(F.col("text"), when(2, F.lit("2010 and 2020")), when(3, F.col("lang")), when(5, F.col("source"))).alias("refined"))


@query(f"""WITH {_ASKED}, l AS (SELECT conv_id, turn, lower(text) AS t FROM q), a AS (SELECT conv_id, turn, list_filter([
   CASE WHEN (contains(t, 'camera') OR contains(t, 'enforcement')) AND NOT contains(t, 'rear-end crash') THEN 'red-light camera rear-end crash effects spillover' END,
   CASE WHEN (contains(t, 'camera') OR contains(t, 'enforcement')) AND NOT contains(t, 'speed compliance') THEN 'speed camera compliance rate effectiveness' END,
   CASE WHEN contains(t, 'effective') AND NOT contains(t, 'empirical bayes') THEN 'crash modification factor empirical bayes methodology' END], lambda x: x IS NOT NULL) AS queries FROM l)
  SELECT conv_id, turn, array_to_string(queries, '; ') AS queries FROM a WHERE len(queries) > 0""")
def targeted_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follow-up questions for what a question asks and its text doesn't cover."""
    made = _asked(spark, sf_dir).select("conv_id", "turn", Q.targeted(F.col("text"), Q.entities(F.col("text"))).alias("queries"))
    return made.filter(F.size("queries") > 0).select("conv_id", "turn", F.array_join("queries", "; ").alias("queries"))


_quoted = lambda p: "'" + p.replace("'", "''") + "'"
_START = " OR ".join(f"starts_with(lower(p), '{x}')" for x in V.INTRODUCTIONS)


@query(rf"""WITH {_ANSWERED}, t AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM a GROUP BY 1),
  s AS (SELECT conv_id, unnest(regexp_split_to_array(regexp_replace(text, '\n(#+\s)', chr(10) || chr(10) || '\1', 'g'), '\n\n+')) AS p FROM t), ps AS (SELECT conv_id, row_number() OVER () AS i, p FROM (SELECT conv_id, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM s) WHERE length(p) > 20),
  f AS (SELECT conv_id, i, regexp_extract_all(p, {_quoted(V.NUMBERED)}, 1) AS marks, len(regexp_extract_all(p, {_quoted(V.PARENTHETICAL)})) + len(regexp_extract_all(p, {_quoted(V.NARRATIVE)})) AS authors,
   NOT (starts_with(p, '#') OR starts_with(p, '**') OR suffix(p, '?') OR contains(p, 'References') OR contains(lower(p), 'limitations') OR length(p) < 100 OR {_START}) AND (regexp_matches(p, {_quoted(V.CLAIM)}) OR (regexp_matches(lower(p), {_quoted(V.VERB)}) AND len(regexp_extract_all(p, '\S+')) > 10)) AS claim FROM ps),
  m AS (SELECT conv_id, i, unnest(marks) AS mark FROM f), c AS (SELECT conv_id, i, unnest(CASE WHEN contains(mark, '-') THEN range(CAST(split_part(mark, '-', 1) AS BIGINT), CAST(split_part(mark, '-', 2) AS BIGINT) + 1) ELSE list_transform(regexp_extract_all(mark, '\d+'), lambda x: CAST(x AS BIGINT)) END) AS n FROM m),
  k AS (SELECT conv_id, count(*) AS numbers, count(*) FILTER (n BETWEEN 1 AND 4) AS valid, coalesce(list(DISTINCT n ORDER BY n) FILTER (n BETWEEN 1 AND 4), []) AS cited FROM c GROUP BY 1), x AS (SELECT DISTINCT conv_id, i FROM c),
  g AS (SELECT f.conv_id, count(*) AS paragraphs, sum(authors) AS authors, count(*) FILTER (claim) AS claims, count(*) FILTER (claim AND authors = 0 AND x.i IS NULL) AS uncited FROM f LEFT JOIN x ON x.conv_id = f.conv_id AND x.i = f.i GROUP BY 1),
  b AS (SELECT t.conv_id, coalesce(paragraphs, 0) AS paragraphs, coalesce(authors, 0) AS authors, coalesce(claims, 0) AS claims, coalesce(uncited, 0) AS uncited, coalesce(numbers, 0) AS numbers, coalesce(valid, 0) AS valid, coalesce(cited, []) AS cited FROM t LEFT JOIN g USING (conv_id) LEFT JOIN k USING (conv_id)),
  s1 AS (SELECT *, CASE WHEN claims = 0 THEN 1.0::DOUBLE ELSE (claims - uncited) / claims::DOUBLE END AS v FROM b), s2 AS (SELECT *, CASE WHEN numbers + authors >= 15 THEN least(1.0, v + 0.1) ELSE v END AS w FROM s1), s3 AS (SELECT *, CASE WHEN numbers + authors >= 25 THEN least(1.0, w + 0.1) ELSE w END AS z FROM s2)
  SELECT conv_id, paragraphs, CAST(numbers + authors AS BIGINT) AS citations, numbers - valid AS invalid, uncited, cited AS cited_sources, round(CASE WHEN numbers > valid THEN z * 0.8 ELSE z END, 6) AS compliance, round((len(cited) + least(authors, 4 - len(cited))) / 4.0, 6) AS coverage, CASE WHEN y >= 0.9 THEN '🟢 Excellent' WHEN y >= 0.7 THEN '🟡 Good' WHEN y >= 0.5 THEN '🟠 Fair' ELSE '🔴 Poor' END AS badge FROM (SELECT *, CASE WHEN numbers > valid THEN z * 0.8 ELSE z END AS y FROM s3)""")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answers of a conversation as one text, against four sources."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    rows = _answered(spark, sf_dir).groupBy("conv_id").agg(whole.alias("text")).select("conv_id", V.judged(F.col("text")).alias("judged"))
    made = V.compliance(F.col("judged"), 4)
    return rows.select("conv_id", *[(F.round(c, 6) if n in ("compliance", "coverage") else c).alias(n) for n, c in made.items()], V.badge(made["compliance"]).alias("badge"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS low, count(*) * (1 + o_custkey % 6) AS high, ['Low', 'Medium', 'High'][(o_custkey % 3 + 1)::INT] AS depth, o_custkey % 4 = 0 AS preset FROM orders GROUP BY 1),
  t AS (SELECT *, CASE depth WHEN 'Low' THEN 10 WHEN 'Medium' THEN 25 ELSE 50 END AS usual, (low + high) // 2 AS middle FROM o)
  SELECT o_custkey, depth, CAST(CASE WHEN preset THEN usual ELSE middle END AS BIGINT) AS target, CAST(CASE WHEN preset THEN floor(usual * 0.6) ELSE low END AS BIGINT) AS least, CAST(CASE WHEN preset THEN floor(usual * 1.4) ELSE high END AS BIGINT) AS most,
   CASE WHEN preset THEN NULL WHEN middle < usual * 0.7 THEN 'narrow' WHEN middle > usual * 1.5 THEN 'wide' END AS warning FROM t""")
def paper_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many papers to look for: the depth's number, or the middle of a range that was asked for, with a warning where they differ much."""
    key = F.col("o_custkey")
    asked = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("low")).withColumn("high", F.col("low") * (1 + key % 6))
    depth = F.element_at(F.array(*map(F.lit, ("Low", "Medium", "High"))), (key % 3 + 1).cast("int"))
    made = Q.paper_target(depth, F.when(key % 4 != 0, F.col("low")), F.when(key % 4 != 0, F.col("high")))
    return asked.select("o_custkey", depth.alias("depth"), *[c.alias(n) for n, c in made.items()])


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = cut(retrieval.fused(spark, sf_dir), "hits")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return hits.select("query_id", "doc_id", "rank").join(asked, "query_id").join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")


@query(ORACLES["rerank_lexical"])
def rerank_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by a scorer that any model can replace."""
    return M.reranked(_hits(spark, sf_dir), M.word_share).select("query_id", "doc_id", F.col("score").alias("overlap"), "reranked")


@query(None)
def hypothetical_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by a written answer: here the question with the beginning of its best keyword hit."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = cut(search.bm25(docs, asked, 1), "best_hits").select("query_id", "doc_id").join(docs.withColumnRenamed("text", "found"), "doc_id")
    written = asked.join(best, "query_id", "left")
    vectors = cut(M.embedded(docs, M.hashed_words).select("doc_id", "embedding"), "text_vectors")
    answers = M.hypothetical(written, F.concat_ws(" ", "text", F.element_at(F.split("found", r"\n"), 1)), M.hashed_words)
    return search.nearest(vectors, cut(answers, "answer_vectors"), 5, "doc_id").select("query_id", "doc_id", "similarity", "semantic_rank")


_TERMS = r"list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: regexp_full_match(t, '[a-z]{3,}') AND NOT list_contains([" + ", ".join(f"'{w}'" for w in X.QUERY_STOP_WORDS) + "], t))"


@query(f"""WITH r AS ({ORACLES["rerank_lexical"]}), h AS (SELECT r.query_id, doc_id, overlap, reranked, lower(d.text) AS t, lang FROM r JOIN documents d USING (doc_id)),
  k AS (SELECT item_id AS query_id, {_TERMS} AS ks FROM benchmark), u AS (SELECT query_id, generate_subscripts(ks, 1) AS pos, unnest(ks) AS term FROM k),
  f AS (SELECT query_id, pos, max(CASE WHEN contains(t, term) THEN 1 ELSE 0 END) AS hit FROM u JOIN h USING (query_id) WHERE reranked <= 20 GROUP BY 1, 2), c AS (SELECT query_id, avg(hit) AS terms FROM f GROUP BY 1),
  g AS (SELECT query_id, avg(CASE WHEN overlap > 0.75 THEN 1.0::DOUBLE ELSE 0 END) AS relevance, least(1.0, count(DISTINCT doc_id) / 10.0::DOUBLE) AS diversity, least(1.0, count(DISTINCT CASE WHEN reranked <= 20 THEN lang END) / 4.0::DOUBLE) AS sections FROM h GROUP BY 1),
  v AS (SELECT query_id, relevance, diversity, coalesce(terms, 0.5) AS terms, sections, round(0.35 * relevance + 0.30 * diversity + 0.25 * coalesce(terms, 0.5) + 0.10 * sections, 6) AS confidence FROM g LEFT JOIN c USING (query_id))
  SELECT query_id, round(relevance, 6) AS relevance, round(diversity, 6) AS diversity, round(terms, 6) AS terms, round(sections, 6) AS sections, confidence, CASE WHEN confidence >= 0.85 THEN 'generate' WHEN confidence >= 0.65 THEN 'expand' ELSE 'full_sequential' END AS recommendation FROM v""")
def confidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four signals of each question's hits: relevant ones, documents against ten, its terms in the first 20, sections (here languages) against four."""
    ranked = cut(retrieval.rerank_lexical(spark, sf_dir), "ranked_hits")
    hits = ranked.join(table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"), "lang"), "doc_id")
    first = F.col("reranked") <= 20
    terms = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(X.key_terms(F.col("text"))).alias("pos", "term"))
    found = terms.join(hits.filter(first), "query_id").groupBy("query_id", "pos").agg(F.max(F.contains("t", "term").cast("int")).alias("hit")).groupBy("query_id").agg(F.avg("hit").alias("terms"))
    share = lambda c, most: F.least(F.lit(1.0), c / float(most))
    signals = hits.groupBy("query_id").agg(
        F.avg((F.col("overlap") > 0.75).cast("double")).alias("relevance"), share(F.countDistinct("doc_id"), 10).alias("diversity"), share(F.countDistinct(F.when(first, F.col("lang"))), 4).alias("sections"),
    ).join(found, "query_id", "left").withColumn("terms", F.coalesce("terms", F.lit(0.5)))
    made = signals.withColumn("confidence", F.round(0.35 * F.col("relevance") + 0.30 * F.col("diversity") + 0.25 * F.col("terms") + 0.10 * F.col("sections"), 6))
    advice = F.when(F.col("confidence") >= 0.85, "generate").when(F.col("confidence") >= 0.65, "expand").otherwise("full_sequential")
    return made.select("query_id", *[F.round(c, 6).alias(c) for c in ("relevance", "diversity", "terms", "sections")], "confidence", advice.alias("recommendation"))
