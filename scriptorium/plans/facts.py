"""Facts, plans and references; states of a corpus under way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import facts as K
from scriptorium.operators.series import placed
from scriptorium.session import table


def _listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_KINDS = ("Empirical", "conceptual model", "survey", "SIMULATION", "case_study")
_CLAIM = "trim(split_part(text, chr(10), 1))"


@query(f"""WITH r AS (SELECT conv_id, turn, {_CLAIM} AS claim, {list(_KINDS)}[(turn % 5 + 1)::INT] AS kind, ['High', 'unsure', 'low'][(conv_id % 3 + 1)::INT] AS sure, role FROM conversations)
  SELECT conv_id, turn, 'fact_' || substr(md5(claim), 1, 12) AS fact_id, CASE WHEN lower(kind) IN {_listed(K.METHODOLOGIES)} THEN lower(kind) WHEN contains(lower(kind), 'conceptual') THEN 'theoretical' ELSE 'other' END AS methodology,
   CASE WHEN lower(sure) IN {_listed(K.CERTAINTIES)} THEN lower(sure) ELSE 'moderate' END AS certainty, CAST(CASE WHEN turn % 2 = 1 THEN 1990 + turn WHEN conv_id % 2 = 1 THEN 2000 ELSE 0 END AS INTEGER) AS year, ['road_' || role, 'speed'] AS topics
  FROM r WHERE claim <> ''""")
def fact_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from a model's JSON: unknown values fall back, topics become slugs, facts without a claim go."""
    at = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c + 1).cast("int"))
    reply = F.to_json(F.struct(
        F.split("text", "\n")[0].alias("claim_text"), at(_KINDS, F.col("turn") % 5).alias("methodology_type"), at(("High", "unsure", "low"), F.col("conv_id") % 3).alias("certainty"),
        F.when(F.col("turn") % 2 == 1, F.col("turn") + 1990).alias("year"), F.array(F.concat(F.lit("Road "), F.col("role")), F.lit("speed")).alias("topics"),
    ))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.from_json(reply, "claim_text string, methodology_type string, certainty string, year int, topics array<string>").alias("f"))
    claim, known = F.trim("f.claim_text"), F.when(F.col("conv_id") % 2 == 1, 2000)
    return rows.filter(claim != "").select(
        "conv_id", "turn", K.fact_id(claim).alias("fact_id"), K.methodology(F.col("f.methodology_type")).alias("methodology"), K.certainty(F.col("f.certainty")).alias("certainty"),
        K.first_given(F.col("f.year"), known).alias("year"), K.topic_slugs(F.col("f.topics")).alias("topics"),
    )


@query("""WITH c AS (SELECT source, doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) > 60)) AS facts, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
  s AS (SELECT source, sum(facts) AS sampled, count(*) AS chunks FROM c WHERE place < 8 GROUP BY 1), n AS (SELECT *, sampled / chunks::DOUBLE AS density, CASE WHEN sampled >= 60 THEN 0 ELSE CAST(floor((60 - sampled) / greatest(sampled / chunks::DOUBLE, 0.5)) AS BIGINT) + 3 END AS needed FROM s),
  b AS (SELECT source, (place - 8) // 5 AS batch, sum(facts) AS facts, count(*) AS chunks FROM c JOIN n USING (source) WHERE place >= 8 AND place < 8 + needed GROUP BY 1, 2),
  r AS (SELECT *, coalesce(sum(facts) OVER (PARTITION BY source ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b), k AS (SELECT r.* FROM r JOIN n USING (source) WHERE sampled + before < 60),
  t AS (SELECT source, sum(facts) AS facts, sum(chunks) AS chunks FROM k GROUP BY 1)
  SELECT source, round(density, 6) AS density, CAST(n.chunks + coalesce(t.chunks, 0) AS BIGINT) AS chunks, CAST(least(60, sampled + coalesce(t.facts, 0)) AS BIGINT) AS facts FROM n LEFT JOIN t USING (source)""")
def fact_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts a chunk from a source's first eight chunks; then batches of five until 60 facts are there.

    What follows the sample is bounded by the facts still wanted, so the running sums are over short groups.
    """
    most, sample, batch = 60, 8, 5
    facts = F.size(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 60)).cast("long")
    chunks = placed(table(spark, sf_dir, "documents").select("source", "doc_id", facts.alias("facts")), ["source"], F.floor(F.col("doc_id") / 4096), ["doc_id"]).drop("group_rows")
    first = chunks.filter(F.col("place") < sample).groupBy("source").agg(F.sum("facts").alias("sampled"), F.count(F.lit(1)).alias("n"))
    first = first.withColumn("density", F.col("sampled") / F.col("n"))
    needed = F.when(F.col("sampled") >= most, 0).otherwise(F.floor((F.lit(most) - F.col("sampled")) / F.greatest("density", F.lit(0.5))) + 3)
    first = first.withColumn("needed", needed)
    more = chunks.filter(F.col("place") >= sample).join(first, "source").filter(F.col("place") < F.col("needed") + sample)
    more = more.groupBy("source", "sampled", F.floor((F.col("place") - sample) / batch).alias("batch")).agg(F.sum("facts").alias("facts"), F.count(F.lit(1)).alias("chunks"))
    before = F.sum("facts").over(Window.partitionBy("source").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    read = more.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("sampled") + F.col("before") < most).groupBy("source").agg(F.sum("facts").alias("facts"), F.sum("chunks").alias("chunks"))
    return first.join(read, "source", "left").select(
        "source", F.round("density", 6).alias("density"), (F.col("n") + F.coalesce("chunks", F.lit(0))).alias("chunks"), F.least(F.lit(most), F.col("sampled") + F.coalesce("facts", F.lit(0))).alias("facts")
    )


@query(f"""WITH d AS (SELECT '[Source ' || doc_id || ']' AS label, doc_id FROM documents) SELECT conv_id, turn, d.doc_id AS source_id, CASE WHEN d.doc_id IS NOT NULL THEN 'doc ' || d.doc_id ELSE {_CLAIM} END AS citation
  FROM conversations LEFT JOIN d ON label = '[Source ' || (conv_id * 7 + turn * 131) || ']' WHERE d.doc_id IS NOT NULL OR {_CLAIM} <> ''""")
def fact_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact's source by its label; the source's own citation goes before the one the model gave, facts with neither go."""
    label = lambda c: F.concat(F.lit("[Source "), c.cast("string"), F.lit("]"))
    sources = table(spark, sf_dir, "documents").select(label(F.col("doc_id")).alias("label"), F.col("doc_id").alias("source_id"))
    given = F.nullif(F.trim(F.split("text", "\n")[0]), F.lit(""))
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", label(F.col("conv_id") * 7 + F.col("turn") * 131).alias("label"), given.alias("given"))
    citation = F.coalesce(F.concat(F.lit("doc "), F.col("source_id").cast("string")), "given")
    return said.join(sources, "label", "left").select("conv_id", "turn", "source_id", citation.alias("citation")).filter("citation is not null")


_ROLES = ("establish_territory", "Contrast", "support", "future_work", "critique ", "synthesis", "methodology")


@query(f"""WITH p AS (SELECT conv_id, turn, lower(trim({list(_ROLES)}[((conv_id + turn) % {len(_ROLES)} + 1)::INT])) AS role, [conv_id, conv_id + turn * 97] AS evidence, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{5,}}')) AS words FROM conversations),
  e AS (SELECT conv_id, turn, count(l.doc_id) AS kept, count(*) FILTER (l.doc_id IS NULL) AS dropped FROM (SELECT conv_id, turn, unnest(evidence) AS id FROM p) LEFT JOIN labels l ON l.doc_id = id GROUP BY 1, 2),
  c AS (SELECT conv_id, count(*) FILTER (kept > 0) AS paragraphs, CAST(sum(dropped) AS BIGINT) AS dropped, bool_or(role IN {_listed(K.COMPARISON_ROLES)}) AS a, bool_or(role IN {_listed(K.BACKGROUND_ROLES)}) AS b, bool_or(role IN {_listed(K.GAP_ROLES)}) AS g FROM p JOIN e USING (conv_id, turn) GROUP BY 1)
  SELECT conv_id, paragraphs, dropped, paragraphs > 0 AS valid, list_filter([CASE WHEN NOT a THEN 'comparison' END, CASE WHEN NOT b THEN 'background/methodology' END, CASE WHEN NOT g THEN 'gap/limitations/future_work' END], lambda x: x IS NOT NULL) AS missing FROM c""")
def plan_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs lose evidence that isn't known and go without any; the roles that a plan lacks are named."""
    role = F.lower(F.trim(F.element_at(F.array(*map(F.lit, _ROLES)), ((F.col("conv_id") + F.col("turn")) % len(_ROLES) + 1).cast("int"))))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", role.alias("role"), F.explode(F.array(F.col("conv_id"), F.col("conv_id") + F.col("turn") * 97)).alias("id"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit(1).alias("known")).dropDuplicates(["id"])
    paragraphs = rows.join(known, "id", "left").groupBy("conv_id", "turn", "role").agg(F.count("known").alias("kept"), F.count(F.when(F.col("known").isNull(), 1)).alias("dropped"))
    has = lambda roles: F.max(F.col("role").isin(*roles))
    lacks = lambda c, name: F.when(~F.col(c), name)
    plans = paragraphs.groupBy("conv_id").agg(
        F.count(F.when(F.col("kept") > 0, 1)).alias("paragraphs"), F.sum("dropped").alias("dropped"), has(K.COMPARISON_ROLES).alias("a"), has(K.BACKGROUND_ROLES).alias("b"), has(K.GAP_ROLES).alias("g")
    )
    missing = F.filter(F.array(lacks("a", "comparison"), lacks("b", "background/methodology"), lacks("g", "gap/limitations/future_work")), lambda x: x.isNotNull())
    return plans.select("conv_id", "paragraphs", "dropped", (F.col("paragraphs") > 0).alias("valid"), missing.alias("missing"))


@query("""WITH s AS (SELECT conv_id, turn, list_transform(range(1, 11), lambda c: least(10, 3 + (length(text) * c) % 37)) AS marks FROM conversations)
  SELECT conv_id, turn, CAST(list_sum(marks) AS BIGINT) AS total, CAST(list_position(marks, list_min(marks)) AS INTEGER) AS weakest, list_min(marks) = 10 AS passed FROM s""")
def grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten criteria from a reply in JSON, fenced or not: their sum, the weakest (the first of several), and whether all are tens."""
    marks = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda c: F.struct(F.concat(F.lit("c"), c.cast("string")).alias("key"), F.least(F.lit(10), (F.length("text") * c) % 37 + 3).alias("value")))
    fence = F.col("turn") % 2 == 0
    reply = F.concat(F.when(fence, "```json\n").otherwise(""), F.to_json(F.struct(F.map_from_entries(marks).alias("scores"))), F.when(fence, "\n```").otherwise(""))
    bare = F.regexp_replace(reply, r"^\s*```(?:json)?|```\s*$", "")
    scores = F.map_entries(F.from_json(bare, "scores map<string, int>")["scores"])
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", scores.alias("s"))
    values = F.transform("s", lambda e: e["value"])
    weakest = F.element_at(F.transform("s", lambda e: e["key"]), F.array_position(values, F.array_min(values)).cast("int"))
    total = F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a + b)
    return rows.select("conv_id", "turn", total.alias("total"), F.substring(weakest, 2, 9).cast("int").alias("weakest"), (F.array_min(values) == 10).alias("passed"))


@query("""SELECT conv_id, turn, place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 10 / 10.0 DESC, turn) AS place FROM conversations) WHERE place <= 3""")
def top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three gaps of highest priority; of equal ones the first."""
    gaps = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 10 / 10.0).alias("priority"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("priority"), "turn")).cast("long")
    return gaps.withColumn("place", place).filter("place <= 3").select("conv_id", "turn", "place")


@query("""WITH s AS (SELECT '10.1/' || conv_id % 60 AS doi, 'Ref ' || conv_id % 60 AS ref FROM conversations WHERE role = 'assistant'),
  p AS (SELECT '10.1/' || doc_id % 400 AS doi, CASE WHEN doc_id % 3 <> 0 THEN 'Ref ' || doc_id % 400 // 2 END AS apa, source, doc_id FROM documents),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY doc_id) AS k FROM p) WHERE k = 1 AND doi NOT IN (SELECT doi FROM s)),
  u AS (SELECT ref, 0 AS origin FROM s UNION ALL SELECT coalesce(apa, coalesce(source, 'Unknown') || ' (n.d.). Untitled. https://doi.org/' || doi), 1 FROM n)
  SELECT ref AS reference, CASE min(origin) WHEN 0 THEN 'section' ELSE 'pool' END AS origin FROM u GROUP BY 1""")
def references_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections' references, then those of the pool whose DOI no section has; each text once, with a fallback for missing ones."""
    tagged = lambda tag, n: F.concat(F.lit(tag), F.floor(n).cast("string"))
    said = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select((F.col("conv_id") % 60).alias("n")).distinct().select(tagged("10.1/", F.col("n")).alias("doi"), tagged("Ref ", F.col("n")).alias("reference"))
    n = F.col("doc_id") % 400
    pool = table(spark, sf_dir, "documents").select(tagged("10.1/", n).alias("doi"), F.struct("doc_id", F.when(F.col("doc_id") % 3 != 0, tagged("Ref ", n / 2)).alias("apa"), "source").alias("hit"))
    fresh = pool.groupBy("doi").agg(F.min_by("hit", "hit.doc_id").alias("hit")).join(said.select("doi"), "doi", "left_anti")
    made = F.coalesce("hit.apa", F.concat(F.coalesce("hit.source", F.lit("Unknown")), F.lit(" (n.d.). Untitled. https://doi.org/"), F.col("doi")))
    both = said.select("reference", F.lit(0).alias("o")).unionByName(fresh.select(made.alias("reference"), F.lit(1).alias("o")))
    return both.groupBy("reference").agg(F.when(F.min("o") == 0, "section").otherwise("pool").alias("origin"))


@query("""SELECT doc_id, md5('source:' || lower(trim(source)) || '|kw:' || lower(split_part(text, ' ', 1)) || '|open_access:' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END || '|type:' || array_to_string(list_sort([lower(lang), 'review']), '|')) AS signature FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def search_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signature for a search, however its filters are ordered and whatever years it covers."""
    filters = F.create_map(F.lit("type"), F.array(F.lit("Review"), F.upper("lang")), F.lit("min_year"), F.array(F.col("doc_id").cast("string")), F.lit("open_access"), F.array(F.when(F.col("doc_id") % 2 == 0, "True").otherwise("False")))
    docs = table(spark, sf_dir, "documents").filter("source is not null and lang is not null")
    return docs.select("doc_id", K.search_signature(F.upper("source"), F.split("text", " ")[0], filters).alias("signature"))


@query("""SELECT p_partkey, p_partkey % 3 <> 0 OR p_type IN ('ECONOMY', 'STANDARD') AS asked FROM part""")
def type_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches of the preprint server only for types that it holds."""
    kind = F.when(F.col("p_type") == "ECONOMY", "preprint").when(F.col("p_type") == "STANDARD", "review").otherwise("dataset")
    source = F.when(F.col("p_partkey") % 3 == 0, "arxiv").otherwise("openalex")
    return table(spark, sf_dir, "part").select("p_partkey", K.worth_asking(source, F.array(F.lit("book"), kind)).alias("asked"))


@query("""WITH c AS (SELECT conv_id, count(*) AS rounds, max(length(text)) AS longest, min(length(text)) AS shortest FROM conversations GROUP BY 1),
  t AS (SELECT *, [10, 25, 50][(conv_id % 3 + 1)::INT] AS goal, CASE WHEN conv_id % 2 = 0 THEN shortest % 40 END AS low, CASE WHEN conv_id % 2 = 0 THEN shortest % 40 + longest % 60 END AS high FROM c)
  SELECT conv_id, rounds < 4 AND longest % 100 < 85 AND conv_id % 5 <> 0 AS again, CAST(coalesce((low + high) // 2, goal) AS BIGINT) AS target, CAST(coalesce(low, floor(goal * 0.6)) AS BIGINT) AS low, CAST(coalesce(high, floor(goal * 1.4)) AS BIGINT) AS high,
   CASE WHEN (low + high) // 2 < goal * 0.7 THEN 'narrow' WHEN (low + high) // 2 > goal * 1.5 THEN 'wide' END AS warning FROM t""")
def search_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a conversation needs another round, and how many papers it is after."""
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("rounds"), F.max(F.length("text")).alias("longest"), F.min(F.length("text")).alias("shortest"))
    goal = F.element_at(F.array(F.lit(10), F.lit(25), F.lit(50)), (F.col("conv_id") % 3 + 1).cast("int"))
    even = F.col("conv_id") % 2 == 0
    low = F.when(even, F.col("shortest") % 40)
    target, least, most, warning = K.paper_target(goal, low, low + F.col("longest") % 60)
    again = K.search_again(F.col("rounds"), F.lit(4), F.col("longest") % 100 / 100.0, F.when(F.col("conv_id") % 5 == 0, "skip").otherwise("full"))
    return by.select("conv_id", again.alias("again"), target.cast("long").alias("target"), least.cast("long").alias("low"), most.cast("long").alias("high"), warning.alias("warning"))


@query(r"""WITH a AS (SELECT doc_id, text, regexp_replace(text, '[aeiou]', '', 'g') AS first, trim(regexp_replace(text, '(?i)\bthe ', '', 'g')) AS second FROM documents)
  SELECT doc_id, md5(CASE WHEN length(first) >= length(text) * 0.8 THEN first WHEN length(second) >= length(text) * 0.8 THEN second ELSE text END) AS chosen_md5 FROM a""")
def proofread_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass that lost over a fifth of a text gives way to the next attempt, and then to the text itself."""
    first = F.regexp_replace("text", "[aeiou]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(K.proofread(F.col("text"), first, F.regexp_replace("text", r"(?i)\bthe ", ""))).alias("chosen_md5"))


@query("""WITH d AS (SELECT DISTINCT '10.5/' || l_partkey AS doi FROM lineitem WHERE l_quantity > 40), n AS (SELECT doi, (row_number() OVER (ORDER BY doi) - 1) // 100 AS batch FROM d) SELECT doi, batch FROM n""")
def missing_reference_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different DOIs of chunks without a reference, in batches of 100."""
    dois = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").select(F.concat(F.lit("10.5/"), F.col("l_partkey").cast("string")).alias("doi"), F.lit(1).alias("all")).distinct()
    return placed(dois, ["all"], F.substring("doi", 1, 8), ["doi"]).select("doi", F.floor(F.col("place") / 100).alias("batch"))


@query("""SELECT doc_id FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def index_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded documents that the keyword index doesn't hold yet."""
    embedded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id").join(embedded, "doc_id", "left_semi").join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_anti")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS status, o_orderstatus = 'P' AS reset FROM orders""")
def transient_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a crash, rows in a passing state go back to the one before."""
    passing = F.col("o_orderstatus") == "P"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(passing, "O").otherwise(F.col("o_orderstatus")).alias("status"), passing.alias("reset"))


@query(r"""WITH c AS (SELECT doc_id, greatest(1, CAST(ceil(len(regexp_extract_all(text, '\S+')) / 200.0) AS BIGINT)) AS chunks FROM documents), r AS (SELECT *, sum(chunks) OVER (ORDER BY doc_id) AS stop FROM c)
  SELECT doc_id, CAST((stop - chunks) // 32 AS BIGINT) AS first_batch, CAST((stop - chunks) % 32 AS BIGINT) AS start, CAST((stop - 1) // 32 AS BIGINT) AS done_with FROM r""")
def embed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents in full batches of 32; a document is done with the batch that holds its last chunk."""
    n = F.greatest(F.lit(1), F.ceil(F.regexp_count("text", F.lit(r"\S+")) / 200)).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", n.alias("chunks"), F.lit(1).alias("all"))
    rows = placed(docs, ["all"], F.floor(F.col("doc_id") / 4096), ["doc_id"], size=F.col("chunks"))
    return rows.select("doc_id", F.floor(F.col("place") / 32).alias("first_batch"), (F.col("place") % 32).alias("start"), F.floor((F.col("place") + F.col("chunks") - 1) / 32).alias("done_with"))


@query("""WITH e AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 7 = 0 THEN embedding[1:10] WHEN vec_id % 5 = 0 THEN list_append(embedding[1:63], 'nan'::FLOAT) ELSE embedding END AS e FROM embeddings)
  SELECT vec_id, CASE WHEN e IS NULL THEN 'missing' WHEN len(e) <> 64 THEN 'dimension ' || len(e) WHEN len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'component' END AS fault FROM e""")
def vector_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a vector out of the store: it's missing, has a wrong dimension or a component that is no number."""
    key, e = F.col("vec_id"), F.col("embedding")
    nan = F.array(F.lit(float("nan")).cast("float"))
    rows = table(spark, sf_dir, "embeddings").select(key, F.when(key % 11 == 0, None).when(key % 7 == 0, F.slice(e, 1, 10)).when(key % 5 == 0, F.concat(F.slice(e, 1, 63), nan)).otherwise(e).alias("e"))
    odd = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select("vec_id", F.when(F.col("e").isNull(), "missing").when(F.size("e") != 64, F.concat(F.lit("dimension "), F.size("e").cast("string"))).when(odd, "component").alias("fault"))


@query(r"""WITH s AS (SELECT conv_id, turn, len(regexp_extract_all(text, '[.!?]')) AS n, len(regexp_extract_all(text, 'n[.!?]')) AS cited FROM conversations)
  SELECT conv_id, turn, CASE WHEN cited / greatest(n, 1)::DOUBLE >= 0.9 THEN 'Excellent' WHEN cited / greatest(n, 1)::DOUBLE >= 0.7 THEN 'Good' WHEN cited / greatest(n, 1)::DOUBLE >= 0.5 THEN 'Fair' ELSE 'Poor' END AS badge,
   CAST(CASE WHEN n >= 15 THEN greatest(floor(1200 * greatest(0.8, least(2.5, n / 10.0)))::BIGINT, 2400) ELSE floor(1200 * greatest(0.8, least(2.5, n / 10.0))) END AS BIGINT) AS tokens FROM s""")
def section_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's badge by the share of its sentences that cite, and its output tokens by its citations."""
    n, cited = F.regexp_count("text", F.lit("[.!?]")), F.regexp_count("text", F.lit("n[.!?]"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", K.badge(cited / F.greatest(n, F.lit(1))).alias("badge"), K.section_tokens(n, 1200, 1.0, high=True).cast("long").alias("tokens"))
