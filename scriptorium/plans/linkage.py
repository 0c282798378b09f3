"""Record linkage over several derived sources, and year coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import biblio
from scriptorium.operators import intervals
from scriptorium.operators.series import placed
from scriptorium.operators.tables import first_by
from scriptorium.session import table

_PAPERS_SQL = """papers AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey % 4 <> 0 THEN CASE p_partkey % 3 WHEN 0 THEN 'https://doi.org/10.1000/P' WHEN 1 THEN 'doi:10.1000/p' ELSE '10.1000/p' END || (p_partkey % 150) END AS doi,
    CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 <> 0 THEN '2101.' || lpad(CAST(p_partkey % 200 AS VARCHAR), 5, '0') END AS arxiv,
    p_name || ' (' || p_brand || ')' AS title, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS abstract, p_size AS citations, 's' || (p_partkey % 3) AS source FROM part)"""
_ID_SQL = r"""CASE WHEN doi IS NOT NULL THEN 'doi:' || regexp_replace(lower(trim(doi)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '')
  WHEN arxiv IS NOT NULL THEN 'arxiv:' || lower(arxiv) ELSE 'title:' || trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) END"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliographic records with three spellings of an identifier, from ``part``."""
    key = F.col("p_partkey")
    spelled = F.when(key % 3 == 0, "https://doi.org/10.1000/P").when(key % 3 == 1, "doi:10.1000/p").otherwise("10.1000/p")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        F.when(key % 4 != 0, F.concat(spelled, (key % 150).cast("string"))).alias("doi"),
        F.when((key % 4 == 0) & (key % 8 != 0), F.concat(F.lit("2101."), F.lpad((key % 200).cast("string"), 5, "0"))).alias("arxiv"),
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("title"),
        F.when(key % 5 != 0, F.col("p_type")).alias("abstract"),
        F.col("p_size").alias("citations"),
        F.concat(F.lit("s"), (key % 3).cast("string")).alias("source"),
    )


def _identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).withColumn("uid", biblio.canonical_id(F.col("doi"), F.col("arxiv"), F.lit(None).cast("string"), F.col("title")))


@query(f"WITH {_PAPERS_SQL} SELECT id, {_ID_SQL} AS uid FROM papers")
def canonical_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identified(spark, sf_dir).select("id", "uid")


@query(f"""WITH {_PAPERS_SQL}, u AS (SELECT *, {_ID_SQL} AS uid FROM papers)
  SELECT uid, count(*) AS n, min(id) AS first_id, max(citations) AS citations,
    first(abstract ORDER BY length(abstract) DESC, id) FILTER (abstract IS NOT NULL) AS abstract, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources FROM u GROUP BY uid""")
def smart_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates of a record become one: longest abstract, most citations, all sources."""
    longest = F.max(F.when(F.col("abstract").isNotNull(), F.struct(F.length("abstract").alias("n"), (-F.col("id")).alias("i"), F.col("abstract").alias("a"))))
    return _identified(spark, sf_dir).groupBy("uid").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("citations").alias("citations"), longest["a"].alias("abstract"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources")
    )


@query(f"""WITH {_PAPERS_SQL}, s AS (SELECT *, lower(p_mfgr) AS t FROM (SELECT *, substr(title, 1, 14) AS p_mfgr FROM papers)),
  r AS (SELECT *, CASE WHEN arxiv IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN doi IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN length(abstract) > 15 THEN 10 ELSE 0 END AS score FROM s)
  SELECT t AS title_key, first(id ORDER BY score DESC, id) AS survivor, max(score) AS score, first(doi ORDER BY score DESC, id) FILTER (doi IS NOT NULL) AS doi,
   first(abstract ORDER BY score DESC, id) FILTER (abstract IS NOT NULL) AS abstract, count(*) - 1 AS victims FROM r GROUP BY t""")
def title_dedup_survivor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best record of a title survives; its empty fields are filled from the others in rank order."""
    score = F.when(F.col("arxiv").isNotNull(), 100).otherwise(0) + F.when(F.col("doi").isNotNull(), 20).otherwise(0) + F.when(F.length("abstract") > 15, 10).otherwise(0)
    ranked = papers(spark, sf_dir).withColumn("title_key", F.lower(F.substring("title", 1, 14))).withColumn("score", score)
    rank = F.struct((-F.col("score")).alias("s"), F.col("id").alias("i"))
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c)
    return ranked.groupBy("title_key").agg(F.min_by("id", rank).alias("survivor"), F.max("score").alias("score"), filled("doi"), filled("abstract"), (F.count(F.lit(1)) - 1).alias("victims"))


@query(f"""WITH {_PAPERS_SQL}, old AS (SELECT * FROM papers WHERE id % 2 = 0), new AS (SELECT * FROM papers WHERE id % 2 = 1),
  a AS (SELECT lower(regexp_replace(doi, '^(https?://doi.org/|doi:)', '')) AS k, min(id) AS m FROM old WHERE doi IS NOT NULL GROUP BY 1),
  b AS (SELECT lower(title) AS k, min(id) AS m FROM old GROUP BY 1)
  SELECT n.id, coalesce(a.m, b.m) AS matched, CASE WHEN coalesce(a.m, b.m) IS NULL THEN 'insert' WHEN coalesce(a.m, b.m) % 3 = 0 THEN 'skip' ELSE 'upgrade' END AS action
  FROM new n LEFT JOIN a ON lower(regexp_replace(n.doi, '^(https?://doi.org/|doi:)', '')) = a.k LEFT JOIN b ON lower(n.title) = b.k""")
def match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match by identifier, else by title; then skip, upgrade or insert."""
    keyed = papers(spark, sf_dir).select("id", biblio.normal_doi(F.col("doi")).alias("doi"), F.lower("title").alias("title"))
    old, new = keyed.filter("id % 2 = 0"), keyed.filter("id % 2 = 1")
    by = lambda k: old.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias(f"by_{k}"))
    matched = F.coalesce("by_doi", "by_title")
    action = F.when(matched.isNull(), "insert").when(matched % 3 == 0, "skip").otherwise("upgrade")
    return new.join(by("doi"), "doi", "left").join(by("title"), "title", "left").select("id", matched.alias("matched"), action.alias("action"))


@query(f"""WITH {_PAPERS_SQL}, a AS (SELECT id, abstract AS v FROM papers WHERE id % 3 = 0), b AS (SELECT id, title AS v FROM papers WHERE id % 2 = 0)
  SELECT p.id, coalesce(p.abstract, a.v, b.v) AS abstract, CASE WHEN p.abstract IS NOT NULL THEN 'own' WHEN a.v IS NOT NULL THEN 'first' WHEN b.v IS NOT NULL THEN 'second' ELSE 'none' END AS origin
  FROM papers p LEFT JOIN a USING (id) LEFT JOIN b USING (id)""")
def enrichment_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = papers(spark, sf_dir)
    first = base.filter("id % 3 = 0").select("id", F.col("abstract").alias("a"))
    second = base.filter("id % 2 = 0").select("id", F.col("title").alias("b"))
    origin = F.when(F.col("abstract").isNotNull(), "own").when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("none")
    return base.join(first, "id", "left").join(second, "id", "left").select("id", F.coalesce("abstract", "a", "b").alias("abstract"), origin.alias("origin"))


_SPANS = "SELECT o_orderpriority AS signature, CAST(extract(year FROM o_orderdate) AS INTEGER) + CAST(o_custkey % 3 AS INTEGER) * 7 AS start, CAST(extract(year FROM o_orderdate) AS INTEGER) + CAST(o_custkey % 3 AS INTEGER) * 7 + CAST(o_orderkey % 2 AS INTEGER) AS \"end\" FROM orders"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.year("o_orderdate") + (F.col("o_custkey") % 3).cast("int") * 7
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("signature"), start.alias("start"), (start + (F.col("o_orderkey") % 2).cast("int")).alias("end")).distinct()


_MERGED = f"""s AS (SELECT DISTINCT * FROM ({_SPANS})), f AS (SELECT *, coalesce(start > max("end") OVER (PARTITION BY signature ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true)::INT AS fresh FROM s),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY signature ORDER BY start, "end") AS island FROM f), m AS (SELECT signature, min(start) AS start, max("end") AS "end" FROM i GROUP BY signature, island)"""


@query(f'WITH {_MERGED} SELECT signature, start, "end" FROM m')
def coverage_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(_spans(spark, sf_dir), ["signature"])


@query(f"""WITH {_MERGED}, y AS (SELECT DISTINCT signature, unnest(range(1985, 2031))::INT AS y FROM m), h AS (SELECT y.* FROM y WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.signature = y.signature AND y.y BETWEEN m.start AND m."end")),
  g AS (SELECT *, y - row_number() OVER (PARTITION BY signature ORDER BY y) AS k FROM h) SELECT signature, min(y) AS gap_start, max(y) AS gap_end FROM g GROUP BY signature, k""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(intervals.merge(_spans(spark, sf_dir), ["signature"]), ["signature"], 1985, 2030)


@query(f"""WITH {_MERGED}, y AS (SELECT DISTINCT signature, unnest(range(1990, 2025))::INT AS year FROM m) SELECT y.signature, y.year, count(m.start) > 0 AS covered
  FROM y LEFT JOIN m ON m.signature = y.signature AND y.year BETWEEN m.start AND m."end" GROUP BY 1, 2""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword by year; a merged interval becomes its years, so the range join is an equi-join."""
    merged = intervals.merge(_spans(spark, sf_dir), ["signature"])
    grid = merged.select("signature").distinct().select("signature", F.explode(F.sequence(F.lit(1990), F.lit(2024))).alias("year"))
    years = merged.select("signature", F.explode(F.sequence("start", "end")).alias("year"), F.lit(True).alias("hit"))
    return grid.join(years, ["signature", "year"], "left").select("signature", "year", F.coalesce("hit", F.lit(False)).alias("covered"))


@query(r"""SELECT s_suppkey, regexp_replace(lower(trim(CASE s_suppkey % 3 WHEN 0 THEN ' https://doi.org/10.5555/S' WHEN 1 THEN 'DOI:10.5555/s' ELSE '10.5555/s' END || s_suppkey)), '^(https?://(dx\.)?doi\.org/|doi:\s*)', '') AS doi FROM supplier""")
def doi_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    raw = F.concat(F.when(key % 3 == 0, " https://doi.org/10.5555/S").when(key % 3 == 1, "DOI:10.5555/s").otherwise("10.5555/s"), key.cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", biblio.normal_doi(raw).alias("doi"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '10.1234/' || replace(p_name, ' ', '_') END AS doi, p_partkey % 2 = 0 AS valid FROM part""")
def filename_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("10.1234_"), slug, F.lit(".pdf"))).otherwise(F.concat(slug, F.lit(".pdf")))
    doi = biblio.doi_from_filename(name)
    return table(spark, sf_dir, "part").select("p_partkey", doi.alias("doi"), biblio.valid_doi(doi).alias("valid"))


@query("""WITH a AS (SELECT l_orderkey, list(s_name ORDER BY l_linenumber, s_name) AS authors FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
  SELECT o_orderkey, CASE WHEN len(authors) = 1 THEN authors[1] ELSE array_to_string(authors[:len(authors) - 1], ', ') || ', & ' || authors[len(authors)] END
   || ' (' || extract(year FROM o_orderdate) || '). Order ' || o_orderkey || '.' || ' ' || o_orderpriority || ', ' || (o_custkey % 40) || '(' || (o_custkey % 12) || ').' || ' https://doi.org/10.1/' || o_orderkey AS reference
  FROM orders JOIN a ON l_orderkey = o_orderkey""")
def apa_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    authors = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "s_name"))), lambda x: x["s_name"]).alias("authors"))
    made = biblio.apa_reference(
        F.col("authors"), F.year("o_orderdate"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.col("o_orderpriority"), F.col("o_custkey") % 40, F.col("o_custkey") % 12,
        F.lit(None).cast("string"), F.concat(F.lit("10.1/"), F.col("o_orderkey").cast("string")),
    )
    return table(spark, sf_dir, "orders").join(authors, "o_orderkey").select("o_orderkey", made.alias("reference"))


@query("""WITH a AS (SELECT l_orderkey, list(s_name ORDER BY l_linenumber, s_name) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)
  SELECT o_orderkey, '(' || CASE WHEN len(n) > 2 THEN n[1] || ' et al.' WHEN len(n) = 2 THEN n[1] || ' & ' || n[2] ELSE n[1] END || ', ' || extract(year FROM o_orderdate) || ')' AS citation
  FROM orders JOIN a ON l_orderkey = o_orderkey""")
def short_citation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    names = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "s_name"))), lambda x: x["s_name"]).alias("names"))
    return table(spark, sf_dir, "orders").join(names, "o_orderkey").select("o_orderkey", biblio.short_citation(F.col("names"), F.year("o_orderdate")).alias("citation"))


@query("""SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS first_seen FROM documents""")
def discovery_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streaming discovery's rule in batch form: the first record of a key wins."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first_seen"))
    return docs.join(first, "doc_id", "left").select("doc_id", "source", F.coalesce("first_seen", F.lit(False)).alias("first_seen"))


@query("""SELECT o_custkey, o_orderkey AS first_order, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1""")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_by(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("first_order"), "o_totalprice")


@query("""WITH r AS (SELECT doc_id, source, '10.1000/' || doc_id AS doi, split_part(text, ' ', 1) AS surname, 1990 + doc_id % 30 AS year FROM documents), c AS (SELECT DISTINCT '10.1000/' || conv_id AS doi FROM conversations)
  SELECT doc_id, c.doi IS NOT NULL AS cited, CASE WHEN c.doi IS NOT NULL THEN row_number() OVER (PARTITION BY source, c.doi IS NOT NULL ORDER BY lower(surname), year, doc_id) END AS number FROM r LEFT JOIN c USING (doi)""")
def references_by_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose DOI is cited, numbered within their list by surname and year, and the others; DOIs are compared without prefix and case."""
    docs = table(spark, sf_dir, "documents")
    refs = docs.select("doc_id", "source", F.concat(F.lit("https://doi.org/10.1000/"), F.col("doc_id").cast("string")).alias("doi"), F.split("text", " ")[0].alias("surname"), (F.lit(1990) + F.col("doc_id") % 30).alias("year"))
    cited = table(spark, sf_dir, "conversations").select(F.concat(F.lit("doi:10.1000/"), F.col("conv_id").cast("string")).alias("c")).distinct()
    bare = lambda c: F.regexp_replace(F.lower(F.trim(F.col(c))), r"^(https?://(dx\.)?doi\.org/|doi:)", "")
    known = refs.withColumn("doi", bare("doi")).join(cited.select(bare("c").alias("doi"), F.lit(True).alias("cited")).distinct(), "doi", "left")
    yes = known.filter("cited").withColumn("surname", F.lower("surname"))
    yes = placed(yes, ["source"], F.substring("surname", 1, 3), ["surname", "year", "doc_id"])
    return yes.select("doc_id", "cited", (F.col("place") + 1).alias("number")).unionByName(known.filter("cited is null").select("doc_id", F.lit(False).alias("cited"), F.lit(None).cast("long").alias("number")))
