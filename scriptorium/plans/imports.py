"""Imported files and records: matches, identifiers, merges, uploaded documents; bounds of quantised vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import biblio
from scriptorium.operators import matching, quantiles
from scriptorium.operators.search import nearest
from scriptorium.plans.linkage import _ID_SQL, _PAPERS_SQL, papers
from scriptorium.session import cut, ship_code, table
from scriptorium.sources import uploads


@query("""WITH d AS (SELECT doc_id AS id, md5(text) AS checksum, lower(trim(split_part(text, '.', 1))) AS title, CASE WHEN doc_id % 3 = 0 THEN 'embedded' ELSE 'discovered' END AS status FROM documents),
  old AS (SELECT id, status, unnest([{'step': 0, 'key': checksum}, {'step': 1, 'key': '10.1000/' || (id % 300)}, {'step': 2, 'key': '10.1000/' || (id % 300)}, {'step': 3, 'key': title}]) AS k FROM d WHERE id % 2 = 0),
  new AS (SELECT id, unnest([{'step': 0, 'key': checksum}, {'step': 1, 'key': CASE WHEN id % 5 = 0 THEN '10.1000/' || (id % 450) END}, {'step': 2, 'key': CASE WHEN id % 5 = 1 THEN '10.1000/' || (id % 700) END}, {'step': 3, 'key': title}]) AS k FROM d WHERE id % 2 = 1),
  m AS (SELECT new.id, min({'step': new.k.step, 'id': old.id, 'status': old.status}) AS b FROM new LEFT JOIN old ON new.k.step = old.k.step AND new.k.key = old.k.key AND trim(new.k.key) <> '' WHERE old.id IS NOT NULL GROUP BY 1)
  SELECT n.id, ['checksum', 'file name', 'text', 'title'][b.step + 1] AS matched_by, b.id AS matched, CASE WHEN b IS NULL THEN 'insert' WHEN b.status = 'embedded' THEN 'skip' ELSE 'upgrade' END AS action FROM (SELECT id FROM d WHERE id % 2 = 1) n LEFT JOIN m USING (id)""")
def import_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against the catalogue by checksum, DOI of the file's name, DOI in the text and whole title, the strongest match each."""
    doc = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(doc.alias("id"), F.md5("text").alias("checksum"), F.lower(F.trim(F.substring_index("text", ".", 1))).alias("title"), F.when(doc % 3 == 0, "embedded").otherwise("discovered").alias("status"))
    doi = lambda n: F.concat(F.lit("10.1000/"), (F.col("id") % n).cast("string"))
    of_id = lambda k: F.col("id") % 5 == k
    old, new = docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1").drop("status")
    keys = {"checksum": (F.col("checksum"), F.col("checksum")), "file name": (F.when(of_id(0), doi(450)), doi(300)), "text": (F.when(of_id(1), doi(700)), doi(300)), "title": (F.col("title"), F.col("title"))}
    return matching.first_match(new, old, keys).select("id", "matched_by", "matched", matching.import_action(F.col("matched"), F.col("status")).alias("action"))


@query(r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'u' || (doc_id % 3) END AS u, CASE WHEN doc_id % 4 <> 0 THEN md5(text) END AS checksum, doc_id % 3 = 0 AS by_hand, CASE WHEN doc_id % 5 <> 0 THEN '10.1000/A' || doc_id END AS doi,
    CASE WHEN doc_id % 2 = 0 THEN '2101.0000' || (doc_id % 10) || 'V1' END AS arxiv, 'title:' || trim(regexp_replace(regexp_replace(lower(substr(text, 1, 80)), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS plain FROM documents)
  SELECT doc_id, CASE WHEN u IS NOT NULL THEN 'user:' || u || ':' || CASE WHEN checksum IS NOT NULL THEN 'manual:' || checksum ELSE plain END WHEN checksum IS NOT NULL AND by_hand THEN 'manual:' || checksum
    WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) WHEN arxiv IS NOT NULL THEN 'arxiv:' || lower(arxiv) ELSE plain END AS uid FROM d""")
def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in all their namespaces: a user's, by hand, DOI, arXiv, title."""
    doc = F.col("doc_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    uid = biblio.record_id(
        F.when(doc % 7 == 0, text("u", doc % 3)), F.when(doc % 4 != 0, F.md5("text")), doc % 3 == 0, F.when(doc % 5 != 0, text("10.1000/A", doc)), F.when(doc % 2 == 0, text("2101.0000", doc % 10, "V1")), F.substring("text", 1, 80)
    )
    return table(spark, sf_dir, "documents").select("doc_id", uid.alias("uid"))


_MORE = """m AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'W' || id END AS openalex, CASE WHEN id % 6 = 0 THEN 'https://example.org/' || id END AS pdf_url, CASE WHEN id % 4 = 1 THEN 'Author ' || (id % 5) WHEN id % 4 = 2 THEN '' END AS authors FROM papers)"""


@query(f"""WITH {_PAPERS_SQL}, {_MORE}, u AS (SELECT *, {_ID_SQL} AS uid FROM m), s AS (SELECT uid, source, min(id) AS o FROM u GROUP BY 1, 2), j AS (SELECT uid, string_agg(source, '|' ORDER BY o) AS sources FROM s GROUP BY 1)
  SELECT uid, min(id) AS first_id, count(*) AS n, first(doi ORDER BY id) FILTER (doi IS NOT NULL) AS doi, first(arxiv ORDER BY id) FILTER (arxiv IS NOT NULL) AS arxiv, first(openalex ORDER BY id) FILTER (openalex IS NOT NULL) AS openalex,
    first(pdf_url ORDER BY id) FILTER (pdf_url IS NOT NULL) AS pdf_url, first(authors ORDER BY id) FILTER (authors <> '') AS authors, first(abstract ORDER BY length(abstract) DESC, id) FILTER (abstract <> '') AS abstract, max(citations) AS citations, any_value(sources) AS sources
  FROM u JOIN j USING (uid) GROUP BY uid""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates of a record become one, with every field filled."""
    id_ = F.col("id")
    more = papers(spark, sf_dir).withColumns({
        "openalex": F.when(id_ % 9 == 0, F.concat(F.lit("W"), id_.cast("string"))), "pdf_url": F.when(id_ % 6 == 0, F.concat(F.lit("https://example.org/"), id_.cast("string"))),
        "authors": F.when(id_ % 4 == 1, F.concat(F.lit("Author "), (id_ % 5).cast("string"))).when(id_ % 4 == 2, ""),
    })
    keyed = more.withColumn("uid", biblio.canonical_id(F.col("doi"), F.col("arxiv"), F.lit(None).cast("string"), F.col("title")))
    return matching.smart_merged(keyed, "uid")


_FILLED = ", ".join(f"first({c} ORDER BY score DESC, id) FILTER (length(trim(CAST({c} AS VARCHAR))) > 0) AS {c}" for c in matching.TITLE_FIELDS)


@query(f"""WITH t AS (SELECT doc_id AS id, split_part(text, '.', 1) AS title, CASE WHEN doc_id % 3 = 0 THEN '/files/' || doc_id END AS pdf_path, CASE WHEN doc_id % 2 = 0 THEN '10.1000/' || doc_id ELSE '' END AS doi, CASE WHEN doc_id % 4 <> 0 THEN substr(text, 1, CAST(30 + doc_id % 40 AS INTEGER)) END AS abstract,
    repeat('A', CAST(doc_id % 9 AS INTEGER)) AS authors, CASE WHEN doc_id % 6 = 1 THEN CAST(2000 + doc_id % 25 AS INTEGER) END AS year, source AS venue, CASE WHEN doc_id % 8 = 5 THEN 'https://example.org/' || doc_id END AS url, CAST(NULL AS VARCHAR) AS created_at FROM documents),
  s AS (SELECT *, lower(title) AS title_key, CAST(CASE WHEN pdf_path IS NOT NULL THEN 100 ELSE 0 END + CASE WHEN doi <> '' THEN 20 ELSE 0 END + CASE WHEN length(abstract) > 50 THEN 10 ELSE 0 END + CASE WHEN length(authors) > 5 THEN 5 ELSE 0 END AS INTEGER) AS score FROM t WHERE trim(title) <> '')
  SELECT title_key, first(id ORDER BY score DESC, id) AS survivor, max(score) AS score, count(*) - 1 AS victims, {_FILLED} FROM s GROUP BY title_key""")
def title_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with one whole title: the best survives and takes what it lacks from the others."""
    doc, of = F.col("doc_id"), lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    records = table(spark, sf_dir, "documents").select(
        doc.alias("id"), F.substring_index("text", ".", 1).alias("title"), F.when(doc % 3 == 0, of("/files/", doc)).alias("pdf_path"), F.when(doc % 2 == 0, of("10.1000/", doc)).otherwise("").alias("doi"),
        F.when(doc % 4 != 0, F.substring(F.col("text"), F.lit(1), (30 + doc % 40).cast("int"))).alias("abstract"), F.repeat(F.lit("A"), (doc % 9).cast("int")).alias("authors"), F.when(doc % 6 == 1, (2000 + doc % 25).cast("int")).alias("year"),
        F.col("source").alias("venue"), F.when(doc % 8 == 5, of("https://example.org/", doc)).alias("url"), F.lit(None).cast("string").alias("created_at"),
    )
    return matching.title_survivors(records)


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'md' ELSE 'txt' END AS kind,
    md5(CASE WHEN doc_id % 10 = 7 THEN NULL WHEN doc_id % 3 = 0 THEN nullif(array_to_string(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\\S')), chr(10) || chr(10)), '') WHEN regexp_matches(text, '\\S') THEN text END) AS text_md5,
    coalesce(CASE WHEN doc_id % 10 = 7 THEN CASE WHEN doc_id % 3 = 0 THEN 'damaged: BadZipFile' ELSE 'damaged: UnicodeDecodeError' END WHEN NOT regexp_matches(text, '\\S') THEN 'empty' END, 'none') AS fault FROM documents""".replace("\\\\", "\\"))
def uploaded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of three kinds, some of them damaged, and the texts that come out of them."""
    ship_code(spark)

    @F.pandas_udf("binary")
    def as_file(kinds: pd.Series, texts: pd.Series, damaged: pd.Series) -> pd.Series:
        made = [uploads.docx_bytes(t) if k == "docx" else t.encode() for k, t in zip(kinds, texts, strict=True)]
        return pd.Series([(b[: len(b) // 2] if k == "docx" else b + b"\xff") if bad else b for k, b, bad in zip(kinds, made, damaged, strict=True)])

    doc = F.col("doc_id")
    kind = F.when(doc % 3 == 0, "docx").when(doc % 3 == 1, "md").otherwise("txt")
    files = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), F.concat(doc.cast("string"), F.lit("."), kind).alias("path"), as_file(kind, F.coalesce("text", F.lit("")), doc % 10 == 7).alias("content"))
    return uploads.extracted(files).select("doc_id", "kind", F.md5("text").alias("text_md5"), F.coalesce("error", F.lit("none")).alias("fault"))


@query("SELECT DISTINCT len(embedding) AS length, unnest(range(len(embedding)))::INTEGER AS component, (SELECT count(*) FROM embeddings) AS n, true AS near FROM embeddings")
def quantile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound of each component by a merged sketch of two halves, and whether its true rank is near 0.99."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    halves = [quantiles.component_sketches(vectors.filter(F.col("vec_id") % 2 == k)) for k in (0, 1)]
    found = cut(quantiles.bounds(quantiles.merged(halves[0].unionByName(halves[1]))), "component_bounds")
    each = vectors.select(F.size("embedding").alias("length"), F.posexplode("embedding").alias("component", "x"))
    below = each.join(found, ["length", "component"]).groupBy("length", "component", "n").agg(F.avg((F.abs(F.col("x").cast("double")) <= F.col("bound")).cast("double")).alias("rank"))
    return below.select("length", "component", "n", F.col("rank").between(0.97, 1.0).alias("near"))


@query("""WITH b AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT b.q AS query_id, v.vec_id, round(list_cosine_similarity(b.e, v.embedding::DOUBLE[]), 6) AS score FROM b, embeddings v WHERE v.vec_id <> b.q)
  SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def quantile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in bytes clipped at each component's 0.99 quantile, rescored exactly; queries: every vec_id divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    clip = quantiles.clip_of(quantiles.bounds(quantiles.component_sketches(vectors)), vectors.select(F.max(F.size("embedding"))).first()[0] or 0)
    queries = vectors.filter(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = nearest(vectors, queries, 3, clip=clip, skip_self=True)
    return found.select("query_id", "vec_id", F.col("similarity").alias("score"), F.col("semantic_rank").alias("rank"))
