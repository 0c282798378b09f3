"""Text work over ``documents`` and ``pages``: cleaning, hashing, quality, chunks, HTML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import text as X
from scriptorium.operators.chunks import hierarchical, word_windows
from scriptorium.operators.similar import similar_sets
from scriptorium.operators.tables import first_by
from scriptorium.operators.token_chunks import token_chunks
from scriptorium.session import ship_code, table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), '\b\d+ *$', '', 'g'), '(?i)^ *page +\d+ *$', '', 'g')) AS text FROM documents""")
def clean_text_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.clean_basic(F.col("text")).alias("text"))


def _preprocess_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = "text"
    for p in X.REMOVED:
        out = f"regexp_replace({out}, {quoted(p)}, '', 'g')"
    for p, to in ((r"\t", "' '"), (r"\r\n?", "chr(10)"), (" +", "' '"), (r"\n{3,}", "chr(10) || chr(10)"), (r" +\n", "chr(10)")):
        out = f"regexp_replace({out}, {quoted(p)}, {to}, 'g')"
    for old, new in X.REPLACED.items():
        out = f"replace({out}, chr({ord(old)}), {quoted(new)})"
    for p, to in ((r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", ""), (r"\.([A-Z])", r". \1"), (r"[.]{4,}", "..."), (r"[-]{3,}", "--")):
        out = f"regexp_replace({out}, {quoted(p)}, {quoted(to)}, 'g')"
    return f"SELECT doc_id, md5(trim({out}, ' ' || chr(9) || chr(13) || chr(10))) AS text_md5 FROM documents"


@query(_preprocess_sql())
def preprocess_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.preprocessed(F.col("text"))).alias("text_md5"))


@query(r"""SELECT doc_id, hash FROM (SELECT doc_id, hash, row_number() OVER (PARTITION BY hash ORDER BY doc_id) AS k FROM (SELECT doc_id, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS hash FROM documents)) WHERE k = 1""")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each content hash, by a grouped minimum."""
    hashed = _docs(spark, sf_dir).select("doc_id", F.sha2(X.collapsed(F.col("text")), 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "hash")


@query("SELECT doc_id, md5(source || ':' || lang || ':' || doc_id) AS chunk_id, substr(md5(lower(trim(text))), 1, 12) AS short_id FROM documents")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.concat_ws(":", "source", "lang", F.col("doc_id").cast("string"))).alias("chunk_id"), F.substring(F.md5(F.lower(F.trim("text"))), 1, 12).alias("short_id"))


_QUALITY = r"""CASE WHEN coalesce(length(text), 0) < 100 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN length(text) < 1000 THEN 0.3 ELSE 0 END
  - CASE WHEN len(regexp_extract_all(text, '[^\p{L}\p{N}_ \t\n\r.,;:!?()-]')) / length(text)::DOUBLE > 0.1 THEN 0.2 ELSE 0 END
  - CASE WHEN contains(lower(text), 'the')::INT + contains(lower(text), 'and')::INT + contains(lower(text), 'of')::INT + contains(lower(text), 'to')::INT + contains(lower(text), 'in')::INT + contains(lower(text), 'a')::INT < 3 THEN 0.2 ELSE 0 END
  - CASE WHEN len(regexp_extract_all(text, '[ \t\n\r]{3,}')) / greatest(length(text) // 100, 1)::DOUBLE > 5 THEN 0.1 ELSE 0 END
  + CASE WHEN regexp_matches(lower(text), 'abstract|introduction|methods|results|conclusion') THEN 0.1 ELSE 0 END)) END"""


@query(f"SELECT doc_id, CAST(round({_QUALITY}, 3) AS DOUBLE) AS quality FROM documents")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.round(X.quality_score(F.col("text")), 3).alias("quality"))


@query(f"SELECT l.quality AS label, count(*) AS n, round(avg(CAST({_QUALITY} AS DOUBLE)), 6) AS mean_score FROM documents JOIN labels l USING (doc_id) GROUP BY 1")
def quality_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _docs(spark, sf_dir).select("doc_id", X.quality_score(F.col("text")).alias("score"))
    return table(spark, sf_dir, "labels").join(scored, "doc_id").groupBy(F.col("quality").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(r"""SELECT doc_id, CAST(nullif(regexp_extract(substr(text, 1, 2000), '\b(?:19|20)\d{2}\b'), '') AS INTEGER) AS year, regexp_matches(substr(text, 1, 3000), '[a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+\.[a-zA-Z0-9_]+') AS has_email,
  CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS words, CAST(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) // 200 AS BIGINT) AS minutes, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents""")
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.nullif(F.regexp_extract(F.substring("text", 1, 2000), r"\b(?:19|20)\d{2}\b", 0), F.lit("")).cast("int")
    words = F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")
    mail = F.substring("text", 1, 3000).rlike(r"[a-zA-Z0-9_.-]+@[a-zA-Z0-9_.-]+\.[a-zA-Z0-9_]+")
    return _docs(spark, sf_dir).select("doc_id", year.alias("year"), mail.alias("has_email"), words.alias("words"), F.floor(words / 200).alias("minutes"), X.token_estimate(F.col("text")).alias("tokens"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text WHEN contains(substr(text, 1, 297), ' ') AND 297 - instr(reverse(substr(text, 1, 297)), ' ') > 240 THEN substr(text, 1, 297 - instr(reverse(substr(text, 1, 297)), ' ')) || '...' ELSE substr(text, 1, 297) || '...' END AS head FROM documents""")
def truncated_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", X.truncated(F.col("text"), 300).alias("head"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\$\$[^$]+\$\$')) AS BIGINT) AS display, CAST(len(regexp_extract_all(text, '\$[^$\n]+\$')) AS BIGINT) AS inline, CAST(len(regexp_extract_all(text, '[∑∫√∂∞≤≥≠±×÷]+')) AS BIGINT) AS symbols, regexp_matches(text, '\\[a-zA-Z]+\{|\$') AS has_latex FROM documents""")
def equation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return _docs(spark, sf_dir).select("doc_id", n(r"\$\$[^$]+\$\$").alias("display"), n(r"\$[^$\n]+\$").alias("inline"), n("[∑∫√∂∞≤≥≠±×÷]+").alias("symbols"), F.col("text").rlike(r"\\[a-zA-Z]+\{|\$").alias("has_latex"))


@query(r"""WITH w AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS pos, unnest(t) AS word FROM (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS t FROM documents)),
  i AS (SELECT doc_id, word, list(pos ORDER BY pos) AS positions FROM w GROUP BY 1, 2), x AS (SELECT doc_id, word, unnest(positions) AS pos FROM i)
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS abstract FROM x GROUP BY 1""")
def inverted_abstract_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word -> positions, then back to running text."""
    words = _docs(spark, sf_dir).select("doc_id", F.posexplode(F.split(X.collapsed(F.col("text")), " ")).alias("pos", "word"))
    inverted = words.groupBy("doc_id", "word").agg(F.collect_list("pos").alias("positions"))
    back = inverted.select("doc_id", F.explode("positions").alias("pos"), "word").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return back.select("doc_id", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("abstract"))


@query(r"""WITH w AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' ') AS t FROM documents),
  s AS (SELECT doc_id, t, unnest(range(0, greatest(len(t) - 50, 1), 150)) AS start FROM w)
  SELECT doc_id, CAST(start // 150 AS BIGINT) AS chunk, CAST(start AS BIGINT) AS start, CAST(len(t[start + 1:start + 200]) AS BIGINT) AS n_words, md5(array_to_string(t[start + 1:start + 200], ' ')) AS chunk_md5 FROM s""")
def word_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_windows(_docs(spark, sf_dir), 200, 50).select("doc_id", "chunk", "start", "n_words", F.md5("text").alias("chunk_md5"))


_SIGNS = "coalesce(text, '')"
for _sign, _meant in X.ARTIFACTS.items():
    _SIGNS = f"replace({_SIGNS}, '{_sign.replace(chr(39), chr(39) * 2)}', '{_meant.replace(chr(39), chr(39) * 2)}')"


@query(rf"""WITH a AS (SELECT doc_id, regexp_replace({_SIGNS}, 'jj([A-Za-z]+)jj', '|\1|', 'g') AS t FROM documents),
  b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t\n\x0B\f\r]{{2,}}', ' ', 'g'), '([\p{{L}}\p{{N}}_])-\n([\p{{L}}\p{{N}}_])', '\1\2', 'g') AS t FROM a)
  SELECT doc_id, md5(trim(regexp_replace(regexp_replace(t, '\n[0-9]+\n', chr(10), 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS cleaned_md5 FROM b""")
def clean_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.clean_artifacts(F.col("text"))).alias("cleaned_md5"))


@query(None)
def hierarchical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchical(_docs(spark, sf_dir))


@query(r"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\s[^>]*href')) AS BIGINT) AS links,
  CAST(len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) AS BIGINT) AS headings FROM pages""")
def html_title_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), n(r"(?i)<a\s[^>]*href").alias("links"), n(r"(?i)<h[1-6][\s>]").alias("headings"))


@query(r"""WITH h AS (SELECT page_id, lower(trim(regexp_replace(unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1)), '<[^>]+>', '', 'g'))) AS name FROM pages)
  SELECT CASE WHEN contains(name, 'abstract') OR contains(name, 'summary') THEN 'abstract' WHEN contains(name, 'introduction') OR contains(name, 'background') THEN 'introduction' WHEN contains(name, 'methods') OR contains(name, 'methodology') THEN 'methods'
   WHEN contains(name, 'results') OR contains(name, 'findings') THEN 'results' WHEN contains(name, 'discussion') THEN 'discussion' WHEN contains(name, 'conclusion') THEN 'conclusion' WHEN contains(name, 'references') THEN 'references' END AS section, count(*) AS n FROM h GROUP BY 1""")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1))).alias("h"))
    return heads.groupBy(X.section_name(F.regexp_replace("h", "<[^>]+>", "")).alias("section")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH w AS (SELECT doc_id, list_sort(list_distinct(regexp_split_to_array(trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '))) AS s FROM documents),
  g AS (SELECT *, min(doc_id) OVER (PARTITION BY s) AS rep FROM w), r AS (SELECT * FROM g WHERE doc_id = rep),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS n FROM r a JOIN r b ON a.doc_id < b.doc_id AND least(len(a.s), len(b.s)) > 0.8 * greatest(len(a.s), len(b.s)))
  SELECT a, b, round(i / (n - i)::DOUBLE, 6) AS jaccard FROM p WHERE i / (n - i)::DOUBLE > 0.8 UNION ALL SELECT rep, doc_id, 1.0::DOUBLE FROM g WHERE doc_id <> rep""")
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share more than 0.8 of their words; those with the same words are paired with the first of them."""
    return similar_sets(_docs(spark, sf_dir).select("doc_id", X.word_set(F.col("text")).alias("s")), 0.8)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), f AS (SELECT substr(md5(lower(trim(line))), 1, 12) AS fact_id, doc_id FROM l WHERE length(trim(line)) > 20)
  SELECT fact_id, min(doc_id) AS doc_id, count(*) AS n FROM f GROUP BY 1""")
def fact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length(F.trim("line")) > 20)
    return lines.groupBy(F.substring(F.md5(F.lower(F.trim("line"))), 1, 12).alias("fact_id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query(None)
def offline_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in embedder: hashed word counts, one Arrow batch at a time."""
    import zlib

    import numpy as np

    ship_code(spark)

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = np.zeros((len(batch), 64), dtype=np.float32)
            for i, words in enumerate(batch.str.lower().str.split()):
                for w in words:
                    out[i, zlib.crc32(w.encode()) % 64] += 1
            yield pd.Series(list(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)))

    return _docs(spark, sf_dir).select("doc_id", embed("text").alias("embedding"))


def _paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a paper: a preface in no section, its text under a heading with a formula behind it, and references."""
    body = F.replace("text", F.lit("#"), F.lit("_"))
    made = F.concat(F.lit(PREFACE), F.lit("\n\n# Methods used\n\n"), body, F.lit("\n\n$$ a + b\n\n= c $$\n\n# References\n\n"), F.substring(body, 1, 500))
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.substring(body, 1, 60).alias("title"), F.substring(body, 1, 400).alias("abstract"), made.alias("paper"))


PREFACE = "A preface of more than fifty characters that stands in no section of the paper at all."
_BARE = r"regexp_replace(%s, '[ \t\n\x0b\f\r]', '', 'g')"


@query(f"""SELECT doc_id, lang, source, section, md5(own) AS own_md5, true AS fits FROM documents, LATERAL (VALUES ('methods', {_BARE % "replace(text, '#', '_')"} || '$$a+b=c$$'), ('uncategorized', {_BARE % f"'{PREFACE}'"})) t(section, own)""")
def chunked_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the chunks of a section hold beyond their overlaps, and whether all are within 800 tokens; metadata ride along."""
    chunks = token_chunks(_paper(spark, sf_dir).withColumn("t", F.col("paper")), text="t", least=0).filter("level = 'paragraph'")
    own = F.regexp_replace(F.substring(F.col("paper"), F.col("fresh") + 1, F.col("stop") - F.col("fresh")), r"\s", "")
    parts = chunks.select("doc_id", "lang", "source", "section", "chunk", own.alias("own"), "n_tokens")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "own"))), lambda x: x["own"]), "")
    return parts.groupBy("doc_id", "lang", "source", "section").agg(F.md5(joined).alias("own_md5"), (F.max("n_tokens") <= 800).alias("fits"))


@query(None)
def paper_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of papers with a summary of title and abstract, and what is known of each paper."""
    chunks = token_chunks(_paper(spark, sf_dir), text="paper", title="title", abstract="abstract")
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return chunks.join(known, "doc_id", "left").select("doc_id", "chunk_id", "level", "section", "chunk", "start", "stop", "n_tokens", "n_formulas", "lang", "source", "quality", F.md5("chunk_text").alias("chunk_md5"))
