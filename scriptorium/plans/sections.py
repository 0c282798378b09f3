"""Sections, citations and front matter of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import text as X
from scriptorium.session import table

# Pages as text with headings; conversations with citations at the ends of some sentences.
_MD = r"m AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<h[1-6][^>]*>', chr(10) || '## ', 'g'), '(?i)</h[1-6]>', chr(10), 'g') AS t FROM pages)"
_CITING = r"""c AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(regexp_replace(text, 'n\. ', 'n (Ortiz et al., ' || (1990 + conv_id % 30) || '). ', 'g'), 'e\. ', 'e, as Brandt (' || (1980 + turn) || ') says. ', 'g'), 's\. ', 's [' || turn || ']. ', 'g') AS t FROM conversations)"""


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')"


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace(F.regexp_replace("html", "(?i)<h[1-6][^>]*>", "\n## "), "(?i)</h[1-6]>", "\n")
    return table(spark, sf_dir, "pages").select("page_id", text.alias("t"))


def _citing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    t = F.regexp_replace("text", F.lit(r"n\. "), F.concat(F.lit("n (Ortiz et al., "), s(F.col("conv_id") % 30 + 1990), F.lit("). ")))
    t = F.regexp_replace(t, F.lit(r"e\. "), F.concat(F.lit("e, as Brandt ("), s(F.col("turn") + 1980), F.lit(") says. ")))
    t = F.regexp_replace(t, F.lit(r"s\. "), F.concat(F.lit("s ["), s(F.col("turn")), F.lit("]. ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", t.alias("t"))


_HEADS = ("Abstract", "Introduction", "Methods", "Results", "Discussion", "Conclusions", "References")


def _headed_sql(before: str, after: str) -> str:
    return "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: " + before + " || " + str(list(_HEADS)) + f"[((i - 1) % {len(_HEADS)} + 1)::INT] || {after} || x), chr(10))"


def _lines_headed(spark: SparkSession, sf_dir: str, before: str, after: str) -> DataFrame:
    """Each document's lines get the sections' names in turn."""
    heads = F.array(*map(F.lit, _HEADS))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit(before), F.element_at(heads, i % len(_HEADS) + 1), F.lit(after), x))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("t"))


_NAME = "CASE " + " ".join(f"WHEN contains(h, '{w}') THEN '{s}'" for w, s in X.SECTIONS.items()) + " END"


@query(rf"""WITH m AS (SELECT doc_id, {_headed_sql("'## '", "chr(10)")} AS t FROM documents), p AS (SELECT doc_id, regexp_split_to_array(chr(10) || t, '\n#+[ \t\n\f\r]*') AS a FROM m),
  u AS (SELECT doc_id, unnest(a[2:]) AS part, unnest(range(2, len(a) + 1)) AS i FROM p), n AS (SELECT doc_id, i, lower(trim(split_part(part, chr(10), 1))) AS h, substr(part, length(split_part(part, chr(10), 1)) + 1) AS body FROM u),
  s AS (SELECT doc_id, i, {_NAME} AS section, {_strip('body')} AS content FROM n)
  SELECT doc_id, section, md5(arg_max(content, i)) AS content_md5, CAST(max(length(content)) AS BIGINT) AS longest, count(*) AS headings FROM s WHERE section IS NOT NULL GROUP BY 1, 2""")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by heading; of several with one name the last stays."""
    found = _lines_headed(spark, sf_dir, "## ", "\n").select("doc_id", F.posexplode(X.markdown_sections(F.col("t"))).alias("i", "s"))
    length = F.length("s.content").cast("long")
    return found.groupBy("doc_id", F.col("s.section").alias("section")).agg(F.md5(F.max_by("s.content", "i")).alias("content_md5"), F.max(length).alias("longest"), F.count(F.lit(1)).alias("headings"))


@query(rf"""WITH {_MD}, p AS (SELECT page_id, list_filter(list_transform(string_split(replace(chr(10) || t, chr(10) || '## ', chr(1) || '## '), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '') AS a FROM m)
  SELECT page_id, CAST(len(a) AS BIGINT) AS parts, md5(a[len(a)]) AS last_md5 FROM p""")
def second_level_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text cut before each heading of the second level."""
    rows = _headed(spark, sf_dir).select("page_id", X.second_level_parts(F.col("t")).alias("a"))
    return rows.select("page_id", F.size("a").cast("long").alias("parts"), F.md5(F.try_element_at("a", F.lit(-1))).alias("last_md5"))


_PLAIN = f"p AS (SELECT doc_id, {_headed_sql("''", "': '")} AS t FROM documents)"


def _found(name: str) -> str:
    start, stop = X.PLAIN_SECTIONS[name]
    pattern = f"(?is){start}(?:{stop})"
    return f"CASE WHEN regexp_matches(t, '{pattern}') THEN md5(substr({_strip(f"regexp_extract(t, '{pattern}', 1)")}, 1, 5000)) END AS {name}"


@query(f"WITH {_PLAIN} SELECT doc_id, " + ", ".join(map(_found, X.PLAIN_SECTIONS)) + " FROM p")
def plain_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of plain text by their words; each document's lines get the names in turn."""
    rows = _lines_headed(spark, sf_dir, "", ": ")
    return rows.select("doc_id", *[F.md5(c).alias(name) for name, c in X.plain_sections(F.col("t")).items()])


_ALL_CITED = "list_concat(" * (len(X.CITED) - 1) + ", ".join(f"regexp_extract_all(t, '{p.replace(chr(39), chr(39) * 2)}')" + (")" if i else "") for i, p in enumerate(X.CITED))


@query(f"WITH {_CITING} SELECT conv_id, turn, list_sort(list_distinct({_ALL_CITED})) AS cited FROM c")
def citations_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The different citations of a text, in parentheses, narrative or by number."""
    return _citing(spark, sf_dir).select("conv_id", "turn", X.citations(F.col("t")).alias("cited"))


@query(rf"""WITH {_CITING}, s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(t, '([.!?])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\([A-Z][a-z]+.*?\d{{4}}\)'))[1:5] AS a FROM c)
  SELECT conv_id, turn, list_transform(a, lambda x: CASE WHEN length(x) > 100 THEN substr(x, 1, 100) || '...' ELSE x END) AS points FROM s""")
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five sentences that cite somebody."""
    return _citing(spark, sf_dir).select("conv_id", "turn", X.key_points(F.col("t")).alias("points"))


@query(rf"""SELECT conv_id, turn, md5({_strip('text')}) AS body_md5 FROM conversations""")
def section_without_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title that a section repeats in front of its text goes, in each of its forms."""
    title = F.concat_ws(" ", F.lit("Part (a+b)"), "role", F.col("turn").cast("string"))
    form = F.col("turn") % 3
    headed = F.concat(F.when(form == 0, "## ").when(form == 1, "").otherwise("**"), F.upper(title), F.when(form == 2, "**").otherwise(""), F.lit(" \n\n"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.without_title(headed, title)).alias("body_md5"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '\. ', ' --- ```', 'g') AS t FROM documents)
  SELECT doc_id, md5(replace(replace(t, '```', ''''''''), '---', '___')) AS prompt_md5, md5(regexp_replace(regexp_replace(substr(t, 1, 1000), '[\x00-\x08\x0B-\x1F\x7F-\x{9F}]', '', 'g'), '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')) AS feedback_md5 FROM t""")
def prompt_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that go into a prompt, and remarks of users, at most 1000 characters."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", r"\. ", " --- ```").alias("t"))
    return rows.select("doc_id", F.md5(X.for_prompt(F.col("t"))).alias("prompt_md5"), F.md5(X.feedback(F.col("t"))).alias("feedback_md5"))


@query(r"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{5,}') AND NOT list_contains(" + str(list(X.REVIEW_STOP_WORDS)) + ", w)))) AS keywords FROM documents")
def review_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.review_keywords(F.col("text")).alias("keywords"))


_OTHER = r"^(abstract|introduction|doi|volume|page|copyright|journal|received|accepted|published|e-?mail|corresponding|\d+$|[a-z]{1,3}\d+)"


@query(rf"""WITH l AS (SELECT doc_id, list_transform(string_split({_strip('text')}, chr(10))[1:15], lambda x: {_strip('x')}) AS a FROM documents),
  t AS (SELECT doc_id, list_filter(a, lambda x: length(x) BETWEEN 20 AND 300 AND NOT regexp_matches(lower(x), '{_OTHER}'))[1] AS title FROM l)
  SELECT doc_id, regexp_replace(title, '^#+\s*', '') AS title, CASE WHEN 1940 + doc_id % 100 BETWEEN 1950 AND 2025 THEN CAST(1940 + doc_id % 100 AS INTEGER) END AS year FROM t""")
def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and year from a first page; every document gets a line that says when it was published."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.col("text"), F.lit("\nPublished: "), (F.col("doc_id") % 100 + 1940).cast("string"))
    return docs.select("doc_id", X.first_page_title(F.col("text")).alias("title"), X.first_page_year(F.regexp_replace(text, r"\(\d{4}\)", ""), 2025).alias("year"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '[DOI: 10.1234/' || replace(p_name, ' ', '_') || ']' WHEN 1 THEN replace(p_name, ' ', ' ') ELSE 'Untitled Document' END AS title FROM part""")
def title_of_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("10.1234_"), slug)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("_"), F.replace(slug, F.lit("_"), F.lit("_-- ")), F.lit("-"))).otherwise("_-_")
    return table(spark, sf_dir, "part").select("p_partkey", X.title_of_file(name).alias("title"))
