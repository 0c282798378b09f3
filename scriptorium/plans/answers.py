"""Questions and answers over ``conversations``: classes, citations, plans, prompts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.functions import questions as Q
from scriptorium.functions import text as X
from scriptorium.functions.jsonrepair import repair
from scriptorium.session import ship_code, table

# The generated texts hold no English questions: a phrase chosen by the row's number is put in front.
_PHRASES = (
    "What is TTC?", "How does speed affect crash severity and injury risk at an urban intersection?", "Compare red-light camera versus speed camera programs.",
    "Give an overview of empirical Bayes before-after studies.", "List the main factors", "Explain the relationship between highway safety and pedestrian crash frequency in literature, research and practice.",
)
_SQL_PHRASES = "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in _PHRASES) + "]"
_ASKED = f"q AS (SELECT conv_id, turn, {_SQL_PHRASES}[((conv_id + turn) % {len(_PHRASES)} + 1)::INT] || ' ' || text AS text FROM conversations WHERE role = 'user')"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrase = F.element_at(F.array(*map(F.lit, _PHRASES)), ((F.col("conv_id") + F.col("turn")) % len(_PHRASES) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.concat(phrase, F.lit(" "), F.col("text")).alias("text"))


def _has(pattern: str) -> str:
    return "regexp_matches(lower(text), '" + pattern.replace("'", "''") + "')"


_WORDS = r"len(regexp_extract_all(text, '\S+'))"
_TYPE = f"CASE WHEN {_has(Q.REVIEW)} THEN 'review' WHEN {_has(Q.COMPARISON)} THEN 'comparison' WHEN {_has(Q.MECHANISM)} THEN 'mechanism' WHEN {_has(Q.DEFINITION)} AND {_WORDS} <= 6 THEN 'definition' ELSE 'general' END"


@query(f"""WITH {_ASKED}, t AS (SELECT *, {_TYPE} AS question_type FROM q) SELECT conv_id, turn, question_type,
  CAST(CASE question_type WHEN 'review' THEN 20 WHEN 'comparison' THEN 8 WHEN 'mechanism' THEN 10 WHEN 'definition' THEN 3 ELSE CASE WHEN {_WORDS} > 20 THEN 13 ELSE 8 END END AS INTEGER) AS min_papers,
  CAST(CASE question_type WHEN 'review' THEN 50 WHEN 'comparison' THEN 20 WHEN 'mechanism' THEN 25 WHEN 'definition' THEN 8 ELSE CASE WHEN {_WORDS} > 20 THEN 25 ELSE 15 END END AS INTEGER) AS max_papers FROM t""")
def question_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = Q.paper_range(F.col("text"))
    return _asked(spark, sf_dir).select("conv_id", "turn", Q.question_type(F.col("text")).alias("question_type"), low.alias("min_papers"), high.alias("max_papers"))


_HARD = " + ".join(f"{_has(p)}::INT" for p in Q.COMPLEX)
_MEDIUM = " + ".join(f"{_has(p)}::INT" for p in Q.MODERATE)


@query(f"""WITH {_ASKED}, s AS (SELECT *, {_WORDS} AS n, len(regexp_extract_all(text, '[.!?]')) AS marks FROM q),
  h AS (SELECT *, {_HARD} + CASE WHEN n > 40 THEN 2 ELSE 0 END + CASE WHEN marks >= 3 THEN 2 ELSE 0 END + CASE WHEN {_has(Q.ACADEMIC)} THEN 2 ELSE 0 END AS hard,
   {_MEDIUM} + CASE WHEN n > 20 AND n <= 40 THEN 1 ELSE 0 END + CASE WHEN marks = 2 THEN 1 ELSE 0 END AS medium FROM s),
  l AS (SELECT *, CASE WHEN hard >= 3 OR (hard >= 2 AND n > 30) THEN 'complex' WHEN medium >= 2 OR hard >= 1 THEN 'moderate' ELSE 'simple' END AS complexity FROM h)
  SELECT conv_id, turn, complexity, CASE WHEN complexity = 'simple' THEN 'moderate' ELSE 'long' END AS length_high FROM l""")
def question_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = Q.complexity(F.col("text"))
    return _asked(spark, sf_dir).select("conv_id", "turn", level.alias("complexity"), Q.response_length(level, "High").alias("length_high"))


@query(rf"""WITH {_ASKED} SELECT conv_id, turn, NOT ({_has(r'\b(and|or|versus|vs\.?|compared to|difference between)\b|\b(what are|list|enumerate|identify all)\b')} OR regexp_matches(text, '(?s)\?.*\?') OR {_WORDS} > 15) AS simple FROM q""")
def simple_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", (~Q.is_complex(F.col("text"))).alias("simple"))


@query(r"WITH " + _ASKED + r""", p AS (SELECT conv_id, turn, text, list_filter(list_transform(regexp_split_to_array(text, '(?i)\s+and\s+'), lambda x: trim(x)), lambda x: length(x) > 10) AS parts, len(regexp_split_to_array(text, '(?i)\s+and\s+')) AS k FROM q)
  SELECT conv_id, turn, CAST(len(list_distinct(CASE WHEN k > 1 THEN list_prepend(text, parts) ELSE [text] END)) AS INTEGER) AS n_parts, CASE WHEN k > 1 AND len(parts) > 0 THEN parts[len(parts)] ELSE text END AS last_part FROM p""")
def query_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = Q.sub_questions(F.col("text"))
    return _asked(spark, sf_dir).select("conv_id", "turn", F.size(parts).alias("n_parts"), F.element_at(parts, -1).alias("last_part"))


def _synonym_sql() -> str:
    made = [f"CASE WHEN contains(lower(text), '{t}') THEN regexp_replace(text, '(?i)\\b{t}\\b', '{s}', 'g') END" for t, found in Q.SYNONYMS.items() for s in found]
    return f"WITH {_ASKED} SELECT conv_id, turn, list_filter([text, {', '.join(made)}], lambda x: x IS NOT NULL)[1:3] AS variants FROM q"


@query(_synonym_sql())
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("conv_id", "turn", Q.with_synonyms(F.col("text")).alias("variants"))


def _entity_sql() -> str:
    cols = ", ".join(f"list_sort(list_distinct(regexp_extract_all(lower(text), '{p}'))) AS {n}" for n, p in Q.ENTITIES.items())
    filled = " + ".join(f"(len({n}) > 0)::INT" for n in Q.ENTITIES)
    ascii_ = "(SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM q)"
    return f"WITH {_ASKED}, e AS (SELECT conv_id, turn, {cols} FROM {ascii_}) SELECT *, round(({filled}) / 5.0, 6)::DOUBLE AS coverage FROM e"


@query(_entity_sql())
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Q.entities(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))  # engines differ on word ends beside accents
    filled = sum(((F.size(c) > 0).cast("int") for c in found.values()), F.lit(0))
    return _asked(spark, sf_dir).select("conv_id", "turn", *[c.alias(n) for n, c in found.items()], F.round(filled / 5.0, 6).alias("coverage"))


@query(f"""WITH {_ASKED}, t AS (SELECT conv_id, turn, {_TYPE} AS k, (conv_id % 10) / 10.0::DOUBLE AS c FROM q) SELECT conv_id, turn,
  CASE k WHEN 'definition' THEN 1 WHEN 'comparison' THEN CASE WHEN c >= 0.75 THEN 1 ELSE 2 END WHEN 'review' THEN CASE WHEN c >= 0.85 THEN 2 ELSE 3 END WHEN 'mechanism' THEN 2 ELSE CASE WHEN c >= 0.85 THEN 1 ELSE 2 END END AS rounds,
  CASE k WHEN 'definition' THEN 'skip' WHEN 'comparison' THEN CASE WHEN c >= 0.75 THEN 'skip' ELSE 'quick' END WHEN 'review' THEN CASE WHEN c >= 0.85 THEN 'quick' ELSE 'full' END WHEN 'mechanism' THEN CASE WHEN c >= 0.70 THEN 'quick' ELSE 'full' END
   ELSE CASE WHEN c >= 0.85 THEN 'skip' WHEN c >= 0.65 THEN 'quick' ELSE 'full' END END AS mode FROM t""")
def adaptive_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    rounds, mode, _ = Q.adaptive_rounds(Q.question_type(F.col("text")), F.col("conv_id") % 10 / 10.0)
    return _asked(spark, sf_dir).select("conv_id", "turn", rounds.alias("rounds"), mode.alias("mode"))


_ANSWERED = "a AS (SELECT conv_id, turn, text || ' [' || (turn + 1) || ', 3]' || chr(10) || 'Seen by Smith et al. (2020) [2-' || (2 + conv_id % 4) || '].' || CASE WHEN conv_id % 5 = 0 THEN ' And (open' ELSE '' END AS text FROM conversations WHERE role = 'assistant')"


def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with citations put behind them, some cut off."""
    s = lambda c: c.cast("string")
    tail = F.when(F.col("conv_id") % 5 == 0, " And (open").otherwise("")
    text = F.concat("text", F.lit(" ["), s(F.col("turn") + 1), F.lit(", 3]\nSeen by Smith et al. (2020) [2-"), s(2 + F.col("conv_id") % 4), F.lit("]."), tail)
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", text.alias("text"))


@query(f"""WITH {_ANSWERED}, n AS (SELECT conv_id, turn, list_distinct(list_concat([turn + 1, 3], range(2, 3 + conv_id % 4))) AS c FROM a)
  SELECT conv_id, turn, list_sort(c) AS cited, CAST(len(list_filter(c, lambda x: x <= 4)) AS BIGINT) AS valid, round(len(list_filter(c, lambda x: x <= 4)) / 4.0::DOUBLE, 6) AS coverage,
   CASE WHEN len(list_filter(c, lambda x: x > 4)) > 0 THEN 'invalid' WHEN len(c) >= 4 THEN 'high' ELSE 'partial' END AS badge FROM n""")
def citation_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers cited in lists and ranges against four sources."""
    rows = _answered(spark, sf_dir).select("conv_id", "turn", F.transform(Q.cited_numbers(F.col("text")), lambda x: x.cast("long")).alias("c"))
    valid = F.size(F.filter("c", lambda x: x <= 4))
    badge = F.when(F.exists("c", lambda x: x > 4), "invalid").when(F.size("c") >= 4, "high").otherwise("partial")
    return rows.select("conv_id", "turn", F.array_sort("c").alias("cited"), valid.cast("long").alias("valid"), F.round(valid / 4.0, 6).alias("coverage"), badge.alias("badge"))


@query(f"WITH {_ANSWERED} SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN 'Unclosed parenthesis' ELSE 'OK' END AS issue FROM a")
def section_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answered(spark, sf_dir).select("conv_id", "turn", Q.section_issue(F.col("text")).alias("issue"))


@query(f"""WITH {_ANSWERED}, r AS (SELECT * FROM (VALUES (1, 'Smith, J. (2020). One.', 'Smith', '2020'), (2, 'Doe, A. (2019). Two.', 'Doe', '2019'), (3, 'Brown, B. (2020). Three.', 'Brown', '2020')) v(ref_id, reference, surname, year))
  SELECT conv_id, turn, ref_id, regexp_matches(text, surname || '[^0-9]{{0,30}}' || year) AS cited FROM a, r""")
def reference_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three references against every answer: cited if the surname stands near the year."""
    refs = ((1, "Smith", "2020"), (2, "Doe", "2019"), (3, "Brown", "2020"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("ref_id"), F.col("text").rlike(f"{s}[^0-9]{{0,30}}{y}").alias("cited")) for i, s, y in refs]))
    return _answered(spark, sf_dir).select("conv_id", "turn", each.alias("r")).select("conv_id", "turn", "r.ref_id", "r.cited")


@query("""WITH p AS (SELECT conv_id, turn, unnest([conv_id, conv_id + turn, conv_id * 1000]) AS doc_id FROM conversations WHERE role = 'assistant')
  SELECT p.conv_id, p.turn, list_sort(list(DISTINCT d.doc_id)) AS evidence, list_sort(list(DISTINCT d.source)) AS sources FROM p JOIN documents d USING (doc_id) GROUP BY 1, 2""")
def plan_evidence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans name their evidence by id; unknown ids and empty plans drop out."""
    ids = F.explode(F.array("conv_id", F.col("conv_id") + F.col("turn"), F.col("conv_id") * 1000))
    plans = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", ids.alias("doc_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return plans.join(docs, "doc_id").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("doc_id")).alias("evidence"), F.array_sort(F.collect_set("source")).alias("sources"))


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
  SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS prompt FROM w WHERE k <= 5 GROUP BY 1""")
def history_window_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = table(spark, sf_dir, "conversations").withColumn("k", F.row_number().over(w)).filter("k <= 5")
    line = F.struct("turn", F.concat("role", F.lit(": "), F.col("text")).alias("line"))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"))


@query("""SELECT conv_id, md5('# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('**' || upper(left(role, 1)) || substr(role, 2) || ':** ' || text, chr(10) || chr(10) ORDER BY turn)) AS markdown_md5 FROM conversations GROUP BY 1""")
def conversation_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("turn", F.concat(F.lit("**"), F.initcap("role"), F.lit(":** "), "text").alias("line"))
    made = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n\n").alias("body"))
    return made.select("conv_id", F.md5(F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n\n"), "body")).alias("markdown_md5"))


_FOUND = ", ".join("nullif(regexp_extract(text, '(?i)" + p.replace("'", "''") + "', 0), '')" for p in X.INJECTION)


@query(f"SELECT conv_id, turn, coalesce({_FOUND}, '') AS found FROM conversations")
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first suspicious phrase of each turn's whole text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.injection(F.col("text")).alias("found"))


@query("""SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'SUFFICIENT' WHEN 1 THEN 'MISSING' ELSE 'RESTRUCTURE' END AS decision, CASE conv_id % 3 WHEN 1 THEN 'data of ' || turn END AS missing FROM conversations""")
def audit_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    reply = F.when(F.col("conv_id") % 3 == 0, "Sufficient evidence.").when(F.col("conv_id") % 3 == 1, F.concat(F.lit("MISSING: data of "), F.col("turn").cast("string"))).otherwise("start again")
    decision, missing = Q.audit_decision(reply)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", decision.alias("decision"), missing.alias("missing"))


@query("SELECT conv_id, turn, conv_id AS id, turn AS n FROM conversations")
def llm_json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies cut off inside their JSON are closed again and read."""
    ship_code(spark)

    @F.pandas_udf("string")
    def fixed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(repair)

    body = F.format_string('```json\n[{"id": %d, "n": %d}, {"id": ', "conv_id", "turn")
    read = F.from_json(fixed(body), "array<struct<id: long, n: long>>")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.get(read, F.lit(0)).alias("r")).select("conv_id", "turn", "r.id", "r.n")
