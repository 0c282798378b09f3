"""Planning and parsing around answers: targets, estimates, progress, model replies, logs."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators import search as S
from scriptorium.operators.tables import all_of
from scriptorium.session import ship_code, table

# Fixed values of the models below.
SECONDS = {"query_expansion": 5.0, "hyde": 8.0, "embedding": 0.2, "vector_search": 0.3, "reranking_per_10": 1.5, "context_building": 0.1, "llm_base": 20.0, "llm_per_1000_tokens": 10.0, "validation": 0.1}
VAGUE = "improve|enhance|clarify|restructure|reorganize"
SPECIFIC = "delete|remove|replace|add|insert|change|move"
FINAL_SECTION = r"(?i)\b(conclusion|summary|recommendation|key\s*finding|synthesis|final\s*remark|implication|takeaway)"


@query("""WITH t AS (SELECT conv_id, turn, ['complex', 'moderate', 'simple'][(conv_id % 3 + 1)::INT] AS complexity, ['long', 'moderate', 'short'][(turn % 3 + 1)::INT] AS length FROM conversations),
  h AS (SELECT *, 30 - 5 * (conv_id % 3) - 5 * (turn % 3) AS high FROM t), g AS (SELECT *, CASE complexity WHEN 'complex' THEN high WHEN 'moderate' THEN floor(high * 0.85) ELSE floor(high * 0.70) END AS target FROM h)
  SELECT conv_id, turn, CAST(greatest(3, target) AS BIGINT) AS target, CAST(greatest(3, floor(greatest(3, target) * 0.7)) AS BIGINT) AS least, CAST(floor(greatest(3, target) * 1.3) AS BIGINT) AS most FROM g""")
def citation_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations by complexity and length: 30 at most, five fewer a step, scaled by complexity."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 3).alias("c"), (F.col("turn") % 3).alias("l"))
    high = 30 - 5 * F.col("c") - 5 * F.col("l")
    target = F.greatest(F.lit(3).cast("long"), F.when(F.col("c") == 0, high).when(F.col("c") == 1, F.floor(high * 0.85)).otherwise(F.floor(high * 0.70)).cast("long"))
    return rows.select("conv_id", "turn", target.alias("target"), F.greatest(F.lit(3).cast("long"), F.floor(target * 0.7)).alias("least"), F.floor(target * 1.3).alias("most"))


@query("""SELECT conv_id, turn, round((CASE conv_id % 3 WHEN 0 THEN 0.5 ELSE 13.5 END + CASE WHEN conv_id % 3 = 2 THEN (10 + turn) / 10.0 * 1.5 ELSE 0 END + 0.2 + 20 + 10 * (CASE conv_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END))::DOUBLE, 6) AS seconds FROM conversations""")
def time_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds by depth: searching, reranking by papers, generating by tokens."""
    depth, papers = F.col("conv_id") % 3, 10 + F.col("turn")
    s = SECONDS
    search = F.lit(s["embedding"] + s["vector_search"]) + F.when(depth > 0, s["query_expansion"] + s["hyde"]).otherwise(0.0)
    rerank = F.when(depth == 2, papers / 10.0 * s["reranking_per_10"]).otherwise(0.0)
    tokens = F.when(depth == 0, 1).when(depth == 1, 2).otherwise(4)
    total = search + rerank + s["context_building"] + s["validation"] + s["llm_base"] + tokens * s["llm_per_1000_tokens"]
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(total, 6).alias("seconds"))


@query("""WITH t AS (SELECT conv_id, count(*) AS sources, [2, 3, 5][(conv_id % 3 + 1)::INT] + CASE WHEN conv_id % 3 = 2 THEN 1 ELSE 0 END AS n FROM conversations GROUP BY conv_id)
  SELECT conv_id, CAST(CASE WHEN sources < n * 3 THEN greatest(2, sources // 3) ELSE n END AS BIGINT) AS sections FROM t""")
def section_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("sources"))
    n = F.when(F.col("conv_id") % 3 == 0, 2).when(F.col("conv_id") % 3 == 1, 3).otherwise(6)
    return by.select("conv_id", F.when(F.col("sources") < n * 3, F.greatest(F.lit(2), F.floor(F.col("sources") / 3))).otherwise(n).cast("long").alias("sections"))


@query("""SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN 'more on turn ' || turn END AS follow_up, 'seen ' || conv_id AS thought FROM conversations""")
def reflection_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """THOUGHT and DECISION of a model's reply; a follow-up question unless it says SUFFICIENT."""
    s = lambda c: F.col(c).cast("string")
    reply = F.concat(F.lit("THOUGHT: seen "), s("conv_id"), F.lit("\nDECISION: "), F.when(F.col("conv_id") % 2 == 0, "SUFFICIENT").otherwise(F.concat(F.lit('FOLLOW_UP "more on turn '), s("turn"), F.lit('"'))))
    decision = F.regexp_extract(reply, r"(?is)decision:\s*(.*)", 1)
    thought = F.trim(F.regexp_extract(reply, r"(?is)(?:thought|reasoning):\s*(.*?)\s*(?:decision:|$)", 1))
    asked = F.nullif(F.substring(F.regexp_extract(decision, r"""(?i)follow_up.*?["'](.+?)["']""", 1), 1, 200), F.lit(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(~F.upper(decision).contains("SUFFICIENT"), asked).alias("follow_up"), thought.alias("thought"))


_ACTIONS = ("fix it", "improve the clarity of this section", "Replace this with 'that' here", "Rewrite the entire section now", "Rewrite 'a' to 'b' please", "enhance and add detail", "rewrite this paragraph", "Remove the last sentence")
_ACTIONABLE = (False, False, True, False, True, True, False, True)


@query("SELECT conv_id, turn, " + str(list(_ACTIONABLE)).lower() + f"[((conv_id + turn) % {len(_ACTIONS)} + 1)::INT] AS actionable FROM conversations")
def actionable_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits concrete enough to carry out."""
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), ((F.col("conv_id") + F.col("turn")) % len(_ACTIONS) + 1).cast("int"))
    low = F.lower(action)
    quoted = action.rlike("""['"]""")
    broad = (F.length(action) < 10) | low.rlike("(entire|whole) section")
    concrete = F.when(low.rlike(VAGUE), quoted | low.rlike(SPECIFIC)).when(low.contains("rewrite"), quoted | low.rlike(" (to|as) ")).otherwise(F.lit(True))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (~broad & concrete).alias("actionable"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'INFO' WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, CASE WHEN event_id % 5 = 0 THEN '' ELSE upper(event_type) END AS stage FROM events""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time - level - [STAGE] message; other lines are messages of level INFO."""
    return _logged(spark, sf_dir).select("event_id", "level", "stage")


def _logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.when(F.col("event_id") % 5 == 0, "a line without structure").otherwise(F.concat_ws(" - ", F.col("ts").cast("string"), level, F.concat(F.lit("["), F.upper("event_type"), F.lit("] user - "), F.col("user_id").cast("string"))))
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("line")).withColumn("parts", F.split("line", " - ", 3))
    whole = F.size("parts") == 3
    message = F.when(whole, F.get("parts", F.lit(2))).otherwise(F.col("line"))
    return lines.select("event_id", "line", F.when(whole, F.trim(F.get("parts", F.lit(1)))).otherwise("INFO").alias("level"), F.regexp_extract(message, r"^\[([^\]]*)\]", 1).alias("stage"))


@query("""SELECT event_id FROM events WHERE event_id % 5 <> 0 AND upper(event_type) IN ('ERROR', 'CLICK') AND contains('[' || upper(event_type) || '] user - ' || user_id, 'user - 1')""")
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of some levels and some stages that hold a phrase; a condition without values lets all pass."""
    return matching_lines(_logged(spark, sf_dir), ["ERROR", "INFO"], ["ERROR", "CLICK"], "user - 1").select("event_id")


def matching_lines(lines: DataFrame, levels: list[str], stages: list[str], phrase: str) -> DataFrame:
    return lines.filter(all_of(F.col("level").isin(levels) if levels else None, F.col("stage").isin(stages) if stages else None, F.lower("line").contains(phrase.lower()) if phrase else None))


@query("""SELECT page_id, regexp_matches(html, '(?i)<h[1-6][^>]*>[^<]*(conclusion|summary|recommendation|synthesis|implication|takeaway)') AS has_final FROM pages""")
def final_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").rlike(r"(?i)<h[1-6][^>]*>[^<]*(conclusion|summary|recommendation|synthesis|implication|takeaway)").alias("has_final"))


@query("""WITH w AS (SELECT conv_id, max(turn) AS done, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, round(least(100.0, (0.2 + 0.3 + 0.5 * least(done, 4) / 5) * 100)::DOUBLE, 6) AS progress FROM w""")
def weighted_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished phases by weight, and the current one by its finished steps."""
    phases, steps = F.array(*map(F.lit, (0.2, 0.3))), F.lit(5)
    before = F.aggregate(phases, F.lit(0.0), lambda s, x: s + x)
    by = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("done"))
    return by.select("conv_id", F.round(F.least(F.lit(100.0), (before + 0.5 * F.least(F.col("done"), F.lit(4)) / steps) * 100), 6).alias("progress"))


@query("""WITH i AS (SELECT vec_id AS doc_id FROM embeddings), m AS (SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM i) AS indexed, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM i)) AS missing)
  SELECT total, indexed, missing, CASE WHEN indexed = 0 OR missing > 0.5 * total THEN 'full' WHEN missing > 0 THEN 'incremental' ELSE 'fresh' END AS plan FROM m""")
def index_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rebuild the keyword index, add what is missing, or leave it."""
    docs, held = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("held"))
    m = docs.join(held, "doc_id", "left").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("held").isNull(), 1)).alias("missing"))
    m = m.join(F.broadcast(held.agg(F.count(F.lit(1)).alias("indexed"))))
    plan = F.when((F.col("indexed") == 0) | (F.col("missing") > 0.5 * F.col("total")), "full").when(F.col("missing") > 0, "incremental").otherwise("fresh")
    return m.select("total", "indexed", "missing", plan.alias("plan"))


@query("""WITH q AS (SELECT conv_id, turn, md5(lower(trim(text))) AS h FROM conversations WHERE role = 'user') SELECT conv_id, turn, h AS query_hash, row_number() OVER (PARTITION BY h ORDER BY conv_id, turn) > 1 AS cached FROM q""")
def session_cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question asked before (but for case and spaces) is answered from the cache."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.md5(F.lower(F.trim("text"))).alias("query_hash"))
    w = Window.partitionBy("query_hash").orderBy("conv_id", "turn")
    return asked.withColumn("cached", F.row_number().over(w) > 1)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(round(greatest(-127, least(127, x / 0.35 * 127))) AS INTEGER)) AS q FROM embeddings)
  SELECT vec_id, CAST(list_min(q) AS INTEGER) AS low, CAST(list_max(q) AS INTEGER) AS high FROM e""")
def int8_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in a byte a component, clipped at a fixed quantile bound."""
    q = F.transform("embedding", lambda x: F.round(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), x.cast("double") / 0.35 * 127))).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_min(q).alias("low"), F.array_max(q).alias("high"))


@query("""WITH b AS (SELECT vec_id AS q, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT b.q AS query_id, v.vec_id, round(list_cosine_similarity(b.e, v.embedding::DOUBLE[]), 6) AS score FROM b, embeddings v WHERE v.vec_id <> b.q)
  SELECT query_id, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def quantised_search_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in bytes, then exact scores of what the codes' errors leave open; queries: every vec_id divisible by 100."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = S.nearest(v, asked, 3, clip=0.35, skip_self=True)
    return found.select("query_id", "vec_id", F.col("similarity").alias("score"), F.col("semantic_rank").alias("rank"))



@query("""WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, CAST(k AS BIGINT) AS k, CASE WHEN CAST(k AS BIGINT) % 2 = 0 THEN ['even', event_type] ELSE [event_type] END AS tags FROM e""")
def json_decode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON map with a default for what isn't there."""
    props = F.coalesce(F.from_json("props", "map<string, string>"), F.create_map().cast("map<string, string>"))
    k = F.try_element_at(props, F.lit("k")).cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k % 2 == 0, F.array(F.lit("even"), "event_type")).otherwise(F.array("event_type")).alias("tags"))


@query(None)
def merge_small_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each plan, merge the two neighbours with the fewest citations until four sections are left."""
    ship_code(spark)

    def merge(plan: pd.DataFrame) -> pd.DataFrame:
        plan = plan.sort_values("turn")
        titles, cited = plan["title"].tolist(), plan["cited"].astype(int).tolist()
        n = left = len(titles)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours of the section that begins at a place
        alive = [True] * n
        heap = [(cited[k] + cited[k + 1], k, k + 1) for k in range(n - 1)]
        heapq.heapify(heap)
        while left > 4:
            total, a, b = heapq.heappop(heap)
            if not alive[a] or not alive[b] or after[a] != b or cited[a] + cited[b] != total:
                continue  # one of the two has been merged since
            cited[a], alive[b], after[a] = total, False, after[b]
            left -= 1
            if after[a] < n:
                before[after[a]] = a
                heapq.heappush(heap, (total + cited[after[a]], a, after[a]))
            if before[a] >= 0:
                heapq.heappush(heap, (cited[before[a]] + total, before[a], a))
        made = [(k, " & ".join(titles[k : after[k]]), cited[k]) for k in range(n) if alive[k]]
        return pd.DataFrame([(plan["conv_id"].iloc[0], i, t, c) for i, (_, t, c) in enumerate(made)], columns=["conv_id", "section", "title", "cited"])

    plans = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("S"), F.col("turn").cast("string")).alias("title"), (F.length("text") % 9).cast("long").alias("cited"))
    return plans.groupBy("conv_id").applyInPandas(merge, "conv_id long, section long, title string, cited long")
