"""The registered queries of the numbered operators, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionByName(extra)))


ORACLES["op2_chat_formatting"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, chr(9243), chr(9243) || 'e'), '<|', '<' || chr(9243) || '|'), '|>', '|' || chr(9243) || '>') AS etext,
         replace(replace(replace(replace(role, chr(9243), chr(9243) || 'e'), '|', chr(9243) || 'p'), '<', chr(9243) || 'l'), '>', chr(9243) || 'g') AS erole,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN previous IS NULL OR previous <> role THEN length(erole) + 18 ELSE 9 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source", "row_key")


ORACLES["op8_source_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         length(coalesce(text, '')) AS chars,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), k AS (
  SELECT doc_id, source, size, -ln(u) / (CASE WHEN size > 0 THEN 1 / (1 + abs(ln(chars / size / 6))) ELSE 1 END) AS key FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM s
), r(step, source, source_size, cap, weight, budget, full_) AS (
  SELECT 0, source, source_size, cap, weight, budget, false FROM w
  UNION ALL
  SELECT step + 1, source, source_size, cap, weight, budget, full_ OR share >= cap FROM (
    SELECT *, (budget - coalesce(sum(cap) FILTER (full_) OVER (), 0)) * weight / nullif(sum(weight) FILTER (NOT full_) OVER (), 0) AS share FROM r
  ) WHERE step < 40
), f AS (
  SELECT *, (budget - coalesce(sum(cap) FILTER (full_) OVER (), 0)) * weight / nullif(sum(weight) FILTER (NOT full_) OVER (), 0) AS share FROM r WHERE step = 40
), t AS (
  SELECT source, source_size, round(CASE WHEN full_ THEN cap ELSE least(cap, share) END, 6) AS target FROM f
), e AS (
  SELECT k.doc_id, k.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (epochs + CASE WHEN start + size / 2.0::DOUBLE <= target - epochs * source_size AND start < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""


@query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.kneser_ney import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("key")


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table through a store: four arrivals, a compaction, then every document as the current version has it."""
    import uuid

    from pyspark.sql import functions as F

    from scriptorium.llm.sharding import ShardStore
    from scriptorium.session import shared_dir

    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
    for folder in store.write_arrivals(table(spark, sf_dir, "documents"), 4):
        store.append(folder)
    version = store.compact()
    store.vacuum(grace_seconds=0)  # the store has no other writer
    text = F.coalesce("text", F.lit(""))
    return store.read(version).select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), F.lit(version).cast("long").alias("version"))


ORACLES["op3_sharding"] = """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, CAST(5 AS BIGINT) AS version FROM documents
"""


@query
def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from scriptorium.llm.rp_forest import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.pq_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op5_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.a = v.vec_id
"""


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLES["op6_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.token_alignment import align_corpus

    return align_corpus(table(spark, sf_dir, "documents"))[0]


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from scriptorium.llm.license_scan import scan_licenses

    starts = F.col("places.start")
    return scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.llm.prefix_trie import forked, prefix_trie, turn_sequences
    from scriptorium.session import cut

    own = cut(turn_sequences(table(spark, sf_dir, "conversations")), "turn_sequences")
    return prefix_trie(forked(own))


ORACLES["op13_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, md5(length(role) || ':' || role || text) AS id,
         CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, pos, id, words FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, id, words FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(id, '') OVER w AS key, words FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), q AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, depth = max(depth) OVER (PARTITION BY conv_id) AS over FROM p
), n AS (
  SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS least, count(*) AS n, (count(*) - 1) * any_value(words) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over), '')) AS ends
  FROM q GROUP BY key
), k AS (
  SELECT parent AS key, count(*) AS children FROM n WHERE parent IS NOT NULL GROUP BY parent
), s AS (
  SELECT up.key, count(*) FILTER (k.children IS NULL) AS leaves, CAST(sum(n.saved) AS BIGINT) AS saved
  FROM n LEFT JOIN k ON k.key = n.key JOIN p up ON up.conv_id = n.least AND up.depth <= n.depth GROUP BY up.key
)
SELECT n.least AS conv_id, n.depth, u.least AS parent_conv_id, n.n AS n_convs, coalesce(k.children, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.key = n.key LEFT JOIN k ON k.key = n.key LEFT JOIN n u ON u.key = n.parent
"""
