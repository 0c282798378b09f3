"""Catalogue tables: counts, pages, inserts, upserts, semi and anti joins, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators import tables as op
from scriptorium.session import table


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey % 10 AS owner, count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS pending,
  count(*) FILTER (o_orderstatus = 'O') AS processing, count(*) FILTER (o_orderstatus = 'F') AS ready FROM orders GROUP BY 1""")
def status_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    counts = [op.count_if(status == s).alias(name) for s, name in (("P", "pending"), ("O", "processing"), ("F", "ready"))]
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("owner")).agg(F.count(F.lit(1)).alias("total"), *counts)


@query("SELECT event_type || '/' || CASE WHEN value > 50 THEN 'retried' ELSE 'pending' END AS stage_status, count(*) AS n FROM events GROUP BY 1")
def dlq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("value") > 50, "retried").otherwise("pending")
    return table(spark, sf_dir, "events").groupBy(F.concat_ws("/", "event_type", status).alias("stage_status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(min(o_orderkey), 0) AS min_id, count(*) AS n FROM orders WHERE o_orderstatus = 'missing'")
def min_id_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'missing'").agg(F.coalesce(F.min("o_orderkey"), F.lit(0)).alias("min_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keyset_page(table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), "o_orderkey", 100, 50).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 100")
def newest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.newest_page(table(spark, sf_dir, "orders"), "o_orderkey", 100).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 25 OFFSET 50")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.newest_page(table(spark, sf_dir, "events"), "event_id", 25, 50).select("event_id", "event_type")


@query("SELECT md5(lower(text)) AS key, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower("text")).alias("key"))
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000007') OR lower(trim(c_mktsegment)) = 'building'")
def case_insensitive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.lower("c_name") == F.lower(F.lit("CUSTOMER#000000007"))) | (F.lower(F.trim("c_mktsegment")) == "building")
    return table(spark, sf_dir, "customer").filter(hit).select("c_custkey", "c_name")


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_custkey = 7) AS found")
def status_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter("o_custkey = 7").limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE 'part%' AND p_type ILIKE '%steel%'")
def prefix_and_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.col("p_name").ilike("part%") & F.col("p_type").ilike("%steel%")).select("p_partkey", "p_name", "p_type")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (1, 2, 3, 5, 8, 13, 21) AND NOT o_orderstatus IN ('F')")
def in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("o_orderkey").isin(1, 2, 3, 5, 8, 13, 21) & ~F.col("o_orderstatus").isin("F")
    return table(spark, sf_dir, "orders").filter(hit).select("o_orderkey", "o_orderpriority")


@query("""SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20'
  AND value > 10 ORDER BY event_id DESC LIMIT 100""")
def audit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = {"event_type": "error", "start": "2024-01-05", "end": "2024-01-20", "least": 10, "user": None}
    ts = F.col("ts")
    hit = op.all_of(
        F.col("event_type") == wanted["event_type"],
        ts >= F.to_timestamp_ntz(F.lit(wanted["start"])),
        ts < F.to_timestamp_ntz(F.lit(wanted["end"])),
        F.col("value") > wanted["least"],
        None if wanted["user"] is None else F.col("user_id") == wanted["user"],
    )
    return op.newest_page(table(spark, sf_dir, "events").filter(hit), "event_id", 100).select("event_id", "user_id", "event_type")


@query("SELECT count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'")
def audit_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = (F.to_timestamp_ntz(F.lit(d)) for d in ("2024-01-10", "2024-01-12"))
    return table(spark, sf_dir, "events").filter(F.col("ts").between(low, high)).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 25 MINUTE")
def relative_time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(now)).filter("ts > now - INTERVAL 25 MINUTES").select("event_id", "ts")


_SPLIT = "coalesce(o_orderkey, 0) % 3"


@query("""WITH old AS (SELECT o_orderkey % 500 AS id FROM orders WHERE o_orderkey % 3 = 0),
  new AS (SELECT o_orderkey % 1000 AS id, o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 1)
  SELECT id, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS k FROM new WHERE id NOT IN (SELECT id FROM old)) WHERE k = 1""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    old = orders.filter("o_orderkey % 3 = 0").select((F.col("o_orderkey") % 500).alias("id"))
    new = orders.filter("o_orderkey % 3 = 1").select((F.col("o_orderkey") % 1000).alias("id"), "o_orderkey", "o_totalprice")
    return op.insert_or_ignore(old, new, "id", F.col("o_orderkey"))


@query("""WITH new AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 4 = 0)
  SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = old.filter("c_custkey % 4 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return op.upsert(old, new, "c_custkey")


@query("""WITH old AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0),
  new AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' END AS c_name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 1)
  SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.segment, o.segment) AS segment FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey""")
def upsert_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer")
    old = base.filter("c_custkey % 5 <> 0").selectExpr("c_custkey", "c_name", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment")
    new = base.filter("c_custkey % 3 <> 1").selectExpr("c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN c_name || '!' END AS c_name", "c_mktsegment AS segment")
    return op.upsert_fill(old, new, "c_custkey")


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT d.doc_id, md5(CAST(d.doc_id AS VARCHAR)) AS chunk_id FROM documents d
  WHERE md5(CAST(d.doc_id AS VARCHAR)) IN (SELECT md5(CAST(doc_id AS VARCHAR)) FROM labels)""")
def semi_join_existing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with dashes (8-4-4-4-12) on one side, without on the other."""
    plain = F.md5(F.col("doc_id").cast("string"))
    dashed = F.regexp_replace(plain, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    held = table(spark, sf_dir, "labels").select(F.regexp_replace(dashed, "-", "").alias("chunk_id"))
    return table(spark, sf_dir, "documents").select("doc_id", plain.alias("chunk_id")).join(held, "chunk_id", "left_semi").select("doc_id", "chunk_id")


@query("""SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'label:' || l.quality END, CASE WHEN d.lang <> 'en' THEN 'lang:' || d.lang END, 'doc:' || d.doc_id) AS reference
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_join_reference_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    first = F.when(F.col("quality") == 1, F.concat(F.lit("label:"), F.col("quality").cast("string")))
    second = F.when(F.col("lang") != "en", F.concat(F.lit("lang:"), "lang"))
    return joined.select("doc_id", F.coalesce(first, second, F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("reference"))


@query("""SELECT 'missing' AS side, o_custkey AS id FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT 'surplus', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def disk_vs_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct()
    held = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    tag = lambda df, side: df.select(F.lit(side).alias("side"), "id")
    return tag(asked.join(held, "id", "left_anti"), "missing").unionByName(tag(held.join(asked, "id", "left_anti"), "surplus"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'retried' ELSE o_orderstatus END AS status FROM orders")
def dlq_status_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("hit")).distinct()
    joined = table(spark, sf_dir, "orders").join(returned, "o_orderkey", "left")
    return joined.select("o_orderkey", F.when(F.col("hit"), "retried").otherwise(F.col("o_orderstatus")).alias("status"))


@query("SELECT doc_id, source FROM documents WHERE NOT (source = 'src3' AND doc_id % 3 = 0)")
def owner_guarded_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.delete_where(table(spark, sf_dir, "documents"), (F.col("source") == "src3") & (F.col("doc_id") % 3 == 0)).select("doc_id", "source")


@query("""SELECT count(*) AS total, count(*) FILTER (json_extract_string(props, '$.k') IS NULL OR json_extract_string(props, '$.k') = '') AS no_key,
  count(*) FILTER (value IS NULL OR value < 5) AS no_value, round(100.0 * count(*) FILTER (value IS NULL OR value < 5) / count(*), 1) AS no_value_pct FROM events""")
def metadata_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))
    missing = F.col("value").isNull() | (F.col("value") < 5)
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("total"), op.count_if(key == "").alias("no_key"), op.count_if(missing).alias("no_value"), F.round(op.count_if(missing) * 100.0 / F.count(F.lit(1)), 1).alias("no_value_pct")
    )


@query("""WITH d AS (SELECT source, doc_id IN (SELECT doc_id FROM labels) AS has FROM documents),
  s AS (SELECT source, bool_or(has) AS yes_, bool_or(NOT has) AS no_ FROM d GROUP BY 1)
  SELECT (SELECT count(*) FROM d WHERE has) AS with_ref, (SELECT count(*) FROM d WHERE NOT has) AS without_ref, count(*) FILTER (yes_) AS sources_with,
  count(*) FILTER (no_) AS sources_without, count(*) FILTER (yes_ AND no_) AS mixed FROM s""")
def apa_mixed_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")).distinct()
    docs = table(spark, sf_dir, "documents").join(known, "doc_id", "left").select("source", F.coalesce("has", F.lit(0)).alias("has"))
    by_source = docs.groupBy("source").agg(F.sum("has").alias("yes"), F.sum(1 - F.col("has")).alias("no"))
    return by_source.agg(
        F.sum("yes").cast("long").alias("with_ref"), F.sum("no").cast("long").alias("without_ref"), op.count_if(F.col("yes") > 0).alias("sources_with"),
        op.count_if(F.col("no") > 0).alias("sources_without"), op.count_if((F.col("yes") > 0) & (F.col("no") > 0)).alias("mixed"),
    )


@query("""SELECT CAST(extract(year FROM o_orderdate) AS BIGINT) AS year, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS embedded,
  round((1 - count(*) FILTER (o_orderstatus = 'F') / greatest(count(*), 1)::DOUBLE) * 100, 1) AS gap_pct FROM orders GROUP BY 1""")
def coverage_drilldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year"))
    done = op.count_if(F.col("o_orderstatus") == "F")
    return orders.agg(F.count(F.lit(1)).alias("total"), done.alias("embedded"), F.round((1 - done / F.greatest(F.count(F.lit(1)), F.lit(1))) * 100, 1).alias("gap_pct"))


@query("""SELECT count(*) AS total, count(*) FILTER (value >= 50) AS positive, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (value >= 50) / count(*)::DOUBLE END, 6) AS rate
  FROM events WHERE event_type = 'purchase'""")
def feedback_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, n = op.count_if(F.col("value") >= 50), F.count(F.lit(1))
    return table(spark, sf_dir, "events").filter("event_type = 'purchase'").agg(n.alias("total"), good.alias("positive"), F.round(op.share(good, n), 6).alias("rate"))


@query("""WITH a AS (SELECT count(*) AS n FROM documents), b AS (SELECT count(*) AS n FROM embeddings)
  SELECT a.n AS total, b.n AS indexed, round(CASE WHEN a.n = 0 THEN 1.0 ELSE b.n / a.n::DOUBLE END, 6) AS completeness, round(abs(a.n - b.n) / greatest(a.n, 1)::DOUBLE, 6) AS drift,
  abs(a.n - b.n) / greatest(a.n, 1)::DOUBLE > 0.05 AS stale FROM a, b""")
def index_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t, name: table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias(name))
    drift = F.abs(F.col("total") - F.col("indexed")) / F.greatest("total", F.lit(1))
    one_row_each = n("documents", "total").join(F.broadcast(n("embeddings", "indexed")))
    return one_row_each.select("total", "indexed", F.round(op.share(F.col("indexed"), F.col("total"), 1.0), 6).alias("completeness"), F.round(drift, 6).alias("drift"), (drift > 0.05).alias("stale"))


@query("SELECT source, lang, grouping_id(source, lang) AS level, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def rollup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents INTERSECT SELECT vec_id FROM embeddings")
def id_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").intersect(table(spark, sf_dir, "embeddings").select("vec_id"))


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY coalesce(o_totalprice, 0) DESC, o_orderdate DESC, o_orderkey LIMIT 200")
def discovery_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.coalesce("o_totalprice", F.lit(0.0)).desc(), F.desc("o_orderdate"), F.col("o_orderkey")]
    return table(spark, sf_dir, "orders").orderBy(*order).limit(200).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("""SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'other' END AS kind FROM orders""")
def vocabulary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.create_map(*[F.lit(x) for x in ("1-URGENT", "urgent", "2-HIGH", "high")])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(F.try_element_at(terms, F.col("o_orderpriority")), F.lit("other")).alias("kind"))


@query("""SELECT l_suppkey, sum(l_quantity) AS cited, CAST(ceil(sum(l_quantity) / (sum(sum(l_quantity)) OVER ()) * 500) AS BIGINT) AS scaled FROM lineitem GROUP BY 1""")
def scale_up_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("cited"))
    total = by.agg(F.sum("cited").alias("total"))
    return by.join(F.broadcast(total)).select("l_suppkey", "cited", F.ceil(F.col("cited") / F.col("total") * 500).cast("long").alias("scaled"))


@query("""SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status, o_orderkey FROM orders WHERE CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE o_orderstatus END IN ('', 'P')""")
def blank_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END AS status", "o_orderkey")
    return rows.filter(op.blank("status") | (F.col("status") == "P"))
