"""Operational time series over ``events``: rates, buckets, alerts, latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.operators.series import at_shares, placed, with_previous
from scriptorium.operators.tables import count_if
from scriptorium.session import table


def _seconds(col: str = "ts"):
    return F.unix_micros(F.col(col).cast("timestamp")) / 1e6


_RATES = """r AS (SELECT event_type, event_id, value, ts, epoch(ts) - epoch(lag(ts) OVER w) AS dt, value - lag(value) OVER w AS dv FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""


@query(f"WITH {_RATES} SELECT event_id, event_type, round(CASE WHEN dt > 0 THEN dv / dt * 3600 END, 6) AS per_hour FROM r WHERE dt IS NOT NULL")
def throughput_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_previous(table(spark, sf_dir, "events"), ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"], ["ts", "value"])
    rows = rows.withColumn("dt", _seconds() - _seconds("previous.ts")).withColumn("dv", F.col("value") - F.col("previous.value"))
    return rows.filter("dt IS NOT NULL").select("event_id", "event_type", F.round(F.when(F.col("dt") > 0, F.col("dv") / F.col("dt") * 3600), 6).alias("per_hour"))


@query("""WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT event_type, v - lag(v) OVER (PARTITION BY event_type ORDER BY day) AS rate FROM d)
  SELECT event_type, round(avg(rate), 6) AS mean_rate, round(stddev_samp(rate), 6) AS stdev, round(avg(rate) - 1.96 * stddev_samp(rate) / sqrt(count(rate)), 6) AS low, round(avg(rate) + 1.96 * stddev_samp(rate) / sqrt(count(rate)), 6) AS high
  FROM r GROUP BY 1""")
def projection_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    rates = days.withColumn("rate", F.col("v") - F.lag("v").over(Window.partitionBy("event_type").orderBy("day")))
    mean, dev, n = F.avg("rate"), F.stddev_samp("rate"), F.count("rate")
    half = dev * 1.96 / F.sqrt(n)
    return rates.groupBy("event_type").agg(F.round(mean, 6).alias("mean_rate"), F.round(dev, 6).alias("stdev"), F.round(mean - half, 6).alias("low"), F.round(mean + half, 6).alias("high"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events),
  b AS (SELECT *, i // greatest(c // 50, 1) AS bucket FROM n)
  SELECT event_type, bucket, round(avg(value), 6) AS gauge, arg_max(event_id, i) AS counter, max(ts) AS ts FROM b GROUP BY 1, 2""")
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 50 points a series: the mean of gauges, the last of counters."""
    rows = placed(table(spark, sf_dir, "events"), ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"])
    size = F.greatest(F.floor(F.col("group_rows") / 50), F.lit(1))
    return rows.withColumn("bucket", F.floor(F.col("place") / size)).groupBy("event_type", "bucket").agg(F.round(F.avg("value"), 6).alias("gauge"), F.max_by("event_id", "place").alias("counter"), F.max("ts").alias("ts"))


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)
  SELECT event_type, v[CAST(floor(len(v) * 0.5) AS INT) + 1] AS p50, v[least(CAST(floor(len(v) * 0.95) AS INT), len(v) - 1) + 1] AS p95, v[least(CAST(floor(len(v) * 0.99) AS INT), len(v) - 1) + 1] AS p99, round(list_avg(v), 6) AS mean FROM s""")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by index into the sorted values: counts of blocks say which block holds one."""
    events = table(spark, sf_dir, "events")
    at = at_shares(events, "event_type", "value", [0.5, 0.95, 0.99], 1.0).select("event_type", *[F.get("values", F.lit(i)).alias(p) for i, p in enumerate(("p50", "p95", "p99"))])
    return at.join(events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean")), "event_type")


@query("""WITH s AS (SELECT user_id, event_type, sum(value) AS d FROM events GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, event_type) AS k, sum(d) OVER (PARTITION BY user_id) AS total FROM s)
  SELECT user_id, event_type AS span, round(d, 4) AS duration, round(d / total * 100, 4) AS pct FROM t WHERE k = 1""")
def bottleneck_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("d"))
    top = spans.groupBy("user_id").agg(F.min(F.struct((-F.col("d")).alias("d"), "event_type")).alias("top"), F.sum("d").alias("total"))
    return top.select("user_id", F.col("top.event_type").alias("span"), F.round(-F.col("top.d"), 4).alias("duration"), F.round(-F.col("top.d") / F.col("total") * 100, 4).alias("pct"))


@query("""WITH f AS (SELECT event_type, event_id, ts, value > 90 AS firing, lag(value > 90) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before FROM events)
  SELECT event_type, event_id, CASE WHEN firing THEN 'fire' ELSE 'resolve' END AS edge FROM f WHERE firing IS DISTINCT FROM coalesce(before, false)""")
def alert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = table(spark, sf_dir, "events").withColumn("firing", F.col("value") > 90)
    flags = with_previous(flags, ["event_type"], F.date_trunc("hour", "ts"), ["ts", "event_id"], ["firing"])
    flags = flags.withColumn("before", F.coalesce("previous.firing", F.lit(False)))
    return flags.filter("firing <> before").select("event_type", "event_id", F.when(F.col("firing"), "fire").otherwise("resolve").alias("edge"))


@query("""SELECT event_id, user_id, CASE WHEN c10 >= 5 THEN 'halt' WHEN c5 >= 3 THEN 'single' ELSE 'halve' END AS level FROM (
  SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id % 20 ORDER BY ts RANGE BETWEEN INTERVAL 10 HOUR PRECEDING AND CURRENT ROW) AS c10, count(*) OVER (PARTITION BY user_id % 20 ORDER BY ts RANGE BETWEEN INTERVAL 5 HOUR PRECEDING AND CURRENT ROW) AS c5
  FROM events WHERE event_type = 'error')""")
def oom_window_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors in sliding windows decide how far to back off."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    within = lambda hours: F.count(F.lit(1)).over(Window.partitionBy(F.col("user_id") % 20).orderBy(micros).rangeBetween(-hours * 3_600_000_000, 0))
    rows = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("c10", within(10)).withColumn("c5", within(5))
    return rows.select("event_id", "user_id", F.when(F.col("c10") >= 5, "halt").when(F.col("c5") >= 3, "single").otherwise("halve").alias("level"))


@query("""SELECT event_id, user_id, n > 10 AS locked FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 15 DAY PRECEDING AND CURRENT ROW) AS n FROM events)""")
def login_lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(micros).rangeBetween(-15 * 86_400_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.count(F.lit(1)).over(w) > 10).alias("locked"))


@query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def ring_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    return events.join(F.broadcast(newest)).filter("ts >= newest - INTERVAL 7 DAYS").select("event_id", "ts")


@query("""WITH l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
  SELECT user_id, last_ts, k <= 50 AND last_ts >= now - INTERVAL 5 DAY AS kept FROM (SELECT *, row_number() OVER (ORDER BY last_ts DESC, user_id) AS k FROM l), n""")
def lru_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache's content: the 50 last used entries, none older than five days."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    now = last.agg(F.max("last_ts").alias("now"))
    top = last.orderBy(F.desc("last_ts"), "user_id").limit(50).select("user_id", F.lit(True).alias("recent"))
    fresh = F.col("last_ts") >= F.expr("now - INTERVAL 5 DAYS")
    return last.join(top, "user_id", "left").join(F.broadcast(now)).select("user_id", "last_ts", (F.coalesce("recent", F.lit(False)) & fresh).alias("kept"))


@query("""SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // least(10, greatest(3, count(*) OVER (PARTITION BY source) // 6)) AS batch FROM documents""")
def interval_batching(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = placed(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], F.floor(F.col("doc_id") / 4096), ["doc_id"])
    size = F.least(F.lit(10), F.greatest(F.lit(3), F.floor(F.col("group_rows") / 6)))
    return rows.select("source", "doc_id", F.floor(F.col("place") / size).alias("batch"))


@query("""WITH s AS (SELECT user_id, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b, epoch(max(ts)) - epoch(min(ts)) AS dt FROM events GROUP BY 1)
  SELECT user_id, round(CASE WHEN dt > 0 THEN (b - a) / dt * 3600 ELSE 0 END, 6) AS per_hour FROM s""")
def trailing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct("ts", "event_id")
    dt = F.max(_seconds()) - F.min(_seconds())
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.when(dt > 0, (F.max_by("value", key) - F.min_by("value", key)) / dt * 3600).otherwise(0.0), 6).alias("per_hour"))


@query("""WITH h AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1)
  SELECT day, n, bad, round(n / 86400.0, 6) AS per_second, bad / greatest(n, 1)::DOUBLE > 0.20 AS alert FROM h""")
def failure_rate_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("event_type") == "error").alias("bad"))
    return days.select("day", "n", "bad", F.round(F.col("n") / 86400.0, 6).alias("per_second"), (F.col("bad") / F.greatest("n", F.lit(1)) > 0.20).alias("alert"))


@query("SELECT o_orderkey, least(o_custkey % 8, 7) AS attempt, least(2.0 * pow(2, o_custkey % 8), 60.0) AS delay, least(10 * pow(2, o_custkey % 8), 300.0) AS restart FROM orders")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.col("o_custkey") % 8
    delay = lambda base, most: F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return table(spark, sf_dir, "orders").select("o_orderkey", attempt.alias("attempt"), delay(2.0, 60.0).alias("delay"), delay(10.0, 300.0).alias("restart"))


@query("""WITH s AS (SELECT source, count(*) * 1000 AS vectors, 4096 AS dim FROM documents GROUP BY 1), f AS (SELECT *, round(vectors * dim * 4 / 1e9, 3) AS raw_gb, round(vectors * dim / 1e9, 3) AS int8_gb, round(vectors * 2 * 32 * 8 / 1e9, 3) AS graph_gb FROM s)
  SELECT source, raw_gb, int8_gb, graph_gb, round(int8_gb + graph_gb, 3) AS total_gb, CASE WHEN 3.0 > raw_gb + 2 THEN 'LUXURY' WHEN 3.0 > int8_gb + graph_gb + 2 THEN 'BALANCED' WHEN 3.0 > int8_gb + graph_gb THEN 'CONSTRAINED' ELSE 'EXTREME' END AS tier FROM f""")
def hnsw_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory of a graph index over each source, and the tier that fits 3 GB."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg((F.count(F.lit(1)) * 1000).alias("v"))
    gb = lambda per: F.round(F.col("v") * per / 1e9, 3)
    sizes = sizes.select("source", gb(4096 * 4).alias("raw_gb"), gb(4096).alias("int8_gb"), gb(2 * 32 * 8).alias("graph_gb")).withColumn("t", F.col("int8_gb") + F.col("graph_gb"))
    tier = F.when(F.col("raw_gb") + 2 < 3.0, "LUXURY").when(F.col("t") + 2 < 3.0, "BALANCED").when(F.col("t") < 3.0, "CONSTRAINED").otherwise("EXTREME")
    return sizes.select("source", "raw_gb", "int8_gb", "graph_gb", F.round("t", 3).alias("total_gb"), tier.alias("tier"))


@query("""SELECT lang, count(*) AS n, CAST(sum(floor(n_chars / 4)) AS BIGINT) AS tokens, CAST(greatest(500, least(4000, sum(floor(n_chars / 4)) / count(*))) AS BIGINT) AS budget FROM documents GROUP BY 1""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, n = F.sum(F.floor(F.col("n_chars") / 4)), F.count(F.lit(1))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(n.alias("n"), tokens.alias("tokens"), F.round(F.greatest(F.lit(500), F.least(F.lit(4000), tokens / n))).cast("long").alias("budget"))


@query("""SELECT source, max_facts, CAST(floor(max_facts / 2.5) AS BIGINT) + least(10, n // 3) AS max_chunks, CAST(floor((CAST(floor(max_facts / 2.5) AS BIGINT) + least(10, n // 3)) * 1.25) AS BIGINT) AS rerank
  FROM (SELECT source, count(*) AS n, CASE count(*) % 3 WHEN 0 THEN 40 WHEN 1 THEN 80 ELSE 150 END AS max_facts FROM documents GROUP BY 1)""")
def extraction_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    facts = F.when(F.col("n") % 3 == 0, 40).when(F.col("n") % 3 == 1, 80).otherwise(150)
    chunks = F.floor(facts / 2.5) + F.least(F.lit(10), F.floor(F.col("n") / 3))
    return by.select("source", facts.alias("max_facts"), chunks.alias("max_chunks"), F.floor(chunks * 1.25).alias("rerank"))
