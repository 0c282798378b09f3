"""Streams over ``events`` whose results equal a batch query."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.catalog import query
from scriptorium.session import ship_code, table
from scriptorium.streaming import breaker, timers
from scriptorium.streaming.windows import drain, event_stream, local_time


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return local_time(drain(agg.select(F.col("w.start").alias("day"), "event_type", "n", "total"), "complete"), "day")


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts)]) AS s FROM events) GROUP BY 1, 2""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.window("ts", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return local_time(drain(agg.select(F.col("w.start").alias("start"), "event_type", "n"), "complete"), "start")


@query("""WITH o AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR, true)::INT AS fresh FROM events),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS stop, count(*) AS n FROM i GROUP BY user_id, k""")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    agg = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return local_time(drain(agg.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n"), "complete"), "start", "stop")


@query("SELECT event_type, user_id FROM events GROUP BY ALL")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = event_stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["event_type", "user_id"])
    return drain(stream.select("event_type", "user_id"))


@query("""SELECT event_id, CASE WHEN value > 95 THEN 'dead_letter' ELSE 'stored' END AS sink, CASE WHEN value > 95 THEN 'value out of range' END AS error FROM events""")
def stream_dlq_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail a check carry an error and go to the quarantine, the others to the store."""
    bad = F.col("value") > 95
    stream = event_stream(spark, sf_dir).select("event_id", F.when(bad, "dead_letter").otherwise("stored").alias("sink"), F.when(bad, "value out of range").alias("error"))
    return drain(stream)


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def stream_running_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(event_stream(spark, sf_dir).groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n")), "complete")


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') >= 5 AS open FROM events GROUP BY 1""")
def stream_circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State a user: calls and failures so far; five failures open the breaker."""
    ship_code(spark)

    def step(key, batches, state):
        n, errors = state.get if state.exists else (0, 0)
        for batch in batches:
            n, errors = n + len(batch), errors + int((batch["event_type"] == "error").sum())
        state.update((n, errors))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "errors": [errors], "open": [errors >= 5]})

    stream = event_stream(spark, sf_dir).select("user_id", "event_type").groupBy("user_id")
    out = stream.applyInPandasWithState(step, "user_id long, n long, errors long, open boolean", "n long, errors long", "update", "NoTimeout")
    rows = drain(out, "update")
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max("errors").alias("errors"), F.max("open").alias("open"))


@query(None)
def stream_breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed, open or half open after each event of a user: two errors open, half a day later a trial, quiet for six hours closes."""
    stream = event_stream(spark, sf_dir)
    return drain(breaker.states(stream, "user_id", "event_id", "ts", F.col("event_type") == "error", threshold=2, reset=43_200.0, stable=21_600.0))


@query("""SELECT o.o_orderkey, l.l_linenumber, l.l_quantity FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND l.l_shipdate BETWEEN o.o_orderdate AND o.o_orderdate + INTERVAL 60 DAY""")
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined by key within an event-time interval."""
    orders = event_stream(spark, sf_dir, "orders").withColumn("o_ts", F.col("o_orderdate").cast("timestamp")).withWatermark("o_ts", "1 day").select("o_orderkey", "o_ts")
    lines = event_stream(spark, sf_dir, "lineitem").withColumn("l_ts", F.col("l_shipdate").cast("timestamp")).withWatermark("l_ts", "1 day").select("l_orderkey", "l_linenumber", "l_quantity", "l_ts")
    hit = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_ts") >= F.col("o_ts")) & (F.col("l_ts") <= F.expr("o_ts + INTERVAL 60 DAYS"))
    return drain(orders.join(lines, hit).select("o_orderkey", "l_linenumber", "l_quantity"))


_PASSED = """p AS (SELECT max(epoch_us(ts) // 1000) - 86400000 AS w FROM events), """


@query(f"""WITH RECURSIVE {_PASSED} e AS (
    SELECT user_id, epoch_us(ts) // 1000 AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events, p WHERE epoch_us(ts) // 1000 <= w
  ), r AS (
    SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::BIGINT AS t, 'CLOSED' AS ripe, 'CLOSED' AS state, 'CLOSED' AS was, 0 AS failures, -(1::BIGINT << 60) AS opened, -(1::BIGINT << 60) AS was_opened, -(1::BIGINT << 60) AS last FROM e
    UNION ALL
    SELECT user_id, rn, t, ripe, state, was, CASE WHEN ripe = 'OPEN' THEN failures WHEN failed THEN failures + 1 WHEN t - last >= 21600000 THEN 0 ELSE failures END,
      CASE WHEN ripe <> 'OPEN' AND state = 'OPEN' THEN t ELSE opened END, opened, CASE WHEN ripe <> 'OPEN' AND failed THEN t ELSE last END
    FROM (SELECT *, CASE WHEN ripe = 'OPEN' THEN 'OPEN' WHEN failed AND failures + 1 >= 2 THEN 'OPEN' WHEN NOT failed AND t - last >= 21600000 THEN 'CLOSED' ELSE ripe END AS state
      FROM (SELECT e.user_id, e.rn, e.t, e.failed, CASE WHEN r.state = 'OPEN' AND e.t > r.opened + 43200000 THEN 'HALF_OPEN' ELSE r.state END AS ripe, r.state AS was, r.failures, r.opened, r.last FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
  )
  SELECT user_id, t AS at_ms, state FROM r WHERE state <> ripe UNION ALL SELECT user_id, was_opened + 43200001, 'HALF_OPEN' FROM r WHERE ripe <> was
  UNION ALL SELECT user_id, opened + 43200001, 'HALF_OPEN' FROM (SELECT *, max(rn) OVER (PARTITION BY user_id) AS last_rn FROM r), p WHERE rn = last_rn AND state = 'OPEN' AND w > opened + 43200000""")
def breaker_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of each user's breaker, by timers: half open half a day after it opened even if nothing comes."""
    stream = event_stream(spark, sf_dir)
    made = timers.breaker_changes(stream, "user_id", "event_id", "ts", F.col("event_type") == "error", threshold=2, reset=43_200_000, stable=21_600_000, delay="1 day")
    return drain(made.withColumnsRenamed({"key": "user_id", "at": "at_ms"}))


@query(f"""WITH RECURSIVE {_PASSED} e AS (
    SELECT user_id % 8 AS lane, event_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events, p WHERE epoch_us(ts) // 1000 <= w
  ), r AS (
    SELECT DISTINCT lane, 0::BIGINT AS rn, 0::BIGINT AS number, 0::BIGINT AS n, 0::BIGINT AS first, 0::BIGINT AS low, 0::BIGINT AS high, [NULL::STRUCT(number BIGINT, n BIGINT, first BIGINT, t BIGINT, cause VARCHAR, low BIGINT, high BIGINT)] AS out FROM e
    UNION ALL
    SELECT lane, rn, number + (n = 32)::BIGINT, CASE WHEN n = 32 THEN 0 ELSE n END, first, low, high, [late, CASE WHEN n = 32 THEN struct_pack(number := number, n := n, first := first, t := t, cause := 'size', low := low, high := high) END]
    FROM (SELECT e.lane, e.rn, e.t, r.number + late::BIGINT AS number, CASE WHEN r.n = 0 OR late THEN 1 ELSE r.n + 1 END AS n, CASE WHEN r.n = 0 OR late THEN e.t ELSE r.first END AS first,
        CASE WHEN r.n = 0 OR late THEN e.event_id ELSE least(r.low, e.event_id) END AS low, CASE WHEN r.n = 0 OR late THEN e.event_id ELSE greatest(r.high, e.event_id) END AS high,
        CASE WHEN late THEN struct_pack(number := r.number, n := r.n, first := r.first, t := r.first + 21600000, cause := 'wait', low := r.low, high := r.high) END AS late
      FROM (SELECT r.*, e AS e, r.n > 0 AND e.t > r.first + 21600000 AS late FROM r JOIN e ON e.lane = r.lane AND e.rn = r.rn + 1) r)
  ), o AS (
    SELECT lane, unnest(out) AS o FROM r
    UNION ALL SELECT lane, struct_pack(number := number, n := n, first := first, t := first + 21600000, cause := 'wait', low := low, high := high) FROM (SELECT *, max(rn) OVER (PARTITION BY lane) AS last_rn FROM r), p WHERE rn = last_rn AND n > 0 AND w > first + 21600000
  )
  SELECT lane, o.number, o.n, o.first AS first_at, o.t AS left_at, o.cause, o.low, o.high FROM o WHERE o IS NOT NULL""")
def timed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of eight lanes in batches that leave with their 32nd item or six hours after their first."""
    stream = event_stream(spark, sf_dir).withColumn("lane", F.col("user_id") % 8)
    return drain(timers.timed_batches(stream, "lane", "event_id", "ts", size=32, wait=21_600_000, delay="1 day").withColumnRenamed("key", "lane"))
