import random

import pytest
from pyspark.sql import functions as F

from scriptorium.streaming import timers

EVENT = "row long, key string, ts timestamp, bad boolean"


def feed(spark, folder, rows):
    """One file: (row, key, seconds, bad)."""
    made = spark.createDataFrame([(r, k, float(s), b) for r, k, s, b in rows], "row long, key string, s double, bad boolean")
    made.select("row", "key", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "bad").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, make, out, state):
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(folder)
    q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def breaker(stream):
    return timers.breaker_changes(stream, "key", "row", "ts", F.col("bad"), threshold=2, reset=300_000, stable=60_000, delay="10 seconds")


def batches(stream):
    return timers.timed_batches(stream, "key", "row", "ts", size=3, wait=20_000, delay="10 seconds")


def at(s):
    return int(s * 1000)


def test_half_open_without_an_event(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("src", "out", "state"))
    got = lambda: sorted((r.key, r.at, r.state) for r in run(spark, src, breaker, out, state).collect())
    feed(spark, src, [(1, "a", 100, True), (2, "a", 101, True), (3, "b", 150, False)])
    assert got() == [("a", at(101), "OPEN")]
    feed(spark, src, [(4, "b", 401, False)])  # the clock of others: not yet
    assert got() == [("a", at(101), "OPEN")]
    feed(spark, src, [(5, "b", 500, False)])
    half = [("a", at(101), "OPEN"), ("a", at(401) + 1, "HALF_OPEN")]
    assert got() == half
    feed(spark, src, [(6, "a", 520, True), (7, "b", 600, False)])  # the trial fails
    assert got() == [*half, ("a", at(520), "OPEN")]
    feed(spark, src, [(8, "a", 900, False), (9, "b", 1000, False)])  # the next one doesn't
    assert got() == sorted([*half, ("a", at(520), "OPEN"), ("a", at(820) + 1, "HALF_OPEN"), ("a", at(900), "CLOSED")])


def test_a_batch_leaves_by_size_or_age(spark, tmp_path):
    src, out, state = (f"{tmp_path}/{x}" for x in ("src", "out", "state"))
    got = lambda: sorted((r.key, r.number, r.n, r.first_at, r.left_at, r.cause, r.low, r.high) for r in run(spark, src, batches, out, state).collect())
    feed(spark, src, [(1, "a", 100, False), (2, "a", 105, False), (3, "b", 111, False)])
    assert got() == []
    feed(spark, src, [(4, "b", 145, False)])  # nothing more for a
    aged = [("a", 0, 2, at(100), at(120), "wait", 1, 2), ("b", 0, 1, at(111), at(131), "wait", 3, 3)]
    assert got() == aged
    feed(spark, src, [(5, "a", 150, False), (6, "a", 150, False), (7, "a", 151, False), (8, "a", 152, False), (9, "b", 162, False)])
    full = ("a", 1, 3, at(150), at(151), "size", 5, 7)
    assert got() == sorted([*aged, full])
    feed(spark, src, [(10, "c", 300, False)])
    assert got() == sorted([*aged, full, ("a", 2, 1, at(152), at(172), "wait", 8, 8), ("b", 1, 2, at(145), at(165), "wait", 4, 9)])


@pytest.mark.parametrize("make", [breaker, batches])
def test_files_do_not_matter(spark, tmp_path, make):
    r = random.Random(3)
    rows = [(k, r.choice("abc"), 1000 + 3 * k + r.random() * 2, r.random() < 0.5) for k in range(150)] + [(999, "z", 10_000, False)]
    made = []
    for name, step in (("one", len(rows)), ("many", 40)):
        for k in range(0, len(rows), step):
            feed(spark, f"{tmp_path}/{name}", rows[k : k + step])
        made.append(sorted(map(tuple, run(spark, f"{tmp_path}/{name}", make, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-state").collect())))
    assert made[0] == made[1] and len(made[0]) > 10


def test_processors_in_plain_python():
    b = timers.BreakerTimers(2, 100, 50)
    held, out = b.advance(b.fresh, [(0, 1, True), (1, 2, True), (50, 3, False), (101, 4, False), (102, 5, False)], 102)
    assert out == [(1, "OPEN"), (102, "HALF_OPEN"), (102, "CLOSED")] and held[:2] == ("CLOSED", 0)
    t = timers.BatchTimers(2, 10)
    held, out = t.advance(t.fresh, [(0, 7, False), (10, 3, False), (12, 4, False), (23, 5, False)], 23)
    assert [x[5 - 1] for x in out] == ["size", "wait"] and held[1] == 1 and t.timer(held) == 34
