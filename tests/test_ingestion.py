import json
import os

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import paged, vector_sink


def put(root, scan, token, body):
    os.makedirs(f"{root}/scan={scan}/token={token}")
    with open(f"{root}/scan={scan}/token={token}/part-0", "w") as f:
        f.write(body if isinstance(body, str) else json.dumps(body))


def cursor_page(ids, then=None):
    return {"meta": {"next_cursor": then}, "results": [{"id": i} for i in ids]}


def test_errors_are_rows(spark, tmp_path):
    put(tmp_path, "a", "%2A", {"meta": {"next_cursor": "n1"}, "results": [{"id": 1}, "text", {"title": "x"}, {"id": None}, {"id": 2}]})
    put(tmp_path, "a", "n1", cursor_page([3], "n2"))
    put(tmp_path, "a", "n2", "<html>busy</html>")
    put(tmp_path, "b", "%2A", {"results": 5})
    put(tmp_path, "c", "%2A", cursor_page([]))
    rows = paged.read_pages(spark, f"file://{tmp_path}", ["a", "b", "c", "absent"]).collect()
    good = [(r.scan, r.token, r.place, json.loads(r.record)["id"]) for r in rows if r.error is None]
    assert sorted(good) == [("a", "*", 0, 1), ("a", "*", 4, 2), ("a", "n1", 0, 3)]
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["entry"] * 3 + ["page"] * 2
    limited = paged.read_pages(spark, f"file://{tmp_path}", ["a"], max_results=2).filter("error is null")
    assert sorted(json.loads(r.record)["id"] for r in limited.collect()) == [1, 2]


def test_offset_pages(spark, tmp_path):
    for at in range(0, 25, 10):
        put(tmp_path, "s", str(at), {"total": 25, "data": [{"id": i} for i in range(at, min(at + 10, 25))]})
    put(tmp_path, "none", "0", {"total": 0, "data": []})
    rows = paged.read_pages(spark, f"file://{tmp_path}", ["s", "none"], "offset")
    assert sorted(json.loads(r.record)["id"] for r in rows.collect()) == list(range(25)) and rows.rdd.getNumPartitions() == 3
    cut = paged.read_pages(spark, f"file://{tmp_path}", ["s"], "offset", max_results=12)
    assert sorted(json.loads(r.record)["id"] for r in cut.collect()) == list(range(12))


def run(stream, out, state):
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    q.processAllAvailable()
    q.stop()


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    root, out, state = f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/state"
    ids = lambda: sorted((json.loads(r.record)["id"], r.scan) for r in spark.read.schema(paged.SCHEMA).parquet(out).collect())
    put(root, "old", "-", {"data": [{"id": i} for i in range(3)]})
    put(root, "old", "2", {"data": [{"id": i} for i in range(3, 6)]})
    put(root, "new", "-", {"data": [{"id": 100}]})
    read = lambda: paged.read_pages(spark, f"file://{root}", ["old", "new"], "keyset", stream=True, pages_per_batch=1, priority="true")
    run(read(), out, state)
    first = [(i, "old") for i in range(6)] + [(100, "new")]
    assert ids() == first
    put(root, "new", "100", {"data": [{"id": 101}, {"id": 102}]})
    put(root, "old", "5", {"data": [{"id": 6}]})
    put(root, "new", "102", {"data": []})
    run(read(), out, state)
    assert ids() == sorted([*first, (6, "old"), (101, "new"), (102, "new")])
    run(read(), out, state)
    assert len(ids()) == 10


def test_a_stream_stopped_between_batches(spark, tmp_path):
    root, out, state = f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/state"
    for k in range(8):
        put(root, "s", "%2A" if k == 0 else f"t{k}", cursor_page([2 * k, 2 * k + 1], f"t{k + 1}" if k < 7 else None))
    read = lambda: paged.read_pages(spark, f"file://{root}", ["s"], "cursor", stream=True, pages_per_batch=1)
    q = read().writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    while q.isActive and len(q.recentProgress) < 2:
        pass
    q.stop()
    run(read(), out, state)
    assert sorted(json.loads(r.record)["id"] for r in spark.read.schema(paged.SCHEMA).parquet(out).collect()) == list(range(16))


def test_requests():
    assert paged.works_filter() == "has_doi:true"
    assert paged.works_filter(["article", "review"], (2001, 2010), True, "2024-05-01") == "publication_year:>2000,publication_year:<2011,is_oa:true,type:article|review,from_updated_date:2024-05-01,has_doi:true"
    assert paged.scholar_request("q", limit=500) == {"query": "q", "limit": "100", "offset": "0"}
    assert paged.scholar_request("q", ["Review", "Book"], (1990, None), True, "2015-03-01", 200) == {"query": "q", "limit": "100", "offset": "200", "year": "2015-2100", "openAccessPdf": "", "publicationTypes": "Review,Book"}
    assert paged.scholar_request("q", updated_since="soon") == {"query": "q", "limit": "100", "offset": "0"}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, embedding array<double>, payload string")


def shown(spark, root):
    return sorted((r.chunk_id, list(r.embedding), r.payload) for r in vector_sink.read_vectors(spark, root).collect())


def test_upsert_last_commit_wins(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    assert shown(spark, root) == []
    vector_sink.upsert(vectors(spark, [(f"c{i}", [float(i), 1.0], "one") for i in range(250)]), root, 2, batch_size=100)
    vector_sink.upsert(vectors(spark, [("c1", [9.0, 9.0], "two"), ("new", [0.0, 0.0], None), ("new", [0.0, 1.0], "both")]), root, 2)
    want = sorted([(f"c{i}", [float(i), 1.0], "one") for i in range(250) if i != 1] + [("c1", [9.0, 9.0], "two"), ("new", [0.0, 1.0], "both")])
    assert shown(spark, root) == want
    vector_sink.compact(spark, root, 2)
    assert shown(spark, root) == want and len(os.listdir(f"{tmp_path}/v/commits")) == 1
    vector_sink.upsert(vectors(spark, []), root, 2)
    assert shown(spark, root) == want


def test_batches_are_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    root = f"{tmp_path}/g"
    vector_sink.upsert(vectors(spark, [(f"c{i}", [float(i), 1.0], "") for i in range(330)]).coalesce(1), f"file://{root}", 2, batch_size=100)
    (f,) = os.listdir(f"{root}/data")
    meta = pq.ParquetFile(f"{root}/data/{f}").metadata
    assert [meta.row_group(k).num_rows for k in range(meta.num_row_groups)] == [100, 100, 100, 30]


def test_a_failed_write_leaves_nothing_visible(spark, tmp_path):
    root = f"file://{tmp_path}/f"
    vector_sink.upsert(vectors(spark, [("a", [1.0, 2.0], "kept")]), root, 2)
    bad = vectors(spark, [(f"c{i}", [1.0, 2.0] if i != 77 else [1.0], "lost") for i in range(200)]).repartition(4)
    with pytest.raises(Exception, match="1 components, not 2"):
        vector_sink.upsert(bad, root, 2)
    assert shown(spark, root) == [("a", [1.0, 2.0], "kept")]
    with open(f"{tmp_path}/f/data/killed.parquet", "wb") as f:
        f.write(b"half a file")  # of an attempt that was killed
    assert shown(spark, root) == [("a", [1.0, 2.0], "kept")]


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    vector_sink.upsert(vectors(spark, [("a", [1.0], "one")]), root, 1, batch_id="x")
    vector_sink.upsert(vectors(spark, [("a", [2.0], "two")]), root, 1, batch_id="y")
    vector_sink.upsert(vectors(spark, [("a", [1.0], "one")]), root, 1, batch_id="x")
    assert shown(spark, root) == [("a", [2.0], "two")] and len(os.listdir(f"{tmp_path}/t/data")) == 2


def test_rejects(spark, tmp_path):
    root, nan, inf = f"file://{tmp_path}/r", float("nan"), float("inf")
    rows = [("ok", [1.0, 2.0], ""), ("null", None, ""), ("short", [1.0], ""), (None, [1.0, 2.0], ""), ("nan", [nan, 1.0], ""), ("inf", [1.0, -inf], ""), ("gap", [None, 1.0], ""), ("empty", [], "")]
    vector_sink.upsert(vectors(spark, rows).coalesce(1), root, 2, invalid="quarantine")
    assert shown(spark, root) == [("ok", [1.0, 2.0], "")]
    got = {r.chunk_id: r.reason for r in vector_sink.read_rejects(spark, root).collect()}
    number = "components that are no numbers"
    assert got == {"null": "no embedding", "short": "1 components, not 2", None: "no id", "nan": number, "inf": number, "gap": number, "empty": "0 components, not 2"}


def test_a_stream_of_vectors_restarted(spark, tmp_path):
    root, src = f"file://{tmp_path}/s", f"{tmp_path}/src"
    rows = lambda lo, hi: vectors(spark, [(f"c{i}", [float(i)], "") for i in range(lo, hi)])
    rows(0, 10).coalesce(1).write.parquet(src)
    for lo, hi in ((10, 20), (20, 25)):
        stream = spark.readStream.schema(rows(0, 1).schema).option("maxFilesPerTrigger", 1).parquet(src)
        vector_sink.upsert_stream(stream, root, 1, f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        rows(lo, hi).coalesce(1).write.mode("append").parquet(src)
    assert [r[0] for r in shown(spark, root)] == sorted(f"c{i}" for i in range(20))
    assert vector_sink.read_vectors(spark, root).agg(F.count_distinct("chunk_id")).first()[0] == 20
