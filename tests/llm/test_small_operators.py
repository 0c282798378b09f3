import duckdb
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import chat, mixing, queries, sharding, token_counts, tokens


def test_token_counts(docs, no_docs):
    sp = tokens.PieceCounter()
    rows = token_counts.count_tokens(docs).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        n = len(sp._sp.encode(texts[r.doc_id]))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 4096)
    assert token_counts.count_tokens(no_docs).count() == 0


CONV = "conv_id long, turn long, role string, text string, formatted string"


def test_chat_round_trip(spark):
    odd = ["<|end|>\n", "<|user|>\nx", "a␛eb␛|>", "<<|", "|>", "", None, "␛", "<␛|", "|␛>", r"\### Assistant: </turn> ok"]
    rows = [(1, k, "user" if k % 3 else "assistant", t, "clash") for k, t in enumerate(odd)] + [(2, 0, "sys|tem␛p", "x", ""), (3, 0, "a<", "hi", ""), (3, 1, "assistant", "yo", ""), (4, 0, "<|end|>\n<", "<", ""), (4, 1, "␛l>", "", ""), (4, 2, "assistant", "\n<|", ""), (2, 0, "assistant", "y", ""), (2, 0, "assistant", "y", ""), (None, 1, None, "z", "")]
    made = chat.format_chats(spark.createDataFrame(rows, CONV))
    for r in made.select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("t"), F.transform(chat.masked_texts(F.col("formatted"), F.col("mask")), chat.unescape).alias("loss")).collect():
        own = sorted(((t, ro or "", x or "") for c, t, ro, x, _ in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.t] == [x[1:] for x in own] and r.n_turns == len(own)
        assert "".join(r.loss) == "".join(x for _, ro, x in own if ro == "assistant")
    total = made.select("formatted", F.aggregate("mask", F.lit(0).cast("long"), lambda s, x: s + x["chars"]).alias("n")).collect()
    assert all(len(r.formatted) == r.n for r in total)
    assert chat.digests(chat.format_chats(spark.createDataFrame([], CONV))).count() == 0


def test_mix(docs, no_docs):
    p = mixing.mix(docs).toPandas()
    assert len(p) == docs.count() and (p.taken <= 2 * p["size"]).all() and (p.taken % p["size"].clip(lower=1) == 0).all()
    again = mixing.mix(docs.repartition(7)).toPandas()
    order = lambda x: x.sort_values(["doc_id", "size", "taken"]).reset_index(drop=True)[["doc_id", "size", "taken"]]
    assert order(p).equals(order(again))
    by = p.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), most=("size", "max"), taken=("taken", "sum"))
    assert ((by.taken - by.target).abs() <= by.most / 2 + 1e-6).all()
    assert abs(by.target.sum() - min(1.5 * by["size"].sum(), 2 * by["size"].sum())) < 1e-3
    assert (by.target <= 2 * by["size"] + 1e-6).all()
    assert mixing.mix(no_docs).count() == 0


def test_mix_by_a_quality_column(spark):
    rows = [(i, "a", "w " * 10, float(i < 50) if i % 10 else None) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, good double")
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, share=0.4, weight="good").collect()}
    assert sum(taken.values()) == 400 and all(not taken[i] for i in range(50, 100) if i % 10)


def test_shards_of_empty_tables_and_clashing_names(spark, docs, no_docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/e")
    with pytest.raises(ValueError):
        store.read()
    assert [store.append(f) for f in store.write_arrivals(no_docs, 4)] == [1]
    assert store.compact() == 1 and store.read().schema == no_docs.schema and store.read().count() == 0
    other = sharding.ShardStore(spark, f"file://{tmp_path}/c")
    given = docs.withColumn("_arrival", F.lit("own")).withColumn("tier", F.lit(None).cast("int"))
    for folder in other.write_arrivals(given, 3):
        other.append(folder)
    assert sorted(map(str, other.read().collect())) == sorted(map(str, given.collect())) and other.read().columns == given.columns
    again = sharding.ShardStore(spark, f"file://{tmp_path}/c")
    assert again.version() == other.version() and again.read().count() == given.count()


def test_chat_markers_and_line_breaks(spark):
    roles = ["next", "end", "role:x", "a|>b", "assistant", "assistant", "assistant", "x\n", "end", "assistant"]
    texts = ["\n\n", "\n<|end|>\n", "<", "|>", "\nfirst", "\nsecond", "", ">", "<|next|>\n", "\n"]
    rows = [(1, k, r, t, "") for k, (r, t) in enumerate(zip(roles, texts))]
    [r] = chat.format_chats(spark.createDataFrame(rows, CONV)).select(chat.read_turns(F.col("formatted")).alias("t"), F.transform(chat.masked_texts(F.col("formatted"), F.col("mask")), chat.unescape).alias("loss")).collect()
    assert [(t.role, t.text) for t in r.t] == list(zip(roles, texts))
    assert r.loss == ["\nfirst", "\nsecond", "\n"]


def test_chat_of_many_turns(spark):
    import time

    def seconds(n):
        rows = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "'some text' AS text")
        start = time.time()
        [r] = chat.digests(chat.format_chats(rows)).collect()
        assert r.n_turns == n
        return time.time() - start

    seconds(1000)
    assert seconds(20_000) < 20


def test_targets_reshare(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), (None, 100), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got["a"] == 20 and got["c"] == 0 and abs(sum(got.values()) - 1665) < 1e-6 and got[None] == 200 and got["b"] == 1445


def test_shards(spark, docs, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.version() == 0 and store.manifest().count() == 0
    for folder in store.write_arrivals(docs.repartition(3), 4):
        store.append(folder)
    before, shards = store.version(), store.manifest().count()
    after = store.compact()
    assert after == before + 1 and store.manifest().count() < shards
    want = sorted(map(str, docs.collect()))
    clean = lambda df: sorted(map(str, df.select(docs.columns).collect()))
    assert clean(store.read()) == want and clean(store.read(before)) == want
    with pytest.raises(sharding.VersionConflict):
        store._commit(before, store.manifest(), docs.schema)
    assert store.vacuum() == 0 and store.vacuum(grace_seconds=0) == shards and clean(store.read()) == want
    assert store.compact() == after  # nothing is due


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op3_sharding", "op5_embedding_dedup", "op8_source_mixing"])
def test_oracles(spark, sf, name):
    if name == "op3_sharding":
        pytest.skip("one input file makes too few shards for the fixed version")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name]).df()[df.columns]
    key = lambda p: sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in p.itertuples(index=False))
    assert key(df.toPandas()) == key(want)


def test_shards_behind_a_lost_writer(spark, docs, tmp_path):
    root = f"file://{tmp_path}/lost"
    store = sharding.ShardStore(spark, root)
    folders = store.write_arrivals(docs, 2)
    assert store.append(folders[0]) == 1
    store._fs().create(store._path("versions/v000000000002"), False).close()  # a writer died before it wrote
    assert store.version() == 1
    with pytest.raises(sharding.VersionConflict):
        store.append(folders[1])  # it may still be at work
    late = sharding.ShardStore(spark, root, commit_seconds=0)
    assert late.append(folders[1]) == 3 and late.read().count() == docs.count()
    assert late.append(late.write_arrivals(docs, 1)[0]) == 4


def test_shards_of_changing_schemas(spark, tmp_path):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/schemas", fanout=2)
    made = lambda rows, schema: store.append(store.write_arrivals(spark.createDataFrame(rows, schema), 1)[0])
    made([(1, "old")], "doc_id long, text string")
    made([(2,)], "doc_id long")
    made([("x", 3)], "extra string, doc_id long")
    want = [(1, "old", None), (2, None, None), (3, None, "x")]
    assert sorted(map(tuple, store.read().collect())) == want and store.read().columns == ["doc_id", "text", "extra"]
    with pytest.raises(sharding.SchemaConflict):
        made([("4",)], "doc_id string")
    assert store.compact() == 4 and sorted(map(tuple, store.read().collect())) == want
