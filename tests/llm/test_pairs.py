import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.llm import ngram_join, pq_dedup, rp_forest, substring_dedup
from scriptorium.llm.shingles import shingle_sets
from scriptorium.llm.suffix_array import repeated_starts, suffix_array


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(ids, linked):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            m = min(low[a], low[b])
            if (low[a], low[b]) != (m, m):
                low[a] = low[b] = m
                changed = True
    return low


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    return sets, classes(ids, [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])


def test_jaccard_on_cases(docs, no_docs):
    got = ngram_join.near_duplicates(docs.withColumn("component_id", F.lit(1))).collect()
    assert len(got) == docs.count()
    sets, low = brute_jaccard([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None])
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), low[r.doc_id])
    assert ngram_join.near_duplicates(no_docs).count() == 0


def test_jaccard_near_the_threshold(spark):
    import random

    r, rows = random.Random(5), []
    for g in range(12):
        base = [f"w{g}x{k}" for k in range(r.choice([5, 8, 14, 40, 70, 130, 300]))]
        for _ in range(9):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 30))):
                own[r.randrange(len(own))] = f"e{r.random()}"
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets, low = brute_jaccard(rows)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(df).collect()} == {i: (len(sets[i]), low[i]) for i, _ in rows}


def test_jaccard_on_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    sets, low = brute_jaccard([(r.doc_id, r.text) for r in df.collect()])
    assert all((x.n_shingles, x.component_id) == (len(sets[x.doc_id]), low[x.doc_id]) for x in ngram_join.near_duplicates(df).collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 400), st.integers(0, 120), st.randoms(use_true_random=False))
def test_similar_sets_share_a_key(n, edits, r):
    a = {r.getrandbits(64) for _ in range(n)}
    b = set(a)
    for _ in range(edits):
        if r.random() < 0.5 and b:
            b.remove(next(iter(b)))
        else:
            b.add(r.getrandbits(64))
    if b and 100 * len(a & b) >= 75 * len(a | b):
        x, y = (np.sort(np.array(list(s), dtype=np.uint64)) for s in (a, b))
        assert set(ngram_join.keys(x).tolist()) & set(ngram_join.keys(y).tolist())
        assert ngram_join.hamming(ngram_join.bit_sketch(x), ngram_join.bit_sketch(y)) <= len(a ^ b)


def test_shingle_sets_count_distinct(docs):
    texts = [r.text or "" for r in docs.collect()]
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=30))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=14).map(str.encode), min_size=1, max_size=4))
def test_repeated_starts(segments):
    n = Counter(s[k : k + 3] for s in segments for k in range(len(s) - 2))
    assert [sorted(x) for x in repeated_starts(segments, 3)] == [[k for k in range(len(s) - 2) if n[s[k : k + 3]] > 1] for s in segments]


def brute_repeats(texts):
    n = Counter(t[k : k + 200] for t in texts.values() for k in range(len(t) - 199))
    out = {}
    for i, t in texts.items():
        cover = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - 199):
            if n[t[k : k + 200]] > 1:
                cover[k : k + 200] = True
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        out[i] = (len(t), int(cover.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cover])).hexdigest())
    return out


@pytest.mark.parametrize("limit", [400, 1])
def test_repeats_on_cases(docs, no_docs, limit, monkeypatch):
    monkeypatch.setattr(substring_dedup, "GROUP_STRINGS", limit)  # 1: every unsettled key takes the way for large ones
    df = docs.dropDuplicates(["doc_id"]).withColumn("n_removed", F.lit(0))
    want = brute_repeats({r.doc_id: (r.text or "").encode() for r in df.collect() if r.doc_id is not None})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect() if r.doc_id is not None}
    assert got == want and any(x[1] for x in want.values())
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert substring_dedup.remove_repeats(docs).count() == docs.count()


def test_repeats_on_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute_repeats({r.doc_id: r.text.encode() for r in df.collect()})
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()} == want


def test_repeats_of_repeated_rows(spark, docs):
    want = brute_repeats({r.doc_id: (r.text or "").encode() for r in docs.collect() if r.doc_id is not None})
    twice = docs.union(docs)
    got = [(r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in substring_dedup.remove_repeats(twice).collect() if r.doc_id is not None]
    assert len(got) == 2 * docs.filter("doc_id is not null").count() and all(x == want[i] for i, x in got)
    assert want[9][1:3] == (0, 0)
    one, two = " ".join(map(str, range(200))), "x " + " ".join(map(str, range(500, 700)))  # one document, two texts: the greater is judged
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(1, one), (1, two), (1, None), (2, two[2:])], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.kept_text) for r in rows) == [(1, ""), (1, one), (1, "x "), (2, "")]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i % 5] + rng.normal(size=16) * 0.12).tolist(), int(i % 5 % 3)) for i in range(200)]
    rows += [(2000, base[0].tolist(), 0), (2001, (base[0] * 3).tolist(), 0), (2002, base[0].tolist(), None), (2003, None, 1), (2004, [0.0] * 16, 1), (2005, [float("nan")] * 16, 1), (2006, [None] * 16, 1), (2007, [1.0], 1), (2008, [], 1), (2050, [float("inf")] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("score", F.lit("clash"))


def usable(v):
    return v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)


def test_nearest(vectors):
    rows = {r.vec_id: np.array(r.embedding) for r in vectors.collect() if usable(r.embedding)}
    got = rp_forest.search(vectors, F.col("vec_id") % 50 == 0).toPandas()
    hit = 0
    for q in (i for i in rows if i % 50 == 0):
        score = {i: float((v * rows[q]).sum() / np.linalg.norm(v) / np.linalg.norm(rows[q])) for i, v in rows.items() if i != q}
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(own.vec_id)
        assert own.score.tolist() == pytest.approx([score[i] for i in own.vec_id], abs=1e-12)
        assert own[["score", "vec_id"]].apply(lambda r: (-r.score, r.vec_id), axis=1).is_monotonic_increasing
        hit += len(set(own.vec_id) & set(sorted(score, key=lambda i: (-score[i], i))[:5]))
    assert hit / len(got) >= 0.9 and 2050 not in set(got.query_id)
    assert rp_forest.search(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert rp_forest.search(vectors.filter("vec_id in (0, 3)"), F.col("vec_id") % 50 == 0).count() == 1


def test_vectors_of_rare_lengths_and_large_components(spark, vectors):
    odd = [(3000, [1e200, 2e200], 1), (3001, [2e200, 4e200], 1), (3002, [1e200, -2e200], 1), (3050, [3e-200, 6e-200], 1), (3003, [1.0], 1)]
    rows = vectors.select("vec_id", "embedding", "label").union(spark.createDataFrame(odd, "vec_id long, embedding array<double>, label int"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in pq_dedup.near_duplicates(rows).collect() if r.vec_id >= 3000}
    assert got == {3000: (2, 3000), 3001: (2, 3000), 3050: (2, 3000), 3002: (0, 3002), 3003: (1, 2007)}
    near = [(r.rank, r.vec_id, round(r.score, 9)) for r in rp_forest.search(rows, F.col("vec_id") == 3050).orderBy("rank").collect()]
    assert near == [(1, 3000, 1.0), (2, 3001, 1.0), (3, 3002, -0.6)]


def test_embedding_dedup(vectors):
    rows = {r.vec_id: (np.array(r.embedding, dtype=float), r.label) for r in vectors.collect() if usable(r.embedding) and r.label is not None}
    ids = sorted(rows)
    cos = lambda a, b: float((a * b).sum() / np.linalg.norm(a) / np.linalg.norm(b))
    linked = [(a, b) for a in ids for b in ids if a != b and rows[a][1] == rows[b][1] and cos(rows[a][0], rows[b][0]) >= 0.93]
    low, n = classes(ids, linked), Counter(a for a, _ in linked)
    got = pq_dedup.near_duplicates(vectors).collect()
    assert len(got) == vectors.count() and sum(n.values()) > 1000
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (n[r.vec_id], low.get(r.vec_id, r.vec_id), low.get(r.vec_id, r.vec_id) == r.vec_id)
    assert pq_dedup.near_duplicates(vectors.limit(0)).count() == 0
    assert pq_dedup.near_duplicates(vectors.union(vectors)).count() == 2 * vectors.count()
