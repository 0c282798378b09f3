import math
import random
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium import session
from scriptorium.llm import kneser_ney as kn
from scriptorium.llm import tokens


class Plain:
    """The same model, a word at a time, from dictionaries."""

    def __init__(self, trusted, rejected, whole=None):
        lists = [kn.words_of(t) for t in trusted]
        self.n = Counter(w for words in lists for w in set(words))
        self.r = Counter(w for t in rejected for w in set(kn.words_of(t)))
        lists = [[kn.BEGIN, *words, kn.END] for words in lists if words]
        self.pairs = Counter(p for words in lists for p in zip(words, words[1:]))
        self.t = Counter(w for words in lists for w in words)
        kept = (whole or self).pairs
        self.kept = {p: n for p, n in self.pairs.items() if kept[p] >= 2}
        self.c = Counter(w for _, w in self.pairs)
        self.d2 = kn.discounts(*(sum(v == j for v in self.pairs.values()) for j in (1, 2, 3, 4)))
        self.left = Counter()
        for (v, _), n in self.kept.items():
            self.left[v] += n - self.d2[min(n, 3) - 1]
        before = {}
        for t in rejected:
            words = kn.words_of(t)
            for a, b in zip(words, words[1:]):
                before.setdefault(b, set()).add(kn.word_hash(a.encode()) & 63)
        self.contexts = {w: len(x) for w, x in before.items()}

    def spell(self, types):
        self.level = {3: Counter()}
        for w in types:
            b = b"  " + w.encode() + b" "
            self.level[3].update(b[i : i + 3] for i in range(len(b) - 2))
        for k in (2, 1):
            self.level[k] = Counter(x[1:] for x in self.level[k + 1])
        self.cache, self.behind = {}, {}
        for own in self.level.values():
            for x, v in own.items():
                self.behind.setdefault(x[:-1], {})[x] = v
        self.d = {k: kn.discounts(*(sum(v == j for v in own.values()) for j in (1, 2, 3, 4))) for k, own in self.level.items()}
        return self

    def spelled(self, w):
        if w not in self.cache:
            self.cache[w] = self.spelled_out(w)
        return self.cache[w]

    def spelled_out(self, w):
        b, out = b"  " + w.encode() + b" ", 0.0
        for i in range(2, len(b)):
            p = 1 / 256
            for k in (1, 2, 3):
                x = b[i - k + 1 : i + 1]
                same = self.behind.get(x[:-1])
                if same:
                    v = same.get(x, 0)
                    off = lambda n: self.d[k][min(n, 3) - 1]
                    p = ((v - off(v) if v else 0) + sum(map(off, same.values())) * p) / sum(same.values())
            out -= math.log2(p)
        return out

    def bits(self, v, w, speller):
        if not hasattr(self, "whole"):
            self.whole = self.mass()
        d, total, back = self.whole
        c, n, t = self.c[w], self.kept.get((v, w), 0), self.t[v]
        p = ((c - d[min(c, 3) - 1] if c else 0) / total if total else 0) + back * 2 ** -speller.spelled(w)
        return -math.log2(((n - self.d2[min(n, 3) - 1]) / t if n else 0) + (1 - self.left[v] / t if t else 1) * p)

    def mass(self):
        d = kn.discounts(*(sum(v == j for v in self.c.values()) for j in (1, 2, 3, 4)))
        total = sum(self.c.values())
        return d, total, sum(d[min(x, 3) - 1] for x in self.c.values()) / total if total else 1.0

    def evidence(self, w):
        r, t, share = self.r[w], self.n[w], sum(self.r.values()) / (sum(self.r.values()) + sum(self.n.values()))
        share = (1 + share) / 2
        if not r or r <= share * (r + t):
            return 0.0
        g = r * math.log2(r / (r + t) / share) + (t * math.log2(t / (r + t) / (1 - share)) if t else 0)
        return g * min(1, 64 * math.log(64 / max(64 - self.contexts.get(w, 0), 0.5)) / r)

    def scores(self, text, speller):
        words = kn.words_of(text or "")
        if not words:
            return None, 0.0
        around = [kn.BEGIN, *words, kn.END]
        return 2 ** (sum(self.bits(v, w, speller) for v, w in zip(around, around[1:])) / len(text.encode())), max(map(self.evidence, words))


@pytest.mark.parametrize("hot,bits", [(300_000, 26), (3, 26), (3, 18)])
def test_matches_a_plain_model(spark, docs, hot, bits, monkeypatch):
    monkeypatch.setattr(kn, "HOT", hot)  # 3: nearly all words and bigrams go through the shards
    monkeypatch.setattr(kn, "HOT_PAIRS", hot)
    monkeypatch.setattr(kn, "PAIR_BITS", bits)
    docs = docs.filter("doc_id is null or doc_id not in (9, 12)").withColumn("perplexity", F.lit("clash")).withColumn("key", F.lit(1))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bad = {4, 13, 15}
    labels = spark.createDataFrame([(i, int(i not in bad), int(i == 15), "x") for i, _ in rows if i not in (8, None)] + [(1, 1, 0, "again")], "doc_id long, quality int, toxic int, lang string")
    trusted = [t or "" for i, t in rows if i not in bad | {8, None}]
    half = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).collect()}
    rejected = [t for i, t in rows if i in bad]
    full = Plain(trusted, rejected)
    full.spell(full.n)
    halves = [Plain([t or "" for i, t in rows if i not in bad | {8, None} and half[i] == k], rejected, full) for k in (0, 1)]
    got = kn.classify(docs, labels).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    held = [halves[1 - half[i]].scores(t, full) for i, t in rows if i not in bad | {8, None} and t and t.split()]
    for r in got:
        p, w = full.scores(texts[r.doc_id], full)
        assert (r.perplexity is None) == (p is None) and (p is None or r.perplexity == pytest.approx(p, rel=1e-5)) and r.worst == pytest.approx(w, abs=1e-4)
        assert r.threshold >= max(x for x, _ in held) * (1 - 1e-5) or r.lang == "en"
        assert r.kept == (p is not None and r.perplexity <= r.threshold and r.worst <= r.worst_threshold)
    assert max(r.threshold for r in got) == pytest.approx(max(x for x, _ in held), rel=1e-5)


def test_word_order_counts(spark):
    r = random.Random(4)
    pairs = [(f"left{k}", f"right{k}") for k in range(30)]
    fixed = [" ".join(w for p in r.sample(pairs, 12) for w in p) for _ in range(60)]
    shuffled = []
    for t in fixed:
        words = t.split()
        shuffled.append(" ".join([words[0], *r.sample(words[1:], len(words) - 1)]))
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*fixed, *shuffled])], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    p = {x.doc_id: x.perplexity for x in kn.classify(docs, labels).collect()}
    assert all(p[60 + k] > 1.2 * p[k] for k in range(60))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d".split()), min_size=1, max_size=6), min_size=1, max_size=8))
def test_bigrams_sum_to_one(texts):
    plain = Plain([" ".join(t) for t in texts], [])
    plain.spell(plain.n)
    spelled = sum(2 ** -plain.spelled(w) for w in [*plain.c])
    d, total, back = (plain.bits("a", "a", plain), plain.whole)[1]
    for v in plain.t:
        seen = sum(2 ** -plain.bits(v, w, plain) for w in plain.c)
        left = 1 - plain.left[v] / plain.t[v]
        assert seen == pytest.approx(1 - left * back * (1 - spelled), abs=1e-9)


def test_without_trusted_and_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kn.classify(no_docs, none).count() == 0
    got = kn.classify(docs, none).collect()
    assert len(got) == docs.count() and {r.doc_id for r in got if not r.kept} == {5, 6, 10}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abé", min_size=1, max_size=6), min_size=1, max_size=30))
def test_spelling_sums_to_one(words):
    grams = kn.trigrams([w.encode() for w in words])[0]
    own, n = np.unique(grams, return_counts=True)
    p = 2.0 ** -kn.Spelling(own, n).bits_of.reshape(-1, 256).astype(float)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-3)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    p = kn.classify(docs, labels.filter("doc_id % 2 = 0")).toPandas().merge(labels.filter("doc_id % 2 = 1").toPandas(), on="doc_id")
    good, junk, toxic = p[(p.quality == 1) & (p.toxic == 0)], p[(p.quality == 0) & (p.toxic == 0)], p[(p.quality == 1) & (p.toxic == 1)]
    kept = good.kept.mean(), junk.kept.mean(), toxic.kept.mean()
    assert kept[0] > 0.97 and kept[1] < 0.3 and kept[2] < 0.15, kept


def test_counting_frees_tokenisers_and_stays_small():
    """A counting task of a worker that holds tokenisers of an earlier stage frees them, and holds few times its two million words."""

    class Taken:
        def filter(self, *_):
            return self

        select = groupBy = applyInPandas = filter

        def mapInPandas(self, run, _):
            self.run = run
            return self

    taken, r = Taken(), random.Random(2)
    kn.count_pairs(taken)
    words = [f"w{k}" for k in range(50_000)]
    batch = pd.DataFrame({"text": [" ".join(r.choices(words, k=1000)) for _ in range(1000)] * 2, "kind": 0})
    tokens._LOADED[object, None] = object()
    tracemalloc.start()
    assert sum(len(x) for x in taken.run(iter([batch]))) and not tokens._LOADED
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 175e6, peak


def test_entries_and_counts_pack_and_unpack():
    r = np.random.default_rng(3)
    own = np.zeros(5000, dtype=kn._ENTRY)
    own["word"] = np.sort(r.integers(-(1 << 63), (1 << 63) - 1, 2000))[np.sort(r.integers(0, 2000, 5000))] // 51 * 51 + 7
    own["n"], own["doc"] = r.integers(1, 65536, 5000), r.integers(0, 65536, 5000)
    packed = kn.pack_entries(own, 51)
    assert (kn.unpack_entries(packed, 7, 51) == own).all()


def test_tables_on_disk_stay_below_the_input(spark, monkeypatch):
    """No table of the scan is written, and the model's tables are gone as soon as nothing reads them."""
    live, most = {}, [0]

    def size(path):
        return sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet"))

    def cut(df, label):
        back = session.cut(df, label)
        live[back._cut_path] = label
        most[0] = max(most[0], sum(map(size, live)))
        return back

    monkeypatch.setattr(kn, "cut", cut)
    sf = "/root/testdata/sf0.1"
    kn.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert most[0] < 1.1 * Path(f"{sf}/documents.parquet").stat().st_size, most
    assert {label for path, label in live.items() if size(path)} == {"labelled", "kn_scores"}
