import random
from collections import OrderedDict

from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.operators import question_cache as C
from scriptorium.operators import rounds as R

WORDS = "river stone bridge water road night light paper engine signal frame copper glass forest".split()


def shared_terms(texts, k):
    """A search by the number of key terms in common."""

    def search(asked):
        q = asked.select("query_id", F.explode(F.array_distinct(X.key_terms(F.col("text")))).alias("term"))
        d = texts.select("doc_id", F.explode(F.array_distinct(X.key_terms(F.col("text")))).alias("term"))
        n = q.join(d, "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
        rank = F.expr("row_number() over (partition by query_id order by n desc, doc_id)")
        return n.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)

    return search


def plain_rounds(questions, texts, k, enough):
    """The same as a loop over questions."""
    terms = lambda t: {w for w in (t or "").lower().split() if len(w) >= 3 and w not in X.QUERY_STOP_WORDS}
    hits, log = [], []
    for qid, text, most in questions:
        asked, seen = text or "", {}
        for r in range(1, (most or 0) + 1):
            n = sorted(((-len(terms(asked) & terms(t)), d) for d, t in texts if terms(asked) & terms(t)))[:k]
            new = [(rank, d) for rank, (_, d) in enumerate(n, 1) if d not in seen]
            for rank, d in new:
                seen[d] = len(seen) + 1
                hits.append((qid, d, r, rank, seen[d]))
            gaps = sorted(terms(text) - set().union(*(terms(dict(texts)[d]) for d in seen)) if seen else terms(text))
            following = f"additional evidence for {' '.join(gaps)}" if len(seen) < enough and gaps else None
            decision = "last" if r >= most else "sufficient" if following is None else "follow_up"
            log.append((qid, r, asked, len(new), len(seen), gaps, decision))
            if decision != "follow_up":
                break
            asked = following
    return sorted(hits), sorted(log)


def test_rounds_equal_a_loop(spark):
    r = random.Random(5)
    texts = [(d, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 4)))) for d in range(30)] + [(99, None), (98, "additional evidence")]
    questions = [(q, " ".join(r.choice([*WORDS, "unheard", "unseen", "the"]) for _ in range(r.randint(2, 7))), r.randint(1, 4)) for q in range(25)] + [(50, None, 2), (51, "", 1), (52, "river", 0), (53, "road", None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    follow = lambda t, n, g: R.asks_for_gaps(t, n, g, enough=9)
    hits, log = R.question_rounds(spark.createDataFrame(questions, "query_id long, text string, rounds int"), docs, shared_terms(docs, 3), follow)
    want_hits, want_log = plain_rounds(questions, texts, 3, 9)
    assert sorted((x.query_id, x.doc_id, x["round"], x["rank"], x.number) for x in hits.collect()) == want_hits
    got = sorted((x.query_id, x["round"], x.asked, x.n_new, x.n_sources, x.gaps, x.decision) for x in log.collect())
    assert got == want_log and {x[6] for x in got} == {"last", "sufficient", "follow_up"} and max(x[1] for x in got) > 2


def test_no_questions(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    hits, log = R.question_rounds(spark.createDataFrame([], "query_id long, text string, rounds int"), docs, shared_terms(docs, 3))
    assert hits.count() == log.count() == 0


def plain_facts(chunks, most, sample, batch):
    done = {}
    for q in {q for q, _, _ in chunks}:
        own = [t for p, t in sorted((p, t) for k, p, t in chunks if k == q)]
        read = own[:sample]
        facts = [f for t in read for f in t.split("|") if f]
        density = len(facts) / len(read)
        if len(facts) < most:
            rest = own[sample : sample + int((most - len(facts)) / max(density, 0.5)) + 3]
            for k in range(0, len(rest), batch):
                if len(facts) >= most:
                    break
                read = read + rest[k : k + batch]
                facts += [f for t in rest[k : k + batch] for f in t.split("|") if f]
        done[q] = (density, len(read), list(dict.fromkeys(facts))[:most])
    return done


def test_facts_equal_a_loop(spark):
    r = random.Random(6)
    chunks = [(q, p, "|".join(f"fact {r.randint(0, 40)}" for _ in range(r.randint(0, 3 if q % 2 else 12)))) for q in range(8) for p in range(r.randint(1, 60))]
    write = lambda t: F.filter(F.split(t, r"\|"), lambda x: x != "")
    facts, sums = R.fact_rounds(spark.createDataFrame(chunks, "query_id long, place long, text string"), write, most=25)
    want = plain_facts(chunks, 25, 8, 5)
    got = {}
    for x in sorted(facts.collect(), key=lambda x: (x.query_id, x.place, x["at"])):
        got.setdefault(x.query_id, []).append(x.fact)
    assert {x.query_id: (x.density, x.chunks, got.get(x.query_id, [])) for x in sums.collect()} == want


def plain_cache(asks, size, ttl, threshold):
    cache, out = OrderedDict(), []
    for k, (row, at, text) in enumerate(asks):
        key = text.strip().lower()
        if key in cache and at - cache[key][2] <= ttl:
            cache.move_to_end(key)
            out.append((row, "exact", cache[key][1]))
            continue
        cache.pop(key, None)
        words, best = set(key.split()), None
        for number, of, made, theirs in sorted(cache.values(), key=lambda e: e[0]):
            score = len(words & theirs) / len(words | theirs)
            if at - made <= ttl and score >= threshold and (best is None or score > best[0]):
                best = score, of
        while len(cache) >= size:
            cache.popitem(last=False)
        cache[key] = (k, row, at, words)
        out.append((row, "similar", best[1]) if best else (row, "new", None))
    return out


def test_cache_equals_a_plain_one(spark):
    r = random.Random(7)
    rows, want = [], []
    for session in range(6):
        at, asks = 0, []
        for k in range(150):
            at += r.randint(0, 30)
            words = r.sample("a b c d e f".split(), r.randint(3, 6))
            asks.append((session * 1000 + k, at, r.choice(["", " "]) + " ".join(words).replace("a", r.choice("aA"))))
        rows += [(session, *x) for x in asks]
        want += plain_cache(asks, 7, 100, 0.8)
    rows += [(None, 1, 1, "x"), (1, 5, None, "x"), (1, 6, 2, None), (1, 7, 3, "  ")]
    made = C.cached_questions(spark.createDataFrame(rows, "session long, id long, at long, text string"), 7, 100)
    assert sorted((x.id, x.kind, x.answered_by) for x in made.collect()) == sorted(want)
    assert {k for _, k, _ in want} == {"exact", "similar", "new"}
