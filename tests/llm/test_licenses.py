import random
import re

import duckdb

from scriptorium.llm import license_scan, queries
from scriptorium.llm.license_texts import NOTICES, PHRASES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def test_words_are_those_of_the_pattern():
    r = random.Random(1)
    for _ in range(200):
        text = "".join(r.choice("aZ09 _-.\t\n\x00\x7f`{[éßİ  漢") for _ in range(40))
        assert [w.decode() for w in license_scan.words_of(text)] == plain_words(text)


def test_matching_statistics_and_places_by_brute_force():
    r = random.Random(2)
    for _ in range(60):
        sequences = [[r.randrange(3) for _ in range(r.randint(1, 12))] for _ in range(4)]
        a = license_scan.SuffixAutomaton(sequences)
        text = [r.randrange(4) for _ in range(40)]
        for at, (state, length) in enumerate(a.read(text)):
            inside = lambda n: [(k, i + n - 1) for k, s in enumerate(sequences) for i in range(len(s) - n + 1) if s[i : i + n] == text[at - n + 1 : at + 1]]  # noqa: B023, E731
            longest = max((n for n in range(1, at + 2) if inside(n)), default=0)
            assert length == longest
            if longest:
                assert sorted(a.ends_at(state)) == sorted(inside(longest))


def test_phrases_by_brute_force():
    r = random.Random(3)
    s = license_scan.Scanner()
    words = [w for _, p in PHRASES for w in p.split()] + ["the", "software", "zebra", "lesser"]
    for _ in range(200):
        text = [r.choice(words) for _ in range(r.randint(0, 60))]
        n, places, _ = s.scan(" ".join(text))
        want = [(label, i) for label, p in PHRASES for i in range(len(text)) if text[i : i + len(p.split())] == p.split()]
        assert n == len(text) and sorted((s.labels[k], i) for k, i in places) == sorted(want)


def test_spans_of_changed_notices():
    s = license_scan.Scanner()
    r = random.Random(4)
    for k, (label, notice) in enumerate(NOTICES[:8]):
        words = plain_words(notice)
        changed = [*words[:10], "inserted", *words[11:]] if len(words) > 20 else words
        before = [f"x{r.random()}" for _ in range(5)]
        n, _, spans = s.scan(" ".join([*before, "a", *changed, "zzz", *words]))
        mine = [x for x in spans if x[0] == k]
        lead = sum(len(plain_words(w)) for w in before) + 1
        assert [(a, b) for _, a, b, _ in mine] == [(lead, lead + len(changed)), (lead + len(changed) + 1, n)], label
        assert mine[0][3] >= len(words) - 4 and mine[1][3] == len(words)
        half = s.scan(" ".join(words[: len(words) // 2]))[2]
        assert not [x for x in half if x[0] == k]


def test_a_long_text_of_a_few_words():
    s = license_scan.Scanner()
    n, places, spans = s.scan("of the software " * 50_000 + "released under the mit license " * 2000)
    assert n == 160_000 and len(places) == 2000 and len([x for x in spans if s.labels[x[0]] == "mit"]) == 2000


def test_query_and_odd_rows(spark, sf, docs, no_docs):
    rows = queries.op12_license_scan(spark, sf).collect()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    assert len(rows) == len(texts)
    for x in rows:
        words = plain_words(texts[x.doc_id] or "")
        want = [(label, i) for label, p in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for _, i in want]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(words), len(want), min(starts, default=None), max(starts, default=None))
        assert x.base_labels == ",".join(sorted({label for label, _ in want})) and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
        assert 0 <= x.score <= 1 and (x.score > 0) == (x.labels != "")
    assert any("cc-by-nc" in x.labels for x in rows)
    made = license_scan.scan_licenses(docs.withColumnsRenamed({"lang": "places", "source": "score"}))
    assert made.count() == docs.count() and made.filter("doc_id = 5").first().n_words == 0
    assert license_scan.scan_licenses(no_docs).count() == 0
