import random
import re

import pytest

from scriptorium.operators import spans
from scriptorium.operators import token_chunks as T


def test_spans_as_sets():
    r = random.Random(1)
    for _ in range(300):
        some = [(a, a + r.randint(-1, 6)) for a in (r.randrange(-3, 30) for _ in range(r.randint(0, 8)))]
        covered = {i for a, b in some for i in range(a, b) if 0 <= i < 25}
        assert {i for a, b in spans.union(some, 25) for i in range(a, b)} == covered
        assert all(b < c for (_, b), (c, _) in zip(spans.union(some, 25), spans.union(some, 25)[1:], strict=False))
        assert {i for a, b in spans.complement(some, 0, 25) for i in range(a, b)} == set(range(25)) - covered
        for at in range(26):
            inside = spans.around(spans.union(some, 25), at)
            assert (inside is not None) == (at - 1 in covered and at in covered)


def paper(r):
    words = ["alpha", "beta", "gamma.", "delta!", "été", "漢字仮名", "x" * 40, "$a+b$", "$$ x\n\n= y $$", r"\begin{align} a &= b \\ c &= d \end{align}", "∀∃∑∫≤≥", "it costs $5"]
    parts = []
    for _ in range(r.randint(0, 6)):
        if r.random() < 0.5:
            parts.append("# " + r.choice(["Introduction", "Methods and data", "References", "Other things", "2 Results"]))
        parts.append(" ".join(r.choice(words) for _ in range(r.randint(0, 120))))
    return r.choice(["\n\n", "\n \n\n"]).join(parts) + r.choice(["", "\n", "  "])


def slow_end(c, start, fresh, hi):
    """The end of a chunk by trying every place."""
    if c.count(start, hi) <= c.size:
        return hi
    best = None
    for level in c.levels[:4]:
        fits = [p for p in level if fresh < p < hi and c.text[fresh:p].strip() and c.count(start, p) <= c.size]
        best = max([*fits, best or 0]) or None
        if best and c.count(fresh, best) >= min(c.least, c.size):
            return best
    return best


@pytest.mark.parametrize("seed", range(12))
def test_chunks_of_random_papers(seed):
    r = random.Random(seed)
    for _ in range(12):
        text, size = paper(r), r.choice([12, 30, 80])
        c = T.Chunker(text, size, r.choice([0, size // 5]), r.choice([0, size // 8]))
        formulas = [s for s in c.whole if c.count(*s) <= size - 2]
        regions = list(c.regions())
        assert all(s != "references" for s, _, _ in regions)
        for _, lo, hi in regions:
            made = c.chunks(lo, hi)
            if not made:
                assert c.count(lo, hi) < max(c.least, 1)
                continue
            assert made[0][1] == lo and all(a[2] == b[1] for a, b in zip(made, made[1:], strict=False)) and not text[made[-1][2] : hi].strip()
            for start, fresh, stop in made:
                assert lo <= start <= fresh < stop <= hi and c.count(start, stop) <= size
                assert start == fresh or fresh - start <= len(text)
                for place in (start, stop):
                    assert not spans.around(formulas, place), text[place - 10 : place + 10]
            for start, fresh, stop in made[:-1]:  # the last one may have taken in a small rest
                if stop != made[-1][2]:
                    want = slow_end(c, start, fresh, hi)
                    assert want is None or stop == want


def test_regions():
    text = "A first part that has more than fifty characters in all of it.\n# Methods\nbody one\n## Details of nothing\nThis heading is of no known kind, so its text is a gap to be filled.\n# References\nshort\n# Results\nbody two"
    c = T.Chunker(text)
    assert [(s, re.sub(r"\s+", " ", text[a:b].strip())[:12]) for s, a, b in c.regions()] == [("methods", "body one"), ("results", "body two"), ("uncategorized", "A first part"), ("uncategorized", "## Details o")]
    assert [s for s, _, _ in T.Chunker("no headings").regions()] == ["full_text"]


def test_a_text_without_sentences_or_words():
    c = T.Chunker("word " * 5000)
    made = c.chunks(0, len(c.text))
    assert len(made) > 6 and all(c.count(a, b) <= 800 for a, _, b in made) and all(c.count(a, f) in range(140, 151) for a, f, _ in made[1:])
    c = T.Chunker("漢" * 9000)
    assert all(c.count(a, b) <= 800 for a, _, b in c.chunks(0, 9000))


def test_small_rests():
    c = T.Chunker("one two three. " * 30, 50, 10, 20)
    made = c.chunks(0, len(c.text))
    assert made[-1][2] == len(c.text) and c.count(made[-1][0], made[-1][2]) <= 50
    assert T.Chunker("tiny", 50, 10, 20).chunks(0, 4) == [] and T.Chunker("  ", 50, 10, 0).chunks(0, 2) == []
    with pytest.raises(ValueError):
        T.Chunker("x", 10, 10)


def test_table_function(spark):
    rows = [(1, "A title", None, "kept", "word " * 2000), (2, None, None, "kept", None), (3, "Unknown Title", "An abstract. " * 2000, "kept", ""), (1, None, None, "again", "few")]
    made = T.token_chunks(spark.createDataFrame(rows, "doc_id long, title string, abstract string, source string, text string"), title="title", abstract="abstract", least=0).collect()
    of = lambda k, source: [r for r in made if (r.doc_id, r.source) == (k, source)]
    assert [r.section for r in of(1, "kept")] == ["summary"] + ["full_text"] * (len(of(1, "kept")) - 1) and len(of(1, "kept")) > 3
    assert [r.chunk for r in of(1, "kept")] == list(range(len(of(1, "kept")))) and len({r.chunk_id for r in of(1, "kept")}) == len(of(1, "kept"))
    assert of(2, "kept") == [] and [(r.section, r.n_tokens <= 1600, r.n_tokens > 1500) for r in of(3, "kept")] == [("summary", True, True)]
    assert [r.chunk_text for r in of(1, "again")] == ["few"]


def test_queries_are_whole(spark, sf):
    from scriptorium import catalog

    rows = catalog.QUERIES["paper_chunks"](spark, sf)
    assert rows.filter("level = 'paragraph' and n_tokens > 800").count() == 0
    assert rows.filter("level = 'paragraph' and section = 'references'").count() == 0 and rows.filter("n_formulas > 0").count() > 100
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
