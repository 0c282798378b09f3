"""API records, lookups, vocabulary, follow-up questions, citation checks and model hooks on small inputs."""

import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scriptorium.functions import questions as Q
from scriptorium.functions import validation as V
from scriptorium.operators import models as M
from scriptorium.sources import readers


def lines(tmp_path, rows):
    path = tmp_path / "records.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_crossref(spark, tmp_path):
    path = lines(tmp_path, [
        {"DOI": "10.5/ABC", "title": ["Fog"], "author": [{"given": "Ida", "family": "Moe"}, {"family": "Lund"}, {"given": "Nobody"}], "created": {"date-parts": [[2011, 4]]}, "container-title": ["Roads"], "is-referenced-by-count": 3},
        {"title": ["no identifier"]},
        {"DOI": "10.5/d", "title": [], "created": {"date-parts": [[]]}},
    ])
    got = {r.doi: r for r in readers.read_crossref(spark, path).collect()}
    assert set(got) == {"10.5/abc", "10.5/d"}
    assert (got["10.5/abc"].authors, got["10.5/abc"].year, got["10.5/abc"].venue, got["10.5/abc"].citation_count) == (["Ida Moe", "Lund"], 2011, "Roads", 3)
    assert (got["10.5/d"].title, got["10.5/d"].authors, got["10.5/d"].year, got["10.5/d"].citation_count) == ("Unknown Title", [], None, 0)


def test_scholar(spark, tmp_path):
    names = [{"name": f"n{i}"} for i in range(12)]
    path = lines(tmp_path, [
        {"paperId": "a", "externalIds": {"DOI": "10.5/a"}, "title": "A", "authors": [{"name": None}, *names], "year": 2010, "isOpenAccess": True, "openAccessPdf": {"url": "u"}, "citationCount": 4},
        {"paperId": "b", "title": "B", "year": 1999, "isOpenAccess": True},
        {"paperId": "c", "title": "C", "year": 2012, "isOpenAccess": False},
        {"title": "no id"},
    ])
    assert {r.title for r in readers.read_scholar(spark, path).collect()} == {"A", "B", "C"}
    (a,) = readers.read_scholar(spark, path, (2000, 2020), open_only=True).collect()
    assert (a.doi, len(a.authors), a.pdf_url, a.citation_count) == ("10.5/a", 9, "u", 4)
    wanted = spark.createDataFrame([("https://doi.org/10.5/A",), (None,), ("10.5/zzz",)], "doi string")
    assert [r.title for r in readers.by_dois(readers.read_scholar(spark, path), wanted).collect()] == ["A"]


def test_source_terms(spark):
    term = lambda kind, api: spark.range(1).select(readers.source_term(F.lit(kind), F.lit(api))).first()[0]
    assert term("preprint", "crossref") == "posted-content" and term("report", "semantic_scholar") is None
    with pytest.raises(PySparkException):
        term("poem", "crossref")


def test_questions(spark):
    row = spark.range(1).select(
        Q.refined(F.lit("Why?"), F.lit("2001 and 2005"), F.lit(""), F.lit(None).cast("string"), F.lit("reviews")),
        Q.refined(F.lit("Why?"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("")),
        Q.targeted(F.lit("Are cameras effective?"), Q.entities(F.lit("speed compliance near cameras")), F.array(F.lit(""), F.lit("Red-Light camera rear-end crash effects spillover"))),
    ).first()
    assert row[0] == "Why? (published between 2001 and 2005, excluding reviews)" and row[1] == "Why?"
    assert row[2] == ["Red-Light camera rear-end crash effects spillover", "crash modification factor empirical bayes methodology"]
    made = Q.paper_target(F.col("d"), F.col("a"), F.col("b"))
    rows = spark.createDataFrame([("Low", None, None), ("High", 10, 21), ("Low", 20, 40), ("?", 20, 30)], "d string, a long, b long").select(*[c.alias(n) for n, c in made.items()]).collect()
    assert [tuple(r) for r in rows] == [(10, 6, 14, None), (15, 10, 21, "narrow"), (30, 20, 40, "wide"), (25, 20, 30, None)]


LONG = "The trial showed that speeds were reduced by a third on all of the streets which had been rebuilt within two years"
ANSWER = "\n\n".join([
    "# Findings of the whole study", LONG + " [1].", LONG + " (Moe & Lund, 2019) and [2-3].", LONG + ".\n## A header of the next part\nshort text under the header, [9]", "Overall, " + LONG, LONG + "?", "tiny", LONG + ", as Berg et al. (2014) said [3 7].",
])


@pytest.mark.parametrize("text", [ANSWER, "", "x" * 300, "\n\n".join([LONG + " [1] [2] [3,4] [1-4] [4-1] [12345678901234567890]"] * 4), LONG + " [1-9999999999]"])
def test_citations(spark, text):
    """Against a plain reading of the rules."""
    parts = [p.strip() for p in re.split(r"\n\n+|\n(?=#+\s)", text)]
    parts = [p for p in parts if len(p) > 20]
    numbers = authors = claims = uncited = valid = 0
    cited = set()
    for p in parts:
        n = 0
        for mark in re.findall(V.NUMBERED, p):
            if "-" in mark:
                a, b = mark.split("-")[:2]
                pairs = [(int(a), int(b))] if a.isdigit() and b.isdigit() else []
            else:
                pairs = [(int(x), int(x)) for x in re.findall(r"\d+", mark)]
            for a, b in pairs:
                n += max(b - a + 1, 0)
                hit = [x for x in (1, 2, 3, 4) if a <= x <= b]
                valid += len(hit)
                cited |= set(hit)
        by = len(re.findall(V.PARENTHETICAL, p)) + len(re.findall(V.NARRATIVE, p))
        starts = p.startswith(("#", "**")) or p.lower().startswith(V.INTRODUCTIONS)
        claim = not (starts or p.endswith("?") or "References" in p or "limitations" in p.lower() or len(p) < 100)
        claim = claim and bool(re.search(V.CLAIM, p) or (re.search(V.VERB, p.lower()) and len(p.split()) > 10))
        numbers, authors, claims = numbers + n, authors + by, claims + claim
        uncited += claim and not n and not by
    score = (claims - uncited) / claims if claims else 1.0
    for least in (15, 25):
        score = min(1.0, score + 0.1) if numbers + authors >= least else score
    score = score * 0.8 if numbers > valid else score
    df = spark.createDataFrame([(text,)], "text string").select(V.judged(F.col("text")).alias("j"))
    got = df.select(*[c.alias(n) for n, c in V.compliance(F.col("j"), 4).items()]).first()
    assert (got.paragraphs, got.citations, got.invalid, got.uncited, got.cited_sources) == (len(parts), numbers + authors, numbers - valid, uncited, sorted(cited))
    assert got.compliance == pytest.approx(score) and got.coverage == pytest.approx((len(cited) + min(authors, 4 - len(cited))) / 4)


def test_models(spark):
    pairs = spark.createDataFrame([(1, 10, 1, "red fog", "no such thing"), (1, 11, 2, "red fog", "Fog, red and grey"), (1, 12, 3, "red fog", None), (2, 10, 1, None, "x")], "query_id long, doc_id long, rank long, question string, text string")
    got = sorted((r.query_id, r.reranked, r.doc_id, r.score) for r in M.reranked(pairs, M.word_share).collect())
    assert got == [(1, 1, 11, 1.0), (1, 2, 10, 0.0), (1, 3, 12, 0.0), (2, 1, 10, 0.0)]
    odd = lambda: lambda questions, texts: [None, "bad", 7, -1][: len(texts)]
    assert [r.score for r in M.scored(pairs.coalesce(1), odd).collect()] == [0.0, 0.0, 1.0, 0.0]
    (v,) = M.embedded(pairs.filter("doc_id = 11"), M.hashed_words).select("embedding").first()
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1.0)
