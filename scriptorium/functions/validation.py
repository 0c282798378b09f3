"""Do answers cite their sources: paragraphs, citations in three forms, claims, compliance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a citation and what as a claim.
NUMBERED = r"\[(\d+(?:[-,\s]\d+)*)\]"
PARENTHETICAL = r"\(([A-Z][a-zA-Zé\-']+(?:\s*(?:et\s+al\.?|,?\s*&?\s*[A-Z][a-zA-Z\-]+)+)?),?\s*(\d{4})\)"
NARRATIVE = r"[A-Z][a-zA-Z\-']+(?:\s+(?:and|&)\s+[A-Z][a-zA-Z\-']+)?(?:\s+et\s+al\.?)?\s*\(\d{4}\)"
INTRODUCTIONS = ("in this", "this section", "overall", "in summary", "to summarize", "in conclusion", "the following")
CLAIMS = (
    r"\b(found|demonstrated|showed|reported|indicates?|suggests?)\b",
    r"\b(increas|decreas|reduc|improv)e[ds]?\b",
    r"\b\d+%\b",
    r"\b(p\s*[<>=]\s*0?\.\d+)\b",
    r"\bp<0\.05\b",
    r"\b(OR|RR|CI)\s*[:=]",
    r"\b(significant|correlation|effect)\b",
)
CLAIM = "(?i)" + "|".join(f"(?:{p})" for p in CLAIMS)
VERB = r"(ed|es|ing|tion)(\s|$)"
_NONE = 1 << 62  # a number too long for a source


def paragraphs(text: Column) -> Column:
    """Parts between empty lines and before headers, stripped; those of up to 20 characters go."""
    parts = F.split(F.regexp_replace(text, r"\n(#+\s)", "\n\n$1"), r"\n\n+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: F.length(p) > 20)


def is_claim(p: Column) -> Column:
    """A long paragraph, no header, question, introduction or list of references, that states something."""
    low = F.lower(p)
    skipped = p.startswith("#") | p.startswith("**") | p.endswith("?") | F.contains(p, F.lit("References")) | F.contains(low, F.lit("limitations")) | (F.length(p) < 100)
    for phrase in INTRODUCTIONS:
        skipped = skipped | low.startswith(phrase)
    return ~skipped & (p.rlike(CLAIM) | (low.rlike(VERB) & (F.regexp_count(p, F.lit(r"\S+")) > 10)))


def numbered(p: Column) -> Column:
    """first, last of the ranges that brackets cite; a single number is a range of one."""

    def ranges(inner: Column) -> Column:
        ends = F.transform(F.slice(F.split(inner, "-"), 1, 2), lambda x: F.trim(x).try_cast("long"))
        first, last = F.get(ends, F.lit(0)), F.get(ends, F.lit(1))
        whole = F.when(last >= first, F.array(F.struct(first.alias("first"), last.alias("last")))).otherwise(F.array().cast("array<struct<first: long, last: long>>"))
        number = lambda x: F.coalesce(x.try_cast("long"), F.lit(_NONE))
        single = F.transform(F.regexp_extract_all(inner, F.lit(r"\d+"), F.lit(0)), lambda x: F.struct(number(x).alias("first"), number(x).alias("last")))
        return F.when(F.contains(inner, F.lit("-")), whole).otherwise(single)

    return F.flatten(F.transform(F.regexp_extract_all(p, F.lit(NUMBERED), F.lit(1)), ranges))


def by_author(p: Column) -> Column:
    return F.size(F.regexp_extract_all(p, F.lit(PARENTHETICAL), F.lit(0))) + F.size(F.regexp_extract_all(p, F.lit(NARRATIVE), F.lit(0)))


def judged(text: Column) -> Column:
    """A text's paragraphs with ranges, citations by author, and whether they claim something."""
    return F.transform(paragraphs(text), lambda p: F.struct(numbered(p).alias("ranges"), by_author(p).alias("authors"), is_claim(p).alias("claim")))


def compliance(judged: Column, sources: int) -> dict[str, Column]:
    """Figures of a column made by :func:`judged` (as a stored column: it is read several times)."""
    total = lambda arr, f: F.aggregate(arr, F.lit(0).cast("long"), lambda s, x: s + f(x))
    ranges = F.flatten(F.transform(judged, lambda p: p["ranges"]))
    authors = total(judged, lambda p: p["authors"])
    valid = F.flatten(F.transform(F.filter(ranges, lambda r: (r["first"] <= sources) & (r["last"] >= 1)), lambda r: F.sequence(F.greatest(r["first"], F.lit(1)), F.least(r["last"], F.lit(sources)))))
    numbers = total(ranges, lambda r: r["last"] - r["first"] + 1)
    claims, cited = F.size(F.filter(judged, lambda p: p["claim"])), F.size(F.array_distinct(valid))
    uncited = F.size(F.filter(judged, lambda p: p["claim"] & (F.size(p["ranges"]) == 0) & (p["authors"] == 0)))
    score = F.when(claims == 0, 1.0).otherwise((claims - uncited) / claims)
    for least in (15, 25):
        score = F.when(numbers + authors >= least, F.least(F.lit(1.0), score + 0.10)).otherwise(score)
    invalid = numbers - F.size(valid)
    return {
        "paragraphs": F.size(judged).cast("long"), "citations": numbers + authors, "invalid": invalid, "uncited": uncited.cast("long"), "cited_sources": F.array_sort(F.array_distinct(valid)),
        "compliance": F.when(invalid > 0, score * 0.8).otherwise(score), "coverage": (cited + F.least(authors, sources - cited)) / float(sources),
    }


def badge(score: Column) -> Column:
    return F.when(score >= 0.9, "🟢 Excellent").when(score >= 0.7, "🟡 Good").when(score >= 0.5, "🟠 Fair").otherwise("🔴 Poor")
