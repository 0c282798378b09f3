"""Facts drawn from texts, plans made of them, and marks for what was written."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
METHODOLOGIES = ("empirical", "theoretical", "review", "simulation", "case_study", "other")
CERTAINTIES = ("high", "moderate", "low")
COMPARISON_ROLES = ("comparison", "counter_claim", "contrast", "evaluation", "critique")
BACKGROUND_ROLES = ("background", "context", "literature_review", "establish_territory", "methodology", "introduction")
GAP_ROLES = ("gap", "limitations", "future_work", "identify_gap", "problem_statement", "research_gap")
PREPRINT_TYPES = ("preprint", "journal_article", "review", "conference_paper")
YEARS_OF_SEARCH = ("min_year", "max_year", "from_updated_date")


def methodology(named: Column) -> Column:
    low = F.lower(F.coalesce(named, F.lit("other")))
    return F.when(low.isin(*METHODOLOGIES), low).when(low.contains("conceptual"), "theoretical").otherwise("other")


def certainty(named: Column) -> Column:
    low = F.lower(named)
    return F.when(low.isin(*CERTAINTIES), low).otherwise("moderate")


def topic_slugs(topics: Column) -> Column:
    return F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.replace(F.lower(t), F.lit(" "), F.lit("_")))


def fact_id(claim: Column) -> Column:
    return F.concat(F.lit("fact_"), F.substring(F.md5(F.trim(claim)), 1, 12))


def first_given(*numbers: Column) -> Column:
    """The first number that is neither null nor 0; 0 if there is none."""
    return F.coalesce(*[F.nullif(n, F.lit(0)) for n in numbers], F.lit(0))


def search_signature(source: Column, keyword: Column, filters: Column) -> Column:
    """md5 of a search; ``filters`` is a map to arrays of values.  Order and case don't matter, years are left out."""
    used = F.filter(F.array_sort(F.map_keys(filters)), lambda k: ~k.isin(*YEARS_OF_SEARCH))
    parts = F.transform(used, lambda k: F.concat_ws(":", k, F.array_join(F.array_sort(F.transform(filters[k], F.lower)), "|")))
    return F.md5(F.concat(F.lit("source:"), F.lower(F.trim(source)), F.lit("|kw:"), F.lower(F.trim(keyword)), F.lit("|"), F.array_join(parts, "|")))


def worth_asking(source: Column, types: Column) -> Column:
    """A preprint server is not asked for types that it doesn't hold."""
    return (source != "arxiv") | F.arrays_overlap(types, F.array(*map(F.lit, PREPRINT_TYPES)))


def search_again(round_: Column, most: Column, confidence: Column, mode: Column) -> Column:
    return (round_ < most) & (confidence < 0.85) & (mode != "skip")


def paper_target(depth_target: Column, low: Column, high: Column) -> tuple[Column, Column, Column, Column]:
    """Target, range and warning; without a range of the user's, 60 to 140 % of the depth's target."""
    middle = F.floor((low + high) / 2)
    own = low.isNotNull() & high.isNotNull()
    warning = F.when(own & (middle < depth_target * 0.7), "narrow").when(own & (middle > depth_target * 1.5), "wide")
    return F.when(own, middle).otherwise(depth_target), F.when(own, low).otherwise(F.floor(depth_target * 0.6)), F.when(own, high).otherwise(F.floor(depth_target * 1.4)), warning


def proofread(original: Column, first: Column, second: Column, least: float = 0.8) -> Column:
    """The first attempt that isn't much shorter than the original, or the original."""
    enough = lambda c: F.length(c) >= F.length(original) * least
    return F.when(enough(first), first).when(enough(F.trim(second)), F.trim(second)).otherwise(original)


def badge(score: Column) -> Column:
    return F.when(score >= 0.9, "Excellent").when(score >= 0.7, "Good").when(score >= 0.5, "Fair").otherwise("Poor")


def section_tokens(citations: Column, base: int, factor: float, high: bool = False) -> Column:
    """Output tokens of a section by its citations."""
    out = F.floor(F.greatest(F.lit(0.8), F.least(F.lit(2.5), citations / 10)) * F.lit(base * factor))
    return F.when(citations >= 15, F.greatest(out, F.lit(2400))).otherwise(out) if high else out
