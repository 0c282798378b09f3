"""Text cleaning, tokens and quality, as column expressions.

Patterns stay inside what Java's and RE2's regular expressions share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the keyword index (fixed values).
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "that", "the", "to", "was",
    "were", "will", "with", "this", "but", "they", "have", "had", "what", "when", "where", "who", "which", "why", "how",
)

#: Stop words of key-term extraction (fixed values).
QUERY_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "what", "how", "why", "when", "where", "which", "who", "do", "does", "did", "can",
    "could", "would", "should", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "about", "between",
)

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def index_terms(text: Column) -> Column:
    """Tokens of the keyword index: no stop words, more than two characters."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(tokens(text), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def key_terms(text: Column) -> Column:
    stop = F.array(*map(F.lit, QUERY_STOP_WORDS))
    return F.filter(tokens(text), lambda t: t.rlike("^[a-z]{3,}$") & ~F.array_contains(stop, t))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))


def clean_basic(text: Column) -> Column:
    """White space to single spaces, trailing number and page lines removed."""
    out = F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")
    out = F.regexp_replace(out, r"\b\d+ *$", "")
    return F.trim(F.regexp_replace(out, r"(?i)^ *page +\d+ *$", ""))


#: Characters that cleaning replaces (fixed values).
REPLACED = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
    "–": "-", "—": "-", "“": '"', "”": '"', "‘": "'", "’": "'",
    "…": "...", " ": " ", " ": " ", " ": " ",
}

#: Lines and notices that preprocessing removes (fixed values).
REMOVED = (
    r"(?im)^[ \t]*\d+[ \t]*$",
    r"(?im)^[ \t]*-[ \t]*\d+[ \t]*-[ \t]*$",
    r"(?im)^[ \t]*page[ \t]+\d+[ \t]*(of[ \t]+\d+)?[ \t]*$",
    r"(?i)©.*?reserved\.?",
    r"(?im)downloaded from.*?$",
    r"(?im)^[ \t]*https?://\S+[ \t]*$",
)


def preprocessed(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern in REMOVED:
        out = F.regexp_replace(out, pattern, "")
    for pattern, to in ((r"\t", " "), (r"\r\n?", "\n"), (r" +", " "), (r"\n{3,}", "\n\n"), (r" +\n", "\n")):
        out = F.regexp_replace(out, pattern, to)
    for old, new in REPLACED.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, to in ((r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", ""), (r"\.([A-Z])", ". $1"), (r"[.]{4,}", "..."), (r"[-]{3,}", "--")):
        out = F.regexp_replace(out, pattern, to)
    return F.btrim(out, F.lit(" \t\r\n"))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    """Cut at a word's end if that loses less than a fifth."""
    head = F.substring(text, 1, most - len(mark))
    back = F.locate(" ", F.reverse(head))
    at = F.length(head) - back  # zero-based place of the last space
    cut = F.when((back > 0) & (at > most * 0.8), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit(mark)))


def quality_score(text: Column) -> Column:
    """0 to 1: length, share of odd signs, common words, runs of spaces, section words."""
    n, low = F.length(text), F.lower(text)
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{N}_ \t\n\r.,;:!?()-]")) / n
    common = sum((low.contains(w).cast("int") for w in ("the", "and", "of", "to", "in", "a")), F.lit(0))
    runs = F.regexp_count(text, F.lit(r"[ \t\n\r]{3,}")) / F.greatest(F.floor(n / 100), F.lit(1))
    minus = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = 1.0 - minus(n < 1000, 0.3) - minus(odd > 0.1, 0.2) - minus(common < 3, 0.2) - minus(runs > 5, 0.1)
    score = score + minus(low.rlike("abstract|introduction|methods|results|conclusion"), 0.1)
    return F.when(F.coalesce(n, F.lit(0)) < 100, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


#: Section words, first hit wins (fixed values).
SECTIONS = {
    "abstract": "abstract", "summary": "abstract", "introduction": "introduction", "background": "introduction", "methods": "methods",
    "methodology": "methods", "results": "results", "findings": "results", "discussion": "discussion", "conclusion": "conclusion", "references": "references",
}


def section_name(name: Column) -> Column:
    low, out = F.lower(F.trim(name)), F.when(F.lit(False), "")
    for word, section in SECTIONS.items():
        out = out.when(low.contains(word), section)
    return out


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.split(collapsed(F.lower(text)), " "))


#: What an injected instruction looks like (fixed values).
INJECTION = (
    r"ignore\s+(previous|above|all)\s+(instructions?|prompts?|rules?)", r"forget\s+(everything|all|previous)", r"new\s+instructions?:", r"system\s*:\s*", r"assistant\s*:\s*",
    r"<\|.*?\|>", r"\[INST\]", r"\[/INST\]", r"<<SYS>>", r"<</SYS>>", r"you\s+are\s+now\s+", r"pretend\s+(you\s+are|to\s+be)", r"act\s+as\s+if", r"roleplay\s+as", r"jailbreak", r"dan\s+mode",
)


def injection(text: Column) -> Column:
    """The first suspicious phrase, by pattern; empty if there is none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in INJECTION], F.lit(""))


# Signs that text extraction leaves, and what they stand for.
ARTIFACTS = {
    "¼": "1/4", "½": "1/2", "¾": "3/4", "⅓": "1/3", "⅔": "2/3",
    "×": " × ", "÷": " / ", "±": " ± ", "≤": " ≤ ", "≥": " ≥ ", "≠": " ≠ ", "≈": " ≈ ", "∞": "infinity",
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "σ": "sigma", "μ": "mu",
    "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl",
    "“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "→": "->", "←": "<-", "↔": "<->",
}
#: Those that stay where formulas are to be kept.
FORMULA_SIGNS = ("×", "÷", "±", "≤", "≥")
_WORD = r"[\p{L}\p{N}_]"


def clean_artifacts(text: Column, formulas: bool = False) -> Column:
    """Text without what extraction left in it: stray signs, doubled bars, split words, page numbers, runs of white space."""
    out = F.coalesce(text, F.lit(""))
    for sign, meant in ARTIFACTS.items():
        if not (formulas and sign in FORMULA_SIGNS):
            out = F.replace(out, F.lit(sign), F.lit(meant))
    out = F.regexp_replace(out, "jj([A-Za-z]+)jj", "|$1|")
    out = F.regexp_replace(out, r"\s{2,}", " ")
    out = F.regexp_replace(out, rf"({_WORD})-\n({_WORD})", "$1$2")
    out = F.regexp_replace(out, r"\n[0-9]+\n", "\n")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def for_display(text: Column) -> Column:
    """Cleaned text with subscripts marked up."""
    return F.regexp_replace(clean_artifacts(text, formulas=True), rf"\b({_WORD}+)_({_WORD}+)\b", "$1<sub>$2</sub>")


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")


def markdown_sections(text: Column) -> Column:
    """Array of (section, content) under headings with ``#``, in order; headings of no known section are left out."""
    parts = F.split(F.concat(F.lit("\n"), text), r"\n#+[ \t\n\f\r]*(?=[^ \t\n\f\r])")
    cut = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.substring_index(p, "\n", 1).alias("head"), p.alias("part")))
    named = F.transform(cut, lambda c: F.struct(section_name(c["head"]).alias("section"), stripped(F.substr(c["part"], F.length(c["head"]) + 1)).alias("content")))
    return F.filter(named, lambda s: s["section"].isNotNull())


def second_level_parts(text: Column) -> Column:
    """The text cut before each ``## `` heading; blank parts are left out."""
    return F.filter(F.transform(F.split(F.concat(F.lit("\n"), text), r"\n(?=## .)"), stripped), lambda p: p != "")


#: Sections of plain text: where one begins, and what ends it (fixed values).
PLAIN_SECTIONS = {
    "abstract": (r"abstract[:\s]*(.+?)", "introduction|background|$"),
    "introduction": (r"introduction[:\s]*(.+?)", "methods|methodology|materials|background|$"),
    "methods": (r"(?:methods|methodology|materials and methods)[:\s]*(.+?)", "results|findings|$"),
    "results": (r"results[:\s]*(.+?)", "discussion|conclusion|$"),
    "discussion": (r"discussion[:\s]*(.+?)", "conclusion|references|$"),
    "conclusion": (r"conclusions?[:\s]*(.+?)", "references|acknowledgment|$"),
}


def plain_sections(text: Column, most: int = 5000) -> dict[str, Column]:
    """The six sections of a text without headings' marks; null where there is none."""
    found = {}
    for name, (start, stop) in PLAIN_SECTIONS.items():
        pattern = f"(?is){start}(?={stop})"
        found[name] = F.when(text.rlike(pattern), F.substring(stripped(F.regexp_extract(text, pattern, 1)), 1, most))
    return found


#: Citations in running text (fixed values): in parentheses, narrative, by number.
CITED = (
    r"\([A-Z][a-zA-Z\-']+(?:\s*(?:et\s+al\.?|,?\s*&?\s*[A-Z][a-zA-Z\-]+)+)?,?\s*\d{4}\)",
    r"[A-Z][a-zA-Z\-']+(?:\s+(?:and|&)\s+[A-Z][a-zA-Z\-']+)?(?:\s+et\s+al\.?)?\s*\(\d{4}\)",
    r"\[\d+\]",
)


def citations(text: Column) -> Column:
    """The different citations of a text, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in CITED])))


def key_points(text: Column, most: int = 5) -> Column:
    """The first sentences that cite somebody, cut at 100 characters."""
    said = F.filter(F.split(text, r"(?<=[.!?])[ \t\n\f\r]+"), lambda s: s.rlike(r"\([A-Z][a-z]+.*?\d{4}\)"))
    return F.transform(F.slice(said, 1, most), lambda s: F.when(F.length(s) > 100, F.concat(F.substring(s, 1, 100), F.lit("..."))).otherwise(s))


def without_title(text: Column, title: Column) -> Column:
    """A section's text without its own title in front, as heading, plain or bold."""
    name = F.concat(F.lit(r"\Q"), F.replace(title, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    out = stripped(text)
    for before, after in ((r"(?i)^##?\s*", r"\s*\n+"), (r"(?i)^", r"\s*\n+"), (r"(?i)^\*\*", r"\*\*\s*\n+")):
        out = F.regexp_replace(out, F.concat(F.lit(before), name, F.lit(after)), F.lit(""))
    return stripped(out)


def for_prompt(text: Column) -> Column:
    """Nothing that could pass for a delimiter of the prompt."""
    return F.replace(F.replace(text, F.lit("```"), F.lit("'''")), F.lit("---"), F.lit("___"))


def feedback(text: Column, most: int = 1000) -> Column:
    """A user's remark: the length is bounded, control characters go."""
    return stripped(F.regexp_replace(F.substring(text, 1, most), r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]", ""))


#: Words that say nothing of a review's subject (fixed values).
REVIEW_STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "these", "those", "such", "from", "based", "including", "among", "between", "within", "using",
    "used", "use", "have", "has", "were", "been", "also", "however", "although", "where", "when", "which", "while", "both", "each", "other", "their",
    "its",
)


def review_keywords(text: Column) -> Column:
    """The different words of five plain letters or more, sorted."""
    stop = F.array(*map(F.lit, REVIEW_STOP_WORDS))
    return F.array_sort(F.array_distinct(F.filter(tokens(text), lambda w: w.rlike("^[a-z]{5,}$") & ~F.array_contains(stop, w))))


# How lines of a first page begin that are no title, and where its year stands.
NO_TITLE = ("abstract", "introduction", "doi", "volume", "page", "copyright", "journal", "received", "accepted", "published", "e-?mail", "corresponding", r"\d+$", r"[a-z]{1,3}\d+")
YEAR_PLACES = (r"\((\d{4})\)", r"©\s*(\d{4})", r"copyright\s+(\d{4})", r"published[:\s]+(\d{4})", r"received[:\s]+[^\n]*?(\d{4})")


def first_page_title(text: Column) -> Column:
    """Of the first 15 lines, the first that can be a title."""
    lines = F.transform(F.slice(F.split(stripped(text), "\n"), 1, 15), stripped)
    other = f"^({'|'.join(NO_TITLE)})"
    fit = F.filter(lines, lambda s: F.length(s).between(20, 300) & ~F.lower(s).rlike(other))
    return F.regexp_replace(F.get(fit, F.lit(0)), r"^#+\s*", "")


def first_page_year(text: Column, latest: int) -> Column:
    """A year in one of the usual places, the first place that holds one from 1950 to ``latest``."""
    found = [F.try_to_number(F.nullif(F.regexp_extract(text, "(?is)" + p, 1), F.lit("")), F.lit("9999")).cast("int") for p in YEAR_PLACES]
    return F.coalesce(*[F.when(y.between(1950, latest), y) for y in found])


def first_page_abstract(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?is)abstract[:\s]*(.{50,2000}?)(?=introduction|keywords|background|1\.|1\s|$)", 1)
    return F.nullif(F.substring(F.regexp_replace(stripped(found), r"[ \t\n\f\r]+", " "), 1, 1500), F.lit(""))


def first_page_authors(text: Column, most: int = 10) -> Column:
    """Names of two to four capitalised words, from those of the first 20 lines that begin like a name."""
    lines = F.filter(F.transform(F.slice(F.split(text, "\n"), 1, 20), stripped), lambda s: s.rlike(r"^[A-Z][a-z]+(?:\s+[A-Z]\.?)?\s+[A-Z][a-z]+"))
    names = F.flatten(F.transform(lines, lambda s: F.transform(F.split(s, r"[,;]|\s+and\s+"), stripped)))
    return F.slice(F.filter(names, lambda n: n.rlike(r"^\p{Lu}\S*(\s+\p{Lu}\S*){1,3}$")), 1, most)


def title_of_file(name: Column) -> Column:
    """A file's name as title; one that holds a DOI says so."""
    plain = stripped(F.regexp_replace(F.regexp_replace(name, "[_-]+", " "), r"\s+", " "))
    doi = F.concat(F.lit("[DOI: "), F.regexp_replace(name, "^([^_]*)_", "$1/"), F.lit("]"))
    return F.when(name.startswith("10.") & name.contains("_"), doi).when(plain == "", "Untitled Document").otherwise(plain)
