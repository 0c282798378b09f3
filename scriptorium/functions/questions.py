"""Questions and their answers: classes, complexity, decomposition, entities, citations.

Word and pattern lists are fixed values of the domain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The phrases of each class of question.
REVIEW_PHRASES = (
    r"systematic\s+review", r"meta[\-\s]?analysis", r"scoping\s+review", r"comprehensive\s+review", r"literature\s+review", r"narrative\s+review",
    r"quantitative\s+review", r"qualitative\s+review", r"mixed[\-\s]?methods?\s+review", r"state[\-\s]?of[\-\s]?the[\-\s]?art", r"overview\s+of", r"survey\s+of",
    r"all\s+(?:studies|research|papers|evidence)\s+on",
)
COMPARISON_PHRASES = (
    r"compare", r"comparison", r"versus", r"vs\.?", r"differ(?:ence)?s?\s+between", r"which\s+is\s+better", r"pros\s+and\s+cons", r"advantages?\s+and\s+disadvantages?",
    r"similarities?\s+and\s+differences?", r"relative\s+to",
)
MECHANISM_PHRASES = (
    r"how\s+does", r"mechanism", r"why\s+does", r"what\s+causes?", r"relationship\s+between", r"effect\s+of", r"impact\s+of", r"influence\s+of",
    r"factors?\s+(?:that\s+)?affect", r"determinants?\s+of",
)
DEFINITION_PHRASES = (
    r"what\s+is", r"define", r"definition\s+of", r"meaning\s+of", r"explain\s+(?:the\s+)?(?:term|concept|notion)",
)


def whole_words(phrases: tuple[str, ...]) -> str:
    """A pattern of any of the phrases, as whole words."""
    return r"\b(" + "|".join(phrases) + r")\b"


REVIEW = whole_words(REVIEW_PHRASES)
COMPARISON = whole_words(COMPARISON_PHRASES)
MECHANISM = whole_words(MECHANISM_PHRASES)
DEFINITION = whole_words(DEFINITION_PHRASES) + r"|^\s*what\s+(?:is|are)\s+\w+\s*\??\s*$"

COMPLEX = (
    r"\b(comprehensive|systematic|integrated|meta-analysis|literature review)\b", r"\b(compare|comparison|contrast|synthesize|analyze|evaluate)\b",
    r"\b(methodology|methodological|framework|theoretical)\b", r"\b(variables|factors|moderators|mediators|mechanisms)\b",
    r"\b(network|spatial|temporal|multi|heterogeneity)\b", r"\b(and|also|additionally|furthermore|moreover)\b.*\b(and|also)\b",
    r"\b(effectiveness|efficacy|impact|outcome|treatment effect)\b", r"\b(crash modification|cmf|crf|reduction factor)\b", r"\b(halo effect|spillover|radial|upstream|downstream)\b",
)
MODERATE = (r"\b(explain|describe|discuss|outline|summarize)\b", r"\b(how|why|what factors|what variables)\b", r"\b(relationship|correlation|association|influence)\b", r"\b(examples|instances|cases|scenarios)\b")
ACADEMIC = "academic|scholarly|research|literature"

SYNONYMS = {
    "crash": ["accident", "collision", "incident"], "safety": ["risk", "hazard", "protection"], "autonomous": ["self-driving", "automated", "driverless"],
    "pedestrian": ["walker", "foot traffic"], "intersection": ["junction", "crossing"], "ttc": ["time-to-collision", "time to collision"],
}

ENTITIES = {
    "methodologies": r"\b(empirical\s+bayes|eb|before[\-\s]?after\s+stud(?:y|ies)|rct|randomized\s+controlled?\s+trial|cross[\-\s]?sectional|longitudinal\s+stud(?:y|ies)|meta[\-\s]?analysis|case[\-\s]?control|propensity\s+score|regression\s+to\s+(?:the\s+)?mean|crash\s+modification\s+factor|cmf|safety\s+performance\s+function|spf)\b",
    "contexts": r"\b(urban|rural|suburban|intersection|signalized|unsignalized|highway|arterial|freeway|expressway|school\s+zone|work\s+zone|residential|commercial|industrial|high[\-\s]?speed|low[\-\s]?speed|daytime|nighttime|dark\s+conditions?|wet|dry|adverse\s+weather)\b",
    "outcomes": r"\b(crash\s+reduction|crash\s+frequency|crash\s+severity|fatal(?:ity|ities)?|injur(?:y|ies)|serious\s+injur(?:y|ies)|speed\s+compliance|speed\s+reduction|red[\-\s]?light\s+violation|rear[\-\s]?end\s+crash(?:es)?|angle\s+crash(?:es)?|right[\-\s]?angle|pedestrian|cyclist|vulnerable\s+road\s+user)\b",
    "interventions": r"\b(red[\-\s]?light\s+camera|rlc|speed\s+camera|photo\s+enforcement|automated\s+enforcement|traffic\s+signal|signal\s+timing|speed\s+limit|posted\s+speed|warning\s+sign|advance\s+warning|geometric\s+improvement)\b",
    "metrics": r"\b(ttc|time[\-\s]?to[\-\s]?collision|pet|post[\-\s]?encroachment[\-\s]?time|drac|deceleration\s+rate|85th\s+percentile|odds\s+ratio|or|relative\s+risk|rr|confidence\s+interval|ci|p[\-\s]?value|significance)\b",
}


def words(text: Column) -> Column:
    """The number of words between white space."""
    return F.regexp_count(text, F.lit(r"\S+"))


def question_type(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.rlike(REVIEW), "review").when(low.rlike(COMPARISON), "comparison").when(low.rlike(MECHANISM), "mechanism").when(low.rlike(DEFINITION) & (words(text) <= 6), "definition").otherwise("general")


def paper_range(text: Column, depth: str = "Medium") -> tuple[Column, Column]:
    """Least and most papers for a question."""
    kind = question_type(text)
    low, high = {"Low": (3, 8), "Medium": (8, 15), "High": (15, 30)}[depth]
    long = words(text) > 20
    pick = lambda review, comparison, mechanism, definition, general: F.when(kind == "review", review).when(kind == "comparison", comparison).when(kind == "mechanism", mechanism).when(kind == "definition", definition).otherwise(general)
    return (pick(20, 8, 10, 3, F.when(long, min(low + 5, 25)).otherwise(low)), pick(50, 20, 25, 8, F.when(long, min(high + 10, 50)).otherwise(high)))


def complexity(text: Column) -> Column:
    low, n, marks = F.lower(text), words(text), F.regexp_count(text, F.lit("[.!?]"))
    hits = lambda patterns: sum((low.rlike(p).cast("int") for p in patterns), F.lit(0))
    hard = hits(COMPLEX) + F.when(n > 40, 2).otherwise(0) + F.when(marks >= 3, 2).otherwise(0) + F.when(low.rlike(ACADEMIC), 2).otherwise(0)
    medium = hits(MODERATE) + F.when((n > 20) & (n <= 40), 1).otherwise(0) + F.when(marks == 2, 1).otherwise(0)
    return F.when((hard >= 3) | ((hard >= 2) & (n > 30)), "complex").when((medium >= 2) | (hard >= 1), "moderate").otherwise("simple")


def response_length(level: Column, depth: str) -> Column:
    base = F.when(level == "complex", "long").when(level == "moderate", "moderate").otherwise("short")
    if depth == "High":
        return F.when(base == "short", "moderate").otherwise("long")
    if depth == "Low":
        return F.when(base == "long", "moderate").otherwise("short")
    return base


def is_complex(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(r"\b(and|or|versus|vs\.?|compared to|difference between)\b|\b(what are|list|enumerate|identify all)\b") | low.rlike(r"(?s)\?.*\?") | (words(text) > 15)


def sub_questions(text: Column) -> Column:
    """The question, then its parts around 'and' (over ten characters), in order and distinct."""
    parts = F.transform(F.split(text, r"(?i)\s+and\s+"), lambda p: F.trim(p))
    long = F.filter(parts, lambda p: F.length(p) > 10)
    return F.array_distinct(F.concat(F.array(text), F.when(F.size(parts) > 1, long).otherwise(F.array().cast("array<string>"))))


def compared_parts(text: Column) -> Column:
    """The question, its parts around 'and' (over ten characters) and around 'versus' or 'vs' (over five), in order and distinct."""
    parts = lambda pattern, least: F.filter(F.transform(F.split(text, pattern), lambda p: F.trim(p)), lambda p: F.length(p) > least)
    none = F.array().cast("array<string>")
    joined = F.when(F.contains(F.lower(text), F.lit(" and ")), parts(r"(?i)\s+and\s+", 10)).otherwise(none)
    against = F.when(text.rlike(r"(?i)\b(versus|vs\.?)\b"), parts(r"(?i)\s+(?:versus|vs\.?)\s+", 5)).otherwise(none)
    return F.array_distinct(F.concat(F.array(text), joined, against))


def with_synonyms(text: Column, most: int = 3) -> Column:
    low = F.lower(text)
    made = [F.when(low.contains(term), F.regexp_replace(text, rf"(?i)\b{term}\b", s)) for term, found in SYNONYMS.items() for s in found]
    return F.slice(F.array_distinct(F.filter(F.array(text, *made), lambda x: x.isNotNull())), 1, most)


def entities(text: Column) -> dict[str, Column]:
    """Sorted distinct entities of each category."""
    return {name: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0)))) for name, pattern in ENTITIES.items()}


def adaptive_rounds(kind: Column, confidence: Column, rounds: int = 2) -> tuple[Column, Column, Column]:
    """Rounds, reflection mode and search expansion for a question's type and confidence."""
    rule = lambda n, mode, x: F.struct(F.lit(n).alias("n"), F.lit(mode).alias("mode"), F.lit(x).alias("x"))
    chosen = (
        F.when(kind == "definition", rule(1, "skip", 1.0))
        .when(kind == "comparison", F.when(confidence >= 0.75, rule(1, "skip", 1.0)).otherwise(rule(2, "quick", 1.2)))
        .when(kind == "review", F.when(confidence >= 0.85, rule(2, "quick", 1.5)).otherwise(rule(3, "full", 2.0)))
        .when(kind == "mechanism", F.when(confidence >= 0.70, rule(2, "quick", 1.3)).otherwise(rule(2, "full", 1.5)))
        .otherwise(F.when(confidence >= 0.85, rule(1, "skip", 1.0)).when(confidence >= 0.65, rule(min(2, rounds), "quick", 1.2)).otherwise(rule(rounds, "full", 1.5)))
    )
    return chosen["n"], chosen["mode"], chosen["x"]


NUMBERED = r"\[(\d+(?:\s*[-,]\s*\d+)*)\]"


def cited_numbers(text: Column) -> Column:
    """Source numbers cited as [1], [2, 3] or [1-3], in order, distinct.

    A range of a thousand numbers or more is no list of sources: its two ends count.  Numbers too long for one are left out.
    """
    lists = F.regexp_extract_all(text, F.lit(NUMBERED), F.lit(1))
    parts = F.flatten(F.transform(lists, lambda x: F.split(F.regexp_replace(x, " ", ""), ",")))

    def expand(p: Column) -> Column:
        low, high = (F.split_part(p, F.lit("-"), F.lit(k)).try_cast("int") for k in (1, 2))
        near = (high >= low) & (high.cast("long") - low < 1000)
        return F.when(near, F.sequence(low, F.when(near, high).otherwise(low))).otherwise(F.filter(F.array(low, high), lambda n: n.isNotNull()))

    return F.array_distinct(F.flatten(F.transform(parts, expand)))


def section_issue(text: Column) -> Column:
    """Why a section looks cut off; 'OK' if it doesn't."""
    t = F.trim(text)
    return (
        F.when(F.coalesce(t, F.lit("")) == "", "Empty content")
        .when(t.rlike(r"\([^)]*$"), "Unclosed parenthesis")
        .when(t.rlike(r"[,;:]$"), "Ends with comma/semicolon/colon")
        .when(t.rlike(r"\bet\s+al\.?\s*$"), "Ends with 'et al' without year")
        .when(t.rlike(r"\[[^\]]*$"), "Unclosed bracket")
        .when(t.rlike(r"[\p{L}\p{N}_]{4,}$"), "Ends without punctuation")
        .when(~t.rlike(r"""[.!?)\]"]$"""), "Does not end with proper punctuation")
        .otherwise("OK")
    )


def audit_decision(text: Column) -> tuple[Column, Column]:
    """SUFFICIENT, MISSING or RESTRUCTURE, and what is missing."""
    up = F.upper(F.coalesce(text, F.lit("")))
    missing = F.trim(F.regexp_extract(text, r"(?i)MISSING:\s*([^\n]+)", 1))
    return F.when(up.contains("SUFFICIENT"), "SUFFICIENT").when(up.contains("MISSING:"), "MISSING").otherwise("RESTRUCTURE"), F.nullif(missing, F.lit(""))


def refined(text: Column, timeframe: Column, context: Column, include: Column, exclude: Column | None = None) -> Column:
    """A question with the answers to clarifying questions in brackets; null and empty answers add nothing."""
    given = {"published between {}": timeframe, "in {} contexts": context, "including {}": include, "excluding {}": exclude}
    added = []
    for form, answer in given.items():
        if answer is not None:
            before, after = form.split("{}")
            added.append(F.when(F.length(answer) > 0, F.concat(F.lit(before), answer, F.lit(after))))
    all_ = F.concat_ws(", ", *added)
    return F.when(all_ == "", text).otherwise(F.concat(text, F.lit(" ("), all_, F.lit(")")))


def targeted(text: Column, found: dict[str, Column], suggested: Column | None = None, most: int = 3) -> Column:
    """Follow-up questions: two of the suggested ones first, then those for outcomes and methods not found yet."""
    asks = lambda *words: F.lower(text).rlike("|".join(words))
    lacks = lambda kind, word: ~F.exists(found[kind], lambda x: F.contains(x, F.lit(word)))
    # Cues, what must be missing, and the question for it.
    made = F.array(
        F.when(asks("camera", "enforcement") & lacks("outcomes", "rear-end crash"), "red-light camera rear-end crash effects spillover"),
        F.when(asks("camera", "enforcement") & lacks("outcomes", "speed compliance"), "speed camera compliance rate effectiveness"),
        F.when(asks("effective") & lacks("methodologies", "empirical bayes"), "crash modification factor empirical bayes methodology"),
    )
    if suggested is not None:
        made = F.concat(F.slice(F.filter(suggested, lambda s: F.length(s) > 0), 1, 2), made)
    kept = F.filter(made, lambda q: q.isNotNull())
    new = F.filter(kept, lambda q, i: ~F.array_contains(F.transform(F.slice(kept, F.lit(1), i), lambda x: F.lower(x)), F.lower(q)))
    return F.slice(new, 1, most)


# Papers to look for by depth.
DEPTHS = {"Low": 10, "Medium": 25, "High": 50}


def paper_target(depth: Column, low: Column, high: Column) -> dict[str, Column]:
    """target, least, most, warning; a null range means the depth decides, an unknown depth is Medium."""
    usual = F.lit(DEPTHS["Medium"])
    for name, n in DEPTHS.items():
        usual = F.when(depth == name, n).otherwise(usual)
    middle, preset = F.floor((low + high) / 2), low.isNull() | high.isNull()
    warning = F.when(preset, None).when(middle < usual * 0.7, "narrow").when(middle > usual * 1.5, "wide")
    either = lambda a, b: F.when(preset, a.cast("long")).otherwise(b.cast("long"))
    return {"target": either(usual, middle), "least": either(F.floor(usual * 0.6), low), "most": either(F.floor(usual * 1.4), high), "warning": warning}
