"""Identifiers, names and references of publications, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_doi(doi: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(doi)), r"^(https?://(dx\.)?doi\.org/|doi:\s*)", "")


def valid_doi(doi: Column) -> Column:
    return F.coalesce(doi.rlike(r"^10\.\d{4,}/\S+$"), F.lit(False))


def doi_from_filename(name: Column) -> Column:
    """10.x_suffix(.pdf) -> 10.x/suffix; null for other names."""
    stem = F.regexp_replace(name, r"\.pdf$", "")
    return F.when(stem.rlike(r"^10\.\d{4,}_"), F.regexp_replace(stem, r"^(10\.\d{4,})_", "$1/"))


def doi_in_text(text: Column) -> Column:
    found = F.regexp_replace(F.regexp_extract(text, r"10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+", 0), r"\.+$", "")
    return F.when(found != "", found)


def arxiv_id(text: Column) -> Column:
    found = F.regexp_extract(text, r"(\d{4}\.\d{4,5})(v\d+)?", 1)
    return F.when(found != "", found)


def normal_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^a-z0-9\s]", ""), r"\s+", " "))


def canonical_id(doi: Column, arxiv: Column, openalex: Column, title: Column) -> Column:
    """The strongest identifier there is, with its kind in front."""
    tagged = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{tag}:"), F.lower(c)))
    return F.coalesce(tagged("doi", normal_doi(doi)), tagged("arxiv", arxiv), tagged("openalex", openalex), tagged("title", normal_title(title)))


def apa_author(name: Column) -> Column:
    """First Middle Last -> Last, F. M."""
    parts = F.split(F.trim(name), r"\s+")
    given = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit(".")))
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) < 2, last).otherwise(F.concat_ws(", ", last, F.array_join(given, " ")))


def apa_authors(authors: Column) -> Column:
    n = F.size(authors)
    last = F.element_at(authors, -1)
    some = lambda k: F.array_join(F.slice(authors, 1, k), ", ")
    return (
        F.when(F.coalesce(n, F.lit(0)) <= 0, "Unknown Author")
        .when(n == 1, F.get(authors, F.lit(0)))
        .when(n <= 20, F.concat(some(F.greatest(n - 1, F.lit(1))), F.lit(", & "), last))
        .otherwise(F.concat(some(F.lit(19)), F.lit(", ... "), last))
    )


def apa_reference(authors: Column, year: Column, title: Column, venue: Column, volume: Column, issue: Column, pages: Column, doi: Column) -> Column:
    when = F.when(F.coalesce(year, F.lit(0)) > 0, F.concat(F.lit("("), year.cast("string"), F.lit(")"))).otherwise("(n.d.)")
    name = F.trim(F.coalesce(title, F.lit("Untitled")))
    name = F.when(name.endswith("."), name).otherwise(F.concat(name, F.lit(".")))
    numbers = F.when(volume.isNotNull(), F.concat(volume.cast("string"), F.when(issue.isNotNull(), F.concat(F.lit("("), issue.cast("string"), F.lit(")"))).otherwise("")))
    details = F.concat_ws(", ", venue, numbers, pages)
    source = F.when(details != "", F.concat(F.lit(" "), details, F.lit("."))).otherwise("")
    link = F.when(doi.isNotNull(), F.concat(F.lit(" https://doi.org/"), doi)).otherwise("")
    return F.concat(apa_authors(authors), F.lit(" "), when, F.lit(". "), name, source, link)


def short_citation(surnames: Column, year: Column) -> Column:
    n = F.size(surnames)
    who = F.when(n > 2, F.concat(F.get(surnames, F.lit(0)), F.lit(" et al."))).when(n == 2, F.array_join(surnames, " & ")).when(n == 1, F.get(surnames, F.lit(0))).otherwise("Unknown")
    return F.concat(F.lit("("), who, F.lit(", "), F.coalesce(year.cast("string"), F.lit("n.d.")), F.lit(")"))


def reference_surname(reference: Column) -> Column:
    found = F.regexp_extract(reference, r"^([A-Za-zÀ-ÿ\-']+),", 1)
    return F.when(found != "", found)


def author_list(text: Column) -> Column:
    """Authors of a line: by semicolons, else 'Last, First' alone, else by commas and 'and'."""
    clean = F.regexp_replace(text, r"\s+(?:and|&)\s+", ", ")
    parts = F.when(text.contains(";"), F.split(text, r"\s*;\s*")).when(
        text.rlike(r"^[^,\s]+,\s*[^,\s]+$"), F.transform(F.array(F.split(text, r",\s*")), lambda p: F.concat_ws(" ", F.get(p, F.lit(1)), F.get(p, F.lit(0))))
    ).otherwise(F.split(clean, r"\s*,\s*(?:and\s+)?"))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) > 1)


def pdf_year(value: Column) -> Column:
    year = F.regexp_extract(value, r"(?:D:)?((?:19|20)\d{2})", 1)
    return F.when(year != "", year.cast("int"))


def generic_title(title: Column) -> Column:
    """Titles that say nothing (fixed words)."""
    return F.coalesce(F.lower(title).rlike("untitled|microsoft word|document|powerpoint") | (F.length(F.trim(title)) < 5), F.lit(True))


def record_id(user: Column, checksum: Column, by_hand: Column, doi: Column, arxiv: Column, title: Column) -> Column:
    """The identifier of a record: a user's own document by checksum or title, one imported by hand by checksum, else by DOI, arXiv id or title."""
    has = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    plain = F.concat(F.lit("title:"), F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")))
    own = F.concat(F.lit("user:"), user, F.lit(":"), F.when(has(checksum), F.concat(F.lit("manual:"), checksum)).otherwise(plain))
    return (
        F.when(has(user), own)
        .when(has(checksum) & F.coalesce(by_hand, F.lit(False)), F.concat(F.lit("manual:"), checksum))
        .when(has(doi), F.concat(F.lit("doi:"), F.lower(doi)))
        .when(has(arxiv), F.concat(F.lit("arxiv:"), F.lower(arxiv)))
        .otherwise(plain)
    )


def extraction_confidence(sources: Column) -> Column:
    """high from four sources with the file's own metadata among them, medium from two, else low."""
    n = F.coalesce(F.size(sources), F.lit(0))
    own = F.coalesce(F.exists(sources, lambda s: F.contains(s, F.lit("pdf_metadata"))), F.lit(False))
    return F.when((n >= 4) & own, "high").when(n >= 2, "medium").otherwise("low")


def doi_of_dump(doi: Column) -> Column:
    """A dump's DOI: small letters, without ``doi:`` and then without a link to doi.org; null is empty."""
    low = F.lower(F.trim(F.coalesce(doi, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, "^doi:", ""), "^https?://doi[.]org/", "")


def doi_of_link(doi: Column) -> Column:
    """A DOI as it is written, without the one prefix it has, in whatever letters."""
    return F.trim(F.regexp_replace(F.trim(doi), r"(?i)^(https?://(dx\.)?doi\.org/|doi:)", ""))


def doi_of_any_file(name: Column) -> Column:
    """10.x_suffix -> 10.x/suffix at the first underscore; any other name as it is, without ``.pdf``."""
    stem = F.regexp_replace(name, r"\.pdf|\.PDF", "")
    return F.when(stem.startswith("10.") & F.contains(stem, F.lit("_")), F.regexp_replace(stem, "^([^_]*)_", "$1/")).otherwise(stem)


def arxiv_of_file(name: Column) -> Column:
    """The arXiv id that is the whole name of a file, with ``arXiv-`` in front or not; else null."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.pdf|\.PDF", ""), "^(arXiv|arxiv)-", "")
    return F.when(stem.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), stem)


def arxiv_of_link(text: Column) -> Column:
    """An arXiv id from an id or a link to its page or file; old ids and versions stay."""
    inner = F.regexp_extract(text, r"(?:abs|pdf)/(.+?)(?:\.pdf)?$", 1)
    return F.regexp_replace(F.trim(F.when(F.contains(text, F.lit("arxiv.org")) & (inner != ""), inner).otherwise(text)), r"\.pdf$", "")


def openalex_id(text: Column) -> Column:
    """W and digits from a link, an id, or digits alone; null for anything else."""
    bare = F.trim(text)
    last = F.when(F.contains(bare, F.lit("openalex.org")), F.element_at(F.split(F.regexp_replace(bare, "/+$", ""), "/"), -1)).otherwise(bare)
    made = F.when(last.rlike(r"^\d+$"), F.concat(F.lit("W"), last)).otherwise(last)
    return F.when(made.rlike(r"^W\d+$"), made)
