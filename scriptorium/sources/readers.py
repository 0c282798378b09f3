"""Sources: API dumps, Atom feeds, CSV dumps, JSON lines, folders of files.

Readers take a schema and push projections to the scan; malformed lines are kept
apart, not dropped silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import biblio

WORK = (
    "doi string, id string, display_name string, publication_year int, cited_by_count long, "
    "authorships array<struct<author: struct<display_name: string>>>, open_access: struct<is_oa: boolean, oa_url: string>, "
    "abstract_inverted_index map<string, array<int>>, primary_location struct<source: struct<display_name: string>>"
).replace("open_access: struct", "open_access struct")
PAPER = "source string, doi string, openalex_id string, arxiv_id string, title string, authors array<string>, year int, abstract string, venue string, citation_count long, pdf_url string"


def abstract_text(inverted: Column) -> Column:
    """Words at their positions, joined."""
    placed = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")


def _paper(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = dict(f.strip().split(" ", 1) for f in PAPER.replace("array<string>", "array<string>").split(","))
    return df.select(*[columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


def read_works(spark: SparkSession, path: str, untitled: bool = False) -> DataFrame:
    """Dump of a works API, one record a line; records without an identifier go, and those without a title unless ``untitled``."""
    raw = spark.read.schema(WORK).json(path)
    made = _paper(
        raw, source=F.lit("works"), doi=biblio.normal_doi(F.col("doi")), openalex_id=F.element_at(F.split("id", "/"), -1), title=F.col("display_name"),
        authors=F.slice(F.transform("authorships", lambda a: a["author"]["display_name"]), 1, 10), year=F.col("publication_year"), abstract=abstract_text(F.col("abstract_inverted_index")),
        venue=F.col("primary_location.source.display_name"), citation_count=F.col("cited_by_count"), pdf_url=F.when(F.col("open_access.is_oa"), F.col("open_access.oa_url")),
    )
    return made.filter("doi is not null" if untitled else "doi is not null and title is not null")


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed in XML files."""
    raw = spark.read.format("xml").option("rowTag", "entry").schema("id string, title string, summary string, published string, author array<struct<name: string>>").load(path)
    arxiv = F.regexp_replace(F.regexp_extract("id", r"/abs/(.+)$", 1), r"v\d+$", "")
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return _paper(
        raw, source=F.lit("atom"), arxiv_id=arxiv, title=squeeze("title"), abstract=squeeze("summary"), year=F.substring("published", 1, 4), authors=F.slice(F.transform("author", lambda a: a["name"]), 1, 10),
        pdf_url=F.concat(F.lit("https://arxiv.org/pdf/"), arxiv, F.lit(".pdf")),
    )


CROSSREF = (
    "DOI string, title array<string>, author array<struct<given: string, family: string>>, created struct<`date-parts`: array<array<int>>>, "
    "`container-title` array<string>, `is-referenced-by-count` long, abstract string"
)
SCHOLAR = (
    "paperId string, externalIds struct<DOI: string>, title string, authors array<struct<name: string>>, year int, venue string, abstract string, "
    "openAccessPdf struct<url: string>, isOpenAccess boolean, citationCount long"
)


def crossref_papers(raw: DataFrame) -> DataFrame:
    """Papers of records of schema ``CROSSREF``; those without a DOI go, a missing title is "Unknown Title"."""
    named = F.filter(F.transform("author", lambda a: F.struct(F.coalesce(a["given"], F.lit("")).alias("given"), a["family"].alias("family"))), lambda a: F.coalesce(F.length(a["family"]), F.lit(0)) > 0)
    return _paper(
        raw.filter("length(DOI) > 0"), source=F.lit("crossref"), doi=F.lower("DOI"), title=F.coalesce(F.get("title", F.lit(0)), F.lit("Unknown Title")),
        authors=F.transform(F.coalesce(named, F.array()), lambda a: F.trim(F.concat(a["given"], F.lit(" "), a["family"]))), year=F.get(F.get("created.date-parts", F.lit(0)), F.lit(0)),
        abstract=F.col("abstract"), venue=F.get("container-title", F.lit(0)), citation_count=F.coalesce("is-referenced-by-count", F.lit(0)),
    )


def scholar_papers(raw: DataFrame, years: tuple[int, int] | None = None, open_only: bool = False) -> DataFrame:
    """Papers of records of schema ``SCHOLAR`` in a range of years; ten authors at most; those without an id go."""
    kept = raw.filter("length(paperId) > 0")
    kept = kept.filter(F.col("year").between(*years)) if years else kept
    kept = kept.filter("isOpenAccess") if open_only else kept
    names = F.filter(F.transform(F.slice("authors", 1, 10), lambda a: a["name"]), lambda n: F.coalesce(F.length(n), F.lit(0)) > 0)
    return _paper(
        kept, source=F.lit("semantic_scholar"), doi=F.col("externalIds.DOI"), title=F.col("title"), authors=F.coalesce(names, F.array()), year=F.col("year"), abstract=F.col("abstract"),
        venue=F.col("venue"), citation_count=F.coalesce("citationCount", F.lit(0)), pdf_url=F.col("openAccessPdf.url"),
    )


def read_crossref(spark: SparkSession, path: str) -> DataFrame:
    return crossref_papers(spark.read.schema(CROSSREF).json(path))


def read_scholar(spark: SparkSession, path: str, years: tuple[int, int] | None = None, open_only: bool = False) -> DataFrame:
    return scholar_papers(spark.read.schema(SCHOLAR).json(path), years, open_only)


def by_dois(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """The papers whose DOI is in ``wanted`` (doi), in whatever form either is written."""
    keys = wanted.select(biblio.normal_doi(F.col("doi")).alias("wanted_doi")).distinct()
    return papers.join(keys, biblio.normal_doi(papers["doi"]) == F.col("wanted_doi"), "left_semi")


# Publication type, its terms in the works API, Crossref and Semantic Scholar.
PUBLICATION_TYPES = (
    ("journal_article", "type:article,primary_location.source.type:journal", "journal-article", "JournalArticle"),
    ("conference_paper", "type:conference-proceedings", "proceedings-article", "Conference"),
    ("preprint", "type:preprint", "posted-content", "Preprint"),
    ("book", "type:book", "book", "Book"),
    ("book_chapter", "type:book-chapter", "book-chapter", "BookChapter"),
    ("review", "type:review", "journal-article", "Review"),
    ("report", "type:report", "report", None),
    ("dataset", "type:dataset", "dataset", None),
    ("editorial", "type:editorial", "journal-article", "Editorial"),
    ("thesis", "dissertation|thesis", "dissertation", None),
    ("clinical_trial", None, None, "ClinicalTrial"),
    ("letter", "type:letter", "journal-article", "LettersAndComments"),
    ("standard", "type:standard", "standard", None),
)
APIS = ("works", "crossref", "semantic_scholar")


def source_term(kind: Column, api: Column) -> Column:
    """The term of a publication type at an API, null where it has none; an unknown type or API is an error."""
    terms = {f"{row[0]}@{a}": t for row in PUBLICATION_TYPES for a, t in zip(APIS, row[1:], strict=True)}
    table = F.create_map(*[F.lit(x) for item in terms.items() for x in item])
    key = F.concat(kind, F.lit("@"), api)
    return F.when(F.coalesce(F.map_contains_key(table, key), F.lit(False)), F.try_element_at(table, key)).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(key, F.lit("null")))))


def read_csv_dump(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and quoted line breaks; the column ``doi`` in normal form."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"').withColumn("doi", biblio.normal_doi(F.col("doi")))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that don't parse; each is a scan of its own."""
    read = F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    raw = spark.read.text(path).filter(F.trim("value") != "").select(read.alias("r"), "value")
    return raw.filter("r._corrupt_record is null").select("r.*").drop("_corrupt_record"), raw.filter("r._corrupt_record is not null").select(F.col("value").alias("_corrupt_record"))


def append_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, checksum, id key of a folder's files; content is only read for the checksum."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    doi, arxiv = biblio.doi_from_filename(name), biblio.arxiv_id(name)
    key = F.coalesce(F.concat(F.lit("doi:"), doi), F.concat(F.lit("arxiv:"), arxiv), F.concat(F.lit("file:"), name))
    return raw.select("path", "length", F.sha2("content", 256).alias("checksum"), key.alias("key"))


def best_location(best: Column, all_: Column) -> Column:
    """The named best location, else the first with a PDF, else the first."""
    return F.coalesce(best, F.get(F.filter(all_, lambda x: x["url_for_pdf"].isNotNull()), F.lit(0)), F.get(all_, F.lit(0)))


def usable_pdf(content: Column) -> Column:
    """The magic bytes and at least 1000 bytes."""
    return F.coalesce((F.octet_length(content) >= 1000) & (F.hex(F.substring(content, 1, 5)) == "255044462D"), F.lit(False))


def first_download(contents: dict[str, Column]) -> Column:
    """The name of the first source whose file is usable, in the order given; null if none is."""
    return F.coalesce(*[F.when(usable_pdf(c), name) for name, c in contents.items()])


def filename_of(doi: Column, arxiv: Column, title: Column) -> Column:
    return F.concat(F.coalesce(F.translate(doi, "/:", "__"), F.concat(F.lit("arxiv_"), arxiv), F.substring(F.md5(title), 1, 12)), F.lit(".pdf"))


def union_sources(*papers: DataFrame) -> DataFrame:
    out = papers[0]
    for p in papers[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
