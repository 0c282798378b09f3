"""Sections, citations, first pages, facts; positions in long groups; context; breaker."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium import catalog
from scriptorium.functions import facts as K
from scriptorium.functions import text as X
from scriptorium.operators import context
from scriptorium.operators.series import at_shares, placed, with_previous
from scriptorium.streaming.breaker import CLOSED, HALF_OPEN, OPEN, advance


def of(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("c")).first()["c"]


def test_sections(spark):
    md = "front\n# Summary\nfirst\n## Materials and Methods\nhow\n### Unrelated\nx\n# ABSTRACT of it\nsecond"
    assert [tuple(s) for s in of(spark, X.markdown_sections, md)] == [("abstract", "first"), ("methods", "how"), ("abstract", "second")]
    assert of(spark, X.markdown_sections, "no headings") == []
    assert of(spark, X.second_level_parts, "intro\n## One\na\n### deeper\n## Two\nb\n") == ["intro", "## One\na\n### deeper", "## Two\nb"]
    assert of(spark, X.second_level_parts, " \n ") == []
    plain = lambda t: F.struct(*[c.alias(n) for n, c in X.plain_sections(t, 12).items()])
    got = of(spark, plain, "ABSTRACT: Bridges age.\nIntroduction\nWe ask why exactly. Methods: surveys Results none").asDict()
    assert got["abstract"] == "Bridges age." and got["introduction"] == "We ask why e" and got["methods"] == "surveys" and got["results"] == "none"
    assert got["discussion"] is None and got["conclusion"] is None


def test_citations_and_points(spark):
    text = "Ramps help (Quist, 2011). As Olu and Brandt (1999) say [4]. Others disagree [4]. See (Moreau et al., 2020)! Nothing here."
    assert of(spark, X.citations, text) == ["(Moreau et al., 2020)", "(Quist, 2011)", "Olu and Brandt (1999)", "[4]"]
    assert of(spark, X.key_points, text) == ["Ramps help (Quist, 2011).", "See (Moreau et al., 2020)!"]
    assert of(spark, X.key_points, "x" * 120 + " (Quist 2011).")[0] == "x" * 100 + "..."


@pytest.mark.parametrize("head", ["## Wet Roads (a+b)\n\n", "wet roads (A+B) \n", "**Wet Roads (a+b)**\n\n\n", ""])
def test_title_goes(spark, head):
    assert of(spark, lambda t: X.without_title(t, F.lit("Wet Roads (a+b)")), head + "Body\nWet Roads (a+b)\nstays") == "Body\nWet Roads (a+b)\nstays"


def test_first_page(spark):
    page = "Journal of Paving\n\n# A study of gravel under heavy rain\nIda B. Quist, Tor Moreau and Ana de la Cruz Olu\nCopyright 1931\nReceived: March 1987\nAbstract: " + "Gravel moves when it rains hard. " * 3 + "\nKeywords: gravel"
    assert of(spark, X.first_page_title, page) == "A study of gravel under heavy rain"
    assert of(spark, lambda t: X.first_page_year(t, 2025), page) == 1987
    assert of(spark, X.first_page_abstract, page) == ("Gravel moves when it rains hard. " * 3).strip()
    assert of(spark, X.first_page_authors, page)[:2] == ["Ida B. Quist", "Tor Moreau"]
    assert of(spark, X.first_page_title, "") is None and of(spark, X.first_page_abstract, "") is None
    assert of(spark, X.title_of_file, "10.5555_abc_d") == "[DOI: 10.5555/abc_d]" and of(spark, X.title_of_file, "wet__roads-2") == "wet roads 2"
    assert of(spark, X.feedback, " a\x00b\x1bc\n" + "z" * 2000) == " abc\n".strip() + "\n" + "z" * 993


def test_facts(spark):
    assert [of(spark, K.methodology, m) for m in ("Review", "a CONCEPTUAL frame", "poll", None)] == ["review", "theoretical", "other", "other"]
    assert [of(spark, K.certainty, m) for m in ("LOW", "maybe", None)] == ["low", "moderate", "moderate"]
    sign = lambda f: of(spark, lambda t: K.search_signature(t, F.lit("Ramps "), f), " OpenAlex")
    a = F.create_map(F.lit("type"), F.array(F.lit("b"), F.lit("A")), F.lit("max_year"), F.array(F.lit("1")))
    b = F.create_map(F.lit("max_year"), F.array(F.lit("9")), F.lit("type"), F.array(F.lit("a"), F.lit("B")))
    assert sign(a) == sign(b)
    assert of(spark, lambda t: K.proofread(t, F.lit("short"), F.lit(" 0123456x ")), "0123456789") == "0123456x"
    assert of(spark, lambda t: K.proofread(t, F.lit("short"), F.lit("s")), "0123456789") == "0123456789"
    low = lambda a, b: tuple(spark.range(1).select(*K.paper_target(F.lit(25), F.lit(a).cast("int"), F.lit(b).cast("int"))).first())
    assert low(None, None) == (25, 15, 35, None) and low(5, 10) == (7, 5, 10, "narrow") and low(40, 60) == (50, 40, 60, "wide")


def test_series(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "a", "a", "b", None]), i, float(draw.randrange(300))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, i long, v double")
    groups = {k: [r for r in rows if r[0] == k] for k in ("a", "b", None)}
    got = {r["i"]: (r["place"], r["group_rows"]) for r in placed(df, ["k"], F.floor(F.col("i") / 16), ["i"]).collect()}
    assert got == {r[1]: (p, len(g)) for g in groups.values() for p, r in enumerate(g)}
    before = {r["i"]: r["previous"] and r["previous"]["v"] for r in with_previous(df, ["k"], F.floor(F.col("i") / 16), ["i"], ["v"]).collect()}
    assert before == {r[1]: g[p - 1][2] if p else None for g in groups.values() for p, r in enumerate(g)}
    shares = [0.0, 0.5, 0.99]
    got = {r["k"]: r["values"] for r in at_shares(df, "k", "v", shares, 10.0).collect()}
    assert got == {k: [sorted(r[2] for r in g)[min(int(len(g) * s), len(g) - 1)] for s in shares] for k, g in groups.items()}
    assert placed(df.limit(0), ["k"], F.floor(F.col("i") / 16), ["i"]).count() == 0


def brute_context(hits, per_group, groups, budget, least=200):
    seen, kept = {}, []
    for h in sorted(hits, key=lambda h: h["rank"]):
        seen[h["source"]] = seen.get(h["source"], 0) + 1
        if seen[h["source"]] <= per_group:
            kept.append(h)
    chosen = []
    for h in kept:
        own = set(h["words"])
        if not any(len(own & set(c["words"])) > 0.8 * len(own | set(c["words"])) for c in chosen):
            chosen.append(h)
    chosen = [h for h in chosen if h["source"] is not None]
    numbers, link = {}, {}
    for h in chosen:
        numbers.setdefault(h["source"], len(numbers) + 1)
        link.setdefault(h["source"], h["reference"] or f"https://doi.org/{h['source']}")
    parts, used, room = [], [], budget
    for h in sorted(chosen, key=lambda h: (numbers[h["source"]], h["rank"])):
        if numbers[h["source"]] > groups:
            continue
        ref = f"[{numbers[h['source']]}] {link[h['source']]}"
        part = f"{ref}\n{h['text']}"
        if len(part) > room:
            if room > least:
                parts.append(part[:room] + "...")
                used.append(ref)
            break
        parts.append(part)
        used.append(ref)
        room -= len(part)
    return "\n\n---\n\n".join(parts), len(parts), list(dict.fromkeys(used))


def test_context(spark):
    draw = random.Random(8)
    hits = []
    for q in range(12):
        for rank in range(1, 11):
            words = [f"w{draw.randrange(8)}" for _ in range(draw.choice([3, 6, 40]))]
            hits.append((q, rank, draw.choice(["s1", "s2", "s3", "s4", None]), sorted(set(words)), " ".join(words), draw.choice([None, "", f"Ref {rank}"])))
    names = ["query_id", "rank", "source", "words", "text", "reference"]
    df = spark.createDataFrame(hits, "query_id long, rank long, source string, words array<string>, text string, reference string")
    for budget, groups in ((400, 3), (10_000, 150)):
        got = {r["query_id"]: (r["context"], r["used"], r["references"]) for r in context.assemble(df, "source", "words", "text", "reference", 2, groups, budget, 50).collect()}
        want = {q: brute_context([dict(zip(names, h, strict=True)) for h in hits if h[0] == q], 2, groups, budget, 50) for q in range(12)}
        assert got == {q: w for q, w in want.items() if w[1]}


def test_breaker(spark, sf):
    held = (CLOSED, 0, float("-inf"), float("-inf"))
    told = []
    for at, bad in ((0, True), (10, False), (20, True), (30, False), (321, False), (400, False), (410, True), (420, True), (800, True), (900, False), (1101, False)):
        held = advance(held, at, bad, 2, 300, 60)
        told.append(held[0])
    assert told == [CLOSED, CLOSED, OPEN, OPEN, CLOSED, CLOSED, CLOSED, OPEN, OPEN, OPEN, CLOSED]
    assert advance((OPEN, 5, 0.0, 290.0), 301.0, False, 5, 300, 60)[0] == HALF_OPEN

    events = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type").orderBy("us", "event_id").collect()
    want, by = {}, {}
    for e in events:
        by[e["user_id"]] = advance(by.get(e["user_id"], (CLOSED, 0, float("-inf"), float("-inf"))), e["us"] / 1e6, e["event_type"] == "error", 2, 43_200.0, 21_600.0)
        want[e["event_id"]] = by[e["user_id"]][0]
    assert {r["event_id"]: r["state"] for r in catalog.QUERIES["stream_breaker_states"](spark, sf).collect()} == want
    assert set(want.values()) >= {CLOSED, OPEN}


def test_chunks_of_a_text_without_sentences():
    from scriptorium.operators.chunks import chunk_text

    made = chunk_text("word " * 5000, 800, 150, 100)
    assert len(made) > 6 and max(len(c.split()) for c in made) <= 950


def test_nearest_of_vectors_of_two_lengths(spark):
    from scriptorium.operators.search import nearest

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.0, 0.5]), (3, [1.0])], "query_id long, query_vector array<double>")
    assert sorted((r.query_id, r.vec_id) for r in nearest(vectors, queries, 5).collect()) == [(1, 1), (1, 2), (2, 3)]


def test_json_lines_without_a_cache(spark, tmp_path):
    from scriptorium.sources.readers import read_json_lines

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{"a": \n\n{"a": 2}\nnot json\n')
    good, bad = read_json_lines(spark, str(tmp_path), "a long")
    assert sorted(r.a for r in good.collect()) == [1, 2] and sorted(r[0] for r in bad.collect()) == ["not json", '{"a": ']
