import random
import re

from scriptorium.operators import proximity


def slow(text, surname):
    return bool(re.search(rf"\b{re.escape(surname)}\b.{{0,30}}\b(19|20)\d{{2}}\b", text.lower()))


def test_mentions_by_pattern():
    r = random.Random(1)
    bits = ["Smith", "Smith-Jones", "O'Brien", "Müller", "et al.", "2019", "(2020)", "1850", "20199", "\n", ", ", " ", "x" * 12, "van", "_", "smith2", "-", "'"]
    names = ["smith", "smith-jones", "jones", "o'brien", "brien", "müller", "van"]
    for _ in range(1500):
        text = "".join(r.choice(bits) + r.choice(["", " ", " "]) for _ in range(r.randint(1, 14)))
        found = {s for s, _, _ in proximity.mentions_of(text)}
        for name in names:
            assert (name in found) == slow(text, name), (text, name)


def test_gap_and_year():
    assert proximity.mentions_of("Doe (2019)") == [("doe", 2019, 2)]
    assert proximity.mentions_of("Doe 2019 2021") == [("2019", 2021, 1), ("doe", 2019, 1), ("doe", 2021, 6)]
    assert proximity.mentions_of("Doe" + "." * 31 + "2019") == [] and proximity.mentions_of("Doe" + "." * 30 + "2019") == [("doe", 2019, 30)]
    assert proximity.mentions_of("") == []


def test_lists_of_answers(spark):
    refs = ["Smith, J. (2020). One.", "no name", "Ünal, B. (2019). Two.", "Brown, C. (2018). Three.", "Smith, J. (2020). One."]
    lists = [(k, i + 1, t) for k in (1, 2, 3, None) for i, t in enumerate(refs)]
    texts = [(1, "As Smith et al. say, 2021, and [4]"), (2, None), (None, "[5] and [2]; Ünal (2019)")]
    made = proximity.split_references(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(lists, "k long, place int, reference string"), ["k"])
    cited = sorted(((r.k or 0), r.place) for r in made.collect() if r.cited)
    assert made.count() == len(lists) and cited == [(0, 3), (1, 1), (1, 4), (1, 5)]


def test_equal_references_share_the_first_number(spark):
    lists = spark.createDataFrame([(1, 1, "Aa, B. One."), (1, 2, "Cc, D. Two."), (1, 3, "Aa, B. One.")], "k long, place int, reference string")
    made = proximity.split_references(spark.createDataFrame([(1, "see [1]")], "k long, text string"), lists, ["k"])
    assert sorted((r.place, r.cited) for r in made.collect()) == [(1, True), (2, False), (3, True)]


def test_all_references_against_all_answers(spark, sf):
    from scriptorium.plans import rounds

    got = {(r.conv_id, r.turn, r.ref_id): (r.by_name, r.by_year, r.by_number) for r in rounds.references_in_answers(spark, sf).collect()}
    refs, answers, want = rounds._references(spark, sf).collect(), rounds._said(spark, sf).collect(), {}
    for r in refs:
        surname = r.reference.split(",")[0].lower()
        any_year, own = (re.compile(rf"\b{re.escape(surname)}\b.{{0,30}}\b{y}\b") for y in (r"(?:19|20)\d{2}", r.year))
        for a in answers if surname else ():
            low = a.text.lower()
            found = surname in low and bool(any_year.search(low)), surname in low and bool(own.search(low)), f"[{r.place}]" in a.text
            if found[0] or found[2]:
                want[a.conv_id, a.turn, r.ref_id] = found
    assert got == want and len(want) > 50


def test_pairs_are_made_once_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(proximity, "BLOCK", 3)
    refs = [(i, i + 1, "Smith, J. (2020). One.", 2000 + i) for i in range(20)] + [(50, 30, "Brown, C. Two.", None), (50, 31, "Green, C. Two.", 2001), (51, 40, "no name", 2000), (None, 41, "Brown, C. Three.", 2002), (None, 42, "Brown, C. Four.", 2001)]
    texts = [(1, "Smith 2003 and Smith (2004) [2] [30] [31]"), (1, "Smith (2005) [3]"), (2, "Brown 2001, Green 2001"), (None, "[1] [41]"), (3, None)]
    made = proximity.cited_pairs(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(refs, "ref_id long, place int, reference string, year int"), ["k"])
    got = {(r.k, r.ref_id): (r.by_name, r.by_year, r.by_number) for r in made.collect()}
    want = {(1, i): (True, i in (3, 4, 5), i in (1, 2)) for i in range(20)}
    want |= {(1, 50): (False, False, True), (2, 50): (True, True, False), (2, None): (True, True, False), (None, 0): (False, False, True), (None, None): (False, False, True)}
    assert got == want and made.count() == len(want)
    once = proximity.cited_pairs(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame(refs[:20], "ref_id long, place int, reference string, year int"), ["k"])
    plan = once._jdf.queryExecution().optimizedPlan().toString().split("Generate explode(refs")[0]
    assert "Aggregate" not in plan.split("Generate")[0]
