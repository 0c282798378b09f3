import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import biblio
from scriptorium.operators import matching, quantiles
from scriptorium.operators.search import nearest
from scriptorium.sources import uploads


def docx(body, name="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, f'<w:document xmlns:w="{uploads._W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_round_trip():
    r = random.Random(1)
    for _ in range(50):
        text = "".join(r.choice("aé漢<>&\"' \n\t\r🙂]") for _ in range(200)).strip()
        want = "\n\n".join(p for p in text.split("\n\n") if p.strip())
        assert uploads.docx_text(uploads.docx_bytes(text)) == want
        assert uploads.text_of("A.MD", text.encode()) == text


def test_paragraphs_of_a_body():
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = f"<w:p>{run('one')}<w:r><w:tab/></w:r>{run('two')}</w:p><w:p/><w:p>{run('  ')}</w:p><w:tbl><w:tr><w:tc><w:p>{run('cell')}</w:p></w:tc></w:tr></w:tbl><w:p><w:hyperlink>{run('link')}</w:hyperlink></w:p>"
    assert uploads.docx_text(docx(body)) == "one\ttwo\n\nlink"


@pytest.mark.parametrize(
    "path,content,why",
    [
        ("a.docx", b"no archive", "damaged"), ("a.docx", docx("<w:p>", "word/document.xml"), "damaged"), ("a.docx", docx("", "other.xml"), "damaged"), ("a.docx", docx("<w:p/>")[:-30], "damaged"),
        ("a.txt", b"\xff\xfe", "damaged"), ("a.pdf", b"%PDF-1.7", "unsupported"), ("a.txt", None, "no content"), ("a.txt", b"x" * (uploads.LARGEST + 1), "too large"),
    ],
)
def test_what_cannot_be_read(path, content, why):
    with pytest.raises(uploads.Unreadable, match=why):
        uploads.text_of(path, content)


def test_a_bomb_is_not_unpacked():
    bomb = docx("<w:p><w:r><w:t>" + "a" * 3_000_000 + "</w:t></w:r></w:p>")
    assert len(bomb) < 20_000
    with pytest.raises(uploads.Unreadable, match="too much"):
        uploads.docx_text(bomb, most=1_000_000)


def test_folder_as_batch_and_stream(spark, tmp_path):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.txt").write_bytes("gründlich\n".encode())
    (folder / "b.docx").write_bytes(uploads.docx_bytes("one\n\ntwo"))
    (folder / "c.docx").write_bytes(b"PK")
    (folder / "d.md").write_bytes(b"  ")
    want = {"a.txt": ("gründlich\n", None), "b.docx": ("one\n\ntwo", None), "c.docx": (None, "damaged: BadZipFile"), "d.md": (None, "empty")}
    named = lambda rows: {r.path.rpartition("/")[2]: (r.text, r.error) for r in rows}
    assert named(uploads.read_uploads(spark, str(tmp_path / "in")).collect()) == want
    q = uploads.read_uploads(spark, str(tmp_path / "in"), stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert named(spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_first_match_is_the_strongest(spark):
    r = random.Random(2)
    pick = lambda: r.choice([None, "", *"abcdefgh"])
    old = [(i, r.choice(["embedded", "new"]), pick(), pick(), pick()) for i in range(12)]
    new = [(100 + i, pick(), pick(), pick()) for i in range(60)]
    keys = {k: (F.col(k), F.col(k)) for k in ("x", "y", "z")}
    known = spark.createDataFrame(old, "id long, status string, x string, y string, z string")
    made = {m.id: (m.matched_by, m.matched, m.status) for m in matching.first_match(spark.createDataFrame(new, "id long, x string, y string, z string"), known, keys).collect()}
    for i, *own in new:
        want = (None, None, None)
        for k, name in enumerate("xyz"):
            hits = [o for o in old if own[k] and o[2 + k] == own[k]]
            if hits:
                want = (name, min(hits)[0], min(hits)[1])
                break
        assert made[i] == want
    assert len(made) == len(new)


def test_merges(spark):
    rows = [(3, "k", "s", None, None, "W3", "u3", "", "short", 5), (1, "k", "s1", None, "2101", None, None, None, None, 9), (2, "k", "t", "10.1/x", "9999", None, "u2", "A; B", "longer", 1), (4, "j", "t", "", "", "", "", "", "", None)]
    df = spark.createDataFrame(rows, "id long, uid string, source string, doi string, arxiv string, openalex string, pdf_url string, authors string, abstract string, citations long")
    got = {r.uid: r for r in matching.smart_merged(df, "uid").collect()}
    k = got["k"]
    assert (k.first_id, k.n, k.doi, k.arxiv, k.openalex, k.pdf_url, k.authors, k.abstract, k.citations, k.sources) == (1, 3, "10.1/x", "2101", "W3", "u2", "A; B", "longer", 9, "s1|t")
    assert (got["j"].doi, got["j"].abstract, got["j"].sources) == (None, None, "t")


def test_identifiers(spark):
    lit = F.lit
    none = lit(None).cast("string")
    ids = [
        biblio.record_id(lit("u1"), lit("c"), lit(True), lit("10.1/A"), none, lit("T")), biblio.record_id(lit("u1"), none, lit(False), lit("10.1/A"), none, lit("A  Straße: (1)")), biblio.record_id(none, lit("c"), lit(True), lit("10.1/A"), none, lit("T")),
        biblio.record_id(none, lit("c"), lit(False), lit("10.1/A"), none, lit("T")), biblio.record_id(none, none, lit(None).cast("boolean"), none, lit("2101.1V2"), lit("T")), biblio.record_id(none, none, lit(False), lit(""), none, none),
    ]
    assert tuple(spark.range(1).select(*ids).first()) == ("user:u1:manual:c", "user:u1:title:a straße 1", "manual:c", "doi:10.1/a", "arxiv:2101.1v2", "title:")
    sources = [["pdf_metadata", "a", "b", "c"], ["a", "b", "c", "d"], ["a", "b"], ["a"], None]
    df = spark.createDataFrame([(s,) for s in sources], "s array<string>")
    assert [r[0] for r in df.select(biblio.extraction_confidence(F.col("s"))).collect()] == ["high", "medium", "medium", "low", "low"]


def test_component_bounds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 5)) * np.array([1, 0.1, 10, 0, 3])
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(9000, None), (9001, [1.0]), (9002, [float("nan"), float("inf"), None, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    parts = [quantiles.component_sketches(df.filter(F.col("vec_id") % 3 == k)) for k in range(3)]
    clip = quantiles.clip_of(quantiles.bounds(quantiles.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))), 5)
    for k in (0, 1, 2, 4):
        assert abs((np.abs(x[:, k]) <= clip[k]).mean() - 0.99) < 0.012
    assert clip[3] == 0
    queries = df.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact, coded = (sorted(map(tuple, nearest(df, queries, 3, clip=c, skip_self=True).collect())) for c in (None, clip))
    assert exact == coded and len(exact) == 60
