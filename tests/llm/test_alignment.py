import hashlib
import random
from collections import Counter

import duckdb
import pytest

from scriptorium.llm import queries, token_alignment, tokens

ODD = [
    "a  b", " a", "a ", "  ", "\n", "\n\nx y\n z", "tab\tand space \t mixed", "▁", "a ▁b c", "x▁y", "<|endoftext|> is text", "it's <s> </s> <unk> <0x0A>", "漢字かな 交じり文", "🙂🙂 👩‍👩‍👧 ok",
    "été  nbsp  x", "　wide　 space", "a" * 5000, "ab" * 3001 + " c", "-" * 777 + "x" + "-" * 1001, "don't we'll I'm 'quoted'", "1234567 12,345.678", "x\x00y z", "\x1c a \x1d b", "ﬁ ligature", "Ω≈ç√∫ ∆˚", " ​ zero width",
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(tokens.default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokens.default_path("piece_bpe_32k.model"))


def byte_of_sign():
    kept = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b < 127 or 161 <= b != 173 and b > 127]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}


def plain(texts, a, b):
    """The contract for (id, text) rows, text by text."""
    sign, measured, docs = byte_of_sign(), [], Counter()
    for _, text in texts:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(sign[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                i = j = at_a = at_b = 0
                ga, gb = [], []
                while i < len(ids_a) or j < len(ids_b):
                    if at_a <= at_b:
                        ga.append(ids_a[i])
                        at_a += len(bytes_a[i])
                        i += 1
                    else:
                        gb.append(ids_b[j])
                        at_b += len(bytes_b[j])
                        j += 1
                    if at_a == at_b:
                        groups.append((ga, gb))
                        ga, gb = [], []
        links = Counter()
        for x, y in groups:
            cx, cy = Counter(x), Counter(y)
            for p, n in cx.items():
                for q, m in cy.items():
                    links[p, q] += n * m
        docs.update(links.keys())
        measured.append((groups, links))
    best = {}
    for (p, _), n in docs.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for (doc, _), (groups, links) in zip(texts, measured, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for k, n in links.items() if docs[k] == best[k[0]]), sum(n * docs[k] for k, n in links.items()), digest))
    return sorted(out, key=str), docs


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot,shard", [(500_000, 500_000), (40, 100), (0, 50)])
def test_against_whole_texts(spark, docs, libraries, hot, shard):
    r = random.Random(7)
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(100 + k, t) for k, t in enumerate(ODD)]
    texts += [(300 + k, "".join(r.choice(["a", "B", " ", "  ", "\n", "é", "漢", "'s", "▁" if k % 9 == 0 else ".", "12", "\t", "the"]) for _ in range(60))) for k in range(150)]
    texts += [(600 + k, "the same text for a third of all") for k in range(90)]
    made, links = token_alignment.align_corpus(spark.createDataFrame([(*t, "x", 1) for t in texts], "doc_id long, text string, key string, n int"), hot_pairs=hot, shard_pairs=shard)
    want, docs_of = plain(texts, *libraries)
    assert made.columns == COLUMNS
    assert sorted((tuple(x) for x in made.collect()), key=str) == want
    assert {(x.a, x.b): x.docs for x in links.collect()} == docs_of


def test_large_groups_by_distinct_ids(libraries):
    text = "x" + "-" * 4001 + "y ok"
    sums, groups, pairs, times = token_alignment.Aligner().align([text, "ok"])
    limit, token_alignment.LARGE_GROUP = token_alignment.LARGE_GROUP, 0
    try:
        again = token_alignment.Aligner().align([text, "ok"])
    finally:
        token_alignment.LARGE_GROUP = limit
    assert (sums == again[0]).all() and groups == again[1]
    assert all((x == y).all() for k in (2, 3) for x, y in zip((sums, groups, pairs, times)[k], again[k], strict=True))


def test_forgetting_changes_nothing(docs):
    texts = [r.text for r in docs.collect() if r.text] + [t for t in ODD if t] + [f"again {k % 7} and once {k}" for k in range(200)]
    whole, small = token_alignment.Aligner(), token_alignment.Aligner()
    limit, token_alignment.CHUNKS = token_alignment.CHUNKS, 60
    try:
        made = [small.align([t]) for t in texts]
    finally:
        token_alignment.CHUNKS = limit
    assert len(small._at) < 2000
    for t, got in zip(texts, made, strict=True):
        want = whole.align([t])
        assert (got[0] == want[0]).all() and got[1] == want[1] and (got[2][0] == want[2][0]).all() and (got[3][0] == want[3][0]).all()


def test_query_and_empty_table(spark, sf, libraries, no_docs):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    made = queries.op11_token_alignment(spark, sf)
    assert sorted((tuple(x) for x in made.collect()), key=str) == plain(texts, *libraries)[0]
    assert token_alignment.align_corpus(no_docs)[0].count() == 0
