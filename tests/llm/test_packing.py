import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import packing, tokens


def brute(counts, capacity):
    """The number of bins of best-two-fit, a piece at a time."""
    left, bins = sorted((x for x, n in enumerate(counts) for _ in range(n)), reverse=True), 0
    while left:
        bin_, gap = [], capacity
        while fits := [x for x in left if x <= gap]:
            left.remove(fits[0])
            bin_.append(fits[0])
            gap -= fits[0]
        while gap and len(bin_) > 1:
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if min(bin_) < a + b <= gap + min(bin_)]
            if not pairs:
                break
            out = min(bin_)
            total, a, b = max(pairs)
            bin_.remove(out)
            left.remove(a)
            left.remove(b)
            left = sorted([*left, out], reverse=True)
            bin_ += [a, b]
            gap += out - total
        bins += 1
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 24), max_size=40))
def test_bins_hold_all_and_match_brute_force(lengths):
    counts = np.bincount(lengths, minlength=25) if lengths else np.zeros(25, dtype=int)
    bins = packing.best_two_fit(counts, 24)
    used = np.zeros(25, dtype=int)
    for times, bin_ in bins:
        assert sum(x * n for x, n in bin_) <= 24
        for x, n in bin_:
            used[x] += n * times
    assert (used == counts).all()
    assert abs(sum(t for t, _ in bins) - brute(counts, 24)) <= 1  # ties between pairs may differ


def test_pack_documents(docs):
    rows = packing.pack_documents(docs).toPandas()
    bpe, want = tokens.ByteBpe(), {}
    for r in docs.collect():
        ids = bpe._encode(r.text or "") + bytes(4)
        cuts = packing.cut_points(len(ids) // 4, 2048)
        assert sum(n for _, n in cuts) == len(ids) // 4 and all(n == 2048 for _, n in cuts[1:])
        want[r.doc_id] = sorted((s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for s, n in cuts)
    got = {}
    for r in rows.drop_duplicates(["doc_id", "piece"]).itertuples():
        got.setdefault(None if np.isnan(r.doc_id) else int(r.doc_id), []).append((r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == want
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= 2048
    assert rows["sequence_id"].nunique() <= -(-rows["length"].sum() // 2048) + 2


def test_empty(no_docs):
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("text", ["a  b", "a   b", " a", "a ", "a\n b", "x<|endoftext|>y <|endoftext|> z", "it's 's", "", "  ", "a　b", "a  b."])
def test_byte_bpe_matches_whole_text(text):
    bpe = tokens.ByteBpe()
    assert next(bpe.ids([text])) == bpe._encode(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab  \n\t'sÉ1.<|▁　 ,!", max_size=40))
def test_tokenisers_on_odd_texts(text):
    bpe, sp = tokens.shared(tokens.ByteBpe, None), tokens.shared(tokens.PieceCounter, None)
    assert next(bpe.ids([text])) == bpe._encode(text)
    assert sp.counts([text]) == [len(sp._sp.encode(text))]
