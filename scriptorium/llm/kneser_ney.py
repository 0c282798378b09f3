"""Quality classifier: an interpolated modified Kneser-Ney model, scored by sharded count joins.

Tokens are the words and signs of a text; digits count as 0, and a token that begins a
sentence is one of its own; every text begins and ends with a mark of its own.  The model
of trusted texts (labelled good and not toxic) interpolates word bigrams, words and spelling:

    P(w | v) = max(n(v, w) - D(n(v, w)), 0) / t(v)  +  G(v) * P(w)
    P(w)     = max(c(w) - D'(c(w)), 0) / C  +  B * S(w)

n(v, w) counts the bigram and t(v) the word, c(w) the distinct words before w and C all of
these, D and D' are the three modified discounts of each order, and G(v) and B the mass that
is left.  S spells w by its bytes: a Kneser-Ney trigram model whose counts are continuation
counts, one for each distinct word.  Counts come from all trusted texts, whole, and grow with
them.  Bigrams that occur once in all are left to the words below them (``LEAST_PAIR``, the usual
cut-off of the highest order; their mass stays in G).

A document has two scores.  Its perplexity is 2 to the mean bits a byte.  Its worst word
is the largest G-statistic, in bits, of the words' counts in rejected (labelled, not
trusted) against trusted texts, over what a word half-way to being theirs alone would have; copies give a word no weight, as a word's evidence is
scaled down to the number of distinct words before it in rejected texts, the count that
Kneser-Ney continuation rests on.  The mean does not see a few insults in ordinary prose;
the worst word does.

Scoring.  The bits of a text are a sum over its words, as they follow (P) and as they lead (G),
less what each bigram that has counts saves against that, so words and bigrams are looked up each
by itself.  Counts are sharded by the hash of the word or bigram.  A task scores the ``HOT`` most
frequent words and ``HOT_PAIRS`` bigrams itself (a broadcast of bounded size) and packs its
documents' other words and bigrams by shard, a few bytes each, if they may have counts (bit
maps of ``PAIR_BITS`` bits rule out others); a shard joins them to its counts and returns what
they change, packed by the task's documents.  No text is shuffled.  The documents' own rows go
the same way, so that one scan without a table of its own does; their numbers hold as long as a
task that is run again reads its rows in the same order, as from stored tables.

A document is kept while both scores are at most their language's quantiles over trusted
documents, each half of which is scored by the counts of the other half, as a text that a
model has seen looks better than one it hasn't.  A language with fewer than ``FEW`` trusted
documents uses the quantiles over all trusted documents where those are larger.

Defined results: a null text, or one without words, has no perplexity and is not kept;
without trusted documents nothing can be judged and every text with words is kept;
repeated rows are judged alike; a null language is a language of its own; a document with
several labels is trusted if all of them trust it; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import gc
import pickle
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import tokens
from scriptorium.session import cut, drop_cut, input_bytes, small_batches

QUANTILE = 0.995
WORST_QUANTILE = 0.99
FEW = 200  # trusted documents whose quantile isn't relied upon alone
#: Words that tasks score themselves; none is longer than HOT_BYTES, which bounds the broadcast.
HOT = 200_000
HOT_BYTES = 64
#: Bigrams that tasks score themselves (20 bytes each), and the size of the bit maps of words and of bigrams that have counts.
HOT_PAIRS = 400_000
PAIR_BITS = 26
#: Occurrences of a bigram in all trusted texts, below which the words below it stand for it.
LEAST_PAIR = 2
#: Bound of the broadcast set of labelled ids.
LABEL_ROWS = 5_000_000
#: Input bytes (as stored) for each shard of words.
SHARD_BYTES = 8 << 20
CONTEXTS = 64  # hashed words before a word, kept as the bits of a number
BEGIN, END = " (", " )"  # no token of a text has a space
_TOKENS = 2_000_000  # tokens whose bigrams a counting task holds before it writes them out
_LOW48 = (1 << 48) - 1  # bigrams name their words by so many bits
_PAIR_BYTES = 14
_WORDS = 300_000  # distinct words a counting task holds before it writes them out
_ENTRIES = 600_000  # words a scoring task holds before it writes them out
_DOCS = 30_000  # and documents; an entry numbers them in 15 bits
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_SIGN = re.compile(r"([,;:.!?])")
_ENTRY = np.dtype([("word", "<i8"), ("n", "<u2"), ("doc", "<u2")])
_CHANGE = np.dtype([("doc", "<u2"), ("bits", "<f4"), ("held", "<f4"), ("worst", "<f4"), ("held_worst", "<f4")])


def words_of(text: str) -> list[str]:
    """The tokens of a text; the first of a sentence begins with a mark."""
    text = text.strip().encode().translate(_DIGITS).decode()
    if not text:
        return []
    for end in (". ", "! ", "? ", "\n"):
        text = text.replace(end, end + "\x02")
    for sign in ",;:.!?":
        text = text.replace(sign, f" {sign} ")
    return ("\x02" + text).split()


def word_hash(word: bytes) -> int:
    """What xxhash64 of Spark gives for the string."""
    n = xxhash.xxh64_intdigest(word, 42)
    return n - (1 << 64) if n >> 63 else n


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the counts of counts; 0.5, 1, 1.5 where those are too few to estimate."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(max(0.05, min(k - 0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


class Spelling:
    """A byte trigram model of words: bits of each word of a list.

    Fitted from trigram counts over distinct words, two spaces before a word and one
    behind it; at most 2**24 rows, by construction.
    """

    def __init__(self, grams: np.ndarray, n: np.ndarray):
        p = np.full((1, 256), 1 / 256)
        for order in (1, 2, 3):
            own, at = np.unique(grams & ((1 << (8 * order)) - 1), return_inverse=True)
            counts = np.bincount(at, n if order == 3 else None, len(own))
            if order < 3:  # distinct longer n-grams with this ending
                longer = np.unique(grams & ((1 << (8 * order + 8)) - 1)) & ((1 << (8 * order)) - 1)
                counts = np.bincount(np.searchsorted(own, longer), minlength=len(own))
            d = np.array(discounts(*(int((counts == k).sum()) for k in (1, 2, 3, 4))))
            off = d[np.minimum(counts, 3).astype(int) - 1] if len(own) else np.zeros(0)
            contexts = 1 << (8 * order - 8)
            total, held = np.bincount(own >> 8, counts, contexts), np.bincount(own >> 8, off, contexts)
            seen = total > 0
            back = np.where(seen, held / np.maximum(total, 1), 1).astype(np.float32)
            # rows: context; the shorter context's row is its low bytes'
            table = np.tile(p.astype(np.float32), (contexts // len(p), 1))
            table *= back[:, None]
            table[own >> 8, own & 255] += ((counts - off) / np.maximum(total[own >> 8], 1)).astype(np.float32)
            p = table
        np.log2(p, out=p)  # 64 MB in each worker: in place
        self.bits_of = np.negative(p, out=p).ravel()

    def bits(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        grams, ends = trigrams(words)
        return np.add.reduceat(self.bits_of[grams].astype(float), np.concatenate(([0], ends[:-1])))


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams that end at the bytes of each word and its end, and where each word's end."""
    data = np.frombuffer(b"  " + b"   ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    own = np.ones(len(grams), dtype=bool)
    between = (np.cumsum(sizes + 2) - 2)[:-1]
    own[between] = own[between + 1] = False
    return grams[own], np.cumsum(sizes)


def evidence(rejected: np.ndarray, trusted: np.ndarray, contexts: np.ndarray, share: float) -> np.ndarray:
    """Bits by which a word's counts speak against its being at most half as much a word of rejected texts as can be.

    Rejected texts hold ``share`` of all words; a word's share of them lies half-way between that and all of it.
    """
    r, t = rejected.astype(float), trusted.astype(float)
    if not 0 < share < 1:
        return np.zeros(len(r))
    share = (1 + share) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        g = r * np.log2(r / (r + t) / share) + np.where(t > 0, t * np.log2(t / (r + t) / (1 - share)), 0)
        distinct = CONTEXTS * np.log(CONTEXTS / np.maximum(CONTEXTS - contexts, 0.5))  # hashed contexts collide
        g *= np.minimum(1, distinct / r)
    return np.where((r > 0) & (r > share * (r + t)), g, 0.0)


class Counts:
    """Totals and discounts of words in the three sets of trusted counts: both halves, and all; by distinct words before them."""

    def __init__(self, row):
        self.rejected = row["rejected"] or 0
        self.trusted = [row[f"texts{k}"] or 0 for k in range(3)]
        self.total = [row[f"total{k}"] or 0 for k in range(3)]
        self.discount = [np.array((0.0, *discounts(*((row[f"of{k}_{n}"] or 0) for n in (1, 2, 3, 4))))) for k in range(3)]
        self.back = [sum(d * (row[f"has{k}_{n}"] or 0) for n, d in enumerate(self.discount[k][1:], 1)) / self.total[k] if self.total[k] else 1.0 for k in range(3)]

    def bits(self, k: int, n: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        p = np.maximum(n - self.discount[k][np.minimum(n, 3)], 0) / self.total[k] if self.total[k] else 0.0
        return -np.log2(p + self.back[k] * 2.0 ** -np.minimum(spelled, 900))

    def unseen(self, k: int, spelled: np.ndarray) -> np.ndarray:
        return np.minimum(spelled, 900) - np.log2(self.back[k])

    def evidence(self, k: int, n: np.ndarray, rejected: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        return evidence(rejected, n, contexts, self.rejected / max(1, self.rejected + self.trusted[k]))


def count_words(texts: DataFrame) -> DataFrame:
    """hash, word, n0, n1, rejected, t0, t1, contexts from rows (text, kind): texts of each kind (0, 1 trusted halves, 2 rejected)
    that hold a word, its occurrences in the trusted ones, and how many of ``CONTEXTS`` hashed words stand before it in rejected ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens.release()
        held, masks, times = [Counter(), Counter(), Counter()], {}, [Counter(), Counter()]

        def out() -> Iterator[pd.DataFrame]:
            for kind, own in enumerate(held):
                mask = np.fromiter((masks.get(w, 0) for w in own), np.uint64, len(own)).astype(np.int64)
                t = np.fromiter((times[kind][w] for w in own), np.int64, len(own)) if kind < 2 else np.zeros(len(own), np.int64)
                yield pd.DataFrame({"word": np.array([*own, None], dtype=object)[:-1], "kind": np.full(len(own), kind, np.int32), "n": np.fromiter(own.values(), np.int64, len(own)), "t": t, "mask": mask})
                own.clear()
            masks.clear()
            for own in times:
                own.clear()

        places: dict[str, int] = {}
        for batch in batches:
            for text, kind in zip(batch["text"], batch["kind"], strict=True):
                words = words_of(text)
                if kind < 2 and words:
                    words = [BEGIN, *words, END]
                    times[kind].update(words)
                held[kind].update(set(words))
                if kind == 2:
                    for before, w in zip(words, words[1:]):
                        bit = places.get(before)
                        if bit is None:
                            bit = places[before] = 1 << (word_hash(before.encode()) & 63)
                        masks[w] = masks.get(w, 0) | bit
                    if len(places) > _WORDS:
                        places.clear()
            if sum(map(len, held)) > _WORDS:
                yield from out()
        yield from out()

    counted = texts.select("text", "kind").mapInPandas(run, "word string, kind int, n long, t long, mask long")
    of = lambda k, name, c="n": F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0)).alias(name)
    by = counted.groupBy(F.xxhash64("word").alias("hash")).agg(F.min("word").alias("word"), of(0, "n0"), of(1, "n1"), of(2, "rejected"), of(0, "t0", "t"), of(1, "t1", "t"), F.bit_or("mask").alias("mask"))
    return by.select("hash", "word", "n0", "n1", "rejected", "t0", "t1", F.bit_count("mask").cast("int").alias("contexts"))


def mixed(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A bigram's hash, 63 bits, from those of its words."""
    x, y = w.astype(np.uint64), v.astype(np.uint64)  # changed in place: a counting task has millions of them
    x += np.uint64(0x632BE59BD9B4E019)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    y *= np.uint64(0x9E3779B97F4A7C15)
    x ^= y
    x ^= np.right_shift(x, np.uint64(32), out=y)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= np.right_shift(x, np.uint64(29), out=y)
    x >>= np.uint64(1)
    return x.view(np.int64)


def _six_bytes(x: np.ndarray) -> np.ndarray:
    return x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]


def _from_six(x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), 8), dtype=np.uint8)
    out[:, :6] = x
    return out.view("<i8").ravel()


def count_pairs(texts: DataFrame, shards: int = 16) -> DataFrame:
    """Bigrams of the trusted halves, as rows of two kinds: kind 0 has p, v, w, n0, n1 of a bigram of at least ``LEAST_PAIR``
    occurrences; kind 1 how many bigrams have n (1 to 4) occurrences in the halves and in all: n0, n1, n2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens.release()
        hashes: dict[str, int] = {}
        held, kinds, n_held = [], [], 0

        def out() -> Iterator[pd.DataFrame]:
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            all_, half = np.concatenate(held), np.repeat(np.array(kinds, dtype=bool), sizes)
            held.clear()
            kinds.clear()
            own = np.ones(len(all_) - 1, dtype=bool)
            own[np.cumsum(sizes)[:-1] - 1] = False  # not from one text to the next
            v, w, half = all_[:-1][own], all_[1:][own], half[1:][own]
            del all_, own
            p, first, at = np.unique(mixed(v, w), return_index=True, return_inverse=True)
            v, w, shard = _six_bytes(v[first]), _six_bytes(w[first]), p % shards
            n = [np.bincount(at[half == k], minlength=len(p)) for k in (False, True)]
            del at, first, half
            while len(p):
                some = [np.minimum(x, 255) for x in n]
                rows = np.concatenate([v, w, *[x.astype(np.uint8)[:, None] for x in some]], axis=1)
                order = np.argsort(shard, kind="stable")
                cuts = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
                yield pd.DataFrame([(int(shard[order[a]]), rows[order[a:b]].tobytes()) for a, b in zip(cuts, cuts[1:])], columns=["shard", "entries"])
                n = [x - y for x, y in zip(n, some, strict=True)]
                left = (n[0] + n[1]) > 0
                p, v, w, shard, n = p[left], v[left], w[left], shard[left], [x[left] for x in n]

        for batch in batches:
            for text, kind in zip(batch["text"], batch["kind"], strict=True):
                words = words_of(text) if kind < 2 else []
                if not words:
                    continue
                words = [BEGIN, *words, END]
                for w in words:
                    if w not in hashes:
                        hashes[w] = word_hash(w.encode()) & _LOW48
                held.append(np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)))
                kinds.append(kind)
                n_held += len(words)
                if n_held > _TOKENS:
                    yield from out()
                    n_held = 0
                if len(hashes) > _WORDS:
                    hashes.clear()
        if held:
            yield from out()

    def merge(packed: pd.DataFrame) -> pd.DataFrame:
        rows = np.frombuffer(b"".join(packed["entries"]), dtype=np.uint8).reshape(-1, _PAIR_BYTES)
        v, w = _from_six(rows[:, :6]), _from_six(rows[:, 6:12])
        p, first, at = np.unique(mixed(v, w), return_index=True, return_inverse=True)
        n0, n1 = (np.bincount(at, rows[:, 12 + k], len(p)).astype(np.int64) for k in (0, 1))
        kept = n0 + n1 >= LEAST_PAIR
        found = pd.DataFrame({"kind": 0, "p": p, "v": v[first], "w": w[first], "n0": n0, "n1": n1, "n2": n0 + n1})[kept]
        sizes = pd.DataFrame([(1, j, 0, 0, *(int((n == j).sum()) for n in (n0, n1, n0 + n1))) for j in (1, 2, 3, 4)], columns=found.columns)
        return pd.concat([found, sizes])

    packed = texts.filter("kind < 2").select("text", "kind").mapInPandas(run, "shard long, entries binary")
    return packed.groupBy("shard").applyInPandas(merge, "kind int, p long, v long, w long, n0 long, n1 long, n2 long")


def with_continuations(counts: DataFrame, pairs: DataFrame, off: list) -> DataFrame:
    """``counts`` with c0, c1, c2, how many distinct words stand before each, and g0, g1, g2, the bits that it costs to leave its bigrams.

    A word's occurrences less the repeats of its bigrams are its distinct ones, and only bigrams that are kept have repeats."""
    cost = [F.sum(F.when(F.col(f"n{k}") > 0, F.col(f"n{k}") - _off(off[k], F.col(f"n{k}"))).otherwise(0.0)).alias(f"m{k}") for k in range(3)]
    repeats = pairs.groupBy(F.col("w").alias("low")).agg(*[F.sum(F.greatest(F.col(f"n{k}") - 1, F.lit(0))).alias(f"r{k}") for k in range(3)])
    mass = pairs.groupBy(F.col("v").alias("low")).agg(*cost)
    rows = counts.withColumn("low", _low()).withColumn("t2", F.col("t0") + F.col("t1"))
    rows = rows.join(repeats, "low", "left").join(mass, "low", "left")
    c = [F.when(F.col("word") == BEGIN, 0).otherwise(F.greatest(F.col(f"t{k}") - F.coalesce(f"r{k}", F.lit(0)), F.lit(0))).cast("long").alias(f"c{k}") for k in range(3)]
    # words that share 48 bits of their hash share their bigrams; what is left of such a word is at least a millionth
    g = [F.when(F.col(f"t{k}") > 0, -F.log2(F.greatest(1 - F.coalesce(f"m{k}", F.lit(0.0)) / F.col(f"t{k}"), F.lit(1e-6)))).otherwise(0.0).alias(f"g{k}") for k in range(3)]
    return rows.select("hash", "word", "n0", "n1", "rejected", "contexts", "t0", "t1", "t2", F.col("spelled").cast("float").alias("spelled"), *c, *g)


def _low():
    return F.col("hash").bitwiseAND(F.lit(_LOW48))


def _off(d: tuple, n):
    return F.when(n == 1, float(d[0])).when(n == 2, float(d[1])).otherwise(float(d[2]))


def pair_discounts(pairs: DataFrame) -> list[tuple[float, float, float]]:
    rows = {r["p"]: r for r in pairs.filter("kind = 1").groupBy("p").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(3)]).collect()}  # four rows
    return [discounts(*((rows[j][f"n{k}"] if j in rows else 0) for j in (1, 2, 3, 4))) for k in range(3)]


def saved_bits(pairs: DataFrame, words: DataFrame, of: Counts, off: list) -> DataFrame:
    """p, n2, d0, d1, d2: the bits that a bigram saves against leaving its first word and following as a word; ``words`` has spelled."""
    one = words.withColumn("low", _low()).dropDuplicates(["low"])
    lead = one.select(F.col("low").alias("v"), *[F.col(f"{c}{k}").alias(f"v_{c}{k}") for c in ("t", "g") for k in range(3)])
    follow = one.select(F.col("low").alias("w"), "spelled", "c0", "c1", "c2")
    joined = pairs.join(lead, "v").join(follow, "w")

    def save(k: int):
        n, c, d = F.col(f"n{k}"), F.col(f"c{k}"), of.discount[k]
        p = (F.when(c > 0, c - F.when(c == 1, float(d[1])).when(c == 2, float(d[2])).otherwise(float(d[3]))).otherwise(0.0) / of.total[k] if of.total[k] else F.lit(0.0)) + of.back[k] * F.pow(F.lit(2.0), -F.least("spelled", F.lit(900.0)))
        whole = (n - _off(off[k], n)) / F.col(f"v_t{k}") + F.pow(F.lit(2.0), -F.col(f"v_g{k}")) * p
        return F.when((n > 0) & (F.col(f"v_t{k}") > 0), F.log2(whole) + F.col(f"v_g{k}") - F.log2(p)).otherwise(0.0).cast("float").alias(f"d{k}")

    return joined.select("p", "n2", *[save(k) for k in range(3)])


def bitmap_of(numbers: DataFrame, name: str, bits: int) -> np.ndarray:
    """A bit for each slot that some number of the column, of so many bits, falls into; ``PAIR_BITS`` bits, made in 32 parts."""
    low = PAIR_BITS - 5

    def run(own: pd.DataFrame) -> pd.DataFrame:
        slot = own["slot"].to_numpy()
        bits = np.zeros(1 << low, dtype=np.uint8)
        bits[slot & ((1 << low) - 1)] = 1
        return pd.DataFrame({"part": [int(slot[0]) >> low], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    slots = numbers.select(F.shiftright(name, bits - PAIR_BITS).bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).cast("int").alias("slot")).distinct()
    found = slots.groupBy(F.shiftright("slot", low)).applyInPandas(run, "part int, bits binary").toPandas()
    out = np.zeros((32, 1 << (low - 3)), dtype=np.uint8)
    for part, bits in zip(found["part"], found["bits"], strict=True):
        out[part] = np.frombuffer(bits, dtype=np.uint8)
    return out.ravel()


def frequent_pairs(saved: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """At most ``HOT_PAIRS`` of the most frequent bigrams, sorted, with their bits."""
    n = saved.count()
    if n > HOT_PAIRS:
        at = saved.agg(F.percentile_approx("n2", F.lit(1 - HOT_PAIRS / n), F.lit(100_000))).first()[0]
        saved = saved.filter(F.col("n2") > at)
    rows = saved.select("p", "d0", "d1", "d2").limit(HOT_PAIRS).toArrow()
    order = np.argsort(rows.column("p").to_numpy())
    return rows.column("p").to_numpy()[order], [rows.column(f"d{k}").to_numpy()[order].astype(np.float32) for k in range(3)]


def totals(counts: DataFrame) -> Counts:
    of_text = ~F.col("word").isin(BEGIN, END)
    aggs = [F.sum("rejected").alias("rejected")] + [F.sum(F.when(of_text, n)).alias(f"texts{k}") for k, n in enumerate((F.col("n0"), F.col("n1"), F.col("n0") + F.col("n1")))]
    for k in range(3):
        n = F.col(f"c{k}")
        aggs.append(F.sum(n).alias(f"total{k}"))
        aggs += [F.sum((n == j).cast("long")).alias(f"of{k}_{j}") for j in (1, 2, 3, 4)]
        aggs += [F.sum((n == j).cast("long")).alias(f"has{k}_{j}") for j in (1, 2)] + [F.sum((n >= 3).cast("long")).alias(f"has{k}_3")]
    return Counts(counts.agg(*aggs).first())


def spelling_counts(counts: DataFrame) -> pd.DataFrame:
    """gram, n: byte trigrams over the distinct trusted words; at most 2**24 rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(1 << 24, dtype=np.int64)
        for batch in batches:
            if len(batch):
                grams, n = np.unique(trigrams([w.encode() for w in batch["word"]])[0], return_counts=True)
                held[grams] += n
        grams = np.flatnonzero(held)
        yield pd.DataFrame({"gram": grams.astype(np.int32), "n": held[grams]})

    found = counts.filter((F.col("n0") + F.col("n1") > 0) & ~F.col("word").isin(BEGIN, END)).select("word").mapInPandas(run, "gram int, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()


def frequent(counts: DataFrame) -> DataFrame:
    """At most ``HOT`` of the most frequent words; which ones changes where a word is scored, not its score."""
    short = counts.filter(F.octet_length("word") <= HOT_BYTES).withColumn("total", F.col("n0") + F.col("n1") + F.col("rejected"))
    n = short.count()
    if n > HOT:
        at = short.agg(F.percentile_approx("total", F.lit(1 - HOT / n), F.lit(100_000))).first()[0]
        short = short.filter(F.col("total") > at)
    return short.select("word", _low().alias("low"), "n0", "n1", "rejected", "contexts", *_PARTS).limit(HOT)


_PARTS = [f"{c}{k}" for c in "cg" for k in range(3)]


class Hot:
    """Scores of the most frequent words, by place in ``at``, and of bigrams, by place in ``pairs``."""

    def __init__(self, words: list[str], columns: dict[str, np.ndarray], counts: Counts, spelling: Spelling, pairs: tuple, bitmaps: list[np.ndarray], ends: list[float]):
        self.at = dict(zip(words, range(len(words))))
        self.low = columns["low"].astype(np.int64)
        spelled = spelling.bits([w.encode() for w in words])
        n0, n1, rejected, contexts = (columns[c].astype(np.int64) for c in ("n0", "n1", "rejected", "contexts"))
        self.bits = [counts.bits(k, columns[f"c{k}"].astype(np.int64), spelled) + columns[f"g{k}"] for k in range(3)]
        self.worst = [counts.evidence(k, n, rejected, contexts) for k, n in enumerate((n0, n1, n0 + n1))]
        self.pairs, self.saved = pairs
        self.bitmaps, self.ends = bitmaps, ends  # ends: the bits of a text's begin and end, for each set

    def may_count(self, kind: int, numbers: np.ndarray) -> np.ndarray:
        """Whether words' hashes (kind ``_WORD``, 64 bits) or bigrams' (``_PAIR``, 63 bits) may have counts."""
        bitmap = self.bitmaps[kind]
        slots = 8 * len(bitmap)
        slot = (numbers >> ((64, 63)[kind] + 1 - slots.bit_length())) & (slots - 1)
        return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


#: Kinds of packed rows: words and bigrams of a shard, a batch's documents, and changes of them.
_WORD, _PAIR, _DOCUMENTS, _CHANGES = range(4)
_PACKED = ("batch", "kind", "packed")
_COLUMNS = ("doc", "doc_id", "lang", "key", "fold", "bytes", "bits", "held", "worst", "held_worst")


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: bytes that are zero in all take no room in a shuffle."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: bytes, kinds: list[tuple[str, int]], at: int = 0) -> list[np.ndarray]:
    """Arrays of given types and lengths that follow one another."""
    out = []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel())
        at += n * size
    return out


def pack_entries(own: np.ndarray, shards: int) -> bytes:
    """Entries of one shard, sorted by word: each word once, as its distance from the one before it, and then its entries."""
    words = own["word"]
    starts = np.flatnonzero(np.r_[True, words[1:] != words[:-1]])
    apart = np.diff(words[starts] // shards, prepend=0)
    times = np.diff(np.r_[starts, len(own)])
    return struct.pack("<II", len(starts), len(own)) + b"".join(_planes(x.astype(kind)) for x, kind in ((apart, "<i8"), (times, "<u4"), (own["n"], "<u2"), (own["doc"], "<u2")))


def unpack_entries(data: bytes, shard: int, shards: int) -> np.ndarray:
    heads, n = struct.unpack_from("<II", data)
    apart, times, many, doc = _from_planes(data, [("<i8", heads), ("<u4", heads), ("<u2", n), ("<u2", n)], 8)
    own = np.zeros(n, dtype=_ENTRY)
    own["word"], own["n"], own["doc"] = np.repeat(np.cumsum(apart) * shards + shard, times), many, doc
    return own


class _Scan:
    """Scores by the hot words, and the other words, of a task's documents."""

    def __init__(self, hot: Hot, counts: Counts, spelling: Spelling, shards: int):
        self.hot, self.counts, self.spelling, self.shards = hot, counts, spelling, shards
        self.docs, self.entries, self.held, self.made = [], ([], []), 0, 0

    def add(self, batch: pd.DataFrame) -> None:
        known: dict[str, int] = {}
        rest, place, times, runs = [], [], [], []
        first = len(self.docs)
        for doc_id, lang, key, fold, text in batch[["doc_id", "lang", "key", "fold", "text"]].itertuples(index=False, name=None):
            words = words_of(text)
            n = len(self.docs)
            at = np.fromiter(map(self.hot.at.get, words, repeat(-1)), np.int64, len(words))
            found = at[at >= 0]
            other = 1 - fold  # a half is judged by the other one's counts
            bits, held = (float(self.hot.bits[k][found].sum()) + (self.hot.ends[k] if words else 0.0) for k in (2, other))
            worst, held_worst = (float(self.hot.worst[k][found].max(initial=0)) for k in (2, other))
            size = len(text.encode()) if words else 0
            cold = np.flatnonzero(at < 0)
            named = [known.setdefault(words[i], len(known)) for i in cold.tolist()]
            at[cold] = -1 - np.array(named, dtype=np.int64)
            runs.append(at)
            for w, c in Counter(named).items():
                while c > 0:
                    rest.append(w)
                    place.append(n | fold << 15)
                    times.append(min(c, 65535))
                    c -= 65535
            self.docs.append([n, doc_id, lang, key, fold, size, bits, held, worst, held_worst])
        coded = [w.encode() for w in known]
        spelled, hashes = self.spelling.bits(coded).astype(np.float32).astype(float), np.fromiter(map(word_hash, coded), np.int64, len(coded))
        if rest:
            own = np.zeros(len(rest), dtype=_ENTRY)
            own["word"], own["n"], own["doc"] = hashes[rest], times, place
            # until the join finds counts of them, they are words that no one has seen
            unseen = [own["n"] * self.counts.unseen(k, spelled[rest]) for k in range(3)]
            self._change(first, own["doc"], unseen)
            self._keep(_WORD, own[self.hot.may_count(_WORD, own["word"])])
        self._pairs(first, runs, hashes & _LOW48)

    def _change(self, first: int, place: np.ndarray, bits: list[np.ndarray]) -> None:
        """Add bits by each of the three sets to documents, named with their fold."""
        doc, fold = place & 0x7FFF, place >> 15
        mine = np.bincount(doc, bits[2], len(self.docs))
        held = np.bincount(doc, np.where(fold == 0, bits[1], bits[0]), len(self.docs))
        for i in range(first, len(self.docs)):
            self.docs[i][6] += mine[i]
            self.docs[i][7] += held[i]

    def _pairs(self, first: int, runs: list[np.ndarray], cold: np.ndarray) -> None:
        """What bigrams save: of hot ones now, of others that may have counts by the join."""
        begin, end = (np.array([word_hash(m.encode()) & _LOW48]) for m in (BEGIN, END))
        parts, place = [], []
        for n, at in enumerate(runs, first):
            if len(at):
                low = np.where(at >= 0, self.hot.low[np.maximum(at, 0)] if len(self.hot.low) else 0, cold[np.maximum(-1 - at, 0)] if len(cold) else 0)
                parts.append(np.concatenate([begin, low, end]))
                place.append(np.full(len(at) + 2, n | self.docs[n][4] << 15))
        if not parts:
            return
        low, place = np.concatenate(parts), np.concatenate(place)
        p, place = mixed(low[:-1], low[1:])[place[1:] == place[:-1]], place[1:][place[1:] == place[:-1]]
        may = self.hot.may_count(_PAIR, p)
        p, place = p[may], place[may]
        at = np.minimum(np.searchsorted(self.hot.pairs, p), max(len(self.hot.pairs) - 1, 0))
        found = self.hot.pairs[at] == p if len(self.hot.pairs) else np.zeros(len(p), dtype=bool)
        self._change(first, place[found], [-x[at[found]].astype(float) for x in self.hot.saved])
        order = np.lexsort((p[~found], place[~found]))
        p, place = p[~found][order], place[~found][order]
        if len(p):
            starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (place[1:] != place[:-1])])
            own = np.zeros(len(starts), dtype=_ENTRY)
            times = np.diff(np.r_[starts, len(p)])
            own["word"], own["doc"], own["n"] = p[starts], place[starts], np.minimum(times, 65535)
            self._keep(_PAIR, own)
            while (times > 65535).any():  # a row of its own for each 65535 of them, as words have
                starts, times = starts[times > 65535], times[times > 65535] - 65535
                own = np.zeros(len(starts), dtype=_ENTRY)
                own["word"], own["doc"], own["n"] = p[starts], place[starts], np.minimum(times, 65535)
                self._keep(_PAIR, own)

    def _keep(self, kind: int, own: np.ndarray) -> None:
        self.entries[kind].append(own)
        self.held += len(own)

    def rows(self) -> Iterator[pd.DataFrame]:
        if not self.docs:
            return
        batch = TaskContext.get().partitionId() << 24 | self.made
        packed = [(batch % self.shards, batch, _DOCUMENTS, zlib.compress(pickle.dumps(self.docs), 1))]
        for kind, held in enumerate(self.entries):
            own = np.concatenate([*held, np.zeros(0, dtype=_ENTRY)])
            held.clear()
            shard = own["word"] % self.shards
            order = np.lexsort((own["word"], shard))
            own, shard = own[order], shard[order]
            cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
            packed += [(int(shard[a]), batch, kind, pack_entries(own[a:b], self.shards)) for a, b in zip(cuts, cuts[1:])]
        yield pd.DataFrame(packed, columns=["shard", *_PACKED])
        self.docs, self.held, self.made = [], 0, self.made + 1


#: What scoring needs of a word and of a bigram beside its hash.
_KNOWN = (
    [*[(c, "<i8") for c in ("n0", "n1", "rejected", "contexts", "c0", "c1", "c2")], *[(c, "<f4") for c in ("spelled", "g0", "g1", "g2")]],
    [(f"d{k}", "<f4") for k in range(3)],
)


def pack_known(rows: DataFrame, kind: int, shards: int) -> DataFrame:
    """shard, kind, packed: words or bigrams with counts, some 20 bytes each, sorted by hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def out() -> Iterator[pd.DataFrame]:
            own = pd.concat(held)
            held.clear()
            hashes = own["hash"].to_numpy(np.int64)
            shard = hashes % shards
            order = np.lexsort((hashes, shard))
            hashes, shard, values = hashes[order], shard[order], [own[c].to_numpy()[order].astype(of) for c, of in _KNOWN[kind]]
            cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
            packed = [(int(shard[a]), kind, zlib.compress(b"".join([_planes(np.diff(hashes[a:b] // shards, prepend=0)), *[_planes(x[a:b]) for x in values]]), 1)) for a, b in zip(cuts, cuts[1:])]
            yield pd.DataFrame(packed, columns=["shard", "kind", "packed"])

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n > _WORDS:
                yield from out()
                n = 0
        if n:
            yield from out()

    return rows.select("hash", *[c for c, _ in _KNOWN[kind]]).mapInPandas(run, "shard long, kind int, packed binary")


def unpack_known(data: bytes, kind: int, shard: int, shards: int) -> pd.DataFrame:
    of = [("hash", "<i8"), *_KNOWN[kind]]
    n = len(data) // sum(np.dtype(x).itemsize for _, x in of)
    apart, *values = _from_planes(data, [(x, n) for _, x in of])
    return pd.DataFrame({"hash": np.cumsum(apart) * shards + shard, **dict(zip((c for c, _ in _KNOWN[kind]), values))})


def _changes(counts: Counts, shards: int, packed: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """What the words and bigrams of a shard that have counts change in the scores of documents, and the documents that came with them."""
    documents = packed[packed["kind"] == _DOCUMENTS][list(_PACKED)]
    packed = packed[packed["kind"] != _DOCUMENTS]
    if not len(packed) or not len(known):
        return documents

    def met(kind: int) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        """Entries that have counts, their batches and the counts."""
        some, of = packed[packed["kind"] == kind], known[known["kind"] == kind]
        rows = [unpack_known(zlib.decompress(x), kind, shard, shards) for x, shard in zip(of["packed"], of["shard"], strict=True)]
        rows = pd.concat([*rows, unpack_known(b"", kind, 0, shards)]).sort_values("hash")
        entries = [unpack_entries(e, shard, shards) for e, shard in zip(some["packed"], some["shard"], strict=True)]
        own, batch, keys = np.concatenate([*entries, np.zeros(0, dtype=_ENTRY)]), np.repeat(some["batch"].to_numpy(np.int64), list(map(len, entries))), rows["hash"].to_numpy(np.int64)
        if not len(keys) or not len(own):
            return own[:0], batch[:0], rows.iloc[:0]
        at = np.minimum(np.searchsorted(keys, own["word"]), len(keys) - 1)
        hit = keys[at] == own["word"]
        return own[hit], batch[hit], rows.iloc[at[hit]]

    own, batch, words = met(_WORD)
    n0, n1, rejected, contexts, *c = (words[x].to_numpy(np.int64) for x in ("n0", "n1", "rejected", "contexts", "c0", "c1", "c2"))
    spelled = words["spelled"].to_numpy(float)
    more = [own["n"] * (counts.bits(k, c[k], spelled) - counts.unseen(k, spelled) + words[f"g{k}"].to_numpy(float)) for k in range(3)]
    worst = [counts.evidence(k, n, rejected, contexts) for k, n in enumerate((n0, n1, n0 + n1))]
    first_half = own["doc"] >> 15 == 0  # judged by the other half's counts
    out = pd.DataFrame({"batch": batch, "doc": own["doc"] & 0x7FFF, "bits": more[2], "held": np.where(first_half, more[1], more[0]), "worst": worst[2], "held_worst": np.where(first_half, worst[1], worst[0])})
    own, batch, pairs = met(_PAIR)
    saved = [-own["n"].astype(float) * pairs[f"d{k}"].to_numpy(float) for k in range(3)]
    first_half = own["doc"] >> 15 == 0
    less = pd.DataFrame({"batch": batch, "doc": own["doc"] & 0x7FFF, "bits": saved[2], "held": np.where(first_half, saved[1], saved[0]), "worst": 0.0, "held_worst": 0.0})
    out = pd.concat([out, less]).groupby(["batch", "doc"], as_index=False).agg({"bits": "sum", "held": "sum", "worst": "max", "held_worst": "max"})
    made = [(batch, _CHANGES, b"".join(_planes(some[c].to_numpy().astype(_CHANGE[c])) for c in _CHANGE.names)) for batch, some in out.groupby("batch")]
    return pd.concat([documents, pd.DataFrame(made, columns=list(_PACKED))])


def spelled_words(words: DataFrame, spelling) -> DataFrame:
    """``words`` with spelled, the bits of each; ``spelling`` is the broadcast trigram counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speller = Spelling(*spelling.value)
        for batch in batches:
            yield batch.assign(spelled=speller.bits([w.encode() for w in batch["word"]]))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInPandas(run, f"{kinds}, spelled double")


def _free_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of shuffles that are over once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Model:
    """Everything that scoring needs: words and bigrams with counts, as tables, totals, and the spelling."""

    def __init__(self, texts: DataFrame, shards: int = 16):
        spark = texts.sparkSession
        found = cut(count_pairs(texts, shards), "kn_pairs")
        off = pair_discounts(found)
        pairs = found.filter("kind = 0").drop("kind")
        _free_shuffles(spark)
        counts = cut(count_words(texts), "kn_counts")
        _free_shuffles(spark)
        grams = spelling_counts(counts)
        self.grams = (grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.int64))
        shared = spark.sparkContext.broadcast(self.grams)
        self.words = cut(with_continuations(spelled_words(counts, shared), pairs, off), "kn_words")
        shared.unpersist()
        drop_cut(counts)
        self.of = totals(self.words)
        _free_shuffles(spark)
        self.pairs = cut(saved_bits(pairs, self.words.filter("t2 > 0"), self.of, off), "kn_saved")
        marks = {r["word"]: r for r in self.words.filter(F.col("word").isin(BEGIN, END) & (F.col("t2") > 0)).collect()}
        begin, end = marks.get(BEGIN), marks.get(END)
        self.ends = [float(begin[f"g{k}"] + self.of.bits(k, np.array([end[f"c{k}"]]), np.array([end["spelled"]]))[0]) if begin and end else 0.0 for k in range(3)]
        drop_cut(found)
        _free_shuffles(spark)

    def drop(self) -> None:
        drop_cut(self.words)
        drop_cut(self.pairs)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, key, fold, bytes, bits, held, worst, held_worst of every row of ``docs``, as a table; held: by the other half's counts. The model's tables go."""
    spark, of = docs.sparkSession, model.of
    shards = int(np.clip(input_bytes(docs) // SHARD_BYTES, 64, 1 << 16))
    often = frequent(model.words).toArrow()
    columns = {c: often.column(c).to_numpy() for c in ("low", "n0", "n1", "rejected", "contexts", *_PARTS)}
    bitmaps = [bitmap_of(model.words, "hash", 64), bitmap_of(model.pairs, "p", 63)]
    hot = (of, *model.grams, "\n".join(often.column("word").to_pylist()), columns, frequent_pairs(model.pairs), bitmaps, model.ends)
    shared = spark.sparkContext.broadcast(zlib.compress(pickle.dumps(hot), 1))  # each executor keeps it in a file
    del often, columns, bitmaps, hot
    known = cut(pack_known(model.words, _WORD, shards).unionByName(pack_known(model.pairs.withColumnRenamed("p", "hash"), _PAIR, shards)), "kn_known")
    model.drop()
    _free_shuffles(spark)
    names = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang")}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens.release()
        own_counts, gram, n, words, columns, pairs, bitmaps, ends = pickle.loads(zlib.decompress(shared.value))
        spelling = Spelling(gram, n)
        task = _Scan(Hot(words.split("\n") if words else [], columns, own_counts, spelling, pairs, bitmaps, ends), own_counts, spelling, shards)
        for batch in batches:
            if len(task.docs) + len(batch) > _DOCS or task.held > _ENTRIES:
                yield from task.rows()
            task.add(batch)
        yield from task.rows()

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold")
    rows = docs.select("doc_id", "lang", text_key("lang", "text").alias("key"), fold, F.coalesce("text", F.lit("")).alias("text"))
    packed = rows.mapInPandas(scan, "shard long, batch long, kind int, packed binary").groupBy("shard")
    changed = packed.cogroup(known.groupBy("shard")).applyInPandas(lambda p, w: _changes(of, shards, p, w), "batch long, kind int, packed binary")

    def settle(packed: pd.DataFrame) -> pd.DataFrame:
        own = pd.DataFrame(pickle.loads(zlib.decompress(packed["packed"][packed["kind"] == _DOCUMENTS].iloc[0])), columns=list(_COLUMNS), dtype=object)
        total = {c: own[c].to_numpy(float) for c in _COLUMNS[6:]}
        for data in packed["packed"][packed["kind"] == _CHANGES]:
            doc, *some = _from_planes(data, [(_CHANGE[c].str, len(data) // _CHANGE.itemsize) for c in _CHANGE.names])
            for c, x in zip(_COLUMNS[6:], some, strict=True):
                (np.add if c in ("bits", "held") else np.maximum).at(total[c], doc, x)
        return own.assign(**total)[list(_COLUMNS[1:])]

    numbers = ", ".join(f"{c} double" for c in _COLUMNS[6:])
    found = changed.groupBy("batch").applyInPandas(settle, f"doc_id {names['doc_id']}, lang {names['lang']}, key long, fold int, bytes long, {numbers}")
    found = cut(found, "kn_scores")
    shared.unpersist()
    drop_cut(known)
    return found


def text_key(lang: str, text: str):
    """With doc_id it tells a document's rows apart."""
    return F.xxhash64(lang, text)


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id, trusted: one row a labelled document."""
    trusted = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(trusted).alias("trusted"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, worst_quantile: float = WORST_QUANTILE) -> DataFrame:
    """doc_id, lang, key, perplexity, worst, threshold, worst_threshold, kept for every row of ``docs`` (doc_id, lang, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "lang", "text")
    known = cut(_labelled(labels.select("doc_id", "quality", "toxic")), "labelled")
    near = F.broadcast(known) if known.count() <= LABEL_ROWS else known
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    texts = docs.filter(F.length("text") > 0).join(near, "doc_id").select("text", F.when(F.col("trusted"), half).otherwise(F.lit(2)).alias("kind"))
    model = Model(texts, int(np.clip(input_bytes(docs) // SHARD_BYTES, 16, 1 << 16)))  # a join's own estimate says nothing
    found = scores(docs, model)
    _free_shuffles(docs.sparkSession)
    perplexity = lambda bits: F.when(F.col("bytes") > 0, F.pow(F.lit(2.0), F.col(bits) / F.col("bytes")))
    trusted = found.filter("bytes > 0").join(near.filter("trusted"), "doc_id", "left_semi").select("lang", perplexity("held").alias("p"), F.col("held_worst").alias("w"))
    cutoff = [F.percentile_approx("p", F.lit(quantile), F.lit(10000)).alias("p"), F.percentile_approx("w", F.lit(worst_quantile), F.lit(10000)).alias("w")]
    by_lang = trusted.groupBy(F.col("lang").alias("l")).agg(*cutoff, F.count(F.lit(1)).alias("n")).select("l", "n", F.col("p").alias("of_p"), F.col("w").alias("of_w"))
    overall = trusted.agg(*cutoff).select(F.col("p").alias("all_p"), F.col("w").alias("all_w"))  # one row
    judged = found.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(overall))
    limit = lambda own, every: F.coalesce(F.when(F.col("n") >= FEW, F.col(own)), F.greatest(own, every), F.lit(float("inf")))
    judged = judged.select("doc_id", "lang", "key", perplexity("bits").alias("perplexity"), "worst", limit("of_p", "all_p").alias("threshold"), limit("of_w", "all_w").alias("worst_threshold"))
    return judged.withColumn("kept", F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.col("threshold")) & (F.col("worst") <= F.col("worst_threshold")))
