"""Jaccard join of word-shingle sets with XOR parity sketches; exact.

Two sets A and B link when 100 |A & B| >= 75 |A | B|, that is when their symmetric
difference is at most k = (|A| + |B|) / 7.

Sketch.  The shingles of a set are dealt by hash into P parts; a part's sketch is
the XOR of its shingles' hashes.  The number of parts in which two sketches differ
is at most the symmetric difference.  Sizes are banded by powers of two; P depends
on the band alone.  A set larger than a band joins it too if a set of the band can
be similar to it.

Pigeonhole.  A set emits the keys (part, sketch) of its first k + 1 parts that are
not empty, k for the largest set it can link to.  Of the parts up to where the
first of two similar sets stops, at most k differ, so the sets share a key.  Sets
under ``SMALL`` shingles use each shingle as a part, in the order of the hashes.

Candidates.  Tasks pack their keys by bucket of the key (six to twelve bytes a key,
no row a key); a bucket sorts its keys and returns, for each key that several
documents share, links to its smallest document, the leader; documents that share a
key share its leader.  The number of buckets follows the input's size.

Verification.  Candidates whose sizes or parity bits (a set's shingles, XORed into
one or two bits each) are too far apart are dropped.  Round one checks each document
against the candidate with which it shares most keys.  Documents that those links connect need no further check with
each other.  Round two checks what is left: the other candidate links, and within
each leader's group all pairs of different components within the Hamming bound.  Copies are joined by their
sets' fingerprints; a task emits the keys of one of its copies only.

Pairs are compared as sets of 64-bit shingle hashes of the whole texts.

Defined results: a null or empty text, or one without words, has no shingles and
links with nothing; fewer than five words are one shingle; rows of one doc_id count
as one document (the first text met stands for it) and come back once each; a null
doc_id links with nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import tokens
from scriptorium.llm.shingles import mix, shingle_sets
from scriptorium.operators.components import components
from scriptorium.session import cut, input_bytes, small_batches

SMALL = 32
#: Input bytes (as stored) for each bucket of keys.
BUCKET_BYTES = 2 << 20
#: Ids of texts to compare that are broadcast rather than shuffled (16 MB of ids).
BROADCAST_IDS = 2_000_000
_FLUSH = 1_000_000  # keys a task holds before it writes them out
_BLOCK = 1024  # members of one group that meet in a task
_GROUP_ROWS = 5_000  # rows of small groups that share a task
_U = np.uint64


def _most(n: int, other: int) -> int:
    """The largest symmetric difference of similar sets of these sizes."""
    return (n + other) // 7


def _spaces(n: int) -> list[tuple[int, int]]:
    """(band, k) in which a set of n shingles emits keys; band 0: sets under SMALL."""
    upper = _most(n, 4 * n // 3)
    if n < SMALL:
        return [(0, upper)]
    band = n.bit_length() - 1
    floor = 1 << band
    own = [(band, upper)]
    if 3 * n < 4 * floor:  # a set of the band below can be similar
        own.append((0 if floor == SMALL else band - 1, _most(n, floor - 1)))
    return own


def _parts(band: int) -> int:
    return int(np.ceil(0.9 * 2**band + 3 * 2 ** (band / 2)))


def keys(hashes: np.ndarray) -> np.ndarray:
    """The pigeonhole keys of a set."""
    out = []
    for band, k in _spaces(len(hashes)):
        if band:
            part = (hashes >> _U(20)) % _U(_parts(band))
            order = np.argsort(part, kind="stable")
            part = part[order]
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))[: k + 2]
            sketch = np.bitwise_xor.reduceat(hashes[order], first)[: k + 1]
            out.append(mix(mix(sketch + _U(band)) + part[first[: k + 1]]))
        else:
            out.append(mix(hashes[: k + 1]))
    return np.concatenate(out)


def bit_sketch(hashes: np.ndarray) -> bytes:
    """Parity bits: as many as twice the power of two at or below the set's size, 64 at least."""
    bits = max(64, 2 << (max(1, len(hashes)).bit_length() - 1))
    out = np.zeros(bits, dtype=np.uint8)
    at, n = np.unique(hashes & _U(bits - 1), return_counts=True)
    out[at.astype(np.int64)] = n & 1
    return np.packbits(out, bitorder="little").tobytes()


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0)


def hamming(a: bytes, b: bytes) -> int:
    """Of the sketches at the smaller one's width."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


def _possible(n: int, m: int) -> bool:
    return 3 * max(n, m) <= 4 * min(n, m)


def _narrow(x: np.ndarray) -> tuple[int, np.ndarray]:
    """Ids as offsets from the smallest, in as few bytes as they need."""
    base = int(x.min())
    span = int(x.max()) - base
    return base, (x - base).astype(np.uint16 if span < 1 << 16 else np.uint32 if span < 1 << 32 else np.int64)


class _Buffer:
    """Keys and document facts of a task, handed out as one packed row a bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.keys, self.docs, self.held, self.facts = buckets, [], [], 0, []

    def add(self, ids: list, texts: list[str]) -> None:
        leaders: dict[tuple, int] = {}
        for doc, own in zip(ids, shingle_sets(texts), strict=True):
            if not len(own):
                self.facts.append((doc % self.buckets, doc, 0, doc, 0, 0, b""))
                continue
            print_ = (len(own), int(np.bitwise_xor.reduce(mix(own + _U(1)))), int(mix(own ^ _U(0x5851F42D4C957F2D)).sum()))
            leader = leaders.setdefault(print_, doc)
            if leader != doc:
                self.facts.append((doc % self.buckets, doc, len(own), leader, 0, 0, b""))
                continue
            self.facts.append((print_[1] % self.buckets, doc, len(own), doc, print_[1] - (1 << 63), print_[2] - (1 << 63), bit_sketch(own)))
            k = keys(own)
            self.keys.append(k)
            self.docs.append(np.full(len(k), doc, dtype=np.int64))
            self.held += len(k)

    def rows(self) -> pd.DataFrame:
        out = []
        if self.keys:
            key, doc = np.concatenate(self.keys), np.concatenate(self.docs)
            bucket = (key % _U(self.buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            bucket, key, doc = bucket[order], (key[order] >> _U(32)).astype(np.uint32), doc[order]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            for a, b in zip(cuts, cuts[1:]):
                base, narrow = _narrow(doc[a:b])
                out.append((int(bucket[a]), key[a:b].tobytes(), base, narrow.tobytes(), None, None, None, None, None, None))
        out += [(b, None, None, None, doc, n, leader, f, g, s) for b, doc, n, leader, f, g, s in self.facts]
        self.keys, self.docs, self.held, self.facts = [], [], 0, []
        return pd.DataFrame(out, columns=_PACKED_NAMES).astype({c: "Int64" for c in ("base", "doc", "n", "leader", "f", "g")})


_PACKED = "bucket long, keys binary, base long, ids binary, doc long, n long, leader long, f long, g long, sketch binary"
_PACKED_NAMES = [c.split()[0] for c in _PACKED.split(", ")]
#: what = 0: document a with n shingles; 1: a leads n keys that b has too; 2: a and b have equal sets
_FOUND = "what int, a long, b long, n long, sketch binary"


def _found(what: int, a: np.ndarray, b: np.ndarray, n=0, sketch=None) -> pd.DataFrame:
    return pd.DataFrame({"what": np.full(len(a), what, dtype=np.int32), "a": a, "b": b, "n": n, "sketch": sketch})


def _bucket(rows: pd.DataFrame) -> pd.DataFrame:
    packed, facts = rows[rows["keys"].notna()], rows[rows["doc"].notna()]
    out = []
    if len(facts):
        doc, leader = (facts[c].to_numpy(dtype=np.int64) for c in ("doc", "leader"))
        out.append(_found(0, doc, doc, facts["n"].to_numpy(dtype=np.int64), facts["sketch"]))
        copies = doc != leader
        out.append(_found(2, leader[copies], doc[copies]))
        lead = facts[~copies & (facts["n"].to_numpy(dtype=np.int64) > 0)]
        least = lead.groupby(["n", "f", "g"])["doc"].transform("min").to_numpy(dtype=np.int64)
        own = lead["doc"].to_numpy(dtype=np.int64)
        out.append(_found(2, least[least != own], own[least != own]))
    if len(packed):
        wide = {2: np.uint16, 4: np.uint32, 8: np.int64}
        some_keys = [np.frombuffer(k, np.uint32) for k in packed["keys"]]
        some_ids = [np.frombuffer(i, wide[len(i) // len(k)]).astype(np.int64) + int(base) for k, i, base in zip(some_keys, packed["ids"], packed["base"], strict=True)]
        key, doc = np.concatenate(some_keys), np.concatenate(some_ids)
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))
        key, doc = key[fresh], doc[fresh]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        run = np.cumsum(first) - 1
        leader = doc[first][run]
        pair = pd.DataFrame({"a": leader[~first], "b": doc[~first]}).value_counts().reset_index(name="n")
        out.append(_found(1, pair["a"], pair["b"], pair["n"]))
    return pd.concat(out) if out else _found(0, np.zeros(0, np.int64), np.zeros(0, np.int64))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose texts are similar; only their texts are shuffled further than once."""
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "jaccard_ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    texts = cut(texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "jaccard_texts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}  # the last batch's left sides: a hub's set is made once
        for batch in batches:
            left = {a: t for a, t in zip(batch["a"], batch["text_a"], strict=True) if a not in held}
            held = {a: held[a] for a in set(batch["a"]) if a in held} | dict(zip(left, shingle_sets(list(left.values())), strict=True))
            hits = []
            for a, right in zip(batch["a"], shingle_sets(batch["text_b"].tolist()), strict=True):
                both = len(np.intersect1d(held[a], right, assume_unique=True))
                hits.append(both > 0 and 100 * both >= 75 * (len(held[a]) + len(right) - both))
            yield batch.loc[hits, ["a", "b"]]

    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long")


def _near(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs that sizes and bit sketches do not rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = [_possible(n, m) and hamming(s, t) <= _most(n, m) for n, m, s, t in zip(batch["n_a"], batch["n_b"], batch["s_a"], batch["s_b"], strict=True)]
            yield batch.loc[keep, ["a", "b", "n"]]

    side = lambda x: facts.select(F.col("doc").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "n", "n_a", "n_b", "s_a", "s_b").mapInPandas(run, "a long, b long, n long")


def _group_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components within a leader's group that the sketches do not rule out.

    Rows: leader, doc, component, n, sketch.  The members of a large group are dealt
    into blocks; each two blocks meet in a task.  Small groups share a task.
    """

    def of_group(group: pd.DataFrame, same_block: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, block, comp, doc = (group[c].to_numpy(np.int64) for c in ("n", "own", "component", "doc"))
        if len(group) < 2 or comp.min() == comp.max():
            return
        sketches = [np.frombuffer(s, np.uint8) for s in group["sketch"]]
        width = np.array([len(s) for s in sketches])
        tables = {w: np.stack([_folded(s, w).view(np.uint64) if len(s) >= w else np.zeros(w // 8, np.uint64) for s in sketches]) for w in set(width.tolist())}
        for x in range(len(group) - 1):  # partners y > x are not smaller, so x's width is the smaller one
            y = np.arange(x + 1, np.searchsorted(n, 4 * n[x] // 3, side="right"))
            y = y[comp[y] != comp[x]]
            if not same_block:
                y = y[block[y] != block[x]]
            if len(y):
                table = tables[width[x]]
                y = y[np.bitwise_count(table[y] ^ table[x]).sum(axis=1) <= (n[x] + n[y]) // 7]
                yield np.minimum(doc[x], doc[y]), np.maximum(doc[x], doc[y])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        same_block = rows["i"].iloc[0] == rows["j"].iloc[0]
        rows = rows.sort_values(["leader", "n"])
        cuts = np.flatnonzero(np.diff(rows["leader"].to_numpy(), prepend=np.iinfo(np.int64).min, append=np.iinfo(np.int64).max))
        found = [p for a, b in zip(cuts, cuts[1:]) for p in of_group(rows.iloc[a:b], same_block)]
        if not found:
            return pd.DataFrame({"a": [], "b": []})
        return pd.DataFrame({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])}).drop_duplicates()

    sizes = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("blocks"))
    dealt = members.join(sizes, "leader").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    dealt = dealt.withColumn("_m", F.explode(meets)).select("leader", "doc", "component", "n", "sketch", "own", "_m.i", "_m.j")
    groups = max(64, members.count() // _GROUP_ROWS)
    return dealt.groupBy(F.pmod(F.xxhash64("leader"), F.lit(groups)).alias("group"), "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    kind = docs.schema["doc_id"].dataType
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = named.filter("doc_id is not null")
    buckets = int(np.clip(input_bytes(docs) // BUCKET_BYTES, 64, 1 << 24))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens.release()
        buffer = _Buffer(buckets)
        for batch in batches:
            buffer.add(batch["doc_id"].tolist(), batch["text"].tolist())
            if buffer.held > _FLUSH or len(buffer.facts) > 50_000:
                yield buffer.rows()
        yield buffer.rows()

    found = cut(texts.mapInPandas(pack, _PACKED).groupBy("bucket").applyInPandas(_bucket, _FOUND), "jaccard_found")
    facts = found.filter("what = 0").groupBy(F.col("a").alias("doc")).agg(F.first("n").alias("n"), F.max("sketch").alias("sketch"))
    same = found.filter("what = 2").select("a", "b")
    shared = cut(found.filter("what = 1").groupBy("a", "b").agg(F.sum("n").alias("n")), "jaccard_shared")
    candidates = cut(_near(shared, facts), "jaccard_candidates")
    best = candidates.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    links = cut(_verified(best, texts).union(same), "jaccard_links")
    joined = cut(components(links), "jaccard_components")

    of = lambda x: joined.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    rest = candidates.select("a", "b").join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
    rest = rest.filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
    groups = shared.select(F.col("a").alias("leader"), F.col("b").alias("doc"))
    groups = groups.union(groups.select("leader", "leader").distinct()).join(joined.withColumnRenamed("node", "doc"), "doc", "left")
    groups = groups.select("leader", "doc", F.coalesce("component", "doc").alias("component"))
    unsettled = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).filter("size > 2 and low < high")
    members = cut(groups.join(unsettled.select("leader"), "leader", "left_semi").join(facts, "doc"), "jaccard_members")
    more = cut(rest.union(_group_pairs(members)).distinct().join(best, ["a", "b"], "left_anti"), "jaccard_more")
    links = cut(_verified(more, texts).union(joined.filter("node != component").select("component", "node")), "jaccard_links")

    final = components(links)
    out = facts.select("doc", "n").join(final.withColumnRenamed("node", "doc"), "doc", "left")
    out = out.select(F.col("doc").alias("_doc"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))
    rows = docs.select("doc_id").join(out, F.col("doc_id") == F.col("_doc"), "left")
    return rows.select("doc_id", F.coalesce("n_shingles", F.lit(0)).cast("long").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"))
