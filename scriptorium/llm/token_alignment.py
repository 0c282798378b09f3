"""Alignment of two tokenisers over a corpus, each distinct text once.

Texts are shuffled in full and counted, so that each distinct one is tokenised and aligned once,
by a byte-level BPE (A) and a SentencePiece model (B).  Byte offsets where tokens of both end cut
the tokens into groups; each A token of a group is linked with each B token of it.  A text keeps
its measures and its distinct links; links are counted over the corpus by documents, each text
as often as it occurs; then the counts come back to the texts' links, and the measures to
the documents by the text's 256-bit hash.

Inside a task a text falls into chunks at single spaces between other characters.  Both tokenisers
always cut there (for B this is checked when the model is loaded), so a chunk is tokenised and
aligned once in a while, and a text is its chunks' alignments one after the other.

Links are numbers, A id times the size of B's vocabulary plus B id.  Up to ``HOT_PAIRS`` of the most
frequent ones are broadcast with their counts, and a text's links are looked up in the task; all other
links meet their counts in shards, packed by batches of texts.  Both give the same sums.  A task that
counts links keeps ``COUNTED`` of them before it writes them out.

Defined results: null and empty texts, and texts that a tokeniser does not give back byte by byte,
have no tokens (zeros, an empty digest); rows are kept as they are, repeated ones and null ids too;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import tokens
from scriptorium.session import cut, small_batches

#: Links whose counts are broadcast.
HOT_PAIRS = 500_000
#: Links that a shard of the others holds, with their counts, or from texts.
SHARD_PAIRS = 500_000
#: Links a task counts before it writes them out.
COUNTED = 3_000_000
#: Chunks, and bytes of them, that a worker keeps aligned; beyond that, those seen once are forgotten.
CHUNKS, CHUNK_BYTES = 250_000, 24 << 20
#: Characters of texts that are aligned at once (one text at least).
AT_ONCE = 1 << 20
#: A group of more links is taken by distinct ids.
LARGE_GROUP = 1024

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_COLD = np.dtype([("doc", "<u4"), ("pair", "<u8"), ("times", "<u4")])


def _byte_of_sign() -> dict[str, int]:
    """The bytes that the signs of a byte-level vocabulary stand for: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenisers, and the alignments of chunks seen lately."""

    def __init__(self, paths: tuple[str | None, str | None] = (None, None)):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self._a = Tokenizer.from_file(paths[0] or tokens.default_path("byte_bpe_50k.json"))
        self._a.encode_special_tokens = True  # their strings in a text are plain text
        self._b = sentencepiece.SentencePieceProcessor(model_file=paths[1] or tokens.default_path("piece_bpe_32k.model"))
        sign, b = _byte_of_sign(), self._b
        self._a_bytes = [b""] * (max(self._a.get_vocab().values()) + 1)
        for piece, k in self._a.get_vocab().items():
            self._a_bytes[k] = bytes(sign[c] for c in piece) if all(c in sign for c in piece) else piece.encode()
        pieces = [b.id_to_piece(k) for k in range(b.vocab_size())]
        self._b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self._separable = not any("▁" in p.lstrip("▁") for p in pieces)
        self.width = b.vocab_size()
        self._a_size, self._b_size = (np.array([len(x) for x in of], dtype=np.int64) for of in (self._a_bytes, self._b_bytes))
        self._forget()

    def _forget(self) -> None:
        self._at: dict[str, int] = {}
        self._groups: list[str | None] = []  # None: not given back byte by byte
        self._sums = np.zeros((1024, len(MEASURES)), dtype=np.int64)
        self._start = np.zeros(1025, dtype=np.int64)
        self._pairs = np.zeros(4096, dtype=np.int64)
        self._times = np.zeros(4096, dtype=np.int64)
        self._used = np.zeros(1024, dtype=np.int64)
        self._bytes = 0

    def _thin(self) -> None:
        """Keep the chunks that were met again, if they are at most half of what may be kept."""
        n = len(self._groups)
        kept = np.flatnonzero(self._used[:n] > 1)
        words = list(self._at)
        words = [words[k] for k in kept.tolist()]
        size = sum(map(len, words))
        if len(kept) > CHUNKS // 2 or size > CHUNK_BYTES // 2:
            self._forget()
            return
        groups, sums, start, pairs, times = self._groups, self._sums, self._start, self._pairs, self._times
        self._forget()
        long = start[kept + 1] - start[kept]
        place = np.repeat(start[kept] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        self._keep(sums[kept], np.r_[0, np.cumsum(long)], pairs[place], times[place])
        self._groups = [groups[k] for k in kept.tolist()]
        self._at = dict(zip(words, range(len(words)), strict=True))
        self._bytes = size

    def _whole(self, ids: list[list[int]], table: list[bytes], sizes: np.ndarray, want: list[bytes]) -> np.ndarray:
        """Whether the tokens of each chunk are its bytes."""
        flat = list(chain.from_iterable(ids))
        if b"".join(map(table.__getitem__, flat)) == b"".join(want):
            ends = np.r_[0, np.cumsum(sizes[flat])][np.cumsum(list(map(len, ids)))]
            if (ends == np.cumsum(list(map(len, want)))).all():
                return np.ones(len(ids), dtype=bool)
        return np.array([b"".join(table[i] for i in of) == w for of, w in zip(ids, want, strict=True)], dtype=bool)

    def _learn(self, new: list[str]) -> None:
        spaced = [" " + c for c in new]
        want = [c.encode() for c in spaced]
        a = [e.ids for e in self._a.encode_batch_fast(spaced, add_special_tokens=False)]
        b = self._b.encode(new, num_threads=1)
        fine = self._whole(a, self._a_bytes, self._a_size, want) & self._whole(b, self._b_bytes, self._b_size, want)
        if not fine.all():
            a, b = ([of if ok else [] for of, ok in zip(ids, fine, strict=True)] for ids in (a, b))
        n_a, n_b = (np.array(list(map(len, ids)), dtype=np.int64) for ids in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), dtype=np.int64) for ids in (a, b))
        end_a, end_b = np.cumsum(self._a_size[flat_a]), np.cumsum(self._b_size[flat_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)  # the group of each token
        in_a, in_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        size = np.array([len(w) if ok else 0 for w, ok in zip(want, fine, strict=True)], dtype=np.int64)
        n_groups = np.diff(np.r_[0, np.searchsorted(common, np.cumsum(size), side="right")])
        links = in_a * in_b
        sum_at = np.r_[0, np.cumsum(links)]
        group_at = np.r_[0, np.cumsum(n_groups)]
        n_links = sum_at[group_at[1:]] - sum_at[group_at[:-1]]

        # links by group; those of large groups by distinct ids
        usual = (links <= LARGE_GROUP)[of_a]
        often = np.where(usual, in_b[of_a], 0)
        left = np.repeat(np.arange(len(flat_a)), often)
        right = from_b[of_a[left]] + np.arange(len(left)) - np.repeat(np.cumsum(often) - often, often)
        pairs, times, group = flat_a[left] * self.width + flat_b[right], np.ones(len(left), dtype=np.int64), of_a[left]
        if (large := np.flatnonzero(links > LARGE_GROUP)).size:
            parts = [(pairs, times, group)]
            for g in large.tolist():
                (x, nx), (y, ny) = (np.unique(ids[s : s + n], return_counts=True) for ids, s, n in ((flat_a, from_a[g], in_a[g]), (flat_b, from_b[g], in_b[g])))
                parts.append((np.add.outer(x * self.width, y).ravel(), np.multiply.outer(nx, ny).ravel(), np.full(len(x) * len(y), g)))
            pairs, times, group = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(group, kind="stable")
            pairs, times, group = pairs[order], times[order], group[order]
        self._keep(np.stack([n_a, n_b, n_groups, n_links], axis=1), np.searchsorted(group, group_at), pairs, times)

        text_a, text_b = list(map(str, flat_a.tolist())), list(map(str, flat_b.tolist()))
        at_a, at_b = np.r_[from_a, len(text_a)].tolist(), np.r_[from_b, len(text_b)].tolist()
        written = [f"{text_a[s] if e - s == 1 else ','.join(text_a[s:e])}|{text_b[u] if v - u == 1 else ','.join(text_b[u:v])}" for s, e, u, v in zip(at_a, at_a[1:], at_b, at_b[1:])]  # noqa: B905
        bounds = group_at.tolist()
        first = len(self._groups)
        self._groups += [";".join(written[s:e]) if ok else None for s, e, ok in zip(bounds, bounds[1:], fine.tolist())]  # noqa: B905
        self._at.update(zip(new, range(first, first + len(new)), strict=True))
        self._bytes += int(size.sum())

    def _keep(self, sums: np.ndarray, bounds: np.ndarray, pairs: np.ndarray, times: np.ndarray) -> None:
        n, held = len(self._groups), int(self._start[len(self._groups)])

        def room(of: np.ndarray, need: int) -> np.ndarray:
            return of if need <= len(of) else np.concatenate([of, np.zeros((max(need, 2 * len(of)) - len(of), *of.shape[1:]), dtype=of.dtype)])

        self._used = room(self._used, n + len(sums))
        self._used[n : n + len(sums)] = 0
        self._sums, self._start = room(self._sums, n + len(sums)), room(self._start, n + len(sums) + 1)
        self._pairs, self._times = room(self._pairs, held + len(pairs)), room(self._times, held + len(pairs))
        self._sums[n : n + len(sums)] = sums
        self._start[n : n + len(sums) + 1] = held + bounds
        self._pairs[held : held + len(pairs)], self._times[held : held + len(pairs)] = pairs, times

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """For each text: its measures, its groups as text, its distinct links in order, and how often each occurs."""
        if len(self._at) > CHUNKS or self._bytes > CHUNK_BYTES:
            self._thin()
        chunks = [_CUT.split(t) if self._separable else [t] for t in texts]
        if new := list(set().union(*chunks).difference(self._at)):
            self._learn(new)
        counts = np.array([len(c) for c in chunks], dtype=np.int64)
        listed = list(map(self._at.__getitem__, chain.from_iterable(chunks)))
        at = np.array(listed, dtype=np.int64)
        self._used[: len(self._groups)] += np.bincount(at, minlength=len(self._groups))
        edge = np.cumsum(counts) - counts
        sums = np.add.reduceat(self._sums[at], edge, axis=0) if len(texts) else np.zeros((0, 4), dtype=np.int64)
        groups = []
        for k, (s, n) in enumerate(zip(edge.tolist(), counts.tolist(), strict=True)):
            own = list(map(self._groups.__getitem__, listed[s : s + n]))
            whole = None not in own
            groups.append(";".join(own) if whole else "")
            if not whole:
                sums[k] = 0
        text_of = np.repeat(np.arange(len(texts)), counts)
        long = self._start[at + 1] - self._start[at]
        place = np.repeat(self._start[at] - (np.cumsum(long) - long), long) + np.arange(int(long.sum()))
        pairs, times, text_of = self._pairs[place], self._times[place], np.repeat(text_of, long)
        if (sums[:, 0] == 0).any():
            some = sums[text_of, 0] > 0
            pairs, times, text_of = pairs[some], times[some], text_of[some]
        span = max(len(self._a_bytes) * self.width, 1)
        keyed = text_of * span + pairs
        if (times == 1).all():
            keyed.sort()
        else:
            order = np.argsort(keyed)
            keyed, times = keyed[order], times[order]
        first = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]]) if len(keyed) else np.zeros(0, dtype=np.int64)
        total = np.add.reduceat(times, first) if len(keyed) else times
        keyed = keyed[first]
        borders = np.searchsorted(keyed, np.arange(1, len(texts)) * span)
        return sums, groups, np.split(keyed % span, borders), np.split(total, borders)


_ALIGNED = pa.schema([("key", pa.binary()), ("n", pa.int64()), *[(m, pa.int64()) for m in MEASURES], ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])


def _pack(numbers: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, behind one byte that says how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << (8 * w))
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=f"<u{packed[0]}", offset=1).astype(np.int64)


def _batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def align_texts(docs: DataFrame, paths: tuple[str | None, str | None]) -> DataFrame:
    """key, n, measures, groups_sha256, pairs and times (packed) of each distinct text that is not empty; n: how many rows have it."""
    texts = docs.filter(F.length("text") > 0).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    texts = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = tokens.shared(Aligner, paths)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            part = np.cumsum(list(map(len, texts))) // AT_ONCE
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for start, stop in zip(starts.tolist(), [*starts[1:].tolist(), len(texts)], strict=True):
                sums, groups, pairs, times = aligner.align(texts[start:stop])
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                some = batch.slice(start, stop - start)
                yield _batch(_ALIGNED, [some.column("key"), some.column("n"), *sums.T, digests, list(map(_pack, pairs)), list(map(_pack, times))])

    return texts.mapInArrow(run, _ddl(_ALIGNED))


def count_pairs(aligned: DataFrame) -> DataFrame:
    """pair, docs: how many documents hold each link."""
    schema = pa.schema([("pair", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, held, fewest = [], [], 0, 0

        def merge() -> None:
            nonlocal pairs, docs, held
            distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
            pairs, docs = [distinct], [np.bincount(at, np.concatenate(docs), len(distinct)).astype(np.int64)]
            held = len(distinct)

        for batch in batches:
            for packed, n in zip(batch.column("pairs").to_pylist(), batch.column("n").to_pylist(), strict=True):
                some = _unpack(packed)
                pairs.append(some)
                docs.append(np.full(len(some), n))
                held += len(some)
                if held > COUNTED + fewest:
                    merge()
                    fewest = held
                    if held > COUNTED:
                        yield _batch(schema, [pairs[0], docs[0]])
                        pairs, docs, held, fewest = [], [], 0, 0
        if pairs:
            merge()
            yield _batch(schema, [pairs[0], docs[0]])

    return aligned.select("pairs", "n").mapInArrow(run, _ddl(schema)).groupBy("pair").agg(F.sum("docs").alias("docs"))


def _threshold(counts: DataFrame, most: int) -> tuple[float, int, int]:
    """The least step of frequency, in quarters of powers of two, above which at most ``most`` links stand; how many links lie below, and in how many documents."""
    steps = counts.groupBy(F.floor(F.log2("docs") * 4).alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("docs").alias("docs")).orderBy(F.desc("step")).collect()  # some 250 rows
    held = 0
    for k, s in enumerate(steps):
        held += s["n"]
        if held > most:
            return steps[k]["step"] + 1, sum(r["n"] for r in steps[k:]), sum(r["docs"] for r in steps[k:])
    return 0, 0, 0


def score_links(aligned: DataFrame, counts: DataFrame, hot_pairs: int = HOT_PAIRS, shard_pairs: int = SHARD_PAIRS) -> DataFrame:
    """key, measures, groups_sha256, n_best, count_sum of each distinct text; ``counts``: pair, docs, best."""
    spark = aligned.sparkSession
    step, n_cold, cold_docs = _threshold(counts, hot_pairs)
    is_hot = F.floor(F.log2("docs") * 4) >= step
    hot = counts.filter(is_hot).toArrow()  # at most hot_pairs
    order = np.argsort(hot.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy()[order] for c in ("pair", "docs", "best")))
    del hot, order
    shards = 1 + max(n_cold, cold_docs) // shard_pairs
    schema = pa.schema([*[f for f in _ALIGNED if f.name in ("key", *MEASURES, "groups_sha256")], ("n_best", pa.int64()), ("count_sum", pa.int64()), ("batch", pa.int64()), ("doc", pa.int64()), ("shard", pa.int64()), ("entries", pa.binary())])
    kept = [f.name for f in schema][:6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, docs, best = shared.value
        name = TaskContext.get().partitionId() << 32
        for batch in batches:
            links = [_unpack(p) for p in batch.column("pairs").to_pylist()]
            doc = np.repeat(np.arange(len(links)), [len(x) for x in links])
            pair = np.concatenate([*links, np.zeros(0, dtype=np.int64)])
            times = np.concatenate([*map(_unpack, batch.column("times").to_pylist()), np.zeros(0, dtype=np.int64)])
            at = np.minimum(np.searchsorted(hot, pair), max(len(hot) - 1, 0))
            found = hot[at] == pair if len(hot) else np.zeros(len(pair), dtype=bool)
            add = lambda of: _sum_by(doc[found], of, len(links))  # noqa: B023, E731
            n_best, count_sum = add(times[found] * best[at[found]]), add(times[found] * docs[at[found]])
            yield _batch(schema, [*[batch.column(c) for c in kept], n_best, count_sum, [name] * len(links), np.arange(len(links)), *[[None] * len(links)] * 2])
            cold = np.zeros(int((~found).sum()), dtype=_COLD)
            cold["doc"], cold["pair"], cold["times"] = doc[~found], pair[~found], times[~found]
            shard = _shard(cold["pair"], shards)
            order = np.argsort(shard, kind="stable")
            cold, shard = cold[order], shard[order]
            here, first = np.unique(shard, return_index=True)
            if len(here):
                parts = [x.tobytes() for x in np.split(cold, first[1:])]
                empty = [[None] * len(here)]
                yield _batch(schema, [*empty * 8, [name] * len(here), *empty, here, parts])
            name += 1

    scored = cut(aligned.mapInArrow(run, _ddl(schema)), "align_scored")
    shared.unpersist()
    own = scored.filter("doc is not null").drop("shard", "entries")
    if n_cold:
        asked = scored.filter("shard is not null").select("shard", "batch", "entries").groupBy("shard")
        known = counts.filter(~is_hot).select(F.col("pair"), "docs", "best").withColumn("shard", _shard_of("pair", shards)).groupBy("shard")
        sums = asked.cogroup(known).applyInArrow(_answer, "batch long, doc long, more_best long, more_count long")
        sums = sums.groupBy("batch", "doc").agg(F.sum("more_best").alias("more_best"), F.sum("more_count").alias("more_count"))
        own = own.join(sums, ["batch", "doc"], "left").fillna(0, ["more_best", "more_count"])
        own = own.withColumns({"n_best": F.col("n_best") + F.col("more_best"), "count_sum": F.col("count_sum") + F.col("more_count")})
    return own.select(*kept, "n_best", "count_sum")


_MIX = 0x9E3779B1  # odd, so that the low bits of neighbours spread


def _shard(pairs: np.ndarray, shards: int) -> np.ndarray:
    return ((pairs.astype(np.int64) % (1 << 31)) * _MIX % (1 << 32) % shards).astype(np.int64)


def _shard_of(pair: str, shards: int):
    return (F.col(pair) % (1 << 31)) * F.lit(_MIX) % F.lit(1 << 32) % F.lit(shards)


def _sum_by(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Whole sums of values by place."""
    out = np.zeros(n, dtype=np.int64)
    np.add.at(out, at, values.astype(np.int64))
    return out


def _answer(asked: pa.Table, known: pa.Table) -> pa.Table:
    """The sums of a shard's links for each text that asks."""
    order = np.argsort(pairs := known.column("pair").to_numpy())
    pairs, docs, best = pairs[order], known.column("docs").to_numpy()[order], known.column("best").to_numpy()[order]
    parts: list[list[np.ndarray]] = [[], [], [], []]
    for batch, packed in zip(asked.column("batch").to_pylist(), asked.column("entries").to_pylist(), strict=True):
        entries = np.frombuffer(packed, dtype=_COLD)
        at = np.searchsorted(pairs, entries["pair"].astype(np.int64))
        doc, place = np.unique(entries["doc"], return_inverse=True)
        for part, of in zip(parts, (np.full(len(doc), batch), doc.astype(np.int64), _sum_by(place, entries["times"] * best[at], len(doc)), _sum_by(place, entries["times"] * docs[at], len(doc))), strict=True):
            part.append(of)
    return pa.table({c: np.concatenate(p) if p else np.zeros(0, dtype=np.int64) for c, p in zip(("batch", "doc", "more_best", "more_count"), parts, strict=True)})


def _width(path: str | None) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or tokens.default_path("piece_bpe_32k.model")).vocab_size()


def align_corpus(docs: DataFrame, paths: tuple[str | None, str | None] = (None, None), hot_pairs: int = HOT_PAIRS, shard_pairs: int = SHARD_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, measures, n_best, count_sum, groups_sha256 of every row; a, b, docs, best of every link of the corpus)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    width = spark.sparkContext.broadcast(None) and Aligner(paths).width
    aligned = cut(align_texts(docs, paths), "aligned_texts")
    counts = cut(count_pairs(aligned), "link_counts").withColumn("a", F.floor(F.col("pair") / width))
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))  # a row for each id of A's vocabulary at most
    counts = cut(counts.join(F.broadcast(most), "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best")), "link_table")
    scored = score_links(aligned, counts, hot_pairs, shard_pairs)
    rows = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key")).join(scored, "key", "left")
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    links = counts.select(F.floor(F.col("pair") / width).alias("a"), (F.col("pair") % width).alias("b"), "docs", (F.col("best") == 1).alias("best"))
    return rows.select("doc_id", *sums, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256")), links
