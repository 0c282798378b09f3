"""Remove every byte that lies in a 200-byte string which also starts elsewhere.

A window (200-byte string) has an anchor: the start of its leftmost 8-byte string
with the smallest hash.  Equal windows have their anchor at the same offset, so the
windows of an anchor are cut by that offset into blocks of ``BLOCK``; all windows of
a block share a core of 200 - ``BLOCK`` + 1 bytes around the anchor, and the core's
hash is the block's key.  Equal windows have equal keys.

Tasks pack their blocks by bucket of the key, a few bytes each.  Blocks of one key
whose whole strings agree are copies: their windows repeat, and one of them stands
for the others in what follows (a task does this before it writes anything, a bucket
for what tasks have left).  Where strings of one key differ, at the ends of a
repeat, the strings are fetched and a suffix array of them finds the windows that
repeat; the core that they share is one symbol in it.  A key with more than ``GROUP_STRINGS`` strings is not gathered: its strings are
cut into blocks of ``FINE`` windows, whose cores are longer, and settled alike; what
then still shares a key so often is grouped by the bytes of its windows, by Spark.

Matches never cross documents; all judgements are on the input texts.  Strings are
compared by their bytes, but for whole blocks that agree: those are taken for copies when
the hashes of string and core, 96 bits at least, the anchor's place and the number of
windows agree (of n blocks, a wrong pair has a chance of n * n / 2**97).

Defined results: a null text is empty; rows of one doc_id are one document, whose text
is the greatest of theirs, and come back once each, those with another text as they
are; a null doc_id is left as it is; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm import tokens
from scriptorium.llm.shingles import mix
from scriptorium.llm.suffix_array import repeated_starts
from scriptorium.operators.tables import one_row_each
from scriptorium.session import cut, input_bytes, small_batches

WIDTH = 200
BLOCK = 64
GRAM = 8
FINE = 8
GROUP_STRINGS = 400
TASK_STRINGS = 500  # strings of several keys that share a task
BUCKET_BYTES = 2 << 20
_CHUNK = 1 << 20  # bytes scanned at once; a scan holds about 150 bytes for each
_FLUSH = 1_500_000  # blocks a task holds before it writes them out
_U = np.uint64
_RNG = np.random.default_rng(987)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = _U(0xD6E8FEB86659FD93)
_BACK = _U(pow(int(_STEP), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row (van Herk's two running minima)."""
    n = len(values) - width + 1
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def blocks(data: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, first window, windows, string hash and the anchor's offset in the string, of every block of a buffer.

    ``own`` numbers the document of each byte; windows that cross documents don't count.
    """
    n = len(data) - WIDTH + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    wide = data.astype(np.uint64)
    m = len(data) - GRAM + 1
    gram = np.zeros(m, dtype=np.uint64)
    for k in range(GRAM):
        gram = (gram << _U(8)) | wide[k : k + m]
    rank = ((mix(gram) >> _U(24)) << _U(24)) | np.arange(m, dtype=np.uint64)
    least = _leftmost_least(rank, WIDTH - GRAM + 1)
    anchor = (least & _U((1 << 24) - 1)).astype(np.int64)
    window = np.flatnonzero(own[:n] == own[WIDTH - 1 :])
    back = anchor[window] - window
    place = back // BLOCK
    fresh = np.ones(len(window), dtype=bool)
    fresh[1:] = (np.diff(window) != 1) | (np.diff(anchor[window]) != 0) | (np.diff(place) != 0)
    at = np.flatnonzero(fresh)
    first, count = window[at], np.diff(np.append(at, len(window)))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _powers(_STEP, len(data)), dtype=np.uint64, out=sums[1:])
    backs = _powers(_BACK, len(data) + 1)
    hashed = lambda a, b: mix((sums[b] - sums[a]) * backs[a])
    core_from = anchor[first] - place[at] * BLOCK
    key = mix(hashed(core_from, core_from + WIDTH - BLOCK + 1) + place[at].astype(np.uint64))
    string = hashed(first, first + count + WIDTH - 1) ^ mix((anchor[first] - first).astype(np.uint64))
    return key, first, count, string, back[at]


def _buffers(ids: list[int], texts: list[str]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Documents, offsets and pieces in buffers of about ``_CHUNK`` bytes; pieces of long texts overlap by a window."""
    docs, offsets, pieces, held = [], [], [], 0
    for doc, text in zip(ids, texts, strict=True):
        raw = text.encode()
        for start in range(0, max(1, len(raw) - WIDTH + 1), _CHUNK):
            piece = raw[start : start + _CHUNK + WIDTH - 1]
            docs.append(doc)
            offsets.append(start)
            pieces.append(piece)
            held += len(piece)
            if held > _CHUNK:
                yield docs, offsets, pieces
                docs, offsets, pieces, held = [], [], [], 0
    if docs:
        yield docs, offsets, pieces


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of touching intervals, document by document."""
    if not len(doc):
        return doc, start, stop
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    new_doc = np.concatenate(([True], doc[1:] != doc[:-1]))
    base = np.cumsum(new_doc) * (int(stop.max()) + 1)  # lifts each document above the one before
    reach = np.maximum.accumulate(stop + base)
    fresh = new_doc.copy()
    fresh[1:] |= (start + base)[1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], (reach - base)[last]


def _copies(entries: np.ndarray) -> np.ndarray:
    """For entries sorted by (key, string, count): which agree with a neighbour."""
    same = (entries[1:]["key"] == entries[:-1]["key"]) & (entries[1:]["string"] == entries[:-1]["string"]) & (entries[1:]["count"] == entries[:-1]["count"])
    return same


_ENTRY = np.dtype([("key", "<u4"), ("string", "<u8"), ("count", "u1"), ("many", "u1"), ("back", "u1"), ("doc", "<i8"), ("start", "<u4")])
#: what = 0: bytes start to stop of doc are covered; 1: the string start to stop of doc under key is to be compared;
#: a packed row has a bucket and entries
_ROW = "bucket long, entries binary, what int, doc long, start long, stop long, key long, back int"


def _rows(what: int, doc, start, stop, key=0, back=0) -> pd.DataFrame:
    out = pd.DataFrame({"what": np.full(len(doc), what, np.int32), "doc": doc, "start": start, "stop": stop, "key": key, "back": back})
    return out.assign(bucket=out["doc"] & 0xFFFF if what == 0 else -1, entries=None)


class _Scan:
    """The blocks of a task."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, ids: list[int], texts: list[str]) -> None:
        for docs, offsets, pieces in _buffers(ids, texts):
            data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
            sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
            begins = np.cumsum(sizes) - sizes
            own = np.repeat(np.arange(len(pieces)), sizes)
            key, first, count, string, back = blocks(data, own)
            piece = own[first]
            self.parts.append((key, string, count.astype(np.uint8), back.astype(np.uint8), np.asarray(docs, np.int64)[piece], first - begins[piece] + np.asarray(offsets, np.int64)[piece]))
            self.held += len(key)

    def rows(self) -> Iterator[pd.DataFrame]:
        if not self.parts:
            return
        key, string, count, back, doc, start = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.lexsort((count, string, key))
        key, string, count, back, doc, start = (x[order] for x in (key, string, count, back, doc, start))
        same = (key[1:] == key[:-1]) & (string[1:] == string[:-1]) & (count[1:] == count[:-1])
        head = np.concatenate(([True], ~same)) if len(key) else np.zeros(0, bool)
        many = np.zeros(len(key), dtype=bool)
        many[1:] |= same
        many[:-1] |= same
        yield _rows(0, *_merged(doc[many], start[many], start[many] + count[many] + WIDTH - 1))
        bucket = (key[head] % _U(self.buckets)).astype(np.int64)
        entries = np.zeros(int(head.sum()), dtype=_ENTRY)
        entries["key"], entries["string"], entries["count"] = key[head] >> _U(32), string[head], count[head]
        entries["many"], entries["back"], entries["doc"], entries["start"] = many[head], back[head], doc[head], start[head]
        order = np.argsort(bucket, kind="stable")
        bucket, entries = bucket[order], entries[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        packed = [(int(bucket[a]), entries[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])]
        yield pd.DataFrame(packed, columns=["bucket", "entries"]).assign(what=2, doc=-1, start=0, stop=0, key=0, back=0)


def _bucket(rows: pd.DataFrame) -> pd.DataFrame:
    e = np.frombuffer(b"".join(rows["entries"]), dtype=_ENTRY)
    e = e[np.lexsort((e["count"], e["string"], e["key"]))]
    first = np.concatenate(([True], e["key"][1:] != e["key"][:-1]))
    run = np.cumsum(first) - 1
    shared = (np.bincount(run) > 1)[run]
    e, run = e[shared], run[shared]
    same = (e["key"][1:] == e["key"][:-1]) & (e["string"][1:] == e["string"][:-1]) & (e["count"][1:] == e["count"][:-1])
    copy = np.zeros(len(e), dtype=bool)
    copy[1:] |= same
    copy[:-1] |= same
    stop = e["start"].astype(np.int64) + e["count"] + WIDTH - 1
    cover = _rows(0, *_merged(e["doc"][copy].astype(np.int64), e["start"][copy].astype(np.int64), stop[copy]))
    # one string of each kind goes on, if its key has several kinds, and one of them isn't covered yet
    head = np.concatenate(([True], ~same)) if len(e) else np.zeros(0, bool)
    runs = int(run.max()) + 1 if len(run) else 0
    kinds, single = np.bincount(run[head], minlength=runs), np.bincount(run[~copy & (e["many"] == 0)], minlength=runs)
    go = head & (kinds[run] > 1) & (single[run] > 0) if len(e) else head
    key = (e["key"].astype(np.int64) << 24) + (int(rows["bucket"].iloc[0]) & 0xFFFFFF)
    ask = _rows(1, e["doc"][go].astype(np.int64), e["start"][go].astype(np.int64), stop[go], key[go], e["back"][go].astype(np.int32))
    return pd.concat([cover, ask])[["what", "doc", "start", "stop", "key", "back"]]


def _compare(group: pd.DataFrame) -> pd.DataFrame:
    """Suffix arrays of the strings of a few keys; the core that a key's strings share is one symbol."""
    out = []
    for _, own in group.groupby(["key", "size"]):
        size, by_core = int(own["size"].iloc[0]), {}
        for doc, start, string, at in own[["doc", "start", "string", "core"]].itertuples(index=False, name=None):
            by_core.setdefault(string[at : at + size], []).append((doc, start, string, at))  # keys are hashes
        for rows in by_core.values():
            if len(rows) > 1:
                _, _, strings, cores = zip(*rows, strict=True)
                for (doc, start, _, _), hits in zip(rows, repeated_starts(list(strings), WIDTH, list(cores), size), strict=True):
                    at = np.asarray(hits, dtype=np.int64) + start
                    out.append((np.full(len(at), doc, np.int64), at, at + WIDTH))
    doc, start, stop = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pd.DataFrame(dict(zip(("doc", "start", "stop"), _merged(doc, start, stop), strict=True)))


def _by_size(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strings of keys with 2 to ``GROUP_STRINGS`` strings, and of larger keys."""
    sizes = strings.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return strings.join(sizes.filter(f"n between 2 and {GROUP_STRINGS}"), "key", "left_semi"), strings.join(sizes.filter(f"n > {GROUP_STRINGS}"), "key", "left_semi")


def _by_suffix_arrays(strings: DataFrame) -> DataFrame:
    groups = max(64, strings.count() // TASK_STRINGS)
    dealt = strings.select("doc", "start", "key", "core", "size", "string", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("group"))
    # few bytes, much work: so many partitions, whatever their size
    return dealt.repartition(min(groups, 2000), "group").groupBy("group").applyInPandas(_compare, "doc long, start long, stop long")


def _finer(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strings cut into blocks of ``FINE`` windows, again by the anchor's offset, each keyed by its longer core.

    Gives the spans of strings that occur more than once, and one string of each kind.
    """
    more = F.length("string") - WIDTH  # windows of a string, less one
    block = F.explode(F.sequence(F.floor((F.col("back") - more) / FINE), F.floor(F.col("back") / FINE)).cast("array<int>")).alias("block")
    far, near = F.least(F.col("back"), F.col("block") * FINE + FINE - 1), F.greatest(F.col("back") - more, F.col("block") * FINE)
    part = F.substring("string", F.col("back") - far + 1, far - near + WIDTH)
    core = F.substring("string", F.col("back") - F.col("block") * FINE + 1, F.lit(WIDTH - FINE + 1))
    parts = strings.select("doc", "start", "back", "key", "string", block)
    parts = cut(parts.select("doc", (F.col("start") + F.col("back") - far).alias("start"), F.xxhash64("key", "block", core).alias("key"), (far - F.col("block") * FINE).cast("int").alias("core"), part.alias("string")), "repeat_parts")
    kinds = parts.groupBy("key", "string").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "start", "core")).alias("one"))
    copies = parts.join(kinds.filter("n > 1").select("key", "string"), ["key", "string"], "left_semi").select("doc", "start", (F.col("start") + F.length("string")).alias("stop"))
    return copies, kinds.select("one.doc", "one.start", "one.core", F.lit(WIDTH - FINE + 1).alias("size"), "key", "string")


def _by_windows(strings: DataFrame) -> DataFrame:
    """Every window of the strings, grouped by its bytes."""
    starts = F.explode(F.sequence(F.lit(0), F.length("string") - WIDTH)).alias("at")
    windows = strings.select("doc", "start", "string", starts)
    windows = windows.select("doc", (F.col("start") + F.col("at")).alias("start"), F.substring(F.col("string"), F.col("at") + 1, F.lit(WIDTH)).alias("window"))
    counts = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("window")
    return windows.join(counts, "window", "left_semi").select("doc", "start", (F.col("start") + WIDTH).alias("stop"))


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc, start, stop: bytes of documents (doc_id, text) that repeated windows cover; spans may overlap.

    Also gives the rows that documents of several rows were judged by, if there are such documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts, judged = one_row_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text", BROADCAST_IDS)
    texts = texts.filter("doc_id is not null and octet_length(text) > 0")
    buckets = int(np.clip(input_bytes(docs) // BUCKET_BYTES, 64, 1 << 24))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens.release()
        task = _Scan(buckets)
        for batch in batches:
            batch = batch[batch["text"].map(len) >= WIDTH // 4]
            task.add(batch["doc_id"].tolist(), batch["text"].tolist())
            if task.held > _FLUSH:
                yield from (x[_NAMES] for x in task.rows())
        yield from (x[_NAMES] for x in task.rows())

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        packed = rows["what"] == 2
        parts = [rows.loc[~packed, ["what", "doc", "start", "stop", "key", "back"]]]
        if packed.any():
            parts.append(_bucket(rows[packed]))
        return pd.concat(parts)

    scanned = texts.mapInPandas(scan, _ROW)
    scanned = scanned.withColumn("bucket", F.when(F.col("what") == 0, F.pmod(F.xxhash64("doc", "start"), F.lit(buckets))).otherwise(F.col("bucket")))
    found = cut(scanned.groupBy("bucket").applyInPandas(settle, "what int, doc long, start long, stop long, key long, back int"), "repeat_found")
    covered = found.filter("what = 0").select("doc", "start", "stop")
    asked = found.filter("what = 1").select("doc", "start", "stop", "key", "back")

    ids = cut(asked.select(F.col("doc").alias("doc_id")).distinct(), "repeat_ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("shuffle_hash")
    sources = texts.join(ids, "doc_id", "left_semi").withColumnRenamed("doc_id", "doc")
    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "key", "back")).alias("asks"))

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                asks = {c: np.concatenate(batch[c].to_list()) for c in ("start", "stop", "key", "back")}
                cut_from = np.repeat(np.arange(len(batch)), batch["start"].map(len))
                raw = [t.encode() for t in batch["text"]]
                strings = [raw[k][a:b] for k, a, b in zip(cut_from.tolist(), asks["start"].tolist(), asks["stop"].tolist(), strict=True)]
                doc = batch["doc"].to_numpy()[cut_from]
                yield pd.DataFrame({"doc": doc, "start": asks["start"], "back": asks["back"], "key": asks["key"], "string": strings})

    asks = [F.col(f"asks.{c}").alias(c) for c in ("start", "stop", "key", "back")]
    strings = sources.join(by_doc, "doc").select("doc", "text", *asks).mapInPandas(pieces, "doc long, start long, back int, key long, string binary")
    strings = cut(strings.withColumns({"core": F.col("back") % BLOCK, "size": F.lit(WIDTH - BLOCK + 1)}), "repeat_strings")
    few, large = _by_size(strings)
    copies, kinds = _finer(large)
    few_finer, still_large = _by_size(kinds)
    direct = _by_suffix_arrays(few.drop("back").unionByName(few_finer)).unionByName(copies).unionByName(_by_windows(still_large))
    return covered.unionByName(direct), judged


_NAMES = [c.split()[0] for c in _ROW.split(", ")]
BROADCAST_IDS = 2_000_000


def remove_repeats(docs: DataFrame, keep_columns: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text for every row; with ``keep_columns`` ``row``, the input's columns, in the place of doc_id.

    kept_text is what remains, decoded (bytes of a character cut in two are dropped).
    """
    spans, judged = repeated_spans(docs)
    cuts = spans.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    if judged is not None:
        cuts = cuts.join(judged.select(F.col("doc_id").alias("doc"), F.sha2("text", 256).alias("of")), "doc", "left")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep_columns else F.struct("doc_id")
    base = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    joined = base.join(cuts, F.col("id") == F.col("doc"), "left")
    if judged is not None:
        joined = joined.withColumn("cuts", F.when(F.col("of").isNull() | (F.col("of") == F.sha2("text", 256)), F.col("cuts")))

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string, kept_text string")
    def cut_out(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        out = []
        for t, c in zip(texts, cuts, strict=True):
            raw = t.encode()
            if c is None or not len(c):
                out.append((0, 0, hashlib.sha256(raw).hexdigest(), t))
                continue
            start, stop = np.asarray([x["start"] for x in c], np.int64), np.asarray([x["stop"] for x in c], np.int64)
            _, start, stop = _merged(np.zeros(len(start), np.int64), start, np.minimum(stop, len(raw)))
            edges = [0, *np.column_stack((start, stop)).ravel().tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            out.append((int((stop - start).sum()), len(start), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore")))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256", "kept_text"])

    made = joined.select("row", F.octet_length("text").cast("long").alias("n_bytes"), cut_out("text", "cuts").alias("r"))
    return made.select("row" if keep_columns else "row.doc_id", "n_bytes", "r.n_removed", "r.n_spans", "r.kept_sha256", "r.kept_text")
