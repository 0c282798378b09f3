"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Lengths are whole numbers from 1 to the capacity, so the packing problem is the
histogram of lengths: at most ``capacity`` numbers, however many documents there
are.  The bins of best-two-fit are computed on that histogram; a bin pattern is
repeated while the greedy choice would repeat it.  Every piece then finds its
place by its running number among the pieces of its length, which Spark computes
with salted windows, so a length that a third of all pieces share is dealt over
many tasks.

Defined results: a null text is an empty document (one closing token); repeated
rows are packed once each; an empty table gives no rows; extra columns of the
input are ignored by :func:`token_pieces` and kept by :func:`pack`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import tokens
from scriptorium.session import cut, small_batches

CAPACITY = 2048
#: Pieces of one length are numbered in groups of about this many rows.
GROUP_ROWS = 500
_SHIFT = 44  # bits of a piece's running number in a lookup key


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of an n-token document: full pieces, the first may be shorter."""
    head = n % capacity or capacity
    if n <= capacity:
        return [(0, n)]
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those above ``capacity``: doc_id, piece, start, length, ids_crc32 (and ids)."""
    small_batches(docs.sparkSession)
    tail = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokens.shared(tokens.ByteBpe, tokenizer_path)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], bpe.ids(batch["text"].tolist()), strict=True):
                ids += tail
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, k, start, length, zlib.crc32(part)) + ((np.frombuffer(part, dtype="<u4").astype("int64"),) if with_ids else ()))
            yield pd.DataFrame(rows, columns=names)

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.LongType()))
    names = schema.names
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)


class _Stock:
    """Unpacked pieces by length, with the longest available length up to any x."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64)
        self.best = np.zeros(len(counts), dtype=np.int64)
        self._refresh()

    def _refresh(self) -> None:
        self.best = np.maximum.accumulate(np.where(self.left > 0, np.arange(len(self.left)), 0))

    def take(self, length: int, n: int = 1) -> None:
        self.left[length] -= n
        if not self.left[length]:
            self._refresh()

    def give(self, length: int) -> None:
        self.left[length] += 1
        if self.left[length] == 1:
            self._refresh()

    def pair(self, gap: int) -> tuple[int, int]:
        """The two available lengths with the largest sum up to ``gap``; (0, 0) if there are none."""
        firsts = np.flatnonzero(self.left[:gap])
        if not len(firsts):
            return 0, 0
        seconds = self.best[gap - firsts]
        same = seconds == firsts
        if same.any():  # the second may need another piece of the same length
            lone = same & (self.left[firsts] < 2)
            seconds[lone] = self.best[firsts[lone] - 1]
        sums = np.where(seconds > 0, firsts + seconds, 0)
        k = int(np.argmax(sums))
        return (int(firsts[k]), int(seconds[k])) if sums[k] else (0, 0)


def best_two_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (times, [(length, pieces of that length in a bin)]), longest pieces first.

    ``counts[x]`` is the number of pieces of length x.  A bin takes the longest
    piece left that fits, until none fits.  Then, if two unpacked pieces fill the
    gap left without the bin's smallest piece better than that piece, they
    replace it.
    """
    stock, out = _Stock(counts), []
    while True:
        bin_, gap = [], capacity
        while length := int(stock.best[gap]):
            stock.take(length)
            bin_.append(length)
            gap -= length
        if not bin_:
            return out
        while gap and len(bin_) > 1:
            smallest = bin_[-1]
            a, b = stock.pair(gap + smallest)
            if a + b <= smallest:
                break
            bin_.pop()
            stock.give(smallest)
            stock.take(a)
            stock.take(b)
            bin_ = sorted([*bin_, a, b], reverse=True)
            gap += smallest - a - b
        lengths, each = np.unique(bin_, return_counts=True)
        more = int((stock.left[lengths] // each).min())
        for length, n in zip(lengths, each, strict=True):
            if more:
                stock.take(int(length), int(n) * more)
        out.append((1 + more, [(int(x), int(n)) for x, n in zip(lengths[::-1], each[::-1], strict=True)]))


def _places(bins: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> np.ndarray:
    """Rows (key, each, sequence, offset): pieces of a length from a running number on lie in these bins."""
    used, rows, sequence = np.zeros(capacity + 1, dtype=np.int64), [], 0
    for times, bin_ in bins:
        offset = 0
        for length, each in bin_:
            rows.append(((length << _SHIFT) + int(used[length]), each, sequence, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 4)


def _numbered(pieces: DataFrame) -> DataFrame:
    """Add ``_number``: 0, 1, 2, ... among the pieces of the same length, without gathering a length in one task."""
    most = pieces.groupBy("length").count().agg(F.max("count")).first()[0] or 0
    salts = max(64, -(-most // GROUP_ROWS))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(within).cast("long") - 1)
    return ranked.join(sizes, ["length", "_salt"]).withColumn("_number", F.col("_before") + F.col("_rank")).drop("_salt", "_rank", "_before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, piece, length, ...) of lengths 1 to ``capacity``.

    ``pieces`` is read several times: pass a table that is stored (see ``cut``).
    """
    spark = pieces.sparkSession
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    places = spark.sparkContext.broadcast(_places(best_two_fit(counts, capacity), capacity))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, each, sequence, offset = places.value.T
        for batch in batches:
            length, number = batch["length"].to_numpy(np.int64), batch["_number"].to_numpy(np.int64)
            at = np.searchsorted(key, (length << _SHIFT) + number, side="right") - 1
            turn, place = np.divmod(number - (key[at] & ((1 << _SHIFT) - 1)), each[at]) if len(batch) else (number, number)
            yield batch.drop(columns="_number").assign(sequence_id=sequence[at] + turn, offset=offset[at] + place * length)

    numbered = _numbered(pieces).select(*pieces.columns, "_number")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInPandas(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(cut(token_pieces(docs, capacity, tokenizer_path=tokenizer_path, with_ids=with_ids), "pieces"), capacity)
