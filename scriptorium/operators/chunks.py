"""Documents to overlapping chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.text import collapsed
from scriptorium.session import ship_code


def word_windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """doc_id, chunk, start, n_words, text: windows of words, by array functions alone."""
    step = size - overlap
    words = docs.select("doc_id", F.split(collapsed(F.col("text")), " ").alias("w"))
    last = F.floor((F.greatest(F.size("w") - overlap, F.lit(1)) - 1) / step)
    parts = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    part = F.slice("w", F.col("chunk").cast("int") * step + 1, size)
    return parts.select("doc_id", "chunk", (F.col("chunk") * step).alias("start"), F.size(part).cast("long").alias("n_words"), F.array_join(part, " ").alias("text"))


_MATH = re.compile(r"\$\$.+?\$\$|\$[^$\n]+\$", re.S)
_SENTENCE = re.compile(r"[^.!?]+[.!?]*\s*")


def split_units(paragraph: str, most: int) -> list[str]:
    """A paragraph, or its sentences if it is long, or runs of ``most`` words of a longer sentence; formulas are never cut."""
    if len(paragraph.split()) <= most or _MATH.search(paragraph):
        return [paragraph]
    out = []
    for sentence in _SENTENCE.findall(paragraph):
        words = sentence.split()
        out += [" ".join(words[k : k + most]) for k in range(0, len(words), most)]
    return out


def chunk_text(text: str, size: int = 800, overlap: int = 150, least: int = 100) -> list[str]:
    """Paragraphs packed to ``size`` words; the next chunk begins with the last ``overlap`` words.
    A last chunk under ``least`` words joins the one before it, if there is one."""
    out: list[list[str]] = []
    now: list[str] = []
    fresh = 0
    for paragraph in text.split("\n"):
        for unit in split_units(paragraph.strip(), size):
            words = unit.split()
            if now and len(now) + len(words) > size and fresh:
                out.append(now)
                now, fresh = now[-overlap:] if overlap else [], 0
            now = now + words
            fresh += len(words)
    if fresh:
        if out and fresh < least:
            out[-1] = out[-1] + now[-fresh:]
        else:
            out.append(now)
    return [" ".join(c) for c in out]


def hierarchical(docs: DataFrame, size: int = 800, overlap: int = 150, least: int = 100) -> DataFrame:
    """doc_id, level, chunk, n_words, text: a summary chunk (the first line) and the chunks of the body."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                head = text.split("\n", 1)[0].strip()
                rows.append((doc_id, "summary", 0, len(head.split()), head))
                rows += [(doc_id, "body", k, len(c.split()), c) for k, c in enumerate(chunk_text(text, size, overlap, least))]
            yield pd.DataFrame(rows, columns=["doc_id", "level", "chunk", "n_words", "text"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, level string, chunk long, n_words long, text string")
