"""Token counts without token ids.

A task splits each text into pre-tokens, counts the pieces of every distinct
pre-token once, and joins those counts to the text's pre-token frequencies; the
join is a lookup inside the task, so nothing is shuffled.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are kept
as they are, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import tokens
from scriptorium.session import small_batches

LIMIT = 4096


def count_tokens(docs: DataFrame, limit: int = LIMIT, model_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = tokens.shared(tokens.PieceCounter, model_path)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": counter.counts(batch["text"].tolist())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    counted = rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
