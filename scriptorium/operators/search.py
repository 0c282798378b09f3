"""Keyword and vector search for a table of queries, fusion, and context assembly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as X
from scriptorium.session import cut

RRF_K = 60
#: Bound of the query vectors that are broadcast at once.
QUERY_BYTES = 32 << 20
#: Vectors of a task that meet the queries at once, and scores that are in memory at once.
ROWS, TILE = 1000, 1 << 20
K1, B = 1.2, 0.75


def visible(owner: Column, user: str | None, scope: str = "both") -> Column:
    """Rows a user may see: shared ones (no owner), their own, or both.  Without a user, only shared ones."""
    shared, own = owner.isNull(), F.coalesce(owner == user, F.lit(False)) if user else F.lit(False)
    return {"shared_only": shared, "user_only": own, "both": shared | own}[scope]


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, key, tf, dl: the inverted index of a table."""
    terms = docs.select(key, X.index_terms(F.col(text)).alias("terms")).withColumn("dl", F.size("terms"))
    return terms.select(key, "dl", F.explode("terms").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """query_id, key, bm25_score, bm25_rank of the best ``k`` documents of every query (query_id, text).

    Texts are tokenised once: an empty term beside the terms carries each document's length to the corpus statistics.
    Only postings of query terms are kept; ties go to the smaller key.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(X.index_terms(F.col("text")))).alias("term"))
    wanted = asked.select("term").union(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    terms = docs.select(key, X.index_terms(F.col("text")).alias("terms"))
    terms = terms.select(key, F.size("terms").alias("dl"), F.explode(F.concat(F.array(F.lit("")), "terms")).alias("term"))
    held = cut(terms.join(wanted, "term", "left_semi").groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    corpus = held.filter("term = ''").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    found = held.filter("term <> ''")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    hits = asked.join(df, "term").join(found, "term").join(F.broadcast(corpus))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scores = hits.groupBy("query_id", key).agg(F.round(F.sum(idf * weight), 6).alias("bm25_score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25_score"), key))
    return scores.withColumn("bm25_rank", rank.cast("long")).filter(F.col("bm25_rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), np.finfo(float).tiny)


def _coded(x: np.ndarray, clip: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors from a byte a component, and how far each is from the vector's own; ``clip`` for all or each component."""
    clip = np.maximum(clip, np.finfo(float).tiny)
    codes = _unit(np.rint(np.clip(x / clip * 127, -127, 127)).astype(np.int8) * clip)
    return codes, np.sqrt(((codes - _unit(x)) ** 2).sum(axis=1))


def _rows_of(batches: Iterator[pd.DataFrame], held: tuple, k: int, key: str, clip: float | np.ndarray | None, skip_self: bool) -> Iterator[pd.DataFrame]:
    """The best ``k`` rows of each query among a task's vectors; equal scores beyond ``k`` stay until keys decide.

    Products are of at most ``TILE`` scores at once; of each query, scores under the ``k``-th best so far are left out.
    """
    ids, queries = held
    wide, best, waiting = _unit(queries), [], 0
    more = k + int(skip_self)  # a query's own row may hold one of the places
    code, off = _coded(queries, clip) if clip is not None else (None, None)
    least = np.full(len(ids), -np.inf)

    def pruned() -> pd.DataFrame:
        rows = pd.concat(best).sort_values(["q", "similarity", key], ascending=[True, False, True])
        return rows.groupby("q").head(k)

    def scored(x: np.ndarray, own: np.ndarray, some: slice) -> pd.DataFrame:
        unit, first = _unit(x), len(x) > more and not np.isfinite(least[some]).all()
        if clip is not None:
            own_code, own_off = _coded(x, clip)
            rough = own_code @ code[some].T
            slack = own_off[:, None] + off[None, some] + own_off[:, None] * off[None, some] + 1e-6
            floor = np.maximum(least[some], np.partition(rough - slack, -more, axis=0)[-more]) if first else least[some]
            rough += slack
            at, q = np.nonzero(rough >= floor[None, :])
            scores = np.empty(len(at))
            for i in range(0, len(at), TILE // unit.shape[1] + 1):
                part = slice(i, i + TILE // unit.shape[1] + 1)
                scores[part] = np.round((unit[at[part]] * wide[some][q[part]]).sum(axis=1), 6)
        else:
            near = np.round(unit @ wide[some].T, 6)
            floor = np.maximum(least[some], np.partition(near, -more, axis=0)[-more]) if first else least[some]
            at, q = np.nonzero(near >= floor[None, :])
            scores = near[at, q]
        q = q + some.start
        if skip_self:
            other = own[at] != ids[q]
            at, q, scores = at[other], q[other], scores[other]
        return pd.DataFrame({"q": q, key: own[at], "similarity": scores})

    for batch in batches:
        batch = batch[batch["embedding"].map(lambda e: e is not None and len(e) == wide.shape[1])]
        for i in range(0, len(batch), ROWS):
            rows = batch[i : i + ROWS]
            x, own = np.stack(rows["embedding"].to_numpy()).astype(float), rows[key].to_numpy()
            for j in range(0, len(ids), TILE // ROWS):
                best.append(scored(x, own, slice(j, min(len(ids), j + TILE // ROWS))))
                waiting += len(best[-1])
                if waiting > max(8 * k * len(ids), TILE // 4):
                    best[:] = [pruned()]
                    waiting = len(best[0])
                    worst = best[0].groupby("q")["similarity"].agg(["min", "size"])
                    full = worst[worst["size"] == k]
                    least[full.index] = full["min"] - 1e-6  # rounded scores
    if best:
        rows = pruned()
        yield rows.assign(query_id=ids[rows["q"].to_numpy()])[["query_id", key, "similarity"]]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", clip: float | np.ndarray | None = None, skip_self: bool = False) -> DataFrame:
    """query_id, key, similarity, semantic_rank by exact cosine; ``queries`` has (query_id, query_vector).

    Queries meet the vectors in matrix products; each task returns the best ``k`` of its vectors for each query.  Query
    vectors are broadcast in blocks of at most ``QUERY_BYTES``; each block is one scan of the vectors.  With ``clip``,
    vectors are compared in bytes first, clipped there, and only those that the codes' errors cannot rule out exactly.
    Null vectors take no part, and vectors of another length than the query's (each length of queries is a scan); a zero vector has the similarity 0; ``skip_self`` leaves out a query's own key.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query_vector")).alias("d")).first()
    parts = max(1, -(-(size["n"] or 0) * (size["d"] or 0) * 8 // QUERY_BYTES))
    kinds = {"q": queries.schema["query_id"].dataType.simpleString(), "k": vectors.schema[key].dataType.simpleString()}
    dealt = queries.filter("query_vector is not null").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    found = []
    for part in range(parts):
        block = dealt.filter(F.col("part") == part).select("query_id", "query_vector").toPandas()
        for _, some in block.groupby(block["query_vector"].map(len)):
            held = vectors.sparkSession.sparkContext.broadcast((some["query_id"].to_numpy(), np.stack(some["query_vector"].to_numpy()).astype(float)))
            run = lambda batches, held=held: _rows_of(batches, held.value, k, key, clip, skip_self)
            found.append(vectors.select(key, "embedding").mapInPandas(run, f"query_id {kinds['q']}, {key} {kinds['k']}, similarity double"))
    if not found:
        found = [vectors.sparkSession.createDataFrame([], f"query_id {kinds['q']}, {key} {kinds['k']}, similarity double")]
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), key))
    return reduce(DataFrame.unionByName, found).withColumn("semantic_rank", rank.cast("long")).filter(F.col("semantic_rank") <= k)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int, key: str = "doc_id", weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; a list without the key adds nothing."""
    both = semantic.select("query_id", key, "semantic_rank").join(keyword.select("query_id", key, "bm25_rank"), ["query_id", key], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    fused = both.withColumn("score", F.round(part(weights[0], "semantic_rank") + part(weights[1], "bm25_rank"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("bm25_rank"), key)
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)


def cap_per_group(hits: DataFrame, group: str, most: int) -> DataFrame:
    """At most ``most`` hits of a group for each query, the best ones."""
    w = Window.partitionBy("query_id", group).orderBy("rank")
    return hits.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).drop("_k")


def numbered(hits: DataFrame, group: str, most: int) -> DataFrame:
    """Number the groups of each query by first appearance; those after ``most`` go."""
    first = hits.withColumn("_f", F.min("rank").over(Window.partitionBy("query_id", group)))
    number = F.dense_rank().over(Window.partitionBy("query_id").orderBy("_f")).cast("long")
    return first.withColumn("number", number).filter(F.col("number") <= most).drop("_f")


def within_budget(hits: DataFrame, length: str, budget: int, least: int = 200) -> DataFrame:
    """Hits in rank order until the budget ends; the first that doesn't fit is shortened if enough of it remains."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = hits.withColumn("_before", F.coalesce(F.sum(length).over(w), F.lit(0)))
    room = F.lit(budget) - F.col("_before")
    fits = F.col(length) <= room
    return used.withColumn("taken", F.when(fits, F.col(length)).otherwise(room)).filter(fits | (room > least)).withColumn("shortened", ~fits).filter("taken > 0").drop("_before")
