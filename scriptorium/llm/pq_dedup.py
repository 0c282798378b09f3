"""Near-duplicate vectors of one label by product quantisation, without losing a link.

Equal vectors of a label are one representative with a weight.  An index of coarse
centroids and residual subspace codebooks is fitted on a bounded sample.  A vector
lies in the list of its nearest centroid with its residual's codes and the length
of what the codes leave over.  Two vectors with a cosine of at least the threshold
are at most R apart, so a vector must probe the lists whose bisecting plane with
its own list is no farther than R; these probes are sufficient.  In a list, the
table-lookup (asymmetric) distance less the left-over length bounds the distance
from below; only pairs it cannot rule out get an exact cosine in double precision.

Lists meet their probes by (label, list), dealt into blocks of bounded size.  A
block returns counts and a spanning forest of its links, never its pairs.

Vectors of each length that occurs have an index of their own.

Defined results: a vector that is null, empty, zero or with null or non-finite
components, and a vector with a null label, link with nothing, nor do vectors of
different lengths; a repeated vec_id with the same vector is counted as a copy
once; rows come back once each, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.vectors import SAMPLE_ROWS, cosines, lengths, sample, stack, unit, usable
from scriptorium.operators.components import components
from scriptorium.session import cut

THRESHOLD = 0.93
SUBSPACES = 8
CODES = 64
BLOCK_ROWS = 1024
#: Numbers of coarse lists to choose from, and the cost of a probe in table lookups.
LISTS = (1, 8, 32, 128, 512)
ROW_COST = 250
_SLIP = 1e-7  # for rounding in the bounds; pairs within it are computed exactly


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass
class Index:
    centres: np.ndarray
    books: list[np.ndarray]  # one codebook a subspace
    edges: np.ndarray  # first dimension of each subspace, and the end

    @classmethod
    def fit(cls, points: np.ndarray, n: int, radius: float, seed: int = 11) -> "Index":
        """``n``: vectors of the largest label.  Of several numbers of lists, takes the one whose probes cost least."""
        rng = np.random.default_rng(seed)
        trial, best = points[rng.choice(len(points), min(len(points), 500), replace=False)], None
        for k in LISTS:
            if k > 1 and k > len(points) / 20:
                break
            index = cls(_kmeans(points, k, rng), [], np.zeros(0))
            share = np.bincount(cls._nearest(points, index.centres), minlength=k) / len(points)
            probes = index.probes(trial, radius)
            cost = np.mean([len(p) * ROW_COST + share[p].sum() * n for p in probes])
            if best is None or cost < best[0]:
                best = cost, index.centres
        centres = best[1]
        rest = points - centres[cls._nearest(points, centres)]
        edges = np.linspace(0, points.shape[1], min(SUBSPACES, points.shape[1]) + 1).astype(int)
        return cls(centres, [_kmeans(rest[:, a:b], CODES, rng) for a, b in zip(edges, edges[1:])], edges)

    @staticmethod
    def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.edges, self.edges[1:])]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and left-over length of unit vectors."""
        at = self._nearest(x, self.centres)
        rest = x - self.centres[at]
        codes = np.stack([self._nearest(p, b) for p, b in zip(self.parts(rest), self.books)], axis=1)
        back = np.concatenate([b[c] for b, c in zip(self.books, codes.T)], axis=1)
        return at, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(1))

    def probes(self, x: np.ndarray, radius: float) -> list[np.ndarray]:
        """The lists that can hold a vector within ``radius`` of each row."""
        d = (self.centres * self.centres).sum(1) - 2 * x @ self.centres.T
        own = np.argmin(d, axis=1)
        gap = np.sqrt(((self.centres[:, None, :] - self.centres[None, :, :]) ** 2).sum(2))
        return [np.flatnonzero(d[i] - d[i, c] <= 2 * (radius + _SLIP) * gap[c]) for i, c in enumerate(own)]

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of rows x to the coded vectors of list ``at``."""
        total = np.zeros((len(x), len(codes)))
        for part, book, code in zip(self.parts(x - self.centres[at]), self.books, codes.T):
            table = (part * part).sum(1)[:, None] - 2 * part @ book.T + (book * book).sum(1)
            total += table[:, code]
        return np.sqrt(np.maximum(total, 0))


def _forest(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the links a[i] - b[j] connect, at most one for each end."""
    if len(i) <= len(a) + len(b):
        return a[i], b[j]
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, low = at[: len(a)][i], at[len(a) :][j], np.arange(len(names))
    while True:
        least = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == low).all():
            joined = np.flatnonzero(low != np.arange(len(low)))
            return names[joined], names[low[joined]]
        low = new


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    rows = rows.select("vec_id", "embedding", "label")
    good = rows.filter(usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    equal = ["label", "embedding"]
    reps = cut(good.dropDuplicates(["vec_id", *equal]).groupBy(*equal).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vector_reps")
    parts = [_links(reps.filter(F.size("embedding") == n), threshold, sample_rows) for n in lengths(reps, "embedding") or [0]]
    met = reduce(DataFrame.unionByName, parts)
    counts = met.filter("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    classes = components(met.filter("n = 0")).withColumnRenamed("node", "rep")
    found = reps.select(*equal, "rep", "weight").join(counts, "rep", "left").join(classes, "rep", "left")
    found = found.select(F.col("label").alias("_l"), F.col("embedding").alias("_e"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(found, (F.col("label") == F.col("_l")) & (F.col("embedding") == F.col("_e")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _links(reps: DataFrame, threshold: float, sample_rows: int) -> DataFrame:
    """a, b, n from distinct vectors (label, embedding, rep, weight) of one length: n > 0: a has n links; 0: a links with b."""
    spark, radius = reps.sparkSession, float(np.sqrt(2 - 2 * threshold))
    points = sample(reps, "rep", "embedding", sample_rows)
    largest = reps.groupBy("label").count().agg(F.max("count")).first()[0]
    index = spark.sparkContext.broadcast(Index.fit(points, largest, radius) if len(points) else None)
    kind, vector, label = (reps.schema[c].dataType.simpleString() for c in ("rep", "embedding", "label"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = unit(stack(batch["embedding"]))
            at, codes, over = index.value.encode(x)
            yield batch.assign(list=at, codes=[c.tobytes() for c in codes], over=over, probes=index.value.probes(x, radius))

    placed = cut(reps.mapInPandas(place, f"label {label}, embedding {vector}, rep {kind}, weight long, list long, codes binary, over double, probes array<long>"), "vector_codes")
    asks = placed.select(F.col("label").alias("label"), F.explode("probes").alias("list"), F.col("rep").alias("asker"), F.col("embedding").alias("vector"))
    held = placed.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    asked = asks.groupBy("label", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    blocks = cut(held.join(asked, ["label", "list"]), "vector_blocks")
    salt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lists = placed.drop("probes").join(blocks, ["label", "list"]).withColumn("block", salt("rep", "blocks")).withColumn("part", every("parts")).drop("blocks", "parts")
    asks = asks.join(blocks, ["label", "list"]).withColumn("part", salt("asker", "parts")).withColumn("block", every("blocks")).drop("blocks", "parts")

    def meet(ask: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"a": [], "b": [], "n": []})
        if not len(ask) or not len(some):
            return nothing
        x, y = stack(some["embedding"]), stack(ask["vector"])
        codes = np.frombuffer(b"".join(some["codes"]), dtype=np.uint8).reshape(len(some), -1)
        lowest = index.value.distances(unit(y), int(some["list"].iloc[0]), codes) - some["over"].to_numpy()
        a, b = ask["asker"].to_numpy(), some["rep"].to_numpy()
        i, j = np.nonzero((lowest <= radius + _SLIP) & (a[:, None] != b[None, :]))
        hit = np.concatenate([cosines(y[i[s : s + 65536]], x[j[s : s + 65536]]) >= threshold for s in range(0, len(i), 65536)]) if len(i) else np.zeros(0, bool)
        i, j = i[hit], j[hit]
        if not len(i):
            return nothing
        n = np.bincount(i, some["weight"].to_numpy()[j], len(a)).astype(np.int64)
        u, v = _forest(a, b, i, j)
        counts = pd.DataFrame({"a": a[n > 0], "b": a[n > 0], "n": n[n > 0]})
        return pd.concat([counts, pd.DataFrame({"a": u, "b": v, "n": np.zeros(len(u), np.int64)})])

    keys = ["label", "list", "block", "part"]
    asks = asks.toDF(*[f"{c}_" for c in asks.columns]).toDF(*asks.columns)
    return cut(asks.groupBy(*keys).cogroup(lists.groupBy(*keys)).applyInPandas(meet, f"a {kind}, b {kind}, n long"), "vector_links")
