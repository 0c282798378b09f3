"""Questions asked again: the same one, or the most similar one, from a cache of bounded size and age.

A session's questions stream through its cache in order of time.  The cache holds at most ``size`` entries; the
one that was used least recently leaves.  An entry answers for ``ttl`` after it was made.  A question that is asked
again (but for case and spaces around it) is an exact hit and counts as use.  Otherwise the entry with the most similar set
of words is looked for, at ``threshold`` at least, the older one of equals; the question then makes an entry of its own.

Sets are looked up by their first words: of two sets that similar, one's first words, as many as may be missing from the
overlap and one more, hold one of the other's.  Memory is that of one cache a task, and a session is read in sorted order.

Null texts and texts of spaces are no questions; rows without session or time are left out.
"""

from __future__ import annotations

import math
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.session import ship_code

SIZE, TTL, THRESHOLD = 50, 3600, 0.8


class QuestionCache:
    def __init__(self, size: int = SIZE, ttl: float = TTL, threshold: float = THRESHOLD):
        self.size, self.ttl, self.threshold = size, ttl, Fraction(str(threshold))
        self.entries: OrderedDict[str, tuple] = OrderedDict()  # key -> (number, id, at, words), least recently used first
        self.by_word: dict[str, set[str]] = defaultdict(set)
        self.made = 0

    def _first_words(self, words: frozenset[str]) -> list[str]:
        n = len(words)
        return sorted(words)[: n - math.ceil(self.threshold * n) + 1]

    def _drop(self, key: str) -> None:
        _, _, _, words = self.entries.pop(key)
        for w in self._first_words(words):
            self.by_word[w].discard(key)
            if not self.by_word[w]:
                del self.by_word[w]

    def ask(self, row, at: float, text: str) -> tuple[str, object, float | None]:
        """(``exact``, ``similar`` or ``new``, the id of the question that answers, the similarity)."""
        key = text.strip().lower()
        if held := self.entries.get(key):
            if at - held[2] <= self.ttl:
                self.entries.move_to_end(key)
                return "exact", held[1], 1.0
            self._drop(key)
        words = frozenset(key.split())
        best: tuple = (Fraction(0), 0, None)
        for other in set().union(*(self.by_word.get(w, ()) for w in self._first_words(words))):
            number, of, made_at, theirs = self.entries[other]
            same = len(words & theirs)
            score = Fraction(same, len(words) + len(theirs) - same)
            if at - made_at <= self.ttl and score >= self.threshold:
                best = max(best, (score, -number, of), key=lambda x: x[:2])
        while len(self.entries) >= self.size:
            self._drop(next(iter(self.entries)))
        self.made += 1
        self.entries[key] = (self.made, row, at, words)
        for w in self._first_words(words):
            self.by_word[w].add(key)
        return ("similar", best[2], float(best[0])) if best[2] is not None else ("new", None, None)


def cached_questions(questions: DataFrame, size: int = SIZE, ttl: float = TTL, threshold: float = THRESHOLD) -> DataFrame:
    """session, id, kind, answered_by, similarity of every question (session, id, at in seconds, text)."""
    ship_code(questions.sparkSession)
    kinds = {c: questions.schema[c].dataType.simpleString() for c in ("session", "id")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, cache = None, None
        for batch in batches:
            out = []
            for s, row, at, text in zip(batch["session"], batch["id"], batch["at"], batch["text"], strict=True):
                if cache is None or s != session:
                    session, cache = s, QuestionCache(size, ttl, threshold)
                out.append((s, row, *cache.ask(row, at, text)))
            yield pd.DataFrame(out, columns=["session", "id", "kind", "answered_by", "similarity"]).astype({"answered_by": "object"})

    rows = questions.filter("session is not null and at is not null and length(trim(text)) > 0").select("session", "id", F.col("at").cast("double").alias("at"), "text")
    ordered = rows.repartition("session").sortWithinPartitions("session", "at", "id")
    return ordered.mapInPandas(run, f"session {kinds['session']}, id {kinds['id']}, kind string, answered_by {kinds['id']}, similarity double")
