"""Licence scans: a generalised suffix automaton of licence tokens and chained matches.

Words are runs of digits, lower-cased ASCII letters and characters beyond ASCII.  All
templates (notices and phrases) go into one suffix automaton over words.  A text's words are
streamed through it: after each word the state says the longest end of what was read that
stands in any template (the matching statistics).  Matches that cannot be made longer are
chained for each template: the next one lies behind the last in text and template, with at
most ``GAP`` words between.  A chain is a span; it counts where it covers at least ``COVER`` of
its template.  A phrase counts wherever all its words stand consecutively, which the state
knows, since the phrase is among the strings that end there.

Nothing is shuffled; the automaton is broadcast, and its templates may have ``TEMPLATE_WORDS``
words in all (an error beyond).  Work is one step a word that a template has, and memory a
text's words.  The chaining of a match looks back over the matches that end within its own
length and ``GAP`` words.

Defined results: a null text is empty (no words, no labels, score 0); rows are kept as they
are, repeated ones and null ids too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.license_texts import NOTICES, PHRASES
from scriptorium.session import small_batches

#: Fewest words of a match that chains use.
MATCH_WORDS = 3
#: Most words between two matches of a chain, in the text and in the template.
GAP = 8
#: The share of a template that a span must cover.
COVER = 0.8
#: Words of all templates together that an automaton may hold.
TEMPLATE_WORDS = 200_000

SPAN = "struct<label:string,template:int,start:long,stop:long,covered:long,share:double>"

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# as translate() wants it: every byte of no word becomes a space, capital letters small ones
_PLAIN = bytes(b if _WORD.match(bytes([b])) else 32 for b in bytes(range(256)).lower())


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN).split()


class SuffixAutomaton:
    """All word strings inside the given sequences of word ids."""

    def __init__(self, sequences: Iterable[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self._own: list[list[tuple[int, int]]] = [[]]  # (sequence, place of its last word) where the state was reached first
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self._own[last].append((k, at))
        self._number()

    def _state(self, longest: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.longest.append(longest)
        self.link.append(link)
        self._own.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of the strings of ``q`` that are one word longer than those of ``p`` at most."""
        if self.longest[q] == self.longest[p] + 1:
            return q
        copy = self._state(self.longest[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # another sequence went this way
            return self._split(last, self.next[last][word], word)
        made, p = self._state(self.longest[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, self.next[p][word], word)
        return made

    def _number(self) -> None:
        """Lay the places of a state, those of all states linked to it included, next to each other."""
        below: list[list[int]] = [[] for _ in self.link]
        for s, to in enumerate(self.link):
            if to >= 0:
                below[to].append(s)
        self.places: list[tuple[int, int]] = []
        self.of: list[tuple[int, int]] = [(0, 0)] * len(self.link)
        stack = [(0, -1)]
        while stack:
            s, start = stack.pop()
            if start >= 0:
                self.of[s] = (start, len(self.places))
                continue
            stack.append((s, len(self.places)))
            self.places += self._own[s]
            stack += [(c, -1) for c in below[s]]
        del self._own

    def ends_at(self, state: int) -> list[tuple[int, int]]:
        """(sequence, place of the last word) of every place of the state's strings."""
        start, stop = self.of[state]
        return self.places[start:stop]

    def read(self, words: list[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and the length of the longest match that ends there."""
        follow, link, longest = self.next, self.link, self.longest
        state = length = 0
        for w in words:
            while state and w not in follow[state]:
                state = link[state]
                length = longest[state]
            to = follow[state].get(w)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            yield state, length


class Scanner:
    """Templates ready to scan texts: ``notices`` and ``phrases`` are (label, text) pairs."""

    def __init__(self, notices=NOTICES, phrases=PHRASES, match_words: int = MATCH_WORDS, gap: int = GAP, cover: float = COVER):
        self.match_words, self.gap, self.cover = match_words, gap, cover
        texts = [words_of(t) for _, t in (*notices, *phrases)]
        if sum(map(len, texts)) > TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {TEMPLATE_WORDS} words in all")
        self.labels = [label for label, _ in (*notices, *phrases)]
        self.sizes = [len(t) for t in texts]
        self.n_notices = len(notices)
        self.ids: dict[bytes, int] = {}
        sequences = [[self.ids.setdefault(w, len(self.ids)) for w in t] for t in texts]
        self.automaton = SuffixAutomaton(sequences)
        # phrases that end with what a state's strings end with, by state
        a, own = self.automaton, {}
        for k in range(self.n_notices, len(sequences)):
            *_, (state, _) = a.read(sequences[k])
            own.setdefault(state, []).append(k)
        self.phrases: list[tuple[int, ...]] = [()] * len(a.link)
        for s in sorted(range(len(a.link)), key=a.longest.__getitem__):  # a link leads to shorter strings
            above = self.phrases[a.link[s]] if s else ()
            self.phrases[s] = (*above, *own.get(s, ()))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """The number of words, (phrase, start) of each phrase found, (template, start, stop, covered) of each span."""
        words = words_of(text)
        get = self.ids.get
        ids = [get(w, -1) for w in words]
        known = np.flatnonzero(np.array(ids, dtype=np.int64) >= 0)
        if not len(known):
            return len(words), [], []
        breaks = np.flatnonzero(np.diff(known) > 1) + 1
        starts, stops = known[np.r_[0, breaks]], known[np.r_[breaks - 1, len(known) - 1]] + 1
        long = stops - starts > 1
        places, matches, a = [], {}, self.automaton
        for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            before = (0, 0)
            for at, (state, length) in enumerate(a.read(ids[start:stop]), start):
                if self.phrases[state]:
                    places += [(k, at - self.sizes[k] + 1) for k in self.phrases[state] if self.sizes[k] <= length]
                if length <= before[1]:
                    self._keep(matches, at - 1, *before)
                before = state, length
            self._keep(matches, stop - 1, *before)
        return len(words), places, [(t, *s) for t in sorted(matches) for s in self._chains(t, matches[t])]

    def _keep(self, matches: dict, last: int, state: int, length: int) -> None:
        """Note a match that ends at word ``last`` and can't be longer, for each template."""
        if length >= self.match_words:
            for template, end in self.automaton.ends_at(state):
                if template < self.n_notices:
                    matches.setdefault(template, []).append((last, end, length))

    def _chains(self, template: int, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, stop, covered) of the best chain from each first match that covers enough of the template."""
        best: list[tuple[int, int]] = []  # covered so far, first match
        found: dict[int, tuple[int, int]] = {}  # first match -> covered, last match
        low = 0
        longest = max(m[2] for m in matches)
        for j, (last, end, length) in enumerate(matches):  # by last word in the text
            while matches[low][0] < last - longest - self.gap:
                low += 1
            covered, first = length, j
            for k in range(low, j):
                to, until, _ = matches[k]
                if to < last and until < end and to >= last - length - self.gap and until >= end - length - self.gap:
                    more = best[k][0] + min(length, last - to, end - until)
                    if more > covered:
                        covered, first = more, best[k][1]
            best.append((covered, first))
            if covered > found.get(first, (0, 0))[0]:
                found[first] = covered, j
        least = self.cover * self.sizes[template]
        spans = [(matches[f][0] - matches[f][2] + 1, matches[j][0] + 1, n) for f, (n, j) in found.items() if n >= least]
        out: list[tuple[int, int, int]] = []  # in order, none over another
        for span in sorted(spans, key=lambda s: (-s[2], s)):  # of overlapping ones the one that covers most
            at = bisect(out, span)
            if (not at or out[at - 1][1] <= span[0]) and (at == len(out) or out[at][0] >= span[1]):
                out.insert(at, span)
        return out


def scan_licenses(docs: DataFrame, notices=NOTICES, phrases=PHRASES, **how) -> DataFrame:
    """doc_id, n_words, places (array of struct label, start), spans (array of ``SPAN``), labels, base_labels, score of every row.

    score: the largest share of a template that a span covers; 1 where a phrase stands.
    """
    small_batches(docs.sparkSession)
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(notices, phrases, **how))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s: Scanner = scanner.value
        for batch in batches:
            made = []
            for text in batch["text"]:
                n, places, spans = s.scan(text)
                shares = [covered / s.sizes[t] for t, _, _, covered in spans]
                base = sorted({s.labels[k] for k, _ in places})
                found = [{"label": s.labels[t], "template": t, "start": a, "stop": b, "covered": c, "share": share} for (t, a, b, c), share in zip(spans, shares, strict=True)]
                made.append((n, [{"label": s.labels[k], "start": a} for k, a in places], found, base, sorted({*base, *(x["label"] for x in found)}), 1.0 if places else max(shares, default=0.0)))
            out = pd.DataFrame(made, columns=["n_words", "places", "spans", "base_labels", "labels", "score"])
            out.insert(0, "doc_id", batch["doc_id"])
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_words long, places array<struct<label:string,start:long>>, spans array<{SPAN}>, base_labels array<string>, labels array<string>, score double")
