"""Documents to overlapping chunks counted in tokens, as a table function.

A document has sections (from a heading of a known name to the next heading) and the gaps between them.
References are skipped; a gap of at least ``GAP`` characters is chunked as ``uncategorized``, and a text without
sections as ``full_text``.  Every chunk is a slice of the text, with offsets: a chunk's own part begins where the
one before it ended, and before it stands an overlap of its last tokens.

The end of a chunk is looked for in the tokens' offsets: the last end of a paragraph that keeps the chunk within
``size`` tokens, else of a sentence, else of a word, else of a token.  A formula isn't cut, unless it has more than
``size`` tokens by itself.  A last chunk with fewer than ``least`` tokens joins the one before it if both
have room; a section of fewer is left out.  The summary chunk holds title and abstract, cut at twice the size.

The vocabulary is a file of ranks (a parameter); a count is that of a chunk's own text, not of a slice of the
document's tokens.
"""

from __future__ import annotations

import functools
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from scriptorium.functions.text import SECTIONS
from scriptorium.operators.spans import Span, around, complement, union
from scriptorium.session import ship_code

SIZE, OVERLAP, LEAST, GAP = 800, 150, 100, 50
CHUNK = "chunk_id string, level string, section string, chunk int, start int, fresh int, stop int, n_tokens int, n_formulas int, chunk_text string"

# What counts as a formula.
FORMULAS = (
    r"\$\$.+?\$\$|\\\[.+?\\\]|\\begin\{(?:equation|align|gather|eqnarray|multline)\*?\}.+?\\end\{(?:equation|align|gather|eqnarray|multline)\*?\}",
    r"(?<!\$)\$(?!\$)([^$\n]{2,}?)\$(?!\$)",
    r"[∀-⋿⨀-⫿]{5,}",
)
_FORMULAS = [re.compile(p, re.S) for p in FORMULAS]
_HEADING = re.compile(r"^#+[ \t]+(.+?)[ \t]*$", re.M)
_LEVELS = [re.compile(p) for p in (r"\n\s*\n\s*", r"(?<=[.!?])\s+", r"\s+")]


@functools.lru_cache(maxsize=4)
def encoder(path: str | None = None):
    """The byte-pair encoding of a file of ranks."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(name=f"ranks:{path}", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def formula_spans(text: str) -> list[Span]:
    return union(m.span() for p in _FORMULAS for m in p.finditer(text))


def count_formulas(text: str) -> int:
    return sum(1 for p in _FORMULAS for _ in p.finditer(text))


def section_spans(text: str) -> list[tuple[str, int, int]]:
    """(name, start, stop) of each section's body."""
    heads = [(m.start(), m.end(), m.group(1).lower()) for m in _HEADING.finditer(text)]
    ends = [*(h[0] for h in heads), len(text)][1:]
    named = ((next((s for word, s in SECTIONS.items() if word in title), None), a, b) for (_, a, title), b in zip(heads, ends, strict=True))
    return [(s, a, b) for s, a, b in named if s]


class Chunker:
    def __init__(self, text: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, path: str | None = None):
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be smaller than a chunk")
        self.text, self.size, self.overlap, self.least = text, size, overlap, least
        self.encoder = encoder(path)
        self.whole = formula_spans(text)

    def count(self, start: int, stop: int) -> int:
        return len(self.encoder.encode_ordinary(self.text[start:stop].strip()))

    def regions(self) -> Iterator[tuple[str, int, int]]:
        sections = section_spans(self.text)
        if not sections:
            yield "full_text", 0, len(self.text)
            return
        yield from ((s, a, b) for s, a, b in sections if s != "references")
        heads = [(m.start(), m.end()) for m in _HEADING.finditer(self.text)]
        known = {a for _, a, _ in sections}
        covered = [(a, b) for _, a, b in sections] + [h for h in heads if h[1] in known]
        for a, b in complement(covered, 0, len(self.text)):
            if len(self.text[a:b].strip()) >= GAP:
                yield "uncategorized", a, b

    def _prepare(self, lo: int, hi: int) -> None:
        """Offsets of the region's tokens, and the places where it may be cut, by level."""
        ids = self.encoder.encode_ordinary(self.text[lo:hi])
        self.tokens = [lo + o for o in self.encoder.decode_with_offsets(ids)[1]]
        free = lambda places: [p for p in places if lo < p < hi and not around(self.whole, p)]
        self.levels = [free(m.start() for m in p.finditer(self.text, lo, hi)) for p in _LEVELS]
        self.levels += [free(sorted(set(self.tokens))), [t for t in sorted(set(self.tokens)) if lo < t < hi]]

    def _last(self, places: list[int], start: int, fresh: int) -> int | None:
        """The last of the places that keeps the chunk from ``start`` within its size and leaves it something of its own."""
        edge = bisect_left(self.tokens, start) + self.size + 8  # a chunk's own count may differ by its first word
        limit = self.tokens[edge] if edge < len(self.tokens) else len(self.text)
        for k in range(bisect_right(places, limit) - 1, bisect_right(places, fresh) - 1, -1):
            if not self.text[fresh : places[k]].strip():
                return None
            if self.count(start, places[k]) <= self.size:
                return places[k]
        return None

    def _end(self, start: int, fresh: int, hi: int) -> int | None:
        if bisect_left(self.tokens, hi) - bisect_left(self.tokens, start) <= self.size + 8 and self.count(start, hi) <= self.size:
            return hi
        best = None
        for places in self.levels[:4]:
            found = self._last(places, start, fresh)
            if found is not None and (best is None or found > best):
                best = found
            if best is not None and self.count(fresh, best) >= min(self.least, self.size):
                return best
        return best

    def _overlapped(self, before: int, fresh: int) -> int:
        """Where a chunk begins whose own part begins at ``fresh``: at a word, outside of formulas."""
        at = self.tokens[max(bisect_left(self.tokens, fresh) - self.overlap, 0)] if self.overlap else fresh
        at = max(at, before)
        while at < fresh and (around(self.whole, at) or not (at == before or self.text[at - 1].isspace())):
            span = around(self.whole, at)
            at = span[1] if span else at + 1
        return min(at, fresh)

    def chunks(self, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """(start, fresh, stop) of the region's chunks."""
        if not self.text[lo:hi].strip():
            return []
        self._prepare(lo, hi)
        out: list[tuple[int, int, int]] = []
        fresh = lo
        while self.text[fresh:hi].strip():
            start = self._overlapped(out[-1][0], fresh) if out else fresh
            stop = self._end(start, fresh, hi)
            if stop is None and start < fresh:
                start, stop = fresh, self._end(fresh, fresh, hi)
            if stop is None:  # a formula larger than a chunk
                stop = self._last(self.levels[4], start, fresh) or next((t for t in self.levels[4] if t > fresh and self.text[fresh:t].strip()), hi)
            out.append((start, fresh, stop))
            fresh = stop
        if self.count(out[-1][1], hi) < self.least:
            if len(out) == 1:
                return []
            if self.count(out[-2][0], hi) <= self.size:
                out[-2:] = [(out[-2][0], out[-2][1], hi)]
        return out


class _Chunks:
    """The chunks of one document; the arguments are the parameters of :func:`token_chunks`."""

    def eval(self, key: str, title: str, abstract: str, text: str, size: int, overlap: int, least: int, path: str):
        made = 0
        name = lambda section: hashlib.md5(f"{key}:{section}:{made}".encode()).hexdigest()
        c = Chunker(text or "", size, overlap, least, path)
        parts = [f"Title: {title}" if title and title != "Unknown Title" else "", f"Abstract: {abstract}" if abstract else ""]
        if summary := "\n\n".join(p for p in parts if p):
            ids = c.encoder.encode_ordinary(summary)
            if len(ids) > 2 * size:
                summary = c.encoder.decode(ids[: 2 * size], errors="ignore")
            yield name("summary"), "document", "summary", made, None, None, None, len(c.encoder.encode_ordinary(summary)), count_formulas(summary), summary
            made += 1
        for section, lo, hi in c.regions():
            for start, fresh, stop in c.chunks(lo, hi):
                body = c.text[start:stop].strip()
                yield name(section), "paragraph", section, made, start, fresh, stop, c.count(start, stop), count_formulas(body), body
                made += 1


def token_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str | None = None, abstract: str | None = None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, path: str | None = None) -> DataFrame:
    """All columns of ``docs`` but the text's, beside those of each of its chunks."""
    ship_code(docs.sparkSession)
    of = udtf(_Chunks, returnType=CHUNK)
    named = lambda c: F.col(c).cast("string").outer() if c else F.lit(None).cast("string")
    rows = docs.lateralJoin(of(named(key), named(title), named(abstract), named(text), F.lit(size), F.lit(overlap), F.lit(least), F.lit(path).cast("string")))
    return rows.drop(*{text, abstract} - {None, key})
