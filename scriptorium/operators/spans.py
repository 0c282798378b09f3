"""Intervals of character offsets: union, complement, and whether a place may be cut."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

Span = tuple[int, int]


def union(spans: Iterable[Span], stop: int | None = None) -> list[Span]:
    """Sorted spans without overlaps that cover the same places; touching ones become one, empty ones go.  Places from ``stop`` on don't count."""
    out: list[Span] = []
    for a, b in sorted((max(a, 0), b if stop is None else min(b, stop)) for a, b in spans):
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def complement(spans: Iterable[Span], start: int, stop: int) -> list[Span]:
    """What lies between ``start`` and ``stop`` and in none of the spans."""
    out, at = [], start
    for a, b in union(spans, stop):
        if a > at:
            out.append((at, a))
        at = max(at, b)
    return [*out, (at, stop)] if at < stop else out


def around(spans: list[Span], at: int) -> Span | None:
    """The span, of disjoint sorted ones, that a cut at ``at`` would divide."""
    k = bisect_right(spans, (at, -1)) - 1
    return spans[k] if k >= 0 and spans[k][0] < at < spans[k][1] else None
