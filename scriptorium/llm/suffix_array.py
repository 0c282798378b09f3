"""Suffix arrays by linear grouping, without recursive renaming.

Phase one sorts the suffixes into groups by their Lyndon prefixes.  Groups are
processed from the highest down; each of a group's suffixes points to the nearest
suffix before it in a lower group, and the suffixes pointed to, by how often, move
to new groups right above their old ones.  Phase two walks the result from the
left: a suffix in its place puts the suffixes whose Lyndon prefix ends there at the
front of their groups.
"""

from __future__ import annotations

from itertools import accumulate


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in order; its last symbol must be its only smallest one."""
    n = len(text)
    first: dict[int, int] = {}
    for c in text:
        first[c] = first.get(c, 0) + 1
    symbols = sorted(first)
    begins = dict(zip(symbols, accumulate((first[c] for c in symbols), initial=0)))
    group = [begins[c] for c in text]  # a group is named by the place where it begins
    end = {begins[c]: begins[c] + first[c] - 1 for c in symbols}
    order, where = [0] * n, [0] * n
    fill = dict(begins)
    for i, c in enumerate(text):
        at = fill[c]
        fill[c] = at + 1
        order[at], where[i] = i, at
    lower = [-1] * n  # the nearest suffix before, in a lower group
    last = n - 1
    while last >= 0:
        start = group[order[last]]
        times: dict[int, int] = {}
        most = 1
        for i in sorted(order[start : last + 1]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = lower[j]
            lower[i] = j
            if j >= 0:
                if j in times:
                    times[j] += 1
                    most = max(most, times[j])
                else:
                    times[j] = 1
        last = start - 1
        for level in range(most, 0, -1):
            moved: dict[int, int] = {}  # group -> its end before
            for j in times if most == 1 else [j for j, k in times.items() if k == level]:
                g = group[j]
                e = end[g]
                if g not in moved:
                    moved[g] = e
                at, other = where[j], order[e]
                order[at], where[other] = other, at
                order[e], where[j] = j, e
                end[g] = e - 1
            for g, e in moved.items():
                new = end[g] + 1
                if new == g:
                    end[g] = e  # the whole group moved
                else:
                    end[new] = e
                    for at in range(new, e + 1):
                        group[order[at]] = new
    out, put, done = [0] * n, {}, bytearray(n)
    out[0] = n - 1
    done[n - 1] = 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            at = put.get(g, g)
            out[at] = j
            put[g] = at + 1
            done[j] = 1
            j = lower[j]
    return out


def repeated_starts(segments: list[bytes], width: int, cores: list[int] | None = None, core: int = 1) -> list[list[int]]:
    """For each segment, the starts of its ``width``-byte strings that start at another place too.

    With ``cores`` all segments hold the same ``core`` bytes, at these places, and so do all of their strings of that
    width; the core is then one symbol of the text, which makes it shorter.
    """
    text: list[int] = []
    owner, offset = [], []
    if cores is None:
        own = [[c + 2 for c in s] for s in segments]
    else:
        own = [[*(c + 2 for c in s[:at]), 258, *(c + 2 for c in s[at + core :])] for s, at in zip(segments, cores, strict=True)]
        width -= core - 1
    for k, s in enumerate(own):
        text += s
        text.append(1)
        owner += [k] * (len(s) + 1)
        offset += range(len(s) + 1)
    text.append(0)
    out: list[list[int]] = [[] for _ in segments]
    before, marked = None, False
    room = [len(s) - width for s in own]
    for i in suffix_array(text)[1:]:
        k, at = owner[i], offset[i]
        if at > room[k]:
            continue
        window = own[k][at : at + width]
        if before is not None and window == before[2]:
            if not marked:
                out[before[0]].append(before[1])
            out[k].append(at)
            marked = True
        else:
            marked = False
        before = (k, at, window)
    return out
