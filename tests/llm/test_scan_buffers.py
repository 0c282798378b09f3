"""Blocks of windows across the borders of scan buffers."""

import random

import numpy as np

from scriptorium.llm import substring_dedup as S


def test_windows_across_buffers():
    """Every window of a text longer than a buffer has one block; equal windows on both sides of a border have equal keys."""
    draw = random.Random(5)
    letters = lambda n: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    shared = letters(500)
    texts = [letters(S._CHUNK - 250) + shared + letters(200_000), letters(3000) + shared + letters(50), letters(100)]
    scan = S._Scan(64)
    scan.add([1, 2, 3], texts)
    key, _, count, _, doc, start = (np.concatenate(x) for x in zip(*scan.parts, strict=True))
    keys = []
    for k in (1, 2):
        own = doc == k
        order = np.argsort(start[own])
        first, n = start[own][order], count[own][order].astype(np.int64)
        assert first[0] == 0 and (first[1:] == (first + n)[:-1]).all() and first[-1] + n[-1] == len(texts[k - 1]) - S.WIDTH + 1
        at = texts[k - 1].index(shared)
        keys.append(np.repeat(key[own][order], n)[at : at + len(shared) - S.WIDTH + 1])
    assert (keys[0] == keys[1]).all() and not (doc == 3).any()
