"""Tokenisers that cache by pre-token.

Texts are cut at places where the tokeniser itself always cuts, so that the
tokens of a text are the tokens of its pieces put together.  Each distinct piece
is encoded once per task; a text costs one dictionary lookup a word.
"""

from __future__ import annotations

import ctypes
import operator
import os
import struct
from collections import Counter
from collections.abc import Iterator

#: Entries a task keeps before it starts a new dictionary (memory bound).
CACHE_ENTRIES = 1_500_000


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_SIGNS = frozenset(",.;:!?")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ByteBpe:
    """Byte-level BPE through ``tokenizers``.

    The pre-tokeniser attaches one space to the word behind it, so a text can be
    cut before a space that stands between two non-space characters.  Texts with
    other arrangements of white space are encoded whole.
    """

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self._tok = Tokenizer.from_file(path or default_path("byte_bpe_50k.json"))
        self._cache: dict[str, bytes] = {}
        self._signs = {c: self._encode(c) for c in _SIGNS}

    def _encode(self, text: str) -> bytes:
        return _packed(self._tok.encode(text, add_special_tokens=False).ids)

    def _learn(self, words: set[str]) -> None:
        """Encode new words, each behind a space, that are safe to cut at."""
        cache = self._cache
        # letters and one sign behind them are always two pre-tokens
        ended = {w for w in words if w[-1:] in _SIGNS and w[:-1].isalpha()}
        plain = words - ended
        plain.update(w[:-1] for w in ended)
        plain = [w for w in plain.difference(cache) if w and not (w[0].isspace() or w[-1].isspace())]
        encoded = self._tok.encode_batch_fast([" " + w for w in plain], add_special_tokens=False)
        cache.update(zip(plain, [_packed(e.ids) for e in encoded], strict=True))
        cache.update((w, cache[w[:-1]] + self._signs[w[-1]]) for w in ended)

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """For each text, its token ids as little-endian unsigned 32-bit numbers."""
        if len(self._cache) > CACHE_ENTRIES:
            self._cache.clear()
        words = [t.split(" ") for t in texts]
        if new := set().union(*words).difference(self._cache):
            self._learn(new)
        get = self._cache.__getitem__
        for text, (first, *rest) in zip(texts, words, strict=True):
            try:
                if not rest or (first and first[-1].isspace()):
                    yield self._encode(text)
                else:
                    yield b"".join((self._encode(first), *map(get, rest)))
            except KeyError:  # white space beside white space
                yield self._encode(text)


class PieceCounter:
    """Counts of SentencePiece BPE tokens, by distinct pre-token.

    No piece of the vocabulary holds a word mark behind another character, so
    merges never cross the first space of a run of spaces; this is checked when
    the model is loaded.  The dummy prefix of a piece stands for the space cut
    away.
    """

    def __init__(self, path: str | None = None):
        import re

        import sentencepiece

        self._sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path("piece_bpe_32k.model"))
        vocabulary = (self._sp.id_to_piece(i) for i in range(self._sp.vocab_size()))
        self._separable = not any("▁" in p.lstrip("▁") for p in vocabulary)
        self._cut = re.compile("(?<=[^ ]) ")
        self._cache: dict[str, int] = {}

    def _pre_tokens(self, text: str) -> Counter:
        if "▁" in text:
            text = text.replace("▁", " ")
        regular = "  " not in text and text[:1] != " "
        return Counter(text.split(" ") if regular else self._cut.split(text)) if text else Counter()

    def counts(self, texts: list[str]) -> list[int]:
        """The number of tokens of each text."""
        if not self._separable:
            return [len(self._sp.encode(t)) for t in texts]
        cache = self._cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        freqs = [self._pre_tokens(t) for t in texts]
        if new := list(set().union(*freqs).difference(cache)):
            cache.update(zip(new, map(len, self._sp.encode(new, num_threads=1)), strict=True))
        cache[""] = 1  # a final space: a word mark by itself
        return [sum(map(operator.mul, f.values(), map(cache.__getitem__, f))) for f in freqs]


_LOADED: dict[tuple[type, str | None], object] = {}


def shared(kind: type, path: str | None):
    """One tokeniser per worker process, so that its cache outlives a task."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def release() -> None:
    """Free the tokenisers of this process: workers outlive a stage, and other stages need the memory."""
    _LOADED.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
    if trim:
        trim(0)
