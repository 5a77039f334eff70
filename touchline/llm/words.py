"""Words, word hashes and n-gram hashes of many texts at once, in numpy.

A hash is 64 bits wide and depends on the bytes of the words alone, so that executors agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: bytes that end a word: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
SAME = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: bytes handled at once, so that the tables of powers stay in the processor's cache
CHUNK = 1 << 18


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as the longest chunk so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 1)
            inverse = np.uint64(pow(_BASE, -1, 2**64))
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(_BASE))]).astype(np.uint64))
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse)]).astype(np.uint64))
        return cls.up, cls.down


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span."""
    up, down = _Powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes; a longer text is alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of some texts: ``hash``, byte spans in ``data`` and ``first[i]:first[i+1]`` of text i; space is among ``ends``."""

    def __init__(self, texts: list[bytes], fold: np.ndarray = SAME, ends: np.ndarray = SPACE):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.data = data if fold is SAME else fold[data]
        edge = np.flatnonzero(np.diff(ends[data].view(np.int8), prepend=np.int8(1)))
        self.starts, self.ends = edge[::2], edge[1::2]
        begin = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
        self.first = np.searchsorted(self.starts, begin)
        self.begin = begin
        self.hash = span_hash(self.data, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; the last n - 1 places are left out."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[:len(h) - n + 1].copy()
    for i in range(1, n):
        out = out * _STEP + h[i:len(h) - n + 1 + i]
    return mix(out + np.uint64(n))


def inside(text: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams lie in one text."""
    return text[:len(text) - n + 1] == text[n - 1:] if len(text) >= n else np.zeros(0, bool)


def encoded(column) -> list[bytes]:
    """UTF-8 of an Arrow column of strings; null is empty."""
    import pyarrow as pa

    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]
