"""Vectorised hashes of word n-grams, and winnowing, over a batch of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)
_PLACE = 24  # bits of a window's minimum that tell its place
_MASK = np.uint64((1 << _PLACE) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse modulo 2^64."""
    global _POW, _INV
    if len(_POW) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("_POW", _BASE), ("_INV", _BASE_INV)):
            grow = np.full(size, base, np.uint64)
            grow[0] = 1
            globals()[name] = np.cumprod(grow, dtype=np.uint64)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def groups(texts: Sequence[str | None], size: int = 1 << 19) -> Iterator[slice]:
    """Slices of a batch with about ``size`` characters each, a longer text alone."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > size:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(texts):
        yield slice(start, len(texts))


class Words:
    """The words of some texts (UTF-8 split at ASCII white space) and hashes of runs of them.

    A run's hash is a polynomial over the bytes of its words joined by one
    space, so equal runs have equal hashes wherever they stand.
    ``counts`` and ``first`` give each text's number of words and the index of
    its first among all ``n``.
    """

    def __init__(self, texts: Sequence[str | None]):
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.split = split
        self.counts = np.array([len(w) for w in split], np.int64)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)[:-1]])
        self.n = int(self.counts.sum())
        raw = np.frombuffer(b" ".join([b" ".join(w) for w in split if w]), np.uint8)
        gaps = np.flatnonzero(raw == 32)
        self.begin = np.concatenate([np.zeros(1, np.int64), gaps + 1])[: self.n]
        self.end = np.concatenate([gaps, np.array([len(raw)], np.int64)])[: self.n]
        power, self._inv = _powers(len(raw) + 1)
        self._sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64, out=self._sums[1:])

    def runs(self, k: int) -> np.ndarray:
        """Hashes of the n - k + 1 runs of k words; some cross from one text into the next."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return self.spans(self.begin[: self.n - k + 1], self.end[k - 1 :])

    def spans(self, b: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges b:e."""
        return mix(((self._sums[e] - self._sums[b]) * self._inv[b]) ^ (e - b).astype(np.uint64))

    def owner(self) -> np.ndarray:
        """For each word, the index of its text."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w neighbouring hashes, where its smallest lies; the rightmost of equal ones.

    Hashes compare by their upper 40 bits, so equal windows choose the same
    place whatever surrounds them. w is at least 2.
    """
    if len(h) < w:
        return np.zeros(0, np.int64)
    step, out = (1 << _PLACE) - w, []
    for at in range(0, len(h) - w + 1, step):
        part = h[at : at + step + w - 1]
        v = (part & ~_MASK) | (_MASK - np.arange(len(part), dtype=np.uint64))
        reach = 1
        while reach * 2 <= w:
            v = np.minimum(v[:-reach], v[reach:])
            reach *= 2
        if reach < w:
            v = np.minimum(v[: len(v) - (w - reach)], v[w - reach :])
        out.append((_MASK - (v & _MASK)).astype(np.int64) + at)
    return np.concatenate(out)
