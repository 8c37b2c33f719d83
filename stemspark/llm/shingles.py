"""Hashes of words and of word shingles, in numpy."""

from __future__ import annotations

import numpy as np

#: Words of a shingle, and the similarity from which two texts are near-duplicates.
SHINGLE, SIMILAR = 5, 0.8

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


#: A 64-bit value for each byte, and powers of an odd base and of its inverse modulo 2**64.
_BYTE = np.random.default_rng(20240607).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each case-folded word between ASCII white space: sums of byte values times powers, taken from one running
    sum over the text and shifted back by the inverse power."""
    return _hashes((text or "").lower().encode())[0]


def joined_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of the texts one after the other, and the place of each text's first word."""
    data = [t.lower().encode() for t in texts]
    h, starts = _hashes(b" ".join(data))
    bounds = np.cumsum([0] + [len(d) + 1 for d in data[:-1]])
    return h, np.searchsorted(starts, bounds)


def _hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(raw, np.uint8)
    if not _SPACE[data].size or _SPACE[data].all():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edge[~space[edge]] if space[0] else np.concatenate([[0], edge[~space[edge]]])
    ends = edge[space[edge]] if space[-1] else np.concatenate([edge[space[edge]], [len(data)]])
    up, down = _grown(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    return mix((total[ends] - total[starts]) * down[starts]), starts


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * _C1
    x = (x ^ x >> np.uint64(27)) * _C2
    return x ^ x >> np.uint64(31)


def shingle_hashes(h: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of `size` words, in order; of the whole text if it has fewer (none for no words)."""
    n = len(h)
    if n == 0:
        return h
    size = min(size, n)
    x = h[: n - size + 1].copy()
    for i in range(1, size):
        x = mix(x * _GOLD + h[i : n - size + 1 + i])
    return x


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of exactly `size` words, by doubling: as many passes as size has binary digits and ones."""
    n = len(h) - size + 1
    if n <= 0:
        return h[:0]
    out, done, span, x = None, 0, 1, h
    while True:
        if size & span:
            part = x[done : done + n]
            out = part.copy() if out is None else mix(out * _GOLD + part)
            done += span
        if done == size:
            return out
        x = mix(x[:-span] * _GOLD + x[span:])
        span *= 2
