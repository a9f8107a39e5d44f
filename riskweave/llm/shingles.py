"""Word and shingle hashes of one text, vectorised over its bytes.

Words are ``[^\\x20\\x09-\\x0D]+``. A word's hash is multilinear (a mixed value
per byte times a mixed odd factor per position) and finished with a 64-bit
mixer, so equal words have equal hashes on every machine and rerun.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_SPAN = 1 << 16
_BYTE = mix64(np.arange(256))
_PLACE = mix64(np.arange(1000, 1000 + _SPAN)) | _U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32                                   # A-Z only
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_GRAM = mix64(np.arange(300, 364)) | _U(1)         # up to 64 words a shingle


def word_hashes(data: bytes, fold: bool = True) -> np.ndarray:
    """One uint64 per word, in text order; ``fold`` lower-cases A-Z first."""
    b = np.frombuffer(data, dtype=np.uint8)
    if fold:
        b = _FOLD[b]
    ink = ~_SPACE[b]
    if not ink.any():
        return np.empty(0, dtype=np.uint64)
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    starts = np.flatnonzero(first)
    place = np.arange(len(b)) - np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else \
        np.arange(len(b)) - np.concatenate([np.zeros(starts[0], dtype=np.int64),
                                            np.repeat(starts, np.diff(np.append(starts, len(b))))])
    with np.errstate(over="ignore"):
        v = _BYTE[b] * _PLACE[place & (_SPAN - 1)]
        if len(b) > _SPAN:                           # a word may be longer than the factor table
            far = np.flatnonzero(place >= _SPAN)
            v[far] *= mix64(place[far] >> 16) | _U(1)
        v[~ink] = 0
        return mix64(np.add.reduceat(v, starts))


def gram_hashes(words: np.ndarray, n: int = 3) -> np.ndarray:
    """One hash per window of ``n`` words; empty below ``n`` words."""
    m = len(words) - n + 1
    if m < 1:
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = words[:m] * _GRAM[0]
        for j in range(1, n):
            total = total + words[j:j + m] * _GRAM[j]
        return mix64(total)


def shingle_set(data: bytes, n: int = 3) -> np.ndarray:
    """Sorted distinct n-word shingle hashes; a text of fewer words is one shingle."""
    w = word_hashes(data)
    if 0 < len(w) < n:
        with np.errstate(over="ignore"):
            return mix64(gram_hashes(w, len(w)) + _U(len(w)))
    return np.unique(gram_hashes(w, n))


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share (two independent sums), as signed longs."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(mix64(s ^ _U(0x5851F42D4C957F2D)), dtype=np.uint64)
        b = np.add.reduce(mix64(s ^ _U(0x14057B7EF767814F)), dtype=np.uint64)
    return int(np.uint64(a).view(np.int64)), int(np.uint64(b).view(np.int64))

