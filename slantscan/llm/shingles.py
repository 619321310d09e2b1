"""Words and five-word shingles of a text as 64-bit hashes, by NumPy over its bytes.

A word is a maximal run of characters other than space, \\t, \\n, \\v, \\f, \\r;
A-Z count as a-z. Both are ASCII, so UTF-8 bytes can be worked on directly.
"""

from __future__ import annotations

import numpy as np

WORDS = 5  #: words in a shingle


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of the public splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        k = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)
        return _mix(k * np.uint64(0x9E3779B97F4A7C15))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = stream(256, 1)[_LOWER]  # a letter's two cases share a number
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = int(stream(1, 2)[0]) | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_PLACE = stream(WORDS, 3) | np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    p = _powers.get(base)
    if p is None or len(p) < n:
        m = 1 << max(12, (n - 1).bit_length())
        p = np.full(m, base, np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if m <= 1 << 22:  # longer texts are rare: don't keep 32 MB and more for them
            _powers[base] = p
    return p[:n]


def word_hashes(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    word = ~_SPACE[b]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power(_BASE, len(b)), out=total[1:])
    h = (total[end] - total[first]) * _power(_UNBASE, len(b))[first]
    return _mix(h + (end - first).astype(np.uint64))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of the whole text; with fewer words the
    sequence as one shingle; none without text or words."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(WORDS, len(w))
    s = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        s += w[k : k + len(s)] * _PLACE[k]
    return np.unique(_mix(s + np.uint64(n)))
