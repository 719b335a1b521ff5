"""Vectorised Karp-Rabin style fingerprints with numpy.

All arithmetic is modulo 2**64. A buffer is turned into prefix sums
``P[i] = sum_{j<i} table[byte_j] * r**j``; the fingerprint of ``[a, b)`` is
``(P[b] - P[a]) * r**-a``, mixed with the length. Long ranges use a second, independent
sum too, so that the weak low bits of one do not matter; for words one is enough.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MASK = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F | 5)


def _byte_table(seed: int) -> np.ndarray:
    out, x = np.empty(256, _U), seed
    for i in range(256):  # splitmix64 stream
        x = (x + 0x9E3779B97F4A7C15) & _MASK
        z = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out[i] = (z ^ (z >> 31)) | 1
    return out


_TABLES = tuple(_byte_table(s) for s in (11, 29))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), grown by doubling and kept for the worker's life."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, _U)
        have[0] = 1
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * _U(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Fingerprints:
    """Constant-time fingerprints of any byte range of one buffer."""

    def __init__(self, data: np.ndarray, sums: int = 2):
        n = len(data)
        self.sums = []
        for base, tab in list(zip(_BASES, _TABLES))[:sums]:
            p = np.empty(n + 1, _U)
            p[0] = 0
            np.cumsum(tab[data] * _power(base, n), out=p[1:])
            inverse = pow(base, -1, 1 << 64)
            self.sums.append((p, _power(inverse, n + 1)))

    def wide(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits: those of ``of`` and 32 more of the same two sums."""
        (p, inverse), (q, other) = self.sums
        x, y = (p[end] - p[start]) * inverse[start], (q[end] - q[start]) * other[start]
        size = (end - start).astype(_U)
        return mix(mix(size + y) + x), (mix(mix(size ^ x) + y) >> _U(32)).astype(np.uint32)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (end - start).astype(_U)
        for p, inverse in reversed(self.sums):
            h = mix(h + (p[end] - p[start]) * inverse[start])
        return h


class WindowHashes:
    """Running Karp-Rabin hashes of the windows of a sequence of word hashes."""

    def __init__(self, words: np.ndarray):
        self.sums = np.zeros(len(words) + 1, _U)
        np.cumsum(mix(words) * _power(_BASES[0], len(words)), out=self.sums[1:])
        self.inverse = _power(pow(_BASES[0], -1, 1 << 64), len(words) + 1)

    def of(self, start: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[97:123] = True
_ALNUM[128:] = True


def _runs(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], keep, [False])).view(np.int8)))
    return edge[::2], edge[1::2]


#: Bytes whose words are hashed at once.
STRETCH = 1 << 18


def word_hashes(text: str | None, letters: bool = False, prefix: int = 0) -> np.ndarray:
    """64-bit hashes of the words of a text, in order.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; with ``letters`` the text is
    lower-cased as Unicode and only ASCII letters, digits and non-ASCII bytes make words,
    so punctuation and symbols do not matter. With ``prefix`` only so many bytes of each word count.
    """
    raw = (text or "").lower().encode("utf-8", "replace") if letters else (text or "").encode("utf-8", "replace").lower()
    data = np.frombuffer(raw, np.uint8)
    inside = _ALNUM[data] if letters else ~_SPACE[data]
    starts, ends = _runs(inside)
    if not len(starts):
        return np.empty(0, _U)
    ends = np.minimum(ends, starts + prefix) if prefix else ends
    out, i = np.empty(len(starts), _U), 0
    while i < len(starts):  # the words of a stretch at a time: bounds a worker's memory
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, a + STRETCH)))
        out[i:j] = Fingerprints(data[a : int(ends[j - 1])], 1).of(starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per k-word window; fewer words make one window, none make none."""
    n = len(words)
    if n == 0:
        return words
    if n < k:
        k = n
    out = np.full(n - k + 1, _U(k))
    for i in range(k):
        out = mix(out * _U(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i])
    return out


def _octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number (a view)."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def gram_order(data: np.ndarray) -> np.ndarray:
    """A hash of the 16 bytes from each position, to choose anchors by."""
    x = _octets(data)
    h = x[:-8] * _U(0x9E3779B97F4A7C15)
    h ^= x[8:] * _U(0xC2B2AE3D27D4EB4F)
    h ^= h >> _U(31)
    h *= _U(0xBF58476D1CE4E5B9)
    return h


def range_hashes(data: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes (8 at least) from each of a few positions, read eight at a time."""
    x = _octets(data)
    h = np.full(len(start), _U(size))
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        h = (h ^ x[start + k]) * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(29)
    return mix(h)


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Position of the leftmost minimum of the high bits of every w-window of x (len(x) >= w)."""
    bits = _U(max(1, len(x).bit_length()))
    low = (_U(1) << bits) - _U(1)
    best = (x & ~low) | np.arange(len(x), dtype=_U)
    span = 1
    while span < w:
        step = min(span, w - span)
        best = np.minimum(best[:-step], best[step:])
        span += step
    return (best & low).astype(np.int64)
