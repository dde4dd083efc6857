"""Word-shingle sets of texts as 64-bit hashes, computed over whole Arrow batches in numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_SEED = 20240229
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BYTE = np.random.default_rng(_SEED).integers(0, 2**64, 256, dtype=np.uint64)
_MIX = np.random.default_rng(_SEED + 1).integers(0, 2**63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown as texts need them."""

    def __init__(self):
        self.up, self.down = _powers(1), _powers(1)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 18)
            self.up = _powers(size)
            self.down = _powers(size, np.uint64(pow(int(_BASE), -1, 2**64)))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes, member: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte position of each run of bytes that ``member`` marks: by default all
    but space and 9 to 13.

    A-Z count as a-z. A word's hash is a polynomial over its bytes with random byte values.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = member[raw]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    up, down = _POWERS.upto(len(raw) + 1)
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[_FOLD[raw]] * up[:-1], out=total[1:])
    return mix((total[last] - total[first]) * down[first]), first


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Fewer words than a shingle: the whole
    sequence as one. No words, or null: empty."""
    data = b" ".join(t or b"" for t in texts)
    ends = np.cumsum([len(t or b"") + 1 for t in texts])
    words, first = word_hashes(data)
    bounds = np.searchsorted(first, ends)
    n = len(words)
    if n >= WIDTH:
        rolled = words[: n - WIDTH + 1] * _MIX[0]
        for k in range(1, WIDTH):
            rolled = rolled + words[k: n - WIDTH + 1 + k] * _MIX[k]
        rolled = mix(rolled)
    out, lo = [], 0
    for hi in bounds.tolist():
        if hi - lo >= WIDTH:
            out.append(np.unique(rolled[lo: hi - WIDTH + 1]))
        elif hi > lo:
            length = np.array([hi - lo], dtype=np.uint64) * _MIX[WIDTH]
            out.append(mix(np.add.reduce(words[lo:hi] * _MIX[: hi - lo], keepdims=True) + length))
        else:
            out.append(words[:0])
        lo = hi
    return out


def in_chunks(texts: list[bytes | None], limit: int = 400_000):
    """Slices of the list whose bytes stay near ``limit``, so that work fits the caches."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or b"")
        if size >= limit:
            yield texts[start: i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]
