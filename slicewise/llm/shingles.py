"""Word shingles as 64-bit hashes, a whole Arrow batch of texts at a time (numpy, no loop over words)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes between words (blank and 09 to 0D).
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C17)               # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_LONE = np.uint64(0xD6E8FEB86659FD93)
CHUNK = 1 << 19


def mixed(h: np.ndarray, times: int = 0xFF51AFD7ED558CCD) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(times)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of the hash step and of its inverse; grows with the longest chunk."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = np.full(n, _STEP), np.full(n, _BACK)
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word, and the document each word is in. starts: first byte of every document, and the end."""
    data = _LOWER[data]
    gap = _GAP[data]
    word = ~gap
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[starts] = True                                 # a word ends with its document
    begin = word.copy()
    begin[1:] &= gap[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= gap[1:] | cut[1:-1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    hashes = mixed((total[ends] - total[begins]) * down[begins])
    return hashes, np.searchsorted(starts, begins, side="right") - 1


def _grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash per run of `width` words; a lone word's differs from those of longer runs."""
    if width == 1:
        return mixed(hashes * _LONE)
    n = len(hashes) - width + 1
    out = hashes[:max(n, 0)]
    for k in range(1, width):
        out = mixed(out * _STEP + hashes[k:k + max(n, 0)])
    return out


def shingle_sets(texts: pa.Array, powers: Powers, width: int = 2) -> Iterator[np.ndarray]:
    """Per text the ascending distinct hashes of its `width`-word shingles; a text of fewer words is one; null or blank: empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    none = np.zeros(0, dtype=np.uint64)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, side="right")) - 1)
        part, starts = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        if len(part):
            hashes, doc = word_hashes(part, starts, powers)
            grams = _grams(hashes, width)
            bounds = np.searchsorted(doc, np.arange(j - i + 1))
            for k in range(j - i):
                a, b = bounds[k], bounds[k + 1]
                yield np.unique(grams[a:b - width + 1]) if b - a >= width else _grams(hashes[a:b], b - a) if b > a else none
        else:
            for _ in range(j - i):
                yield none
        i = j


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit integers."""
    a, b = mixed(s, 0x87C37B91114253D5).sum(dtype=np.uint64), mixed(s ^ _LONE, 0x4CF5AD432745937F).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


class MinHash:
    """`size` minwise tokens of 16 bits."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, size, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)[:, None]

    def __call__(self, s: np.ndarray) -> bytes:
        least = None
        for i in range(0, len(s), 4096):
            m = (self.a * s[None, i:i + 4096] + self.b).min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return (mixed(least) >> np.uint64(48)).astype("<u2").tobytes()
