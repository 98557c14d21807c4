"""Numpy hashing of words and shingles, many documents at a time, inside Spark tasks."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, 1 << 20)
        down = np.full(size, _INVERSE, np.uint64)
        down[0] = 1
        _tables.update(up=powers(size), down=np.multiply.accumulate(down))
    return _tables["up"], _tables["down"]


class Prefixes:
    """Prefix polynomial hashes of a buffer: the hash of any substring in constant time."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sums[1:])
        self.buf = buf

    def hash(self, start: np.ndarray, size) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension of suffixes a and b, up to most, by binary search."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), most)
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.sums[a + mid] - self.sums[a]) * self.down[a] == (self.sums[b + mid] - self.sums[b]) * self.down[b]
            lo = np.where(open_ & same, mid, lo)
            hi = np.where(open_ & ~same, mid - 1, hi)
        return lo


def utf8(text) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def pieces(blobs: list[bytes], limit: int = 1 << 20):
    """Slices of the list with about limit bytes each, so that work arrays stay small."""
    first, size = 0, 0
    for i, b in enumerate(blobs):
        size += len(b)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(blobs):
        yield first, len(blobs)


def word_hashes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all blobs in order, and the index of each word's blob."""
    buf = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    blank = _BLANK[buf]
    before = np.empty_like(blank)
    before[0] = True
    before[1:] = blank[:-1]
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = ends - starts
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    h = np.add.reduceat(_BYTE[buf[~blank]] * powers(int(size.max()))[at], first)
    begin = np.cumsum([0, *(len(b) + 1 for b in blobs[:-1])])
    return mix(h + size.astype(np.uint64)), np.searchsorted(begin, starts, "right") - 1


def shingle_sets(blobs: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-word shingles of each blob as hashes; shorter texts give one of all words."""
    out: list[np.ndarray] = []
    for lo, hi in pieces(blobs):
        h, doc = word_hashes(blobs[lo:hi])
        bound = np.searchsorted(doc, np.arange(hi - lo + 1))
        m = max(0, len(h) - n + 1)
        s = np.zeros(m, np.uint64)
        for i in range(n):
            s = s * np.uint64(0xD6E8FEB86659FD93) + h[i : i + m]
        s = mix(s)
        for a, b in zip(bound[:-1], bound[1:], strict=True):
            if b - a >= n:
                out.append(np.unique(s[a : b - n + 1]))
            elif b > a:
                x = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for v in h[a:b]:
                        x = x * np.uint64(0xA0761D6478BD642F) + v
                out.append(mix(np.array([x], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
