"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document.

A document's features are its words, pairs of neighbouring words and the character n-grams inside words (a
blank at either end marks a word's edge), hashed to 2^16 rows of an embedding table. Their average goes through a linear softmax;
both are trained by stochastic gradient descent in numpy with per-coordinate steps. Since the model is
linear after the average, a feature's contribution to every class can be computed once: a document
is then scored by table look-ups over its whole text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
_BLANK = np.zeros(0x110000, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_P = np.uint32(0x01000193)
_K = np.uint32(0x9E3779B1)


def _chars(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between blanks, and where each text begins."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    c = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    return c, 1 + np.cumsum(size) - size


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint32(15))) * _K) >> np.uint32(16)


def features(texts: list[str]):
    """(buckets, documents) of every kind of feature of the texts, as parallel arrays."""
    c, begin = _chars(texts)
    blank = _BLANK[np.minimum(c, 0x10FFFF)]
    seen = np.concatenate(([0], np.cumsum(blank)))
    doc = np.searchsorted(begin, np.arange(len(c)), "right") - 1
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for i in range(n):
            h = h * _P + c[i : i + m] * _K
        inside = seen[n - 1 : n - 1 + m] - seen[1 : 1 + m] == 0 if n > 2 else np.ones(m, bool)
        ok = inside & ~(blank[:m] & blank[n - 1 :])
        yield _bucket(h[ok]), np.maximum(doc[:m][ok], doc[n - 1 :][ok])
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(starts):
        ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        size = ends - starts
        first = np.cumsum(size) - size
        own = c[~blank]
        step = np.multiply.accumulate(np.full(int(size.max()), _P, np.uint32), dtype=np.uint32)
        at = np.arange(len(own)) - np.repeat(first, size)
        h = np.add.reduceat((own * _K ^ (own >> np.uint32(7))) * step[at], first, dtype=np.uint32)
        b, d = _bucket(h + np.uint32(77)), doc[starts]
        yield b, d
        pair = d[1:] == d[:-1]
        yield _bucket(h[:-1][pair] * _P + h[1:][pair] * _K), d[1:][pair]


def _slices(texts: list[str], limit: int = 1 << 19):
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The distinct buckets of each text and their shares."""
    out = []
    for lo, hi in _slices(texts):
        parts = list(features(texts[lo:hi]))
        b = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
        d = np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])
        keys, n = np.unique(d * BUCKETS + b, return_counts=True)
        bound = np.searchsorted(keys, np.arange(hi - lo + 1) * BUCKETS)
        for i, j in zip(bound[:-1], bound[1:], strict=True):
            out.append(((keys[i:j] % BUCKETS).astype(np.uint16), (n[i:j] / max(1, n[i:j].sum())).astype(np.float32)))
    return out


def bag_rows(batches):
    """mapInPandas: (doc_id, label, text) to (doc_id, label, buckets, shares), both packed; what training needs of a text."""
    for pdf in batches:
        got = bags([t or "" for t in pdf["text"]])
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "buckets": [b.tobytes() for b, _ in got], "shares": [s.tobytes() for _, s in got]})


def unpacked(rows) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(r.buckets, np.uint16), np.frombuffer(r.shares, np.float32)) for r in rows]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(data: list[tuple[np.ndarray, np.ndarray]], labels: list[int], classes: int, width: int = 8, epochs: int = 4, rate: float = 0.2, seed: int = 1):
    """(table, bias) from bags: what each bucket adds to each class, times its share in a text."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-0.5, 0.5, (BUCKETS, width))
    out, bias = rng.normal(0, 0.3, (width, classes)), np.zeros(classes)
    past_e, past_o, past_b = np.full((BUCKETS, width), 1e-8), np.full((width, classes), 1e-3), np.full(classes, 1e-1)
    goal = np.eye(classes)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(data)):
            rows, share = data[i]
            x = share @ emb[rows]
            g = softmax(x @ out + bias) - goal[labels[i]]
            back = np.outer(share, out @ g)
            go = np.outer(x, g)
            past_o += go**2
            past_b += g**2
            past_e[rows] += back**2
            out -= step * go / np.sqrt(past_o)
            bias -= step * g / np.sqrt(past_b)
            emb[rows] -= step * back / np.sqrt(past_e[rows])
    return (emb @ out).astype(np.float32), bias


def scores(texts: list[str], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of each class for each text; a text without features has the bias alone."""
    out = np.zeros((len(texts), len(bias)))
    for lo, hi in _slices(texts):
        count = np.zeros(hi - lo)
        total = np.zeros((hi - lo, len(bias)))
        for b, d in features(texts[lo:hi]):
            count += np.bincount(d, minlength=hi - lo)
            for k in range(len(bias)):
                total[:, k] += np.bincount(d, weights=table[b, k], minlength=hi - lo)
        out[lo:hi] = total / np.maximum(count, 1)[:, None]
    return out + bias


def bag_scores(data: list[tuple[np.ndarray, np.ndarray]], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The same from bags."""
    return np.array([s @ table[b] for b, s in data]).reshape(-1, len(bias)) + bias
