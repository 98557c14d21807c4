"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has its characters as nodes and the vocabulary's pieces as edges (a character without
a piece is an edge of its UTF-8 bytes' pieces). A piece weighs 1 / (its merge rank + a constant) to the power
alpha, so paths of few, frequent pieces are likely. Where no piece of the vocabulary holds two neighbouring
characters side by side (before a word's blank, or between a letter and a comma), all paths meet, so the lattice is a chain of
small lattices, here called words; backward sums over each distinct word give every edge's exact probability given
its start, once for each worker.

Samples are emitted by a perturbed A-star search. The whole lattice has one Gumbel; the best path under
it is drawn top-down. What is left splits, for every edge of an emitted path, into the paths that
share everything before and take another edge there; a part's mass is known exactly, so its bound is a
Gumbel at its log mass truncated at its parent's, and the part with the largest bound holds the next sample. So k
samples are distinct and come in the order of their perturbed scores. The bound of the best part
left, kappa, gives inclusion scores 1 - exp(-exp(log p - kappa)). All random numbers are hashes of
the seed, the doc_id and the place: runs agree, however rows are partitioned.

Defined results: a null or empty text has one sample without pieces, probability 1 and inclusion 1; a text
with fewer than k segmentations has as many rows; repeated doc_ids with equal texts get equal samples, a null doc_id is a
key like others; an empty table gives no rows; other columns are not read. Texts are segmented whole.
A literal U+2581 is a blank to the vocabulary and comes back as one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import common
from dyadlake.llm.hashing import Prefixes, mix, pieces

SAMPLES, ALPHA, SEED, LONGEST = 2, 1.0, 17, 16
BLANK = "▁"
NODES = 1_500_000  # of word lattices that a worker keeps: 150 MB
_MARK = BLANK.encode()
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_kept: dict = {}
_STEP_MASK = np.uint64((1 << 53) - 1)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B)) >> np.uint32(12)


def _valid(blob: bytes) -> bytes:
    try:
        blob.decode()
    except UnicodeDecodeError:
        return blob.decode("utf-8", "replace").encode()
    return blob


class Vocabulary:
    """Pieces by hash of their code points, with log weights."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.first_byte = sp.piece_to_id("<0x00>")
        self.bytes = [b"" if sp.is_control(i) or sp.is_unknown(i) else bytes([i - self.first_byte]) if sp.is_byte(i) else self.pieces[i].replace(BLANK, " ").encode() for i in range(n)]
        rank = np.array([-sp.get_score(i) for i in plain]) + 10.0
        total = np.log((1 / rank).sum())
        self.byte_weight = alpha * float(-np.log(rank.max()) - total - 1.0)
        self.weights = np.zeros(n, np.float32)
        self.weights[plain] = alpha * (-np.log(rank) - total)
        # pairs of neighbouring characters in pieces, by a hash: a chance hit only joins what could be apart
        self.joined = np.zeros(1 << 20, bool)
        for i in plain:
            c = np.frombuffer(self.bytes[i].decode().encode("utf-32-le"), np.uint32)
            self.joined[_pair(c[:-1], c[1:])] = True
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.begin, self.flat = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(self.bytes), np.uint8)
        # every prefix of a piece is in the table, so that a search ends where no piece goes on
        known: dict[int, int] = {}
        for i in plain:
            h = np.zeros(1, np.uint64)
            for k, c in enumerate(self.pieces[i], 1):
                h = h * _P + np.uint64(ord(c) + 1)
                key = int(mix(h + np.uint64(k))[0])
                known[key] = i if k == len(self.pieces[i]) else known.get(key, -3)
        self.bits = 21
        self.keys, self.ids = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        for key, i in known.items():
            at = key >> (64 - self.bits)
            while self.keys[at]:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.ids[at] = key, i

    def find(self, h: np.ndarray) -> np.ndarray:
        """The ids of hashes, -3 where pieces only go on from there, -1 where there is none."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.full(len(h), -1, np.int32)
        live = np.arange(len(h))
        while len(live):
            key = self.keys[at]
            hit = key == h[live]
            out[live[hit]] = self.ids[at[hit]]
            on = ~hit & (key != 0)
            live, at = live[on], (at[on] + 1) % len(self.keys)
        return out


def lattices(path: str, alpha: float) -> Lattices:
    if (path, alpha) not in _kept:
        _kept[(path, alpha)] = Lattices(Vocabulary(path, alpha))
    return _kept[(path, alpha)]


def _edges(words: list[str], v: Vocabulary):
    """(edges of each node, then by edge: piece, characters, log probability given the node).

    A node stands for each character of the words and for each word's end; a piece below 0 is a character without one.
    """
    size = np.array([len(w) + 1 for w in words], np.int64)
    chars = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.cumsum(size) - size
    n = len(chars)
    left = np.repeat(first + size - 1, size) - np.arange(n)  # characters up to the word's end
    h, rows, found = np.zeros(n, np.uint64), np.flatnonzero(left), []
    for k in range(1, LONGEST + 1):
        rows = rows[left[rows] >= k]
        if not len(rows):
            break
        h[rows] = h[rows] * _P + (chars[rows + k - 1].astype(np.uint64) + np.uint64(1))
        got = v.find(mix(h[rows] + np.uint64(k)))
        found.append((rows[got >= 0], got[got >= 0], np.full((got >= 0).sum(), k, np.uint8)))
        rows = rows[got != -1]
    lone = left > 0
    if found:
        lone[found[0][0]] = False
    lone = np.flatnonzero(lone)
    c = chars[lone].astype(np.int64)
    found.append((lone, -1 - c, np.ones(len(lone), np.uint8)))
    node, piece, width = (np.concatenate(x) for x in zip(*found, strict=True))
    weight = v.weights[np.maximum(piece, 0)].astype(np.float64)
    weight[len(node) - len(lone) :] = v.byte_weight * (1 + (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF))
    order = np.argsort(node * 32 + width, kind="stable")
    node, piece, width, weight = node[order], piece[order], width[order], weight[order]
    count = np.bincount(node, minlength=n)
    begin = np.cumsum(count) - count
    back = np.zeros(n)  # log sums of paths from a node to its word's end
    by_left = np.argsort(left, kind="stable")
    bound = np.searchsorted(left[by_left], np.arange(1, int(left.max(initial=0)) + 2))
    few = 2048  # nodes from which on numpy's cost of a call is small
    for i in range(len(bound) - 1):
        at = by_left[bound[i] : bound[i + 1]]
        if len(at) == 1:
            e = slice(begin[at[0]], begin[at[0]] + count[at[0]])
            x = weight[e] + back[at[0] + width[e]]
            back[at] = x.max() + np.log(np.exp(x - x.max()).sum())
            continue
        total = np.full(len(at), -np.inf)
        for k in range(int(count[at].max())):
            on = np.flatnonzero(count[at] > k) if len(at) > few or k else np.arange(len(at))
            e = begin[at[on]] + k
            total[on] = np.logaddexp(total[on], weight[e] + back[at[on] + width[e]])
        back[at] = total
    return count, piece, width, weight + back[node + width] - back[node]


class Lattices:
    """Lattices of the words met so far, found by their hashes: nodes side by side, the edges of a node side by side.

    Holds about NODES nodes (some 100 bytes each), then starts anew. Two words of one table with equal 64-bit
    hashes would be taken for each other: a chance of 2^-64 for each pair.
    """

    def __init__(self, v: Vocabulary, most: int = NODES):
        self.v, self.most, self.bits = v, most, 21
        self.clear()

    def clear(self) -> None:
        self.keys, self.node = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.words, self.nodes, self.n_edges = 0, 0, 0
        self.first = np.zeros(1 << 16, np.int32)
        self.piece, self.width = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint8)
        self.logp, self.cum = (np.zeros(1 << 16, np.float32) for _ in range(2))

    def find(self, h: np.ndarray) -> np.ndarray:
        """The first nodes of words by hash, -1 for new ones."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out, live = np.full(len(h), -1, np.int64), np.arange(len(h))
        while len(live):
            key = self.keys[slot]
            hit = key == h[live]
            out[live[hit]] = self.node[slot[hit]]
            on = ~hit & (key != 0)
            live, slot = live[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def _grown(self, name: str, used: int, new: np.ndarray) -> None:
        old = getattr(self, name)
        if used + len(new) + 1 > len(old):
            old = np.concatenate([old, np.zeros(max(len(old) // 2, used + len(new) + 1 - len(old)), old.dtype)])
            setattr(self, name, old)
        old[used : used + len(new)] = new

    def add(self, h: np.ndarray, words: list[str]) -> None:
        """New distinct words."""
        size = np.array([len(w) + 1 for w in words], np.int64)
        for lo, hi in pieces(words, 1 << 18):
            count, piece, width, logp = _edges(words[lo:hi], self.v)
            logp = np.minimum(logp, 0.0)
            begin = self.n_edges + np.cumsum(count) - count
            p = np.exp(logp)
            total = np.cumsum(p)
            own = np.repeat(begin - self.n_edges, count)
            cum = total - (total - p)[own]
            self._grown("first", self.nodes, begin)
            for name, x in (("piece", piece), ("width", width), ("logp", logp), ("cum", cum)):
                self._grown(name, self.n_edges, x)
            at = self.nodes + np.cumsum(size[lo:hi]) - size[lo:hi]
            self.nodes, self.n_edges = self.nodes + len(count), self.n_edges + len(piece)
            self.first[self.nodes] = self.n_edges
            live, slot = np.arange(hi - lo), (h[lo:hi] >> np.uint64(64 - self.bits)).astype(np.int64)
            while len(live):
                free = self.keys[slot] == 0
                self.keys[slot[free]] = h[lo:hi][live[free]]  # of those that want one slot, the last gets it
                got = self.keys[slot] == h[lo:hi][live]
                self.node[slot[got]] = at[live[got]]
                live, slot = live[~got], (slot[~got] + 1) & (len(self.keys) - 1)
            self.words += hi - lo

    def spelled(self, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first node of each word of all texts in order, words of each text); texts begin with a blank."""
        own = [b" " + _valid(b).replace(_MARK, b" ") if b else b"" for b in blobs]
        whole = b"".join(own)
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(blobs), np.int64)
        buf, stop = np.frombuffer(whole, np.uint8), np.cumsum([len(b) for b in own])
        char = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        new = np.zeros(len(buf), bool)
        new[np.flatnonzero((buf & 0xC0) != 0x80)[1:]] = ~self.v.joined[_pair(char[:-1], char[1:])]
        lens = np.diff(stop, prepend=0)
        new[(stop - lens)[lens > 0]] = True
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(buf))
        h = Prefixes(buf).hash(start, end - start) | np.uint64(1)
        if self.nodes > self.most or self.words > 1 << (self.bits - 1):
            self.clear()
        node = self.find(h)
        miss = np.flatnonzero(node < 0)
        if len(miss):
            distinct, at = np.unique(h[miss], return_index=True)
            self.add(distinct, [whole[start[i] : end[i]].decode("utf-8", "replace").replace(" ", BLANK) for i in miss[at]])
            node[miss] = self.find(h[miss])
        return node, np.bincount(np.searchsorted(stop, start, "right"), minlength=len(blobs))

    def edge(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge of each node that holds u of the probability."""
        e, last = self.first[node].astype(np.int64), self.first[node + 1] - 1
        live = np.flatnonzero((self.cum[e] <= u) & (e < last))
        while len(live):
            e[live] += 1
            x = e[live]
            live = live[(self.cum[x] <= u[live]) & (x < last[live])]
        return e

    def others(self, node: np.ndarray, banned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log mass of each node's edges whose bit in banned is 0 (-inf for none), and their shares of it in LONGEST + 1 columns."""
        k = np.arange(LONGEST + 1)
        first, n = self.first[node].astype(np.int64), self.first[node + 1] - self.first[node]
        p = self.logp[np.minimum(first[:, None] + k, self.n_edges - 1)].astype(np.float64)
        p[(k >= n[:, None]) | ((banned[:, None] >> k) & 1 == 1)] = -np.inf
        peak = p.max(axis=1, initial=-np.inf)
        p = np.exp(p - np.where(np.isfinite(peak), peak, 0.0)[:, None])  # shifted, so that no mass is too small
        total = p.sum(axis=1)
        with np.errstate(divide="ignore"):
            return peak + np.log(total), p / np.maximum(total, 1e-300)[:, None]


def _uniform(*keys) -> np.ndarray:
    """Hashes of the keys as numbers between 0 and 1, exclusive."""
    h = np.zeros(1, np.uint64)
    with np.errstate(over="ignore"):
        for k in keys:
            h = mix(h * _P + np.asarray(k).astype(np.uint64))
    return ((h & _STEP_MASK).astype(np.float64) + 0.5) / 2.0**53


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _walk(lat: Lattices, node: np.ndarray, key: np.ndarray, step: int):
    """Free paths from the given nodes to their words' ends: (lengths, nodes, edges) chain by chain."""
    steps, live, at, n = [], np.flatnonzero(node >= 0), node[node >= 0], np.zeros(len(node), np.int64)
    key, salt = key[live], 0
    while len(live):
        salt += 1
        h = (key + np.uint64((salt * 1000 + step) * int(_P) & (1 << 64) - 1)) * _Q
        h ^= h >> np.uint64(29)
        h *= _P
        h >>= np.uint64(40)  # keys are hashes already; 24 bits are what a float holds
        u = h.astype(np.float32)
        u *= np.float32(2.0**-24)
        e = lat.edge(at, u)
        steps.append((live, at, e))
        n[live] += 1
        to = at + lat.width[e]
        on = lat.first[to + 1] > lat.first[to]  # a word's end has no edges
        live, at, key = live[on], to[on], key[on]
    first = np.cumsum(n) - n
    nodes, edges = np.zeros(n.sum(), np.int64), np.zeros(n.sum(), np.int64)
    for i, (who, a, e) in enumerate(steps):
        nodes[first[who] + i], edges[first[who] + i] = a, e
    return n, nodes, edges


def sample(blobs: list[bytes], keys: np.ndarray, lat: Lattices, k: int, seed: int):
    """All samples of UTF-8 texts, turn by turn: (texts, ids of each, flat ids, log probability, perturbed score, inclusion)."""
    m = len(blobs)
    word, count = lat.spelled(blobs)
    none = np.flatnonzero(count == 0)
    zero = np.zeros(len(none))
    out = [(none, zero.astype(np.int64), np.zeros(0, np.int32), zero, zero, zero + 1.0)] if len(none) else []
    if not len(word):
        return out
    text_of = np.repeat(np.arange(m), count)
    start = np.cumsum(count) - count
    place = np.arange(len(word)) - start[text_of]
    own = mix(keys.astype(np.uint64) * _P + np.uint64(seed))
    alive = np.flatnonzero(count > 0)
    paths = []  # (text, word, node, edge) of each step, sorted by text, with bounds by text
    heap: list[dict] = []

    def keep(doc, node, edge, wordat, top, since):
        """A path of each text of doc; its parts after the step since join the heap."""
        logp = lat.logp[edge].astype(np.float64)
        n = np.bincount(doc, minlength=m)
        first = np.cumsum(n) - n
        at = np.arange(len(doc)) - first[doc]
        before = np.cumsum(logp) - logp
        before -= np.append(before, 0.0)[np.minimum(first, len(before))][doc]
        bound = np.full(len(doc), -np.inf)
        split = np.flatnonzero((at > since[doc]) & (lat.first[node + 1] - lat.first[node] > 1))  # steps with another edge
        with np.errstate(divide="ignore"):
            left = np.log(-np.expm1(logp[split]))
        small = np.flatnonzero(logp[split] > -1e-4)  # what a likely edge leaves is lost in its own rounding
        if len(small):
            x = split[small]
            left[small] = lat.others(node[x], np.int64(1) << (edge[x] - lat.first[node[x]]))[0]
        h = mix(mix(own[doc[split]] + np.uint64(len(paths) * 16 + 5)) + at[split].astype(np.uint64) * _P)
        bound[split] = before[split] + left + _gumbel(((h & _STEP_MASK).astype(np.float64) + 0.5) / 2.0**53)
        heap.append({"doc": doc, "bound": bound, "top": top, "path": np.full(len(doc), len(paths), np.int8), "at": np.arange(len(doc)), "mu": before, "banned": np.int64(1) << (edge - lat.first[node])})
        paths.append((doc, node, edge, wordat, first, n, logp))

    n, nodes, edges = _walk(lat, word, mix(own[text_of] + place.astype(np.uint64)), 1)
    doc = np.repeat(text_of, n)
    top = _gumbel(_uniform(own, 0, 0, 3))
    keep(doc, nodes, edges, np.repeat(np.arange(len(word)), n), top, np.full(m, -1))
    emitted = [(alive, top.copy(), 0)]

    def best():
        """The part with the largest bound of each text, and the bound."""
        peak, where, which = np.full(m, -np.inf), np.zeros(m, np.int64), np.zeros(m, np.int64)
        for i, e in enumerate(heap):
            if not len(e["doc"]):
                continue
            new = np.append(True, e["doc"][1:] != e["doc"][:-1])
            docs, low = e["doc"][new], np.flatnonzero(new)
            high = np.maximum.reduceat(e["bound"], low)
            # truncating at the parent's bound keeps the order of its parts, so only the best needs it
            cap = e["top"][docs]
            hit = np.flatnonzero(e["bound"] == np.repeat(high, np.diff(np.append(low, len(new)))))
            at = np.zeros(m, np.int64)
            at[e["doc"][hit[::-1]]] = hit[::-1]
            ok = np.isfinite(high)
            high[ok] = -np.logaddexp(-high[ok], -cap[ok])
            better = high > peak[docs]
            peak[docs[better]], where[docs[better]], which[docs[better]] = high[better], at[docs[better]], i
        return peak, where, which

    for turn in range(1, k):
        peak, where, which = best()
        go = np.flatnonzero(np.isfinite(peak))
        if not len(go):
            break
        parts = []
        for i, e in enumerate(heap):
            d = go[which[go] == i]
            x = where[d]
            parts.append((d, e["path"][x], e["at"][x], e["mu"][x], e["banned"][x]))
            e["bound"][x] = -np.inf
        d, path, at, mu, banned = (np.concatenate(x) for x in zip(*parts, strict=True))
        o = np.argsort(d, kind="stable")
        d, path, at, mu, banned = d[o], path[o], at[o], mu[o], banned[o]
        base_node, base_word, pre_doc, pre_node, pre_edge, pre_word, since = np.zeros(len(d), np.int64), np.zeros(len(d), np.int64), [], [], [], [], np.full(m, -1)
        for i, (_, pn, pe, pw, first, n, _) in enumerate(paths):
            mine = np.flatnonzero(path == i)
            base_node[mine], base_word[mine] = pn[at[mine]], pw[at[mine]]
            lens = at[mine] - first[d[mine]]
            since[d[mine]] = lens
            x = np.repeat(first[d[mine]], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
            pre_doc.append(np.repeat(d[mine], lens))
            pre_node.append(pn[x])
            pre_edge.append(pe[x])
            pre_word.append(pw[x])
        share = lat.others(base_node, banned)[1]
        c = np.cumsum(share, axis=1)
        which_edge = (c <= (_uniform(own[d], turn, 0, 7) * c[:, -1])[:, None]).sum(axis=1)
        edge = lat.first[base_node] + np.minimum(which_edge, lat.first[base_node + 1] - lat.first[base_node] - 1)
        # what is left of the part: the same start with one edge more banned
        more = banned | (np.int64(1) << (edge - lat.first[base_node]))
        heap.append({"doc": d, "bound": mu + lat.others(base_node, more)[0] + _gumbel(_uniform(own[d], turn, 1, 9)), "top": peak, "path": path, "at": at, "mu": mu, "banned": more})
        # free steps: the rest of this word, then all later words
        ends = start[d] + count[d]
        lens = ends - base_word
        chain_word = np.repeat(base_word, lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        chain_doc = np.repeat(d, lens)
        node = word[chain_word]
        head = np.cumsum(lens) - lens
        to = base_node + lat.width[edge]
        node[head] = np.where(lat.first[to + 1] > lat.first[to], to, -1)
        n, nodes, edges = _walk(lat, node, mix(own[chain_doc] + place[chain_word].astype(np.uint64)), 100 + turn)
        everything = [np.concatenate([*pre_doc, d, np.repeat(chain_doc, n)]), np.concatenate([*pre_node, base_node, nodes]), np.concatenate([*pre_edge, edge, edges]), np.concatenate([*pre_word, base_word, np.repeat(chain_word, n)])]
        o = np.argsort(everything[0], kind="stable")  # each text: what was before, the new edge, the free steps
        doc, nodes, edges, wordat = (x[o] for x in everything)
        keep(doc, nodes, edges, wordat, peak, since)
        emitted.append((d, peak, turn))
    kappa, _, _ = best()
    for who, score, turn in emitted:
        doc, _, edge, _, _, n, logp = paths[turn]
        lp = np.bincount(doc, weights=logp, minlength=m)[who]
        ids = lat.piece[edge]
        size = n[who]
        if (ids < 0).any():
            ids, doc = _with_bytes(ids, doc, lat.v.first_byte)
            size = np.bincount(doc, minlength=m)[who]
        with np.errstate(over="ignore", invalid="ignore"):
            inclusion = np.where(np.isfinite(kappa[who]), -np.expm1(-np.exp(np.minimum(50.0, lp - kappa[who]))), 1.0)
        out.append((who, size, ids, lp, score[who], inclusion))
    return out


def _with_bytes(ids: np.ndarray, doc: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """ids with each character without a piece replaced by the ids of its bytes, and the text of each id."""
    odd = np.flatnonzero(ids < 0)
    parts = [np.array([first_byte + b for b in chr(-1 - c).encode("utf-8", "surrogatepass")], np.int32) for c in ids[odd].tolist()]
    width = np.ones(len(ids), np.int64)
    width[odd] = [len(p) for p in parts]
    out = np.repeat(ids, width)
    out[np.repeat(ids < 0, width)] = np.concatenate(parts)
    return out, np.repeat(doc, width)


def decode(ids, v: Vocabulary) -> str:
    text = b"".join(map(v.bytes.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def spell(ids: np.ndarray, size: np.ndarray, v: Vocabulary) -> pa.StringArray:
    """The texts of many id lists laid end to end, each without its first blank."""
    n = v.length[ids]
    flat = v.flat[np.repeat(v.begin[ids] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    ends = np.append(0, np.cumsum(n))[np.cumsum(size)]
    begins = np.append(0, ends[:-1])[: len(ends)]
    lead = np.flatnonzero(ends > begins)
    lead = lead[flat[begins[lead]] == 32]
    keep = np.ones(len(flat), bool)
    keep[begins[lead]] = False
    lens = ends - begins
    lens[lead] -= 1
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(np.append(0, np.cumsum(lens)).astype(np.int32)), pa.py_buffer(flat[keep]))


def encoded(docs: DataFrame, model: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, text_too: bool = False) -> DataFrame:
    """(doc_id, sample, ids, log_prob, score, inclusion): up to k distinct segmentations of every text.

    With text_too, decoded has the text that the ids spell, without another pass through Python.
    """

    def run(batches):
        lat = lattices(model, alpha)
        for batch in batches:
            blobs = [b"" if t is None else t for t in batch.column("text").to_pylist()]
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            keys = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            for lo, hi in pieces(blobs, 1 << 19):
                got = sample(blobs[lo:hi], keys[lo:hi], lat, k, seed)
                turn = np.zeros(hi - lo, np.int32)
                for who, size, ids, lp, score, inclusion in got:
                    columns = {
                        "doc_id": pa.array(keys[lo:hi][who], mask=null[lo:hi][who]),
                        "sample": pa.array(turn[who]),
                        "ids": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids)),
                        "log_prob": pa.array(lp, pa.float64()), "score": pa.array(score, pa.float64()), "inclusion": pa.array(inclusion, pa.float64()),
                    }
                    turn[who] += 1
                    if text_too:
                        columns["decoded"] = spell(ids, size, lat.v)
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, sample int, ids array<int>, log_prob double, score double, inclusion double"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema + (", decoded string" if text_too else ""))


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """rows (with ids array<int>) and the text that the ids spell."""

    def run(batches):
        v = lattices(model, ALPHA).v
        for pdf in batches:
            yield pdf.assign(decoded=[decode(i, v) if i is not None else None for i in pdf["ids"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", decoded string"
    return rows.mapInPandas(run, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sampled segmentation of every document with a digest of the text that it decodes to."""
    rows = encoded(common.documents(spark, sf_dir), model_path(), text_too=True)
    return rows.select("doc_id", "sample", F.size("ids").alias("n_pieces"), "log_prob", "inclusion", "ids", F.sha2("decoded", 256).alias("text_sha256"))
