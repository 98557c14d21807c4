"""Hierarchical navigable small-world graphs over unit vectors, in numpy.

Nodes are inserted in growing batches: a batch searches the graph so far together, meets its own
members exactly, and links to a diverse choice of what it found. Searches of many queries take their
steps together. Which level a node reaches depends on its number alone, so a graph can be rebuilt.
"""

from __future__ import annotations

import numpy as np

LINKS = 12  # of a node on the upper levels; twice as many on level 0
BUILD_BEAM = 48


def _levels(n: int) -> np.ndarray:
    u = np.random.default_rng(n).random(n)
    return np.minimum((-np.log(1 - u) / np.log(LINKS)).astype(int), 6)


def _diverse(x: np.ndarray, nodes: np.ndarray, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """For each node up to `most` of its candidates found (-1: none), best first: those nearer to it than to any chosen before, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
    rows, width = found.shape
    chosen, count = np.full((rows, most), -1, np.int32), np.zeros(rows, int)
    taken = np.zeros((rows, width), bool)
    at = np.arange(rows)
    for c in range(width):
        live = at[(found[:, c] >= 0) & (count < most)]
        if not len(live):
            continue
        have = chosen[live]
        near = np.einsum("rd,rmd->rm", x[found[live, c]], x[np.maximum(have, 0)])
        near[have < 0] = -np.inf
        ok = live[near.max(axis=1) < sims[live, c]]
        chosen[ok, count[ok]] = found[ok, c]
        count[ok] += 1
        taken[ok, c] = True
    for c in range(width):  # room that is left goes to the nearest
        live = at[(found[:, c] >= 0) & ~taken[:, c] & (count < most)]
        chosen[live, count[live]] = found[live, c]
        count[live] += 1
    return chosen


class World:
    """A graph over the rows of x (unit vectors)."""

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        level = _levels(n)
        self.order = np.lexsort((np.arange(n), -level))  # upper levels first
        self.top = int(level.max()) if n else 0
        self.links = [np.full((n, LINKS * (2 if at == 0 else 1)), -1, np.int32) for at in range(self.top + 1)]
        level = level[self.order]
        at = 0
        while at < n:
            stop = min(n, at + max(64, min(at, 512)))
            for height in range(int(level[at]), -1, -1):
                self._insert(self.order[at:stop][level[at:stop] >= height], self.order[:at][level[:at] >= height], height)
            at = stop
        if n:
            self._reach_all()

    @property
    def entry(self) -> int:
        return int(self.order[0])

    def _insert(self, new: np.ndarray, old: np.ndarray, height: int) -> None:
        if not len(new):
            return
        most = self.links[height].shape[1]
        own = self.x[new] @ self.x[new].T
        np.fill_diagonal(own, -np.inf)
        width = min(len(new) - 1, BUILD_BEAM)
        near = np.argpartition(-own, width - 1, axis=1)[:, :width] if width > 0 else np.zeros((len(new), 0), int)
        found, sims = new[near], np.take_along_axis(own, near, 1)
        if len(old):
            start = np.full(len(new), self.entry)
            for above in range(self.top, height, -1):
                start = self.beam(self.x[new], start[:, None], 1, above)[0][:, 0]
            there, close, _, _ = self.beam(self.x[new], start[:, None], BUILD_BEAM, height)
            found, sims = np.hstack([found, there]), np.hstack([sims, close])
        links = _diverse(self.x, new, found, sims, most)
        self.links[height][new] = links
        self._back(np.repeat(new, most)[links.ravel() >= 0], links.ravel()[links.ravel() >= 0], height)

    def _back(self, source: np.ndarray, target: np.ndarray, height: int) -> None:
        """Links from target to source; a node with too many keeps a diverse choice."""
        links, most = self.links[height], self.links[height].shape[1]
        nodes = np.unique(target)
        old = links[nodes]
        a = np.concatenate([np.repeat(nodes, most)[old.ravel() >= 0], target])
        b = np.concatenate([old.ravel()[old.ravel() >= 0], source])
        a, b = np.unique(np.stack([a, b]), axis=1)
        sims = np.einsum("ed,ed->e", self.x[a], self.x[b])
        order = np.lexsort((b, -sims, a))
        a, b, sims = a[order], b[order], sims[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))
        keep = rank < 3 * most
        row = np.searchsorted(nodes, a[keep])
        found, close = np.full((len(nodes), 3 * most), -1, np.int32), np.full((len(nodes), 3 * most), -np.inf)
        found[row, rank[keep]], close[row, rank[keep]] = b[keep], sims[keep]
        links[nodes] = _diverse(self.x, nodes, found, close, most)

    def _reach_all(self) -> None:
        """Ways in on level 0 for nodes that lost them: from its nearest where none of a node's three nearest links back, then to all that no links lead to."""
        links, n = self.links[0], len(self.x)
        at = np.arange(n)
        back = np.zeros(n, bool)
        for near in links[:, :3].T:
            back |= (near >= 0) & (links[np.maximum(near, 0)] == at[:, None]).any(axis=1)
        more: dict[int, list[int]] = {}
        for node in np.flatnonzero(~back & (links[:, 0] >= 0)):
            more.setdefault(int(links[node, 0]), []).append(int(node))
        reached, front = np.zeros(n, bool), [self.entry]
        while True:
            while front:
                reached[front] = True
                to = np.unique(links[front])
                front = {int(x) for x in to[to >= 0]}.union(*(more.get(int(x), ()) for x in front))
                front = [x for x in front if not reached[x]]
            lost = np.flatnonzero(~reached)
            if not len(lost):
                break
            doors = [int(x) for x in links[lost[0]] if x >= 0 and reached[x]]
            more.setdefault((doors or [self.entry])[0], []).append(int(lost[0]))
            front = [int(lost[0])]
        if more:
            wide = np.full((n, max(map(len, more.values()))), -1, np.int32)
            for door, nodes in more.items():
                wide[door, : len(nodes)] = nodes
            self.links[0] = np.hstack([links, wide])

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, height: int = 0, least: float = np.inf):
        """(nodes, similarities, seen, near) of each query: its `width` best nodes, best first, all that were compared, and those at `least`."""
        rows, n = len(q), len(self.x)
        links = self.links[height]
        at = np.arange(rows)
        seen = np.zeros((rows, n), bool)
        seen[at[:, None], start] = True
        over = np.zeros((rows, n), bool)
        held = np.full((rows, width), -1, np.int32)
        sims, done = np.full((rows, width), -np.inf), np.ones((rows, width), bool)
        k = min(start.shape[1], width)
        held[:, :k], done[:, :k] = start[:, :k], False
        sims[:, :k] = np.einsum("rd,rkd->rk", q, self.x[start[:, :k]])
        over[at[:, None], start[:, :k]] = sims[:, :k] >= least
        live = at
        while len(live):
            open_ = np.where(done[live], -np.inf, sims[live])
            best = open_.argmax(axis=1)
            go = open_[np.arange(len(live)), best] > -np.inf
            live, best = live[go], best[go]
            if not len(live):
                break
            done[live, best] = True
            near = links[held[live, best]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            seen[live[:, None], np.where(fresh, near, held[live, best][:, None])] = True
            close = np.where(fresh, np.einsum("rd,rmd->rm", q[live], self.x[np.maximum(near, 0)]), -np.inf)
            hit = close >= least
            if hit.any():
                over[np.repeat(live, hit.sum(axis=1)), near[hit]] = True
            all_held, all_sims = np.hstack([held[live], near]), np.hstack([sims[live], close])
            all_done = np.hstack([done[live], ~fresh])
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            held[live], sims[live] = np.take_along_axis(all_held, keep, 1), np.take_along_axis(all_sims, keep, 1)
            done[live] = np.take_along_axis(all_done, keep, 1) | (sims[live] == -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims > -np.inf, np.take_along_axis(held, order, 1), -1), sims, seen, over

    def within(self, q: np.ndarray, least: float, width: int):
        """(near, seen) of each query as matrices: nodes found at a similarity of `least` or more, and all compared.

        What the beam meets near is a seed: links of near nodes are followed until no new one is near, so a
        query may have any number of them.
        """
        n = len(self.x)
        if not n or not len(q):
            return np.zeros((len(q), n), bool), np.zeros((len(q), n), bool)
        if width >= n:  # the widest beam is the whole graph
            return q @ self.x.T >= least, np.ones((len(q), n), bool)
        start = np.full((len(q), 1), self.entry)
        for height in range(self.top, 0, -1):
            start = self.beam(q, start, 4, height)[0]
            start = np.where(start >= 0, start, self.entry)
        _, _, seen, near = self.beam(q, start, width, least=least)
        row, node = np.nonzero(near)
        while len(row):
            to = self.links[0][node]
            row, to = np.repeat(row, to.shape[1]), to.ravel()
            fresh = (to >= 0) & ~seen[row, to]
            row, to = np.divmod(np.unique(row[fresh].astype(np.int64) * n + to[fresh]), n)
            seen[row, to] = True
            hit = np.zeros(len(row), bool)
            for lo in range(0, len(row), 1 << 16):
                part = slice(lo, lo + (1 << 16))
                hit[part] = np.einsum("ed,ed->e", q[row[part]], self.x[to[part]]) >= least
            row, node = row[hit], to[hit]
            near[row, node] = True
        return near, seen
