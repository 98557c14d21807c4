"""Compressed tries over byte strings, with the least id at each terminal."""

from __future__ import annotations


def common_prefix(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """How many bytes a[i:] and b[j:] share, of at most `most`; equal slices are compared whole."""
    if a[i : i + most] == b[j : j + most]:
        return most
    low, high = 0, most  # the first `low` bytes are equal, the first `high` aren't
    while high - low > 1:
        mid = (low + high) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low


class RadixTrie:
    """Texts share the bytes of their common prefixes; an edge is a slice of a text that was inserted.

    Node 0 is the root. `insert` returns the number of the text's terminal node, which stays the same
    while edges above it split.
    """

    def __init__(self) -> None:
        self._text: list[bytes] = [b""]  # of the edge that leads to a node
        self._from: list[int] = [0]
        self._to: list[int] = [0]
        self._next: list[dict[int, int]] = [{}]
        self.least: list[int | None] = [None]
        self.terminal: list[bool] = [False]

    def __len__(self) -> int:
        return len(self._text)

    def _node(self, text: bytes, start: int, stop: int) -> int:
        for held, value in ((self._text, text), (self._from, start), (self._to, stop), (self._next, {}), (self.least, None), (self.terminal, False)):
            held.append(value)
        return len(self._text) - 1

    def insert(self, text: bytes, key: int | None) -> int:
        """Walk text down, splitting an edge where it leaves it; keep the least key at its terminal. A null key counts for nothing."""
        at, i, n = 0, 0, len(text)
        while i < n:
            step = self._next[at].get(text[i])
            if step is None:
                new = self._node(text, i, n)
                self._next[at][text[i]] = new
                at = new
                break
            edge, start = self._text[step], self._from[step]
            length = self._to[step] - start
            same = common_prefix(edge, start, text, i, min(length, n - i))
            if same < length:
                middle = self._node(edge, start, start + same)
                self._next[at][text[i]] = middle
                self._next[middle][edge[start + same]] = step
                self._from[step] = start + same
                step = middle
            at, i = step, i + same
        self.terminal[at] = True
        if key is not None and (self.least[at] is None or key < self.least[at]):
            self.least[at] = key
        return at
