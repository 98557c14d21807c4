"""Scored and mixed lists of whole pools: one array of candidates at a time, hashed and ranked where it lies.

The stand-in model's chances are digests, and nearly all the work. A pool is scored target by target, the heaviest
first: bounds of a score close as its chances come, and where only the best are asked for, a candidate that can no
longer be one of them gets no further digest. Whoever is returned has all its chances; results don't depend on the bounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from dyadlake.schema import RISK_WEIGHTS, SCORE_WEIGHTS

try:  # the built-in one starts faster than OpenSSL's, which matters for messages of one block
    from _sha2 import sha256
except ImportError:
    from hashlib import sha256

MOST = 250  # ranks that the second stage of a mix draws from
SLACK = 1e-8  # of bounds: more than rounding a score to nine digits moves it
#: Chances in the order in which they are made: those that move a score most come first.
ORDER = ["report", "block", "reciprocal_message", "message_started", "partner_accepted", "favorite", "image_reaction", "story_engagement", "private_album_grant", "poke"]
_GAIN, _RISK = sum(SCORE_WEIGHTS.values()), sum(RISK_WEIGHTS.values())


def digests(prefix: bytes, ends: list[bytes]) -> np.ndarray:
    """The first 52 bits of the SHA-256 of prefix and each end, as doubles."""
    whole = b"".join([sha256(prefix + end).digest() for end in ends])
    return (np.frombuffer(whole, ">u8")[::4] >> 12).astype(np.float64)


def rounded(x: np.ndarray, digits: int = 9) -> np.ndarray:
    """Half away from zero, as SQL does; x is not negative."""
    y = x * 10.0**digits
    low = np.floor(y)
    return (low + (y - low >= 0.5)) / 10.0**digits


class Pool:
    """The scores of one viewer's candidates, as far as they have been made."""

    def __init__(self, viewer: int, ids: np.ndarray):
        self.viewer, self.ids = viewer, ids
        self.ends = [b"%d" % c for c in ids.tolist()]
        self.p, self.made = np.zeros((len(ORDER), len(ids))), np.zeros(len(ids), int)
        # what is known of the sums, and what is still missing after so many chances
        self.gain, self.risk = np.zeros(len(ids)), np.zeros(len(ids))
        self.more = np.array([[sum(w.get(t, 0.0) for t in ORDER[k:]) / all_ for k in range(len(ORDER) + 1)] for w, all_ in ((SCORE_WEIGHTS, _GAIN), (RISK_WEIGHTS, _RISK))])

    def advance(self, at: np.ndarray, k: int) -> None:
        """The next chance of the candidates at, who have k of them."""
        t = ORDER[k]
        p = digests(f"{t}:{self.viewer}:".encode(), [self.ends[i] for i in at.tolist()]) / float(2**52)
        self.p[k, at] = p
        self.gain[at] += p * (SCORE_WEIGHTS.get(t, 0.0) / _GAIN)
        self.risk[at] += p * (RISK_WEIGHTS.get(t, 0.0) / _RISK)
        self.made[at] = k + 1

    def highest(self, at: np.ndarray) -> np.ndarray:
        """What the scores of the candidates at may be at most."""
        return (self.gain[at] + self.more[0, self.made[at]]) * (1 - self.risk[at]) + SLACK

    def settle(self, least: float, at: np.ndarray) -> None:
        """All chances of those among the candidates at that may reach least."""
        for k in range(len(ORDER)):
            mine = at[self.made[at] == k]
            if len(mine):
                self.advance(mine, k)
                at = at[self.highest(at) >= least]

    def fill(self) -> None:
        """All chances of everyone."""
        for k, t in enumerate(ORDER):
            self.p[k] = digests(f"{t}:{self.viewer}:".encode(), self.ends) / float(2**52)
        self.made[:] = len(ORDER)

    def scores(self, at: np.ndarray) -> np.ndarray:
        """The scores of candidates with all chances."""
        p = {t: self.p[k, at] for k, t in enumerate(ORDER)}

        def mean(weights: dict[str, float], all_: float) -> np.ndarray:
            total = 0.0
            for t, w in weights.items():
                total = total + p[t] * w
            return total / all_

        return rounded(np.clip(mean(SCORE_WEIGHTS, _GAIN) * (1 - mean(RISK_WEIGHTS, _RISK)), 0.0, 1.0))

    def ranked(self, top: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), the best first, ties by id; only the first top, if that is given."""
        every = np.arange(len(self.ids))
        if top is None or 3 * top >= len(every):
            self.fill()
        else:
            for k in range(3):
                self.advance(every, k)
            # the best by what is known get all chances: the last of as many as are asked for bounds the others
            guess = np.argsort(-(self.gain + self.more[0, 3] / 2) * (1 - self.risk), kind="stable")
            first = guess[: top + top // 2]
            self.settle(-1.0, first)
            least = np.partition(self.scores(first), len(first) - top)[len(first) - top]
            self.settle(least, every[self.highest(every) >= least])
        done = np.flatnonzero(self.made == len(ORDER))
        score = self.scores(done)
        by = np.lexsort((self.ids[done], -score))[:top]
        return self.ids[done][by], score[by]


def _race(seed: str, ids: np.ndarray, scores: np.ndarray, ranks: np.ndarray, start: int, n: int) -> np.ndarray:
    """Places of the n smallest values of an exponential race, in order, ties by id."""
    u = (digests(f"{seed}:".encode(), [b"%d" % c for c in ids.tolist()]) + 1) / float(2**52 + 1)
    value = rounded(-np.log(u) / (np.maximum(scores, 0.001) / np.sqrt(np.maximum(1, ranks - start + 1))))
    return np.lexsort((ids, value))[:n]


def mix(ids: np.ndarray, scores: np.ndarray, seed: str, n_model: int, n_sampled: int, n_explore: int) -> list[tuple[np.ndarray, str]]:
    """[(places in the ranked list, kind)] of the stages of ranking.select_mix, in the order of selection."""
    n, total = len(ids), n_model + n_sampled + n_explore
    ranks = np.arange(1, n + 1)
    draw = lambda seed, at, start, k: at[_race(seed, ids[at], scores[at], ranks[at], start, k)] if len(at) and k else at[:0]
    every = np.arange(n)
    second = draw(seed, every[n_model:MOST], n_model + 1, n_sampled)
    left = np.setdiff1d(every[n_model : n_model + MOST + 1 + total], second)
    third = every[:0]
    if n_explore:
        far = every[MOST:] if n > MOST else left[len(left) // 2 :]
        third = draw(f"{seed}:explore", far, int(ranks[far[0]]) if len(far) else 1, n_explore)
        left = np.setdiff1d(left, third)
    model = every[:n_model]
    free = max(0, total - len(model) - len(second) - len(third))
    return [(model, "model"), (second, "diversity"), (third, "exploration"), (left[:free], "model")]


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        ids = batch["ids"]
        ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        for viewer, a, b in zip(batch["viewer_id"].to_pylist(), ends, ends[1:], strict=False):
            yield viewer, flat[a:b]


def ranked(top: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (viewer_id, ids): (viewer_id, list), the list an array of (rank, candidate_id, score)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for viewer, ids in _pools(batches):
            best, score = Pool(viewer, ids).ranked(top)
            rank = pa.array(np.arange(1, len(best) + 1, dtype=np.int32))
            each = pa.StructArray.from_arrays([rank, pa.array(best), pa.array(score)], names=["rank", "candidate_id", "score"])
            yield pa.RecordBatch.from_arrays([pa.array([viewer], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(best)], pa.int32()), each)], names=["viewer_id", "list"])

    return work


def mixed(n_model: int, n_sampled: int, n_explore: int, product: str, day: str, version: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of batches (viewer_id, ids): the rows of each viewer's mixed list."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for viewer, ids in _pools(batches):
            # without deep ranks nothing beyond the second stage's is looked at, unless the list ends before
            best, score = Pool(viewer, ids).ranked(None if n_explore else max(MOST, n_model + n_sampled))
            stages = mix(best, score, f"{product}:{viewer}:{day}:{version}", n_model, n_sampled, n_explore)
            at = np.concatenate([s for s, _ in stages])
            kinds = [kind for s, kind in stages for _ in range(len(s))]
            place = np.arange(1, len(at) + 1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), viewer, np.int64)), pa.array(best[at]), pa.array(score[at]), pa.array((at + 1).astype(np.int32)), pa.array(place), pa.array(kinds, pa.string())], names=["viewer_id", "candidate_id", "score", "model_rank", "final_rank", "selection_type"])

    return work
