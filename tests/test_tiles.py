"""All pairs with a common target from tiles of small blocks, against brute force."""

import math
import random

import pytest

from dyadlake.operators import graph as G
from dyadlake.operators import tiles
from dyadlake.plans import oracle as O
from dyadlake.plans import queries as Q


@pytest.mark.parametrize("size", [40, 10_000])
def test_tiles_equal_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(tiles, "EDGES", size)
    rng = random.Random(size)
    edges = {(u, 0): float(rng.randint(1, 3)) for u in range(1, 60)}  # a target that many have
    edges |= {(u, rng.randrange(30)): round(rng.expovariate(1), 1) + 0.1 for u in range(30, 120) for _ in range(rng.randint(1, 6))}
    edges |= {(999, 5000): 1.0}  # shares nothing
    vectors, degree = {}, {}
    for (u, t), w in edges.items():
        vectors.setdefault(u, {})[t] = w
        degree[t] = degree.get(t, 0) + 1
    for u, x in vectors.items():
        norm = math.sqrt(sum(w * w for w in x.values()))
        vectors[u] = {t: round(w / norm * 1e6) for t, w in x.items()}
    want = {(u, v): (sum(1 / math.log(1 + degree[t]) for t in x if t in y), sum(a * y.get(t, 0) for t, a in x.items())) for u, x in vectors.items() for v, y in vectors.items() if u != v and x.keys() & y.keys()}
    df = spark.createDataFrame([(u, t, w) for (u, t), w in edges.items()], "src long, dst long, w double")
    rows = tiles.common_pairs(df).collect()
    assert len(rows) == len(want) and {(r.src, r.dst): r.dot for r in rows} == {k: d for k, (_, d) in want.items()}
    assert all(r.x == pytest.approx(want[r.src, r.dst][0]) for r in rows)
    near = {}
    for r in G.closest(tiles.common_pairs(df, 5), 5).collect():
        near.setdefault(r.src, set()).add(r.dst)
    for u in vectors:
        mine = sorted((-d, v) for (a, v), (_, d) in want.items() if a == u and d > 0)[:5]
        assert {v for _, v in mine} == near.get(u, set())


def test_no_edges_no_pairs(spark):
    assert tiles.common_pairs(spark.createDataFrame([], "src long, dst long, w double")).count() == 0


def test_pairs_that_only_share_a_target_are_made(spark, monkeypatch):
    # 60 users with one target in common: more than the 50 closest of each, and none was exposed to another
    signals = spark.sql("SELECT id AS actor_id, 999L AS target_id, 1.0D AS raw, 'long' AS horizon FROM range(1, 61)")
    monkeypatch.setattr(Q, "_signal", lambda spark, sf_dir: signals)
    monkeypatch.setattr(Q, "_users", lambda spark, sf_dir: spark.sql("SELECT id, 'Top' AS position FROM range(1, 61)"))
    for name in ("graph_shared_neighbours", "graph_similarity"):
        assert Q.QUERIES[name](spark, "").count() == 60 * 59
        assert "keys" not in Q.ORACLES[name].replace(O.STATS, "")
    assert Q.graph_pair_features(spark, "").where("src < 999 AND dst < 999 AND similarity > 0 AND shared > 0").count() == 60 * 59
