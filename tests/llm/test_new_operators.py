"""Filter interactions, vector near-duplicates and centroid clusters against brute force."""

import hashlib
import math
from itertools import permutations

import numpy as np
import pytest

from dyadlake.llm import centroids, filters, vectors
from dyadlake.llm.tries import RadixTrie
from dyadlake.llm.worlds import World

# ---------------------------------------------------------------- tries and the audit of filters


def test_trie_keeps_the_least_key_of_each_text():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab"), n)).encode() for n in rng.integers(0, 9, 2000)]
    trie, least, nodes = RadixTrie(), {}, {}
    for key, text in zip(rng.permutation(2000).tolist(), texts, strict=True):
        node = trie.insert(text, key)
        assert nodes.setdefault(text, node) == node
        least[text] = min(key, least.get(text, key))
    assert all(trie.least[nodes[t]] == k for t, k in least.items())
    assert len(trie) <= 2 * len(least) + 1 and sum(trie.terminal) == len(least)


def masks_by_hand(rows):
    import re

    out = []
    for key, text, lang in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        repeat = key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in rows)
        capitals = sum("A" <= c <= "Z" for c in text)
        fails = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 3 * len(text), any(c in "#$%&*|" for c in text), repeat)
        out.append((key, lang or "", sum(1 << i for i, f in enumerate(fails) if f)))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    long = " ".join(f"w{i}" for i in range(300))
    same = "The same head of many documents. " * 20
    rows = [(i, long + " x" * int(rng.integers(0, 3)) + "é" * int(rng.integers(0, 2)), "en") for i in range(30)]
    rows += [(100 + i, same + str(rng.integers(0, 20)), "de") for i in range(200)]  # one long prefix
    rows += [(400 + i, "copy of a third", None if i % 2 else "") for i in range(150)]
    rows += [(900, None, "fr"), (901, "", "fr"), (902, " \t\n\x0b ", "fr"), (903, "A" * 5000, "en"), (904, "long " * 50_000, "en"), (905, " word word", "fr")]
    rows += [(7, "repeated key", "en"), (7, "repeated key", "en"), (7, "repeated key", "de"), (8, "repeated key", "en"), (9, "#$% 100 | *", None)]
    rows += [(None, "copy of a third", "en"), (None, None, None), (None, "no key", "en"), (None, "no key", "en")]
    return [rows[i] for i in rng.permutation(len(rows))]


def test_masks_equal_all_pairs(spark, texts):
    docs = spark.createDataFrame([(*r, "x", 1) for r in texts], "doc_id long, text string, lang string, mask string, bucket int")
    want = sorted(masks_by_hand(texts), key=str)
    for size in (filters.RANGE_BYTES, 500):
        got = [(r.doc_id, r.lang, r["mask"]) for r in filters.masked(docs, size).collect() for _ in range(r.n)]
        assert sorted(got, key=str) == want


def test_ranges_are_cut_within_long_prefixes(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    starts = filters.range_starts(docs, 2000)
    assert starts == sorted(set(starts))
    held = {}
    for text in {(t or "").encode() for _, t, _ in texts}:
        held.setdefault(sum(s <= text for s in starts), []).append(len(text))
    assert all(sum(x) <= 2000 or len(x) == 1 for x in held.values())
    assert sum(s.startswith(b"The same head") for s in starts) > 5  # a prefix of 660 characters was looked into


def test_own_tries_send_a_text_once(spark, texts):
    docs = spark.createDataFrame([(i, "one text " * 30, "en") for i in range(500)], "doc_id long, text string, lang string").coalesce(1)
    rows = docs.selectExpr("doc_id", "cast(text as binary) text", "lang").mapInArrow(filters.own_tries([]), filters._ROW).collect()
    assert len(rows) == 500 and [r.doc_id for r in rows if r.text is not None] == [0]
    assert all(r["mask"] & 16 for r in rows if r.text is None)


def test_audit_equals_all_orders(spark, texts):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 1000, 3)] + [(400, 1, 1), (403, None, 1), (None, 1, 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r.asDict() for r in filters.audit(filters.masked(docs), marks).collect()}
    good, toxic = {k for k, q, _ in labels if q == 1 and k is not None}, {k for k, _, t in labels if t == 1 and k is not None}
    rows = masks_by_hand(texts)
    assert len(got) == 600 * len({lang for _, lang, _ in rows})
    shapley = {}
    for part in {lang for _, lang, _ in rows}:
        mine = [(k, m) for k, lang, m in rows if lang == part]
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [(k, m) for k, m in left if m >> f & 1]
                earlier = len([1 for k, m in mine if m >> f & 1]) - len(gone)
                left = [(k, m) for k, m in left if not m >> f & 1]
                r = got[part, "".join("ABCDE"[i] for i in order), step]
                want = (len(left), len(gone), earlier, sum(m == 1 << f for _, m in mine), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone))
                assert tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")) == want
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    assert all(r["shapley"] == shapley[part, "ABCDE".index(order[step - 1])] for (part, order, step), r in got.items())


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(filters.masked(docs), labels).count() == 0


# ---------------------------------------------------------------- vectors


def links_by_hand(rows, least=0.93):
    """rows (vec_id, embedding, label) to {row: (n_links, component)}"""

    def fine(r):
        e = r[1]
        return r[0] is not None and r[2] is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)

    near = {i: set() for i in range(len(rows))}
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v, float) / max(map(abs, v)) for v in (a[1], b[1]))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, front = {i}, [i]
        while front:
            front = [k for j in front for k in near[j] if k not in seen and not seen.add(k)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((r[0], len(near[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(2)
    near = lambda base, n, noise: (base + noise * rng.normal(size=(n, len(base)))).astype(np.float32).tolist()
    one, two = rng.normal(size=64), rng.normal(size=64)
    listed = [(v, 1) for v in near(one, 60, 0.05)] + [(v, 1) for v in near(two, 80, 0.19)] + [(v, 2) for v in near(one, 30, 0.1)]
    listed += [(rng.normal(size=64).astype(np.float32).tolist(), int(k)) for k in rng.integers(1, 4, 60)]
    listed += [(listed[0][0], 1)] * 40 + [([2 * x for x in listed[0][0]], 1), (listed[0][0], None)]
    listed += [(None, 1), ([], 1), ([0.0] * 64, 1), ([float("nan")] * 64, 1), ([None] + [1.0] * 63, 1), ([float("inf")] + [1.0] * 63, 1)]
    listed += [([1.0, 0.0], 1), ([1.0, 0.1], 1), ([1e38, 1e38], 1), ([1.0, 1.0], 1), ([1e-40, 1e-40], 1)]
    rows = [(10 * i, v, k) for i, (v, k) in enumerate(listed)]
    rows += [(None, listed[0][0], 1), (10, listed[70][0], 1), (20, listed[1][0], 1)]  # no key, repeated keys
    return [rows[i] for i in rng.permutation(len(rows))]


@pytest.mark.parametrize("shard", [4096, 37])
def test_links_and_components_equal_all_pairs(spark, vector_rows, shard):
    df = spark.createDataFrame([(*r, 1) for r in vector_rows], "vec_id long, embedding array<float>, label int, rows int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in vectors.near_duplicates(df, shard=shard).collect()]
    assert sorted(got, key=str) == links_by_hand(vector_rows)


def test_graph_of_a_dense_and_a_sparse_group():
    rng = np.random.default_rng(3)
    base = rng.normal(size=64)
    x = np.concatenate([base + 0.15 * rng.normal(size=(700, 64)), rng.normal(size=(1500, 64))])
    x = x[rng.permutation(len(x))]
    twin = x + 0.1 * rng.normal(size=x.shape)
    a, b = World(vectors.unit(x)), World(vectors.unit(twin))
    for one, two in ((a, None), (a, b)):
        links, width = vectors.linked(one, two, 0.93)
        true = one.x @ (two or one).x.T >= 0.93
        if two is None:
            np.fill_diagonal(true, False)
        assert not (links & ~true).any() and (links & true).sum() >= 0.999 * true.sum()
    near, seen = a.within(a.x, 0.93, 32)
    assert near.sum() >= 0.9 * (a.x @ a.x.T >= 0.93).sum() and seen.mean() < 0.6


def test_a_shard_packs():
    x = np.random.default_rng(4).normal(size=(300, 8))
    shard = vectors.Shard(np.arange(300), np.ones(300, np.int64), x)
    again = vectors.Shard.unpacked(shard.packed())
    assert all((p == q).all() for p, q in zip(shard.world.links, again.world.links, strict=True)) and (again.vectors == x).all()


def test_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(df).count() == 0


# ---------------------------------------------------------------- centroids


def clusters_by_hand(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [r[1] for r in first[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda v: min(range(len(cs)), key=lambda c: (far(v, cs[c]), c))
    for _ in range(rounds):
        at = [place(v) for _, v in kept]
        new = []
        for c, old in enumerate(cs):
            mine = [v for (_, v), x in zip(kept, at, strict=True) if x == c]
            new.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else old)
        cs = new
    return [(i, place(v), far(v, cs[place(v)])) for i, v in kept], cs


@pytest.mark.parametrize("huge", [False, True])
def test_clusters_equal_brute_force(spark, tmp_path, huge):
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 64)).astype(np.float32).tolist())]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # a third of all rows
    rows += [(3, rows[5][1]), (None, rows[7][1]), (2000, None), (2001, [1.0] * 63), (2002, [None] + [1.0] * 63), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64)]
    rows += [(3000 + i, v) for i, v in enumerate(rng.integers(-1, 2, (100, 64)).astype(float).tolist())]  # ties
    if huge:
        rows += [(4000, [3e38] * 64), (4001, [-3e38] * 64), (4002, [1e7] * 64)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, cluster int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    want, cs = clusters_by_hand(rows)
    fit = lambda d: d if d < 2**63 else None
    got = centroids.op13_centroid_clusters(spark, str(tmp_path)).collect()
    assert sorted([(r.vec_id, r.cluster, r.distance) for r in got], key=str) == sorted([(i, c, fit(d)) for i, c, d in want], key=str)
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()
        mine = [fit(d) for _, c, d in want if c == r.cluster]
        assert r.cluster_inertia == (None if None in mine else fit(sum(mine)))
    if not huge:
        assert {r.inertia for r in got} == {sum(d for _, _, d in want)}


def test_few_and_no_vectors(spark):
    three = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<double>")
    found, cs = centroids.clustered(three)
    assert len(cs) == 3 and found.where("distance = 0").count() == 3
    assert centroids.clustered(three.limit(0))[0].count() == 0


def test_tree_enters_few_nodes_and_ties_go_down():
    rng = np.random.default_rng(8)
    cs = rng.integers(-5, 5, (16, 64)).tolist()
    cs[9] = cs[4]
    tree = centroids.Tree(cs)
    x = rng.integers(-5, 5, (500, 64))
    far = ((x[:, None] - np.array(cs)) ** 2).sum(axis=2)
    number, square = tree.nearest(x)
    assert (number == far.argmin(axis=1)).all() and (square == far.min(axis=1)).all()
