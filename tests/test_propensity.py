"""Logistic models of several targets fitted together, on planted weights."""

import numpy as np

from dyadlake.operators import prepare as PR
from dyadlake.operators import propensity as ML


def planted(n=4000):
    rng = np.random.default_rng(0)
    x, ids = rng.normal(3, 2, n), [rng.choice(6, rng.integers(0, 4), replace=False).tolist() for _ in range(n)]
    own = np.array([1.5, -1.0, 0.5, 0.0, 0.0, -2.0])
    push = np.array([own[i].sum() if i else 0.0 for i in ids])
    chance = {"a": 1 / (1 + np.exp(-(0.5 + 1.2 * (x - 3) / 2 + push))), "b": 1 / (1 + np.exp(-(-2.0 - push)))}
    rows = [
        (k, None if k % 10 == 0 else float(x[k]), [*map(int, ids[k]), 99] if k % 3 else [*map(int, ids[k])], bool(rng.random() < chance["a"][k]), None if k % 7 == 0 else bool(rng.random() < chance["b"][k]), False)
        for k in range(n)
    ]
    return rows, chance, x, ids


def test_planted_weights_are_found(spark):
    rows, chance, x, ids = planted()
    df = spark.createDataFrame(rows, "_p long, x double, t array<int>, outcome_a boolean, outcome_b boolean, outcome_never boolean").repartition(5)
    models = ML.fit_propensities(df, ["x"], ["a", "b", "never"], {"a": 1.0, "b": 1.0}, {"t": 6}, ridge=1e-4)
    assert models.targets == ["a", "b"] and models.design.size == 1 + 2 + 6
    a, b = models.weights.T
    assert abs(a[1] - 1.2) < 0.2 and np.abs(a[3:] - [1.5, -1.0, 0.5, 0, 0, -2.0]).max() < 0.35
    assert abs(b[1]) < 0.2 and np.abs(b[3:] + [1.5, -1.0, 0.5, 0, 0, -2.0]).max() < 0.5
    got = ML.predict_propensities(df, models).collect()
    known = [r for r in got if r._p % 10]
    assert np.mean([abs(r.p_a - chance["a"][r._p]) for r in known]) < 0.03
    assert got[0].x is None or got[0]._p % 10  # nulls of the caller's columns stay null


def test_the_optimum_is_that_of_plain_newton_steps(spark):
    rows, _, _, _ = planted(800)
    df = spark.createDataFrame(rows, "k long, x double, t array<int>, outcome_a boolean, outcome_b boolean, outcome_never boolean")
    models = ML.fit_propensities(df, ["x"], ["a", "b"], {"a": 3.0, "b": 0.5}, {"t": 6}, rounds=80)
    fill, mean, std = models.design.stats["x"]
    X = np.zeros((len(rows), 9))
    for i, r in enumerate(rows):
        X[i, :3] = 1, ((fill if r[1] is None else r[1]) - mean) / std, r[1] is None
        X[i, [3 + j for j in r[2] if j < 6]] = 1
    for t, (at, pos) in enumerate(((3, 3.0), (4, 0.5))):
        y = np.array([np.nan if r[at] is None else float(r[at]) for r in rows])
        w = np.where(np.isnan(y), 0, np.where(y > 0, pos, 1.0)) / np.where(np.isnan(y), 0, np.where(y > 0, pos, 1.0)).sum()
        ridge, y, beta = 0.01 * np.r_[0, np.ones(8)], np.nan_to_num(y), np.zeros(9)
        for _ in range(30):
            p = 1 / (1 + np.exp(-X @ beta))
            beta -= np.linalg.solve((X * (w * p * (1 - p))[:, None]).T @ X + np.diag(ridge + 1e-12), X.T @ (w * (p - y)) + ridge * beta)
        assert np.abs(models.weights[:, t] - beta).max() < 2e-3


def test_no_rows_no_models(spark):
    df = spark.createDataFrame([], "x double, outcome_a boolean")
    assert ML.fit_propensities(df, ["x"], ["a"], {}).targets == []


def test_arrays_are_encoded_by_a_join(spark):
    voc = spark.createDataFrame([("t", "a", 2), ("t", "b", 3), ("u", "a", 2)], "field string, token string, id int")
    rows = spark.createDataFrame([(1, ["b", " a", "a", None, " "], None), (2, None, ["zzz", "a"]), (3, [], ["b"])], "k long, t array<string>, u array<string>")
    got = {r.k: (r.ids_t, r.ids_u) for r in PR.encoded_arrays(rows, ["t", "u"], voc).collect()}
    assert got == {1: ([2, 3], []), 2: ([], [1, 2]), 3: ([], [1])}
