"""The adaptive grid, exact positions and candidate pools against all pairs."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from dyadlake.functions import scalar as S
from dyadlake.operators import geo, pools
from dyadlake.operators.order import positions, running_sums


def km(a, b, c, d):
    h = np.sin(np.radians(c - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(c)) * np.sin(np.radians(d - b) / 2) ** 2
    return 2 * S.EARTH_KM * np.arcsin(np.minimum(1, np.sqrt(h)))


@pytest.fixture(scope="module")
def places():
    """Half of all in one city, a default position, both poles, both sides of the date line."""
    rng = np.random.default_rng(3)
    lat = np.concatenate([rng.uniform(-90, 90, 250), 47.6 + 0.05 * rng.normal(size=400), np.full(60, 10.0), rng.uniform(88, 90, 40), rng.uniform(-90, -89, 30), rng.uniform(-2, 2, 60)])
    lon = np.concatenate([rng.uniform(-180, 180, 250), -122.3 + 0.05 * rng.normal(size=400), np.full(60, 10.0), rng.uniform(-180, 180, 70), (rng.uniform(179, 181, 60) + 180) % 360 - 180])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(lat, lon, strict=True))]
    return rows + [(7000, None, 1.0), (7001, 1.0, None), (7002, float("nan"), 0.0), (7003, 90.0, 0.0), (7004, -90.0, 5.0), (7005, 95.0, 0.0), (7006, 0.0, float("inf"))]


def test_grid_cells_stay_small(spark, places):
    points, nodes = geo.grid(spark.createDataFrame(places, "id long, lat double, lon double"), 25)
    held = points.groupBy("level", "code", "salt").count()
    assert held.where("count > 45").count() == 0 and points.count() == len(places) - 5
    assert nodes.where("split AND n <= 25").count() == 0
    assert held.where("salt > 0").count() > 0  # one position with 60 users


def test_radius_equals_all_pairs(spark, places):
    rng = np.random.default_rng(4)
    asks = [(i, a, b, float(m)) for (i, a, b), m in zip(places[::7] + places[-7:], rng.choice([0.0, 10.0, 3000.0, 40000.0, 482803.2, 3e6, 1.2e7, 3e7], len(places)), strict=False)]
    got = geo.within_radius(spark.createDataFrame(asks, "id long, lat double, lon double, metres double"), spark.createDataFrame(places, "id long, lat double, lon double"), 25)
    here = np.array([r for r in places if None not in r and np.isfinite(r[1:]).all() and abs(r[1]) <= 90], float)
    want = {(i, int(j)) for i, a, b, m in asks if i in here[:, 0] for j in here[km(a, b, here[:, 1], here[:, 2]) * 1000 <= m, 0] if i != j}
    rows = [(r.viewer_id, r.candidate_id) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_positions_and_sums_of_one_value_over_many_parts(spark):
    rng = np.random.default_rng(5)
    rows = [(str(g), int(v) if g else 0, i) for i, (g, v) in enumerate(zip(rng.integers(0, 2, 3000), rng.integers(0, 4, 3000), strict=True))]
    df = spark.createDataFrame(rows, "g string, v long, i long")
    order = [df["v"].desc(), df["i"].asc()]
    want = {}
    for g in "01":
        mine, total = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 0
        for at, r in enumerate(mine):
            total += r[1]
            want[r[2]] = (at, total)
    got = {r.i: r.position for r in positions(df, ["g"], order).collect()}
    sums = {r.i: r.v_upto for r in running_sums(df, ["g"], order, ["v"]).collect()}
    assert {i: (got[i], sums[i]) for i in got} == want
    assert {r.i for r in positions(df, [], order).where("position = 0").collect()} == {max(rows, key=lambda r: (r[1], -r[2]))[2]}
    assert positions(df.limit(0), ["g"], order).count() == 0


@pytest.fixture(scope="module")
def people(places):
    rng = np.random.default_rng(6)
    start, rows = datetime(2024, 1, 1), []
    for i, lat, lon in places:
        seen = None if i % 11 == 0 else start + timedelta(minutes=int(rng.integers(0, 300)))
        city = [None, "Metropolis", " metropolis", "Smallville", ""][rng.choice(5, p=[0.1, 0.4, 0.3, 0.15, 0.05])]
        wish = ["any", "same city", "same neighborhood", "within 300 miles", None][int(rng.integers(0, 5))]
        rows.append((i, bool(i % 50 == 7), [False, None, True][0 if i % 40 else int(i % 3)], city, lat, lon, seen, wish))
    settings = [(i, None if i % 3 else bool(i % 5)) for i, *_ in rows[::2]]
    ids = [r[0] for r in rows]
    blocks = [(int(a), int(b)) for a, b in rng.choice(ids, (400, 2))] + [(ids[5], x) for x in ids[100:420]] + [(x, ids[300]) for x in ids[40:180]]
    return rows, settings, blocks


@pytest.mark.parametrize("near", [False, True])
@pytest.mark.parametrize("limit", [7, 60])
def test_pools_equal_all_pairs(spark, people, monkeypatch, near, limit):
    rows, settings, blocks = people
    monkeypatch.setattr(pools, "SPARE", 5)
    monkeypatch.setattr(pools, "READERS", 10)
    monkeypatch.setattr(pools, "FIRST_RANKS", 2)
    monkeypatch.setattr(geo, "CELL_ROWS", 25)
    users = spark.createDataFrame(rows, "id long, is_bot boolean, is_banned boolean, city string, lat double, lon double, last_seen_at timestamp_ntz, into_proximity string")
    got = pools.eligible_candidates(users.select("id"), users, spark.createDataFrame(settings, "user_id long, visible boolean"), spark.createDataFrame(blocks, "blocker_user_id long, blocked_user_id long"), limit, near)
    hidden = {i for i, v in settings if v is False}
    pool = [r for r in rows if not r[1] and r[2] is False and r[0] not in hidden]
    pool.sort(key=lambda r: (r[6] is None, -(r[6] or datetime(2024, 1, 1)).timestamp(), r[0]))
    shut = {(a, b) for a, b in blocks} | {(b, a) for a, b in blocks}
    want = {}
    fine = lambda a, b: a is not None and b is not None and np.isfinite([a, b]).all() and abs(a) <= 90
    for i, _, _, city, lat, lon, _, wish in rows:
        mine = [c for c in pool if c[0] != i and (i, c[0]) not in shut]
        place = (city or "").strip().lower()
        if near and wish == "same city":
            mine = [c for c in mine if place and (c[3] or "").strip().lower() == place]
        elif near and wish in ("same neighborhood", "within 300 miles"):
            reach = 1609.344 * (5 if wish == "same neighborhood" else 300)
            mine = [c for c in mine if fine(lat, lon) and fine(c[4], c[5]) and km(lat, lon, c[4], c[5]) * 1000 <= reach]
        want |= {(i, c[0]): at for at, c in enumerate(mine[:limit], 1)}
    assert {(r.viewer_id, r.candidate_id): r.pool_rank for r in got.collect()} == want
