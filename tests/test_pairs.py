"""Queries against their SQL at the smallest size, and micro-fixtures for edge cases."""

import math
import random
import statistics
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from dyadlake.functions import scalar as S
from dyadlake.operators import events as E
from dyadlake.operators import graph as G
from dyadlake.operators import pairs as P
from dyadlake.operators import peers
from dyadlake.operators import prepare as PR
from dyadlake.operators import ranking as R
from dyadlake.operators.peers import shared_of, similarity_of, top_peers
from dyadlake.plans import queries as Q
from dyadlake.plans import extra  # noqa: F401
from dyadlake.sources import datasets as D
from dyadlake.sources.shared import cut
from dyadlake.streaming.impressions import validated

SF = "/root/testdata/sf0.001"
SOME = ["valid_event_log", "pair_history", "actor_history", "affinity_state", "user_traits", "located_candidates", "daily_suggestions", "search_flights", "graph_candidates", "affinity_import", "encoded_multi", "random_split"]


def _norm(df):
    show = lambda v: "None" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    cols = sorted(df.columns)
    return cols, sorted(tuple(show(v) for v in r) for r in df[cols].astype(object).where(df[cols].notna(), None).values.tolist())


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("customer", "part", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert _norm(Q.QUERIES[name](spark, SF).toPandas()) == _norm(c.sql(Q.ORACLES[name]).df())


def test_age_on_leap_days(spark):
    df = spark.sql("SELECT DATE'2000-02-29' AS b, DATE'2023-02-28' AS a UNION ALL SELECT DATE'2000-02-29', DATE'2023-03-01' UNION ALL SELECT NULL, DATE'2023-03-01'")
    assert [r[0] for r in df.select(S.age_years(F.col("a"), F.col("b"))).collect()] == [22, 23, None]


def test_heights(spark):
    df = spark.createDataFrame([("5'11\"",), ("5'12\"",), ("97",), (" 36\t",), ("",), (None,), ("tall",)], "h string")
    assert [r[0] for r in df.select(S.height_inches(F.col("h"))).collect()] == [71.0, None, None, 36.0, None, None, None]


def test_bad_heights_do_not_stop_a_job(spark):
    df = spark.createDataFrame([("999999999'5",), ("1e20",), ("nan",), ("Infinity",), ("-inf",), ("99999999999999999999'1",), ("6'",), ("60.9",)], "h string")
    assert [tuple(r) for r in df.select(S.height_inches(F.col("h")), S.height_inches_search(F.col("h"))).collect()][1:5] == [(None, None)] * 4
    assert [r[0] for r in df.select(S.height_inches_search(F.col("h"))).collect()] == [None] * 6 + [72, 60]


def test_viewers_with_many_blocks_get_full_pools(spark):
    n = P.SPARE + 400
    users = spark.range(1, n + 1).select("id", F.lit(False).alias("is_bot"), F.lit(False).alias("is_banned"), F.lit(None).cast("timestamp_ntz").alias("last_seen_at"), F.lit(None).cast("string").alias("city"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    blocks = spark.range(2, P.SPARE + 302).select(F.lit(1).cast("long").alias("blocker_user_id"), F.col("id").alias("blocked_user_id"))
    settings = spark.createDataFrame([], "user_id long, visible boolean")
    got = P.eligible_candidates(users.where("id in (1, 2, 450)").select("id"), users, settings, blocks, 20).groupBy("viewer_id").agg(F.collect_list("candidate_id").alias("c")).collect()
    got = {r.viewer_id: sorted(r.c) for r in got}
    first = P.SPARE + 302
    assert got == {1: list(range(first, first + 20)), 2: list(range(3, 23)), 450: list(range(1, 21))}


def test_datasets_and_manifests(spark, tmp_path):
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02' AS cutoff_at, id AS viewer_id, id + 1 AS candidate_id FROM range(3)")
    D.write_pairs(rows, str(tmp_path / "a"), "json")
    D.write_pairs(rows, str(tmp_path / "a"), "json")  # replaces
    back = D.read_pairs_jsonl(spark, str(tmp_path / "a"), rows.schema)
    assert back.count() == 3 and D.dataset_manifest(back).first().n_rows == 3
    (tmp_path / "b.json").write_text('{"viewer_id": 1}\n\n{"viewer_id": oops}\n')
    lax = D.read_pairs_jsonl(spark, str(tmp_path / "b.json"), rows.schema, strict=False).collect()
    assert sorted(r._corrupt_record is not None for r in lax) == [False, True]
    with pytest.raises(ValueError, match=r"b\.json, line 3: .*1 such"):
        D.read_pairs_jsonl(spark, str(tmp_path / "b.json"), rows.schema)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    schema = spark.sql("SELECT 1L AS id, 'x' AS t").schema
    (tmp_path / "in").mkdir()
    for name, bad in (("a", []), ("b", [777, 1500]), ("c", [3])):
        lines = [f'{{"id": {i}, "t": "{"y" * (i % 50)}"}}' if i not in bad else "{not json" for i in range(1, 2001)]
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(lines) + "\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = {r.file.rsplit("/", 1)[1]: (r.rows, r.corrupt, r.line) for r in D.line_report(spark, str(tmp_path / "in"), schema).collect()}
        assert got == {"a.json": (2000, 0, None), "b.json": (2000, 2, 777), "c.json": (2000, 1, 3)}
        with pytest.raises(ValueError, match=r"b\.json, line 777: .*2 such"):
            D.read_pairs_jsonl(spark, str(tmp_path / "in"), schema)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_splits(spark):
    rows = spark.range(1000)
    parts = {r["split"]: r["count"] for r in PR.random_split(rows, ["id"], "x").groupBy("split").count().collect()}
    assert parts == {"test": 100, "validation": 200, "train": 700}
    assert {r["split"] for r in PR.random_split(rows.limit(2), ["id"], "x").collect()} == {"train"}


@pytest.mark.parametrize(
    ("sizes", "want"),
    [
        ([10, 10, 10, 10, 1], ["train", "train", "validation", "test", "test"]),
        ([10, 10, 10], ["train", "validation", "test"]),
        ([1, 1, 98], ["train", "validation", "test"]),
        ([90, 5, 5], ["train", "test", "test"]),
        ([91, 4, 5], None),  # test needs the oldest too: nothing to train on
    ],
)
def test_chronological_split(spark, sizes, want):
    rows = [(datetime(2024, 1, 1 + i), k) for i, n in enumerate(sizes) for k in range(n)]
    df = spark.createDataFrame(rows, "cutoff_at timestamp_ntz, id long")
    if want is None:
        with pytest.raises(Exception, match="no cutoff is left"):
            PR.chronological_split(df).collect()
    else:
        assert [r["split"] for r in PR.chronological_split(df).orderBy("cutoff_at").collect()] == want
        split, how = PR.split_rows(df, ["id"], "x")
        assert how == "chronological" and {(r.cutoff_at.day, r["split"]) for r in split.collect()} == set(enumerate(want, 1))


def test_split_falls_back_to_random(spark):
    texts = spark.sql("SELECT id, CASE WHEN id = 7 THEN 'no time' ELSE concat('2024-01-0', id % 4 + 1) END AS cutoff_at FROM range(100)")
    split, how = PR.split_rows(texts, ["id"], "x")
    assert how == "random" and split.where("split = 'test'").count() == 10
    assert PR.split_rows(texts.where("id <> 7"), ["id"], "x")[1] == "chronological"
    assert PR.split_rows(texts.where("id % 4 < 2"), ["id"], "x")[1] == "random"


@pytest.mark.parametrize("kind", ["odd", "even", "tiny", "one value", "ends"])
def test_medians_are_exact(spark, kind):
    rng = random.Random(kind)
    values = {
        "odd": [rng.gauss(0, 1) for _ in range(501)],
        "even": [rng.gauss(0, 1e-3) for _ in range(500)],
        "tiny": [rng.random() * 10 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(301)],
        "one value": [0.0, -0.0] * 40,
        "ends": [1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, 3.0],
    }[kind]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2.0), ("c", None)], "field string, value double")
    got = {r.field: r["median"] for r in PR.medians(df).collect()}
    assert got == {"a": pytest.approx(statistics.median(values), abs=0, rel=1e-15), "b": 2.0}


def test_overlap_is_null_for_empty_sets(spark):
    df = spark.sql("SELECT array('A', 'b ') AS p, array('a') AS x UNION ALL SELECT array(' '), array('a')")
    assert [tuple(r) for r in df.select(S.overlap_count(F.col("p"), F.col("x")), S.overlap_ratio(F.col("p"), F.col("x"))).collect()] == [(1.0, 0.5), (None, None)]


def test_windows_are_half_open(spark):
    w = E.time_windows(spark, datetime(2024, 1, 10), datetime(2024, 1, 17))
    log = spark.sql("SELECT 1L AS actor_id, 2L AS target_id, 'profile_view' AS event_type, t AS ts FROM VALUES (TIMESTAMP_NTZ'2024-01-10'), (TIMESTAMP_NTZ'2024-01-17'), (TIMESTAMP_NTZ'2024-01-09 23:59:59') v(t)")
    e = E.windowed(log, w)
    assert e.where("ts >= cutoff_at").count() == 1 and e.where("ts < cutoff_at").count() == 1
    with pytest.raises(ValueError):
        E.snapshot_windows(spark, datetime(2024, 1, 10), 3, outcome_days=8)


@pytest.mark.parametrize("n", [5, 40, 300])
def test_mix_sizes(spark, n):
    ranked = spark.range(n).select(F.lit(1).cast("long").alias("viewer_id"), F.col("id").alias("candidate_id"), F.lit(0.5).alias("score"), (F.col("id") + 1).cast("int").alias("rank"))
    rows = R.select_mix(ranked, 7, 2, 1, F.lit("s")).collect()
    assert len(rows) == min(n, 10) and len({r.candidate_id for r in rows}) == len(rows) and sorted(r.final_rank for r in rows) == list(range(1, len(rows) + 1))
    if n >= 40:
        assert sum(r.selection_type == "exploration" for r in rows) == 1


def test_impressions_reject(spark):
    item = "named_struct('candidate_id', {c}L, 'rank', {r}, 'score', {s}, 'predictions', map('p', 0.5D))"
    good, nan, again = item.format(c=2, r=1, s="0.5D"), item.format(c=3, r=2, s="double('NaN')"), item.format(c=4, r=1, s="0.5D")
    df = spark.sql(f"SELECT 'a' AS request_id, 1L AS viewer_id, ' Home ' AS surface, '' AS context_key, array({good}, {nan}) AS items UNION ALL SELECT 'b', 1L, 'home', NULL, array({good}, {again})")
    got = {(r.request_id, r.candidate_id): r.reject_reason for r in validated(df).collect()}
    assert got == {("a", 2): None, ("a", 3): "score", ("b", 2): "repeated_rank", ("b", 4): "repeated_rank"}


def test_hot_targets_keep_all_pairs(spark):
    n = 1100
    edges = spark.range(1, n + 1).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.col("id").cast("double").alias("w"), F.lit(0.5).alias("d"))
    pairs = edges.select("src").crossJoin(edges.select(F.col("src").alias("dst")))
    x = 1 / math.log(1 + n)
    got = shared_of(pairs, edges).agg(F.count("*"), F.countDistinct("src"), F.min("shared"), F.max("shared")).first()
    assert tuple(got) == (n * (n - 1), n, pytest.approx(x / (1 + x)), pytest.approx(x / (1 + x)))
    got = similarity_of(pairs, edges).agg(F.count("*"), F.min("similarity")).first()
    assert tuple(got) == (n * (n - 1), pytest.approx(1.0))


def test_a_hot_target_is_read_to_the_depth_of_the_bound(spark, monkeypatch):
    n, read = 3000, []
    edges = spark.range(1, n + 1).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(2.0).alias("w"))
    monkeypatch.setattr(peers, "cut", lambda df: read.append(keep := cut(df)) or keep)
    got = top_peers(edges, 50).groupBy("src").agg(F.count("*").alias("n"), F.max("dst").alias("last"), F.min("similarity").alias("s")).collect()
    assert len(got) == n and {(r.n, r.last, r.s) for r in got if r.src > 51} == {(50, 50, 1.0)}
    assert max(df.count() for df in read) <= 400 * n  # not n * n


@pytest.mark.parametrize("first", [2, 16])
def test_peers_equal_all_pairs(spark, monkeypatch, first):
    monkeypatch.setattr(peers, "FIRST_RANKS", first)
    rng = random.Random(first)
    edges = {(u, 0): float(rng.randint(1, 3)) for u in range(1, 300)}  # many have the hot target alone
    edges |= {(u, rng.randrange(60)): round(rng.expovariate(1), 1) + 0.1 for u in range(150, 400) for _ in range(rng.randint(1, 12))}
    edges |= {(999, 1000 + t): 1.0 for t in range(200)} | {(998, 1000 + t): 2.0 for t in range(0, 200, 3)}
    got = {}
    for r in top_peers(spark.createDataFrame([(u, t, w) for (u, t), w in edges.items()], "src long, dst long, w double"), 7).collect():
        got.setdefault(r.src, set()).add(r.dst)
    norm = {}
    for (u, _), w in edges.items():
        norm[u] = norm.get(u, 0) + w * w
    vectors = {}
    for (u, t), w in edges.items():
        vectors.setdefault(u, {})[t] = round(w / math.sqrt(norm[u]) * 1e6)
    for u, x in vectors.items():
        near = sorted((-sum(a * y.get(t, 0) for t, a in x.items()), v) for v, y in vectors.items() if v != u)
        assert {v for d, v in near[:7] if d < 0} == got.get(u, set())


def test_no_edges_no_peers(spark):
    assert top_peers(spark.createDataFrame([], "src long, dst long, w double")).count() == 0


def test_two_hop_keeps_its_own_limit_and_edges_do_not(spark):
    signals = spark.sql("SELECT 1L AS actor_id, id AS target_id, CAST(1000 - id AS DOUBLE) AS raw, 'long' AS horizon FROM range(2, 302) UNION ALL SELECT id, 999L, 1.0D, 'long' FROM range(2, 302)")
    edges = G.build_edges(signals)
    assert edges.where("src = 1").count() == 300
    assert G.two_hop(edges).where("src = 1 AND dst = 999").first().paths == 100


def test_a_repeated_pair_is_an_error(spark):
    rows = spark.sql("SELECT id AS viewer_id, id + 1 AS candidate_id FROM range(3)")
    one = spark.sql("SELECT 0L AS src, 1L AS dst, 0.5D AS direct UNION ALL SELECT 7L, 8L, 0.5D")
    assert {(r.viewer_id, r.direct) for r in G.merged(rows, one).collect()} == {(0, 0.5), (1, None), (2, None)}
    with pytest.raises(Exception, match=r"the pair \(0, 1\) are there 2 times"):
        G.merged(rows, one.union(one)).collect()


def test_a_reached_user_is_no_candidate(spark, monkeypatch):
    signals = spark.sql("SELECT 1L AS actor_id, id AS target_id, CAST(1000 - id AS DOUBLE) AS raw, 'long' AS horizon FROM range(2, 110) UNION ALL SELECT 2L, 109L, 5.0D, 'long'")
    monkeypatch.setattr(Q, "_signal", lambda spark, sf_dir: signals)
    monkeypatch.setattr(Q, "_users", lambda spark, sf_dir: spark.sql("SELECT id, 'Top' AS position FROM range(1, 120)"))
    got = Q.graph_pair_features(spark, "").where("src = 1 AND dst = 109 OR src = 109 AND dst = 1").collect()
    assert len(got) == 2 and {(r.src, r.direct > 0, r.reverse > 0) for r in got} == {(1, True, False), (109, False, True)}
    assert Q.graph_candidates(spark, "").where("src = 1 AND dst = 109").count() == 0
