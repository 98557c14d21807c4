"""Lists and scores made within arrays: chances of digests of their own, and no shuffle of pool rows."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from dyadlake.operators import lists
from dyadlake.operators import ranking as R
from dyadlake.plans import queries as Q
from dyadlake.schema import TARGETS


def _chance(target, viewer, candidate):
    return int(hashlib.sha256(f"{target}:{viewer}:{candidate}".encode()).hexdigest()[:13], 16) / 2**52


def test_each_target_has_a_digest_of_its_own(spark):
    row = R.formula_predictions(spark.sql("SELECT 3L AS viewer_id, 14L AS candidate_id")).first()
    assert {t: row[f"p_{t}"] for t in TARGETS} == {t: _chance(t, 3, 14) for t in TARGETS}


def test_pools_are_scored_without_a_shuffle(spark):
    pools = spark.range(5, 8).select(F.col("id").alias("viewer_id"), F.expr("sequence(100L, 160L)").alias("ids"))
    lists = R.ranked_lists(pools)
    assert "Exchange" not in lists._jdf.queryExecution().executedPlan().toString()
    rows = R.formula_predictions(pools.select("viewer_id", F.explode("ids").alias("candidate_id")))
    rows = R.rank_candidates(rows.select("viewer_id", "candidate_id", F.round(R.composite_score(), 9).alias("score")))
    want = {(r.viewer_id, r.candidate_id): (r.score, r.rank) for r in rows.collect()}
    got = lists.select("viewer_id", F.explode("list").alias("x")).select("viewer_id", "x.*").collect()
    assert {(r.viewer_id, r.candidate_id): (r.score, r.rank) for r in got} == want
    top = R.ranked_lists(pools, 7).select("viewer_id", F.size("list").alias("n"), F.element_at("list", 7)["rank"].alias("last")).collect()
    assert {(r.n, r.last) for r in top} == {(7, 7)}


def test_mixes_of_pools_equal_those_of_rows(spark):
    pools = spark.createDataFrame([(v, list(range(v % 3, n, 3))) for v, n in ((1, 3), (2, 40), (3, 700), (4, 760), (5, 800), (6, 2400))], "viewer_id long, ids array<long>")
    rows = R.formula_predictions(pools.select("viewer_id", F.explode("ids").alias("candidate_id")))
    rows = R.rank_candidates(rows.select("viewer_id", "candidate_id", F.round(R.composite_score(), 9).alias("score")))
    for sizes in ((7, 2, 1), (12, 3, 0), (80, 15, 5)):
        want = R.select_mix(rows, *sizes, F.concat_ws(":", F.lit("p"), F.col("viewer_id").cast("string"), F.lit("2024-01-30"), F.lit("v1")))
        got = R.mixed_lists(pools, *sizes, "p", "2024-01-30", "v1")
        assert got.schema.names == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_who_cant_be_among_the_best_gets_fewer_digests():
    ids = np.arange(500, 1500)
    full, pruned = lists.Pool(9, ids), lists.Pool(9, ids)
    best, some = full.ranked(), pruned.ranked(60)
    assert all((a[:60] == b).all() for a, b in zip(best, some, strict=True))
    assert full.made.sum() == 10_000 and pruned.made.sum() < 6_500


def test_pools_are_scored_in_batches_not_by_expressions(spark):
    pools = spark.range(1, 4).select(F.col("id").alias("viewer_id"), F.expr("sequence(100L, 160L)").alias("ids"))
    plan = R.mixed_lists(pools, 7, 2, 1, "p", "d", "v")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sha2" not in plan and "Exchange" not in plan


def test_lists_behind_batches_and_decisions_are_scored_in_batches(spark):
    # live_batches and decided_items start from this list
    plan = Q._list(spark, "/root/testdata/sf0.001", "speed_dating", located=False)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sha2" not in plan
