"""Steps that keep large rows out of shuffles: their plans, and their results against plainer ones."""

import random

import pytest
from pyspark.sql import functions as F

from dyadlake.operators import affinity as AF
from dyadlake.operators import geo, tiles
from dyadlake.operators import graph as G
from dyadlake.operators import prepare as PR
from dyadlake.sources.inputs import Inputs
from dyadlake.sources.shared import shared_dir
from dyadlake.sources.stored import Merged


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _edges(spark, seed=1):
    rng = random.Random(seed)
    edges = {(u, rng.randrange(1, 25)): round(rng.expovariate(1), 1) + 0.1 for u in range(1, 80) for _ in range(5)}
    rows = [(u, v, w) for (u, v), w in edges.items() if u != v]
    return spark.createDataFrame(rows, "src long, dst long, w double").withColumn("d", 1 - F.exp(-F.col("w") / 5))


def _rows(df, *digits):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("cells", [0, tiles.CELLS])
def test_other_pairs_meet_the_common_ones_in_their_tile(spark, monkeypatch, cells):
    monkeypatch.setattr(tiles, "EDGES", 40)
    monkeypatch.setattr(tiles, "CELLS", cells)  # none: products are listed
    edges = _edges(spark)
    others = spark.createDataFrame([(a, b, float(a), None if b % 3 == 0 else float(b)) for a in range(1, 90, 2) for b in range(70, 130)], "src long, dst long, p double, q double")
    plain = tiles.common_pairs(edges).join(others, ["src", "dst"], "full").fillna(0).select("src", "dst", "x", "dot", "p", "q")
    assert _rows(tiles.common_pairs(edges, others=others)) == _rows(plain)


def test_features_of_given_pairs_equal_those_of_all(spark):
    edges = _edges(spark)
    wanted = spark.createDataFrame([(a, b) for a in range(1, 80, 3) for b in (2, 7, 60, a + 1, 500)], "src long, dst long")
    some, whole = G.pair_features(edges, None, wanted), G.pair_features(edges)
    assert some.count() > 60
    assert _rows(some) == _rows(whole.join(wanted.distinct(), ["src", "dst"], "left_semi"))


def test_two_hop_paths_are_summed_where_they_are_made(spark):
    edges = _edges(spark)
    plan = _plan(G.two_hop(edges))
    assert plan.count("Exchange hashpartitioning") == 1  # of the edges by user, not of paths by pair
    a, b = edges.select("src", F.col("dst").alias("m")), edges.select(F.col("src").alias("m"), "dst")
    paths = a.join(b, "m").where("src <> dst").groupBy("src", "dst").count()
    assert _rows(G.two_hop(edges).select("src", "dst", "paths")) == _rows(paths)


def test_distances_are_made_for_places(spark):
    others = spark.range(1, 700).select("id", (F.col("id") % 3 * 0.5).alias("lat"), F.lit(10.0).alias("lon"))
    viewers = others.where("id % 4 = 0").withColumn("metres", F.lit(60_000.0))
    got = geo.within_radius(viewers, others, 50, digits=3)
    plan = _plan(got)
    assert plan.rindex("Generate explode(others") < plan.index("ASIN")  # the distance is made below, before ids follow
    want = {(v, c) for v in range(4, 700, 4) for c in range(1, 700) if v != c and abs(v % 3 - c % 3) < 2}
    rows = got.collect()
    assert len(rows) == len(want) and {(r.viewer_id, r.candidate_id) for r in rows} == want
    assert all(r.distance_km == round(r.distance_km, 3) for r in rows)


def test_traits_are_made_once_and_summed_without_a_shuffle(spark):
    users = Inputs(spark, "/root/testdata/sf0.001").users
    signals = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-23' AS cutoff_at, 1 + id % 40 AS actor_id, 1 + id % 9 AS target_id, 'long' AS horizon, 1.0D AS raw, 0.6D AS score, 1.0D AS evidence FROM range(400)")
    plan = _plan(AF.affinity_state(AF.observations(signals, users)))
    above = plan[: plan.index("Generate")]
    assert "Exchange" not in above and "regexp" not in above.lower() and "regexp" not in plan[plan.index("Generate") :].split("Scan")[0].lower()


def test_merged_rows_are_made_once(spark):
    store = Merged(spark, f"{shared_dir(spark)}/once-{random.random()}", AF.STORED)
    user = (F.rand() * 1e15).cast("long").alias("user_id")  # other users if rows are made again
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(50).select(F.lit("v").alias("model_version"), user, F.lit("k").alias("affinity_kind"), F.lit("x").alias("affinity_key"), F.lit(0.5).alias("score"), F.lit(1).cast("long").alias("evidence_count"), at.alias("window_start_at"), at.alias("window_end_at"))
    store.merge("b1", rows)
    assert store.current().count() == 50


def test_prepared_rows_write_only_named_columns(spark, monkeypatch):
    written = []
    monkeypatch.setattr(PR, "cut", lambda df, keep=PR.cut: written.append(df.columns) or keep(df))
    rows = spark.sql("SELECT 1L AS id, array('a', 'b') AS tags, 2.0D AS size, 'junk' AS junk")
    voc = spark.sql("SELECT 'tags' AS field, 'a' AS token, 2 AS id")
    out = PR.prepare_rows(rows, {"metadata": ["id"], "multi_categorical": ["tags"], "numeric": ["size"]}, voc)
    assert out.select("multi_categorical.tags").first()[0] == [1, 2]
    assert written and all("junk" not in c for c in written)
