"""Pair features of the behaviour graph: edges are summed signal weights before a cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadlake.functions import scalar as S
from dyadlake.operators import events as E
from dyadlake.operators.order import running_sums
from dyadlake.operators.peers import cosine, shared_of, similarity_of
from dyadlake.operators.retrieval import RETRIEVAL, Candidates, Collaborative, Features, Profile
from dyadlake.operators.tiles import Blocks, common_pairs, vectors
from dyadlake.sources.shared import cut, few, parts

MOST_EDGES, MOST_PEERS = 100, 50
EDGES = 32_768  # that a task of two-hop paths starts from


def build_edges(signals: DataFrame) -> DataFrame:
    """(src, dst, w, d): all edges; d = 1 - exp(-w / 5)."""
    top = signals.where("horizon = 'long'")
    return top.select(F.col("actor_id").alias("src"), F.col("target_id").alias("dst"), F.col("raw").alias("w"), (1 - F.exp(-F.col("raw") / 5)).alias("d"))


def _tasks(edges: DataFrame) -> int:
    """Tasks of EDGES edges, so that what one makes of its edges stays within bounds."""
    return max(parts(edges.sparkSession), -(-edges.count() // EDGES))


def heaviest(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """The heaviest edges of each user, ties by target: what two-hop paths go along, by their definition."""
    return E.first_by(edges, ["src"], [F.desc("w"), "dst"], most)


def two_hop(edges: DataFrame) -> DataFrame:
    """(src, dst, two_hop, paths) over one user in between, along the heaviest edges of each.

    Second steps start from users that someone points to. Where these are few, they go to the first steps, which lie
    by user already, so paths are summed where they are made; else both meet by the user in between.
    """
    edges = cut(edges)
    between = few(edges.select(F.col("dst").alias("src")).distinct())
    b = few(heaviest(edges.join(between, "src", "left_semi")).select(F.col("src").alias("m"), "dst", F.col("d").alias("d2")))
    a = edges.repartition(_tasks(edges), "src")
    a = heaviest(a).select("src", F.col("dst").alias("m"), F.col("d").alias("d1"))
    x = F.sum(F.col("d1") * F.col("d2"))
    return a.join(b, "m").where("src <> dst AND m <> src AND m <> dst").groupBy("src", "dst").agg((x / (1 + x)).alias("two_hop"), F.count("*").alias("paths"))


def collaborative(edges: DataFrame, peers: DataFrame) -> DataFrame:
    """(src, dst, collaborative, support) from each user's most similar peers (src, dst, similarity): summed where the user's block meets those of its peers."""
    past = Blocks(edges.select(F.col("src").alias("user"), F.col("dst").alias("target"), F.col("d").alias("x"), F.lit(1.0).alias("w")))
    mine = peers.select(F.col("src").alias("user"), F.col("dst").alias("key"), F.col("similarity").alias("value"))
    return past.met(Collaborative, "src long, dst long, collaborative double, support long", more=mine)


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes and edges."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("n"))
    return ends.agg(F.count_distinct("n").alias("nodes"), (F.count("*") / 2).cast("long").alias("edges"))


def community(whole: DataFrame, users: DataFrame) -> DataFrame:
    """(src, position, community): the share of a user's out-weight that goes to users of a position."""
    w = F.round(F.col("w") * 100).cast("long")
    of = users.select(F.col("id").alias("dst"), S.token(F.col("position")).alias("position")).where("position IS NOT NULL")
    total = whole.groupBy("src").agg(F.sum(w).alias("total"))
    return whole.join(of, "dst").groupBy("src", "position").agg(F.sum(w).alias("own")).join(total, "src").select("src", "position", (F.col("own") / F.col("total")).alias("community"))


def novelty(whole: DataFrame) -> DataFrame:
    """(dst, novelty): one minus the percent rank of in-weights, ranked over their distinct values (whole hundredths)."""
    weight = whole.groupBy("dst").agg(F.sum(F.round(F.col("w") * 100).cast("long")).alias("inw"))
    fold = running_sums(weight.groupBy("inw").agg(F.count("*").alias("n")), [], [F.col("inw")], ["n"])
    fold = fold.select("inw", (F.col("n_upto") - F.col("n")).alias("below")).crossJoin(F.broadcast(weight.agg(F.count("*").alias("all"))))
    return weight.join(fold, "inw").select("dst", F.when(F.col("all") > 1, 1 - F.col("below") / (F.col("all") - 1)).otherwise(1.0).alias("novelty"))


def merged(rows: DataFrame, features: DataFrame) -> DataFrame:
    """rows (viewer_id, candidate_id) with the features of their pairs, one to one.

    A pair that features hold twice is an error, raised by the task that meets it; a pair without features has nulls.
    """
    pair = ["viewer_id", "candidate_id"]
    named = features.withColumnsRenamed({"src": "viewer_id", "dst": "candidate_id"})
    values = [c for c in named.columns if c not in pair]
    one = named.groupBy(*pair).agg(F.count("*").alias("_n"), F.first(F.struct(*values)).alias("_f"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.format_string("features of the pair (%s, %s) are there %s times", *pair, "_n"))).otherwise(F.col("_f"))
    return rows.join(one, pair, "left").withColumn("_f", once).select(*rows.columns, *(F.col(f"_f.{c}").alias(c) for c in values))


def merge_contract(rows: DataFrame, features: DataFrame) -> DataFrame:
    """One row: pairs, pairs whose features are there twice, pairs without; the last two have to be 0 for a one-to-one merge."""
    n = features.groupBy(F.col("src").alias("viewer_id"), F.col("dst").alias("candidate_id")).agg(F.count("*").alias("n"))
    both = rows.select("viewer_id", "candidate_id").distinct().join(n, ["viewer_id", "candidate_id"], "left")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"))


def closest(pairs: DataFrame, most: int = MOST_PEERS) -> DataFrame:
    """(src, dst, similarity): the most similar of common pairs (src, dst, dot) for each user, ties by id."""
    best = E.first_by(pairs.where("dot > 0"), ["src"], [F.desc("dot"), "dst"], most)
    return best.select("src", "dst", cosine(F.col("dot")).alias("similarity"))


def peers_of(edges: DataFrame, most: int = MOST_PEERS) -> DataFrame:
    """(src, dst, similarity): the most similar users of each user, ties by id; each task keeps the best of its users, none is shuffled."""
    return common_pairs(edges, most).select("src", "dst", cosine(F.col("dot")).alias("similarity"))


def _sparse(edges: DataFrame) -> list[DataFrame]:
    """What is known of few pairs: edges either way, two-hop paths and what close peers lead to."""
    direct = edges.select("src", "dst", F.col("d").alias("direct"))
    swapped = direct.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("direct").alias("reverse"))
    return [direct, swapped, two_hop(edges), collaborative(edges, cut(peers_of(edges)))]


def _rows_of(made: list[DataFrame], names: list[str]) -> DataFrame:
    """made, one below the other, with null in the names that a part doesn't have."""
    rows = None
    for p in made:
        p = p.select("src", "dst", *((F.col(n) if n in p.columns else F.lit(None)).cast("double").alias(n) for n in names))
        rows = p if rows is None else rows.unionByName(p)
    return rows


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("dst")).distinct().join(novelty(edges), "dst", "left").withColumn("novelty", F.coalesce("novelty", F.lit(1.0)))


def _every_pair(edges: DataFrame, users: DataFrame | None, work, schema: str) -> DataFrame:
    """What work makes of all pairs with an edge either way, a common target, a two-hop path or one that a close peer leads to, where their blocks meet."""
    edges = cut(edges)
    nodes, of = _nodes(edges), None
    if users is None:
        nodes = nodes.withColumn("position", F.lit(None).cast("long"))
    else:  # positions by number
        named = users.select(F.col("id").alias("dst"), S.token(F.col("position")).alias("name")).where("name IS NOT NULL")
        number = cut(named.select("name").distinct().withColumn("position", F.monotonically_increasing_id()))
        nodes = nodes.join(named.join(number, "name").select("dst", "position"), "dst", "left")
        of = community(edges, users).join(number.withColumnRenamed("position", "key").withColumnRenamed("name", "position"), "position").select(F.col("src").alias("user"), "key", F.col("community").alias("value"))
    past = Blocks(vectors(edges), nodes.withColumnRenamed("dst", "user"))
    return past.met(work, schema, more=of, others=_rows_of(_sparse(edges), Features.given))


def pair_features(edges: DataFrame, users: DataFrame | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """Features and retrieval score of every pair with an edge either way, a common target, a two-hop path or one that a close peer leads to.

    Without users there is no position, and the community share is 0. With wanted (src, dst), of these pairs alone, whose
    common targets are then met from the end with fewer of them.
    """
    if wanted is None:
        return _every_pair(edges, users, Features, Features.schema)
    edges = cut(edges)
    wanted = few(wanted.select("src", "dst").distinct())
    made = [p.join(wanted, ["src", "dst"], "left_semi") for p in _sparse(edges)] + [shared_of(wanted, edges), similarity_of(wanted, edges)]
    # one shuffle on the pair instead of outer joins
    names = [*Features.given, "shared", "similarity"]
    wide = _rows_of(made, names).groupBy("src", "dst").agg(*(F.coalesce(F.max(n), F.lit(0.0)).alias(n) for n in names))
    # what belongs to a node, or to a node and a position, goes to the pairs if it is small
    nodes = _nodes(edges)
    if users is not None:
        nodes = nodes.join(users.select(F.col("id").alias("dst"), S.token(F.col("position")).alias("position")), "dst", "left")
    wide = wide.join(few(nodes), "dst", "left")
    if users is None:
        wide = wide.withColumn("community", F.lit(0.0))
    else:
        wide = wide.join(few(community(edges, users)), ["src", "position"], "left").drop("position").withColumn("community", F.coalesce("community", F.lit(0.0)))
    score = sum((x * F.col(c) for c, x in RETRIEVAL.items()), F.lit(0.0))
    wide = wide.select("src", "dst", "direct", "reverse", "two_hop", "paths", "shared", "similarity", "collaborative", "support", "novelty", "community")
    return wide.withColumn("paths", F.col("paths").cast("long")).withColumn("support", F.col("support").cast("long")).withColumn("retrieval", score)


def candidates(edges: DataFrame, users: DataFrame | None, limit: int) -> DataFrame:
    """(src, dst, retrieval, rank): the best pairs of each user that it hasn't reached itself, by the score to nine digits, ties by id.

    Each task keeps the best of its users while all pairs are scored, so no pair row is made.
    """
    return _every_pair(edges, users, lambda: Candidates(limit), Candidates.schema)


def profile(edges: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """prepare.feature_profile of the features of all pairs, summed where they are made."""
    sums = _every_pair(edges, users, Profile, Profile.schema)
    of = sums.groupBy("field").agg(F.sum("n").alias("present"), F.sum("non_zero").alias("non_zero"), F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean"), F.max("most").alias("most"))
    every = edges.sparkSession.createDataFrame([(c,) for c in Profile.fields], "field string")
    return every.join(of, "field", "left").fillna(0, ["present", "non_zero"])


def excluded_pairs(log: DataFrame, cutoff: F.Column) -> DataFrame:
    """Pairs with a block or report in either direction before the cutoff: never an input of a model."""
    bad = log.where(F.col("event_type").isin("block", "report") & (F.col("ts") < cutoff))
    return bad.select(F.explode(F.array(F.struct(F.col("actor_id").alias("viewer_id"), F.col("target_id").alias("candidate_id")), F.struct(F.col("target_id").alias("viewer_id"), F.col("actor_id").alias("candidate_id")))).alias("p")).select("p.*").distinct()


def flagged(rows: DataFrame, excluded: DataFrame) -> DataFrame:
    """rows with hard_exclusion: whether their pair is among excluded (viewer_id, candidate_id)."""
    mark = excluded.select("viewer_id", "candidate_id").distinct().withColumn("hard_exclusion", F.lit(True))
    return rows.join(mark, ["viewer_id", "candidate_id"], "left").withColumn("hard_exclusion", F.coalesce("hard_exclusion", F.lit(False)))
