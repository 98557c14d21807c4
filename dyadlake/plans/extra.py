"""More registered queries: requests, encodings, contracts, splits, exclusions and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dyadlake.operators import evaluate as EV
from dyadlake.operators import events as E
from dyadlake.operators import graph as G
from dyadlake.operators import pairs as P
from dyadlake.operators import prepare as PR
from dyadlake.operators import propensity as ML
from dyadlake.operators import ranking as R
from dyadlake.plans import oracle as O
from dyadlake.plans import queries as Q
from dyadlake.plans.queries import register
from dyadlake.schema import TARGETS
from dyadlake.sources.inputs import Inputs
from dyadlake.sources.shared import cut

_ASKED = "asked AS (SELECT viewer_id, candidate_id, min(pos) AS position FROM (SELECT id AS viewer_id, unnest([id - 1, id, id + 5, id - 1, -3, id + 5, id + 2000]) AS candidate_id, unnest(range(0, 7)) AS pos FROM users) WHERE candidate_id > 0 AND candidate_id <> viewer_id GROUP BY 1, 2)"


def _asked(spark, sf_dir):
    wanted = F.array(*(F.col("id") + n for n in (-1, 0, 5, -1)), F.lit(-3).cast("long"), *(F.col("id") + n for n in (5, 2000)))
    return E.requested_pairs(Inputs(spark, sf_dir).users.select(F.col("id").alias("viewer_id"), wanted.alias("candidate_ids")))


@register(O.sql(O.USERS, _ASKED, body="SELECT * FROM asked"))
def requested_pairs(spark, sf_dir):
    """Pairs of one request for each user, with repeats, itself and ids that no one has."""
    return _asked(spark, sf_dir)


@register(O.sql(O.USERS, _ASKED, body="SELECT * FROM asked WHERE candidate_id NOT IN (SELECT id FROM people) OR viewer_id NOT IN (SELECT id FROM people)"))
def missing_candidates(spark, sf_dir):
    """Requested candidates without a row of features; position keeps the order of the request."""
    asked, people = _asked(spark, sf_dir), P.eligible(Inputs(spark, sf_dir).users).select("id")
    rows = asked.join(people.withColumnRenamed("id", "viewer_id"), "viewer_id", "left_semi").join(people.withColumnRenamed("id", "candidate_id"), "candidate_id", "left_semi")
    return E.missing_candidates(asked, rows.select("viewer_id", "candidate_id"))


#: The vocabulary of the users of the first months; later tokens are unknown to it.
_OLD = "created_at < TIMESTAMP '2022-01-20'"
_OLD_VOC = ["old AS (SELECT * FROM users WHERE " + _OLD + ")", "tk AS (" + Q._VOC.replace("FROM users", "FROM old") + ")", "fs AS (SELECT field, token, min(id * 1000 + place) AS f FROM tk WHERE token IS NOT NULL AND token <> '' GROUP BY 1, 2)", "voc AS (SELECT field, token, CAST(1 + row_number() OVER (PARTITION BY field ORDER BY f, token) AS INT) AS vid FROM fs)"]
_BARE = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _old_vocabulary(users):
    return PR.build_vocab(users.where(F.col("created_at") < F.lit("2022-01-20").cast("timestamp_ntz")), Q._VOC_SINGLE, Q._VOC_MULTI, [F.col("id")])


def _ids_sql(field: str) -> str:
    t = _BARE.format(field)
    return f"CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE coalesce((SELECT vid FROM voc WHERE voc.field = '{field}' AND token = {t}), 1) END AS id_{field}"


@register(O.sql(O.USERS, *_OLD_VOC, body=f"SELECT id, {', '.join(_ids_sql(f) for f in Q._VOC_SINGLE)} FROM users"))
def encoded_single(spark, sf_dir):
    """Ids of single values under an early vocabulary: 0 for blank, 1 for unknown."""
    users = Inputs(spark, sf_dir).users
    rows, voc = users.select("id", *Q._VOC_SINGLE), _old_vocabulary(users)
    for f in Q._VOC_SINGLE:
        rows = PR.encode_single(rows, f, voc)
    return rows.select("id", *(f"id_{f}" for f in Q._VOC_SINGLE))


_MULTI = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {_BARE.format('t')} AS token FROM (SELECT id, unnest({f}) AS t FROM users)" for f in Q._VOC_MULTI)


@register(O.sql(O.USERS, *_OLD_VOC, f"mt AS (SELECT m.id, m.field, list_sort(list(DISTINCT coalesce(vid, 1))) AS ids FROM ({_MULTI}) m LEFT JOIN voc ON voc.field = m.field AND voc.token = m.token WHERE m.token <> '' GROUP BY 1, 2)",
    body="SELECT users.id, " + ", ".join(f"coalesce(array_to_string((SELECT ids FROM mt WHERE mt.id = users.id AND field = '{f}'), ','), '') AS ids_{f}" for f in Q._VOC_MULTI) + " FROM users"))
def encoded_multi(spark, sf_dir):
    """Sorted distinct ids of arrays under an early vocabulary."""
    users = Inputs(spark, sf_dir).users
    rows = PR.prepare_rows(users, {"metadata": ["id"], "multi_categorical": Q._VOC_MULTI}, _old_vocabulary(users))
    return rows.select("metadata.id", *(F.array_join(F.transform(f"multi_categorical.{f}", lambda x: x.cast("string")), ",").alias(f"ids_{f}") for f in Q._VOC_MULTI))


@register(O.sql(O.USERS, *_OLD_VOC, "tn AS (" + Q._VOC + ")", "fn AS (SELECT field, token, min(id * 1000 + place) AS f FROM tn WHERE token IS NOT NULL AND token <> '' GROUP BY 1, 2)",
    body="SELECT field, token, vid AS id FROM voc UNION ALL SELECT fn.field, fn.token, CAST(coalesce(last, 1) + row_number() OVER (PARTITION BY fn.field ORDER BY f, fn.token) AS INT) FROM fn LEFT JOIN (SELECT field, max(vid) AS last FROM voc GROUP BY 1) m ON m.field = fn.field WHERE NOT EXISTS (SELECT 1 FROM voc WHERE voc.field = fn.field AND voc.token = fn.token)"))
def vocabulary_grown(spark, sf_dir):
    """The early vocabulary grown by all users: known ids don't move."""
    users = Inputs(spark, sf_dir).users
    return PR.build_vocab(users, Q._VOC_SINGLE, Q._VOC_MULTI, [F.col("id")], _old_vocabulary(users))


_STATS = ("fl AS (SELECT field, coalesce(median(value), 0.0) AS fill FROM nums GROUP BY 1)", "st AS (SELECT field, fill, avg(coalesce(value, fill)) AS mean, CASE WHEN stddev_pop(coalesce(value, fill)) < 1e-6 THEN 1.0 ELSE stddev_pop(coalesce(value, fill)) END AS std FROM nums JOIN fl USING (field) GROUP BY field, fill)")


def _scaled_sql(f: str) -> str:
    one = lambda c: f"(SELECT {c} FROM st WHERE field = '{f}')"
    return f"round((coalesce({f}, {one('fill')}) - {one('mean')}) / {one('std')}, 5) + 0.0 AS {f}, CAST({f} IS NULL AS DOUBLE) AS {f}_missing"


@register(O.sql(*O.P1, Q._LONG, *_STATS, body=f"SELECT {Q._KEYS}, {', '.join(_scaled_sql(f) for f in Q._NUM)} FROM pairs"))
def normalized_numeric(spark, sf_dir):
    """Filled and scaled numbers with flags of what was missing."""
    rows = Q._pairs(spark, sf_dir).select("cutoff_at", "viewer_id", "candidate_id", *Q._NUM)
    stats = {r.field: (r.fill, r.mean, r.std) for r in PR.impute_stats(rows, Q._NUM).collect()}  # a row for each field
    return Q._rounded(PR.normalize_numeric(rows, Q._NUM, stats), 5).select("cutoff_at", "viewer_id", "candidate_id", *((F.col(f) + 0.0).alias(f) for f in Q._NUM), *(f"{f}_missing" for f in Q._NUM))


_REQUIRED, _FINITE = ["viewer_age", "candidate_age", "viewer_min_age"], ["distance_km", "viewer_account_age_days"]


_UNIT = ["overall_affinity", "evidence_strength"]
_RULES = [("required", f, f"{f} IS NULL") for f in _REQUIRED] + [("finite", f, f"{f} IS NULL") for f in _FINITE]
_RULES += [("unit", f, f"{f} IS NULL OR NOT {f} BETWEEN 0 AND 1") for f in _UNIT] + [("flag", "hard_exclusion", "false")]


@register(O.sql(*dict.fromkeys([*O.P1, *Q._BOTH]), "dv AS (SELECT * FROM pairs LEFT JOIN (SELECT cutoff_at, viewer_id, candidate_id, overall_affinity, evidence_strength FROM dirs WHERE side = 'viewer' AND horizon = 'long') USING (cutoff_at, viewer_id, candidate_id))",
    body=" UNION ALL ".join(f"SELECT '{k}:{f}' AS rule, count(*) FILTER (WHERE {bad}) AS violations FROM dv" for k, f, bad in _RULES)))
def row_contract(spark, sf_dir):
    """Rules over pairs with the viewer's affinities and the flag of a hard exclusion."""
    on = ["cutoff_at", "viewer_id", "candidate_id"]
    sides = Q._both(spark, sf_dir).where("side = 'viewer' AND horizon = 'long'").select(*on, *_UNIT)
    rows = G.flagged(Q._pairs(spark, sf_dir).select(*on, *_REQUIRED, *_FINITE), Q.excluded_pairs(spark, sf_dir)).join(sides, on, "left")
    return PR.row_contract(rows, _REQUIRED, _FINITE, tuple(_UNIT), "hard_exclusion")


@register(O.sql(*O.P1, "hs AS (SELECT viewer_id, candidate_id, sha256('s1:' || viewer_id || ':' || candidate_id) AS h, count(*) OVER () AS n FROM pairs)", "nr AS (SELECT *, row_number() OVER (ORDER BY h) AS k, greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS v FROM hs)",
    body="SELECT viewer_id, candidate_id, CASE WHEN n < 3 THEN 'train' WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'validation' ELSE 'train' END AS split FROM nr"))
def random_split(spark, sf_dir):
    """A split in the order of a seeded hash."""
    rows = Q._pairs(spark, sf_dir).select("viewer_id", "candidate_id")
    return PR.random_split(rows, ["viewer_id", "candidate_id"], "s1")


@register(O.sql(*O.P1, "hs AS (SELECT viewer_id, candidate_id, sha256('s2:' || viewer_id || ':' || candidate_id) AS h, count(*) OVER () AS n FROM pairs)",
    "nr AS (SELECT *, row_number() OVER (ORDER BY h) AS k, greatest(1, CAST(round_even(n * 0.1, 0) AS BIGINT)) AS t, greatest(1, CAST(round_even(n * 0.2, 0) AS BIGINT)) AS v FROM hs)",
    body="SELECT viewer_id, candidate_id, 'random' AS how, CASE WHEN n < 3 THEN 'train' WHEN k <= t THEN 'test' WHEN k <= t + v THEN 'validation' ELSE 'train' END AS split FROM nr"))
def split_of_one_cutoff(spark, sf_dir):
    """One cutoff can't be split by time, so its rows are split at random."""
    rows, how = PR.split_rows(Q._pairs(spark, sf_dir).select("cutoff_at", "viewer_id", "candidate_id"), ["viewer_id", "candidate_id"], "s2")
    return rows.select("viewer_id", "candidate_id", "split", F.lit(how).alias("how"))


@register(O.sql(*O.P1, body="SELECT viewer_id, candidate_id FROM pairs WHERE EXISTS (SELECT 1 FROM valid x WHERE x.event_type IN ('block', 'report') AND x.ts < TIMESTAMP '2024-01-23' AND ((x.actor_id = viewer_id AND x.target_id = candidate_id) OR (x.actor_id = candidate_id AND x.target_id = viewer_id)))"))
def excluded_candidates(spark, sf_dir):
    """Pairs that a hard exclusion takes out of the ranking."""
    return R.excluded_candidates(Q._pairs(spark, sf_dir).select("viewer_id", "candidate_id"), Q.excluded_pairs(spark, sf_dir))


@register(O.sql(*O.P1, O.MARKS, Q._RANKED, "tw AS (SELECT viewer_id, candidate_id, score, rank FROM rkd UNION ALL SELECT viewer_id, candidate_id, round(score / 2, 9), rank + 3 FROM rkd UNION ALL SELECT viewer_id, candidate_id, round(score / 4, 9), rank FROM rkd WHERE candidate_id % 2 = 0)",
    body="SELECT viewer_id, candidate_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY viewer_id, candidate_id ORDER BY rank, score DESC) AS r FROM tw) WHERE r = 1"))
def deduped_ranks(spark, sf_dir):
    """One row for each candidate of lists that name it several times."""
    scored = R.formula_predictions(Q._pairs(spark, sf_dir)).select("viewer_id", "candidate_id", F.round(R.composite_score(), 9).alias("score"))
    one = R.rank_candidates(scored, None, Q.excluded_pairs(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))
    two = one.withColumns({"score": F.round(F.col("score") / 2, 9), "rank": F.col("rank") + 3})
    three = one.where("candidate_id % 2 = 0").withColumn("score", F.round(F.col("score") / 4, 9))
    return R.dedupe_ranked(one.unionByName(two).unionByName(three))


@register()
def prepared_rows(spark, sf_dir):
    """Pairs as nested sections under the vocabulary of all users."""
    users = Inputs(spark, sf_dir).users
    voc = PR.build_vocab(users.select("id", F.col("position").alias("viewer_position"), F.col("my_types").alias("viewer_my_types")), ["viewer_position"], ["viewer_my_types"], [F.col("id")])
    sections = {
        "metadata": ["cutoff_at", "viewer_id", "candidate_id"], "categorical": ["viewer_position"], "multi_categorical": ["viewer_my_types"], "numeric": Q._NUM,
        "targets": [f"outcome_{t}" for t in TARGETS], "target_counts": ["outcome_message_count", "outcome_favorite_count"],
    }
    return PR.prepare_rows(Q._pairs(spark, sf_dir), sections, voc)


@register()
def propensity_scores(spark, sf_dir):
    """Chances of all targets by logistic models fitted on the pairs: numbers with flags of what is missing, and the candidate's types as ids."""
    users = Inputs(spark, sf_dir).users
    voc = PR.build_vocab(users.select("id", F.col("my_types").alias("candidate_my_types")), [], ["candidate_my_types"], [F.col("id")])
    size = voc.agg(F.coalesce(F.max("id"), F.lit(1))).first()[0] + 1
    rows = Q._pairs(spark, sf_dir).select("viewer_id", "candidate_id", *Q._NUM, "candidate_my_types", *(f"outcome_{t}" for t in TARGETS))
    rows = cut(PR.encoded_arrays(rows, ["candidate_my_types"], voc))
    weights = {r.target: r.pos_weight for r in PR.class_weights(rows, TARGETS).collect()}  # a row for each target
    models = ML.fit_propensities(rows, Q._NUM, TARGETS, weights, {"ids_candidate_my_types": size})
    return ML.predict_propensities(rows, models).select("viewer_id", "candidate_id", *(f"p_{t}" for t in models.targets))


@register(O.sql(*O.P3, O.MARKS, "r AS (SELECT cutoff_at, count(*) AS n, row_number() OVER (ORDER BY cutoff_at DESC) AS k FROM pairs GROUP BY 1)", body="SELECT target, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS positives FROM um JOIN r USING (cutoff_at) WHERE k = 1 GROUP BY 1"))
def test_part_targets(spark, sf_dir):
    """Targets of the part that the chronological split keeps for testing."""
    rows = P.assemble(Q._tables(spark, sf_dir), E.snapshot_windows(spark, Q.END, 3))
    split = PR.chronological_split(rows.select("cutoff_at")).where("split = 'test'").select("cutoff_at")
    marked = EV.unpivoted(R.formula_predictions(rows.join(split, "cutoff_at", "left_semi")), TARGETS)
    return marked.groupBy("target").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("positives"))
