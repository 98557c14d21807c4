"""Registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.functions import scalar as S
from dyadlake.operators import affinity as AF
from dyadlake.operators import evaluate as EV
from dyadlake.operators import events as E
from dyadlake.operators import graph as G
from dyadlake.operators import pairs as P
from dyadlake.operators import prepare as PR
from dyadlake.operators import products as PD
from dyadlake.operators import ranking as R
from dyadlake.operators import stats as A
from dyadlake.operators.pools import pools
from dyadlake.operators.tiles import shared_neighbours, similarity
from dyadlake.plans import oracle as O
from dyadlake.schema import AGE_BANDS, AGE_RANGES, HEIGHT_BANDS, HEIGHT_RANGES, TARGETS, WEIGHT_BANDS, WEIGHT_RANGES
from dyadlake.sources.datasets import dataset_manifest
from dyadlake.sources.inputs import Inputs
from dyadlake.sources.shared import cut, shared_dir
from dyadlake.sources.stored import Batches, Merged
from dyadlake.streaming.impressions import validated

CUTOFF, END = datetime(2024, 1, 23), datetime(2024, 1, 30)
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return Inputs(spark, sf_dir).tables


def _one(spark):
    return E.time_windows(spark, CUTOFF, END)


def _events(spark, sf_dir, windows=None):
    return E.windowed_log(_tables(spark, sf_dir), _one(spark) if windows is None else windows)


def _pairs(spark, sf_dir):
    return P.assemble(_tables(spark, sf_dir), _one(spark))


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _sixths(df: DataFrame) -> DataFrame:
    """_rounded to six digits for tables of very many finite values from 0 up: by a product, as the SQL does, not by decimals."""
    return df.select(*((F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_KEYS = "cutoff_at, viewer_id, candidate_id"


@register(O.sql(*O.P1, body=f"SELECT {_KEYS}, {', '.join(O.PAIR_COLUMNS)}, round(distance_km, 6) AS distance_km, round(viewer_account_age_days, 6) AS viewer_account_age_days FROM pairs"))
def pair_dataset(spark, sf_dir):
    """Labelled pairs at one cutoff: the flagship."""
    return _rounded(_pairs(spark, sf_dir).select("cutoff_at", "viewer_id", "candidate_id", *O.PAIR_COLUMNS, "distance_km", "viewer_account_age_days"))


@register(O.sql(*O.P3, body=f"SELECT {_KEYS}, {', '.join(O.PAIR_COLUMNS)} FROM pairs"))
def pair_dataset_snapshots(spark, sf_dir):
    """The same for three snapshots in one job."""
    return P.assemble(_tables(spark, sf_dir), E.snapshot_windows(spark, END, 3)).select("cutoff_at", "viewer_id", "candidate_id", *O.PAIR_COLUMNS)


@register(O.sql(O.LOG, body="SELECT actor_id, target_id, event_type, ts FROM log WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'"))
def event_log(spark, sf_dir):
    return E.unify_interactions(_tables(spark, sf_dir), datetime(2024, 1, 5), datetime(2024, 1, 25))


@register(O.sql(O.LOG, body="SELECT actor_id, target_id, event_type, ts FROM valid"))
def valid_event_log(spark, sf_dir):
    return E.valid_events(E.unify_interactions(_tables(spark, sf_dir)))


@register(O.sql(O.LOG, body="SELECT * FROM valid WHERE actor_id % 7 = 0 OR target_id % 11 = 0 OR (actor_id % 11 = 0 AND target_id % 7 = 0)"))
def restricted_events(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return E.restrict_events(E.valid_events(E.unify_interactions(t)), *(t["users"].where(f"id % {n} = 0").select("id") for n in (7, 11)))


@register(O.sql(*O.E3, body="SELECT * FROM keys"))
def exposed_pairs(spark, sf_dir):
    return E.exposed_pairs(_events(spark, sf_dir, E.snapshot_windows(spark, END, 3)))


@register(O.sql(*O.E1, body="SELECT * FROM hist"))
def pair_history(spark, sf_dir):
    return A.pair_history(_events(spark, sf_dir))


@register(O.sql(O.LOG, O.windows(("2024-01-23", "2024-01-30"), history=10), O.STATS, body="SELECT * FROM hist"))
def pair_history_short(spark, sf_dir):
    """History of ten days: the 90-day count stays within it."""
    return A.pair_history(_events(spark, sf_dir, E.time_windows(spark, CUTOFF, END, 10)))


@register(O.sql(*O.E1, body="SELECT * FROM outc"))
def pair_outcome(spark, sf_dir):
    return A.pair_outcome(_events(spark, sf_dir))


@register(O.sql(*O.E3, body=O.ACTOR))
def actor_history(spark, sf_dir):
    return A.actor_history(A.pair_history(_events(spark, sf_dir, E.snapshot_windows(spark, END, 3))))


@register(O.sql(*O.E3, body=O.RECEIVED))
def target_received(spark, sf_dir):
    return A.target_received(A.pair_history(_events(spark, sf_dir, E.snapshot_windows(spark, END, 3))))


@register(O.sql(O.LOG, O.THREE, body=O.ITEMS))
def item_stats(spark, sf_dir):
    return A.item_stats(Inputs(spark, sf_dir).user_images, E.snapshot_windows(spark, END, 3))


@register(O.sql(*O.E3, body="SELECT cutoff_at, actor_id, target_id, event_type, count(*) AS n, count(*) FILTER (WHERE ts >= d30) AS n_recent FROM wev WHERE ts < cutoff_at AND ts >= d90 GROUP BY 1, 2, 3, 4"))
def event_type_counts(spark, sf_dir):
    return A.event_type_counts(_events(spark, sf_dir, E.snapshot_windows(spark, END, 3)))


@register(O.sql(*O.E1, body="SELECT cutoff_at, actor_id, target_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS total_{t}_count, count(*) FILTER (WHERE event_type = '{t}' AND ts >= d30) AS recent_{t}_count" for t in O.EVENT_TYPES) + " FROM wev WHERE ts < cutoff_at AND ts >= d90 GROUP BY 1, 2, 3"))
def recent_pair_counts(spark, sf_dir):
    return A.recent_pair_counts(_events(spark, sf_dir))


_HARD = """hx AS (SELECT DISTINCT viewer_id, candidate_id, true AS x FROM (
  SELECT actor_id AS viewer_id, target_id AS candidate_id FROM valid WHERE event_type IN ('block', 'report') AND ts < TIMESTAMP '2024-01-23'
  UNION ALL SELECT target_id, actor_id FROM valid WHERE event_type IN ('block', 'report') AND ts < TIMESTAMP '2024-01-23'))"""


@register(O.sql(*O.P1, _HARD, body=f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE {O.HISTORY_SUM} > 0) AS pairs_with_history, count(*) FILTER (WHERE hx.x) AS hard_excluded, " + ", ".join(f"CAST(coalesce(sum(outcome_{t}_count), 0) AS BIGINT) AS total_{t}" for t in O.EVENT_TYPES) + ", count(*) FILTER (WHERE outcome_reciprocal_message) AS reciprocal_pairs, count(*) FILTER (WHERE outcome_any_positive) AS positive_pairs FROM pairs LEFT JOIN hx USING (viewer_id, candidate_id)"))
def dataset_totals(spark, sf_dir):
    return A.dataset_totals(G.flagged(_pairs(spark, sf_dir), excluded_pairs(spark, sf_dir)))


@register(O.sql(*O.P3, body="SELECT cutoff_at, count(*) AS n_rows, count(DISTINCT viewer_id) AS viewers, count(DISTINCT candidate_id) AS candidates, count(*) FILTER (WHERE outcome_any_positive) AS positive_pairs FROM pairs GROUP BY 1"))
def snapshot_summary(spark, sf_dir):
    return A.snapshot_summary(P.assemble(_tables(spark, sf_dir), E.snapshot_windows(spark, END, 3)))


@register(O.sql(*O.P3, body="SELECT count(*) AS n_rows, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT strftime(cutoff_at, '%Y-%m-%d %H:%M:%S') AS s FROM pairs)) AS cutoffs, count(DISTINCT viewer_id) AS viewers, count(DISTINCT candidate_id) AS candidates FROM pairs"))
def manifest(spark, sf_dir):
    return dataset_manifest(P.assemble(_tables(spark, sf_dir), E.snapshot_windows(spark, END, 3)))


@register(O.sql(*O.P3, body=f"SELECT {_KEYS} FROM pairs ORDER BY cutoff_at DESC, viewer_id, candidate_id LIMIT 200"))
def newest_pairs(spark, sf_dir):
    """A report of the 200 newest rows: the limit is the feature."""
    return E.newest_rows(P.assemble(_tables(spark, sf_dir), E.snapshot_windows(spark, END, 3)).select("cutoff_at", "viewer_id", "candidate_id"), 200)


_ASOF = "TIMESTAMP '2024-01-23'"
_UAGE = O.AGE.format(a=_ASOF, b="born")
_SEARCH_IN = "CASE c % 5 WHEN 0 THEN (5 + c % 2) * 12 + c % 12 WHEN 1 THEN 60 + c % 30 WHEN 3 THEN CASE WHEN c % 14 <= 11 THEN 60 + c % 14 END END"


@register(O.sql(O.USERS, body=f"SELECT id, {_UAGE} AS age, {O.band(_UAGE, AGE_BANDS)} AS age_band, {O.span(_UAGE, AGE_RANGES)} AS age_range, inches, {O.band('inches', HEIGHT_BANDS)} AS height_band, {O.span('inches', HEIGHT_RANGES)} AS height_range, {O.band('weight', WEIGHT_BANDS)} AS weight_band, {O.span('weight', WEIGHT_RANGES)} AS weight_range, {O.tok('position')} AS position_token, array_to_string({O.toks('my_types')}, '|') AS type_tokens, CASE WHEN lower(into_proximity) = 'same city' THEN 'city' WHEN lower(into_proximity) = 'same neighborhood' OR lower(into_proximity) LIKE 'within%' THEN 'radius' ELSE 'any' END AS proximity, round(CASE into_proximity WHEN 'Same neighborhood' THEN 5 WHEN 'Within 25 miles' THEN 25 WHEN 'within 300 mile' THEN 300 END * 1609.344, 3) AS metres FROM users"))
def user_traits(spark, sf_dir):
    """All profile functions over the table of users."""
    c, age = F.col, S.age_years(F.lit("2024-01-23").cast("timestamp_ntz"), F.col("date_of_birth"))
    inches = S.height_inches(c("height"))
    return Inputs(spark, sf_dir).users.select("id", age.alias("age"), S.band(age, AGE_BANDS).alias("age_band"), S.in_range(age, AGE_RANGES).alias("age_range"), inches.alias("inches"), S.band(inches, HEIGHT_BANDS).alias("height_band"), S.in_range(S.height_inches_search(c("height")), HEIGHT_RANGES).alias("height_range"), S.band(c("weight"), WEIGHT_BANDS).alias("weight_band"), S.in_range(c("weight"), WEIGHT_RANGES).alias("weight_range"), S.token(c("position")).alias("position_token"), F.array_join(S.tokens(c("my_types")), "|").alias("type_tokens"), S.proximity_mode(c("into_proximity")).alias("proximity"), F.round(S.proximity_metres(c("into_proximity")), 3).alias("metres"))


def _compat_sql() -> str:
    ov = lambda w, h: f"CASE WHEN len({O.toks(w)}) > 0 AND len({O.toks(h)}) > 0 THEN CAST(len(list_intersect({O.toks(w)}, {O.toks(h)})) AS DOUBLE) END"
    out = {}
    for me, you, m, y in (("viewer", "candidate", "v", "c"), ("candidate", "viewer", "c", "v")):
        out[f"{me}_accepts_{you}_age"] = f"CASE WHEN {you}_age IS NOT NULL AND {me}_min_age IS NOT NULL AND {me}_max_age IS NOT NULL THEN CAST({you}_age BETWEEN {me}_min_age AND {me}_max_age AS DOUBLE) END"
        out[f"{me}_accepts_{you}_distance"] = f"CAST(distance_km <= {me}_max_distance_km AS DOUBLE)"
        for f in ("position", "relationship_status"):
            out[f"{me}_{f}_match"] = f"CAST({O.tok(f'{m}.into_{f}')} = {O.tok(f'{y}.{f}')} AS DOUBLE)"
        out[f"{me}_body_type_match"] = f"{ov(f'{m}.into_body_types', f'[{y}.body_type]')} / len({O.toks(f'{m}.into_body_types')})"
        for stem, want, have in (("body_hair", "into_body_hair", "body_hair"), ("type", "into_types", "my_types"), ("fetish", "into_fetishes", "my_fetishes")):
            out[f"{me}_{stem}_match_count"] = ov(f"{m}.{want}", f"{y}.{have}")
            out[f"{me}_{stem}_match_ratio"] = f"{ov(f'{m}.{want}', f'{y}.{have}')} / len({O.toks(f'{m}.{want}')})"
    inner = "SELECT cutoff_at, viewer_id, candidate_id, " + ", ".join(f"{e} AS {k}" for k, e in out.items()) + " FROM pairs"
    mean = lambda ks: f"list_avg(list_filter([{', '.join(ks)}], lambda x: x IS NOT NULL))"
    body = f"SELECT {_KEYS}, {', '.join(f'round({k}, 6) AS {k}' for k in out)}, CASE WHEN viewer_position_match IS NOT NULL AND candidate_position_match IS NOT NULL THEN CAST(viewer_position_match + candidate_position_match = 2 AS DOUBLE) END AS mutual_position_match, round({mean(['viewer_type_match_ratio', 'candidate_type_match_ratio'])}, 6) AS mutual_type_match, round({mean([k for k in out if not k.endswith('_count')])}, 6) AS mutual_preference_score FROM m"
    return O.sql(*O.P1, f"m AS ({inner})", body=body)


@register(_compat_sql())
def compatibility(spark, sf_dir):
    """The 25 compatibility values of every pair."""
    return _rounded(_pairs(spark, sf_dir).select("cutoff_at", "viewer_id", "candidate_id", *S.compatibility()))


def _signal(spark, sf_dir, windows=None):
    return AF.preference_signal(A.event_type_counts(_events(spark, sf_dir, windows)))


def _seen(spark, sf_dir, windows=None):
    return AF.observations(_signal(spark, sf_dir, windows), Inputs(spark, sf_dir).users)


@register(O.sql(O.LOG, O.ONE, O.SIGNAL, body="SELECT cutoff_at, actor_id, target_id, horizon, round(raw, 6) AS raw, round(score, 6) AS score, round(evidence, 6) AS evidence FROM signal"))
def preference_signal(spark, sf_dir):
    return _rounded(_signal(spark, sf_dir))


@register(O.sql(*O.A1, body="SELECT cutoff_at, user_id, horizon, kind, key, round(score, 6) AS score, evidence_count, round(evidence_weight, 6) AS evidence_weight FROM state"))
def affinity_state(spark, sf_dir):
    return _rounded(AF.affinity_state(_seen(spark, sf_dir)))


@register(O.sql(O.LOG, O.USERS, O.THREE, O.SIGNAL, O.STATE.replace(O.SEEN, O.SEEN.replace("JOIN people v", "JOIN users v").replace("JOIN people c ON c.id = target_id", "JOIN users c ON c.id = target_id AND NOT c.is_bot")), body="SELECT cutoff_at, user_id, horizon, kind, key, round(score, 6) AS score, evidence_count, round(evidence_weight, 6) AS evidence_weight FROM state"))
def affinity_point_in_time(spark, sf_dir):
    """The state of three cutoffs, each from events before it alone."""
    return _rounded(AF.affinity_state(AF.observations(_signal(spark, sf_dir, E.snapshot_windows(spark, END, 3)), _users(spark, sf_dir), point_in_time=True)))


@register(O.sql(*O.A1, body="SELECT cutoff_at, user_id, horizon, observation_count, round(evidence_weight, 6) AS evidence_weight, round(strength, 6) AS strength FROM strength"))
def affinity_strength(spark, sf_dir):
    return _rounded(AF.affinity_strength(_seen(spark, sf_dir)))


_MET = "met AS (SELECT DISTINCT cutoff_at, actor_id AS user_id, h.horizon FROM wev JOIN people v ON v.id = actor_id JOIN people c ON c.id = target_id CROSS JOIN (VALUES ('long'), ('recent')) h(horizon) WHERE ts < cutoff_at AND ts >= d90)"
_ALL = "alls AS (SELECT met.*, coalesce(strength, 0.0) AS strength, coalesce(observation_count, 0) AS observation_count FROM met LEFT JOIN strength USING (cutoff_at, user_id, horizon))"
_EXPORT = "SELECT cutoff_at, user_id, CASE horizon WHEN 'recent' THEN 'recent_' ELSE '' END || kind AS affinity_kind, key AS affinity_key, round(score, 6) AS score, evidence_count FROM state UNION ALL SELECT cutoff_at, user_id, CASE horizon WHEN 'recent' THEN '__recent_meta__' ELSE '__meta__' END, 'strength', round(strength, 6), observation_count FROM alls"


def _exported(spark, sf_dir, windows=None):
    counts, users = cut(A.event_type_counts(_events(spark, sf_dir, windows))), _users(spark, sf_dir)
    seen = AF.observations(AF.preference_signal(counts), users)
    return AF.exported(AF.affinity_state(seen), AF.all_strengths(counts, users, AF.affinity_strength(seen)))


@register(O.sql(*O.A1, _MET, _ALL, f"ex AS ({_EXPORT})", body="SELECT 'v7' AS model_version, user_id, affinity_kind, affinity_key, score, evidence_count, cutoff_at - to_days(CASE WHEN affinity_kind LIKE 'recent%' OR affinity_kind LIKE '__recent_meta%' THEN 30 ELSE 90 END) AS window_start_at, cutoff_at AS window_end_at FROM ex WHERE user_id % 5 <> 2"))
def stored_affinities(spark, sf_dir):
    """The job's rows merged into a stored table with their version and windows, after which every fifth user is deleted."""
    store = Merged(spark, f"{shared_dir(spark)}/affinities-{uuid.uuid4().hex}", AF.STORED)
    counts, users = A.event_type_counts(_events(spark, sf_dir)), _users(spark, sf_dir)
    rows = AF.affinity_job(counts, users, "v7")
    for batch in ("b1", "b1"):  # a replay changes nothing
        store.merge(batch, rows)
    gone = users.where("id % 5 = 2").select(F.lit("v7").alias("model_version"), F.col("id").alias("user_id"))
    store.merge("b2", spark.createDataFrame([], AF.STORED), gone)
    return _rounded(store.current())


@register(O.sql(*O.A1, _MET, _ALL, body=_EXPORT))
def affinity_export(spark, sf_dir):
    """The persisted form, with a meta row for every user with any event."""
    return _rounded(_exported(spark, sf_dir))


@register(O.sql(*O.A1, _MET, _ALL, body="SELECT cutoff_at, user_id, horizon, kind, key, round(score, 4) AS score, evidence_count, CAST(NULL AS DOUBLE) AS evidence_weight FROM state UNION ALL SELECT cutoff_at, user_id, horizon, '__meta__', 'strength', round(strength, 4), observation_count, round(-12 * ln(1 - least(strength, 1 - 1e-12)), 4) + 0.0 FROM alls"))
def affinity_import(spark, sf_dir):
    """The persisted form read back."""
    return _rounded(AF.imported(_exported(spark, sf_dir)), 4).withColumn("evidence_weight", F.col("evidence_weight") + 0.0)


@register(O.sql(O.LOG, O.USERS, O.THREE, O.SIGNAL, O.STATE, "two AS (SELECT user_id, horizon, kind, key, score, evidence_count, row_number() OVER (PARTITION BY user_id, horizon, kind, key ORDER BY cutoff_at DESC) AS r FROM state WHERE cutoff_at >= TIMESTAMP '2024-01-16')", body="SELECT user_id, horizon, kind, key, round(score, 6) AS score, evidence_count FROM two WHERE r = 1"))
def affinity_upsert(spark, sf_dir):
    """The state of one cutoff merged over that of the cutoff before."""
    state = cut(AF.affinity_state(_seen(spark, sf_dir, E.snapshot_windows(spark, END, 2))))
    old, new = (state.where(F.col("cutoff_at") == E.ntz(d)).drop("cutoff_at", "evidence_weight") for d in (datetime(2024, 1, 16), CUTOFF))
    return _rounded(AF.merged(old, new, ["user_id", "horizon", "kind", "key"]))


_DIRECTIONS = f"SELECT p.cutoff_at, viewer_id, candidate_id, {O.AGE.format(a='p.cutoff_at', b='c.born')} AS age, {O.km('v', 'c')} AS distance, c AS c FROM keys p JOIN users v ON v.id = viewer_id JOIN users c ON c.id = candidate_id"
_KINDS = ["age", "height", "weight", "distance", "position", "body_type", "relationship_status", "body_hair", "type", "fetish"]


@register(O.sql(*O.A1, O.STATS, f"pr AS ({_DIRECTIONS})", f"pt AS (SELECT x.*, h.horizon FROM ({O.traits('c', 'age', 'distance', 'cutoff_at, viewer_id, candidate_id', 'pr')}) x, (VALUES ('long'), ('recent')) h(horizon))",
    "ks AS (SELECT pt.cutoff_at, viewer_id, candidate_id, pt.horizon, pt.kind, coalesce(avg(score), 0.5) AS s FROM pt LEFT JOIN state ON state.cutoff_at = pt.cutoff_at AND state.user_id = viewer_id AND state.horizon = pt.horizon AND state.kind = pt.kind AND state.key = pt.key GROUP BY 1, 2, 3, 4, 5)",
    "wide AS (SELECT cutoff_at, viewer_id, candidate_id, horizon, " + ", ".join(f"max(s) FILTER (WHERE kind = '{k}') AS {k}" for k in _KINDS) + ", avg(s) AS overall FROM ks GROUP BY 1, 2, 3, 4)",
    body="SELECT pr.cutoff_at, pr.viewer_id, pr.candidate_id, h.horizon, " + ", ".join(f"round(coalesce(wide.{k}, 0.5), 6) AS {k}_affinity" for k in [*_KINDS, "overall"]) + ", round(coalesce(strength, 0.0), 6) AS evidence_strength FROM pr CROSS JOIN (VALUES ('long'), ('recent')) h(horizon) LEFT JOIN wide ON wide.cutoff_at = pr.cutoff_at AND wide.viewer_id = pr.viewer_id AND wide.candidate_id = pr.candidate_id AND wide.horizon = h.horizon LEFT JOIN strength ON strength.user_id = pr.viewer_id AND strength.cutoff_at = pr.cutoff_at AND strength.horizon = h.horizon"))
def directional_affinities(spark, sf_dir):
    seen = _seen(spark, sf_dir)
    return _rounded(AF.directional(E.exposed_pairs(_events(spark, sf_dir)), Inputs(spark, sf_dir).users, AF.affinity_state(seen), AF.affinity_strength(seen)))


_SIDES = f"SELECT p.cutoff_at, viewer_id, candidate_id, side, {O.AGE.format(a='p.cutoff_at', b='c.born')} AS age, {O.km('v', 'c')} AS distance, c AS c FROM sided p JOIN users v ON v.id = viewer_id JOIN users c ON c.id = candidate_id"
_FIELDS = [*(f"{k}_affinity" for k in [*_KINDS, "overall"]), "evidence_strength"]
_BOTH = (
    *O.A1, O.STATS, "sided AS (SELECT cutoff_at, viewer_id, candidate_id, 'viewer' AS side FROM keys UNION ALL SELECT cutoff_at, candidate_id, viewer_id, 'candidate' FROM keys)", f"pr AS ({_SIDES})",
    f"pt AS (SELECT x.*, h.horizon FROM ({O.traits('c', 'age', 'distance', 'cutoff_at, viewer_id, candidate_id, side', 'pr')}) x, (VALUES ('long'), ('recent')) h(horizon))",
    "ks AS (SELECT pt.cutoff_at, viewer_id, candidate_id, side, pt.horizon, pt.kind, coalesce(avg(score), 0.5) AS s FROM pt LEFT JOIN state ON state.cutoff_at = pt.cutoff_at AND state.user_id = viewer_id AND state.horizon = pt.horizon AND state.kind = pt.kind AND state.key = pt.key GROUP BY 1, 2, 3, 4, 5, 6)",
    "wide AS (SELECT cutoff_at, viewer_id, candidate_id, side, horizon, " + ", ".join(f"max(s) FILTER (WHERE kind = '{k}') AS {k}" for k in _KINDS) + ", avg(s) AS overall FROM ks GROUP BY 1, 2, 3, 4, 5)",
    "dirs AS (SELECT pr.cutoff_at, CASE pr.side WHEN 'viewer' THEN pr.viewer_id ELSE pr.candidate_id END AS viewer_id, CASE pr.side WHEN 'viewer' THEN pr.candidate_id ELSE pr.viewer_id END AS candidate_id, pr.side, h.horizon, " + ", ".join(f"coalesce(wide.{k}, 0.5) AS {k}_affinity" for k in [*_KINDS, "overall"]) + ", coalesce(strength, 0.0) AS evidence_strength FROM pr CROSS JOIN (VALUES ('long'), ('recent')) h(horizon) LEFT JOIN wide ON wide.cutoff_at = pr.cutoff_at AND wide.viewer_id = pr.viewer_id AND wide.candidate_id = pr.candidate_id AND wide.side = pr.side AND wide.horizon = h.horizon LEFT JOIN strength ON strength.user_id = pr.viewer_id AND strength.cutoff_at = pr.cutoff_at AND strength.horizon = h.horizon)",
)


def _both(spark, sf_dir, windows=None):
    seen = _seen(spark, sf_dir, windows)
    return AF.both_directions(E.exposed_pairs(_events(spark, sf_dir, windows)), _users(spark, sf_dir), AF.affinity_state(seen), AF.affinity_strength(seen))


@register(O.sql(*_BOTH, body=f"SELECT cutoff_at, viewer_id, candidate_id, side, horizon, {', '.join(f'round({f}, 6) AS {f}' for f in _FIELDS)} FROM dirs"))
def mutual_affinities(spark, sf_dir):
    """24 affinities in each direction of every exposed pair."""
    return _rounded(_both(spark, sf_dir))


@register(O.sql(*_BOTH, body=" UNION ALL ".join(f"SELECT CASE horizon WHEN 'recent' THEN 'recent_' ELSE '' END || '{f}' AS field, round(avg({f}) FILTER (WHERE side = 'viewer'), 6) AS viewer_mean, round(avg({f}) FILTER (WHERE side = 'candidate'), 6) AS candidate_mean FROM dirs GROUP BY horizon" for f in _FIELDS)))
def affinity_profile(spark, sf_dir):
    return _rounded(AF.profile(_both(spark, sf_dir)))


@register(O.sql(*_BOTH, body="SELECT cutoff_at, " + ", ".join(f"count(*) FILTER (WHERE side = '{s}' AND horizon = '{h}' AND evidence_strength > 0) AS {s}_rows_with_{n}evidence" for s in ("viewer", "candidate") for h, n in (("long", ""), ("recent", "recent_"))) + " FROM dirs GROUP BY 1"))
def affinity_evidence(spark, sf_dir):
    """Rows with evidence on each side: the manifest's and the summary's counts."""
    return A.evidence_counts(_both(spark, sf_dir), ["cutoff_at"])


_SIDES = [(s, h, n) for s in ("viewer", "candidate") for h, n in (("long", ""), ("recent", "recent_"))]


@register(O.sql(*dict.fromkeys([*O.P1, *_BOTH]), _HARD, body=f"""SELECT m.*, {', '.join(f"(SELECT count(*) FILTER (WHERE side = '{s}' AND horizon = '{h}' AND evidence_strength > 0) FROM dirs SEMI JOIN pairs USING (cutoff_at, viewer_id, candidate_id)) AS {s}_rows_with_{n}evidence" for s, h, n in _SIDES)}
  FROM (SELECT count(*) AS n_rows, string_agg(DISTINCT strftime(cutoff_at, '%Y-%m-%d %H:%M:%S'), ',') AS cutoffs, count(DISTINCT viewer_id) AS viewers, count(DISTINCT candidate_id) AS candidates,
    count(*) FILTER (WHERE hx.x) AS hard_excluded FROM pairs LEFT JOIN hx USING (viewer_id, candidate_id)) m"""))
def full_manifest(spark, sf_dir):
    """The manifest with hard exclusions and the rows with evidence on each side, as one row."""
    rows = cut(G.flagged(_pairs(spark, sf_dir).select("cutoff_at", "viewer_id", "candidate_id"), excluded_pairs(spark, sf_dir)))
    sides = _both(spark, sf_dir).join(rows.select("cutoff_at", "viewer_id", "candidate_id"), ["cutoff_at", "viewer_id", "candidate_id"], "left_semi")
    return dataset_manifest(rows, A.evidence_counts(sides, []))


@register(O.sql(O.LOG, O.USERS, O.THREE, O.SIGNAL, O.STATE, body="SELECT cutoff_at, count(*) FILTER (WHERE horizon = 'long' AND evidence_weight > 0) AS users_with_history, count(*) FILTER (WHERE horizon = 'recent' AND evidence_weight > 0) AS users_with_recent FROM strength GROUP BY 1"))
def affinity_users(spark, sf_dir):
    return A.affinity_users(AF.affinity_strength(_seen(spark, sf_dir, E.snapshot_windows(spark, END, 3))))


@register(O.sql(*_BOTH, body=" UNION ALL ".join(f"SELECT '{f}' AS field, count(*) FILTER (WHERE {f} IS NULL OR NOT {f} BETWEEN 0 AND 1) AS violations FROM dirs" for f in _FIELDS)))
def affinity_contract(spark, sf_dir):
    return AF.contract(_both(spark, sf_dir), _FIELDS)


_EDGES = "edges AS (SELECT actor_id AS src, target_id AS dst, raw AS w, 1 - exp(-raw / 5) AS d FROM signal WHERE horizon = 'long')"
_TWO = """th AS (SELECT src, dst, x / (1 + x) AS two_hop, paths FROM (
  SELECT a.src, b.dst, sum(a.d * b.d) AS x, count(*) AS paths FROM top a JOIN top b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2))"""
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM edges) WHERE r <= 100)"
_G = (O.LOG, O.ONE, O.SIGNAL, _EDGES)
_PEER = """vec AS (SELECT e.src, e.dst, CAST(round(w / n * 1000000) AS BIGINT) AS x FROM edges e JOIN (SELECT src, sqrt(sum(w * w)) AS n FROM edges GROUP BY 1) USING (src)),
peers AS (SELECT x.src AS u, y.src AS v, x.dst, x.x AS xu, y.x AS xv FROM vec x JOIN vec y ON x.dst = y.dst AND x.src <> y.src)"""
_SHARED = """sn AS (SELECT u AS src, v AS dst, x / (1 + x) AS shared FROM (
  SELECT u, v, sum(1 / ln(1 + n)) AS x FROM peers JOIN (SELECT dst, count(*) AS n FROM edges GROUP BY 1) USING (dst) GROUP BY 1, 2))"""
_SIMILAR = """si AS (SELECT u AS src, v AS dst, dot, least(1.0, dot / 1000000000000.0) AS similarity FROM (SELECT u, v, sum(xu * xv) AS dot FROM peers GROUP BY 1, 2)),
cp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dot DESC, dst) AS r FROM si WHERE dot > 0) WHERE r <= 50)"""


@register(O.sql(*_G, body="SELECT src, dst, round(w, 6) AS w, round(d, 6) AS d FROM edges"))
def graph_edges(spark, sf_dir):
    return _rounded(G.build_edges(_signal(spark, sf_dir)))


@register(O.sql(*_G, _TOP, _TWO, body="SELECT src, dst, round(two_hop, 6) AS two_hop, paths FROM th"))
def graph_two_hop(spark, sf_dir):
    return _rounded(G.two_hop(G.build_edges(_signal(spark, sf_dir))))


@register(O.sql(*_G, _PEER, _SHARED, body="SELECT src, dst, round(shared, 6) AS shared FROM sn"))
def graph_shared_neighbours(spark, sf_dir):
    """Of all pairs with a common target."""
    return _sixths(shared_neighbours(G.build_edges(_signal(spark, sf_dir))))


@register(O.sql(*_G, _PEER, _SIMILAR, body="SELECT src, dst, round(similarity, 6) AS similarity FROM si"))
def graph_similarity(spark, sf_dir):
    """Of all pairs with a common target."""
    return _sixths(similarity(G.build_edges(_signal(spark, sf_dir))))


@register(O.sql(*_G, _PEER, _SIMILAR, body="SELECT src, dst, round(similarity, 6) AS similarity FROM cp"))
def graph_peers(spark, sf_dir):
    """The 50 most similar users of each, over all edges."""
    return _rounded(G.peers_of(G.build_edges(_signal(spark, sf_dir))))


def _pair_features(spark, sf_dir, wanted=None):
    return G.pair_features(G.build_edges(_signal(spark, sf_dir)), _users(spark, sf_dir), wanted)


def _users(spark, sf_dir):
    return Inputs(spark, sf_dir).users


_WHOLE = "whole AS (SELECT * FROM edges)"
_FEATURES = (
    O.LOG, O.USERS, O.ONE, O.SIGNAL, _EDGES, _WHOLE, _TOP, _TWO, _PEER, _SHARED, _SIMILAR,
    "co AS (SELECT p.src, e.dst, sum(p.similarity * e.d) / any_value(t.total) AS collaborative, count(*) AS support FROM cp p JOIN edges e ON e.src = p.dst JOIN (SELECT src, sum(similarity) AS total FROM cp GROUP BY 1) t ON t.src = p.src WHERE p.src <> e.dst GROUP BY 1, 2)",
    "every AS (SELECT src, dst FROM whole UNION SELECT dst, src FROM whole UNION SELECT src, dst FROM th UNION SELECT src, dst FROM sn UNION SELECT src, dst FROM si UNION SELECT src, dst FROM co)",
    f"pos AS (SELECT id, {O.tok('position')} AS position FROM users)",
    "cm AS (SELECT w.src, p.position, sum(w.w) / any_value(t.total) AS community FROM whole w JOIN pos p ON p.id = w.dst JOIN (SELECT src, sum(w) AS total FROM whole GROUP BY 1) t ON t.src = w.src WHERE p.position IS NOT NULL GROUP BY 1, 2)",
    "nv AS (SELECT dst, 1 - percent_rank() OVER (ORDER BY round(inw * 100)) AS novelty FROM (SELECT dst, sum(w) AS inw FROM whole GROUP BY 1))",
    """gf AS (SELECT e.src, e.dst, coalesce(a.d, 0.0) AS direct, coalesce(b.d, 0.0) AS reverse, coalesce(two_hop, 0.0) AS two_hop, coalesce(paths, 0) AS paths, coalesce(shared, 0.0) AS shared, coalesce(similarity, 0.0) AS similarity,
      coalesce(collaborative, 0.0) AS collaborative, coalesce(support, 0) AS support, coalesce(novelty, 1.0) AS novelty, coalesce(community, 0.0) AS community FROM every e LEFT JOIN whole a ON a.src = e.src AND a.dst = e.dst LEFT JOIN whole b ON b.src = e.dst AND b.dst = e.src
      LEFT JOIN th ON th.src = e.src AND th.dst = e.dst LEFT JOIN sn ON sn.src = e.src AND sn.dst = e.dst LEFT JOIN si ON si.src = e.src AND si.dst = e.dst LEFT JOIN co ON co.src = e.src AND co.dst = e.dst
      LEFT JOIN nv ON nv.dst = e.dst LEFT JOIN pos ON pos.id = e.dst LEFT JOIN cm ON cm.src = e.src AND cm.position = pos.position)""",
    "gs AS (SELECT *, 0.3 * direct + 0.15 * reverse + 0.15 * two_hop + 0.1 * shared + 0.1 * similarity + 0.1 * collaborative + 0.05 * community + 0.05 * novelty AS retrieval FROM gf)",
)
_GRAPH = ["direct", "reverse", "two_hop", "shared", "similarity", "collaborative", "community", "novelty", "retrieval"]


@register(O.sql(*_FEATURES, body=f"SELECT src, dst, {', '.join(f'round({c}, 6) AS {c}' for c in _GRAPH)}, paths, support FROM gs"))
def graph_pair_features(spark, sf_dir):
    return _sixths(_pair_features(spark, sf_dir))


@register(O.sql(*_FEATURES, body="SELECT src, dst, round(round(retrieval, 9), 5) AS retrieval, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(retrieval, 9) DESC, dst) AS rank FROM gs WHERE direct = 0 AND (reverse > 0 OR two_hop > 0 OR shared > 0 OR collaborative > 0)) WHERE rank <= 50"))
def graph_candidates(spark, sf_dir):
    return _rounded(G.candidates(G.build_edges(_signal(spark, sf_dir)), _users(spark, sf_dir), 50), 5)


@register(O.sql(*_FEATURES, body=" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS present, count(*) FILTER (WHERE {c} <> 0) AS non_zero, round(min({c}), 6) AS least, round(avg({c}), 6) AS mean, round(max({c}), 6) AS most FROM gs" for c in _GRAPH)))
def graph_profile(spark, sf_dir):
    """Presence and range of each graph field over the pairs that have any."""
    return _rounded(G.profile(G.build_edges(_signal(spark, sf_dir)), _users(spark, sf_dir)))


@register(O.sql(*_FEATURES, body="SELECT count(DISTINCT n) AS nodes, count(*) // 2 AS edges FROM (SELECT src AS n FROM whole UNION ALL SELECT dst FROM whole)"))
def graph_summary(spark, sf_dir):
    return G.summary(G.build_edges(_signal(spark, sf_dir)))


@register(O.sql(*_FEATURES, O.STATS, body="SELECT count(*) AS pairs, 0 AS repeated, count(*) FILTER (WHERE src IS NULL) AS missing FROM (SELECT DISTINCT viewer_id, candidate_id FROM keys) k LEFT JOIN gs ON src = viewer_id AND dst = candidate_id"))
def graph_merge(spark, sf_dir):
    """The contract of joining graph features to the exposed pairs."""
    pairs = cut(E.exposed_pairs(_events(spark, sf_dir)))
    wanted = pairs.select(F.col("viewer_id").alias("src"), F.col("candidate_id").alias("dst"))
    return G.merge_contract(pairs, _pair_features(spark, sf_dir, wanted))


@register(O.sql(O.LOG, body="SELECT DISTINCT viewer_id, candidate_id FROM (SELECT actor_id AS viewer_id, target_id AS candidate_id FROM valid WHERE event_type IN ('block', 'report') AND ts < TIMESTAMP '2024-01-23' UNION ALL SELECT target_id, actor_id FROM valid WHERE event_type IN ('block', 'report') AND ts < TIMESTAMP '2024-01-23')"))
def excluded_pairs(spark, sf_dir):
    return G.excluded_pairs(E.valid_events(E.unify_interactions(_tables(spark, sf_dir))), E.ntz(CUTOFF))


_NUM = ["distance_km", "viewer_age", "candidate_age", "viewer_height_inches", "viewer_min_age", "history_all_events_90d", "viewer_history_event_count"]
_LONG = "nums AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, CAST({f} AS DOUBLE) AS value FROM pairs" for f in _NUM) + ")"


@register(O.sql(*O.P1, _LONG, body="SELECT field, count(value) AS present, count(*) AS n_rows FROM nums GROUP BY 1"))
def feature_presence(spark, sf_dir):
    return PR.feature_presence(_pairs(spark, sf_dir), _NUM)


@register(O.sql(*O.P1, _LONG, body="SELECT field, count(value) AS present, count(*) FILTER (WHERE value <> 0) AS non_zero, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM nums GROUP BY 1"))
def feature_profile(spark, sf_dir):
    return _rounded(PR.feature_profile(_pairs(spark, sf_dir), _NUM))


@register(O.sql(*O.P1, _LONG, "fl AS (SELECT field, coalesce(median(value), 0.0) AS fill FROM nums GROUP BY 1)", body="SELECT field, round(fill, 6) AS fill, round(avg(coalesce(value, fill)), 6) AS mean, round(CASE WHEN stddev_pop(coalesce(value, fill)) < 1e-6 THEN 1.0 ELSE stddev_pop(coalesce(value, fill)) END, 6) AS std FROM nums JOIN fl USING (field) GROUP BY field, fill"))
def impute_stats(spark, sf_dir):
    return _rounded(PR.impute_stats(_pairs(spark, sf_dir), _NUM))


_TS = "SELECT target, CAST(sum(label) AS BIGINT) AS positives, count(*) AS n_rows, avg(label) AS rate FROM um GROUP BY 1"


@register(O.sql(*O.P1, O.MARKS, body=f"SELECT target, positives, n_rows, round(rate, 6) AS rate FROM ({_TS})"))
def target_summary(spark, sf_dir):
    return _rounded(PR.target_summary(_pairs(spark, sf_dir), TARGETS))


@register(O.sql(*O.P1, O.MARKS, body=f"SELECT target, round(CASE WHEN positives > 0 AND positives < n_rows THEN least(25.0, greatest(1.0, (n_rows - positives) / positives)) ELSE 1.0 END, 6) AS pos_weight FROM ({_TS})"))
def class_weights(spark, sf_dir):
    return _rounded(PR.class_weights(_pairs(spark, sf_dir), TARGETS))


_VOC_SINGLE, _VOC_MULTI = ["position", "body_type"], ["my_types", "body_hair"]
_VOC = " UNION ALL ".join([f"SELECT '{f}' AS field, regexp_replace({f}, '^\\s+|\\s+$', '', 'g') AS token, id, 0 AS place FROM users" for f in _VOC_SINGLE] + [f"SELECT '{f}', regexp_replace(x.t, '^\\s+|\\s+$', '', 'g'), id, x.i - 1 FROM (SELECT id, unnest(list_transform(range(1, len({f}) + 1), lambda i: struct_pack(t := {f}[i], i := i))) AS x FROM users WHERE {f} IS NOT NULL) y" for f in _VOC_MULTI])


@register(O.sql(O.USERS, f"tk AS ({_VOC})", "fs AS (SELECT field, token, min(id * 1000 + place) AS f FROM tk WHERE token IS NOT NULL AND token <> '' GROUP BY 1, 2)", body="SELECT field, token, CAST(1 + row_number() OVER (PARTITION BY field ORDER BY f, token) AS INT) AS id FROM fs"))
def vocabulary(spark, sf_dir):
    """Token ids by first appearance in order of user id."""
    return PR.build_vocab(Inputs(spark, sf_dir).users, _VOC_SINGLE, _VOC_MULTI, [F.col("id")])


#: The walk from the newest cutoff to the oldest, one step a row.
_WALK = """o AS (SELECT cutoff_at, n, row_number() OVER (ORDER BY cutoff_at DESC) AS k, sum(n) OVER () AS total, count(*) OVER () AS cuts
  FROM (SELECT cutoff_at, count(*) AS n FROM pairs GROUP BY 1)),
walk(k, t, nt, v, nv, split) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS HUGEINT), 0, CAST(0 AS HUGEINT), 0, ''
  UNION ALL SELECT o.k, t + CASE WHEN x = 'test' THEN w.n ELSE 0 END, nt + CAST(x = 'test' AS INT), v + CASE WHEN x = 'validation' THEN w.n ELSE 0 END, nv + CAST(x = 'validation' AS INT), x
  FROM (SELECT walk.*, o.n, o.k AS ok, CASE WHEN t < total * 0.1 THEN 'test' WHEN v < total * 0.2 AND cuts - nt - nv > 1 THEN 'validation' ELSE 'train' END AS x FROM walk JOIN o ON o.k = walk.k + 1) w JOIN o ON o.k = w.ok)"""


@register(O.sql(*O.P3, _WALK, body="SELECT cutoff_at, n, split FROM o JOIN walk USING (k)").replace("WITH ", "WITH RECURSIVE ", 1))
def chronological_split(spark, sf_dir):
    return PR.chronological_split(P.assemble(_tables(spark, sf_dir), E.snapshot_windows(spark, END, 3)).select("cutoff_at"))


def _marked(spark, sf_dir):
    return EV.unpivoted(R.formula_predictions(_pairs(spark, sf_dir)), TARGETS)


@register(O.sql(*O.P1, O.MARKS, body="SELECT target, count(*) AS n_rows, count(*) FILTER (WHERE label = 1) AS positives, round(avg(label), 6) AS positive_rate, round(avg(CAST((score >= 0.5) = (label = 1) AS INT)), 6) AS accuracy, round(count(*) FILTER (WHERE label = 1 AND score >= 0.5) / nullif(count(*) FILTER (WHERE score >= 0.5), 0), 6) AS precision, round(count(*) FILTER (WHERE label = 1 AND score >= 0.5) / nullif(sum(label), 0), 6) AS recall FROM um GROUP BY 1"))
def binary_metrics(spark, sf_dir):
    return _rounded(EV.binary_metrics(_marked(spark, sf_dir)))


@register(O.sql(*O.P1, O.MARKS, body="SELECT a.target, round(sum(CASE WHEN a.label = 1 AND b.label = 0 THEN CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END END) / nullif(count(*) FILTER (WHERE a.label = 1 AND b.label = 0), 0), 6) AS auc FROM um a JOIN um b ON a.target = b.target GROUP BY 1"))
def roc_auc(spark, sf_dir):
    return _rounded(EV.roc_auc(_marked(spark, sf_dir)))


@register(O.sql(*O.P1, O.MARKS, "run AS (SELECT target, label, row_number() OVER w AS k, sum(label) OVER w AS hits FROM um WINDOW w AS (PARTITION BY target ORDER BY score DESC, viewer_id, candidate_id ROWS UNBOUNDED PRECEDING))", body="SELECT target, round(sum(CASE WHEN label = 1 THEN hits / k END) / nullif(sum(label), 0), 6) AS average_precision FROM run GROUP BY 1"))
def average_precision(spark, sf_dir):
    return _rounded(EV.average_precision(_marked(spark, sf_dir)))


@register(O.sql(*O.P1, O.MARKS, "rk AS (SELECT *, CAST(outcome_any_positive AS INT) AS label, row_number() OVER (PARTITION BY viewer_id ORDER BY p_any_positive DESC, candidate_id) AS r FROM marks)",
    "per AS (SELECT viewer_id, sum(label) AS p, sum(label) FILTER (WHERE r <= 20) AS hits, count(*) FILTER (WHERE r <= 20) AS shown, sum(label / log2(r + 1)) FILTER (WHERE r <= 20) AS dcg, " + ", ".join(f"count(*) FILTER (WHERE r <= 20 AND outcome_{t}) AS n_{t}" for t in EV.TRACKED) + " FROM rk GROUP BY 1)",
    body="SELECT count(*) AS viewers, round(avg(CASE WHEN p > 0 THEN dcg / list_sum(list_transform(range(1, CAST(least(p, 20) AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END), 6) AS ndcg, round(avg(hits / shown), 6) AS precision, round(avg(CASE WHEN p > 0 THEN hits / p END), 6) AS recall, " + ", ".join(f"round(sum(n_{t}) / sum(shown), 6) AS {t}_rate" for t in EV.TRACKED) + " FROM per"))
def ranking_metrics(spark, sf_dir):
    rows = R.formula_predictions(_pairs(spark, sf_dir)).withColumns({"label": F.col("outcome_any_positive").cast("int"), "score": F.col("p_any_positive")})
    return _rounded(EV.ranking_metrics(rows))


@register(O.sql(*O.P1, O.MARKS, body="SELECT target, round(avg(-(pw * label * ln(q) + (1 - label) * ln(1 - q))), 6) AS logloss FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, score)) AS q FROM um) JOIN (SELECT target, CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN least(25.0, greatest(1.0, (count(*) - sum(label)) / sum(label))) ELSE 1.0 END AS pw FROM um GROUP BY 1) USING (target) GROUP BY 1"))
def weighted_logloss(spark, sf_dir):
    return _rounded(EV.weighted_logloss(_marked(spark, sf_dir), PR.class_weights(_pairs(spark, sf_dir), TARGETS)))


_RANKED = f"rkd AS (SELECT viewer_id, candidate_id, score, row_number() OVER (PARTITION BY viewer_id ORDER BY score DESC, candidate_id) AS rank FROM (SELECT viewer_id, candidate_id, round({O.SCORE}, 9) AS score FROM marks m WHERE NOT EXISTS (SELECT 1 FROM valid x WHERE x.event_type IN ('block', 'report') AND x.ts < TIMESTAMP '2024-01-23' AND ((x.actor_id = viewer_id AND x.target_id = candidate_id) OR (x.actor_id = candidate_id AND x.target_id = viewer_id)))))"


@register(O.sql(*O.P1, O.MARKS, _RANKED, body="SELECT viewer_id, candidate_id, score, rank FROM rkd WHERE rank <= 20"))
def ranked_pairs(spark, sf_dir):
    scored = R.formula_predictions(_pairs(spark, sf_dir)).select("viewer_id", "candidate_id", F.round(R.composite_score(), 9).alias("score"))
    return R.rank_candidates(scored, 20, excluded_pairs(spark, sf_dir)).select("viewer_id", "candidate_id", "score", F.col("rank").cast("long"))


_NOW = datetime(2024, 1, 30)
_ENTITLED = "ent AS (SELECT c + 1 AS id FROM cu WHERE (c % 3 = 0 AND c % 2 = 0 AND c % 4 IN (0, 1) AND (c % 6 = 0 OR TIMESTAMP '2024-01-15' + to_days(CAST(c % 40 AS INT)) > TIMESTAMP '2024-01-30')) OR (c % 10 = 1 AND c % 30 <> 1 AND TIMESTAMP '2024-01-01' + to_days(CAST(c % 45 AS INT)) <= TIMESTAMP '2024-01-30'))"


@register(O.sql(O.USERS, _ENTITLED, body="SELECT id FROM ent"))
def entitled_users(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return P.entitled_users(t["users"].select("id"), t["subscriptions"], t["plus_access_grants"], _NOW)


def _viewers(spark, sf_dir, entitled=True):
    t = _tables(spark, sf_dir)
    people = P.eligible(t["users"]).select("id")
    return P.entitled_users(people, t["subscriptions"], t["plus_access_grants"], _NOW) if entitled else people


_MILES = "CASE lower(trim(v.into_proximity)) WHEN 'same neighborhood' THEN 5.0 WHEN 'within 25 miles' THEN 25.0 WHEN 'within 300 mile' THEN 300.0 END"
_NEAR = f"""AND CASE WHEN lower(trim(v.into_proximity)) = 'same city' THEN lower(trim(v.city)) = lower(trim(c.city))
  WHEN {_MILES} IS NOT NULL THEN {O.km('v', 'c').replace('coalesce(v.lat, v.hlat)', 'v.lat').replace('coalesce(v.lon, v.hlon)', 'v.lon').replace('coalesce(c.lat, c.hlat)', 'c.lat').replace('coalesce(c.lon, c.hlon)', 'c.lon')} * 1000 <= {_MILES} * 1609.344 ELSE true END"""


def _pool_sql(limit: int = 2000, entitled: bool = True, located: bool = False, skip: bool = False) -> str:
    join = "JOIN ent ON ent.id = v.id" if entitled else ""
    live = "AND NOT (v.id % 8 = 4 AND (v.id - 1) % 3 <> 0 AND TIMESTAMP '2024-01-30' + to_days(CAST((v.id - 1) % 5 - 2 AS INT)) > TIMESTAMP '2024-01-30')" if skip else ""
    return f"""blk AS (SELECT DISTINCT x, y FROM (SELECT a AS x, b AS y FROM ev WHERE e = 'error' AND n % 3 = 1 UNION ALL SELECT b, a FROM ev WHERE e = 'error' AND n % 3 = 1)),
pool AS (SELECT * FROM (SELECT v.id AS viewer_id, c.id AS candidate_id, row_number() OVER (PARTITION BY v.id ORDER BY c.last_seen_at DESC NULLS LAST, c.id) AS pool_rank
  FROM people v {join} CROSS JOIN people c LEFT JOIN settings s ON s.user_id = c.id WHERE v.id <> c.id AND coalesce(s.visible, true) {live} {_NEAR if located else ''}
  AND NOT EXISTS (SELECT 1 FROM blk WHERE x = v.id AND y = c.id)) WHERE pool_rank <= {limit})"""


@register(O.sql(O.LOG, O.USERS, _ENTITLED, _pool_sql(), body="SELECT viewer_id, candidate_id, pool_rank FROM pool"))
def eligible_candidates(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return P.eligible_candidates(_viewers(spark, sf_dir), t["users"], t["user_settings"], t["user_blocks"]).withColumn("pool_rank", F.col("pool_rank").cast("long"))


@register(O.sql(O.LOG, O.USERS, _ENTITLED, _pool_sql(located=True), body="SELECT viewer_id, candidate_id, pool_rank FROM pool"))
def located_candidates(spark, sf_dir):
    """The pool of viewers who ask for their city or for a radius comes from there."""
    t = _tables(spark, sf_dir)
    return P.eligible_candidates(_viewers(spark, sf_dir), t["users"], t["user_settings"], t["user_blocks"], located=True).withColumn("pool_rank", F.col("pool_rank").cast("long"))


@register(O.sql(O.USERS, body="SELECT v.id AS viewer_id, c.id AS candidate_id, round(d, 6) AS distance_km FROM (SELECT v, c, " + O.km("v", "c") + " AS d FROM (SELECT * REPLACE (NULL AS hlat, NULL AS hlon) FROM users) v, (SELECT * REPLACE (NULL AS hlat, NULL AS hlon) FROM users) c WHERE v.id % 20 = 0 AND v.id <> c.id) WHERE d * 1000 <= 482803.2"))
def within_radius(spark, sf_dir):
    """Users within 300 miles of every twentieth user: a stated query set against all rows."""
    u = Inputs(spark, sf_dir).users
    return P.within_radius(u.where("id % 20 = 0").select("id", "lat", "lon", F.lit(300 * 1609.344).alias("metres")), u.select("id", "lat", "lon"), digits=6)


def _mix_sql(n1: int, n2: int, n3: int, product: str, pool: str, body: str | None = None) -> str:
    u = lambda seed: f"({O.hashed(f'concat({seed}, candidate_id)')} + 1) / 4503599627370497.0"
    seed = f"'{product}:' || viewer_id || ':2024-01-30:v1:'"
    scored = f"sc AS (SELECT viewer_id, candidate_id, round({O.SCORE}, 9) AS score FROM (SELECT viewer_id, candidate_id, {O.PROBS} FROM pool))"
    rk = "rk AS (SELECT *, row_number() OVER (PARTITION BY viewer_id ORDER BY score DESC, candidate_id) AS rank FROM sc)"
    s2 = f"s2 AS (SELECT *, CASE WHEN rank > {n1} AND rank <= 250 THEN row_number() OVER (PARTITION BY viewer_id, rank > {n1} AND rank <= 250 ORDER BY round(-ln({u(seed)}) / (greatest(score, 0.001) / sqrt(greatest(1, rank - {n1}))), 9), candidate_id) END AS r2 FROM rk)"
    s3 = f"s3 AS (SELECT *, rank <= {n1} AS m, coalesce(r2 <= {n2}, false) AND rank > {n1} AS d, max(rank) OVER (PARTITION BY viewer_id) >= 251 AS deep FROM s2)"
    s4 = "s4 AS (SELECT *, NOT m AND NOT d AS o, count(*) FILTER (WHERE NOT m AND NOT d) OVER (PARTITION BY viewer_id) AS lf, row_number() OVER (PARTITION BY viewer_id, NOT m AND NOT d ORDER BY rank) AS pl FROM s3)"
    s5 = "s5 AS (SELECT *, o AND CASE WHEN deep THEN rank >= 251 ELSE pl > lf // 2 END AS x FROM s4)"
    s6 = "s6 AS (SELECT *, CASE WHEN deep THEN 251 ELSE min(rank) FILTER (WHERE x) OVER (PARTITION BY viewer_id) END AS bg FROM s5)"
    seed3 = f"'{product}:' || viewer_id || ':2024-01-30:v1:explore:'"
    s7 = f"s7 AS (SELECT *, row_number() OVER (PARTITION BY viewer_id, x ORDER BY round(-ln({u(seed3)}) / (greatest(score, 0.001) / sqrt(greatest(1, rank - bg + 1))), 9), candidate_id) AS r3 FROM s6)"
    s8 = f"s8 AS (SELECT *, CASE WHEN m THEN 1 WHEN d THEN 2 WHEN x AND r3 <= {n3} THEN 3 ELSE 4 END AS st FROM s7)"
    s9 = "s9 AS (SELECT *, row_number() OVER (PARTITION BY viewer_id ORDER BY st, CASE st WHEN 2 THEN r2 WHEN 3 THEN r3 ELSE rank END) AS fr FROM s8)"
    kind = "CASE st WHEN 2 THEN 'diversity' WHEN 3 THEN 'exploration' ELSE 'model' END AS selection_type"
    mix = f"mix AS (SELECT viewer_id, candidate_id, score, rank AS model_rank, fr AS final_rank, {kind} FROM s9 WHERE fr <= {n1 + n2 + n3})"
    return O.sql(O.LOG, O.USERS, _ENTITLED, pool, scored, rk, s2, s3, s4, s5, s6, s7, s8, s9, mix, body=body or "SELECT * FROM mix")


def _list(spark, sf_dir, product, entitled=False, located=True, skip=False):
    t, viewers = _tables(spark, sf_dir), _viewers(spark, sf_dir, entitled)
    if skip:
        viewers = PD.without_live_batch(viewers, t["suggestion_batches"], _NOW)
    rows = PD.composed(product, viewers, t, date(2024, 1, 30), "v1", located=located)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("model_rank", "final_rank")})


@register(_mix_sql(12, 3, 0, "suggestions", _pool_sql(located=True, skip=True)))
def daily_suggestions(spark, sf_dir):
    """Entitled viewers without a live batch, near them if they ask for it."""
    return _list(spark, sf_dir, "suggestions", entitled=True, skip=True)


@register(_mix_sql(7, 2, 1, "speed_dating", _pool_sql(entitled=False, located=True)))
def speed_dating(spark, sf_dir):
    return _list(spark, sf_dir, "speed_dating")


@register(_mix_sql(80, 15, 5, "search_pool", _pool_sql(entitled=False)))
def search_pool(spark, sf_dir):
    """Location-free lists of all eligible viewers."""
    return _list(spark, sf_dir, "search_pool", located=False)


_LIVE = "SELECT sha256('speed_dating|' || viewer_id || '|2024-01-29 18:00:00') AS batch_id, 'speed_dating' AS product, viewer_id, 'v1' AS model_version, 'ready' AS status, TIMESTAMP '2024-01-29 18:00:00' AS generated_at, TIMESTAMP '2024-01-30 18:00:00' AS expires_at, final_rank AS rank, model_rank, candidate_id, score, selection_type FROM mix WHERE final_rank <= 5"


@register(_mix_sql(7, 2, 1, "speed_dating", _pool_sql(entitled=False, located=True), _LIVE))
def live_batches(spark, sf_dir):
    """Items of the newest of two published batches of each viewer."""
    rows = _list(spark, sf_dir, "speed_dating")
    rows = cut(PD.with_predictions(rows))
    store = Batches(spark, f"{shared_dir(spark)}/batches-{uuid.uuid4().hex}")
    runs = {"r1": PD.published(rows, "speed_dating", "v1", datetime(2024, 1, 29, 6)), "r2": PD.published(rows.where("final_rank <= 5"), "speed_dating", "v1", datetime(2024, 1, 29, 18))}
    for run in ("r1", "r2", "r1"):  # a run that is published again changes nothing
        store.publish(*runs[run], run)
    return PD.live_items(store.headers(), store.items(), _NOW).drop("predictions")


_DECIDED = """SELECT sha256('speed_dating|' || viewer_id || '|2024-01-20 00:00:00') AS batch_id, viewer_id, candidate_id, final_rank AS rank, d.decision, d.ts AS decided_at
FROM mix LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY ts DESC, decision DESC) AS r FROM (
  SELECT a, b, 'like' AS decision, ts FROM ev WHERE e = 'click' AND n % 3 = 0 UNION ALL SELECT a, b, 'pass', ts FROM ev WHERE e = 'error' AND n % 3 = 1
) WHERE ts >= TIMESTAMP '2024-01-20') d ON d.a = viewer_id AND d.b = candidate_id AND r = 1"""


@register(_mix_sql(7, 2, 1, "speed_dating", _pool_sql(entitled=False, located=True), _DECIDED))
def decided_items(spark, sf_dir):
    """Items of a list with the newest decision on each: a favourite is a like, a block a pass."""
    t = _tables(spark, sf_dir)
    headers, items = PD.published(cut(_list(spark, sf_dir, "speed_dating")), "speed_dating", "v1", datetime(2024, 1, 20))
    who = headers.select("batch_id", "viewer_id")
    said = t["user_favorites"].select(F.col("from_user_id").alias("viewer_id"), F.col("to_user_id").alias("candidate_id"), F.lit("like").alias("decision"), F.col("created_at").alias("decided_at"))
    said = said.unionByName(t["user_blocks"].select(F.col("blocker_user_id").alias("viewer_id"), F.col("blocked_user_id").alias("candidate_id"), F.lit("pass").alias("decision"), F.col("created_at").alias("decided_at")))
    said = said.where("decided_at >= TIMESTAMP_NTZ '2024-01-20 00:00:00'").join(who, "viewer_id")
    return PD.decided(items, said).join(who, "batch_id").select("batch_id", "viewer_id", "candidate_id", F.col("rank").cast("long").alias("rank"), "decision", "decided_at")


def _flights_sql() -> str:
    age, floor = O.AGE.format(a=_ASOF, b="born"), f"CAST({_SEARCH_IN} AS INT)"
    clean = lambda x: f"list_filter(list_transform(coalesce({x}, CAST([] AS VARCHAR[])), lambda t: regexp_replace(t, '^\\s+|\\s+$', '', 'g')), lambda t: t IS NOT NULL AND t <> '' AND lower(t) NOT IN ('any', 'none', 'open to any', 'prefer not to say', 'prefer not to say.'))"
    many = " UNION ALL ".join(f"SELECT id, {i} AS o, '{k}' AS kind, unnest({clean(x)}) AS value, generate_subscripts({clean(x)}, 1) AS at FROM fu" for i, (k, x) in enumerate((("type", "my_types"), ("body_type", "[body_type]"), ("body_hair", "body_hair"))))
    one = " UNION ALL ".join(f"SELECT id, {i + 3}, '{k}', {O.span(x, r)}, 0 FROM fu" for i, (k, x, r) in enumerate((("age_range", "age", AGE_RANGES), ("height_range", "sin", HEIGHT_RANGES), ("weight_range", "weight", WEIGHT_RANGES))))
    ctes = [
        f"fu AS (SELECT c_custkey + 1 AS id, u.my_types, u.body_type, u.body_hair, u.weight, {age} AS age, {floor.replace('c % ', 'c_custkey % ')} AS sin FROM users u JOIN customer ON c_custkey + 1 = u.id)",
        f"tf AS (SELECT DISTINCT id, kind, lower(value) AS key FROM ({many} UNION ALL {one}) WHERE value IS NOT NULL)",
        f"sc AS (SELECT viewer_id, candidate_id, round({O.SCORE}, 9) AS score FROM (SELECT viewer_id, candidate_id, {O.PROBS} FROM pool))",
        "rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY viewer_id ORDER BY score DESC, candidate_id) AS rank FROM sc) WHERE rank <= 200)",
        "ef AS (SELECT viewer_id, candidate_id, greatest(score, 0) / sqrt(rank) AS e, kind, key FROM rk JOIN tf ON tf.id = candidate_id)",
        "sg AS (SELECT viewer_id, kind, key, round(sum(e), 9) AS s FROM ef GROUP BY 1, 2, 3)",
        "pg AS (SELECT x.viewer_id, x.kind AS kind1, x.key AS key1, y.kind AS kind2, y.key AS key2, round(sum(x.e), 9) AS p FROM ef x JOIN ef y ON x.viewer_id = y.viewer_id AND x.candidate_id = y.candidate_id AND x.kind < y.kind GROUP BY 1, 2, 3, 4, 5)",
        "tops AS (SELECT viewer_id, max(s) AS ms FROM sg GROUP BY 1)", "topp AS (SELECT viewer_id, max(p) AS mp FROM pg GROUP BY 1)",
        "rc AS (SELECT viewer_id, kind AS kind1, key AS key1, NULL AS kind2, NULL AS key2, round(s / ms, 9) AS score FROM sg JOIN tops USING (viewer_id) UNION ALL SELECT pg.viewer_id, kind1, key1, kind2, key2, round(0.65 * p / mp + 0.35 * ((a.s + b.s) / 2) / ms, 9) FROM pg JOIN sg a ON a.viewer_id = pg.viewer_id AND a.kind = kind1 AND a.key = key1 JOIN sg b ON b.viewer_id = pg.viewer_id AND b.kind = kind2 AND b.key = key2 JOIN tops ON tops.viewer_id = pg.viewer_id JOIN topp ON topp.viewer_id = pg.viewer_id)",
        "r0 AS (SELECT *, row_number() OVER (PARTITION BY viewer_id ORDER BY score DESC, kind1, key1, kind2 NULLS FIRST, key2 NULLS FIRST) AS place FROM rc)",
        "c0 AS (SELECT *, 0 AS slot FROM r0 WHERE false)",
    ]
    for i in range(1, 6):
        u = {n: f"coalesce(f{n}.n, 0)" for n in ("a", "b")} | {n: f"coalesce(k{n}.n, 0)" for n in ("x", "y")}
        ctes += [
            f"fu{i} AS (SELECT viewer_id, kind, key, count(*) AS n FROM (SELECT viewer_id, kind1 AS kind, key1 AS key FROM c{i - 1} UNION ALL SELECT viewer_id, kind2, key2 FROM c{i - 1} WHERE kind2 IS NOT NULL) GROUP BY 1, 2, 3)",
            f"ku{i} AS (SELECT viewer_id, kind, sum(n) AS n FROM fu{i} GROUP BY 1, 2)",
            f"p{i} AS (SELECT r.*, row_number() OVER (PARTITION BY r.viewer_id ORDER BY round(score - 0.12 * ({u['a']} + {u['b']}) - 0.025 * ({u['x']} + {u['y']}) + CASE WHEN kind2 IS NULL THEN 0.0 ELSE 0.025 END, 9) DESC, r.place) AS best FROM r0 r LEFT JOIN fu{i} fa ON fa.viewer_id = r.viewer_id AND fa.kind = kind1 AND fa.key = key1 LEFT JOIN fu{i} fb ON fb.viewer_id = r.viewer_id AND fb.kind = kind2 AND fb.key = key2 LEFT JOIN ku{i} kx ON kx.viewer_id = r.viewer_id AND kx.kind = kind1 LEFT JOIN ku{i} ky ON ky.viewer_id = r.viewer_id AND ky.kind = kind2 WHERE NOT EXISTS (SELECT 1 FROM c{i - 1} c WHERE c.viewer_id = r.viewer_id AND c.place = r.place))",
            f"c{i} AS (SELECT * FROM c{i - 1} UNION ALL SELECT viewer_id, kind1, key1, kind2, key2, score, place, {i} FROM p{i} WHERE best = 1)",
        ]
    slots = ", ".join(f"'{x}'" for x in PD.SLOTS)
    return O.sql(O.LOG, O.USERS, _ENTITLED, _pool_sql(1000), *ctes, body=f"SELECT viewer_id, CAST(slot AS INT) AS slot, [{slots}][slot] AS location, kind1, key1, kind2, key2, score FROM c5")


@register(_flights_sql())
def search_flights(spark, sf_dir):
    """Five search recipes for every entitled viewer from its 200 best candidates."""
    t = _tables(spark, sf_dir)
    best = R.ranked_lists(pools(_viewers(spark, sf_dir), t["users"], t["user_settings"], t["user_blocks"], 1000), 200)
    ranked = best.select("viewer_id", F.explode("list").alias("x")).select("viewer_id", "x.*")
    single, pair = PD.filter_scores(ranked, PD.trait_filters(t["users"], E.ntz(CUTOFF)))
    return PD.diverse_recipes(PD.recipe_scores(single, pair))


@register(O.sql(*O.P1, O.MARKS, _RANKED, body="SELECT CAST(viewer_id AS VARCHAR) AS request_id, viewer_id, 'home' AS surface, CAST(NULL AS VARCHAR) AS context_key, candidate_id, CAST(rank AS INT) AS rank, score, CAST(NULL AS VARCHAR) AS reject_reason FROM rkd WHERE rank <= 20"))
def impressions(spark, sf_dir):
    """Ranked lists as shown requests, validated."""
    ranked = ranked_pairs(spark, sf_dir)
    item = F.struct("candidate_id", F.col("rank").cast("int").alias("rank"), "score", F.create_map(F.lit("favorite"), F.col("score")).alias("predictions"))
    shown = ranked.groupBy("viewer_id").agg(F.collect_list(item).alias("items"))
    return validated(shown.select(F.col("viewer_id").cast("string").alias("request_id"), "viewer_id", F.lit(" Home ").alias("surface"), F.lit(" ").alias("context_key"), "items"))
