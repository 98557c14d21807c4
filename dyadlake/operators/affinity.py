"""Taste affinities learned from behaviour: one row per (cutoff, user, horizon, kind, key).

The state is algebraic (sums of score times evidence and of evidence), so it is one grouped sum with
partial aggregation; both horizons come from one pass over the pair counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlake.functions import scalar as S
from dyadlake.operators.pairs import eligible
from dyadlake.schema import AGE_BANDS, DISTANCE_BANDS, HEIGHT_BANDS, MULTI_KINDS, POSITIVE_WEIGHTS, PRIOR_WEIGHT, RECENT_DAYS, SATURATION, SINGLE_KINDS, WEIGHT_BANDS
from dyadlake.sources.shared import cut, few, parts

LONG_DAYS = 90
SIGNALS = 250_000  # of a task


def preference_signal(type_counts: DataFrame) -> DataFrame:
    """(cutoff_at, actor_id, target_id, horizon, raw, score, evidence) of pairs with positive evidence."""
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in POSITIVE_WEIGHTS.items() for x in kv)), F.col("event_type"))
    # hundredths are whole numbers, so the sum doesn't depend on its order
    raw = lambda n: F.sum(F.coalesce(F.round(weight * 100).cast("long"), F.lit(0)) * F.col(n)) / 100.0
    sums = type_counts.groupBy("cutoff_at", "actor_id", "target_id").agg(raw("n").alias("long"), raw("n_recent").alias("recent"))
    both = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(h).alias("raw")) for h in ("long", "recent"))))
    sums = sums.select("cutoff_at", "actor_id", "target_id", both.alias("h")).select("cutoff_at", "actor_id", "target_id", "h.*").where("raw > 0")
    return sums.select("*", (0.5 + 0.5 * F.tanh(F.col("raw") / 2)).alias("score"), F.least(F.lit(4.0), 1.5 * F.log(1 + F.col("raw"))).alias("evidence"))


def traits(asof: str = "cutoff_at") -> list[tuple[str, F.Column]]:
    """(kind, key or array of keys) of profile rows; the kind distance is of a pair."""
    c = F.col
    return [
        ("age", S.band(S.age_years(c(asof), c("date_of_birth")), AGE_BANDS)), ("height", S.band(S.height_inches(c("height")), HEIGHT_BANDS)),
        ("weight", S.band(c("weight"), WEIGHT_BANDS)), ("position", S.token(c("position"))), ("body_type", S.token(c("body_type"))), ("relationship_status", S.token(c("relationship_status"))),
        ("body_hair", S.tokens(c("body_hair"))), ("type", S.tokens(c("my_types"))), ("fetish", S.tokens(c("my_fetishes"))),
    ]


_pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
_place = lambda axis: F.coalesce(axis, f"home_{axis}")


def profiled(rows: DataFrame, of: str, users: DataFrame, ids: DataFrame) -> DataFrame:
    """rows (cutoff_at, of, ...) whose user of is among users, with its place (tlat, tlon) and its traits as one array.

    The traits of a user at a cutoff are made once, not for every row that names it; ids has all (cutoff_at, of) of rows.
    """
    kinds = traits()
    single = F.array(*(_pair(k, v) for k, v in kinds if k in SINGLE_KINDS))
    known = F.filter(F.concat(single, *(F.transform(v, _struct_of(k)) for k, v in kinds if k in MULTI_KINDS)), lambda t: t["key"].isNotNull())
    named = ids.select("cutoff_at", of).distinct().join(users.withColumnRenamed("id", of), of)
    return rows.join(few(named.select("cutoff_at", of, _place("lat").alias("tlat"), _place("lon").alias("tlon"), known.alias("traits"))), ["cutoff_at", of])


def exploded(rows: DataFrame, *keep: str) -> DataFrame:
    """A row (keep, kind, key) for every trait of every row of profiled, and for its distance_km."""
    distance = F.array(_pair("distance", S.band(F.col("distance_km"), DISTANCE_BANDS)))
    return rows.select(*keep, F.explode(F.concat(distance, "traits")).alias("t")).where("t.key IS NOT NULL").select(*keep, "t.kind", "t.key")


def _struct_of(kind: str):
    return lambda x: _pair(kind, x)


def observations(signals: DataFrame, users: DataFrame, point_in_time: bool = False) -> DataFrame:
    """Signals with the target's traits and the distance between both.

    The job takes eligible users on both ends; the point-in-time state of a dataset leaves out targets that are bots, and no others.
    Signals are dealt by actor in tasks of SIGNALS rows, so that the sums over an actor's traits stay small in each.
    """
    people, known = (users.where("is_bot = false"), users) if point_in_time else (eligible(users), eligible(users))
    signals = cut(signals)
    dealt = signals.repartition(max(parts(signals.sparkSession), -(-signals.count() // SIGNALS)), "actor_id")
    actors = known.select(F.col("id").alias("actor_id"), _place("lat").alias("alat"), _place("lon").alias("alon"))
    seen = profiled(dealt.join(actors, "actor_id"), "target_id", people, signals)
    return seen.withColumn("distance_km", S.distance_km(F.col("alat"), F.col("alon"), F.col("tlat"), F.col("tlon")))


def affinity_state(seen: DataFrame) -> DataFrame:
    """Shrunk mean score, evidence count and weight of every (user, horizon, kind, key)."""
    each = exploded(seen, "cutoff_at", "actor_id", "horizon", "score", "evidence")
    score = (0.5 * PRIOR_WEIGHT + F.sum(F.col("score") * F.col("evidence"))) / (PRIOR_WEIGHT + F.sum("evidence"))
    return each.groupBy("cutoff_at", F.col("actor_id").alias("user_id"), "horizon", "kind", "key").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"), F.count("*").alias("evidence_count"), F.sum("evidence").alias("evidence_weight"))


def affinity_strength(seen: DataFrame) -> DataFrame:
    return seen.groupBy("cutoff_at", F.col("actor_id").alias("user_id"), "horizon").agg(F.count("*").alias("observation_count"), F.sum("evidence").alias("evidence_weight"), (1 - F.exp(-F.sum("evidence") / SATURATION)).alias("strength"))


def all_strengths(type_counts: DataFrame, users: DataFrame, strength: DataFrame) -> DataFrame:
    """strength with rows of 0 for users whose events between eligible users are none of them positive."""
    people = eligible(users).select("id")
    met = type_counts.select("cutoff_at", "actor_id", "target_id").join(people.withColumnRenamed("id", "actor_id"), "actor_id", "left_semi")
    met = met.join(people.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select("cutoff_at", F.col("actor_id").alias("user_id")).distinct()
    every = met.select("*", F.explode(F.array(F.lit("long"), F.lit("recent"))).alias("horizon"))
    zero = {"observation_count": 0, "evidence_weight": 0.0, "strength": 0.0}
    return every.join(strength, ["cutoff_at", "user_id", "horizon"], "left").fillna(zero)


def exported(state: DataFrame, strength: DataFrame) -> DataFrame:
    """The persisted form: recent kinds carry a prefix, strengths are meta rows."""
    prefix = F.when(F.col("horizon") == "recent", "recent_").otherwise("")
    rows = state.select("cutoff_at", "user_id", F.concat(prefix, "kind").alias("affinity_kind"), F.col("key").alias("affinity_key"), "score", "evidence_count")
    meta = strength.select("cutoff_at", "user_id", F.when(F.col("horizon") == "recent", "__recent_meta__").otherwise("__meta__"), F.lit("strength"), F.col("strength"), F.col("observation_count"))
    return rows.union(meta)


#: Columns of the stored form.
STORED = "model_version string, user_id long, affinity_kind string, affinity_key string, score double, evidence_count long, window_start_at timestamp_ntz, window_end_at timestamp_ntz"


def affinity_job(type_counts: DataFrame, users: DataFrame, version: str) -> DataFrame:
    """The whole job from pair counts to the stored form: state and meta rows of both horizons with their version and window.

    For some users only, type_counts are restricted to their rows as actors.
    """
    type_counts = cut(type_counts)
    seen = observations(preference_signal(type_counts), users)
    rows = exported(affinity_state(seen), all_strengths(type_counts, users, affinity_strength(seen)))
    recent = F.col("affinity_kind").startswith("recent_") | (F.col("affinity_kind") == "__recent_meta__")
    days = F.when(recent, RECENT_DAYS).otherwise(LONG_DAYS)
    start = (F.col("cutoff_at") - F.make_dt_interval(days)).alias("window_start_at")
    return rows.select(F.lit(version).alias("model_version"), "user_id", "affinity_kind", "affinity_key", "score", F.col("evidence_count").cast("long").alias("evidence_count"), start, F.col("cutoff_at").alias("window_end_at"))


def imported(rows: DataFrame) -> DataFrame:
    """Back to (cutoff_at, user_id, horizon, kind, key, score, evidence_count, evidence_weight): unknown kinds are left out, a meta row's weight is recovered from its strength."""
    recent = F.col("affinity_kind").startswith("recent_") | (F.col("affinity_kind") == "__recent_meta__")
    kind = F.when(F.col("affinity_kind").isin("__meta__", "__recent_meta__"), "__meta__").otherwise(F.regexp_replace("affinity_kind", "^recent_", ""))
    weight = F.when(kind == "__meta__", -SATURATION * F.log(1 - F.least(F.col("score"), F.lit(1 - 1e-12))))
    return rows.select("cutoff_at", "user_id", F.when(recent, "recent").otherwise("long").alias("horizon"), kind.alias("kind"), F.col("affinity_key").alias("key"), "score", "evidence_count", weight.alias("evidence_weight")).where(F.col("kind").isin("__meta__", *SINGLE_KINDS, *MULTI_KINDS))


def merged(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A keyed upsert: new rows replace current ones."""
    return current.join(new.select(*keys), keys, "left_anti").unionByName(new)


def directional(pairs: DataFrame, users: DataFrame, state: DataFrame, strength: DataFrame) -> DataFrame:
    """(cutoff_at, viewer_id, candidate_id, horizon, ten kinds, overall, strength) of each pair and direction.

    A single kind without a learned entry scores 0.5; several keys average those that were learned. The
    overall score averages the kinds that the candidate's profile has. Cold users score 0.5 and 0.
    """
    viewers = users.select(F.col("id").alias("viewer_id"), _place("lat").alias("vlat"), _place("lon").alias("vlon"))
    rows = profiled(pairs.select("cutoff_at", "viewer_id", "candidate_id").join(viewers, "viewer_id"), "candidate_id", users, pairs)
    rows = rows.withColumn("distance_km", S.distance_km(F.col("vlat"), F.col("vlon"), F.col("tlat"), F.col("tlon")))
    each = exploded(rows, "cutoff_at", "viewer_id", "candidate_id").withColumn("horizon", F.explode(F.array(F.lit("long"), F.lit("recent"))))
    learned = state.select("cutoff_at", F.col("user_id").alias("viewer_id"), "horizon", "kind", "key", "score")
    key = ["cutoff_at", "viewer_id", "candidate_id", "horizon"]
    kinds = each.join(learned, ["cutoff_at", "viewer_id", "horizon", "kind", "key"], "left").groupBy(*key, "kind").agg(F.coalesce(F.avg("score"), F.lit(0.5)).alias("s"))
    names = [*SINGLE_KINDS, *MULTI_KINDS]
    wide = kinds.groupBy(*key).agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("s"))), F.lit(0.5)).alias(f"{k}_affinity") for k in names), F.avg("s").alias("overall_affinity"))
    base = rows.select("cutoff_at", "viewer_id", "candidate_id", F.explode(F.array(F.lit("long"), F.lit("recent"))).alias("horizon"))
    out = base.join(wide, key, "left").join(strength.select("cutoff_at", F.col("user_id").alias("viewer_id"), "horizon", "strength"), ["cutoff_at", "viewer_id", "horizon"], "left")
    return out.select(*key, *(F.coalesce(f"{k}_affinity", F.lit(0.5)).alias(f"{k}_affinity") for k in [*names, "overall"]), F.coalesce("strength", F.lit(0.0)).alias("evidence_strength"))


def both_directions(pairs: DataFrame, users: DataFrame, state: DataFrame, strength: DataFrame) -> DataFrame:
    """directional for the viewer's state on the candidate and the candidate's on the viewer, told apart by side."""
    pairs, state, strength = cut(pairs), cut(state), cut(strength)  # each is read for both sides
    turned = pairs.select("cutoff_at", F.col("candidate_id").alias("viewer_id"), F.col("viewer_id").alias("candidate_id"))
    one = directional(pairs, users, state, strength).withColumn("side", F.lit("viewer"))
    two = directional(turned, users, state, strength).withColumn("side", F.lit("candidate"))
    return one.unionByName(two.withColumnsRenamed({"viewer_id": "_v", "candidate_id": "viewer_id"}).withColumnRenamed("_v", "candidate_id"))


def profile(directions: DataFrame) -> DataFrame:
    """(field, viewer_mean, candidate_mean) of every affinity of both_directions, recent ones with a prefix."""
    names = [*(f"{k}_affinity" for k in [*SINGLE_KINDS, *MULTI_KINDS, "overall"]), "evidence_strength"]
    each = F.explode(F.array(*(F.struct(F.concat(F.when(F.col("horizon") == "recent", "recent_").otherwise(""), F.lit(n)).alias("field"), F.col(n).alias("value")) for n in names)))
    long = directions.select("side", each.alias("x")).select("side", "x.*")
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("value"))).alias(f"{side}_mean")
    return long.groupBy("field").agg(mean("viewer"), mean("candidate"))


def contract(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Violations of each field: missing, not finite or outside 0 to 1."""
    wrong = lambda f: F.col(f).isNull() | F.isnan(f) | ~F.col(f).between(0, 1)
    return rows.agg(*(F.count_if(wrong(f)).alias(f) for f in fields)).select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("violations")) for f in fields))).alias("v")).select("v.*")
