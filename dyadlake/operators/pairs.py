"""Pairs of users: assembly of features and targets, entitlement; candidate pools are in pools and geo."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlake.functions import scalar as S
from dyadlake.operators import events as E
from dyadlake.operators import stats as A
from dyadlake.operators.geo import within_radius
from dyadlake.operators.pools import POOL, SPARE, eligible, eligible_candidates, symmetric_blocks
from dyadlake.sources.shared import cut

__all__ = ["POOL", "SPARE", "assemble", "eligible", "eligible_candidates", "entitled_users", "labels", "symmetric_blocks", "within_radius"]


def labels() -> list[F.Column]:
    """The 11 targets over outcome_ and reverse_outcome_ counts."""
    n = lambda t, stem="outcome": F.col(f"{stem}_{t}_count") > 0
    any_of = lambda *ts: F.greatest(*(n(t) for t in ts))
    return [
        *(n(t).alias(f"outcome_{t}") for t in ("favorite", "poke", "image_reaction")), any_of("story_reaction", "story_reply").alias("outcome_story_engagement"),
        n("message").alias("outcome_message_started"), (n("message") & n("message", "reverse_outcome")).alias("outcome_reciprocal_message"),
        *(n(t).alias(f"outcome_{t}") for t in ("private_album_grant", "partner_accepted", "block", "report")),
        any_of("favorite", "poke", "image_reaction", "story_reaction", "story_reply", "message", "private_album_grant", "partner_accepted").alias("outcome_any_positive"),
    ]


def _swapped(df: DataFrame) -> DataFrame:
    turned = {"actor_id": "target_id", "target_id": "actor_id"}
    return df.select(*(F.col(c).alias(turned.get(c, c)) for c in df.columns))


def _named(df: DataFrame, prefix: str, keys: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).alias(keys.get(c, f"{prefix}{c}")) for c in df.columns))


def assemble(t: dict[str, DataFrame], windows: DataFrame) -> DataFrame:
    """One row for each exposed pair of eligible users at each cutoff: profiles, histories, outcomes, targets.

    Every side table is aggregated to its key before it is joined, so all joins are equi-joins that keep
    the number of rows; counts that are missing are 0.
    """
    # the log is aggregated once; all side tables come from these pair rows, written to the shared folder
    stats = cut(A.pair_stats(E.windowed_log(t, windows)))
    history, outcome = A.part(stats, "h_"), A.part(stats, "o_")
    keys = stats.where("o_profile_view_count > 0").select("cutoff_at", F.col("actor_id").alias("viewer_id"), F.col("target_id").alias("candidate_id"))
    people = eligible(t["users"]).drop("is_bot", "is_banned")
    rows = keys
    for side in ("viewer", "candidate"):
        rows = rows.join(_named(people, f"{side}_", {"id": f"{side}_id"}), f"{side}_id")
    pair = {"actor_id": "viewer_id", "target_id": "candidate_id", "cutoff_at": "cutoff_at"}
    on = ["cutoff_at", "viewer_id", "candidate_id"]
    for df, prefix in ((history, "history_"), (_swapped(history), "reverse_history_"), (outcome, "outcome_"), (_swapped(outcome), "reverse_outcome_")):
        rows = rows.join(_named(df, prefix, pair), on, "left")
    rows = rows.join(_named(A.actor_history(history), "viewer_history_", {"actor_id": "viewer_id", "cutoff_at": "cutoff_at"}), ["cutoff_at", "viewer_id"], "left")
    rows = rows.join(_named(A.target_received(history), "candidate_history_", {"target_id": "candidate_id", "cutoff_at": "cutoff_at"}), ["cutoff_at", "candidate_id"], "left")
    items = A.item_stats(t["user_images"], windows)
    for side in ("viewer", "candidate"):
        rows = rows.join(_named(items, f"{side}_", {"user_id": f"{side}_id", "cutoff_at": "cutoff_at"}), ["cutoff_at", f"{side}_id"], "left")
        rows = rows.join(_named(t["user_settings"].drop("visible"), f"{side}_", {"user_id": f"{side}_id"}), f"{side}_id", "left")
    counts = [f.name for f in rows.schema.fields if f.dataType.typeName() == "long" and not f.name.endswith("_id")]
    rows = rows.fillna(0, counts)
    place = lambda side, axis: F.coalesce(f"{side}_{axis}", f"{side}_home_{axis}")
    extra = {"distance_km": S.distance_km(place("viewer", "lat"), place("viewer", "lon"), place("candidate", "lat"), place("candidate", "lon"))}
    for side in ("viewer", "candidate"):
        extra[f"{side}_age"] = S.age_years(F.col("cutoff_at"), F.col(f"{side}_date_of_birth"))
        extra[f"{side}_height_inches"] = S.height_inches(F.col(f"{side}_height"))
        extra[f"{side}_account_age_days"] = S.account_age_days(F.col("cutoff_at"), F.col(f"{side}_created_at"))
    return rows.withColumns(extra).select("*", *labels())


def entitled_users(users: DataFrame, subscriptions: DataFrame, grants: DataFrame, now: datetime) -> DataFrame:
    """Users with an active plus subscription or a running grant."""
    t = E.ntz(now)
    open_ = F.col("expires_at").isNull() | (F.col("expires_at") > t)
    paid = subscriptions.where((F.lower("plan") == "plus") & F.lower("status").isin("active", "trialing") & open_).select("user_id")
    given = grants.where(F.col("revoked_at").isNull() & (F.col("started_at") <= t) & open_).select("user_id")
    return users.join(paid.union(given).distinct().withColumnRenamed("user_id", "id"), "id", "left_semi")
