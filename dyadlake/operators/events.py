"""The canonical interaction log (actor_id, target_id, event_type, ts), time windows and pair keys."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_DIRECT = [
    ("user_profile_views", "viewer_user_id", "owner_user_id", "profile_view", "created_at"),
    ("user_favorites", "from_user_id", "to_user_id", "favorite", "created_at"),
    ("user_pokes", "from_user_id", "to_user_id", "poke", "created_at"),
    ("user_blocks", "blocker_user_id", "blocked_user_id", "block", "created_at"),
    ("user_private_album_access", "owner_user_id", "viewer_user_id", "private_album_grant", "granted_at"),
    ("partner_requests", "requester_user_id", "target_user_id", "partner_request", "created_at"),
    ("support_reports", "reporter_user_id", "reported_user_id", "report", "created_at"),
]


def _edge(df: DataFrame, actor: str, target: str, kind, ts: str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.col(actor).alias("actor_id"), F.col(target).alias("target_id"), kind.alias("event_type"), F.col(ts).alias("ts"))


def direct_edges(t: dict[str, DataFrame]) -> DataFrame:
    parts = [_edge(t[name].where(F.col(b).isNotNull()) if kind == "report" else t[name], a, b, kind, ts) for name, a, b, kind, ts in _DIRECT]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def owned_items(t: dict[str, DataFrame]) -> DataFrame:
    """Reactions and views whose target is the owner of an image or story."""
    images, stories = t["user_images"].select(F.col("id").alias("image_id"), F.col("user_id").alias("owner")), t["user_stories"].select(F.col("id").alias("story_id"), F.col("user_id").alias("owner"))
    reply = F.when(F.col("kind") == "reply", "story_reply").otherwise("story_reaction")
    return (
        _edge(t["image_reactions"].join(images, "image_id"), "from_user_id", "owner", "image_reaction", "created_at")
        .unionByName(_edge(t["story_views"].join(stories, "story_id"), "viewer_user_id", "owner", "story_view", "viewed_at"))
        .unionByName(_edge(t["story_reactions"].join(stories, "story_id"), "from_user_id", "owner", reply, "created_at"))
    )


def direct_messages(t: dict[str, DataFrame]) -> DataFrame:
    """A message of a two-sided conversation goes to every other participant."""
    dm = t["conversations"].where("type = 'dm'").select(F.col("id").alias("conversation_id"))
    said = t["messages"].where("sender_user_id IS NOT NULL AND deleted_at IS NULL").join(dm, "conversation_id")
    return _edge(said.join(t["conversation_participants"], "conversation_id").where("user_id <> sender_user_id"), "sender_user_id", "user_id", "message", "created_at")


def message_reactions(t: dict[str, DataFrame]) -> DataFrame:
    sender = t["messages"].where("sender_user_id IS NOT NULL").select(F.col("id").alias("message_id"), "sender_user_id")
    return _edge(t["message_reactions"].join(sender, "message_id").where("user_id <> sender_user_id"), "user_id", "sender_user_id", "message_reaction", "created_at")


def accepted_partners(t: dict[str, DataFrame]) -> DataFrame:
    """Both directions of an accepted request, in one scan."""
    both = F.explode(F.array(F.struct(F.col("requester_user_id").alias("x"), F.col("target_user_id").alias("y")), F.struct(F.col("target_user_id").alias("x"), F.col("requester_user_id").alias("y"))))
    done = t["partner_requests"].where("status = 'accepted' AND responded_at IS NOT NULL").select(both.alias("p"), "responded_at")
    return _edge(done.select("p.x", "p.y", "responded_at"), "x", "y", "partner_accepted", "responded_at")


def unify_interactions(t: dict[str, DataFrame], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """All branches; the half-open time filter is written once and pushed to every scan."""
    log = direct_edges(t).unionByName(owned_items(t)).unionByName(direct_messages(t)).unionByName(message_reactions(t)).unionByName(accepted_partners(t))
    if start is not None:
        log = log.where(F.col("ts") >= ntz(start))
    return log.where(F.col("ts") < ntz(end)) if end is not None else log


def valid_events(log: DataFrame) -> DataFrame:
    return log.where("actor_id IS NOT NULL AND target_id IS NOT NULL AND actor_id <> target_id")


def restrict_events(log: DataFrame, viewers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Events by a viewer or onto a candidate; a candidate's events onto a viewer are among the former's reverse."""
    who = viewers.select("id", F.lit(1).alias("role")).unionByName(candidates.select("id", F.lit(2).alias("role")))
    roles = who.where("id IS NOT NULL").groupBy("id").agg(F.bit_or("role").alias("role"))
    as_ = lambda end: roles.select(F.col("id").alias(f"_{end}"), F.col("role").alias(f"_{end}_role"))
    both = log.join(as_("actor"), F.col("actor_id") == F.col("_actor"), "left").join(as_("target"), F.col("target_id") == F.col("_target"), "left")
    has = lambda end, role: F.coalesce(F.col(f"_{end}_role").bitwiseAND(role) != 0, F.lit(False))
    return both.where(has("actor", 1) | has("target", 2) | (has("actor", 2) & has("target", 1))).select(log.columns)


def ntz(t: datetime) -> F.Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def time_windows(spark: SparkSession, cutoff: datetime, outcome_end: datetime, history_days: int = 90) -> DataFrame:
    """One row of window bounds."""
    return _bounds(spark.range(1).select(ntz(cutoff).alias("cutoff_at"), ntz(outcome_end).alias("outcome_end_at")), history_days)


def snapshot_windows(spark: SparkSession, now: datetime, count: int, outcome_days: int = 7, step_days: int = 7, history_days: int = 90) -> DataFrame:
    """count rows of window bounds, newest first in order of cutoff; outcome windows must not overlap."""
    if step_days < outcome_days:
        raise ValueError("snapshots would overlap: step_days is under outcome_days")
    i = spark.range(count)
    back = lambda base: ntz(base) - F.make_dt_interval((F.col("id") * step_days).cast("int"))
    return _bounds(i.select(back(now - timedelta(days=outcome_days)).alias("cutoff_at"), back(now).alias("outcome_end_at")), history_days)


def _bounds(df: DataFrame, history_days: int) -> DataFrame:
    day = lambda n: F.col("cutoff_at") - F.make_dt_interval(F.lit(n))
    out = df.select("cutoff_at", "outcome_end_at", day(history_days).alias("history_start_at"), *(day(n).alias(f"start_{n}d") for n in (7, 30, 90)))
    return out.withColumn("load_start_at", F.least("history_start_at", "start_90d"))


def windowed(log: DataFrame, windows: DataFrame) -> DataFrame:
    """The log once for every snapshot that needs an event; windows are a few dozen rows, so they are broadcast."""
    return valid_events(log).join(F.broadcast(windows), (F.col("ts") >= F.col("load_start_at")) & (F.col("ts") < F.col("outcome_end_at")))


def windowed_log(t: dict[str, DataFrame], windows: DataFrame) -> DataFrame:
    """The windowed log of the sources; the outer bounds of all windows reach every scan as literals."""
    # one row of two timestamps from a few dozen rows
    start, end = windows.agg(F.min("load_start_at"), F.max("outcome_end_at")).first()
    return windowed(unify_interactions(t, start, end), windows)


def exposed_pairs(events: DataFrame) -> DataFrame:
    """(cutoff_at, viewer_id, candidate_id): pairs with a profile view in the outcome window."""
    seen = events.where("event_type = 'profile_view' AND ts >= cutoff_at")
    return seen.select("cutoff_at", F.col("actor_id").alias("viewer_id"), F.col("target_id").alias("candidate_id")).distinct()


def requested_pairs(requests: DataFrame) -> DataFrame:
    """(viewer_id, candidate_id, position) of requests (viewer_id, candidate_ids): no self, ids over 0, first seen."""
    each = requests.select("viewer_id", F.posexplode("candidate_ids").alias("pos", "candidate_id")).where("candidate_id > 0 AND viewer_id > 0 AND candidate_id <> viewer_id")
    return each.groupBy("viewer_id", "candidate_id").agg(F.min("pos").cast("long").alias("position"))


def missing_candidates(requested: DataFrame, returned: DataFrame) -> DataFrame:
    return requested.join(returned, ["viewer_id", "candidate_id"], "left_anti")


def newest_rows(rows: DataFrame, limit: int) -> DataFrame:
    """A limit over all snapshots that is used up newest first, by viewer and candidate."""
    return rows.orderBy(F.desc("cutoff_at"), "viewer_id", "candidate_id").limit(limit)


def first_by(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
