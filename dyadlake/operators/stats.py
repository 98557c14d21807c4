"""Aggregates over windowed events; wide count columns are generated from the list of event types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlake.schema import EVENT_TYPES, HISTORY_TYPES

KEY = ["cutoff_at", "actor_id", "target_id"]


def _counts(prefix: str = "", when=None) -> list[F.Column]:
    keep = lambda t: (F.col("event_type") == t) if when is None else (F.col("event_type") == t) & when
    return [F.count_if(keep(t)).alias(f"{prefix}{t}_count") for t in EVENT_TYPES]


def pair_history(events: DataFrame) -> DataFrame:
    """Counts of each ordered pair before the cutoff, since the history's start, with 7, 30 and 90 day counts."""
    past = events.where("ts < cutoff_at AND ts >= history_start_at")
    since = lambda n: F.col("ts") >= F.col(f"start_{n}d")
    recent = [F.count_if(since(n)).alias(f"all_events_{n}d") for n in (7, 30, 90)]
    recent += [F.count_if((F.col("event_type") == t) & since(n)).alias(f"{t}s_{n}d") for t in ("profile_view", "favorite", "message") for n in (7, 30)]
    return past.groupBy(*KEY).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), *_counts(), *recent)


def pair_stats(events: DataFrame) -> DataFrame:
    """History (h_) and outcome (o_) statistics of each ordered pair in one aggregate of the log."""
    past, late = F.expr("ts < cutoff_at AND ts >= history_start_at"), F.expr("ts >= cutoff_at")
    since = lambda n: past & (F.col("ts") >= F.col(f"start_{n}d"))
    ends = lambda p, when: [F.min(F.when(when, F.col("ts"))).alias(f"{p}first_at"), F.max(F.when(when, F.col("ts"))).alias(f"{p}last_at")]
    recent = [F.count_if(since(n)).alias(f"h_all_events_{n}d") for n in (7, 30, 90)]
    recent += [F.count_if((F.col("event_type") == t) & since(n)).alias(f"h_{t}s_{n}d") for t in ("profile_view", "favorite", "message") for n in (7, 30)]
    return events.groupBy(*KEY).agg(*ends("h_", past), *_counts("h_", past), *recent, *ends("o_", late), *_counts("o_", late))


def part(stats: DataFrame, prefix: str) -> DataFrame:
    """The pairs with events on one side of the cutoff: what pair_history (h_) and pair_outcome (o_) give."""
    names = [c for c in stats.columns if c.startswith(prefix)]
    return stats.where(F.col(f"{prefix}first_at").isNotNull()).select(*KEY, *(F.col(c).alias(c[len(prefix) :]) for c in names))


def pair_outcome(events: DataFrame) -> DataFrame:
    return events.where("ts >= cutoff_at").groupBy(*KEY).agg(F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), *_counts())


def _rollup(pairs: DataFrame, by: str, events: str, others: str, stem: str) -> DataFrame:
    """Sums over a side's pairs: distinct partners are counts of pair rows, so no distinct is needed."""
    total = sum((F.col(f"{t}_count") for t in EVENT_TYPES[1:]), F.col(f"{EVENT_TYPES[0]}_count"))
    kinds = ["profile_view", "favorite", "poke", "image_reaction", "message"]
    return pairs.groupBy("cutoff_at", by).agg(
        F.sum(total).alias(events), F.count("*").alias(others), *(F.sum(f"{k}_count").alias(f"{stem}{k}s") for k in kinds),
        *(F.sum(f"{k}s_30d").alias(f"{stem}{k}s_30d") for k in ("profile_view", "favorite", "message")), F.count_if(F.col("all_events_30d") > 0).alias(f"{others}_30d"),
    )


def actor_history(pairs: DataFrame) -> DataFrame:
    return _rollup(pairs, "actor_id", "event_count", "unique_targets", "")


def target_received(pairs: DataFrame) -> DataFrame:
    return _rollup(pairs, "target_id", "received_events", "unique_actors", "received_")


def item_stats(images: DataFrame, windows: DataFrame) -> DataFrame:
    """Images of each owner before each cutoff; a null is_public counts on neither side."""
    seen = images.join(F.broadcast(windows.select("cutoff_at")), F.col("created_at") < F.col("cutoff_at"))
    return seen.groupBy("cutoff_at", "user_id").agg(F.count("*").alias("image_count"), F.count_if("is_public").alias("public_image_count"), F.count_if(~F.col("is_public")).alias("private_image_count"), F.count_if("is_avatar").alias("avatar_image_count"), F.count_if(F.col("descriptor_processed_at") < F.col("cutoff_at")).alias("descriptor_processed_count"), F.max("created_at").alias("latest_image_at"))


def event_type_counts(events: DataFrame) -> DataFrame:
    """(cutoff_at, actor_id, target_id, event_type, n, n_recent) before the cutoff, within 90 days."""
    past = events.where("ts < cutoff_at AND ts >= start_90d")
    return past.groupBy(*KEY, "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= F.col("start_30d")).alias("n_recent"))


def recent_pair_counts(events: DataFrame) -> DataFrame:
    past = events.where("ts < cutoff_at AND ts >= start_90d")
    return past.groupBy(*KEY).agg(*_counts("total_"), *_counts("recent_", F.col("ts") >= F.col("start_30d")))


def dataset_totals(rows: DataFrame) -> DataFrame:
    """One row over assembled pairs."""
    history = sum((F.col(f"history_{t}_count") for t in HISTORY_TYPES[1:]), F.col(f"history_{HISTORY_TYPES[0]}_count"))
    hard = [F.count_if("hard_exclusion").alias("hard_excluded")] if "hard_exclusion" in rows.columns else []
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(history > 0).alias("pairs_with_history"), *hard, *(F.coalesce(F.sum(f"outcome_{t}_count"), F.lit(0)).alias(f"total_{t}") for t in EVENT_TYPES), F.count_if("outcome_reciprocal_message").alias("reciprocal_pairs"), F.count_if("outcome_any_positive").alias("positive_pairs"))


def evidence_counts(directions: DataFrame, by: list[str]) -> DataFrame:
    """Rows with long-term and recent evidence on each side, from directional affinities (side, horizon, evidence_strength)."""
    some = lambda side, horizon: F.count_if((F.col("side") == side) & (F.col("horizon") == horizon) & (F.col("evidence_strength") > 0))
    counts = [some(s, h).alias(f"{s}_rows_with_{n}evidence") for s in ("viewer", "candidate") for h, n in (("long", ""), ("recent", "recent_"))]
    return directions.groupBy(*by).agg(*counts)


def affinity_users(strength: DataFrame) -> DataFrame:
    """(cutoff_at, users_with_history, users_with_recent): users with evidence in each horizon."""
    some = F.col("evidence_weight") > 0
    return strength.groupBy("cutoff_at").agg(F.count_if(some & (F.col("horizon") == "long")).alias("users_with_history"), F.count_if(some & (F.col("horizon") == "recent")).alias("users_with_recent"))


def snapshot_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cutoff_at").agg(F.count("*").alias("n_rows"), F.count_distinct("viewer_id").alias("viewers"), F.count_distinct("candidate_id").alias("candidates"), F.count_if("outcome_any_positive").alias("positive_pairs"))
