"""Exposure log: validation of shown lists, the same in batch and streaming, and refresh of affinities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadlake.sources.stored import Merged, Stored

MOST_ITEMS = 200


def validated(requests: DataFrame) -> DataFrame:
    """An item a row with a reject_reason (null: accepted) for requests (request_id, viewer_id, surface, context_key, items).

    Checks across a request's items are made on its array before it is exploded: the plan is stateless and
    runs unchanged in append mode.
    """
    surface = F.lower(F.trim("surface"))
    context = F.when(F.trim("context_key") != "", F.trim("context_key"))
    ids, ranks = F.transform("items", lambda x: x["candidate_id"]), F.transform("items", lambda x: x["rank"])
    twice = lambda a: F.size(F.array_distinct(a)) < F.size(a)
    whole = (
        F.when(~F.coalesce(F.rlike(surface, F.lit("^[a-z0-9_.-]{1,64}$")), F.lit(False)), "surface")
        .when(F.length(context) > 200, "context_key")
        .when(F.size("items") > MOST_ITEMS, "too_many_items")
        .when(twice(ids), "repeated_candidate")
        .when(twice(ranks), "repeated_rank")
    )
    each = requests.select("request_id", "viewer_id", surface.alias("surface"), context.alias("context_key"), whole.alias("whole"), F.explode("items").alias("i"))
    bad = lambda v: v.isNull() | F.isnan(v) | ~v.between(0, 1)
    predictions = F.exists(F.map_values(F.coalesce("i.predictions", F.create_map().cast("map<string,double>"))), bad)
    item = F.when(F.coalesce(F.col("i.rank") <= 0, F.lit(True)), "rank").when(bad(F.col("i.score")), "score").when(predictions, "predictions").when(F.coalesce(F.col("i.candidate_id") == F.col("viewer_id"), F.lit(True)), "self")
    return each.select("request_id", "viewer_id", "surface", "context_key", "i.candidate_id", "i.rank", "i.score", F.coalesce("whole", item).alias("reject_reason"))


def batch_name(batch: int) -> str:
    """Names of micro-batches sort as their numbers do."""
    return f"b{batch:012d}"


SHOWN = "request_id string, viewer_id long, surface string, context_key string, candidate_id long, rank long, score double"


def impression_stream(requests: DataFrame, store: Stored, checkpoint: str):
    """Start a stream that validates requests and stores their items, each exactly once.

    A micro-batch goes to the tables `shown` and `rejected` (with the reason) under its number and is committed as one: a
    batch that is run again after a restart overwrites what it left, or does nothing if it was committed.
    """
    names = [c.split()[0] for c in SHOWN.split(", ")]

    def each(batch: DataFrame, number: int) -> None:
        rows = validated(batch).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SHOWN.split(", ")), "reject_reason")
        good = rows.where("reject_reason IS NULL").select(*names)
        store.write(batch_name(number), {"shown": good, "rejected": rows.where("reject_reason IS NOT NULL")})

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_stream(events: DataFrame, rebuild: Callable[[DataFrame], DataFrame], store: Merged, version: str, checkpoint: str):
    """Start a stream that rebuilds the affinities of every actor of a micro-batch and merges them into the store.

    rebuild takes the touched user ids (id) and returns their rows; users that no longer have any lose them. The number
    of the micro-batch names the merge, so a batch that is run again changes nothing.
    """

    def each(batch: DataFrame, number: int) -> None:
        ids = batch.select(F.col("actor_id").alias("id")).where("id IS NOT NULL").distinct()
        touched = ids.select(F.lit(version).alias("model_version"), F.col("id").alias("user_id"))
        if not store.is_committed(batch_name(number)):
            store.merge(batch_name(number), rebuild(ids).withColumn("model_version", F.lit(version)), touched)

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
