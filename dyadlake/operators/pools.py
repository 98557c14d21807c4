"""Candidate pools: the most recently seen eligible users for every viewer, read from lists in order of recency.

There is a list of everyone, one for each city and one for each leaf of an adaptive grid. Viewers read lists
by ranges of ranks, no further than their own number of blocks asks for, so neither a metropolis nor
someone who blocks many users makes anyone else's pool dearer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadlake.functions import scalar as S
from dyadlake.operators import events as E
from dyadlake.operators import geo
from dyadlake.operators.order import positions
from dyadlake.sources.shared import cut, parts

POOL = 2000
SPARE = 100  # blocks of a viewer who needs only the first range of a list
READERS = 250  # viewers that read one copy of a range; lists are scored in the task that reads them
FIRST_RANKS = 16  # of a leaf's list in its first range; each range is twice as long as the one before
EVERYONE = "*"


def eligible(users: DataFrame) -> DataFrame:
    """Users that are known to be neither a bot nor banned."""
    return users.where("is_bot = false AND is_banned = false")


def symmetric_blocks(blocks: DataFrame) -> DataFrame:
    """(viewer_id, candidate_id) in both directions of every block."""
    one, two = F.col("blocker_user_id"), F.col("blocked_user_id")
    both = F.array(F.struct(one.alias("viewer_id"), two.alias("candidate_id")), F.struct(two.alias("viewer_id"), one.alias("candidate_id")))
    return blocks.select(F.explode(both).alias("p")).select("p.*").distinct()


def age() -> Column:
    """Microseconds since a user was seen, as a number that sorts newest first and never seen last."""
    seen = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', last_seen_at)")
    return F.coalesce(-seen, F.lit((1 << 63) - 1)).alias("age")


def _best(rows: DataFrame, limit: int) -> DataFrame:
    """(viewer_id, ids): the first `limit` candidates of each viewer among rows (viewer_id, candidate_id, age)."""
    first = E.first_by(rows, ["viewer_id"], ["age", "candidate_id"], limit)
    of = F.array_sort(F.collect_list(F.struct("age", "candidate_id")))
    return first.groupBy("viewer_id").agg(F.transform(of, lambda x: x["candidate_id"]).alias("ids"))


def _without_blocked(rows: DataFrame, shut: DataFrame) -> DataFrame:
    return rows.where("viewer_id <> candidate_id").join(shut, ["viewer_id", "candidate_id"], "left_anti")


def _ranges(lists: DataFrame, size: int) -> DataFrame:
    """(list, chunk, ids): ranges of `size` ranks of each list (list, candidate_id, age), with their ids in order."""
    placed = positions(lists, ["list"], [F.col("age"), F.col("candidate_id")]).withColumn("chunk", F.floor(F.col("position") / size))
    of = F.array_sort(F.collect_list(F.struct("age", "candidate_id")))
    return placed.groupBy("list", "chunk").agg(of.alias("members"))


def listed_pools(asks: DataFrame, pool: DataFrame, shut: DataFrame, limit: int) -> DataFrame:
    """(viewer_id, ids) of viewers that ask (viewer_id, list) for one list: everyone's or a city's.

    A viewer with at most SPARE blocks reads one range of limit + SPARE + 1 ranks, and drops its blocked users
    from that array in place. The few others read as many ranges as their own blocks fill.
    """
    size = limit + SPARE + 1
    own = cut(shut.groupBy("viewer_id").agg(F.count("*").alias("shut_n")))
    few = shut.join(own.where(F.col("shut_n") <= SPARE), "viewer_id").groupBy("viewer_id").agg(F.collect_list("candidate_id").alias("shut"))
    many = own.where(F.col("shut_n") > SPARE)
    deep = asks.join(many, "viewer_id")
    any_deep = deep.limit(1).count() > 0
    near = asks.join(many, "viewer_id", "left_anti") if any_deep else asks
    n = parts(pool.sparkSession)
    # by a hash of its own: a partitioning that the join leaves is merged to few tasks by its size
    near = near.join(few, "viewer_id", "left").repartition(n, F.xxhash64("viewer_id"))
    everyone = pool.select(F.lit(EVERYONE).alias("list"), "candidate_id", "age")
    cities = pool.where("place <> ''").select(F.concat(F.lit("c:"), "place").alias("list"), "candidate_id", "age")
    # the first range of everyone's list: its size is fixed by the parameters
    head = everyone.orderBy("age", "candidate_id").limit(size).agg(F.array_sort(F.collect_list(F.struct("age", "candidate_id"))).alias("members"))
    read = [near.where(F.col("list") == EVERYONE).crossJoin(F.broadcast(head))]
    placed = near.where(F.col("list") != EVERYONE)
    ranges = None
    if any_deep or placed.limit(1).count():
        ranges = cut(_ranges(cities.unionByName(everyone) if any_deep else cities, size))
        # a range is copied for every READERS viewers of a city
        copies = placed.groupBy("list").agg(F.ceil(F.count("*") / READERS).cast("int").alias("copies"))
        first = ranges.where("chunk = 0").join(copies, "list").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        readers = placed.join(copies, "list").withColumn("copy", F.pmod(F.xxhash64("viewer_id"), F.col("copies")).cast("int")).drop("copies")
        readers = readers.repartition(n, "list", "copy")
        read.append(readers.join(first.select("list", "copy", "members"), ["list", "copy"]).select(*read[0].columns))
    shut_out = F.array_append(F.coalesce("shut", F.array().cast("array<long>")), F.col("viewer_id"))
    rows = None
    for p in read:
        ids = F.slice(F.array_except(F.transform("members", lambda x: x["candidate_id"]), shut_out), 1, limit)
        p = p.select("viewer_id", ids.alias("ids"))
        rows = p if rows is None else rows.unionByName(p)
    if any_deep:
        last = F.floor((F.col("shut_n") + limit) / size)
        reads = deep.select("viewer_id", "list", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
        met = reads.join(ranges, ["list", "chunk"]).select("viewer_id", F.explode("members").alias("m")).select("viewer_id", "m.*")
        rows = rows.unionByName(_best(_without_blocked(met, shut), limit))
    return rows.where(F.size("ids") > 0)


def radius_pools(asks: DataFrame, pool: DataFrame, shut: DataFrame, limit: int, cell_rows: int | None = None) -> DataFrame:
    """(viewer_id, ids) of viewers (viewer_id, lat, lon, metres): the newest `limit` within each one's radius.

    Each leaf of the grid keeps its users in order of recency. A viewer reads the first ranks of all leaves that its
    circle meets, about twice its limit together, and is done once it has enough candidates newer than
    anyone it hasn't read; else it reads the next range, twice as long. Ranges end with the leaf, so rounds do.
    """
    points, nodes = geo.grid(pool.select(F.col("candidate_id").alias("id"), "lat", "lon", "age"), cell_rows or geo.CELL_ROWS)
    leaf, n = ["level", "code", "salt"], parts(pool.sparkSession)
    # a leaf holds about cell_rows rows at most
    at = F.row_number().over(W.partitionBy(*leaf).orderBy("age", "id")) - 1
    lists = points.select(*leaf, F.col("id").alias("candidate_id"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), "age", at.alias("at"))
    lists = cut(lists.withColumn("chunk", F.floor(F.log2(F.col("at") / FIRST_RANKS + 1)).cast("int")))
    heads = lists.groupBy(*leaf, "chunk").agg(F.min(F.struct("age", "candidate_id")).alias("head"))
    met = geo.touched(asks.select("viewer_id", "lat", "lon", "metres"), nodes)
    met = cut(met.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("n", "salts"))
    # blocks go with their viewer as an array; only those of viewers with very many are joined to what was read
    own = shut.join(asks.select("viewer_id"), "viewer_id", "left_semi").groupBy("viewer_id").agg(F.collect_list("candidate_id").alias("shut"))
    own = cut(own.withColumn("many", F.size("shut") > SPARE))
    few = own.where("NOT many").select("viewer_id", "shut")
    any_many = own.where("many").limit(1).count() > 0
    many = shut.join(own.where("many").select("viewer_id"), "viewer_id", "left_semi") if any_many else None
    share = F.log2(2 * limit / F.col("leaves") / FIRST_RANKS + 1)
    still = met.groupBy("viewer_id").agg(F.count("*").alias("leaves")).select("viewer_id", F.lit(0).alias("from"), F.floor(share).cast("int").alias("upto"))
    held, done = None, []
    while True:
        reads = met.join(still.join(few, "viewer_id", "left"), "viewer_id").withColumn("chunk", F.explode(F.sequence("from", "upto")))
        close = S.distance_km(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) * 1000 <= F.col("metres")
        near = reads.join(lists, [*leaf, "chunk"]).where(close & (F.col("viewer_id") != F.col("candidate_id")))
        near = near.where("shut IS NULL OR NOT array_contains(shut, candidate_id)").select("viewer_id", "candidate_id", "age")
        if any_many:
            near = near.join(many, ["viewer_id", "candidate_id"], "left_anti")
        # rows are shuffled once, into an array for each viewer that keeps the first `limit`
        got = near.repartition(n, "viewer_id").groupBy("viewer_id").agg(_first(F.collect_list(F.struct("age", "candidate_id")), limit))
        if held is not None:
            got = held.join(still, "viewer_id", "left_semi").unionByName(got).groupBy("viewer_id").agg(_first(F.flatten(F.collect_list("members")), limit))
        # the newest that a viewer hasn't read, over its leaves
        unread = met.join(still, "viewer_id").withColumn("chunk", F.col("upto") + 1).join(heads, [*leaf, "chunk"])
        front = unread.groupBy("viewer_id", "upto").agg(F.min("head").alias("front"))
        got = got.join(front, "viewer_id", "full")
        full = F.coalesce((F.size("members") >= limit) & (F.element_at("members", -1) < F.col("front")), F.lit(False))
        got = cut(got.withColumn("open", F.col("front").isNotNull() & ~full).drop("front"))
        done.append(got.where("NOT open").select("viewer_id", "members"))
        held = got.where("open AND members IS NOT NULL").select("viewer_id", "members")
        still = got.where("open").select("viewer_id", (F.col("upto") + 1).alias("from"), (F.col("upto") + 1).alias("upto"))
        if not still.limit(1).count():
            rows = done[0]
            for d in done[1:]:
                rows = rows.unionByName(d)
            return rows.select("viewer_id", F.col("members")["candidate_id"].alias("ids")).repartition(n, "viewer_id")


def _first(members: Column, limit: int) -> Column:
    return F.slice(F.sort_array(members), 1, limit).alias("members")


def pools(viewers: DataFrame, users: DataFrame, settings: DataFrame, blocks: DataFrame, limit: int = POOL, near: bool = False) -> DataFrame:
    """(viewer_id, ids): up to `limit` candidates of each viewer, most recently seen first, ties by id.

    With near, viewers that ask for their city or for a radius get candidates from there. Blocks count in both
    directions; invisible users, bots and banned ones are no candidates. Viewers without a candidate have no row.
    """
    hidden = settings.where("visible = false").select(F.col("user_id").alias("id"))
    place = F.lower(F.trim("city")).alias("place")
    pool = eligible(users).join(hidden, "id", "left_anti").select(F.col("id").alias("candidate_id"), age(), place, "lat", "lon")
    shut = symmetric_blocks(blocks)
    who = viewers.select(F.col("id").alias("viewer_id"))
    if not near:
        return listed_pools(who.withColumn("list", F.lit(EVERYONE)), pool, shut, limit)
    mode, metres = S.proximity_mode(F.col("into_proximity")).alias("mode"), S.proximity_metres(F.col("into_proximity")).alias("metres")
    asks = cut(who.join(users.select(F.col("id").alias("viewer_id"), mode, metres, place, "lat", "lon"), "viewer_id"))
    of = F.when(F.col("mode") == "any", EVERYONE).when((F.col("mode") == "city") & (F.col("place") != ""), F.concat(F.lit("c:"), "place"))
    rows = listed_pools(asks.select("viewer_id", of.alias("list")).where("list IS NOT NULL"), pool, shut, limit)
    circles = asks.where("mode = 'radius'")
    return rows.unionByName(radius_pools(circles, pool, shut, limit)) if circles.limit(1).count() else rows


def eligible_candidates(viewers: DataFrame, users: DataFrame, settings: DataFrame, blocks: DataFrame, limit: int = POOL, located: bool = False) -> DataFrame:
    """(viewer_id, candidate_id, pool_rank): the pools as rows."""
    each = pools(viewers, users, settings, blocks, limit, located).select("viewer_id", F.posexplode("ids").alias("pos", "candidate_id"))
    return each.select("viewer_id", "candidate_id", (F.col("pos") + 1).alias("pool_rank"))
