"""Input tables: read from a folder, or projected from the driver's star schema by fixed integer rules."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

WORDS = ["Alpha", "bravo", "Charlie", "delta", "Echo", "foxtrot", "Golf", "hotel"]
#: Multiplier of each array column.
ARRAYS = {"body_hair": 1, "my_types": 3, "my_fetishes": 5, "into_age_ranges": 7, "into_height_ranges": 2, "into_weight_ranges": 4, "into_body_types": 6, "into_body_hair": 9, "into_types": 11, "into_fetishes": 13}
BODY_TYPES = ["Slim", "athletic", None, "Average", "stocky", "Large"]
RELATIONSHIPS = ["single", "Partnered", None, "Open"]
PRONOUNS = ["he/him", "they/them", None]
PROXIMITY = ["Any", "", "Same city", "Same neighborhood", "Within 25 miles", "within 300 mile", "On request"]


def load_sources(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The application tables of a folder by name."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def _pick(values: list, index: str) -> str:
    listed = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"element_at(array({listed}), CAST({index} AS INT) + 1)"


def _values(mult: int) -> str:
    one = f"element_at(array({', '.join(repr(w) for w in WORDS)}), CAST((c * {mult} + i * 3) % 8 AS INT) + 1)"
    cased = f"IF((c + i) % 2 = 0, upper({one}), {one})"
    some = f"transform(sequence(0L, c % 3), i -> {cased})"
    return f"CASE WHEN c % 9 = 0 THEN NULL WHEN c % 8 = 0 THEN CAST(array() AS ARRAY<STRING>) WHEN c % 7 = 0 THEN array_append({some}, ' ') ELSE {some} END"


class Inputs:
    """The projection of the driver's tables; every table is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, *cols: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet").select(*cols)

    @cached_property
    def raw(self) -> DataFrame:
        return self._read("events", "event_id", "user_id", "props", "event_type", "ts").selectExpr("event_id AS n", "user_id + 1 AS a", "CAST(get_json_object(props, '$.k') AS BIGINT) + 1 AS b", "event_type AS e", "CAST(ts AS TIMESTAMP_NTZ) AS ts")

    def _kind(self, kind: str, rest: str) -> DataFrame:
        return self.raw.where(f"e = '{kind}' AND n % 3 IN ({rest})")

    @cached_property
    def users(self) -> DataFrame:
        c = self._read("customer", "c_custkey", "c_mktsegment", "c_nationkey").withColumnRenamed("c_custkey", "c")
        lat = "-60 + 5 * c_nationkey + (c % 100) * 0.01D"
        lon = "-150 + 12 * c_nationkey + (c % 90) * 0.01D"
        return c.selectExpr(
            "c + 1 AS id", "c % 50 = 7 AS is_bot", "c % 60 = 11 AS is_banned",
            "IF(c % 17 = 0, NULL, date_add(DATE'1955-01-01', CAST(c * 37 % 18000 AS INT))) AS date_of_birth",
            """CASE c % 5 WHEN 0 THEN concat(5 + c % 2, "'", c % 12, '"') WHEN 1 THEN CAST(60 + c % 30 AS STRING) WHEN 2 THEN 'tall' WHEN 3 THEN concat("5'", c % 14) END AS height""",
            "IF(c % 19 = 0, NULL, CAST(110 + c * 13 % 200 AS DOUBLE)) AS weight",
            f"{_pick(RELATIONSHIPS, 'c % 4')} AS relationship_status", f"{_pick(PRONOUNS, 'c % 3')} AS pronouns",
            "IF(c % 2 = 0, upper(c_mktsegment), concat(lower(c_mktsegment), ' ')) AS position",
            f"{_pick(BODY_TYPES, 'c % 6')} AS body_type",
            *(f"{_values(m)} AS {name}" for name, m in ARRAYS.items()),
            "IF(c % 10 = 0, NULL, IF(c % 3 = 0, 'BUILDING', 'machinery')) AS into_position",
            f"{_pick(RELATIONSHIPS, '(c + 1) % 4')} AS into_relationship_status", f"{_pick(PROXIMITY, 'c % 7')} AS into_proximity",
            f"IF(c % 13 = 0, NULL, {lat}) AS lat", f"IF(c % 13 = 0, NULL, {lon}) AS lon",
            f"IF(c % 26 = 0, {lat}, NULL) AS home_lat", f"IF(c % 26 = 0, {lon}, NULL) AS home_lon",
            "CASE WHEN c % 15 = 0 THEN NULL WHEN c % 2 = 1 THEN upper(concat('City ', c_nationkey)) ELSE concat('City ', c_nationkey) END AS city",
            "CAST('2022-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(c * 101 % 800 AS INT)) AS created_at",
            "IF(c % 29 = 0, NULL, CAST('2024-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(0, 0, CAST(c * 7919 % 43200 AS INT))) AS last_seen_at",
        )

    @cached_property
    def user_settings(self) -> DataFrame:
        return self._read("customer", "c_custkey").withColumnRenamed("c_custkey", "c").where("c % 6 <> 5").selectExpr("c + 1 AS user_id", "CAST(50 + c * 7 % 500 AS DOUBLE) AS max_distance_km", "CAST(18 + c % 20 AS INT) AS min_age", "CAST(28 + c % 20 + c % 30 AS INT) AS max_age", "IF(c % 41 = 0, NULL, c % 40 <> 3) AS visible")

    @cached_property
    def user_images(self) -> DataFrame:
        p = self._read("part", "p_partkey", "p_size").withColumnRenamed("p_partkey", "p")
        made = "CAST('2023-12-01' AS TIMESTAMP_NTZ) + make_dt_interval(p_size)"
        return p.selectExpr("p AS id", "p % 100 + 1 AS user_id", "IF(p_size % 7 = 0, NULL, p_size % 2 = 0) AS is_public", "p_size % 5 = 0 AS is_avatar", f"IF(p % 3 = 0, NULL, {made} + INTERVAL '2' DAY) AS descriptor_processed_at", f"{made} AS created_at")

    @cached_property
    def user_stories(self) -> DataFrame:
        return self._read("part", "p_partkey").selectExpr("p_partkey AS id", "p_partkey % 100 + 1 AS user_id")

    @cached_property
    def messages(self) -> DataFrame:
        return self._kind("purchase", "0").selectExpr("n AS id", "least(a, b) * 10000 + greatest(a, b) AS conversation_id", "IF(n % 37 = 0, NULL, a) AS sender_user_id", "ts AS created_at", "IF(n % 23 = 0, ts, NULL) AS deleted_at", "a", "b")

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        """All input tables by name."""
        item = "(b - 1) + 100 * (n % 2)"
        m = self.messages
        first = m.where("sender_user_id IS NOT NULL").groupBy("sender_user_id").agg({"id": "min"}).withColumnRenamed("min(id)", "message_id")
        reacts = self._kind("purchase", "1")
        stories = self._kind("signup", "2").selectExpr("a AS from_user_id", f"{item} AS story_id", "IF(n % 2 = 0, NULL, 'like') AS kind", "ts AS created_at").union(self._kind("error", "0").selectExpr("a", item, "'reply'", "ts"))
        return {
            "users": self.users, "user_settings": self.user_settings, "user_images": self.user_images, "user_stories": self.user_stories,
            "user_profile_views": self._kind("view", "0, 1").selectExpr("a AS viewer_user_id", "b AS owner_user_id", "ts AS created_at"),
            "story_views": self._kind("view", "2").selectExpr("a AS viewer_user_id", f"{item} AS story_id", "ts AS viewed_at"),
            "user_favorites": self._kind("click", "0").selectExpr("a AS from_user_id", "b AS to_user_id", "ts AS created_at"),
            "user_pokes": self._kind("click", "1").selectExpr("a AS from_user_id", "b AS to_user_id", "ts AS created_at"),
            "image_reactions": self._kind("click", "2").selectExpr("a AS from_user_id", f"{item} AS image_id", "ts AS created_at"),
            "messages": m.drop("a", "b"),
            "conversations": m.selectExpr("conversation_id AS id").distinct().selectExpr("id", "IF(id % 11 = 0, 'group', 'dm') AS type"),
            "conversation_participants": m.selectExpr("conversation_id", "explode(array(a, b)) AS user_id").distinct(),
            "message_reactions": reacts.join(first, reacts["b"] == first["sender_user_id"]).selectExpr("a AS user_id", "message_id", "ts AS created_at"),
            "user_private_album_access": self._kind("purchase", "2").selectExpr("a AS owner_user_id", "b AS viewer_user_id", "ts AS granted_at"),
            "partner_requests": self._kind("signup", "0, 1").selectExpr("a AS requester_user_id", "b AS target_user_id", "IF(n % 3 = 0, 'pending', 'accepted') AS status", "ts AS created_at", "IF(n % 3 = 1, ts + INTERVAL '1' DAY, NULL) AS responded_at"),
            "story_reactions": stories,
            "user_blocks": self._kind("error", "1").selectExpr("a AS blocker_user_id", "b AS blocked_user_id", "ts AS created_at"),
            "support_reports": self._kind("error", "2").selectExpr("a AS reporter_user_id", "IF(n % 10 = 0, NULL, b) AS reported_user_id", "ts AS created_at"),
            "subscriptions": self._read("customer", "c_custkey").withColumnRenamed("c_custkey", "c").where("c % 3 = 0").selectExpr("c + 1 AS user_id", "IF(c % 2 = 0, 'Plus', 'basic') AS plan", "element_at(array('active', 'Trialing', 'canceled', 'past_due'), CAST(c % 4 AS INT) + 1) AS status", "IF(c % 6 = 0, NULL, CAST('2024-01-15' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(c % 40 AS INT))) AS expires_at"),
            "suggestion_batches": self._read("customer", "c_custkey").withColumnRenamed("c_custkey", "c").where("c % 8 = 3").selectExpr("c + 1 AS viewer_id", "IF(c % 3 = 0, 'building', 'ready') AS status", "CAST('2024-01-30' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(c % 5 AS INT) - 2) AS expires_at"),
            "plus_access_grants": self._read("customer", "c_custkey").withColumnRenamed("c_custkey", "c").where("c % 10 = 1").selectExpr("c + 1 AS user_id", "CAST('2024-01-01' AS TIMESTAMP_NTZ) + make_dt_interval(CAST(c % 45 AS INT)) AS started_at", "IF(c % 30 = 1, CAST('2024-01-20' AS TIMESTAMP_NTZ), NULL) AS revoked_at", "CAST(NULL AS TIMESTAMP_NTZ) AS expires_at"),
        }
