"""Readers and lineage cuts shared by the document operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract here: space and 0x09 to 0x0D.
SPACES = "[\\x20\\x09-\\x0D]+"
_own: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key and the text of every document; the only columns that most operators read."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one of our own only where none is named and Spark is one process, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="dyadlake-"))
    return _own[0]


def cut(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(col) -> F.Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), SPACES), "")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b).

    Alternating large-star and small-star steps, each a minimum per node and a join, so that a hub
    with a third of all edges is a skewed join at worst and never a collected group. Null ends
    are dropped, loops and repeated edges change nothing, no edges give no rows.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null").distinct())
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # every node keeps a link to its own minimum, so no node falls out
        large = large.union(low.where("m <> u").select("u", F.col("m").alias("v"))).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.union(down.select("u", F.col("m").alias("v"))).distinct()
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no fixpoint; raise max_rounds")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti")
    )
