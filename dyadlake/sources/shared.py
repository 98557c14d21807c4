"""The folder that the cluster shares: written intermediate tables that end a lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 500_000  # rows that a join may send to every executor

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where none is named and everything runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="dyadlake-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    """Tasks for work that is large for its bytes: an explicit number, which is not merged by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, written, with a hint to broadcast it if it has at most so many rows; a larger one is joined by a shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
