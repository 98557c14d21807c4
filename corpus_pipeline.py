"""A training corpus from documents, in five stages that each work on what the one before kept.

The order: the quality classifier drops documents that it rejects, MinHash keeps one document of each
near-duplicate group, decontamination drops documents that hold a benchmark passage, the secret scan
replaces secrets in the texts, and SentencePiece encoding samples segmentations of what is left.
Every stage but the last returns the columns of documents; each result is written as Parquet and
reread. Rows with a null doc_id pass the filters that need a key; empty tables pass all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dyadlake.llm import common, decontaminate, minhash, quality, secrets, segmentations

#: Near-duplicate stages take five words and a similarity of 0.8.
NEAR = {"n": 5, "num": 80, "den": 100}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of this stage's input, predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs.select("doc_id", "text"), labels)
    return quality.filtered(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest doc_id, then hash of the text; texts without words and null keys stay."""
    found = common.cut(minhash.near_duplicates(docs, **NEAR).where("component_id is not null"))
    least = found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "mark")).alias("least"))
    gone = found.join(least, "group").where("struct(doc_id, mark) <> least").select("doc_id", "mark").distinct()
    mark = next(name for i in range(len(docs.columns) + 1) if (name := f"mark{i}") not in docs.columns)
    kept = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark"))
    kept = kept.join(gone, (kept["doc_id"] == gone["_gone"]) & (kept[mark] == gone["_mark"]), "left_anti")
    if found.groupBy("doc_id", "mark").count().where("count > 1").limit(1).count():  # rows that repeat others as a whole
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", mark]).unionByName(kept.where("doc_id is null"))
    return kept.select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti").select(*docs.columns)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced."""
    found = secrets.scan(docs, out="_secrets")
    text = secrets.redacted(F.col("text"), F.col("_secrets"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct segmentations of every document."""
    return segmentations.encoded(docs, segmentations.model_path()).select("doc_id", "sample", "ids", "log_prob", "inclusion")


STAGES = [
    ("quality classifier", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("secret scan", secrets_stage),
    ("encoding", encoding_stage),
]

#: SQL has no trained embeddings or sampled segmentations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = f"{common.shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
