"""Quality classifier: supervised subword embeddings with a softmax over two classes.

The model is fitted on at most max_train labelled documents, chosen by a hash of their key; every document
is scored on its whole text. Labels of held-out rows (crc32 of the key as text divisible by 5) are
never read; language, source and key are never inputs.

Defined results: null and blank texts have the score of the bias; rows with a null doc_id are held
out and scored; repeated rows are scored alike and, of several texts under a doc_id, one is learned from (the least by hash); labels that are null are not learned from; without any
label the score is 0.5; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadlake.llm import common, subword

MAX_TRAIN = 3000
CUT = 0.3


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN):
    """The model learned from documents with labels (doc_id, quality) that are not held out."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # at most max_train rows of two numbers
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", F.col("quality").alias("label")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # texts stay in tasks; the driver gets at most max_train bags
    rows = sorted(texts.mapInPandas(subword.bag_rows, "doc_id long, label long, buckets binary, shares binary").collect(), key=lambda r: r.doc_id)
    if not rows:
        return np.zeros((subword.BUCKETS, 2), np.float32), np.zeros(2)
    return subword.train(subword.unpacked(rows), [int(r.label > 0) for r in rows], 2)


def scored(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score): how likely label 1 is."""
    table, bias = model

    def run(batches):
        for batch in batches:
            z = subword.scores([t or "" for t in batch.column("text").to_pylist()], table, bias)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(subword.softmax(z)[:, 1] if len(z) else [], pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op4_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def filtered(docs: DataFrame, model, least: float = CUT) -> DataFrame:
    """The rows of docs, all columns as they are, whose text scores least or more."""
    table, bias = model

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(subword.softmax(subword.scores([t or "" for t in text], table, bias))[:, 1], dtype="float64")

    return docs.where(score(F.col("text")) >= least)
