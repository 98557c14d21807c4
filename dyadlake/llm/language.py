"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

At most per_language documents of each language are learned from; a fifth of them is set aside to fit a
temperature, so that the score is a calibrated probability, and to place the rejection threshold where
99 % of correct predictions are kept. Rows whose crc32 of the key modulo 3 is 1 are never learned from.

Defined results: null texts and texts without a letter give "und" and score 0; rows with a null doc_id are
held out; ties go to the first language in order; with nothing to learn from all is "und"; an empty
table gives an empty table; other columns are not read. Texts are scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadlake.llm import common, subword

PER_LANGUAGE = 500
PARTS = 8
_LETTER = regex.compile(r"\p{L}")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE):
    """(languages, table, bias, temperature, threshold) from docs (doc_id, text, lang)."""
    known = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out()).select("doc_id", "lang").distinct().withColumn("part", F.pmod(F.hash("doc_id"), F.lit(PARTS)))

    def first(rows: DataFrame, *by: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
        return rows.withColumn("r", rank).where(F.col("r") <= per_language).drop("r")

    # the first of a language are among the first of its parts, so no task ranks a whole language
    chosen = first(first(known, "lang", "part"), "lang").drop("part")
    # at most per_language keys of each language; texts stay in tasks, the driver gets their bags
    texts = docs.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"], "left_semi").groupBy("doc_id", F.col("lang").alias("label")).agg(F.lower(F.min_by("text", F.xxhash64("text"))).alias("text"))
    rows = sorted(texts.mapInPandas(subword.bag_rows, "doc_id long, label string, buckets binary, shares binary").collect(), key=lambda r: (r.doc_id, r.label))
    langs = sorted({r.label for r in rows})
    if not langs:
        return [], np.zeros((subword.BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0
    bags, y = subword.unpacked(rows), np.array([langs.index(r.label) for r in rows])
    aside = np.arange(len(rows)) % 5 == 4
    table, bias = subword.train([bags[i] for i in np.flatnonzero(~aside)], [int(k) for k in y[~aside]], len(langs))
    if not aside.any():
        return langs, table, bias, 1.0, 0.0
    z = subword.bag_scores([bags[i] for i in np.flatnonzero(aside)], table, bias)
    goal = y[aside]
    loss = {t: -np.log(subword.softmax(z / t)[np.arange(len(goal)), goal] + 1e-12).mean() for t in 2.0 ** np.arange(-3, 4.1, 0.25)}
    heat = min(loss, key=loss.get)
    p = subword.softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == goal]
    return langs, table, bias, heat, float(np.quantile(right, 0.01)) if len(right) else 0.0


def predicted(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) of every document."""
    langs, table, bias, heat, least = model

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ok = np.array([bool(langs) and bool(_LETTER.search(t)) for t in texts], bool)
            p = subword.softmax(subword.scores([t.lower() for t in texts], table, bias) / heat) if langs and texts else np.zeros((len(texts), 1))
            score = np.where(ok, p.max(axis=1), 0.0)
            best = [langs[k] if o else "und" for o, k in zip(ok, p.argmax(axis=1), strict=True)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(ok & (score >= least), pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predicted(docs, fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
