"""Readers, writers and manifests of pair datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType


CORRUPT = "_corrupt_record"


def _lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(value, file, block, id, row): each line that isn't blank, parsed; id grows with the lines of a block of a file."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    kept = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    return text.withColumn("row", F.when(F.trim("value") != "", F.from_json("value", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})))


def line_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(file, rows, corrupt, line): of each file the lines with a row, the malformed ones and the number of the first of these.

    A block's lines have consecutive ids; what lies in earlier blocks of the file is added, a sum over a row for each block.
    """
    bad = F.col(f"row.{CORRUPT}").isNotNull()
    blocks = _lines(spark, path, schema).groupBy("file", "block").agg(
        F.min("id").alias("first"), F.count("*").alias("lines"), F.count("row").alias("rows"), F.count_if(bad).alias("corrupt"), F.min(F.when(bad, F.col("id"))).alias("bad")
    )
    before = F.coalesce(F.sum("lines").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = blocks.withColumn("line", before + F.col("bad") - F.col("first") + 1)
    return at.groupBy("file").agg(F.sum("rows").alias("rows"), F.sum("corrupt").alias("corrupt"), F.min("line").alias("line"))


def read_pairs_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank ones are skipped. A malformed line is an error that names its file and number, or kept in _corrupt_record when not strict."""
    if strict:
        # the first malformed file, if any
        wrong = line_report(spark, path, schema).where("corrupt > 0").orderBy("file").limit(1).collect()
        if wrong:
            raise ValueError(f"{wrong[0].file}, line {wrong[0].line}: not a row of the schema ({wrong[0].corrupt} such lines in this file)")
    rows = _lines(spark, path, schema).where("row IS NOT NULL").select("row.*")
    return rows.drop(CORRUPT) if strict else rows


def write_pairs(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """A dataset partitioned by cutoff; the committer replaces it as a whole."""
    rows.withColumn("cutoff", F.date_format("cutoff_at", "yyyy-MM-dd")).write.mode("overwrite").partitionBy("cutoff").format(form).save(path)


def dataset_manifest(rows: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """One row: rows, sorted distinct cutoffs, viewers, candidates, hard exclusions if rows have them, and the counts of evidence (one row) if given."""
    cutoffs = F.array_join(F.array_sort(F.transform(F.collect_set("cutoff_at"), lambda x: x.cast("string"))), ",")  # dozens of values
    hard = [F.count_if("hard_exclusion").alias("hard_excluded")] if "hard_exclusion" in rows.columns else []
    one = rows.agg(F.count("*").alias("n_rows"), cutoffs.alias("cutoffs"), F.count_distinct("viewer_id").alias("viewers"), F.count_distinct("candidate_id").alias("candidates"), *hard)
    return one if evidence is None else one.crossJoin(evidence)
