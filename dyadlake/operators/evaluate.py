"""Metrics of scored rows (viewer_id, candidate_id, target, label, score), exact and in one plan per family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadlake.operators.order import running_sums

#: Targets whose rates among the shown rows are reported.
TRACKED = ["favorite", "message_started", "reciprocal_message", "block", "report"]


def unpivoted(rows: DataFrame, targets: list[str]) -> DataFrame:
    """A row for each target of rows with outcome_ and p_ columns."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("target"), F.col(f"outcome_{t}").cast("int").alias("label"), F.col(f"p_{t}").alias("score")) for t in targets)))
    return rows.select("cutoff_at", "viewer_id", "candidate_id", each.alias("t")).select("cutoff_at", "viewer_id", "candidate_id", "t.*")


def binary_metrics(rows: DataFrame) -> DataFrame:
    """Counts, rate, accuracy, precision and recall at 0.5 of each target; null over zero."""
    hit, pos = F.col("score") >= 0.5, F.col("label") == 1
    part = lambda a, b: F.when(b > 0, a / b)
    n, p, tp = F.count("*"), F.count_if(pos), F.count_if(hit & pos)
    return rows.groupBy("target").agg(n.alias("n_rows"), p.alias("positives"), (p / n).alias("positive_rate"), (F.count_if(hit == pos) / n).alias("accuracy"), part(tp, F.count_if(hit)).alias("precision"), part(tp, p).alias("recall"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Rank-sum AUC with mean ranks for ties: rows are folded to distinct scores, which are ranked over range partitions."""
    fold = rows.groupBy("target", "score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    ranked = running_sums(fold, ["target"], [F.desc("score")], ["n"])
    worse = F.col("n_upto") - F.col("n") + (F.col("n") + 1) / 2  # mean rank from the top
    out = ranked.groupBy("target").agg(F.sum(F.col("p") * worse).alias("s"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    total = F.col("p") * (F.col("n") + 1) - F.col("s")
    auc = (total - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * (F.col("n") - F.col("p")))
    return out.select("target", F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), auc).alias("auc"))


def average_precision(rows: DataFrame) -> DataFrame:
    """Mean precision at the positives; ties in order of viewer and candidate. Rows are ranked over range partitions."""
    rows = rows.select("target", "viewer_id", "candidate_id", "score", "label", F.lit(1).alias("n"))
    run = running_sums(rows, ["target"], [F.desc("score"), F.col("viewer_id"), F.col("candidate_id")], ["n", "label"])
    precision = F.sum(F.when(F.col("label") == 1, F.col("label_upto") / F.col("n_upto")))
    return run.groupBy("target").agg((precision / F.when(F.sum("label") > 0, F.sum("label"))).alias("average_precision"))


def ranking_metrics(rows: DataFrame, k: int = 20) -> DataFrame:
    """NDCG, precision and recall at k, averaged over the viewers that define them; rates of tracked outcome_ columns among all rows in a top k."""
    tracked = [t for t in TRACKED if f"outcome_{t}" in rows.columns]
    w = W.partitionBy("viewer_id").orderBy(F.desc("score"), "candidate_id")
    ranked = rows.withColumn("r", F.row_number().over(w))
    top = F.col("r") <= k
    per = ranked.groupBy("viewer_id").agg(F.sum("label").alias("p"), F.sum(F.when(top, F.col("label"))).alias("hits"), F.count_if(top).alias("shown"), F.sum(F.when(top, F.col("label") / F.log2(F.col("r") + 1))).alias("dcg"), *(F.count_if(top & F.col(f"outcome_{t}")).alias(f"n_{t}") for t in tracked))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("p"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    some = F.col("p") > 0
    return per.agg(F.count("*").alias("viewers"), F.avg(F.when(some, F.col("dcg") / F.when(some, ideal))).alias("ndcg"), F.avg(F.col("hits") / F.col("shown")).alias("precision"), F.avg(F.when(some, F.col("hits") / F.col("p"))).alias("recall"), *((F.sum(f"n_{t}") / F.sum("shown")).alias(f"{t}_rate") for t in tracked))


def weighted_logloss(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Binary cross-entropy of each target with its positive weight (target, pos_weight)."""
    p = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("score")))
    loss = -(F.col("pos_weight") * F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    return rows.join(F.broadcast(weights), "target").groupBy("target").agg(F.avg(loss).alias("logloss"))
