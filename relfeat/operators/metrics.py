"""Evaluation (M1-M3), distributed: no score column is collected."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import exclusive_prefix_sums


def roc_auc(df: DataFrame, label_col: str, score_col: str, positive=1) -> DataFrame:
    """M1, exact: Mann-Whitney U with half credit for ties, over the positive-class score.

    One grouped pass gives (score, positives, negatives) per distinct score; negatives
    ranked below each score come from range-partitioned prefix sums (no single-task
    window).  Returns one row ``auc`` (null when a class is missing)."""
    g = (df.where(F.col(label_col).isNotNull() & F.col(score_col).isNotNull())
         .groupBy(F.col(score_col).cast("double").alias("__s"))
         .agg(F.sum(F.when(F.col(label_col) == F.lit(positive), 1).otherwise(0)).cast("long").alias("pos"),
              F.sum(F.when(F.col(label_col) == F.lit(positive), 0).otherwise(1)).cast("long").alias("neg")))
    r = exclusive_prefix_sums(g, ["__s"], ["neg"])
    tot = r.agg((F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") * F.lit(0.5)))).alias("u"),
                F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return tot.select(F.when((F.col("p") > 0) & (F.col("n") > 0),
                             F.col("u") / (F.col("p").cast("double") * F.col("n").cast("double"))).alias("auc"))


def mean_absolute_error(df: DataFrame, label_col: str, pred_col: str) -> DataFrame:
    """M2: mean of |y - prediction| over rows where both are present (one partial aggregate)."""
    d = F.abs(F.col(label_col).cast("double") - F.col(pred_col).cast("double"))
    return df.agg(F.avg(d).alias("mae"))


METRICS = {"auc": roc_auc, "auroc": roc_auc, "roc_auc": roc_auc, "mae": mean_absolute_error,
           "mean_absolute_error": mean_absolute_error}


def metric_by_name(name: str):
    """M3: metric function for a task's ``evaluation_metric`` name."""
    key = (name or "").lower()
    if key not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {sorted(METRICS)}")
    return METRICS[key]
