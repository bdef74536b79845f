"""Connected components of an undirected graph, on Spark.

Each round every vertex takes the smallest label among its own and its neighbours', then the label
of its label (pointer jumping), so long chains shorten by halves.  Rounds write a checkpoint, so
lineage stays short and lost executors cost one round.  Grouping by vertex aggregates partially,
and joins are on vertices, where adaptive execution splits hot keys.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def free_finished_rounds(spark: SparkSession) -> None:
    """Let the driver collect its garbage: only then does Spark delete shuffle and checkpoint
    files, and broadcasts, that no frame refers to any more; and the driver's heap stays small."""
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``edges``: (a, b) of longs.  Returns (id, component): the smallest id that each vertex
    reaches, for every vertex of an edge."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")).checkpoint()
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.min("component").alias("low"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", "component", F.least("component", "low").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("jump"))
        step = step.join(up, "next").select("id", "component", F.least("next", "jump").alias("next")).checkpoint()
        moved = step.where(F.col("next") != F.col("component")).limit(1).count()
        labels = step.select("id", F.col("next").alias("component"))
        free_finished_rounds(edges.sparkSession)
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
