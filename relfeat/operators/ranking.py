"""Global order statistics without a single-task window.

``Window.orderBy`` with no partition puts every row in one task.  Here rows are range
partitioned on the order key, each partition computes local running sums, the per-partition
totals (one row per partition: metadata-sized) give each partition its offset, and one
broadcast join adds it; of groups only those that go on in a further partition have one.  The range-partitioned frame is checkpointed to the cluster's
checkpoint directory first, so partition ids stay stable if tasks are retried.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_prefix_sums(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str],
                          group_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``<v>_before`` = sum of ``v`` over rows strictly earlier in ``order_cols`` order
    (within ``group_col`` if given).  ``order_cols`` must be unique per group."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ([group_col] if group_col else []) + list(order_cols)
    d = df.repartitionByRange(n, *keys).withColumn("__pid", F.spark_partition_id())
    d = d.checkpoint(eager=True)
    gkeys = ["__pid"] + ([group_col] if group_col else [])
    tot = d.groupBy(*gkeys).agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    w_all = (Window.partitionBy(group_col) if group_col else Window.partitionBy(F.lit(0))).orderBy("__pid")
    w_off = w_all.rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*gkeys, F.row_number().over(w_all).alias("__nth"), *[F.coalesce(F.sum(f"__t_{v}").over(w_off), F.lit(0)).alias(f"__o_{v}") for v in value_cols])
    offs = offs.where("__nth > 1").drop("__nth")  # ranges: fewer rows than partitions
    w_loc = Window.partitionBy(*gkeys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    local = d.select("*", *[F.coalesce(F.sum(v).over(w_loc), F.lit(0)).alias(f"__l_{v}") for v in value_cols])
    out = local.join(F.broadcast(offs), gkeys, "left")
    offset = {v: F.coalesce(f"__o_{v}", F.lit(0)) for v in value_cols}
    if group_col:  # rows of no group have no place
        offset = {v: F.when(F.col(group_col).isNotNull(), c) for v, c in offset.items()}
    return out.select(*df.columns, *[(offset[v] + F.col(f"__l_{v}")).alias(f"{v}_before") for v in value_cols])


def dense_codes(values: DataFrame, group_col: str, value_col: str, base: DataFrame | None = None,
                bounded_rows: int | None = None) -> DataFrame:
    """0-based dense rank of each distinct ``value_col`` within ``group_col`` (ascending,
    binary string order), optionally starting after a per-group ``base.offset``.

    ``bounded_rows``: a proven bound on the input rows; up to a million, a plain
    ``dense_rank`` per group is used (one small task per group, no extra jobs)."""
    if bounded_rows is not None and bounded_rows <= 1_000_000:
        r = values.select(group_col, value_col).distinct().withColumn(
            "code", F.dense_rank().over(Window.partitionBy(group_col).orderBy(value_col)) - 1)
    else:
        d = values.select(group_col, value_col).distinct().withColumn("__one", F.lit(1))
        r = exclusive_prefix_sums(d, [value_col], ["__one"], group_col=group_col)
        r = r.withColumnRenamed("__one_before", "code").drop("__one")
    if base is not None:
        r = r.join(F.broadcast(base), group_col, "left").select(
            group_col, value_col, (F.col("code") + F.coalesce(F.col("offset"), F.lit(0))).alias("code"))
    return r.select(group_col, value_col, F.col("code").cast("long").alias("code"))


#: Split points a group of ``planned_codes``, and characters of each.
SPLITS, SPLIT_CHARS = 512, 256


def planned_codes(values: DataFrame, group_col: str, value_col: str, base: DataFrame) -> DataFrame:
    """As ``dense_codes``, for strings, but as one plan: no job runs before the caller's action and
    nothing is checkpointed.  ``values`` holds distinct (group, value) rows; ``base`` one row a
    group with the ``offset`` its codes start from (none: 0).

    The values with the ``SPLITS`` smallest hashes of a group are a uniform sample of it and cut
    it into ranges; each range is numbered by itself and starts after the ranges before it.  A
    range holds about 1 / SPLITS of its group whatever the values are, unless very many share
    their first ``SPLIT_CHARS`` characters.  Splits depend on the values alone, so a task that runs
    again gives the same codes.  Through the driver pass the splits (at most SPLITS * SPLIT_CHARS
    characters a group) and a number a range."""
    def by_group(df: DataFrame, value) -> Column:  # one map of all groups, as a scalar subquery
        rows = df.groupBy(group_col).agg(value.alias("__of_group"))
        return rows.agg(F.map_from_entries(F.collect_list(F.struct(group_col, "__of_group")))).scalar()

    v = values.select(group_col, value_col)
    first = Window.partitionBy(group_col).orderBy(F.xxhash64(value_col), value_col)
    sample = v.withColumn("__p", F.row_number().over(first)).where(F.col("__p") <= SPLITS)
    splits = by_group(sample, F.array_sort(F.collect_list(F.substring(value_col, 1, SPLIT_CHARS))))
    ranged = v.withColumn("__splits", splits[F.col(group_col)]).select(
        group_col, value_col, F.size(F.filter("__splits", lambda s: s <= F.col(value_col))).alias("__range"))
    before = Window.partitionBy(group_col).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(group_col, "__range").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(group_col, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    sizes = sizes.join(base.select(group_col, "offset"), group_col, "left")
    starts = by_group(sizes, F.map_from_entries(F.collect_list(F.struct("__range", (F.col("__start") + F.coalesce("offset", F.lit(0)))))))
    inside = F.row_number().over(Window.partitionBy(group_col, "__range").orderBy(value_col)) - 1
    start = starts[F.col(group_col)][F.col("__range")]
    return ranged.select(group_col, value_col, (start + inside).cast("long").alias("code"))
