"""Aggregates over rows whose features change with time, without meeting rows and cutoffs.

Between two changes a row's features are constant, so each row is a sequence of spans: from the
first of its key's cutoffs that sees a state to the first that sees the next one.  Cutoffs of a key
are numbered by time; a span is a range ``[first, last)`` of numbers.  Every range is the union of
at most ``2 log2(m)`` nodes of the binary tree over the numbers, and a cutoff lies in one node of
each height.  So spans are aggregated per node (map-side first: no task needs a key's rows
together) and a cutoff merges the at most ``log2(m) + 1`` nodes above it.  Sums, counts, extremes
and moments merge exactly as over the rows themselves; nothing is ever subtracted.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import exclusive_prefix_sums


def _shift(name: str, c, by: Column) -> Column:
    return F.call_function(name, c, by)


def nodes_of(first: Column, last: Column) -> Column:
    """Array of (height, node): node ``n`` of height ``h`` covers ``[n 2**h, (n + 1) 2**h)``; together
    they cover ``[first, last)``, for ``last > first >= 0``, once."""
    def at(h: Column) -> Column:
        low = _shift("shiftright", first + _shift("shiftleft", F.lit(1).cast("long"), h) - 1, h)   # first, rounded up
        high = _shift("shiftright", last, h)                                                      # last, rounded down
        own = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))
        return F.transform(F.filter(own, lambda n: n.isNotNull()), lambda n: F.struct(h.alias("height"), n.alias("node")))
    return F.flatten(F.transform(_heights(last), at))


def nodes_above(number: Column, count: Column) -> Column:
    """Array of (height, node): the nodes that hold ``number`` in the tree over ``count`` numbers."""
    return F.transform(_heights(count), lambda h: F.struct(h.alias("height"), _shift("shiftright", number, h).alias("node")))


def _heights(count: Column) -> Column:
    return F.sequence(F.lit(0), F.floor(F.log2(count)).cast("int"))


def number_cutoffs(cutoffs: DataFrame, changes: DataFrame, key: str, time: str) -> tuple[DataFrame, DataFrame]:
    """(cutoffs with ``number`` and ``count``, changes with ``first`` and ``count``).

    ``number``: place of a cutoff among its key's distinct cutoffs; ``first``: the first cutoff that
    is later than the change.  Keys are range partitioned with the times, so a key with very many
    rows is spread over tasks.  Changes that no cutoff sees are left out."""
    marks = cutoffs.select(key, time, F.lit(0).alias("__kind"), F.lit(1).cast("long").alias("__one"))
    marks = marks.unionByName(changes.withColumn("__kind", F.lit(1)).withColumn("__one", F.lit(0).cast("long")), allowMissingColumns=True)
    counted = exclusive_prefix_sums(marks, [time, "__kind"], ["__one"], group_col=key)
    count = cutoffs.groupBy(key).agg(F.count(F.lit(1)).alias("count"))
    seen = counted.join(count, key).drop("__one")
    return (seen.where("__kind = 0").select(key, time, F.col("__one_before").alias("number"), "count"),
            seen.where("__kind = 1 AND __one_before < count").select(*changes.columns, F.col("__one_before").alias("first"), "count"))
