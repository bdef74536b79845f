"""Order statistics of prefixes: for each cutoff of a key the median of the values dated before it.

A wavelet tree over the values' ranks, in time order, answers the k-th smallest value of any range
of positions.  All queries of a piece go down the tree together, one level at a time, so only one
level is held: a piece of ``n`` rows takes some arrays of ``n`` numbers and ``log2(n)`` passes.

* ``window_medians``: rows are dealt out by key and sorted by time; pieces are runs of whole keys
  of about ``PIECE_ROWS`` rows.  A key's rows meet in one task, so very large keys go to
* ``bucketed_medians``: no piece holds a whole key.  The values of a key are cut at quantiles and
  its times in buckets.  Counts per (value range, bucket) give, for each bucket, the weights of the
  value ranges before it; a first tree over the ranges, one piece a (key, bucket), finds the range
  that holds the wanted rank, and a second one, a piece a (key, range), the value.  Ranges and
  buckets of a single value have no inside and are not read again, however many rows they hold.
  Where many queries fall in one range they are dealt out over copies of it.

A median is the middle value or the mean of the two middle ones, as ``F.median`` gives it.  Null
values are not events; cutoffs without events are left out.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE_ROWS = 1 << 17
_FIRST = -(2 ** 63)
_BASE, _QUERY, _EVENT = 0, 1, 2  # at one time, queries stand before events: a cutoff is strict


def range_select(code: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each query the code at the (0-based) ``rank`` among positions ``lo`` to ``hi`` when each
    position's code counts ``weight`` times, and the rank left inside that code."""
    answer = np.zeros(len(rank), dtype=np.int64)
    for level in reversed(range(int(code.max()).bit_length() if len(code) else 0)):
        ones = (code >> level) & 1 == 1
        zeros_before = np.concatenate(([0], np.cumsum(~ones)))
        weight_before = np.concatenate(([0], np.cumsum(np.where(ones, 0, weight))))
        low_weight = weight_before[hi] - weight_before[lo]
        up = rank >= low_weight
        rank = np.where(up, rank - low_weight, rank)
        lo, hi = (np.where(up, zeros_before[-1] + at - zeros_before[at], zeros_before[at]) for at in (lo, hi))
        answer |= up.astype(np.int64) << level
        order = np.concatenate((np.flatnonzero(~ones), np.flatnonzero(ones)))
        code, weight = code[order], weight[order]
    return answer, rank


def _new_groups(table: pa.Table, n_keys: int) -> np.ndarray:
    """Whether each row's first ``n_keys`` columns differ from the row's before."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for i in range(n_keys):
        column = table.column(i).combine_chunks()
        if not pa.types.is_integer(column.type):
            column = column.dictionary_encode().indices
        values = column.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return new


def whole_groups(batches, n_keys: int, piece_rows: int):
    """Sorted rows as tables of whole groups, of about ``piece_rows`` rows or one group more, each
    with the position at which every row's group begins."""
    held, rows, most = [], 0, piece_rows
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:
            table = pa.Table.from_batches(held)
            last = int(np.flatnonzero(_new_groups(table, n_keys))[-1])
            if last:
                yield _with_starts(table.slice(0, last), n_keys)
                table = table.slice(last)
            held, rows = table.to_batches(), table.num_rows
            most = max(piece_rows, 2 * rows)
    if rows:
        yield _with_starts(pa.Table.from_batches(held), n_keys)


def _with_starts(table: pa.Table, n_keys: int) -> tuple[pa.Table, np.ndarray]:
    new = _new_groups(table, n_keys)
    return table, np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _ranked(x: np.ndarray, event: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of the events, and each row's place among them (0 for other rows)."""
    values, place = np.unique(x[event], return_inverse=True)
    code = np.zeros(len(x), dtype=np.int64)
    code[event] = place
    return values, code


def _middle(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where(low == high, low, 0.5 * low + 0.5 * high)


def _key_type(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


def window_medians(events: DataFrame, queries: DataFrame, key: str, group: str, time: str, value: str, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``(key, group, time, median)`` for every query ``(key, group, time)`` that has an earlier
    event ``(key, group, time, value)``."""
    def run(batches):
        for table, start in whole_groups(batches, 2, piece_rows):
            event = _numbers(table, "kind") == _EVENT
            values, code = _ranked(_numbers(table, "x"), event)
            weight = event.astype(np.int64)
            before = np.concatenate(([0], np.cumsum(weight)))
            at = np.flatnonzero(~event)
            n = before[at] - before[start[at]]
            at, n = at[n > 0], n[n > 0]
            low, high = (range_select(code, weight, start[at], at, rank)[0] for rank in ((n - 1) // 2, n // 2))
            if len(at):
                out = table.select([0, 1, 2]).take(pa.array(at)).append_column("m", pa.array(_middle(values[low], values[high])))
                yield from out.combine_chunks().to_batches()

    rows = events.select(key, group, time, F.lit(_EVENT).alias("kind"), F.col(value).alias("x"))
    rows = rows.unionByName(queries.select(key, group, time, F.lit(_QUERY).alias("kind"), F.lit(float("nan")).alias("x")))
    rows = rows.repartition(key, group).sortWithinPartitions(key, group, time, "kind")
    return rows.mapInArrow(run, f"{key} {_key_type(events, key)}, {group} int, {time} long, m double")


def place_among(bounds: Column, x: Column) -> Column:
    """Where ``x`` stands among ascending bounds: ``2 i`` strictly between the ``i``-th and the next,
    ``2 i - 1`` on the ``i``-th."""
    return (F.size(F.filter(bounds, lambda b: b < x)) + F.size(F.filter(bounds, lambda b: b <= x))).cast("long")


def _find_ranges(rows: DataFrame, key: str, group: str, time: str, piece_rows: int) -> DataFrame:
    """The value range, and the rank inside it, of the two middle values before each cutoff."""
    def run(batches):
        for table, start in whole_groups(batches, 3, piece_rows):
            kind, code = _numbers(table, "kind"), _numbers(table, "code")
            weight = _numbers(table, "weight")
            before = np.concatenate(([0], np.cumsum(weight)))
            at = np.flatnonzero(kind == _QUERY)
            n = before[at] - before[start[at]]
            at, n = at[n > 0], n[n > 0]
            for which, rank in enumerate(((n - 1) // 2, n // 2)):
                found, rest = range_select(code, weight, start[at], at, rank)
                if len(at):
                    out = table.select([0, 1, 3]).take(pa.array(at))
                    for name, column in (("which", pa.array(np.full(len(at), which, np.int32))), ("code", pa.array(found)), ("rest", pa.array(rest))):
                        out = out.append_column(name, column)
                    yield from out.combine_chunks().to_batches()

    rows = rows.repartition(key, group, "bucket").sortWithinPartitions(key, group, "bucket", time, "kind")
    return rows.mapInArrow(run, f"{key} {_key_type(rows, key)}, {group} int, {time} long, which int, code long, rest long")


def _find_values(rows: DataFrame, key: str, group: str, time: str, piece_rows: int) -> DataFrame:
    """The value at rank ``rest`` among a range's values before each cutoff."""
    def run(batches):
        for table, start in whole_groups(batches, 4, piece_rows):
            event = _numbers(table, "kind") == _EVENT
            if event.all() or not event.any():
                continue
            values, code = _ranked(_numbers(table, "x"), event)
            at = np.flatnonzero(~event)
            found, _ = range_select(code, event.astype(np.int64), start[at], at, _numbers(table, "rest")[at])
            out = table.select([0, 1, 4]).take(pa.array(at)).append_column("x", pa.array(values[found]))
            yield from out.combine_chunks().to_batches()

    rows = rows.repartition(key, group, "code", "chunk").sortWithinPartitions(key, group, "code", "chunk", time, "kind")
    return rows.mapInArrow(run, f"{key} {_key_type(rows, key)}, {group} int, {time} long, x double")


def bucketed_medians(events: DataFrame, queries: DataFrame, key: str, group: str, time: str, value: str, ranges: int = 8, chunks: int = 1,
                     instants: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """As ``window_medians``, for keys of any size.  Both frames also hold ``bucket``: events of an
    earlier bucket are earlier.  ``ranges``: quantiles at which each key's values are cut;
    ``chunks``: how many tasks share the queries of one range; ``instants``: whether odd buckets
    hold a single time each; that is so for few (hot) keys, whose cuts are broadcast."""
    by = [key, group]
    steps = [i / ranges for i in range(ranges + 1)]
    cuts = events.groupBy(*by).agg(F.array_sort(F.array_distinct(F.percentile_approx(value, steps, 10 * max(ranges, 100)))).alias("cuts")).checkpoint()
    cuts = F.broadcast(cuts) if instants else cuts
    coded = events.join(cuts, by).withColumn("code", place_among(F.col("cuts"), F.col(value))).drop("cuts")
    cells = coded.groupBy(*by, "code", "bucket").agg(F.count(F.lit(1)).alias("n"))
    grid = queries.select(*by, "bucket").distinct().join(cells.select(*by, "code").distinct(), by)
    cells = cells.withColumn("wanted", F.lit(False)).unionByName(grid.select(*by, "code", "bucket", F.lit(0).cast("long").alias("n"), F.lit(True).alias("wanted")))
    earlier = Window.partitionBy(*by, "code").orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)
    base = cells.withColumn("weight", F.sum("n").over(earlier)).where("wanted AND weight > 0")

    def stream(df, kind, at, code, weight):
        return df.select(*by, "bucket", at.alias(time), F.lit(kind).alias("kind"), code.alias("code"), weight.cast("long").alias("weight"))

    inside = coded.where("bucket % 2 = 0") if instants else coded
    none = F.lit(0).cast("long")
    rows = stream(base, _BASE, F.lit(_FIRST), F.col("code"), F.col("weight")).unionByName(stream(inside, _EVENT, F.col(time), F.col("code"), F.lit(1))) \
        .unionByName(stream(queries, _QUERY, F.col(time), none, none))
    found = _find_ranges(rows, key, group, time, piece_rows).checkpoint()
    plain = found.where("code % 2 = 1").join(cuts, by).select(*by, time, F.element_at("cuts", ((F.col("code") + 1) / 2).cast("int")).alias("x"))
    wanted = found.where("code % 2 = 0").withColumn("chunk", F.pmod(F.xxhash64(time, "which"), F.lit(chunks)).cast("int"))
    ranged = coded.join(wanted.select(*by, "code").distinct(), [*by, "code"], "left_semi").withColumn("chunk", F.explode(F.array(*[F.lit(c) for c in range(chunks)])))
    rows = ranged.select(*by, "code", "chunk", time, F.lit(_EVENT).alias("kind"), F.col(value).alias("x"), none.alias("rest"))
    rows = rows.unionByName(wanted.select(*by, "code", "chunk", time, F.lit(_QUERY).alias("kind"), F.lit(float("nan")).alias("x"), "rest"))
    values = plain.unionByName(_find_values(rows, key, group, time, piece_rows))
    low, high = F.min("x"), F.max("x")
    return values.groupBy(*by, time).agg(F.when(low == high, low).otherwise(low * 0.5 + high * 0.5).alias("m"))
