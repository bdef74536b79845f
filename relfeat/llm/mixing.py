"""Mixing sources to target weights by weighted fair queueing.

Every document is queued in its source in a shuffled order and gets a virtual finish time: the
words of its source up to and including it, divided by the source's target.  A second copy of
each document queues behind the whole source.  All copies of all sources are sorted by finish
time and cut where the total budget is reached, so every source is cut at about its target.

Scale: the text is read once to count its words; all else works on rows of a few columns.  The
running sums, within a source (one source may hold most rows) and over everything, are
range-partitioned prefix sums: no task holds a whole source.  The table of sources has one row a
source and stays distributed; Spark decides how to join it.

Defined results: null text has size 0; null source is a source of its own and sorts last; a null
or repeated id is a row like any other; rows alike in every column are taken alike; a source
without words has target 0 and nothing is taken from it; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relfeat.operators.ranking import exclusive_prefix_sums

#: A word, as Java's regular expressions write it.
WORD = r"[^\x20\x09-\x0D]+"
#: Rounds of resharing; each round caps at least one more source or ends the loop.
REPEATS = 2
#: Places in which the documents of a source meet its target.
SHARES = 128


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    ``weights`` repeat along the sources by code point, null last.  Together the targets make
    ``share`` of all words; none is above ``repeats`` times its source, and what a source cannot
    use is shared again by weight among those still below."""
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("no_name", F.col("source").isNull().cast("int"))
    table = table.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("one", F.lit(1).cast("long"))
    ranked = exclusive_prefix_sums(table, ["no_name", "name"], ["one"])
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("one_before") % len(weights) + 1).cast("int"))
    table = ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * repeats).alias("most")).checkpoint()
    total = table.agg(F.sum("source_size")).first()[0] or 0
    rate, full = 0.0, -1
    while True:
        over = F.col("most") <= F.col("weight") * F.lit(rate) if full >= 0 else F.lit(False)
        capped, n_capped, open_weight = table.agg(
            F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0)), F.count(F.when(over, 1)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if n_capped == full or not open_weight:
            break
        full = n_capped
        rate = (share * total - capped) / open_weight
    target = F.when(over, F.col("most").cast("double")).otherwise(F.least(F.col("most").cast("double"), F.col("weight") * F.lit(rate)))
    return table.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[int] = (3, 1, 2), share: float = 1.5, seed: str = "mix") -> DataFrame:
    """One row per document: ``id, source, size, source_size, target, taken``.

    ``taken`` counts the words that the mix takes from the document: 0, its size, or twice its
    size.  The order inside a source is that of md5(seed, id, md5 of the text), so reruns agree."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                       F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                                         F.md5(F.coalesce(F.col(text_col), F.lit(""))))).alias("place")).checkpoint()
    targets = source_targets(slim, weights, share, REPEATS)
    queued = slim.withColumn("no_name", F.col("source").isNull().cast("int")).withColumn("name", F.coalesce("source", F.lit("")))
    queued = exclusive_prefix_sums(queued, ["no_name", "name", "place"], ["size"])
    # the sum over all sources less what stands before the source is the sum inside it
    first = queued.groupBy("no_name", "name").agg(F.min("size_before").alias("before_source"))
    targets = targets.withColumn("no_name", F.col("source").isNull().cast("int")).withColumn("name", F.coalesce("source", F.lit("")))
    # a source's one row meets its documents in SHARES places, so that a large source is no single task
    per_source = targets.drop("source").join(first, ["no_name", "name"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    queued = queued.withColumn("share", F.pmod(F.xxhash64("place"), F.lit(SHARES)).cast("int")).join(per_source, ["no_name", "name", "share"]).drop("share")
    done = F.col("size_before") - F.col("before_source") + F.col("size")

    def finish(copy: int) -> Column:
        return F.when(F.col("target") > 0, (done + F.col("source_size") * copy) / F.col("target")).otherwise(F.lit(0.0))

    def order(copy: int) -> Column:
        return F.struct(finish(copy).alias("finish"), F.col("no_name"), F.col("name"), F.lit(copy).alias("copy"), F.col("place"))

    queued = queued.select("id", "source", "size", "source_size", "target", *[order(c).alias(f"order_{c}") for c in range(REPEATS)])
    copies = queued.select("size", F.explode(F.array(*[F.col(f"order_{c}") for c in range(REPEATS)])).alias("o")).select("size", "o.*")
    budget = targets.agg(F.sum("target")).first()[0] or 0.0
    keys = ["finish", "no_name", "name", "copy", "place"]
    line = exclusive_prefix_sums(copies, keys, ["size"])
    taken = line.where((F.col("size_before") + F.col("size") <= F.lit(budget)) & (F.col("size") > 0))
    last = taken.agg(F.max(F.struct(*keys)).alias("last")).first()["last"]
    if last is None:
        words = F.lit(0).cast("long")
    else:
        cut = F.struct(*[F.lit(last[k]).cast("double" if k == "finish" else "int" if k in ("no_name", "copy") else "string").alias(k) for k in keys])
        words = sum((F.when(F.col(f"order_{c}") <= cut, F.col("size")).otherwise(F.lit(0)) for c in range(1, REPEATS)),
                    F.when(F.col("order_0") <= cut, F.col("size")).otherwise(F.lit(0))).cast("long")
    return queued.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", words.alias("taken"))
