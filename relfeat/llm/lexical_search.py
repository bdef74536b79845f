"""Exact ranked lexical search with sparse ball trees.

An item's score of a document is the inner product of two sparse vectors over the terms of the
items: the item's ``repeats * w`` and the document's saturated frequencies
``s = (10**9 * tf) div (1000 * tf + 8 * m)``, all integers.  Each task gathers its documents'
vectors in chunks of bounded size and builds a ball tree over each chunk: a node is split between
two far documents until ``leaf_docs`` are left, and keeps a centroid ``c`` and a radius ``r``.  No
document below it scores more than ``q . c + |q| r``; both vectors carry ``sqrt(w)`` there.  That
bound is taken in doubles and rounded up: radii by more than the error that cancellation can leave
in them, the sum by ``SLACK``, which is above the error of a sum of ``2**18`` products.  For each
item the task goes down the trees best bound first and stops where the bound is below its ``k``-th
score so far; at the leaves scores are summed exactly in 64-bit integers.  The tasks' best are
ranked at the end, at most ``k`` rows a task and item.

Scale: the items are the stated queries.  They are taken in blocks of about ``block_terms`` terms
(2 MB); only a block's terms, counts and weights are sent to the workers, and whatever the driver
holds is bounded by them.  For each block the documents' texts are read once, whole; what follows
reads their vectors over the block's terms from a checkpoint.  Nothing is shuffled but document
counts of terms (a row a task and term) and the tasks' best rows.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased, held
as 64-bit fingerprints (see ``tokens``).

Defined results: null and term-free texts have no terms, count in no statistic and are never
found; term-free items have no rows; scores of 0 are left out; equal scores rank by ascending id,
null last; rows with one id are documents of their own, and so are item rows with one id; empty
tables give no rows.  Integers hold while ``75 * terms of a document * documents`` is below 2**63.
"""
from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relfeat.llm.components import free_finished_rounds
from relfeat.llm.tokens import distinct_in_rows, slices, utf8_buffer, words
from relfeat.operators.ranking import exclusive_prefix_sums

#: Relative error allowed for in bounds made of doubles.
SLACK = 1e-9
#: Every byte that is no part of a term becomes a space; the others stay.
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[:128][~np.array([chr(i).isalnum() for i in range(128)])] = 0x20


def terms(column) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all terms in order and, per row, their offsets."""
    data, offsets = utf8_buffer(column)
    spaced = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_TO_SPACE[data]))
    return words(spaced)


def _rows_of(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each row's part of ``values`` as a binary value."""
    size = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64) * size), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _values(column, kind) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = utf8_buffer(column)
    return np.frombuffer(data.tobytes(), dtype=kind), offsets // np.dtype(kind).itemsize


def _item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_no, item_id, n_terms, prints, repeats) of items with terms; one row each."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            prints, offsets = terms(batch.column(1))
            own, own_offsets = distinct_in_rows(prints, offsets)
            repeats = np.concatenate([np.unique(prints[a:b], return_counts=True)[1] for a, b in zip(offsets[:-1], offsets[1:])] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(own_offsets), pa.int64()), _rows_of(own, own_offsets), _rows_of(repeats.astype(np.int64), own_offsets)],
                                             names=["item_id", "n_terms", "prints", "repeats"])

    slim = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text"))
    made = slim.mapInArrow(run, f"item_id {kind}, n_terms long, prints binary, repeats binary").where("n_terms > 0")
    return made.withColumn("item_no", F.monotonically_increasing_id()).checkpoint()


def _vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary) -> DataFrame:
    """(id, n, terms, tf) of documents with terms; terms as places in the block's vocabulary."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        vocab = vocabulary.value
        for batch in slices(batches):
            prints, offsets = terms(batch.column(1))
            n = np.diff(offsets)
            place = np.minimum(np.searchsorted(vocab, prints), len(vocab) - 1)
            known = vocab[place] == prints
            row = np.repeat(np.arange(len(n)), n)[known]
            key, tf = np.unique(row * len(vocab) + place[known], return_counts=True)
            cuts = np.searchsorted(key, np.arange(len(n) + 1) * len(vocab))
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), _rows_of((key % len(vocab)).astype(np.int32), cuts), _rows_of(tf.astype(np.int32), cuts)],
                                             names=["id", "n", "terms", "tf"])
            yield out.filter(pa.array(n > 0))

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n long, terms binary, tf binary")


def _document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """For each place in the vocabulary, the number of documents that hold its term."""
    def run(batches):
        count = np.zeros(size, dtype=np.int64)
        for batch in batches:
            count += np.bincount(_values(batch.column(0), np.int32)[0], minlength=size)
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(count[held], pa.int64())], names=["place", "df"])

    df = np.zeros(size, dtype=np.int64)
    for r in vectors.select("terms").mapInArrow(run, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect():
        df[r.place] = r.df
    return df


class BallTree:
    """A ball tree over rows of sparse vectors, with every item's bound at every node."""

    def __init__(self, lengths, place, s, root_w, queries, leaf_docs):
        self.children: list[tuple[int, int] | None] = []
        self.leaf: list[tuple | None] = []
        self.bounds: list[np.ndarray] = []
        self.queries, self.root_w, self.leaf_docs = queries, root_w, leaf_docs
        if len(lengths):
            self._grow(np.arange(len(lengths)), lengths, place, s, s * root_w[place])

    def _grow(self, rows, lengths, place, s, x) -> None:
        """Nodes of all splits, by a stack; a node's vectors are dropped when it is split."""
        stack = [(rows, lengths, place, s, x, None)]
        size = len(self.root_w)
        while stack:
            rows, lengths, place, s, x, parent = stack.pop()
            at = np.cumsum(lengths) - lengths
            dot = lambda dense: np.add.reduceat(x * dense[place], at)  # noqa: B023,E731
            centre = np.bincount(place, weights=x, minlength=size) / len(rows)
            square, middle = np.add.reduceat(x * x, at), float(centre @ centre)
            far = square - 2 * dot(centre) + middle
            radius = math.sqrt(max(0.0, float((far + SLACK * (square + middle)).max())))
            node = len(self.bounds)
            q_place, q_at, q_value, q_norm = self.queries
            inner = np.add.reduceat(q_value * centre[q_place], q_at)
            self.bounds.append((inner + q_norm * radius) * (1 + SLACK) + 1)
            self.children.append(None)
            self.leaf.append(None)
            if parent is not None:
                self.children[parent] = (*(self.children[parent] or ()), node)
            if len(rows) <= self.leaf_docs:
                self.leaf[node] = (rows, at, place, s)
                continue

            def dense(k):
                out = np.zeros(size)
                out[place[at[k]:at[k] + lengths[k]]] = x[at[k]:at[k] + lengths[k]]  # noqa: B023
                return out

            a = int(far.argmax())
            from_a = dot(dense(a))
            b = int((square - 2 * from_a).argmax())
            # how much nearer to a than to b; about a quarter of the rows, and one, go to either side at least
            lean = 2 * (from_a - dot(dense(b))) - square[a] + square[b]
            order = np.argsort(lean, kind="stable")
            least = max(1, len(rows) // 4)
            cut = int(np.clip((lean < 0).sum(), least, len(rows) - least))
            left = np.zeros(len(rows), dtype=bool)
            left[order[:cut]] = True
            inside = np.repeat(left, lengths)
            for rows_in, values_in in ((left, inside), (~left, ~inside)):
                stack.append((rows[rows_in], lengths[rows_in], place[values_in], s[values_in], x[values_in], node))

    def search(self, item: int, weights: np.ndarray, least, found) -> int:
        """Best first: call ``found(rows, scores)`` for the leaves that may hold a score of
        ``least()`` or more.  Returns the number of leaves read."""
        heap, read = [(-float(self.bounds[0][item]), 0)] if self.bounds else [], 0
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < least():
                break
            if self.leaf[node] is None:
                for child in self.children[node]:
                    heapq.heappush(heap, (-float(self.bounds[child][item]), child))
                continue
            rows, at, place, s = self.leaf[node]
            found(rows, np.add.reduceat(s * weights[place], at))
            read += 1
        return read


class _Best:
    """The ``k`` highest-scoring documents of an item so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def least(self) -> int:
        """A document below this score can't be among them."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, ids, rows, scores) -> None:
        good = np.flatnonzero(scores >= self.least())
        if len(good) > self.k:  # those below the k-th can't stay; equal ones may
            good = good[scores[good] >= np.partition(scores[good], -self.k)[-self.k]]
        if len(good):
            new = [(-int(scores[g]), (key := ids[rows[g]].as_py()) is None, key) for g in good]
            self.rows = sorted(self.rows + new, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:self.k]


def _search(vectors: DataFrame, kind: str, block, k: int, tree_docs: int, tree_terms: int, leaf_docs: int) -> DataFrame:
    """(item_no, doc, score): each task's best documents of every item of the block."""
    def run(batches):
        item_no, q_place, q_at, repeats, w, documents, all_terms = block.value
        root_w = np.sqrt(w.astype(np.float64))
        q_value = repeats * root_w[q_place]
        queries = (q_place, q_at, q_value, np.sqrt(np.add.reduceat(q_value * q_value, q_at)) * (1 + SLACK))
        ends = np.append(q_at[1:], len(q_place))
        best = [_Best(k) for _ in item_no]

        def chunk(parts):
            ids = pa.chunked_array([p[0] for p in parts])
            n, lengths, place, tf = (np.concatenate([p[j] for p in parts]) for j in range(1, 5))
            m = np.repeat(25 + (75 * n * documents) // all_terms, lengths)
            s = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
            tree = BallTree(lengths, place, s, root_w, queries, leaf_docs)
            weights = np.zeros(len(w), dtype=np.int64)
            for i, (a, b) in enumerate(zip(q_at, ends)):
                if tree.bounds[0][i] < best[i].least():
                    continue
                weights[q_place[a:b]] = repeats[a:b] * w[q_place[a:b]]
                tree.search(i, weights, best[i].least, lambda rows, scores: best[i].add(ids, rows, scores))  # noqa: B023
                weights[q_place[a:b]] = 0

        parts, n_docs, n_terms = [], 0, 0
        for batch in batches:
            (place, offsets), (tf, _) = _values(batch.column(2), np.int32), _values(batch.column(3), np.int32)
            lengths, n = np.diff(offsets), batch.column(1).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < batch.num_rows:
                hi = min(batch.num_rows, lo + tree_docs - n_docs, int(np.searchsorted(offsets, offsets[lo] + tree_terms - n_terms, side="right")) - 1)
                if hi <= lo:
                    if parts:
                        chunk(parts)
                        parts, n_docs, n_terms = [], 0, 0
                        continue
                    hi = lo + 1  # a document of more terms than a tree's
                some = np.flatnonzero(lengths[lo:hi]) + lo  # the others score 0
                if len(some):
                    cut = slice(offsets[lo], offsets[hi])
                    parts.append((batch.column(0).take(pa.array(some)), n[some], lengths[some], place[cut].astype(np.int64), tf[cut].astype(np.int64)))
                    n_docs, n_terms = n_docs + len(some), n_terms + int(offsets[hi] - offsets[lo])
                lo = hi
        if parts:
            chunk(parts)
        rows = [(int(item_no[i]), key, -score) for i, b in enumerate(best) for score, _, key in b.rows]
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], arrow_kind), pa.array(columns[2], pa.int64())], names=["item_no", "doc", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    arrow_kind = to_arrow_type(vectors.schema["id"].dataType)
    return vectors.mapInArrow(run, f"item_no long, doc {kind}, score long")


def search_items(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 block_terms: int = 1 << 18, tree_docs: int = 8192, tree_terms: int = 1 << 21, leaf_docs: int = 48) -> DataFrame:
    """Each item's ``k`` highest-scoring documents with a score above 0: ``item_id, rank`` (from 1),
    ``doc_id, score``.

    ``tree_docs`` and ``tree_terms`` bound a tree's rows and values, which bounds a task's memory."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    parsed = _item_terms(items, item_col, item_text_col)
    numbered = exclusive_prefix_sums(parsed, ["item_no"], ["n_terms"])
    numbered = numbered.withColumn("block", F.floor(F.col("n_terms_before") / block_terms)).drop("n_terms_before").checkpoint()
    empty = spark.createDataFrame([], f"item_no long, rank int, doc {kind}, score long")
    ranked = empty
    for (number,) in sorted(numbered.select("block").distinct().collect()):
        rows = numbered.where(F.col("block") == number).collect()
        prints = [np.frombuffer(r.prints, dtype=np.uint64) for r in rows]
        vocab = np.unique(np.concatenate(prints))
        vectors = _vectors(docs, id_col, text_col, spark.sparkContext.broadcast(vocab)).checkpoint()
        documents, all_terms = vectors.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            return _named(empty, numbered, id_col, item_col)
        df = _document_counts(vectors, len(vocab))
        w = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        q_at = np.cumsum([0] + [len(p) for p in prints])[:-1]
        block = (np.array([r.item_no for r in rows]), np.searchsorted(vocab, np.concatenate(prints)), q_at,
                 np.concatenate([np.frombuffer(r.repeats, dtype=np.int64) for r in rows]), w, documents, all_terms)
        best = _search(vectors, kind, spark.sparkContext.broadcast(block), k, tree_docs, tree_terms, leaf_docs)
        order = Window.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_no", "rank", "doc", "score").checkpoint()
        ranked = best if ranked is empty else ranked.unionAll(best)
        del vectors
        free_finished_rounds(spark)
    return _named(ranked, numbered, id_col, item_col)


def _named(ranked: DataFrame, numbered: DataFrame, id_col: str, item_col: str) -> DataFrame:
    out = ranked.join(numbered.select("item_no", "item_id"), "item_no")
    return out.select(F.col("item_id").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
