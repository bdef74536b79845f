"""Benchmark decontamination by size-partitioned MinHash containment search.

Items (short benchmark texts) are partitioned by their number of word shingles into classes
[2^k, 2^(k+1)).  For each class a document is cut into blocks of 2^(k+1) shingles, and every two
adjacent blocks form a window, so that a passage of an item's size always lies whole in a window
whose size fits the class: an item contained to 0.8 has a Jaccard similarity of 0.19 or more with
its window however long the document is.  MinHash values of windows (minima of block minima) are
looked up among the items' values of their class; one equal value of ``hashes`` makes a
candidate, so 64 values miss a contained item with probability 1.4e-6 at most.  Candidates are
verified with the exact share of the item's distinct shingles that the whole document contains.

Scale: documents are scanned where they lie, with no shuffle, and read whole.  Items are
broadcast in blocks of bounded size (``block_chars`` characters); more items mean more scans of
the documents, never a larger broadcast (except for a single item that is longer by itself).

Defined results: null or empty documents and items match nothing; an item of 1 to 4 words is one
shingle and matches where its words stand in this order; repeated rows give repeated pairs; null
ids pass through; other columns are ignored (``find_items``) or kept (``drop_contaminated``).
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relfeat.llm import tokens

_U = np.uint64
#: Shingles whose MinHash values are computed at once.
PIECE = 1 << 17


class ItemIndex:
    """The shingles and MinHash values of a bounded block of items."""

    def __init__(self, texts: list[str | None], n: int, hashes: int, threshold: float):
        self.n, self.threshold = n, threshold
        prints, offsets = tokens.words(pa.array(texts, pa.string()))
        values, bounds = tokens.distinct_in_rows(*tokens.shingles(prints, offsets, n))
        self.sets = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        n_words, n_shingles = np.diff(offsets), np.diff(bounds)
        rng = np.random.default_rng(11)
        self.seeds = rng.integers(1, 2**63, hashes, dtype=np.int64).astype(_U)
        self.factors = rng.integers(1, 2**63, hashes, dtype=np.int64).astype(_U) * _U(2) + _U(1)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, n):
            rows = np.flatnonzero(n_words == m)
            if len(rows):
                runs = np.array([self.sets[r][0] for r in rows], dtype=_U)
                order = np.argsort(runs)
                self.short[m] = runs[order], rows[order]
        long = n_words >= n
        size_class = np.frexp(np.maximum(n_shingles, 1))[1]  # 2^(c-1) <= size < 2^c
        #: by class: the items, and for each hash the sorted values and their items
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for c in sorted(set(size_class[long].tolist())):
            rows = np.flatnonzero(long & (size_class == c))
            table = []
            for seed, factor in zip(self.seeds, self.factors):
                v = np.array([((self.sets[r] ^ seed) * factor).min() for r in rows], dtype=_U)
                order = np.argsort(v, kind="stable")
                table.append((v[order], rows[order]))
            self.classes[c] = table

    @staticmethod
    def _equal(wanted: np.ndarray, items: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (position in found, item) with equal values; ``wanted`` is sorted."""
        lo, hi = np.searchsorted(wanted, found, "left"), np.searchsorted(wanted, found, "right")
        at = np.flatnonzero(hi > lo)
        count = hi[at] - lo[at]
        where = np.repeat(at, count)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return where, items[np.repeat(lo[at], count) + inner]

    def match(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, shared shingles) for each pair whose containment reaches the threshold."""
        prints, offsets = tokens.words(column)
        pairs = []
        for m, (runs, items) in self.short.items():
            s, o = tokens.shingles(prints, offsets, m)
            at, item = self._equal(runs, items, s)
            row = np.searchsorted(o, at, side="right") - 1
            whole = np.diff(offsets)[row] >= m  # shorter rows have another run length
            pairs.append(np.stack([row[whole], item[whole]], 1))
        s, o = tokens.shingles(prints, offsets, self.n)
        if self.classes and len(s):
            pairs.append(self._candidates(s, o))
        if not pairs:
            e = np.empty(0, np.int64)
            return e, e, e
        pairs = np.unique(np.concatenate(pairs), axis=0)
        keep, shared, last, own = [], [], -1, None
        for row, item in pairs:
            wanted = self.sets[item]
            if len(wanted) == 1 and offsets[row + 1] - offsets[row] >= 1 and self._is_short(item):
                keep.append(True)
                shared.append(1)
                continue
            if row != last:
                own, last = np.unique(s[o[row]:o[row + 1]]), row
            at = np.minimum(np.searchsorted(own, wanted), max(0, len(own) - 1))
            n = int((own[at] == wanted).sum()) if len(own) else 0
            keep.append(n >= self.threshold * len(wanted) - 1e-9)
            shared.append(n)
        keep = np.array(keep, dtype=bool)
        return pairs[keep, 0], pairs[keep, 1], np.array(shared, dtype=np.int64)[keep]

    def _is_short(self, item: int) -> bool:
        return any(item in rows for _, rows in self.short.values())

    def _candidates(self, s: np.ndarray, o: np.ndarray) -> np.ndarray:
        fine = min(self.classes)
        count = np.diff(o)

        def blocks(size: int) -> tuple[np.ndarray, np.ndarray]:
            per_row = -(-count // size)
            row = np.repeat(np.arange(len(count)), per_row)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
            return row, o[row] + inner * size

        layout = {c: blocks(1 << c) for c in self.classes}
        fine_row, fine_start = layout[fine]
        out = []
        found: dict[int, list[np.ndarray]] = {}
        pieces = [0]
        while pieces[-1] < len(fine_start):  # block minima piece by piece, so that values stay in the cache
            pieces.append(max(pieces[-1] + 1, int(np.searchsorted(fine_start, fine_start[pieces[-1]] + PIECE))))
        pieces[-1] = len(fine_start)
        for j, (seed, factor) in enumerate(zip(self.seeds, self.factors)):
            low = np.empty(len(fine_start), dtype=_U)
            for a, b in zip(pieces[:-1], pieces[1:]):
                lo, hi = fine_start[a], fine_start[b] if b < len(fine_start) else len(s)
                v = s[lo:hi] ^ seed
                v *= factor
                low[a:b] = np.minimum.reduceat(v, fine_start[a:b] - lo)
            for c, table in self.classes.items():
                row, start = layout[c]
                block = low if c == fine else np.minimum.reduceat(low, np.searchsorted(fine_start, start))
                window = block.copy()
                same = row[1:] == row[:-1]
                window[:-1][same] = np.minimum(block[:-1], block[1:])[same]
                at, item = self._equal(*table[j], window)
                if len(at):
                    found.setdefault(c, []).append(np.unique(np.stack([row[at], item], 1), axis=0))
        for parts in found.values():
            out.append(np.unique(np.concatenate(parts), axis=0))
        return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int):
    """The items, a bounded block after another: lists of ids and texts."""
    slim = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("length(text) > 0")
    chars = slim.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    n = -(-chars // block_chars)
    for k in range(n):
        part = slim.where(F.pmod(F.xxhash64("text", "id"), F.lit(n)) == k) if n > 1 else slim
        rows = part.orderBy("id", "text").collect()
        if rows:
            yield [r["id"] for r in rows], [r["text"] for r in rows]


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
               item_text_col: str = "text", n: int = 5, threshold: float = 0.8, hashes: int = 64, block_chars: int = 16 << 20) -> DataFrame:
    """Pairs ``id, item id, shared, item_shingles, containment`` with containment >= threshold."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, `{item_id_col}` {item_type}, shared long, item_shingles long, containment double"
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    parts = []
    for ids, texts in item_blocks(items, item_id_col, item_text_col, block_chars):
        index = spark.sparkContext.broadcast((ids, ItemIndex(texts, n, hashes, threshold)))

        def scan(batches, index=index):
            ids, found = index.value
            for batch in tokens.slices(batches):
                row, item, shared = found.match(batch.column("text"))
                size = np.array([len(found.sets[i]) for i in item], dtype=np.int64)
                item_ids = pa.array([ids[i] for i in item])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(row)), item_ids.cast(pa.int64()) if pa.types.is_null(item_ids.type) else item_ids,
                     pa.array(shared), pa.array(size), pa.array(shared / np.maximum(size, 1))],
                    names=[id_col, item_id_col, "shared", "item_shingles", "containment"])

        parts.append(slim.mapInArrow(scan, schema))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
                      n: int = 5, threshold: float = 0.8, hashes: int = 64, block_chars: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item to the threshold."""
    out, at = docs, docs.columns.index(text_col)
    for _, texts in item_blocks(items, item_id_col, item_text_col, block_chars):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(texts, n, hashes, threshold))

        def scan(batches, index=index):
            for batch in tokens.slices(batches, text_col):
                clean = np.ones(batch.num_rows, dtype=bool)
                clean[index.value.match(batch.column(at))[0]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(scan, docs.schema)
    return out
