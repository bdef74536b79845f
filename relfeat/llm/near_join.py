"""N-gram Jaccard self-join of documents with Bayesian candidate pruning.

1. Texts are sets of five-word shingles; texts of equal sets form a class, which has a number of
   its own (ids may repeat or be null) and is represented by its row of the smallest id (nulls
   last).  Everything below works on one text a class; ids come back with the result.
2. Each class has 128 MinHash values, banded 32 x 4.  Classes that share a band are candidates:
   a pair of similarity 0.8 shares no band with probability 5e-8.  Bands give only star edges
   (smallest member to each other one), whose connected components bound where links can be.
3. Inside a candidate component all classes are compared in blocks: MinHash values are compared
   16 at a time, and a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold, given the matches so far (uniform prior), is below ``tolerance``.
   The rest are verified with exact intersections of shingle sets.
4. Links between classes are counted in the tasks that find them and leave as one count a class
   and block, and as the edges of a spanning forest; pairs are never emitted.

Scale: signatures are computed where texts lie; bands shuffle 16 bytes a class and band.  Only
texts of candidate components (measured; their ids and text hashes are broadcast only while their
number is bounded) are read again.  A component of any size is dealt out to tasks of two blocks of bounded size each, so
a component that holds a third of all rows spreads over all executors.  No pair is capped.

Defined results: null or empty texts have no shingles and link with nothing; texts of 1 to 4
words are one shingle; null ids are never representatives while the class has another id, and
classes of null ids alone are linked like others; repeated rows are members of one class and are
linked with each other; an empty table gives no rows; rows that share an id with another text are
rows of their own texts' classes; other columns are ignored (``near_join``) or kept
(``keep_first``).
"""
from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relfeat.llm import tokens
from relfeat.llm.components import components, free_finished_rounds

_U = np.uint64
HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
#: About how many shingles and texts a block holds (more shingles if one text alone has more).
BLOCK_SHINGLES, BLOCK_TEXTS = 1 << 16, 256
STEP = 16
_RNG = np.random.default_rng(29)
SEEDS = _RNG.integers(1, 2**63, HASHES, dtype=np.int64).astype(_U)
FACTORS = _RNG.integers(1, 2**63, HASHES, dtype=np.int64).astype(_U) * _U(2) + _U(1)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, HASHES) 32-bit MinHash values of the rows' shingles; rows must not be empty."""
    out = np.empty((len(offsets) - 1, HASHES), dtype=np.uint32)
    lo = 0
    while lo < len(out):  # pieces of rows, so that values stay in the cache
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + (1 << 16), side="right")) - 1)
        s, start = values[offsets[lo]:offsets[hi]], offsets[lo:hi] - offsets[lo]
        for j in range(HASHES):
            v = s ^ SEEDS[j]
            v *= FACTORS[j]
            out[lo:hi, j] = np.minimum.reduceat(v, start) >> _U(32)
        lo = hi
    return out


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, ... compared values: the matches below which
    P(similarity >= threshold | m of n match), with a uniform prior, is under ``tolerance``."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        # 1 - I_t(m + 1, n - m + 1) as a binomial sum
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * threshold**m * (1 - threshold)**(n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def _text_sets(column) -> tuple[np.ndarray, np.ndarray]:
    prints, offsets = tokens.words(column)
    return tokens.distinct_in_rows(*tokens.shingles(prints, offsets, 5))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _keys(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit fingerprint of each row's set of shingles; rows must not be empty."""
    with np.errstate(over="ignore"):
        high = np.add.reduceat(tokens.mix64(values ^ _U(0x5851F42D4C957F2D)), offsets[:-1])
        low = np.add.reduceat(tokens.mix64(values), offsets[:-1])
        return (tokens.mix64(high) ^ np.diff(offsets).astype(_U)).view(np.int64), tokens.mix64(low).view(np.int64)


def text_classes(docs: DataFrame) -> DataFrame:
    """(id, text_hash, key, bands) of each row: key is a 128-bit fingerprint of its shingle set,
    null for texts without shingles; bands are 32 band values."""

    def read(batches):
        for batch in tokens.slices(batches, most_bytes=8 << 20):
            values, offsets = _text_sets(batch.column("text"))
            filled = np.flatnonzero(np.diff(offsets))
            n = batch.num_rows
            high, low = np.zeros(n, np.int64), np.zeros(n, np.int64)
            bands = np.zeros((len(filled), BANDS), dtype=np.int64)
            if len(filled):
                bounds = np.append(offsets[:-1][filled], offsets[-1])
                high[filled], low[filled] = _keys(values, bounds)
                sig = signatures(values, bounds)
                h = np.zeros((len(filled), BANDS), dtype=_U)
                with np.errstate(over="ignore"):
                    for k in range(ROWS):
                        h = tokens.mix64(h * _U(31) + sig[:, k::ROWS])
                    bands = (h ^ (np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15))).view(np.int64)
            empty = np.ones(n, dtype=bool)
            empty[filled] = False
            sizes = np.zeros(n + 1, dtype=np.int32)
            sizes[filled + 1] = BANDS
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(high, mask=empty), pa.array(low, mask=empty),
                 pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(bands.reshape(-1)))], names=["id", "text_hash", "high", "low", "bands"])

    return docs.mapInArrow(read, "id long, text_hash long, high long, low long, bands array<long>")


def _compare(ids_a, sets_a, sig_a, ids_b, sets_b, sig_b, same: bool, least: list[int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked texts of two blocks (of one block: each pair once)."""
    if same:
        i, j = np.triu_indices(len(ids_a), 1)
    else:
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(ids_a)), np.arange(len(ids_b)), indexing="ij"))
    matches = np.zeros(len(i), dtype=np.int32)
    for k, need in enumerate(least):
        cut = slice(k * STEP, (k + 1) * STEP)
        matches += (sig_a[i, cut] == sig_b[j, cut]).sum(1, dtype=np.int32)
        keep = matches >= need
        i, j, matches = i[keep], j[keep], matches[keep]
        if not len(i):
            return i, j
    # exact: shared shingles of all rows of one side with all of the other, by columns of a 0/1 matrix
    used_a, used_b = np.unique(i), np.unique(j)
    common = np.intersect1d(np.unique(np.concatenate([sets_a[x] for x in used_a])), np.unique(np.concatenate([sets_b[x] for x in used_b])))
    shared = np.zeros((len(used_a), len(used_b)), dtype=np.float32)
    for lo in range(0, len(common), 1 << 13):
        part = common[lo:lo + (1 << 13)]
        sides = []
        for used, sets in ((used_a, sets_a), (used_b, sets_b)):
            x = np.zeros((len(used), len(part)), dtype=np.float32)
            for r, u in enumerate(used):
                own = sets[u]
                own = own[np.searchsorted(own, part[0]):np.searchsorted(own, part[-1], "right")]
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                x[r, at[part[at] == own]] = 1
            sides.append(x)
        shared += sides[0] @ sides[1].T
    n = shared[np.searchsorted(used_a, i), np.searchsorted(used_b, j)]
    size_a, size_b = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    linked = n >= threshold * (size_a[i] + size_b[j] - n) - 1e-6
    return i[linked], j[linked]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the pairs of a spanning forest."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    keep = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(k)
    return np.array(keep, dtype=np.int64)


def _links(blocks: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """Rows (a, b, n): n > 0 adds n linked rows to class (vertex) a; b not null is an edge of a forest."""
    least = least_matches(threshold, tolerance)
    pairs = blocks.where("blocks > 1 OR texts > 1").select(
        "component", "vertex", "weight", "values", "signature", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "component", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "vertex", "weight", "values", "signature")

    def compare(key, group):
        left = group.column("block").to_numpy() == key[1].as_py()
        ids, weight = group.column("vertex").to_numpy(), group.column("weight").to_numpy()
        sets = [np.frombuffer(v, dtype=_U) for v in group.column("values").to_pylist()]
        sig = np.stack([np.frombuffer(v, dtype=np.uint32) for v in group.column("signature").to_pylist()])
        same = key[1].as_py() == key[2].as_py()
        a = np.flatnonzero(left)
        b = a if same else np.flatnonzero(~left)
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        i, j = _compare(ids[a], [sets[k] for k in a], sig[a], ids[b], [sets[k] for k in b], sig[b], same, least, threshold)
        i, j = a[i], b[j]
        n = np.bincount(i, weights=weight[j], minlength=len(ids)) + np.bincount(j, weights=weight[i], minlength=len(ids))
        some = np.flatnonzero(n)
        tree = _forest(ids[i], ids[j])
        return pa.table({"a": pa.array(np.concatenate([ids[some], ids[i][tree]])),
                         "b": pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[j][tree]]), mask=np.arange(len(some) + len(tree)) < len(some)),
                         "n": pa.array(np.concatenate([n[some].astype(np.int64), np.zeros(len(tree), np.int64)]))})

    # dealt out by pair of blocks; else all of a component's pairs stay where its rows were joined
    return pairs.repartition("component", "x", "y").groupBy("component", "x", "y").applyInArrow(compare, "a long, b long, n long")


def _marks(slim: DataFrame, threshold: float, tolerance: float, broadcast_ids: int) -> DataFrame:
    """(id, text_hash, class_id, n_links, component_id, first) of each row; ``first`` tells whether
    it, or a row that it repeats, is the first of its component, null for texts without shingles."""
    rows = text_classes(slim).checkpoint()
    # numbers follow the ids: a group's first text is often what the others are copies of, so it
    # shares most bands with them and stars stay few; the checkpoint fixes the numbers
    classes = rows.where("high IS NOT NULL").groupBy("high", "low").agg(
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("row"), F.count("*").alias("weight"), F.first("bands").alias("bands")).orderBy("row.no_id", "row.id", "high", "low").select(
        F.monotonically_increasing_id().alias("vertex"), "high", "low", F.struct("row.no_id", "row.id", "high", "low", "row.text_hash").alias("row"), "weight", "bands").checkpoint()
    band = classes.select("vertex", F.explode("bands").alias("band"))
    lowest = band.groupBy("band").agg(F.min("vertex").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = lowest.join(band, "band").groupBy("vertex").agg(F.min("a").alias("low"), F.collect_set("a").alias("centres"))  # at most BANDS centres
    # a class is joined to the least of its bands' centres, and the other centres to that one, so
    # that a dense group makes about one edge a member and not one for each of its bands
    stars = stars.select("low", F.explode(F.array_union("centres", F.array("vertex"))).alias("b")).where("low <> b").select(F.col("low").alias("a"), "b").distinct()
    members = components(stars).withColumnRenamed("id", "vertex").join(
        classes.select("vertex", "high", "low", "weight", F.col("row.id").alias("row_id"), F.col("row.text_hash").alias("row_hash")), "vertex").checkpoint()
    few = members.count() <= broadcast_ids
    texts = slim.join(F.broadcast(members) if few else members, (F.col("text_hash") == F.col("row_hash")) & F.col("id").eqNullSafe(F.col("row_id"))).select(
        "component", "vertex", "weight", "high", "low", "text")

    def read(batches):
        for batch in tokens.slices(batches, most_bytes=8 << 20):
            values, offsets = _text_sets(batch.column("text"))
            filled = np.flatnonzero(np.diff(offsets))
            if not len(filled):
                continue
            bounds = np.append(offsets[:-1][filled], offsets[-1])
            high, low = _keys(values, bounds)
            # texts that share a hash may be of another class
            own = (batch.column("high").to_numpy()[filled] == high) & (batch.column("low").to_numpy()[filled] == low)
            sig, filled = signatures(values, bounds)[own], filled[own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(pa.array(filled)) for c in ("component", "vertex", "weight")] + [
                    pa.array([values[offsets[r]:offsets[r + 1]].tobytes() for r in filled], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()),
                    pa.array(np.diff(offsets)[filled])], names=["component", "vertex", "weight", "values", "signature", "size"])

    sets = texts.mapInArrow(read, "component long, vertex long, weight long, values binary, signature binary, size long")
    sets = sets.dropDuplicates(["vertex", "component"]).checkpoint()
    need = sets.groupBy("component").agg(F.sum("size").alias("shingles"), F.count("*").alias("texts"))
    n = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("texts") / BLOCK_TEXTS), F.lit(1)).cast("int")
    blocks = sets.join(need.select("component", "texts", n.alias("blocks")), "component").withColumn("block", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    free_finished_rounds(slim.sparkSession)
    found = _links(blocks, threshold, tolerance).checkpoint()
    counts = found.where("n > 0").groupBy(F.col("a").alias("vertex")).agg(F.sum("n").alias("others"))
    groups = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("id", "vertex")
    linked = groups.join(classes.select("vertex", "row"), "vertex").groupBy("component").agg(F.min("row").alias("first"))
    linked = groups.join(linked, "component").select("vertex", "first")
    by_class = classes.select("vertex", "high", "low", "row", "weight").join(counts, "vertex", "left").join(linked, "vertex", "left").select(
        "high", "low", F.col("row.id").alias("class_id"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("first", "row").alias("first"))
    out = rows.select("id", "text_hash", "high", "low").join(by_class, ["high", "low"], "left")
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", "high", "low", "text_hash")
    return out.select("id", "text_hash", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("first.id", "id").alias("component_id"), F.when(F.col("high").isNotNull(), own.eqNullSafe(F.col("first"))).alias("first"))


def near_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-6,
              broadcast_ids: int = 2_000_000) -> DataFrame:
    """One row per document: ``id, class_id`` (smallest id with the same shingles), ``n_links``
    (other rows of similarity >= threshold) and ``component_id`` (smallest id reached by links)."""
    marks = _marks(_slim(docs, id_col, text_col), threshold, tolerance, broadcast_ids)
    return marks.select(F.col("id").alias(id_col), "class_id", "n_links", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, tolerance: float = 1e-6,
               broadcast_ids: int = 2_000_000, one_row: bool = False) -> DataFrame:
    """``docs``, all columns, without the documents that another one of their group stands for:
    of each group the row that is first by id (nulls last), class key and text hash stays.  Rows
    without a text all stay.  Rows that repeat the first one's id and text stay with it, unless
    ``one_row`` asks for one of them."""
    marks = _marks(_slim(docs, id_col, text_col), threshold, tolerance, broadcast_ids)
    key = lambda m: F.col(id_col).cast("long").eqNullSafe(m["__id"]) & (F.xxhash64(text_col) == m["__hash"])
    of = lambda m: m.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"))
    gone = of(marks.where("NOT first")).distinct()
    rest = docs.join(gone, key(gone), "left_anti")
    if not one_row:
        return rest
    repeated = of(marks.where("first")).groupBy("__id", "__hash").count().where("count > 1").drop("count").checkpoint()
    if not repeated.limit(1).count():
        return rest
    once = rest.join(repeated, key(repeated)).dropDuplicates(["__id", "__hash"]).drop("__id", "__hash")
    return rest.join(repeated, key(repeated), "left_anti").unionByName(once)
