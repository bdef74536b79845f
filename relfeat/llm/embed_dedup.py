"""Near-duplicate embeddings by NN-descent.

1. Vectors that equal each other bit by bit (with equal label) form a class with one
   representative; all below works on representatives.
2. The neighbour graph (``k`` nearest a vector, labels equal) starts from blocks of vectors with
   equal random-hyperplane signatures, in several tables.
3. NN-descent: each vector's neighbours and (sampled) reverse neighbours are compared with each
   other wherever one of the two is new in its list, and better neighbours replace worse ones,
   until few lists change.
4. Every comparison that reaches the threshold is a link.  A block of comparisons keeps the edges
   of a spanning forest of its links, so that links of dense groups stay connected although no
   list could hold them.  The forests' components bound where links are.
5. A list whose worst entry still reaches the threshold is saturated.  Lists are enlarged to the
   vector's whole component: components are compared in blocks, in double precision, and each
   task adds up links, so that a dense group of any size is counted without emitting its pairs.
6. Recall is audited: ``audit`` random vectors are compared with all vectors by brute force; links
   missed mean more tables with other hyperplanes, and another descent, until none of the
   audited links is missing (or ``most_passes`` is reached, which fails the job below 0.9).
   Recall is the mean over the audited vectors that have links, and over those with few of them
   if that is less, so that a dense group does not hide what small ones lost.

Scale: shuffles carry one vector for each list entry and round; lists, blocks and audited queries
have fixed sizes; labels and dense groups of any size are dealt out to blocks by a hash.

Defined results: vectors that are null, empty, zero, or hold nulls or non-finite numbers, and those
with a null label, link with nothing; vectors of different lengths do not link; repeated rows are
members of one class and link with each other; a class is known by its label and vector, so rows
that repeat an id with another vector, or have no id, link by their own vectors; a null id is the
smallest of a component only if there is no other, and then its rows are kept; an empty table
gives no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relfeat.llm.components import components, free_finished_rounds

BLOCK, BITS = 256, 24
PROPOSAL = "a long, b long, sim double, link boolean"


def _matrix(blobs, kind: str) -> np.ndarray:
    """Unit rows in double precision; rows are scaled by a power of two first, so that squares of very
    large or small numbers stay in range."""
    x = np.frombuffer(b"".join(blobs), dtype=kind).reshape(len(blobs), -1).astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])
    return x / np.sqrt((x * x).sum(1))[:, None]


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    keep = []
    for n, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(n)
    return np.array(keep, dtype=np.int64)


def _table(a, b, sim, link) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sim": pa.array(sim, pa.float64()), "link": pa.array(link, pa.bool_())})


def _block_neighbours(ids: np.ndarray, x: np.ndarray, k: int, threshold: float) -> pa.Table:
    """The k best neighbours of each vector inside a block, and a forest of its links."""
    if len(ids) < 2:
        return _table([], [], [], [])
    s = x @ x.T
    np.fill_diagonal(s, -2)
    i, j = np.nonzero(np.triu(s >= threshold, 1))
    tree = _forest(ids[i], ids[j])
    k = min(k, len(ids) - 1)
    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
    a, b = np.repeat(ids, k), ids[best.ravel()]
    return _table(np.concatenate([a, ids[i][tree]]), np.concatenate([b, ids[j][tree]]),
                  np.concatenate([np.take_along_axis(s, best, 1).ravel(), s[i, j][tree]]), np.arange(len(a) + len(tree)) >= len(a))


def vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, str]:
    """(id, label, blob) with a null blob for vectors that link with nothing; and the blobs' type."""
    double = rows.schema[vector_col].dataType.elementType.simpleString() not in ("float", "tinyint", "smallint")
    kind, element = ("<f8", "double") if double else ("<f4", "float")
    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast(f"array<{element}>").alias("v"))
    plain = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    usable = F.col("label").isNotNull() & F.coalesce((F.size("v") > 0) & F.forall("v", plain) & F.exists("v", lambda e: e != 0), F.lit(False))

    def pack(batches):
        for batch in batches:
            column, usable = batch.column("v"), batch.column("usable").to_pylist()
            blobs = [np.asarray(column[i].values.to_numpy(zero_copy_only=False) + 0.0, dtype=kind).tobytes() if u else None for i, u in enumerate(usable)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(blobs, pa.binary())], names=["id", "label", "blob"])

    label = slim.schema["label"].dataType.simpleString()
    return slim.withColumn("usable", usable).mapInArrow(pack, f"id long, label {label}, blob binary"), kind


def _initial(reps: DataFrame, kind: str, tables: int, seed: int, k: int, threshold: float) -> DataFrame:
    """Neighbours and links inside blocks of equal signatures."""

    def sign(batches):
        planes: dict = {}
        for batch in batches:
            blobs = batch.column("blob").to_pylist()
            size = np.array([len(v) for v in blobs])
            codes = np.zeros((len(blobs), tables), dtype=np.int32)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x = _matrix([blobs[i] for i in at], kind)
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, int(n)]).standard_normal((x.shape[1], tables * BITS))
                bits = (x @ planes[n] > 0).reshape(len(at), tables, BITS)
                codes[at] = (bits * (1 << np.arange(BITS)[::-1])).sum(2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(
                pa.array(np.arange(len(blobs) + 1, dtype=np.int32) * tables), pa.array(codes.reshape(-1)))], names=["id", "codes"])

    group = ["label", "size"]
    codes = reps.select("id", "blob").mapInArrow(sign, "id long, codes array<int>")
    totals = reps.groupBy(*group).agg(F.count("*").alias("n"))
    # as many signature bits as leave about half a block in a bucket
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (BLOCK // 2))))).cast("int")
    rows = reps.join(codes, "id").join(totals.withColumn("bits", bits).drop("n"), group)
    rows = rows.select("id", *group, "blob", "bits", F.posexplode("codes").alias("t", "code")).withColumn("code", F.expr(f"shiftright(code, {BITS} - bits)")).drop("bits")
    bucket = [*group, "t", "code"]
    counts = rows.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = rows.join(counts, bucket).withColumn("block", F.pmod(F.xxhash64("id", "t", F.lit(seed)), F.col("blocks")))

    def compare(group):
        ids = group.column("id").to_numpy()
        return _block_neighbours(ids, _matrix(group.column("blob").to_pylist(), kind), k, threshold)

    # dealt out by block; else all blocks of a bucket stay where its rows were joined
    return rows.repartition(*bucket, "block").groupBy(*bucket, "block").applyInArrow(compare, PROPOSAL)


def _merge(old: DataFrame | None, proposals: DataFrame, k: int, buckets: int) -> DataFrame:
    """(a, b, sim, new): the k best of each vector's list and proposals."""
    rows = proposals.where("NOT link").select("a", "b", "sim", F.lit(True).alias("new"))
    if old is not None:
        rows = rows.unionAll(old.withColumn("new", F.lit(False)))

    def best(table):
        a, b, sim, new = (table.column(c).to_numpy() for c in ("a", "b", "sim", "new"))
        order = np.lexsort((new, b, a))  # an entry that is already listed is not new
        a, b, sim, new = a[order], b[order], sim[order], new[order]
        first = np.ones(len(a), dtype=bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, sim, new = a[first], b[first], sim[first], new[first]
        order = np.lexsort((b, -sim, a))
        a, b, sim, new = a[order], b[order], sim[order], new[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a)
        top = rank < k
        return pa.table({"a": a[top], "b": b[top], "sim": sim[top], "new": new[top]})

    return rows.groupBy(F.pmod(F.xxhash64("a"), F.lit(buckets)).alias("bucket")).applyInArrow(best, "a long, b long, sim double, new boolean")


def _descend(graph: DataFrame, reps: DataFrame, kind: str, k: int, threshold: float, buckets: int) -> DataFrame:
    """One round of neighbours-of-neighbours joins: proposals and links."""
    forward = graph.select(F.col("a").alias("v"), F.col("b").alias("u"), "new")
    reverse = graph.select(F.col("b").alias("v"), F.col("a").alias("u"), "new")
    # k reverse neighbours of each vector by a hash, new ones first; in two steps, so that a hub is split
    reverse = reverse.withColumn("h", F.xxhash64("u", "v")).withColumn("salt", F.pmod("h", F.lit(61)))
    for keys in (["v", "salt"], ["v"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("new"), "h"))
        reverse = reverse.withColumn("rank", rank).where(F.col("rank") <= k)
    lists = forward.unionAll(reverse.select("v", "u", "new")).groupBy("v", "u").agg(F.max("new").alias("new"))
    active = lists.groupBy("v").agg(F.max("new").alias("any")).where("any").select("v")
    lists = lists.join(active, "v")
    worst = graph.groupBy(F.col("a").alias("id")).agg(F.min("sim").alias("worst"), F.count("*").alias("have"))
    known = reps.join(worst, "id", "left").select(F.col("id").alias("u"), "blob", F.when(F.col("have") >= k, F.col("worst")).otherwise(F.lit(-2.0)).alias("worst"))
    rows = lists.join(known, "u")

    def compare(table):
        v = table.column("v").to_numpy()
        order = np.argsort(v, kind="stable")
        v, u, new, worst = v[order], table.column("u").to_numpy()[order], table.column("new").to_numpy()[order], table.column("worst").to_numpy()[order]
        blobs = table.column("blob").to_pylist()
        blobs = [blobs[i] for i in order]
        start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        count = np.diff(np.append(start, len(v)))
        size = np.array([len(x) for x in blobs])
        out = []
        for m in np.unique(count):  # vectors with lists of one length at once
            if m < 2:
                continue
            at = start[count == m][:, None] + np.arange(m)
            at = at[size[at].min(1) == size[at].max(1)]
            for n in np.unique(size[at[:, 0]]):
                own = at[size[at[:, 0]] == n]
                x = _matrix([blobs[i] for i in own.ravel()], kind).reshape(len(own), m, -1)
                s = np.einsum("gid,gjd->gij", x, x, optimize=True)
                g, i, j = np.nonzero(np.triu(np.ones((m, m), bool), 1)[None] & (new[own][:, :, None] | new[own][:, None, :])
                                     & ((s > np.minimum(worst[own][:, :, None], worst[own][:, None, :])) | (s >= threshold)))
                out.append(np.stack([own[g, i], own[g, j]], 1))
                out[-1] = (out[-1], s[g, i, j])
        if not out:
            return _table([], [], [], [])
        pairs, sim = np.concatenate([p for p, _ in out]), np.concatenate([s for _, s in out])
        i, j = pairs[:, 0], pairs[:, 1]
        linked = sim >= threshold
        tree = np.flatnonzero(linked)[_forest(u[i][linked], u[j][linked])]
        a, b, s = np.concatenate([u[i], u[j]]), np.concatenate([u[j], u[i]]), np.concatenate([sim, sim])
        better = s > np.concatenate([worst[i], worst[j]])
        a, b, s = a[better], b[better], s[better]
        order = np.lexsort((b, -s, a))
        a, b, s = a[order], b[order], s[order]
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, s = a[fresh], b[fresh], s[fresh]
        top = np.arange(len(a)) - np.searchsorted(a, a) < k
        return _table(np.concatenate([a[top], u[i][tree]]), np.concatenate([b[top], u[j][tree]]), np.concatenate([s[top], sim[tree]]),
                      np.arange(top.sum() + len(tree)) >= top.sum())

    return rows.groupBy(F.pmod(F.xxhash64("v"), F.lit(buckets)).alias("bucket")).applyInArrow(compare, PROPOSAL)


def _count_links(reps: DataFrame, groups: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(id, others): linked rows of other classes, each component compared whole in blocks."""
    members = groups.join(reps.select("id", "blob", "weight"), "id")
    need = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = members.join(need, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("component", "id", "weight", "blob", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "component", "id", "weight", "blob", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def compare(key, group):
        block, ids, weight = (group.column(c).to_numpy() for c in ("block", "id", "weight"))
        x = _matrix(group.column("blob").to_pylist(), kind)
        left, right = block == key[1].as_py(), block == key[2].as_py()
        linked = x[left] @ x[right].T >= threshold
        if key[1].as_py() == key[2].as_py():
            np.fill_diagonal(linked, False)
            return pa.table({"id": ids[left], "n": linked @ weight[left]})
        return pa.table({"id": np.concatenate([ids[left], ids[right]]), "n": np.concatenate([linked @ weight[right], weight[left] @ linked])})

    counted = rows.repartition("component", "x", "y").groupBy("component", "x", "y").applyInArrow(compare, "id long, n long")
    return counted.groupBy("id").agg(F.sum("n").alias("others"))


def _audit(reps: DataFrame, counts: DataFrame, kind: str, threshold: float, audit: int) -> float:
    """Share of the true links of ``audit`` vectors, chosen by a hash, that were found: the mean over
    vectors with links, or over those with fewer than 16 if that is less."""
    total = reps.count()
    share = min(1.0, audit / max(1, total))
    queries = reps.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).join(counts, "id", "left")
    asked = queries.select("id", "label", "blob", "weight", F.coalesce("others", F.lit(0)).alias("others")).toArrow()
    if not asked.num_rows:
        return 1.0
    shared = reps.sparkSession.sparkContext.broadcast((asked["label"].to_pylist(), asked["blob"].to_pylist(), asked["id"].to_numpy()))

    def brute(batches):
        labels, blobs, ids = shared.value
        groups: dict = {}
        for n, key in enumerate(zip(labels, map(len, blobs))):
            groups.setdefault(key, []).append(n)
        ready = {key: (np.array(at), _matrix([blobs[i] for i in at], kind)) for key, at in groups.items()}
        found = np.zeros(len(ids), np.int64)
        for batch in batches:
            own: dict = {}
            own_blobs, own_ids, weight = batch.column("blob").to_pylist(), batch.column("id").to_numpy(), batch.column("weight").to_numpy()
            for n, key in enumerate(zip(batch.column("label").to_pylist(), map(len, own_blobs))):
                if key in ready:
                    own.setdefault(key, []).append(n)
            for key, rows in own.items():
                at, q = ready[key]
                linked = (q @ _matrix([own_blobs[i] for i in rows], kind).T >= threshold) & (ids[at][:, None] != own_ids[rows][None, :])
                found[at] += linked @ weight[rows]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found)], names=["id", "n"])

    true = reps.mapInArrow(brute, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    there = {r["id"]: r["n"] for r in true.collect()}  # a row for each audited vector
    found = [(there[i], n / there[i]) for i, n in zip(asked["id"].to_pylist(), asked["others"].to_pylist()) if there[i]]
    means = [sum(s for _, s in some) / len(some) for some in (found, [f for f in found if f[0] < 16]) if some]
    return min(means, default=1.0)


def dedup_embeddings(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98,
                     k: int = 8, tables: int = 8, most_rounds: int = 8, least_change: float = 0.02, audit: int = 512, most_passes: int = 4) -> DataFrame:
    """One row per vector: ``id, n_links, component_id, kept``."""
    packed, kind = vectors(rows, id_col, vector_col, label_col)
    packed = packed.withColumn("key", F.when(F.col("blob").isNotNull(), F.sha2("blob", 256))).checkpoint()
    reps = packed.where("blob IS NOT NULL").groupBy("label", "key").agg(F.min("id").alias("low"), F.count("*").alias("weight"), F.first("blob").alias("blob")).checkpoint()
    # classes have numbers of their own: ids may be null or shared by several classes
    reps = reps.withColumn("id", F.monotonically_increasing_id()).withColumn("size", F.length("blob")).checkpoint()
    total = reps.count()
    buckets = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // 1024))
    graph, links, counts, groups = None, None, None, None
    for turn in range(most_passes):
        proposals = _initial(reps, kind, tables, turn, k, threshold).checkpoint()
        for _ in range(most_rounds):
            found = proposals.where("link").select("a", "b")
            links = found if links is None else links.unionAll(found)
            graph = _merge(graph.drop("new") if graph is not None else None, proposals, k, buckets).checkpoint()
            if graph.where("new").count() <= least_change * k * total:
                break
            proposals = _descend(graph, reps, kind, k, threshold, buckets).checkpoint()
            free_finished_rounds(rows.sparkSession)
        else:  # the last descent's links count too
            links = links.unionAll(proposals.where("link").select("a", "b"))
        links = links.distinct().checkpoint()
        groups = components(links).checkpoint()
        counts = _count_links(reps, groups, kind, threshold).checkpoint()
        recall = _audit(reps, counts, kind, threshold, audit)
        if recall >= 1:
            break
    if recall < 0.9:
        raise RuntimeError(f"audited recall {recall:.3f} after {most_passes} passes")
    placed = reps.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = placed.groupBy("component").agg(F.min("low").alias("lowest"))
    by_class = placed.join(counts, "id", "left").join(lowest, "component").select(
        F.col("label").alias("of_label"), F.col("key").alias("of_key"), F.col("lowest").alias("component"), (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    out = packed.select("id", "label", "key").join(by_class, (F.col("key") == F.col("of_key")) & (F.col("label") == F.col("of_label")), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"),
                      F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"))
