import collections
import math
import tracemalloc
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from relfeat.llm import suffix_tree

from .conftest import words_of


def plain_model(rows, least, power=0.75, gain=10.0):
    docs = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0, words_of(t) + ["</s>"]) for i, t in rows]
    c0, starts = collections.Counter(), 0
    for _, held, w in docs:
        if not held:
            c0.update(w)
            starts += 1
    n, v = sum(c0.values()), len(c0)
    one = {w: k for w, k in c0.items() if k >= least and w != "</s>"}
    if starts >= least:
        one["<s>"] = starts

    def positions(w):
        for i, x in enumerate(w):
            yield x, w[i - 1] if i else "<s>", w[i - 2] if i > 1 else "<s>" if i == 1 else None

    c1, c2 = collections.Counter(), collections.Counter()
    for _, held, w in docs:
        if not held:
            c1.update((a, x) for x, a, b in positions(w) if a in one)
    two = {k: m for k, m in c1.items() if m >= least and k[1] in one}
    for _, held, w in docs:
        if not held:
            c2.update((b, a, x) for x, a, b in positions(w) if (b, a) in two)
    p0 = lambda x, out: (max(c0[x] - out, 0) + 0.1) / (n - out + 0.1 * (v + 1))
    p1 = lambda a, x, out: (max(c1[a, x] - out, 0) + one[a] ** power * p0(x, out)) / (max(one[a] - out, 0) + one[a] ** power)
    p2 = lambda b, a, x, out: (max(c2[b, a, x] - out, 0) + two[b, a] ** power * p1(a, x, out)) / (max(two[b, a] - out, 0) + two[b, a] ** power)
    g1, g2 = collections.Counter(), collections.Counter()
    for (a, x), k in c1.items():
        g1[a] += k * math.log(p1(a, x, 1) / p0(x, 1))
    for (b, a, x), k in c2.items():
        g2[b, a] += k * math.log(p2(b, a, x, 1) / p1(a, x, 1))
    keep2 = {k for k, g in g2.items() if g >= gain}
    keep1 = {k for k, g in g1.items() if g >= gain} | {a for _, a in keep2}
    out = []
    for i, held, w in docs:
        chances = [p2(b, a, x, 0) if (b, a) in keep2 else p1(a, x, 0) if a in keep1 else p0(x, 0) for x, a, b in positions(w)]
        out.append((i, held, len(w), sum(c0[x] > 0 for x in w), n, sum(math.log10(p0(x, 0)) for x in w), sum(map(math.log10, chances))))
    return out, len(keep1), len(keep2)


def key(r):
    return (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))


def test_scores_match_a_plain_model(corpus):
    rows, frame = corpus
    expected, one, two = plain_model([r[:2] for r in rows], least=4)
    assert one and two  # both depths are in use
    got = suffix_tree.score_documents(frame, min_count=4).collect()
    assert len(got) == len(rows)
    for e, g in zip(sorted(expected, key=key), sorted((tuple(r) for r in got), key=key)):
        assert e[:5] == g[:5] and math.isclose(e[5], g[5], rel_tol=1e-9) and math.isclose(e[6], g[6], rel_tol=1e-9)


def test_chances_of_a_context_sum_to_one():
    n, v, counts, c, a = 100, 4, [60, 30, 9, 1], 60, 60**0.75
    root = [(k + 0.1) / (n + 0.1 * (v + 1)) for k in counts] + [0.1 / (n + 0.1 * (v + 1))]
    one = [(k + a * p) / (c + a) for k, p in zip([40, 15, 5, 0, 0], root)]
    assert math.isclose(sum(root), 1) and math.isclose(sum(one), 1)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_tree.score_documents(empty).count() == 0


def test_hot_words_pairs_and_triples_are_dealt_out(spark):
    """One pair that is a third of all positions, in every text."""
    rows = [(i, "hot pair " * 40 + f"x{i % 7} y{i % 5}") for i in range(80)]
    expected, _, _ = plain_model(rows, least=16)
    got = suffix_tree.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for e, g in zip(sorted(expected, key=key), sorted((tuple(r) for r in got), key=key)):
        assert e[:5] == g[:5] and math.isclose(e[6], g[6], rel_tol=1e-9)

class _OneTask:
    """Stands for the documents: ``mapInArrow`` gives the task's function."""

    def mapInArrow(self, function, schema):
        return function


def test_memory_of_a_map_task():
    words = np.random.default_rng(5).integers(0, 50_000, size=1 << 21)
    texts = [" ".join(f"w{w}" for w in part) for part in words.reshape(256, -1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 16), pa.int64()), pa.array(texts[i:i + 16])], names=["id", "text"]) for i in range(0, 256, 16)]
    none = np.empty(0, np.uint64)
    model = suffix_tree.Contexts(len(words), 50_000, 16, [none, none, none], none, none, 8, 2)
    run = suffix_tree._positions(_OneTask(), SimpleNamespace(value=model))
    tracemalloc.start()
    try:
        rows = sum(batch.num_rows for batch in run(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows >= 16
    assert peak < 100 << 20


def test_buckets_come_whole_and_nothing_is_sorted(corpus, monkeypatch):
    """Many buckets a partition: each is read by itself, in turn."""
    rows, frame = corpus
    monkeypatch.setattr(suffix_tree, "BUCKET", 32)
    made, own = [], suffix_tree._by_bucket

    def seen(positions, m):
        placed = own(positions, m)
        made.append((m.buckets, m.partitions, placed.getNumPartitions(), placed.toDebugString().decode(), placed.glom().map(lambda p: [r["bucket"] for r in p]).collect()))
        return placed

    monkeypatch.setattr(suffix_tree, "_by_bucket", seen)
    expected, _, _ = plain_model([r[:2] for r in rows], least=4)
    got = suffix_tree.score_documents(frame, min_count=4).collect()
    for e, g in zip(sorted(expected, key=key), sorted((tuple(r) for r in got), key=key)):
        assert e[:5] == g[:5] and math.isclose(e[5], g[5], rel_tol=1e-9) and math.isclose(e[6], g[6], rel_tol=1e-9)
    buckets, partitions, held, lineage, parts = made[0]
    assert buckets > 2 * partitions and held == partitions and "CoalescedRDD" in lineage
    runs = [b for part in parts for i, b in enumerate(part) if i == 0 or part[i - 1] != b]
    assert len(runs) == len(set(runs))
