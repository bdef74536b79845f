import math
import random
import re

import numpy as np
import pytest

from relfeat.llm import lexical_search

from .conftest import LOWER, random_text


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain_search(docs, items, k=10):
    """Scores of all documents for all items: {position of item: [(doc_id, score), ...]}."""
    found = [(key, t) for key, text in docs if (t := terms_of(text))]
    n_docs, all_terms = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = {}
    for i, (_, text) in enumerate(items):
        best = []
        for key, t in found:
            m = 25 + (75 * len(t) * n_docs) // all_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in terms_of(text) if x in df)
            if score > 0:
                best.append((-score, key is None, key or 0, key))
        out[i] = [(key, -score) for score, _, _, key in sorted(best)[:k]]
    return out


def rows_of(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.item_id, []).append((r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.fixture(scope="module")
def small(corpus, spark):
    rows, frame = corpus
    rnd = random.Random(8)
    items = [(i, " ".join(rnd.sample((rows[i][1] or "x").split(), min(4, len((rows[i][1] or "x").split()))) + [f"w{i}"])) for i in range(30)]
    items += [(100, "w1 w1 W1 w2-w3"), (101, "nowhere"), (102, ""), (103, None), (104, "é" * 3 + " àb"), (105, rows[7][1]), (106, "One! two?"), (None, "w5 w6")]
    return [r[:2] for r in rows], frame, items, spark.createDataFrame([(*i, 1, 0.5) for i in items], "item_id long, text string, rank int, score double").repartition(3)


@pytest.mark.parametrize("sizes", [{}, {"tree_docs": 16, "leaf_docs": 2, "block_terms": 40}, {"tree_terms": 50, "leaf_docs": 1}])
def test_ranks_equal_brute_force(small, sizes):
    docs, frame, items, item_frame = small
    got = rows_of(lexical_search.search_items(frame, item_frame, **sizes))
    want = {items[i][0]: rows for i, rows in plain_search(docs, items).items() if rows}
    assert got == want and len(want) >= 33


def test_ties_repeated_rows_and_null_ids(spark):
    docs = [(5, "a b"), (3, "a b"), (None, "a b"), (3, "a b"), (9, "b a"), (8, "c"), (7, None)]
    items = spark.createDataFrame([(1, "a"), (1, "b c c")], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = lexical_search.search_items(frame, items, k=4).collect()
    assert sorted(r.doc_id for r in got) == [3, 3, 3, 3, 5, 5, 8, 9] and sorted(r["rank"] for r in got) == [1, 1, 2, 2, 3, 3, 4, 4]
    assert [r.doc_id for r in sorted(lexical_search.search_items(frame, items.limit(1), k=10).collect(), key=lambda r: r["rank"])] == [3, 3, 5, 9, None]


def test_text_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [(r.doc_id, r["rank"]) for r in lexical_search.search_items(docs, items).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert lexical_search.search_items(docs, items.limit(0)).count() == 0
    assert lexical_search.search_items(docs.limit(0), items).count() == 0


def test_the_tree_prunes_and_its_bounds_hold():
    rnd = np.random.default_rng(4)
    size, groups = 300, 40
    centres = [rnd.choice(size, 20, replace=False) for _ in range(groups)]
    lengths, place, s = [], [], []
    for i in range(2000):  # documents of one group share most terms
        p = np.unique(np.concatenate([centres[i % groups][:18], rnd.choice(size, 2)]))
        lengths.append(len(p)), place.append(p), s.append(rnd.integers(300_000, 900_000, len(p)))
    lengths, place, s = np.array(lengths), np.concatenate(place), np.concatenate(s)
    w = rnd.integers(1, 9000, size)
    q_place = np.concatenate(centres)
    q_at = np.arange(groups) * 20
    root = np.sqrt(w.astype(float))
    q_value = root[q_place]
    queries = (q_place, q_at, q_value, np.sqrt(np.add.reduceat(q_value**2, q_at)))
    tree = lexical_search.BallTree(lengths, place, s, root, queries, 16)
    at = np.cumsum(lengths) - lengths
    leaves = sum(x is not None for x in tree.leaf)
    for item in range(groups):
        weights = np.zeros(size, dtype=np.int64)
        weights[centres[item]] = w[centres[item]]
        exact = np.add.reduceat(s * weights[place], at)
        for node, leaf in enumerate(tree.leaf):
            if leaf is not None:
                assert exact[leaf[0]].max() <= tree.bounds[node][item]
        seen = []
        read = tree.search(item, weights, lambda: sorted(seen)[-10] if len(seen) >= 10 else 1, lambda rows, scores: seen.extend(scores))  # noqa: B023
        assert sorted(seen)[-10:] == sorted(exact)[-10:] and read < leaves / 2
    assert sorted(np.concatenate([x[0] for x in tree.leaf if x is not None])) == list(range(2000))
