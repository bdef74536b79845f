import random

import pytest

from relfeat.llm import near_join

from .conftest import random_text, shingles_of


def brute(rows, threshold=0.8):
    sets = [frozenset(shingles_of(t)) for _, t, _ in rows]
    links = [[m for m in range(len(rows)) if m != n and sets[n] and sets[m] and len(sets[n] & sets[m]) >= threshold * len(sets[n] | sets[m]) - 1e-9] for n in range(len(rows))]
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        low = lambda these: min((rows[m][0] for m in these if rows[m][0] is not None), default=None)
        out.append((i, low([m for m in range(len(rows)) if sets[n] and sets[m] == sets[n]] or [n]), len(links[n]), low(seen)))
    return sorted(out, key=str)


@pytest.mark.parametrize("texts, ids", [(256, 2_000_000), (3, 0)])
def test_links_match_brute_force(corpus, monkeypatch, texts, ids):
    monkeypatch.setattr(near_join, "BLOCK_TEXTS", texts)  # 3: groups are compared in many blocks
    rows, frame = corpus
    got = near_join.near_join(frame, broadcast_ids=ids).collect()
    expected = brute(rows)
    assert sorted((tuple(r) for r in got), key=str) == expected
    assert sum(n >= 11 for _, _, n, _ in expected) >= 12  # the near copies


def test_first_of_each_group_stays(corpus):
    rows, frame = corpus
    kept = near_join.keep_first(frame)
    assert kept.columns == frame.columns
    expected = [r for r, b in zip(rows, [next(x for x in brute(rows) if x[0] == r[0]) for r in rows]) if r[0] is None or b[3] == r[0]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((d, t) for d, t, _ in expected), key=str)


def test_reused_and_missing_ids(spark):
    """Ids that two texts share, repeated rows, and groups of rows without an id."""
    rnd = random.Random(5)
    base, other, lone, third = (random_text(rnd, 60) for _ in range(4))
    near = " ".join(base.split()[:-1] + ["changed"])
    rows = [(1, base, "a"), (1, base, "a"), (7, near, "b"), (7, other, "c"),              # 7: a near copy and a clean text
            (None, lone, "d"), (None, lone, "e"), (None, " ".join(lone.split()[:-1] + ["end"]), "f"),  # only null ids
            (3, third, "g"), (3, base, "h"), (4, third + " more", "i"), (None, third, "j"), (None, None, "k"), (8, "", "l"), (8, "", "l")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for ids in (2_000_000, 0):
        got = near_join.near_join(frame, broadcast_ids=ids).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    kept = lambda **how: sorted((r.source for r in near_join.keep_first(frame, **how).collect()))
    nameless = set(kept(one_row=True)) & set("def")  # by class key: one of three rows
    assert len(nameless) == 1
    assert [s for s in kept(one_row=True) if s not in "def"] == ["a", "c", "g", "k", "l", "l"]
    assert [s for s in kept() if s not in "def"] == ["a", "a", "c", "g", "k", "l", "l"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_join.near_join(empty).count() == 0 and near_join.keep_first(empty).count() == 0


def test_pruning_bounds():
    least = near_join.least_matches(0.8, 1e-6)
    assert len(least) == near_join.HASHES // near_join.STEP and all(0 < m < (k + 1) * near_join.STEP * 0.8 for k, m in enumerate(least))
    assert least == sorted(least)
