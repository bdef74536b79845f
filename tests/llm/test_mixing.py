from relfeat.llm import mixing

from .conftest import words_of


def test_targets_and_words_taken(corpus):
    rows, frame = corpus
    got = mixing.mix_sources(frame).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(words_of(text))
    names = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:  # share, cap, share the excess again
        rate = (total - sum(2 * sizes[s] for s in names if s not in open_)) / sum(weights[s] for s in open_)
        over = {s for s in open_ if rate * weights[s] >= 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    target = {s: rate * weights[s] if s in open_ else 2.0 * sizes[s] for s in names}
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(d), len(words_of(t)), str(s)) for d, t, s in rows)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
    longest = max(r.size for r in got)
    for s in names:
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= longest
    again = mixing.mix_sources(frame.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_even_sources_come_near_their_targets(spark):
    frame = spark.createDataFrame([(i, "w " * (1 + i % 9), "ab"[i % 2] if i % 5 else None) for i in range(3000)], "doc_id long, text string, source string")
    taken = {}
    for r in mixing.mix_sources(frame).collect():
        t = taken.setdefault(r.source, [0, r.target])
        t[0] += r.taken
    assert all(abs(a - b) <= 30 for a, b in taken.values())


def test_empty_tables_and_texts(spark):
    frame = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix_sources(frame).collect()] == [(0, 0.0, 0)] * 2
    assert mixing.mix_sources(frame.limit(0)).count() == 0
