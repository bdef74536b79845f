import numpy as np

from relfeat.llm import embed_dedup


def brute(rows, threshold=0.98):
    ok = []
    for i, v, label in rows:
        good = label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.asarray(v, np.float32).astype(float) if good else None)
    links = {n: [] for n in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] is not None and ok[b] is not None and rows[a][2] == rows[b][2] and len(ok[a]) == len(ok[b]):
                if ok[a] @ ok[b] / np.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= threshold:
                    links[a].append(b)
                    links[b].append(a)
    out = []
    for n in range(len(rows)):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[n][0], len(links[n]), low, rows[n][0] == low))
    return sorted(out, key=str)


def vectors():
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.standard_normal(16).tolist(), i % 2) for i in range(150)]
    centre = rnd.standard_normal(16)
    rows += [(1000 + i, (centre + rnd.standard_normal(16) * 0.05).tolist(), 1) for i in range(300)]  # a dense group
    chain = rnd.standard_normal(16)
    for i in range(10):  # neighbours link, ends do not
        chain = chain + rnd.standard_normal(16) * 0.12
        rows.append((2000 + i, chain.tolist(), 0))
    rows += [(3000 + i, rows[5][1], 1) for i in range(4)] + [(4000, (np.array(rows[5][1]) * 3).tolist(), 1), (4001, rows[5][1], 0)]
    rows += [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 16, 1), (5003, [1.0, None] * 8, 1), (5004, [float("nan")] * 16, 1), (5005, [float("inf")] * 16, 1),
             (5006, rows[5][1], None), (5007, rows[5][1][:8], 1), (5008, rows[5][1][:8], 1), (7, rows[7][1], 1), (7, rows[7][1], 1)]
    return rows


def test_links_match_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame([r + ("x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, id string, blob double")
    got = embed_dedup.dedup_embeddings(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.01], 1), (2, None, None)], "vec_id long, embedding array<double>, label int")
    got = embed_dedup.dedup_embeddings(frame)
    assert got.count() == 4 and got.where("vec_id = 2 AND n_links = 0 AND kept").count() == 1
    assert embed_dedup.dedup_embeddings(frame.limit(0)).count() == 0


def test_rows_link_by_their_own_vectors(spark):
    """Null ids, ids that other vectors repeat, and numbers whose squares leave the doubles' range."""
    rows = [(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (4, [1.0, 0.01], 1),
            (1, [1.0, 0.0], 2), (1, [0.0, 1.0], 2), (2, [1.0, 0.01], 2), (3, [1.0, 0.02], 2),
            (10, [1e200, 1e198], 3), (11, [2e-200, 2e-202], 3), (12, [0.0, 1e-310], 3), (13, [5e-324, 1e300], 3),
            (None, [3.0, 1.0], 4), (None, [3.0, 1.01], 4)]
    got = embed_dedup.dedup_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    want = [(None, 2, 4, False), (None, 2, 4, False), (4, 2, 4, True),
            (1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (3, 2, 1, False),
            (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True), (13, 1, 12, False), (None, 1, None, True), (None, 1, None, True)]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)


def test_links_of_the_last_descent_count(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embed_dedup.dedup_embeddings(frame, most_rounds=1, tables=1).collect()
    want = {str(r[:2]) for r in brute(rows)}
    assert sum(str(tuple(r)[:2]) in want for r in got) >= 0.9 * len(rows)
