import random

from relfeat.llm import decontam

from .conftest import shingles_of, words_of


def items_and_docs(spark, corpus):
    rows, frame = corpus
    rnd = random.Random(9)
    long_words = words_of(rows[[r[0] for r in rows].index(306)][1])
    items = [(1, " ".join(long_words[40_000:40_030])), (2, " ".join(long_words[10:18])), (3, "one two"), (4, "nowhere to be found in any of these texts"),
             (5, None), (6, ""), (None, rows[3][1]), (7, " ".join(words_of(rows[5][1])).upper()), (3, "one two"), (8, "one"),
             (9, " ".join(long_words[100:130] + [f"k{i}" for i in range(4)])), (10, " ".join(long_words[500:520] + [f"z{i}" for i in range(10)]))]
    rnd.shuffle(items)
    return rows, frame, items, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, id string")


def brute(rows, items):
    out = []
    for d, text, _ in rows:
        w = words_of(text)
        runs = {n: {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} for n in (1, 2, 5)}
        for i, item in items:
            s = shingles_of(item)
            if s:
                n = min(5, len(words_of(item)))
                k = len(s & runs[n])
                if k and k >= 0.8 * len(s):
                    out.append((d, i, k))
    return sorted(out, key=str)


def test_pairs_match_brute_force(spark, corpus):
    rows, frame, items, table = items_and_docs(spark, corpus)
    expected = brute(rows, items)
    got = decontam.find_items(frame, table).collect()
    assert sorted(((r.doc_id, r.item_id, r.shared) for r in got), key=str) == expected
    assert any(r.item_id == 9 and r.containment < 1 for r in got) and not any(r.item_id in (4, 5, 6, 10) for r in got)
    in_blocks = decontam.find_items(frame, table, block_chars=300).collect()
    assert sorted(map(str, in_blocks)) == sorted(map(str, got))


def test_drop_contaminated_keeps_clean_rows_whole(spark, corpus):
    rows, frame, items, table = items_and_docs(spark, corpus)
    bad = {(d, t) for d, t, _ in rows if brute([(d, t, None)], items)}
    kept = decontam.drop_contaminated(frame, table)
    assert kept.columns == frame.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((d, t) for d, t, _ in rows if (d, t) not in bad), key=str)


def test_empty_tables(spark, corpus):
    rows, frame, _, table = items_and_docs(spark, corpus)
    assert decontam.find_items(frame, table.limit(0)).count() == 0
    assert decontam.find_items(frame.limit(0), table).count() == 0
    assert decontam.drop_contaminated(frame, table.limit(0)).count() == len(rows)
