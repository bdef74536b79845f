import random
import re

import pytest

LOWER = {k: k + 32 for k in range(65, 91)}
#: Columns whose names operators use inside.
CLASH = "id string, size string, class_id string, component string, place string, score double, n long, key string, text_1 string"
CLASH_VALUES = ("x", "y", "z", "c", "p", 0.5, 7, "k", "t")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles_of(text, n=5):
    w = words_of(text)
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def random_text(rnd, n, vocabulary=400):
    return " ".join(f"w{int(rnd.random() ** 2 * vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """(rows, frame) of documents: plain ones, copies, near copies, and every odd case."""
    rnd = random.Random(3)
    rows = [(i, random_text(rnd, rnd.randint(5, 80)), f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, rows[7][1], "s0") for i in range(5)]                              # exact copies
    base = random_text(rnd, 120).split()
    for i in range(12):                                                                  # near copies
        w = list(base)
        w[(i * 9) % 120] = f"new{i}"
        rows.append((200 + i, " ".join(w), "s1"))
    rows += [(300, None, "s0"), (301, "", "s0"), (302, " \t\n", None), (None, random_text(rnd, 30), "s2"), (303, "one two", None),
             (304, "One  TWO", "s2"), (305, "é" * 3 + " ÀB " + "q" * 6000, "s2"), (306, random_text(rnd, 60_000, 3000), "s1"),
             (9, rows[9][1], "s0"), (9, rows[9][1], "s0"), (307, rows[20][1].upper(), "s1"), (None, None, None)]
    frame = spark.createDataFrame([r + CLASH_VALUES for r in rows], "doc_id long, text string, source string, " + CLASH)
    return rows, frame.repartition(3)
