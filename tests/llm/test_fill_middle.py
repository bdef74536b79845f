import hashlib
import random
import re

import numpy as np
import pytest

from relfeat.llm import fill_middle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(key, text):
    text = text or ""
    h = [int(sha(f"1:{'' if key is None else key}")[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_rows_equal_the_plain_ones(spark, corpus):
    rows, frame = corpus
    more = [(400 + i, t) for i, t in enumerate(["<P>", "a<S>b", "x <M", "é日本𝄞" * 40, "<", "a" * 31 + "é", "𝄞" * 3000])]
    frame = frame.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*m, 1) for m in more], "doc_id long, text string, n long"))
    got = fill_middle.transform_middle(frame).collect()
    want = []
    for key, text in [r[:2] for r in rows] + more:
        *head, output = plain_row(key, text)
        want.append((key, *head, sha(output), sha(text or ""), output))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_every_rank_is_reached_exactly(monkeypatch):
    rnd = random.Random(2)
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 100)
    for _ in range(20):
        text = "".join(rnd.choice("ab é日𝄞\n") for _ in range(rnd.randint(0, 3000)))
        index = fill_middle.SkipList(np.frombuffer(text.encode(), dtype=np.uint8))
        assert index.n == index.points == len(text) and index.size == len(text.encode())
        for rank in {0, index.n, *(rnd.randint(0, len(text)) for _ in range(60))}:
            assert index.seek(rank) == (rank, len(text[:rank].encode()))
    assert len(index.lanes) >= 2


@pytest.mark.parametrize("unit", [r"\w+", r"\S+\s*", r"(?s:.)"])
def test_units_of_a_pattern(spark, unit):
    rnd = random.Random(3)
    texts = [(i, "".join(rnd.choice("ab é日 \n.") for _ in range(rnd.randint(0, 400)))) for i in range(40)] + [(40, "   "), (41, None)]
    for r in fill_middle.transform_middle(spark.createDataFrame(texts, "doc_id long, text string"), unit=unit).collect():
        text = dict(texts)[r.doc_id] or ""
        ends = [0] + [m.end() for m in re.finditer(unit, text)]
        assert r.n == len(ends) - 1 and r.restored_sha256 == sha(text)
        a, b, *_ = fill_middle.decide("1", r.doc_id, r.n)
        if r.form != "plain":
            assert (r.prefix_chars, r.middle_chars) == (ends[a], ends[b] - ends[a])


def test_a_long_text_has_many_lanes_and_short_searches():
    data = np.frombuffer(b"abc " * 300_000, dtype=np.uint8)
    index = fill_middle.SkipList(data)
    assert len(index.lanes) >= 3 and sum(len(lane.units) for lane in index.lanes) < index.n / 16
    assert [index.seek(r) for r in (0, 1, 777_777, 1_200_000)] == [(r, r) for r in (0, 1, 777_777, 1_200_000)]


def test_broken_outputs_raise_and_empty_tables(spark):
    with pytest.raises(ValueError):
        fill_middle.restore(b"<P>a<M>b", "psm")
    with pytest.raises(ValueError):
        fill_middle.restore(b"a", "spm")
    frame = spark.createDataFrame([], "doc_id string, text string")
    assert fill_middle.transform_middle(frame).count() == 0
