import random

import numpy as np
import pyarrow as pa

from relfeat.llm import tokens

from .conftest import shingles_of, words_of

TEXTS = ["", None, "a", "A b\tC\n\x0bd\x0ce\rf g", "  x  ", "é ÉÀ x", "w " * 3000 + "end", "q" * 9000 + " z", "a b c d e", "b c d e f a"]


def test_words_match_the_definition():
    prints, offsets = tokens.words(pa.array(TEXTS))
    seen = {}
    for i, text in enumerate(TEXTS):
        expected = words_of(text)
        own = prints[offsets[i]:offsets[i + 1]]
        assert len(own) == len(expected)
        for w, h in zip(expected, own):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_change_nothing(monkeypatch):
    whole = tokens.words(pa.array(TEXTS), heads=(3, 5), tail=3)
    monkeypatch.setattr(tokens, "PIECE_BYTES", 7)
    for a, b in zip(whole, tokens.words(pa.array(TEXTS), heads=(3, 5), tail=3)):
        assert np.array_equal(a, b)


def test_slices_of_columns():
    column = pa.array(TEXTS)
    prints, offsets = tokens.words(column)
    part, own = tokens.words(column.slice(3, 4))
    assert np.array_equal(part, prints[offsets[3]:offsets[7]]) and np.array_equal(np.diff(own), np.diff(offsets)[3:7])


def test_shingles_match_brute_force():
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    values, offsets = tokens.distinct_in_rows(*tokens.shingles(*tokens.words(pa.array(texts)), 5))
    seen = {}
    for i, text in enumerate(texts):
        assert len(shingles_of(text)) == offsets[i + 1] - offsets[i]
        key = frozenset(values[offsets[i]:offsets[i + 1]].tolist())
        assert seen.setdefault(frozenset(shingles_of(text)), key) == key
    assert len(set(seen.values())) == len(seen)
