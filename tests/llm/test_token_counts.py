import random

import public_tokenizers
import pytest

from relfeat.llm import token_counts

from .conftest import random_text


def plain_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(sp.encode(t)) for t in texts]
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_librarys(spark, corpus, name):
    rows, frame = corpus
    texts = [t or "" for _, t, _ in rows]
    got = token_counts.count_tokens(frame, public_tokenizers.path(name), batch_bytes=500).collect()
    want = sorted((str(d), len(t.encode()), n, n > 512) for (d, _, _), t, n in zip(rows, texts, plain_counts(name, texts)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


ODD = ["", " ", "a", "don't  we'll I'm a's  b", "x <|endoftext|> y<|endoftext|>", "line\n\nline \n  two\t\tthree   four", "ééé àà  日本語 テスト 12 34", "a 1 b 22 c333 d", "q" * 5000,
       " lead and trail  ", " nbsp a b c d", "mixed's 'll 've text's 's a", "Σίσυφος ΣΑΣ a b", "é a é b", "</s> <s> <unk> a b"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_every_cut_keeps_the_count(name):
    with open(public_tokenizers.path(name), "rb") as f:
        lengths, splits, drop = token_counts._load(name, f.read())
    assert splits == (name != "word_bpe_49k.json")
    rnd = random.Random(5)
    texts = ODD + ["".join(rnd.choice("ab 'st1\n.é ") for _ in range(rnd.randint(1, 300))) for _ in range(300)]
    if splits:
        cut = [[p.decode() for p in token_counts.split_safely(t.encode(), drop)] for t in texts]
        assert [sum(lengths(p)) for p in cut] == plain_counts(name, texts) and max(map(len, cut)) > 10


def test_batches_are_even_and_known_pieces_are_not_encoded_again(monkeypatch):
    sent = []

    def lengths(texts):
        sent.append(texts)
        return [len(t) for t in texts]

    monkeypatch.setattr(token_counts, "KNOWN_BYTES", 2000)
    counter = token_counts.Counter(lengths, True, False, 100)
    text = random_text(random.Random(1), 5000, 60).encode()
    assert b"".join(token_counts.split_safely(text, False)) == text
    assert counter.count([text, b"", text]) == [len(text), 0, len(text)]
    encoded = [t for batch in sent for t in batch]
    assert len(encoded) == len(set(encoded)) < 70 and max(sum(map(len, b)) for b in sent) <= 100
    before = len(encoded)
    assert counter.count([text]) == [len(text)] and sum(map(len, sent)) - before <= 1  # but for the text's first word
    assert counter.count([b"x" * 3000, " y".join("ab" * 300).encode()]) == [3000, 600 + 2 * 599]
    assert b"x" * 3000 not in counter.known and counter.size <= 2100


def test_odd_tables_and_files(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a b", 3), (1, "a b", 3)], "doc_id long, text string, n_tokens long")
    assert sorted((str(r.doc_id), *r[1:]) for r in token_counts.count_tokens(frame, path).collect()) == [("1", 0, 0, False), ("1", 3, 2, False), ("1", 3, 2, False), ("None", 0, 0, False)]
    assert token_counts.count_tokens(frame.limit(0), path).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(frame, public_tokenizers.path("byte_bpe_50k.tiktoken"))
