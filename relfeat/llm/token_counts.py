"""Token counts of whole texts under a given tokenizer.

Texts are encoded by the tokenizer's own library inside Arrow functions, which return lengths
only.  Texts are split at safe boundaries into short pieces; of a slice of rows, each piece whose
length the worker doesn't know yet is encoded once, in encoding batches of about ``batch_bytes``
bytes, so that a batch holds about the same work whatever the lengths of the texts are.  Lengths of
pieces of up to ``PIECE_BYTES`` stay known until they take ``KNOWN_BYTES``; then the worker begins
anew.

A boundary is safe where the tokens of the two sides, one after the other, are the tokens of the
whole.  The only boundary used is a single space between two ASCII letters or digits, and only
with a tokenizer that is found to end a token there: a ``.json`` file must have a byte-level
pre-tokenizer with its own pattern, no normalizer, and no added token that holds a space or takes
space off its neighbours; no piece of a ``.model`` file may hold the space mark after another
character.  Otherwise, and in a text without such a boundary, a text is encoded whole.

Defined results: null counts as an empty text (0 bytes, 0 tokens); a null or repeated id is a row
like any other; special strings inside texts are treated as the library does by default; no
tokens are added, nothing is truncated or padded; an empty table gives no rows; other columns are
not read.
"""
from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relfeat.llm.tokens import slices

#: A single space between two ASCII letters or digits, and the place before it.
SAFE = re.compile(rb"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
BEFORE_SAFE = re.compile(rb"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")
#: Longest piece whose length stays known, and how many bytes of known pieces a worker keeps.
PIECE_BYTES, KNOWN_BYTES = 64, 16 << 20
#: A tokenizer's file is sent to the workers up to this size.
MOST_FILE_BYTES = 64 << 20
#: The tokenizers that this worker has loaded.
_LOADED: dict[str, tuple] = {}


def _json_lengths(raw: bytes) -> tuple[Callable, bool, bool]:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
    t = Tokenizer.from_str(raw.decode("utf-8"))
    t.no_truncation()
    t.no_padding()
    said = json.loads(raw)
    plain = not any(" " in a["content"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in said["added_tokens"])
    kind = said["pre_tokenizer"] or {}
    ends = said["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True)
    return (lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]), plain and ends, False


def _model_lengths(raw: bytes) -> tuple[Callable, bool, bool]:
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_proto=raw)
    inner = any("▁" in (p := sp.id_to_piece(i)).lstrip("▁") for i in range(sp.get_piece_size()))
    # every text begins with a space mark of its own, so the piece after a cut goes without its space
    first = sp.encode("a", out_type=str)[:1] == ["▁a"] and sp.encode("a b") == sp.encode("a") + sp.encode("b")
    return (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), first and not inner, True


def _load(name: str, raw: bytes) -> tuple[Callable, bool, bool]:
    """(lengths of a list of texts, whether ``SAFE`` boundaries hold, whether the space goes)."""
    if name not in _LOADED:
        _LOADED[name] = _model_lengths(raw) if name.endswith(".model") else _json_lengths(raw)
    return _LOADED[name]


def split_safely(text: bytes, drop_space: bool) -> list[bytes]:
    """A UTF-8 text cut at all safe boundaries."""
    return (SAFE if drop_space else BEFORE_SAFE).split(text)


def _even_batches(pieces: Iterable[bytes], batch_bytes: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for p in pieces:
        if held and size + len(p) > batch_bytes:
            yield held
            held, size = [], 0
        held.append(p)
        size += len(p)
    if held:
        yield held


class Counter:
    """Token counts of texts, piece by piece."""

    def __init__(self, lengths: Callable, splits: bool, drop_space: bool, batch_bytes: int):
        self.lengths, self.splits, self.drop_space, self.batch_bytes = lengths, splits, drop_space, batch_bytes
        self.known: dict[bytes, int] = {}
        self.size = 0

    def count(self, texts: list[bytes]) -> list[int]:
        if self.size > KNOWN_BYTES:
            self.known, self.size = {}, 0
        rows = [split_safely(t, self.drop_space) if self.splits else [t] for t in texts]
        own = {p: 0 for row in rows for p in row if p not in self.known}
        for some in _even_batches(own, self.batch_bytes):
            own.update(zip(some, self.lengths([p.decode("utf-8") for p in some])))
        known = self.known
        counts = [sum(own[p] if p in own else known[p] for p in row) for row in rows]
        for p, n in own.items():
            if len(p) <= PIECE_BYTES:
                known[p] = n
                self.size += len(p)
        return counts


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512,
                 batch_bytes: int = 1 << 18) -> DataFrame:
    """One row per document: ``id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    ``path``: a tokenizer's ``.json`` file (library tokenizers) or ``.model`` file (sentencepiece),
    read on the driver and sent to the workers once."""
    name = os.path.basename(path)
    if not name.endswith((".json", ".model")):
        raise ValueError(f"{name}: a .json or .model file is needed")
    if os.path.getsize(path) > MOST_FILE_BYTES:
        raise ValueError(f"{name}: over {MOST_FILE_BYTES} bytes")
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(*_load(name, sent.value), batch_bytes)
        for part in slices(batches):
            counts = counter.count(part.column(1).cast(pa.large_binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = slim.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
