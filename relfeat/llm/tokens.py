"""Vectorised word tokens and word shingles of whole texts.

One definition for every word-based operator of this subpackage: ASCII letters are
lower-cased, a word is a maximal run of characters other than ``\\x20`` and ``\\x09-\\x0D``.
A word is represented by a 64-bit fingerprint computed with numpy over the UTF-8 buffer of an
Arrow column, so that no Python object is made per word.  Two different words share a
fingerprint with probability about 2**-64 per pair.  Null texts count as empty.  Texts of any
length are read in pieces of about ``PIECE_BYTES``, cut between words.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
#: Bytes of text handled at once; bounds the temporary arrays (about 40 bytes for each byte).
PIECE_BYTES = 1 << 18

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A random 64-bit value for each byte value; capitals A-Z have their lower-case letter's.
BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63 - 1, size=256, dtype=np.int64).astype(_U)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]

_POWERS = np.empty(1 << 12, dtype=_U)
_POWERS[0] = 1
with np.errstate(over="ignore"):
    for _i in range(1, len(_POWERS)):
        _POWERS[_i] = _POWERS[_i - 1] * _MULT


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that spreads every bit."""
    x = np.array(x, dtype=_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (rows + 1) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches, text_col: str = "text", most_bytes: int = 2 << 20):
    """The rows of Arrow batches in smaller batches of about ``most_bytes`` of text (a longer text
    alone), which bounds what is made of them at once."""
    for batch in batches:
        sizes = np.diff(utf8_buffer(batch.column(text_col))[1])
        step, lo = np.cumsum(sizes), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(step, (step[lo - 1] if lo else 0) + most_bytes, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
        pa.default_memory_pool().release_unused()


def _pieces(data: np.ndarray):
    lo = 0
    while lo < len(data):
        hi = min(lo + PIECE_BYTES, len(data))
        if hi < len(data):
            gap = SPACE[data[lo:hi]][::-1]
            back = int(gap.argmax())
            if gap[back]:
                hi -= back
            else:  # one word as long as a piece: up to its end
                while hi < len(data) and not SPACE[data[hi - 1]]:
                    step = SPACE[data[hi:hi + PIECE_BYTES]]
                    hi = hi + int(step.argmax()) + 1 if step.any() else min(len(data), hi + PIECE_BYTES)
        yield lo, hi
        lo = hi


def words(column, heads: tuple[int, ...] = (), tail: int = 0) -> tuple[np.ndarray, ...]:
    """Fingerprints of all words in order and, per row, their offsets.

    With ``heads`` and ``tail``, also a matrix of fingerprints of each word's first bytes, one
    column for each (ascending) number in ``heads``, and of its last ``tail`` bytes as they are
    (case kept): cheap features of a word's form.  0 stands for a word that is too short."""
    data, offsets = utf8_buffer(column)
    marks, starts, prints, forms = offsets[:-1], [], [], []
    for lo, hi in _pieces(data):
        d = data[lo:hi]
        gap = SPACE[d]
        begin = np.empty(len(d), dtype=bool)
        begin[0] = True
        begin[1:] = gap[:-1]
        at = marks[np.searchsorted(marks, lo):np.searchsorted(marks, hi)] - lo
        begin[at] = True
        begin &= ~gap
        start = np.flatnonzero(begin)
        if not len(start):
            continue
        stop = np.empty(len(d), dtype=bool)
        stop[-1] = True
        stop[:-1] = gap[1:]
        stop[at[at > 0] - 1] = True
        stop &= ~gap
        length = np.flatnonzero(stop) + 1 - start
        edges = np.concatenate(([0], start, [len(d)]))
        place = np.arange(len(d)) - np.repeat(edges[:-1], np.diff(edges))
        with np.errstate(over="ignore"):
            if length.max() >= len(_POWERS):  # beyond the table its entries are varied by the block's number
                power = _POWERS[place & 4095] * (_U(2) * mix64(place >> 12) + _U(1))
            else:
                power = _POWERS[np.minimum(place, len(_POWERS) - 1)]
            v = LOWER_CODE[d]
            v *= power
            v[gap] = 0
            h = np.add.reduceat(v, start)
            h += length.astype(_U) * _U(0xD6E8FEB86659FD93)
            prints.append(mix64(h))
            if tail:
                form = np.zeros((len(start), len(heads) + 1), dtype=_U)
                t = np.zeros(len(start), dtype=_U)
                for k in range(1, max(heads, default=0) + 1):
                    t = t * _MULT + LOWER_CODE[d[np.minimum(start + k - 1, len(d) - 1)]]
                    if k in heads:
                        form[:, heads.index(k)] = np.where(length >= k, mix64(t + _U(k)), _U(0))
                end, t = start + length, np.zeros(len(start), dtype=_U)
                for k in range(1, tail + 1):
                    t = t * _MULT + BYTE_CODE[d[np.maximum(end - k, 0)]]
                form[:, -1] = np.where(length >= tail, mix64(t), _U(0))
                forms.append(form)
        starts.append(start + lo)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    out = join(prints, _U), np.searchsorted(join(starts, np.int64), offsets)
    return (*out, np.concatenate(forms) if forms else np.zeros((0, len(heads) + 1), _U)) if tail else out


def shingles(prints: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit fingerprints of all runs of ``n`` words inside each row, in order, and per row
    their offsets.  A row of 1 to ``n - 1`` words has one shingle: all its words."""
    count = np.diff(offsets)
    m = max(0, len(prints) - n + 1)
    with np.errstate(over="ignore"):
        h = np.full(m, n, dtype=_U)
        for k in range(n):
            h = mix64(h * _MULT + prints[k:k + m])
    inside = np.zeros(m, dtype=bool)
    rows = np.flatnonzero(count >= n)
    if m and len(rows):
        edge = np.zeros(m + 1, dtype=np.int32)
        np.add.at(edge, offsets[rows], 1)
        np.add.at(edge, offsets[rows + 1] - n + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0
    out_count = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(out_count)])
    short = np.flatnonzero((count > 0) & (count < n))
    if not len(short):
        return h[inside], out_offsets
    out = np.empty(out_offsets[-1], dtype=_U)
    own = np.zeros(out_offsets[-1], dtype=bool)
    own[out_offsets[short]] = True
    out[~own] = h[inside]
    for r in short:
        out[out_offsets[r]] = run_print(prints[offsets[r]:offsets[r + 1]])
    return out, out_offsets


def run_print(prints: np.ndarray) -> np.uint64:
    """The fingerprint that ``shingles`` gives to this run of words."""
    h = np.array([len(prints)], dtype=_U)
    with np.errstate(over="ignore"):
        for k in range(len(prints)):
            h = mix64(h * _MULT + prints[k:k + 1])
    return h[0]


def distinct_in_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in ascending order, and per row their offsets."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[new], np.searchsorted(r[new], np.arange(len(offsets)))
