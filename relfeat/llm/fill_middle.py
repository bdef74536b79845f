"""Fill-in-the-middle: texts cut in prefix, middle and suffix and put in another order.

A text is a list of units, by default its code points; with a pattern, its matches, each with the
text before it.  Cuts are ranks in that list.  They are found in an indexable skip list over the
UTF-8 text.  Its ground lane is the text itself.  Express lanes hold a part of the units: unit
``i`` stands in lane ``k`` where a hash of ``i`` ends in ``k`` times ``LANE_BITS`` zero bits.  Each
lane's link carries three widths: the units, the code points and the bytes that it passes.  A
search descends from the highest lane: it takes a link while the units passed so far and the
link's do not exceed the rank, else goes one lane down; the last units, fewer than a few dozen,
are counted on the ground lane.  So the sums of widths reach each cut exactly.

Lanes are made in slices of ``SLICE_BYTES`` of text; a text of ``n`` units keeps about
``n / 2**LANE_BITS`` links, so memory is bounded by a fraction of the text next to the text itself.

The forms: ``plain`` (the text), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix, prefix,
middle), each part behind its mark.  Which form and which ranks is decided by a hash of the seed
and the id, so reruns and retried tasks agree.

Defined results: null counts as an empty text, which stays plain; so does a text that holds a
mark; a null id hashes as an empty id; rows with one id are cut by the same numbers; one unit or
equal ranks leave parts empty; an empty table gives no rows.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relfeat.llm.tokens import mix64, slices

MARKS = ("<P>", "<S>", "<M>")
#: Each lane keeps about one unit in 2**LANE_BITS of the lane below.
LANE_BITS = 5
#: Bytes of text whose units are listed at once.
SLICE_BYTES = 1 << 18


def _tall(first: int, count: int) -> np.ndarray:
    """Which of the units of ranks ``first + 1`` to ``first + count`` stand in the lowest lane."""
    if first == 0 and count <= SLICE_BYTES:
        return _EARLY[:np.searchsorted(_EARLY, count)]
    rank = np.arange(first + 1, first + count + 1)
    return np.flatnonzero((mix64(rank) & _LOW) == 0)


_LOW = np.uint64((1 << LANE_BITS) - 1)
#: The places of the lowest lane's units in a text's first slice, which are the same for all texts.
_EARLY = np.flatnonzero((mix64(np.arange(1, SLICE_BYTES + 1)) & _LOW) == 0)


@dataclass
class Lane:
    """Links of one lane: where each begins, as a place in the lane below, and its widths."""
    below: np.ndarray
    units: np.ndarray
    points: np.ndarray
    bytes: np.ndarray


def _point_slices(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points as units: for each slice, where units end in bytes, and in code points."""
    done = 0
    for lo in range(0, len(data), SLICE_BYTES):
        # a unit ends before the next byte that starts a code point
        part = data[lo + 1:lo + 1 + SLICE_BYTES]
        ends = np.flatnonzero((part & 0xC0) != 0x80) + lo + 1
        if lo + 1 + SLICE_BYTES > len(data):
            ends = np.append(ends, len(data))
        yield ends, np.arange(done + 1, done + 1 + len(ends))
        done += len(ends)


def _pattern_slices(data: np.ndarray, unit: re.Pattern, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    text = data.tobytes().decode("utf-8")
    ends: list[int] = []
    at_point = at_byte = 0

    def both():
        nonlocal at_point, at_byte
        size = []
        for e in ends:
            at_byte += len(text[at_point:e].encode("utf-8"))
            at_point = e
            size.append(at_byte)
        return np.array(size, dtype=np.int64), np.array(ends, dtype=np.int64)

    for m in unit.finditer(text):
        if m.end() > m.start():
            ends.append(m.end())
        if len(ends) == most:
            yield both()
            ends = []
    if ends:
        yield both()


class SkipList:
    """An indexable skip list over the units of a UTF-8 text."""

    def __init__(self, data: np.ndarray, unit: re.Pattern | None = None):
        self.data, self.unit = data, unit
        n = points = 0
        size = 0
        towers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of express units: rank, code points, bytes
        grounds: list[tuple[np.ndarray, np.ndarray]] = []             # a pattern's units can't be counted from bytes
        for ends, end_points in (_point_slices(data) if unit is None else _pattern_slices(data, unit)):
            tall = _tall(n, len(ends))
            towers.append((tall + (n + 1), end_points[tall], ends[tall]))
            if unit is not None:
                grounds.append((ends, end_points))
            if len(ends):
                n, points, size = n + len(ends), int(end_points[-1]), int(ends[-1])
        self.n, self.points, self.size = n, points, size
        join = lambda k, parts: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64)
        rank, point, byte = (join(k, towers) for k in range(3))
        self.ground = (join(0, grounds), join(1, grounds)) if unit is not None else None
        self.lanes: list[Lane] = []  # from the lowest
        place = np.arange(1, len(rank) + 1)
        height = 1
        while len(rank):
            # a lane's first link begins at the start of the text, which is place 0 of every lane
            links = [np.diff(x, prepend=0) for x in (rank, point, byte)]
            self.lanes.append(Lane(np.concatenate(([0], rank if height == 1 else place)), *links))
            height += 1
            tall = (mix64(rank) & np.uint64((1 << (LANE_BITS * height)) - 1)) == 0
            place = np.arange(1, len(rank) + 1)[tall]
            rank, point, byte = rank[tall], point[tall], byte[tall]
            if LANE_BITS * (height + 1) > 60:
                break

    def seek(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the end of the first ``rank`` units."""
        units = points = size = place = 0
        for lane in reversed(self.lanes):
            while place < len(lane.units) and units + int(lane.units[place]) <= rank:
                units += int(lane.units[place])
                points += int(lane.points[place])
                size += int(lane.bytes[place])
                place += 1
            place = int(lane.below[place])
        if units == rank:
            return points, size
        if self.ground is not None:
            return int(self.ground[1][rank - 1]), int(self.ground[0][rank - 1])
        return points + rank - units, size + self._ground_bytes(size, rank - units)

    def _ground_bytes(self, start: int, units: int) -> int:
        """Bytes of the ``units`` code points that begin at byte ``start``."""
        width = 256
        while True:
            part = self.data[start:start + width]
            begin = np.flatnonzero((part & 0xC0) != 0x80)
            if len(begin) > units:
                return int(begin[units])
            if start + width >= len(self.data):
                return len(self.data) - start
            width *= 4


def decide(seed: str, key, n: int) -> tuple[int, int, int, int]:
    """(lower rank, upper rank, h3 % 100, h4 % 100) of a text of ``n`` units."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = h1 % (n + 1), h2 % (n + 1)
    return min(a, b), max(a, b), h3 % 100, h4 % 100


def restore(output: bytes, form: str) -> bytes:
    """The text that ``transform_middle`` made ``output`` from."""
    p, s, m = (x.encode() for x in MARKS)
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError("the output doesn't begin with its mark")
    one, found, rest = output[len(first):].partition(second)
    two, also, middle = rest.partition(m)
    if not (found and also):
        raise ValueError("the output lacks a mark")
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def transform_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str | None = None,
                     rate: int = 90, spm_rate: int = 20, texts: bool = True) -> DataFrame:
    """One row per document: ``id, n, form, prefix_chars, middle_chars``, the lower-case hex
    digests ``output_sha256`` and ``restored_sha256`` and, with ``texts``, ``output``.

    ``unit``: a Python regular expression of the units, or None for code points; text after the
    last match belongs to the suffix.  ``rate`` per cent of texts are transformed, ``spm_rate`` per
    cent of those in the form spm.  The restored digest is that of the text rebuilt from output and
    form alone."""
    pattern = re.compile(unit) if unit else None
    id_type = docs.schema[id_col].dataType.simpleString()
    p, s, m = (x.encode() for x in MARKS)

    def one(key, text: bytes):
        data = np.frombuffer(text, dtype=np.uint8)
        index = SkipList(data, pattern)
        lower, upper, h3, h4 = decide(seed, key, index.n)
        if not text or p in text or s in text or m in text or h3 >= rate:
            return index.n, "plain", None, None, text
        (points_a, a), (points_b, b) = index.seek(lower), index.seek(upper)
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 < spm_rate:
            return index.n, "spm", points_a, points_b - points_a, b"".join((s, suffix, p, prefix, m, middle))
        return index.n, "psm", points_a, points_b - points_a, b"".join((p, prefix, s, suffix, m, middle))

    kinds = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()), ("restored_sha256", pa.string()),
             *([("output", pa.string())] if texts else [])]

    def run(batches):
        for part in slices(batches):
            rows = []
            for key, text in zip(part.column(0), part.column(1).cast(pa.large_binary())):
                n, form, a, b, output = one(key.as_py(), text.as_py())
                rows.append((n, form, a, b, hashlib.sha256(output).hexdigest(), hashlib.sha256(restore(output, form)).hexdigest(), *([output.decode("utf-8")] if texts else [])))
            arrays = [pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["id", *[name for name, _ in kinds]])

    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string" + ", output string" * texts
    return slim.mapInArrow(run, schema).withColumnRenamed("id", id_col)
