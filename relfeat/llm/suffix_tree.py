"""Language-model scores by a probabilistic suffix tree over words.

The tree's nodes are contexts of 0, 1 or 2 preceding words.  A context is a candidate if its
empirical probability reaches ``p_min`` (and it occurs ``min_count`` times).  Node by node:

- root: P(x) = (c(x) + 0.1) / (N + 0.1 (V + 1)), x a word or a text's end;
- context s: P(x | s) = (c(s, x) + a(s) P(x | parent)) / (c(s) + a(s)), a(s) = c(s) ** 0.75, the
  parent being s without its first word: counts smoothed towards the parent's distribution.

A candidate is retained if its leave-one-out divergence from its parent, the sum over its
occurrences of ln P(x | s) / P(x | parent) with the occurrence itself left out of all counts, is
at least ``least_gain`` nats, or if a longer retained context ends in it.  A word is scored in the
longest retained suffix of what precedes it; the start of a text counts as a word of contexts.

How it runs.  A first pass counts words.  Then every position (context codes, word, document)
goes, sorted and compressed with thousands of others, to the bucket of its *predicted word*, so
that c(x), c(s, x) and all contexts that precede x meet in one place, whatever their depth.  Three
passes over the buckets find the longer contexts, sum up divergences, and score; each sends back
small sums.  The shuffle is written once and read three times.

Scale: what is gathered grows with the corpus: all words, and all successors of all contexts, are
counted; nothing of it is collected.  Only the contexts (at most 1 / p_min a length, by their
definition) with their counts are broadcast.  Words, pairs and triples that hold over about 1 in
2,000 positions (hence at most some thousands) are dealt out further, by context and document, and
their counts are added up first, so no bucket depends on a hot key.  Buckets are read in slices of
bounded size.  A text may be of any length.

Defined results: null or empty text is scored as its end alone; a row is in the training part
unless crc32 of its id as text (null: empty) leaves 0 modulo 10; repeated rows are learnt as often
as they stand there and scored alike (rows that share an id are told apart by 32 bits of a
fingerprint of the text); an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import ctypes
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relfeat.llm import tokens

_U = np.uint64
#: Fingerprints of a text's end and start.
END, BEGIN = _U(0xE4D0F7E875A3C1B9), _U(0xB5297A4D3F84D5B5)
HOT_SHARE = 1 << 11
#: Positions that a map task handles at once, and sorts together; about how many positions a
#: bucket and a partition of buckets hold.
SLICE, SORTED, BUCKET, PARTITION = 1 << 18, 3 << 18, 1 << 19, 1 << 26
_CODEC = pa.Codec("zstd", 1)


def _give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and what one has freed
    would else stay its own beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def held_out_flags(ids: list) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0 for i in ids), dtype=bool, count=len(ids))


def _pair(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tokens.mix64(x + tokens.mix64(one + _U(1)))


def _with_ends(column) -> tuple[np.ndarray, np.ndarray]:
    """Word fingerprints with each row's end appended, and the rows' offsets."""
    prints, offsets = tokens.words(column)
    return np.insert(prints, offsets[1:], END), offsets + np.arange(len(offsets))


def _contexts(x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before each position, and the one before that; 0 where there is none."""
    one, two = np.empty_like(x), np.zeros_like(x)
    one[1:] = x[:-1]
    one[offsets[:-1]] = BEGIN
    two[1:] = one[:-1]
    two[offsets[:-1]] = 0
    return one, two


def _word_counts(docs: DataFrame) -> DataFrame:
    """(kind, h, n): 0 training words, 1 to 3 words, pairs and triples that are frequent in a
    batch, 4 all positions."""

    def count(batches):
        for batch in tokens.slices(batches):
            x, offsets = _with_ends(batch.column("text"))
            if not len(x):
                continue
            training = np.repeat(~held_out_flags(batch.column("id").to_pylist()), np.diff(offsets))
            kinds, values, numbers = [], [], []

            def put(kind, v, n):
                kinds.append(np.full(len(v), kind, np.int32))
                values.append(v.view(np.int64))
                numbers.append(n.astype(np.int64))

            order = np.argsort(x)
            v, learnt = x[order], training[order]
            start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            v, n, learnt = v[start], np.diff(np.append(start, len(x))), np.add.reduceat(learnt, start, dtype=np.int64)
            put(0, v[learnt > 0], learnt[learnt > 0])
            hot = v[n * 2 * HOT_SHARE >= len(x)]
            put(1, hot, n[n * 2 * HOT_SHARE >= len(x)])
            one, two = _contexts(x, offsets)
            at = np.flatnonzero(_place(hot, x) >= 0)  # a frequent pair or triple ends in a frequent word
            pair = _pair(x[at], one[at])
            for kind, v in ((2, pair), (3, _pair(pair, two[at]))):
                v, n = np.unique(v, return_counts=True)
                often = n * 2 * HOT_SHARE >= len(x)
                put(kind, v[often], n[often])
            put(4, np.zeros(1, _U), np.array([len(x)]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(values)), pa.array(np.concatenate(numbers))],
                                             names=["kind", "h", "n"])

    def counted(batches):
        yield from count(batches)
        _give_back()

    return docs.mapInArrow(counted, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


@dataclass
class Contexts:
    """The bounded part of the model that every task reads."""
    total: int                 # N
    distinct: int              # V
    least: int                 # occurrences a candidate needs
    hot: list[np.ndarray]      # sorted fingerprints of hot words, pairs, triples
    words: np.ndarray          # sorted fingerprints of one-word contexts
    counts: np.ndarray         # their c(s)
    buckets: int
    partitions: int
    hot_counts: list[np.ndarray] | None = None
    pairs: np.ndarray | None = None         # sorted keys of two-word contexts
    pair_counts: np.ndarray | None = None
    keep_words: np.ndarray | None = None
    keep_pairs: np.ndarray | None = None

    def codes(self, h: np.ndarray) -> np.ndarray:
        """1 + the place of each fingerprint among the contexts' words; 0: not one of them."""
        return _place(self.words, h) + 1


def _place(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The place of each value in a sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    return np.where(table[at] == h, at, -1)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of an array, transposed and compressed."""
    raw = a.view(np.uint8).reshape(len(a), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = _CODEC.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _positions(docs: DataFrame, model) -> DataFrame:
    """(partition, bucket, ...): compressed positions, each in its predicted word's bucket."""
    arrays = ["x", "one", "two", "doc", "times", "ids", "no_id", "texts"]

    def place(m: Contexts, x, offsets, one, two, texts, lo, hi):
        """Columns (word, contexts, document, bucket) of the positions from lo to hi."""
        w, w1, w2 = x[lo:hi], one[lo:hi], two[lo:hi]
        doc = (np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1).astype(np.int32)
        c1, c2 = m.codes(w1).astype(np.int32), m.codes(w2).astype(np.int32)
        c2[c1 == 0] = 0
        key = tokens.mix64(w)
        at = np.flatnonzero(_place(m.hot[0], w) >= 0)  # hot words are dealt out by what precedes them
        key[at] = tokens.mix64(w[at] ^ tokens.mix64(w1[at]))
        pair = _pair(w[at], w1[at])
        hot = _place(m.hot[1], pair) >= 0
        at, pair = at[hot], pair[hot]
        key[at] = tokens.mix64(pair ^ tokens.mix64(w2[at]))
        triple = _pair(pair, w2[at])
        hot = _place(m.hot[2], triple) >= 0
        at, triple = at[hot], triple[hot]
        key[at] = tokens.mix64(triple ^ tokens.mix64(texts[doc[at]].view(_U)))
        return w, c1, c2, doc, (key % _U(m.buckets)).astype(np.int64)

    def packed(m: Contexts, parts, ids, no_id, texts) -> pa.RecordBatch:
        w, c1, c2, doc, bucket = (np.concatenate(p) for p in zip(*parts))
        parts.clear()  # the pieces are not held beside the whole
        ids, no_id, texts = np.concatenate(ids), np.concatenate(no_id), np.concatenate(texts)
        # by bucket, then about by word and context, in the bits that are left
        bits, low = m.buckets.bit_length(), c1.astype(_U) + (c2.astype(_U) << _U(21)) + (doc.astype(_U) << _U(42))
        by_word = (tokens.mix64(w) >> _U(bits) & ~_U(4095)) | (tokens.mix64(low) >> _U(52))
        by_word |= bucket.astype(_U) << _U(64 - bits)
        del low
        order = np.argsort(by_word)
        del by_word
        w, c1, c2, doc, bucket = w[order], c1[order], c2[order], doc[order], bucket[order]
        new = np.ones(len(w), dtype=bool)
        new[1:] = (w[1:] != w[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1]) | (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(w))).astype(np.int32)
        w, c1, c2, doc, bucket = w[first], c1[first], c2[first], doc[first], bucket[first]
        del order, new, first
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        out = []
        for a, b in zip(edge, np.append(edge[1:], len(w))):
            here, local = np.unique(doc[a:b], return_inverse=True)
            columns = (w[a:b], c1[a:b], c2[a:b], local.astype(np.int32), times[a:b], ids[here], no_id[here], (texts[here] >> 32).astype(np.int32))
            out.append((int(bucket[a] % m.partitions), int(bucket[a]), *map(_pack, columns)))
        columns = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[2:]],
                                          names=["partition", "bucket", *arrays])

    def read(batches):
        m: Contexts = model.value
        parts, ids, no_id, texts, docs_held, held = [], [], [], [], 0, 0
        for batch in tokens.slices(batches):
            x, offsets = _with_ends(batch.column("text"))
            if not len(x):
                continue
            one, two = _contexts(x, offsets)
            own = batch.column("id").to_pylist()
            no_id.append(np.array([i is None for i in own], dtype=np.uint8))
            ids.append(np.array([0 if i is None else i for i in own], dtype=np.int64))
            with np.errstate(over="ignore"):
                texts.append(tokens.mix64(np.add.reduceat(tokens.mix64(x + tokens.mix64(one)), offsets[:-1])).view(np.int64))
            for lo in range(0, len(x), SLICE):
                w, c1, c2, doc, bucket = place(m, x, offsets, one, two, texts[-1], lo, min(lo + SLICE, len(x)))
                parts.append((w, c1, c2, doc + np.int32(docs_held), bucket))
                held += len(w)
                del w, c1, c2, doc, bucket
                if held >= SORTED:
                    yield packed(m, parts, ids, no_id, texts)
                    parts, ids, no_id, texts, docs_held, held = [], ids[-1:], no_id[-1:], texts[-1:], 0, 0
            docs_held = sum(map(len, ids))
        if parts:
            yield packed(m, parts, ids, no_id, texts)
        del parts, ids, no_id, texts
        _give_back()

    return docs.mapInArrow(read, "partition int, bucket int, " + ", ".join(f"{a} binary" for a in arrays))


class _Bucket:
    """A bucket's positions, grouped by (word, one-word context, two-word context)."""

    def __init__(self, m: Contexts, rows: list):
        kinds = {"x": _U, "one": np.int32, "two": np.int32, "doc": np.int32, "times": np.int32, "ids": np.int64, "no_id": np.uint8, "texts": np.int32}
        got = {k: [_unpack(bytes(r[k]), t) for r in rows] for k, t in kinds.items()}
        shift = np.cumsum([0] + [len(i) for i in got["ids"]])
        doc = np.concatenate([d + s for d, s in zip(got["doc"], shift)])
        x, one, two, times = (np.concatenate(got[k]) for k in ("x", "one", "two", "times"))
        self.ids, self.no_id, self.texts = (np.concatenate(got[k]) for k in ("ids", "no_id", "texts"))
        self.held_out = held_out_flags([None if n else i for i, n in zip(self.ids.tolist(), self.no_id.tolist())])
        distinct, rank = np.unique(x, return_inverse=True)
        if len(distinct) >= 1 << 22:
            raise ValueError("a bucket holds too many words")
        key = (rank.astype(_U) << _U(42)) | (one.astype(_U) << _U(21)) | two.astype(_U)
        order = np.argsort(key)
        key, self.doc, self.times = key[order], doc[order], times[order].astype(np.int64)
        del x, one, two, times, doc, got, rank, order
        train = np.where(self.held_out[self.doc], 0, self.times)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        self.key = key[start]
        self.x = distinct[(self.key >> _U(42)).astype(np.int64)]
        self.one, self.two = ((self.key >> _U(21)) & _U((1 << 21) - 1)).astype(np.int64), (self.key & _U((1 << 21) - 1)).astype(np.int64)
        self.triples = np.add.reduceat(train, start)

        def over(shift_bits):
            k = self.key >> _U(shift_bits)
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            return np.repeat(np.add.reduceat(self.triples, first), np.diff(np.append(first, len(k)))), first

        self.train = self.triples.copy()
        self.pairs, self.pair_first = over(21)
        self.words, _ = over(42)
        # hot n-grams are known by fingerprints of words, so their contexts' words are needed
        context = np.append(_U(0), m.words)
        pair = _pair(self.x, context[self.one])
        places = [_place(m.hot[0], self.x), _place(m.hot[1], pair), _place(m.hot[2], _pair(pair, context[self.two]))]
        self.hot = [np.where(self.one > 0, p, -1) if n else p for n, p in enumerate(places)]
        self.hot[2] = np.where(self.two > 0, self.hot[2], -1)
        if m.hot_counts is not None:
            for n, counts in enumerate((self.words, self.pairs, self.triples)):
                at = self.hot[n] >= 0
                counts[at] = m.hot_counts[n][self.hot[n][at]]

    def two_places(self, m: Contexts) -> np.ndarray:
        place = _place(m.pairs, (self.two << 21) | self.one)
        return np.where((self.two > 0) & (self.one > 0), place, -1)


def _by_bucket(positions: DataFrame, m: Contexts):
    """Partitions whose rows come bucket by bucket.  Each bucket is a shuffle partition of its own and a
    task reads several of them in turn: nothing is sorted, so nothing spills, however large they are."""
    dealt = positions.repartitionById(m.buckets, F.col("bucket")).rdd
    if dealt.getNumPartitions() != m.buckets:  # merged in between: their rows may alternate
        return positions.repartitionById(m.partitions, F.col("partition")).sortWithinPartitions("bucket").rdd
    return dealt.coalesce(m.partitions)


def _buckets(model, rows):
    """The buckets of a partition, one after another; rows come bucket by bucket."""
    held, now, ended = [], None, set()
    for row in rows:
        if row["bucket"] != now and held:
            yield _Bucket(model.value, held)
            held = []
            ended.add(now)
        if row["bucket"] in ended:
            raise ValueError("a bucket's rows are apart")
        now = row["bucket"]
        held.append(row)
    if held:
        yield _Bucket(model.value, held)
    del held
    _give_back()


def _smoothing(c: np.ndarray, power: float) -> np.ndarray:
    return np.maximum(c, 1).astype(float) ** power


def _find_pairs(model):
    """Pass 1: counts of hot n-grams (kinds 0 to 2) and of two-word contexts (kind 3)."""
    def run(rows):
        m = model.value
        for b in _buckets(model, rows):
            for kind in range(3):
                at = b.hot[kind] >= 0
                n = np.bincount(b.hot[kind][at], weights=b.train[at], minlength=len(m.hot[kind])).astype(np.int64)
                yield from ((kind, int(k), int(n[k])) for k in np.flatnonzero(n))
            first = b.pair_first
            x, one, n, hot = b.x[first], b.one[first], b.pairs[first], b.hot[1][first] >= 0
            word = m.codes(x)
            at = np.flatnonzero((one > 0) & (word > 0) & ((n >= m.least) | hot) & (n > 0))
            yield from ((3, int(k), int(c)) for k, c in zip((one[at] << 21) | word[at], n[at]))
    return run


def _chances(b: _Bucket, m: Contexts, power: float, left_out: int):
    """Root, one-word and two-word probabilities of each group, and the place of its two-word
    context; ``left_out`` occurrences of the group are left out of all counts."""
    floor = 0.1 * (m.distinct + 1)
    root = (np.maximum(b.words - left_out, 0) + 0.1) / (m.total - left_out + floor)
    c1 = np.append(0, m.counts)[b.one]
    a1 = _smoothing(c1, power)
    one = np.where(b.one > 0, (np.maximum(b.pairs - left_out, 0) + a1 * root) / (np.maximum(c1 - left_out, 0) + a1), root)
    place = b.two_places(m)
    c2 = np.append(m.pair_counts, 0)[place]
    a2 = _smoothing(c2, power)
    return root, one, place, c2, a2


def _sum_gains(model, power: float):
    """Pass 2: each context's leave-one-out divergence (kind 0 one word, 1 two words)."""
    def run(rows):
        m = model.value
        gains = np.zeros(len(m.words) + 1), np.zeros(len(m.pairs) + 1)
        for b in _buckets(model, rows):
            root, one, place, c2, a2 = _chances(b, m, power, 1)
            at = np.flatnonzero((b.train > 0) & (b.one > 0))
            gains[0][:] += np.bincount(b.one[at], weights=b.train[at] * np.log(one[at] / root[at]), minlength=len(gains[0]))
            at = at[place[at] >= 0]
            two = (np.maximum(b.triples[at] - 1, 0) + a2[at] * one[at]) / (np.maximum(c2[at] - 1, 0) + a2[at])
            gains[1][:] += np.bincount(place[at], weights=b.train[at] * np.log(two / one[at]), minlength=len(gains[1]))
        for kind, (gain, shift) in enumerate(zip(gains, (1, 0))):
            yield from ((kind, int(k) - shift, float(gain[k])) for k in np.flatnonzero(gain))
    return run


def _score(model, power: float):
    """Pass 3: each document's share of a partition."""
    def run(rows):
        m = model.value
        keep1, keep2 = np.append(False, m.keep_words), np.append(m.keep_pairs, False)
        for b in _buckets(model, rows):
            root, one, place, c2, a2 = _chances(b, m, power, 0)
            chance = np.where(keep1[b.one], one, root)
            longer = keep2[place] & (place >= 0)
            chance = np.where(longer, (b.triples + a2 * one) / (c2 + a2), chance)
            n = len(b.ids)
            add = lambda v: np.bincount(b.doc, weights=b.times * v[b.group], minlength=n)
            size, known, base, score, ends = add(np.ones(len(root))), add(b.words > 0), add(np.log10(root)), add(np.log10(chance)), add(b.x == END)
            # a document's slices may come in several blobs of a bucket
            order = np.lexsort((b.texts, b.ids, b.no_id))
            i, t, z = b.ids[order], b.texts[order], b.no_id[order]
            first = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (z[1:] != z[:-1])))
            sums = [np.add.reduceat(v[order], first) for v in (size, known, base, score, ends)]
            yield pa.table({"id": pa.array(i[first], mask=z[first] > 0), "text": t[first].astype(np.int64), "size": sums[0].astype(np.int64), "known": sums[1].astype(np.int64),
                            "base": sums[2], "score": sums[3], "ends": sums[4].astype(np.int64)})
    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p_min: float = 2.0**-20, min_count: int = 16,
                    power: float = 0.75, least_gain: float = 10.0) -> DataFrame:
    """One row per document: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    (log10 probabilities of the text under the root alone, and under the tree)."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = _word_counts(slim).checkpoint()
    total, distinct, positions = counts.agg(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.count(F.when(F.col("kind") == 0, 1)),
                                            F.sum(F.when(F.col("kind") == 4, F.col("n")))).first()
    total, positions = total or 0, positions or 0
    least = max(min_count, int(np.ceil(total * p_min)))

    def fingerprints(kind: int, at_least: int) -> pa.Table:  # at most total / at_least rows
        return counts.where((F.col("kind") == kind) & (F.col("n") >= at_least)).select("h", "n").toArrow()

    words = fingerprints(0, least)
    h, n = words["h"].to_numpy().astype(np.int64).view(_U), words["n"].to_numpy().astype(np.int64)
    usable = h != END  # nothing follows an end
    starts = int(n[~usable].sum()) if (~usable).any() else 0
    h, n = h[usable], n[usable]
    if starts:  # as many texts start as end
        h, n = np.append(h, BEGIN), np.append(n, starts)
    order = np.argsort(h)
    hot = [np.sort(fingerprints(k, max(2, positions // HOT_SHARE))["h"].to_numpy().astype(np.int64).view(_U)) for k in (1, 2, 3)]
    partitions = max(2 * spark.sparkContext.defaultParallelism, -(-positions // PARTITION))
    per_partition = max(1, -(-positions // (partitions * BUCKET)))
    m = Contexts(total, distinct, least, hot, h[order], n[order], partitions * per_partition, partitions)
    share = spark.sparkContext.broadcast
    placed = _by_bucket(_positions(slim, share(m)), m)

    found = spark.createDataFrame(placed.mapPartitions(_find_pairs(share(m))), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    found = found.where((F.col("kind") < 3) | (F.col("n") >= least)).toArrow()
    kind, key, n = (found[c].to_numpy() for c in ("kind", "key", "n"))
    m.hot_counts = [np.zeros(len(t), np.int64) for t in hot]
    for k in range(3):
        m.hot_counts[k][key[kind == k]] = n[kind == k]
    order = np.argsort(key[kind == 3])
    m.pairs, m.pair_counts = key[kind == 3][order], n[kind == 3][order]

    gains = spark.createDataFrame(placed.mapPartitions(_sum_gains(share(m), power)), "kind int, key long, gain double")
    gains = gains.groupBy("kind", "key").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= least_gain).toArrow()
    kind, key = gains["kind"].to_numpy(), gains["key"].to_numpy()
    m.keep_words, m.keep_pairs = np.zeros(len(m.words), bool), np.zeros(len(m.pairs), bool)
    m.keep_words[key[kind == 0]] = True
    m.keep_pairs[key[kind == 1]] = True
    m.keep_words[(m.pairs[m.keep_pairs] & ((1 << 21) - 1)) - 1] = True  # what a retained context ends in

    def shares(rows):
        values = ["size", "known", "base", "score", "ends"]

        def added(tables):  # one row a document
            sums = pa.concat_tables(tables).group_by(["id", "text"]).aggregate([(c, "sum") for c in values])
            return sums.select(["id", "text", *(f"{v}_sum" for v in values)]).rename_columns(["id", "text", *values])

        held = []
        for table in _score(final, power)(rows):  # the buckets' rows are added up as they come
            held.append(table)
            if sum(t.num_rows for t in held[1:]) > max(SLICE, held[0].num_rows):
                held = [added(held)]
                pa.default_memory_pool().release_unused()
        for batch in added(held).to_batches(max_chunksize=4096) if held else ():
            yield from zip(*(c.to_pylist() for c in batch.columns))

    final = share(m)
    parts = spark.createDataFrame(placed.mapPartitions(shares), "id long, text long, size long, known long, base double, score double, ends long")
    sums = parts.groupBy("id", "text").agg(*[F.sum(c).alias(c) for c in ("size", "known", "base", "score", "ends")])
    rows = sums.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("ends"))).alias("copy"))  # repeated rows
    held_out = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % 10 == 0
    each = lambda c: (F.col(c) / F.col("ends"))
    return rows.select(F.col("id").alias(id_col), held_out.alias("held_out"), each("size").cast("long").alias("n_tokens"), each("known").cast("long").alias("n_known"),
                       F.lit(total).cast("long").alias("train_tokens"), each("base").alias("base_score"), each("score").alias("score"))
