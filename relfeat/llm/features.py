"""Hashed-text features and linear models for the classifiers of this subpackage.

A feature is the presence in a text of a word, of a word's beginning (3, 4, 5, 6 or 8 bytes) or
of a word's ending (3 bytes, case kept), all hashed to fixed ranges, or a step (an eighth) that the
share of words which repeat the word before them reaches.  Models are fitted on a bounded sample of labelled rows
(``max_train_rows``, documented where it is used): Spark counts features and picks those whose
relation with the labels is beyond chance, and the sample's rows over these few features, some
integers a row, go to the driver.  Scoring reads every whole text in one pass without a shuffle.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relfeat.llm import tokens

WORD_RANGE, FORM_RANGE, REPEAT_RANGE = 1 << 18, 1 << 16, 8
HEADS, TAIL = (3, 4, 5, 6, 8), 3
FEATURES = WORD_RANGE + (len(HEADS) + 1) * FORM_RANGE + REPEAT_RANGE


def feature_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each text, not distinct, and per row their offsets."""
    prints, offsets, forms = tokens.words(column, heads=HEADS, tail=TAIL)
    width = forms.shape[1] + 1
    out = np.empty((len(prints), width), dtype=np.int32)
    out[:, 0] = prints & np.uint64(WORD_RANGE - 1)
    word = out[:, 0].copy()
    for k in range(forms.shape[1]):
        ids = (forms[:, k] & np.uint64(FORM_RANGE - 1)).astype(np.int32) + (WORD_RANGE + k * FORM_RANGE)
        out[:, k + 1] = np.where(forms[:, k] == 0, word, ids)
    out, offsets = out.reshape(-1), width * offsets
    # how many words repeat the word before them: one id for each step reached
    again = np.zeros(len(prints) + 1, dtype=np.int64)
    if len(prints):
        again[1:-1] = np.cumsum(prints[1:] == prints[:-1])
        again[-1] = again[-2]
    count = np.diff(offsets) // width
    first, last = offsets[:-1] // width, offsets[1:] // width
    rows = np.flatnonzero(count)
    repeats = again[last[rows] - 1] - again[first[rows]]
    step = np.minimum(np.ceil(8 * repeats / count[rows]), REPEAT_RANGE - 1).astype(np.int64) + 1
    inner = np.arange(step.sum()) - np.repeat(np.cumsum(step) - step, step)  # all steps up to the text's own
    out = np.insert(out, np.repeat(offsets[1:][rows], step), (inner + FEATURES - REPEAT_RANGE).astype(np.int32))
    added = np.zeros(len(offsets), dtype=np.int64)
    added[rows + 1] = step
    return out, offsets + np.cumsum(added)


def selected_features(column, lookup: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, model column) pairs of the features that ``lookup`` maps to a column."""
    ids, offsets = feature_ids(column)
    col = lookup[ids]
    at = np.flatnonzero(col >= 0)
    row = np.searchsorted(offsets, at, side="right") - 1
    pair = np.unique(row * np.int64(FEATURES) + col[at])
    return pair // FEATURES, pair % FEATURES


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: Sequence[str],
                    max_train_rows: int) -> DataFrame:
    """(id, text, label columns) of labelled documents, about ``max_train_rows`` at most.

    Rows are chosen by a hash of the id.  Labels that are null, or disagree for an id, leave the
    id out.  Equal texts with equal labels count once, so that copies do not outweigh the rest."""
    spark_id = F.col(id_col).alias("id")
    clean = labels.select(spark_id, *[F.col(c).cast("int").alias(c) for c in label_cols]).dropna()
    clean = clean.groupBy("id").agg(*[F.min(c).alias(c) for c in label_cols], *[F.max(c).alias(f"max_{c}") for c in label_cols])
    for c in label_cols:
        clean = clean.where(F.col(c) == F.col(f"max_{c}"))
    clean = clean.select("id", *label_cols)
    share = max_train_rows / max(1, clean.count())
    if share < 1:
        clean = clean.where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # the labels are bounded by the sample's size, so that the documents are not shuffled
    rows = docs.select(spark_id, F.col(text_col).alias("text")).where("length(text) > 0").join(F.broadcast(clean), "id")
    rows = rows.groupBy(F.sha2("text", 256), *label_cols).agg(F.min("id").alias("id"), F.first("text").alias("text"))
    return rows.select("id", "text", *label_cols).checkpoint()


def screen(sample: DataFrame, label_col: str, max_features: int, least_z: float = 5.0, least_rows: int = 5) -> np.ndarray:
    """The features whose mean label differs from the sample's by ``least_z`` standard errors
    (with a correction for continuity), the strongest ``max_features``: a model's size."""
    n, total, square = sample.agg(F.count("*"), F.sum(label_col), F.sum(F.col(label_col) * F.col(label_col))).first()
    if not n:
        return np.empty(0, np.int64)
    mean = total / n
    spread = square / n - mean * mean

    def count(batches):
        rows, sums = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for batch in tokens.slices(batches):
            ids, offsets = feature_ids(batch.column("text"))
            row = np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(offsets))
            pair = np.unique(row * FEATURES + ids)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            rows += np.bincount(pair % FEATURES, minlength=FEATURES)
            sums += np.bincount(pair % FEATURES, weights=y[pair // FEATURES], minlength=FEATURES).astype(np.int64)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[at]), pa.array(sums[at])], names=["feature", "rows", "sums"])

    counts = sample.select("text", F.col(label_col).cast("long").alias("y")).mapInArrow(count, "feature long, rows long, sums long")
    counts = counts.groupBy("feature").agg(F.sum("rows").alias("rows"), F.sum("sums").alias("sums"))
    off = F.abs(F.col("sums") - F.col("rows") * F.lit(mean)) - 0.5
    z = off / F.sqrt(F.col("rows") * (1 - F.col("rows") / F.lit(float(n + 1))) * F.lit(max(spread, 1e-12)))
    best = counts.where(F.col("rows") >= least_rows).withColumn("z", z).where(F.col("z") >= least_z)
    return np.array([r["feature"] for r in best.orderBy(F.desc("z"), "feature").limit(max_features).collect()], dtype=np.int64)


def lookup_of(features: np.ndarray) -> np.ndarray:
    out = np.full(FEATURES, -1, dtype=np.int32)
    out[features] = np.arange(len(features), dtype=np.int32)
    return out


def sample_matrix(sample: DataFrame, features: np.ndarray, label_cols: Sequence[str], folds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bounded sample over the chosen features: 0/1 matrix, labels, fold of each row."""
    lookup = sample.sparkSession.sparkContext.broadcast(lookup_of(features))

    def rows(batches):
        for batch in tokens.slices(batches):
            row, col = selected_features(batch.column("text"), lookup.value)
            offsets = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(offsets), pa.array(col.astype(np.int32)))] + [batch.column(c) for c in ("fold", *label_cols)],
                names=["cols", "fold", *label_cols])

    got = sample.withColumn("fold", F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(folds)).cast("int")) \
        .select("id", "text", "fold", *label_cols).orderBy("id").mapInArrow(rows, "cols array<int>, fold int, " + ", ".join(f"`{c}` int" for c in label_cols)).toArrow()
    x = np.zeros((got.num_rows, len(features)), dtype=np.float32)
    cols = got["cols"].to_pylist()
    for i, c in enumerate(cols):
        x[i, c] = 1
    y = np.stack([got[c].to_numpy() for c in label_cols], 1) if got.num_rows else np.zeros((0, len(label_cols)), int)
    return x, y.astype(np.int64), got["fold"].to_numpy()


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method; the intercept has no penalty.  Without both
    classes the weights are 0 and the intercept is the smoothed share."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    a = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-9
    w = np.zeros(a.shape[1])
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(rounds):
        p = sigmoid(a @ w)
        grad = a.T @ (p - y) + penalty * w
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty), grad)
        w -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def with_scores(docs: DataFrame, score: Callable, names: Sequence[str], text_col: str, columns: Sequence[str] | None) -> DataFrame:
    """``columns`` of ``docs`` (all by default) and double columns ``names``, made from each Arrow
    batch by ``score(batch)``.  A column of ``docs`` with one of these names gives way to it."""
    columns = [c for c in (columns if columns is not None else docs.columns) if c not in names]
    given = docs.select(*dict.fromkeys([*columns, text_col]))

    def run(batches):
        for batch in tokens.slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + score(batch), names=[*columns, *names])

    schema = given.select(*columns).schema
    for c in names:
        schema = schema.add(c, "double")
    return given.mapInArrow(run, schema)
