"""Quality by ordinal cumulative-link regression on graded ratings.

One weight for each hashed-text feature is shared by all grades; ordered thresholds cut the
text's score into grades: P(grade <= k) = sigmoid(threshold_k - score).  The model gives each
text its expected grade and the tail probability P(grade >= k) used for selection.

``max_train_rows`` (20,000) bounds the labelled rows that the model is fitted on; every row of
the documents is scored, over its whole text, in one pass without a shuffle.

Defined results: null or empty text has no features and score 0; grades that are null or
contradict each other are left out; a grade that no row has keeps its place between its
neighbours' thresholds; without any rating every text gets the same probabilities, 1 for the
highest grade, so that nothing is rejected for want of ratings; an empty table gives no rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relfeat.llm import features as ft


@dataclass
class OrdinalModel:
    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one less than the grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1 .. grades - 1."""
        return ft.sigmoid(score[:, None] - self.thresholds[None, :])

    def scores(self, column) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = ft.lookup_of(self.features)
        row, col = ft.selected_features(column, self._table)
        return np.bincount(row, weights=self.weights[col], minlength=len(column))[:len(column)]


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 0.1, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Penalised maximum likelihood of the cumulative-link model by Adam steps on all rows.

    Thresholds are the first one and the exponentials of steps, so they stay ordered."""
    n, m = x.shape
    below = np.array([((grade <= k).sum() + 0.5) / (n + 1) for k in range(grades - 1)])
    start = np.maximum.accumulate(np.log(below / (1 - below)) + 1e-3 * np.arange(grades - 1))
    p = np.concatenate([np.zeros(m), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    if not n:
        return p[:m], np.full(grades - 1, -30.0)
    x = x.astype(np.float64)
    first, second = np.zeros_like(p), np.zeros_like(p)
    rows = np.arange(n)
    for t in range(1, rounds + 1):
        steps = np.exp(np.clip(p[m + 1:], -20, 5))
        theta = p[m] + np.concatenate([[0], np.cumsum(steps)])
        score = x @ p[:m]
        edge = np.concatenate([np.full((n, 1), -40.0), theta[None, :] - score[:, None], np.full((n, 1), 40.0)], 1)
        cdf = ft.sigmoid(edge)
        cdf[:, 0], cdf[:, -1] = 0, 1
        density = cdf * (1 - cdf)
        mass = np.maximum(cdf[rows, grade + 1] - cdf[rows, grade], 1e-12)
        up, down = density[rows, grade + 1] / mass, density[rows, grade] / mass
        grad_theta = np.array([down[grade == k + 1].sum() - up[grade == k].sum() for k in range(grades - 1)])
        grad = np.concatenate([x.T @ (up - down) + ridge * p[:m], [grad_theta.sum()],
                               [grad_theta[k + 1:].sum() * steps[k] for k in range(grades - 2)]])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        move = first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        p = p - 0.1 * min(1.0, 4 * (1 - t / (rounds + 1))) * move
    return p[:m], p[m] + np.concatenate([[0], np.cumsum(np.exp(np.clip(p[m + 1:], -20, 5)))])


def fit_quality(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade",
                max_train_rows: int = 20_000, max_features: int = 256) -> OrdinalModel:
    """``ratings``: the id and a grade from 0 to ``grades - 1``; others are left out."""
    ratings = ratings.where(F.col(grade_col).between(0, grades - 1))
    sample = ft.labelled_sample(docs, ratings, id_col, text_col, [grade_col], max_train_rows)
    features = np.sort(ft.screen(sample, grade_col, max_features))
    x, y, _ = ft.sample_matrix(sample, features, [grade_col], 1)
    weights, thresholds = fit_ordinal(x, y[:, 0], grades)
    return OrdinalModel(features, weights, thresholds)


def score_quality(docs: DataFrame, model: OrdinalModel, text_col: str = "text", columns: Sequence[str] | None = None,
                  tail: int = 1) -> DataFrame:
    """``columns`` of ``docs`` (all by default) with ``expected_grade`` and ``tail_probability``,
    P(grade >= tail)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch):
        tails = shared.value.tails(shared.value.scores(batch.column(text_col)))
        return [pa.array(tails.sum(1)), pa.array(np.ascontiguousarray(tails[:, tail - 1]))]

    return ft.with_scores(docs, score, ["expected_grade", "tail_probability"], text_col, columns)


def label_grades(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Graded ratings from the labels table: 0 low quality and toxic, 1 low quality, 2 good."""
    return labels.select(F.col(id_col), F.when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1 - F.col("toxic")).alias("grade"))


#: Grades of ``label_grades``, and the least good one.
GRADES, GOOD = 3, 2
