"""Toxicity by a classifier chain over hashed text.

Categories are predicted in a fixed order.  Each has a linear (logistic) model over hashed
features, and from the second on also over the log-odds of all earlier categories.  In training
these are out-of-fold predictions, so that a later model sees earlier probabilities as they are
on unseen texts; in scoring they are those of the earlier final models.

``max_train_rows`` (20,000) bounds the labelled rows that the models are fitted on; every row of
the documents is scored, over its whole text, in one pass without a shuffle.

Defined results: null or empty text has no features and gets the models' base probability;
labels that are null or contradict each other are left out; without labels, or with one class
only, a category's probability is the smoothed share of its positive labels (0 without any);
repeated rows are scored alike; an empty table gives no rows.
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
class ChainModel:
    categories: list[str]
    features: np.ndarray
    weights: list[np.ndarray]  # one value a feature, then one for each earlier category
    intercepts: list[float]

    def probabilities(self, column) -> np.ndarray:
        """(rows, categories)"""
        n = len(column)
        row, col = ft.selected_features(column, self._lookup())
        out = np.zeros((n, len(self.categories)))
        odds = np.zeros((n, 0))
        m = len(self.features)
        for k, (w, b) in enumerate(zip(self.weights, self.intercepts)):
            z = b + np.bincount(row, weights=w[:m][col], minlength=n)[:n] + odds @ w[m:]
            out[:, k] = ft.sigmoid(z)
            odds = np.concatenate([odds, np.clip(z, -30, 30)[:, None]], 1)
        return out

    def _lookup(self) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = ft.lookup_of(self.features)
        return self._table


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_col: str = "doc_id", text_col: str = "text",
              max_train_rows: int = 20_000, max_features: int = 256, folds: int = 5) -> ChainModel:
    """``labels``: the id and one 0/1 column for each category, in the chain's order."""
    sample = ft.labelled_sample(docs, labels, id_col, text_col, categories, max_train_rows)
    chosen = [ft.screen(sample, c, max_features) for c in categories]
    features = np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)
    x, y, fold = ft.sample_matrix(sample, features, categories, folds)
    weights, intercepts = [], []
    odds = np.zeros((len(x), 0))
    for k in range(len(categories)):
        a = np.concatenate([x, odds], 1)
        t = y[:, k].astype(float)
        w, b = ft.fit_logistic(a, t) if len(t) else (np.zeros(a.shape[1]), -30.0)
        held_out = np.zeros(len(t))
        for f in range(folds):
            test = fold == f
            if test.any():
                wf, bf = ft.fit_logistic(a[~test], t[~test])
                held_out[test] = a[test] @ wf + bf
        weights.append(w)
        intercepts.append(b)
        odds = np.concatenate([odds, np.clip(held_out, -30, 30)[:, None]], 1)
    return ChainModel(list(categories), features, weights, intercepts)


def score_chain(docs: DataFrame, model: ChainModel, text_col: str = "text", columns: Sequence[str] | None = None,
                prefix: str = "p_") -> DataFrame:
    """``columns`` of ``docs`` (all by default) with one probability column for each category."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"{prefix}{c}" for c in model.categories]

    def score(batch):
        p = shared.value.probabilities(batch.column(text_col))
        return [pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names))]

    return ft.with_scores(docs, score, names, text_col, columns)


def toxic_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The chain's categories from the labels table: low quality first, then toxic."""
    return labels.select(F.col(id_col), (1 - F.col("quality")).alias("low_quality"), F.col("toxic"))


#: The order of the chain over the labels table.
CATEGORIES = ("low_quality", "toxic")
