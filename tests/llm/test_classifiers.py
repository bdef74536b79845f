import random

import numpy as np
from pyspark.sql import functions as F

from relfeat.llm import features, quality, toxicity

from .conftest import CLASH, CLASH_VALUES, random_text


def labelled(spark):
    rnd = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        bad, junk = i % 7 == 0, i % 5 == 0
        w = random_text(rnd, rnd.randint(10, 60)).split()
        if junk:
            w = [f"{x}%%%" for x in w] if i % 2 else [w[k // 6 * 6] for k in range(len(w))]
        if bad:
            w[rnd.randrange(len(w))] = rnd.choice(["vilest", "vilely"])
        docs.append((i, " ".join(w)) + CLASH_VALUES)
        if i % 3:
            labels.append((i, int(not junk), int(bad)))
    docs += [(1000, None) + CLASH_VALUES, (1001, "") + CLASH_VALUES, (None, "plain words") + CLASH_VALUES, docs[3], docs[3],
             (1002, random_text(rnd, 50_000, 3000)) + CLASH_VALUES]
    labels += [(2, None, 1), (5, 1, 1), (5, 1, 0), (9999, 1, 0), (None, 1, 0), (1000, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string, " + CLASH), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_chain_finds_held_out_toxic_texts(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_chain(docs, toxicity.toxic_labels(labels), toxicity.CATEGORIES)
    assert len(model.weights[1]) == len(model.features) + 1  # the later model reads the earlier category
    rows = toxicity.score_chain(docs, model).collect()
    assert len(rows) == 606 and set(docs.columns) < set(rows[0].asDict())
    for r in rows:
        if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 0:  # never labelled
            assert (r.p_toxic >= 0.5) == (r.doc_id % 7 == 0), r
    assert {r.p_toxic for r in rows if r.doc_id in (1000, 1001)} == {rows[[r.doc_id for r in rows].index(1000)].p_toxic}


def test_out_of_fold_odds_are_not_fitted_ones():
    rnd = np.random.default_rng(0)
    x, y = rnd.integers(0, 2, (60, 40)).astype(float), rnd.integers(0, 2, 60).astype(float)
    w, b = features.fit_logistic(x, y, ridge=0.01)
    assert ((x @ w + b > 0) == y).mean() > 0.9  # noise is learnt by heart, which folds must hide


def test_chain_without_labels_or_documents(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_chain(docs, toxicity.toxic_labels(labels.limit(0)), toxicity.CATEGORIES)
    assert toxicity.score_chain(docs, model).where("p_toxic > 1e-9").count() == 0
    assert toxicity.score_chain(docs.limit(0), model).count() == 0
    one = labels.where("toxic = 0")
    assert toxicity.score_chain(docs, toxicity.fit_chain(docs, toxicity.toxic_labels(one), toxicity.CATEGORIES)).where("p_toxic > 0.1").count() == 0


def test_quality_grades(spark):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, quality.label_grades(labels), quality.GRADES)
    assert (np.diff(model.thresholds) > 0).all()
    rows = quality.score_quality(docs, model, tail=quality.GOOD).collect()
    assert len(rows) == 606
    wrong = [r for r in rows if r.doc_id is not None and r.doc_id < 600 and r.doc_id % 3 == 0 and (r.tail_probability >= 0.5) != (r.doc_id % 5 != 0)]
    assert len(wrong) <= 2, wrong[:3]
    assert all(r.tail_probability >= 0.5 for r in rows if r.doc_id in (None, 1000, 1001, 1002))


def test_quality_without_ratings_rejects_nothing(spark):
    docs, labels = labelled(spark)
    model = quality.fit_quality(docs, quality.label_grades(labels.limit(0)), quality.GRADES)
    assert quality.score_quality(docs, model, tail=quality.GOOD).where("tail_probability < 0.99").count() == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_ordinal_fit_recovers_order_and_an_absent_grade():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2, (900, 2)).astype(float)
    grade = np.clip((x @ [2.0, 1.0] + rnd.logistic(size=900) * 0.3).astype(int), 0, 3)
    w, theta = quality.fit_ordinal(x, grade, 4)
    assert w[0] > w[1] > 0 and (np.diff(theta) > 0).all()
    w, theta = quality.fit_ordinal(x, np.where(grade > 1, 2, 0), 3)
    assert (np.diff(theta) > 0).all()


def test_sample_is_bounded(spark):
    docs, labels = labelled(spark)
    sample = features.labelled_sample(docs, labels.select("doc_id", "toxic"), "doc_id", "text", ["toxic"], 100)
    assert 40 < sample.count() < 160 and sample.select(F.sha2("text", 256)).distinct().count() == sample.count()
