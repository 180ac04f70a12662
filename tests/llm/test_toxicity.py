"""Op 3: the fit recovers an ordinal model, toxic documents are caught, clean ones stay."""

import random

import numpy as np

from millrace.llm import toxicity
from tests.llm.helpers import clashing, docs, odd_docs


def test_fit_recovers_weights():
    rng = np.random.default_rng(2)
    x = (rng.random((6000, 4)) < 0.4).astype(float)
    w, theta = np.array([2.0, -1.0, 0.5, 0.0]), np.array([0.0, 1.0, 2.5])
    y = (x @ w + rng.logistic(size=6000))[:, None] > theta
    got_w, got_theta = toxicity.fit_ordinal(x, y.sum(axis=1), l2=0.01)
    assert np.allclose(got_w, w, atol=0.25) and np.allclose(got_theta, theta, atol=0.25)
    assert (np.diff(got_theta) > 0).all()


def corpus(spark, n=600):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(80)]
        if i % 6 == 0:
            for _ in range(rng.randint(2, 8)):
                words[rng.randrange(80)] = rng.choice(["foul", "nasty", "vile"])
        texts.append(" ".join("".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in words))
        labels.append((i, int(i % 6 == 0)))
    return docs(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_catches_toxic_and_leaves_clean(spark):
    table, labels = corpus(spark)
    model = toxicity.fit(table, labels.where("doc_id % 2 = 0"))
    assert set(model.weights) == {"foul", "nasty", "vile"}
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert all(got[i].toxic == (i % 6 == 0) for i in got)
    assert model.beyond("vile " * 3 + "foul nasty")[0] > model.beyond("so vile")[0]
    severities = [sum(model.beyond(t)) for t in ("", "vile", "vile foul", "vile foul nasty")]
    assert severities == sorted(severities) and severities[0] < 0.5
    assert {r.doc_id for r in toxicity.drop_toxic(table, model).collect()} == {i for i in got if i % 6}


def test_odd_and_empty(spark):
    table, labels = corpus(spark, 120)
    model = toxicity.fit(table, labels)
    odd = clashing(odd_docs(spark))
    assert toxicity.score(odd, model).count() == odd.count()
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    nothing = toxicity.fit(table, labels.limit(0))
    assert nothing.thresholds == [] and not any(r.toxic for r in toxicity.score(table, nothing).collect())
    one_sided = toxicity.fit(table, labels.where("toxic = 0"))
    assert one_sided.thresholds == []
    assert toxicity.score(odd.limit(0), model).count() == 0
    nulls = labels.selectExpr("doc_id", "cast(null as int) as toxic").union(labels)
    assert toxicity.fit(table, nulls).weights.keys() == model.weights.keys()
