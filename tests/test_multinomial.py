"""Multinomial fits against plain Newton steps, one-hot names, grids of wrapped learners."""

import numpy as np
import pandas as pd
import pytest

from abacist.operators import learn
from abacist.operators.multinomial import multinomial_logit


def made(n=600):
    rng = np.random.default_rng(2)
    x = rng.normal([3, 200], [1, 40], (n, 2))
    eta = np.column_stack([np.zeros(n), x @ [0.8, -0.01] + 0.2, x @ [-0.5, 0.02] - 2])
    p = np.exp(eta) / np.exp(eta).sum(1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    return x, y


def newton(x, y, k=3):
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros((k - 1, x.shape[1]))
    for _ in range(40):
        e = np.exp(np.column_stack([np.zeros(len(x)), x @ b.T]))
        p = (e / e.sum(1, keepdims=True))[:, 1:]
        g = ((y[:, None] == np.arange(1, k)) - p).T @ x
        h = np.block([[(x * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ x for j in range(k - 1)] for i in range(k - 1)])
        b = b + np.linalg.solve(h, g.ravel()).reshape(b.shape)
    return b, np.sqrt(np.diag(np.linalg.inv(h)))


def test_coefficients_and_errors(spark):
    x, y = made()
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": np.array(["k0", "k1", "k2"])[y]})).repartition(5)
    extra = spark.createDataFrame([(None, 1.0, "k1"), (float("nan"), 1.0, "k2"), (1.0, 1.0, None)], "a double, b double, y string")
    model = multinomial_logit(df.unionByName(extra), "y", ["a", "b"])
    want, se = newton(x, y)
    rows = model.summary().collect()
    assert [(r["class"], r["term"]) for r in rows] == [(c, t) for c in ("k1", "k2") for t in ("a", "b", "const")]
    assert np.allclose([r["coef"] for r in rows], want.ravel(), rtol=1e-6) and np.allclose([r["se"] for r in rows], se, rtol=1e-6)
    stats = model.fit_stats().first()
    assert stats["converged"] and stats["n"] == len(x) and stats["steps"] < 15
    found = model.transform(df).toPandas()
    e = np.exp(np.column_stack([np.zeros(len(found)), np.column_stack([found["a"], found["b"], np.ones(len(found))]) @ want.T]))
    assert np.allclose(np.vstack(found["probability"]), e / e.sum(1, keepdims=True), atol=1e-6)
    assert (found["predicted_label"] == np.array(["k0", "k1", "k2"])[e.argmax(1)]).all()


def test_separated_classes_do_not_converge(spark):
    df = spark.createDataFrame([(float(i), "p" if i < 5 else "q") for i in range(10)], "a double, y string")
    assert not multinomial_logit(df, "y", ["a"], max_iter=4).converged


@pytest.mark.parametrize("algorithm,grid", [("gradient_boosting", {"maxDepth": [1, 2]}), ("svm", {"regParam": [1.0, 0.01]})])
def test_grid_search_of_several_classes(spark, algorithm, grid):
    x, y = made(150)
    df = spark.createDataFrame(pd.DataFrame({"id": range(150), "a": x[:, 0], "b": x[:, 1], "y": np.array(["k0", "k1", "k2"])[y]}))
    grid = {**grid, "maxIter": [2]}
    model, table = learn.grid_search(df, "y", ["a", "b"], algorithm, "id", grid, folds=2, task="classification")
    assert table.count() == 2
    assert {r.feature for r in model.importance().collect()} == {"a", "b"}


def test_names_of_one_hot_places(spark):
    df = spark.createDataFrame([(float(i), "uvw"[i % 3], "yes" if i % 3 == 1 else "no") for i in range(60)], "a double, c string, y string")
    model = learn.fit(df, "y", ["a", "c"], "logistic", "classification", encoding="onehot")
    names = [r.feature for r in model.importance().collect()]
    assert sorted(names) == ["a", "c=u", "c=v", "c=w"]
