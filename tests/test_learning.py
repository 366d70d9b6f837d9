"""Models, clusters, anomalies, readers and writers."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from abacist.operators import anomaly, cluster, density, evaluate, learn, neighbour_models, reduce, split
from abacist.sources import readers, writers


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(20)
    n = 400
    x = rng.normal(size=(n, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.normal(size=n) > 0).astype(int)
    rows = [(i, float(a), float(b) if i % 17 else None, "u" if i % 3 else "w", int(t), float(3 * a - 2 * (b if i % 17 else 0) + 1)) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k long, a double, b double, c string, y int, z double").repartition(3).cache()


def test_split_is_exact_and_independent_of_partitions(labelled):
    a, b = split.train_test_split(labelled, "k", stratify="y")
    assert a.count() + b.count() == 400 and a.join(b, "k").count() == 0
    for r in labelled.groupBy("y").count().collect():
        assert a.filter(F.col("y") == r["y"]).count() == round(0.8 * r["count"])
    again, _ = split.train_test_split(labelled.repartition(11), "k", stratify="y")
    assert {r["k"] for r in a.collect()} == {r["k"] for r in again.collect()}


@pytest.mark.parametrize("name, params", [("logistic", {}), ("svm", {"components": 60}), ("decision_tree", {}), ("naive_bayes", {})])
def test_classifiers_learn(labelled, name, params):
    model, metrics = learn.train(labelled, "y", ["a", "b", "c"], name, "k", params=params)
    assert metrics.first()["accuracy"] > 0.8
    out = model.transform(labelled)
    assert {"prediction", "predicted_label"} <= set(out.columns) and out.count() == 400


def test_ridge_and_lasso_match_definitions(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 3))
    y = x @ [3.0, -2.0, 0.0] + rng.normal(size=300)
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k long, a double, b double, c double, y double")
    model = learn.fit(df, "y", ["a", "b", "c"], "ridge", "regression", params={"alpha": 10.0})
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + 10.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(model.fitted.stages[-1].coefficients.toArray(), want, atol=1e-4)
    lasso = learn.fit(df, "y", ["a", "b", "c"], "lasso", "regression", params={"alpha": 0.5}).fitted.stages[-1].coefficients.toArray()
    grad = xc.T @ (yc - xc @ lasso) / 300
    for g, b in zip(grad, lasso):
        assert abs(g) <= 0.5 + 1e-3 and (b == 0 or g == pytest.approx(0.5 * np.sign(b), abs=1e-3))


def test_store_round_trip(spark, labelled, tmp_path):
    model = learn.fit(labelled, "y", ["a", "b", "c"], "logistic")
    store = learn.ModelStore(spark, str(tmp_path))
    store.save(model, "m1")
    back = store.load("m1")
    same = model.transform(labelled).select("k", "prediction").exceptAll(back.transform(labelled).select("k", "prediction"))
    assert same.count() == 0 and store.info("m1").features == ["a", "b", "c"]
    assert [r["model_id"] for r in store.list().collect()] == ["m1"]
    assert store.delete("m1")


def test_selection_search_and_vote(labelled):
    assert learn.select_features(labelled, "y", ["a", "b"], "univariate", 1) == ["a"]
    best, table = learn.grid_search(labelled, "y", ["a", "b"], "decision_tree", "k", {"maxDepth": [1, 3]}, folds=3)
    assert table.count() == 2 and best.transform(labelled).count() == 400
    cv = learn.cross_validate(labelled, "y", ["a", "b"], "logistic", "k", 3)
    assert cv.count() == 3 and cv.first()["mean"] > 0.8
    models = [learn.fit(labelled, "y", ["a", "b"], n) for n in ("logistic", "decision_tree", "naive_bayes")]
    voted = learn.vote(models, labelled)
    assert evaluate.classification_metrics(voted, "y", "prediction").first()["accuracy"] > 0.85
    imp = learn.permutation_importance(models[0], labelled, "k").collect()
    assert imp[0]["feature"] == "a"
    strict = models[0].predict_with_threshold(labelled, 0.9).agg(F.sum("prediction")).first()[0]
    assert strict < models[0].transform(labelled).agg(F.sum("prediction")).first()[0]
    assert len(models[0].top_classes(labelled, 2).first()["top_classes"]) == 2


def test_perfect_scores(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    assert evaluate.auc(df, "y", "s").first()["auc"] == 1.0 and evaluate.average_precision(df, "y", "s").first()[0] == 1.0
    ties = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, s double")
    assert evaluate.auc(ties, "y", "s").first()["auc"] == 0.5
    b = evaluate.bootstrap_mean(spark.range(2000).withColumn("v", F.col("id").cast("double")), "v", ["id"], 200).first()
    assert b["low"] < 999.5 < b["high"] and 30 < b["high"] - b["low"] < 80


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(22)
    x = np.vstack([rng.normal(0, 0.3, (80, 2)), rng.normal(5, 0.3, (80, 2)), rng.uniform(-3, 8, (15, 2)), np.full((60, 2), 2.5)])
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "k long, a double, b double").repartition(4).cache()


def _brute_dbscan(x, eps, m):
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= eps * eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, c = [i], label.max() + 1
            label[i] = c
            while stack:
                j = stack.pop()
                for t in np.flatnonzero(near[j]):
                    if core[t] and label[t] < 0:
                        label[t] = c
                        stack.append(t)
    border = ~core & (near & core[None]).any(1)
    return core, label, border


@pytest.mark.parametrize("eps, m", [(0.5, 5), (0.25, 4), (1.5, 10)])
def test_dbscan_brute_force(blobs, eps, m):
    x, df = blobs
    core, label, border = _brute_dbscan(x, eps, m)
    got = {r["k"]: r for r in density.dbscan(df, ["a", "b"], "k", eps, m).collect()}
    assert [got[i]["core"] for i in range(len(x))] == list(core)
    pairs = {(label[i], got[i]["cluster"]) for i in range(len(x)) if core[i]}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((got[i]["cluster"] >= 0) == (core[i] or border[i]) for i in range(len(x)))


def test_clusters(blobs):
    x, df = blobs
    two = df.filter("k < 160")
    for fn in (cluster.kmeans, cluster.gaussian_mixture, cluster.hierarchical):
        out = fn(two, ["a", "b"], 2).transform(two)
        assert out.groupBy("cluster", (F.col("k") < 80).alias("first")).count().count() == 2
    m = cluster.cluster_metrics(cluster.kmeans(two, ["a", "b"], 2).transform(two), ["a", "b"]).first()
    assert m["silhouette"] > 0.9 and m["davies_bouldin"] < 0.3


def test_anomalies(blobs, spark):
    x, df = blobs
    far = df.filter("k < 160").unionByName(spark.createDataFrame([(900, 40.0, 40.0)], "k long, a double, b double"))
    f = anomaly.IsolationForest(trees=40, contamination=0.02).fit(far, ["a", "b"], "k").transform(far)
    assert f.filter("k = 900").first()["prediction"] == -1
    assert anomaly.anomaly_summary(f).first()["anomalies"] <= 4
    lof = {r["k"]: r["score"] for r in anomaly.LocalOutlierFactor(10).fit(far, ["a", "b"], "k").transform(far).collect()}
    cells = {r["k"]: r["score"] for r in anomaly.LocalOutlierFactor(10, broadcast_points=0).fit(far, ["a", "b"], "k").transform(far).collect()}
    assert max(lof, key=lof.get) == 900 and lof == pytest.approx(cells)
    e = anomaly.EllipticEnvelope(0.05).fit(far, ["a", "b"]).transform(far)
    assert e.filter("k = 900").first()["prediction"] == -1


def test_knn_and_reduction(blobs):
    x, df = blobs
    t = df.filter("k < 160").withColumn("g", F.when(F.col("k") < 80, "l").otherwise("r"))
    out = neighbour_models.knn(t, "g", ["a", "b"], "k").transform(t)
    assert out.filter("g = prediction").count() == 160
    ld = reduce.discriminant(t, ["a", "b"], "g").transform(t).groupBy("g").agg(F.min("ld1").alias("lo"), F.max("ld1").alias("hi")).orderBy("lo").collect()
    assert ld[0]["hi"] < ld[1]["lo"]
    parts = reduce.nmf(t.select(F.abs("a").alias("a"), F.abs("b").alias("b")), ["a", "b"], 2, max_iter=20)
    assert parts.error < 0.2 * np.sqrt((np.abs(x[:160]) ** 2).sum())


def test_ica_separates(spark):
    rng = np.random.default_rng(23)
    s = np.column_stack([rng.uniform(-1, 1, 1500), rng.laplace(size=1500)])
    mixed = s @ np.array([[1.0, 0.6], [0.4, 1.0]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(mixed)], "k long, a double, b double")
    got = np.array([[r["ic1"], r["ic2"]] for r in reduce.ica(df, ["a", "b"], 2).transform(df).orderBy("k").collect()])
    c = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert c.max(1).min() > 0.95 and set(c.argmax(1)) == {0, 1}


def test_statistical_files(spark, tmp_path):
    for i in range(2):
        pd.DataFrame({"id": [i * 10 + j for j in range(3)], "v": [0.5, None, 2.0]}).to_stata(tmp_path / f"p{i}.dta", write_index=False)
    df = readers.load(spark, str(tmp_path), "dta", schema="id long, v double", chunk_rows=2)
    assert df.count() == 6 and df.filter("v is null").count() == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"columns": ["a", "b"], "data": [[1, "x"], [2, null]]}')
    out = readers.read_json(spark, str(tmp_path / "s.json"), orient="split")
    assert sorted(map(tuple, out.collect()), key=str) == [("1", "x"), ("2", None)]
    (tmp_path / "d.csv").write_text("a;b\n1;2\n3;NA\n")
    assert readers.infer_delimiter(spark, str(tmp_path / "d.csv")) == ";"
    df = readers.read_csv(spark, str(tmp_path / "d.csv"), delimiter=";", schema="a int, b double", na_values=["NA"])
    assert sorted(map(tuple, df.collect())) == [(1, 2.0), (3, None)]
    with pytest.raises(ValueError):
        readers.load(spark, "x", "xlsx")
    with pytest.raises(ValueError):
        writers.export(df, str(tmp_path / "o"), "html")
