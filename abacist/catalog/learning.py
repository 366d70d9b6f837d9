"""Model, cluster, anomaly and evaluation queries."""

from pyspark.sql import functions as F

from abacist.catalog.base import query, r, rounded, table
from abacist.catalog.inference import pick, vectors
from abacist.operators import anomaly, cluster, evaluate, learn, linkage, multivariate, neighbour_models, reduce, split


def quality(spark, d):
    """Labelled documents with simple numeric and text features."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.size(F.split("text", r"\s+")).alias("words"))
    return table(spark, d, "labels").join(docs, "doc_id")


def line_features(spark, d):
    """Order totals with features that have a unique key."""
    o = table(spark, d, "orders")
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_totalprice", "c_acctbal", "c_mktsegment", "o_orderpriority", "o_orderstatus")


def small_vectors(spark, d, n=4):
    t, cols = vectors(spark, d)
    return t, cols[:n]


# ---- splits -----------------------------------------------------------------

# The split itself depends on Spark's hash, so its sizes are what SQL can state.
@query("split_stratified", """SELECT o_orderstatus, CAST(round(0.8 * count(*)) AS BIGINT) AS train, count(*) - CAST(round(0.8 * count(*)) AS BIGINT) AS test FROM orders GROUP BY o_orderstatus""")
def split_stratified(spark, d):
    a, b = split.train_test_split(table(spark, d, "orders"), "o_orderkey", stratify="o_orderstatus")
    both = a.select("o_orderstatus", F.lit(1).alias("t")).unionByName(b.select("o_orderstatus", F.lit(0).alias("t")))
    return both.groupBy("o_orderstatus").agg(F.sum("t").alias("train"), F.sum(1 - F.col("t")).alias("test"))


@query("split_plain", "SELECT CAST(round(0.8 * count(*)) AS BIGINT) AS train FROM orders")
def split_plain(spark, d):
    return split.train_test_split(table(spark, d, "orders"), "o_orderkey")[0].agg(F.count(F.lit(1)).alias("train"))


@query("split_time", "SELECT o_orderkey FROM orders WHERE epoch_us(o_orderdate) <= (SELECT quantile_cont(CAST(epoch_us(o_orderdate) AS DOUBLE), 0.8) FROM orders)")
def split_time(spark, d):
    return split.time_split(table(spark, d, "orders"), "o_orderdate")[0].select("o_orderkey")


@query("split_validation", "SELECT count(*) AS n FROM orders")
def split_validation(spark, d):
    parts = split.three_way_split(table(spark, d, "orders"), "o_orderkey")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count_distinct("o_orderkey").alias("n"))


@query("fold_sizes")
def fold_sizes(spark, d):
    return table(spark, d, "orders").groupBy(split.fold_column("o_orderkey", 5).alias("fold")).count()


# ---- metrics ------------------------------------------------------------------

SCORED = "(SELECT l_linenumber > 3 AS y, l_quantity > 25 AS p, l_quantity / 50 AS s FROM lineitem)"


def scored(spark, d):
    return table(spark, d, "lineitem").select(
        (F.col("l_linenumber") > 3).cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("p"), (F.col("l_quantity") / 50).alias("s")
    )


@query("confusion_matrix", f"SELECT CAST(y AS INTEGER) AS label, CAST(p AS INTEGER) AS prediction, count(*) AS n FROM {SCORED} GROUP BY ALL")
def confusion_matrix(spark, d):
    return evaluate.confusion(scored(spark, d), "y", "p")


@query("classification_metrics", f"""WITH c AS (SELECT count(*) AS n, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM {SCORED}),
    m AS (SELECT *, tp / (tp + fp) AS p1, tn / (tn + fn) AS p0, tp / (tp + fn) AS r1, tn / (tn + fp) AS r0 FROM c)
    SELECT n, round((tp + tn) / n, 9) AS accuracy, round((p1 * (tp + fn) + p0 * (tn + fp)) / n, 9) AS precision, round((tp + tn) / n, 9) AS recall,
    round((2 * p1 * r1 / (p1 + r1) * (tp + fn) + 2 * p0 * r0 / (p0 + r0) * (tn + fp)) / n, 9) AS f1,
    round((CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)), 9) AS mcc FROM m""")
def classification_metrics(spark, d):
    return rounded(evaluate.classification_metrics(scored(spark, d), "y", "p"), 9)


@query("class_report", f"""SELECT CAST(CAST(y AS INTEGER) AS VARCHAR) AS label, round(count(*) FILTER (y = p) / (SELECT count(*) FROM {SCORED} q WHERE q.p = t.y), 9) AS precision,
    round(count(*) FILTER (y = p) / count(*), 9) AS recall, count(*) AS support FROM {SCORED} t GROUP BY y""")
def class_report(spark, d):
    return rounded(evaluate.class_report(scored(spark, d), "y", "p").drop("f1"), 9)


@query("auc", f"""WITH k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM {SCORED}), c AS (SELECT count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q, sum(rk) FILTER (y) AS r FROM k)
    SELECT p AS positives, q AS negatives, round((r - p * (p + 1) / 2) / (p * q), 9) AS auc FROM c""")
def auc(spark, d):
    return rounded(evaluate.auc(scored(spark, d), "y", "s"), 9)


@query("roc_curve", f"""WITH g AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q FROM {SCORED} GROUP BY s)
    SELECT round(s, 9) AS threshold, round(sum(q) OVER (ORDER BY s DESC) / sum(q) OVER (), 9) AS fpr, round(sum(p) OVER (ORDER BY s DESC) / sum(p) OVER (), 9) AS tpr FROM g""")
def roc_curve(spark, d):
    return rounded(evaluate.roc_curve(scored(spark, d), "y", "s"), 9)


@query("pr_curve", f"""WITH g AS (SELECT s, count(*) FILTER (y) AS p, count(*) AS n FROM {SCORED} GROUP BY s)
    SELECT round(s, 9) AS threshold, round(sum(p) OVER (ORDER BY s DESC) / sum(n) OVER (ORDER BY s DESC), 9) AS precision, round(sum(p) OVER (ORDER BY s DESC) / sum(p) OVER (), 9) AS recall FROM g""")
def pr_curve(spark, d):
    return rounded(evaluate.pr_curve(scored(spark, d), "y", "s"), 9)


@query("average_precision", f"""WITH g AS (SELECT s, count(*) FILTER (y) AS p, count(*) AS n FROM {SCORED} GROUP BY s), c AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS k FROM g)
    SELECT round(sum(p * tp / k) / sum(p), 9) AS average_precision FROM c""")
def average_precision(spark, d):
    return rounded(evaluate.average_precision(scored(spark, d), "y", "s"), 9)


@query("calibration_curve", f"SELECT CAST(least(floor(s * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(s), 9) AS mean_score, round(avg(CAST(y AS INTEGER)), 9) AS event_rate FROM {SCORED} GROUP BY 1")
def calibration_curve(spark, d):
    return rounded(evaluate.calibration_curve(scored(spark, d), "y", "s"), 9)


@query("log_loss", f"SELECT round(-avg(CASE WHEN y THEN ln(least(greatest(s, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(s, 1e-15), 1 - 1e-15)) END), 9) AS log_loss FROM {SCORED}")
def log_loss(spark, d):
    return rounded(evaluate.log_loss(scored(spark, d), "y", "s"), 9)


@query("regression_metrics", """WITH e AS (SELECT l_extendedprice AS y, l_extendedprice - 1500 * l_quantity AS e FROM lineitem)
    SELECT count(*) AS n, round(sqrt(avg(e * e)), 4) AS rmse, round(avg(abs(e)), 4) AS mae, round(1 - sum(e * e) / (var_pop(y) * count(*)), 8) AS r2, round(avg(abs(e / y)), 7) AS mape,
    round(1 - var_pop(e) / var_pop(y), 8) AS explained_variance, round(avg(e), 4) AS residual_mean, round(stddev_pop(e), 4) AS residual_std, round(min(e), 2) AS residual_min, round(max(e), 2) AS residual_max FROM e""")
def regression_metrics(spark, d):
    t = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    return pick(evaluate.regression_metrics(t, "l_extendedprice", "p"), n=None, rmse=4, mae=4, r2=8, mape=7, explained_variance=8, residual_mean=4, residual_std=4, residual_min=2, residual_max=2)


@query("bootstrap_mean")
def bootstrap_mean(spark, d):
    return evaluate.bootstrap_mean(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 50)


# ---- supervised models -----------------------------------------------------------

CLASS_FEATURES = ["n_chars", "words", "lang", "toxic"]
REG_FEATURES = ["c_acctbal", "c_mktsegment", "o_orderpriority"]


def _classifier(name, **params):
    def run(spark, d):
        model, metrics = learn.train(quality(spark, d), "quality", CLASS_FEATURES, name, "doc_id", "classification", params=params)
        return metrics

    return run


for _name, _params in {
    "logistic": {}, "svm": {"components": 40, "max_iter": 30}, "random_forest": {"trees": 20}, "gradient_boosting": {"trees": 10},
    "decision_tree": {}, "naive_bayes": {}, "neural_network": {"max_iter": 30},
}.items():
    query(f"classify_{_name}")(_classifier(_name, **_params))


def _regressor(name, **params):
    def run(spark, d):
        return learn.train(line_features(spark, d), "o_totalprice", REG_FEATURES, name, "o_orderkey", "regression", params=params)[1]

    return run


for _name, _params in {"linear": {}, "ridge": {}, "lasso": {}, "elastic_net": {}, "random_forest": {"trees": 10}, "gradient_boosting": {"trees": 5}}.items():
    query(f"regress_{_name}")(_regressor(_name, **_params))


# Leave-nothing-out check of the exact neighbour vote: every part votes among all parts.
KNN_SQL = """WITH p AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS a, p_retailprice / 100 AS b, p_brand AS y FROM part),
    n AS (SELECT q.id AS qid, t.y, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2), t.id) AS k FROM p q, p t)
    SELECT qid AS p_partkey, first(y ORDER BY c DESC, y) AS prediction FROM (SELECT qid, y, count(*) AS c FROM n WHERE k <= 5 GROUP BY 1, 2) GROUP BY qid"""


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"), "p_brand")


@query("knn_classify", KNN_SQL)
def knn_classify(spark, d):
    t = _parts(spark, d)
    return neighbour_models.knn(t, "p_brand", ["a", "b"], "p_partkey").transform(t).select("p_partkey", "prediction")


@query("knn_classify_by_cells", KNN_SQL)
def knn_classify_by_cells(spark, d):
    t = _parts(spark, d)
    return neighbour_models.knn(t, "p_brand", ["a", "b"], "p_partkey").transform(t, broadcast_points=0).select("p_partkey", "prediction")


@query("cross_validation")
def cross_validation(spark, d):
    return learn.cross_validate(quality(spark, d), "quality", CLASS_FEATURES, "logistic", "doc_id", 3, "classification")


@query("grid_search")
def grid_search(spark, d):
    return learn.grid_search(quality(spark, d), "quality", CLASS_FEATURES, "decision_tree", "doc_id", {"maxDepth": [2, 4]}, folds=3, task="classification")[1]


@query("automl")
def automl(spark, d):
    return learn.automl(quality(spark, d), "quality", CLASS_FEATURES, "doc_id", "classification", ("logistic", "decision_tree", "naive_bayes"))[1].drop("seconds")


@query("feature_importance")
def feature_importance(spark, d):
    return learn.fit(quality(spark, d), "quality", CLASS_FEATURES, "random_forest", "classification", params={"trees": 10}).importance(normalize=True)


@query("permutation_importance")
def permutation_importance(spark, d):
    t = quality(spark, d)
    model = learn.fit(t, "quality", ["n_chars", "words"], "logistic", "classification")
    return learn.permutation_importance(model, t, "doc_id")


@query("univariate_f", """WITH g AS (SELECT quality AS g, count(*) AS n, avg(n_chars) AS m, var_samp(n_chars) AS v FROM labels JOIN documents USING (doc_id) GROUP BY 1), t AS (SELECT sum(n * m) / sum(n) AS gm FROM g)
    SELECT 'n_chars' AS feature, round((sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 7) AS f FROM g, t""")
def univariate_f(spark, d):
    return pick(learn.univariate_scores(quality(spark, d), "quality", ["n_chars"], "classification"), feature=None, f=7)


def _selected(spark, d, method):
    names = learn.select_features(quality(spark, d), "quality", CLASS_FEATURES[:2] + ["toxic"], method, 2, "classification", trees=5)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("select_univariate")
def select_univariate(spark, d):
    return _selected(spark, d, "univariate")


@query("select_rfe")
def select_rfe(spark, d):
    return _selected(spark, d, "rfe")


@query("select_l1")
def select_l1(spark, d):
    return _selected(spark, d, "l1")


@query("predict_threshold_topk")
def predict_threshold_topk(spark, d):
    t = quality(spark, d)
    model = learn.fit(t, "quality", CLASS_FEATURES, "logistic", "classification")
    out = model.top_classes(model.predict_with_threshold(t, 0.7).withColumnRenamed("prediction", "strict").drop("probability", "predicted_label"), 2)
    return out.select("doc_id", "strict", "prediction", "predicted_label", "top_classes")


@query("balanced_weights", """SELECT doc_id, round((SELECT count(*) FROM labels) / (2 * count(*) OVER (PARTITION BY quality)), 9) AS class_weight FROM labels""")
def balanced_weights(spark, d):
    return rounded(learn.balanced_weights(table(spark, d, "labels"), "quality").select("doc_id", "class_weight"), 9)


@query("voting_ensemble")
def voting_ensemble(spark, d):
    t = quality(spark, d)
    models = [learn.fit(t, "quality", CLASS_FEATURES, n, "classification") for n in ("logistic", "decision_tree", "naive_bayes")]
    return learn.vote(models, t).select("doc_id", "prediction")


@query("model_store_round_trip")
def model_store_round_trip(spark, d):
    from abacist.catalog.preparation import _folder

    t = quality(spark, d)
    store = learn.ModelStore(spark, _folder(spark))
    store.save(learn.fit(t, "quality", CLASS_FEATURES, "logistic", "classification"), "quality-logit")
    return store.load("quality-logit").transform(t).select("doc_id", "prediction", "predicted_label")


@query("evaluate_stored_model")
def evaluate_stored_model(spark, d):
    from abacist.catalog.preparation import _folder

    t = quality(spark, d)
    store = learn.ModelStore(spark, _folder(spark))
    store.save(learn.fit(t, "quality", CLASS_FEATURES, "logistic", "classification"), "quality-logit")
    return store.load("quality-logit").evaluate(t)


# ---- clusters ----------------------------------------------------------------------

@query("kmeans")
def kmeans(spark, d):
    t, cols = vectors(spark, d)
    return cluster.kmeans(t, cols, 3).transform(t).select("vec_id", "cluster")


@query("kmeans_centers")
def kmeans_centers(spark, d):
    t = table(spark, d, "part")
    return cluster.kmeans(t, ["p_size", "p_retailprice"], 3).centers()


@query("gaussian_mixture")
def gaussian_mixture(spark, d):
    t = table(spark, d, "part")
    return cluster.gaussian_mixture(t, ["p_size", "p_retailprice"], 3).transform(t).select("p_partkey", "cluster")


@query("hierarchical")
def hierarchical(spark, d):
    t, cols = vectors(spark, d)
    return cluster.hierarchical(t, cols, 3).transform(t).select("vec_id", "cluster")


@query("spectral")
def spectral(spark, d):
    t, cols = small_vectors(spark, d)
    return cluster.spectral(t, cols, "vec_id", 3)


@query("cluster_metrics", """WITH x AS (SELECT label AS c, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings), g AS (SELECT c, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) + var_pop(b) AS v FROM x GROUP BY c),
    t AS (SELECT avg(a) AS ga, avg(b) AS gb FROM x), s AS (SELECT c, avg(sqrt((a - ma) ** 2 + (b - mb) ** 2)) AS s FROM x JOIN g USING (c) GROUP BY c),
    w AS (SELECT sum(n * v) AS w, sum(n * ((ma - ga) ** 2 + (mb - gb) ** 2)) AS bt, count(*) AS k, sum(n) AS n FROM g, t),
    p AS (SELECT g1.c, max((s1.s + s2.s) / sqrt((g1.ma - g2.ma) ** 2 + (g1.mb - g2.mb) ** 2)) AS d FROM g g1 JOIN g g2 ON g1.c <> g2.c JOIN s s1 ON s1.c = g1.c JOIN s s2 ON s2.c = g2.c GROUP BY 1)
    SELECT CAST(n AS BIGINT) AS n, k AS clusters, round(w, 7) AS inertia, round((bt / (k - 1)) / (w / (n - k)), 7) AS calinski_harabasz, round((SELECT avg(d) FROM p), 7) AS davies_bouldin FROM w""")
def cluster_metrics(spark, d):
    t = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("a"), F.col("embedding")[1].cast("double").alias("b"))
    return pick(cluster.cluster_metrics(t, ["a", "b"], "label", silhouette=False), n=None, clusters=None, inertia=7, calinski_harabasz=7, davies_bouldin=7)


@query("silhouette")
def silhouette(spark, d):
    t, cols = vectors(spark, d)
    return cluster.cluster_metrics(t, cols, "label").select("silhouette")


# ---- reduction ---------------------------------------------------------------------

@query("discriminant")
def discriminant(spark, d):
    t, cols = small_vectors(spark, d, 8)
    return reduce.discriminant(t, cols, "label", 2).transform(t).select("vec_id", "ld1", "ld2")


@query("nmf")
def nmf(spark, d):
    return reduce.nmf(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 2, max_iter=10).components()


@query("ica")
def ica(spark, d):
    t, cols = small_vectors(spark, d, 8)
    return reduce.ica(t, cols, 2, max_iter=20).transform(t).select("vec_id", "ic1", "ic2")


@query("factor_scores")
def factor_scores(spark, d):
    t, cols = small_vectors(spark, d, 8)
    return multivariate.factor_analysis(t, cols, 2).communalities()


# ---- anomalies ----------------------------------------------------------------------

@query("isolation_forest")
def isolation_forest(spark, d):
    t = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return anomaly.IsolationForest().fit(t, ["o_totalprice", "o_custkey"], "o_orderkey").transform(t).select("o_orderkey", "score", "prediction")


@query("isolation_outliers")
def isolation_outliers(spark, d):
    from abacist.operators.profile import detect_outliers, outlier_summary

    return outlier_summary(detect_outliers(table(spark, d, "events"), ["value"], "event_id", "isolation_forest"))


LOF_SQL = """WITH p AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier),
    e AS (SELECT q.id AS qid, t.id AS tid, sqrt((q.a - t.a) ** 2 + (q.b - t.b) ** 2) AS dist FROM p q, p t),
    n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS k FROM e WHERE qid <> tid QUALIFY k <= 20),
    kd AS (SELECT qid AS id, max(dist) AS kd FROM n GROUP BY 1),
    lrd AS (SELECT qid AS id, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM n JOIN kd ON kd.id = tid GROUP BY 1),
    m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS k FROM e QUALIFY k <= 20),
    own AS (SELECT qid AS id, 1 / (avg(greatest(dist, kd)) + 1e-10) AS own FROM m JOIN kd ON kd.id = tid GROUP BY 1),
    th AS (SELECT qid AS id, avg(lrd) AS th FROM m JOIN lrd ON lrd.id = tid GROUP BY 1)
    SELECT id AS s_suppkey, round(th / own, 7) AS score FROM own JOIN th USING (id)"""


@query("local_outlier_factor", LOF_SQL)
def local_outlier_factor(spark, d):
    t = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    out = anomaly.LocalOutlierFactor(20).fit(t, ["a", "b"], "s_suppkey").transform(t)
    return pick(out, s_suppkey=None, score=7)


@query("elliptic_envelope")
def elliptic_envelope(spark, d):
    t = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return anomaly.EllipticEnvelope().fit(t, ["p_size", "p_retailprice"]).transform(t).select("p_partkey", "prediction")


@query("anomaly_metrics", """WITH t AS (SELECT CAST(l_discount > 0.09 AS INTEGER) AS y, CAST(l_tax > 0.07 AS INTEGER) AS p FROM lineitem), c AS (SELECT count(*) AS n, count(*) FILTER (y = 1 AND p = 1) AS tp, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn FROM t)
    SELECT round((n - fp - fn) / n, 9) AS accuracy, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM c""")
def anomaly_metrics(spark, d):
    t = table(spark, d, "lineitem").select(F.expr("if(l_discount > 0.09, -1, 1)").alias("y"), F.expr("if(l_tax > 0.07, -1, 1)").alias("prediction"))
    return rounded(anomaly.anomaly_metrics(t, "y").select("accuracy", "precision", "recall"), 9)


DBSCAN_SQL = """WITH RECURSIVE p AS (SELECT s_suppkey AS id, s_acctbal / 1000 AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier),
    e AS (SELECT q.id AS qid, t.id AS tid FROM p q, p t WHERE (q.a - t.a) ** 2 + (q.b - t.b) ** 2 <= 1.44),
    core AS (SELECT qid AS id FROM e GROUP BY qid HAVING count(*) >= 4),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT e.tid, reach.root FROM reach JOIN e ON e.qid = reach.id JOIN core c ON c.id = e.tid),
    comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
    SELECT p.id AS s_suppkey, core.id IS NOT NULL AS core,
    CASE WHEN core.id IS NOT NULL THEN (SELECT count(*) FROM comp c2 WHERE c2.root = comp.root) ELSE 0 END AS core_size FROM p LEFT JOIN core USING (id) LEFT JOIN comp USING (id)"""


@query("dbscan", DBSCAN_SQL)
def dbscan(spark, d):
    from abacist.operators.density import dbscan as run

    t = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    out = run(t, ["a", "b"], "s_suppkey", 1.2, 4)
    size = out.filter("core").groupBy("cluster").agg(F.count(F.lit(1)).alias("core_size"))
    out = out.join(size, "cluster", "left")
    return out.select("s_suppkey", "core", F.when(F.col("core"), F.col("core_size")).otherwise(F.lit(0)).alias("core_size"))


@query("dbscan_labels")
def dbscan_labels(spark, d):
    from abacist.operators.density import dbscan as run

    return run(table(spark, d, "events").select("event_id", "value", (F.col("user_id") / 100).alias("u")), ["value", "u"], "event_id", 0.5, 10).select("event_id", "cluster")


VECTOR_PAIRS = """WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
    e AS (SELECT q.id AS qid, t.id AS tid FROM v q, v t WHERE list_distance(q.x, t.x) <= {0})"""


@query("dbscan_vectors", VECTOR_PAIRS.format(1.15) + """,
    core AS (SELECT qid AS id FROM e GROUP BY qid HAVING count(*) >= 4),
    reach(id, root) AS (SELECT id, id FROM core UNION SELECT e.tid, reach.root FROM reach JOIN e ON e.qid = reach.id JOIN core c ON c.id = e.tid),
    comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id), named AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS k FROM comp GROUP BY root),
    label AS (SELECT comp.id, k FROM comp JOIN named USING (root)), near AS (SELECT e.qid AS id, min(k) AS k FROM e JOIN label ON label.id = e.tid GROUP BY e.qid)
    SELECT v.id AS vec_id, CAST(coalesce(label.k, near.k, -1) AS INTEGER) AS cluster, label.id IS NOT NULL AS core FROM v LEFT JOIN label ON label.id = v.id LEFT JOIN near ON near.id = v.id""")
def dbscan_vectors(spark, d):
    from abacist.operators.density import dbscan as run

    t, cols = vectors(spark, d)
    return run(t, cols, "vec_id", 1.15, 4)


@query("single_linkage", VECTOR_PAIRS.format(1.1) + """,
    reach(id, root) AS (SELECT id, id FROM v UNION SELECT e.tid, reach.root FROM reach JOIN e ON e.qid = reach.id),
    comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id), named AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS k FROM comp GROUP BY root)
    SELECT id AS vec_id, CAST(k AS INTEGER) AS cluster FROM comp JOIN named USING (root)""")
def single_linkage(spark, d):
    t, cols = vectors(spark, d)
    return linkage.single_linkage(t, cols, "vec_id", height=1.1, standardize=False)
