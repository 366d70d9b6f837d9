"""Supervised models: preparation, fit, tuning, selection, storage.

Every model is a Spark `PipelineModel`, so its encoders and fill values are
those of the training rows and travel with it.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, OneHotEncoderModel, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.functions.columns import columns_of
from abacist.operators.evaluate import auc, classification_metrics, log_loss, regression_metrics
from abacist.operators.frequency import levels
from abacist.operators.hypothesis import f_of_groups
from abacist.operators.split import fold_column, key_hash, train_test_split
from abacist.plans.moments import moments
from abacist.plans.ordering import with_row_index
from abacist.plans.quantiles import clean_double
from abacist.plans.session import durable

LABEL = "_label"
FEATURES = "_features"
CLASSIFIERS = ("logistic", "svm", "random_forest", "gradient_boosting", "decision_tree", "naive_bayes", "neural_network")
REGRESSORS = ("linear", "ridge", "lasso", "elastic_net", "random_forest", "gradient_boosting")


def infer_task(df: DataFrame, target: str) -> str:
    """Classification for text targets or fewer than 10 distinct values."""
    if target not in columns_of(df, "numeric"):
        return "classification"
    few = df.select(target).filter(F.col(target).isNotNull()).distinct().limit(10).count()
    return "classification" if few < 10 else "regression"


def preparation(df: DataFrame, features: Sequence[str], encoding: str = "label", scale: bool = False) -> list:
    """Stages that code text columns, fill numbers with the mean and build the vector."""
    text = [c for c in features if c not in columns_of(df, "numeric")]
    numeric = [c for c in features if c not in text]
    stages: list = []
    inputs = []
    if numeric:
        stages.append(Imputer(strategy="mean", inputCols=numeric, outputCols=[f"_num_{c}" for c in numeric]))
    if text:
        stages.append(
            StringIndexer(inputCols=text, outputCols=[f"_idx_{c}" for c in text], handleInvalid="keep", stringOrderType="alphabetAsc")
        )
        if encoding == "onehot":
            stages.append(OneHotEncoder(inputCols=[f"_idx_{c}" for c in text], outputCols=[f"_hot_{c}" for c in text], dropLast=True))
    for c in features:
        inputs.append(f"_num_{c}" if c in numeric else f"_hot_{c}" if encoding == "onehot" else f"_idx_{c}")
    out = "_raw" if scale else FEATURES
    stages.append(VectorAssembler(inputCols=inputs, outputCol=out))
    if scale:
        stages.append(StandardScaler(inputCol="_raw", outputCol=FEATURES, withMean=True, withStd=True))
    return stages


def _numeric_input(df: DataFrame, features: Sequence[str]) -> DataFrame:
    numeric = set(columns_of(df, "numeric"))
    return df.withColumns({c: clean_double(c) if c in numeric else F.col(c).cast("string") for c in features})


def _rbf_stages(df: DataFrame, features: Sequence[str], gamma: float, size: int, seed: int) -> list:
    """Random Fourier features of the prepared, standardised inputs, as SQL columns."""
    numeric = [c for c in features if c in columns_of(df, "numeric")]
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.struct(F.count(c).alias("k"), F.avg(c).alias("m"), F.var_pop(c).alias("v")).alias(f"s{i}") for i, c in enumerate(numeric)],
    ).first()
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (size, len(features)))
    shift = rng.uniform(0, 2 * math.pi, size)
    inputs = []
    for i, c in enumerate(features):
        if c in numeric:
            s = stats[f"s{numeric.index(c)}"]
            # Filling with the mean shrinks the variance by the share of known values.
            sd = math.sqrt((s["v"] or 0.0) * s["k"] / stats["n"]) or 1.0
            inputs.append((f"`_num_{c}`", s["m"] or 0.0, sd))
        else:
            inputs.append((f"`_idx_{c}`", 0.0, 1.0))
    terms = []
    for j in range(size):
        inner = " + ".join(f"{float(w[j, i] / sd)!r}D * ({name} - ({float(mean)!r}D))" for i, (name, mean, sd) in enumerate(inputs))
        terms.append(f"{math.sqrt(2 / size)!r}D * cos({inner} + {float(shift[j])!r}D) AS _rff{j}")
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(terms)} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_rff{j}" for j in range(size)], outputCol="_rbf"),
    ]


def classifier(name: str, n_train: int, n_features: int, classes: int, **params):
    """The Spark estimator behind an algorithm name."""
    seed = params.pop("seed", 42)
    cols = {"featuresCol": FEATURES, "labelCol": LABEL}
    if name == "logistic":
        c = params.pop("C", 1.0)
        return LogisticRegression(
            regParam=1.0 / (c * max(n_train, 1)), elasticNetParam=params.pop("l1_ratio", 0.0), standardization=False, maxIter=params.pop("max_iter", 1000), tol=1e-12, **cols, **params
        )
    if name == "svm":
        c = params.pop("C", 1.0)
        base = LinearSVC(regParam=1.0 / (c * max(n_train, 1)), maxIter=params.pop("max_iter", 100), **cols, **params)
        return base if classes == 2 else OneVsRest(classifier=base, rawPredictionCol="rawPrediction", **cols)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=params.pop("trees", 100), maxDepth=params.pop("depth", 10), seed=seed, **cols, **params)
    if name == "gradient_boosting":
        base = GBTClassifier(maxIter=params.pop("trees", 100), maxDepth=params.pop("depth", 3), stepSize=0.1, seed=seed, **cols, **params)
        return base if classes == 2 else OneVsRest(classifier=base, **cols)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=params.pop("depth", 10), seed=seed, **cols, **params)
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian", **cols, **params)
    if name == "neural_network":
        layers = [n_features, *params.pop("hidden", (100, 50)), classes]
        return MultilayerPerceptronClassifier(layers=layers, maxIter=params.pop("max_iter", 100), seed=seed, **cols, **params)
    raise ValueError(f"unknown classifier: {name}")


def regressor(name: str, n_train: int, sd: float, **params):
    """The Spark estimator behind an algorithm name; penalties match the usual definitions."""
    seed = params.pop("seed", 42)
    cols = {"featuresCol": FEATURES, "labelCol": LABEL}
    alpha = params.pop("alpha", 1.0)
    plain = {"standardization": False, "maxIter": 1000, "tol": 1e-10, **cols}
    if name == "linear":
        return LinearRegression(solver="normal", regParam=0.0, **cols, **params)
    if name == "ridge":
        # Spark divides the squared loss by 2n and scales the L2 term by the label's sd.
        return LinearRegression(regParam=alpha * sd / max(n_train, 1), elasticNetParam=0.0, **plain)
    if name == "lasso":
        return LinearRegression(regParam=alpha, elasticNetParam=1.0, **plain)
    if name == "elastic_net":
        ratio = params.pop("l1_ratio", 0.5)
        l1, l2 = alpha * ratio, alpha * (1 - ratio) * sd
        return LinearRegression(regParam=l1 + l2, elasticNetParam=l1 / (l1 + l2) if l1 + l2 else 0.0, **plain)
    if name == "random_forest":
        return RandomForestRegressor(numTrees=params.pop("trees", 100), maxDepth=params.pop("depth", 10), seed=seed, **cols, **params)
    if name == "gradient_boosting":
        return GBTRegressor(maxIter=params.pop("trees", 100), maxDepth=params.pop("depth", 3), stepSize=0.1, seed=seed, **cols, **params)
    raise ValueError(f"unknown regressor: {name}")


@dataclass
class Metadata:
    task: str
    algorithm: str
    features: list[str]
    target: str
    classes: list[str]
    metrics: dict = field(default_factory=dict)
    created: float = 0.0
    params: dict = field(default_factory=dict)


@dataclass
class TrainedModel:
    """A fitted pipeline with what is needed to use it on new rows."""

    fitted: PipelineModel
    meta: Metadata

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `prediction` (and `probability`, `predicted_label` for classes)."""
        out = self.fitted.transform(_numeric_input(df, self.meta.features))
        keep = [F.col(c) for c in df.columns]
        keep.append(F.col("prediction"))
        if self.meta.task == "classification":
            if "probability" in out.columns:
                keep.append(F.col("probability"))
            names = F.array(*[F.lit(c) for c in self.meta.classes])
            keep.append(F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted_label"))
        return out.select(*keep)

    def with_label(self, df: DataFrame) -> DataFrame:
        return with_label(df, self.meta)

    def evaluate(self, df: DataFrame) -> DataFrame:
        """Metrics of the stored model on rows that carry the target."""
        scored = self.transform(self.with_label(df.filter(F.col(self.meta.target).isNotNull())))
        if self.meta.task == "regression":
            return regression_metrics(scored, LABEL, "prediction")
        scored = durable(scored.select(LABEL, "prediction", *([vector_to_array("probability").alias("p")] if "probability" in scored.columns else [])))
        out = classification_metrics(scored, LABEL, "prediction")
        if len(self.meta.classes) == 2 and "p" in scored.columns:
            p = scored.select(LABEL, F.col("p")[1].alias("p"))
            out = out.withColumns({"auc": F.lit(auc(p, LABEL, "p").first()["auc"]), "log_loss": F.lit(log_loss(p, LABEL, "p").first()[0])})
        return out

    def input_names(self) -> list[str]:
        """Names of the vector's places: features, or `feature=level` where levels have places of their own."""
        hot = any(isinstance(s, OneHotEncoderModel) for s in self.fitted.stages)
        known = {c: x for s in self.fitted.stages if isinstance(s, StringIndexerModel) and hot for c, x in zip(s.getInputCols(), s.labelsArray)}
        return [name for c in self.meta.features for name in ([f"{c}={x}" for x in known[c]] if c in known else [c])]

    def importance(self, normalize: bool = False) -> DataFrame:
        """Tree importances or absolute coefficients, largest first."""
        # A matrix is asked for before coefficients: models of several classes refuse those.
        kinds = ("featureImportances", "coefficientMatrix", "coefficients", "models")
        model = next((s for s in self.fitted.stages if any(hasattr(s, k) for k in kinds)), None)
        if model is None:
            raise ValueError(f"{self.meta.algorithm} has no feature importance")
        if isinstance(model, OneVsRestModel):
            parts = [m.featureImportances if hasattr(m, "featureImportances") else m.coefficients for m in model.models]
            values = np.abs([p.toArray() for p in parts]).mean(0)
        elif hasattr(model, "featureImportances"):
            values = model.featureImportances.toArray()
        elif getattr(model, "numClasses", 2) > 2:
            values = np.abs(model.coefficientMatrix.toArray()).mean(0)
        else:
            values = np.abs(model.coefficients.toArray())
        names = self.input_names()
        if len(values) != len(names):  # features made by a kernel have no names of their own
            names = [f"{i}" for i in range(len(values))]
        total = values.sum()
        if normalize and total > 0:
            values = values / total
        spark = SparkSession.active()
        return spark.createDataFrame([(n, float(v)) for n, v in zip(names, values)], "feature string, importance double").orderBy(F.desc("importance"), "feature")

    def predict_with_threshold(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """Binary decision at another probability than one half."""
        out = self.transform(df)
        return out.withColumn("prediction", (vector_to_array("probability")[1] > threshold).cast("double"))

    def top_classes(self, df: DataFrame, k: int = 3) -> DataFrame:
        """The k most probable classes as `(label, probability)` structs."""
        p = vector_to_array("probability")
        pairs = F.array(*[F.struct((-p[i]).alias("neg"), F.lit(c).alias("label")) for i, c in enumerate(self.meta.classes)])
        best = F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["label"].alias("label"), (-s["neg"]).alias("probability")))
        return self.transform(df).withColumn("top_classes", best)


def with_label(df: DataFrame, meta: Metadata) -> DataFrame:
    if meta.task == "regression":
        return df.withColumn(LABEL, clean_double(meta.target))
    code = F.array_position(F.array(*[F.lit(c) for c in meta.classes]), F.col(meta.target).cast("string")) - 1
    return df.withColumn(LABEL, F.when(code >= 0, code).cast("double"))


def _estimator(df: DataFrame, meta: Metadata, encoding: str, scale: bool, params: Mapping):
    """Pipeline for labelled rows `df`; the fit constants come from those rows."""
    if meta.task == "classification":
        n = df.count()
        rbf = meta.algorithm == "svm" and params.get("kernel", "rbf") == "rbf" and encoding == "label"
        stages = preparation(df, meta.features, encoding, scale or (meta.algorithm == "svm" and not rbf))
        width = len(meta.features)
        if rbf:
            options = {k: v for k, v in params.items() if k != "kernel"}
            # Scaled inputs have unit variance, so 1/p is the usual default width.
            gamma, size = options.pop("gamma", 1.0 / width), options.pop("components", 100)
            stages += _rbf_stages(df, meta.features, gamma, size, options.pop("seed", 42))
            est = classifier("svm", n, size, len(meta.classes), **options).setFeaturesCol("_rbf")
            if isinstance(est, OneVsRest):
                est.getClassifier().setFeaturesCol("_rbf")
        else:
            options = {k: v for k, v in params.items() if k != "kernel"}
            est = classifier(meta.algorithm, n, width, len(meta.classes), **options)
        stages.append(est)
        if meta.algorithm == "svm":
            # Probabilities from a logistic fit to the margins.
            stages.append(VectorAssembler(inputCols=["rawPrediction"], outputCol="_margin"))
            stages.append(
                LogisticRegression(featuresCol="_margin", labelCol=LABEL, rawPredictionCol="_mraw", predictionCol="_mpred", probabilityCol="probability", maxIter=100)
            )
        return Pipeline(stages=stages)
    s = df.agg(F.count(LABEL).alias("n"), F.stddev_pop(LABEL).alias("sd")).first()
    return Pipeline(stages=[*preparation(df, meta.features, encoding, scale), regressor(meta.algorithm, s["n"], s["sd"] or 1.0, **dict(params))])


def fit(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    algorithm: str,
    task: str = "auto",
    *,
    encoding: str = "label",
    scale: bool = False,
    weight: str | None = None,
    params: Mapping | None = None,
) -> TrainedModel:
    """Fit on all given rows that have a target."""
    task = infer_task(df, target) if task == "auto" else task
    data = _numeric_input(df.filter(F.col(target).isNotNull()), features)
    classes = [str(c) for c in levels(data.select(F.col(target).cast("string").alias("c")), "c")] if task == "classification" else []
    meta = Metadata(task, algorithm, list(features), target, classes, created=time.time(), params=dict(params or {}))
    labelled = with_label(data, meta)
    estimator = _estimator(labelled, meta, encoding, scale, params or {})
    if weight:
        for stage in estimator.getStages():
            if stage.hasParam("weightCol"):
                stage.set(stage.getParam("weightCol"), weight)
    return TrainedModel(estimator.fit(labelled), meta)


def train(
    df: DataFrame, target: str, features: Sequence[str], algorithm: str, key: str, task: str = "auto", *, train_share: float = 0.8, seed: int = 42, **options
) -> tuple[TrainedModel, DataFrame]:
    """Split by key hash (stratified for classes), fit on train, score on test."""
    task = infer_task(df, target) if task == "auto" else task
    complete = df.filter(F.col(target).isNotNull())
    train_rows, test_rows = train_test_split(complete, key, train_share, seed, target if task == "classification" else None)
    # Several passes follow; a lost partition is recomputed from the hash.
    train_rows = train_rows.persist()
    try:
        model = fit(train_rows, target, features, algorithm, task, **options)
    finally:
        train_rows.unpersist()
    metrics = model.evaluate(test_rows)
    model.meta.metrics = {k: v for k, v in metrics.first().asDict().items() if v is not None}
    return model, metrics


def balanced_weights(df: DataFrame, target: str, name: str = "class_weight") -> DataFrame:
    """Weights inversely proportional to the class sizes."""
    counts = {r[0]: r[1] for r in df.filter(F.col(target).isNotNull()).groupBy(target).count().limit(1001).collect()}
    if len(counts) > 1000:
        raise ValueError("too many classes for class weights")
    n, k = sum(counts.values()), len(counts)
    weight: Column = F.lit(None).cast("double")
    for c, m in counts.items():
        weight = F.when(F.col(target) == F.lit(c), F.lit(n / (k * m))).otherwise(weight)
    return df.withColumn(name, weight)


def _score(model: TrainedModel, rows: DataFrame) -> float:
    """Accuracy, or minus the mean squared error."""
    r = model.evaluate(rows).first()
    return r["accuracy"] if model.meta.task == "classification" else -r["mse"]


def cross_validate(
    df: DataFrame, target: str, features: Sequence[str], algorithm: str, key: str, folds: int = 5, task: str = "auto", seed: int = 42, **options
) -> DataFrame:
    """One row per fold, plus mean and standard deviation in every row."""
    task = infer_task(df, target) if task == "auto" else task
    data = df.filter(F.col(target).isNotNull()).withColumn("_fold", fold_column(key, folds, seed)).persist()
    scores = []
    try:
        for f in range(folds):
            model = fit(data.filter(F.col("_fold") != f).drop("_fold"), target, features, algorithm, task, **options)
            scores.append(_score(model, data.filter(F.col("_fold") == f).drop("_fold")))
    finally:
        data.unpersist()
    mean, sd = float(np.mean(scores)), float(np.std(scores))
    return df.sparkSession.createDataFrame(
        [(f, float(s), mean, sd) for f, s in enumerate(scores)], "fold int, score double, mean double, std double"
    )


GRIDS: dict[str, dict[str, list]] = {
    "logistic": {"regParam": [1.0, 0.1, 0.01], "elasticNetParam": [0.0, 1.0]},
    "random_forest": {"numTrees": [50, 100], "maxDepth": [5, 10], "minInstancesPerNode": [1, 5]},
    "svm": {"regParam": [1.0, 0.1, 0.01]},
    "decision_tree": {"maxDepth": [3, 5, 10]},
    "gradient_boosting": {"maxDepth": [3, 5]},
    "ridge": {"regParam": [0.001, 0.1, 1.0]},
    "lasso": {"regParam": [0.001, 0.1, 1.0]},
    "elastic_net": {"regParam": [0.001, 0.1], "elasticNetParam": [0.2, 0.8]},
}


def grid_search(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    algorithm: str,
    key: str,
    grid: Mapping[str, Sequence] | None = None,
    *,
    folds: int = 5,
    task: str = "auto",
    seed: int = 42,
    parallelism: int = 4,
) -> tuple[TrainedModel, DataFrame]:
    """Cross-validated search over Spark parameter values; returns the refit best model."""
    task = infer_task(df, target) if task == "auto" else task
    data = _numeric_input(df.filter(F.col(target).isNotNull()), features)
    classes = [str(c) for c in levels(data.select(F.col(target).cast("string").alias("c")), "c")] if task == "classification" else []
    meta = Metadata(task, algorithm, list(features), target, classes, created=time.time())
    labelled = with_label(data, meta).withColumn("_fold", fold_column(key, folds, seed))
    est = _estimator(labelled, meta, "label", False, {"kernel": "linear"} if algorithm == "svm" else {})
    last = [s for s in est.getStages() if s.hasParam("labelCol") and not (algorithm == "svm" and isinstance(s, LogisticRegression))][-1]
    builder = ParamGridBuilder()
    chosen = dict(grid or GRIDS.get(algorithm, {}))
    for name, values in chosen.items():
        # Several classes wrap the learner that has the parameter.
        owner = last.getClassifier() if isinstance(last, OneVsRest) else last
        builder = builder.addGrid(owner.getParam(name), list(values))
    maps = builder.build()
    judge = (
        MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
        if task == "classification"
        else RegressionEvaluator(labelCol=LABEL, metricName="mse")
    )
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=judge, foldCol="_fold", numFolds=folds, parallelism=parallelism)
    result = cv.fit(labelled)
    sign = 1.0 if task == "classification" else -1.0
    rows = [(json.dumps({p.name: v for p, v in m.items()}, sort_keys=True), float(sign * s)) for m, s in zip(maps, result.avgMetrics)]
    table = df.sparkSession.createDataFrame(rows, "params string, score double").orderBy(F.desc("score"), "params")
    return TrainedModel(result.bestModel, meta), table


def automl(
    df: DataFrame, target: str, features: Sequence[str], key: str, task: str = "auto", algorithms: Sequence[str] | None = None, seed: int = 42
) -> tuple[TrainedModel, DataFrame]:
    """Fit several learners on one split; best by accuracy or minus MSE, and the leaderboard."""
    task = infer_task(df, target) if task == "auto" else task
    names = algorithms or (
        ("logistic", "random_forest", "gradient_boosting", "svm") if task == "classification" else ("linear", "ridge", "random_forest", "gradient_boosting")
    )
    return compare_models(df, target, features, key, names, task, seed)


def compare_models(
    df: DataFrame, target: str, features: Sequence[str], key: str, algorithms: Sequence[str], task: str = "auto", seed: int = 42
) -> tuple[TrainedModel, DataFrame]:
    task = infer_task(df, target) if task == "auto" else task
    complete = df.filter(F.col(target).isNotNull())
    train_rows, test_rows = train_test_split(complete, key, 0.8, seed, target if task == "classification" else None)
    train_rows, test_rows = train_rows.persist(), test_rows.persist()
    try:
        scored = []
        for name in algorithms:
            start = time.time()
            model = fit(train_rows, target, features, name, task)
            scored.append((_score(model, test_rows), name, model, time.time() - start))
    finally:
        train_rows.unpersist()
        test_rows.unpersist()
    scored.sort(key=lambda s: (-s[0], s[1]))
    rows = [(i + 1, s[1], float(s[0]), float(s[3])) for i, s in enumerate(scored)]
    return scored[0][2], df.sparkSession.createDataFrame(rows, "place int, algorithm string, score double, seconds double")


# ---- feature selection and importance -----------------------------------

def univariate_scores(df: DataFrame, target: str, features: Sequence[str], task: str = "auto") -> DataFrame:
    """F statistic and p value of each numeric feature against the target."""
    task = infer_task(df, target) if task == "auto" else task
    rows = []
    if task == "classification":
        for c in features:
            s = f_of_groups(df, c, target)
            rows.append((c, float(s["f"]), float(s["p"])))
    else:
        m = moments(df, [*features, target])
        r = m.corr[:-1, -1]
        f = r**2 / (1 - r**2) * (m.n - 2)
        rows = [(c, float(v), float(dist.f_sf(v, 1, m.n - 2))) for c, v in zip(features, f)]
    return df.sparkSession.createDataFrame(rows, "feature string, f double, p double").orderBy(F.desc("f"), "feature")


def select_features(
    df: DataFrame, target: str, features: Sequence[str], method: str = "univariate", n_features: int = 10, task: str = "auto", trees: int = 50
) -> list[str]:
    """`univariate` F, recursive elimination with a forest (`rfe`), or non-zero `l1` coefficients."""
    task = infer_task(df, target) if task == "auto" else task
    if method == "univariate":
        return [r["feature"] for r in univariate_scores(df, target, features, task).limit(n_features).collect()]
    if method == "rfe":
        kept = list(features)
        while len(kept) > n_features:
            ranked = fit(df, target, kept, "random_forest", task, params={"trees": trees}).importance().collect()
            kept.remove(ranked[-1]["feature"])
        return kept
    if method == "l1":
        algorithm, params = ("logistic", {"l1_ratio": 1.0}) if task == "classification" else ("lasso", {})
        ranked = fit(df, target, features, algorithm, task, scale=True, params=params).importance().collect()
        return [r["feature"] for r in ranked if r["importance"] > 1e-8][:n_features]
    raise ValueError(f"unknown selection method: {method}")


def permutation_importance(model: TrainedModel, df: DataFrame, key: str, features: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Drop in score after a feature's values are dealt out in another hash order."""
    rows = df.filter(F.col(model.meta.target).isNotNull())
    base = _score(model, rows)
    home = with_row_index(rows.withColumn("_h", key_hash(key, seed)), ["_h", key], "_i").drop("_h")
    out = []
    for j, c in enumerate(features or model.meta.features):
        other = with_row_index(rows.select(key, c, key_hash(key, seed + 1 + j).alias("_h")), ["_h", key], "_i").select("_i", F.col(c).alias("_other"))
        mixed = home.join(other, "_i").withColumn(c, F.col("_other")).select(*df.columns)
        out.append((c, float(base - _score(model, mixed))))
    return df.sparkSession.createDataFrame(out, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def vote(models: Sequence[TrainedModel], df: DataFrame) -> DataFrame:
    """Majority class (smallest on ties) or mean of several models, without a join."""
    first = models[0].meta
    out = df
    names = []
    for i, m in enumerate(models):
        out = m.transform(out).withColumnRenamed("prediction", f"_p{i}").drop("probability", "predicted_label")
        names.append(f"_p{i}")
    if first.task == "regression":
        return out.withColumn("prediction", sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)).drop(*names)
    votes = F.array(*[F.col(n) for n in names])
    ballots = F.transform(F.array_distinct(votes), lambda v: F.struct((-F.size(F.filter(votes, lambda x: x == v))).alias("neg"), v.alias("v")))
    return out.withColumn("prediction", F.array_min(ballots)["v"]).drop(*names)


# ---- storage -----------------------------------------------------------------

class ModelStore:
    """Models under one folder of any file system Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, model_id: str) -> str:
        if not model_id or "/" in model_id:
            raise ValueError("model ids are single path names")
        return f"{self.root}/{model_id}"

    def save(self, model: TrainedModel, model_id: str) -> str:
        path = self._path(model_id)
        model.fitted.write().overwrite().save(f"{path}/model")
        text = self.spark.createDataFrame([(json.dumps(asdict(model.meta), default=str),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
        return model_id

    def info(self, model_id: str) -> Metadata:
        return Metadata(**json.loads(self.spark.read.text(f"{self._path(model_id)}/metadata").first()["value"]))

    def load(self, model_id: str) -> TrainedModel:
        return TrainedModel(PipelineModel.load(f"{self._path(model_id)}/model"), self.info(model_id))

    def list(self) -> DataFrame:
        """One row per stored model."""
        raw = self.spark.read.text(f"{self.root}/*/metadata").withColumn("path", F.input_file_name())
        fields = "task string, algorithm string, target string, features array<string>, created double"
        parsed = raw.select(
            F.regexp_extract("path", r"/([^/]+)/metadata/[^/]*$", 1).alias("model_id"), F.from_json("value", fields).alias("m")
        )
        return parsed.select("model_id", "m.*").orderBy("model_id")

    def delete(self, model_id: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(model_id))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
