"""Scores and curves of predictions, from confusion tables and running totals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.operators.hypothesis import one_row
from abacist.plans.quantiles import clean_double
from abacist.plans.ranks import value_ranks

MAX_CLASSES = 10_000


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """`(label, prediction, n)` over complete rows."""
    data = df.select(F.col(label).alias("label"), F.col(prediction).alias("prediction")).dropna()
    return data.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def _cells(df: DataFrame, label: str, prediction: str) -> list:
    rows = confusion(df, label, prediction).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError("too many distinct (label, prediction) pairs for classification metrics")
    return rows


def _class_scores(rows, classes):
    out = {}
    for c in classes:
        tp = sum(r["n"] for r in rows if r["label"] == c and r["prediction"] == c)
        support = sum(r["n"] for r in rows if r["label"] == c)
        predicted = sum(r["n"] for r in rows if r["prediction"] == c)
        p = tp / predicted if predicted else 0.0
        q = tp / support if support else 0.0
        out[c] = (p, q, 2 * p * q / (p + q) if p + q else 0.0, support)
    return out


def classification_metrics(df: DataFrame, label: str, prediction: str, average: str = "weighted", positive=None) -> DataFrame:
    """Accuracy, precision, recall, F1 and Matthews correlation.

    `average`: weighted by support, macro, or binary (the larger class is the
    event unless `positive` says otherwise).  Empty divisions count as zero.
    """
    rows = _cells(df, label, prediction)
    classes = sorted({r["label"] for r in rows} | {r["prediction"] for r in rows})
    n = sum(r["n"] for r in rows)
    if not n:
        return one_row(df, {"n": 0, "accuracy": math.nan, "precision": math.nan, "recall": math.nan, "f1": math.nan, "mcc": math.nan})
    right = sum(r["n"] for r in rows if r["label"] == r["prediction"])
    scores = _class_scores(rows, classes)
    if average == "binary":
        p, q, f, _ = scores[classes[-1] if positive is None else positive]
    elif average == "weighted":
        p, q, f = (sum(s[i] * s[3] for s in scores.values()) / n for i in range(3))
    elif average == "macro":
        p, q, f = (sum(s[i] for s in scores.values()) / len(scores) for i in range(3))
    else:
        raise ValueError(f"unknown average: {average}")
    t = {c: scores[c][3] for c in classes}
    k = {c: sum(r["n"] for r in rows if r["prediction"] == c) for c in classes}
    cov = right * n - sum(t[c] * k[c] for c in classes)
    spread = (n * n - sum(v * v for v in k.values())) * (n * n - sum(v * v for v in t.values()))
    return one_row(
        df,
        {"n": int(n), "accuracy": right / n, "precision": p, "recall": q, "f1": f, "mcc": cov / math.sqrt(spread) if spread else 0.0},
    )


def class_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    rows = _cells(df, label, prediction)
    classes = sorted({r["label"] for r in rows} | {r["prediction"] for r in rows})
    return df.sparkSession.createDataFrame(
        [(str(c), float(s[0]), float(s[1]), float(s[2]), int(s[3])) for c, s in _class_scores(rows, classes).items()],
        "label string, precision double, recall double, f1 double, support long",
    )


def _score_table(df: DataFrame, label: str, score: str, sign: int = 1) -> DataFrame:
    """Distinct scores with positives, rows and the running rows in score order."""
    data = df.select(F.col(label).cast("double").alias("y"), (clean_double(score) * sign).alias("x")).dropna()
    return data.groupBy("x").agg(F.count_if(F.col("y") > 0.5).alias("pos"), F.count(F.lit(1)).alias("w"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks; tied scores count half."""
    r = value_ranks(_score_table(df, label, score), "x", "w").agg(
        F.sum("pos").alias("p"), F.sum("w").alias("n"), F.sum(F.col("pos") * F.col("avg_rank")).alias("r")
    ).first()
    p, q = r["p"] or 0, (r["n"] or 0) - (r["p"] or 0)
    return one_row(df, {"positives": int(p), "negatives": int(q), "auc": (r["r"] - p * (p + 1) / 2) / (p * q) if p and q else math.nan})


def _cumulative(df: DataFrame, label: str, score: str) -> tuple[DataFrame, int, int]:
    """Running true and false positives from the highest score down."""
    table = _score_table(df, label, score, sign=-1)
    seen = value_ranks(table, "x", "w").withColumnRenamed("upto", "_seen").drop("avg_rank")
    run = value_ranks(seen, "x", "pos").withColumnRenamed("upto", "tp").drop("avg_rank")
    t = table.agg(F.sum("pos").alias("p"), F.sum("w").alias("n")).first()
    return run.withColumn("fp", F.col("_seen") - F.col("tp")), t["p"] or 0, (t["n"] or 0) - (t["p"] or 0)


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    run, p, q = _cumulative(df, label, score)
    return run.select((-F.col("x")).alias("threshold"), (F.col("fp") / F.lit(q or None)).alias("fpr"), (F.col("tp") / F.lit(p or None)).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    run, p, _ = _cumulative(df, label, score)
    return run.select(
        (-F.col("x")).alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.lit(p or None)).alias("recall")
    )


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the precision-recall curve as a step sum."""
    run, p, _ = _cumulative(df, label, score)
    return run.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.lit(p or None)).alias("average_precision"))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and share of events in equal score bins on [0, 1]."""
    part = F.least(F.floor(clean_double(score) * bins), F.lit(bins - 1)).cast("int")
    data = df.filter(F.col(label).isNotNull() & F.col(score).isNotNull())
    return data.groupBy(part.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(clean_double(score)).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("event_rate")
    )


def log_loss(df: DataFrame, label: str, score: str, eps: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(clean_double(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    return df.agg((-F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """MSE, RMSE, MAE, R2, MAPE, explained variance and the residual summary, in one aggregate."""
    y, p = clean_double(label), clean_double(prediction)
    data = df.select(y.alias("y"), p.alias("p")).dropna().withColumn("e", F.col("y") - F.col("p"))
    e2 = F.sum(F.col("e") * F.col("e"))
    n = F.count(F.lit(1))
    total = F.var_pop("y") * n
    return data.agg(
        n.alias("n"),
        (e2 / n).alias("mse"),
        F.sqrt(e2 / n).alias("rmse"),
        F.avg(F.abs("e")).alias("mae"),
        (F.lit(1.0) - F.try_divide(e2, total)).alias("r2"),
        F.avg(F.abs(F.try_divide(F.col("e"), F.col("y")))).alias("mape"),
        (F.lit(1.0) - F.try_divide(F.var_pop("e"), F.var_pop("y"))).alias("explained_variance"),
        F.avg("e").alias("residual_mean"),
        F.stddev_pop("e").alias("residual_std"),
        F.min("e").alias("residual_min"),
        F.max("e").alias("residual_max"),
    )


def _uniform(h: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """Uniform draws from row hashes: the splitmix64 finaliser per replicate."""
    z = h.astype(np.uint64) + np.uint64((replicate + 1) * 0x9E3779B97F4A7C15 + seed & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * (1.0 / (1 << 53))


def bootstrap_mean(df: DataFrame, column: str, key: Sequence[str], replicates: int = 100, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of a mean.

    Each row counts Poisson(1) times in each replicate, drawn from the hash of
    its key, so all replicates come from one pass and do not depend on the
    partitioning.
    """
    data = df.select(clean_double(column).alias("v"), F.xxhash64(*key).alias("h")).filter(F.col("v").isNotNull())
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(15)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(replicates), np.zeros(replicates)
        with np.errstate(over="ignore"):
            for pdf in batches:
                v, h = pdf["v"].to_numpy(), pdf["h"].to_numpy()
                for i in range(replicates):
                    w = np.searchsorted(steps, _uniform(h, i, seed), side="right")
                    weight[i] += w.sum()
                    total[i] += w @ v
        yield pd.DataFrame({"i": np.arange(replicates), "s": total, "w": weight})

    drawn = data.mapInPandas(sums, "i int, s double, w double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    means = [r["s"] / r["w"] for r in drawn.collect() if r["w"]]  # one row per replicate
    lo, hi = np.quantile(means, [(1 - level) / 2, (1 + level) / 2]) if means else (math.nan, math.nan)
    return one_row(df, {"mean": data.agg(F.avg("v")).first()[0], "low": lo, "high": hi, "replicates": len(means)})
