"""Multinomial logistic regression with standard errors: Newton steps from one pass of weighted products each."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.operators.frequency import levels
from abacist.operators.hypothesis import _null, one_row
from abacist.plans.moments import complete, moments
from abacist.plans.quantiles import complete_rows
from abacist.plans.session import stored

CONST = "const"


@dataclass
class MultinomialModel:
    """Log odds of every class against the first one.

    beta: classes but the first x (features, constant); cov is the inverse
    information in that order; `steps` Newton steps led to a largest score of
    `score` standard errors.
    """

    features: list[str]
    target: str
    classes: list
    beta: np.ndarray
    cov: np.ndarray
    n: int
    llf: float
    null_llf: float
    steps: int
    score: float
    converged: bool
    source: DataFrame = field(repr=False)

    def summary(self, level: float = 0.95) -> DataFrame:
        """One row per class and term: coefficient, standard error, z, p, interval, odds ratio."""
        z = dist.norm_ppf(0.5 + level / 2)
        se = np.sqrt(np.maximum(np.diag(self.cov), 0)).reshape(self.beta.shape)
        rows = []
        for k, name in enumerate(self.classes[1:]):
            for t, b, s in zip([*self.features, CONST], self.beta[k].tolist(), se[k].tolist()):
                stat = b / s if s > 0 else math.nan
                p = math.erfc(abs(stat) / math.sqrt(2))
                rows.append((str(name), t, *[_null(v) for v in (b, s, stat, p, b - z * s, b + z * s, math.exp(b) if b < 700 else math.nan)]))
        return self.source.sparkSession.createDataFrame(
            rows, "class string, term string, coef double, se double, z double, p double, ci_low double, ci_high double, ratio double"
        )

    def fit_stats(self) -> DataFrame:
        k = self.beta.size
        return one_row(
            self.source,
            {
                "n": self.n, "llf": self.llf, "null_llf": self.null_llf, "aic": 2 * k - 2 * self.llf, "bic": k * math.log(self.n) - 2 * self.llf if self.n else math.nan,
                "pseudo_r2": 1 - self.llf / self.null_llf if self.null_llf else math.nan, "steps": self.steps, "converged": self.converged,
            },
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `probability` (one for each class, in order) and `predicted_label`."""
        terms = [F.lit(0.0)]
        for b in self.beta.tolist():
            terms.append(sum((F.lit(v) * F.col(f"`{c}`").cast("double") for c, v in zip(self.features, b)), F.lit(b[-1])))
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        raised = F.array(*[F.exp(t - top) for t in terms])
        total = F.aggregate(raised, F.lit(0.0), lambda s, v: s + v)
        out = df.withColumn("probability", F.transform(raised, lambda v: v / total))
        names = F.array(*[F.lit(str(c)) for c in self.classes])
        best = F.array_position("probability", F.array_max("probability")).cast("int")
        return out.withColumn("predicted_label", F.element_at(names, best))


def _pass(data: DataFrame, beta: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score and information at beta, summed where the rows are."""
    k, width = beta.shape

    def run(batches):
        size = k * width
        total = np.zeros(1 + size + size * size)
        for batch in batches:
            x = np.column_stack([*[(batch.column(i).to_numpy() - mean[i]) / scale[i] for i in range(width - 1)], np.ones(batch.num_rows)])
            y = batch.column(width - 1).to_numpy()
            eta = np.column_stack([np.zeros(len(x)), x @ beta.T])
            top = eta.max(axis=1, keepdims=True)
            log_p = eta - top - np.log(np.exp(eta - top).sum(axis=1, keepdims=True))
            p = np.exp(log_p)[:, 1:]
            total[0] += log_p[np.arange(len(x)), y].sum()
            total[1 : 1 + size] += ((y[:, None] == np.arange(1, k + 1)) - p).T.dot(x).ravel()
            info = np.zeros((k, width, k, width))
            for i in range(k):
                for j in range(i, k):
                    w = p[:, i] * ((i == j) - p[:, j])
                    info[i, :, j] = (x * w[:, None]).T @ x
                    info[j, :, i] = info[i, :, j].T
            total[1 + size :] += info.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    rows = data.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(1 + k * width + (k * width) ** 2)
    for r in rows:
        flat[r["i"]] = r["v"]
    return float(flat[0]), flat[1 : 1 + k * width], flat[1 + k * width :].reshape(k * width, k * width)


def multinomial_logit(df: DataFrame, target: str, features: Sequence[str], max_iter: int = 50, tol: float = 1e-9, max_levels: int = 1000) -> MultinomialModel:
    """Unpenalised fit; the first class in sorted order is the reference.

    Rows with a missing value are dropped.  Each step is one pass that sums the
    score and the information (classes x terms, squared) within the tasks;
    steps that lower the likelihood are halved.  With separated classes the
    estimates have no end: `converged` is then false.
    """
    features = list(features)
    known = df.filter(F.col(target).isNotNull())
    classes = levels(complete_rows(known, features), target, max_levels)
    if len(classes) < 2:
        raise ValueError(f"{target} needs at least two levels")
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target)).cast("int") - 1
    data = complete(known.withColumn("_class", code), [*features, "_class"])
    data = stored(data.select(*features, F.col("_class").cast("int").alias("_class")))
    m = moments(data, features)
    mean, scale = np.asarray(m.mean, float), np.sqrt(np.maximum(np.diag(m.cov), 0))
    scale = np.where(scale > 0, scale, 1.0)
    counts = {r["_class"]: r["n"] for r in data.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    width, k = len(features) + 1, len(classes) - 1
    beta = np.zeros((k, width))
    beta[:, -1] = [math.log(counts[i + 1] / counts[0]) for i in range(k)]
    llf, score, info = _pass(data, beta, mean, scale)
    null_llf, steps, size, converged = llf, 0, math.inf, False
    while steps < max_iter:
        move = np.linalg.pinv(info, hermitian=True) @ score
        size = math.sqrt(max(float(score @ move), 0.0))
        if size < tol * math.sqrt(max(n, 1)):
            converged = True
            break
        steps, share = steps + 1, 1.0
        while True:
            trial = beta + share * move.reshape(beta.shape)
            found = _pass(data, trial, mean, scale)
            if found[0] >= llf - 1e-12 * abs(llf) or share < 1e-4:
                break
            share /= 2
        beta, (llf, score, info) = trial, found
    # Back to the features' own units: slopes by their scale, constants by their means.
    turn = np.zeros((width, width))
    turn[np.arange(width - 1), np.arange(width - 1)] = 1 / scale
    turn[-1, :-1], turn[-1, -1] = -mean / scale, 1.0
    both = np.kron(np.eye(k), turn)
    cov = both @ np.linalg.pinv(info, hermitian=True) @ both.T
    return MultinomialModel(features, target, classes, beta @ turn.T, cov, n, llf, null_llf, steps, size, converged, df)
