"""Linear, logistic, quantile and robust regression with diagnostics.

Linear fits come from one pass of centred products (`plans.moments`); every
candidate model of a stepwise search is solved from sub-matrices of that pass.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.operators.frequency import levels
from abacist.operators.hypothesis import _null, one_row
from abacist.operators.timeseries import autocovariances
from abacist.plans.moments import Moments, complete, grouped_moments, moments, weighted_sums
from abacist.plans.quantiles import clean_double, complete_rows, exact_quantiles

CONST = "const"


@dataclass
class LinearModel:
    """A least-squares fit, solved on the driver from sums of products."""

    target: str
    features: list[str]
    intercept: bool
    n: float
    beta: np.ndarray
    cov: np.ndarray
    rss: float
    tss: float
    rank: int
    means: np.ndarray
    inverse: np.ndarray
    condition: float
    source: DataFrame | None = field(default=None, repr=False)

    @classmethod
    def from_moments(cls, m: Moments, features: Sequence[str], target: str, intercept: bool = True) -> LinearModel:
        sub = m.at([*features, target])
        table = sub.cross if intercept else sub.raw
        p = len(features)
        sxx, sxy, syy = table[:p, :p], table[:p, p], table[p, p]
        inv = np.linalg.pinv(sxx, hermitian=True) if p else np.zeros((0, 0))
        b = inv @ sxy
        rank = int(np.linalg.matrix_rank(sxx, hermitian=True)) if p else 0
        rss = max(float(syy - b @ sxy), 0.0)
        k = rank + int(intercept)
        scale = rss / (sub.n - k) if sub.n > k else math.nan
        means = sub.mean[:p]
        if intercept:
            b0 = sub.mean[p] - means @ b
            cross = -inv @ means
            corner = 1.0 / sub.n + means @ inv @ means
            full = np.block([[np.array([[corner]]), cross[None, :]], [cross[:, None], inv]])
            beta = np.concatenate([[b0], b])
            raw = np.block([[np.array([[sub.n]]), (sub.n * means)[None, :]], [(sub.n * means)[:, None], sub.raw[:p, :p]]])
        else:
            full, beta, raw = inv, b, sxx
        eig = np.linalg.eigvalsh(raw) if raw.size else np.array([1.0])
        cond = math.sqrt(eig[-1] / eig[0]) if eig[0] > 0 else math.inf
        return cls(target, list(features), intercept, sub.n, beta, scale * full, rss, float(syy), rank, means, inv, cond)

    @property
    def terms(self) -> list[str]:
        return ([CONST] if self.intercept else []) + self.features

    @property
    def params(self) -> int:
        return self.rank + int(self.intercept)

    @property
    def dof(self) -> float:
        return self.n - self.params

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss if self.tss > 0 else math.nan

    @property
    def llf(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi * self.rss / self.n) + 1) if self.rss > 0 else math.inf

    @property
    def aic(self) -> float:
        return -2 * self.llf + 2 * self.params

    @property
    def bic(self) -> float:
        return -2 * self.llf + math.log(self.n) * self.params

    def p_values(self) -> np.ndarray:
        se = np.sqrt(np.diag(self.cov))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.atleast_1d(dist.t_two_sided(self.beta / se, self.dof))

    def summary(self, level: float = 0.95) -> DataFrame:
        """term, coef, se, t, p, ci_low, ci_high."""
        se = np.sqrt(np.diag(self.cov))
        q = dist.t_ppf(0.5 + level / 2, self.dof)
        ps = self.p_values()
        rows = []
        for i, t in enumerate(self.terms):
            b, s = float(self.beta[i]), float(se[i])
            rows.append((t, b, _null(s), _null(b / s if s > 0 else math.nan), _null(float(ps[i])), _null(b - q * s), _null(b + q * s)))
        return self.source.sparkSession.createDataFrame(
            rows, "term string, coef double, se double, t double, p double, ci_low double, ci_high double"
        )

    def fit_stats(self) -> DataFrame:
        """R squared, F, likelihood and information criteria."""
        k = self.rank
        f = ((self.tss - self.rss) / k) / (self.rss / self.dof) if k and self.rss > 0 else math.nan
        lift = self.n - 1 if self.intercept else self.n
        return one_row(
            self.source,
            {
                "n": int(self.n), "df_model": k, "df_resid": int(self.dof), "r2": self.r2, "adj_r2": 1 - (1 - self.r2) * lift / self.dof,
                "f": f, "f_p": dist.f_sf(f, k, self.dof), "aic": self.aic, "bic": self.bic, "llf": self.llf, "rss": self.rss,
                "mse": self.rss / self.dof, "condition": self.condition,
            },
        )

    def predicted(self) -> Column:
        """The fitted value as a Column of the feature columns."""
        total = F.lit(float(self.beta[0])) if self.intercept else F.lit(0.0)
        for b, c in zip(self.beta[int(self.intercept) :], self.features):
            total = total + F.lit(float(b)) * F.col(f"`{c}`")
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.predicted())

    def residuals(self, extra: Sequence[str] = ()) -> DataFrame:
        """Complete rows with `prediction` and `residual`."""
        keep = [c for c in extra if c not in (*self.features, self.target)]
        data = self.source.select(*keep, *[clean_double(f"`{c}`").alias(c) for c in [*self.features, self.target]])
        data = complete_rows(data, [*self.features, self.target])
        return self.transform(data).withColumn("residual", F.col(self.target) - F.col("prediction"))

    def residual_summary(self) -> DataFrame:
        e = self.residuals().select("residual")
        q = exact_quantiles(e, ["residual"], (0.25, 0.5, 0.75))["residual"]
        s = e.agg(
            F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("std"), F.min("residual").alias("min"), F.max("residual").alias("max")
        )
        return s.select("mean", "std", "min", F.lit(q[0]).alias("q1"), F.lit(q[1]).alias("median"), F.lit(q[2]).alias("q3"), "max")

    def leverage(self) -> Column:
        """Diagonal of the hat matrix, as a quadratic form in the features."""
        x = [F.col(f"`{c}`") - F.lit(float(m) if self.intercept else 0.0) for c, m in zip(self.features, self.means)]
        h = F.lit(1.0 / self.n if self.intercept else 0.0)
        for i in range(len(x)):
            for j in range(len(x)):
                h = h + F.lit(float(self.inverse[i, j])) * x[i] * x[j]
        return h

    def influence(self, extra: Sequence[str] = ()) -> DataFrame:
        """Leverage, internally and externally studentized residuals, Cook's distance."""
        mse, k = self.rss / self.dof, self.params
        e = self.residuals(extra).withColumn("leverage", self.leverage())
        r = F.col("residual") / F.sqrt(F.lit(mse) * (1 - F.col("leverage")))
        out = e.withColumn("student_internal", r)
        out = out.withColumn(
            "student_external", F.col("student_internal") * F.sqrt(F.lit(self.dof - 1.0) / (F.lit(float(self.dof)) - F.pow("student_internal", 2)))
        )
        return out.withColumn("cooks_d", F.pow("student_internal", 2) * F.col("leverage") / (1 - F.col("leverage")) / F.lit(float(k)))

    def durbin_watson(self, order_by: Sequence[str]) -> DataFrame:
        e = self.residuals(order_by).select(*order_by, "residual")
        c = autocovariances(e, "residual", order_by, 1, centre=0.0)
        ends = c.first_square + c.last_square
        dw = (2 * c.sums[0] - ends - 2 * c.sums[1]) / c.sums[0] if c.sums[0] > 0 else math.nan
        return one_row(self.source, {"durbin_watson": dw})

    def ljung_box(self, order_by: Sequence[str], lags: int = 10) -> DataFrame:
        e = self.residuals(order_by).select(*order_by, "residual")
        return ljung_box(e, "residual", order_by, lags)

    def breusch_pagan(self) -> DataFrame:
        e = self.residuals()
        m = moments(e.withColumn("_e2", F.pow("residual", 2)), [*self.features, "_e2"])
        aux = LinearModel.from_moments(m, self.features, "_e2")
        k = len(self.features)
        lm = m.n * aux.r2
        f = (aux.r2 / k) / ((1 - aux.r2) / (m.n - k - 1))
        return one_row(self.source, {"lm": lm, "lm_p": dist.chi2_sf(lm, k), "f": f, "f_p": dist.f_sf(f, k, m.n - k - 1)})

    def jarque_bera(self) -> DataFrame:
        from abacist.operators.nonparametric import jarque_bera

        return jarque_bera(self.residuals(), "residual")

    def standardized(self) -> DataFrame:
        """Coefficients in standard deviation units."""
        m = moments(self.source, [*self.features, self.target])
        sd = np.sqrt(np.diag(m.cov))
        b = self.beta[int(self.intercept) :]
        rows = [(c, float(v * s / sd[-1])) for c, v, s in zip(self.features, b, sd)]
        return self.source.sparkSession.createDataFrame(rows, "term string, beta double")


def ols(df: DataFrame, target: str, features: Sequence[str], intercept: bool = True) -> LinearModel:
    """Ordinary least squares over complete rows, in one pass."""
    m = moments(df, [*features, target])
    model = LinearModel.from_moments(m, features, target, intercept)
    model.source = df
    return model


def polynomial_ols(df: DataFrame, target: str, feature: str, degree: int = 2) -> LinearModel:
    """Powers of one feature; term names are `{feature}^{i}` from the second on."""
    names = [feature, *[f"{feature}_p{i}" for i in range(2, degree + 1)]]
    wide = df.withColumns({n: F.pow(clean_double(feature), i) for i, n in enumerate(names[1:], 2)})
    return ols(wide, target, names)


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation on the uncentred products, without a constant."""
    raw = moments(df, features).raw
    inv = np.linalg.pinv(raw, hermitian=True)
    rows = [(c, float(raw[i, i] * inv[i, i])) for i, c in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "term string, vif double")


def ljung_box(df: DataFrame, column: str, order_by: Sequence[str], lags: int = 10) -> DataFrame:
    c = autocovariances(df, column, order_by, lags)
    n, q, rows = c.n, 0.0, []
    for k in range(1, lags + 1):
        q += (c.sums[k] / c.sums[0]) ** 2 / (n - k)
        stat = n * (n + 2) * q
        rows.append((k, float(stat), float(dist.chi2_sf(stat, k))))
    return df.sparkSession.createDataFrame(rows, "lag int, statistic double, p double")


def stepwise(df: DataFrame, target: str, features: Sequence[str], method: str = "forward", threshold: float = 0.05) -> LinearModel:
    """Selection by p value; the data is read once, for the products."""
    m = moments(df, [*features, target])

    def fit(names):
        return LinearModel.from_moments(m, names, target)

    def p_of(names, name):
        model = fit(names)
        return float(model.p_values()[model.terms.index(name)])

    if method not in ("forward", "backward", "both"):
        raise ValueError(f"unknown stepwise method: {method}")
    chosen = [] if method != "backward" else list(features)
    while True:
        changed = False
        if method in ("forward", "both"):
            rest = [f for f in features if f not in chosen]
            trial = [(p_of([*chosen, f], f), f) for f in rest]
            if trial and min(trial)[0] < threshold:
                chosen.append(min(trial)[1])
                changed = True
        if method in ("backward", "both") and chosen:
            model = fit(chosen)
            worst = max(zip(model.p_values()[1:], chosen))
            if worst[0] >= threshold:
                chosen.remove(worst[1])
                changed = True
        if not changed:
            break
    model = fit(chosen)
    model.source = df
    return model


@dataclass
class IterativeFit:
    """Coefficients of a reweighted fit."""

    terms: list[str]
    beta: np.ndarray
    stats: dict
    source: DataFrame = field(repr=False)

    def summary(self) -> DataFrame:
        return self.source.sparkSession.createDataFrame(
            [(t, float(b)) for t, b in zip(self.terms, self.beta)], "term string, coef double"
        )

    def fit_stats(self) -> DataFrame:
        return one_row(self.source, self.stats)


def _design(df: DataFrame, target: str, features: Sequence[str]) -> tuple[DataFrame, list[Column], Column]:
    data = complete(df, [*features, target]).persist()
    return data, [F.lit(1.0), *[F.col(f"`{c}`") for c in features]], F.col(f"`{target}`")


def _linear(beta: np.ndarray, x: Sequence[Column]) -> Column:
    return sum((F.lit(float(b)) * c for b, c in zip(beta[1:], x[1:])), F.lit(float(beta[0])))


def quantile_regression(
    df: DataFrame, target: str, features: Sequence[str], quantile: float = 0.5, max_iter: int = 200, tol: float = 1e-5
) -> IterativeFit:
    """Check-loss minimum by Newton steps on a smoothed loss whose width shrinks.

    Residuals within the width count in proportion; one aggregate per step
    gives gradient, curvature and loss.  A step that does not lower the loss is
    halved.  The width shrinks sixfold when the gradient is settled, down to
    `tol` of the residual spread; `converged` tells whether it got there.
    """
    data, x, y = _design(df, target, features)
    p = len(x)

    def state(beta, h):
        e = y - _linear(beta, x)
        share = F.least(F.greatest((F.lit(h) - e) / F.lit(2 * h), F.lit(0.0)), F.lit(1.0))
        psi = F.lit(quantile) - share
        inside = F.when(F.abs(e) <= h, F.lit(1.0)).otherwise(F.lit(0.0))
        smooth = F.when(F.abs(e) > h, F.when(e < 0, (quantile - 1) * e).otherwise(quantile * e)).otherwise(quantile * e + (F.lit(h) - e) * (F.lit(h) - e) / (4 * h))
        cells = [F.sum(inside * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(p) for j in range(i + 1)]
        r = data.agg(F.sum(smooth).alias("loss"), *[F.sum(psi * x[i]).alias(f"g{i}") for i in range(p)], *[F.sum(F.abs(x[i])).alias(f"s{i}") for i in range(p)], *cells).first()
        curve = np.array([[r[f"h{max(i, j)}_{min(i, j)}"] for j in range(p)] for i in range(p)]) / (2 * h)
        return r["loss"], np.array([r[f"g{i}"] for i in range(p)]), curve, np.array([r[f"s{i}"] for i in range(p)])

    try:
        beta = ols(data, target, features).beta
        spread = data.agg(F.stddev_pop(y - _linear(beta, x))).first()[0] or 0.0
        h, steps, converged = spread, 0, spread == 0
        while not converged and steps < max_iter:
            loss, slope, curve, scale = state(beta, h)
            steps += 1
            while steps < max_iter and np.max(np.abs(slope) / np.maximum(scale, 1e-300)) > 1e-6:
                # A little of the whole curvature keeps the step finite when few residuals are inside.
                ridge = 1e-10 * np.diag(np.maximum(np.diag(curve), 1e-12 * scale / h))
                move = np.linalg.lstsq(curve + ridge, slope, rcond=None)[0]
                better = False
                for _ in range(8):
                    tried = state(beta + move, h)
                    steps += 1
                    if tried[0] < loss:
                        better = True
                        break
                    move = move / 2
                if not better:
                    break
                gain, beta = loss - tried[0], beta + move
                loss, slope, curve, scale = tried
                if gain <= 1e-11 * abs(loss):
                    break
            converged = h <= tol * spread
            h /= 6
        e = y - _linear(beta, x)
        base = exact_quantiles(data, [target], (quantile,))[target][0]
        check = lambda r: F.sum(F.when(r < 0, (quantile - 1) * r).otherwise(quantile * r))
        s = data.agg(check(e).alias("fit"), check(y - F.lit(base)).alias("null"), F.count(F.lit(1)).alias("n")).first()
        stats = {"quantile": quantile, "n": s["n"], "pseudo_r2": 1 - s["fit"] / s["null"] if s["null"] else math.nan, "loss": s["fit"], "steps": steps, "converged": bool(converged)}
        return IterativeFit([CONST, *features], beta, stats, df)
    finally:
        data.unpersist()


def huber_regression(df: DataFrame, target: str, features: Sequence[str], k: float = 1.345, max_iter: int = 50, tol: float = 1e-6) -> IterativeFit:
    """Huber M-estimate: reweighted fits with the scale from the residual MAD."""
    data, x, y = _design(df, target, features)
    try:
        beta, scale = ols(data, target, features).beta, math.nan
        for _ in range(max_iter):
            e = y - _linear(beta, x)
            mad = exact_quantiles(data.select(F.abs(e).alias("a")), ["a"], (0.5,))["a"][0]
            scale = mad / dist.norm_ppf(0.75)
            if scale == 0:
                break
            weight = F.least(F.lit(1.0), F.lit(k * scale) / F.greatest(F.abs(e), F.lit(1e-300)))
            a, b = weighted_sums(data, x, y, weight)
            new = np.linalg.lstsq(a, b, rcond=None)[0]
            gap = float(np.max(np.abs(new - beta) / np.maximum(np.abs(beta), 1e-12)))
            beta = new
            if gap < tol:
                break
        return IterativeFit([CONST, *features], beta, {"scale": scale, "n": data.count()}, df)
    finally:
        data.unpersist()


@dataclass
class GeneralizedModel:
    """A Spark GLM with a readable summary."""

    model: object
    features: list[str]
    target: str
    family: str
    source: DataFrame = field(repr=False)
    classes: tuple = ()

    def summary(self, level: float = 0.95) -> DataFrame:
        s = self.model.summary
        coefs = [*self.model.coefficients, self.model.intercept]
        z = dist.norm_ppf(0.5 + level / 2)
        rows = []
        for t, b, se, stat, p in zip([*self.features, CONST], coefs, s.coefficientStandardErrors, s.tValues, s.pValues):
            ratio = math.exp(b) if self.family in ("binomial", "poisson") and b < 700 else math.nan
            rows.append(tuple(_null(v) if not isinstance(v, str) else v for v in (t, b, se, stat, p, b - z * se, b + z * se, ratio)))
        return self.source.sparkSession.createDataFrame(
            rows, "term string, coef double, se double, z double, p double, ci_low double, ci_high double, ratio double"
        )

    def fit_stats(self) -> DataFrame:
        s = self.model.summary
        k = len(self.features) + 1
        n = s.numInstances
        llf = -s.deviance / 2 if self.family == "binomial" else (2 * k - s.aic) / 2
        return one_row(
            self.source,
            {
                "n": n, "deviance": s.deviance, "null_deviance": s.nullDeviance, "llf": llf, "aic": s.aic, "bic": k * math.log(n) - 2 * llf,
                "pseudo_r2": 1 - s.deviance / s.nullDeviance if s.nullDeviance else math.nan,
            },
        )

    def transform(self, df: DataFrame) -> DataFrame:
        data = complete_rows(df.withColumns({c: clean_double(c) for c in self.features}), self.features)
        vec = VectorAssembler(inputCols=self.features, outputCol="_features").transform(data)
        return self.model.transform(vec).drop("_features")


def glm(df: DataFrame, target: str, features: Sequence[str], family: str = "poisson", weight: str | None = None) -> GeneralizedModel:
    data = complete(df, [*features, target, *([weight] if weight else [])])
    vec = VectorAssembler(inputCols=list(features), outputCol="_features").transform(data)
    est = GeneralizedLinearRegression(featuresCol="_features", labelCol=target, family=family, maxIter=100, tol=1e-10)
    if weight:
        est = est.setWeightCol(weight)
    return GeneralizedModel(est.fit(vec), list(features), target, family, df)


def logit(df: DataFrame, target: str, features: Sequence[str]) -> GeneralizedModel:
    """Binary logit; the second level in sorted order is the event."""
    names = levels(df, target, 2)
    if len(names) != 2:
        raise ValueError(f"{target} must have exactly two levels")
    coded = df.filter(F.col(target).isNotNull()).withColumn(target, (F.col(target) == F.lit(names[1])).cast("double"))
    model = glm(coded, target, features, "binomial")
    model.classes, model.source = tuple(names), coded
    return model


def logit_metrics(model: GeneralizedModel) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC on the training rows."""
    from abacist.operators.evaluate import auc, classification_metrics

    scored = model.transform(model.source).select(
        F.col(model.target).alias("label"), F.col("prediction").alias("score"), (F.col("prediction") >= 0.5).cast("double").alias("prediction")
    )
    area = auc(scored, "label", "score").first()["auc"]
    m = classification_metrics(scored, "label", "prediction", average="binary")
    return m.withColumn("auc", F.lit(area))


# ---- group models -------------------------------------------------------

def ancova(df: DataFrame, target: str, group: str, covariates: Sequence[str], max_levels: int = 100) -> DataFrame:
    """Group effect adjusted for covariates, type II, from one pass of products."""
    names = levels(df, group, max_levels)
    dummies = [f"_g{i}" for i in range(1, len(names))]
    data = df.filter(F.col(group).isNotNull()).withColumns(
        {d: (F.col(group) == F.lit(v)).cast("double") for d, v in zip(dummies, names[1:])}
    )
    m = moments(data, [*dummies, *covariates, target])
    full = LinearModel.from_moments(m, [*dummies, *covariates], target)
    rows = []
    for term, drop in [(group, dummies), *[(c, [c]) for c in covariates]]:
        less = LinearModel.from_moments(m, [f for f in full.features if f not in drop], target)
        ss, dof = less.rss - full.rss, less.dof - full.dof
        f = (ss / dof) / (full.rss / full.dof) if dof else math.nan
        rows.append((term, float(ss), float(dof), _null(f), _null(dist.f_sf(f, dof, full.dof))))
    rows.append(("Residual", full.rss, float(full.dof), None, None))
    return df.sparkSession.createDataFrame(rows, "term string, ss double, df double, f double, p double")


def manova(df: DataFrame, targets: Sequence[str], group: str) -> DataFrame:
    """Wilks, Pillai, Hotelling-Lawley and Roy statistics with F approximations."""
    by = grouped_moments(df.filter(F.col(group).isNotNull()), group, targets)
    n = sum(m.n for m in by.values())
    grand = sum(m.n * m.mean for m in by.values()) / n
    within = sum(m.cross for m in by.values())
    between = sum(m.n * np.outer(m.mean - grand, m.mean - grand) for m in by.values())
    lam = np.clip(np.real(np.linalg.eigvals(np.linalg.solve(within, between))), 0, None)
    p, q, v = len(targets), len(by) - 1, n - len(by)
    s = min(p, q)
    mm, nn = (abs(p - q) - 1) / 2, (v - p - 1) / 2
    wilks, pillai = float(np.prod(1 / (1 + lam))), float(np.sum(lam / (1 + lam)))
    hotelling, roy = float(np.sum(lam)), float(np.max(lam))
    r, u = v - (p - q + 1) / 2, (p * q - 2) / 4
    t = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5)) if p * p + q * q - 5 > 0 else 1.0
    d2 = r * t - 2 * u
    root = wilks ** (1 / t)
    rows = [("wilks", wilks, (1 - root) / root * d2 / (p * q), p * q, d2)]
    rows.append(("pillai", pillai, (2 * nn + s + 1) / (2 * mm + s + 1) * pillai / (s - pillai), s * (2 * mm + s + 1), s * (2 * nn + s + 1)))
    rows.append(("hotelling", hotelling, 2 * (s * nn + 1) * hotelling / (s * s * (2 * mm + s + 1)), s * (2 * mm + s + 1), 2 * (s * nn + 1)))
    d = max(p, q)
    rows.append(("roy", roy, roy * (v - d + q) / d, d, v - d + q))
    out = [(a, b, float(f), float(x), float(y), float(dist.f_sf(f, x, y))) for a, b, f, x, y in rows]
    return df.sparkSession.createDataFrame(out, "statistic string, value double, f double, df1 double, df2 double, p double")
