"""Autocorrelation, stationarity tests, decomposition, resampling."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.functions import dist
from abacist.operators.describe import _AGGREGATES
from abacist.plans.moments import moments
from abacist.plans.ordering import windowed, with_row_index, with_running_totals
from abacist.plans.quantiles import clean_double

LAGS_PER_JOB = 50


def series(df: DataFrame, value: str, order_by: Sequence[str]) -> DataFrame:
    """`(t, v)`: position in time and value, missing values dropped."""
    data = df.select(*order_by, clean_double(value).alias("v")).filter(F.col("v").isNotNull())
    return with_row_index(data, list(order_by), "t").select("t", "v")


@dataclass(frozen=True)
class Autocovariances:
    """Sums of lagged products of the centred series."""

    n: int
    mean: float
    sums: list[float]
    first_square: float
    last_square: float


def _lag_sums(indexed: DataFrame, nlags: int, centre: float | None = None) -> Autocovariances:
    s = indexed.agg(F.count("v").alias("n"), F.avg("v").alias("m")).first()
    mean = s["m"] if centre is None else centre
    d = indexed.withColumn("d", F.col("v") - F.lit(mean))
    sums: dict[int, float] = {}
    lags = list(range(0, nlags + 1))
    for start in range(0, len(lags), LAGS_PER_JOB):
        part = lags[start : start + LAGS_PER_JOB]
        wide = windowed(d, "t", lambda w, part=part: {f"p{k}": F.col("d") * F.lag("d", k).over(w) for k in part}, max(part))
        r = wide.agg(
            *[F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"p{k}") for k in part],
            F.min_by(F.col("d") * F.col("d"), "t").alias("first"),
            F.max_by(F.col("d") * F.col("d"), "t").alias("last"),
        ).first()
        sums |= {k: r[f"p{k}"] for k in part}
        if start == 0:
            first, last = r["first"], r["last"]
    return Autocovariances(s["n"], mean, [sums[k] for k in lags], first or 0.0, last or 0.0)


def autocovariances(df: DataFrame, value: str, order_by: Sequence[str], nlags: int, centre: float | None = None) -> Autocovariances:
    return _lag_sums(series(df, value, order_by), nlags, centre)


def default_lags(n: int) -> int:
    return max(1, min(40, n // 4))


def acf(df: DataFrame, value: str, order_by: Sequence[str], nlags: int | None = None) -> DataFrame:
    """Autocorrelation with the 95 % white-noise band."""
    indexed = series(df, value, order_by)
    nlags = nlags if nlags is not None else default_lags(indexed.count())
    c = _lag_sums(indexed, nlags)
    band = 1.959963984540054 / math.sqrt(c.n)
    rows = [(k, s / c.sums[0] if c.sums[0] else None, band) for k, s in enumerate(c.sums)]
    return df.sparkSession.createDataFrame(rows, "lag int, acf double, band double")


def pacf(df: DataFrame, value: str, order_by: Sequence[str], nlags: int | None = None) -> DataFrame:
    """Partial autocorrelation from the adjusted Yule-Walker equations."""
    indexed = series(df, value, order_by)
    nlags = nlags if nlags is not None else default_lags(indexed.count())
    c = _lag_sums(indexed, nlags)
    r = np.array([s / (c.n - k) for k, s in enumerate(c.sums)])
    rows = [(0, 1.0)]
    for k in range(1, nlags + 1):
        lags = np.abs(np.subtract.outer(np.arange(k), np.arange(k)))
        phi = np.linalg.lstsq(r[lags], r[1 : k + 1], rcond=None)[0]
        rows.append((k, float(phi[-1])))
    return df.sparkSession.createDataFrame(rows, "lag int, pacf double")


def decompose(df: DataFrame, value: str, order_by: Sequence[str], period: int = 12, model: str = "additive") -> DataFrame:
    """Trend by a centred moving average, phase means, and what is left."""
    if model not in ("additive", "multiplicative"):
        raise ValueError(f"unknown model: {model}")
    indexed = series(df, value, order_by)
    n = indexed.count()
    if n < 2 * period:
        raise ValueError("decomposition needs at least two full periods")
    half = period // 2

    def build(w):
        frame = w.rowsBetween(-half, half)
        whole = F.count("v").over(frame) == 2 * half + 1
        total = F.sum("v").over(frame)
        if period % 2 == 0:
            total = total - 0.5 * (F.lag("v", half).over(w) + F.lead("v", half).over(w))
        return {"trend": F.when(whole, total / period)}

    smooth = windowed(indexed, "t", build, half, half)
    additive = model == "additive"
    detrended = F.col("v") - F.col("trend") if additive else F.try_divide(F.col("v"), F.col("trend"))
    phase = (F.col("t") % period).cast("int")
    means = {
        r["phase"]: r["m"] for r in smooth.groupBy(phase.alias("phase")).agg(F.avg(detrended).alias("m")).collect()  # `period` rows
    }
    middle = sum(means.values()) / len(means)
    fixed = [means[i] - middle if additive else means[i] / middle for i in range(period)]
    seasonal = F.element_at(F.array(*[F.lit(float(x)) for x in fixed]), phase + 1)
    out = smooth.withColumn("seasonal", seasonal)
    rest = F.col("v") - F.col("trend") - F.col("seasonal") if additive else F.try_divide(F.col("v"), F.col("trend") * F.col("seasonal"))
    return out.select("t", F.col("v").alias("observed"), "trend", "seasonal", rest.alias("residual"))


def adf(df: DataFrame, value: str, order_by: Sequence[str], max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller with a constant, lag chosen by AIC.

    All candidate lags are nested regressions on one common sample, so they
    share one pass of products; the chosen one is refitted on its own sample.
    """
    from abacist.operators.hypothesis import one_row
    from abacist.operators.regression import LinearModel

    indexed = series(df, value, order_by)
    n = indexed.count()
    if max_lag is None:
        max_lag = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2)

    def sample(lags: int) -> DataFrame:
        def build(w):
            step = {f"_l{k}": F.lag("v", k).over(w) for k in range(lags + 2)}
            return step

        wide = windowed(indexed, "t", build, lags + 1).filter(F.col("t") >= lags + 1)
        diffs = [(F.col(f"_l{k}") - F.col(f"_l{k + 1}")).alias(f"d{k}") for k in range(lags + 1)]
        return wide.select(F.col("_l1").alias("level"), *diffs)

    cols = lambda lags: ["level", *[f"d{k}" for k in range(1, lags + 1)]]
    m = moments(sample(max_lag), [*cols(max_lag), "d0"])
    fits = [LinearModel.from_moments(m, cols(k), "d0") for k in range(max_lag + 1)]
    best = min(range(max_lag + 1), key=lambda k: fits[k].aic)
    fit = LinearModel.from_moments(moments(sample(best), [*cols(best), "d0"]), cols(best), "d0")
    stat = float(fit.beta[1] / math.sqrt(fit.cov[1, 1]))
    crit = {name: sum(b / fit.n**i for i, b in enumerate(coefs)) for name, coefs in _ADF_CRITICAL.items()}
    return one_row(
        df,
        {
            "statistic": stat, "p": _adf_p(stat), "lags": best, "nobs": int(fit.n), "crit_1": crit["1"], "crit_5": crit["5"], "crit_10": crit["10"],
            "stationary": bool(_adf_p(stat) < 0.05),
        },
    )


# MacKinnon response surfaces for one series with a constant.
_ADF_CRITICAL = {
    "1": (-3.43035, -6.5393, -16.786, -79.433),
    "5": (-2.86154, -2.8903, -4.234, -40.040),
    "10": (-2.56677, -1.5384, -2.809),
}


def _adf_p(stat: float) -> float:
    # MacKinnon polynomial coefficients and their range.
    if stat > 2.74:
        return 1.0
    if stat < -18.83:
        return 0.0
    coefs = (2.1659, 1.4412, 0.038269) if stat <= -1.61 else (1.7339, 0.93202, -0.12745, -0.010368)
    return dist.norm_cdf(sum(c * stat**i for i, c in enumerate(coefs)))


def kpss(df: DataFrame, value: str, order_by: Sequence[str], lags: int | None = None) -> DataFrame:
    """Level stationarity from running sums of the centred series."""
    from abacist.operators.hypothesis import one_row

    indexed = series(df, value, order_by)
    n = indexed.count()
    lags = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n - 1) if lags is None else lags
    c = _lag_sums(indexed, lags)
    run = with_running_totals(indexed.withColumn("d", F.col("v") - F.lit(c.mean)), ["t"], {"s": "d"})
    eta = run.agg(F.sum(F.col("s") * F.col("s")).alias("e")).first()["e"] / n**2
    variance = (c.sums[0] + 2 * sum((1 - k / (lags + 1)) * c.sums[k] for k in range(1, lags + 1))) / n
    if not variance:
        return one_row(df, {"statistic": math.nan, "p": math.nan, "lags": lags}).withColumn("stationary", F.lit(None).cast("boolean"))
    stat = eta / variance
    # Published critical values for level stationarity.
    p = float(np.interp(stat, (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)))
    return one_row(df, {"statistic": stat, "p": p, "lags": lags, "stationary": bool(p >= 0.05)})


_TRUNC = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year", "H": "hour"}


def resample(df: DataFrame, time: str, frequency: str, aggs: Mapping[str, str]) -> DataFrame:
    """Aggregate to day, week, month, quarter or year: `{column: operation}`."""
    if frequency not in _TRUNC:
        raise ValueError(f"unknown frequency: {frequency}")
    return df.groupBy(F.date_trunc(_TRUNC[frequency], time).alias(time)).agg(
        *[_AGGREGATES[op](c).alias(f"{c}_{op}") for c, op in aggs.items()]
    )


def kaplan_meier(df: DataFrame, duration: str, event: str) -> DataFrame:
    """Survival curve with Greenwood errors, one row per distinct time."""
    data = df.select(clean_double(duration).alias("time"), F.col(event).cast("int").alias("e")).dropna()
    times = data.groupBy("time").agg(F.sum("e").cast("long").alias("events"), F.count(F.lit(1)).alias("leaving"))
    total = data.count()
    gone = with_running_totals(times, ["time"], {"gone": "leaving"})
    risk = gone.withColumn("at_risk", F.lit(total) - F.col("gone") + F.col("leaving"))
    alive = F.col("at_risk") - F.col("events")
    steps = risk.withColumns(
        {
            "_log": F.when(alive > 0, F.ln(alive / F.col("at_risk"))).otherwise(0.0),
            "_var": F.when(alive > 0, F.col("events") / (F.col("at_risk") * alive)).otherwise(0.0),
        }
    )
    run = with_running_totals(steps, ["time"], {"_cum": "_log", "_cumvar": "_var"})
    curve = F.when(alive > 0, F.exp("_cum")).otherwise(0.0)
    return run.select("time", "at_risk", "events", curve.alias("survival"), (curve * F.sqrt("_cumvar")).alias("se"))


def accelerated_failure(df: DataFrame, duration: str, event: str, features: Sequence[str]):
    """Weibull accelerated failure time model."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import AFTSurvivalRegression

    data = df.select(*[clean_double(c).alias(c) for c in [*features, duration, event]]).dropna()
    vec = VectorAssembler(inputCols=list(features), outputCol="features").transform(data)
    return AFTSurvivalRegression(labelCol=duration, censorCol=event, featuresCol="features").fit(vec)
