"""Known answers, published table values, edge rows and invariants."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from abacist.functions import columns as X
from abacist.functions import dist
from abacist.operators import clean, describe, frequency, hypothesis, nonparametric, profile, regression, reshape, transform
from abacist.operators import correlation as corr
from abacist.operators import multivariate as mv
from abacist.operators import timeseries as ts


@pytest.mark.parametrize(
    "got, want",
    [
        (lambda: dist.t_two_sided(2.228, 10), 0.05),
        (lambda: dist.t_two_sided(12.706, 1), 0.05),
        (lambda: dist.f_sf(3.326, 5, 10), 0.05),
        (lambda: dist.chi2_sf(3.841, 1), 0.05),
        (lambda: dist.chi2_sf(18.307, 10), 0.05),
        (lambda: dist.norm_two_sided(1.96), 0.05),
        (lambda: dist.studentized_range_sf(3.877, 3, 10), 0.05),
        (lambda: dist.studentized_range_sf(3.314, 3, 1e6), 0.05),
        (lambda: dist.studentized_range_sf(4.232, 5, 20), 0.05),
        (lambda: dist.kolmogorov_sf(1.358), 0.05),
    ],
)
def test_tails_against_tables(got, want):
    assert got() == pytest.approx(want, abs=2e-4)


def test_quantile_functions_invert():
    assert dist.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert dist.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert math.isnan(dist.t_two_sided(None, 3))


def test_normal_columns(spark):
    z = [-6.0, -2.5, -1.0, -0.1, 0.0, 0.3, 1.96, 4.0]
    df = spark.createDataFrame([(v,) for v in z], "z double")
    got = [r[0] for r in df.select(X.norm_cdf(F.col("z"))).collect()]
    assert np.allclose(got, dist.norm_cdf(z), atol=1e-7)
    back = [r[0] for r in df.select(X.norm_ppf(F.lit(0.001) + (F.col("z") + 6) / 11)).collect()]
    assert np.allclose(back, dist.norm_ppf([0.001 + (v + 6) / 11 for v in z]), atol=1e-7)


@pytest.fixture(scope="module")
def tiny(spark):
    return spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (10.0,), (None,), (float("nan"),)], "x double").repartition(3)


def test_describe_known(tiny):
    r = describe.describe_numeric(tiny, ["x"]).first()
    assert (r["count"], r["missing"], r["mean"], r["median"], r["q1"], r["q3"], r["iqr"]) == (5, 2, 4.0, 3.0, 2.0, 4.0, 2.0)
    assert (r["outlier_low"], r["outlier_high"], r["outliers"], r["mode"], r["trimmed_mean"]) == (-1.0, 7.0, 1, 1.0, 4.0)
    s = pd.Series([1, 2, 3, 4, 10.0])
    assert r["skewness"] == pytest.approx(s.skew()) and r["kurtosis"] == pytest.approx(s.kurtosis()) and r["mad"] == pytest.approx(2.4)


def test_describe_edges(spark):
    df = spark.createDataFrame([(None, 5.0), (None, 5.0)], "a double, b double")
    rows = {r["column"]: r for r in describe.describe_numeric(df).collect()}
    assert rows["a"]["count"] == 0 and rows["a"]["mean"] is None
    assert rows["b"]["std"] == 0.0 and rows["b"]["skewness"] is None
    empty = spark.createDataFrame([], "a double")
    assert describe.describe_numeric(empty).first()["count"] == 0


def test_scaling_known(tiny):
    z = sorted(r[0] for r in transform.normalize(tiny, ["x"]).collect() if r[0] is not None)
    assert z[0] == pytest.approx(-3 / math.sqrt(10)) and np.mean(z) == pytest.approx(0) and np.std(z) == pytest.approx(1)
    robust = sorted(r[0] for r in transform.normalize(tiny, ["x"], "robust").collect() if r[0] is not None)
    assert robust == [-1.0, -0.5, 0.0, 0.5, 3.5]


def test_constant_column_scales_to_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    for method in ("zscore", "minmax", "robust"):
        assert {r[0] for r in transform.normalize(df, ["x"], method).collect()} == {0.0, None}


def test_bins_like_pandas(spark):
    v = [float(x) for x in np.random.default_rng(5).integers(0, 40, 200)]
    df = spark.createDataFrame([(x,) for x in v], "x double")
    got = sorted(map(tuple, transform.bin_numeric(df, ["x"], 5).collect()))
    assert [b for _, b in got] == sorted(pd.qcut(v, 5, labels=False, duplicates="drop"))
    got = {r["x"]: r["x_binned"] for r in transform.bin_numeric(df, ["x"], 5, "uniform").collect()}
    assert got == dict(zip(v, pd.cut(v, 5, labels=False)))


def test_histogram_like_numpy(spark):
    v = np.random.default_rng(6).normal(size=300)
    out = frequency.histogram(spark.createDataFrame([(float(x),) for x in v], "x double"), "x", 12).orderBy("bin").collect()
    counts, edges = np.histogram(v, 12)
    assert [r["n"] for r in out] == list(counts) and np.allclose([r["low"] for r in out], edges[:-1])
    one = frequency.histogram(spark.createDataFrame([(3.0,)] * 4, "x double"), "x", 4)
    assert one.agg(F.sum("n")).first()[0] == 4 and one.agg(F.min("low")).first()[0] == 2.5


def test_encoders(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "c string")
    hot = {tuple(r) for r in transform.one_hot(df, ["c"]).collect()}
    assert hot == {(0, 1), (1, 0), (0, 0)}
    assert sorted(r[0] for r in transform.label_encode(df, ["c"]).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        transform.one_hot(df, ["c"], max_levels=1)
    with pytest.raises(ValueError):
        transform.transform(df, [{"type": "nope"}])


def test_fill_known(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, None), (4, 4.0), (5, None)], "t int, v double").repartition(3)
    pick = lambda out: [r["v"] for r in out.orderBy("t").collect()]
    assert pick(transform.impute(df, ["v"], "forward", order_by=["t"])) == [1, 1, 1, 4, 4]
    assert pick(transform.impute(df, ["v"], "backward", order_by=["t"])) == [1, 4, 4, 4, None]
    assert pick(transform.impute(df, ["v"], "interpolate", order_by=["t"])) == [1, 2, 3, 4, 4]


def test_melt_then_pivot_is_identity(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, 4.0, 5.0)], "id int, m1 double, m2 double")
    back = frequency.pivot_table(reshape.melt(df, ["id"]), ["id"], "variable", "value")
    assert sorted(map(tuple, back.select("id", "m1", "m2").collect())) == sorted(map(tuple, df.collect()))


def test_clean_names_and_table(spark):
    assert clean.clean_names(["a b", "1x", "a_b", "", "p%"]) == ["a_b", "col_1x", "a_b_1", "col_", "p"]
    df = spark.createDataFrame([(0, " 1 ", "x", "1"), (1, "2", None, "y")], ["Unnamed: 0", "n", "t", "mix"])
    out = clean.clean_table(df)
    assert dict(out.dtypes) == {"n": "double", "t": "string", "mix": "string"} and sorted(r["n"] for r in out.collect()) == [1.0, 2.0]


def test_chi_square_known(spark):
    rows = [("a", "x")] * 10 + [("a", "y")] * 20 + [("b", "x")] * 30 + [("b", "y")] * 40
    df = spark.createDataFrame(rows, "a string, b string")
    assert hypothesis.chi_square(df, "a", "b").first()["chi2"] == pytest.approx(0.44643, abs=1e-5)
    assert hypothesis.chi_square(df, "a", "b", correction=False).first()["chi2"] == pytest.approx(0.79365, abs=1e-5)
    p = hypothesis.fisher_exact(df, "a", "b").first()
    assert p["odds_ratio"] == pytest.approx(2 / 3) and 0.4 < p["p"] < 0.6


def test_anova_invariants(spark):
    rng = np.random.default_rng(7)
    rows = [(g, float(rng.normal(i))) for i, g in enumerate("abc") for _ in range(30 + 5 * i)]
    df = spark.createDataFrame(rows, "g string, y double")
    r = hypothesis.one_way_anova(df, "y", "g").first()
    y = np.array([v for _, v in rows])
    assert r["ss_between"] + r["ss_within"] == pytest.approx(((y - y.mean()) ** 2).sum())
    two = df.filter("g != 'c'")
    t = hypothesis.independent_t(two, "y", "g", equal_var=True).first()
    f = hypothesis.one_way_anova(two, "y", "g").first()
    assert t["t"] ** 2 == pytest.approx(f["f"]) and t["p"] == pytest.approx(f["p"])
    tukey = hypothesis.post_hoc(two, "y", "g").first()
    assert tukey["p"] == pytest.approx(t["p"], abs=1e-4)
    assert hypothesis.adjust_p([0.01, 0.04, 0.03], "holm") == pytest.approx([0.03, 0.06, 0.06])


def test_null_group_is_dropped(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 5.0), (None, 9.0)], "g string, y double")
    assert hypothesis.independent_t(df, "y", "g").first()["n1"] == 2


def test_one_sided_alternatives(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5)], "x double")
    two = hypothesis.one_sample_t(df, "x", 2).first()
    up = hypothesis.one_sample_t(df, "x", 2, alternative="greater").first()
    assert up["p"] == pytest.approx(two["p"] / 2) and two["effect"] == "medium"


def test_repeated_measures_with_two_levels_is_paired_t(spark):
    rng = np.random.default_rng(8)
    rows = [(i, lv, float(rng.normal(j))) for i in range(20) for j, lv in enumerate("ab")]
    df = spark.createDataFrame(rows, "s int, w string, y double")
    wide = df.groupBy("s").pivot("w", ["a", "b"]).agg(F.first("y"))
    t = hypothesis.paired_t(wide, "a", "b").first()
    r = hypothesis.repeated_measures_anova(df, "s", "w", "y").first()
    assert t["t"] ** 2 == pytest.approx(r["f"]) and r["eps_gg"] == pytest.approx(1.0)


def test_shapiro_published_example(spark):
    # Shapiro and Wilk (1965), weights of eleven men.
    v = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([(float(x),) for x in v], "x double")
    r = nonparametric.shapiro_wilk(df, "x").first()
    assert r["w"] == pytest.approx(0.79, abs=0.005) and r["p"] == pytest.approx(0.0067, abs=0.002)


def test_shapiro_takes_all_rows(spark):
    from abacist.catalog import load_all
    from abacist.catalog.base import QUERIES

    load_all()
    assert QUERIES["normality_shapiro"](spark, "/root/testdata/sf0.01").first()["n"] == 1500
    m = np.array([NormalDist().inv_cdf((i - 0.375) / 6000.25) for i in range(1, 6001)])
    x = np.exp(m / 2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(m, x)], "m double, x double").repartition(7)
    a, b = nonparametric.shapiro_wilk(df, "m").first(), nonparametric.shapiro_wilk(df, "x").first()
    assert a["n"] == b["n"] == 6000 and a["w"] > 0.9999 and a["p"] > 0.9
    # Far from the ends the weights are those of Shapiro and Francia.
    assert b["w"] == pytest.approx(np.corrcoef(m, x)[0, 1] ** 2, abs=0.005) and b["p"] < 1e-6


def test_normal_sample_passes_and_skewed_fails(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.normal(size=2000), rng.exponential(size=2000))], "n double, e double")
    for fn, stat in ((nonparametric.ks_normal, "p"), (nonparametric.anderson_darling, "p"), (nonparametric.jarque_bera, "p"), (nonparametric.shapiro_wilk, "p")):
        assert fn(df, "n").first()[stat] > 0.01
        assert fn(df, "e").first()[stat] < 0.001


def test_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 6.0, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    m = {(r["a"], r["b"]): r for r in corr.correlation(df, ["a", "b", "c"]).collect()}
    assert m["a", "b"]["n"] == 3 and m["a", "c"]["r"] is None and m["a", "b"]["r"] == m["b", "a"]["r"]
    s = {(r["a"], r["b"]): r["r"] for r in corr.correlation(df, ["a", "b"], "spearman").collect()}
    k = {(r["a"], r["b"]): r["r"] for r in corr.correlation(df, ["a", "b"], "kendall").collect()}
    assert s["a", "b"] == pytest.approx(1.0) and k["a", "b"] == pytest.approx(1.0)


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 3))
    y = 1 + x @ [2.0, -1.0, 0.0] + rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, (*a, b))) for a, b in zip(x, y)], "a double, b double, c double, y double")
    model = regression.ols(df, "y", ["a", "b", "c"])
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)
    assert np.allclose(model.beta, beta)
    e = model.residuals()
    assert e.agg(F.sum("residual")).first()[0] == pytest.approx(0, abs=1e-8)
    assert e.agg(F.sum(F.pow("residual", 2))).first()[0] == pytest.approx(model.rss)
    assert model.influence().agg(F.sum("leverage")).first()[0] == pytest.approx(4.0)
    chosen = regression.stepwise(df, "y", ["a", "b", "c"], "forward").features
    assert chosen[:2] == ["a", "b"]
    for how in ("backward", "both"):
        assert set(regression.stepwise(df, "y", ["a", "b", "c"], how).features) >= {"a", "b"}
    q = regression.quantile_regression(df, "y", ["a", "b"], 0.5)
    assert np.allclose(q.beta, [1, 2, -1], atol=0.35) and q.stats["converged"]
    h = regression.huber_regression(df, "y", ["a", "b"])
    assert np.allclose(h.beta, [1, 2, -1], atol=0.3)
    bp, jb = model.breusch_pagan().first(), model.jarque_bera().first()
    assert bp["lm_p"] > 0.001 and jb["p"] > 0.001


def test_singular_design_uses_rank(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 3.0 * i + 1) for i in range(10)], "a double, b double, y double")
    model = regression.ols(df, "y", ["a", "b"])
    assert model.rank == 1 and model.r2 == pytest.approx(1.0)


def test_two_group_manova_is_hotelling(spark):
    rng = np.random.default_rng(11)
    rows = [("a" if i < 30 else "b", float(rng.normal(i >= 30)), float(rng.normal())) for i in range(70)]
    df = spark.createDataFrame(rows, "g string, u double, v double")
    r = {x["statistic"]: x for x in regression.manova(df, ["u", "v"], "g").collect()}
    assert r["wilks"]["f"] == pytest.approx(r["pillai"]["f"]) == pytest.approx(r["hotelling"]["f"])
    one = regression.ancova(df, "u", "g", ["v"]).collect()
    assert [x["term"] for x in one] == ["g", "v", "Residual"]


def test_logit_recovers_and_scores(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=1500)
    y = rng.random(1500) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))
    df = spark.createDataFrame([(float(a), "yes" if b else "no") for a, b in zip(x, y)], "x double, y string")
    model = regression.logit(df, "y", ["x"])
    s = {r["term"]: r for r in model.summary().collect()}
    assert s["x"]["coef"] == pytest.approx(1.5, abs=0.3) and s["x"]["ratio"] == pytest.approx(math.exp(s["x"]["coef"]))
    stats = model.fit_stats().first()
    assert stats["aic"] == pytest.approx(-2 * stats["llf"] + 4, abs=1e-6)
    assert regression.logit_metrics(model).first()["auc"] > 0.75


def test_pca_and_factors(spark):
    rng = np.random.default_rng(13)
    f = rng.normal(size=(600, 2))
    x = f @ np.array([[1, 1, 1, 0, 0, 0], [0, 0, 0, 1, 1, 1.0]]) + 0.4 * rng.normal(size=(600, 6))
    names = [f"v{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], names)
    p = mv.pca(df, names, 6)
    assert p.summary().agg(F.sum("ratio")).first()[0] == pytest.approx(1.0)
    scores = p.transform(df).agg(F.corr("pc1", "pc2"), F.var_samp("pc1")).first()
    assert scores[0] == pytest.approx(0, abs=1e-8) and scores[1] == pytest.approx(p.values[0])
    load = mv.factor_analysis(df, names, 2).loadings_
    own = np.abs(load).argmax(1)
    assert len(set(own[:3])) == 1 and len(set(own[3:])) == 1 and own[0] != own[3] and np.abs(load).max(1).min() > 0.8
    assert mv.kmo(df, names).filter('column = "overall"').first()["kmo"] > 0.6


def test_series_operators(spark):
    rng = np.random.default_rng(14)
    t = np.arange(240)
    v = 10 + 0.1 * t + 3 * np.sin(2 * np.pi * t / 12) + 0.1 * rng.normal(size=240)
    walk = np.cumsum(rng.normal(size=240))
    noise = rng.normal(size=240)
    df = spark.createDataFrame([(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(t, v, walk, noise)], "t int, v double, walk double, noise double").repartition(5)
    d = ts.decompose(df, "v", ["t"], 12).filter("trend is not null")
    assert d.agg(F.stddev("residual")).first()[0] < 0.2 and d.agg(F.max("seasonal")).first()[0] == pytest.approx(3, abs=0.2)
    assert ts.adf(df, "noise", ["t"]).first()["stationary"] and not ts.adf(df, "walk", ["t"]).first()["stationary"]
    assert ts.kpss(df, "noise", ["t"]).first()["stationary"] and not ts.kpss(df, "walk", ["t"]).first()["stationary"]
    a = [r["acf"] for r in ts.acf(df, "v", ["t"], 5).orderBy("lag").collect()]
    c = v - v.mean()
    assert np.allclose(a, [(c[k:] * c[: 240 - k]).sum() / (c @ c) for k in range(6)])
    p = [r["pacf"] for r in ts.pacf(df, "v", ["t"], 3).orderBy("lag").collect()]
    assert p[0] == 1.0 and abs(p[1]) <= 1.01
    with pytest.raises(ValueError):
        ts.decompose(df.limit(10), "v", ["t"], 12)


def test_quality_and_validation(spark):
    df = spark.createDataFrame([(1, "5", 1.0), (1, "5", 1.0), (2, "ab", None), (3, "ab", 2.0)], "id int, mix string, v double")
    s = profile.quality_scores(df).first()
    assert s["completeness"] == pytest.approx(11 / 12) and s["uniqueness"] == 0.75 and s["consistency"] == 0.0
    issues = {(r["column"], r["issue"]) for r in profile.validate_table(df).collect()}
    assert issues == {("mix", "mixed content")}
    roles = {r["column"]: r["role"] for r in profile.infer_roles(df).collect()}
    assert roles == {"id": "numeric", "mix": "binary", "v": "binary"}
    assert profile.apply_roles(df).schema["mix"].metadata["role"] == "binary"
    assert {r["column"] for r in profile.quality_report(df)["recommendations"].collect()} >= {"v"}


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("v", F.col("id") % 7)
    assert X.fingerprint(df).first() == X.fingerprint(df.repartition(9).orderBy(F.desc("v"))).first()
    assert X.fingerprint(df).first() != X.fingerprint(df.filter("id > 0")).first()


def test_scan_reads_only_what_is_needed(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = clean.filter_rows(df, [{"column": "l_quantity", "op": "gt", "value": 45}]).select("l_orderkey", "l_quantity")
    plan = out._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    grouped = describe.group_summary(df, ["l_returnflag"], "l_tax")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in grouped and "partial_avg" in grouped
