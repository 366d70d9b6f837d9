"""Tests, correlation, regression, multivariate and time-series queries."""

from pyspark.sql import functions as F

from abacist.catalog.base import query, r, rounded, table
from abacist.operators import correlation as corr
from abacist.operators import hypothesis as hy
from abacist.operators import multivariate as mv
from abacist.operators import nonparametric as npar
from abacist.operators import regression as reg
from abacist.operators import timeseries as ts

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def li(spark, d):
    return table(spark, d, "lineitem")


def pick(df, /, **digits):
    """Round named columns, keep the rest given with None."""
    return df.select(*[F.col(c) if k is None else r(F.col(c), k, c) for c, k in digits.items()])


# ---- t tests -------------------------------------------------------------

@query("t_one_sample", """SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std,
    round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df, round((avg(l_quantity) - 25) / stddev_samp(l_quantity), 8) AS cohens_d,
    CASE WHEN abs((avg(l_quantity) - 25) / stddev_samp(l_quantity)) < 0.2 THEN 'negligible' ELSE 'other' END AS effect FROM lineitem""")
def t_one_sample(spark, d):
    return pick(hy.one_sample_t(li(spark, d), "l_quantity", 25), n=None, mean=6, std=6, t=6, df=None, cohens_d=8, effect=None)


@query("t_one_sample_by_flag", """SELECT l_returnflag, count(*) AS n, round((avg(l_quantity) - 25.5) / (stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t FROM lineitem GROUP BY l_returnflag""")
def t_one_sample_by_flag(spark, d):
    return pick(hy.one_sample_t(li(spark, d), "l_quantity", 25.5, by=["l_returnflag"], alternative="greater"), l_returnflag=None, n=None, t=6)


@query("t_paired", """SELECT count(*) AS n, round(avg(a - b), 5) AS mean, round(stddev_samp(a - b), 5) AS std, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 5) AS t,
    round(avg(a - b) / stddev_samp(a - b), 7) AS cohens_d FROM (SELECT l_extendedprice AS b, l_extendedprice * (1 - l_discount) AS a FROM lineitem)""")
def t_paired(spark, d):
    t = li(spark, d).select(F.col("l_extendedprice").alias("b"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"))
    return pick(hy.paired_t(t, "b", "a"), n=None, mean=5, std=5, t=5, cohens_d=7)


GROUPS2 = """WITH g AS (SELECT l_linestatus AS g, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY 1),
    p AS (SELECT a.n AS n1, b.n AS n2, a.m AS m1, b.m AS m2, a.v AS v1, b.v AS v2 FROM g a, g b WHERE a.g = 'F' AND b.g = 'O')"""


@query("t_independent_pooled", GROUPS2 + """ SELECT n1, n2, round(m1, 6) AS mean1, round(m2, 6) AS mean2,
    round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df,
    round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 7) AS cohens_d FROM p""")
def t_independent_pooled(spark, d):
    return pick(hy.independent_t(li(spark, d), "l_quantity", "l_linestatus", equal_var=True), n1=None, n2=None, mean1=6, mean2=6, t=6, df=None, cohens_d=7)


@query("t_independent_welch", GROUPS2 + """ SELECT round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
    round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 3) AS df FROM p""")
def t_independent_welch(spark, d):
    return pick(hy.independent_t(li(spark, d), "l_quantity", "l_linestatus", equal_var=False), t=6, df=3)


@query("t_independent_auto")
def t_independent_auto(spark, d):
    return hy.independent_t(li(spark, d), "l_extendedprice", "l_linestatus")


@query("t_columns", """SELECT count(l_discount) AS n1, count(l_tax) AS n2, round((avg(l_discount) - avg(l_tax)) / sqrt(var_samp(l_discount) / count(l_discount) + var_samp(l_tax) / count(l_tax)), 5) AS t FROM lineitem""")
def t_columns(spark, d):
    return pick(hy.independent_t_columns(li(spark, d), "l_discount", "l_tax", equal_var=False), n1=None, n2=None, t=5)


# ---- variance and ANOVA ---------------------------------------------------

def _anova_sql(src, extra=""):
    return f"""WITH x AS ({src}), g AS (SELECT g, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM x GROUP BY g),
    t AS (SELECT sum(n * m) / sum(n) AS grand FROM g),
    s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * (m - grand) ** 2) AS ssb, sum((n - 1) * v) AS ssw FROM g, t) {extra}"""


@query("levene", _anova_sql("SELECT c_mktsegment AS g, abs(c_acctbal - med) AS y FROM customer JOIN (SELECT c_mktsegment AS k, quantile_cont(c_acctbal, 0.5) AS med FROM customer GROUP BY 1) ON k = c_mktsegment",
    "SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 7) AS w, k - 1 AS df1, CAST(n - k AS BIGINT) AS df2 FROM s"))
def levene(spark, d):
    return pick(hy.levene(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"), w=7, df1=None, df2=None)


CUSTOMERS = "SELECT o_custkey AS g, o_totalprice AS y FROM orders"


@query("anova_by_customer", _anova_sql(CUSTOMERS, "SELECT CAST(n AS BIGINT) AS n, k AS groups, round((ssb / (k - 1)) / (ssw / (n - k)), 7) AS f FROM s"))
def anova_by_customer(spark, d):
    return pick(hy.one_way_anova(table(spark, d, "orders"), "o_totalprice", "o_custkey"), n=None, groups=None, f=7)


@query("levene_by_customer", _anova_sql("SELECT o_custkey AS g, abs(o_totalprice - med) AS y FROM orders JOIN (SELECT o_custkey AS k, quantile_cont(o_totalprice, 0.5) AS med FROM orders GROUP BY 1) ON k = o_custkey",
    "SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 7) AS w, k - 1 AS df1 FROM s"))
def levene_by_customer(spark, d):
    return pick(hy.levene(table(spark, d, "orders"), "o_totalprice", "o_custkey"), w=7, df1=None)


@query("anova_one_way", _anova_sql("SELECT c_mktsegment AS g, c_acctbal AS y FROM customer",
    "SELECT CAST(n AS BIGINT) AS n, k AS groups, round(ssb / 1e6, 5) AS ssb_m, round(ssw / 1e6, 4) AS ssw_m, round((ssb / (k - 1)) / (ssw / (n - k)), 7) AS f, round(ssb / (ssb + ssw), 8) AS eta_sq FROM s"))
def anova_one_way(spark, d):
    out = hy.one_way_anova(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return out.select("n", "groups", r(F.col("ss_between") / 1e6, 5, "ssb_m"), r(F.col("ss_within") / 1e6, 4, "ssw_m"), r(F.col("f"), 7, "f"), r(F.col("eta_sq"), 8, "eta_sq"))


# Interaction of a 2 x 2 design: compared through the cell means.
@query("anova_two_way", """WITH t AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'N' END AS a, l_linestatus AS b, l_quantity AS y FROM lineitem),
    c AS (SELECT a, b, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM t GROUP BY 1, 2),
    e AS (SELECT sum((n - 1) * v) AS sse, sum(n) - 4 AS dfe FROM c),
    i AS (SELECT (sum(CASE WHEN (a = 'R') = (b = 'F') THEN m ELSE -m END)) ** 2 / sum(1.0 / n) AS ssi FROM c),
    w AS (SELECT b, sum(n) FILTER (a = 'R') AS n1, sum(n) FILTER (a = 'N') AS n2, max(m) FILTER (a = 'R') - max(m) FILTER (a = 'N') AS dm FROM c GROUP BY b),
    ea AS (SELECT sum(n1 * n2 / (n1 + n2) * dm) ** 2 / sum(n1 * n2 / (n1 + n2)) AS ssa FROM w),
    u AS (SELECT a, sum(n) FILTER (b = 'F') AS n1, sum(n) FILTER (b = 'O') AS n2, max(m) FILTER (b = 'F') - max(m) FILTER (b = 'O') AS dm FROM c GROUP BY a),
    eb AS (SELECT sum(n1 * n2 / (n1 + n2) * dm) ** 2 / sum(n1 * n2 / (n1 + n2)) AS ssb FROM u)
    SELECT 'a' AS term, round(ssa, 4) AS ss, round(ssa / (sse / dfe), 6) AS f FROM ea, e UNION ALL SELECT 'b', round(ssb, 4), round(ssb / (sse / dfe), 6) FROM eb, e
    UNION ALL SELECT 'a:b', round(ssi, 4), round(ssi / (sse / dfe), 6) FROM i, e UNION ALL SELECT 'Residual', round(sse, 4), NULL FROM e""")
def anova_two_way(spark, d):
    t = li(spark, d).select(F.expr("CASE WHEN l_returnflag = 'R' THEN 'R' ELSE 'N' END").alias("a"), F.col("l_linestatus").alias("b"), "l_quantity")
    return pick(hy.two_way_anova(t, "l_quantity", "a", "b"), term=None, ss=4, f=6)


RM = """WITH c AS (SELECT user_id, event_type, avg(value) AS y FROM events GROUP BY 1, 2), full5 AS (SELECT user_id FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT event_type) FROM events)),
    x AS (SELECT c.* FROM c JOIN full5 USING (user_id)), g AS (SELECT avg(y) AS g FROM x), k AS (SELECT count(DISTINCT event_type) AS k, count(DISTINCT user_id) AS n FROM x)"""


@query("anova_repeated", RM + """, sw AS (SELECT sum(nl * (ml - g) ** 2) AS ssw FROM (SELECT count(*) AS nl, avg(y) AS ml FROM x GROUP BY event_type), g),
    ss AS (SELECT sum(nl * (ml - g) ** 2) AS sss FROM (SELECT count(*) AS nl, avg(y) AS ml FROM x GROUP BY user_id), g), st AS (SELECT sum((y - g) ** 2) AS sst FROM x, g)
    SELECT n AS subjects, k AS levels, round(ssw, 3) AS ss_within, round(sst - ssw - sss, 2) AS ss_error, round((ssw / (k - 1)) / ((sst - ssw - sss) / ((k - 1) * (n - 1))), 6) AS f FROM sw, ss, st, k""")
def anova_repeated(spark, d):
    return pick(hy.repeated_measures_anova(table(spark, d, "events"), "user_id", "event_type", "value"), subjects=None, levels=None, ss_within=3, ss_error=2, f=6)


@query("anova_repeated_sphericity")
def anova_repeated_sphericity(spark, d):
    return hy.repeated_measures_anova(table(spark, d, "events"), "user_id", "event_type", "value").select("eps_gg", "p_gg", "mauchly_w", "sphericity_chi2", "sphericity_p")


TUKEY = """WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1),
    e AS (SELECT sum((n - 1) * v) / (sum(n) - count(*)) AS mse, count(*) AS k FROM g)"""


@query("post_hoc_tukey", TUKEY + """ SELECT a.g AS group1, b.g AS group2, round(a.m - b.m, 4) AS mean_diff, round(abs(a.m - b.m) / sqrt(mse * (1 / a.n + 1 / b.n) / 2), 7) AS statistic FROM g a JOIN g b ON a.g < b.g, e""")
def post_hoc_tukey(spark, d):
    return pick(hy.post_hoc(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"), group1=None, group2=None, mean_diff=4, statistic=7)


@query("post_hoc_scheffe", TUKEY + """ SELECT a.g AS group1, b.g AS group2, round((a.m - b.m) ** 2 / (mse * (1 / a.n + 1 / b.n)) / (k - 1), 7) AS statistic FROM g a JOIN g b ON a.g < b.g, e""")
def post_hoc_scheffe(spark, d):
    return pick(hy.post_hoc(table(spark, d, "customer"), "c_acctbal", "c_mktsegment", "scheffe"), group1=None, group2=None, statistic=7)


@query("post_hoc_games_howell", TUKEY + """ SELECT a.g AS group1, b.g AS group2, round(abs(a.m - b.m) / sqrt((a.v / a.n + b.v / b.n) / 2), 7) AS statistic FROM g a JOIN g b ON a.g < b.g""")
def post_hoc_games_howell(spark, d):
    return pick(hy.post_hoc(table(spark, d, "customer"), "c_acctbal", "c_mktsegment", "games-howell"), group1=None, group2=None, statistic=7)


for _method in ("bonferroni", "holm", "sidak"):
    query(f"post_hoc_{_method}", TUKEY + """ SELECT a.g AS group1, b.g AS group2, round((a.m - b.m) / sqrt(mse * (1 / a.n + 1 / b.n)), 7) AS statistic FROM g a JOIN g b ON a.g < b.g, e""")(
        lambda spark, d, m=_method: pick(hy.post_hoc(table(spark, d, "customer"), "c_acctbal", "c_mktsegment", m), group1=None, group2=None, statistic=7)
    )


# ---- counts -----------------------------------------------------------------

CHI = """WITH o AS (SELECT {a} AS a, {b} AS b, count(*) AS n FROM {t} GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS n FROM o GROUP BY 1), cb AS (SELECT b, sum(n) AS n FROM o GROUP BY 1), t AS (SELECT sum(n) AS n FROM o),
    e AS (SELECT ra.a, cb.b, coalesce(o.n, 0) AS obs, ra.n * cb.n / t.n AS exp FROM ra CROSS JOIN cb CROSS JOIN t LEFT JOIN o ON o.a = ra.a AND o.b = cb.b)"""


@query("chi_square", CHI.format(a="o_orderstatus", b="o_orderpriority", t="orders") + """ SELECT CAST(sum(obs) AS BIGINT) AS n, round(sum((obs - exp) ** 2 / exp), 7) AS chi2,
    (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df, round(sqrt(sum((obs - exp) ** 2 / exp) / (sum(obs) * least(count(DISTINCT a) - 1, count(DISTINCT b) - 1))), 8) AS cramers_v FROM e""")
def chi_square(spark, d):
    return pick(hy.chi_square(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), n=None, chi2=7, df=None, cramers_v=8)


@query("chi_square_by_part", CHI.format(a="l_partkey", b="l_returnflag", t="lineitem") + """ SELECT CAST(sum(obs) AS BIGINT) AS n, round(sum((obs - exp) ** 2 / exp), 5) AS chi2,
    (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS df FROM e""")
def chi_square_by_part(spark, d):
    return pick(hy.chi_square(li(spark, d), "l_partkey", "l_returnflag"), n=None, chi2=5, df=None)


@query("chi_square_corrected", CHI.format(a="l_linestatus", b="(l_returnflag = 'R')", t="lineitem") + " SELECT round(sum((greatest(abs(obs - exp) - 0.5, 0)) ** 2 / exp), 6) AS chi2 FROM e")
def chi_square_corrected(spark, d):
    t = li(spark, d).select("l_linestatus", (F.col("l_returnflag") == "R").alias("ret"))
    return pick(hy.chi_square(t, "l_linestatus", "ret"), chi2=6)


@query("chi_square_expected", CHI.format(a="o_orderstatus", b="o_orderpriority", t="orders") + " SELECT a AS o_orderstatus, b AS o_orderpriority, obs AS observed, round(exp, 5) AS expected FROM e")
def chi_square_expected(spark, d):
    return pick(hy.expected_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority"), o_orderstatus=None, o_orderpriority=None, observed=None, expected=5)


@query("goodness_of_fit", "SELECT CAST(sum(n) AS BIGINT) AS n, round(sum((n - e) ** 2 / e), 6) AS chi2, count(*) - 1 AS df FROM (SELECT count(*) AS n, (SELECT count(*) FROM events) / (SELECT count(DISTINCT event_type) FROM events) AS e FROM events GROUP BY event_type)")
def goodness_of_fit(spark, d):
    return pick(hy.goodness_of_fit(table(spark, d, "events"), "event_type"), n=None, chi2=6, df=None)


@query("fisher_exact", "SELECT round(count(*) FILTER (quality = 0 AND toxic = 0) * count(*) FILTER (quality = 1 AND toxic = 1) / (count(*) FILTER (quality = 0 AND toxic = 1) * count(*) FILTER (quality = 1 AND toxic = 0)), 6) AS odds_ratio FROM labels")
def fisher_exact(spark, d):
    return pick(hy.fisher_exact(table(spark, d, "labels"), "quality", "toxic"), odds_ratio=6)


@query("mcnemar", "SELECT count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic = 0) AS c FROM labels")
def mcnemar(spark, d):
    return hy.mcnemar(table(spark, d, "labels"), "quality", "toxic").select("b", "c")


@query("cochran_q", """WITH t AS (SELECT CAST(l_discount > 0.05 AS INTEGER) AS a, CAST(l_tax > 0.04 AS INTEGER) AS b, CAST(l_quantity > 25 AS INTEGER) AS c FROM lineitem)
    SELECT count(*) AS n, round(2 * (3 * (sum(a) ** 2 + sum(b) ** 2 + sum(c) ** 2) - sum(a + b + c) ** 2) / (3 * sum(a + b + c) - sum((a + b + c) ** 2)), 5) AS q FROM t""")
def cochran_q(spark, d):
    t = li(spark, d).select(F.expr("int(l_discount > 0.05)").alias("a"), F.expr("int(l_tax > 0.04)").alias("b"), F.expr("int(l_quantity > 25)").alias("c"))
    return pick(hy.cochran_q(t, ["a", "b", "c"]), n=None, q=5)


# ---- ranks --------------------------------------------------------------------

RANKED = "SELECT *, rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {x}) AS tie FROM ({src})"


@query("mann_whitney", "WITH k AS (" + RANKED.format(x="l_quantity", src="SELECT l_quantity, l_linestatus FROM lineitem") + """), s AS (SELECT count(*) FILTER (l_linestatus = 'F') AS n1, count(*) AS n, sum(rk) FILTER (l_linestatus = 'F') AS r1, sum(CAST(tie AS DOUBLE) ** 2 - 1) AS ties FROM k)
    SELECT n1, n - n1 AS n2, round(r1 - n1 * (n1 + 1) / 2, 1) AS u, round(greatest(abs(r1 - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) - 0.5, 0) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))), 7) AS z FROM s""")
def mann_whitney(spark, d):
    return pick(npar.mann_whitney(li(spark, d), "l_quantity", "l_linestatus"), n1=None, n2=None, u=1, z=7)


@query("wilcoxon", "WITH k AS (" + RANKED.format(x="abs(df)", src="SELECT round(o_totalprice - 150000, 0) AS df FROM orders WHERE round(o_totalprice - 150000, 0) <> 0") + """), s AS (SELECT count(*) AS n, sum(rk) FILTER (df > 0) AS wp, sum(rk) FILTER (df < 0) AS wm, sum(CAST(tie AS DOUBLE) ** 2 - 1) AS ties FROM k)
    SELECT n, wp AS w_plus, wm AS w_minus, round((least(wp, wm) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 7) AS z FROM s""")
def wilcoxon(spark, d):
    t = table(spark, d, "orders").select(F.lit(0.0).alias("a"), F.round(F.col("o_totalprice") - 150000, 0).alias("b"))
    return pick(npar.wilcoxon(t, "a", "b"), n=None, w_plus=None, w_minus=None, z=7)


@query("kruskal_wallis", "WITH k AS (" + RANKED.format(x="value", src="SELECT value, event_type FROM events") + """), n AS (SELECT count(*) AS n, sum(CAST(tie AS DOUBLE) ** 2 - 1) AS ties FROM k), g AS (SELECT event_type, count(*) AS m, avg(rk) AS a FROM k GROUP BY 1)
    SELECT any_value(n) AS n, count(*) AS groups, round(12 / (any_value(n) * (any_value(n) + 1)) * sum(m * (a - (n + 1) / 2) ** 2) / (1 - any_value(ties) / (any_value(n) ** 3 - any_value(n))), 6) AS h FROM g, n""")
def kruskal_wallis(spark, d):
    return pick(npar.kruskal_wallis(table(spark, d, "events"), "value", "event_type"), n=None, groups=None, h=6)


@query("friedman", RM + """, rk AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY y) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2.0 AS rr FROM x)
    SELECT any_value(n) AS subjects, any_value(k) AS levels, round(12 / (any_value(n) * any_value(k) * (any_value(k) + 1)) * sum(s ** 2) - 3 * any_value(n) * (any_value(k) + 1), 5) AS chi2 FROM (SELECT event_type, sum(rr) AS s FROM rk GROUP BY 1), k""")
def friedman(spark, d):
    return pick(npar.friedman(table(spark, d, "events"), "user_id", "event_type", "value"), subjects=None, levels=None, chi2=5)


@query("jarque_bera", """SELECT count(*) AS n, round(count(*) / 6 * (s ** 2 + (k - 3) ** 2 / 4), 3) AS jb FROM orders, (SELECT avg((o_totalprice - m) ** 3) / avg((o_totalprice - m) ** 2) ** 1.5 AS s, avg((o_totalprice - m) ** 4) / avg((o_totalprice - m) ** 2) ** 2 AS k
    FROM orders, (SELECT avg(o_totalprice) AS m FROM orders)) GROUP BY s, k""")
def jarque_bera(spark, d):
    return pick(npar.jarque_bera(table(spark, d, "orders"), "o_totalprice"), n=None, jb=3)


@query("normality_ks")
def normality_ks(spark, d):
    return npar.ks_normal(table(spark, d, "orders"), "o_totalprice")


@query("normality_shapiro")
def normality_shapiro(spark, d):
    return npar.shapiro_wilk(table(spark, d, "customer"), "c_acctbal")


@query("normality_anderson")
def normality_anderson(spark, d):
    return npar.anderson_darling(table(spark, d, "customer"), "c_acctbal")


@query("normality")
def normality(spark, d):
    return npar.normality(table(spark, d, "orders"), "o_totalprice")


@query("qq_points", " UNION ALL ".join(f"SELECT {(i + 0.5) / 20}::DOUBLE AS p, round(quantile_cont(o_totalprice, {(i + 0.5) / 20}), 6) AS sample FROM orders" for i in range(20)))
def qq_points(spark, d):
    return pick(npar.qq_points(table(spark, d, "orders"), "o_totalprice", 20), p=None, sample=6)


@query("assumption_checks")
def assumption_checks(spark, d):
    return npar.check_assumptions(li(spark, d), "anova", variable="l_quantity", group="l_returnflag")


# ---- correlation ----------------------------------------------------------------

NP = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"


@query("correlation_pearson", f"""SELECT 'p' AS a, 'k' AS b, count(p) AS n, round(corr(p, k), 9) AS r FROM (SELECT {NP} AS p, o_custkey AS k FROM orders)""")
def correlation_pearson(spark, d):
    t = table(spark, d, "orders").select(F.expr(NP).alias("p"), F.col("o_custkey").alias("k"))
    return pick(corr.correlation(t, ["p", "k"]).filter("a = 'p' AND b = 'k'"), a=None, b=None, n=None, r=9)


def _spearman(a, b):
    return f"""SELECT '{a}' AS a, '{b}' AS b, round(corr(ra, rb), 9) AS r FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra,
    rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM lineitem)"""


@query("correlation_spearman", " UNION ALL ".join(_spearman(a, b) for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))))
def correlation_spearman(spark, d):
    m = corr.correlation(li(spark, d), ["l_quantity", "l_extendedprice", "l_tax"], "spearman")
    keep = F.concat_ws("|", "a", "b").isin("l_quantity|l_extendedprice", "l_quantity|l_tax", "l_extendedprice|l_tax")
    return pick(m.filter(keep), a=None, b=None, r=9)


# tau-b through the table of distinct pairs.
@query("correlation_kendall", """WITH c AS (SELECT p_size AS x, round(p_retailprice / 50) AS y, count(*) AS w FROM part GROUP BY 1, 2),
    s AS (SELECT sum(a.w * b.w) FILTER ((a.x < b.x AND a.y < b.y)) AS con, sum(a.w * b.w) FILTER (a.x < b.x AND a.y > b.y) AS dis FROM c a JOIN c b ON a.x < b.x),
    t AS (SELECT (SELECT count(*) * (count(*) - 1) / 2 FROM part) AS n0, (SELECT sum(w * (w - 1) / 2) FROM (SELECT sum(w) AS w FROM c GROUP BY x)) AS n1, (SELECT sum(w * (w - 1) / 2) FROM (SELECT sum(w) AS w FROM c GROUP BY y)) AS n2)
    SELECT 'x' AS a, 'y' AS b, round((con - dis) / sqrt((n0 - n1) * (n0 - n2)), 9) AS r FROM s, t""")
def correlation_kendall(spark, d):
    t = table(spark, d, "part").select(F.col("p_size").alias("x"), F.round(F.col("p_retailprice") / 50).alias("y"))
    return pick(corr.correlation(t, ["x", "y"], "kendall").filter("a = 'x' AND b = 'y'"), a=None, b=None, r=9)


@query("correlation_p_values")
def correlation_p_values(spark, d):
    return corr.correlation(li(spark, d), LINE)


@query("correlation_strong", "SELECT 'l_extendedprice' AS a, 'revenue' AS b, round(corr(l_extendedprice, l_extendedprice * (1 - l_discount)), 9) AS r FROM lineitem")
def correlation_strong(spark, d):
    t = li(spark, d).select("l_extendedprice", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return pick(corr.strong_pairs(corr.correlation(t, ["l_extendedprice", "l_quantity", "revenue"])), a=None, b=None, r=9)


@query("correlation_partial", """SELECT 'x' AS a, 'y' AS b, round((rxy - rxz * ryz) / sqrt((1 - rxz ** 2) * (1 - ryz ** 2)), 9) AS r FROM (SELECT corr(l_quantity, l_extendedprice) AS rxy, corr(l_quantity, l_tax) AS rxz, corr(l_extendedprice, l_tax) AS ryz FROM lineitem)""")
def correlation_partial(spark, d):
    t = li(spark, d).select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_tax").alias("z"))
    return pick(corr.partial_correlation(t, ["x", "y", "z"]).filter("a = 'x' AND b = 'y'"), a=None, b=None, r=9)


# ---- regression ---------------------------------------------------------------

@query("ols_simple", """SELECT 'const' AS term, round(regr_intercept(l_extendedprice, l_quantity), 4) AS coef, round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)
    * (1 / count(*) + avg(l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity))), 5) AS se FROM lineitem UNION ALL
    SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 7), round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 5) FROM lineitem""")
def ols_simple(spark, d):
    s = reg.ols(li(spark, d), "l_extendedprice", ["l_quantity"]).summary()
    coef = F.when(F.col("term") == "const", F.round("coef", 4)).otherwise(F.round("coef", 7)).alias("coef")
    return s.select("term", coef, r(F.col("se"), 5, "se"))


TWO = """WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2, var_pop(l_quantity) * count(*) AS s11, var_pop(l_discount) * count(*) AS s22, covar_pop(l_quantity, l_discount) * count(*) AS s12,
    covar_pop(l_quantity, l_extendedprice) * count(*) AS s1y, covar_pop(l_discount, l_extendedprice) * count(*) AS s2y, var_pop(l_extendedprice) * count(*) AS syy FROM lineitem),
    b AS (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 ** 2) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 ** 2) AS b2 FROM s),
    f AS (SELECT *, syy - b1 * s1y - b2 * s2y AS rss, my - b1 * m1 - b2 * m2 AS b0 FROM b)"""


@query("ols_multiple", TWO + """ SELECT 'const' AS term, round(b0, 3) AS coef, NULL::DOUBLE AS t FROM f UNION ALL SELECT 'l_quantity', round(b1, 3), round(b1 / sqrt(rss / (n - 3) * s22 / (s11 * s22 - s12 ** 2)), 6) FROM f
    UNION ALL SELECT 'l_discount', round(b2, 3), round(b2 / sqrt(rss / (n - 3) * s11 / (s11 * s22 - s12 ** 2)), 6) FROM f""")
def ols_multiple(spark, d):
    s = reg.ols(li(spark, d), "l_extendedprice", ["l_quantity", "l_discount"]).summary()
    return s.select("term", r(F.col("coef"), 3, "coef"), F.when(F.col("term") != "const", F.round("t", 6)).alias("t"))


@query("ols_fit_stats", TWO + """ SELECT n, round(1 - rss / syy, 10) AS r2, round(1 - rss / syy * (n - 1) / (n - 3), 10) AS adj_r2, round(((syy - rss) / 2) / (rss / (n - 3)), 6) AS f,
    round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 6, 3) AS aic, round(n * (ln(2 * pi()) + ln(rss / n) + 1) + 3 * ln(n), 3) AS bic FROM f""")
def ols_fit_stats(spark, d):
    return pick(reg.ols(li(spark, d), "l_extendedprice", ["l_quantity", "l_discount"]).fit_stats(), n=None, r2=10, adj_r2=10, f=6, aic=3, bic=3)


@query("ols_polynomial")
def ols_polynomial(spark, d):
    return reg.polynomial_ols(li(spark, d), "l_extendedprice", "l_quantity", 2).summary()


@query("ols_no_intercept", "SELECT 'l_quantity' AS term, round(sum(l_quantity * l_extendedprice) / sum(l_quantity ** 2), 6) AS coef FROM lineitem")
def ols_no_intercept(spark, d):
    return pick(reg.ols(li(spark, d), "l_extendedprice", ["l_quantity"], intercept=False).summary(), term=None, coef=6)


@query("ols_standardized", "SELECT 'l_quantity' AS term, round(corr(l_quantity, l_extendedprice), 9) AS beta FROM lineitem")
def ols_standardized(spark, d):
    return pick(reg.ols(li(spark, d), "l_extendedprice", ["l_quantity"]).standardized(), term=None, beta=9)


@query("ols_residual_summary", """WITH e AS (SELECT l_extendedprice - a - b * l_quantity AS e FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem))
    SELECT round(stddev_samp(e), 4) AS std, round(min(e), 3) AS min, round(quantile_cont(e, 0.5), 3) AS median, round(max(e), 3) AS max FROM e""")
def ols_residual_summary(spark, d):
    return pick(reg.ols(li(spark, d), "l_extendedprice", ["l_quantity"]).residual_summary(), std=4, min=3, median=3, max=3)


EV = """WITH b AS (SELECT regr_intercept(value, user_id) AS a, regr_slope(value, user_id) AS b FROM events), e AS (SELECT event_id, user_id, value - a - b * user_id AS e FROM events, b)"""


@query("durbin_watson", EV + " SELECT round(sum((e - p) ** 2) / (SELECT sum(e * e) FROM e), 7) AS durbin_watson FROM (SELECT e, lag(e) OVER (ORDER BY event_id) AS p FROM e)")
def durbin_watson(spark, d):
    return pick(reg.ols(table(spark, d, "events"), "value", ["user_id"]).durbin_watson(["event_id"]), durbin_watson=7)


@query("ljung_box", EV + """, l AS (SELECT k, (SELECT sum(e * e) FROM e) AS c0, (SELECT count(*) FROM e) AS n, sum(e * p) AS ck FROM (SELECT k, e, lag(e, CAST(k AS INTEGER)) OVER (PARTITION BY k ORDER BY event_id) AS p FROM e CROSS JOIN (SELECT unnest(range(1, 11)) AS k)) GROUP BY k)
    SELECT CAST(k AS INTEGER) AS lag, round(n * (n + 2) * sum((ck / c0) ** 2 / (n - k)) OVER (ORDER BY k), 6) AS statistic FROM l""")
def ljung_box(spark, d):
    return pick(reg.ols(table(spark, d, "events"), "value", ["user_id"]).ljung_box(["event_id"]), lag=None, statistic=6)


@query("breusch_pagan", EV + " SELECT round(count(*) * regr_r2(e * e, user_id), 6) AS lm FROM e")
def breusch_pagan(spark, d):
    return pick(reg.ols(table(spark, d, "events"), "value", ["user_id"]).breusch_pagan(), lm=6)


@query("vif", """WITH s AS (SELECT sum(l_quantity ** 2) AS a, sum(l_discount ** 2) AS b, sum(l_quantity * l_discount) AS c FROM lineitem) SELECT 'l_quantity' AS term, round(a * b / (a * b - c * c), 7) AS vif FROM s UNION ALL SELECT 'l_discount', round(a * b / (a * b - c * c), 7) FROM s""")
def vif(spark, d):
    return pick(reg.vif(li(spark, d), ["l_quantity", "l_discount"]), term=None, vif=7)


@query("influence", """WITH s AS (SELECT count(*) AS n, avg(p_size) AS m, var_pop(p_size) * count(*) AS sxx, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM part),
    e AS (SELECT p_partkey, p_retailprice - a - b * p_size AS e, 1 / n + (p_size - m) ** 2 / sxx AS h, n FROM part, s), v AS (SELECT sum(e * e) / (count(*) - 2) AS mse FROM e)
    SELECT p_partkey, round(h, 9) AS leverage, round(e / sqrt(mse * (1 - h)), 7) AS student_internal, round(e * e / (mse * (1 - h)) * h / (1 - h) / 2, 9) AS cooks_d FROM e, v""")
def influence(spark, d):
    out = reg.ols(table(spark, d, "part"), "p_retailprice", ["p_size"]).influence(["p_partkey"])
    return pick(out, p_partkey=None, leverage=9, student_internal=7, cooks_d=9)


@query("stepwise_forward")
def stepwise_forward(spark, d):
    return reg.stepwise(li(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "forward").fit_stats()


@query("stepwise_backward")
def stepwise_backward(spark, d):
    return reg.stepwise(li(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "backward").summary()


@query("stepwise_both")
def stepwise_both(spark, d):
    return reg.stepwise(li(spark, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "both").summary()


@query("quantile_regression")
def quantile_regression(spark, d):
    return reg.quantile_regression(li(spark, d), "l_extendedprice", ["l_quantity"], 0.5).summary()


@query("huber_regression")
def huber_regression(spark, d):
    return reg.huber_regression(li(spark, d), "l_extendedprice", ["l_quantity"]).summary()


def _quality(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("kchars")), "doc_id")


@query("logit")
def logit(spark, d):
    return reg.logit(_quality(spark, d), "quality", ["kchars", "toxic"]).summary()


@query("logit_fit_stats")
def logit_fit_stats(spark, d):
    return reg.logit(_quality(spark, d), "quality", ["kchars"]).fit_stats()


@query("logit_metrics")
def logit_metrics(spark, d):
    return reg.logit_metrics(reg.logit(_quality(spark, d), "quality", ["kchars", "toxic"]))


@query("poisson_regression")
def poisson_regression(spark, d):
    return reg.glm(li(spark, d), "l_linenumber", ["l_quantity", "l_discount"]).summary()


@query("ancova")
def ancova(spark, d):
    return reg.ancova(li(spark, d), "l_extendedprice", "l_returnflag", ["l_quantity"])


@query("manova")
def manova(spark, d):
    return reg.manova(li(spark, d), ["l_quantity", "l_discount"], "l_returnflag")


# ---- multivariate ---------------------------------------------------------------

@query("pca_variance", """SELECT 'pc1' AS component, round(1 + abs(r), 9) AS variance, round((1 + abs(r)) / 2, 9) AS ratio FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)
    UNION ALL SELECT 'pc2', round(1 - abs(r), 9), round((1 - abs(r)) / 2, 9) FROM (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem)""")
def pca_variance(spark, d):
    n = F.lit(1.0)
    s = mv.pca(li(spark, d), ["l_quantity", "l_extendedprice"])
    total = s.total / 2  # n / (n - 1)
    return s.summary().select("component", r(F.col("variance") / total * n, 9, "variance"), r(F.col("ratio"), 9, "ratio"))


@query("pca_scores")
def pca_scores(spark, d):
    model = mv.pca(li(spark, d), LINE, 2)
    return model.transform(li(spark, d)).select("l_orderkey", "pc1", "pc2")


def vectors(spark, d):
    t = table(spark, d, "embeddings")
    size = len(t.select("embedding").first()[0])
    return t.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)]), [f"e{i}" for i in range(size)]


@query("pca_embeddings")
def pca_embeddings(spark, d):
    t, cols = vectors(spark, d)
    return mv.pca(t, cols, 5).summary()


@query("svd_embeddings")
def svd_embeddings(spark, d):
    t, cols = vectors(spark, d)
    return mv.truncated_svd(t, cols, 2).summary()


@query("factor_analysis")
def factor_analysis(spark, d):
    t, cols = vectors(spark, d)
    return mv.factor_analysis(t, cols[:10], 3).loadings()


@query("bartlett_sphericity", "SELECT count(*) AS n, round(-(count(*) - 1 - 9.0 / 6) * ln(1 - corr(l_quantity, l_extendedprice) ** 2), 7) AS chi2, CAST(1 AS BIGINT) AS df FROM lineitem")
def bartlett_sphericity(spark, d):
    return pick(mv.bartlett_sphericity(li(spark, d), ["l_quantity", "l_extendedprice"]), n=None, chi2=7, df=None)


@query("kmo", """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem),
    p AS (SELECT *, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS pa, (b - a * c) / sqrt((1 - a * a) * (1 - c * c)) AS pb, (c - a * b) / sqrt((1 - a * a) * (1 - b * b)) AS pc FROM r)
    SELECT 'overall' AS "column", round((a * a + b * b + c * c) / (a * a + b * b + c * c + pa * pa + pb * pb + pc * pc), 8) AS kmo FROM p""")
def kmo(spark, d):
    return pick(mv.kmo(li(spark, d), ["l_quantity", "l_extendedprice", "l_tax"]).filter('column = "overall"'), column=None, kmo=8)


@query("canonical_correlation", "SELECT CAST(1 AS INTEGER) AS number, round(abs(corr(l_quantity, l_extendedprice)), 9) AS correlation FROM lineitem")
def canonical_correlation(spark, d):
    return pick(mv.canonical_correlation(li(spark, d), ["l_quantity"], ["l_extendedprice"]), number=None, correlation=9)


# ---- time series ------------------------------------------------------------------

HOURLY = "SELECT date_trunc('hour', ts) AS h, avg(value) AS v FROM events GROUP BY 1"


def hourly(spark, d):
    return ts.resample(table(spark, d, "events"), "ts", "H", {"value": "mean"}).withColumnRenamed("value_mean", "v")


@query("acf", f"""WITH x AS ({HOURLY}), s AS (SELECT row_number() OVER (ORDER BY h) AS t, v - (SELECT avg(v) FROM x) AS v FROM x), k AS (SELECT unnest(range(0, 25)) AS k)
    SELECT CAST(k AS INTEGER) AS lag, round(sum(a.v * b.v) / (SELECT sum(v * v) FROM s), 8) AS acf FROM k JOIN s a ON true JOIN s b ON b.t = a.t - k GROUP BY k""")
def acf(spark, d):
    return pick(ts.acf(hourly(spark, d), "v", ["ts"], 24), lag=None, acf=8)


@query("pacf")
def pacf(spark, d):
    return ts.pacf(hourly(spark, d), "v", ["ts"], 24)


DEC = f"""WITH x AS ({HOURLY}), s AS (SELECT row_number() OVER (ORDER BY h) - 1 AS t, v FROM x),
    m AS (SELECT t, v, CASE WHEN count(*) OVER w = 25 THEN (sum(v) OVER w - 0.5 * (lag(v, 12) OVER (ORDER BY t) + lead(v, 12) OVER (ORDER BY t))) / 24 END AS trend FROM s WINDOW w AS (ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),"""


@query("decompose_additive", DEC + """ p AS (SELECT t % 24 AS ph, avg(v - trend) AS a FROM m GROUP BY 1), c AS (SELECT ph, a - (SELECT avg(a) FROM p) AS seasonal FROM p)
    SELECT t, round(v, 9) AS observed, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(v - trend - seasonal, 9) AS residual FROM m JOIN c ON ph = t % 24""")
def decompose_additive(spark, d):
    return pick(ts.decompose(hourly(spark, d), "v", ["ts"], 24), t=None, observed=9, trend=9, seasonal=9, residual=9)


@query("decompose_multiplicative", DEC + """ p AS (SELECT t % 24 AS ph, avg(v / trend) AS a FROM m GROUP BY 1), c AS (SELECT ph, a / (SELECT avg(a) FROM p) AS seasonal FROM p)
    SELECT t, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(v / (trend * seasonal), 9) AS residual FROM m JOIN c ON ph = t % 24""")
def decompose_multiplicative(spark, d):
    return pick(ts.decompose(hourly(spark, d), "v", ["ts"], 24, "multiplicative"), t=None, trend=9, seasonal=9, residual=9)


@query("adf")
def adf(spark, d):
    return ts.adf(hourly(spark, d), "v", ["ts"])


@query("kpss", f"""WITH x AS ({HOURLY}), s AS (SELECT row_number() OVER (ORDER BY h) AS t, v - (SELECT avg(v) FROM x) AS e FROM x), n AS (SELECT count(*) AS n, CAST(ceil(12 * (count(*) / 100) ** 0.25) AS BIGINT) AS l FROM s),
    c AS (SELECT a.t - b.t AS k, sum(a.e * b.e) AS g FROM s a JOIN s b ON a.t >= b.t, n WHERE a.t - b.t <= l GROUP BY 1)
    SELECT round((SELECT sum(q * q) FROM (SELECT sum(e) OVER (ORDER BY t) AS q FROM s)) / any_value(n) ** 2 / (sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (l + 1)) * g END) / any_value(n)), 8) AS statistic, any_value(l) AS lags FROM c, n""")
def kpss(spark, d):
    return pick(ts.kpss(hourly(spark, d), "v", ["ts"]), statistic=8, lags=None)


@query("resample_daily", "SELECT date_trunc('day', ts) AS ts, round(avg(value), 8) AS value_mean FROM events GROUP BY 1")
def resample_daily(spark, d):
    return pick(ts.resample(table(spark, d, "events"), "ts", "D", {"value": "mean"}), ts=None, value_mean=8)


@query("resample_quarterly", "SELECT date_trunc('quarter', o_orderdate) AS o_orderdate, round(sum(o_totalprice), 1) AS o_totalprice_sum FROM orders GROUP BY 1")
def resample_quarterly(spark, d):
    return pick(ts.resample(table(spark, d, "orders"), "o_orderdate", "Q", {"o_totalprice": "sum"}), o_orderdate=None, o_totalprice_sum=1)


@query("kaplan_meier", """WITH t AS (SELECT value AS time, CAST(sum(CAST(event_type <> 'error' AS INTEGER)) AS BIGINT) AS events, count(*) AS leaving FROM events GROUP BY 1),
    r AS (SELECT time, events, (SELECT count(*) FROM events) - sum(leaving) OVER (ORDER BY time) + leaving AS at_risk FROM t)
    SELECT time, CAST(at_risk AS BIGINT) AS at_risk, events, round(CASE WHEN at_risk = events THEN 0 ELSE exp(sum(CASE WHEN at_risk > events THEN ln((at_risk - events) / at_risk) ELSE 0 END) OVER (ORDER BY time)) END, 9) AS survival FROM r""")
def kaplan_meier(spark, d):
    t = table(spark, d, "events").select("value", (F.col("event_type") != "error").alias("e"))
    return pick(ts.kaplan_meier(t, "value", "e"), time=None, at_risk=None, events=None, survival=9)


@query("accelerated_failure")
def accelerated_failure(spark, d):
    t = table(spark, d, "events").filter("value > 0").select("value", (F.col("event_type") != "error").cast("double").alias("e"), F.col("user_id").cast("double").alias("u"))
    m = ts.accelerated_failure(t, "value", "e", ["u"])
    return spark.createDataFrame([("u", float(m.coefficients[0])), ("intercept", float(m.intercept)), ("scale", float(m.scale))], "term string, coef double")


@query("multinomial_logit", """WITH c AS (SELECT o_orderstatus AS k, count(*) FILTER (o_orderpriority <> '1-URGENT') AS a, count(*) FILTER (o_orderpriority = '1-URGENT') AS b FROM orders GROUP BY 1),
    r AS (SELECT a AS ra, b AS rb FROM c ORDER BY k LIMIT 1), t AS (SELECT k, ln(a / ra) AS const, ln(b / rb) - ln(a / ra) AS slope, sqrt(1 / a + 1 / ra) AS sc, sqrt(1 / a + 1 / ra + 1 / b + 1 / rb) AS ss FROM c, r WHERE k <> (SELECT min(k) FROM c))
    SELECT k AS "class", 'urgent' AS term, round(slope, 6) AS coef, round(ss, 6) AS se, round(slope / ss, 4) AS z FROM t UNION ALL SELECT k, 'const', round(const, 6), round(sc, 6), round(const / sc, 4) FROM t""")
def multinomial_logit(spark, d):
    from abacist.operators.multinomial import multinomial_logit as fit

    t = table(spark, d, "orders").select("o_orderstatus", (F.col("o_orderpriority") == "1-URGENT").cast("double").alias("urgent"))
    return pick(fit(t, "o_orderstatus", ["urgent"]).summary(), **{"class": None, "term": None, "coef": 6, "se": 6, "z": 4})
