"""Profiles, frequencies, quality, outliers, chart data."""

from pyspark.sql import functions as F

from abacist.catalog.base import query, r, rounded, table
from abacist.operators import charts, clean, describe, frequency, profile
from abacist.sources.readers import upload_summary

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _union(columns, text):
    return " UNION ALL ".join(text.replace("{c}", c) for c in columns)


DESCRIBE_SQL = _union(
    LINE,
    """SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing,
    round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max,
    round(max({c}) - min({c}), 4) AS "range", round(quantile_cont({c}, 0.5), 4) AS median,
    round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
    round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr,
    round(quantile_cont({c}, 0.05), 4) AS p5, round(quantile_cont({c}, 0.99), 4) AS p99,
    round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis,
    round(stddev_samp({c}) / sqrt(count({c})), 6) AS sem, round(stddev_samp({c}) / avg({c}) * 100, 6) AS cv,
    round(exp(avg(ln({c})) FILTER ({c} > 0)), 4) AS geometric_mean,
    round(count(*) FILTER ({c} > 0) / (sum(1.0 / nullif({c}, 0)) FILTER ({c} > 0)), 4) AS harmonic_mean,
    (SELECT {c} FROM lineitem GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode
    FROM lineitem""",
)


@query("describe_numeric", DESCRIBE_SQL)
def describe_numeric(spark, d):
    out = describe.describe_numeric(table(spark, d, "lineitem"), LINE, include_advanced=True)
    six = ("skewness", "kurtosis", "sem", "cv")
    four = ("mean", "std", "min", "max", "range", "median", "q1", "q3", "iqr", "p5", "p99", "geometric_mean", "harmonic_mean")
    return out.select(
        "column", "count", "missing", *[r(F.col(c), 4, c) for c in four], *[r(F.col(c), 6, c) for c in six], "mode"
    )


@query(
    "mean_absolute_deviation",
    _union(LINE, """SELECT '{c}' AS "column", round(avg(abs({c} - (SELECT avg({c}) FROM lineitem))), 5) AS mad FROM lineitem"""),
)
def mean_absolute_deviation(spark, d):
    li = table(spark, d, "lineitem")
    means = li.agg(*[F.avg(c).alias(c) for c in LINE]).first().asDict()
    mad = describe.mean_absolute_deviations(li, means)
    return rounded(spark.createDataFrame(list(mad.items()), "column string, mad double"), 5)


@query(
    "trimmed_mean",
    _union(
        LINE,
        """SELECT '{c}' AS "column", round(avg({c}), 5) AS trimmed_mean FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS k,
        count(*) OVER () AS n FROM lineitem) WHERE k > floor(0.1 * n) AND k <= n - floor(0.1 * n)""",
    ),
)
def trimmed_mean(spark, d):
    out = describe.trimmed_means(table(spark, d, "lineitem"), LINE)
    return rounded(spark.createDataFrame(list(out.items()), "column string, trimmed_mean double"), 5)


NULLABLE = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END"


@query(
    "describe_nullable",
    f"""SELECT 'price' AS "column", count(v) AS count, count(*) - count(v) AS missing, round(100.0 * (count(*) - count(v)) / count(*), 6) AS missing_pct,
    round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(var_samp(v) / 1e6, 4) AS variance_m, round(quantile_cont(v, 0.5), 4) AS median
    FROM (SELECT {NULLABLE} AS v FROM orders)""",
)
def describe_nullable(spark, d):
    o = table(spark, d, "orders").select(F.expr(NULLABLE).alias("price"))
    out = describe.describe_numeric(o, ["price"], include_advanced=False, include_mode=False)
    return out.select(
        "column", "count", "missing", r(F.col("missing_pct"), 6, "missing_pct"), r(F.col("mean"), 4, "mean"),
        r(F.col("std"), 4, "std"), r(F.col("variance") / 1e6, 4, "variance_m"), r(F.col("median"), 4, "median"),
    )


@query(
    "describe_table",
    _union(
        ["o_totalprice"],
        """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min,
        round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75,
        round(max({c}), 4) AS max FROM orders""",
    ),
)
def describe_table(spark, d):
    return rounded(describe.describe_table(table(spark, d, "orders"), ["o_totalprice"]), 4)


@query("confidence_intervals")
def confidence_intervals(spark, d):
    out = describe.describe_numeric(table(spark, d, "lineitem"), LINE, include_mode=False)
    return out.select("column", "mean", "sem", "ci95_low", "ci95_high", "ci99_low", "ci99_high")


IQR_SQL = """SELECT '{c}' AS "column", round(lo, 4) AS low, round(hi, 4) AS high, count({c}) AS n,
    count(*) FILTER ({c} < lo OR {c} > hi) AS outliers, round(100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count({c}), 5) AS pct
    FROM {t}, (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
    quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {t}) GROUP BY lo, hi"""


@query("iqr_outliers", " UNION ALL ".join(IQR_SQL.replace("{c}", c).replace("{t}", "events") for c in ["value"]) + " UNION ALL " + IQR_SQL.replace("{c}", "n_chars").replace("{t}", "documents"))
def iqr_outliers(spark, d):
    a = profile.column_outliers(table(spark, d, "events"), ["value"])
    b = profile.column_outliers(table(spark, d, "documents"), ["n_chars"])
    return a.union(b).select("column", r(F.col("low"), 4, "low"), r(F.col("high"), 4, "high"), "n", "outliers", r(F.col("pct"), 5, "pct"))


CAT_SQL = """SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "unique",
    round(100.0 * count(DISTINCT {c}) / count(*), 6) AS unique_pct,
    (SELECT {c} FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode,
    (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_freq,
    round(entropy({c}) * ln(2), 8) AS entropy FROM {t}"""


@query(
    "describe_categorical",
    " UNION ALL ".join(CAT_SQL.replace("{c}", c).replace("{t}", "orders") for c in ("o_orderstatus", "o_orderpriority")),
)
def describe_categorical(spark, d):
    out = describe.describe_categorical(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return out.select("column", "count", "missing", "unique", r(F.col("unique_pct"), 6, "unique_pct"), "mode", "mode_freq", r(F.col("entropy"), 8, "entropy"))


@query(
    "top_values",
    """SELECT p_type AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM part), 6) AS pct
    FROM part GROUP BY p_type ORDER BY n DESC, value LIMIT 10""",
)
def top_values(spark, d):
    return rounded(describe.top_values(table(spark, d, "part"), "p_type", 10), 6)


@query(
    "missing_counts",
    """SELECT 'o_orderkey' AS "column", count(*) AS rows, 0::BIGINT AS missing, 0.0::DOUBLE AS missing_pct FROM orders UNION ALL
    SELECT 'price', count(*), count(*) - count(v), round(100.0 * (count(*) - count(v)) / count(*), 6) FROM (SELECT """
    + NULLABLE
    + """ AS v FROM orders)""",
)
def missing_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr(NULLABLE).alias("price"))
    return rounded(describe.missing_counts(o), 6)


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", count({c}) AS count, round(count(DISTINCT {c}) / count({c}), 8) AS unique_ratio FROM lineitem"""
        for c in ("l_orderkey", "l_extendedprice", "l_returnflag")
    ),
)
def distinct_counts(spark, d):
    return rounded(describe.distinct_counts(table(spark, d, "lineitem"), ["l_orderkey", "l_extendedprice", "l_returnflag"]), 8)


@query("distinct_counts_approx")
def distinct_counts_approx(spark, d):
    return describe.distinct_counts(table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], approx=True)


@query("unique_levels", "SELECT DISTINCT c_mktsegment FROM customer")
def unique_levels(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").filter("c_mktsegment IS NOT NULL").distinct()


@query(
    "group_summary",
    """SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std,
    round(stddev_samp(l_extendedprice) / sqrt(count(*)), 5) AS sem, min(l_extendedprice) AS min, max(l_extendedprice) AS max,
    round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3
    FROM lineitem GROUP BY l_returnflag""",
)
def group_summary(spark, d):
    out = describe.group_summary(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", quantiles=True)
    return out.select("l_returnflag", "n", *[r(F.col(c), k, c) for c, k in (("mean", 4), ("std", 4), ("sem", 5))], "min", "max", *[r(F.col(c), 4, c) for c in ("q1", "median", "q3")])


@query(
    "grouped_quantiles_ordered",
    """SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS median, round(quantile_cont(o_totalprice, 0.9), 4) AS p90 FROM orders GROUP BY o_custkey""",
)
def grouped_quantiles_ordered(spark, d):
    from abacist.plans.quantiles import grouped_quantiles

    # direct_rows=0: the ordered plan that large inputs take.
    out = grouped_quantiles(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", (0.5, 0.9), ("median", "p90"), direct_rows=0)
    return rounded(out, 4)


@query(
    "quantiles_by_refinement",
    _union(LINE, """SELECT '{c}' AS "column", round(quantile_cont({c}, 0.1), 4) AS q10, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.9), 4) AS q90 FROM lineitem"""),
)
def quantiles_by_refinement(spark, d):
    from abacist.plans.quantiles import exact_quantiles

    q = exact_quantiles(table(spark, d, "lineitem"), LINE, (0.1, 0.5, 0.9), direct_rows=0)
    return rounded(spark.createDataFrame([(c, *v) for c, v in q.items()], "column string, q10 double, q50 double, q90 double"), 4)


@query(
    "aggregate_groups",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean,
    count(l_quantity) AS l_quantity_count, max(l_extendedprice) AS l_extendedprice_max, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std
    FROM lineitem GROUP BY ALL""",
)
def aggregate_groups(spark, d):
    out = describe.aggregate(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"],
        {"l_quantity": ["sum", "mean", "count"], "l_extendedprice": ["max", "std"]},
    )
    return out.withColumns({
        "l_quantity_sum": F.round("l_quantity_sum", 2), "l_quantity_mean": F.round("l_quantity_mean", 6),
        "l_extendedprice_std": F.round("l_extendedprice_std", 4),
    })


@query(
    "categorical_frequency",
    """SELECT value, n, round(100.0 * n / sum(n) OVER (), 6) AS pct, CAST(sum(n) OVER w AS BIGINT) AS cumulative,
    round(100.0 * sum(n) OVER w / sum(n) OVER (), 6) AS cumulative_pct
    FROM (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1) WINDOW w AS (ORDER BY n DESC, value)""",
)
def categorical_frequency(spark, d):
    return rounded(frequency.categorical_frequency(table(spark, d, "part"), "p_brand"), 6)


HIST_SQL = """WITH b AS (SELECT min({c}) AS lo, max({c}) AS hi, count({c}) AS n FROM {t}),
    k AS (SELECT unnest(range(0, {k})) AS bin),
    h AS (SELECT CAST(least(floor(({c} - lo) / (hi - lo) * {k}), {k} - 1) AS INTEGER) AS bin, count(*) AS n FROM {t}, b GROUP BY 1)"""


@query(
    "histogram",
    HIST_SQL.replace("{c}", "value").replace("{t}", "events").replace("{k}", "20")
    + """ SELECT CAST(k.bin AS INTEGER) AS bin, round(lo + k.bin * (hi - lo) / 20, 6) AS low, round(lo + (k.bin + 1) * (hi - lo) / 20, 6) AS high,
    coalesce(h.n, 0) AS n, round(coalesce(h.n, 0) / b.n, 8) AS relative, CAST(sum(coalesce(h.n, 0)) OVER (ORDER BY k.bin) AS BIGINT) AS cumulative
    FROM k CROSS JOIN b LEFT JOIN h ON h.bin = k.bin""",
)
def histogram(spark, d):
    out = frequency.histogram(table(spark, d, "events"), "value", 20)
    return out.select("bin", r(F.col("low"), 6, "low"), r(F.col("high"), 6, "high"), "n", r(F.col("relative"), 8, "relative"), "cumulative")


@query(
    "histogram_auto",
    HIST_SQL.replace("{c}", "p_retailprice").replace("{t}", "part").replace("{k}", "(SELECT least(50, CAST(floor(sqrt(count(*))) AS BIGINT)) FROM part)")
    + """ SELECT CAST(k.bin AS INTEGER) AS bin, coalesce(h.n, 0) AS n FROM k LEFT JOIN h ON h.bin = k.bin""",
)
def histogram_auto(spark, d):
    return frequency.histogram(table(spark, d, "part"), "p_retailprice").select("bin", "n")


@query(
    "contingency",
    """SELECT a.o_orderstatus, b.o_orderpriority, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) a
    CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) b LEFT JOIN orders o ON o.o_orderstatus = a.o_orderstatus AND o.o_orderpriority = b.o_orderpriority
    GROUP BY ALL""",
)
def contingency(spark, d):
    return frequency.contingency(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query(
    "pivot_mean",
    """SELECT l_returnflag, round(avg(l_extendedprice) FILTER (l_linestatus = 'F'), 4) AS F, round(avg(l_extendedprice) FILTER (l_linestatus = 'O'), 4) AS O
    FROM lineitem GROUP BY l_returnflag""",
)
def pivot_mean(spark, d):
    return rounded(frequency.pivot_table(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_extendedprice"), 4)


@query(
    "pivot_margins",
    """SELECT coalesce(l_returnflag, 'All') AS l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS F,
    round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS O, round(avg(l_quantity), 6) AS "All" FROM lineitem GROUP BY ROLLUP (l_returnflag)""",
)
def pivot_margins(spark, d):
    return rounded(frequency.pivot_table(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", margins=True), 6)


@query("upload_summary", """SELECT 'p_partkey' AS "column", 'bigint' AS data_type, 'integer' AS kind, count(*) AS rows, count(*) - count(p_partkey) AS missing FROM part
    UNION ALL SELECT 'p_name', 'string', 'categorical', count(*), count(*) - count(p_name) FROM part
    UNION ALL SELECT 'p_retailprice', 'double', 'numeric', count(*), count(*) - count(p_retailprice) FROM part""")
def upload_summary_query(spark, d):
    return upload_summary(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"))


@query("column_types")
def column_types(spark, d):
    return upload_summary(table(spark, d, "events")).select("column", "kind")


@query("preview", "SELECT event_id, event_type, value FROM events ORDER BY event_id LIMIT 10")
def preview(spark, d):
    return clean.subset(table(spark, d, "events"), ["event_id", "event_type", "value"], 10, ["event_id"])


@query("sorted_customers", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def sorted_customers(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


# ---- quality -----------------------------------------------------------

@query(
    "infer_roles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CASE WHEN u = 2 THEN 'binary' WHEN {num} AND u / n < 0.05 AND u < 20 THEN 'ordinal' WHEN {num} THEN 'numeric'
        WHEN u / n < 0.5 THEN 'categorical' ELSE 'text' END AS role FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n FROM lineitem)"""
        for c, num in (("l_orderkey", "true"), ("l_linenumber", "true"), ("l_returnflag", "false"), ("l_linestatus", "false"), ("l_discount", "true"))
    )
    + """ UNION ALL SELECT 'l_shipdate', 'datetime'""",
)
def infer_roles(spark, d):
    cols = ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount", "l_shipdate"]
    return profile.infer_roles(table(spark, d, "lineitem").select(*cols)).select("column", "role")


@query(
    "duplicate_rows",
    """SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n - 1) AS BIGINT) AS duplicates, round(sum(n - 1) / sum(n), 8) AS rate
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""",
)
def duplicate_rows(spark, d):
    return rounded(profile.duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")), 8)


@query("id_candidates", """SELECT 'event_id' AS "column" FROM events HAVING count(DISTINCT event_id) = count(*)
    UNION ALL SELECT 'user_id' FROM events HAVING count(DISTINCT user_id) = count(*)""")
def id_candidates(spark, d):
    return profile.id_candidates(table(spark, d, "events"), ["event_id", "user_id"])


@query("mixed_text", r"""SELECT 'props' AS "column", bool_or(regexp_matches(props, '^\d+$')) AND bool_or(regexp_matches(props, '^[a-zA-Z]+$')) AS mixed FROM events
    UNION ALL SELECT 'event_type', bool_or(regexp_matches(event_type, '^\d+$')) AND bool_or(regexp_matches(event_type, '^[a-zA-Z]+$')) FROM events""")
def mixed_text(spark, d):
    return profile.mixed_text(table(spark, d, "events"), ["props", "event_type"])


QUALITY = "SELECT o_orderpriority, " + NULLABLE + " AS price, o_custkey FROM orders"


@query(
    "quality_scores",
    f"""WITH t AS ({QUALITY}), q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b, quantile_cont(o_custkey, 0.25) AS c, quantile_cont(o_custkey, 0.75) AS e FROM t),
    o AS (SELECT (CASE WHEN count(*) FILTER (price < a - 1.5 * (b - a) OR price > b + 1.5 * (b - a)) > 0 THEN 1 ELSE 0 END
      + CASE WHEN count(*) FILTER (o_custkey < c - 1.5 * (e - c) OR o_custkey > e + 1.5 * (e - c)) > 0 THEN 1 ELSE 0 END) AS bad FROM t, q),
    s AS (SELECT 1 - (SELECT count(*) - count(price) FROM t) / (SELECT 3 * count(*) FROM t) AS completeness, 1 - (SELECT bad FROM o) / 2.0 AS validity,
      1 - (SELECT sum(n - 1) / sum(n) FROM (SELECT count(*) AS n FROM t GROUP BY ALL, o_orderpriority, price, o_custkey)) AS uniqueness, 1.0 AS consistency)
    SELECT round(completeness, 8) AS completeness, round(CAST(validity AS DOUBLE), 8) AS validity, round(uniqueness, 8) AS uniqueness, CAST(consistency AS DOUBLE) AS consistency,
    round(25.0 * (completeness + validity + uniqueness + consistency), 6) AS overall FROM s""".replace("GROUP BY ALL, ", "GROUP BY "),
)
def quality_scores(spark, d):
    out = profile.quality_scores(table(spark, d, "orders").select("o_orderpriority", F.expr(NULLABLE).alias("price"), "o_custkey"))
    return rounded(out, 8, ["completeness", "validity", "uniqueness"]).withColumn("overall", F.round("overall", 6))


@query("quality_recommendations")
def quality_recommendations(spark, d):
    o = table(spark, d, "orders").select("o_orderpriority", F.expr(NULLABLE).alias("price"))
    return profile.quality_report(o)["recommendations"]


@query(
    "dataset_statistics",
    """SELECT count(*) AS rows, CAST(2 AS INTEGER) AS columns, CAST(0 AS BIGINT) AS missing_cells, 0.0::DOUBLE AS missing_cells_pct,
    count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_rows FROM lineitem""",
)
def dataset_statistics(spark, d):
    return profile.dataset_statistics(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("validate_table", f"""SELECT 'price' AS "column", 'more than half missing' AS issue FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS price FROM orders) HAVING count(price) < 0.5 * count(*) AND count(price) > 0""")
def validate_table(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END").alias("price"))
    return profile.validate_table(o)


@query(
    "validate_numeric",
    """SELECT 'v' AS "column", count(*) FILTER (isinf(v)) AS infinite, count(*) FILTER (isnan(v)) AS nan, count(*) FILTER (v IS NULL) AS missing
    FROM (SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)""",
)
def validate_numeric(spark, d):
    v = F.expr("CASE WHEN o_orderkey % 11 = 0 THEN double('Infinity') WHEN o_orderkey % 7 = 0 THEN double('NaN') WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END")
    return profile.validate_numeric(table(spark, d, "orders").select(v.alias("v")), ["v"]).select("column", "infinite", "nan", "missing")


@query(
    "validate_categorical",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS "unique", round(count(DISTINCT {c}) / count({c}), 8) AS unique_ratio, count(DISTINCT {c}) / count({c}) > 0.9 AS high_cardinality,
        count(DISTINCT {c}) = count({c}) AS all_unique, count(*) FILTER ({c} = '') AS empty FROM customer"""
        for c in ("c_name", "c_mktsegment")
    ),
)
def validate_categorical(spark, d):
    return rounded(profile.validate_categorical(table(spark, d, "customer"), ["c_name", "c_mktsegment"]), 8)


@query(
    "validate_rules",
    r"""SELECT 'l_discount' AS "column", 'range' AS rule, count(*) FILTER (l_discount < 0.01 OR l_discount > 0.09) AS violations, count(*) FILTER (l_discount < 0.01 OR l_discount > 0.09) = 0 AS passed FROM lineitem
    UNION ALL SELECT 'l_returnflag', 'pattern', count(*) FILTER (NOT regexp_matches(l_returnflag, '^[AN]$')), count(*) FILTER (NOT regexp_matches(l_returnflag, '^[AN]$')) = 0 FROM lineitem
    UNION ALL SELECT 'l_tax', 'not_null', count(*) - count(l_tax), count(*) - count(l_tax) = 0 FROM lineitem
    UNION ALL SELECT 'l_orderkey', 'unique', count(l_orderkey) - count(DISTINCT l_orderkey), count(l_orderkey) = count(DISTINCT l_orderkey) FROM lineitem""",
)
def validate_rules(spark, d):
    return clean.validate_rules(
        table(spark, d, "lineitem"),
        [
            {"column": "l_discount", "rule": "range", "min": 0.01, "max": 0.09},
            {"column": "l_returnflag", "rule": "pattern", "pattern": "^[AN]$"},
            {"column": "l_tax", "rule": "not_null"},
            {"column": "l_orderkey", "rule": "unique"},
        ],
    )


@query(
    "zscore_outliers",
    """SELECT event_id, 'value' AS "column", value, abs(value - m) / s > 3 AS is_outlier FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""",
)
def zscore_outliers(spark, d):
    return profile.detect_outliers(table(spark, d, "events"), ["value"], "event_id", "zscore")


@query(
    "mad_outliers",
    """WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events), k AS (SELECT quantile_cont(abs(value - med), 0.5) AS mad FROM events, m)
    SELECT 'value' AS "column", count(*) AS n, count(*) FILTER (0.6745 * abs(value - med) / mad > 3.5) AS outliers FROM events, m, k""",
)
def mad_outliers(spark, d):
    flagged = profile.detect_outliers(table(spark, d, "events"), ["value"], "event_id", "mad")
    return profile.outlier_summary(flagged).select("column", "n", "outliers")


@query(
    "iqr_outlier_rows",
    """SELECT doc_id, CAST(n_chars AS DOUBLE) AS value FROM documents, (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents)
    WHERE n_chars < a - 1.5 * (b - a) OR n_chars > b + 1.5 * (b - a)""",
)
def iqr_outlier_rows(spark, d):
    return profile.detect_outliers(table(spark, d, "documents"), ["n_chars"], "doc_id").filter("is_outlier").select("doc_id", "value")


# ---- chart data --------------------------------------------------------

@query(
    "chart_histogram",
    HIST_SQL.replace("{c}", "value").replace("{t}", "events").replace("{k}", "30") + " SELECT CAST(k.bin AS INTEGER) AS bin, coalesce(h.n, 0) AS n FROM k LEFT JOIN h ON h.bin = k.bin",
)
def chart_histogram(spark, d):
    return charts.histogram_data(table(spark, d, "events"), "value").select("bin", "n")


@query("chart_scatter_r", "SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem")
def chart_scatter_r(spark, d):
    return rounded(charts.scatter_correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), 8)


@query("chart_scatter_points", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def chart_scatter_points(spark, d):
    return charts.scatter_points(table(spark, d, "orders"), "o_custkey", "o_totalprice", "o_orderkey")


@query(
    "chart_box",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS b FROM events)
    SELECT 'value' AS "column", round(any_value(a), 6) AS q1, round(any_value(m), 6) AS median, round(any_value(b), 6) AS q3, min(value) FILTER (value >= a - 1.5 * (b - a)) AS whisker_low,
    max(value) FILTER (value <= b + 1.5 * (b - a)) AS whisker_high, count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS outliers FROM events, q""",
)
def chart_box(spark, d):
    return rounded(charts.box_data(table(spark, d, "events"), ["value"]), 6, ["q1", "median", "q3"])


@query("chart_bar", "SELECT c_mktsegment, round(avg(c_acctbal), 5) AS c_acctbal FROM customer GROUP BY c_mktsegment")
def chart_bar(spark, d):
    return rounded(charts.bar_data(table(spark, d, "customer"), "c_mktsegment", "c_acctbal"), 5)


@query("chart_line", "SELECT event_id, value FROM events ORDER BY event_id")
def chart_line(spark, d):
    return charts.line_data(table(spark, d, "events"), "event_id", ["value"])


@query("chart_line_averaged")
def chart_line_averaged(spark, d):
    return charts.line_averaged(table(spark, d, "events"), "ts", ["value"], 500)


PAIRS = [(a, b) for a in LINE for b in LINE]


@query(
    "chart_heatmap",
    " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, " + f"round(corr({a}, {b}), 8)" + " AS r FROM lineitem" for a, b in PAIRS if a != b)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT '{a}', '{a}', 1.0::DOUBLE" for a in LINE),
)
def chart_heatmap(spark, d):
    return rounded(charts.heatmap_data(table(spark, d, "lineitem"), LINE), 8)


@query(
    "chart_grid",
    """WITH b AS (SELECT min(l_quantity) AS xl, max(l_quantity) AS xh, min(l_discount) AS yl, max(l_discount) AS yh FROM lineitem)
    SELECT CAST(least(floor(20 * (l_quantity - xl) / (xh - xl)), 19) AS INTEGER) AS bx, CAST(least(floor(20 * (l_discount - yl) / (yh - yl)), 19) AS INTEGER) AS by, count(*) AS n FROM lineitem, b GROUP BY ALL""",
)
def chart_grid(spark, d):
    return charts.grid_2d(table(spark, d, "lineitem"), "l_quantity", "l_discount")


def _report_sql(numeric, text):
    """What a report says of each column of customer."""
    rows = []
    for c, kind in numeric:
        rows.append(f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS rows, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median,
            round(quantile_cont({c}, 0.99), 6) AS p99, CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top FROM customer""")
    for c in text:
        rows.append(f"""SELECT '{c}', 'categorical', count(*), count(*) - count({c}), NULL, NULL, NULL, count(DISTINCT {c}),
            (SELECT {c} FROM customer WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) FROM customer""")
    return " UNION ALL ".join(rows)


@query("summary_report", _report_sql([("c_custkey", "integer"), ("c_nationkey", "integer"), ("c_acctbal", "numeric")], ["c_name", "c_mktsegment"]))
def summary_report_query(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_name", "c_mktsegment")
    report = describe.summary_report(t)
    numeric = report["numeric"].select("column", r(F.col("mean"), 6, "mean"), r(F.col("median"), 6, "median"), r(F.col("p99"), 6, "p99"))
    text = report["categorical"].select("column", "unique", F.col("mode").alias("top"))
    return report["columns"].select("column", "kind", "rows", "missing").join(numeric, "column", "left").join(text, "column", "left")
