"""Filters, cleaning, transforms, ordered operators, joins and reshaping."""

from pyspark.sql import functions as F

from abacist.catalog.base import query, r, rounded, table
from abacist.functions import columns as X
from abacist.operators import clean, describe, frequency, ordered, reshape, transform
from abacist.sources import readers, writers

GAPPY = "CASE WHEN event_id % 5 IN (1, 2) OR event_id < 3 THEN NULL ELSE value END"


def gappy_events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.expr(GAPPY).alias("v"))


# ---- filters and cleaning ----------------------------------------------

@query("filter_equal", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_equal(spark, d):
    return clean.filter_rows(table(spark, d, "orders"), [{"column": "o_orderstatus", "op": "eq", "value": "F"}]).select("o_orderkey", "o_totalprice")


@query("filter_and", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> 'P'")
def filter_and(spark, d):
    spec = [
        {"column": "o_totalprice", "op": "between", "value": (1000, 90000)},
        {"column": "o_orderpriority", "op": "in", "value": ["1-URGENT", "2-HIGH"]},
        {"column": "o_orderstatus", "op": "ne", "value": "P"},
    ]
    return clean.filter_rows(table(spark, d, "orders"), spec).select("o_orderkey")


@query("filter_or", "SELECT p_partkey FROM part WHERE p_name LIKE 'small%' OR p_size > 45 OR p_brand IS NULL")
def filter_or(spark, d):
    spec = [
        {"column": "p_name", "op": "like", "value": "small%"},
        {"column": "p_size", "op": "gt", "value": 45},
        {"column": "p_brand", "op": "isnull"},
    ]
    return clean.filter_rows(table(spark, d, "part"), spec, "or").select("p_partkey")


@query("filter_outside", "SELECT event_id, value FROM events WHERE value < 1 OR value > 50")
def filter_outside(spark, d):
    return clean.outside(table(spark, d, "events"), "value", 1, 50).select("event_id", "value")


@query("drop_missing", f"SELECT event_id, v FROM (SELECT event_id, {GAPPY} AS v FROM events) WHERE v IS NOT NULL")
def drop_missing(spark, d):
    return clean.drop_missing(gappy_events(spark, d), ["v"]).select("event_id", "v")


@query("align_complete", f"SELECT count(*) AS n FROM (SELECT {GAPPY} AS v, user_id FROM events) WHERE v IS NOT NULL AND user_id IS NOT NULL")
def align_complete(spark, d):
    return reshape.align(gappy_events(spark, d), ["v"], "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("select_kind", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def select_kind(spark, d):
    return clean.select_kind(table(spark, d, "lineitem"), "numeric")


@query(
    "clean_table",
    """SELECT CAST(p_size AS DOUBLE) AS size_text, trim(p_name) AS padded, p_brand || CAST(p_size AS VARCHAR) AS mixed FROM part""",
)
def clean_table(spark, d):
    dirty = table(spark, d, "part").select(
        F.col("p_partkey").alias("Unnamed: 0"),
        F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("size_text"),
        F.concat(F.lit("  "), "p_name", F.lit(" ")).alias("padded"),
        F.concat("p_brand", F.col("p_size").cast("string")).alias("mixed"),
    )
    return clean.clean_table(dirty)


@query("clean_column_names", 'SELECT c_custkey AS col_1st_key, c_name AS customer_name, c_acctbal AS balance FROM customer')
def clean_column_names(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return clean.clean_column_names(t.toDF("1st key", "customer name", "balance$"))


@query("regex_replace", r"SELECT p_partkey, regexp_replace(p_brand, '[^0-9]+', '', 'g') AS p_brand, regexp_matches(p_type, '^[a-zA-Z]+$') AS letters FROM part")
def regex_replace(spark, d):
    out = clean.replace_values(table(spark, d, "part"), "p_brand", "[^0-9]+", "")
    return out.select("p_partkey", "p_brand", F.col("p_type").rlike("^[a-zA-Z]+$").alias("letters"))


# ---- scalar functions ---------------------------------------------------

@query("safe_divide", "SELECT o_orderkey, coalesce(round(o_totalprice / nullif(o_orderkey % 4, 0), 4), 0.0) AS ratio FROM orders")
def safe_divide(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(X.safe_divide(F.col("o_totalprice"), F.col("o_orderkey") % 4), 4).alias("ratio"))


@query("log_sqrt_power", "SELECT p_partkey, round(ln(p_retailprice + 1), 8) AS p_retailprice_log, round(sqrt(p_retailprice), 8) AS p_retailprice_sqrt, round(pow(p_size, 2), 4) AS p_size_2, round(pow(p_size, 3), 4) AS p_size_3 FROM part")
def log_sqrt_power(spark, d):
    out = transform.log_transform(table(spark, d, "part"), ["p_retailprice"])
    out = transform.polynomial(transform.sqrt_transform(out, ["p_retailprice"]), ["p_size"], 3)
    return out.select(
        "p_partkey", r(F.col("p_retailprice_log"), 8, "p_retailprice_log"), r(F.col("p_retailprice_sqrt"), 8, "p_retailprice_sqrt"),
        r(F.col("`p_size^2`"), 4, "p_size_2"), r(F.col("`p_size^3`"), 4, "p_size_3"),
    )


@query("interactions", f"""SELECT event_id, round(coalesce(v, 1) * user_id, 4) AS v_x_user_id, round(coalesce(v, 1) * event_id, 4) AS v_x_event_id, user_id * event_id AS user_id_x_event_id,
    round(coalesce(v, 1) * user_id * event_id, 4) AS v_x_user_id_x_event_id FROM (SELECT event_id, user_id, {GAPPY} AS v FROM events)""")
def interactions(spark, d):
    out = transform.interactions(gappy_events(spark, d), ["v", "user_id", "event_id"], 3)
    return rounded(out.drop("v", "user_id"), 4)


@query("row_hashes")
def row_hashes(spark, d):
    t = table(spark, d, "customer")
    return t.select("c_custkey", X.row_hash(t).alias("hash"))


@query("table_fingerprint")
def table_fingerprint(spark, d):
    return X.fingerprint(table(spark, d, "lineitem"))


# ---- scaling, encoding, imputing, binning -------------------------------

SCALE = "SELECT o_orderkey, round({expr}, 8) AS o_totalprice FROM orders, (SELECT {stats} FROM orders)"


@query("normalize_zscore", SCALE.format(expr="(o_totalprice - m) / s", stats="avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s"))
def normalize_zscore(spark, d):
    return rounded(transform.normalize(table(spark, d, "orders"), ["o_totalprice"]).select("o_orderkey", "o_totalprice"), 8)


@query("normalize_minmax", SCALE.format(expr="(o_totalprice - m) / (s - m)", stats="min(o_totalprice) AS m, max(o_totalprice) AS s"))
def normalize_minmax(spark, d):
    return rounded(transform.normalize(table(spark, d, "orders"), ["o_totalprice"], "minmax").select("o_orderkey", "o_totalprice"), 8)


@query("normalize_robust", SCALE.format(expr="(o_totalprice - m) / (b - a)", stats="quantile_cont(o_totalprice, 0.5) AS m, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b"))
def normalize_robust(spark, d):
    return rounded(transform.normalize(table(spark, d, "orders"), ["o_totalprice"], "robust").select("o_orderkey", "o_totalprice"), 8)


@query(
    "one_hot",
    "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS c_mktsegment_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer",
)
def one_hot(spark, d):
    return transform.one_hot(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@query("label_encode_keys", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS INTEGER) AS code FROM orders")
def label_encode_keys(spark, d):
    data = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("code"))
    return transform.label_encode(data, ["code"])


# A column with NULL and NaN: both are missing.
HOLED = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)"


def _holed(spark, d):
    v = F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN double('NaN') ELSE o_totalprice END")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", v.alias("v"))


@query("holed_missing", f"SELECT 'v' AS \"column\", count(*) AS rows, count(*) - count(v) AS missing FROM {HOLED}")
def holed_missing(spark, d):
    return describe.missing_counts(_holed(spark, d), ["v"]).select("column", "rows", "missing")


@query("holed_drop", f"SELECT o_orderkey, o_custkey, v FROM {HOLED} WHERE v IS NOT NULL")
def holed_drop(spark, d):
    return clean.drop_missing(_holed(spark, d))


@query("holed_forward", f"SELECT o_orderkey, last_value(v IGNORE NULLS) OVER (ORDER BY o_orderkey) AS v FROM {HOLED}")
def holed_forward(spark, d):
    return transform.impute(_holed(spark, d), ["v"], "forward", order_by=["o_orderkey"]).select("o_orderkey", "v")


@query("holed_constant", f"SELECT o_orderkey, coalesce(v, -1.0) AS v FROM {HOLED}")
def holed_constant(spark, d):
    return transform.impute(_holed(spark, d), ["v"], "constant", value=-1.0).select("o_orderkey", "v")


@query("holed_distinct", f"SELECT 'v' AS \"column\", count(DISTINCT v) AS \"unique\", count(v) AS count FROM {HOLED}")
def holed_distinct(spark, d):
    return describe.distinct_counts(_holed(spark, d), ["v"]).select("column", "unique", "count")


@query("holed_rolling", f"SELECT o_orderkey, CASE WHEN count(v) OVER w = 3 THEN round(sum(v) OVER w, 4) END AS v FROM {HOLED} WINDOW w AS (ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def holed_rolling(spark, d):
    out = ordered.rolling(_holed(spark, d), "v", 3, ["sum"], order_by=["o_orderkey"])
    return out.select("o_orderkey", F.round("v_roll_sum", 4).alias("v"))


@query("holed_align", f"SELECT o_orderkey, o_custkey, v FROM {HOLED} WHERE v IS NOT NULL")
def holed_align(spark, d):
    return reshape.align(_holed(spark, d), ["o_custkey"], "v")


@query("contingency_observed", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def contingency_observed(spark, d):
    return frequency.contingency(table(spark, d, "orders"), "o_custkey", "o_orderpriority", zeros=False)


@query("label_encode", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS p_brand FROM part")
def label_encode(spark, d):
    return transform.label_encode(table(spark, d, "part").select("p_partkey", "p_brand"), ["p_brand"])


@query("ordinal_encode", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS INTEGER) AS o_orderstatus FROM orders")
def ordinal_encode(spark, d):
    return transform.ordinal_encode(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"])


@query("target_encode", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 5) AS o_orderpriority_target FROM orders")
def target_encode(spark, d):
    return rounded(transform.target_encode(table(spark, d, "orders"), "o_orderpriority", "o_totalprice").select("o_orderkey", "o_orderpriority_target"), 5)


def _impute_sql(stat):
    return f"SELECT event_id, round(coalesce(v, m), 8) AS v FROM (SELECT event_id, {GAPPY} AS v FROM events), (SELECT {stat} AS m FROM (SELECT {GAPPY} AS v FROM events))"


@query("impute_mean", _impute_sql("avg(v)"))
def impute_mean(spark, d):
    return rounded(transform.impute(gappy_events(spark, d), ["v"]).select("event_id", "v"), 8)


@query("impute_median", _impute_sql("quantile_cont(v, 0.5)"))
def impute_median(spark, d):
    return rounded(transform.impute(gappy_events(spark, d), ["v"], "median").select("event_id", "v"), 8)


@query(
    "impute_mode",
    f"""WITH t AS (SELECT event_id, {GAPPY} AS v, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS k FROM events)
    SELECT event_id, coalesce(v, (SELECT v FROM t WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)) AS v,
    coalesce(k, (SELECT k FROM t WHERE k IS NOT NULL GROUP BY k ORDER BY count(*) DESC, k LIMIT 1)) AS k FROM t""",
)
def impute_mode(spark, d):
    t = table(spark, d, "events").select("event_id", F.expr(GAPPY).alias("v"), F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END").alias("k"))
    return transform.impute(t, ["v", "k"], "mode")


@query("impute_constant", f"SELECT event_id, coalesce({GAPPY}, -1.0) AS v FROM events")
def impute_constant(spark, d):
    return transform.impute(gappy_events(spark, d), ["v"], "constant", value=-1.0).select("event_id", "v")


@query("bin_quantile", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, quantile_cont(o_totalprice, 0.75) AS c FROM orders)
    SELECT o_orderkey, CAST(o_totalprice > a AS INTEGER) + CAST(o_totalprice > b AS INTEGER) + CAST(o_totalprice > c AS INTEGER) AS o_totalprice_binned FROM orders, q""")
def bin_quantile(spark, d):
    return transform.bin_numeric(table(spark, d, "orders"), ["o_totalprice"], 4).select("o_orderkey", "o_totalprice_binned")


@query("bin_uniform", """WITH q AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 5 AS w FROM orders)
    SELECT o_orderkey, CAST(o_totalprice > lo + w AS INTEGER) + CAST(o_totalprice > lo + 2 * w AS INTEGER) + CAST(o_totalprice > lo + 3 * w AS INTEGER) + CAST(o_totalprice > lo + 4 * w AS INTEGER) AS o_totalprice_binned FROM orders, q""")
def bin_uniform(spark, d):
    return transform.bin_numeric(table(spark, d, "orders"), ["o_totalprice"], 5, "uniform").select("o_orderkey", "o_totalprice_binned")


@query("clip_outliers", "SELECT event_id, round(greatest(least(value, hi), lo), 8) AS value FROM events, (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events)")
def clip_outliers(spark, d):
    return rounded(transform.clip_outliers(table(spark, d, "events"), ["value"], 0.05, 0.95).select("event_id", "value"), 8)


@query(
    "transform_steps",
    f"""WITH t AS (SELECT event_id, coalesce(v, m) AS v FROM (SELECT event_id, {GAPPY} AS v FROM events), (SELECT avg({GAPPY}) AS m FROM events))
    SELECT event_id, round((v - a) / s, 7) AS v, round(ln((v - a) / s + 10), 7) AS v_log FROM t, (SELECT avg(v) AS a, stddev_pop(v) AS s FROM t)""",
)
def transform_steps(spark, d):
    out = transform.transform(
        gappy_events(spark, d),
        [
            {"type": "impute", "columns": ["v"], "options": {"strategy": "mean"}},
            {"type": "normalize", "columns": ["v"]},
            {"type": "log", "columns": ["v"], "options": {"offset": 10.0}},
        ],
    )
    return rounded(out.select("event_id", "v", "v_log"), 7)


# ---- ordered operators --------------------------------------------------

@query("row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_index FROM orders")
def row_index(spark, d):
    return ordered.row_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row_index")


@query("difference", "SELECT event_id, round(value - lag(value, 2) OVER (ORDER BY ts, event_id), 8) AS value_diff FROM events")
def difference(spark, d):
    out = ordered.difference(table(spark, d, "events"), ["value"], 2, order_by=["ts", "event_id"])
    return rounded(out.select("event_id", "value_diff"), 8)


@query("difference_by_user", "SELECT event_id, round(value - lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 8) AS value_diff FROM events")
def difference_by_user(spark, d):
    out = ordered.difference(table(spark, d, "events"), ["value"], -1, order_by=["ts", "event_id"], partition_by=["user_id"])
    return rounded(out.select("event_id", "value_diff"), 8)


@query("lag_features", "SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 3) OVER w AS value_lag3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def lag_features(spark, d):
    out = ordered.lag_features(table(spark, d, "events"), ["value"], [1, 3], order_by=["event_id"], partition_by=["user_id"])
    return out.select("event_id", "value_lag1", "value_lag3")


@query(
    "rolling",
    """SELECT event_id, round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 7) AS value_roll_mean, round(CASE WHEN count(value) OVER w = 5 THEN stddev_samp(value) OVER w END, 6) AS value_roll_std,
    round(CASE WHEN count(value) OVER w = 5 THEN sum(value) OVER w END, 7) AS value_roll_sum FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def rolling(spark, d):
    out = ordered.rolling(table(spark, d, "events"), "value", 5, order_by=["event_id"])
    return out.select("event_id", r(F.col("value_roll_mean"), 7, "value_roll_mean"), r(F.col("value_roll_std"), 6, "value_roll_std"), r(F.col("value_roll_sum"), 7, "value_roll_sum"))


@query("forward_fill", f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM (SELECT event_id, {GAPPY} AS v FROM events)")
def forward_fill(spark, d):
    return ordered.forward_fill(gappy_events(spark, d), ["v"], order_by=["event_id"]).select("event_id", "v")


@query("backward_fill_by_user", f"SELECT event_id, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM (SELECT event_id, user_id, {GAPPY} AS v FROM events)")
def backward_fill_by_user(spark, d):
    return ordered.backward_fill(gappy_events(spark, d), ["v"], order_by=["event_id"], partition_by=["user_id"]).select("event_id", "v")


@query(
    "interpolate",
    f"""WITH t AS (SELECT event_id, {GAPPY} AS v, row_number() OVER (ORDER BY event_id) AS i FROM events),
    b AS (SELECT event_id, v, i, last_value(v IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS pi,
      first_value(v IGNORE NULLS) OVER n AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER n AS ni FROM t
      WINDOW p AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / nullif(ni - pi, 0) END, 7) AS v FROM b""",
)
def interpolate(spark, d):
    return rounded(ordered.interpolate(gappy_events(spark, d), ["v"], order_by=["event_id"]).select("event_id", "v"), 7)


# ---- joins and reshaping ------------------------------------------------

ONE = "(SELECT c_custkey AS k, c_acctbal AS amount FROM customer)"
TWO = "(SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS k, o_totalprice AS amount FROM orders)"


def _sides(spark, d):
    one = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("amount"))
    two = table(spark, d, "orders").select(F.expr("CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END").alias("k"), F.col("o_totalprice").alias("amount"))
    return one, two


def _merge_sql(how, a="amount_x", b="amount_y"):
    return f"SELECT coalesce(l.k, r.k) AS k, l.amount AS {a}, r.amount AS {b} FROM {ONE} l {how} JOIN {TWO} r ON l.k IS NOT DISTINCT FROM r.k"


@query("merge_inner", _merge_sql("INNER"))
def merge_inner(spark, d):
    one, two = _sides(spark, d)
    return reshape.merge(one, two, on=["k"])


@query("merge_left_spread", _merge_sql("LEFT"))
def merge_left_spread(spark, d):
    one, two = _sides(spark, d)
    return reshape.merge(one, two, on=["k"], how="left", spread_hot_keys=True)


@query("merge_right_request", _merge_sql("RIGHT", "amount_left", "amount_right"))
def merge_right_request(spark, d):
    one, two = _sides(spark, d)
    return reshape.merge_request(one, two, "right", ["k"], ["k"])


@query(
    "merge_outer_indicator",
    f"""SELECT coalesce(l.k, r.k) AS k, l.amount AS amount_x, r.amount AS amount_y, CASE WHEN l.i IS NOT NULL AND r.i IS NOT NULL THEN 'both' WHEN l.i IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS _merge
    FROM (SELECT *, 1 AS i FROM {ONE}) l FULL JOIN (SELECT *, 1 AS i FROM {TWO}) r ON l.k = r.k""",
)
def merge_outer_indicator(spark, d):
    one, two = _sides(spark, d)
    return reshape.merge(one, two, on=["k"], how="outer", indicator=True)


@query("merge_outer_spread", _merge_sql("FULL").replace("IS NOT DISTINCT FROM", "="))
def merge_outer_spread(spark, d):
    one, two = _sides(spark, d)
    return reshape.merge(two, one, on=["k"], how="outer", suffixes=("_y", "_x"), spread_hot_keys=True)


@query(
    "merge_nation_region",
    """SELECT r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def merge_nation_region(spark, d):
    j = reshape.merge(table(spark, d, "customer"), table(spark, d, "nation"), left_on=["c_nationkey"], right_on=["n_nationkey"])
    j = reshape.merge(j, table(spark, d, "region"), left_on=["n_regionkey"], right_on=["r_regionkey"])
    return j.groupBy("r_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("melt", "SELECT event_id, 'value' AS variable, value FROM events UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events")
def melt(spark, d):
    t = table(spark, d, "events").select("event_id", "value", F.col("user_id").cast("double").alias("user_id"))
    return reshape.melt(t, ["event_id"])


# ---- sources and sinks --------------------------------------------------

def _folder(spark):
    """A fresh folder next to the checkpoints, which every executor can reach."""
    import uuid

    from abacist.plans.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/export-{uuid.uuid4().hex}"


@query("csv_round_trip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = _folder(spark)
    writers.export(table(spark, d, "customer"), path, "csv", columns=["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], compression="gzip")
    return readers.load(spark, path, "csv", schema="c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("csv_missing_marks", "SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def csv_missing_marks(spark, d):
    path = _folder(spark)
    writers.export(table(spark, d, "customer"), path, "csv", columns=["c_custkey", "c_mktsegment"])
    return readers.read_csv(spark, path, schema="c_custkey long, c_mktsegment string", na_values=["BUILDING", "MACHINERY"])


@query("json_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def json_round_trip(spark, d):
    path = _folder(spark)
    writers.export(table(spark, d, "nation"), path, "json")
    return readers.load(spark, path, "json", schema="n_nationkey int, n_name string, n_regionkey int")


@query("parquet_round_trip", "SELECT * FROM supplier")
def parquet_round_trip(spark, d):
    path = _folder(spark)
    writers.export(table(spark, d, "supplier"), path, "parquet", compression="zstd")
    return readers.load(spark, path, "parquet")


@query("infer_delimiter")
def infer_delimiter(spark, d):
    path = _folder(spark)
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.option("sep", ";").csv(path)
    sep = readers.infer_delimiter(spark, path)
    return readers.read_csv(spark, path, schema="p_partkey long, p_name string, p_size int", delimiter=sep, has_header=False)
