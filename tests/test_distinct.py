"""Distinct counts by sketch and exact settlement, roles, row names."""

import numpy as np
import pandas as pd

from abacist.operators.describe import distinct_counts
from abacist.operators.profile import duplicate_rows, id_candidates, infer_roles
from abacist.plans.distinct import settled_counts


def made(spark):
    rng = np.random.default_rng(1)
    n = 4000
    x = pd.DataFrame({
        "key": np.arange(n), "almost": np.append(np.arange(n - 1), 0), "half": [f"h{k}" for k in rng.permutation(n) % (n // 2)], "under": [f"u{k % (n // 2 - 1)}" for k in range(n)],
        "name": [f"n{k % 1000}" for k in range(n)], "two": rng.integers(0, 2, n), "few": rng.integers(0, 9, n), "twenty": np.arange(n) % 20, "real": rng.normal(0, 1, n),
        "holes": np.where(np.arange(n) % 4 == 0, np.nan, np.arange(n) % 50), "zero": np.where(np.arange(n) % 2 == 0, 0.0, -0.0), "none": np.full(n, np.nan),
    })
    return x, spark.createDataFrame(x)


def test_roles_equal_those_of_exact_counts(spark):
    x, df = made(spark)
    got = {r["column"]: r for r in infer_roles(df).collect()}
    for c in x:
        u = (x[c] + 0.0 if x[c].dtype == float else x[c]).nunique()
        number, ratio = x[c].dtype != object, u / len(x)
        want = "binary" if u == 2 else ("ordinal" if ratio < 0.05 and u < 20 else "numeric") if number else "categorical" if ratio < 0.5 else "text"
        assert got[c]["role"] == want, c
        assert got[c]["unique"] == u if got[c]["exact"] else abs(got[c]["unique"] - u) <= 0.07 * u
    assert got["name"]["exact"] is False  # far from every threshold: its values are not shuffled


def test_counts_and_candidates(spark):
    x, df = made(spark)
    got = {r["column"]: (r["unique"], r["count"]) for r in distinct_counts(df, list(x)).collect()}
    assert got == {c: ((x[c] + 0.0 if x[c].dtype == float else x[c]).nunique(), x[c].count()) for c in x if c != "none"}
    assert {r["column"] for r in id_candidates(df).collect()} == {"key", "real"}
    known = settled_counts(df, ["key", "none"], lambda c, d: False)
    assert not known["key"].exact and known["key"].low <= 4000 <= known["key"].high and known["none"].high == 0
    assert id_candidates(df.limit(0)).count() == 0


def test_duplicate_rows_tell_nulls_apart(spark):
    rows = [(None, 5, 0.0), (5, None, 0.0), (5, None, -0.0), (None, None, float("nan")), (None, None, float("nan")), (None, None, None)]
    got = duplicate_rows(spark.createDataFrame(rows, "a int, b int, c double")).first()
    assert (got["rows"], got["duplicates"]) == (6, 2)
