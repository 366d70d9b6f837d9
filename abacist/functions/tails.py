"""Tail probabilities as Columns, for tables that are already aggregated.

Vectorised UDFs: they run on one row per test, group or term, never on raw data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from abacist.functions import dist


def _tail(fn, args: int):
    if args == 1:
        def run(a: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(dtype=float)))
    elif args == 2:
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(dtype=float), b.to_numpy(dtype=float)))
    else:
        def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(fn(a.to_numpy(dtype=float), b.to_numpy(dtype=float), c.to_numpy(dtype=float)))
    udf = F.pandas_udf(run, DoubleType())

    def column(*cols):
        value = udf(*[(F.lit(float(c)) if isinstance(c, (int, float)) else F.col(c) if isinstance(c, str) else c).cast("double") for c in cols])
        return F.nanvl(value, F.lit(None).cast("double"))

    return column


t_two_sided = _tail(dist.t_two_sided, 2)
t_sf = _tail(dist.t_sf, 2)
t_ppf = _tail(dist.t_ppf, 2)
f_sf = _tail(dist.f_sf, 3)
chi2_sf = _tail(dist.chi2_sf, 2)
norm_two_sided = _tail(dist.norm_two_sided, 1)
kolmogorov_sf = _tail(dist.kolmogorov_sf, 1)
studentized_range_sf = _tail(dist.studentized_range_sf, 3)
