"""Exact order statistics without holding a column in one task.

`percentile` merges a value -> count map in one reducer, which grows with the
number of distinct values.  Here a quantile sketch only narrows the search:
rows inside the bracket are counted exactly, the bracket is refined until it
holds a bounded number of rows, and only those are ordered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from abacist.functions.columns import missing
from abacist.plans.ordering import with_running_totals
from abacist.plans.session import stored
from abacist.plans.skew import skew_join

ACCURACY = 10_000
# A bracket with this many rows or fewer is ordered value by value.
BRACKET_ROWS = 200_000
# Up to these many rows the built-in `percentile` holds a map of proven size.
DIRECT_ROWS = 100_000
GROUPED_DIRECT_ROWS = 2_000_000


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN in the columns.

    One predicate per column: `dropna` makes a single predicate over all of
    them, whose rewriting through later aliases grows exponentially in the
    optimizer once there are dozens of columns.
    """
    present = [~missing(df, c) for c in (columns if columns is not None else df.columns)]
    return df.filter(reduce(lambda a, b: a & b, present)) if present else df


@dataclass
class _Bracket:
    column: str
    lo: float
    hi: float
    ranks: list[int]
    slack: float = 2.0
    below: int = 0
    inside: int = 0
    parent: _Bracket | None = None


def clean_double(c: str) -> Column:
    """The column as double with NaN turned into NULL."""
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def _targets(n: int, probs: Sequence[float]) -> list[tuple[int, int, float]]:
    out = []
    for p in probs:
        h = (n - 1) * p
        i = math.floor(h)
        out.append((i, min(i + 1, n - 1), h - i))
    return out


def order_statistics(
    df: DataFrame, ranks: Mapping[str, Sequence[int]], bracket_rows: int = BRACKET_ROWS, spans: Row | None = None
) -> dict[tuple[str, int], float]:
    """Values at 0-based ranks of each column: `(column, rank) -> value`."""
    data = df.select(*[clean_double(c).alias(c) for c in ranks])
    spans = column_spans(df, list(ranks)) if spans is None else spans
    brackets = [
        _Bracket(c, spans[c]["lo"], spans[c]["hi"], sorted(set(wanted)), inside=spans[c]["n"]) for c, wanted in ranks.items() if wanted
    ]
    small = [b for b in brackets if b.inside <= bracket_rows or b.lo == b.hi]
    large = [b for b in brackets if b not in small]
    narrow = small + _refine(data, large, bracket_rows)
    # Equal ends leave nothing to order.
    found = {(b.column, r): b.lo for b in narrow if b.lo == b.hi for r in b.ranks}
    return found | _read_off(data, [b for b in narrow if b.lo < b.hi])


def column_spans(df: DataFrame, columns: Sequence[str]) -> Row:
    """Per column a struct of non-null rows `n`, smallest `lo` and largest `hi`."""
    v = {c: clean_double(c) for c in columns}
    return df.agg(
        *[F.struct(F.count(v[c]).alias("n"), F.min(v[c]).alias("lo"), F.max(v[c]).alias("hi")).alias(c) for c in columns]
    ).first()


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    bracket_rows: int = BRACKET_ROWS,
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles per column (the `quantile_cont` rule)."""
    data = df.select(*[clean_double(c).alias(c) for c in columns])
    spans = column_spans(df, columns)
    counted = {c: spans[c]["n"] for c in columns}
    if max(counted.values()) <= direct_rows:
        row = data.agg(*[F.percentile(c, [float(p) for p in probs]).alias(c) for c in columns]).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in columns}
    targets = {c: _targets(counted[c], probs) if counted[c] else [] for c in columns}
    ranks = {c: [r for i, j, _ in targets[c] for r in (i, j)] for c in columns}
    found = order_statistics(data, ranks, bracket_rows, spans)
    return {
        c: [found[c, i] + (found[c, j] - found[c, i]) * w for i, j, w in targets[c]] or [None] * len(probs)
        for c in columns
    }


def _edges(b: _Bracket, rank: int) -> tuple[float, float]:
    """Sketch probabilities that enclose `rank` inside bracket `b`."""
    p, eps = (rank - b.below + 0.5) / b.inside, b.slack / ACCURACY
    return max(p - eps, 0.0), min(p + eps, 1.0)


def _sketches(brackets: Sequence[_Bracket]) -> list[Column]:
    """One quantile sketch per bracket, read at both ends of every rank's share."""
    out = []
    for k, b in enumerate(brackets):
        v = F.col(b.column)
        cuts = [p for r in b.ranks for p in _edges(b, r)]
        out.append(F.percentile_approx(F.when((v >= b.lo) & (v <= b.hi), v), cuts, ACCURACY).alias(f"s{k}"))
    return out


def _narrowed(brackets: Sequence[_Bracket], sketched: Sequence) -> list[_Bracket]:
    """Brackets around the ranks by what the sketches say; those that overlap become one."""
    narrow: list[_Bracket] = []
    for k, b in enumerate(brackets):
        spans: list[_Bracket] = []
        for t, r in enumerate(b.ranks):
            p_lo, p_hi = _edges(b, r)
            lo = b.lo if p_lo == 0.0 else sketched[k][2 * t]
            hi = b.hi if p_hi == 1.0 else sketched[k][2 * t + 1]
            if spans and lo <= spans[-1].hi:
                spans[-1].hi = max(spans[-1].hi, hi)
                spans[-1].ranks.append(r)
            else:
                spans.append(_Bracket(b.column, lo, hi, [r], b.slack, parent=b))
        narrow += spans
    return narrow


def _refine(data: DataFrame, open_: list[_Bracket], limit: int) -> list[_Bracket]:
    """Narrow each bracket until it holds at most `limit` rows or a single value."""
    done: list[_Bracket] = []
    while open_:
        narrow = _narrowed(open_, data.agg(*_sketches(open_)).first())
        _count(data, narrow)
        open_ = []
        for b in narrow:
            if b.below > b.ranks[0] or b.ranks[-1] >= b.below + b.inside:
                # The sketch missed: retry the enclosing bracket with more slack.
                up = b.parent
                open_.append(_Bracket(b.column, up.lo, up.hi, b.ranks, b.slack * 8, up.below, up.inside, up.parent))
            elif b.inside <= limit or b.lo == b.hi or b.inside >= b.parent.inside:
                # Without progress the values repeat, and counting them collapses them.
                done.append(b)
            else:
                open_.append(b)
    return done


@dataclass
class RankedSummary:
    """What one sketch and one counting pass tell of several columns.

    quantiles[c] are in the order of the asked shares, trimmed[c] is the mean
    without the cut-off ends, extra the further aggregates of the sketch's pass.
    """

    quantiles: dict[str, list[float | None]]
    trimmed: dict[str, float | None]
    extra: Row | None


def ranked_summary(
    df: DataFrame, columns: Sequence[str], spans: Mapping[str, tuple[int, float, float]], probs: Sequence[float], share: float | None = None,
    extra: Sequence[Column] = (), bracket_rows: int = BRACKET_ROWS,
) -> RankedSummary:
    """Quantiles and trimmed means of all columns together, with `extra` aggregates of df.

    spans: per column the rows that are not missing, their smallest and largest
    value.  All ranks of all columns share one sketch; one pass then counts
    and sums the values between the brackets and lists those inside.  Columns
    whose brackets the sketch missed, or which hold too many rows, are asked
    again by `order_statistics`.
    """
    n = {c: spans[c][0] for c in columns}
    targets = {c: _targets(n[c], probs) if n[c] else [] for c in columns}
    cut = {c: int(share * n[c]) for c in columns if share is not None and n[c] > 2 * int(share * n[c])}
    ranks = {c: sorted({r for i, j, _ in targets[c] for r in (i, j)} | ({cut[c], n[c] - 1 - cut[c]} if c in cut else set())) for c in columns}
    data = df.select(*[clean_double(c).alias(c) for c in columns])
    roots = [_Bracket(c, spans[c][1], spans[c][2], ranks[c], inside=n[c]) for c in columns if n[c]]
    large = [b for b in roots if b.inside > bracket_rows and b.lo < b.hi]
    asked = [*_sketches(large), *extra]
    row = data.select("*").agg(*asked).first() if asked else None
    small = [_Bracket(b.column, b.lo, b.hi, b.ranks, parent=b) for b in roots if b not in large]
    brackets = small + (_narrowed(large, row) if large else [])
    # Wider than sketches should leave them: too many values to list.
    wide = {b.column for b in brackets if b.lo < b.hi and b.parent in large and 4 * b.slack * len(b.ranks) / ACCURACY * b.parent.inside > bracket_rows}
    families = _families([b for b in brackets if b.column not in wide])
    table = stored(data.mapInPandas(_tallying(families), "f int, at int, v double, n long, s double").groupBy("f", "at", "v").agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    total = {(r["f"], r["at"]): (r["n"], r["s"]) for r in table.filter("v IS NULL").collect()}  # two per bracket
    missed = set(wide)
    for f, family in enumerate(families):
        _settle(family, {at: k for (g, at), (k, _) in total.items() if g == f})
        missed |= {b.column for b in family if b.below > b.ranks[0] or b.ranks[-1] >= b.below + b.inside}
    found = _picked(table.filter("v IS NOT NULL").select("f", "at", "v", "n"), families)
    again = {c: ranks[c] for c in missed}
    if again:
        found |= order_statistics(df, again, bracket_rows)
    trimmed: dict[str, float | None] = dict.fromkeys(columns)
    ends = {c: (found[c, cut[c]], found[c, n[c] - 1 - cut[c]]) for c in cut}
    trimmed |= {c: lo for c, (lo, hi) in ends.items() if lo == hi}
    open_ = {c: e for c, e in ends.items() if e[0] < e[1] and c not in missed}
    trimmed |= _inner_means(table, families, total, open_, cut, n)
    late = [c for c in cut if c in missed]
    if late:
        trimmed |= _trimmed_by_pass(df, {c: ends[c] for c in late}, cut, n)
    quantiles = {c: [found[c, i] + (found[c, j] - found[c, i]) * w for i, j, w in targets[c]] or [None] * len(probs) for c in columns}
    return RankedSummary(quantiles, trimmed, row)


def _tallying(families: Sequence[Sequence[_Bracket]]):
    """Rows and sums of every place between and inside the brackets (v is NULL), and the values inside with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [np.zeros(2 * len(family) + 1, dtype="int64") for family in families]
        sums = [np.zeros(2 * len(family) + 1) for family in families]
        for pdf in batches:
            for f, family in enumerate(families):
                v = pdf[family[0].column].to_numpy(dtype=float)
                v = v[~np.isnan(v)] + 0.0
                at = _places(v, family)
                rows[f] += np.bincount(at, minlength=len(rows[f]))
                sums[f] += np.bincount(at, weights=v, minlength=len(rows[f]))
                v, n = np.unique(v[at % 2 == 1], return_counts=True)
                yield pd.DataFrame({"f": f, "at": _places(v, family), "v": v, "n": n, "s": 0.0})
        for f in range(len(families)):
            yield pd.DataFrame({"f": f, "at": np.arange(len(rows[f])), "v": pd.Series([None] * len(rows[f]), dtype="float64"), "n": rows[f], "s": sums[f]})

    return run


def _inner_means(table: DataFrame, families, total, ends: Mapping[str, tuple[float, float]], cut: Mapping[str, int], n: Mapping[str, int]) -> dict[str, float]:
    """Trimmed means from the tallies between the two cut-off values and the listed values beside them."""
    place = {}
    for f, family in enumerate(families):
        c = family[0].column
        if c in ends:
            low, high = (next(k for k, b in enumerate(family) if b.lo <= e <= b.hi) for e in ends[c])
            place[c] = (f, 2 * low + 1, 2 * high + 1, family[low].below, family[high].below)
    if not place:
        return {}
    aggs = []
    for c, (f, low, high, *_) in place.items():
        lo, hi = ends[c]
        here, v, k = F.col("f") == f, F.col("v"), F.col("n")
        beside = here & F.col("at").isin(low, high) & (v > lo) & (v < hi)
        sums = [(beside, v * k), (here & (F.col("at") == low) & (v <= lo), k), (here & (F.col("at") == high) & (v < hi), k)]
        aggs.append(F.struct(*[F.coalesce(F.sum(F.when(when, x)), F.lit(0)).alias(f"x{i}") for i, (when, x) in enumerate(sums)]).alias(c))
    row = table.filter("v IS NOT NULL").agg(*aggs).first()
    out = {}
    for c, (f, low, high, below_low, below_high) in place.items():
        (lo, hi), k = ends[c], cut[c]
        inner = row[c]["x0"] + sum(total.get((f, at), (0, 0.0))[1] for at in range(low + 1, high))
        # Brackets between the two ends were summed as a whole.
        upto_lo, under_hi = below_low + row[c]["x1"], below_high + row[c]["x2"]
        out[c] = (inner + lo * (upto_lo - k) + hi * (n[c] - k - under_hi)) / (n[c] - 2 * k)
    return out


def _trimmed_by_pass(df: DataFrame, ends: Mapping[str, tuple[float, float]], cut: Mapping[str, int], n: Mapping[str, int]) -> dict[str, float]:
    """Trimmed means by one more pass, from cut-off values that are known."""
    aggs = []
    for c, (lo, hi) in ends.items():
        v = clean_double(c)
        inner = F.coalesce(F.sum(F.when((v > lo) & (v < hi), v)), F.lit(0.0))
        aggs.append(F.struct(inner.alias("inner"), F.count_if(v <= lo).alias("upto_lo"), F.count_if(v < hi).alias("under_hi")).alias(c))
    row = df.agg(*aggs).first()
    out = {}
    for c, (lo, hi) in ends.items():
        k, r = cut[c], row[c]
        out[c] = lo if lo == hi else (r["inner"] + lo * (r["upto_lo"] - k) + hi * (n[c] - k - r["under_hi"])) / (n[c] - 2 * k)
    return out


def _families(brackets: Sequence[_Bracket]) -> list[list[_Bracket]]:
    """Brackets that came from one enclosing bracket: ordered and disjoint."""
    groups: dict[tuple[str, int], list[_Bracket]] = {}
    for b in brackets:
        groups.setdefault((b.column, id(b.parent)), []).append(b)
    return [sorted(g, key=lambda b: b.lo) for g in groups.values()]


def _places(values: np.ndarray, family: Sequence[_Bracket]) -> np.ndarray:
    """Place of each value: 2k + 1 is inside the k-th bracket, even is between brackets."""
    lows, highs = np.array([b.lo for b in family]), np.array([b.hi for b in family])
    return np.searchsorted(lows, values, side="right") + np.searchsorted(highs, values, side="left")


def _count(data: DataFrame, brackets: list[_Bracket]) -> None:
    """Fill in the exact number of rows below and inside each bracket."""
    families = _families(brackets)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros(2 * len(family) + 1, dtype="int64") for family in families]
        for pdf in batches:
            for total, family in zip(totals, families):
                v = pdf[family[0].column].to_numpy(dtype=float)
                total += np.bincount(_places(v[~np.isnan(v)], family), minlength=len(total))
        for f, total in enumerate(totals):
            yield pd.DataFrame({"f": f, "at": np.arange(len(total)), "n": total})

    parts = data.mapInPandas(tally, "f int, at int, n long")
    seen = {(r["f"], r["at"]): r["n"] for r in parts.groupBy("f", "at").agg(F.sum("n").alias("n")).collect()}  # two per bracket
    for f, family in enumerate(families):
        _settle(family, {at: n for (g, at), n in seen.items() if g == f})


def _settle(family: Sequence[_Bracket], rows: Mapping[int, int]) -> None:
    """Rows below and inside each bracket from the counts of all places."""
    below = 0
    for k, b in enumerate(family):
        below += rows.get(2 * k, 0)
        b.below, b.inside = below, rows.get(2 * k + 1, 0)
        below += b.inside


def _read_off(data: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """Count each value inside the brackets and pick the wanted ranks."""
    if not brackets:
        return {}
    families = _families(brackets)

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for f, family in enumerate(families):
                v = pdf[family[0].column].to_numpy(dtype=float)
                v = v[~np.isnan(v)]
                at = _places(v, family)
                v, n = np.unique(v[at % 2 == 1], return_counts=True)
                yield pd.DataFrame({"f": f, "at": _places(v, family), "v": v, "n": n})

    kept = data.mapInPandas(inside, "f int, at int, v double, n long")
    return _picked(kept.groupBy("f", "at", "v").agg(F.sum("n").alias("n")), families)


def _picked(counts: DataFrame, families: Sequence[Sequence[_Bracket]]) -> dict[tuple[str, int], float]:
    """The wanted ranks among values with counts, by family and place."""
    rows = [
        (f, 2 * k + 1, b.column, r, r - b.below)
        for f, family in enumerate(families)
        for k, b in enumerate(family)
        for r in b.ranks
        if 0 <= r - b.below < b.inside
    ]
    if not rows:
        return {}
    running = F.sum("n").over(
        Window.partitionBy("f", "at").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    )
    wanted = counts.sparkSession.createDataFrame(rows, "wf int, wat int, name string, rank long, pos long")
    here = (F.col("f") == F.col("wf")) & (F.col("at") == F.col("wat"))
    picked = (
        counts.withColumn("upto", running)
        # One row per bracket and rank.
        .join(F.broadcast(wanted), here & (F.col("pos") < F.col("upto")) & (F.col("pos") >= F.col("upto") - F.col("n")))
        .select("name", "rank", "v")
        .collect()
    )
    return {(r["name"], r["rank"]): r["v"] for r in picked}


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    direct_rows: int = GROUPED_DIRECT_ROWS,
) -> DataFrame:
    """Exact quantiles per group; one row per group, hot groups included.

    Equal values collapse first, the count table is ordered by range over
    (group, value), and each group's ranks are offsets into the global running
    total, so no task ever holds a whole group.
    """
    data = df.select(*by, clean_double(value).alias("_v")).filter(F.col("_v").isNotNull())
    if data.count() <= direct_rows:
        exact = data.groupBy(*by).agg(F.percentile("_v", [float(p) for p in probs]).alias("_q"))
        return exact.select(*by, *[F.col("_q")[k].alias(name) for k, name in enumerate(names)])
    counts = (
        data.groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    run = with_running_totals(counts, [*by, "_v"], {"_upto": "_c"})
    spans = run.groupBy(*by).agg(
        F.min(F.col("_upto") - F.col("_c")).alias("_base"), F.sum("_c").alias("_n")
    )
    located = skew_join(run, spans, list(by), null_safe=True)
    aggs, final = [], []
    for k, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        i = F.floor(h)
        j = F.least(i + 1, F.col("_n") - 1)
        for tag, pos in (("i", i), ("j", j)):
            at = F.col("_base") + pos
            hit = (at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{k}"))
        lo, hi = F.col(f"_i{k}"), F.col(f"_j{k}")
        final.append((lo + (hi - lo) * F.col(f"_w{k}")).alias(names[k]))
        aggs.append(F.max(h - i).alias(f"_w{k}"))
    return located.groupBy(*by).agg(*aggs).select(*by, *final)
