"""Distribution tails in numpy: normal, t, F, chi-square, studentized range.

scipy is not assumed.  Every function accepts scalars or arrays.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()


def _over(fn):
    """Apply a scalar function elementwise; NaN or None in gives NaN out."""

    def safe(*args):
        vals = [math.nan if a is None else float(a) for a in args]
        return math.nan if any(math.isnan(v) for v in vals) else fn(*vals)

    def call(*args):
        # Built per call: a used vectorised object cannot be shipped to executors.
        out = np.vectorize(safe, otypes=[float])(*args)
        return float(out) if out.ndim == 0 else out

    call.__doc__ = fn.__doc__
    call.__name__ = fn.__name__
    return call


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 2000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-16:
            break
    return h


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - front * total
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 5000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


betainc = _over(_betainc)
gammaincc = _over(_gammaincc)
norm_cdf = _over(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)))
norm_sf = _over(lambda z: 0.5 * math.erfc(z / math.sqrt(2.0)))
norm_two_sided = _over(lambda z: math.erfc(abs(z) / math.sqrt(2.0)))
norm_ppf = _over(lambda p: -math.inf if p <= 0 else math.inf if p >= 1 else _NORMAL.inv_cdf(p))


@_over
def chi2_sf(x, df):
    """Upper tail of chi-square."""
    return _gammaincc(df / 2.0, x / 2.0) if df > 0 else math.nan


@_over
def f_sf(f, d1, d2):
    """Upper tail of F."""
    if math.isinf(f):
        return 0.0
    return 1.0 if f <= 0 else _betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@_over
def t_two_sided(t, df):
    """P(|T| >= |t|)."""
    return 0.0 if math.isinf(t) else _betainc(df / 2.0, 0.5, df / (df + t * t))


@_over
def t_sf(t, df):
    """P(T >= t)."""
    if math.isinf(t):
        return 0.0 if t > 0 else 1.0
    half = 0.5 * _betainc(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


@_over
def t_ppf(p, df):
    """Quantile of t, by bisection on the upper tail."""
    if p == 0.5:
        return 0.0
    tail = min(p, 1.0 - p)
    hi = 1.0
    while 0.5 * _betainc(df / 2.0, 0.5, df / (df + hi * hi)) > tail:
        hi *= 2.0
    lo = 0.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if 0.5 * _betainc(df / 2.0, 0.5, df / (df + mid * mid)) > tail:
            lo = mid
        else:
            hi = mid
        if hi - lo < 1e-15 * hi:
            break
    return hi if p > 0.5 else -hi


@_over
def kolmogorov_sf(x):
    """Limit law of sqrt(n) times the Kolmogorov distance."""
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2.0 * sum((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 101))))


_GL_X, _GL_W = np.polynomial.legendre.leggauss(64)


def _phi(z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)


def _range_cdf(w: float, k: float) -> float:
    """P(range of k standard normals <= w)."""
    if w <= 0:
        return 0.0
    total = 0.0
    for a, b in zip(np.arange(-8.0, 8.0, 1.0), np.arange(-7.0, 9.0, 1.0)):
        z = 0.5 * (b - a) * _GL_X + 0.5 * (a + b)
        inner = norm_cdf(z) - norm_cdf(z - w)
        total += float(np.sum(_GL_W * _phi(z) * np.clip(inner, 0.0, 1.0) ** (k - 1))) * 0.5 * (b - a)
    return min(1.0, k * total)


@_over
def studentized_range_sf(q, k, df):
    """Upper tail of the studentized range with `k` means and `df` error degrees."""
    if q <= 0:
        return 1.0
    if df > 20000:
        return max(0.0, 1.0 - _range_cdf(q, k))
    # Integrate over s = sqrt(chi2/df), concentrated around one.
    spread = 1.0 / math.sqrt(2.0 * df)
    lo, hi = max(1e-9, 1.0 - 9.0 * spread), 1.0 + 9.0 * spread + (4.0 if df < 5 else 0.0)
    edges = np.linspace(lo, hi, 5)
    const = (df / 2.0) * math.log(df) - math.lgamma(df / 2.0) - (df / 2.0 - 1.0) * math.log(2.0)
    total = 0.0
    x16, w16 = np.polynomial.legendre.leggauss(24)
    for a, b in zip(edges[:-1], edges[1:]):
        s = 0.5 * (b - a) * x16 + 0.5 * (a + b)
        density = np.exp(const + (df - 1.0) * np.log(s) - 0.5 * df * s * s)
        probs = np.array([_range_cdf(q * v, k) for v in s])
        total += float(np.sum(w16 * density * probs)) * 0.5 * (b - a)
    return min(1.0, max(0.0, 1.0 - total))


def binom_two_sided_half(k: int, n: int) -> float:
    """Exact two-sided sign-test probability with p = 1/2."""
    low = min(k, n - k)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2.0) for i in range(low + 1)]
    return min(1.0, 2.0 * sum(math.exp(v) for v in logs))
