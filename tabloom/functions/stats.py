"""Distribution functions for the driver (small scalars) and as Column
expressions (inverse normal CDF, evaluated JVM-side inside codegen).

SciPy is not available, so tails are computed with the standard
continued-fraction / series forms of the regularised incomplete beta and
gamma functions (Numerical Recipes style), exact to ~1e-12.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    from statistics import NormalDist
    return NormalDist().inv_cdf(p)


def _betacf(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of a t statistic; df=inf gives the normal."""
    if t is None or not math.isfinite(t):
        return float("nan") if t is None or math.isnan(t) else 0.0
    if df is None or math.isinf(df) or df > 1e7:
        return 2.0 * norm_sf(abs(t))
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or not math.isfinite(f) or f <= 0:
        return 1.0 if (f is not None and f <= 0) else float("nan")
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def gammainc_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    if x < a + 1.0:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(1000):
            ap += 1.0
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def chi2_sf(x: float, df: float) -> float:
    return gammainc_upper(df / 2.0, x / 2.0)


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student t by bisection on t_sf2 (driver, scalar)."""
    if math.isinf(df):
        return norm_ppf(p)
    target = 2.0 * (1.0 - p) if p >= 0.5 else 2.0 * p
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_sf2(mid, df) > target:
            lo = mid
        else:
            hi = mid
    q = (lo + hi) / 2
    return q if p >= 0.5 else -q


# --- Column expressions ----------------------------------------------------

# Coefficients of Wichura's algorithm AS 241 (PPND16), the
# published double-precision rational approximation of the normal quantile.
_A = [3.387132872796366608, 133.14166789178437745, 1971.5909503065514427,
      13731.693765509461125, 45921.953931549871457, 67265.770927008700853,
      33430.575583588128105, 2509.0809287301226727]
_B = [1.0, 42.313330701600911252, 687.1870074920579083, 5394.1960214247511077,
      21213.794301586595867, 39307.89580009271061, 28729.085735721942674,
      5226.495278852545925]
_C = [1.42343711074968357734, 4.6303378461565452959, 5.7694972214606914055,
      3.64784832476320460504, 1.27045825245236838258, 0.24178072517745061177,
      0.0227238449892691845833, 7.7454501427834140764e-4]
_D = [1.0, 2.05319162663775882187, 1.6763848301838038494, 0.68976733498510000455,
      0.14810397642748007459, 0.0151986665636164571966, 5.475938084995344946e-4,
      1.05075007164441684324e-9]
_E = [6.6579046435011037772, 5.4637849111641143699, 1.7848265399172913358,
      0.29656057182850489123, 0.026532189526576123093, 0.0012426609473880784386,
      2.71155556874348757815e-5, 2.01033439929228813265e-7]
_F = [1.0, 0.59983220655588793769, 0.13692988092273580531, 0.0148753612908506148525,
      7.868691311456132591e-4, 1.8463183175100546818e-5, 1.4215117583164458887e-7,
      2.04426310338993978564e-15]


def _poly(coefs, x: Column) -> Column:
    acc = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = acc * x + F.lit(c)
    return acc


def inv_norm_cdf(p: Column) -> Column:
    """Standard normal quantile as a JVM-side expression (AS 241, ~1e-16)."""
    q = p - F.lit(0.5)
    r_central = F.lit(0.180625) - q * q
    central = q * _poly(_A, r_central) / _poly(_B, r_central)
    r_tail = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near = _poly(_C, r_tail - F.lit(1.6)) / _poly(_D, r_tail - F.lit(1.6))
    far = _poly(_E, r_tail - F.lit(5.0)) / _poly(_F, r_tail - F.lit(5.0))
    tail = F.when(r_tail <= 5.0, near).otherwise(far)
    tail = F.when(q < 0, -tail).otherwise(tail)
    return (F.when(p.isNull() | (p <= 0) | (p >= 1), F.lit(None).cast("double"))
            .when(F.abs(q) <= 0.425, central)
            .otherwise(tail))
