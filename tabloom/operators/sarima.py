"""Seasonal ARIMA(p,d,q)(P,D,Q)_m for many series, orders chosen by AICc.

Rows are numbered within their series and cut into blocks of ``BLOCK`` rows that bring the
rows before them along (as many as the longest lag needs), one array a block.  Every step
is numpy over whole blocks, and what leaves a block is sums; Spark adds them per series, so
a long series is as many tasks as it has blocks.

1. Seasonal differencing if the seasonal strength 1 - Var(R) / Var(S + R) passes 0.64, from
   sums by season of the values less their centred moving average.
2. Differencing until the KPSS statistic for a level passes no more: block sums of the
   running totals are put together with the totals of the blocks before them.
3. Hannan-Rissanen: a long autoregression on lags near 0 and near the seasons gives
   residuals (and once found, the model itself gives better ones); the cross-moments of value,
   lagged values and lagged residuals then hold every candidate.  The multiplicative polynomials make the coefficients of the lags products of
   the parameters, and Gauss-Newton minimises the quadratic form of those coefficients, on one
   moment matrix a series.  Candidates with roots near the unit circle are left out.
4. Forecasts need the last residuals of the filter over the WHOLE series: blocks stream in
   order, each adds the effect of the residuals before it to its first rows and multiplies
   with the power series of the moving-average polynomial; no row is looped over."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.stats import norm_ppf
from ..functions import ranks
from ..session import ship_package
from .validation import running_totals

BLOCK = 1024
Z975 = norm_ppf(0.975)
# Limits of the two tests
STRENGTH, KPSS_LEVEL = 0.64, 0.463
ROUNDS = 3                      # of residuals and moments: from the autoregression, then from the model
LONG_SEASONS = 4                # seasons that the long autoregression looks back
MAX_ORDER = 5                   # of p + q + P + Q together
STEPS, TOLERANCE, ROOT = 60, 1e-10, 1.01


def _blocks(df: DataFrame, keys: list[str], order_col: str, value: str, halo: int) -> DataFrame:
    """(keys, block, first, start, v): rows of each block from position ``first`` on and the ``halo`` rows
    before it, as an array from position ``start`` on; written once."""
    v = F.col(value).cast("double")
    x = df.select(*keys, F.col(order_col).alias("_t"), v.alias("_v")).where(v.isNotNull() & ~F.isnan(v))
    x = running_totals(x, keys, ["_t"], "_v").select(*keys, (F.col("cum_n") - 1).alias("_pos"), "_v")
    spread = F.sequence(F.floor(F.col("_pos") / BLOCK), F.floor((F.col("_pos") + halo) / BLOCK))
    x = x.withColumn("block", F.explode(spread))
    x = x.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("_pos", "_v"))).alias("r"))   # BLOCK + halo rows
    x = x.select(*keys, "block", (F.col("block") * BLOCK).alias("first"), F.get("r", F.lit(0))["_pos"].alias("start"), F.transform("r", lambda a: a["_v"]).alias("v"),
                 F.element_at("r", -1)["_pos"].alias("_end"))
    # a block without rows of its own only repeats the end of the series
    return ranks.materialize(x.where(F.col("_end") >= F.col("first")).drop("_end"))


def _per_block(blocks: DataFrame, keys: list[str], schema: str, fn) -> DataFrame:
    """``fn(row) -> list of tuples`` for every block row, in Arrow batches."""
    ship_package(blocks.sparkSession)
    full = T.StructType([blocks.schema[k] for k in keys] + T.StructType.fromDDL(schema).fields)

    def run(batches):
        fields = to_arrow_schema(full)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out += [(*(r[k] for k in keys), *t) for t in fn(r)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out), fields)], schema=fields)
    return blocks.mapInArrow(run, full)


def difference(y: np.ndarray, m: int, D: int, d: int) -> np.ndarray:
    for _ in range(D):
        y = y[m:] - y[:-m] if len(y) > m else y[:0]
    for _ in range(d):
        y = np.diff(y) if len(y) else y
    return y


def _own(r, m: int, D: int, d: int, lag: int) -> tuple[np.ndarray, int]:
    """(differenced values from ``lag`` before the block's own first value on, how many come before it)."""
    w = difference(np.array(r["v"], float), m, D, d)
    first = max(r["first"], d + m * D)                # position of the first differenced value of the block
    at = first - (r["start"] + d + m * D)
    lead = min(lag, max(at, 0))
    return w[max(at, 0) - lead:], lead


# ------------------------------------------------------------------ differencing

def seasonal_strength(blocks: DataFrame, keys: list[str], m: int) -> DataFrame:
    """(keys, strength): of the values less their centred moving average over ``m`` rows."""
    half = m // 2
    kernel = np.full(m + 1, 1.0 / m) if m % 2 == 0 else np.full(m, 1.0 / m)
    if m % 2 == 0:
        kernel[[0, -1]] = 0.5 / m

    def sums(r):
        y = np.array(r["v"], float)
        if len(y) < len(kernel):
            return []
        trend = np.convolve(y, kernel, "valid")
        x = y[half:half + len(trend)] - trend
        ends = r["start"] + np.arange(len(trend)) + len(kernel) - 1     # a window belongs to the block of its last row
        own = ends >= r["first"]
        season = (ends[own] - len(kernel) + 1 + half) % m
        n = np.bincount(season, minlength=m)
        s, q = np.bincount(season, x[own], m), np.bincount(season, x[own] ** 2, m)
        return [(int(i), int(n[i]), float(s[i]), float(q[i])) for i in np.flatnonzero(n)]
    per = _per_block(blocks, keys, "season int, n long, s double, q double", sums)
    per = per.groupBy(*keys, "season").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    within = F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    total = q - s * s / n
    return per.groupBy(*keys).agg(F.greatest(F.lit(0.0), 1 - F.try_divide(within, total)).alias("strength"))


def kpss(blocks: DataFrame, keys: list[str], m: int, lags: int, most: int = 2) -> DataFrame:
    """(keys, d, kpss) for each order of differencing up to ``most``; ``blocks`` has the column _sd,
    the seasonal differences to take first."""
    names = [f"{c}{k}" for k in range(lags + 1) for c in "abcn"]

    def sums(r):
        out = []
        for d in range(most + 1):
            w, lead = _own(r, m, r["_sd"], d, lags)
            own = w[lead:]
            if not len(own):
                continue
            run, j = np.cumsum(own), np.arange(1, len(own) + 1)
            row = [d, r["block"], len(own), float(run[-1]), float(run.sum()), float(run @ run), float(j @ run)]
            for k in range(lags + 1):
                late = w[max(lead, k):]
                early = w[max(lead, k) - k:max(lead, k) - k + len(late)]
                row += [float(late @ early), float(late.sum()), float(early.sum()), float(len(late))]
            out.append(tuple(row))
        return out
    per = _per_block(blocks, keys, "d int, block long, n long, c double, l1 double, l2 double, j double, "
                     + ", ".join(f"{c} double" for c in names), sums)
    tot = per.groupBy(*keys, "d").agg(F.sum("n").alias("N"), (F.sum("c") / F.sum("n")).alias("mean"), *[F.sum(c).alias(c) for c in names])
    before = Window.partitionBy(*keys, "d").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = per.select(*keys, "d", "block", F.col("n").cast("double").alias("n"), "c", "l1", "l2", "j").withColumns({
        "c0": F.coalesce(F.sum("c").over(before), F.lit(0.0)), "n0": F.coalesce(F.sum("n").over(before), F.lit(0.0))})
    head = tot.select(*keys, F.col("d").alias("_d"), "mean")
    on = [F.col("_d") == F.col("d")]
    for k in keys:
        head = head.withColumnRenamed(k, f"_k_{k}")
        on.append(F.col(k).eqNullSafe(F.col(f"_k_{k}")))
    b = b.join(head, on)
    n, mu = F.col("n"), F.col("mean")
    u = F.col("c0") - F.col("n0") * mu
    part = F.col("l2") + n * u * u + mu * mu * n * (n + 1) * (2 * n + 1) / 6 + 2 * u * F.col("l1") - 2 * mu * F.col("j") - mu * u * n * (n + 1)
    S = b.groupBy(*keys, "d").agg(F.sum(part).alias("S"))
    N = F.col("N").cast("double")
    use = F.floor(4 * F.pow(N / 100, 0.25))
    gamma = [F.col(f"a{k}") - mu * (F.col(f"b{k}") + F.col(f"c{k}")) + F.col(f"n{k}") * mu * mu for k in range(lags + 1)]
    lrv = gamma[0]
    for k in range(1, lags + 1):
        lrv = lrv + F.when(use >= k, 2 * (1 - k / (use + 1)) * gamma[k]).otherwise(0.0)
    return tot.join(S, [*keys, "d"]).select(*keys, "d", F.try_divide(F.col("S") / (N * N), lrv / N).alias("kpss"), F.col("N").alias("n"))


# ------------------------------------------------------------------ orders and parameters

def _lags(short: int, seasons: int, m: int) -> list[int]:
    """Lags of the product of a polynomial of order ``short`` with one of ``seasons`` seasons."""
    out = {i + m * j for i in range(short + 1) for j in range(seasons + 1)}
    return sorted(x for x in out if x > 0)


def _upper(x: np.ndarray) -> list[float]:
    g = x.T @ x
    return g[np.triu_indices(len(g))].tolist()


def _square(values, k: int) -> np.ndarray:
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = values
    return g + np.triu(g, 1).T


def polynomial(short: Sequence[float], season: Sequence[float], m: int, sign: float) -> dict[int, float]:
    """Lag -> coefficient of (1 + sign * short(B)) (1 + sign * season(B^m)), without the constant 1."""
    out: dict[int, float] = {}
    a = {0: 1.0} | {i + 1: sign * v for i, v in enumerate(short)}
    b = {0: 1.0} | {m * (j + 1): sign * v for j, v in enumerate(season)}
    for (i, x), (j, y) in itertools.product(a.items(), b.items()):
        out[i + j] = out.get(i + j, 0.0) + x * y
    out.pop(0)
    return out


def _outside(coefs: Sequence[float], sign: float) -> bool:
    """All roots of 1 + sign * sum c_i z^i lie outside the unit circle by some distance."""
    c = np.trim_zeros(np.r_[1.0, sign * np.array(coefs, float)], "b")
    return len(c) < 2 or bool((np.abs(np.roots(c[::-1])) > ROOT).all())


def _solve(M: np.ndarray, order: tuple[int, int, int, int], m: int, wl: list[int], el: list[int], constant: bool):
    """(parameters, sum of squares) of one candidate on the moments of (1, lagged w, lagged e, w)."""
    p, q, P, Q = order
    K = len(M)
    at_w, at_e = {x: 1 + i for i, x in enumerate(wl)}, {x: 1 + len(wl) + i for i, x in enumerate(el)}
    size = p + q + P + Q + constant

    def vector(x: np.ndarray) -> np.ndarray:
        v = np.zeros(K)
        v[K - 1] = 1.0
        ar, sar, ma, sma = x[:p], x[p:p + P], x[p + P:p + P + q], x[p + P + q:p + P + q + Q]
        for lag, c in polynomial(ar, sar, m, -1.0).items():
            v[at_w[lag]] += c
        for lag, c in polynomial(ma, sma, m, 1.0).items():
            v[at_e[lag]] -= c
        if constant:
            v[0] = -x[-1]
        return v
    x = np.zeros(size)
    v = vector(x)
    value = float(v @ M @ v)
    for _ in range(STEPS if size else 0):
        J = np.column_stack([(vector(x + h) - vector(x - h)) / 2e-4 for h in np.eye(size) * 1e-4])   # the vector is bilinear: exact
        move = np.linalg.lstsq(J.T @ M @ J, -(J.T @ M @ v), rcond=None)[0]
        scale, gain = 1.0, 0.0
        while scale > 1e-4:
            new = vector(x + scale * move)
            after = float(new @ M @ new)
            if after < value:
                gain, x, v, value = value - after, x + scale * move, new, after
                break
            scale /= 2
        if gain <= TOLERANCE * max(value, 1e-300):
            break
    return x, value


FITTED = ("p int, d int, q int, `P` int, `D` int, `Q` int, m int, const double, ar array<double>, ma array<double>, sar array<double>, "
          "sma array<double>, sigma2 double, aicc double, n long")
# Spark's names ignore case, so the seasonal orders are spelled out
FITTED = FITTED.replace("`P`", "seasonal_p").replace("`D`", "seasonal_d").replace("`Q`", "seasonal_q")


def sarima_fit(df: DataFrame, keys: Sequence[str], order_col: str, value: str, m: int = 12, max_p: int = 5, max_q: int = 5,
               max_P: int = 2, max_Q: int = 2, d: int | None = None, D: int | None = None, ic: str = "aicc",
               order: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The model of least criterion of every series: orders, coefficients, variance, criterion.

    ``order`` (p, q, P, Q) fixes the orders; ``d`` and ``D`` fix the differencing, which the tests choose
    otherwise.  ``m`` = 1 is a model without seasons.  A series too short for any candidate has no row."""
    ship_package(df.sparkSession)
    keys = list(keys)
    if not keys:
        return sarima_fit(df.withColumn("_all", F.lit(0)), ["_all"], order_col, value, m, max_p, max_q, max_P, max_Q, d, D, ic, order).drop("_all")
    if m <= 1:
        m, max_P, max_Q, D = 1, 0, 0, 0
    if order:
        max_p, max_q, max_P, max_Q = order
    limit = MAX_ORDER if not order else sum(order)
    grid = [order] if order else [o for o in itertools.product(range(max_p + 1), range(max_q + 1), range(max_P + 1), range(max_Q + 1))
                                  if sum(o) <= limit]
    n_max = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    test_lags = int(4 * (max(n_max, 1) / 100) ** 0.25)
    wl, el = _lags(max_p, max_P, m), _lags(max_q, max_Q, m)
    near = max(max_p + max_q + 2, 6)
    long = sorted({*range(1, near + 1), *(j * m + i for j in range(1, LONG_SEASONS + 1) for i in range(-2, 3) if m > 1 and j * m + i > 0)})
    span = max(max(long), 8 * m if m > 1 else 0, 48) + 1
    reach = max([*wl, *el, 0]) + span + 2 + m * 2
    blocks = _blocks(df, keys, order_col, value, max(reach, test_lags + 2 + m, m + 1))

    # differencing
    sized = blocks.groupBy(*keys).agg(F.max(F.col("start") + F.size("v")).alias("rows"))
    if D is None:
        strong = seasonal_strength(blocks, keys, m)
        sized = sized.join(strong, keys, "left").select(
            *keys, "rows", F.when((F.col("strength") > STRENGTH) & (F.col("rows") >= 3 * m), 1).otherwise(0).alias("_sd"))
    else:
        sized = sized.withColumn("_sd", F.lit(D))
    sized = ranks.materialize(sized)
    blocks = blocks.join(sized.select(*keys, "_sd"), keys)
    if d is None:
        tests = kpss(blocks, keys, m, test_lags)
        # the first order whose statistic passes; a constant series needs none
        passed = tests.where((F.col("kpss") <= KPSS_LEVEL) | F.col("kpss").isNull() | F.isnan("kpss") | (F.col("d") == 2))
        chosen = ranks.materialize(passed.groupBy(*keys).agg(F.min("d").alias("_nd")))
        blocks = blocks.join(chosen, keys)
    else:
        blocks = blocks.withColumn("_nd", F.lit(d))

    blocks = ranks.materialize(blocks.join(sized.select(*keys, "rows"), keys))

    # long autoregression; short series take the lags that a quarter of their rows allows
    k1 = len(long) + 2

    def first(r):
        use = [i for i, k in enumerate(long) if k <= max(r["rows"] // 4, 1)]
        top = long[use[-1]] if use else 0
        w, _ = _own(r, m, r["_sd"], r["_nd"], top)
        if len(w) <= top:
            return []
        rows = np.zeros((len(w) - top, k1))
        rows[:, 0], rows[:, -1] = 1.0, w[top:]
        for i in use:
            rows[:, i + 1] = w[top - long[i]:len(w) - long[i]]
        return [(len(rows), *_upper(rows))]
    sums1 = [f"s{i}" for i in range(k1 * (k1 + 1) // 2)]
    mom = _per_block(blocks, keys, "n long, " + ", ".join(f"{c} double" for c in sums1), first).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums1])

    def solve_long(r):
        M = _square([r[c] for c in sums1], k1)
        b = np.linalg.lstsq(M[:-1, :-1], M[:-1, -1], rcond=None)[0]
        pi = np.zeros(max(long) + 1)
        pi[0] = 1.0
        pi[long] = -b[1:]
        return [(pi.tolist(), float(b[0] / pi.sum()) if abs(pi.sum()) > 1e-6 else 0.0)]
    filters = _per_block(mom, keys, "pi array<double>, mu double", solve_long)

    # moments of every candidate, the residuals first from the autoregression, then from the model found
    k2 = 2 + len(wl) + len(el)
    sums2 = [f"s{i}" for i in range(k2 * (k2 + 1) // 2)]

    def second(r):
        reach = max(r["rows"] // 3, 2)
        use_w, use_e = [k for k in wl if k <= reach], [k for k in el if k <= reach]
        far, pi, mu = max([*use_w, *use_e, 0]), np.array(r["pi"]), r["mu"]
        w, lead = _own(r, m, r["_sd"], r["_nd"], far + len(pi) - 1)
        own, real = len(w) - lead, min(lead, far)
        if not own:
            return []
        # before the series: its mean
        padded = np.r_[np.full(far + len(pi) - 1 - lead, mu), w]
        e = np.convolve(padded - mu, pi, "valid")
        x, skip, end = padded[-(far + own):], far - real, far + own
        rows = np.zeros((own, k2))
        rows[:, 0], rows[:, -1] = 1.0, x[far:]
        for i, k in enumerate(wl):
            if k in use_w:
                rows[:, 1 + i] = x[far - k:end - k]
        for i, k in enumerate(el):
            if k in use_e:
                rows[:, 1 + len(wl) + i] = e[far - k:end - k]
        rows = rows[skip:]
        return [(r["_nd"], r["_sd"], r["rows"], len(rows), *_upper(rows))] if len(rows) else []

    def choose(r):
        M, n, dd, DD = _square([r[c] for c in sums2], k2), r["n"], r["d"], r["seasonal_d"]
        constant, reach = dd + DD <= 1, max(r["rows"] // 3, 2)
        found = []
        for o in grid:
            p, q, P, Q = o
            k = sum(o) + constant + 1
            if n - k - 1 <= 0 or max(p + m * P, q + m * Q) > reach:
                continue
            x, sse = _solve(M, o, m, wl, el, constant)
            ar, sar, ma, sma = x[:p], x[p:p + P], x[p + P:p + P + q], x[p + P + q:p + P + q + Q]
            if not (_outside(ar, -1.0) and _outside(sar, -1.0) and _outside(ma, 1.0) and _outside(sma, 1.0)):
                continue
            penalty = {"aic": 2 * k, "bic": k * math.log(n)}.get(ic, 2 * k + 2 * k * (k + 1) / (n - k - 1))
            found.append((n * math.log(max(sse / n, 1e-300)) + penalty, o, sse, x))
        if not found:
            return []
        score, (p, q, P, Q), sse, x = min(found, key=lambda f: (f[0], f[1]))
        parts = [x[:p], x[p + P:p + P + q], x[p:p + P], x[p + P + q:p + P + q + Q]]
        return [(p, dd, q, P, DD, Q, m, float(x[-1]) if constant else 0.0, *(a.tolist() for a in parts),
                 float(sse / max(n - len(x), 1)), float(score), n)]

    def inverted(r):
        """The model found, as an autoregression of many lags."""
        ar, ma = (_dense(polynomial(*c, m, sign)) for c, sign in (((r["ar"], r["sar"]), -1.0), ((r["ma"], r["sma"]), 1.0)))
        pi = np.convolve(_power_series(ma, span), ar)[:span]
        return [(pi.tolist(), float(r["const"] / ar.sum()))]
    fitted = None
    for turn in range(ROUNDS):
        if turn:
            filters = _per_block(fitted, keys, "pi array<double>, mu double", inverted)
        sums = _per_block(blocks.join(filters, keys), keys, "d int, seasonal_d int, rows long, n long, " + ", ".join(f"{c} double" for c in sums2), second)
        sums = sums.groupBy(*keys).agg(F.max("d").alias("d"), F.max("seasonal_d").alias("seasonal_d"), F.max("rows").alias("rows"),
                                       F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums2])
        fitted = ranks.materialize(_per_block(sums, keys, FITTED, choose))     # a row a series
    return fitted


# ------------------------------------------------------------------ forecasts

def _dense(terms: dict[int, float]) -> np.ndarray:
    out = np.zeros(max(terms, default=0) + 1)
    out[0] = 1.0
    for lag, c in terms.items():
        out[lag] = c
    return out


def _power_series(poly: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` coefficients of 1 / poly, doubling their number by Newton steps."""
    out = np.array([1.0])
    while len(out) < n:
        size = min(2 * len(out), n)
        error = np.convolve(poly[:size], out)[:size]
        error = np.r_[error, np.zeros(size - len(error))]
        error[0] -= 1.0
        out = np.r_[out, np.zeros(size - len(out))] - np.convolve(out, error)[:size]
    return out


def residual_tail(u: np.ndarray, before: np.ndarray, theta: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """The last residuals (newest first) of e_t = u_t - sum theta_j e_{t-j}, given those ``before`` (newest first)."""
    k = len(theta) - 1
    x = u.copy()
    for t in range(min(k, len(x))):
        x[t] -= theta[t + 1:] @ before[:k - t]
    tail = [float(x[max(0, i - len(inverse) + 1):i + 1][::-1] @ inverse[:i + 1]) for i in range(len(x) - 1, max(len(x) - 1 - k, -1), -1)]
    return np.r_[tail, before[:k - len(tail)]][:k]


def sarima_forecast(df: DataFrame, fitted: DataFrame, keys: Sequence[str], order_col: str, value: str, h: int = 12) -> DataFrame:
    """(keys, step, predicted, lower, upper) of every fitted series, 95 % limits."""
    ship_package(df.sparkSession)
    keys = list(keys)
    if not keys:
        return sarima_forecast(df.withColumn("_all", F.lit(0)), fitted.withColumn("_all", F.lit(0)), ["_all"], order_col, value, h).drop("_all")
    fitted = ranks.materialize(fitted)
    reach = fitted.agg(F.max(F.col("p") + F.col("m") * F.col("seasonal_p") + F.col("d") + F.col("m") * F.col("seasonal_d"))).first()[0] or 0
    blocks = _blocks(df, keys, order_col, value, reach + 1)
    schema = T.StructType([df.schema[k] for k in keys]).add("step", "integer").add("predicted", "double").add("lower", "double").add("upper", "double")
    x, size = blocks.join(fitted, keys), BLOCK

    def run(batches):
        fields = to_arrow_schema(schema)
        key, last, e, theta, inverse = None, None, None, None, None

        def forecast():
            out, (phi, full) = [], last["_polys"]
            y, res = list(last["v"]), list(e)
            for i in range(h):
                v = last["const"] - sum(c * y[-k] for k, c in enumerate(full) if k and k <= len(y))
                v += sum(theta[j] * res[j - i - 1] for j in range(i + 1, len(theta)) if j - i - 1 < len(res))
                y.append(v)
                out.append(v)
            psi = _power_series(full, h)
            psi = np.convolve(psi, theta)[:h]
            se = np.sqrt(last["sigma2"] * np.cumsum(np.r_[psi, np.zeros(h - len(psi))] ** 2))
            return [(*key, i + 1, v, v - Z975 * s, v + Z975 * s) for i, (v, s) in enumerate(zip(out, se.tolist()))]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = tuple(r[k] for k in keys)
                if own != key:
                    if key is not None:
                        out += forecast()
                    key = own
                    theta = _dense(polynomial(r["ma"], r["sma"], r["m"], 1.0))
                    inverse = _power_series(theta, size)
                    e = np.zeros(len(theta) - 1)
                ar = _dense(polynomial(r["ar"], r["sar"], r["m"], -1.0))
                full = ar
                for _ in range(r["seasonal_d"]):
                    full = np.convolve(full, _dense({r["m"]: -1.0}))
                for _ in range(r["d"]):
                    full = np.convolve(full, [1.0, -1.0])
                top = len(ar) - 1
                w, lead = _own(r, r["m"], r["seasonal_d"], r["d"], top)
                padded = np.r_[np.zeros(top - lead), w]           # before the first value: nothing
                u = np.convolve(padded, ar, "valid") - r["const"] if len(padded) > top else np.zeros(0)
                e = residual_tail(u, e, theta, inverse)
                last = r | {"_polys": (ar, full)}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), fields)], schema=fields)
        if key is not None:
            out = forecast()
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), fields)], schema=fields)
    return x.repartition(*keys).sortWithinPartitions(*keys, "block").mapInArrow(run, schema)
