"""Time-series models for many series at once.

ARIMA(p, d, q) is fitted by Hannan-Rissanen: (1) a long autoregression gives
residual estimates, (2) the series is regressed on its own lags and lagged
residuals.  Both stages are cross-moment aggregates grouped by series over
lag windows (``halo_blocks``, so a long series is never one task); each
series' small solve runs in ``applyInPandas`` on its single moment row, and
every order in the grid is scored by AICc from the same moments.  ETS(A,N,N)
and ETS(A,A,N) use their ARIMA(0,1,1) / ARIMA(0,2,2) equivalents; the theta
method is SES plus half the linear-trend slope.  VAR(p) for a system of series
is one cross-moment aggregate and a small multivariate solve.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.stats import norm_ppf
from . import series
from .validation import running_totals

Z975 = norm_ppf(0.975)


def _diff(df: DataFrame, keys, order_col, value, d: int) -> DataFrame:
    x = df.select(*keys, order_col, F.col(value).cast("double").alias("_y0"))
    cur = "_y0"
    for k in range(1, d + 1):
        x = series.lag_features(x, cur, [order_col], keys, [1], prefix=f"_dl{k}_")
        x = x.withColumn(f"_y{k}", F.col(cur) - F.col(f"_dl{k}_1")).drop(f"_dl{k}_1")
        cur = f"_y{k}"
    return x.withColumnRenamed(cur, "_w") if d > 0 else x.withColumn("_w", F.col("_y0"))


def _moment_cols(cols):
    return [F.sum(cols[i] * cols[j]).alias(f"m_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]


def _mat(row, k):
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m_{i}_{j}"]
    return m


def arima_fit(df: DataFrame, keys: Sequence[str], order_col: str, value: str, d: int = 1,
              max_p: int = 3, max_q: int = 2, orders: Sequence[tuple[int, int]] | None = None,
              long_ar: int | None = None) -> DataFrame:
    """Per series: chosen (p, d, q) by AICc, constant, AR and MA coefficients,
    innovation variance.  ``orders`` restricts the (p, q) grid."""
    keys = list(keys)
    grid = list(orders) if orders else [(p, q) for p in range(max_p + 1) for q in range(max_q + 1)]
    P = max(p for p, _ in grid)
    Q = max(q for _, q in grid)
    m = long_ar or max(P + Q + 2, 4)
    x = _diff(df, keys, order_col, value, d)
    # stage 1: long AR(m) on the differenced series
    x = series.lag_features(x, "_w", [order_col], keys, list(range(1, m + 1)), prefix="_a")
    # the lagged design feeds both stage-1 moments and the residual pass:
    # materialise it once in the shared checkpoint folder (cuts the lineage)
    x = ranks.materialize(x)
    c1 = [F.lit(1.0)] + [F.col(f"_a{j}") for j in range(1, m + 1)] + [F.col("_w")]
    ok1 = F.col("_w").isNotNull()
    for j in range(1, m + 1):
        ok1 = ok1 & F.col(f"_a{j}").isNotNull()
    mom1 = x.where(ok1).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_moment_cols(c1))
    k1 = m + 1

    def solve_long(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            M = _mat(r, k1 + 1)
            b = np.linalg.lstsq(M[:k1, :k1], M[:k1, k1], rcond=None)[0]
            out.append({**{k: r[k] for k in keys}, **{f"_s1_{j}": float(b[j]) for j in range(k1)}})
        return pd.DataFrame(out, columns=keys + [f"_s1_{j}" for j in range(k1)])

    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    s1 = mom1.groupBy(*keys).applyInPandas(
        solve_long, f"{key_schema + ', ' if keys else ''}" + ", ".join(f"_s1_{j} double" for j in range(k1)))
    x = x.join(s1, keys) if keys else ranks.attach_scalars(x, s1)
    fit1 = F.col("_s1_0")
    for j in range(1, m + 1):
        fit1 = fit1 + F.col(f"_s1_{j}") * F.col(f"_a{j}")
    x = x.withColumn("_e", F.when(ok1, F.col("_w") - fit1))
    x = x.select(*keys, order_col, "_w", "_e", *[f"_a{j}" for j in range(1, P + 1)])
    # stage 2: lags of the residual estimates
    if Q > 0:
        x = series.lag_features(x, "_e", [order_col], keys, list(range(1, Q + 1)), prefix="_b")
    regs = [F.lit(1.0)] + [F.col(f"_a{j}") for j in range(1, P + 1)] + [F.col(f"_b{j}") for j in range(1, Q + 1)]
    c2 = regs + [F.col("_w")]
    ok2 = F.col("_w").isNotNull()
    for c in regs[1:]:
        ok2 = ok2 & c.isNotNull()
    mom2 = x.where(ok2).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_moment_cols(c2))
    K = 1 + P + Q

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, r in pdf.iterrows():
            M = _mat(r, K + 1)
            n = int(r["_n"])
            best = None
            for p, q in grid:
                idx = [0] + list(range(1, p + 1)) + list(range(1 + P, 1 + P + q))
                A, c = M[np.ix_(idx, idx)], M[idx, K]
                b = np.linalg.lstsq(A, c, rcond=None)[0]
                ssr = float(M[K, K] - 2 * b @ c + b @ A @ b)
                s2 = max(ssr / n, 1e-300)
                k = len(idx) + 1
                aicc = n * math.log(s2) + 2 * k + (2 * k * (k + 1) / (n - k - 1) if n - k - 1 > 0 else math.inf)
                if best is None or aicc < best[0]:
                    best = (aicc, p, q, b, ssr / max(n - len(idx), 1))
            aicc, p, q, b, s2 = best
            rows.append({**{k: r[k] for k in keys}, "p": p, "d": d, "q": q, "const": float(b[0]),
                         "ar": [float(v) for v in b[1:1 + p]], "ma": [float(v) for v in b[1 + p:]],
                         "sigma2": float(s2), "aicc": float(aicc), "n": n})
        return pd.DataFrame(rows)

    return mom2.groupBy(*keys).applyInPandas(
        choose, f"{key_schema + ', ' if keys else ''}p int, d int, q int, const double, ar array<double>, "
                "ma array<double>, sigma2 double, aicc double, n long")


def _psi(ar: list[float], ma: list[float], d: int, h: int) -> np.ndarray:
    """MA(infinity) weights of phi(B)(1-B)^d y = theta(B) e."""
    phi = np.array([1.0] + [-a for a in ar])
    for _ in range(d):
        phi = np.convolve(phi, [1.0, -1.0])
    theta = np.array([1.0] + list(ma))
    psi = np.zeros(h)
    for j in range(h):
        v = theta[j] if j < len(theta) else 0.0
        for i in range(1, min(j, len(phi) - 1) + 1):
            v -= phi[i] * psi[j - i]
        psi[j] = v
    return psi


def _filter_state(df: DataFrame, model: DataFrame, keys: Sequence[str], order_col: str, value: str) -> DataFrame:
    """(keys, e): the last q residuals of the ARMA filter over the WHOLE series, newest first.

    With u_t = w_t - const - sum ar_i w_{t-i} (w: differenced, pre-sample terms 0) the filter
    is e_t = u_t - sum ma_j e_{t-j}.  Over a block of rows it is an affine map of the q
    residuals before it, so every block is folded on its own (its map needs only the
    block's u and length) and the few blocks of a series are then applied in order."""
    keys = list(keys)
    head = model.select(*keys, "p", "d", "q", "const", "ar", "ma")
    depth, longest = head.agg(F.max(F.col("p") + F.col("d")), F.max("q")).first()
    x = df.select(*keys, order_col, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not longest:
        return head.select(*keys, F.array().cast("array<double>").alias("e"))
    x = series.lag_features(x, "_v", [order_col], keys, list(range(1, depth + 1)), prefix="_y") if depth else x
    x = series.halo_blocks(x, keys, [order_col], 0)
    x = x.join(head, keys) if keys else ranks.attach_scalars(x, head)
    lagged = ["_v", *[f"_y{i}" for i in range(1, depth + 1)]]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col, kind="stable")
        r = pdf.iloc[0]
        p, d, q, c = int(r["p"]), int(r["d"]), int(r["q"]), float(r["const"])
        y = pdf[lagged].to_numpy(float)                     # newest first: y_t, y_{t-1}, ...
        for _ in range(d):
            y = y[:, :-1] - y[:, 1:]
        ok = ~np.isnan(y[:, 0])                             # rows with a differenced value
        u = y[ok, 0] - c - np.nan_to_num(y[ok, 1:p + 1]) @ np.array(list(r["ar"]), float)
        ma = np.array(list(r["ma"]), float)
        step = np.zeros((q, q))
        step[1:, :-1] = np.eye(max(q - 1, 0))
        if q:
            step[0] = -ma
        e = np.zeros(q)
        for v in u:
            e = step @ e
            e[:1] += v
        return pd.DataFrame([{**{k: r[k] for k in keys}, "_blk": int(r["_blk"]), "end": e.tolist(),
                              "map": np.linalg.matrix_power(step, len(u)).ravel().tolist()}])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_blk")
        e = np.zeros(len(pdf.iloc[0]["end"]))
        for end, m in zip(pdf["end"], pdf["map"]):
            e = np.array(list(m), float).reshape(len(e), len(e)) @ e + np.array(list(end), float)
        return pd.DataFrame([{**{k: pdf.iloc[0][k] for k in keys}, "e": e.tolist()}])

    key_schema = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    blocks = x.groupBy(*keys, "_blk").applyInPandas(fold, f"{key_schema}_blk int, end array<double>, map array<double>")
    return blocks.groupBy(*keys).applyInPandas(chain, f"{key_schema}e array<double>")


def arima_forecast(df: DataFrame, model: DataFrame, keys: Sequence[str], order_col: str, value: str,
                   h: int = 12) -> DataFrame:
    """Recursive h-step forecasts with 95 % intervals per series.  The recursion needs the
    last p + d observations (a bounded top-k) and the last q residuals, which carry the
    filter's state over the whole series."""
    keys = list(keys)
    state = _filter_state(df, model, keys, order_col, value)
    need = model.agg(F.max(F.col("p") + F.col("d"))).first()[0] or 0
    last = ranks.top_k_per_group(df.select(*keys, order_col, F.col(value).cast("double").alias("_v"))
                                 .where(F.col("_v").isNotNull()), keys, [F.col(order_col).desc()],
                                 max(need, 1)).select(*keys, "_rank", "_v")
    full = model.join(state, keys) if keys else ranks.attach_scalars(model, state)
    x = last.join(full, keys) if keys else ranks.attach_scalars(last, full)

    def fc(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank", ascending=False)
        r0 = pdf.iloc[0]
        p, d, q = int(r0["p"]), int(r0["d"]), int(r0["q"])
        ar, ma, e = list(r0["ar"]), list(r0["ma"]), list(r0["e"])      # e: newest first
        c, s2 = float(r0["const"]), float(r0["sigma2"])
        w = pdf["_v"].to_numpy(float)
        levels = []
        for _ in range(d):
            levels.append(w[-1])
            w = np.diff(w)
        w = list(w)
        preds = []
        for k in range(h):
            v = c + sum(ar[i] * w[-1 - i] for i in range(p) if len(w) > i)
            v += sum(ma[j] * e[j - k] for j in range(k, q) if j - k < len(e))
            w.append(v)
            preds.append(v)
        out = np.array(preds)
        for lvl in reversed(levels):
            out = lvl + np.cumsum(out)
        psi = _psi(ar, ma, d, h)
        se = np.sqrt(s2 * np.cumsum(psi ** 2))
        base = {k: r0[k] for k in keys}
        return pd.DataFrame([{**base, "step": i + 1, "predicted": float(out[i]),
                              "lower": float(out[i] - Z975 * se[i]), "upper": float(out[i] + Z975 * se[i])}
                             for i in range(h)])

    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return x.groupBy(*keys).applyInPandas(
        fc, f"{key_schema + ', ' if keys else ''}step int, predicted double, lower double, upper double")


def ets_fit(df, keys, order_col, value, model: str = "ANN"):
    """ETS(A,N,N) ~ ARIMA(0,1,1), ETS(A,A,N) ~ ARIMA(0,2,2); alpha = 1 + theta1."""
    if model.upper() == "ANN":
        m = arima_fit(df, keys, order_col, value, d=1, orders=[(0, 1)])
    elif model.upper() == "AAN":
        m = arima_fit(df, keys, order_col, value, d=2, orders=[(0, 2)])
    else:
        raise ValueError(f"ets model {model} is not supported (ANN, AAN)")
    # no drift in the exponential-smoothing form
    return m.withColumn("const", F.lit(0.0)).withColumn(
        "alpha", F.least(F.greatest(1 + F.col("ma")[0], F.lit(1e-4)), F.lit(1.0)))


def theta_forecast(df: DataFrame, keys: Sequence[str], order_col: str, value: str, h: int = 12) -> DataFrame:
    """Theta method: SES (from ARIMA(0,1,1) without constant) plus half the
    slope of a linear trend in time, damped by the SES weight."""
    keys = list(keys)
    ses = ets_fit(df, keys, order_col, value, "ANN").withColumn("const", F.lit(0.0))
    f = arima_forecast(df, ses, keys, order_col, value, h)
    rt = running_totals(df.select(*keys, order_col, value), keys, [order_col], value)
    tr = rt.groupBy(*keys).agg(F.regr_slope(F.col(value).cast("double"), F.col("cum_n").cast("double")).alias("_b"),
                               F.count(F.lit(1)).alias("_n"))
    a = ses.select(*keys, "alpha")
    x = f.join(tr, keys).join(a, keys) if keys else ranks.attach_scalars(ranks.attach_scalars(f, tr), a)
    adj = F.col("_b") / 2 * (F.col("step") - 1 + 1 / F.col("alpha")
                             - F.pow(1 - F.col("alpha"), F.col("_n")) / F.col("alpha"))
    return x.select(*keys, "step", (F.col("predicted") + adj).alias("predicted"),
                    (F.col("lower") + adj).alias("lower"), (F.col("upper") + adj).alias("upper"))


# ----------------------------------------------------------------- VAR

def var_fit(df: DataFrame, order_col: str, cols: Sequence[str], max_p: int = 4, ic: str = "AIC",
            trend: str = "const") -> dict:
    """VAR(p) with p chosen by AIC/HQ/SC/FPE over a common sample; one
    cross-moment aggregate over the lag columns of every series."""
    cols = list(cols)
    K = len(cols)
    x = df.select(order_col, *[F.col(c).cast("double").alias(c) for c in cols])
    x = series.lags_many(x, {c: list(range(1, max_p + 1)) for c in cols}, [order_col], [])
    lagc = [f"{c}__l{j}" for j in range(1, max_p + 1) for c in cols]   # ordered by lag, then series
    ok = F.lit(True)
    for c in lagc + cols:
        ok = ok & F.col(c).isNotNull()
    det = {"const": [F.lit(1.0)], "none": [], "trend": [], "both": [F.lit(1.0)]}[trend]
    if trend in ("trend", "both"):
        x = running_totals(x, [], [order_col], cols[0]).drop("cum_sum")
        det = det + [F.col("cum_n").cast("double")]       # 1, 2, ... in time
    allc = det + [F.col(c) for c in lagc] + [F.col(c) for c in cols]
    r = x.where(ok).agg(F.count(F.lit(1)).alias("_n"), *_moment_cols(allc)).first().asDict()
    T = int(r["_n"])
    D = len(det)
    M = _mat(r, len(allc))
    ycols = list(range(D + K * max_p, D + K * max_p + K))
    best = None
    for p in range(1, max_p + 1):
        xi = list(range(D)) + list(range(D, D + K * p))
        XX, XY, YY = M[np.ix_(xi, xi)], M[np.ix_(xi, ycols)], M[np.ix_(ycols, ycols)]
        B = np.linalg.lstsq(XX, XY, rcond=None)[0]
        S = (YY - B.T @ XY - XY.T @ B + B.T @ XX @ B) / T
        ld = math.log(max(np.linalg.det(S), 1e-300))
        npar = len(xi) * K
        crit = {"AIC": ld + 2 * npar / T, "HQ": ld + 2 * math.log(math.log(T)) * npar / T,
                "SC": ld + math.log(T) * npar / T,
                "FPE": ((T + len(xi)) / (T - len(xi))) ** K * math.exp(ld)}[ic.upper()]
        if best is None or crit < best[0]:
            best = (crit, p, B, S * T / max(T - len(xi), 1))
    _, p, B, S = best
    return {"p": p, "coef": B, "sigma": S, "cols": cols, "trend": trend, "n": T, "det": D}


def var_forecast(df: DataFrame, order_col: str, fit: dict, h: int = 12) -> DataFrame:
    """Recursive forecasts with MA(infinity) intervals; the last p rows are the
    only data the driver reads."""
    cols, p, B, S, D = fit["cols"], fit["p"], fit["coef"], fit["sigma"], fit["det"]
    K = len(cols)
    last = ranks.top_k_per_group(df.select(order_col, *cols), [], [F.col(order_col).desc()], p).collect()
    hist = [np.array([float(r[c]) for c in cols]) for r in sorted(last, key=lambda r: r["_rank"], reverse=True)]
    A = [B[D + K * (j - 1): D + K * j, :].T for j in range(1, p + 1)]   # K x K per lag
    c = B[0, :] if fit["trend"] in ("const", "both") else np.zeros(K)
    slope = B[D - 1, :] if fit["trend"] in ("trend", "both") else np.zeros(K)
    n = df.select(order_col).count() if slope.any() else 0
    preds = []
    for t in range(1, h + 1):
        v = c + slope * (n + t)
        for j in range(1, p + 1):
            v = v + A[j - 1] @ hist[-j]
        hist.append(v)
        preds.append(v)
    Phi = [np.eye(K)]
    for i in range(1, h):
        Phi.append(sum(Phi[i - j] @ A[j - 1] for j in range(1, min(i, p) + 1)))
    rows = []
    cov = np.zeros((K, K))
    for s in range(h):
        cov = cov + Phi[s] @ S @ Phi[s].T
        for k, name in enumerate(cols):
            se = math.sqrt(max(cov[k, k], 0.0))
            rows.append((name, s + 1, float(preds[s][k]), float(preds[s][k] - Z975 * se), float(preds[s][k] + Z975 * se)))
    return df.sparkSession.createDataFrame(rows, "series_id string, step int, predicted double, lower double, upper double")


# ----------------------------------------------------------------- decomposition

def decompose(df: DataFrame, keys: Sequence[str], order_col: str, value: str, m: int = 12) -> DataFrame:
    """Classical additive decomposition per series: centred moving average of
    order m (2 x m for even m) as trend, seasonal means of the detrended values
    by position mod m centred to sum zero, remainder.  Positions come from
    block-offset running counts; the centred window is evaluated at its last
    row (a trailing window in a blocked pass) and joined back by position."""
    keys = list(keys)
    x = running_totals(df.select(*keys, order_col, F.col(value).cast("double").alias("_y")), keys, [order_col], "_y")
    x = x.withColumnRenamed("cum_n", "pos").drop("cum_sum")
    half = m // 2
    span = m if m % 2 == 0 else m - 1          # rows before the window's last row
    hb = series.halo_blocks(x, keys, [order_col], span)
    from pyspark.sql import Window
    w = Window.partitionBy(*keys, "_blk").orderBy(order_col).rowsBetween(-span, 0)
    wl = Window.partitionBy(*keys, "_blk").orderBy(order_col)
    if m % 2 == 0:
        tr = (F.sum("_y").over(w) - 0.5 * F.lag("_y", span).over(wl) - 0.5 * F.col("_y")) / m
    else:
        tr = F.avg("_y").over(w)
    hb = hb.withColumn("_tr", F.when(F.count(F.lit(1)).over(w) == span + 1, tr))
    trend = hb.where(~F.col("_halo") & F.col("_tr").isNotNull()).select(
        *keys, (F.col("pos") - half).alias("pos"), F.col("_tr").alias("trend"))
    y = x.join(trend, [*keys, "pos"], "left").withColumn("season", ((F.col("pos") - 1) % m).cast("int"))
    s = (y.where(F.col("trend").isNotNull()).groupBy(*keys, "season")
         .agg(F.avg(F.col("_y") - F.col("trend")).alias("_s")))
    from pyspark.sql import Window as W2
    s = s.withColumn("seasonal", F.col("_s") - F.avg("_s").over(W2.partitionBy(*keys))).drop("_s")
    out = y.join(s, [*keys, "season"], "left")
    return out.select(*keys, order_col, "pos", "season", F.col("_y").alias(value), "trend", "seasonal",
                      (F.col("_y") - F.col("trend") - F.col("seasonal")).alias("remainder"))


def stl_arima_forecast(df: DataFrame, keys: Sequence[str], order_col: str, value: str, m: int = 12,
                       h: int = 12) -> DataFrame:
    """Forecast the seasonally adjusted series with ARIMA, then add back the
    seasonal index of each future position."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    if not keys:
        m = int(series.ts_frequency_guard(m, n.first()[0]))
        if m < 2:
            raise ValueError("stl_arima needs a seasonal frequency of at least 2")
    else:
        # each series has its own guard: a short one gets the period that its length allows, one too
        # short for the model's lags its mean; one pass per period in use
        f = F.when(F.col("_len") > m, F.lit(m)).otherwise(F.greatest(F.lit(1), F.floor(F.col("_len") / 2))).cast("int")
        n = ranks.materialize(n.withColumn("_m", F.when((f >= 2) & (F.col("_len") >= 16), f).otherwise(F.lit(1))))
        periods = sorted(r[0] for r in n.select("_m").distinct().collect())     # at most m values
        if periods != [m]:
            out = None
            for own in periods:
                part = df.join(n.where(F.col("_m") == own).select(*keys), keys)
                if own >= 2:
                    res = _stl_arima(part, keys, order_col, value, own, h)
                else:
                    y = F.col(value).cast("double")
                    mean = part.groupBy(*keys).agg(F.avg(y).alias("predicted"), (
                        F.stddev_samp(y) * F.sqrt(1 + 1 / F.count(y))).alias("_se"))
                    res = mean.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"), "predicted", (
                        F.col("predicted") - Z975 * F.col("_se")).alias("lower"), (
                        F.col("predicted") + Z975 * F.col("_se")).alias("upper"))
                out = res if out is None else out.unionByName(res)
            return out
    return _stl_arima(df, keys, order_col, value, m, h)


def _stl_arima(df: DataFrame, keys: list[str], order_col: str, value: str, m: int, h: int) -> DataFrame:
    """``stl_arima_forecast`` for series that all have the seasonal period ``m``."""
    dec = ranks.materialize(decompose(df, keys, order_col, value, m))
    adj = dec.select(*keys, order_col, (F.col(value) - F.col("seasonal")).alias("_adj"))
    model = arima_fit(adj, keys, order_col, "_adj", d=1, max_p=2, max_q=1)
    f = arima_forecast(adj, model, keys, order_col, "_adj", h)
    last = dec.groupBy(*keys).agg(F.max("pos").alias("_n"))
    seas = dec.select(*keys, "season", "seasonal").distinct()
    x = f.join(last, keys) if keys else ranks.attach_scalars(f, last)
    x = x.withColumn("season", ((F.col("_n") + F.col("step") - 1) % m).cast("int")).join(seas, [*keys, "season"])
    return x.select(*keys, "step", (F.col("predicted") + F.col("seasonal")).alias("predicted"),
                    (F.col("lower") + F.col("seasonal")).alias("lower"), (F.col("upper") + F.col("seasonal")).alias("upper"))


# ----------------------------------------------------------------- system models

def _system_moments(df: DataFrame, order_col: str, cols: Sequence[str], p: int):
    """One aggregate: cross moments of [1, lags 1..p of every series, series]."""
    x = df.select(order_col, *[F.col(c).cast("double").alias(c) for c in cols])
    x = series.lags_many(x, {c: list(range(1, p + 1)) for c in cols}, [order_col], [])
    lagc = [f"{c}__l{j}" for j in range(1, p + 1) for c in cols]
    ok = F.lit(True)
    for c in lagc + list(cols):
        ok = ok & F.col(c).isNotNull()
    allc = [F.lit(1.0)] + [F.col(c) for c in lagc] + [F.col(c) for c in cols]
    r = x.where(ok).agg(F.count(F.lit(1)).alias("_n"), *_moment_cols(allc)).first().asDict()
    return int(r["_n"]), _mat(r, len(allc))


def bvar_fit(df: DataFrame, order_col: str, cols: Sequence[str], p: int = 4, lam: float = 0.2,
             cross: float = 0.5) -> dict:
    """VAR(p) with a Minnesota prior (own first lag 1, others 0; prior sd
    lam / l for own lags, lam * cross * s_i / (l s_j) for other series, a flat
    constant); the conjugate posterior mean per equation comes from the same
    cross moments as the VAR (no MCMC; lambda fixed)."""
    cols = list(cols)
    K = len(cols)
    T, M = _system_moments(df, order_col, cols, p)
    nx = 1 + K * p
    XX, XY = M[:nx, :nx], M[:nx, nx:]
    YY = M[nx:, nx:]
    # univariate AR(1) residual scales s_i from the same moments
    s = []
    for i in range(K):
        idx = [0, 1 + i]
        b = np.linalg.lstsq(XX[np.ix_(idx, idx)], XY[idx, i], rcond=None)[0]
        ssr = YY[i, i] - 2 * b @ XY[idx, i] + b @ XX[np.ix_(idx, idx)] @ b
        s.append(math.sqrt(max(ssr / max(T - 2, 1), 1e-12)))
    B = np.zeros((nx, K))
    for i in range(K):
        prior_mean = np.zeros(nx)
        prior_var = np.zeros(nx)
        prior_var[0] = 1e6 * s[i] ** 2
        for lag in range(1, p + 1):
            for j in range(K):
                col = 1 + (lag - 1) * K + j
                sd = lam / lag if j == i else lam * cross * s[i] / (lag * s[j])
                prior_var[col] = sd ** 2
                if j == i and lag == 1:
                    prior_mean[col] = 1.0
        Vinv = np.diag(1 / prior_var)
        A = XX / s[i] ** 2 + Vinv
        B[:, i] = np.linalg.solve(A, XY[:, i] / s[i] ** 2 + Vinv @ prior_mean)
    S = (YY - B.T @ XY - XY.T @ B + B.T @ XX @ B) / max(T - nx, 1)
    return {"p": p, "coef": B, "sigma": S, "cols": cols, "trend": "const", "n": T, "det": 1}


def dfm_forecast(df: DataFrame, order_col: str, cols: Sequence[str], r: int = 2, p: int = 1, h: int = 12) -> DataFrame:
    """Two-step dynamic factor model: principal-component factors of the
    standardised system (covariance from one aggregate), VAR(p) on the
    factors, forecasts mapped back through the loadings."""
    cols = list(cols)
    st = df.agg(*[a for c in cols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    z = {c: (F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"] for c in cols}
    row = df.agg(*_moment_cols([z[c] for c in cols]), F.count(F.lit(1)).alias("_n")).first().asDict()
    C = _mat(row, len(cols)) / (row["_n"] - 1)
    val, vec = np.linalg.eigh(C)
    order = np.argsort(val)[::-1][:r]
    L = vec[:, order]
    for j in range(r):
        if L[np.argmax(np.abs(L[:, j])), j] < 0:
            L[:, j] = -L[:, j]
    fac = df.select(order_col, *[sum((z[c] * float(L[i, j]) for i, c in enumerate(cols)), F.lit(0.0)).alias(f"f{j + 1}")
                                 for j in range(r)])
    fit = var_fit(fac, order_col, [f"f{j + 1}" for j in range(r)], max_p=p)
    ff = var_forecast(fac, order_col, fit, h).collect()
    fmat = {}
    for rr in ff:
        fmat.setdefault(rr["step"], {})[rr["series_id"]] = rr["predicted"]
    rows = []
    for step in sorted(fmat):
        f = np.array([fmat[step][f"f{j + 1}"] for j in range(r)])
        for i, c in enumerate(cols):
            rows.append((c, step, float(st[f"m_{c}"] + st[f"s_{c}"] * (L[i, :] @ f))))
    return df.sparkSession.createDataFrame(rows, "series_id string, step int, predicted double")


# 5 % limits of the trace statistic by the number of relations left (1, 2, ...),
# for a constant within the relations and for an unrestricted one.
TRACE_LIMITS = {"const": (9.24, 19.96, 34.91, 53.12, 76.07, 102.14, 131.70, 165.58, 202.92, 244.15, 291.40),
                "none": (8.18, 17.95, 31.52, 48.28, 70.60, 95.18, 124.25, 157.11, 192.84, 232.49, 277.39)}


def vecm_fit(df: DataFrame, order_col: str, cols: Sequence[str], k: int = 2, r: int | None = 1, ecdet: str = "none") -> dict:
    """Johansen reduced-rank regression.  Delta y_t, y_(t-1) and the k-1 lagged differences come from
    one aggregate of centred cross-moments; the partialled moments S00, S01, S11 (Frisch-Waugh) give
    the eigenproblem.  ``ecdet`` "const" keeps the constant within the cointegrating relations, "none"
    leaves it unrestricted.  ``r`` None takes the first rank whose trace statistic passes no more.
    Returns beta (cointegrating vectors), alpha, Gamma, trace statistics, residual covariance."""
    cols = list(cols)
    K = len(cols)
    if k < 2 or ecdet not in TRACE_LIMITS:
        raise ValueError("vecm needs k >= 2 and ecdet const or none")
    x = df.select(order_col, *[F.col(c).cast("double").alias(c) for c in cols])
    x = series.lags_many(x, {c: list(range(1, k + 1)) for c in cols}, [order_col], [])
    ok = F.lit(True)
    for c in cols:
        for j in range(k + 1):
            v = F.col(f"{c}__l{j}" if j else c)
            ok = ok & v.isNotNull() & ~F.isnan(v)
    x = x.where(ok)
    mean = x.agg(*[F.avg(c).alias(c) for c in cols]).first()
    if mean[0] is None:
        raise ValueError("vecm has no complete rows")
    mu = np.array([float(v) for v in mean])
    level = {c: F.lit(float(m)) for c, m in zip(cols, mu)}       # levels are taken from their mean
    d0 = [F.col(c) - F.col(f"{c}__l1") for c in cols]                                   # delta y_t
    y1 = [F.col(f"{c}__l1") - level[c] for c in cols]                                    # y_(t-1)
    dl = [F.col(f"{c}__l{j}") - F.col(f"{c}__l{j + 1}") for j in range(1, k) for c in cols]  # lagged deltas
    allc = d0 + y1 + [F.lit(1.0)] + dl
    row = x.agg(F.count(F.lit(1)).alias("_n"), *_moment_cols(allc)).first().asDict()
    T = int(row["_n"])
    M = _mat(row, len(allc)) / T
    i0 = list(range(K))
    i1, iz = (list(range(K, 2 * K + 1)), list(range(2 * K + 1, len(allc)))) if ecdet == "const" else \
        (list(range(K, 2 * K)), list(range(2 * K, len(allc))))
    Mzz_inv = np.linalg.pinv(M[np.ix_(iz, iz)])

    def part(a, b):
        return M[np.ix_(a, b)] - M[np.ix_(a, iz)] @ Mzz_inv @ M[np.ix_(iz, b)]
    S00, S01, S11 = part(i0, i0), part(i0, i1), part(i1, i1)
    val, vec = np.linalg.eig(np.linalg.solve(S11, S01.T @ np.linalg.solve(S00, S01)))
    order = np.argsort(val.real)[::-1]
    val, vec = val.real[order], vec.real[:, order]
    trace = [float(-T * np.sum(np.log(1 - val[j:K]))) for j in range(K)]
    if r is None:
        r = next((j for j in range(K) if trace[j] < TRACE_LIMITS[ecdet][K - j - 1]), K - 1)
    beta = vec[:, :r]
    beta = beta / np.sqrt(np.diag(beta.T @ S11 @ beta)) if r else beta
    alpha = S01 @ beta
    Pi = alpha @ beta.T
    # short-run coefficients from the partial regression given Pi
    Gz = (M[np.ix_(i0, iz)] - Pi @ M[np.ix_(i1, iz)]) @ Mzz_inv
    const = Pi[:, K] if ecdet == "const" else Gz[:, 0]
    short = Gz if ecdet == "const" else Gz[:, 1:]
    return {"beta": beta, "alpha": alpha, "Pi": Pi, "Gamma_z": Gz, "eigen": val[:K].tolist(), "trace": trace,
            "cols": cols, "k": k, "r": r, "n": T, "sigma": S00 - alpha @ alpha.T, "ecdet": ecdet,
            "constant": const - Pi[:, :K] @ mu, "short": short}


def vecm_forecast(df: DataFrame, order_col: str, fit: dict, h: int = 12) -> DataFrame:
    """Forecasts of the levels: the error-correction form as a vector autoregression of order k
    (A_1 = I + Pi + Gamma_1, A_j = Gamma_j - Gamma_(j-1), A_k = -Gamma_(k-1)), then its recursion."""
    K, k = len(fit["cols"]), fit["k"]
    gamma = [fit["short"][:, K * j:K * (j + 1)] for j in range(k - 1)]
    A = [np.eye(K) + fit["Pi"][:, :K] + gamma[0], *(gamma[j] - gamma[j - 1] for j in range(1, k - 1)), -gamma[-1]]
    levels = {"cols": fit["cols"], "p": k, "coef": np.vstack([fit["constant"][None], *(a.T for a in A)]), "sigma": fit["sigma"],
              "det": 1, "trend": "const"}
    return var_forecast(df, order_col, levels, h)


# ----------------------------------------------------------------- mixed frequencies

def _midas_weights(poly: str, theta: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, derivative by parameter): Almon polynomial, or exponential Almon normalised to a sum."""
    j = np.arange(1, lags + 1, dtype=float)
    if poly == "almonp":
        powers = j[:, None] ** np.arange(len(theta))[None]
        return powers @ theta, powers
    z = theta[1] * j + theta[2] * j * j
    e = np.exp(z - z.max())
    w = e / e.sum()
    d = np.column_stack([j, j * j])
    return theta[0] * w, np.column_stack([w, theta[0] * w[:, None] * (d - w @ d)])


def midas_fit(y_df: DataFrame, x_df: DataFrame, period_col: str, y: str, x_order_col: str, x: str,
              high_lags: int = 4, degree: int = 1, poly: str = "almonp") -> dict:
    """MIDAS regression: y of a period on sum_j w_j(theta) x_j over the period's last value of x and the
    ``high_lags`` values before it.  ``almonp``: w a polynomial of ``degree``, a linear model.  ``nealmon``:
    theta_0 exp(theta_1 j + theta_2 j^2) over its sum.  The squared error is a quadratic form of the
    weights, so either is fitted on one matrix of centred moments of the lags and y, the second by
    Gauss-Newton from a grid of starts; no pass over the rows depends on the parameters.

    The rows of x form one sequence; its lags are looked up block by block."""
    if poly not in ("almonp", "nealmon"):
        raise ValueError(f"unknown weights {poly}")
    lags = high_lags + 1
    z = midas_lags(x_df, period_col, x_order_col, x, high_lags)
    names = [f"x{j}" for j in range(lags)]
    d = y_df.select(period_col, F.col(y).cast("double").alias("_y")).join(z, period_col).where(
        F.col("_y").isNotNull() & ~F.isnan("_y"))
    for c in names:
        d = d.where(F.col(c).isNotNull() & ~F.isnan(c))
    mean = d.agg(F.count(F.lit(1)), *[F.avg(c) for c in [*names, "_y"]]).first()
    n = int(mean[0])
    k = degree + 1 if poly == "almonp" else 3
    if n <= k + 1:
        raise ValueError(f"midas has {n} complete periods")
    mu = np.array(mean[1:], float)
    M = _mat(d.agg(*_moment_cols([F.col(c) - F.lit(float(m)) for c, m in zip([*names, "_y"], mu)])).first().asDict(), lags + 1)
    S, s, yy = M[:lags, :lags], M[:lags, lags], M[lags, lags]
    sse = lambda w: float(yy - 2 * w @ s + w @ S @ w)
    if poly == "almonp":
        _, P = _midas_weights(poly, np.zeros(k), lags)
        theta = np.linalg.lstsq(P.T @ S @ P, P.T @ s, rcond=None)[0]
        converged = True
    else:
        best = None
        for a in np.linspace(-2, 2, 17):
            for b in np.linspace(-0.5, 0.25, 13):
                w, _ = _midas_weights(poly, np.array([1.0, a, b]), lags)
                scale = float(w @ s / max(w @ S @ w, 1e-300))
                if best is None or sse(scale * w) < best[0]:
                    best = (sse(scale * w), np.array([scale, a, b]))
        value, theta, converged = *best, False
        damp = 1e-3
        for _ in range(500):
            w, J = _midas_weights(poly, theta, lags)
            g, H = J.T @ (s - S @ w), J.T @ S @ J
            move = np.linalg.lstsq(H + damp * np.diag(np.diag(H) + 1e-12), g, rcond=None)[0]
            new = sse(_midas_weights(poly, theta + move, lags)[0])
            if new <= value:
                converged = value - new <= 1e-13 * yy
                theta, value, damp = theta + move, new, damp / 3
                if converged:
                    break
            else:
                damp *= 4
                if damp > 1e12:
                    converged = True      # no way down is left
                    break
    w, _ = _midas_weights(poly, theta, lags)
    return {"intercept": float(mu[lags] - w @ mu[:lags]), "theta": theta.tolist(), "weights": w.tolist(),
            "r2": 1 - sse(w) / yy if yy > 0 else float("nan"), "n": n, "sigma2": sse(w) / (n - k - 1), "converged": bool(converged),
            "high_lags": high_lags, "poly": poly}


def midas_lags(x_df: DataFrame, period_col: str, x_order_col: str, x: str, high_lags: int) -> DataFrame:
    """(period, x0, x1, ...): the last value of x in each period and the values before it."""
    hx = series.lags_many(x_df.select(period_col, x_order_col, F.col(x).cast("double").alias("_x")),
                          {"_x": list(range(1, high_lags + 1))}, [x_order_col], [])
    last = hx.groupBy(period_col).agg(F.max_by(F.struct("_x", *[f"_x__l{j}" for j in range(1, high_lags + 1)]), x_order_col).alias("v"))
    return last.select(period_col, F.col("v._x").alias("x0"), *[F.col(f"v._x__l{j}").alias(f"x{j}") for j in range(1, high_lags + 1)])


def midas_forecast(fit: dict, x_df: DataFrame, period_col: str, x_order_col: str, x: str) -> DataFrame:
    """(period, predicted, lower, upper) of every period that x covers, whether y is known or not."""
    z = midas_lags(x_df, period_col, x_order_col, x, fit["high_lags"])
    p = F.lit(fit["intercept"])
    for j, w in enumerate(fit["weights"]):
        p = p + F.col(f"x{j}") * F.lit(float(w))
    wide = Z975 * math.sqrt(fit["sigma2"])
    return z.select(period_col, p.alias("predicted"), (p - wide).alias("lower"), (p + wide).alias("upper")).where("predicted IS NOT NULL")


# ----------------------------------------------------------------- trend + seasonality

def prophet_forecast(df: DataFrame, keys: Sequence[str], ds: str, y: str, h: int = 12, freq: str = "month",
                     n_changepoints: int = 25, changepoint_range: float = 0.8, changepoint_prior_scale: float = 0.05,
                     seasonality_prior_scale: float = 10.0, yearly_order: int = 10, weekly_order: int = 3) -> DataFrame:
    """Piecewise-linear trend with changepoints over the first 80 % of each
    series' time span plus yearly (and, for daily data, weekly) Fourier terms,
    fitted per series as a MAP estimate with Gaussian priors (ridge penalties
    sigma^2/scale^2), y scaled by its max |y| - all from one grouped
    cross-moment aggregate and a solve in applyInPandas per series."""
    keys = list(keys)
    day = F.unix_date(F.col(ds).cast("date")).cast("double")
    st = df.groupBy(*keys).agg(F.min(day).alias("_t0"), F.max(day).alias("_t1"),
                               F.max(F.abs(F.col(y))).alias("_ys"), F.max(F.col(ds).cast("date")).alias("_last"))
    x = df.join(st, keys) if keys else ranks.attach_scalars(df, st)
    span = F.greatest(F.col("_t1") - F.col("_t0"), F.lit(1.0))
    tau = (day - F.col("_t0")) / span
    feats = [F.lit(1.0), tau]
    names = ["k", "m"]
    for j in range(1, n_changepoints + 1):
        s = changepoint_range * j / (n_changepoints + 1)
        feats.append(F.greatest(tau - F.lit(s), F.lit(0.0)))
        names.append(f"d{j}")
    fourier = []
    for kk in range(1, yearly_order + 1):
        fourier += [F.sin(2 * math.pi * kk * day / 365.25), F.cos(2 * math.pi * kk * day / 365.25)]
    if freq == "day":
        for kk in range(1, weekly_order + 1):
            fourier += [F.sin(2 * math.pi * kk * day / 7.0), F.cos(2 * math.pi * kk * day / 7.0)]
    feats += fourier
    K = len(feats)
    nc = n_changepoints
    allc = feats + [F.col(y).cast("double") / F.col("_ys")]
    mom = x.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_moment_cols(allc))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            M = _mat(r, K + 1)
            XX, Xy, yy = M[:K, :K], M[:K, K], M[K, K]
            n = int(r["_n"])
            base = [0, 1] + list(range(2 + nc, K))          # trend + seasonality, no changepoints
            b0 = np.linalg.lstsq(XX[np.ix_(base, base)], Xy[base], rcond=None)[0]
            s2 = max(float(yy - 2 * b0 @ Xy[base] + b0 @ XX[np.ix_(base, base)] @ b0) / max(n - len(base), 1), 1e-12)
            pen = np.zeros(K)
            pen[2:2 + nc] = s2 / changepoint_prior_scale ** 2
            pen[2 + nc:] = s2 / seasonality_prior_scale ** 2
            b = np.linalg.solve(XX + np.diag(pen) + 1e-12 * np.eye(K), Xy)
            ssr = float(yy - 2 * b @ Xy + b @ XX @ b)
            out.append({**{k: r[k] for k in keys}, "coef": [float(v) for v in b], "sigma2": max(ssr / max(n - 2, 1), 0.0)})
        return pd.DataFrame(out)

    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    model = mom.groupBy(*keys).applyInPandas(solve, f"{key_schema + ', ' if keys else ''}coef array<double>, sigma2 double")
    fut = st.select(*keys, "_t0", "_t1", "_ys", "_last", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    fdate = (F.add_months(F.col("_last"), F.col("step")) if freq == "month"
             else F.date_add(F.col("_last"), F.col("step") * (7 if freq == "week" else 1)))
    fut = fut.withColumn(ds, fdate)
    fut = fut.join(model, keys) if keys else ranks.attach_scalars(fut, model)
    pred = F.lit(0.0)
    for j, f in enumerate(feats):
        pred = pred + f * F.col("coef")[j]
    half = Z975 * F.sqrt(F.col("sigma2"))
    return fut.select(*keys, "step", F.col(ds).cast("string").alias("ds"), (pred * F.col("_ys")).alias("predicted"),
                      ((pred - half) * F.col("_ys")).alias("lower"), ((pred + half) * F.col("_ys")).alias("upper"))


def harmonic_forecast(df: DataFrame, keys: Sequence[str], order_col: str, value: str, periods: Sequence[float],
                      h: int = 12, harmonics: int = 5, box_cox: float | None = None) -> DataFrame:
    """TBATS-style trigonometric seasonality: per series, an (optionally
    Box-Cox transformed) regression on a linear trend and Fourier terms of each
    seasonal period (in observations), from one grouped moment aggregate and a
    solve per series in applyInPandas; forecasts are back-transformed."""
    keys = list(keys)
    x = running_totals(df.select(*keys, order_col, F.col(value).cast("double").alias("_v")), keys, [order_col], "_v")
    t = F.col("cum_n").cast("double")
    yv = F.col("_v") if box_cox is None else (
        F.log("_v") if abs(box_cox) < 1e-9 else (F.pow(F.col("_v"), F.lit(box_cox)) - 1) / box_cox)
    feats = [F.lit(1.0), t]
    for per in periods:
        for kk in range(1, min(harmonics, int(per // 2)) + 1):
            feats += [F.sin(2 * math.pi * kk * t / per), F.cos(2 * math.pi * kk * t / per)]
    K = len(feats)
    mom = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_moment_cols(feats + [yv]))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in pdf.iterrows():
            M = _mat(r, K + 1)
            b = np.linalg.lstsq(M[:K, :K], M[:K, K], rcond=None)[0]
            n = int(r["_n"])
            ssr = float(M[K, K] - 2 * b @ M[:K, K] + b @ M[:K, :K] @ b)
            out.append({**{k: r[k] for k in keys}, "coef": [float(v) for v in b],
                        "sigma2": max(ssr / max(n - K, 1), 0.0), "n": n})
        return pd.DataFrame(out)

    key_schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    model = mom.groupBy(*keys).applyInPandas(solve, f"{key_schema + ', ' if keys else ''}coef array<double>, "
                                                    "sigma2 double, n long")
    fut = model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(h))))
    tf = (F.col("n") + F.col("step")).cast("double")
    ff = [F.lit(1.0), tf]
    for per in periods:
        for kk in range(1, min(harmonics, int(per // 2)) + 1):
            ff += [F.sin(2 * math.pi * kk * tf / per), F.cos(2 * math.pi * kk * tf / per)]
    pred = F.lit(0.0)
    for j, f in enumerate(ff):
        pred = pred + f * F.col("coef")[j]
    half = Z975 * F.sqrt(F.col("sigma2"))

    def back(e):
        if box_cox is None:
            return e
        return F.exp(e) if abs(box_cox) < 1e-9 else F.pow(F.greatest(box_cox * e + 1, F.lit(0.0)), 1 / box_cox)

    return fut.select(*keys, "step", back(pred).alias("predicted"), back(pred - half).alias("lower"),
                      back(pred + half).alias("upper"))
