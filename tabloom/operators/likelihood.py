"""Maximum likelihood of two regressions that no built-in estimator covers: negative binomial
counts and beta proportions.

Every step is one aggregate over the complete rows: the score and the information of all
parameters as sums of JVM expressions (digamma and trigamma included), a small solve on the
driver, and a halved step where the likelihood would fall.  The columns in use are written
once; predictors are centred so that the sums keep their precision."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.special import digamma, lgamma, trigamma
from ..functions.stats import t_sf2
from .models import _complete, _q, train_shape_guard

HALVINGS = 12


def _data(df: DataFrame, y: str, xcols: Sequence[str]):
    """(rows with _y and centred _x0.., means, row count)"""
    data = df.where(_complete([y, *xcols])).select(
        F.col(_q(y)).cast("double").alias("_y"), *[F.col(_q(c)).cast("double").alias(f"_x{i}") for i, c in enumerate(xcols)])
    data = ranks.materialize(data)
    row = data.agg(F.count(F.lit(1)), *[F.avg(f"_x{i}") for i in range(len(xcols))]).first()
    n, mu = int(row[0]), np.array([v or 0.0 for v in row[1:]], float)
    train_shape_guard(n, n, max(len(xcols), 1), "likelihood model")
    return data.select("_y", *[(F.col(f"_x{i}") - F.lit(float(m))).alias(f"_x{i}") for i, m in enumerate(mu)]), mu, n


def _linear(b: np.ndarray) -> Column:
    eta = F.lit(float(b[0]))
    for i, v in enumerate(b[1:]):
        eta = eta + F.col(f"_x{i}") * F.lit(float(v))
    return eta


def _uncentred(coef: np.ndarray, cov: np.ndarray, mu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and covariance for the predictors as they were given; later parameters unchanged."""
    T = np.eye(len(coef))
    T[0, 1:1 + len(mu)] = -mu
    return T @ coef, T @ cov @ T.T


def _newton(step_sums, start: np.ndarray, steps: int, tolerance: float):
    """Scoring from ``start``; ``step_sums(x)`` gives (log-likelihood, score, information)."""
    x = start
    value, score, info = step_sums(x)
    converged = False
    for _ in range(steps):
        move = np.linalg.lstsq(info, score, rcond=None)[0]
        move *= min(1.0, 5.0 / max(np.abs(move).max(), 1e-300))
        for _ in range(HALVINGS):
            after = step_sums(x + move)
            if after[0] >= value - 1e-9 * abs(value):
                break
            move = move / 2
        else:
            break
        x, (value, score, info) = x + move, after
        if float(score @ np.linalg.lstsq(info, score, rcond=None)[0]) < tolerance:
            converged = True
            break
    return x, value, score, info, converged


def _result(xcols, coef, cov, n, extra: dict) -> dict:
    k = 1 + len(xcols)
    se = np.sqrt(np.diag(cov))
    return {"terms": ["(Intercept)", *xcols], "coef": coef[:k].tolist(), "se": se[:k].tolist(), "n": n,
            "p": [t_sf2(float(b / s), n - k) if s > 0 else float("nan") for b, s in zip(coef[:k], se[:k])], **extra}


def negbin_fit(df: DataFrame, y: str, xcols: Sequence[str], max_iter: int = 50, tol: float = 1e-12) -> dict:
    """Negative binomial (variance mu + mu^2 / theta, log link): coefficients and theta together by
    scoring on (b, log theta), which are orthogonal in information; the theta part takes the observed
    information where it is positive.  ``converged`` is False where the counts are not more dispersed
    than Poisson ones (theta grows without bound)."""
    xcols = list(xcols)
    data, mu, n = _data(df, y, xcols)
    k = 1 + len(xcols)
    xs = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(k - 1)]]
    yy = F.col("_y")

    def sums(p: np.ndarray):
        m, theta = F.exp(_linear(p[:k])), F.lit(float(math.exp(p[k])))
        w, resid = m * theta / (m + theta), (yy - m) * theta / (m + theta)
        s = digamma(yy + theta) - digamma(theta) + F.log(theta) + 1 - F.log(m + theta) - (yy + theta) / (m + theta)
        h = trigamma(yy + theta) - trigamma(theta) + 1 / theta - 2 / (m + theta) + (yy + theta) / ((m + theta) * (m + theta))
        ll = lgamma(yy + theta) - lgamma(theta) - lgamma(yy + 1) + theta * F.log(theta) + yy * F.log(m) - (yy + theta) * F.log(m + theta)
        r = data.agg(F.sum(ll), F.sum(s), F.sum(h), *[F.sum(resid * a) for a in xs],
                     *[F.sum(w * xs[i] * xs[j]) for i in range(k) for j in range(i, k)]).first()
        t = math.exp(p[k])
        score = np.array([*r[3:3 + k], r[1] * t], float)
        info = np.zeros((k + 1, k + 1))
        info[np.triu_indices(k)] = r[3 + k:]
        info[:k, :k] = info[:k, :k] + np.triu(info[:k, :k], 1).T
        own = -(r[2] * t * t + r[1] * t)
        info[k, k] = own if own > 1e-12 * n else max(abs(r[1] * t), 1e-12)
        return float(r[0]), score, info
    first = data.agg(F.avg(yy), F.var_samp(yy)).first()
    mean, var = float(first[0]), float(first[1] or 0.0)
    if mean <= 0:
        raise ValueError("the negative binomial needs a positive count")
    start = np.r_[math.log(mean), np.zeros(k - 1), math.log(min(max(mean * mean / (var - mean), 1e-3), 1e3) if var > mean else 1e3)]
    x, value, score, info, converged = _newton(sums, start, max_iter, tol)
    theta = math.exp(x[k])
    cov = np.linalg.pinv(info)
    coef, cov = _uncentred(x, cov, mu)
    return _result(xcols, coef, cov, n, {
        "theta": theta, "theta_se": theta * math.sqrt(cov[k, k]), "loglik": value, "score": np.abs(score).max() / n,
        "converged": bool(converged and theta < 1e7)})


def _links(name: str):
    """(mean, its derivative) as functions of the linear predictor."""
    if name == "logit":
        return lambda e: 1 / (1 + F.exp(-e)), lambda e, m: m * (1 - m), lambda m: math.log(m / (1 - m))
    if name == "cloglog":
        return lambda e: 1 - F.exp(-F.exp(e)), lambda e, m: F.exp(e - F.exp(e)), lambda m: math.log(-math.log(1 - m))
    if name == "loglog":
        return lambda e: F.exp(-F.exp(-e)), lambda e, m: F.exp(-e - F.exp(-e)), lambda m: -math.log(-math.log(m))
    if name == "cauchit":
        return lambda e: 0.5 + F.atan(e) / math.pi, lambda e, m: 1 / (math.pi * (1 + e * e)), lambda m: math.tan(math.pi * (m - 0.5))
    raise ValueError(f"unknown link {name}")


def beta_fit(df: DataFrame, y: str, xcols: Sequence[str], link: str = "logit", max_iter: int = 100, tol: float = 1e-12) -> dict:
    """Beta regression of a proportion in (0, 1): mean by ``link``, one precision phi by the log link, both
    estimated together by Fisher scoring.  Rows at or beyond 0 and 1 raise, as they have no density."""
    mean, slope, back = _links(link)
    xcols = list(xcols)
    data, mu, n = _data(df, y, xcols)
    yy, k = F.col("_y"), 1 + len(xcols)
    first = data.agg(F.avg(yy), F.var_samp(yy), F.min(yy), F.max(yy)).first()
    if first[2] <= 0 or first[3] >= 1:
        raise ValueError("beta regression needs values inside (0, 1)")
    xs = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(k - 1)]]

    def sums(p: np.ndarray):
        eta = _linear(p[:k])
        m = F.least(F.greatest(mean(eta), F.lit(1e-12)), F.lit(1 - 1e-12))
        phi = F.lit(float(math.exp(p[k])))
        a, b, g = m * phi, (1 - m) * phi, slope(eta, m)
        da, db, ta, tb = digamma(a), digamma(b), trigamma(a), trigamma(b)
        miss = F.log(yy) - F.log(1 - yy) - da + db
        s_phi = m * miss + F.log(1 - yy) - db + digamma(phi)
        ll = lgamma(phi) - lgamma(a) - lgamma(b) + (a - 1) * F.log(yy) + (b - 1) * F.log(1 - yy)
        w, c = phi * phi * (ta + tb) * g * g, phi * (ta * m - tb * (1 - m)) * g
        d = ta * m * m + tb * (1 - m) * (1 - m) - trigamma(phi)
        r = data.agg(F.sum(ll), F.sum(s_phi), F.sum(d), *[F.sum(phi * miss * g * x) for x in xs], *[F.sum(c * x) for x in xs],
                     *[F.sum(w * xs[i] * xs[j]) for i in range(k) for j in range(i, k)]).first()
        t = math.exp(p[k])
        score = np.array([*r[3:3 + k], r[1] * t], float)
        info = np.zeros((k + 1, k + 1))
        upper = np.triu_indices(k)
        info[upper] = r[3 + 2 * k:]
        info[:k, :k] = info[:k, :k] + np.triu(info[:k, :k], 1).T
        info[:k, k] = info[k, :k] = np.array(r[3 + k:3 + 2 * k], float) * t
        info[k, k] = r[2] * t * t
        return float(r[0]), score, info
    m0, v0 = float(first[0]), max(float(first[1] or 0.0), 1e-12)
    start = np.r_[back(m0), np.zeros(k - 1), math.log(max(m0 * (1 - m0) / v0 - 1, 0.1))]
    x, value, score, info, converged = _newton(sums, start, max_iter, tol)
    phi, cov = math.exp(x[k]), np.linalg.pinv(info)
    coef, cov = _uncentred(x, cov, mu)
    return _result(xcols, coef, cov, n, {"phi": phi, "phi_se": phi * math.sqrt(cov[k, k]), "loglik": value,
                                         "score": np.abs(score).max() / n, "converged": converged, "link": link})
