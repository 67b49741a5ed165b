"""Gamma functions, negative binomial and beta regression."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.functions import special
from tabloom.operators import likelihood


def test_gamma_functions(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 2.5, 7.0, 33.3, 1e4, 1e7]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", special.lgamma(F.col("x")).alias("l"), special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t")).collect()
    for r in rows:
        x, h = r["x"], r["x"] * 1e-4
        assert math.isclose(r["l"], math.lgamma(x), rel_tol=1e-11, abs_tol=1e-11)
        assert math.isclose(r["d"], (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel_tol=1e-5, abs_tol=1e-5)
    by = {r["x"]: r for r in rows}
    assert math.isclose(by[1.0]["d"], -0.5772156649015329, rel_tol=1e-11) and math.isclose(by[1.0]["t"], math.pi ** 2 / 6, rel_tol=1e-11)
    assert math.isclose(by[0.5]["t"], math.pi ** 2 / 2, rel_tol=1e-11)


def _loglik(mean, theta, y):
    return sum(math.lgamma(v + theta) - math.lgamma(theta) - math.lgamma(v + 1) + theta * math.log(theta) + v * math.log(m)
               - (v + theta) * math.log(m + theta) for v, m in zip(y, mean))


def test_negative_binomial_is_the_maximum(spark):
    rng = np.random.default_rng(1)
    n, theta = 4000, 1.7
    x = rng.normal(100, 1, n)
    mean = np.exp(1.0 + 0.4 * (x - 100))
    y = rng.poisson(rng.gamma(theta, mean / theta))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)] + [(float("nan"), 3), (1.0, None)], "`x.1` double, y long").repartition(4)
    fit = likelihood.negbin_fit(df, "y", ["x.1"])
    assert fit["converged"] and fit["n"] == n and fit["score"] < 1e-6
    assert abs(fit["theta"] - theta) < 4 * fit["theta_se"] and abs(fit["coef"][1] - 0.4) < 4 * fit["se"][1]
    at = lambda b0, b1, t: _loglik(np.exp(b0 + b1 * x), t, y)
    best = at(*fit["coef"], fit["theta"])
    assert math.isclose(best, fit["loglik"], rel_tol=1e-9)
    for h in (1e-3, -1e-3):     # every way from the fit is down
        assert at(fit["coef"][0] + h, fit["coef"][1], fit["theta"]) < best
        assert at(fit["coef"][0] - 100 * h, fit["coef"][1] + h, fit["theta"]) < best
        assert at(*fit["coef"], fit["theta"] * (1 + h)) < best
    flat = spark.createDataFrame([(i % 3,) for i in range(300)], "y long").withColumn("x", F.col("y") * 0.0)
    assert not likelihood.negbin_fit(flat, "y", [])["converged"]


@pytest.mark.parametrize("link", ["logit", "cloglog", "loglog", "cauchit"])
def test_beta_regression_recovers_mean_and_precision(spark, link):
    rng = np.random.default_rng(2)
    n, phi, b = 3000, 12.0, (0.3, -0.5)
    x = rng.normal(0, 1, n)
    eta = b[0] + b[1] * x
    mean = {"logit": 1 / (1 + np.exp(-eta)), "cloglog": 1 - np.exp(-np.exp(eta)), "loglog": np.exp(-np.exp(-eta)), "cauchit": 0.5 + np.arctan(eta) / np.pi}[link]
    y = np.clip(rng.beta(mean * phi, (1 - mean) * phi), 1e-9, 1 - 1e-9)
    df = spark.createDataFrame([(float(a + 50), float(v)) for a, v in zip(x, y)], "x double, y double").repartition(3)
    fit = likelihood.beta_fit(df, "y", ["x"], link)
    assert fit["converged"] and fit["score"] < 1e-6 and abs(fit["phi"] - phi) < 4 * fit["phi_se"]
    assert abs(fit["coef"][1] - b[1]) < 4 * fit["se"][1] and 0.1 < fit["phi_se"] < 1
    assert abs(fit["coef"][0] + 50 * fit["coef"][1] - b[0]) < 0.1


def test_beta_regression_refuses_the_ends(spark):
    with pytest.raises(ValueError):
        likelihood.beta_fit(spark.createDataFrame([(0.0,), (0.5,)], "y double"), "y", [])
