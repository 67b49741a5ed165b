"""Seasonal ARIMA: block sums against plain loops, recovery of simulated orders, forecasts."""

import numpy as np

from tabloom.operators import sarima


def simulate(n, ar=(), ma=(), sar=(), sma=(), m=1, d=0, D=0, c=0.0, seed=1):
    rng = np.random.default_rng(seed)
    a, b = sarima._dense(sarima.polynomial(ar, sar, m, -1.0)), sarima._dense(sarima.polynomial(ma, sma, m, 1.0))
    e, w = rng.normal(0, 1, n + 200), np.zeros(n + 200)
    for t in range(len(w)):
        w[t] = c + b[:t + 1] @ e[t::-1][:len(b)] - sum(a[k] * w[t - k] for k in range(1, len(a)) if t >= k)
    y = w[200:]
    for _ in range(d):
        y = np.cumsum(y)
    for _ in range(D):
        for t in range(m, len(y)):
            y[t] += y[t - m]
    return y


def frame(spark, series):
    return spark.createDataFrame([(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)], "k string, t long, v double").repartition(5)


def test_statistics_equal_plain_ones_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(sarima, "BLOCK", 64)
    series = {"walk": simulate(300, d=1, seed=2), "noise": simulate(250, seed=3) + 9, "season": 10 * np.sin(np.arange(290) * np.pi / 6) + simulate(290, seed=4)}
    blocks = sarima._blocks(frame(spark, series), ["k"], "t", "v", 40)
    got = {r["k"]: r["strength"] for r in sarima.seasonal_strength(blocks, ["k"], 12).collect()}
    for k, y in series.items():
        kernel = np.r_[0.5, np.ones(11), 0.5] / 12
        x = y[6:-6] - np.convolve(y, kernel, "valid")
        season = (np.arange(len(x)) + 6) % 12
        rest = x - np.array([x[season == s].mean() for s in range(12)])[season]
        assert np.isclose(got[k], max(0, 1 - rest.var() / x.var()), rtol=1e-8)
    assert got["season"] > 0.9
    from pyspark.sql import functions as F
    got = {(r["k"], r["d"]): r["kpss"] for r in sarima.kpss(blocks.withColumn("_sd", F.lit(0)), ["k"], 12, 5).collect()}
    for k, y in series.items():
        for d in range(3):
            w = np.diff(y, d)
            x = w - w.mean()
            L = int(4 * (len(w) / 100) ** 0.25)
            lrv = (x @ x + 2 * sum((1 - j / (L + 1)) * (x[j:] @ x[:-j]) for j in range(1, L + 1))) / len(w)
            assert np.isclose(got[k, d], (np.cumsum(x) ** 2).sum() / len(w) ** 2 / lrv, rtol=1e-7)


def test_moments_do_not_depend_on_blocks(spark, monkeypatch):
    df = frame(spark, {"a": simulate(700, ar=[0.6], sma=[0.4], m=4, seed=5), "b": simulate(90, ma=[0.5], seed=6)})
    want = {r["k"]: r for r in sarima.sarima_fit(df, ["k"], "t", "v", 4, d=0, D=0, order=(1, 0, 0, 1)).collect()}
    monkeypatch.setattr(sarima, "BLOCK", 50)
    for r in sarima.sarima_fit(df, ["k"], "t", "v", 4, d=0, D=0, order=(1, 0, 0, 1)).collect():
        assert r["n"] == want[r["k"]]["n"] and np.allclose([*r["ar"], *r["sma"], r["sigma2"]],
                                                          [*want[r["k"]]["ar"], *want[r["k"]]["sma"], want[r["k"]]["sigma2"]], rtol=1e-6)


def test_recovers_simulated_orders_and_parameters(spark):
    series = {"air": simulate(3000, ma=[-0.4], sma=[-0.6], m=12, d=1, D=1, seed=7), "ar": simulate(3000, ar=[0.5, -0.3], c=2.0, seed=8),
              "sar": simulate(3000, ar=[0.5], sar=[0.4], m=12, seed=9), "walk": simulate(3000, ma=[0.5], d=1, seed=10)}
    got = {r["k"]: r for r in sarima.sarima_fit(frame(spark, series), ["k"], "t", "v", 12, max_p=2, max_q=2, max_P=1, max_Q=1).collect()}
    orders = {k: (r["p"], r["d"], r["q"], r["seasonal_p"], r["seasonal_d"], r["seasonal_q"]) for k, r in got.items()}
    assert orders["air"] == (0, 1, 1, 0, 1, 1) and orders["walk"][1] == 1 and orders["walk"][4] == 0
    assert orders["ar"][1] == 0 and orders["ar"][4] == 0
    assert orders["sar"][0] >= 1 and orders["sar"][3] >= 1 and orders["sar"][1] == 0
    assert abs(got["air"]["ma"][0] + 0.4) < 0.06 and abs(got["air"]["sma"][0] + 0.6) < 0.08 and abs(got["air"]["sigma2"] - 1) < 0.1
    fixed = {r["k"]: r for r in sarima.sarima_fit(frame(spark, series), ["k"], "t", "v", 12, d=0, D=0, order=(1, 0, 1, 0)).where("k = 'sar'").collect()}
    assert abs(fixed["sar"]["ar"][0] - 0.5) < 0.05 and abs(fixed["sar"]["sar"][0] - 0.4) < 0.05


def test_residuals_and_forecasts_equal_the_recursion(spark, monkeypatch):
    y = simulate(333, ar=[0.4], ma=[0.3, -0.6], sma=[0.5], m=4, d=1, D=1, c=0.01, seed=11)
    df = frame(spark, {"a": y, "b": y[:41]})
    fitted = spark.createDataFrame([(k, 1, 1, 2, 0, 1, 1, 4, 0.01, [0.4], [0.3, -0.6], [], [0.5], 1.0, 0.0, 333) for k in "ab"], "k string, " + sarima.FITTED)
    monkeypatch.setattr(sarima, "BLOCK", 32)
    got = {(r["k"], r["step"]): r for r in sarima.sarima_forecast(df, fitted, ["k"], "t", "v", 9).collect()}
    theta = sarima._dense(sarima.polynomial([0.3, -0.6], [0.5], 4, 1.0))
    full = np.convolve(np.convolve([1, -0.4], [1, 0, 0, 0, -1]), [1, -1])
    for k, own in (("a", y), ("b", y[:41])):
        w = sarima.difference(own, 4, 1, 1)
        e = []
        for t in range(len(w)):
            e.append(w[t] - 0.01 - (0.4 * w[t - 1] if t else 0) - sum(theta[j] * e[t - j] for j in range(1, len(theta)) if t >= j))
        path, res = list(own), list(e)
        for i in range(9):
            path.append(0.01 - sum(full[j] * path[-j] for j in range(1, len(full))) + sum(theta[j] * res[-j] for j in range(1, len(theta))))
            res.append(0.0)
            assert np.isclose(got[k, i + 1]["predicted"], path[-1], rtol=1e-8)
    width = [got["a", i]["upper"] - got["a", i]["lower"] for i in range(1, 10)]
    assert np.isclose(width[0], 2 * sarima.Z975) and all(b > a for a, b in zip(width, width[1:]))


def test_short_constant_and_empty_series(spark):
    df = frame(spark, {"c": np.full(60, 3.0), "s": np.arange(4.0), "n": simulate(80, seed=12)})
    got = {r["k"]: r for r in sarima.sarima_fit(df, ["k"], "t", "v", 12).collect()}
    assert "n" in got and "s" not in got
    assert sarima.sarima_forecast(df, sarima.sarima_fit(df, ["k"], "t", "v", 12), ["k"], "t", "v", 3).where("k = 'n'").count() == 3
    assert sarima.sarima_fit(df.where("false"), ["k"], "t", "v", 12).count() == 0
