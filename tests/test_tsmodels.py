"""Time-series model recovery on simulated series."""

import random

from pyspark.sql import functions as F

from tabloom.operators import tsmodels


def _ar1(n, phi, seed):
    rng = random.Random(seed)
    y, out = 0.0, []
    for _ in range(n):
        y = phi * y + rng.gauss(0, 1)
        out.append(y)
    return out


def test_arima_recovers_ar1(spark):
    rows = [(s, t, v) for s, phi in (("a", 0.6), ("b", -0.4)) for t, v in enumerate(_ar1(1500, phi, 11))]
    df = spark.createDataFrame(rows, "sid string, t long, y double")
    m = {r["sid"]: r for r in tsmodels.arima_fit(df, ["sid"], "t", "y", d=0, orders=[(1, 0)]).collect()}
    assert abs(m["a"]["ar"][0] - 0.6) < 0.06 and abs(m["b"]["ar"][0] + 0.4) < 0.06
    f = tsmodels.arima_forecast(df, tsmodels.arima_fit(df, ["sid"], "t", "y", d=0, orders=[(1, 0)]),
                                ["sid"], "t", "y", 5).orderBy("sid", "step").collect()
    assert len(f) == 10 and all(r["lower"] < r["predicted"] < r["upper"] for r in f)


def test_var_recovers_coefficients(spark):
    rng = random.Random(5)
    a, b, rows = 0.0, 0.0, []
    for t in range(2000):
        a, b = 0.5 * a + 0.2 * b + rng.gauss(0, 1), -0.3 * a + 0.4 * b + rng.gauss(0, 1)
        rows.append((t, a, b))
    df = spark.createDataFrame(rows, "t long, a double, b double")
    fit = tsmodels.var_fit(df, "t", ["a", "b"], 3, "SC")
    assert fit["p"] == 1
    A1 = fit["coef"][1:3, :].T
    assert abs(A1[0, 0] - 0.5) < 0.06 and abs(A1[0, 1] - 0.2) < 0.06 and abs(A1[1, 0] + 0.3) < 0.06
    fc = tsmodels.var_forecast(df, "t", fit, 4)
    assert fc.count() == 8


def test_var_with_trend_forecasts_the_trend(spark):
    rng = random.Random(3)
    rows, b = [], 0.0
    for t in range(1, 201):
        b = 0.3 * b + rng.gauss(0, 0.1)
        rows.append((t, 20.0 + 0.75 * t + rng.gauss(0, 0.1), b))
    df = spark.createDataFrame(rows, "t long, a double, b double")
    for trend in ("both", "trend"):
        f = tsmodels.var_forecast(df, "t", tsmodels.var_fit(df, "t", ["a", "b"], 1, "SC", trend), 5)
        got = {r["step"]: r["predicted"] for r in f.where("series_id = 'a'").collect()}
        assert all(abs(got[h] - (20.0 + 0.75 * (200 + h))) < (2.0 if trend == "both" else 8.0) for h in got)


def test_filter_state_spans_the_whole_series(spark):
    # a root near one: residuals of long ago still count
    ma, c, rng = [0.3, -0.69], 0.2, random.Random(9)
    y = [rng.gauss(1, 1) for _ in range(900)]
    df = spark.createDataFrame([("s", t, v) for t, v in enumerate(y)], "sid string, t long, y double")
    model = spark.createDataFrame([("s", 1, 1, 2, c, [0.4], ma, 1.0)],
                                  "sid string, p int, d int, q int, const double, ar array<double>, ma array<double>, sigma2 double")
    w, e = [b - a for a, b in zip(y, y[1:])], []
    for t, v in enumerate(w):
        e.append(v - c - (0.4 * w[t - 1] if t else 0) - sum(ma[j] * e[t - 1 - j] for j in range(2) if t - 1 - j >= 0))
    got = tsmodels._filter_state(df, model, ["sid"], "t", "y").first()["e"]
    assert abs(got[0] - e[-1]) < 1e-9 and abs(got[1] - e[-2]) < 1e-9


def test_seasonal_forecast_of_long_and_short_series(spark):
    rows = [("long", t, 10.0 + (t % 12) + 0.01 * t) for t in range(96)] + [("short", t, 5.0 + t) for t in range(3)] \
        + [("mid", t, float(t % 4)) for t in range(9)]
    df = spark.createDataFrame(rows, "sid string, t long, y double")
    got = {}
    for r in tsmodels.stl_arima_forecast(df, ["sid"], "t", "y", 12, 6).collect():
        got.setdefault(r["sid"], {})[r["step"]] = r["predicted"]
    assert set(got) == {"long", "short", "mid"} and all(len(v) == 6 for v in got.values())
    assert abs(got["short"][1] - 6.0) < 1e-9
    assert all(abs(got["long"][h] - (10.0 + (95 + h) % 12 + 0.01 * (95 + h))) < 1.0 for h in range(1, 7))


def _system(n, seed):
    """Two series tied by y = 2 x + 5 and a walk of its own."""
    import numpy as np
    rng = np.random.default_rng(seed)
    x = 1000 + np.cumsum(rng.normal(0, 1, n))
    y, z = np.zeros(n), np.cumsum(rng.normal(0, 1, n))
    y[0] = 2 * x[0] + 5
    for t in range(1, n):
        y[t] = y[t - 1] - 0.4 * (y[t - 1] - 2 * x[t - 1] - 5) + rng.normal(0, 0.5)
    return np.column_stack([y, x, z])


def test_vecm_rank_relation_and_forecast(spark):
    import numpy as np
    Y = _system(800, 3)
    df = spark.createDataFrame([(t, *map(float, r)) for t, r in enumerate(Y)] + [(800, None, 1.0, 1.0)], "t long, y double, x double, z double").repartition(4)
    clean = df.where("y IS NOT NULL")
    for ecdet in ("const", "none"):
        fit = tsmodels.vecm_fit(df, "t", ["y", "x", "z"], 2, None, ecdet)
        assert fit["r"] == 1 and abs(fit["beta"][1, 0] / fit["beta"][0, 0] + 2) < 0.02 and abs(fit["alpha"][0, 0] * fit["beta"][0, 0] + 0.4) < 0.1
        got = {(r["series_id"], r["step"]): r for r in tsmodels.vecm_forecast(clean, "t", fit, 6).collect()}
        a, b = Y[-1], Y[-2]
        for h in range(1, 7):      # the error-correction recursion itself
            move = fit["constant"] + fit["Pi"][:, :3] @ a + fit["short"] @ (a - b)
            a, b = a + move, a
            assert np.allclose([got[c, h]["predicted"] for c in ("y", "x", "z")], a, rtol=1e-9)
        assert abs(got["y", 6]["predicted"] - 2 * got["x", 6]["predicted"] - 5) < 2.5
        assert all(r["lower"] < r["predicted"] < r["upper"] for r in got.values())


def test_midas_weights_and_forecast(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    periods, per = 120, 3
    x = rng.normal(500, 3, periods * per)
    rows, ys = [(i // per, i, float(v)) for i, v in enumerate(x)], []
    e = np.exp(0.8 * np.arange(1, 6) - 0.3 * np.arange(1, 6) ** 2)
    w = 2.0 * e / e.sum()
    for q in range(2, periods - 2):
        last = q * per + per - 1
        ys.append((q, float(7 + w @ x[last - np.arange(5)] + rng.normal(0, 0.05))))
    xd, yd = spark.createDataFrame(rows, "q long, i long, x double").repartition(3), spark.createDataFrame(ys, "q long, y double")
    X = np.array([x[q * per + per - 1 - np.arange(5)] for q, _ in ys])
    y = np.array([v for _, v in ys])
    fit = tsmodels.midas_fit(yd, xd, "q", "y", "i", "x", poly="nealmon")
    assert fit["converged"] and np.allclose(fit["weights"], w, atol=0.03)
    sse = lambda a, t: (((y - a) - X @ tsmodels._midas_weights("nealmon", np.array(t), 5)[0]) ** 2).sum()
    best = sse(fit["intercept"], fit["theta"])
    for i in range(3):             # no way down, with the intercept at its best
        for h in (1e-3, -1e-3):
            t = list(fit["theta"])
            t[i] += h
            wt = tsmodels._midas_weights("nealmon", np.array(t), 5)[0]
            assert sse(y.mean() - wt @ X.mean(axis=0), t) >= best
    plain = tsmodels.midas_fit(yd, xd, "q", "y", "i", "x", degree=2)
    P = np.arange(1, 6)[:, None] ** np.arange(3)[None]
    b = np.linalg.lstsq(np.column_stack([np.ones(len(y)), X @ P]), y, rcond=None)[0]
    assert np.allclose(plain["weights"], P @ b[1:], rtol=1e-6)
    got = {r["q"]: r for r in tsmodels.midas_forecast(fit, xd, "q", "i", "x").collect()}
    assert set(got) == set(range(1, periods))      # the last two have no y yet
    last = (periods - 1) * per + per - 1
    assert abs(got[periods - 1]["predicted"] - (7 + w @ x[last - np.arange(5)])) < 0.5
