"""Exponential smoothing against a plain recursion, row by row."""

import numpy as np
import pytest

from tabloom.operators import ets


def plain(y, r):
    """Sum of squared errors, of relative ones, sum of log means and last states of one series."""
    level, slope, season = r["level0"], r["trend0"], list(r["season0"])
    t, s, phi, m = r["trend_type"], r["season_type"], r["phi"], r["period"]
    sse = rel = logs = 0.0
    for i, v in enumerate(y):
        drift = slope ** phi if t == "M" else phi * slope if t == "A" else 0
        base = level * drift if t == "M" else level + drift
        k = season[i % m] if s != "N" else None
        mean = base if k is None else base + k if s == "A" else base * k
        e = v - mean
        own = e / k if s == "M" else e
        if t != "N":
            slope = drift + r["beta"] * own / (level if t == "M" else 1)
        level = base + r["alpha"] * own
        if s != "N":
            season[i % m] = k + r["gamma"] * (e if s == "A" else e / base)
        sse, rel, logs = sse + e * e, rel + (e / mean) ** 2, logs + np.log(abs(mean))
    return sse, rel, logs, level, slope, [season[(len(y) + j) % m] for j in range(m)] if season else []


def frame(spark, series):
    return spark.createDataFrame([(k, i, float(v)) for k, y in series.items() for i, v in enumerate(y)], "k string, t long, v double").repartition(4)


def simulated():
    rng = np.random.default_rng(7)
    t = np.arange(96)
    wave = np.tile([1.2, 0.8, 1.0, 1.1, 0.7, 1.2, 1.3, 0.9, 0.8, 1.0, 1.1, 0.9], 8)
    return {"flat": 50 + np.cumsum(rng.normal(0, 1, 96)), "line": 20 + 3 * t + rng.normal(0, 2, 96),
            "add": 100 + t + 30 * (wave - 1) + rng.normal(0, 1, 96), "mult": (50 + 2 * t) * wave * rng.normal(1, 0.02, 96),
            "short": 5 + rng.normal(0, 1, 9) ** 2}


@pytest.mark.parametrize("code", ets.CODES)
def test_every_code_equals_the_plain_recursion(spark, code):
    series = simulated()
    rows = ets.ets_fit(frame(spark, series), ["k"], "t", "v", code, 12, choose=False).collect()
    assert {r["k"] for r in rows} >= {"flat", "line", "add", "mult"} and {r["damped"] for r in rows} == ({False, True} if code[1] != "N" else {False})
    for r in rows:
        assert r["error"] + r["trend_type"] + r["season_type"] == code
        sse, rel, logs, level, slope, season = plain(series[r["k"]], r)
        n, k = r["n"], ets.n_parameters(r["trend_type"], r["damped"], r["season_type"], 12)
        lik = n * np.log(sse if code[0] == "A" else rel) + (2 * logs if code[0] == "M" else 0)
        assert np.isclose(r["aicc"], lik + 2 * k + 2 * k * (k + 1) / (n - k - 1), rtol=1e-7)
        assert code[0] == "M" or np.isclose(r["sse"], sse, rtol=1e-6)
        assert np.allclose([r["level"], r["trend"], *r["season"]], [level, slope if r["trend_type"] != "N" else r["trend"], *season], rtol=1e-6)


def test_choice_and_forecast(spark):
    series = simulated()
    fitted = ets.ets_fit(frame(spark, series), ["k"], "t", "v", "ZZZ", 12)
    got = {r["k"]: r for r in fitted.collect()}
    assert set(got) == set(series)
    assert got["flat"]["season_type"] == "N" and got["line"]["trend_type"] == "A"
    assert got["add"]["season_type"] == "A" and got["mult"]["season_type"] == "M"
    paths = {}
    for r in ets.ets_forecast(fitted, ["k"], 12).collect():
        paths.setdefault(r["k"], {})[r["step"]] = r
        assert r["lower"] <= r["predicted"] <= r["upper"]
    want = [(50 + 2 * (96 + i)) * w for i, w in enumerate([1.2, 0.8, 1.0, 1.1, 0.7, 1.2, 1.3, 0.9, 0.8, 1.0, 1.1, 0.9])]
    assert np.allclose([paths["mult"][i + 1]["predicted"] for i in range(12)], want, rtol=0.08)
    assert np.allclose([paths["line"][i + 1]["predicted"] for i in range(12)], [20 + 3 * (96 + i) for i in range(12)], rtol=0.05)


def test_long_series_is_carried_through_batches(monkeypatch):
    y = simulated()["mult"]
    whole = ets._Batch(ets.structures("MAM"), 12)
    whole.keys, whole.values = [("a",), ("b",)], [list(y[:40]), list(y)]
    want = {(r[0], r[4]): r[5:] for r in whole.solve(False, None)[0]}
    part = ets._Batch(ets.structures("MAM"), 12)
    part.keys, part.values = [("a",), ("b",)], [list(y[:40]), list(y[:37])]
    found, carry = part.solve(True, None)
    for a, b in ((37, 60), (60, 96)):
        part.keys, part.values = [("b",)], [list(y[a:b])]
        more, carry = part.solve(b < 96, carry)
        found += more
    for r in found:
        if r[0] == "a":
            assert r[5:] == want["a", r[4]]
        else:      # the same recursion; only the first states see fewer rows here
            assert r[-1] == 96 and np.isclose(r[-2], want["b", r[4]][-2], rtol=0.05)


def test_empty_and_awkward_values(spark):
    df = spark.createDataFrame([("n", i, None if i == 3 else float("nan") if i == 4 else float(i % 5 - 1)) for i in range(30)], "k string, t long, v double")
    got = ets.ets_fit(df, ["k"], "t", "v", "ZZZ", 1).collect()
    assert got[0]["n"] == 28 and got[0]["error"] == "A"
    assert ets.ets_fit(df, ["k"], "t", "v", "MNN", 1).count() == 0
    assert ets.ets_fit(df.where("false"), ["k"], "t", "v").count() == 0
    with pytest.raises(ValueError):
        ets.ets_fit(df, ["k"], "t", "v", "XYZ")
