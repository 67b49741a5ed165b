"""Woodruff intervals against a plain computation, and their edge cases."""

import numpy as np
import pytest

from tabloom.functions.stats import t_ppf
from tabloom.operators import survey


def plain(y, w, h, i, p):
    order = np.argsort(y, kind="stable")
    F = np.cumsum(w[order]) / w.sum()

    def inverse(x):
        x = min(max(x, 1e-9), 1.0)
        return y[order][np.flatnonzero(F >= x - 1e-12)[0]]
    q = inverse(p)
    share = w[y <= q].sum() / w.sum()
    z = w * ((y <= q) - share) / w.sum()
    var, df = 0.0, 0
    for a in np.unique(h):
        tot = np.array([z[(h == a) & (i == b)].sum() for b in np.unique(i[h == a])])
        n = len(tot)
        var += n / (n - 1) * ((tot - tot.mean()) ** 2).sum()
        df += n - 1
    t = t_ppf(0.975, df)
    lo, hi = inverse(share - t * var ** 0.5), inverse(share + t * var ** 0.5)
    return q, (hi - lo) / (2 * t), lo, hi, df


@pytest.mark.parametrize("psu", ["i", None])
def test_equals_plain_computation(spark, psu):
    rng = np.random.default_rng(5)
    n = 400
    y, w = np.round(rng.gamma(2, 3, n), 1), rng.integers(1, 9, n) / 2
    h, i = rng.integers(0, 3, n), rng.integers(0, 6, n)
    df = spark.createDataFrame([(float(a), float(b), int(c), int(d)) for a, b, c, d in zip(y, w, h, i)], "y double, w double, h long, i long")
    df = df.union(spark.createDataFrame([(None, 1.0, 0, 0), (1.0, None, 0, 0), (2.0, 0.0, 1, 1)], df.schema)).repartition(4)
    got = {r["p"]: r for r in survey.survey_quantile_ci(df, "y", survey.Design("w", "h", psu), [0.01, 0.5, 0.9]).collect()}
    for p in (0.01, 0.5, 0.9):
        want = plain(y, w, h, i if psu else np.arange(n), p)
        assert np.allclose([got[p][c] for c in ("quantile", "se", "lower", "upper", "df")], want, rtol=1e-9)


def test_domains_and_single_psu(spark):
    rows = [("a", float(v), 1.0, v % 2, v % 5) for v in range(100)] + [("b", float(v), 1.0, 0, 0) for v in range(10)]
    df = spark.createDataFrame(rows, "g string, y double, w double, h long, i long")
    got = {(r["g"], r["p"]): r for r in survey.survey_quantile_ci(df, "y", survey.Design("w", "h", "i"), [0.5], ["g"]).collect()}
    assert got["a", 0.5]["quantile"] == 49.0 and got["a", 0.5]["se"] >= 0
    assert got["b", 0.5]["quantile"] == 4.0 and got["b", 0.5]["se"] is None and got["b", 0.5]["n_single"] == 1
    assert survey.survey_quantile_ci(df.where("false"), "y", survey.Design("w", "h", "i")).count() == 0
