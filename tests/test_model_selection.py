"""2SLS diagnostics, cross-validation and the elastic-net path against plain numpy."""

import numpy as np

from tabloom.operators import models, validation


def _frame(spark, cols):
    names = list(cols)
    return spark.createDataFrame([tuple(float(cols[c][i]) for c in names) for i in range(len(cols[names[0]]))],
                                 ", ".join(f"`{c}` double" for c in names))


def _rss(y, *xs):
    x = np.column_stack([np.ones(len(y)), *xs])
    e = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
    return e @ e, e


def test_iv_diagnostics_equal_regressions(spark):
    rng = np.random.default_rng(1)
    n = 400
    z1, z2, w, c = rng.normal(1e4, 1, n), rng.normal(0, 2, n), rng.normal(0, 1, n), rng.normal(5, 1, n)
    x = 0.5 * z1 + 0.3 * z2 + w + 0.2 * c + rng.normal(0, 1, n)
    y = 2.0 + 1.5 * x - 0.7 * c + 2 * w + rng.normal(0, 1, n)
    got = models.iv_2sls(_frame(spark, {"y": y, "x": x, "z.1": z1, "z2": z2, "c": c}), "y", ["x"], ["z.1", "z2"], ["c"])
    first = np.column_stack([np.ones(n), z1, z2, c])
    xh = first @ np.linalg.lstsq(first, x, rcond=None)[0]
    X, H = np.column_stack([np.ones(n), x, c]), np.column_stack([np.ones(n), xh, c])
    b = np.linalg.lstsq(H, y, rcond=None)[0]
    u = y - X @ b
    se = np.sqrt(np.diag(np.linalg.inv(H.T @ H)) * (u @ u) / (n - 3))
    assert np.allclose(got["coef"], b, rtol=1e-6) and np.allclose(got["se"], se, rtol=1e-6)
    d = got["diagnostics"]
    r0, r1 = _rss(x, c)[0], _rss(x, z1, z2, c)[0]
    assert np.isclose(d["weak_x"][0], (r0 - r1) / 2 / (r1 / (n - 4)), rtol=1e-6) and d["weak_x"][1:3] == (2, n - 4)
    v = x - xh
    a0, a1 = _rss(y, x, c)[0], _rss(y, x, c, v)[0]
    assert np.isclose(d["wu_hausman"][0], (a0 - a1) / (a1 / (n - 4)), rtol=1e-6) and d["wu_hausman"][1:3] == (1, n - 4)
    su = _rss(u, z1, z2, c)[0]
    assert np.isclose(d["sargan"][0], n * (1 - su / (u @ u)), rtol=1e-5) and d["sargan"][1] == 1
    assert d["weak_x"][3] < 1e-6 and d["wu_hausman"][3] < 1e-6 and 0 < d["sargan"][3] < 1
    assert models.iv_2sls(_frame(spark, {"y": y, "x": x, "z": z1}), "y", ["x"], ["z"])["diagnostics"]["sargan"] is None


def test_cross_validation_of_any_model(spark):
    rng = np.random.default_rng(2)
    n = 600
    x, idx = rng.normal(0, 1, n), np.arange(n)
    y = 3 * x + rng.normal(0, 1, n)
    df = _frame(spark, {"idx": idx, "x": x, "y": y, "f": idx % 3})
    got = {r["fold"]: r for r in validation.cross_validate(df, "lm", "y", ["x"], fold_cols=["f"]).collect()}
    for f in range(3):
        tr, te = idx % 3 != f, idx % 3 == f
        X = np.column_stack([np.ones(tr.sum()), x[tr]])
        b = np.linalg.lstsq(X, y[tr], rcond=None)[0]
        e = y[te] - b[0] - b[1] * x[te]
        assert (got[f]["n_train"], got[f]["n_test"]) == (tr.sum(), te.sum()) and abs(got[f]["rmse"] - np.sqrt((e @ e) / len(e))) < 1e-4
    forest = validation.cross_validate(df, "ranger_reg", "y", ["x"], "idx", k=3, repeats=2, params={"num_trees": 10}).collect()
    assert len(forest) == 6 and sum(r["n_test"] for r in forest if r["repeat"] == "1") == n
    assert all(r["n_train"] + r["n_test"] == n and 0.5 < r["r2"] <= 1 for r in forest)


def _standard(X):
    return (X - X.mean(axis=0)) / X.std(axis=0)


def test_elastic_net_gaussian_meets_its_conditions_and_errors(spark):
    from tabloom.operators import glmnet
    rng = np.random.default_rng(3)
    n, k, alpha = 500, 5, 0.6
    X = rng.normal(0, 1, (n, k)) * [1, 5, 0.2, 3, 1] + [1000, 0, 0, -4, 0]
    X[:, 4] = 0.7 * X[:, 0] + 0.1 * X[:, 4]
    y = X @ [1.5, 0, -3, 0.2, 0] + rng.normal(0, 2, n)
    fold = np.arange(n) % 4
    df = _frame(spark, {**{f"x.{j}": X[:, j] for j in range(k)}, "y": y, "f": fold})
    fit = glmnet.elastic_net(df, "y", [f"x.{j}" for j in range(k)], alpha=alpha, nlambda=40, fold_col="f")

    def conditions(Xt, yt, lam, a, b):
        S, sd, dev = _standard(Xt), Xt.std(axis=0), yt.std()
        beta, grad = b * sd / dev, S.T @ ((yt - a - Xt @ b) / dev) / len(yt)
        own = lam / dev
        on = beta != 0
        assert np.allclose(grad[on] - own * (1 - alpha) * beta[on], own * alpha * np.sign(beta[on]), atol=1e-8)
        assert (np.abs(grad[~on]) <= own * alpha + 1e-8).all() and abs((yt - a - Xt @ b).mean()) < 1e-6
    for i, lam in enumerate(fit.lambdas):
        conditions(X, y, lam, fit.intercept[i], fit.coef[i])
    assert (fit.coef[0] == 0).all() and (fit.coef[1] != 0).any() and len(fit.lambdas) == 40
    # the error at each lambda, from fits of the training rows of each fold alone
    errors = []
    for f in range(4):
        part = glmnet.elastic_net(df.where(f"f <> {f}"), "y", [f"x.{j}" for j in range(k)], alpha=alpha, lambdas=fit.lambdas, fold_col="f")
        e = y[fold == f, None] - part.intercept - X[fold == f] @ part.coef.T
        errors.append((e ** 2).mean(axis=0))
    assert np.allclose(fit.cv_mean, np.mean(errors, axis=0), rtol=1e-6)
    assert fit.index_1se <= fit.index_min
    scored = fit.score(df).select("y", "prediction").collect()
    assert np.isclose(np.mean([(r["y"] - r["prediction"]) ** 2 for r in scored]),
                      np.mean((y - fit.intercept[fit.index_min] - X @ fit.coef[fit.index_min]) ** 2))


def test_elastic_net_binomial_meets_its_conditions(spark):
    from tabloom.operators import glmnet
    rng = np.random.default_rng(4)
    n, k, alpha = 600, 3, 0.8
    X = rng.normal(0, 1, (n, k)) * [1, 10, 1] + [0, 50, 3]
    y = (rng.random(n) < 1 / (1 + np.exp(-(1.2 * X[:, 0] - 0.1 * (X[:, 1] - 50))))).astype(float)
    df = _frame(spark, {**{f"x{j}": X[:, j] for j in range(k)}, "y": y, "id": np.arange(n)}).repartition(3)
    fit = glmnet.elastic_net(df, "y", [f"x{j}" for j in range(k)], "binomial", key="id", alpha=alpha, nlambda=12)
    assert fit.converged and (fit.coef[0] == 0).all()
    S, sd = _standard(X), X.std(axis=0)
    for lam, a, b in zip(fit.lambdas, fit.intercept, fit.coef):
        p = 1 / (1 + np.exp(-(a + X @ b)))
        grad, on = S.T @ (y - p) / n, b != 0
        assert np.allclose(grad[on] - lam * (1 - alpha) * (b * sd)[on], lam * alpha * np.sign(b[on]), atol=1e-6)
        assert (np.abs(grad[~on]) <= lam * alpha + 1e-6).all() and abs((y - p).mean()) < 1e-6
    right = np.mean([r["prediction"] == r["y"] for r in fit.score(df).collect()])
    assert right > 0.7
