"""Sums of a Newton step and held-out losses of the binomial path, against numpy."""

import numpy as np
from pyspark.sql import functions as F

from tabloom.operators import glmnet


def test_sums_and_losses(spark):
    rng = np.random.default_rng(1)
    n, names = 300, [0, 2, 5]
    x, y, w = rng.normal(size=(n, 2)), rng.integers(0, 2, n).astype(float), rng.uniform(0.5, 2, n)
    fold = np.array(names)[rng.integers(0, 3, n)]
    data = spark.createDataFrame([(float(a), float(b), float(c), float(d), int(f)) for (a, b), c, d, f in zip(x, y, w, fold)],
                                 "_x0 double, _x1 double, _y double, _w double, _fold int").repartition(3)
    center, sd, b = np.array([0.1, -0.2]), np.array([1.1, 0.9]), rng.normal(size=(4, 5, 3))
    H, g = glmnet._sums(data, b, names, center, sd)
    loss = glmnet._losses(data, b, names, center, sd)
    z = np.column_stack([np.ones(n), (x - center) / sd])
    for s in range(4):
        keep = np.ones(n, bool) if s == 0 else fold != names[s - 1]
        for j in range(5):
            eta = z @ b[s, j]
            p = 1 / (1 + np.exp(-eta))
            k = w * keep
            assert np.allclose(H[s, j], (z * (k * np.maximum(p * (1 - p), glmnet.LEAST_WEIGHT))[:, None]).T @ z)
            assert np.allclose(g[s, j], z.T @ (k * (y - p)))
            if s:
                assert np.isclose(loss[s - 1, j], (2 * w * (np.logaddexp(0, eta) - y * eta))[~keep].sum())
