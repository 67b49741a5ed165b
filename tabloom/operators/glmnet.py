"""Elastic-net path with the penalty chosen by k-fold cross-validation.

minimise  loss / n + lambda * (alpha * |b|_1 + (1 - alpha) / 2 * |b|_2^2)  over a falling
geometric sequence of lambdas, on predictors scaled to unit variance.

Gaussian: the rows are read twice, for the means and for one aggregate of centred
cross-moments per fold.  A training set's moments are the total less its fold's, so the
path of all training sets is coordinate descent on K x K matrices (warm-started along the
path, all sets at once), and the held-out error is a quadratic form of the fold's moments.

Binomial: the weights of a Newton step depend on its coefficients, so the grid is data:
every pass over the rows (written once, only the columns in use) takes one step of ALL
(training set, lambda) fits at once.  A task multiplies its rows' products with the matrix
of all weights and sends one row of sums a fit; the penalised steps are solved on those."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..session import ship_package
from .models import _complete, _matrix, _q, cross_moments, train_shape_guard

TOLERANCE, SWEEPS = 1e-12, 100_000
NEWTON_STEPS, NEWTON_TOLERANCE = 30, 1e-9
BLOCK_ROWS = 2048               # rows whose weights for all fits a task holds at a time
LEAST_WEIGHT = 1e-5             # of a row in a Newton step


@dataclass
class PathFit:
    family: str
    features: list[str]
    lambdas: np.ndarray
    intercept: np.ndarray       # one a lambda
    coef: np.ndarray            # (lambda, feature), on the scale of the data
    cv_mean: np.ndarray         # mean squared error, or deviance a row
    cv_sd: np.ndarray
    converged: bool
    n: int

    @property
    def index_min(self) -> int:
        """The largest lambda of least error."""
        return int(np.argmin(self.cv_mean))

    @property
    def index_1se(self) -> int:
        """The largest lambda within a standard error of the least."""
        i = self.index_min
        return int(np.flatnonzero(self.cv_mean <= self.cv_mean[i] + self.cv_sd[i])[0])

    def linear(self, at: int | None = None) -> Column:
        i = self.index_min if at is None else at
        out = F.lit(float(self.intercept[i]))
        for c, b in zip(self.features, self.coef[i]):
            if b:
                out = out + F.col(_q(c)).cast("double") * F.lit(float(b))
        return out

    def score(self, df: DataFrame, at: int | None = None) -> DataFrame:
        """``df`` with ``prediction`` (binomial: the class, and ``probability``) at lambda.min, or at the
        lambda of index ``at``; NULL where a predictor is missing."""
        eta = F.when(_complete(self.features), self.linear(at))
        if self.family == "gaussian":
            return df.withColumn("prediction", eta)
        return df.withColumn("probability", 1 / (1 + F.exp(-eta))).withColumn("prediction", (F.col("probability") > 0.5).cast("double"))

    def table(self, spark) -> DataFrame:
        rows = [(i + 1, float(lam), float(m), float(s), int((b != 0).sum()), i == self.index_min, i == self.index_1se)
                for i, (lam, m, s, b) in enumerate(zip(self.lambdas, self.cv_mean, self.cv_sd, self.coef))]
        return spark.createDataFrame(rows, "step int, lambda double, cv_mean double, cv_sd double, nonzero int, is_min boolean, is_1se boolean")


def _sequence(top: float, n: int, k: int, nlambda: int, lambdas) -> np.ndarray:
    if lambdas is not None:
        return np.array(sorted({float(x) for x in lambdas}, reverse=True))
    low = 1e-4 if n > k else 1e-2
    return max(top, 1e-300) * np.exp(np.linspace(0.0, math.log(low), nlambda))


def _descend(R: np.ndarray, r: np.ndarray, b: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Coordinate descent of many problems at once: R (m, k, k), r (m, k), penalties (m, k)."""
    diagonal = np.einsum("mkk->mk", R) + l2
    free = diagonal > 0
    for _ in range(SWEEPS):
        moved = 0.0
        for j in range(R.shape[1]):
            z = r[:, j] - np.einsum("mk,mk->m", R[:, j], b) + R[:, j, j] * b[:, j]
            new = np.where(free[:, j], np.sign(z) * np.maximum(np.abs(z) - l1[:, j], 0) / np.where(free[:, j], diagonal[:, j], 1), 0.0)
            change = np.abs(new - b[:, j]) * np.sqrt(np.abs(R[:, j, j]))
            moved = max(moved, float(change.max(initial=0.0)))
            b[:, j] = new
        if moved < TOLERANCE:
            break
    return b


def _folds(df: DataFrame, key: str | None, nfolds: int, fold_col: str | None, seed: int) -> Column:
    if fold_col:
        return F.col(_q(fold_col)).cast("int")
    if key is None:
        raise ValueError("the elastic net needs a row key or a fold column")
    return F.pmod(F.xxhash64(F.col(_q(key)), F.lit(seed)), F.lit(nfolds)).cast("int")


def _choice(errors: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, standard error) over folds of ``errors`` (fold, lambda), weighted by the folds' rows."""
    w = sizes / sizes.sum()
    mean = w @ errors
    return mean, np.sqrt(w @ (errors - mean) ** 2 / max(len(sizes) - 1, 1))


def _scale(matrix: np.ndarray, n: float, standardize: bool) -> tuple[np.ndarray, np.ndarray]:
    """(means, standard deviations) of the columns after the constant; 1 where they don't vary."""
    mean = matrix[0, 1:] / n
    var = np.maximum(np.diag(matrix)[1:] / n - mean ** 2, 0)
    return mean, np.where(var > 1e-28, np.sqrt(var), 1.0) if standardize else np.ones(len(mean))


def elastic_net(df: DataFrame, y: str, features: Sequence[str], family: str = "gaussian", key: str | None = None,
                alpha: float = 1.0, nlambda: int = 100, nfolds: int = 5, lambdas: Sequence[float] | None = None,
                standardize: bool = True, fold_col: str | None = None, weight: str | None = None, seed: int = 42) -> PathFit:
    """The path fitted on the rows complete in ``y`` and ``features``; folds from ``fold_col`` or a hash
    of ``key``.  The binomial target is 0 or 1."""
    if family not in ("gaussian", "binomial"):
        raise ValueError(f"unknown family {family}")
    features = list(features)
    w = F.lit(1.0) if weight is None else F.col(_q(weight)).cast("double")
    data = df.where(_complete([y, *features, *([weight] if weight else [])])).select(
        *[F.col(_q(c)).cast("double").alias(f"_x{i}") for i, c in enumerate(features)], F.col(_q(y)).cast("double").alias("_y"),
        w.alias("_w"), _folds(df, key, nfolds, fold_col, seed).alias("_fold")).where("_fold IS NOT NULL")
    xs = [f"_x{i}" for i in range(len(features))]
    if family == "binomial":
        data = ranks.materialize(data)
    means = data.agg(F.count(F.lit(1)), *[F.sum(F.col(c) * F.col("_w")) / F.sum("_w") for c in [*xs, "_y"]]).first()
    n = int(means[0])
    train_shape_guard(n, n, len(features), "elastic net")
    mu = np.array(means[1:], float)
    if family == "binomial":
        mu[-1] = 0.0
    cols = [F.lit(1.0), *[F.col(c) - F.lit(float(m)) for c, m in zip([*xs, "_y"], mu)]]
    moments = {r["_fold"]: r.asDict() for r in cross_moments(data, cols, [], "_w", ["_fold"]).collect()}   # one row a fold
    names = sorted(moments)
    if len(names) < 2:
        raise ValueError("the elastic net needs at least two folds")
    M = np.stack([_matrix(moments[f], len(cols)) for f in names])
    run = _gaussian if family == "gaussian" else _binomial
    lam, a, b, mean, sd, converged = run(data, M, names, mu, len(features), alpha, nlambda, lambdas, standardize)
    return PathFit(family, features, lam, a, b + 0.0, mean, sd, converged, n)     # no negative zeros


def _gaussian(data, M, names, mu, k, alpha, nlambda, lambdas, standardize):
    total = M.sum(axis=0)
    sets = np.concatenate([total[None], total - M])            # all rows, then all but each fold
    R, r, scale, center, spread = [], [], [], [], []
    for m in sets:
        n = m[0, 0]
        mean, sd = _scale(m, n, standardize)
        S = m[1:, 1:] / n - np.outer(mean, mean)
        dev = math.sqrt(max(S[k, k], 1e-300))                  # the target has unit variance too
        R.append(S[:k, :k] / np.outer(sd[:k], sd[:k]))
        r.append(S[:k, k] / sd[:k] / dev)
        scale.append(sd[:k])
        center.append(mean)
        spread.append(dev)
    R, r, scale, center, spread = map(np.array, (R, r, scale, center, spread))
    lam = _sequence(np.abs(r[0]).max() / max(alpha, 1e-3) * spread[0], int(total[0, 0]), k, nlambda, lambdas)
    b, path = np.zeros_like(r), []
    for x in lam:
        own = (x / spread)[:, None] * np.ones_like(r)
        b = _descend(R, r, b.copy(), own * alpha, own * (1 - alpha))
        path.append(b * spread[:, None] / scale)               # back on the scale of the data
    path = np.array(path)                                      # (lambda, set, feature)
    cut = center[None, :, k] - np.einsum("lsk,sk->ls", path, center[:, :k])
    errors = np.zeros((len(names), len(lam)))
    for f in range(len(names)):
        v = np.concatenate([-cut[:, f + 1, None], -path[:, f + 1], np.ones((len(lam), 1))], axis=1)
        errors[f] = np.einsum("li,ij,lj->l", v, M[f], v) / M[f][0, 0]
    mean, sd = _choice(errors, M[:, 0, 0])
    return lam, cut[:, 0] + mu[k] - path[:, 0] @ mu[:k], path[:, 0], mean, sd, True


def _binomial(data, M, names, mu, k, alpha, nlambda, lambdas, standardize):
    total = M.sum(axis=0)
    n = total[0, 0]
    _, sd = _scale(total, n, standardize)
    sd = sd[:k]
    # predictors are centred at their means over all rows and scaled by their deviations
    center = mu[:k]
    rate = total[0, k + 1] / n
    if not 0 < rate < 1:
        raise ValueError("the binomial elastic net needs both classes")
    top = np.abs((total[1:k + 1, k + 1] - total[0, 1:k + 1] * rate) / sd / n).max() / max(alpha, 1e-3)
    lam = _sequence(top, int(n), k, nlambda, lambdas)
    sets, L = len(names) + 1, len(lam)
    sizes = np.concatenate([[n], n - M[:, 0, 0]])
    rates = np.clip(np.concatenate([[rate], (total[0, k + 1] - M[:, 0, k + 1]) / sizes[1:]]), 1e-6, 1 - 1e-6)
    b = np.zeros((sets, L, k + 1))
    b[:, :, 0] = np.log(rates / (1 - rates))[:, None]
    l1 = np.concatenate([[0.0], np.full(k, alpha)])[None, None] * lam[None, :, None] * np.ones((sets, 1, 1))
    l2 = np.concatenate([[0.0], np.full(k, 1 - alpha)])[None, None] * lam[None, :, None] * np.ones((sets, 1, 1))
    converged = False
    for _ in range(NEWTON_STEPS):
        H, g = _sums(data, b, names, center, sd)
        H, g = H / sizes[:, None, None, None], g / sizes[:, None, None]
        r = np.einsum("slij,slj->sli", H, b) + g
        new = _descend(H.reshape(-1, k + 1, k + 1), r.reshape(-1, k + 1), b.reshape(-1, k + 1).copy(),
                       l1.reshape(-1, k + 1), l2.reshape(-1, k + 1)).reshape(b.shape)
        moved = float(np.abs(new - b).max())
        b = new
        if moved < NEWTON_TOLERANCE:
            converged = True
            break
    loss = _losses(data, b, names, center, sd)
    mean, spread = _choice(loss / M[:, 0, 0][:, None], M[:, 0, 0])
    coef = b[0, :, 1:] / sd
    return lam, b[0, :, 0] - coef @ center, coef, mean, spread, converged


def _blocks(batches, k: int, names: list, center: np.ndarray, sd: np.ndarray):
    """(fold's place, rows with a constant, targets, weights) of the rows of one fold, BLOCK_ROWS at a time."""
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        X = (np.column_stack(columns[:k]) - center) / sd
        for place, name in enumerate(names):
            mine = np.flatnonzero(columns[k + 2] == name)
            for i in range(0, len(mine), BLOCK_ROWS):
                at = mine[i:i + BLOCK_ROWS]
                yield place, np.column_stack([np.ones(len(at)), X[at]]), columns[k][at], columns[k + 1][at]


def _added(data: DataFrame, k: int, fits: int, width: int, batch_sums) -> np.ndarray:
    """(width, fits) sums over all rows: every task sends one row a fit."""
    ship_package(data.sparkSession)

    def run(batches):
        out = batch_sums(batches)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(fits)), *(pa.array(row) for row in out)],
                                             ["fit", *(f"s{i}" for i in range(width))])
    cols = [*[f"_x{i}" for i in range(k)], "_y", "_w", "_fold"]
    parts = data.select(*cols).mapInArrow(run, "fit long, " + ", ".join(f"s{i} double" for i in range(width)))
    rows = parts.groupBy("fit").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).orderBy("fit").toArrow()
    return np.array([rows[f"s{i}"].to_numpy() for i in range(width)])


def _sums(data: DataFrame, b: np.ndarray, names: list, center: np.ndarray, sd: np.ndarray):
    """For every (set, lambda): weighted products of the predictors and the gradient.  The rows of a fold
    meet only the sets that train on them."""
    sets, L, k1 = b.shape
    upper = np.triu_indices(k1)
    m = len(upper[0])
    shared = data.sparkSession.sparkContext.broadcast((b, center, sd))    # coefficients of all fits

    def batch_sums(batches):
        b, center, sd = shared.value
        out, seen = np.zeros((m + k1, sets, L)), False
        for place, x, y, w in _blocks(batches, k1 - 1, names, center, sd):
            seen = True
            use = [s for s in range(sets) if s != place + 1]
            p = x @ b[use].reshape(-1, k1).T
            np.clip(p, -700, 700, out=p)
            np.negative(p, out=p)
            np.exp(p, out=p)
            p += 1
            np.reciprocal(p, out=p)
            curve = p * (1 - p)
            np.maximum(curve, LEAST_WEIGHT, out=curve)
            out[:m, use] += ((x[:, upper[0]] * x[:, upper[1]] * w[:, None]).T @ curve).reshape(m, -1, L)
            out[m:, use] += ((x * (w * y)[:, None]).sum(axis=0)[:, None] - (x * w[:, None]).T @ p).reshape(k1, -1, L)
        return out.reshape(m + k1, -1) if seen else None
    got = _added(data, k1 - 1, sets * L, m + k1, batch_sums).reshape(m + k1, sets, L)
    H = np.zeros((sets, L, k1, k1))
    for row, (i, j) in zip(got, zip(*upper)):
        H[:, :, i, j] = H[:, :, j, i] = row
    return H, np.moveaxis(got[m:], 0, -1)


def _losses(data: DataFrame, b: np.ndarray, names: list, center: np.ndarray, sd: np.ndarray) -> np.ndarray:
    """(fold, lambda): the deviance of a fold's rows under the fits of the set that leaves them out."""
    sets, L, k1 = b.shape
    shared = data.sparkSession.sparkContext.broadcast((b, center, sd))

    def batch_sums(batches):
        b, center, sd = shared.value
        out, seen = np.zeros((sets - 1, L)), False
        for place, x, y, w in _blocks(batches, k1 - 1, names, center, sd):
            seen = True
            eta = x @ b[place + 1].T
            out[place] += 2 * (w @ (np.logaddexp(0, eta) - y[:, None] * eta))
        return out.reshape(1, -1) if seen else None
    return _added(data, k1 - 1, (sets - 1) * L, 1, batch_sums).reshape(sets - 1, L)
