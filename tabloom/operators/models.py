"""Models: a registry of ``pyspark.ml`` estimators by task type, plus
moment-based linear models whose fit is one aggregate of cross-products
(X'WX, X'Wy) and a K x K solve on the driver - only K^2 numbers leave the
cluster, whatever the row count."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf, f_sf, t_sf2


# ----------------------------------------------------------------- moments

def _x(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def cross_moments(df: DataFrame, cols: Sequence[str | Column], names: Sequence[str],
                  weight: str | Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One aggregate: n, sum(w), sum(w*a*b) for every pair (upper triangle)."""
    w = F.lit(1.0) if weight is None else _x(weight)
    xs = [_x(c) for c in cols]
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_sw")]
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            aggs.append(F.sum(w * xs[i] * xs[j]).alias(f"m_{i}_{j}"))
    return df.groupBy(*keys).agg(*aggs)


def _matrix(row: dict, k: int) -> np.ndarray:
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m_{i}_{j}"] or 0.0
    return m


@dataclass
class LinearFit:
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    sigma2: float
    n: int
    df_resid: int
    r2: float
    xtx_inv: np.ndarray = field(repr=False, default=None)

    def table(self, spark, cov: np.ndarray | None = None):
        c = self.cov if cov is None else cov
        rows = []
        for i, t in enumerate(self.terms):
            se = math.sqrt(c[i, i]) if c[i, i] >= 0 else float("nan")
            st = self.coef[i] / se if se > 0 else float("nan")
            rows.append((t, float(self.coef[i]), float(se), float(st), float(t_sf2(st, self.df_resid))))
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, statistic double, p_value double")

    def predict(self, cols: dict[str, Column]) -> Column:
        e = F.lit(0.0)
        for i, t in enumerate(self.terms):
            e = e + (F.lit(1.0) if t == "(Intercept)" else cols[t].cast("double")) * F.lit(float(self.coef[i]))
        return e


def ols(df: DataFrame, y: str, xcols: Sequence[str], weight: str | None = None, intercept: bool = True,
        extra: dict[str, Column] | None = None) -> LinearFit:
    """Weighted least squares over complete rows.  With an intercept the
    columns are first centred at their (weighted) means - one small aggregate -
    so the cross-moment aggregate does not lose precision to large offsets."""
    extra = extra or {}
    exprs = {c: F.col(_q(c)).cast("double") for c in xcols}
    exprs.update({k: v.cast("double") for k, v in extra.items()})
    names = list(exprs)
    yy = F.col(_q(y)).cast("double")
    ok = _given(yy)
    for c in exprs.values():
        ok = ok & _given(c)
    data = df.where(ok)
    w = F.lit(1.0) if weight is None else F.col(_q(weight)).cast("double")
    if intercept:
        mrow = data.agg(F.sum(w).alias("_sw"), *[(F.sum(w * exprs[c]) / F.sum(w)).alias(f"mu{i}")
                                                 for i, c in enumerate(names)],
                        (F.sum(w * yy) / F.sum(w)).alias("mu_y")).first().asDict()
        mus = [mrow[f"mu{i}"] for i in range(len(names))]
        cols = [exprs[c] - F.lit(m) for c, m in zip(names, mus)] + [yy - F.lit(mrow["mu_y"])]
    else:
        mus = [0.0] * len(names)
        cols = [exprs[c] for c in names] + [yy]
    row = cross_moments(data, cols, names + [y], w).first().asDict()
    k = len(names)
    M = _matrix(row, k + 1)
    xtx, xty, yty = M[:k, :k], M[:k, k], M[k, k]
    inv_s = np.linalg.pinv(xtx)
    b = inv_s @ xty
    ssr = float(yty - 2 * b @ xty + b @ xtx @ b)
    n = int(row["_n"])
    p = k + (1 if intercept else 0)
    dfr = n - p
    s2 = ssr / dfr if dfr > 0 else float("nan")
    sst = float(yty)
    r2 = 1 - ssr / sst if sst > 0 else float("nan")
    if intercept:
        sw = row["_sw"]
        b0 = mrow["mu_y"] - float(np.dot(b, mus))
        # covariance of (intercept, slopes) from the centred solve
        mu = np.array(mus)
        full_inv = np.zeros((k + 1, k + 1))
        full_inv[1:, 1:] = inv_s
        full_inv[0, 0] = 1.0 / sw + mu @ inv_s @ mu
        full_inv[0, 1:] = full_inv[1:, 0] = -(inv_s @ mu)
        coef = np.concatenate([[b0], b])
        return LinearFit(["(Intercept)", *names], coef, full_inv * s2, s2, n, dfr, r2, full_inv)
    return LinearFit(names, b, inv_s * s2, s2, n, dfr, r2, inv_s)


def robust_se(df: DataFrame, fit: LinearFit, y: str, cols: dict[str, Column], kind: str = "HC3") -> np.ndarray:
    """Sandwich covariance HC0 / HC1 / HC3.  The meat sum(e^2 * g * x x') is
    one aggregate; leverage h = x' (X'X)^-1 x is an expression of literals."""
    xs = [F.lit(1.0) if t == "(Intercept)" else cols[t].cast("double") for t in fit.terms]
    e = F.col(y).cast("double") - fit.predict(cols)
    k = len(xs)
    inv = fit.xtx_inv
    h = F.lit(0.0)
    for i in range(k):
        for j in range(k):
            if inv[i, j] != 0:
                h = h + xs[i] * xs[j] * F.lit(float(inv[i, j]))
    g = F.pow(e, 2) / F.pow(1 - h, 2) if kind.upper() == "HC3" else F.pow(e, 2)
    ok = F.col(y).isNotNull()
    for c in cols.values():
        ok = ok & c.isNotNull()
    aggs = [F.sum(g * xs[i] * xs[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]
    meat = _matrix(df.where(ok).agg(*aggs).first().asDict(), k)
    V = inv @ meat @ inv
    if kind.upper() == "HC1":
        V = V * fit.n / (fit.n - k)
    return V


def did_2x2(df: DataFrame, y: str, treat: str, post: str, controls: Sequence[str] = ()) -> dict:
    """Difference-in-differences: OLS of y on treat, post, treat:post (+controls);
    returns the interaction estimate, SE and p-value."""
    inter = (F.col(treat).cast("double") * F.col(post).cast("double"))
    fit = ols(df, y, [treat, post, *controls], extra={f"{treat}:{post}": inter})
    i = fit.terms.index(f"{treat}:{post}")
    se = math.sqrt(fit.cov[i, i])
    return {"ate": float(fit.coef[i]), "se": se, "p": t_sf2(fit.coef[i] / se, fit.df_resid), "n": fit.n}


def iv_2sls(df: DataFrame, y: str, x_endog: Sequence[str], instruments: Sequence[str],
            controls: Sequence[str] = ()) -> dict:
    """Two-stage least squares and its diagnostics from one matrix of centred cross-moments
    (one aggregate for the means, one for the moments; nothing else reaches the driver).

    ``diagnostics`` has, as (statistic, df1, df2, p): ``weak_<x>``, the F test of the excluded
    instruments in each first stage; ``wu_hausman``, the F test of the first-stage residuals
    added to the structural equation; ``sargan``, n times the share of the residuals that the
    instruments explain (None where no instrument is to spare).  Every regression of the
    diagnostics is on linear combinations of the same variables, so all come from the matrix."""
    xs, zs = [*x_endog, *controls], [*instruments, *controls]
    names = list(dict.fromkeys([*zs, *xs, y]))
    cols = {c: F.col(_q(c)).cast("double") for c in names}
    data = df.where(_complete(names))
    means = data.agg(*[F.avg(cols[c]).alias(f"m{i}") for i, c in enumerate(names)]).first()
    mu = np.array([v if v is not None else 0.0 for v in means], float)
    row = cross_moments(data, [cols[c] - F.lit(float(m)) for c, m in zip(names, mu)], names).first().asDict()
    n = int(row["_n"])
    train_shape_guard(n, n, len(xs), "2SLS")
    M, at = _matrix(row, len(names)), {c: i for i, c in enumerate(names)}

    def pick(cs):
        out = np.zeros((len(names), len(cs)))
        for j, c in enumerate(cs):
            out[at[c], j] = 1.0
        return out
    X, Z, Y = pick(xs), pick(zs), pick([y])[:, 0]
    first = np.linalg.pinv(Z.T @ M @ Z) @ (Z.T @ M @ X)       # first stages, one column a regressor
    fitted = Z @ first
    inv = np.linalg.pinv(fitted.T @ M @ fitted)
    b = inv @ (fitted.T @ M @ Y)
    u = Y - X @ b                                             # the residual as a combination of columns
    k = 1 + len(xs)
    s2 = float(u @ M @ u) / (n - k)
    mx = np.array([mu[at[c]] for c in xs])
    cov = np.zeros((k, k))
    cov[1:, 1:] = inv
    cov[0, 0] = 1.0 / n + mx @ inv @ mx
    cov[0, 1:] = cov[1:, 0] = -(inv @ mx)
    coef, se = np.r_[mu[at[y]] - b @ mx, b], np.sqrt(np.diag(cov) * s2)

    def rss(target: np.ndarray, regressors: np.ndarray) -> float:
        if not regressors.shape[1]:
            return float(target @ M @ target)
        w = np.linalg.pinv(regressors.T @ M @ regressors) @ (regressors.T @ M @ target)
        left = target - regressors @ w
        return float(left @ M @ left)

    def f_test(small: float, large: float, d1: int, d2: int) -> tuple:
        f = (small - large) / d1 / (large / d2) if d1 > 0 and d2 > 0 and large > 0 else float("nan")
        return f, d1, d2, f_sf(f, d1, d2) if math.isfinite(f) else float("nan")
    diagnostics = {}
    for c in x_endog:
        x = pick([c])[:, 0]
        diagnostics[f"weak_{c}"] = f_test(rss(x, pick(list(controls))), rss(x, Z), len(instruments), n - 1 - len(zs))
    residuals = X[:, :len(x_endog)] - fitted[:, :len(x_endog)]
    diagnostics["wu_hausman"] = f_test(rss(Y, X), rss(Y, np.hstack([X, residuals])), len(x_endog), n - k - len(x_endog))
    spare = len(instruments) - len(x_endog)
    explained = float(u @ M @ u) - rss(u, Z)
    stat = n * explained / float(u @ M @ u) if spare > 0 else None
    diagnostics["sargan"] = None if stat is None else (stat, spare, None, chi2_sf(stat, spare))
    return {"terms": ["(Intercept)", *xs], "coef": coef.tolist(), "se": se.tolist(), "n": n, "sigma2": s2,
            "t": (coef / se).tolist(), "p": [t_sf2(float(t), n - k) for t in coef / se], "diagnostics": diagnostics}


# ----------------------------------------------------------------- registry

@dataclass
class ModelSpec:
    id: str
    label: str
    task_types: tuple[str, ...]
    build: Callable[[dict], object]
    params: dict = field(default_factory=dict)


MODEL_REGISTRY: dict[str, ModelSpec] = {}


def register_model(spec: ModelSpec) -> None:
    MODEL_REGISTRY[spec.id] = spec


def models_for_task(task_type: str) -> list[str]:
    return [m.id for m in MODEL_REGISTRY.values() if task_type in m.task_types]


def _ml():
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    return C, R


def _lm(p):
    _, R = _ml()
    return R.LinearRegression(regParam=0.0, solver="normal", fitIntercept=bool(p.get("intercept", True)))


def _logit(p):
    _, R = _ml()
    return R.GeneralizedLinearRegression(family="binomial", link=p.get("link", "logit"),
                                         maxIter=int(p.get("maxit", 50)), tol=float(p.get("epsilon", 1e-8)))


def _glmnet_reg(p):
    _, R = _ml()
    return R.LinearRegression(elasticNetParam=float(p.get("alpha", 1.0)), regParam=float(p.get("lambda", 0.01)),
                              standardization=bool(p.get("standardize", True)))


def _glmnet_cls(p):
    C, _ = _ml()
    return C.LogisticRegression(elasticNetParam=float(p.get("alpha", 1.0)), regParam=float(p.get("lambda", 0.01)),
                                standardization=bool(p.get("standardize", True)))


def _rf_reg(p):
    _, R = _ml()
    depth = int(p.get("max_depth", 0)) or 30
    return R.RandomForestRegressor(numTrees=int(p.get("num_trees", 500)), maxDepth=min(depth, 30),
                                   minInstancesPerNode=int(p.get("min_node_size", 5)),
                                   subsamplingRate=float(p.get("sample_fraction", 1.0)), seed=42)


def _rf_cls(p):
    C, _ = _ml()
    depth = int(p.get("max_depth", 0)) or 30
    return C.RandomForestClassifier(numTrees=int(p.get("num_trees", 500)), maxDepth=min(depth, 30),
                                    minInstancesPerNode=int(p.get("min_node_size", 1)),
                                    subsamplingRate=float(p.get("sample_fraction", 1.0)), seed=42)


def _gbt_reg(p):
    _, R = _ml()
    return R.GBTRegressor(maxIter=int(p.get("nrounds", p.get("num_iterations", p.get("iterations", 200)))),
                          stepSize=float(p.get("eta", p.get("learning_rate", 0.1))),
                          maxDepth=int(p.get("max_depth", 6)) if int(p.get("max_depth", 6)) > 0 else 6,
                          subsamplingRate=float(p.get("subsample", p.get("bagging_fraction", 0.9))),
                          featureSubsetStrategy=str(p.get("colsample_bytree", p.get("feature_fraction", "all"))),
                          seed=42)


def _gbt_multi(p):
    """Multiclass boosting: one-vs-rest over binary boosted trees."""
    C, _ = _ml()
    return C.OneVsRest(classifier=_gbt_cls(p))


def _gbt_cls(p):
    C, _ = _ml()
    return C.GBTClassifier(maxIter=int(p.get("nrounds", p.get("num_iterations", 200))),
                           stepSize=float(p.get("eta", p.get("learning_rate", 0.1))),
                           maxDepth=int(p.get("max_depth", 6)) if int(p.get("max_depth", 6)) > 0 else 6,
                           subsamplingRate=float(p.get("subsample", p.get("bagging_fraction", 0.9))), seed=42)


def _lightgbm_cls(p):
    """Boosted trees that grow leaf by leaf to ``num_leaves``, as deep as these lead unless ``max_depth`` is above 0.
    Where ``fit_model`` has to leave them to ``pyspark.ml``, which cannot, they grow to that depth, or to 6."""
    from . import boosting
    least, depth = int(p["min_data_in_leaf"]), int(p["max_depth"])
    est = _gbt_cls(p).setMinInstancesPerNode(max(least, 1))
    est.leaf_budget = boosting.LeafBudget(int(p["num_leaves"]), least, depth if depth > 0 else None)
    return est


def _poisson(p):
    _, R = _ml()
    return R.GeneralizedLinearRegression(family="poisson", link=p.get("link", "log"),
                                         maxIter=int(p.get("maxit", 50)), tol=float(p.get("epsilon", 1e-8)))


def _betareg(p):
    _, R = _ml()
    # fractional response GLM on (0, 1): quasi-binomial mean model
    return R.GeneralizedLinearRegression(family="binomial", link=p.get("link", "logit"))


def _mlp(p):
    C, _ = _ml()
    hidden = [int(x) for x in str(p.get("hidden_units", "128,64")).split(",") if x.strip()]
    return C.MultilayerPerceptronClassifier(layers=[int(p["n_features"]), *hidden, int(p["n_classes"])],
                                            maxIter=int(p.get("epochs", 50)), stepSize=float(p.get("learning_rate", 0.001)),
                                            blockSize=int(p.get("batch_size", 32)), seed=42)


for _spec in [
    ModelSpec("lm", "Linear regression", ("regression",), _lm, {"intercept": True}),
    ModelSpec("logit", "Logistic regression", ("binary_classification",), _logit, {"link": "logit"}),
    ModelSpec("glmnet_reg", "Elastic net", ("regression",), _glmnet_reg, {"alpha": 1.0}),
    ModelSpec("glmnet_cls", "Elastic net (binomial)", ("binary_classification",), _glmnet_cls, {"alpha": 1.0}),
    ModelSpec("ranger_reg", "Random forest", ("regression",), _rf_reg, {"num_trees": 500}),
    ModelSpec("ranger_cls", "Random forest", ("binary_classification", "multiclass_classification"), _rf_cls,
              {"num_trees": 500}),
    ModelSpec("xgb_reg", "Gradient boosting", ("regression",), _gbt_reg, {"nrounds": 200}),
    ModelSpec("xgb_cls", "Gradient boosting", ("binary_classification",), _gbt_cls, {"nrounds": 200}),
    ModelSpec("lightgbm_reg", "Gradient boosting (leaf-wise settings)", ("regression",), _gbt_reg,
              {"num_iterations": 300, "learning_rate": 0.05}),
    ModelSpec("lightgbm_cls", "Gradient boosting (leaf-wise settings)", ("binary_classification",), _lightgbm_cls,
              {"num_iterations": 300, "learning_rate": 0.05, "num_leaves": 31, "max_depth": -1, "min_data_in_leaf": 20,
               "bagging_fraction": 1.0}),
    ModelSpec("catboost_reg", "Gradient boosting on target-encoded levels", ("regression",), _gbt_reg,
              {"iterations": 500}),
    ModelSpec("mlp_cls", "Multilayer perceptron", ("binary_classification", "multiclass_classification"), _mlp,
              {"hidden_units": "128,64"}),
    ModelSpec("poisson", "Poisson GLM", ("count",), _poisson, {"link": "log"}),
    ModelSpec("betareg", "Fractional logit for proportions", ("proportion",), _betareg, {"link": "logit"}),
]:
    register_model(_spec)


def _q(name: str) -> str:
    """A column's exact name, dots and all."""
    return f"`{name.replace('`', '``')}`"


def _given(c: Column) -> Column:
    """Neither NULL nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def _complete(features: Sequence[str]) -> Column:
    """Rows with a value of every predictor; a NaN is a missing value."""
    ok = F.lit(True)
    for c in features:
        ok = ok & F.coalesce(_given(F.col(_q(c)).cast("double")), F.lit(False))
    return ok


def _inputs(features: Sequence[str]) -> list[str]:
    return [f"_x{i}" for i in range(len(features))]


def _with_inputs(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Predictors under names that the assembler can read."""
    return df.withColumns({n: F.col(_q(c)).cast("double") for n, c in zip(_inputs(features), features)})


PORTION_ROWS = 500_000      # rows of a partition that trees are grown on


def _portioned(data: DataFrame, rows: int) -> DataFrame:
    """``data`` in partitions of about ``PORTION_ROWS`` rows or less, however large its files are."""
    parts = -(-rows // PORTION_ROWS)
    return data.repartition(parts) if parts > data.rdd.getNumPartitions() else data


def _boosted(est, data: DataFrame, inputs: Sequence[str], rows: int):
    """Boosted trees grown on the table of the predictors' binned cells, which passes over the rows once
    for some rounds instead of once a level; None for other estimators and for more cells than the limit."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor
    from . import boosting
    classes = isinstance(est, GBTClassifier)
    if not (classes or isinstance(est, GBTRegressor)) or est.getFeatureSubsetStrategy() not in ("all", "1.0"):
        return None
    if classes and data.where(~F.col("label").isin(0.0, 1.0)).limit(1).count():
        return None                          # pyspark.ml says what is wrong
    return boosting.fit(data, inputs, classes, est.getMaxIter(), est.getStepSize(), est.getMaxDepth(),
                        est.getSubsamplingRate(), est.getSeed(), rows, getattr(est, "leaf_budget", None))


def fit_model(df: DataFrame, model_id: str, target: str, features: Sequence[str], params: dict | None = None,
              weight: str | None = None):
    """Assemble features and fit a registered estimator on the rows complete in target and
    predictors; returns (model, assembler), ``assembler.rows_dropped`` tells how many of
    the rows with a target were incomplete."""
    from pyspark.ml.feature import VectorAssembler
    spec = MODEL_REGISTRY[model_id]
    p = dict(spec.params)
    p.update(params or {})
    est = spec.build(p)
    label = F.col(_q(target)).cast("double")
    complete = _given(label) & _complete(features)
    n, used = df.agg(F.count_if(_given(label)), F.count_if(complete)).first()
    train_shape_guard(n, n if used else 0, len(features), model_id)
    asm = VectorAssembler(inputCols=_inputs(features), outputCol="features")
    asm.predictors = list(features)
    data = asm.transform(_with_inputs(df.where(complete), features)).withColumn("label", label)
    est = est.setFeaturesCol("features").setLabelCol("label")
    if weight and hasattr(est, "setWeightCol"):
        est = est.setWeightCol(weight)
    model = None if weight else _boosted(est, data, _inputs(features), used)
    if model is None and hasattr(est, "getMaxBins"):          # trees hold their rows as objects
        data = _portioned(data.select("features", "label", *([_q(weight)] if weight else [])), used)
    model = model or est.fit(data)
    asm.rows_used, asm.rows_dropped = used, n - used   # dropped: with a target but incomplete predictors
    return model, asm


def score(model, asm, df: DataFrame) -> DataFrame:
    """Predictions for every row of ``df``; a row with a missing predictor keeps its
    place with a NULL prediction."""
    complete = _complete(asm.predictors)
    scored = model.transform(asm.transform(_with_inputs(df.where(complete), asm.predictors)))
    return scored.drop(*asm.getInputCols()).unionByName(df.where(~complete), allowMissingColumns=True)


def align_scoring_columns(df: DataFrame, train_columns: Sequence[str]) -> DataFrame:
    """Score-time design matrix: columns missing from new data are 0, extras dropped."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(0.0)).alias(c) for c in train_columns])


def train_shape_guard(n_y: int, n_x_rows: int, n_x_cols: int, label: str) -> None:
    if n_y == 0:
        raise ValueError(f"Cannot train {label}: the target has no rows.")
    if n_x_rows == 0 or n_x_cols == 0:
        raise ValueError(f"Cannot train {label}: the predictor matrix is empty.")
    if n_y != n_x_rows:
        raise ValueError(f"Cannot train {label}: target has {n_y} rows but predictors have {n_x_rows}.")


def lm_f_test(fit: LinearFit) -> float:
    k = len(fit.terms) - 1
    if k <= 0 or not math.isfinite(fit.r2):
        return float("nan")
    f = (fit.r2 / k) / ((1 - fit.r2) / fit.df_resid)
    return f_sf(f, k, fit.df_resid)


# Parameters of the default / aggressive / conservative presets,
# per model family; a family without an entry keeps its registry defaults.
_XGB = {"default": {"eta": 0.1, "max_depth": 6, "subsample": 0.9, "colsample_bytree": 0.9, "nrounds": 200},
        "aggressive": {"eta": 0.05, "max_depth": 10, "subsample": 1.0, "colsample_bytree": 1.0, "nrounds": 1500},
        "conservative": {"eta": 0.05, "max_depth": 4, "subsample": 0.7, "colsample_bytree": 0.7, "nrounds": 500,
                         "gamma": 1, "lambda": 5, "alpha": 1}}
_RANGER = {"default": {"num_trees": 500, "min_node_size": 5, "sample_fraction": 1},
           "aggressive": {"num_trees": 1500, "min_node_size": 1, "sample_fraction": 1},
           "conservative": {"num_trees": 1000, "min_node_size": 10, "sample_fraction": 0.7}}
_LIGHTGBM = {"default": {"num_iterations": 300, "learning_rate": 0.05, "num_leaves": 31},
             "aggressive": {"num_iterations": 2000, "learning_rate": 0.02, "num_leaves": 127},
             "conservative": {"num_iterations": 500, "learning_rate": 0.05, "num_leaves": 15, "min_data_in_leaf": 50}}
MODEL_PRESETS = {
    "xgb_reg": _XGB, "xgb_cls": _XGB, "ranger_reg": _RANGER,
    "ranger_cls": {**_RANGER, "default": {**_RANGER["default"], "min_node_size": 1}},
    "lightgbm_reg": _LIGHTGBM, "lightgbm_cls": _LIGHTGBM,
}


def preset(model_id: str, kind: str = "default") -> dict:
    """Parameters of a preset; empty (registry defaults) where a family has none."""
    if kind not in ("default", "aggressive", "conservative"):
        raise ValueError(f"unknown preset {kind}")
    return dict(MODEL_PRESETS.get(model_id, {}).get(kind, {}))


def feature_importance(model, features: Sequence[str]):
    """Built-in importance: forest / boosting impurity importances, |t| for
    linear models; returns [(feature, importance)]."""
    if hasattr(model, "featureImportances"):
        return list(zip(features, [float(v) for v in model.featureImportances.toArray()]))
    if hasattr(model, "summary") and hasattr(model.summary, "tValues"):
        t = model.summary.tValues
        return list(zip(features, [abs(float(v)) for v in t[:len(features)]]))
    return [(f, float("nan")) for f in features]


# ----------------------------------------------------------------- GAM

def gam_fit(df: DataFrame, y: str, xcols: Sequence[str], k: int = 10,
            lambdas: Sequence[float] | None = None) -> dict:
    """Additive model: each predictor gets a cubic truncated-power spline basis
    with k-4 interior knots at its exact quantiles (standardised first); the
    knot terms are ridge-penalised and lambda is chosen by GCV.  The fit is one
    cross-moment aggregate; GCV for every lambda is computed from the moments
    (trace of the hat matrix = tr((X'X + lambda P)^-1 X'X))."""
    from ..operators.recipe import exact_quantile_values
    lambdas = list(lambdas) if lambdas else [10.0 ** e for e in range(-6, 5)]
    st = df.agg(*[a for c in xcols for a in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).first()
    zc = {c: (F.col(c).cast("double") - st[f"m_{c}"]) / (st[f"s_{c}"] or 1.0) for c in xcols}
    nk = max(k - 4, 0)
    probs = [(j + 1) / (nk + 1) for j in range(nk)]
    zdf = df.select(*[zc[c].alias(c) for c in xcols], F.col(y).cast("double").alias("_y"))
    q = exact_quantile_values(zdf, list(xcols), probs) if nk else {c: [] for c in xcols}
    cols, names, pen = [F.lit(1.0)], ["(Intercept)"], [0.0]
    for c in xcols:
        z = F.col(c)
        cols += [z, z * z, z * z * z]
        names += [f"{c}", f"{c}^2", f"{c}^3"]
        pen += [0.0, 0.0, 0.0]
        for j, kn in enumerate(sorted(set(v for v in q[c] if v is not None))):
            cols.append(F.pow(F.greatest(z - F.lit(kn), F.lit(0.0)), 3))
            names.append(f"{c}_knot{j + 1}")
            pen.append(1.0)
    ok = F.col("_y").isNotNull()
    for c in xcols:
        ok = ok & F.col(c).isNotNull()
    allc = cols + [F.col("_y")]
    row = zdf.where(ok).agg(F.count(F.lit(1)).alias("_n"),
                            *[F.sum(allc[i] * allc[j]).alias(f"m_{i}_{j}") for i in range(len(allc))
                              for j in range(i, len(allc))]).first().asDict()
    K = len(cols)
    M = _matrix(row, K + 1)
    XX, Xy, yy = M[:K, :K], M[:K, K], M[K, K]
    n = int(row["_n"])
    P = np.diag(pen)
    scale = np.trace(XX) / K
    best = None
    for lam in lambdas:
        A = XX + lam * scale * P
        b = np.linalg.solve(A, Xy)
        ssr = float(yy - 2 * b @ Xy + b @ XX @ b)
        edf = float(np.trace(np.linalg.solve(A, XX)))
        gcv = n * ssr / (n - edf) ** 2 if n > edf else math.inf
        if best is None or gcv < best[0]:
            best = (gcv, lam, b, edf, ssr)
    gcv, lam, b, edf, ssr = best
    return {"terms": names, "coef": b.tolist(), "lambda": lam, "edf": edf, "gcv": gcv, "sigma2": ssr / max(n - edf, 1),
            "n": n, "columns": cols, "standardise": {c: (st[f"m_{c}"], st[f"s_{c}"]) for c in xcols}}
