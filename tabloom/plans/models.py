"""Model, validation, explanation and causal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models, validation
from ..session import table
from .catalog import query, rounded
from .series import MONTHLY_SQL, monthly_input


def _lineitem(spark, sf):
    return table(spark, sf, "lineitem")


def _one_row(spark, cols: dict):
    return spark.createDataFrame([tuple(float(v) for v in cols.values())], ", ".join(f"{k} double" for k in cols))


@query("lm_one_regressor", """
SELECT round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_slope(l_extendedprice, l_quantity), 6) AS slope,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def q_lm_one(spark, sf):
    fit = models.ols(_lineitem(spark, sf), "l_extendedprice", ["l_quantity"])
    return rounded(_one_row(spark, {"intercept": fit.coef[0], "slope": fit.coef[1], "r2": fit.r2}))


@query("lm_coefficients")
def q_lm_coefficients(spark, sf):
    fit = models.ols(_lineitem(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])
    return rounded(fit.table(spark))


@query("robust_se")
def q_robust_se(spark, sf):
    li = _lineitem(spark, sf)
    xs = ["l_quantity", "l_discount", "l_tax"]
    fit = models.ols(li, "l_extendedprice", xs)
    V = models.robust_se(li, fit, "l_extendedprice", {c: F.col(c) for c in xs}, "HC3")
    return rounded(fit.table(spark, V))


DID_SQL = """SELECT o_totalprice / 1000.0 AS y, CAST(n_regionkey = 0 AS INTEGER) AS treat,
       CAST(o_orderdate >= TIMESTAMP '1998-01-01' AS INTEGER) AS post
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def did_input(spark, sf, *extra):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select((F.col("o_totalprice") / 1000.0).alias("y"), (F.col("n_regionkey") == 0).cast("int").alias("treat"),
                    (F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).cast("int").alias("post"), *extra)


@query("did_2x2", f"""WITH d AS ({DID_SQL}),
c AS (SELECT treat, post, avg(y) AS m, count(*) AS n, coalesce(var_samp(y), 0) * (count(*) - 1) AS ss FROM d GROUP BY 1, 2),
a AS (SELECT sum(CASE WHEN treat = 1 AND post = 1 THEN m WHEN treat = 1 THEN -m WHEN post = 1 THEN -m ELSE m END) AS ate,
             sum(ss) / (sum(n) - 4) AS s2, sum(1.0 / n) AS inv, sum(n) AS n FROM c)
SELECT round(ate, 6) AS ate, round(sqrt(s2 * inv), 6) AS se, CAST(n AS BIGINT) AS n FROM a""")
def q_did(spark, sf):
    r = models.did_2x2(did_input(spark, sf), "y", "treat", "post")
    return rounded(spark.createDataFrame([(float(r["ate"]), float(r["se"]), int(r["n"]))], "ate double, se double, n long"))


IV_SQL = "SELECT l_extendedprice AS y, l_quantity AS x, l_quantity + l_linenumber AS z FROM lineitem"


@query("iv_2sls", f"""WITH d AS ({IV_SQL}),
b AS (SELECT covar_samp(z, y) / covar_samp(z, x) AS beta, avg(y) AS my, avg(x) AS mx, avg(z) AS mz,
             count(*) AS n, var_samp(z) AS vz, covar_samp(z, x) AS czx FROM d),
r AS (SELECT sum(power(y - (my - beta * mx) - beta * x, 2)) / (any_value(n) - 2) AS s2 FROM d, b)
SELECT round(beta, 6) AS slope, round(my - beta * mx, 6) AS intercept,
       round(sqrt(s2 * vz / (czx * czx) / (n - 1)), 6) AS slope_se FROM b, r""")
def q_iv(spark, sf):
    d = _lineitem(spark, sf).select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"),
                                    (F.col("l_quantity") + F.col("l_linenumber")).alias("z"))
    r = models.iv_2sls(d, "y", ["x"], ["z"])
    return rounded(spark.createDataFrame([(r["coef"][1], r["coef"][0], r["se"][1])],
                                         "slope double, intercept double, slope_se double"))


# two instruments for one regressor: every diagnostic is a regression on one or two columns
IV2_SQL = """d AS (SELECT l_extendedprice AS y, l_quantity AS x, l_quantity + l_linenumber AS z1,
       l_quantity * 2 + l_tax * 100 AS z2 FROM lineitem),
m AS (SELECT *, avg(y) OVER () AS my, avg(x) OVER () AS mx, avg(z1) OVER () AS m1, avg(z2) OVER () AS m2 FROM d),
c AS (SELECT y - my AS y, x - mx AS x, z1 - m1 AS z1, z2 - m2 AS z2 FROM m),
s AS (SELECT sum(z1*z1) AS s11, sum(z1*z2) AS s12, sum(z2*z2) AS s22, sum(z1*x) AS s1x, sum(z2*x) AS s2x, count(*) AS n FROM c),
p AS (SELECT (s22*s1x - s12*s2x) / (s11*s22 - s12*s12) AS p1, (s11*s2x - s12*s1x) / (s11*s22 - s12*s12) AS p2, s11, s12, s22, n FROM s),
f AS (SELECT y, x, z1, z2, p1*z1 + p2*z2 AS xh, x - p1*z1 - p2*z2 AS v FROM c, p),
b AS (SELECT sum(xh*y) / sum(xh*xh) AS beta, (sum(xh*xh) / 2) / (sum(v*v) / (count(*) - 3)) AS weak,
             sum(x*y) / sum(x*x) AS ols, sum(x*v) / sum(x*x) AS vx FROM f),
r AS (SELECT y - ols*x AS ry, v - vx*x AS rv, y - beta*x AS u, z1, z2 FROM f, b),
t AS (SELECT sum(ry*rv) AS g, sum(rv*rv) AS h, sum(ry*ry) AS q, sum(u*u) AS uu, sum(z1*u) AS u1, sum(z2*u) AS u2, count(*) AS n FROM r)"""


@query("iv_diagnostics", f"""WITH {IV2_SQL}
SELECT 'weak_x' AS test, round(weak, 2) AS statistic, CAST(2 AS BIGINT) AS df1, n - 3 AS df2 FROM b, t
UNION ALL SELECT 'wu_hausman', round((g*g/h) / ((q - g*g/h) / (n - 3)), 2), 1, n - 3 FROM t
UNION ALL SELECT 'sargan', round(t.n * ((u1*u1*s22 - 2*u1*u2*s12 + u2*u2*s11) / (s11*s22 - s12*s12)) / uu, 2), 1, NULL FROM t, p""")
def q_iv_diagnostics(spark, sf):
    d = _lineitem(spark, sf).select(F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("x"),
                                    (F.col("l_quantity") + F.col("l_linenumber")).alias("z1"),
                                    (F.col("l_quantity") * 2 + F.col("l_tax") * 100).alias("z2"))
    tests = models.iv_2sls(d, "y", ["x"], ["z1", "z2"])["diagnostics"]
    return rounded(spark.createDataFrame([(k, *t[:3]) for k, t in tests.items()],
                                         "test string, statistic double, df1 long, df2 long"), 2)


def _glm_table(spark, m, terms):
    s = m.summary
    rows = list(zip(["(Intercept)", *terms], [m.intercept, *m.coefficients.toArray().tolist()],
                    [s.coefficientStandardErrors[-1], *s.coefficientStandardErrors[:-1]]))
    return spark.createDataFrame([(t, float(b), float(e)) for t, b, e in rows], "term string, estimate double, std_error double")


@query("logit")
def q_logit(spark, sf):
    li = _lineitem(spark, sf).withColumn("is_r", (F.col("l_returnflag") == "R").cast("double"))
    m, _ = models.fit_model(li, "logit", "is_r", ["l_quantity", "l_discount"])
    return rounded(_glm_table(spark, m, ["l_quantity", "l_discount"]))


@query("poisson")
def q_poisson(spark, sf):
    li = _lineitem(spark, sf).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"),
                                                       (F.sum("l_extendedprice") / 1e5).alias("value"))
    m, _ = models.fit_model(li, "poisson", "n_lines", ["value"])
    return rounded(_glm_table(spark, m, ["value"]))


@query("betareg")
def q_betareg(spark, sf):
    """Mean and precision of discounts as shares of the greatest one, with their standard errors."""
    from ..operators import likelihood
    li = _lineitem(spark, sf).withColumn("share", F.least(F.greatest(F.col("l_discount"), F.lit(0.001)), F.lit(0.999)))
    r = likelihood.beta_fit(li, "share", ["l_quantity", "l_tax"])
    rows = [(t, float(b), float(s)) for t, b, s in zip(r["terms"], r["coef"], r["se"])] + [("(phi)", r["phi"], r["phi_se"])]
    return rounded(spark.createDataFrame(rows, "term string, estimate double, std_error double"))


def _holdout_metrics(spark, sf, model_id, params):
    from ..operators import metrics
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    sp = validation.holdout_split(li, "idx", 0.8)
    feats = ["l_quantity", "l_discount", "l_tax"]
    m, asm = models.fit_model(sp.where(F.col("split") == "train"), model_id, "l_extendedprice", feats, params)
    pred = models.score(m, asm, sp.where(F.col("split") == "test"))
    return metrics.regression_metrics(pred, "l_extendedprice", "prediction")


@query("ranger_reg")
def q_ranger(spark, sf):
    return _holdout_metrics(spark, sf, "ranger_reg", {"num_trees": 50, "max_depth": 8})


@query("xgb_reg")
def q_xgb(spark, sf):
    return _holdout_metrics(spark, sf, "xgb_reg", {"nrounds": 30, "max_depth": 4})


@query("glmnet_reg")
def q_glmnet(spark, sf):
    """Lasso of 100 penalties, the penalty chosen by five folds of the training rows, at the registry's defaults."""
    from ..operators import glmnet, metrics
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    sp = validation.holdout_split(li, "idx", 0.8)
    fit = glmnet.elastic_net(sp.where(F.col("split") == "train"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], key="idx")
    return metrics.regression_metrics(fit.score(sp.where(F.col("split") == "test")), "l_extendedprice", "prediction")


# one predictor: every fit of the path is a soft threshold
_GLMNET_MOMENTS = """count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, corr(x, y) AS r"""
_GLMNET_FIT = "sign(r) * greatest(abs(r) - lam * 0.5 / sy, 0) / (1 + lam * 0.5 / sy) * sy / sx"


@query("glmnet_path", f"""WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, (l_orderkey + l_linenumber) % 5 AS fold FROM lineitem),
a AS (SELECT {_GLMNET_MOMENTS} FROM d),
l AS (SELECT i + 1 AS step, abs(r) / 0.5 * sy * exp(i * ln(1e-4) / 99) AS lam FROM a, (SELECT unnest(range(100)) AS i)),
t AS (SELECT f.fold, {_GLMNET_MOMENTS} FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold <> f.fold GROUP BY f.fold),
h AS (SELECT fold, count(*) AS nf, {_GLMNET_MOMENTS.replace("count(*) AS n, ", "").replace("AS mx", "AS hx").replace("AS my", "AS hy").replace("AS sx", "AS hsx").replace("AS sy", "AS hsy").replace("AS r", "AS hr")} FROM d GROUP BY fold),
b AS (SELECT step, lam, t.*, {_GLMNET_FIT} AS b FROM t, l),
e AS (SELECT step, nf, power(hy - my - b * (hx - mx), 2) + hsy*hsy - 2*b*hr*hsx*hsy + b*b*hsx*hsx AS mse FROM b JOIN h USING (fold)),
m AS (SELECT step, sum(nf * mse) / sum(nf) AS cv_mean FROM e GROUP BY step),
s AS (SELECT step, any_value(cv_mean) AS cv_mean, sqrt(sum(nf * power(mse - cv_mean, 2)) / sum(nf) / 4) AS cv_sd FROM e JOIN m USING (step) GROUP BY step)
SELECT CAST(step AS INTEGER) AS step, round(lam, 4) AS lambda, round(cv_mean, 0) AS cv_mean, round(cv_sd, 0) AS cv_sd,
       round({_GLMNET_FIT}, 4) + 0.0 AS coef FROM s JOIN l USING (step), a""")
def q_glmnet_path(spark, sf):
    """The whole path at alpha 0.5 with the cross-validated error of every penalty."""
    from ..operators import glmnet
    d = _lineitem(spark, sf).select("l_quantity", "l_extendedprice", ((F.col("l_orderkey") + F.col("l_linenumber")) % 5).alias("fold"))
    fit = glmnet.elastic_net(d, "l_extendedprice", ["l_quantity"], alpha=0.5, fold_col="fold")
    coef = spark.createDataFrame([(i + 1, float(b[0])) for i, b in enumerate(fit.coef)], "step int, coef double")
    return fit.table(spark).join(coef, "step").select(
        "step", F.round("lambda", 4).alias("lambda"), F.round("cv_mean", 0).alias("cv_mean"), F.round("cv_sd", 0).alias("cv_sd"),
        F.round("coef", 4).alias("coef"))


@query("ranger_cls")
def q_ranger_cls(spark, sf):
    from ..operators import metrics
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    li = li.withColumn("is_r", (F.col("l_returnflag") == "R").cast("double"))
    sp = validation.holdout_split(li, "idx", 0.8)
    feats = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    m, asm = models.fit_model(sp.where(F.col("split") == "train"), "ranger_cls", "is_r", feats,
                              {"num_trees": 30, "max_depth": 6})
    pred = models.score(m, asm, sp.where(F.col("split") == "test"))
    return metrics.classification_metrics(pred, "is_r", "prediction")


@query("holdout_split")
def q_holdout(spark, sf):
    o = table(spark, sf, "orders")
    return validation.holdout_split(o, "o_orderkey", 0.8).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("split_disjoint")
def q_split_disjoint(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    sp = validation.holdout_split(o, "o_orderkey", 0.8)
    train = sp.where(F.col("split") == "train")
    test = o.join(train, "o_orderkey", "left_anti")
    return test.agg(F.count(F.lit(1)).alias("n_test"))


@query("kfold_cv")
def q_kfold(spark, sf):
    o = table(spark, sf, "orders")
    return validation.kfold_ids(o, "o_orderkey", 5, 2).groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"))


def _roc_sql(initial=24, h=6):
    lags = " UNION ALL ".join(
        f"""SELECT series_id, {k} AS horizon, y AS actual, lag(cn, {k}) OVER w AS origin_n, lag(y, {k}) OVER w AS yt,
               lag(cs, {k}) OVER w AS st, y1 FROM r WINDOW w AS (PARTITION BY series_id ORDER BY month)"""
        for k in range(1, h + 1))
    return f"""WITH s AS ({MONTHLY_SQL}),
r AS (SELECT series_id, month, y, sum(y) OVER (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS cs,
             count(*) OVER (PARTITION BY series_id ORDER BY month ROWS UNBOUNDED PRECEDING) AS cn,
             first_value(y) OVER (PARTITION BY series_id ORDER BY month) AS y1 FROM s),
l AS ({lags}),
e AS (SELECT horizon, 'naive' AS method, actual - yt AS err FROM l WHERE origin_n >= {initial}
      UNION ALL SELECT horizon, 'mean', actual - st / origin_n FROM l WHERE origin_n >= {initial}
      UNION ALL SELECT horizon, 'drift', actual - (yt + horizon * (yt - y1) / (origin_n - 1)) FROM l WHERE origin_n >= {initial})
SELECT method, CAST(horizon AS INTEGER) AS horizon, count(*) AS n, round(sqrt(avg(err * err)), 2) AS rmse,
       round(avg(abs(err)), 2) AS mae FROM e GROUP BY 1, 2"""


@query("rolling_origin_cv", _roc_sql())
def q_rolling_origin(spark, sf):
    return rounded(validation.rolling_origin_cv(monthly_input(spark, sf), ["series_id"], "month", "y", 24, 6), 2)


@query("pearson_importance", """
SELECT 'l_quantity' AS feature, round(abs(corr(l_quantity, l_extendedprice)), 6) AS importance FROM lineitem
UNION ALL SELECT 'l_discount', round(abs(corr(l_discount, l_extendedprice)), 6) FROM lineitem
UNION ALL SELECT 'l_tax', round(abs(corr(l_tax, l_extendedprice)), 6) FROM lineitem""")
def q_pearson_importance(spark, sf):
    return rounded(validation.pearson_importance(_lineitem(spark, sf), "l_extendedprice",
                                                 ["l_quantity", "l_discount", "l_tax"]))


def _lm_predict_fn(spark, sf, xs):
    fit = models.ols(_lineitem(spark, sf), "l_extendedprice", xs)
    return lambda d: d.withColumn("prediction", fit.predict({c: F.col(c) for c in xs}))


@query("permutation_importance")
def q_permutation_importance(spark, sf):
    xs = ["l_quantity", "l_discount", "l_tax"]
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    li = li.select("idx", "l_extendedprice", *xs)       # what the model reads
    return rounded(validation.permutation_importance(li, _lm_predict_fn(spark, sf, xs), "l_extendedprice", xs,
                                                     "idx", 5))


def _ols3_sql(a: str, b: str, c: str, y: str, source: str) -> str:
    """One row (b0, b1, b2, b3): least squares of y on three regressors, the covariance
    matrix inverted by cofactors."""
    cov = ", ".join(f"covar_pop({p}, {q}) AS s{i}{j}" for i, p in enumerate((a, b, c), 1)
                    for j, q in enumerate((a, b, c, y), 1) if j >= i)
    det = "s11*(s22*s33-s23*s23) - s12*(s12*s33-s23*s13) + s13*(s12*s23-s22*s13)"
    return f"""m AS (SELECT {cov}, avg({a}) AS ma, avg({b}) AS mb, avg({c}) AS mc, avg({y}) AS my FROM {source}),
g AS (SELECT *, {det} AS det FROM m),
k AS (SELECT ma, mb, mc, my,
  ((s22*s33-s23*s23)*s14 - (s12*s33-s13*s23)*s24 + (s12*s23-s13*s22)*s34)/det AS b1,
  (-(s12*s33-s13*s23)*s14 + (s11*s33-s13*s13)*s24 - (s11*s23-s12*s13)*s34)/det AS b2,
  ((s12*s23-s13*s22)*s14 - (s11*s23-s12*s13)*s24 + (s11*s22-s12*s12)*s34)/det AS b3 FROM g),
beta AS (SELECT my - b1*ma - b2*mb - b3*mc AS b0, b1, b2, b3 FROM k)"""


LM3_SQL = "WITH " + _ols3_sql("l_quantity", "l_discount", "l_tax", "l_extendedprice", "lineitem")


@query("partial_dependence", LM3_SQL + """,
e AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, avg(l_discount) AS d, avg(l_tax) AS t FROM lineitem),
steps AS (SELECT unnest(range(25)) AS i)
SELECT round(lo + (hi - lo) * i / 24, 6) AS value,
       round(b0 + b1 * (lo + (hi - lo) * i / 24) + b2 * d + b3 * t, 4) AS mean_prediction FROM beta, e, steps""")
def q_partial_dependence(spark, sf):
    xs = ["l_quantity", "l_discount", "l_tax"]
    pd = validation.partial_dependence(_lineitem(spark, sf), _lm_predict_fn(spark, sf, xs), "l_quantity", 25)
    return pd.select(F.round("value", 6).alias("value"), F.round("mean_prediction", 4).alias("mean_prediction"))


@query("batch_score", LM3_SQL + """
SELECT l_orderkey, l_linenumber, round(b0 + b1 * l_quantity + b2 * l_discount + b3 * l_tax, 4) AS prediction FROM lineitem, beta""")
def q_batch_score(spark, sf):
    xs = ["l_quantity", "l_discount", "l_tax"]
    new = _lineitem(spark, sf).select("l_orderkey", "l_linenumber", *xs)
    return rounded(_lm_predict_fn(spark, sf, xs)(new).select("l_orderkey", "l_linenumber", "prediction"), 4)


@query("align_scoring_columns", """
SELECT l_quantity, 0.0 AS l_weight_missing, l_tax FROM lineitem""")
def q_align_scoring(spark, sf):
    new = _lineitem(spark, sf).select("l_quantity", "l_tax", "l_discount")
    return models.align_scoring_columns(new, ["l_quantity", "l_weight_missing", "l_tax"])


@query("ipw")
def q_ipw(spark, sf):
    d = did_input(spark, sf, "c_acctbal")        # known before the treatment
    m, asm = models.fit_model(d, "logit", "treat", ["c_acctbal", "post"])
    ps = models.score(m, asm, d).withColumnRenamed("prediction", "ps")
    return rounded(validation.ipw_estimate(ps, "y", "treat", "ps", "ATE").unionByName(
        validation.ipw_estimate(ps, "y", "treat", "ps", "ATT")))


@query("top_k_importance", """
SELECT feature, importance FROM (
  SELECT 'l_quantity' AS feature, round(abs(corr(l_quantity, l_extendedprice)), 6) AS importance FROM lineitem
  UNION ALL SELECT 'l_discount', round(abs(corr(l_discount, l_extendedprice)), 6) FROM lineitem
  UNION ALL SELECT 'l_tax', round(abs(corr(l_tax, l_extendedprice)), 6) FROM lineitem
  UNION ALL SELECT 'l_linenumber', round(abs(corr(l_linenumber, l_extendedprice)), 6) FROM lineitem)
ORDER BY importance DESC LIMIT 25""")
def q_top_k_importance(spark, sf):
    imp = validation.pearson_importance(_lineitem(spark, sf), "l_extendedprice",
                                        ["l_quantity", "l_discount", "l_tax", "l_linenumber"])
    return rounded(imp).orderBy(F.desc("importance")).limit(25)     # as many as a report shows


@query("qq_points")
def q_qq_points(spark, sf):
    from ..operators import metrics
    from .evaluate import preds
    r = preds(spark, sf).withColumn("residual", F.col("actual") - F.col("predicted"))
    return rounded(metrics.qq_points(r, "residual", "idx"))


@query("bootstrap_refit")
def q_bootstrap_refit(spark, sf):
    from ..operators import metrics
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(metrics.bootstrap_refit_lm(li, "l_extendedprice", ["l_quantity", "l_discount"], "idx", 20))


@query("negbin")
def q_negbin(spark, sf):
    """Orders of every customer, none included: more dispersed than Poisson counts."""
    from ..operators import likelihood
    n = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    li = table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.coalesce("n_orders", F.lit(0)).alias("n_orders"), (F.col("c_acctbal") / 1e4).alias("balance"))
    r = likelihood.negbin_fit(li, "n_orders", ["balance"])
    rows = [(t, float(b), float(s), float(r["theta"]), float(r["theta_se"])) for t, b, s in zip(r["terms"], r["coef"], r["se"])]
    return rounded(spark.createDataFrame(rows, "term string, estimate double, std_error double, theta double, theta_se double"))


@query("builtin_importance")
def q_builtin_importance(spark, sf):
    feats = ["l_quantity", "l_discount", "l_tax"]
    m, _ = models.fit_model(_lineitem(spark, sf), "ranger_reg", "l_extendedprice", feats,
                            {"num_trees": 20, "max_depth": 5})
    return rounded(spark.createDataFrame(models.feature_importance(m, feats), "feature string, importance double"))


@query("model_presets", """
SELECT model, preset, name, CAST(value AS DOUBLE) AS value, n_rows, n_complete FROM (VALUES ('xgb_reg', 'aggressive', 'nrounds', 1500.0), ('xgb_reg', 'aggressive', 'eta', 0.05),
  ('xgb_reg', 'aggressive', 'max_depth', 10.0), ('xgb_reg', 'aggressive', 'subsample', 1.0),
  ('xgb_reg', 'aggressive', 'colsample_bytree', 1.0), ('ranger_cls', 'default', 'num_trees', 500.0),
  ('ranger_cls', 'default', 'min_node_size', 1.0), ('ranger_cls', 'default', 'sample_fraction', 1.0)) p(model, preset, name, value)
CROSS JOIN (SELECT count(*) AS n_rows, count_if(l_discount IS NOT NULL AND l_quantity IS NOT NULL) AS n_complete FROM lineitem)
""")
def q_model_presets(spark, sf):
    """Preset parameters beside the rows that a fit on lineitem would train on."""
    li = _lineitem(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(
        F.col("l_discount").isNotNull() & F.col("l_quantity").isNotNull()).alias("n_complete"))
    rows = [(m, k, n, float(v)) for m, k in (("xgb_reg", "aggressive"), ("ranger_cls", "default"))
            for n, v in models.preset(m, k).items()]
    out = spark.createDataFrame(rows, "model string, preset string, name string, value double")
    return out.join(F.broadcast(li))


@query("train_run")
def q_train_run(spark, sf):
    """split -> fit -> predict -> metrics -> append run and predictions to the
    registry (shared folder) -> read the stored run back."""
    import json
    import uuid
    from ..operators import metrics, registry
    root = registry.registry_path(spark) + f"/train_{uuid.uuid4().hex}"
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    sp = validation.holdout_split(li, "idx", 0.8)
    feats = ["l_quantity", "l_discount", "l_tax"]
    m, asm = models.fit_model(sp.where(F.col("split") == "train"), "lm", "l_extendedprice", feats)
    pred = models.score(m, asm, sp.where(F.col("split") == "test"))
    met = metrics.regression_metrics(pred, "l_extendedprice", "prediction").first().asDict()
    run = spark.createDataFrame([(1, 1, "lm", "regression", json.dumps({"features": feats}),
                                  json.dumps({k: met[k] for k in ("rmse", "mae", "mape", "r2")}), None, None, "ok", "")],
                                "id long, dataset_id long, model_id string, task_type string, params_json string, "
                                "metrics_json string, horizon int, duration_sec double, status string, notes string")
    registry.append_rows(run, root, "runs")
    registry.append_rows(pred.select(F.lit(1).cast("long").alias("run_id"), "idx",
                                     F.col("l_extendedprice").alias("actual"), F.col("prediction").alias("predicted")),
                         root, "predictions")
    runs = registry.read_table(spark, root, "runs")
    n_pred = registry.read_table(spark, root, "predictions").groupBy("run_id").agg(F.count(F.lit(1)).alias("n_predictions"))
    return runs.join(n_pred, runs.id == n_pred.run_id).select("id", "model_id", "metrics_json", "n_predictions")


def _cls_holdout(spark, sf, model_id, params, multiclass=False):
    from ..operators import metrics
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    if multiclass:
        li = li.withColumn("label_y", F.when(F.col("l_returnflag") == "A", 0.0).when(F.col("l_returnflag") == "N", 1.0)
                           .otherwise(2.0))
    else:
        li = li.withColumn("label_y", (F.col("l_returnflag") == "R").cast("double"))
    sp = validation.holdout_split(li, "idx", 0.8)
    feats = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    p = dict(params)
    if model_id == "mlp_cls":
        p.update({"n_features": len(feats), "n_classes": 3 if multiclass else 2})
    m, asm = models.fit_model(sp.where(F.col("split") == "train"), model_id, "label_y", feats, p)
    pred = models.score(m, asm, sp.where(F.col("split") == "test"))
    return metrics.classification_metrics(pred, "label_y", "prediction")


@query("glmnet_cls")
def q_glmnet_cls(spark, sf):
    """Logistic lasso of 100 penalties, chosen by five folds, at the registry's defaults."""
    from ..operators import glmnet, metrics
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    sp = validation.holdout_split(li.withColumn("label_y", (F.col("l_returnflag") == "R").cast("double")), "idx", 0.8)
    fit = glmnet.elastic_net(sp.where(F.col("split") == "train"), "label_y", ["l_quantity", "l_discount", "l_tax", "l_extendedprice"],
                             "binomial", key="idx")
    return metrics.classification_metrics(fit.score(sp.where(F.col("split") == "test")), "label_y", "prediction")


@query("xgb_cls")
def q_xgb_cls(spark, sf):
    return _cls_holdout(spark, sf, "xgb_cls", {"nrounds": 20, "max_depth": 4})


@query("lightgbm_cls")
def q_lightgbm_cls(spark, sf):
    """300 rounds of trees of 31 leaves and any depth: the registry's defaults."""
    return _cls_holdout(spark, sf, "lightgbm_cls", {})


@query("mlp_cls")
def q_mlp_cls(spark, sf):
    return _cls_holdout(spark, sf, "mlp_cls", {"hidden_units": "8,4", "epochs": 20}, multiclass=True)


@query("lightgbm_reg")
def q_lightgbm_reg(spark, sf):
    return _holdout_metrics(spark, sf, "lightgbm_reg", {"num_iterations": 20, "max_depth": 4})


@query("catboost_reg")
def q_catboost_reg(spark, sf):
    """Categorical levels target-encoded (smoothed, fitted on the training
    split) and fed to the boosted trees."""
    from ..operators import metrics, recipe
    from ..operators.recipe import step
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    sp = validation.holdout_split(li, "idx", 0.8)
    train = sp.where(F.col("split") == "train")
    enc, _ = recipe.apply_recipe(sp, [step("target_encode", ["l_returnflag", "l_linestatus"], smoothing=10)],
                                 target="l_extendedprice", fit_on=train)
    feats = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    m, asm = models.fit_model(enc.where(F.col("split") == "train"), "catboost_reg", "l_extendedprice", feats,
                              {"iterations": 20, "max_depth": 4})
    pred = models.score(m, asm, enc.where(F.col("split") == "test"))
    return metrics.regression_metrics(pred, "l_extendedprice", "prediction")


@query("gam")
def q_gam(spark, sf):
    li = _lineitem(spark, sf)
    fit = models.gam_fit(li, "l_extendedprice", ["l_quantity", "l_discount"], k=8)
    rows = [(t, float(b)) for t, b in zip(fit["terms"], fit["coef"])]
    return rounded(spark.createDataFrame(rows, "term string, estimate double"))


@query("kfold_lm_cv")
def q_kfold_lm_cv(spark, sf):
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(validation.kfold_lm_cv(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "idx", 5))


CV_FOLDS = {"fold_1": "(l_orderkey * 10 + l_linenumber) % 5", "fold_2": "(l_orderkey + l_linenumber * 3) % 5"}
_CV_SQL = " UNION ALL ".join(f"""
SELECT '{name}' AS repeat, fold, regr_slope(t.y, t.x) AS b, regr_intercept(t.y, t.x) AS a, count(*) AS n_train
FROM (SELECT DISTINCT {expr} AS fold FROM lineitem) f
JOIN (SELECT {expr} AS g, l_quantity AS x, l_extendedprice AS y FROM lineitem) t ON t.g <> f.fold GROUP BY fold""" for name, expr in CV_FOLDS.items())
_CV_TEST = " UNION ALL ".join(f"SELECT '{name}' AS repeat, {expr} AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem"
                              for name, expr in CV_FOLDS.items())


@query("cross_validate_lm", f"""WITH m AS ({_CV_SQL}), t AS ({_CV_TEST}),
e AS (SELECT repeat, fold, y, n_train, y - a - b * x AS e FROM t JOIN m USING (repeat, fold)),
r AS (SELECT repeat, fold, any_value(n_train) AS n_train, count(*) AS n_test, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
             1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY 1, 2)
SELECT repeat, CAST(fold AS BIGINT) AS fold, n_train, n_test, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 4) AS r2 FROM r""")
def q_cross_validate_lm(spark, sf):
    """Two repeats of five folds given as columns; the linear model refitted on each."""
    li = _lineitem(spark, sf).withColumns({name: F.expr(expr) for name, expr in CV_FOLDS.items()})
    cv = validation.cross_validate(li, "lm", "l_extendedprice", ["l_quantity"], fold_cols=list(CV_FOLDS))
    return cv.select("repeat", "fold", "n_train", "n_test", "rmse", "mae", "r2")


@query("cross_validate_logit")
def q_cross_validate_logit(spark, sf):
    """Five hashed folds of a classifier."""
    li = _lineitem(spark, sf).withColumn("idx", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    li = li.withColumn("is_r", (F.col("l_returnflag") == "R").cast("double"))
    return rounded(validation.cross_validate(li, "logit", "is_r", ["l_quantity", "l_discount"], "idx", k=5, task="classification"))
