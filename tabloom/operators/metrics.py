"""Model metrics, confusion tables, Poisson bootstrap, residual diagnostics.

Every metric is an aggregate, so it runs per group (run, series, fold,
replicate) in one pass.  The bootstrap explodes a replicate id per row and
aggregates immediately; partial aggregation runs in the same stage, so the
shuffle carries replicates x partitions rows, never replicates x rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.stats import t_sf2
from .series import halo_blocks


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = (),
                       digits: int = 4) -> DataFrame:
    """rmse, mae, mape (% over actual != 0), r2 (NULL when SS_tot = 0) over complete pairs."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    x = df.where(a.isNotNull() & p.isNotNull() & ~F.isnan(a) & ~F.isnan(p))
    e = a - p
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("_mae"),
        F.avg(F.when(a != 0, F.abs(e / a))).alias("_mape"), F.sum(e * e).alias("_ssr"),
        (F.var_pop(a) * F.count(F.lit(1))).alias("_sst"))
    r2 = F.when(F.col("_sst") > 0, 1 - F.col("_ssr") / F.col("_sst"))
    return g.select(*keys, F.col("n").cast("long").alias("n"), F.round(F.sqrt("_mse"), digits).alias("rmse"),
                    F.round("_mae", digits).alias("mae"), F.round(F.col("_mape") * 100, digits).alias("mape"),
                    F.round(r2, digits).alias("r2"))


def classification_metrics(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = (),
                           digits: int = 4) -> DataFrame:
    """accuracy; for two actual levels also precision / recall / f1 with the
    positive class = the second level in sorted order."""
    a, p = F.col(actual).cast("string"), F.col(predicted).cast("string")
    levels = df.where(a.isNotNull()).groupBy(*keys).agg(
        F.count_distinct(a).alias("_k"), F.max(a).alias("_pos"))
    x = df.join(levels, list(keys)) if keys else ranks.attach_scalars(df, levels)
    pos = F.col("_pos")
    g = x.groupBy(*keys).agg(
        F.avg(F.when(a.isNotNull() & p.isNotNull(), (a == p).cast("double"))).alias("_acc"),
        F.first("_k").alias("_k"),
        F.count_if((a == pos) & (p == pos)).alias("_tp"), F.count_if((a != pos) & (p == pos)).alias("_fp"),
        F.count_if((a == pos) & (p != pos)).alias("_fn"))
    binary = F.col("_k") == 2
    prec = F.when(binary & (F.col("_tp") + F.col("_fp") > 0), F.col("_tp") / (F.col("_tp") + F.col("_fp")))
    rec = F.when(binary & (F.col("_tp") + F.col("_fn") > 0), F.col("_tp") / (F.col("_tp") + F.col("_fn")))
    f1 = F.when(prec.isNotNull() & rec.isNotNull() & (prec + rec > 0), 2 * prec * rec / (prec + rec))
    return g.select(*keys, F.round("_acc", digits).alias("accuracy"), F.round(prec, digits).alias("precision"),
                    F.round(rec, digits).alias("recall"), F.round(f1, digits).alias("f1"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    return (df.groupBy(*keys, F.col(actual).cast("string").alias("actual"),
                       F.col(predicted).cast("string").alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


# Poisson(1) cumulative probabilities P(X <= k), k = 0..11,
# from the formula exp(-1) * sum_{j<=k} 1/j!.
POISSON1_CDF = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(12)]


def poisson1_weight(*cols: Column) -> Column:
    """Deterministic Poisson(1) draw from a hash of the given columns."""
    u = (F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double")) / float(1 << 53)
    w = F.lit(len(POISSON1_CDF))
    for k in reversed(range(len(POISSON1_CDF))):
        w = F.when(u < POISSON1_CDF[k], F.lit(k)).otherwise(w)
    return w


def bootstrap_rmse(df: DataFrame, actual: str, predicted: str, row_id: str, keys: Sequence[str] = (),
                   reps: int = 200, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of RMSE: estimate, SE (sd over replicates), 2.5/97.5 %
    percentile interval (type 7), R, n.  n < 5 -> NULLs; < 10 finite -> no CI."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    x = df.where(a.isNotNull() & p.isNotNull()).select(*keys, F.col(row_id), ((a - p) * (a - p)).alias("_e2"))
    x = ranks.ensure_parallelism(x)
    rep = x.select(*keys, "_e2", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"), F.col(row_id))
    rep = rep.withColumn("_w", poisson1_weight(F.col(row_id), F.col("rep"), F.lit(seed)))
    per = rep.groupBy(*keys, "rep").agg((F.sum(F.col("_w") * F.col("_e2")) / F.sum("_w")).alias("v"))
    per = per.where(F.col("v").isNotNull() & ~F.isnan("v")).withColumn("v", F.sqrt("v"))
    est = x.groupBy(*keys).agg(F.sqrt(F.avg("_e2")).alias("estimate"), F.count(F.lit(1)).alias("n"))
    dist = per.groupBy(*keys).agg(F.stddev_samp("v").alias("se"), F.count(F.lit(1)).alias("R"),
                                  F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    out = est.join(dist, list(keys), "left") if keys else ranks.attach_scalars(est, dist)
    ok = (F.col("n") >= 5)
    ci = ok & (F.col("R") >= 10)
    return out.select(*keys, F.when(ok, F.col("estimate")).alias("estimate"), F.when(ci, F.col("se")).alias("se"),
                      F.when(ci, F.col("_q")[0]).alias("lo"), F.when(ci, F.col("_q")[1]).alias("hi"),
                      F.when(ok, F.col("R")).otherwise(F.lit(0)).cast("long").alias("R"), F.col("n").cast("long"))


def residual_stats(df: DataFrame, actual: str, predicted: str, order_cols: Sequence[str],
                   keys: Sequence[str] = ()) -> DataFrame:
    """bias, sd, lag-1 autocorrelation (in ``order_col`` order), corr(|resid|,
    predicted) and the t statistic of that correlation."""
    keys, order_cols = list(keys), list(order_cols)
    r = (F.col(actual) - F.col(predicted)).cast("double")
    x = df.select(*keys, *[c for c in order_cols if c not in keys], F.col(predicted).cast("double").alias("_p"),
                  r.alias("_r")).where(
        F.col("_r").isNotNull())
    m = x.groupBy(*keys).agg(F.avg("_r").alias("_m"))
    x = (ranks.attach_groups(x, m, keys) if keys else ranks.attach_scalars(x, m)).withColumn("_d", F.col("_r") - F.col("_m"))
    hb = halo_blocks(x, keys, order_cols, 1)
    w = Window.partitionBy(*keys, "_blk").orderBy(*order_cols)
    hb = hb.withColumn("_l1", F.lag("_d", 1).over(w)).where(~F.col("_halo"))
    g = hb.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("_r").alias("bias"), F.stddev_samp("_r").alias("sd"),
        (F.sum(F.col("_d") * F.col("_l1")) / F.sum(F.col("_d") * F.col("_d"))).alias("acf1"),
        F.corr(F.abs("_r"), F.col("_p")).alias("hetero_cor"))
    t = F.col("hetero_cor") * F.sqrt((F.col("n") - 2) / (1 - F.col("hetero_cor") * F.col("hetero_cor")))
    return g.select(*keys, F.col("n").cast("long"), "bias", "sd", "acf1", "hetero_cor", t.alias("hetero_t"))


def hetero_pvalue(t: float, n: int) -> float:
    return t_sf2(t, n - 2)


def residual_histogram(df: DataFrame, actual: str, predicted: str, bins: int = 30) -> DataFrame:
    from .profile import target_histogram
    r = df.select((F.col(actual) - F.col(predicted)).cast("double").alias("residual"))
    return target_histogram(r, "residual", bins)


def prediction_frame(df: DataFrame, idx: str, actual: str, predicted: str,
                     lower: str | None = None, upper: str | None = None) -> DataFrame:
    return df.select(F.col(idx).alias("idx"), F.col(actual).cast("double").alias("actual"),
                     F.col(predicted).cast("double").alias("predicted"),
                     (F.col(actual) - F.col(predicted)).cast("double").alias("residual"),
                     (F.col(lower) if lower else F.lit(None)).cast("double").alias("lower"),
                     (F.col(upper) if upper else F.lit(None)).cast("double").alias("upper"))


def qq_points(df: DataFrame, value: str, tie_col: str) -> DataFrame:
    """Normal Q-Q pairs: the i-th smallest value against qnorm(ppoints(n)[i]),
    ppoints a = 3/8 for n <= 10 else 1/2.  Positions come from the bucketed
    row index, the quantile from the JVM inverse-normal expression."""
    from ..functions.stats import inv_norm_cdf
    from .series import row_index
    x = df.where(F.col(value).isNotNull())
    n = x.count()
    a = 3.0 / 8 if n <= 10 else 0.5
    r = row_index(x.select(value, tie_col), value, tie_col)
    p = (F.col("_row") - a) / (n + 1 - 2 * a)
    return r.select(F.col("_row").alias("i"), F.col(value).cast("double").alias("sample"),
                    inv_norm_cdf(p).alias("theoretical"))


def bootstrap_refit_lm(df: DataFrame, y: str, xcols, key: str, reps: int = 20, seed: int = 42) -> DataFrame:
    """Re-fit a linear model on Poisson-weighted resamples (one grouped moment
    aggregate over the exploded replicate id) and score each replicate's RMSE
    on the full data; returns per-replicate coefficients and RMSE."""
    import numpy as np
    xs = [F.lit(1.0)] + [F.col(c).cast("double") for c in xcols]
    k = len(xs)
    rep = df.select(*[F.col(c) for c in [y, *xcols, key]]).withColumn(
        "_rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    rep = rep.withColumn("_pw", poisson1_weight(F.col(key), F.col("_rep"), F.lit(seed)).cast("double"))
    cols = xs + [F.col(y).cast("double")]
    aggs = [F.sum(F.col("_pw") * cols[i] * cols[j]).alias(f"m_{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    rows = rep.groupBy("_rep").agg(*aggs).collect()          # reps rows of (k+1)^2 sums
    coefs = []
    for r in rows:
        M = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i, k + 1):
                M[i, j] = M[j, i] = r[f"m_{i}_{j}"]
        coefs.append((int(r["_rep"]), np.linalg.lstsq(M[:k, :k], M[:k, k], rcond=None)[0]))
    spark = df.sparkSession
    bt = spark.createDataFrame([(rp, *map(float, b)) for rp, b in coefs],
                               "_rep int, " + ", ".join(f"_b{j} double" for j in range(k)))
    pred = F.lit(0.0)
    for j in range(k):
        pred = pred + xs[j] * F.col(f"_b{j}")
    # replicate coefficients: reps rows, broadcast; rows x reps scored with map-side combine
    sc = df.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).join(F.broadcast(bt), "_rep")
    err = sc.groupBy("_rep").agg(F.sqrt(F.avg(F.pow(F.col(y) - pred, 2))).alias("rmse"))
    return err.join(bt, "_rep").withColumnRenamed("_rep", "rep")


# weighted metric aggregates usable by the bootstrap (custom metrics plug in here)
def _w_rmse(a, p, w):
    return F.sqrt(F.sum(w * (a - p) * (a - p)) / F.sum(w))


def _w_mae(a, p, w):
    return F.sum(w * F.abs(a - p)) / F.sum(w)


def _w_mape(a, p, w):
    ok = a != 0
    return 100 * F.sum(F.when(ok, w * F.abs((a - p) / a))) / F.sum(F.when(ok, w))


METRICS = {"rmse": _w_rmse, "mae": _w_mae, "mape": _w_mape}


def bootstrap_metric(df: DataFrame, actual: str, predicted: str, row_id: str, metric="rmse",
                     keys: Sequence[str] = (), reps: int = 200, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of any weighted metric aggregate ``metric(a, p, w)``
    (a name from METRICS or a callable building a Column aggregate)."""
    fn = METRICS[metric] if isinstance(metric, str) else metric
    keys = list(keys)
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    x = df.where(a.isNotNull() & p.isNotNull()).select(*keys, F.col(row_id), a.alias("_a"), p.alias("_p"))
    x = ranks.ensure_parallelism(x)
    rep = x.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    rep = rep.withColumn("_w", poisson1_weight(F.col(row_id), F.col("rep"), F.lit(seed)).cast("double"))
    per = rep.groupBy(*keys, "rep").agg(fn(F.col("_a"), F.col("_p"), F.col("_w")).alias("v"))
    per = per.where(F.col("v").isNotNull() & ~F.isnan("v"))
    est = x.groupBy(*keys).agg(fn(F.col("_a"), F.col("_p"), F.lit(1.0)).alias("estimate"), F.count(F.lit(1)).alias("n"))
    dist = per.groupBy(*keys).agg(F.stddev_samp("v").alias("se"), F.count(F.lit(1)).alias("R"),
                                  F.percentile("v", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    out = est.join(dist, keys, "left") if keys else ranks.attach_scalars(est, dist)
    ok = F.col("n") >= 5
    ci = ok & (F.col("R") >= 10)
    return out.select(*keys, F.when(ok, F.col("estimate")).alias("estimate"), F.when(ci, F.col("se")).alias("se"),
                      F.when(ci, F.col("_q")[0]).alias("lo"), F.when(ci, F.col("_q")[1]).alias("hi"),
                      F.when(ok, F.col("R")).otherwise(F.lit(0)).cast("long").alias("R"), F.col("n").cast("long"))
