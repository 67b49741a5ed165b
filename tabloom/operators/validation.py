"""Splits, cross-validation folds, rolling-origin evaluation of forecasts,
explanation (importance, partial dependence) and propensity weighting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ranks
from .series import halo_blocks


def _unit(*cols) -> F.Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / float(1 << 53)


def holdout_split(df: DataFrame, key: str, train_pct: float, seed: int = 42) -> DataFrame:
    """Deterministic random split by a hash of the row key (no shuffle, no
    driver state); the test set is exactly the complement of the train set."""
    return df.withColumn("split", F.when(_unit(F.col(key), F.lit(seed)) < train_pct, "train").otherwise("test"))


def kfold_ids(df: DataFrame, key: str, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Fold id per row and repeat (hash based); rows x repeats."""
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return x.withColumn("fold", (F.floor(_unit(F.col(key), F.col("repeat"), F.lit(seed)) * k) + 1).cast("int"))


def cross_validate(df: DataFrame, model_id: str, target: str, features: Sequence[str], key: str | None = None, k: int = 5,
                   repeats: int = 1, params: dict | None = None, fold_cols: Sequence[str] | None = None,
                   task: str = "regression", parallelism: int = 4, seed: int = 42) -> DataFrame:
    """k-fold cross-validation of any registered model, repeated: (repeat, fold, n_train, n_test)
    and the metrics of the held-out fold.

    Folds come from ``fold_cols`` (one column a repeat) or a hash of ``key``.  The columns in
    use are written once to the checkpoint folder; every fit is a filter over that table, and
    ``parallelism`` of them run at a time.  One small row a fit reaches the driver."""
    from concurrent.futures import ThreadPoolExecutor
    from . import metrics, models
    spark = df.sparkSession
    if fold_cols:
        named = [(c, F.col(c).cast("long")) for c in fold_cols]
    elif key is None:
        raise ValueError("cross_validate needs a row key or fold columns")
    else:
        named = [(str(r), (F.floor(_unit(F.col(key), F.lit(r), F.lit(seed)) * k) + 1).cast("long")) for r in range(1, repeats + 1)]
    folds = [f"_fold{i}" for i in range(len(named))]
    columns = dict.fromkeys([*features, target])
    table = ranks.materialize(df.select(*[F.col(f"`{c}`") for c in columns], *[e.alias(f) for f, (_, e) in zip(folds, named)]))
    jobs = []
    for f, (name, _) in zip(folds, named):
        jobs += [(f, name, r[0]) for r in table.select(f).where(F.col(f).isNotNull()).distinct().orderBy(f).collect()]

    def run(job):
        f, name, held = job
        model, asm = models.fit_model(table.where(F.col(f) != held), model_id, target, features, params)
        test = models.score(model, asm, table.where((F.col(f) == held) & F.col(f"`{target}`").isNotNull()))
        test = test.where(F.col("prediction").isNotNull())
        if task != "regression" and model_id == "logit":      # its prediction is a probability
            test = test.withColumn("prediction", (F.col("prediction") > 0.5).cast("double"))
        measure = metrics.regression_metrics if task == "regression" else metrics.classification_metrics
        out = measure(test, target, "prediction").first().asDict()
        return {"repeat": name, "fold": int(held), "n_train": int(asm.rows_used), "n_test": test.count(),
                **{m: float(v) for m, v in out.items() if isinstance(v, (int, float)) and m not in ("n", "n_obs")}}
    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, jobs))
    if not rows:
        raise ValueError("cross_validate found no folds")
    measures = [c for c in rows[0] if c not in ("repeat", "fold", "n_train", "n_test")]
    return spark.createDataFrame([tuple(r.get(c) for c in ("repeat", "fold", "n_train", "n_test", *measures)) for r in rows],
                                 "repeat string, fold long, n_train long, n_test long, " + ", ".join(f"{c} double" for c in measures))


def running_totals(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], value: str) -> DataFrame:
    """Per-row running sum and count of ``value`` up to and including the row,
    computed per time block plus block offsets (no window over a whole series)."""
    keys, order_cols = list(keys), list(order_cols)
    x = halo_blocks(df, keys, order_cols, 0).drop("_halo")
    bt = x.groupBy(*keys, "_blk").agg(F.sum(value).alias("_bs"), F.count(F.lit(1)).alias("_bc"))
    w = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.select(*keys, "_blk", F.coalesce(F.sum("_bs").over(w), F.lit(0.0)).alias("_os"),
                   F.coalesce(F.sum("_bc").over(w), F.lit(0)).alias("_oc"))
    x = x.join(bt, [*keys, "_blk"])
    wi = Window.partitionBy(*keys, "_blk").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return (x.withColumn("cum_sum", F.col("_os") + F.sum(value).over(wi))
            .withColumn("cum_n", F.col("_oc") + F.count(F.lit(1)).over(wi))
            .drop("_blk", "_os", "_oc"))


def rolling_origin_cv(df: DataFrame, keys: Sequence[str], order_col: str, value: str,
                      initial: int = 50, h: int = 12) -> DataFrame:
    """Evaluate naive, mean and drift forecasts from every origin t >= initial
    at horizons 1..h.  Row u with origin t = u - k is scored by lagging the
    origin's state (value, running sum/count, first value) k rows, so each
    (origin, horizon) pair costs one lagged column, never a copy of history."""
    keys = list(keys)
    x = running_totals(df.select(*keys, order_col, value), keys, [order_col], value)
    first = df.groupBy(*keys).agg(F.min_by(value, order_col).alias("_first"))
    x = x.join(first, keys) if keys else ranks.attach_scalars(x, first)
    # the running totals feed three branches of the blocked window below:
    # materialise them once (shared checkpoint folder) instead of re-deriving
    x = ranks.materialize(x)
    x = halo_blocks(x, keys, [order_col], h)
    w = Window.partitionBy(*keys, "_blk").orderBy(order_col)
    for k in range(1, h + 1):
        x = (x.withColumn(f"_y{k}", F.lag(value, k).over(w)).withColumn(f"_s{k}", F.lag("cum_sum", k).over(w))
             .withColumn(f"_n{k}", F.lag("cum_n", k).over(w)))
    rows = []
    for k in range(1, h + 1):
        yt, st, nt = F.col(f"_y{k}"), F.col(f"_s{k}"), F.col(f"_n{k}")
        rows.append(F.struct(F.lit(k).alias("horizon"), nt.alias("origin_n"), yt.alias("naive"),
                             F.try_divide(st, nt).alias("mean"),
                             (yt + F.try_divide(k * (yt - F.col("_first")), nt - 1)).alias("drift")))
    y = x.select(*keys, "_halo", F.col(value).alias("actual"), F.inline(F.array(*rows)))
    y = y.where(~F.col("_halo") & F.col("origin_n").isNotNull() & (F.col("origin_n") >= initial))
    out = y.select(*keys, "horizon", F.inline(F.array(*[
        F.struct(F.lit(m).alias("method"), (F.col("actual") - F.col(m)).alias("err")) for m in ("naive", "mean", "drift")])))
    return out.groupBy("method", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.avg(F.abs("err")).alias("mae"))


def permutation_importance(df: DataFrame, predict_fn, target: str, features: Sequence[str], key: str,
                           repeats: int = 5, seed: int = 42) -> DataFrame:
    """RMSE increase when one feature is permuted.  Rows fall into random hash
    buckets per repeat; inside a bucket the feature's values are re-paired by
    two independent hash orders, so every group a task holds is one bucket.
    A repeat is one shuffle of the columns of ``df`` (select those in use before), which serves
    all features and is given back before the next repeat."""
    from ..session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    features = list(features)
    b = ranks.default_buckets(df)
    error = F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2)))
    base = predict_fn(df).agg(error).first()[0]
    orders = [(f"_a{i}", f"_b{i}") for i in range(len(features))]
    names, places = [f"_v{i}" for i in range(len(features))], [df.columns.index(f) for f in features]
    moved = T.StructType([*df.schema.fields, *[T.StructField(n, df.schema[f].dataType) for n, f in zip(names, features)]])
    width = len(df.columns)

    def pair(group):
        cols = [group.column(i) for i in range(width)]
        out = []
        for i, at in enumerate(places):
            own, other = (np.argsort(group.column(width + 1 + 2 * i + j).to_numpy(), kind="stable") for j in (0, 1))
            take = np.empty(len(own), np.int64)
            take[own] = other               # the row of the n-th own hash gets the value of the n-th other one
            out.append(cols[at].take(pa.array(take)))
        return pa.Table.from_arrays([*cols, *out], names=moved.names)

    rows = []
    for rep in range(1, repeats + 1):
        r = F.lit(rep)
        x = df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), r, F.lit(seed)), F.lit(b))).repartition("_bucket")
        x = x.select("*", *[F.xxhash64(F.col(key), r, F.lit(f), F.lit(j + 1)).alias(n)
                             for f, pairs in zip(features, orders) for j, n in enumerate(pairs)])
        paired = x.groupBy("_bucket").applyInArrow(pair, moved)
        cases = F.array(*[F.struct(F.lit(i).alias("_feature"), *[F.col(n if f == g else g).alias(g) for g in features])
                          for i, (f, n) in enumerate(zip(features, names))])
        kept = [c for c in df.columns if c not in features]
        err = predict_fn(paired.select(*kept, F.inline(cases))).groupBy("_feature").agg(error.alias("_e"))
        rows += [(features[e["_feature"]], None if e["_e"] is None or base is None else e["_e"] - base) for e in err.collect()]
        del x, paired, err
        ranks.release(spark)
    res = spark.createDataFrame(rows, "feature string, gain double").groupBy("feature").agg(F.avg("gain").alias("importance"))
    return res.orderBy(F.desc("importance"))


def pearson_importance(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Fallback importance |pearson(x, y)|, one aggregate."""
    w = df.agg(*[F.corr(F.col(f).cast("double"), F.col(target).cast("double")).alias(f) for f in features])
    return w.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.abs(F.col(f)).alias("importance"))
                                       for f in features])))


def partial_dependence(df: DataFrame, predict_fn, feature: str, grid_n: int = 25) -> DataFrame:
    """Mean prediction with ``feature`` set to each of grid_n equally spaced
    values between its min and max: the grid is a literal array exploded per
    row, then one grouped average."""
    mm = df.agg(F.min(feature).alias("a"), F.max(feature).alias("b")).first()
    a, b = float(mm["a"]), float(mm["b"])
    grid = [a + (b - a) * i / (grid_n - 1) for i in range(grid_n)] if grid_n > 1 else [a]
    x = df.withColumn("_g", F.explode(F.array(*[F.lit(v) for v in grid]))).withColumn(feature, F.col("_g"))
    return predict_fn(x).groupBy(F.col("_g").alias("value")).agg(F.avg("prediction").alias("mean_prediction"))


def ipw_estimate(df: DataFrame, y: str, treat: str, ps: str, estimand: str = "ATE") -> DataFrame:
    """Hajek IPW contrast given a propensity column."""
    t, p = F.col(treat).cast("double"), F.col(ps).cast("double")
    w = t / p + (1 - t) / (1 - p) if estimand == "ATE" else t + (1 - t) * p / (1 - p)
    yy = F.col(y).cast("double")
    x = df.select(w.alias("w"), t.alias("t"), yy.alias("y")).where(
        F.col("w").isNotNull() & ~F.isnan("w") & F.col("y").isNotNull())
    a = x.agg((F.sum(F.col("w") * F.col("t") * F.col("y")) / F.sum(F.col("w") * F.col("t"))
               - F.sum(F.col("w") * (1 - F.col("t")) * F.col("y")) / F.sum(F.col("w") * (1 - F.col("t")))).alias("estimate"),
              F.count(F.lit(1)).alias("n"))
    return a.select(F.lit(estimand).alias("estimand"), "estimate", F.col("n").cast("long"))


def kfold_lm_cv(df: DataFrame, y: str, xcols, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """k-fold cross-validated RMSE of a linear model without k refits over the
    data: cross moments per fold (one grouped aggregate); fold j trains on
    total - moments_j; each fold's rows are scored with its coefficients."""
    import numpy as np
    x = kfold_ids(df, key, k, 1, seed)
    cols = [F.lit(1.0)] + [F.col(c).cast("double") for c in xcols] + [F.col(y).cast("double")]
    m = len(cols)
    ok = F.col(y).isNotNull()
    for c in xcols:
        ok = ok & F.col(c).isNotNull()
    x = x.where(ok)
    rows = x.groupBy("fold").agg(*[F.sum(cols[i] * cols[j]).alias(f"m_{i}_{j}") for i in range(m)
                                   for j in range(i, m)]).collect()
    mats = {}
    for r in rows:
        M = np.zeros((m, m))
        for i in range(m):
            for j in range(i, m):
                M[i, j] = M[j, i] = r[f"m_{i}_{j}"]
        mats[int(r["fold"])] = M
    total = sum(mats.values())
    coef = []
    K = m - 1
    for f, M in mats.items():
        T = total - M
        coef.append((f, *map(float, np.linalg.lstsq(T[:K, :K], T[:K, K], rcond=None)[0])))
    spark = df.sparkSession
    bt = spark.createDataFrame(coef, "fold int, " + ", ".join(f"_b{j} double" for j in range(K)))
    pred = F.lit(0.0)
    for j in range(K):
        pred = pred + cols[j] * F.col(f"_b{j}")
    sc = x.join(F.broadcast(bt), "fold")   # k rows
    return sc.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"),
                                  F.sqrt(F.avg(F.pow(cols[K] - pred, 2))).alias("rmse"))
