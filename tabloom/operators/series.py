"""Ordered-series operators: lags, rolling means, supervised windows, ACF,
time-ordered split, and the closed-form baseline forecasts of many series.

Skew: one series may hold a large share of all rows, so a window must not
``partitionBy(series)`` alone.  ``halo_blocks`` cuts each series into
time blocks (bounds from a bounded sketch) and copies the exact last ``halo``
rows preceding each block into it.  A window over ``(series, block)`` then
sees every row it needs, and no task holds more than one block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ranks
from ..functions.stats import norm_ppf, t_ppf

Z975 = norm_ppf(0.975)
MIN_BLOCK_ROWS = 1000


def order_key(df: DataFrame, col: str) -> Column:
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")) if isinstance(dt, T.TimestampNTZType) else F.unix_micros(F.col(col))
    if isinstance(dt, T.DateType):
        return F.unix_date(F.col(col)).cast("long")
    return F.col(col).cast("double")


def halo_blocks(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], halo: int,
                buckets: int | None = None) -> DataFrame:
    """Add ``_blk`` (time block within the series) and ``_halo`` (True for copied
    preceding rows).  Series under MIN_BLOCK_ROWS rows stay one block."""
    keys, order_cols = list(keys), list(order_cols)
    # the input is read three times below (block bounds, rows, halo tails)
    df = ranks.materialize(df)
    b = buckets or ranks.default_buckets(df)
    o = order_key(df, order_cols[0]).cast("double")
    # equal-width time blocks between each series' exact first and last time:
    # exact aggregates, so every plan branch assigns the same block ids
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(o).alias("_lo"), F.max(o).alias("_hi"))
    nb = F.greatest(F.lit(1), F.least(F.lit(b), (F.col("_n") / F.lit(max(MIN_BLOCK_ROWS, 10 * halo))).cast("long")))
    stats = stats.select(*keys, "_lo", "_hi", nb.alias("_nb"))
    x = ranks.attach_groups(df, stats, keys) if keys else ranks.attach_scalars(df, stats)
    width = (F.col("_hi") - F.col("_lo")) / F.col("_nb")
    blk = F.when(width > 0, F.least(F.floor((o - F.col("_lo")) / width), F.col("_nb") - 1)).otherwise(F.lit(0))
    x = x.withColumn("_blk", blk.cast("int")).drop("_lo", "_hi")
    if halo <= 0:
        return x.withColumn("_halo", F.lit(False)).drop("_nb")
    desc = [F.col(c).desc() for c in order_cols]
    # the last `halo` rows of a block go to the blocks that need them: the next one, and one
    # after it only while the blocks between hold fewer than `halo` rows
    tails = ranks.top_k_per_group(x, [*keys, "_blk"], desc, halo).drop("_rank")
    order = Window.partitionBy(*keys).orderBy("_blk")                 # one row a block
    per = x.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_cum", F.sum("_c").over(order)).withColumn("_next", F.lead("_blk").over(order))
    near = Window.partitionBy(*keys).orderBy("_cum").rangeBetween(0, halo - 1)
    per = per.select(*keys, "_blk", F.collect_list("_next").over(near).alias("_to"))
    cand = tails.join(per, [*keys, "_blk"]).withColumn("_to", F.explode("_to"))
    w = Window.partitionBy(*keys, "_to").orderBy(*desc)
    cand = (cand.withColumn("_hrow", F.row_number().over(w)).where(F.col("_hrow") <= halo)
            .drop("_hrow", "_blk").withColumnRenamed("_to", "_blk"))
    return (x.withColumn("_halo", F.lit(False)).unionByName(cand.withColumn("_halo", F.lit(True)))
            .drop("_nb"))


def _window(keys, order_cols):
    return Window.partitionBy(*keys, "_blk").orderBy(*[F.col(c) for c in order_cols])


def lag_features(df: DataFrame, value: str, order_cols: Sequence[str], keys: Sequence[str] = (),
                 lags: Sequence[int] = (1, 2, 3), prefix: str = "lag_") -> DataFrame:
    x = halo_blocks(df, keys, order_cols, max(lags))
    w = _window(keys, order_cols)
    for k in lags:
        x = x.withColumn(f"{prefix}{k}", F.lag(F.col(value), k).over(w))
    return x.where(~F.col("_halo")).drop("_blk", "_halo")


def lags_many(df: DataFrame, spec: dict[str, Sequence[int]], order_cols: Sequence[str], keys: Sequence[str] = (),
              name=lambda col, k: f"{col}__l{k}") -> DataFrame:
    """Lags of several columns from ONE blocked window pass."""
    h = max(max(v) for v in spec.values())
    x = halo_blocks(df, keys, order_cols, h)
    w = _window(keys, order_cols)
    x = x.select("*", *[F.lag(F.col(c), k).over(w).alias(name(c, k)) for c, ks in spec.items() for k in ks])
    return x.where(~F.col("_halo")).drop("_blk", "_halo")


def rolling_mean(df: DataFrame, value: str, order_cols: Sequence[str], keys: Sequence[str] = (),
                 k: int = 7, out: str | None = None) -> DataFrame:
    """Trailing mean of the last k rows (NULLs inside skipped); NULL for the
    first k-1 rows of a series."""
    out = out or f"rollmean_{k}"
    x = halo_blocks(df, keys, order_cols, k - 1)
    w = _window(keys, order_cols).rowsBetween(-(k - 1), 0)
    x = x.withColumn(out, F.when(F.count(F.lit(1)).over(w) >= k, F.avg(F.col(value)).over(w)))
    return x.where(~F.col("_halo")).drop("_blk", "_halo")


def supervised_windows(df: DataFrame, features: Sequence[str], target: str, order_cols: Sequence[str],
                       timesteps: int, keys: Sequence[str] = ()) -> DataFrame:
    """Sliding windows: X = the previous ``timesteps`` rows of ``features``
    (array<array<double>>), y = ``target`` of the current row; N = n - timesteps."""
    if not isinstance(timesteps, int) or timesteps < 1:
        raise ValueError("supervised_windows: `timesteps` must be a positive integer")
    x = halo_blocks(df, keys, order_cols, timesteps)
    w = _window(keys, order_cols).rowsBetween(-timesteps, -1)
    row = F.array(*[F.col(c).cast("double") for c in features])
    x = x.withColumn("X", F.collect_list(row).over(w))
    x = x.where(~F.col("_halo") & (F.size("X") == timesteps))
    return x.select(*keys, *order_cols, "X", F.col(target).cast("double").alias("y"))


def acf(df: DataFrame, value: str, order_cols: Sequence[str], keys: Sequence[str] = (),
        max_lag: int = 20) -> DataFrame:
    """Autocorrelation at lags 1..min(max_lag, n-1) per series (mean-centred,
    divided by the total sum of squares) with the +-1.96/sqrt(n) bound."""
    v = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    m = v.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count(F.lit(1)).alias("_n"))
    x = (v.join(m, keys) if keys else ranks.attach_scalars(v, m)).withColumn("_d", F.col(value) - F.col("_m"))
    x = halo_blocks(x, keys, order_cols, max_lag)
    w = _window(keys, order_cols)
    prods = [(F.col("_d") * F.lag("_d", k).over(w)).alias(f"_p{k}") for k in range(1, max_lag + 1)]
    x = x.select(*keys, "_halo", "_d", "_n", *prods).where(~F.col("_halo"))
    agg = x.groupBy(*keys).agg(F.first("_n").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
                               *[F.sum(f"_p{k}").alias(f"_s{k}") for k in range(1, max_lag + 1)])
    long = agg.select(*keys, "n", "_ss", F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"), F.col(f"_s{k}").alias("_sk")) for k in range(1, max_lag + 1)])))
    return long.where(F.col("lag") <= F.least(F.lit(max_lag), F.col("n") - 1)).select(
        *keys, "lag", (F.col("_sk") / F.col("_ss")).alias("acf"),
        (F.lit(Z975) / F.sqrt(F.col("n"))).alias("bound"))


def row_index(df: DataFrame, order_col: str, tie_col: str, keys: Sequence[str] = (),
              out: str = "_row") -> DataFrame:
    """1-based position by (order_col, tie_col) within keys, from bucketed
    cumulative counts (no single-task sort of a whole group)."""
    keys = list(keys)
    o = order_key(df, order_col).cast("double")
    vc = df.select(*keys, o.alias("_o")).groupBy(*keys, "_o").agg(F.count(F.lit(1)).alias("_c"))
    c1 = ranks.with_cumulative(vc, keys, "_o", "_c", out_before="_before_o")
    x = df.withColumn("_o", o).join(c1, [*keys, "_o"])
    # ties on the order value are ranked by tie_col; only multi-row tie groups
    # need the second cumulative pass
    tie = F.col(tie_col).cast("double")
    multi = x.where(F.col("_c") > 1)
    vc2 = multi.select(*keys, "_o", tie.alias("_t")).groupBy(*keys, "_o", "_t").agg(F.count(F.lit(1)).alias("_c2"))
    c2 = ranks.with_cumulative(vc2, [*keys, "_o"], "_t", "_c2", out_before="_before_t").drop("_c2")
    x = x.withColumn("_t", tie).join(c2, [*keys, "_o", "_t"], "left")
    idx = F.col("_before_o") + F.coalesce(F.col("_before_t"), F.lit(0)) + 1
    return x.withColumn(out, idx).drop("_o", "_t", "_c", "_before_o", "_before_t")


def time_ordered_split(df: DataFrame, order_col: str, tie_col: str, train_pct: float) -> DataFrame:
    """First floor(n * p) rows by time are train (p clamped to [0.5, 0.95])."""
    p = min(0.95, max(0.5, float(train_pct)))
    n = df.count()
    cut = math.floor(n * p)
    x = row_index(df, order_col, tie_col)
    return x.withColumn("split", F.when(F.col("_row") <= cut, "train").otherwise("test")).drop("_row")


# ----------------------------------------------------------------- forecasts

def series_summary(df: DataFrame, keys: Sequence[str], order_col: str, value: str) -> DataFrame:
    """Per series: n, first, last, mean, sd, and the mean square of first
    differences (drift-free random walk variance) - one lag window + aggregate."""
    x = lag_features(df.select(*keys, order_col, value), value, [order_col], keys, lags=[1], prefix="_lag")
    d = F.col(value) - F.col("_lag1")
    return x.groupBy(*keys).agg(
        F.count(F.col(value)).alias("n"), F.min_by(value, order_col).alias("first"),
        F.max_by(value, order_col).alias("last"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"), F.avg(d * d).alias("msd"), F.stddev_samp(d).alias("sdd"),
        F.count(d).alias("nd"))


def _steps(h: int):
    return F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step")


def forecast_naive(df, keys, order_col, value, h=12):
    s = series_summary(df, keys, order_col, value).select(*keys, "last", "msd", _steps(h))
    se = F.sqrt(F.col("msd") * F.col("step"))
    return s.select(*keys, "step", F.col("last").alias("predicted"),
                    (F.col("last") - Z975 * se).alias("lower"), (F.col("last") + Z975 * se).alias("upper"))


def forecast_rwf_drift(df, keys, order_col, value, h=12):
    s = series_summary(df, keys, order_col, value)
    b = (F.col("last") - F.col("first")) / (F.col("n") - 1)
    bse = F.col("sdd") / F.sqrt(F.col("nd"))
    s = s.select(*keys, "last", b.alias("b"), F.col("sdd").alias("sigma"), bse.alias("bse"), _steps(h))
    pred = F.col("last") + F.col("step") * F.col("b")
    se = F.sqrt(F.col("sigma") * F.col("sigma") * F.col("step") + F.pow(F.col("step") * F.col("bse"), 2))
    return s.select(*keys, "step", pred.alias("predicted"), (pred - Z975 * se).alias("lower"),
                    (pred + Z975 * se).alias("upper"))


def forecast_meanf(df, keys, order_col, value, h=12):
    s = series_summary(df, keys, order_col, value)
    tq = _t975(F.col("n") - 1)
    s = s.select(*keys, "mean", (tq * F.col("sd") * F.sqrt(1 + 1 / F.col("n"))).alias("half"), _steps(h))
    return s.select(*keys, "step", F.col("mean").alias("predicted"), (F.col("mean") - F.col("half")).alias("lower"),
                    (F.col("mean") + F.col("half")).alias("upper"))


def _t975(df_col: Column) -> Column:
    @F.pandas_udf("double")
    def tq(d):
        import pandas as pd
        cache = {}
        out = []
        for v in d:
            if v is None or (isinstance(v, float) and math.isnan(v)) or v < 1:
                out.append(float("nan"))
                continue
            if v not in cache:
                cache[v] = t_ppf(0.975, float(v))
            out.append(cache[v])
        return pd.Series(out)
    return tq(df_col.cast("double"))


def forecast_snaive(df, keys, order_col, value, m=12, h=12):
    """Value of the same season in the last observed period; se grows with
    the number of full periods ahead."""
    keys = list(keys)
    lagged = lag_features(df.select(*keys, order_col, value), value, [order_col], keys, lags=[m], prefix="_slag")
    d = F.col(value) - F.col(f"_slag{m}")
    sig = lagged.groupBy(*keys).agg(F.avg(d * d).alias("msd"))
    last = ranks.top_k_per_group(df.select(*keys, order_col, value), keys, [F.col(order_col).desc()], m)
    # _rank r (1 = last observation) serves steps m - r + 1, m - r + 1 + m, ... <= h
    start = F.lit(m) - F.col("_rank") + 1
    x = last.where(start <= h).withColumn("step", F.explode(F.sequence(start.cast("int"), F.lit(h), F.lit(m))))
    x = x.join(sig, keys) if keys else ranks.attach_scalars(x, sig)
    k = F.floor((F.col("step") - 1) / m) + 1
    se = F.sqrt(F.col("msd") * k)
    return x.select(*keys, "step", F.col(value).alias("predicted"), (F.col(value) - Z975 * se).alias("lower"),
                    (F.col(value) + Z975 * se).alias("upper"))


def ts_frequency_guard(freq, n: int) -> float:
    try:
        f = float(freq)
    except (TypeError, ValueError):
        f = 12.0
    if not math.isfinite(f) or f < 1:
        f = 1.0
    if f >= n:
        f = max(1.0, math.floor(n / 2))
    return f


def prophet_prepare(df: DataFrame, time_col: str, target: str, growth: str = "linear",
                    cap=None, floor=None, keys: Sequence[str] = ()) -> DataFrame:
    """Rename to (ds, y), drop NULL targets, keep the first row per ds (by the
    input order column ``_ord`` if present), logistic growth needs a cap."""
    keys = list(keys)
    if growth not in ("linear", "logistic", "flat"):
        raise ValueError("Prophet: growth must be one of linear, logistic, flat")
    x = df.select(*keys, F.col(time_col).alias("ds"), F.col(target).cast("double").alias("y"),
                  *([F.col(cap).alias("cap")] if isinstance(cap, str) else []),
                  *([F.col("_ord")] if "_ord" in df.columns else []))
    x = x.where(F.col("y").isNotNull() & F.col("ds").isNotNull())
    first = F.min_by(F.struct(*[c for c in x.columns if c not in (*keys, "ds")]),
                     F.col("_ord") if "_ord" in x.columns else F.col("y"))
    x = x.groupBy(*keys, "ds").agg(first.alias("_f")).select(*keys, "ds", "_f.*")
    if "_ord" in x.columns:
        x = x.drop("_ord")
    if growth == "logistic":
        if cap is None:
            raise ValueError("Prophet: logistic growth requires a cap (scalar or column)")
        if not isinstance(cap, str):
            x = x.withColumn("cap", F.lit(float(cap)))
        x = x.withColumn("floor", F.lit(float(floor if floor is not None else 0.0)))
    return x
