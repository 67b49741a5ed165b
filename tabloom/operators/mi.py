"""Multiple imputation: implicate handling, per-implicate estimates and
Rubin's pooling rules, all as grouped aggregates over an ``implicate`` key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import t_sf2
from . import survey
from .detect import WIDE_IMPLICATE_PATTERN


def mi_split_wide(df: DataFrame, bases: dict[str, list[str]], implicate: str = "implicate") -> DataFrame:
    """Wide ``y_imp1..y_impM`` columns -> long rows with an ``implicate`` column
    (suffix stripped); other columns are repeated per implicate."""
    m = max(len(v) for v in bases.values())
    wide_cols = {c for v in bases.values() for c in v}
    base_cols = [c for c in df.columns if c not in wide_cols]
    items = []
    for k in range(m):
        fields = [F.lit(k + 1).alias(implicate)]
        for b, cols in bases.items():
            fields.append((F.col(cols[k]) if k < len(cols) else F.lit(None)).alias(b))
        items.append(F.struct(*fields))
    return df.select(*base_cols, F.inline(F.array(*items)))


def wide_bases(columns: Sequence[str]) -> dict[str, list[str]]:
    groups: dict[str, dict[int, str]] = {}
    for c in columns:
        mt = WIDE_IMPLICATE_PATTERN.search(c)
        if mt:
            groups.setdefault(c[: mt.start()], {})[int(mt.group(2))] = c
    return {b: [v[k] for k in sorted(v)] for b, v in groups.items() if len(v) >= 2}


def rubin_pool(est: DataFrame, keys: Sequence[str] = ("term",), estimate: str = "estimate",
               se: str = "se", implicate: str = "implicate") -> DataFrame:
    """Pool per term: Qbar, W, B, T = W + (1+1/m)B, riv, lambda, df, fmi.
    B = 0 gives df = NULL (infinite) and fmi = 0."""
    keys = list(keys)
    g = est.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.avg(estimate).alias("estimate"),
                               F.avg(F.col(se) * F.col(se)).alias("W"), F.var_samp(estimate).alias("B"))
    m, W, B = F.col("m"), F.col("W"), F.col("B")
    T = W + (1 + 1 / m) * B
    riv = F.when(W > 0, (1 + 1 / m) * B / W)
    lam = (1 + 1 / m) * B / T
    df = F.when(B > 0, (m - 1) * F.pow(1 + 1 / riv, 2))
    fmi = F.when(B > 0, (riv + 2 / (df + 3)) / (riv + 1)).otherwise(F.lit(0.0))
    return g.select(*keys, F.col("m").cast("long"), "estimate", F.sqrt(T).alias("std_error"),
                    (F.col("estimate") / F.sqrt(T)).alias("statistic"), df.alias("df"), fmi.alias("fmi"),
                    riv.alias("riv"), lam.alias("lambda"))


def with_p_value(pooled: DataFrame) -> DataFrame:
    """Two-sided t p-value (normal when df is infinite) via an Arrow UDF on the
    small pooled table."""
    @F.pandas_udf("double")
    def pval(t, d):
        import pandas as pd
        return pd.Series([t_sf2(float(a), math.inf if (b is None or (isinstance(b, float) and math.isnan(b))) else float(b))
                          if a is not None and not (isinstance(a, float) and math.isnan(a)) else float("nan")
                          for a, b in zip(t, d)])
    return pooled.withColumn("p_value", pval(F.col("statistic"), F.col("df")))


def mi_mean(df: DataFrame, y: str, d: survey.Design, implicate: str = "implicate") -> DataFrame:
    per = survey.survey_mean(df, y, d, [implicate]).select(implicate, F.lit(y).alias("term"),
                                                            F.col("mean").alias("estimate"), "se")
    return rubin_pool(per, ["term"], implicate=implicate)


def mi_ratio(df: DataFrame, num: str, den: str, d: survey.Design, implicate: str = "implicate") -> DataFrame:
    per = survey.survey_ratio(df, num, den, d, [implicate]).select(
        implicate, F.lit(f"{num}/{den}").alias("term"), F.col("ratio").alias("estimate"), "se")
    return rubin_pool(per, ["term"], implicate=implicate)


def mi_quantile(df: DataFrame, y: str, d: survey.Design, probs: Sequence[float] = (0.25, 0.5, 0.75),
                implicate: str = "implicate") -> DataFrame:
    """Quantiles of every implicate with their Woodruff errors, pooled per probability."""
    per = survey.survey_quantile_ci(df, y, d, probs, [implicate]).select(
        implicate, F.concat(F.lit(f"{y} "), F.col("p").cast("string")).alias("term"), F.col("quantile").alias("estimate"), "se")
    return rubin_pool(per, ["term"], implicate=implicate)


def mi_diagnostics(pooled: DataFrame) -> DataFrame:
    return pooled.agg(F.max("m").alias("m"), F.avg("fmi").alias("avg_fmi"), F.max("fmi").alias("max_fmi"),
                      F.avg("lambda").alias("avg_lambda"))


def mi_glm(df: DataFrame, y: str, xcols: Sequence[str], d: survey.Design, family: str = "gaussian",
           implicate: str = "implicate") -> DataFrame:
    """Survey GLM per implicate (one grouped fit), pooled per term by Rubin's rules."""
    per = survey.survey_glm(df, y, xcols, d, family, [implicate]).withColumnRenamed("std_error", "se")
    return with_p_value(rubin_pool(per, ["term"], implicate=implicate))
