"""Complex-survey estimation as aggregates.

Design: weight column, strata, PSU nested in strata (no finite population
correction).  Taylor linearisation: an estimator's influence values ``z``
are summed to PSU totals, then per stratum
``V = sum_h n_h/(n_h-1) * sum_i (z_hi - zbar_h)^2``.  Each estimator is
three grouped aggregates (totals -> PSU -> stratum), optionally per domain
or implicate keys.  Replicate designs work from PSU-level totals, so
replicates multiply the PSU table, never the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.stats import t_ppf


@dataclass(frozen=True)
class Design:
    weight: str
    strata: str | None = None
    psu: str | None = None


def valid_weights(df: DataFrame, weight: str) -> DataFrame:
    """Keep rows whose weight is non-NULL, finite and > 0."""
    w = F.col(weight).cast("double")
    return df.where(w.isNotNull() & ~F.isnan(w) & (w > 0) & (w < float("inf")))


def _keyed(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys)) if keys else ranks.attach_scalars(df, other)


def _spread(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``_keyed`` for many rows and one row a key, of which there may be few."""
    return ranks.attach_groups(df, groups, list(keys)) if keys else ranks.attach_scalars(df, groups)


def _strata_psu(d: Design):
    h = F.col(d.strata).cast("string") if d.strata else F.lit("_all")
    i = F.col(d.psu).cast("string") if d.psu else F.monotonically_increasing_id().cast("string")
    return h, i


def taylor_variance(z_df: DataFrame, d: Design, keys: Sequence[str] = (), zcols: Sequence[str] = ("z",)) -> DataFrame:
    """Variance of the totals of each influence column in ``zcols`` per keys.
    Returns keys + ``var_<z>`` + ``n_single`` (strata with one PSU, whose
    presence makes the variance undefined -> NULL)."""
    keys = list(keys)
    if not d.psu:
        # each row is its own PSU: stratum sums of z and z^2 suffice (no PSU shuffle)
        h = F.col(d.strata).cast("string") if d.strata else F.lit("_all")
        st = z_df.groupBy(*keys, h.alias("_h")).agg(
            F.count(F.lit(1)).alias("_nh"),
            *[F.sum(c).alias(f"_s_{c}") for c in zcols], *[F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}") for c in zcols])
    else:
        h, i = _strata_psu(d)
        psu = z_df.groupBy(*keys, h.alias("_h"), i.alias("_i")).agg(*[F.sum(c).alias(c) for c in zcols])
        st = psu.groupBy(*keys, "_h").agg(
            F.count(F.lit(1)).alias("_nh"),
            *[F.sum(c).alias(f"_s_{c}") for c in zcols], *[F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}") for c in zcols])
    nh = F.col("_nh")
    parts = [F.sum(F.when(nh > 1, nh / (nh - 1) * (F.col(f"_q_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}") / nh)))
             .alias(f"_v_{c}") for c in zcols]
    v = st.groupBy(*keys).agg(*parts, F.count_if(nh == 1).alias("n_single"))
    return v.select(*keys, *[F.when(F.col("n_single") == 0, F.col(f"_v_{c}")).alias(f"var_{c}") for c in zcols],
                    F.col("n_single").cast("long"))


def _psu_sums(x: DataFrame, keys: list[str], d: Design, sums: dict[str, Column]) -> DataFrame:
    """One pass over the data: per (keys, stratum, PSU) sums - the sufficient
    statistics of every linearised estimator below (size: number of PSUs)."""
    h, i = _strata_psu(d)
    return x.groupBy(*keys, h.alias("_h"), i.alias("_i")).agg(
        F.count(F.lit(1)).alias("_cnt"), *[e.alias(n) for n, e in sums.items()])


def _psu_variance(psu: DataFrame, keys: list[str]) -> DataFrame:
    """Taylor variance from PSU-level influence totals ``z`` (already summed)."""
    nh = F.col("_nh")
    st = psu.groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_nh"), F.sum("z").alias("_s"),
                                      F.sum(F.col("z") * F.col("z")).alias("_q"))
    v = st.groupBy(*keys).agg(F.sum(F.when(nh > 1, nh / (nh - 1) * (F.col("_q") - F.col("_s") * F.col("_s") / nh)))
                              .alias("_v"), F.count_if(nh == 1).alias("n_single"))
    return v.select(*keys, F.when(F.col("n_single") == 0, F.col("_v")).alias("var_z"), F.col("n_single").cast("long"))


def survey_mean(df: DataFrame, y: str, d: Design, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean sum(w y)/sum(w) and its Taylor SE; NULL y rows dropped.
    With PSUs, one pass builds PSU sums (T, W); the influence total of PSU i is
    (T_i - mean W_i) / W, so the data is read once."""
    keys = list(keys)
    x = valid_weights(df, d.weight).where(F.col(y).isNotNull())
    w, yy = F.col(d.weight).cast("double"), F.col(y).cast("double")
    if d.psu:
        psu = _psu_sums(x, keys, d, {"_T": F.sum(w * yy), "_W": F.sum(w)})
        tot = psu.groupBy(*keys).agg((F.sum("_T") / F.sum("_W")).alias("mean"), F.sum("_W").alias("_sw"),
                                     F.sum("_cnt").alias("n"))
        z = _keyed(psu, tot.select(*keys, "mean", "_sw"), keys).withColumn(
            "z", (F.col("_T") - F.col("mean") * F.col("_W")) / F.col("_sw"))
        v = _psu_variance(z, keys)
    else:
        tot = x.groupBy(*keys).agg((F.sum(w * yy) / F.sum(w)).alias("mean"), F.sum(w).alias("_sw"),
                                   F.count(F.lit(1)).alias("n"))
        z = _keyed(x, tot.select(*keys, "mean", "_sw"), keys).withColumn(
            "z", w * (yy - F.col("mean")) / F.col("_sw"))
        v = taylor_variance(z, d, keys)
    return _keyed(tot.select(*keys, "mean", "n"), v, keys).select(
        *keys, "mean", F.sqrt("var_z").alias("se"), F.col("n").cast("long"), "n_single")


def survey_total(df: DataFrame, y: str, d: Design, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    x = valid_weights(df, d.weight).where(F.col(y).isNotNull())
    wy = F.col(d.weight).cast("double") * F.col(y).cast("double")
    if d.psu:
        psu = _psu_sums(x, keys, d, {"z": F.sum(wy)})
        tot = psu.groupBy(*keys).agg(F.sum("z").alias("total"), F.sum("_cnt").alias("n"))
        v = _psu_variance(psu, keys)
    else:
        z = x.withColumn("z", wy)
        tot = z.groupBy(*keys).agg(F.sum("z").alias("total"), F.count(F.lit(1)).alias("n"))
        v = taylor_variance(z, d, keys)
    return _keyed(tot, v, keys).select(*keys, "total", F.sqrt("var_z").alias("se"), F.col("n").cast("long"),
                                       "n_single")


def survey_ratio(df: DataFrame, num: str, den: str, d: Design, keys: Sequence[str] = ()) -> DataFrame:
    """R = sum(w y)/sum(w x) with z = w (y - R x) / sum(w x)."""
    keys = list(keys)
    x = valid_weights(df, d.weight).where(F.col(num).isNotNull() & F.col(den).isNotNull())
    w, yy, xx = F.col(d.weight).cast("double"), F.col(num).cast("double"), F.col(den).cast("double")
    if d.psu:
        psu = _psu_sums(x, keys, d, {"_Y": F.sum(w * yy), "_X": F.sum(w * xx)})
        tot = psu.groupBy(*keys).agg((F.sum("_Y") / F.sum("_X")).alias("ratio"), F.sum("_X").alias("_sx"),
                                     F.sum("_cnt").alias("n"))
        z = _keyed(psu, tot.select(*keys, "ratio", "_sx"), keys).withColumn(
            "z", (F.col("_Y") - F.col("ratio") * F.col("_X")) / F.col("_sx"))
        v = _psu_variance(z, keys)
    else:
        tot = x.groupBy(*keys).agg(F.sum(w * yy).alias("_sy"), F.sum(w * xx).alias("_sx"),
                                   F.count(F.lit(1)).alias("n")).withColumn("ratio", F.col("_sy") / F.col("_sx"))
        z = _keyed(x, tot.select(*keys, "ratio", "_sx"), keys).withColumn(
            "z", w * (yy - F.col("ratio") * xx) / F.col("_sx"))
        v = taylor_variance(z, d, keys)
    return _keyed(tot.select(*keys, "ratio", "n"), v, keys).select(
        *keys, "ratio", F.sqrt("var_z").alias("se"), F.col("n").cast("long"), "n_single")


def survey_proportion(df: DataFrame, y: str, d: Design, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted share of each level of ``y`` with Taylor SE.  Works from PSU
    totals: strata where a level is absent contribute through the level-free
    sums, so no PSU x level product is formed."""
    keys = list(keys)
    x = valid_weights(df, d.weight).where(F.col(y).isNotNull())
    w = F.col(d.weight).cast("double")
    h, i = _strata_psu(d)
    x = x.select(*keys, h.alias("_h"), i.alias("_i"), F.col(y).cast("string").alias("level"), w.alias("_w"))
    psu = x.groupBy(*keys, "_h", "_i").agg(F.sum("_w").alias("_B"))
    psu_l = x.groupBy(*keys, "_h", "_i", "level").agg(F.sum("_w").alias("_A"))
    W = psu.groupBy(*keys).agg(F.sum("_B").alias("_W"))
    st = psu.groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_nh"), F.sum("_B").alias("_SB"),
                                      F.sum(F.col("_B") * F.col("_B")).alias("_SB2"))
    nh = F.col("_nh")
    st = st.withColumn("_g", F.when(nh > 1, nh / (nh - 1) * (F.col("_SB2") - F.col("_SB") * F.col("_SB") / nh)))
    G = st.groupBy(*keys).agg(F.sum("_g").alias("_G"), F.count_if(nh == 1).alias("n_single"))
    lvl = psu_l.groupBy(*keys, "level").agg(F.sum("_A").alias("_SA_all"))
    lvl = _keyed(lvl, W, keys).withColumn("p", F.col("_SA_all") / F.col("_W"))
    pl = psu_l.join(psu, [*keys, "_h", "_i"])
    hl = pl.groupBy(*keys, "_h", "level").agg(
        F.sum("_A").alias("_SA"), F.sum(F.col("_A") * F.col("_A")).alias("_SA2"),
        F.sum(F.col("_A") * F.col("_B")).alias("_SAB"))
    hl = hl.join(st, [*keys, "_h"]).join(lvl.select(*keys, "level", "p", "_W"), [*keys, "level"])
    p = F.col("p")
    sz = F.col("_SA") - p * F.col("_SB")
    sz2 = F.col("_SA2") - 2 * p * F.col("_SAB") + p * p * F.col("_SB2")
    term = F.when(nh > 1, nh / (nh - 1) * (sz2 - sz * sz / nh))
    corr = hl.groupBy(*keys, "level").agg(F.sum(term - p * p * F.col("_g")).alias("_corr"))
    out = lvl.join(corr, [*keys, "level"])
    out = _keyed(out, G, keys)
    var = (F.col("p") * F.col("p") * F.col("_G") + F.col("_corr")) / (F.col("_W") * F.col("_W"))
    return out.select(*keys, "level", F.col("p").alias("proportion"),
                      F.when(F.col("n_single") == 0, F.sqrt(var)).alias("se"), "n_single")


def survey_quantile(df: DataFrame, y: str, d: Design, probs: Sequence[float] = (0.25, 0.5, 0.75),
                    keys: Sequence[str] = ()) -> DataFrame:
    """Smallest x with weighted CDF F_w(x) >= p (bucketed cumulative weights)."""
    keys = list(keys)
    x = valid_weights(df, d.weight).where(F.col(y).isNotNull())
    vc = ranks.value_weights(x, keys, F.col(y).cast("double"), F.col(d.weight).cast("double"))
    cum = ranks.with_cumulative(vc, keys, "value", "w")
    tot = vc.groupBy(*keys).agg(F.sum("w").alias("_W"))
    cum = _keyed(cum, tot, keys).withColumn("_F", (F.col("cum_before") + F.col("w")) / F.col("_W")).withColumn(
        "_Fb", F.col("cum_before") / F.col("_W"))
    pr = cum.select(*keys, "value", "_F", "_Fb", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    # smallest x with F(x) >= p: F(x) >= p > F(previous x), with a relative tolerance
    hit = pr.where((F.col("_F") >= F.col("p") - 1e-12) & (F.col("_Fb") < F.col("p") - 1e-12))
    return hit.groupBy(*keys, "p").agg(F.min("value").alias("quantile"))


def _weighted_cdf(x: DataFrame, keys: list[str], y: str, weight: str) -> DataFrame:
    """(keys, value, F, below): the weighted distribution function at every value and before it;
    one row a distinct value, written once because several plan branches look values up in it."""
    vc = ranks.value_weights(x, keys, F.col(y).cast("double"), F.col(weight).cast("double"))
    cum = ranks.with_cumulative(vc, keys, "value", "w")
    tot = vc.groupBy(*keys).agg(F.sum("w").alias("_W"))
    cum = _spread(cum, tot, keys)
    return ranks.materialize(cum.select(*keys, "value", ((F.col("cum_before") + F.col("w")) / F.col("_W")).alias("F"),
                                        (F.col("cum_before") / F.col("_W")).alias("below")))


def _inverted(cdf: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, value): the smallest value whose F reaches each p of the array ``ps`` of the key's
    row in ``wanted``; a p at or below 0 gives the least value, one at or above 1 the greatest."""
    x = _spread(cdf, wanted.select(*keys, "ps"), keys)
    at = lambda p: F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0)) - 1e-12
    hit = F.filter("ps", lambda p: (F.col("F") >= at(p)) & (F.col("below") < at(p)))
    return x.select(*keys, "value", F.explode(hit).alias("p")).groupBy(*keys, "p").agg(F.min("value").alias("value"))


def survey_quantile_ci(df: DataFrame, y: str, d: Design, probs: Sequence[float] = (0.25, 0.5, 0.75), keys: Sequence[str] = (),
                       level: float = 0.95) -> DataFrame:
    """Quantiles with Woodruff intervals: (keys, p, quantile, se, lower, upper, df, n_single).

    The share of weight at or below a quantile is a proportion with a Taylor variance; its limits
    at the t quantile of (PSUs - strata) degrees of freedom are inverted through the weighted
    distribution function, and the standard error is the interval's half-width over that t.  One pass
    builds the distribution function, one the PSU totals of weight and of weight below every
    quantile; the rest are tables of PSUs or of keys."""
    keys, probs = list(keys), [float(p) for p in probs]
    x = valid_weights(df, d.weight).where(F.col(y).isNotNull())
    cdf = _weighted_cdf(x, keys, y, d.weight)
    every = cdf.groupBy(*keys).agg(F.lit(1).alias("_any")).select(*keys, F.array(*[F.lit(p) for p in probs]).alias("ps"))
    found = _inverted(cdf, every, keys)
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"_q{i}") for i, p in enumerate(probs)])
    w, yy = F.col(d.weight).cast("double"), F.col(y).cast("double")
    h = F.col(d.strata).cast("string") if d.strata else F.lit("_all")
    z = _spread(x.select(*keys, h.alias("_h"), *([F.col(d.psu).cast("string").alias("_i")] if d.psu else []), w.alias("_w"), yy.alias("_yv")), wide, keys)
    share = {f"_a{i}": F.when(F.col("_yv") <= F.col(f"_q{i}"), F.col("_w")).otherwise(0.0) for i in range(len(probs))}
    if d.psu:
        z = z.groupBy(*keys, "_h", "_i").agg(F.sum("_w").alias("_w"), *[F.sum(e).alias(n) for n, e in share.items()])
    else:
        z = z.select(*keys, "_h", "_w", *[e.alias(n) for n, e in share.items()])
    tot = z.groupBy(*keys).agg(F.sum("_w").alias("_total"), *[(F.sum(n) / F.sum("_w")).alias(f"_p{i}") for i, n in enumerate(share)])
    z = _spread(z, tot, keys).select(*keys, "_h", *[((F.col(f"_a{i}") - F.col(f"_p{i}") * F.col("_w")) / F.col("_total")).alias(f"z{i}")
                                                  for i in range(len(probs))])
    zs = [f"z{i}" for i in range(len(probs))]
    st = z.groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_nh"), *[F.sum(c).alias(f"_s_{c}") for c in zs],
                                    *[F.sum(F.col(c) * F.col(c)).alias(f"_q_{c}") for c in zs])
    nh = F.col("_nh")
    var = st.groupBy(*keys).agg(
        (F.sum("_nh") - F.count(F.lit(1))).cast("long").alias("df"), F.count_if(nh == 1).cast("long").alias("n_single"),
        *[F.sum(F.when(nh > 1, nh / (nh - 1) * (F.col(f"_q_{c}") - F.col(f"_s_{c}") * F.col(f"_s_{c}") / nh))).alias(f"_v_{c}") for c in zs])
    cut = 0.5 + level / 2

    @F.pandas_udf("double")
    def t_quantile(n):     # one row a key
        return n.map(lambda v: t_ppf(cut, float(v)) if v > 0 else float("nan"))
    lim = _keyed(tot, var, keys).withColumn("_t", t_quantile(F.col("df"))).select(*keys, "df", "n_single", "_t", F.explode(F.array(*[
        F.struct(F.lit(p).alias("p"), (F.col(f"_p{i}") - F.col("_t") * F.sqrt(f"_v_z{i}")).alias("_lo"),
                 (F.col(f"_p{i}") + F.col("_t") * F.sqrt(f"_v_z{i}")).alias("_hi")) for i, p in enumerate(probs)])).alias("_l")).select(
        *keys, "df", "n_single", "_t", "_l.*")
    lim = ranks.materialize(lim)
    ends = _inverted(cdf, lim.groupBy(*keys).agg(F.flatten(F.collect_list(F.array("_lo", "_hi"))).alias("ps")), keys)
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"l.{k}")) for k in keys]

    def at(frame: DataFrame, limit: str, name: str) -> DataFrame:
        j = frame.alias("l").join(ends.alias("e"), [*same, F.col(f"l.{limit}") == F.col("e.p")], "left")
        return j.select("l.*", F.col("e.value").alias(name))
    out = at(at(lim, "_lo", "lower"), "_hi", "upper").alias("l").join(
        found.alias("e"), [*same, F.col("l.p") == F.col("e.p")]).select("l.*", F.col("e.value").alias("quantile"))
    defined = F.col("n_single") == 0
    return out.select(*keys, "p", "quantile", *[F.when(defined, e).alias(n) for n, e in (
        ("se", (F.col("upper") - F.col("lower")) / (2 * F.col("_t"))), ("lower", F.col("lower")), ("upper", F.col("upper")))], "df", "n_single")


def unweighted_summary(df: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    x = df.where(F.col(y).isNotNull())
    s = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"),
                             F.min(y).alias("min"), F.max(y).alias("max"))
    med = ranks.quantile_map(ranks.exact_quantiles(x, keys, F.col(y).cast("double"), [0.5]), keys, {0.5: "median"})
    return _keyed(s, med, keys) if keys else ranks.attach_scalars(s, med)


# ---------------------------------------------------------------- replicates

# Variance scale per replicate type (R = number of replicates).
def replicate_scale(kind: str, R: int, rho: float = 0.0) -> float:
    k = kind.lower()
    if k == "brr":
        return 1.0 / R
    if k == "fay":
        return 1.0 / (R * (1 - rho) ** 2)
    if k == "jk1":
        return (R - 1) / R
    if k == "jkn":
        raise ValueError("JKn has a scale per replicate, (n_h - 1) / n_h: pass `rscales`")
    if k == "bootstrap":
        return 1.0 / (R - 1)
    if k == "acs":
        return 4.0 / R
    raise ValueError(f"unknown replicate type {kind}")


def replicate_mean(df: DataFrame, y: str, weight: str, rep_cols: Sequence[str], kind: str = "JK1",
                   rho: float = 0.0, mse: bool = True, combined: bool = True, keys: Sequence[str] = (),
                   rscales: Sequence[float] | None = None) -> DataFrame:
    """Mean with replicate-weight variance: theta_r from each replicate weight
    (times the full weight unless ``combined``), V = scale * sum (theta_r - c)^2
    with c = theta (mse) or mean theta_r.  ``rscales`` gives each replicate its own
    scale (JKn: (n_h - 1) / n_h of the stratum that lost a PSU).  One aggregate over
    an exploded replicate index with map-side combine."""
    keys = list(keys)
    R = len(rep_cols)
    x = valid_weights(df, weight).where(F.col(y).isNotNull())
    w, yy = F.col(weight).cast("double"), F.col(y).cast("double")
    arr = F.array(*[F.col(c).cast("double") * (F.lit(1.0) if combined else w) for c in rep_cols])
    full = x.groupBy(*keys).agg((F.sum(w * yy) / F.sum(w)).alias("mean"), F.count(F.lit(1)).alias("n"))
    rep = ranks.ensure_parallelism(x).select(*keys, yy.alias("_y"), F.posexplode(arr).alias("rep", "_wr"))
    th = rep.groupBy(*keys, "rep").agg((F.sum(F.col("_wr") * F.col("_y")) / F.sum("_wr")).alias("theta_r"))
    j = _keyed(th, full, keys)
    center = F.col("mean") if mse else F.avg("theta_r").over(_window_by(keys))
    j = j.withColumn("_c", center)
    sc = F.get(F.array(*[F.lit(float(s)) for s in rscales]), F.col("rep")) if rscales is not None \
        else F.lit(replicate_scale(kind, R, rho))
    v = j.groupBy(*keys).agg(F.first("mean").alias("mean"), F.first("n").alias("n"),
                             F.sum(sc * F.pow(F.col("theta_r") - F.col("_c"), 2)).alias("_v"))
    return v.select(*keys, "mean", F.sqrt("_v").alias("se"), F.col("n").cast("long"))


def _window_by(keys):
    from pyspark.sql import Window
    return Window.partitionBy(*keys)


def jkn_replicate_weights(df: DataFrame, weight: str, stratum: Column, psu_index: Column,
                          psus_of: dict, prefix: str = "wr_") -> tuple[DataFrame, list[float]]:
    """Stratified delete-one-PSU weights: a replicate drops one PSU of one stratum and
    scales that stratum's others by n_h / (n_h - 1).  ``psus_of`` maps each stratum to
    the PSU numbers it holds (a design has as many columns as PSUs).  Returns the frame
    and the scale (n_h - 1) / n_h of every replicate; strata of one PSU give none."""
    w, cols, scales = F.col(weight).cast("double"), [], []
    for h, members in psus_of.items():
        n = len(members)
        for i in members if n > 1 else ():
            own = stratum == F.lit(h)
            cols.append(F.when(own & (psu_index == F.lit(i)), F.lit(0.0)).when(own, w * (n / (n - 1.0))).otherwise(w)
                        .alias(f"{prefix}{len(cols) + 1}"))
            scales.append((n - 1.0) / n)
    return df.select("*", *cols), scales


def jk1_replicate_weights(df: DataFrame, weight: str, psu_index: Column, n_psu: int, prefix: str = "wr_") -> DataFrame:
    """Delete-one-PSU weights: replicate r zeroes PSU r and scales the rest by
    R/(R-1); strata are ignored (JK1)."""
    f = n_psu / (n_psu - 1)
    cols = [F.when(psu_index == r, F.lit(0.0)).otherwise(F.col(weight).cast("double") * f).alias(f"{prefix}{r + 1}")
            for r in range(n_psu)]
    return df.select("*", *cols)


def psu_bootstrap_multipliers(psus: DataFrame, reps: int, seed: int = 42) -> DataFrame:
    """Rao-Wu style bootstrap at the PSU level: in each stratum with n_h PSUs,
    draw n_h - 1 PSUs with replacement per replicate (seeded hash draws);
    multiplier = count * n_h / (n_h - 1).  Input: one row per (_h, _i).
    Output: (_h, _i, rep, mult); size PSUs x reps, independent of row count."""
    from pyspark.sql import Window
    w = Window.partitionBy("_h").orderBy("_i")
    p = psus.select("_h", "_i").withColumn("_pos", F.row_number().over(w) - 1).withColumn(
        "_nh", F.count(F.lit(1)).over(Window.partitionBy("_h")))
    draws = (p.where(F.col("_pos") < F.col("_nh") - 1)
             .select("_h", "_nh", F.col("_pos").alias("_d"), F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep")))
    u = F.pmod(F.xxhash64(F.col("_h"), F.col("_d"), F.col("rep"), F.lit(seed)), F.lit(1 << 53)).cast("double") / float(1 << 53)
    draws = draws.withColumn("_pos", F.floor(u * F.col("_nh")).cast("long"))
    cnt = draws.groupBy("_h", "_pos", "rep").agg(F.count(F.lit(1)).alias("_c"))
    grid = p.select("_h", "_i", "_pos", "_nh", F.explode(F.sequence(F.lit(1), F.lit(reps))).alias("rep"))
    g = grid.join(cnt, ["_h", "_pos", "rep"], "left")
    mult = F.coalesce(F.col("_c"), F.lit(0)) * F.col("_nh") / (F.col("_nh") - 1)
    return g.select("_h", "_i", "rep", F.when(F.col("_nh") > 1, mult).otherwise(F.lit(1.0)).alias("mult"))


def bootstrap_mean(df: DataFrame, y: str, d: Design, reps: int = 200, seed: int = 42) -> DataFrame:
    """Replicate-bootstrap SE of the weighted mean from PSU totals."""
    x = valid_weights(df, d.weight).where(F.col(y).isNotNull())
    h, i = _strata_psu(d)
    w, yy = F.col(d.weight).cast("double"), F.col(y).cast("double")
    psu = x.groupBy(h.alias("_h"), i.alias("_i")).agg(F.sum(w * yy).alias("_T"), F.sum(w).alias("_W"))
    m = psu_bootstrap_multipliers(psu, reps, seed)
    th = m.join(psu, ["_h", "_i"]).groupBy("rep").agg(
        (F.sum(F.col("mult") * F.col("_T")) / F.sum(F.col("mult") * F.col("_W"))).alias("theta_r"))
    full = psu.agg((F.sum("_T") / F.sum("_W")).alias("mean"))
    j = ranks.attach_scalars(th, full)
    v = j.groupBy().agg(F.first("mean").alias("mean"),
                        (F.lit(replicate_scale("bootstrap", reps)) * F.sum(F.pow(F.col("theta_r") - F.col("mean"), 2))).alias("_v"),
                        F.count(F.lit(1)).alias("R"))
    return v.select("mean", F.sqrt("_v").alias("se"), F.col("R").cast("long"))


def crosstab(df: DataFrame, row: str, col: str, weight: str | None = None) -> DataFrame:
    """Cell counts (or weighted totals) with row / column / overall shares."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    cells = x.groupBy(F.col(row).cast("string").alias("row"), F.col(col).cast("string").alias("col")).agg(
        F.sum(w).alias("n"))
    rt = cells.groupBy("row").agg(F.sum("n").alias("_rt"))
    ct = cells.groupBy("col").agg(F.sum("n").alias("_ct"))
    tt = cells.agg(F.sum("n").alias("_t"))
    out = ranks.attach_scalars(cells.join(rt, "row").join(ct, "col"), tt)
    return out.select("row", "col", "n", (F.col("n") / F.col("_t")).alias("share"),
                      (F.col("_rt") * F.col("_ct") / F.col("_t")).alias("expected"))


def chisq_statistic(tab: DataFrame) -> DataFrame:
    """Pearson X^2 (Yates-corrected for a 2x2 table), df, from crosstab()."""
    s = tab.agg(F.sum(F.pow(F.col("n") - F.col("expected"), 2) / F.col("expected")).alias("_x2"),
                F.sum(F.pow(F.greatest(F.abs(F.col("n") - F.col("expected")) - 0.5, F.lit(0.0)), 2)
                      / F.col("expected")).alias("_x2y"),
                F.count_distinct("row").alias("_r"), F.count_distinct("col").alias("_c"))
    two = (F.col("_r") == 2) & (F.col("_c") == 2)
    from ..functions.stats import chi2_sf
    p_value = F.udf(lambda x, df: chi2_sf(x, df) if x is not None and df else None, "double")   # of one row
    return s.select(F.when(two, F.col("_x2y")).otherwise(F.col("_x2")).alias("statistic"),
                    ((F.col("_r") - 1) * (F.col("_c") - 1)).cast("long").alias("df")).withColumn(
        "p_value", p_value("statistic", "df"))


def panel_summary(df: DataFrame, unit: str, wave: str) -> DataFrame:
    """Units, waves, observations, % balanced units (as many rows as there are waves),
    attrition, mean observations per unit."""
    per_unit = df.groupBy(unit).agg(F.count(F.lit(1)).alias("_obs"))
    nw = df.agg(F.count_distinct(wave).alias("n_waves"))
    x = ranks.attach_scalars(per_unit, nw)
    s = x.agg(F.count(F.lit(1)).alias("n_units"), F.first("n_waves").alias("n_waves"), F.sum("_obs").alias("n_obs"),
              (100.0 * F.avg((F.col("_obs") == F.col("n_waves")).cast("double"))).alias("pct_balanced"))
    return s.select(F.col("n_units").cast("long"), F.col("n_waves").cast("long"), F.col("n_obs").cast("long"),
                    F.round("pct_balanced", 2).alias("pct_balanced"),
                    F.round(100 - F.col("pct_balanced"), 2).alias("attrition"),
                    F.round(F.col("n_obs") / F.col("n_units"), 2).alias("avg_obs_per_unit"))


def panel_waves(df: DataFrame, unit: str, wave: str) -> DataFrame:
    """Observations and distinct units of every wave; rows without a wave are left out."""
    x = df.where(F.col(wave).isNotNull()).groupBy(F.col(wave).cast("string").alias("wave"), F.col(unit).alias("_u")).agg(
        F.count(F.lit(1)).alias("_n"))       # combined before the shuffle, so a large wave is no hot spot
    return x.groupBy("wave").agg(F.sum("_n").cast("long").alias("n"), F.count("_u").cast("long").alias("n_units"))


def unweighted_shares(df: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of every level of a categorical column per ``keys``; NULL levels are left out."""
    keys = list(keys)
    n = df.where(F.col(y).isNotNull()).groupBy(*keys, F.col(y).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*keys).agg(F.sum("n").alias("_all"))
    return _keyed(n, total, keys).select(*keys, "level", F.col("n").cast("long").alias("n"), (F.col("n") / F.col("_all")).alias("proportion"))


def likert_distribution(df: DataFrame, item: str) -> DataFrame:
    """% per level including missing (level NULL)."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    g = df.groupBy(F.col(item).cast("string").alias("level")).agg(F.count(F.lit(1)).alias("n"))
    return ranks.attach_scalars(g, n).select("level", F.col("n").cast("long"),
                                             F.round(100.0 * F.col("n") / F.col("_n"), 4).alias("pct"))


def survey_glm(df: DataFrame, y: str, xcols: Sequence[str], d: Design, family: str = "gaussian",
               keys: Sequence[str] = (), max_iter: int = 25, tol: float = 1e-10) -> DataFrame:
    """Design-weighted GLM (gaussian, or quasi-binomial logit by IRLS) with the
    linearisation sandwich: bread = (X' W X)^-1 at the solution, meat from PSU
    totals of w * x * (y - mu) centred within strata.  Every IRLS step and the
    meat are grouped aggregates (per ``keys``, e.g. implicate); only K x K
    matrices per key reach the driver.  Returns keys, term, estimate,
    std_error, statistic, p_value (t on design df = PSUs - strata - K + 1)."""
    import numpy as np
    from ..functions.stats import t_sf2
    keys = list(keys)
    spark = df.sparkSession
    terms = ["(Intercept)", *xcols]
    K = len(terms)
    ok = F.col(y).isNotNull()
    for c in xcols:
        ok = ok & F.col(c).isNotNull()
    h, i = _strata_psu(d)
    x = valid_weights(df, d.weight).where(ok).select(
        *keys, h.alias("_h"), i.alias("_i"), F.col(d.weight).cast("double").alias("_w"),
        F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{j + 1}") for j, c in enumerate(xcols)])
    X = [F.lit(1.0)] + [F.col(f"_x{j}") for j in range(1, K)]
    key_rows = [tuple(r) for r in x.select(*keys).distinct().collect()] if keys else [()]
    beta = {kr: np.zeros(K) for kr in key_rows}
    schema = ", ".join([f"{k} {x.schema[k].dataType.simpleString()}" for k in keys] + [f"_b{j} double" for j in range(K)])

    def with_beta():
        bt = spark.createDataFrame([(*kr, *map(float, b)) for kr, b in beta.items()], schema)
        xb = x.join(F.broadcast(bt), keys) if keys else ranks.attach_scalars(x, bt)
        eta = F.lit(0.0)
        for j in range(K):
            eta = eta + X[j] * F.col(f"_b{j}")
        mu = eta if family == "gaussian" else 1 / (1 + F.exp(-eta))
        return xb.withColumn("_eta", eta).withColumn("_mu", mu)

    def solve(rows, wcol_sq=True):
        out = {}
        for r in rows:
            kr = tuple(r[k] for k in keys)
            A = np.zeros((K, K))
            for a in range(K):
                for b in range(a, K):
                    A[a, b] = A[b, a] = r[f"a_{a}_{b}"]
            out[kr] = (A, np.array([r[f"c_{a}"] for a in range(K)]))
        return out

    A_final = {}
    for _ in range(max_iter if family != "gaussian" else 1):
        xb = with_beta()
        if family == "gaussian":
            wt, z = F.col("_w"), F.col("_y")
        else:
            v = F.col("_mu") * (1 - F.col("_mu"))
            wt = F.col("_w") * v
            z = F.col("_eta") + (F.col("_y") - F.col("_mu")) / v
        aggs = [F.sum(wt * X[a] * X[b]).alias(f"a_{a}_{b}") for a in range(K) for b in range(a, K)]
        aggs += [F.sum(wt * X[a] * z).alias(f"c_{a}") for a in range(K)]
        sol = solve(xb.groupBy(*keys).agg(*aggs).collect())
        delta = 0.0
        for kr, (A, c) in sol.items():
            nb = np.linalg.solve(A, c)
            delta = max(delta, float(np.max(np.abs(nb - beta[kr]))))
            beta[kr] = nb
            A_final[kr] = A
        if family == "gaussian" or delta < tol:
            break
    if family != "gaussian":  # bread at the final coefficients
        xb = with_beta()
        v = F.col("_mu") * (1 - F.col("_mu"))
        aggs = [F.sum(F.col("_w") * v * X[a] * X[b]).alias(f"a_{a}_{b}") for a in range(K) for b in range(a, K)]
        aggs += [F.lit(0.0).alias(f"c_{a}") for a in range(K)]
        A_final = {kr: A for kr, (A, _) in solve(xb.groupBy(*keys).agg(*aggs).collect()).items()}
    xb = with_beta()
    e = F.col("_y") - F.col("_mu")
    psu = xb.groupBy(*keys, "_h", "_i").agg(*[F.sum(F.col("_w") * X[a] * e).alias(f"u{a}") for a in range(K)])
    st = psu.groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("_nh"),
                                      *[F.sum(f"u{a}").alias(f"s{a}") for a in range(K)],
                                      *[F.sum(F.col(f"u{a}") * F.col(f"u{b}")).alias(f"q_{a}_{b}")
                                        for a in range(K) for b in range(a, K)])
    nh = F.col("_nh")
    meat = st.groupBy(*keys).agg(
        *[F.sum(F.when(nh > 1, nh / (nh - 1) * (F.col(f"q_{a}_{b}") - F.col(f"s{a}") * F.col(f"s{b}") / nh)))
          .alias(f"m_{a}_{b}") for a in range(K) for b in range(a, K)],
        F.count(F.lit(1)).alias("_nst"), F.sum("_nh").alias("_npsu"), F.count_if(nh == 1).alias("_single")).collect()
    rows = []
    for r in meat:
        kr = tuple(r[k] for k in keys)
        M = np.zeros((K, K))
        for a in range(K):
            for b in range(a, K):
                M[a, b] = M[b, a] = r[f"m_{a}_{b}"] or 0.0
        Ai = np.linalg.inv(A_final[kr])
        V = Ai @ M @ Ai
        ddf = max(1, int(r["_npsu"]) - int(r["_nst"]) - K + 1)
        for a, t in enumerate(terms):
            se = float(np.sqrt(V[a, a])) if r["_single"] == 0 and V[a, a] >= 0 else float("nan")
            est = float(beta[kr][a])
            stat = est / se if se and se == se and se > 0 else float("nan")
            rows.append((*kr, t, est, se, stat, float(t_sf2(stat, ddf)) if stat == stat else float("nan")))
    out_schema = ", ".join([f"{k} {x.schema[k].dataType.simpleString()}" for k in keys] +
                           ["term string", "estimate double", "std_error double", "statistic double", "p_value double"])
    return spark.createDataFrame(rows, out_schema)


def hadamard(n: int):
    """Sylvester Hadamard matrix of the smallest power-of-two order >= n:
    entry (r, s) = (-1)^popcount(r & s)."""
    m = 1
    while m < n:
        m *= 2
    return [[-1 if bin(r & s).count("1") % 2 else 1 for s in range(m)] for r in range(m)]


def brr_mean(df: DataFrame, y: str, d: Design, rho: float = 0.0) -> DataFrame:
    """Balanced repeated replication (Fay when rho > 0) for designs with exactly
    two PSUs per stratum: the PSU table (one pass) gets Hadamard half-sample
    multipliers 2 - rho / rho; V = sum (theta_r - theta)^2 / (R (1 - rho)^2)."""
    x = valid_weights(df, d.weight).where(F.col(y).isNotNull())
    h, i = _strata_psu(d)
    w, yy = F.col(d.weight).cast("double"), F.col(y).cast("double")
    psu = x.groupBy(h.alias("_h"), i.alias("_i")).agg(F.sum(w * yy).alias("_T"), F.sum(w).alias("_W"))
    strata = [r["_h"] for r in psu.groupBy("_h").agg(F.count(F.lit(1)).alias("c")).orderBy("_h").collect()]
    counts = {r["_h"]: r["c"] for r in psu.groupBy("_h").agg(F.count(F.lit(1)).alias("c")).collect()}
    if any(c != 2 for c in counts.values()):
        raise ValueError("BRR/Fay replicates need exactly two PSUs per stratum")
    H = hadamard(len(strata) + 1)
    R = len(H)
    spark = df.sparkSession
    # (stratum, first/second PSU, replicate) multipliers: strata x 2 x R rows
    rows = [(s, side, r + 1, (2 - rho) if H[r][j + 1] * (1 if side == 0 else -1) > 0 else rho)
            for j, s in enumerate(strata) for side in (0, 1) for r in range(R)]
    mult = spark.createDataFrame(rows, "_h string, _side int, rep int, mult double")
    from pyspark.sql import Window
    psu = psu.withColumn("_side", F.row_number().over(Window.partitionBy("_h").orderBy("_i")) - 1)
    th = psu.join(F.broadcast(mult), ["_h", "_side"]).groupBy("rep").agg(
        (F.sum(F.col("mult") * F.col("_T")) / F.sum(F.col("mult") * F.col("_W"))).alias("theta_r"))
    full = psu.agg((F.sum("_T") / F.sum("_W")).alias("mean"))
    j = ranks.attach_scalars(th, full)
    v = j.groupBy().agg(F.first("mean").alias("mean"),
                        (F.sum(F.pow(F.col("theta_r") - F.col("mean"), 2)) / (R * (1 - rho) ** 2)).alias("_v"),
                        F.count(F.lit(1)).alias("R"))
    return v.select("mean", F.sqrt("_v").alias("se"), F.col("R").cast("long"))


# Survey column conventions (first exact match, then
# case-insensitive) for the two household-finance panels.
SURVEY_TEMPLATES = {
    "phf": {"method": "replicate", "weight": ["wgt", "weight", "phf_wgt"],
            "repweights_pattern": "^wr_|^wgt_rep_|^repwgt_", "repdesign_type": "Fay",
            "combined_weights": True, "use_mse": True, "strata": ["wsr", "stratum", "schicht"],
            "psu": ["psu", "cluster", "wsr"], "id": ["hid", "pid", "household_id"], "wave": ["wave", "welle"],
            "implicate": ["implicate", "imp", "imp_id"]},
    "hfcn": {"method": "replicate", "weight": ["hw0001", "weight", "hfcn_weight"],
             "repweights_pattern": "^hw[0-9]{4}$|^hw_rep_|^wgt_rep_", "repdesign_type": "bootstrap",
             "combined_weights": True, "use_mse": True, "strata": ["sa0100", "stratum"],
             "psu": ["sa0010", "psu"], "id": ["id", "hid"], "wave": ["wave"], "implicate": ["implicate", "imp"]},
}


def _first_match(candidates: Sequence[str], names: Sequence[str]) -> str | None:
    for c in candidates:
        if c in names:
            return c
    lower = {n.lower(): n for n in reversed(list(names))}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    return None


def apply_template(columns: Sequence[str], template: str) -> dict:
    """Resolve a template's roles against a schema (metadata only)."""
    import re
    t = SURVEY_TEMPLATES[template]
    roles = {r: _first_match(t[r], columns) for r in ("weight", "strata", "psu", "id", "wave", "implicate")}
    wcol = roles["weight"]
    reps = [c for c in columns if re.search(t["repweights_pattern"], c) and c != wcol]
    return {**roles, "replicate_weights": reps, "method": t["method"], "type": t["repdesign_type"],
            "combined_weights": t["combined_weights"], "use_mse": t["use_mse"]}


def model_features(columns: Sequence[str], target: str, spec: dict, time_col: str | None = None) -> list[str]:
    """Predictors for a survey-weighted model: the weight, design and replicate
    columns leave the feature set (the weight becomes the model weight)."""
    drop = {target, time_col, spec.get("weight"), spec.get("strata"), spec.get("psu"), spec.get("id"),
            spec.get("implicate"), *spec.get("replicate_weights", [])}
    return [c for c in columns if c not in drop]


def rao_scott_test(df: DataFrame, row: str, col: str, d: Design) -> dict:
    """Second-order Rao-Scott test of independence for a weighted two-way
    table.  The design covariance of the cell proportions comes from PSU
    totals of the cell influence values (cells^2 stratum aggregates); the
    generalised design effects are the eigen-structure of
    (C' D^-1 V_srs D^-1 C)^-1 (C' D^-1 V D^-1 C), C = interaction contrasts
    orthogonal to the main effects.  F = X^2 / tr(Delta) on (d0, d0 * df_design)
    degrees of freedom, d0 = tr(Delta)^2 / tr(Delta^2)."""
    import numpy as np
    from ..functions.stats import f_sf
    x = valid_weights(df, d.weight).where(F.col(row).isNotNull() & F.col(col).isNotNull())
    rl = [r[0] for r in x.select(F.col(row).cast("string")).distinct().orderBy(1).collect()]
    cl = [r[0] for r in x.select(F.col(col).cast("string")).distinct().orderBy(1).collect()]
    nr, nc = len(rl), len(cl)
    cells = [(a, b) for b in cl for a in rl]          # row index varies fastest
    h, i = _strata_psu(d)
    w = F.col(d.weight).cast("double")
    ind = [((F.col(row).cast("string") == a) & (F.col(col).cast("string") == b)) for a, b in cells]
    psu = x.groupBy(h.alias("_h"), i.alias("_i")).agg(
        F.sum(w).alias("_B"), *[F.sum(F.when(c, w).otherwise(0.0)).alias(f"_A{k}") for k, c in enumerate(ind)])
    tot = psu.agg(F.sum("_B").alias("W"), F.count(F.lit(1)).alias("npsu"),
                  *[F.sum(f"_A{k}").alias(f"T{k}") for k in range(len(cells))]).first()
    W = tot["W"]
    p = np.array([tot[f"T{k}"] / W for k in range(len(cells))])
    z = [(F.col(f"_A{k}") - F.lit(float(p[k])) * F.col("_B")) / F.lit(W) for k in range(len(cells))]
    st = psu.select("_h", *[zk.alias(f"z{k}") for k, zk in enumerate(z)]).groupBy("_h").agg(
        F.count(F.lit(1)).alias("nh"), *[F.sum(f"z{k}").alias(f"s{k}") for k in range(len(cells))],
        *[F.sum(F.col(f"z{a}") * F.col(f"z{b}")).alias(f"q{a}_{b}") for a in range(len(cells))
          for b in range(a, len(cells))]).collect()
    m = len(cells)
    V = np.zeros((m, m))
    nstrata = 0
    for r in st:
        nstrata += 1
        nh = r["nh"]
        if nh < 2:
            continue
        S = np.array([r[f"s{k}"] for k in range(m)])
        Q = np.zeros((m, m))
        for a in range(m):
            for b in range(a, m):
                Q[a, b] = Q[b, a] = r[f"q{a}_{b}"]
        V += nh / (nh - 1) * (Q - np.outer(S, S) / nh)
    n = x.count()
    # interaction contrasts orthogonal to the intercept and main effects
    rows_idx = np.array([k % nr for k in range(m)])
    cols_idx = np.array([k // nr for k in range(m)])
    X1 = np.column_stack([np.ones(m)] + [(rows_idx == a).astype(float) for a in range(1, nr)]
                         + [(cols_idx == b).astype(float) for b in range(1, nc)])
    X12 = np.column_stack([((rows_idx == a) & (cols_idx == b)).astype(float)
                           for b in range(1, nc) for a in range(1, nr)])
    Cm = X12 - X1 @ np.linalg.lstsq(X1, X12, rcond=None)[0]
    Dinv = np.diag(np.where(p > 0, 1 / np.where(p > 0, p, 1), 0.0))
    Vsrs = (np.diag(p) - np.outer(p, p)) / n
    denom = Cm.T @ Dinv @ Vsrs @ Dinv @ Cm
    numr = Cm.T @ Dinv @ V @ Dinv @ Cm
    Delta = np.linalg.solve(denom, numr)
    tr, tr2 = float(np.trace(Delta)), float(np.trace(Delta @ Delta))
    # Pearson X^2 on the weighted table rescaled to the sample size
    tab = p.reshape(nc, nr).T * n
    e = np.outer(tab.sum(axis=1), tab.sum(axis=0)) / n
    x2 = float(((tab - e) ** 2 / np.where(e > 0, e, 1)).sum())
    d0 = tr * tr / tr2 if tr2 > 0 else float("nan")
    ddf = d0 * (tot["npsu"] - nstrata)
    fstat = x2 / tr if tr > 0 else float("nan")
    return {"chisq": x2, "F": fstat, "ndf": d0, "ddf": ddf, "p_value": f_sf(fstat, d0, ddf), "deff_mean": tr / len(Delta)}
