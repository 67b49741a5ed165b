"""Column profiling, data-health grades, leakage scan, schema summary,
missingness, target distribution and correlations.

All columns are profiled from ONE scan: the table is unpivoted to
``(column, num, str)`` and collapsed to a value-count table (VC).  Every
statistic (missing counts, distinct counts, moments, exact quartiles, outlier
counts) is an aggregate over VC, so the plan holds a single shuffle of the
source that Spark reuses (``ReusedExchange``) for each derived aggregate.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.fmt import c_fixed
from ..functions.types import column as _q
from ..functions.types import kind, r_class


TASK_VALUES = 4_000_000     # values that a task counts; distinct ones stay in its memory


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Unpivot to ``(column, num, str)``: numerics in ``num``, the rest as text."""
    columns = columns or df.columns
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    items = []
    for c in columns:
        num = _q(c).cast("double") if k[c] == "numeric" else F.lit(None).cast("double")
        txt = F.lit(None).cast("string") if k[c] == "numeric" else _q(c).cast("string")
        items.append(F.struct(F.lit(c).alias("column"), num.alias("num"), txt.alias("str")))
    return df.select(F.inline(F.array(*items)))


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, num, str, cnt)``: one row per distinct value (and one for NULL)."""
    return long_values(df, columns).groupBy("column", "num", "str").agg(F.count(F.lit(1)).alias("cnt"))


def _missing(c_num: Column, c_str: Column) -> Column:
    return c_num.isNull() & c_str.isNull()


def profile_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: class, n_missing, pct_missing, n_unique, is_numeric,
    skew (sample-sd form), n_outliers (1.5 IQR, type-7 quartiles), constant /
    quasi-constant / id-like flags, severity and finding text."""
    spark = df.sparkSession
    columns = columns or df.columns
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    meta = spark.createDataFrame(
        [(c, r_class(dtypes[c]), kind(dtypes[c]) == "numeric", i) for i, c in enumerate(columns)],
        "column string, class string, is_numeric boolean, ord int")
    # one scan + shuffle builds the value-count table; it is checkpointed to the
    # shared checkpoint folder so every statistic below reads it instead of
    # re-scanning the source (lineage is cut; survives executor loss)
    x = ranks.ensure_parallelism(df.select(*[_q(c) for c in columns]), max(1, TASK_VALUES // max(1, len(columns))))
    vc = ranks.materialize(value_counts(x, columns))
    miss = _missing(F.col("num"), F.col("str"))
    base = vc.groupBy("column").agg(
        F.sum("cnt").alias("n"),
        F.coalesce(F.sum(F.when(miss, F.col("cnt"))), F.lit(0)).alias("n_missing"),
        F.count(F.when(~miss, F.lit(1))).alias("n_unique"),
        F.sum(F.col("cnt") * F.col("num")).alias("_s1"),
        F.sum(F.when(F.col("num").isNotNull(), F.col("cnt"))).alias("_nn"))
    base = base.withColumn("_mean", F.col("_s1") / F.col("_nn"))
    num_vc = vc.where(F.col("num").isNotNull()).select("column", "num", "cnt")
    cm = num_vc.join(F.broadcast(base.select("column", "_mean")), "column").groupBy("column").agg(
        F.sum(F.col("cnt") * F.pow(F.col("num") - F.col("_mean"), 2)).alias("_m2"),
        F.sum(F.col("cnt") * F.pow(F.col("num") - F.col("_mean"), 3)).alias("_m3"))
    qdf = ranks.quantiles_from_counts(num_vc, ["column"], "num", "cnt", [0.25, 0.75])
    quart = ranks.quantile_map(qdf, ["column"], {0.25: "_q1", 0.75: "_q3"})
    bounds = quart.select("column", (F.col("_q1") - 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_lo"),
                          (F.col("_q3") + 1.5 * (F.col("_q3") - F.col("_q1"))).alias("_hi"))
    outl = num_vc.join(F.broadcast(bounds), "column").groupBy("column").agg(
        F.coalesce(F.sum(F.when((F.col("num") < F.col("_lo")) | (F.col("num") > F.col("_hi")),
                                F.col("cnt"))), F.lit(0)).alias("_out"))
    p = (F.broadcast(meta).join(base, "column", "left").join(cm, "column", "left")
         .join(outl, "column", "left"))
    n, nm, nu = F.col("n"), F.col("n_missing"), F.col("n_unique")
    sd = F.sqrt(F.col("_m2") / (F.col("_nn") - 1))
    skew = F.when(F.col("is_numeric") & (nu > 2) & (sd > 0),
                  (F.col("_m3") / F.col("_nn")) / F.pow(sd, 3))
    p = p.select("ord", "column", "class", nm.cast("long").alias("n_missing"),
                 F.round(100 * nm / n, 2).alias("pct_missing"), nu.cast("long").alias("n_unique"),
                 "is_numeric", F.round(skew, 3).alias("skew"),
                 F.when(F.col("is_numeric") & (nu > 4), F.col("_out")).cast("long").alias("n_outliers"),
                 (nu <= 1).alias("is_constant"),
                 ((nu > 1) & (nu < F.greatest(F.lit(2.0), F.ceil(0.005 * n)))).alias("is_quasi_const"),
                 ((nu == n - nm) & ~F.col("is_numeric")).alias("is_id_like"),
                 (nm / n).alias("_mr"), skew.alias("_skew"), n.alias("_n"))
    return add_severity(p).drop("_mr", "_skew", "_n").orderBy("ord").drop("ord")


def add_severity(p: DataFrame) -> DataFrame:
    """Severity (CRITICAL/WARN/OK) and the '; '-joined finding text."""
    mr, sk = F.col("_mr"), F.col("_skew")
    big_skew = F.col("is_numeric") & sk.isNotNull() & (F.abs(sk) > 1.5)
    sev = (F.when(F.col("is_constant"), "CRITICAL").when(mr > 0.6, "CRITICAL")
           .when(F.col("is_id_like") | F.col("is_quasi_const"), "WARN")
           .when(mr > 0.2, "WARN").when(big_skew, "WARN").otherwise("OK"))
    parts = F.concat_ws("; ", F.array_compact(F.array(
        F.when(F.col("is_constant"), F.lit("Zero variance - drop")),
        F.when(F.col("is_quasi_const"), F.lit("Quasi-constant - likely drop")),
        F.when(F.col("is_id_like"), F.lit("ID-like - drop or hash")),
        F.when(mr > 0.2, F.concat(c_fixed(100 * mr, 0), F.lit("% missing"))),
        F.when(big_skew, F.concat(F.lit("skew="), c_fixed(sk, 2), F.lit(" - power transform"))),
        F.when(F.col("is_numeric") & F.col("n_outliers").isNotNull() & (F.col("n_outliers") > 0.05 * F.col("_n")),
               F.format_string("%d outliers (IQR)", F.col("n_outliers"))))))
    return p.withColumn("severity", sev).withColumn(
        "finding", F.when(parts == "", F.lit("Healthy")).otherwise(parts))


def health_grade(profile: DataFrame) -> DataFrame:
    """FAIL if any CRITICAL; WEAK if more WARN than OK; else PASS; overall missing %."""
    a = profile.agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
        F.count_if(F.col("severity") == "WARN").alias("n_warn"),
        F.count_if(F.col("severity") == "OK").alias("n_ok"),
        F.avg("pct_missing").alias("overall_missing_pct"))
    grade = (F.when(F.col("n_critical") > 0, "FAIL").when(F.col("n_warn") > F.col("n_ok"), "WEAK")
             .otherwise("PASS"))
    return a.select(grade.alias("grade"), F.col("n_critical").cast("long"), F.col("n_warn").cast("long"),
                    F.col("n_ok").cast("long"), F.round("overall_missing_pct", 2).alias("overall_missing_pct"))


def leakage_numeric(df: DataFrame, target: str, columns: list[str] | None = None,
                    threshold: float = 0.99) -> DataFrame:
    """Numeric predictors with |pearson r| > threshold over > 5 complete pairs (one agg)."""
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    cols = [c for c in (columns or df.columns) if c != target and k[c] == "numeric"]
    aggs = []
    for c in cols:
        ok = _q(c).isNotNull() & _q(target).isNotNull()
        aggs += [F.corr(_q(c).cast("double"), _q(target).cast("double")).alias(f"r__{c}"),
                 F.count_if(ok).alias(f"n__{c}")]
    wide = df.agg(*aggs)
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"r__{c}").alias("r"),
                                                   F.col(f"n__{c}").alias("n_pairs")) for c in cols])))
    hit = long.where((F.col("n_pairs") > 5) & F.col("r").isNotNull() & (F.abs("r") > threshold))
    return hit.select("column", F.concat(F.lit("|cor|="), c_fixed(F.col("r"), 4)).alias("relation"),
                      F.lit("near-perfect correlation").alias("risk"))


def leakage_ratios(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """(column, relation, risk, ratio) for every categorical column, ratio =
    (var(group means) * k / n) / var(y) — the reference's formula kept as is.
    Each column costs one grouped aggregate; the per-level table is small."""
    tot = df.agg(F.var_samp(_q(target)).alias("_tv"), F.count(F.lit(1)).alias("_n"))
    out = None
    for c in columns:
        g = df.where(_q(c).isNotNull()).groupBy(_q(c).alias("_lvl")).agg(F.avg(target).alias("_gm"))
        s = g.agg(F.var_samp("_gm").alias("_bv"), F.count(F.lit(1)).alias("_k"))
        r = ranks.attach_scalars(s, tot).select(
            F.lit(c).alias("column"),
            F.when(F.col("_tv").isNotNull() & (F.col("_tv") > 0),
                   F.try_divide(F.col("_bv") * F.col("_k") / F.col("_n"), F.col("_tv"))).otherwise(F.lit(0.0)).alias("ratio"))
        out = r if out is None else out.unionByName(r)
    return out.select("column", F.concat(F.lit("between/total var="), c_fixed(F.col("ratio"), 3)).alias("relation"),
                      F.lit("groups explain ~all variance").alias("risk"), "ratio")


def leakage_categorical(df: DataFrame, target: str, columns: list[str],
                        threshold: float = 0.99) -> DataFrame:
    """Columns whose ratio exceeds ``threshold``."""
    r = leakage_ratios(df, target, columns)
    return r.where(F.col("ratio").isNotNull() & (F.col("ratio") > threshold)).drop("ratio")


def schema_summary(df: DataFrame, columns: list[str] | None = None, n_samples: int = 3) -> DataFrame:
    """column, type, n_missing, n_unique (NULL counted as a value), and the
    ``n_samples`` smallest distinct values joined by ', '."""
    spark = df.sparkSession
    columns = columns or df.columns
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    meta = spark.createDataFrame([(c, r_class(dtypes[c]).split("/")[0], i) for i, c in enumerate(columns)],
                                 "column string, type string, ord int")
    vc = value_counts(df, columns).withColumn("_txt", F.coalesce(
        F.col("str"), F.col("num").cast("string")))
    miss = _missing(F.col("num"), F.col("str"))
    agg = vc.groupBy("column").agg(F.coalesce(F.sum(F.when(miss, F.col("cnt"))), F.lit(0)).cast("long").alias("n_missing"),
                                   F.count(F.lit(1)).cast("long").alias("n_unique"))
    present = vc.where(~miss)
    top = ranks.top_k_per_group(present.select("column", "num", "str", "_txt"), ["column"],
                                [F.col("num").asc_nulls_last(), F.col("str").asc_nulls_last()], n_samples)
    samples = top.groupBy("column").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("_rank", "_txt"))), lambda s: s["_txt"]), ", ").alias("sample"))
    return (F.broadcast(meta).join(agg, "column", "left").join(samples, "column", "left")
            .orderBy("ord").drop("ord"))


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """% missing per column, descending (one agg over the source)."""
    columns = columns or df.columns
    w = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(_q(c)).alias(f"c__{i}") for i, c in enumerate(columns)])
    long = w.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"),
                                                (100.0 * (F.col("_n") - F.col(f"c__{i}")) / F.col("_n")).alias("pct"))
                                       for i, c in enumerate(columns)])))
    return long.select("column", F.round("pct", 4).alias("pct_missing")).orderBy(F.desc("pct_missing"), "column")


def target_histogram(df: DataFrame, target: str, bins: int = 30) -> DataFrame:
    """Equal-width histogram of a numeric target: bin id 1..bins, bounds, count."""
    r = df.agg(F.min(target).alias("_lo"), F.max(target).alias("_hi"))
    x = ranks.attach_scalars(df.select(_q(target)).where(_q(target).isNotNull()), r)
    wdt = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(1)).otherwise(
        F.least(F.lit(bins), F.floor((_q(target) - F.col("_lo")) / wdt).cast("int") + 1))
    g = x.groupBy(b.alias("bin"), "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", (F.col("_lo") + (F.col("bin") - 1) * (F.col("_hi") - F.col("_lo")) / bins).alias("lower"),
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("upper"),
                    F.col("n").cast("long").alias("n")).orderBy("bin")


def target_counts(df: DataFrame, target: str) -> DataFrame:
    return (df.where(_q(target).isNotNull()).groupBy(_q(target).cast("string").alias("level"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("level"))


def correlation_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Numeric and logical columns; constant / all-NULL ones are dropped later by the agg."""
    k = {f.name: kind(f.dataType) for f in df.schema.fields}
    return [c for c in (columns or df.columns) if k[c] in ("numeric", "logical")]


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation for every pair of usable columns
    (sd > 0 over >= 2 values), long form ``(var1, var2, cor)`` upper triangle.
    One aggregate over the source computes every pair."""
    cols = correlation_columns(df, columns)
    x = df.select(*[_q(c).cast("double").alias(c) for c in cols])
    sds = [F.stddev_samp(c).alias(f"sd__{i}") for i, c in enumerate(cols)]
    prs = [F.corr(_q(a), _q(b)).alias(f"r__{i}__{j}") for (i, a), (j, b) in combinations(list(enumerate(cols)), 2)]
    wide = x.agg(*sds, *prs)
    items = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), F.col(f"r__{i}__{j}").alias("cor"),
                      (F.coalesce(F.col(f"sd__{i}"), F.lit(0.0)) > 0).alias("_ok1"),
                      (F.coalesce(F.col(f"sd__{j}"), F.lit(0.0)) > 0).alias("_ok2"))
             for (i, a), (j, b) in combinations(list(enumerate(cols)), 2)]
    long = wide.select(F.inline(F.array(*items)))
    return long.where(F.col("_ok1") & F.col("_ok2") & F.col("cor").isNotNull()).select("var1", "var2", "cor")


def correlation_spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Spearman = Pearson of average ranks over each pair's complete rows.
    Without NULLs every pair's complete rows are all rows, so each column is
    ranked once (value -> average-rank table from bucketed cumulative counts)
    and joined back by value; the pair correlations are then one aggregate.
    With NULLs the ranks are computed per pair over its complete rows."""
    cols = correlation_columns(df, columns)
    pairs = list(combinations(cols, 2))
    seen = df.agg(F.count_if(F.greatest(*[_q(c).isNull() for c in cols]) if len(cols) > 1 else _q(cols[0]).isNull()),
                  *[F.stddev_samp(_q(c).cast("double")) for c in cols]).first()
    has_null, sd_ok = seen[0] > 0, dict(zip(cols, seen[1:]))
    good = {c for c in cols if (sd_ok[c] or 0.0) > 0}
    if not has_null:
        long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("double").alias("x"))
                                            for c in cols])))
        vc = ranks.value_weights(long, ["column"], "x")
        cum = ranks.with_cumulative(vc, ["column"], "value", "w")
        rk = cum.select("column", "value", (F.col("cum_before") + (F.col("w") + 1) / 2.0).alias("r"))
        x = df.select(*[_q(c).cast("double").alias(c) for c in cols])
        for c in cols:
            x = x.join(rk.where(F.col("column") == c).select(F.col("value").alias(c), F.col("r").alias(f"_r_{c}")), c)
        wide = x.agg(*[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}__{b}") for a, b in pairs])
        long_r = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                                         F.col(f"{a}__{b}").alias("cor")) for a, b in pairs])))
    else:
        items = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), _q(a).cast("double").alias("x"),
                          _q(b).cast("double").alias("y")) for a, b in pairs]
        long = df.select(F.inline(F.array(*items))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
        rx = ranks.average_ranks(long, ["var1", "var2"], "x", "rx")
        rxy = ranks.average_ranks(rx, ["var1", "var2"], "y", "ry")
        long_r = rxy.groupBy("var1", "var2").agg(F.corr("rx", "ry").alias("cor"))
    ok = F.col("var1").isin(list(good)) & F.col("var2").isin(list(good))
    return long_r.where(ok & F.col("cor").isNotNull()).select("var1", "var2", "cor")


def correlation_kendall(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(var1, var2, cor): Kendall's tau-b over the complete rows of every pair.

    Concordant pairs are a two-dimensional dominance count: rows with a smaller x and a
    smaller y.  y becomes an integer rank; two rows differ in y at exactly one level, the
    highest bit in which their ranks differ, and share all bits above it.  So each
    row goes to one group per bit (log2(rows) copies, no pair of rows is ever formed); in
    a group, every x with the bit set counts the rows of smaller x without it, by the bucketed
    running totals of ``ranks``.  Ties follow from the sizes of equal values."""
    cols = correlation_columns(df, columns)
    items = [F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"), _q(a).cast("double").alias("x"),
                      _q(b).cast("double").alias("y")) for a, b in combinations(cols, 2)]
    pair = ["var1", "var2"]
    vc = ranks.materialize(df.select(F.inline(F.array(*items))).where("x IS NOT NULL AND y IS NOT NULL").groupBy(
        *pair, "x", "y").agg(F.count(F.lit(1)).alias("n")))
    twice = lambda by: vc.groupBy(*pair, *by).agg(F.sum("n").cast("double").alias("t")).groupBy(*pair).agg(
        (F.sum(F.col("t") * (F.col("t") - 1)) / 2).alias("n" + "".join(by)))
    sums = twice([]).join(twice(["x"]), pair).join(twice(["y"]), pair).join(twice(["x", "y"]), pair)
    top = vc.groupBy(*pair).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    levels = max(1, int(top).bit_length())
    ys = ranks.with_cumulative(vc.groupBy(*pair, F.col("y").alias("value")).agg(F.sum("n").alias("w")), pair,
                               "value", "w", "rank").select(*pair, F.col("value").alias("y"), "rank")
    bits = vc.join(ys, [*pair, "y"]).withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    bits = bits.withColumn("above", F.expr("shiftright(rank, bit + 1)")).withColumn(
        "set", F.expr("shiftright(rank, bit) & 1"))
    side = bits.groupBy(*pair, "bit", "above", F.col("x").alias("value")).agg(
        F.sum(F.when(F.col("set") == 0, F.col("n")).otherwise(0)).alias("w"),
        F.sum(F.when(F.col("set") == 1, F.col("n")).otherwise(0)).alias("above_w"))
    met = ranks.with_cumulative(side, [*pair, "bit", "above"], "value", "w")
    c = met.groupBy(*pair).agg(F.sum(F.col("above_w").cast("double") * F.col("cum_before")).alias("c"))
    x = sums.join(c, pair)
    gap = F.expr("2 * c - (n - nx - ny + nxy)")
    room = F.expr("(n - nx) * (n - ny)")
    return x.where(room > 0).select(*pair, (gap / F.sqrt(room)).alias("cor"))


def top_correlated_pairs(pairs: DataFrame, top_n: int = 20) -> DataFrame:
    """cor and abs_cor rounded to 4 dp, sorted by abs desc, first ``top_n``."""
    r = pairs.select("var1", "var2", F.round("cor", 4).alias("cor"), F.round(F.abs("cor"), 4).alias("abs_cor"))
    return r.orderBy(F.desc("abs_cor"), "var1", "var2").limit(top_n)


def _labels(df: DataFrame, c: str) -> tuple[str, dict]:
    md = df.schema[c].metadata or {}
    return str(md.get("label", "") or ""), dict(md.get("value_labels") or {})


def codebook_basic(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """variable, label, class, n_missing, pct_missing, n_unique, value_labels
    ("code=label; ..." from the schema metadata); one value-count pass."""
    spark = df.sparkSession
    columns = columns or df.columns
    meta = spark.createDataFrame(
        [(c, _labels(df, c)[0], r_class(df.schema[c].dataType), i,
          "; ".join(f"{k}={v}" for k, v in _labels(df, c)[1].items())) for i, c in enumerate(columns)],
        "variable string, label string, class string, ord int, value_labels string")
    vc = value_counts(df, columns)
    miss = _missing(F.col("num"), F.col("str"))
    a = vc.groupBy(F.col("column").alias("variable")).agg(
        F.coalesce(F.sum(F.when(miss, F.col("cnt"))), F.lit(0)).cast("long").alias("n_missing"),
        F.sum("cnt").alias("_n"), F.count(F.when(~miss, F.lit(1))).cast("long").alias("n_unique"))
    out = F.broadcast(meta).join(a, "variable", "left")
    return out.select("variable", "label", "class", "n_missing",
                      F.round(100.0 * F.col("n_missing") / F.greatest(F.col("_n"), F.lit(1)), 2).alias("pct_missing"),
                      "n_unique", "value_labels", "ord").orderBy("ord").drop("ord")


def codebook_rich(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """name, type bucket, label, value labels, pct_missing, n_unique, sample
    (3 smallest distinct values joined ' | ', cut at 80 characters) and a
    summary: numeric five-number summary in %g, or the top-3 'level=count'."""
    from ..functions.fmt import c_general
    spark = df.sparkSession
    columns = columns or df.columns
    bucket = {"numeric": "numeric", "logical": "logical", "date": "date", "timestamp": "datetime",
              "string": "character"}
    rows = []
    for i, c in enumerate(columns):
        lab, vl = _labels(df, c)
        k = kind(df.schema[c].dataType)
        rows.append((c, "labelled" if vl else bucket.get(k, k), lab, len(vl),
                     "; ".join(f"{a} = {b}" for a, b in vl.items()), i, k == "numeric"))
    meta = spark.createDataFrame(rows, "name string, type string, label string, n_value_labels int, "
                                       "value_labels_str string, ord int, _isnum boolean")
    vc = ranks.materialize(value_counts(df, columns))
    miss = _missing(F.col("num"), F.col("str"))
    a = vc.groupBy(F.col("column").alias("name")).agg(
        F.round(100.0 * F.coalesce(F.sum(F.when(miss, F.col("cnt"))), F.lit(0)) / F.sum("cnt"), 2).alias("pct_missing"),
        F.count(F.when(~miss, F.lit(1))).cast("int").alias("n_unique"))
    present = vc.where(~miss)
    # pick the 3 values first, format only those
    top = ranks.top_k_per_group(present.select("column", "num", "str"), ["column"],
                                [F.col("num").asc_nulls_last(), F.col("str").asc_nulls_last()], 3)
    top = top.withColumn("_txt", F.coalesce(F.col("str"), c_general(F.col("num"))))
    samp = top.groupBy(F.col("column").alias("name")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", "_txt"))), lambda s: s["_txt"]), " | ").alias("_s"))
    samp = samp.select("name", F.when(F.length("_s") > 80, F.concat(F.substring("_s", 1, 77), F.lit("...")))
                       .otherwise(F.col("_s")).alias("sample"))
    nums = present.where(F.col("num").isNotNull())
    q = ranks.quantile_map(ranks.quantiles_from_counts(nums, ["column"], "num", "cnt", [0.0, 0.25, 0.5, 0.75, 1.0]),
                           ["column"], {0.0: "q0", 0.25: "q1", 0.5: "q2", 0.75: "q3", 1.0: "q4"})
    numsum = q.select(F.col("column").alias("name"), F.concat(
        F.lit("min="), c_general(F.col("q0")), F.lit(" · Q25="), c_general(F.col("q1")), F.lit(" · med="),
        c_general(F.col("q2")), F.lit(" · Q75="), c_general(F.col("q3")), F.lit(" · max="), c_general(F.col("q4"))
    ).alias("_num_summary"))
    cats = present.where(F.col("str").isNotNull())
    t3 = ranks.top_k_per_group(cats.select("column", "str", "cnt"), ["column"], [F.desc("cnt"), F.asc("str")], 3)
    catsum = t3.groupBy(F.col("column").alias("name")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", F.concat(F.col("str"), F.lit("="), F.col("cnt").cast("string")).alias("t")))),
        lambda s: s["t"]), "; ").alias("_cat_summary"))
    out = (F.broadcast(meta).join(a, "name", "left").join(samp, "name", "left")
           .join(numsum, "name", "left").join(catsum, "name", "left"))
    summ = F.when(F.col("_isnum"), F.coalesce(F.col("_num_summary"), F.lit(""))).when(
        F.col("type") == "character", F.coalesce(F.col("_cat_summary"), F.lit(""))).otherwise(F.lit(""))
    return out.select("name", "type", "label", "n_value_labels", "value_labels_str", "pct_missing", "n_unique",
                      F.coalesce(F.col("sample"), F.lit("")).alias("sample"), summ.alias("summary"),
                      "ord").orderBy("ord").drop("ord")
