"""Survey, replicate-variance, panel and multiple-imputation queries on orders
with a derived design (weight, stratum = priority, PSU = customer mod 20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import t_ppf
from ..operators import mi, survey
from ..operators.survey import Design
from ..session import table
from .catalog import query, rounded

SURVEY_SQL = """SELECT o_orderkey, o_custkey, o_totalprice / 1000.0 AS y, CAST(o_custkey % 13 + 1 AS DOUBLE) AS x,
       CAST(5 + o_orderkey % 16 AS DOUBLE) / 10.0 AS w, o_orderpriority AS stratum, o_custkey % 20 AS psu,
       o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS wave, 1 + o_orderkey % 5 AS likert
FROM orders"""

D = Design("w", "stratum", "psu")


def survey_input(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_custkey", (F.col("o_totalprice") / 1000.0).alias("y"),
                    (F.col("o_custkey") % 13 + 1).cast("double").alias("x"),
                    ((5 + F.col("o_orderkey") % 16).cast("double") / 10.0).alias("w"),
                    F.col("o_orderpriority").alias("stratum"), (F.col("o_custkey") % 20).alias("psu"),
                    "o_orderstatus", F.year("o_orderdate").alias("wave"), (1 + F.col("o_orderkey") % 5).alias("likert"))


def _taylor_sql(zexpr: str, est_cte: str, est_cols: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    on = f"USING ({group})" if group else "ON true"
    return f"""{est_cte},
z AS (SELECT {g}stratum, psu, {zexpr} AS z FROM s JOIN t {on}),
p AS (SELECT {g}stratum, psu, sum(z) AS z FROM z GROUP BY ALL),
h AS (SELECT {g}stratum, count(*) AS nh, sum(z) AS sz, sum(z * z) AS qz FROM p GROUP BY ALL),
v AS (SELECT {g}sum(CASE WHEN nh > 1 THEN nh / (nh - 1) * (qz - sz * sz / nh) END) AS var,
             count_if(nh = 1) AS n_single FROM h {gb})
SELECT {g}{est_cols}, CASE WHEN n_single = 0 THEN sqrt(var) END AS se, CAST(n AS BIGINT) AS n,
       CAST(n_single AS BIGINT) AS n_single FROM t JOIN v {on}"""


MEAN_SQL = f"WITH s AS ({SURVEY_SQL}), " + _taylor_sql(
    "w * (y - mean) / sw", "t AS (SELECT sum(w * y) / sum(w) AS mean, sum(w) AS sw, count(*) AS n FROM s)", "mean")


@query("survey_mean_taylor", f"WITH r AS ({MEAN_SQL}) SELECT round(mean, 6) AS mean, round(se, 6) AS se, n, n_single FROM r")
def q_survey_mean(spark, sf):
    return rounded(survey.survey_mean(survey_input(spark, sf), "y", D))


@query("survey_total_taylor", "WITH r AS (" + f"WITH s AS ({SURVEY_SQL}), " + _taylor_sql(
    "w * y", "t AS (SELECT sum(w * y) AS total, count(*) AS n FROM s)", "total")
       + ") SELECT round(total, 4) AS total, round(se, 4) AS se, n, n_single FROM r")
def q_survey_total(spark, sf):
    return rounded(survey.survey_total(survey_input(spark, sf), "y", D), 4)


@query("survey_ratio", "WITH r AS (" + f"WITH s AS ({SURVEY_SQL}), " + _taylor_sql(
    "w * (y - ratio * x) / sx", "t AS (SELECT sum(w * y) / sum(w * x) AS ratio, sum(w * x) AS sx, count(*) AS n FROM s)",
    "ratio") + ") SELECT round(ratio, 6) AS ratio, round(se, 6) AS se, n, n_single FROM r")
def q_survey_ratio(spark, sf):
    return rounded(survey.survey_ratio(survey_input(spark, sf), "y", "x", D))


@query("survey_mean_by_domain", "WITH r AS (" + f"WITH s AS ({SURVEY_SQL}), " + _taylor_sql(
    "w * (y - mean) / sw", "t AS (SELECT o_orderstatus, sum(w * y) / sum(w) AS mean, sum(w) AS sw, count(*) AS n FROM s GROUP BY 1)",
    "mean", "o_orderstatus") + ") SELECT o_orderstatus, round(mean, 6) AS mean, round(se, 6) AS se, n, n_single FROM r")
def q_survey_mean_by_domain(spark, sf):
    return rounded(survey.survey_mean(survey_input(spark, sf), "y", D, ["o_orderstatus"]))


@query("survey_proportion", f"""WITH s AS ({SURVEY_SQL}),
lv AS (SELECT DISTINCT o_orderstatus AS level FROM s),
tw AS (SELECT sum(w) AS TW FROM s),
pl AS (SELECT level, sum(CASE WHEN o_orderstatus = level THEN w ELSE 0 END) / any_value(TW) AS p FROM s, lv, tw GROUP BY 1),
z AS (SELECT level, stratum, psu, (CASE WHEN o_orderstatus = level THEN w ELSE 0 END - p * w) / TW AS z FROM s, pl, tw),
pz AS (SELECT level, stratum, psu, sum(z) AS z FROM z GROUP BY ALL),
h AS (SELECT level, stratum, count(*) AS nh, sum(z) AS sz, sum(z * z) AS qz FROM pz GROUP BY ALL),
v AS (SELECT level, sum(CASE WHEN nh > 1 THEN nh / (nh - 1) * (qz - sz * sz / nh) END) AS var,
             count_if(nh = 1) AS ns FROM h GROUP BY 1)
SELECT level, round(p, 6) AS proportion, round(CASE WHEN ns = 0 THEN sqrt(var) END, 6) AS se, CAST(ns AS BIGINT) AS n_single
FROM pl JOIN v USING (level)""")
def q_survey_proportion(spark, sf):
    return rounded(survey.survey_proportion(survey_input(spark, sf), "o_orderstatus", D))


@query("survey_quantile", f"""WITH s AS ({SURVEY_SQL}),
v AS (SELECT y AS value, sum(w) AS w FROM s GROUP BY 1),
c AS (SELECT value, w, sum(w) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER () AS tot FROM v),
f AS (SELECT value, cum / tot AS F, (cum - w) / tot AS Fb FROM c),
p AS (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS p)
SELECT p, round(min(value), 6) AS quantile FROM f, p WHERE F >= p - 1e-12 AND Fb < p - 1e-12 GROUP BY p""")
def q_survey_quantile(spark, sf):
    return rounded(survey.survey_quantile(survey_input(spark, sf), "y", D))


@query("unweighted_summary", f"""WITH s AS ({SURVEY_SQL})
SELECT o_orderstatus, count(*) AS n, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS sd, round(min(y), 6) AS min,
       round(max(y), 6) AS max, round(quantile_cont(y, 0.5), 6) AS median FROM s GROUP BY 1""")
def q_unweighted_summary(spark, sf):
    return rounded(survey.unweighted_summary(survey_input(spark, sf), "y", ["o_orderstatus"]))


@query("filter_valid_weight", f"""WITH s AS ({SURVEY_SQL}),
t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN -w
                             WHEN o_orderkey % 9 = 2 THEN 0.0 ELSE w END AS w FROM s)
SELECT o_orderkey, w FROM t WHERE w IS NOT NULL AND NOT isnan(w) AND w > 0 AND w < 'Infinity'::DOUBLE""")
def q_filter_valid_weight(spark, sf):
    s = survey_input(spark, sf)
    k = F.col("o_orderkey")
    t = s.select("o_orderkey", F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, -F.col("w"))
                 .when(k % 9 == 2, F.lit(0.0)).otherwise(F.col("w")).alias("w"))
    return survey.valid_weights(t, "w")


JK1_SQL = f"""WITH s AS ({SURVEY_SQL}),
r AS (SELECT r, sum(CASE WHEN psu = r - 1 THEN 0.0 ELSE w * 20.0 / 19.0 END * y)
                / sum(CASE WHEN psu = r - 1 THEN 0.0 ELSE w * 20.0 / 19.0 END) AS th
      FROM s, range(1, 21) AS t(r) GROUP BY r),
f AS (SELECT sum(w * y) / sum(w) AS mean, count(*) AS n FROM s)"""


@query("replicate_design_jk1", JK1_SQL + """
SELECT round(mean, 6) AS mean, round(sqrt(19.0 / 20.0 * sum((th - mean) * (th - mean))), 6) AS se, CAST(n AS BIGINT) AS n
FROM r, f GROUP BY mean, n""")
def q_replicate_design(spark, sf):
    s = survey_input(spark, sf)
    wr = survey.jk1_replicate_weights(s, "w", F.col("psu"), 20)
    return rounded(survey.replicate_mean(wr, "y", "w", [f"wr_{i}" for i in range(1, 21)], "JK1"))


@query("replicate_design_jkn", f"""WITH s AS ({SURVEY_SQL}),
p AS (SELECT psu, psu % 4 AS h, sum(w * y) AS t, sum(w) AS ww FROM s WHERE w > 0 AND y IS NOT NULL GROUP BY 1, 2),
hh AS (SELECT h, sum(t) AS th, sum(ww) AS wh, count(*) AS k FROM p GROUP BY 1),
a AS (SELECT sum(t) AS ta, sum(ww) AS wa FROM p),
n AS (SELECT count(*) AS n FROM s WHERE w > 0 AND y IS NOT NULL),
r AS (SELECT (k - 1.0) / k AS c, (ta - th + k / (k - 1.0) * (th - t)) / (wa - wh + k / (k - 1.0) * (wh - ww)) - ta / wa AS d
      FROM p JOIN hh USING (h), a)
SELECT round(any_value(ta / wa), 6) AS mean, round(sqrt(sum(c * d * d)), 6) AS se, CAST(any_value(n) AS BIGINT) AS n FROM r, a, n""")
def q_replicate_design_jkn(spark, sf):
    """Four strata of five PSUs, one deleted per replicate."""
    s = survey_input(spark, sf)
    of = {h: [p for p in range(20) if p % 4 == h] for h in range(4)}
    wr, scales = survey.jkn_replicate_weights(s, "w", F.col("psu") % 4, F.col("psu"), of)
    return rounded(survey.replicate_mean(wr, "y", "w", [f"wr_{i + 1}" for i in range(20)], "JKn", rscales=scales))


_JK1 = ", ".join(f"round(CASE WHEN psu = {i} THEN 0.0 ELSE w * 20.0 / 19.0 END, 10) AS wr_{i + 1}" for i in range(20))


@query("make_replicates_jk1", f"""WITH s AS ({SURVEY_SQL})
SELECT o_orderkey, {_JK1} FROM s""")
def q_make_replicates_jk1(spark, sf):
    wr = survey.jk1_replicate_weights(survey_input(spark, sf), "w", F.col("psu"), 20)
    return rounded(wr.select("o_orderkey", *[f"wr_{i}" for i in range(1, 21)]), 10)


@query("replicate_bootstrap")
def q_replicate_bootstrap(spark, sf):
    return rounded(survey.bootstrap_mean(survey_input(spark, sf), "y", D, 200, 42))


@query("crosstab_unweighted", f"""WITH s AS ({SURVEY_SQL}),
c AS (SELECT stratum AS "row", o_orderstatus AS col, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY 1, 2),
r AS (SELECT "row", sum(n) AS rt FROM c GROUP BY 1), k AS (SELECT col, sum(n) AS ct FROM c GROUP BY 1),
t AS (SELECT sum(n) AS tt FROM c)
SELECT "row", col, n, round(n / tt, 6) AS share, round(rt * ct / tt, 6) AS expected
FROM c JOIN r USING ("row") JOIN k USING (col), t""")
def q_crosstab_unweighted(spark, sf):
    return rounded(survey.crosstab(survey_input(spark, sf), "stratum", "o_orderstatus"))


@query("crosstab_chisq", f"""WITH s AS ({SURVEY_SQL}),
c AS (SELECT stratum AS "row", o_orderstatus AS col, CAST(count(*) AS DOUBLE) AS n FROM s GROUP BY 1, 2),
r AS (SELECT "row", sum(n) AS rt FROM c GROUP BY 1), k AS (SELECT col, sum(n) AS ct FROM c GROUP BY 1),
t AS (SELECT sum(n) AS tt FROM c),
e AS (SELECT "row", col, n, rt * ct / tt AS ex FROM c JOIN r USING ("row") JOIN k USING (col), t),
x AS (SELECT sum((n - ex) * (n - ex) / ex) AS s, CAST((count(DISTINCT "row") - 1) * (count(DISTINCT col) - 1) AS BIGINT) AS df
      FROM e)
-- upper tail of chi-square for an even number of degrees of freedom
SELECT round(s, 6) AS statistic, df, round(exp(-s / 2) * list_sum(list_transform(range(df // 2),
       lambda k: pow(s / 2, k) / gamma(k + 1))), 6) AS p_value FROM x""")
def q_crosstab_chisq(spark, sf):
    return rounded(survey.chisq_statistic(survey.crosstab(survey_input(spark, sf), "stratum", "o_orderstatus")))


@query("survey_crosstab", f"""WITH s AS ({SURVEY_SQL}),
c AS (SELECT stratum AS "row", o_orderstatus AS col, sum(w) AS n FROM s GROUP BY 1, 2),
r AS (SELECT "row", sum(n) AS rt FROM c GROUP BY 1), k AS (SELECT col, sum(n) AS ct FROM c GROUP BY 1),
t AS (SELECT sum(n) AS tt FROM c)
SELECT "row", col, round(n, 6) AS n, round(n / tt, 6) AS share, round(rt * ct / tt, 6) AS expected
FROM c JOIN r USING ("row") JOIN k USING (col), t""")
def q_survey_crosstab(spark, sf):
    return rounded(survey.crosstab(survey_input(spark, sf), "stratum", "o_orderstatus", "w"))


@query("panel_summary", f"""WITH s AS ({SURVEY_SQL}),
u AS (SELECT o_custkey, count(*) AS obs FROM s GROUP BY 1),
nw AS (SELECT count(DISTINCT wave) AS n_waves FROM s),
a AS (SELECT count(*) AS n_units, any_value(n_waves) AS n_waves, sum(obs) AS n_obs,
             100.0 * avg(CASE WHEN obs = n_waves THEN 1.0 ELSE 0.0 END) AS pb FROM u, nw)
SELECT CAST(n_units AS BIGINT) AS n_units, CAST(n_waves AS BIGINT) AS n_waves, CAST(n_obs AS BIGINT) AS n_obs,
       round(pb, 2) AS pct_balanced, round(100 - round(pb, 2), 2) AS attrition,
       round(n_obs / n_units, 2) AS avg_obs_per_unit FROM a""")
def q_panel_summary(spark, sf):
    return survey.panel_summary(survey_input(spark, sf), "o_custkey", "wave")


@query("panel_waves", f"""WITH s AS ({SURVEY_SQL})
SELECT CAST(wave AS VARCHAR) AS wave, count(*) AS n, count(DISTINCT o_custkey) AS n_units FROM s GROUP BY 1""")
def q_panel_waves(spark, sf):
    return survey.panel_waves(survey_input(spark, sf), "o_custkey", "wave")


@query("unweighted_shares", f"""WITH s AS ({SURVEY_SQL})
SELECT stratum, o_orderstatus AS level, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY stratum), 6) AS proportion
FROM s WHERE o_orderstatus IS NOT NULL GROUP BY 1, 2""")
def q_unweighted_shares(spark, sf):
    return rounded(survey.unweighted_shares(survey_input(spark, sf), "o_orderstatus", ["stratum"]))


@query("likert_distribution", f"""WITH s AS ({SURVEY_SQL}),
l AS (SELECT CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE likert END AS likert FROM s)
SELECT CAST(likert AS VARCHAR) AS level, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM l), 4) AS pct
FROM l GROUP BY 1""")
def q_likert_distribution(spark, sf):
    s = survey_input(spark, sf).select(
        F.when(F.col("o_orderkey") % 31 == 0, F.lit(None)).otherwise(F.col("likert")).alias("likert"))
    return survey.likert_distribution(s, "likert")


def _woodruff_sql(source: str, value: str, group: str = "1") -> str:
    """CTEs up to ``w`` (g, p, q, se, lo, hi, df): the design has 5 strata of 20 PSUs, 95 degrees of freedom."""
    t = repr(t_ppf(0.975, 95))
    reach = "F >= greatest(least({0}, 1.0), 1e-9) - 1e-12 AND Fb < greatest(least({0}, 1.0), 1e-9) - 1e-12"
    return f"""s AS (SELECT {group} AS g, {value} AS y, w, stratum, psu FROM ({source})),
v AS (SELECT g, y AS value, sum(w) AS w FROM s GROUP BY ALL),
c AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY value ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY g) AS tot FROM v),
f AS (SELECT g, value, cum / tot AS F, (cum - w) / tot AS Fb FROM c),
p AS (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS p),
q AS (SELECT g, p, min(value) AS q FROM f, p WHERE {reach.format("p")} GROUP BY ALL),
a AS (SELECT g, p, stratum, psu, sum(w) AS b, sum(CASE WHEN y <= q THEN w ELSE 0 END) AS a FROM s JOIN q USING (g) GROUP BY ALL),
t AS (SELECT g, p, sum(a) / sum(b) AS ph, sum(b) AS tw FROM a GROUP BY ALL),
z AS (SELECT g, p, stratum, (a - ph * b) / tw AS z FROM a JOIN t USING (g, p)),
h AS (SELECT g, p, stratum, count(*) AS nh, sum(z) AS sz, sum(z * z) AS qz FROM z GROUP BY ALL),
r AS (SELECT g, p, sqrt(sum(nh / (nh - 1) * (qz - sz * sz / nh))) AS sp, sum(nh) - count(*) AS df FROM h GROUP BY ALL),
l AS (SELECT g, p, df, ph - {t} * sp AS pl, ph + {t} * sp AS pu FROM r JOIN t USING (g, p)),
lo AS (SELECT g, p, min(value) AS lo FROM f JOIN l USING (g) WHERE {reach.format("pl")} GROUP BY ALL),
hi AS (SELECT g, p, min(value) AS hi FROM f JOIN l USING (g) WHERE {reach.format("pu")} GROUP BY ALL),
w AS (SELECT g, p, q, (hi - lo) / (2 * {t}) AS se, lo, hi, df FROM q JOIN l USING (g, p) JOIN lo USING (g, p) JOIN hi USING (g, p))"""


@query("survey_quantile_woodruff", f"""WITH {_woodruff_sql(SURVEY_SQL, "y")}
SELECT p, round(q, 6) AS quantile, round(se, 6) AS se, round(lo, 6) AS lower, round(hi, 6) AS upper, CAST(df AS BIGINT) AS df,
       CAST(0 AS BIGINT) AS n_single FROM w""")
def q_survey_quantile_woodruff(spark, sf):
    return rounded(survey.survey_quantile_ci(survey_input(spark, sf), "y", D))


# ----------------------------------------------------------------- implicates
MI_SQL = f"""SELECT s.*, imp AS implicate,
       y * (1 + CAST((o_orderkey * imp) % 11 - 5 + imp AS DOUBLE) / 100.0) AS y_imp
FROM ({SURVEY_SQL}) s, range(1, 6) AS t(imp)"""


def mi_input(spark, sf):
    s = survey_input(spark, sf).withColumn("implicate", F.explode(F.sequence(F.lit(1), F.lit(5))))
    noise = ((F.col("o_orderkey") * F.col("implicate")) % 11 - 5 + F.col("implicate")).cast("double") / 100.0
    return s.withColumn("y_imp", F.col("y") * (1 + noise))


PER_IMP_SQL = f"WITH s AS ({MI_SQL}), " + _taylor_sql(
    "w * (y_imp - mean) / sw",
    "t AS (SELECT implicate, sum(w * y_imp) / sum(w) AS mean, sum(w) AS sw, count(*) AS n FROM s GROUP BY 1)",
    "mean", "implicate")

POOL_SQL = f"""WITH r AS ({PER_IMP_SQL}),
g AS (SELECT 'y_imp' AS term, count(*) AS m, avg(mean) AS est, avg(se * se) AS W, var_samp(mean) AS B FROM r),
c AS (SELECT *, W + (1 + 1.0 / m) * B AS T, CASE WHEN W > 0 THEN (1 + 1.0 / m) * B / W END AS riv FROM g),
d AS (SELECT *, CASE WHEN B > 0 THEN (m - 1) * power(1 + 1 / riv, 2) END AS df FROM c)"""


@query("mi_mean", POOL_SQL + """
SELECT term, CAST(m AS BIGINT) AS m, round(est, 6) AS estimate, round(sqrt(T), 6) AS std_error,
       round(est / sqrt(T), 4) AS statistic, round(df, 4) AS df,
       round(CASE WHEN B > 0 THEN (riv + 2 / (df + 3)) / (riv + 1) ELSE 0.0 END, 6) AS fmi,
       round(riv, 6) AS riv, round((1 + 1.0 / m) * B / T, 6) AS lambda FROM d""")
def q_mi_mean(spark, sf):
    p = mi.mi_mean(mi_input(spark, sf), "y_imp", D)
    return p.select("term", "m", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                    F.round("statistic", 4).alias("statistic"), F.round("df", 4).alias("df"),
                    F.round("fmi", 6).alias("fmi"), F.round("riv", 6).alias("riv"), F.round("lambda", 6).alias("lambda"))


@query("mi_quantile", f"""WITH {_woodruff_sql(MI_SQL, "y_imp", "implicate")},
k AS (SELECT 'y_imp ' || p AS term, count(*) AS m, avg(q) AS est, avg(se * se) AS W, var_samp(q) AS B FROM w GROUP BY p),
j AS (SELECT *, W + (1 + 1.0 / m) * B AS T, CASE WHEN W > 0 THEN (1 + 1.0 / m) * B / W END AS riv FROM k),
d AS (SELECT *, CASE WHEN B > 0 THEN (m - 1) * power(1 + 1 / riv, 2) END AS df FROM j)
SELECT term, CAST(m AS BIGINT) AS m, round(est, 6) AS estimate, round(sqrt(T), 6) AS std_error,
       round(est / sqrt(T), 4) AS statistic, round(df, 4) AS df,
       round(CASE WHEN B > 0 THEN (riv + 2 / (df + 3)) / (riv + 1) ELSE 0.0 END, 6) AS fmi,
       round(riv, 6) AS riv, round((1 + 1.0 / m) * B / T, 6) AS lambda FROM d""")
def q_mi_quantile(spark, sf):
    p = mi.mi_quantile(mi_input(spark, sf), "y_imp", D)
    return p.select("term", "m", *[F.round(c, n).alias(c) for c, n in (
        ("estimate", 6), ("std_error", 6), ("statistic", 4), ("df", 4), ("fmi", 6), ("riv", 6), ("lambda", 6))])


@query("mi_diagnostics", POOL_SQL + """
SELECT CAST(m AS BIGINT) AS m, round(CASE WHEN B > 0 THEN (riv + 2 / (df + 3)) / (riv + 1) ELSE 0.0 END, 6) AS avg_fmi,
       round(CASE WHEN B > 0 THEN (riv + 2 / (df + 3)) / (riv + 1) ELSE 0.0 END, 6) AS max_fmi,
       round((1 + 1.0 / m) * B / T, 6) AS avg_lambda FROM d""")
def q_mi_diagnostics(spark, sf):
    return rounded(mi.mi_diagnostics(mi.mi_mean(mi_input(spark, sf), "y_imp", D)))


@query("rubin_pool_p")
def q_rubin_pool_p(spark, sf):
    return rounded(mi.with_p_value(mi.mi_ratio(mi_input(spark, sf), "y_imp", "x", D)))


@query("mi_split_wide", f"""WITH s AS ({SURVEY_SQL}),
w AS (SELECT o_orderkey, y + 0.1 AS y_imp1, y + 0.2 AS y_imp2, y + 0.3 AS y_imp3 FROM s)
SELECT o_orderkey, implicate, round(y, 6) AS y FROM (
  SELECT o_orderkey, 1 AS implicate, y_imp1 AS y FROM w UNION ALL
  SELECT o_orderkey, 2, y_imp2 FROM w UNION ALL SELECT o_orderkey, 3, y_imp3 FROM w)""")
def q_mi_split_wide(spark, sf):
    s = survey_input(spark, sf).select("o_orderkey", (F.col("y") + 0.1).alias("y_imp1"),
                                       (F.col("y") + 0.2).alias("y_imp2"), (F.col("y") + 0.3).alias("y_imp3"))
    long = mi.mi_split_wide(s, mi.wide_bases(s.columns))
    return rounded(long.select("o_orderkey", "implicate", "y"))


@query("survey_glm_gaussian", f"""WITH s AS ({SURVEY_SQL}),
m AS (SELECT sum(w) AS sw, sum(w * x) AS swx, sum(w * x * x) AS swxx, sum(w * y) AS swy, sum(w * x * y) AS swxy FROM s),
b AS (SELECT (swxx * swy - swx * swxy) / (sw * swxx - swx * swx) AS b0,
             (sw * swxy - swx * swy) / (sw * swxx - swx * swx) AS b1, sw, swx, swxx, sw * swxx - swx * swx AS det FROM m),
u AS (SELECT stratum, psu, sum(w * (y - b0 - b1 * x)) AS u0, sum(w * x * (y - b0 - b1 * x)) AS u1 FROM s, b GROUP BY 1, 2),
h AS (SELECT stratum, count(*) AS nh, sum(u0) AS s0, sum(u1) AS s1, sum(u0 * u0) AS q00, sum(u0 * u1) AS q01,
             sum(u1 * u1) AS q11 FROM u GROUP BY 1),
mt AS (SELECT sum(nh / (nh - 1) * (q00 - s0 * s0 / nh)) AS m00, sum(nh / (nh - 1) * (q01 - s0 * s1 / nh)) AS m01,
              sum(nh / (nh - 1) * (q11 - s1 * s1 / nh)) AS m11 FROM h)
SELECT '(Intercept)' AS term, round(b0, 6) AS estimate,
       round(sqrt((swxx * swxx * m00 - 2 * swxx * swx * m01 + swx * swx * m11) / (det * det)), 6) AS std_error FROM b, mt
UNION ALL
SELECT 'x', round(b1, 6), round(sqrt((swx * swx * m00 - 2 * swx * sw * m01 + sw * sw * m11) / (det * det)), 6) FROM b, mt""")
def q_survey_glm_gaussian(spark, sf):
    r = survey.survey_glm(survey_input(spark, sf), "y", ["x"], D, "gaussian")
    return rounded(r.select("term", "estimate", "std_error"))


@query("survey_glm_logit")
def q_survey_glm_logit(spark, sf):
    s = survey_input(spark, sf).withColumn("is_f", (F.col("o_orderstatus") == "F").cast("double"))
    return rounded(survey.survey_glm(s, "is_f", ["y", "x"], D, "binomial"))


@query("mi_glm")
def q_mi_glm(spark, sf):
    return rounded(mi.mi_glm(mi_input(spark, sf), "y_imp", ["x"], D, "gaussian"))


def _brr_sql(rho: float) -> str:
    return f"""WITH s AS ({SURVEY_SQL}),
p AS (SELECT stratum, o_custkey % 2 AS psu2, sum(w * y) AS T, sum(w) AS W FROM s GROUP BY 1, 2),
ps AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY CAST(psu2 AS VARCHAR)) - 1 AS side,
              dense_rank() OVER (ORDER BY stratum) AS j FROM p),
r AS (SELECT unnest(range(0, 8)) AS r),
m AS (SELECT r, T, W, CASE WHEN (CASE WHEN bit_count(CAST(r AS BIGINT) & CAST(j AS BIGINT)) % 2 = 1 THEN -1 ELSE 1 END)
                                * (CASE WHEN side = 0 THEN 1 ELSE -1 END) > 0 THEN 2 - {rho} ELSE {rho} END AS mult FROM ps, r),
th AS (SELECT r, sum(mult * T) / sum(mult * W) AS th FROM m GROUP BY r),
f AS (SELECT sum(T) / sum(W) AS mean FROM p)
SELECT round(mean, 6) AS mean, round(sqrt(sum((th - mean) * (th - mean)) / (8 * power(1 - {rho}, 2))), 6) AS se,
       CAST(8 AS BIGINT) AS R FROM th, f GROUP BY mean"""


@query("make_replicates_brr", _brr_sql(0.0))
def q_brr(spark, sf):
    s = survey_input(spark, sf).withColumn("psu2", F.col("o_custkey") % 2)
    return rounded(survey.brr_mean(s, "y", Design("w", "stratum", "psu2"), 0.0))


@query("make_replicates_fay", _brr_sql(0.5))
def q_fay(spark, sf):
    s = survey_input(spark, sf).withColumn("psu2", F.col("o_custkey") % 2)
    return rounded(survey.brr_mean(s, "y", Design("w", "stratum", "psu2"), 0.5))


def _phf_input(spark, sf):
    s = survey_input(spark, sf).select("o_orderkey", "y", "x", F.col("w").alias("wgt"), F.col("stratum").alias("wsr"),
                                       "psu", F.col("o_custkey").alias("hid"))
    return survey.jk1_replicate_weights(s, "wgt", F.col("psu"), 20)


@query("survey_template_apply")
def q_survey_template_apply(spark, sf):
    """PHF conventions resolved on a derived panel; the replicate-weight mean
    then uses the template's design type (Fay, rho 0.5, MSE form)."""
    d = _phf_input(spark, sf)
    spec = survey.apply_template(d.columns, "phf")
    est = survey.replicate_mean(d, "y", spec["weight"], spec["replicate_weights"], spec["type"], rho=0.5,
                                mse=spec["use_mse"], combined=spec["combined_weights"])
    roles = ", ".join(f"{k}={spec[k]}" for k in ("weight", "strata", "psu", "id"))
    return rounded(est.withColumn("roles", F.lit(roles)).withColumn("n_replicates", F.lit(len(spec["replicate_weights"]))))


@query("survey_to_model")
def q_survey_to_model(spark, sf):
    """Design columns leave the predictors; the survey weight becomes the model weight."""
    from ..operators import models
    d = _phf_input(spark, sf)
    spec = survey.apply_template(d.columns, "phf")
    feats = [c for c in survey.model_features(d.columns, "y", spec) if c != "o_orderkey"]
    fit = models.ols(d, "y", feats, weight=spec["weight"])
    return rounded(fit.table(spark))


@query("detect_survey_columns")
def q_detect_survey_columns(spark, sf):
    from ..operators import detect
    return detect.detect_survey_columns(_phf_input(spark, sf).withColumnRenamed("wsr", "stratum_id")
                                        .withColumn("wave", F.lit(1)))


@query("survey_crosstab_rao_scott")
def q_survey_crosstab_rao_scott(spark, sf):
    r = survey.rao_scott_test(survey_input(spark, sf), "stratum", "o_orderstatus", D)
    return rounded(spark.createDataFrame([tuple(float(r[k]) for k in ("chisq", "F", "ndf", "ddf", "p_value", "deff_mean"))],
                                         "chisq double, F double, ndf double, ddf double, p_value double, deff_mean double"))
