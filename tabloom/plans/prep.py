"""Recipe-step queries: each applies one step of the recipe engine to the
orders-derived recipe input and returns the key plus the changed columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..operators import profile, recipe
from ..operators.recipe import step
from . import inputs
from ..session import table
from .catalog import query, rounded
from .explore import PROFILE_SQL

T = f"WITH t AS ({inputs.RECIPE_INPUT_SQL})"


def _run(spark, sf, steps, cols, target=None, digits=6):
    df, _ = recipe.apply_recipe(inputs.recipe_input(spark, sf), steps, target=target)
    return rounded(df.select("o_orderkey", *cols), digits)


@query("impute", f"""{T},
m AS (SELECT quantile_cont(price_k, 0.5) AS mp, quantile_cont(cust_mod, 0.5) AS mc FROM t),
md AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL
       GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
SELECT o_orderkey, round(coalesce(price_k, mp), 6) AS price_k,
       round(CAST(coalesce(cust_mod, mc) AS DOUBLE), 6) AS cust_mod,
       coalesce(o_orderpriority, v) AS o_orderpriority
FROM t, m, md""")
def q_impute(spark, sf):
    df, _ = recipe.apply_recipe(inputs.recipe_input(spark, sf),
                                [step("impute", ["price_k", "cust_mod", "o_orderpriority"])])
    return rounded(df.select("o_orderkey", "price_k", F.col("cust_mod").cast("double").alias("cust_mod"),
                             "o_orderpriority"))


@query("impute_date", """
WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders),
m AS (SELECT d FROM t WHERE d IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, CAST(d AS VARCHAR) LIMIT 1)
SELECT o_orderkey, coalesce(t.d, m.d) AS d FROM t, m""")
def q_impute_date(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", F.when(
        F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("date")).alias("d"))
    return recipe.apply_recipe(d, [step("impute", ["d"])])[0]


@query("lump_rare", f"""{T},
n AS (SELECT count(*) AS n FROM t),
c AS (SELECT status_r AS l, count(*) AS c FROM t WHERE status_r IS NOT NULL GROUP BY 1)
SELECT o_orderkey, CASE WHEN CAST(c.c AS DOUBLE) / n.n < 0.01 THEN 'Other' ELSE status_r END AS status_r
FROM t LEFT JOIN c ON status_r = c.l, n""")
def q_lump_rare(spark, sf):
    return _run(spark, sf, [step("lump_rare", ["status_r"], threshold=0.01)], ["status_r"])


@query("frequency_encode", f"""{T},
n AS (SELECT count(*) AS n FROM t),
c AS (SELECT o_orderpriority AS l, count(*) AS c FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderkey, round(CAST(c.c AS DOUBLE) / n.n, 6) AS o_orderpriority
FROM t LEFT JOIN c ON o_orderpriority = c.l, n""")
def q_frequency_encode(spark, sf):
    return _run(spark, sf, [step("frequency_encode", ["o_orderpriority"])], ["o_orderpriority"])


@query("target_encode", f"""{T},
g AS (SELECT avg(o_totalprice) AS gm FROM t),
l AS (SELECT o_orderpriority AS lv, avg(o_totalprice) AS mu, count(*) AS n FROM t
      WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderkey, round(coalesce((mu * n + gm * 10) / (n + 10), gm), 6) AS o_orderpriority
FROM t LEFT JOIN l ON o_orderpriority = l.lv, g""")
def q_target_encode(spark, sf):
    return _run(spark, sf, [step("target_encode", ["o_orderpriority"], smoothing=10)], ["o_orderpriority"],
                target="o_totalprice")


@query("target_encode_class", f"""{T},
top AS (SELECT o_orderstatus AS top FROM t WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
y AS (SELECT t.*, CASE WHEN o_orderstatus IS NULL THEN NULL ELSE CAST(o_orderstatus = top AS DOUBLE) END AS yv FROM t, top),
g AS (SELECT avg(yv) AS gm FROM y),
l AS (SELECT o_orderpriority AS lv, avg(yv) AS mu, count(*) AS n FROM y WHERE o_orderpriority IS NOT NULL GROUP BY 1)
SELECT o_orderkey, round(coalesce((mu * n + gm * 10) / (n + 10), gm), 6) AS o_orderpriority
FROM y LEFT JOIN l ON o_orderpriority = l.lv, g""")
def q_target_encode_class(spark, sf):
    return _run(spark, sf, [step("target_encode", ["o_orderpriority"], smoothing=10)], ["o_orderpriority"],
                target="o_orderstatus")


@query("ordinal_encode", f"""{T},
lv AS (SELECT l, CAST(row_number() OVER (ORDER BY l) AS INTEGER) AS pos
       FROM (SELECT DISTINCT o_orderpriority AS l FROM t WHERE o_orderpriority IS NOT NULL))
SELECT o_orderkey, pos AS o_orderpriority FROM t LEFT JOIN lv ON o_orderpriority = lv.l""")
def q_ordinal_encode(spark, sf):
    return _run(spark, sf, [step("ordinal_encode", ["o_orderpriority"])], ["o_orderpriority"])


@query("one_hot", f"""{T}
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS o_orderstatus_F,
       CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS o_orderstatus_O,
       CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS o_orderstatus_P,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS "o_orderpriority_1-URGENT",
       CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END AS "o_orderpriority_2-HIGH",
       CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END AS "o_orderpriority_3-MEDIUM",
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS "o_orderpriority_4-NOT SPECIFIED",
       CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS "o_orderpriority_5-LOW"
FROM t""")
def q_one_hot(spark, sf):
    df, _ = recipe.apply_recipe(inputs.recipe_input(spark, sf), [step("one_hot", ["o_orderstatus", "o_orderpriority"])])
    return df.select("o_orderkey", *[c for c in df.columns if c.startswith("o_orderstatus_") or c.startswith("o_orderpriority_")])


@query("yeo_johnson", f"""{T}
SELECT o_orderkey, round(sign(disc) * ln(1 + abs(disc)), 6) AS disc,
       round(sign(price_k) * ln(1 + abs(price_k)), 6) AS price_k FROM t""")
def q_yeo_johnson(spark, sf):
    return _run(spark, sf, [step("yeo_johnson", ["disc", "price_k"])], ["disc", "price_k"])


@query("log_transform", f"""{T},
s AS (SELECT count_if(disc = 0) AS zd, min(disc) AS md, count_if(cust_mod = 0) AS zc, min(cust_mod) AS mc,
             count_if(o_totalprice = 0) AS zt, min(o_totalprice) AS mt FROM t),
o AS (SELECT CASE WHEN zd > 0 THEN 1.0 ELSE 0.0 END AS od0, CASE WHEN zc > 0 THEN 1.0 ELSE 0.0 END AS oc0,
             CASE WHEN zt > 0 THEN 1.0 ELSE 0.0 END AS ot0, md, mc, mt FROM s),
e AS (SELECT CASE WHEN md + od0 <= 0 THEN od0 - md + 1e-9 ELSE od0 END AS od,
             CASE WHEN mc + oc0 <= 0 THEN oc0 - mc + 1e-9 ELSE oc0 END AS oc,
             CASE WHEN mt + ot0 <= 0 THEN ot0 - mt + 1e-9 ELSE ot0 END AS ot FROM o)
SELECT o_orderkey, round(ln(disc + od), 6) AS disc, round(log2(cust_mod + oc), 6) AS cust_mod,
       round(log10(o_totalprice + ot), 6) AS o_totalprice
FROM t, e""")
def q_log_transform(spark, sf):
    return _run(spark, sf, [step("log", ["disc"]), step("log2", ["cust_mod"]), step("log10", ["o_totalprice"])],
                ["disc", "cust_mod", "o_totalprice"])


@query("sqrt_inverse", f"""{T}
SELECT o_orderkey, round(sqrt(greatest(CAST(disc AS DOUBLE), 0.0)), 6) AS disc,
       round(1.0 / nullif(CAST(cust_mod AS DOUBLE), 0.0), 6) AS cust_mod FROM t""")
def q_sqrt_inverse(spark, sf):
    return _run(spark, sf, [step("sqrt", ["disc"]), step("inverse", ["cust_mod"])], ["disc", "cust_mod"])


@query("boxcox", f"""{T}
SELECT o_orderkey, round((power(o_totalprice, 0.5) - 1) / 0.5, 6) AS o_totalprice FROM t""")
def q_boxcox(spark, sf):
    return _run(spark, sf, [step("boxcox", ["o_totalprice"], **{"lambda": 0.5})], ["o_totalprice"])


@query("boxcox_search")
def q_boxcox_search(spark, sf):
    return _run(spark, sf, [step("boxcox", ["o_totalprice", "disc"])], ["o_totalprice", "disc"])


@query("zscore", f"""{T},
s AS (SELECT avg(price_k) AS m, stddev_samp(price_k) AS sd FROM t)
SELECT o_orderkey, round((price_k - m) / sd, 6) AS price_k FROM t, s""")
def q_zscore(spark, sf):
    return _run(spark, sf, [step("zscore", ["price_k"])], ["price_k"])


@query("min_max", f"""{T},
s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM t)
SELECT o_orderkey, round((o_totalprice - a) / (b - a), 6) AS o_totalprice FROM t, s""")
def q_min_max(spark, sf):
    return _run(spark, sf, [step("min_max", ["o_totalprice"])], ["o_totalprice"])


@query("robust_scale", f"""{T},
s AS (SELECT quantile_cont(price_k, 0.25) AS q1, quantile_cont(price_k, 0.5) AS med,
             quantile_cont(price_k, 0.75) AS q3 FROM t)
SELECT o_orderkey, round((price_k - med) / (q3 - q1), 6) AS price_k FROM t, s""")
def q_robust_scale(spark, sf):
    return _run(spark, sf, [step("robust_scale", ["price_k"])], ["price_k"])


@query("clip", f"""{T},
s AS (SELECT quantile_cont(price_k, 0.01) AS lo, quantile_cont(price_k, 0.99) AS hi FROM t)
SELECT o_orderkey, round(CASE WHEN price_k < lo THEN lo WHEN price_k > hi THEN hi ELSE price_k END, 6) AS price_k
FROM t, s""")
def q_clip(spark, sf):
    return _run(spark, sf, [step("clip", ["price_k"], lower=0.01, upper=0.99, by_quantile=True)], ["price_k"])


@query("bin_equal_width", f"""{T},
s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM t),
b AS (SELECT lo - (hi - lo) / 1000 AS b0, lo + 1 * ((hi - lo) / 5) AS b1, lo + 2 * ((hi - lo) / 5) AS b2,
             lo + 3 * ((hi - lo) / 5) AS b3, lo + 4 * ((hi - lo) / 5) AS b4 FROM s)
SELECT o_orderkey, least(greatest(CAST((o_totalprice > b0) AS INTEGER) + CAST((o_totalprice > b1) AS INTEGER)
       + CAST((o_totalprice > b2) AS INTEGER) + CAST((o_totalprice > b3) AS INTEGER)
       + CAST((o_totalprice > b4) AS INTEGER), 1), 5) AS o_totalprice
FROM t, b""")
def q_bin_equal_width(spark, sf):
    return _run(spark, sf, [step("bin_equal_width", ["o_totalprice"], n_bins=5)], ["o_totalprice"])


@query("bin_quantile", f"""{T},
s AS (SELECT list_sort(list_distinct(quantile_cont(price_k, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS br FROM t)
SELECT o_orderkey, CASE WHEN price_k IS NULL THEN NULL
       ELSE least(greatest(len(list_filter(br, lambda b: b < price_k)), 1), len(br) - 1) END AS price_k
FROM t, s""")
def q_bin_quantile(spark, sf):
    return _run(spark, sf, [step("bin_quantile", ["price_k"], n_bins=5)], ["price_k"])


@query("date_features", f"""{T}
SELECT o_orderkey, o_orderdate,
       CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
       CAST(isodow(o_orderdate) AS INTEGER) AS o_orderdate_dow, CAST(week(o_orderdate) AS INTEGER) AS o_orderdate_week,
       CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_qtr,
       CASE WHEN isodow(o_orderdate) IN (6, 7) THEN 1 ELSE 0 END AS o_orderdate_is_weekend,
       CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS o_orderdate_days_since_epoch
FROM t""")
def q_date_features(spark, sf):
    df, _ = recipe.apply_recipe(inputs.recipe_input(spark, sf), [step("date_features", ["o_orderdate"])],
                                time_col="o_orderdate")
    return df.select("o_orderkey", "o_orderdate", *[c for c in df.columns if c.startswith("o_orderdate_")])


@query("parse_date", f"""WITH d AS ({inputs.DATE_STRINGS_SQL})
SELECT o_orderkey, date_str,
       CAST(coalesce(try_strptime(date_str, '%Y-%m-%d %H:%M:%S'), try_strptime(date_str, '%Y-%m-%d'),
                     try_strptime(date_str, '%d/%m/%Y')) AS DATE) AS parsed
FROM d""")
def q_parse_date(spark, sf):
    d = inputs.date_strings(spark, sf)
    return d.select("o_orderkey", "date_str", parse_date(F.col("date_str")).alias("parsed"))


@query("parse_datetime", f"""WITH d AS ({inputs.DATE_STRINGS_SQL})
SELECT o_orderkey, CAST(try_strptime(date_str, '%d/%m/%Y') AS DATE) AS date_str FROM d""")
def q_parse_datetime(spark, sf):
    df, _ = recipe.apply_recipe(inputs.date_strings(spark, sf),
                                [step("parse_datetime", ["date_str"], format="%d/%m/%Y")])
    return df.select("o_orderkey", "date_str")


@query("quantile_normal")
def q_quantile_normal(spark, sf):
    return _run(spark, sf, [step("quantile_normal", ["price_k"])], ["price_k"])


@query("pca")
def q_pca(spark, sf):
    li = inputs.line_numeric(spark, sf).select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "skewed_qty")
    df, _ = recipe.apply_recipe(li, [step("pca", "all_numeric", n_components=3)])
    return rounded(df)


@query("default_recipe")
def q_default_recipe(spark, sf):
    df = inputs.recipe_input(spark, sf)
    prof = [r.asDict() for r in profile.profile_columns(df).collect()]
    steps = recipe.default_steps(prof, target="o_totalprice")
    out, _ = recipe.apply_recipe(df, steps, target="o_totalprice", time_col="o_orderdate")
    return rounded(out)


@query("suggest_steps", f"""
WITH pr AS ({PROFILE_SQL})
SELECT "column",
       CASE WHEN is_constant THEN 'drop_zero_var' WHEN is_id_like THEN 'drop_id_like'
            WHEN pct_missing > 60 THEN 'drop_high_missing'
            WHEN skew IS NOT NULL AND abs(skew) > 1.5 THEN 'yeo_johnson' WHEN pct_missing > 0 THEN 'impute' END AS action,
       CASE WHEN is_constant THEN 'zero variance' WHEN is_id_like THEN 'ID-like (one value per row)'
            WHEN pct_missing > 60 THEN printf('%.0f%% missing', pct_missing)
            WHEN skew IS NOT NULL AND abs(skew) > 1.5 THEN printf('skew=%.2f', skew)
            WHEN pct_missing > 0 THEN printf('%.1f%% missing', pct_missing) END AS reason
FROM pr WHERE is_constant OR is_id_like OR pct_missing > 0 OR (skew IS NOT NULL AND abs(skew) > 1.5)""")
def q_suggest_steps(spark, sf):
    return recipe.suggest_steps(profile.profile_columns(inputs.profile_input(spark, sf)))


@query("drop_zero_var", f"""WITH t AS ({inputs.PROFILE_INPUT_SQL})
SELECT o_orderkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice, o_orderpriority, order_code, c_nationkey,
       round(c_acctbal, 6) AS c_acctbal, c_mktsegment, rare_flag, round(sparse_tax, 6) AS sparse_tax,
       round(skewed, 6) AS skewed, round(value_missing, 6) AS value_missing FROM t""")
def q_drop_zero_var(spark, sf):
    df = inputs.profile_input(spark, sf)
    prof = [r.asDict() for r in profile.profile_columns(df).collect()]
    const = [r["column"] for r in prof if r["is_constant"]]
    out, _ = recipe.apply_recipe(df, [step("drop_zero_var", const)], time_col="o_orderdate")
    return rounded(out.drop("o_orderdate"))


@query("drop_id_like", f"""WITH t AS ({inputs.PROFILE_INPUT_SQL})
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM t""")
def q_drop_id_like(spark, sf):
    df = inputs.profile_input(spark, sf).select("o_orderkey", "order_code", "o_orderstatus", "o_orderpriority")
    ids = [r["column"] for r in profile.profile_columns(df).collect() if r["is_id_like"]]
    return recipe.apply_recipe(df, [step("drop_id_like", ids)])[0]


@query("drop_high_missing", """
SELECT o_orderkey, o_totalprice FROM orders""")
def q_drop_high_missing(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.when(
        F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("mostly_missing"))
    gone = [r["column"] for r in profile.profile_columns(df).collect() if r["pct_missing"] > 60]
    return recipe.apply_recipe(df, [step("drop_high_missing", gone)])[0]


@query("quick_recipe")
def q_quick_recipe(spark, sf):
    df = inputs.recipe_input(spark, sf).drop("o_orderdate")
    out = recipe.quick_recipe(df, ["drop_high_na", "impute_num", "impute_cat", "dummy", "scale", "lags", "rollmean"],
                              "o_totalprice", ["o_orderkey"])
    return rounded(out)
