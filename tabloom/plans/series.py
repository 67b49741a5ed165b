"""Window / time-series queries: lags, rolling means, supervised windows, ACF,
time-ordered split, baseline forecasts of many series, Prophet preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series
from ..operators.detect import horizon_label
from ..session import table
from .catalog import query, rounded

EVENTS_SQL = """SELECT event_id, ts, user_id, event_type,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value FROM events"""


def events_input(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", "ts", "user_id", "event_type",
                    F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))


MONTHLY_SQL = """SELECT c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
       round(sum(o_totalprice), 2) AS y
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2"""


def monthly_input(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return (j.groupBy(F.col("c_mktsegment").alias("series_id"),
                      F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("y")))


DAILY_SQL = """SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS n_events,
       round(sum(value), 4) AS total_value FROM events GROUP BY 1, 2"""


def daily_input(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(
        F.count(F.lit(1)).cast("double").alias("n_events"), F.round(F.sum("value"), 4).alias("total_value"))


@query("lag_features", f"""WITH e AS ({EVENTS_SQL})
SELECT event_id, round(value, 6) AS value,
       round(lag(value, 1) OVER w, 6) AS lag_1, round(lag(value, 2) OVER w, 6) AS lag_2,
       round(lag(value, 3) OVER w, 6) AS lag_3
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def q_lag_features(spark, sf):
    x = series.lag_features(events_input(spark, sf), "value", ["ts", "event_id"], ["user_id"], [1, 2, 3])
    return rounded(x.select("event_id", "value", "lag_1", "lag_2", "lag_3"))


@query("rolling_mean_7", f"""WITH e AS ({EVENTS_SQL})
SELECT event_id, round(CASE WHEN count(*) OVER w >= 7 THEN avg(value) OVER w END, 6) AS rollmean_7
FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_rolling_mean(spark, sf):
    x = series.rolling_mean(events_input(spark, sf), "value", ["ts", "event_id"], ["user_id"], 7)
    return rounded(x.select("event_id", "rollmean_7"))


@query("supervised_windows", f"""WITH d AS ({DAILY_SQL}),
w AS (SELECT event_type, day, total_value AS y,
        [[lag(n_events, 3) OVER o, lag(total_value, 3) OVER o],
         [lag(n_events, 2) OVER o, lag(total_value, 2) OVER o],
         [lag(n_events, 1) OVER o, lag(total_value, 1) OVER o]] AS X,
        row_number() OVER o AS rn
      FROM d WINDOW o AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, CAST(day AS VARCHAR) AS day, X, y FROM w WHERE rn > 3""")
def q_supervised_windows(spark, sf):
    x = series.supervised_windows(daily_input(spark, sf), ["n_events", "total_value"], "total_value",
                                  ["day"], 3, ["event_type"])
    return x.select("event_type", F.col("day").cast("string").alias("day"), "X", "y")


def _acf_sql(max_lag=20):
    lags = ", ".join(f"sum(dd * lag{k}) AS s{k}" for k in range(1, max_lag + 1))
    lagcols = ", ".join(f"lag(dd, {k}) OVER (PARTITION BY event_type ORDER BY day) AS lag{k}"
                        for k in range(1, max_lag + 1))
    unions = " UNION ALL ".join(
        f"SELECT event_type, {k} AS lag, s{k} / ss AS acf, n FROM a WHERE {k} <= least({max_lag}, n - 1)"
        for k in range(1, max_lag + 1))
    return f"""WITH d AS ({DAILY_SQL}),
m AS (SELECT event_type, avg(total_value) AS mu, count(*) AS n FROM d GROUP BY 1),
c AS (SELECT d.event_type, day, total_value - mu AS dd, n FROM d JOIN m USING (event_type)),
l AS (SELECT event_type, dd, n, {lagcols} FROM c),
a AS (SELECT event_type, any_value(n) AS n, sum(dd * dd) AS ss, {lags} FROM l GROUP BY 1),
r AS ({unions})
SELECT event_type, CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf, round(1.959963984540054 / sqrt(n), 6) AS bound
FROM r"""


@query("acf", _acf_sql())
def q_acf(spark, sf):
    return rounded(series.acf(daily_input(spark, sf), "total_value", ["day"], ["event_type"], 20))


@query("time_ordered_split", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey)
                         <= floor((SELECT count(*) FROM orders) * 0.8) THEN 'train' ELSE 'test' END AS split
FROM orders""")
def q_time_ordered_split(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return series.time_ordered_split(o, "o_orderdate", "o_orderkey", 0.8).select("o_orderkey", "split")


def _fc_sql(body):
    return f"WITH s AS ({MONTHLY_SQL}) {body}"


_LAGGED = """l AS (SELECT series_id, month, y, y - lag(y) OVER (PARTITION BY series_id ORDER BY month) AS d FROM s),
a AS (SELECT series_id, count(y) AS n, arg_min(y, month) AS first, arg_max(y, month) AS last, avg(y) AS mean,
             stddev_samp(y) AS sd, avg(d * d) AS msd, stddev_samp(d) AS sdd, count(d) AS nd FROM l GROUP BY 1),
h AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS step)"""


@query("forecast_naive", _fc_sql(f""", {_LAGGED}
SELECT series_id, step, round(last, 2) AS predicted, round(last - 1.959963984540054 * sqrt(msd * step), 2) AS lower,
       round(last + 1.959963984540054 * sqrt(msd * step), 2) AS upper FROM a, h"""))
def q_forecast_naive(spark, sf):
    return rounded(series.forecast_naive(monthly_input(spark, sf), ["series_id"], "month", "y", 12), 2)


@query("forecast_rwf_drift", _fc_sql(f""", {_LAGGED},
b AS (SELECT series_id, last, (last - first) / (n - 1) AS b, sdd AS sigma, sdd / sqrt(nd) AS bse FROM a)
SELECT series_id, step, round(last + step * b, 2) AS predicted,
       round(last + step * b - 1.959963984540054 * sqrt(sigma * sigma * step + power(step * bse, 2)), 2) AS lower,
       round(last + step * b + 1.959963984540054 * sqrt(sigma * sigma * step + power(step * bse, 2)), 2) AS upper
FROM b, h"""))
def q_forecast_rwf_drift(spark, sf):
    return rounded(series.forecast_rwf_drift(monthly_input(spark, sf), ["series_id"], "month", "y", 12), 2)


@query("forecast_meanf", _fc_sql(f""", {_LAGGED}
SELECT series_id, step, round(mean, 2) AS predicted FROM a, h"""))
def q_forecast_meanf(spark, sf):
    f = series.forecast_meanf(monthly_input(spark, sf), ["series_id"], "month", "y", 12)
    return rounded(f.select("series_id", "step", "predicted"), 2)


@query("forecast_meanf_interval")
def q_forecast_meanf_interval(spark, sf):
    return rounded(series.forecast_meanf(monthly_input(spark, sf), ["series_id"], "month", "y", 12), 2)


@query("forecast_snaive", _fc_sql(""",
l AS (SELECT series_id, month, y, y - lag(y, 12) OVER (PARTITION BY series_id ORDER BY month) AS d,
             row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS back FROM s),
g AS (SELECT series_id, avg(d * d) AS msd FROM l GROUP BY 1),
h AS (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS step)
SELECT l.series_id, step, round(y, 2) AS predicted,
       round(y - 1.959963984540054 * sqrt(msd * (floor((step - 1) / 12) + 1)), 2) AS lower,
       round(y + 1.959963984540054 * sqrt(msd * (floor((step - 1) / 12) + 1)), 2) AS upper
FROM l JOIN g USING (series_id), h WHERE back = 12 - ((step - 1) % 12)"""))
def q_forecast_snaive(spark, sf):
    return rounded(series.forecast_snaive(monthly_input(spark, sf), ["series_id"], "month", "y", 12, 12), 2)


@query("forecast_horizon", _fc_sql(f""", {_LAGGED}
SELECT series_id, step, round(last, 2) AS predicted,
       CAST(step AS VARCHAR) || CASE WHEN step = 1 THEN ' month ahead' ELSE ' months ahead' END AS horizon
FROM a, h"""))
def q_forecast_horizon(spark, sf):
    f = series.forecast_naive(monthly_input(spark, sf), ["series_id"], "month", "y", 12)
    labels = F.create_map(*[x for h in range(1, 13) for x in (F.lit(h), F.lit(horizon_label("monthly", h)))])
    return rounded(f.select("series_id", "step", "predicted", F.element_at(labels, F.col("step")).alias("horizon")), 2)


@query("prophet_prepare", f"""WITH e AS ({EVENTS_SQL})
SELECT CAST(ts AS DATE) AS ds, round(arg_min(value, event_id), 6) AS y
FROM e WHERE value IS NOT NULL GROUP BY 1""")
def q_prophet_prepare(spark, sf):
    e = events_input(spark, sf).select(F.col("ts").cast("date").alias("day"), "value",
                                       F.col("event_id").alias("_ord"))
    return rounded(series.prophet_prepare(e, "day", "value"))


@query("arima")
def q_arima(spark, sf):
    """Orders and differencing chosen per series, seasons of 12 months, at the registry's defaults."""
    from ..operators import sarima
    df = monthly_input(spark, sf)
    return rounded(sarima.sarima_forecast(df, sarima.sarima_fit(df, ["series_id"], "month", "y", 12), ["series_id"], "month", "y", 12), 2)


@query("arima_orders")
def q_arima_orders(spark, sf):
    from ..operators import sarima
    return rounded(sarima.sarima_fit(monthly_input(spark, sf), ["series_id"], "month", "y", 12), 4)


@query("arima_nonseasonal")
def q_arima_nonseasonal(spark, sf):
    from ..operators import tsmodels
    df = monthly_input(spark, sf)
    m = tsmodels.arima_fit(df, ["series_id"], "month", "y", d=1, max_p=3, max_q=2)
    return rounded(tsmodels.arima_forecast(df, m, ["series_id"], "month", "y", 12), 2)


@query("ets")
def q_ets(spark, sf):
    """The model of least AICc of every series among all structures, at the registry's defaults."""
    from ..operators import ets
    return rounded(ets.ets_forecast(ets.ets_fit(monthly_input(spark, sf), ["series_id"], "month", "y", "ZZZ", 12), ["series_id"], 12), 2)


@query("ets_models")
def q_ets_models(spark, sf):
    """Every code of the registry, damped and not, with its parameters and criteria."""
    from functools import reduce
    from ..operators import ets
    df = monthly_input(spark, sf)
    parts = [ets.ets_fit(df, ["series_id"], "month", "y", code, 12, choose=False) for code in ets.CODES]
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return rounded(out.select("series_id", F.concat("error", "trend_type", "season_type").alias("code"), "damped", "alpha", "beta", "gamma",
                              "phi", "sse", "aicc", "n"), 4)


@query("theta")
def q_theta(spark, sf):
    from ..operators import tsmodels
    return rounded(tsmodels.theta_forecast(monthly_input(spark, sf), ["series_id"], "month", "y", 12), 2)


@query("var")
def q_var(spark, sf):
    from ..operators import tsmodels
    wide = monthly_input(spark, sf).groupBy("month").pivot(
        "series_id", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).agg(F.first("y"))
    cols = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    fit = tsmodels.var_fit(wide.na.drop(), "month", cols, 4, "AIC")
    return rounded(tsmodels.var_forecast(wide.na.drop(), "month", fit, 12), 2)


@query("stl_decomposition", f"""WITH s AS ({MONTHLY_SQL}),
p AS (SELECT series_id, month, y, row_number() OVER (PARTITION BY series_id ORDER BY month) AS pos FROM s),
t AS (SELECT *, CASE WHEN count(*) OVER w = 13 THEN (sum(y) OVER w - 0.5 * lag(y, 6) OVER o - 0.5 * lead(y, 6) OVER o) / 12 END AS trend
      FROM p WINDOW w AS (PARTITION BY series_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING),
                    o AS (PARTITION BY series_id ORDER BY month)),
d AS (SELECT *, CAST((pos - 1) % 12 AS INTEGER) AS season FROM t),
sm AS (SELECT series_id, season, avg(y - trend) AS sraw FROM d WHERE trend IS NOT NULL GROUP BY 1, 2),
sn AS (SELECT series_id, season, sraw - avg(sraw) OVER (PARTITION BY series_id) AS seasonal FROM sm)
SELECT d.series_id, CAST(month AS VARCHAR) AS month, round(trend / 1000, 1) AS trend_k, round(seasonal / 1000, 1) AS seasonal_k,
       round((y - trend - seasonal) / 1000, 1) AS remainder_k
FROM d JOIN sn USING (series_id, season)""")
def q_stl_decomposition(spark, sf):
    from ..operators import tsmodels
    dec = tsmodels.decompose(monthly_input(spark, sf), ["series_id"], "month", "y", 12)
    # reported in thousands: float noise on ~1e7 sums stays far from the rounding grid
    return rounded(dec.select("series_id", F.col("month").cast("string").alias("month"),
                              (F.col("trend") / 1000).alias("trend_k"), (F.col("seasonal") / 1000).alias("seasonal_k"),
                              (F.col("remainder") / 1000).alias("remainder_k")), 1)


@query("stl_arima")
def q_stl_arima(spark, sf):
    from ..operators import tsmodels
    return rounded(tsmodels.stl_arima_forecast(monthly_input(spark, sf), ["series_id"], "month", "y", 12, 12), 2)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _system(spark, sf):
    return (monthly_input(spark, sf).groupBy("month").pivot("series_id", SEGMENTS).agg(F.first("y")).na.drop())


@query("bvar")
def q_bvar(spark, sf):
    from ..operators import tsmodels
    w = _system(spark, sf)
    return rounded(tsmodels.var_forecast(w, "month", tsmodels.bvar_fit(w, "month", SEGMENTS, 4, 0.2), 12), 2)


@query("dfm")
def q_dfm(spark, sf):
    from ..operators import tsmodels
    return rounded(tsmodels.dfm_forecast(_system(spark, sf), "month", SEGMENTS, 2, 1, 12), 2)


@query("vecm")
def q_vecm(spark, sf):
    """Forecasts of the five segments from their error-correction form, the rank by the trace test."""
    from ..operators import tsmodels
    w = _system(spark, sf)
    return rounded(tsmodels.vecm_forecast(w, "month", tsmodels.vecm_fit(w, "month", SEGMENTS, 2, None, "const"), 12), 2)


@query("vecm_relations")
def q_vecm_relations(spark, sf):
    from ..operators import tsmodels
    fit = tsmodels.vecm_fit(_system(spark, sf), "month", SEGMENTS, 2, 1)
    rows = [(c, float(fit["beta"][i, 0]), float(fit["alpha"][i, 0]), float(fit["trace"][i]))
            for i, c in enumerate(SEGMENTS)]
    return rounded(spark.createDataFrame(rows, "series_id string, beta double, alpha double, trace_stat double"))


# Quarterly revenue on the monthly order counts up to each quarter's end
QUARTER = "CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR)"


def midas_input(spark, sf):
    o = table(spark, sf, "orders")
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    y = o.groupBy(q.alias("quarter")).agg(F.round(F.sum("o_totalprice") / 1e6, 4).alias("revenue"))
    x = o.groupBy(q.alias("quarter"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("month")).agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"))
    return y, x


@query("midas", f"""WITH m AS (SELECT {QUARTER} AS quarter, date_trunc('month', o_orderdate) AS month, count(*)::DOUBLE AS x FROM orders GROUP BY 1, 2),
l AS (SELECT quarter, month, {", ".join(f"lag(x, {j}) OVER (ORDER BY month) AS x{j}" for j in range(5))} FROM m),
z AS (SELECT quarter, {" + ".join(f"arg_max(x{j}, month)" for j in range(5))} AS z0, {" + ".join(f"{j + 1} * arg_max(x{j}, month)" for j in range(5))} AS z1 FROM l GROUP BY 1),
y AS (SELECT {QUARTER} AS quarter, round(sum(o_totalprice) / 1e6, 4) AS y FROM orders GROUP BY 1),
d AS (SELECT * FROM y JOIN z USING (quarter) WHERE z0 IS NOT NULL),
s AS (SELECT covar_pop(z0, z0) AS a, covar_pop(z0, z1) AS b, covar_pop(z1, z1) AS c, covar_pop(z0, y) AS p, covar_pop(z1, y) AS q,
             avg(y) AS my, avg(z0) AS m0, avg(z1) AS m1, var_pop(y) AS v, count(*) AS n FROM d),
t AS (SELECT (c * p - b * q) / (a * c - b * b) AS t0, (a * q - b * p) / (a * c - b * b) AS t1, * FROM s),
f AS (SELECT my - t0 * m0 - t1 * m1 AS i, t0, t1, 1.959963984540054 * sqrt((v - t0 * p - t1 * q) * n / (n - 3)) AS w FROM t)
SELECT quarter, round(i + t0 * z0 + t1 * z1, 4) AS predicted, round(i + t0 * z0 + t1 * z1 - w, 4) AS lower, round(i + t0 * z0 + t1 * z1 + w, 4) AS upper
FROM z, f WHERE z0 IS NOT NULL""")
def q_midas(spark, sf):
    """Almon weights over a month and the four before it, and the fitted value of every quarter."""
    from ..operators import tsmodels
    y, x = midas_input(spark, sf)
    fit = tsmodels.midas_fit(y, x, "quarter", "revenue", "month", "n_orders")
    return rounded(tsmodels.midas_forecast(fit, x, "quarter", "month", "n_orders"), 4)


@query("midas_nealmon")
def q_midas_nealmon(spark, sf):
    from ..operators import tsmodels
    y, x = midas_input(spark, sf)
    fit = tsmodels.midas_fit(y, x, "quarter", "revenue", "month", "n_orders", poly="nealmon")
    rows = [(j, float(w)) for j, w in enumerate(fit["weights"])] + [(-1, float(fit["intercept"]))]
    return rounded(spark.createDataFrame(rows, "lag int, weight double"), 4)


@query("prophet")
def q_prophet(spark, sf):
    from ..operators import tsmodels
    return rounded(tsmodels.prophet_forecast(monthly_input(spark, sf), ["series_id"], "month", "y", 12, "month"), 2)


@query("tbats")
def q_tbats(spark, sf):
    from ..operators import recipe, tsmodels
    df = monthly_input(spark, sf)
    lam = recipe.boxcox_lambda(df, "y")
    return rounded(tsmodels.harmonic_forecast(df, ["series_id"], "month", "y", [12.0], 12, 5, lam), 2)
