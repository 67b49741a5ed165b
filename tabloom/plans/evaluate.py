"""Metric, diagnostic and run-registry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.fmt import c_fixed
from ..functions.ranks import attach_groups, attach_scalars
from ..operators import metrics, registry
from ..session import table
from .catalog import query, rounded

PRED_SQL = """WITH g AS (SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 4) AS gm
                         FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey * 10 + l_linenumber AS idx, l_returnflag, l_linestatus, l_shipdate,
       l_extendedprice AS actual, gm AS predicted
FROM lineitem JOIN g USING (l_returnflag, l_linestatus)"""


def preds(spark, sf):
    li = table(spark, sf, "lineitem")
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg("l_extendedprice"), 4).alias("gm"))
    return attach_groups(li, g, ["l_returnflag", "l_linestatus"]).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), "l_returnflag", "l_linestatus",
        "l_shipdate", F.col("l_extendedprice").alias("actual"), F.col("gm").alias("predicted"))


def _with_row_hash(p):
    """A draw key per row from all its values, so that lines of one order draw apart."""
    return p.withColumn("row", F.xxhash64(*p.columns))


CLS_SQL = """SELECT l_orderkey * 10 + l_linenumber AS idx, l_linestatus,
       CASE WHEN l_returnflag = 'R' THEN 'yes' ELSE 'no' END AS actual,
       CASE WHEN l_discount > 0.05 THEN 'yes' ELSE 'no' END AS predicted FROM lineitem"""


def cls_preds(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), "l_linestatus",
                     F.when(F.col("l_returnflag") == "R", "yes").otherwise("no").alias("actual"),
                     F.when(F.col("l_discount") > 0.05, "yes").otherwise("no").alias("predicted"))


@query("regression_metrics", f"""WITH p AS ({PRED_SQL})
SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse,
       round(avg(abs(actual - predicted)), 4) AS mae,
       round(avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100, 4) AS mape,
       round(CASE WHEN var_pop(actual) * count(*) > 0
                  THEN 1 - sum((actual - predicted) * (actual - predicted)) / (var_pop(actual) * count(*)) END, 4) AS r2
FROM p GROUP BY 1""")
def q_regression_metrics(spark, sf):
    return metrics.regression_metrics(preds(spark, sf), "actual", "predicted", ["l_returnflag"])


@query("classification_metrics", f"""WITH p AS ({CLS_SQL}),
c AS (SELECT l_linestatus, count(DISTINCT actual) AS k, max(actual) AS pos,
             avg(CAST(actual = predicted AS DOUBLE)) AS acc FROM p GROUP BY 1),
t AS (SELECT p.l_linestatus, any_value(k) AS k, any_value(acc) AS acc,
             count_if(actual = pos AND predicted = pos) AS tp, count_if(actual <> pos AND predicted = pos) AS fp,
             count_if(actual = pos AND predicted <> pos) AS fn FROM p JOIN c USING (l_linestatus) GROUP BY 1),
m AS (SELECT l_linestatus, acc,
             CASE WHEN k = 2 AND tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) END AS prec,
             CASE WHEN k = 2 AND tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) END AS rec FROM t)
SELECT l_linestatus, round(acc, 4) AS accuracy, round(prec, 4) AS precision, round(rec, 4) AS recall,
       round(CASE WHEN prec IS NOT NULL AND rec IS NOT NULL AND prec + rec > 0 THEN 2 * prec * rec / (prec + rec) END, 4) AS f1
FROM m""")
def q_classification_metrics(spark, sf):
    return metrics.classification_metrics(cls_preds(spark, sf), "actual", "predicted", ["l_linestatus"])


@query("confusion_matrix", f"""WITH p AS ({CLS_SQL})
SELECT l_linestatus, actual, predicted, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def q_confusion_matrix(spark, sf):
    return metrics.confusion_matrix(cls_preds(spark, sf), "actual", "predicted", ["l_linestatus"])


@query("bootstrap_metric")
def q_bootstrap_metric(spark, sf):
    return rounded(metrics.bootstrap_rmse(_with_row_hash(preds(spark, sf)), "actual", "predicted", "row", ["l_returnflag"], 200, 42))


@query("residual_stats", f"""WITH p AS ({PRED_SQL}),
r AS (SELECT l_returnflag, l_linestatus, l_shipdate, idx, actual, predicted, actual - predicted AS r FROM p),
m AS (SELECT l_returnflag, avg(r) AS mu FROM r GROUP BY 1),
d AS (SELECT r.*, r - mu AS d FROM r JOIN m USING (l_returnflag)),
l AS (SELECT *, lag(d) OVER (PARTITION BY l_returnflag ORDER BY l_shipdate, idx, actual, l_linestatus) AS l1 FROM d),
g AS (SELECT l_returnflag, count(*) AS n, avg(r) AS bias, stddev_samp(r) AS sd, sum(d * l1) / sum(d * d) AS acf1,
             corr(abs(r), predicted) AS hc FROM l GROUP BY 1)
SELECT l_returnflag, CAST(n AS BIGINT) AS n, round(bias, 6) AS bias, round(sd, 6) AS sd, round(acf1, 6) AS acf1,
       round(hc, 6) AS hetero_cor, round(hc * sqrt((n - 2) / (1 - hc * hc)), 6) AS hetero_t FROM g""")
def q_residual_stats(spark, sf):
    # (l_shipdate, idx) has ties in this data; the remaining ties share the residual
    return rounded(metrics.residual_stats(preds(spark, sf), "actual", "predicted",
                                          ["l_shipdate", "idx", "actual", "l_linestatus"], ["l_returnflag"]))


@query("residual_histogram", f"""WITH p AS ({PRED_SQL}),
x AS (SELECT actual - predicted AS r FROM p),
s AS (SELECT min(r) AS lo, max(r) AS hi FROM x),
b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(30, CAST(floor((r - lo) / ((hi - lo) / 30)) AS INTEGER) + 1) END AS bin,
             lo, hi FROM x, s)
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 30, 6) AS lower, round(lo + bin * (hi - lo) / 30, 6) AS upper,
       CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin, lo, hi""")
def q_residual_histogram(spark, sf):
    return rounded(metrics.residual_histogram(preds(spark, sf), "actual", "predicted", 30))


@query("prediction_frame", f"""WITH p AS ({PRED_SQL})
SELECT idx, actual, predicted, round(actual - predicted, 6) AS residual, CAST(NULL AS DOUBLE) AS lower,
       CAST(NULL AS DOUBLE) AS upper FROM p""")
def q_prediction_frame(spark, sf):
    return rounded(metrics.prediction_frame(preds(spark, sf), "idx", "actual", "predicted"))


# ----------------------------------------------------------------- run registry
# runs: one per order priority, naive group-mean model, metrics as JSON text
RUNS_SQL = """WITH p AS (SELECT o_orderpriority, o_totalprice AS a,
                          round(avg(o_totalprice) OVER (PARTITION BY o_orderstatus), 4) AS p FROM orders),
m AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id, count(*) AS n,
             sqrt(avg((a - p) * (a - p))) AS rmse, avg(abs(a - p)) AS mae FROM p GROUP BY 1)
SELECT id, id % 2 + 1 AS dataset_id, CASE WHEN id % 2 = 0 THEN 'lm' ELSE 'ranger_reg' END AS model_id,
       'regression' AS task_type,
       '{"rmse":"' || printf('%.4f', rmse) || '","mae":"' || printf('%.4f', mae) || '","n":"' || CAST(n AS VARCHAR) || '"}' AS metrics_json,
       '{"seed":"42","order":"' || CAST(id AS VARCHAR) || '"}' AS params_json,
       CAST(12 AS INTEGER) AS horizon, CAST(NULL AS DOUBLE) AS duration_sec, 'ok' AS status,
       '2024-01-0' || CAST(id AS VARCHAR) AS created_at
FROM m"""


def runs_input(spark, sf):
    o = table(spark, sf, "orders")
    means = o.groupBy("o_orderstatus").agg(F.round(F.avg("o_totalprice"), 4).alias("p"))   # one row a status
    p = o.join(means, "o_orderstatus").select("o_orderpriority", F.col("o_totalprice").alias("a"), "p")
    e = F.col("a") - F.col("p")
    m = p.groupBy(F.substring("o_orderpriority", 1, 1).cast("long").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return m.select(
        "id", (F.col("id") % 2 + 1).alias("dataset_id"),
        F.when(F.col("id") % 2 == 0, "lm").otherwise("ranger_reg").alias("model_id"),
        F.lit("regression").alias("task_type"),
        F.concat(F.lit('{"rmse":"'), c_fixed(F.col("rmse"), 4), F.lit('","mae":"'), c_fixed(F.col("mae"), 4),
                 F.lit('","n":"'), F.col("n").cast("string"), F.lit('"}')).alias("metrics_json"),
        F.concat(F.lit('{"seed":"42","order":"'), F.col("id").cast("string"), F.lit('"}')).alias("params_json"),
        F.lit(12).alias("horizon"), F.lit(None).cast("double").alias("duration_sec"), F.lit("ok").alias("status"),
        F.concat(F.lit("2024-01-0"), F.col("id").cast("string")).alias("created_at"))


DATASETS_SQL = "SELECT CAST(1 AS BIGINT) AS id, 'orders' AS name, count(*) AS n_rows FROM orders"


def datasets_input(spark, sf):
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(1).cast("long").alias("id"), F.lit("orders").alias("name"), "n_rows")


@query("runs_join_datasets", f"""WITH runs AS ({RUNS_SQL}), datasets AS ({DATASETS_SQL})
SELECT r.id, r.created_at, d.name AS dataset, r.model_id, r.task_type, r.metrics_json, r.params_json,
       r.horizon, r.duration_sec, r.status
FROM runs r LEFT JOIN datasets d ON d.id = r.dataset_id""")
def q_runs_join_datasets(spark, sf):
    return registry.runs_join_datasets(runs_input(spark, sf), datasets_input(spark, sf))


@query("flatten_stats", f"""WITH runs AS ({RUNS_SQL}),
f AS (SELECT id AS run_id, model_id AS model, task_type AS task, 'metric' AS kind, k AS key,
             json_extract_string(metrics_json, '$.' || k) AS value FROM runs, unnest(json_keys(metrics_json)) AS t(k)
      UNION ALL
      SELECT id, model_id, task_type, 'param', k, json_extract_string(params_json, '$.' || k)
      FROM runs, unnest(json_keys(params_json)) AS t(k))
SELECT *, TRY_CAST(value AS DOUBLE) AS numeric_value FROM f""")
def q_flatten_stats(spark, sf):
    return registry.flatten_stats(runs_input(spark, sf))


@query("stats_search", f"""WITH runs AS ({RUNS_SQL}),
f AS (SELECT id AS run_id, model_id AS model, task_type AS task, 'metric' AS kind, k AS key,
             json_extract_string(metrics_json, '$.' || k) AS value FROM runs, unnest(json_keys(metrics_json)) AS t(k)
      UNION ALL
      SELECT id, model_id, task_type, 'param', k, json_extract_string(params_json, '$.' || k)
      FROM runs, unnest(json_keys(params_json)) AS t(k))
SELECT *, TRY_CAST(value AS DOUBLE) AS numeric_value FROM f
WHERE contains(lower(concat_ws(' ', key, value, kind)), 'rmse')""")
def q_stats_search(spark, sf):
    return registry.stats_search(registry.flatten_stats(runs_input(spark, sf)), "RMSE")


@query("leaderboard", f"""WITH runs AS ({RUNS_SQL})
SELECT id, model_id, task_type, 'rmse' AS primary_metric,
       TRY_CAST(json_extract_string(metrics_json, '$.rmse') AS DOUBLE) AS primary_value,
       CAST(rank() OVER (PARTITION BY task_type ORDER BY TRY_CAST(json_extract_string(metrics_json, '$.rmse') AS DOUBLE) ASC NULLS LAST, id) AS INTEGER) AS rank
FROM runs""")
def q_leaderboard(spark, sf):
    return registry.leaderboard(runs_input(spark, sf))


@query("sort_latest", f"""WITH runs AS ({RUNS_SQL})
SELECT id, model_id, created_at FROM runs ORDER BY created_at DESC""")
def q_sort_latest(spark, sf):
    return runs_input(spark, sf).select("id", "model_id", "created_at").orderBy(F.desc("created_at"))


@query("registry_lookup", f"""WITH p AS ({PRED_SQL})
SELECT idx, actual, predicted FROM p WHERE l_returnflag = 'A' AND l_linestatus = 'F' ORDER BY idx""")
def q_registry_lookup(spark, sf):
    p = preds(spark, sf)
    return p.where((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).select(
        "idx", "actual", "predicted").orderBy("idx")


@query("quality_verdict", f"""WITH p AS ({PRED_SQL}),
m AS (SELECT l_returnflag AS run_id, 'regression' AS task_type, sqrt(avg((actual - predicted) ^ 2)) AS rmse,
             avg(CASE WHEN actual <> 0 THEN abs((actual - predicted) / actual) END) * 100 AS mape,
             CASE WHEN var_pop(actual) > 0 THEN 1 - sum((actual - predicted) ^ 2) / (var_pop(actual) * count(*)) END AS r2,
             avg(actual - predicted) AS bias, count(*) AS n_test FROM p GROUP BY 1),
v AS (SELECT run_id, round(r2, 4) AS r2, rmse, mape, bias, n_test FROM m)
SELECT run_id,
       CASE WHEN r2 >= 0.85 THEN 'PASS' WHEN r2 >= 0.5 THEN 'WEAK' WHEN r2 IS NOT NULL THEN 'FAIL' ELSE 'WEAK' END AS grade,
       CASE WHEN r2 >= 0.85 THEN 'Strong fit (R2=' || printf('%.3f', r2) || ')'
            WHEN r2 >= 0.5 THEN 'Moderate fit (R2=' || printf('%.3f', r2) || ')'
            WHEN r2 >= 0 THEN 'Poor fit (R2=' || printf('%.3f', r2) || ')'
            WHEN r2 IS NOT NULL THEN 'Worse than mean baseline (R2=' || printf('%.3f', r2) || ')' END AS verdict,
       concat_ws(',', CASE WHEN abs(bias) > 0.1 * (rmse / sqrt(2.0) + 1e-9) THEN 'bias' END,
                 CASE WHEN mape > 50 THEN 'high_mape' END, CASE WHEN n_test < 30 THEN 'small_test' END) AS flags
FROM v""")
def q_quality_verdict(spark, sf):
    p = preds(spark, sf)
    a, pr = F.col("actual"), F.col("predicted")
    m = p.groupBy(F.col("l_returnflag").alias("run_id")).agg(
        F.sqrt(F.avg((a - pr) * (a - pr))).alias("rmse"),
        (F.avg(F.when(a != 0, F.abs((a - pr) / a))) * 100).alias("mape"),
        F.when(F.var_pop(a) > 0, 1 - F.sum((a - pr) * (a - pr)) / (F.var_pop(a) * F.count(F.lit(1)))).alias("r2"),
        F.avg(a - pr).alias("bias"), F.count(F.lit(1)).alias("n_test"))
    m = m.select("run_id", F.lit("regression").alias("task_type"), F.round("r2", 4).alias("r2"), "rmse", "mape",
                 "bias", "n_test", *[F.lit(None).cast("double").alias(c) for c in ("accuracy", "f1", "het_p", "acf1")])
    return registry.quality_verdict(m)


@query("project_diff", """
WITH a AS (SELECT 'orders_F' AS name, CAST(count(*) AS VARCHAR) AS n_rows, 'lm' AS model_id,
                  printf('%.2f', avg(o_totalprice)) AS primary_metric FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT 'orders_O' AS name, CAST(count(*) AS VARCHAR) AS n_rows, 'lm' AS model_id,
             printf('%.2f', avg(o_totalprice)) AS primary_metric FROM orders WHERE o_orderstatus = 'O'),
la AS (UNPIVOT a ON name, n_rows, model_id, primary_metric INTO NAME field VALUE project_a),
lb AS (UNPIVOT b ON name, n_rows, model_id, primary_metric INTO NAME field VALUE project_b)
SELECT coalesce(la.field, lb.field) AS field, project_a, project_b
FROM la FULL OUTER JOIN lb ON la.field = lb.field WHERE project_a IS DISTINCT FROM project_b""")
def q_project_diff(spark, sf):
    o = table(spark, sf, "orders")

    def summary(status):
        return o.where(F.col("o_orderstatus") == status).agg(
            F.count(F.lit(1)).cast("string").alias("n_rows"),
            c_fixed(F.avg("o_totalprice"), 2).alias("primary_metric")).select(
            F.lit(f"orders_{status}").alias("name"), "n_rows", F.lit("lm").alias("model_id"), "primary_metric")
    return registry.project_diff(summary("F"), summary("O"))


@query("dataset_fingerprint")
def q_dataset_fingerprint(spark, sf):
    return registry.dataset_fingerprint(table(spark, sf, "orders"))


@query("run_manifest")
def q_run_manifest(spark, sf):
    fp = registry.dataset_fingerprint(table(spark, sf, "orders"))
    return registry.run_manifest(runs_input(spark, sf), fp, [{"id": "zscore", "targets": "all_numeric"}],
                                 {"weights": "w", "strata": "o_orderpriority"})


@query("sink_run_tables", f"SELECT id, 'replaced' AS status FROM ({RUNS_SQL})")
def q_sink_run_tables(spark, sf):
    """Append the runs twice (second time with a later stamp) and read back the
    latest row per run id - the registry's insert-or-replace."""
    import uuid
    root = registry.registry_path(spark) + f"/check_{uuid.uuid4().hex}"
    r = runs_input(spark, sf)
    registry.append_rows(r, root, "runs")
    registry.append_rows(r.withColumn("status", F.lit("replaced")).withColumn(
        "created_at", F.concat(F.col("created_at"), F.lit(" 12:00:00"))), root, "runs")
    return registry.keep_latest(registry.read_table(spark, root, "runs"), ["id"]).select("id", "status")


@query("inverse_class_weight", f"""WITH p AS ({CLS_SQL}),
c AS (SELECT actual, count(*) AS n FROM p GROUP BY 1)
SELECT idx, round(1.0 / n, 10) AS weight FROM p JOIN c USING (actual)""")
def q_inverse_class_weight(spark, sf):
    p = cls_preds(spark, sf)
    c = p.groupBy("actual").agg(F.count(F.lit(1)).alias("_n"))
    # one row per class: a proven-small lookup
    return rounded(p.join(F.broadcast(c), "actual").select("idx", (1.0 / F.col("_n")).alias("weight")), 10)


@query("custom_metric_bootstrap")
def q_custom_metric_bootstrap(spark, sf):
    """Bootstrap of a user-supplied metric aggregate (here MAE and MAPE)."""
    p = _with_row_hash(preds(spark, sf))
    a = metrics.bootstrap_metric(p, "actual", "predicted", "row", "mae", ["l_returnflag"], 200).withColumn(
        "metric", F.lit("mae"))
    b = metrics.bootstrap_metric(p, "actual", "predicted", "row", "mape", ["l_returnflag"], 200).withColumn(
        "metric", F.lit("mape"))
    return rounded(a.unionByName(b))
