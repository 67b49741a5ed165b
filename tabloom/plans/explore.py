"""Profiling / exploration queries (flagship block)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detect, profile
from ..session import table
from . import inputs
from .catalog import query, rounded

# ---------------------------------------------------------------- SQL twins


def _profile_sql() -> str:
    parts = []
    for name, cls, is_num in inputs.PROFILE_COLUMNS:
        if is_num:
            parts.append(f"""
SELECT '{name}' AS column, '{cls}' AS class, true AS is_numeric, count(*) AS n,
       count(*) - count({name}) AS n_missing, count(DISTINCT {name}) AS n_unique,
       (SELECT avg(power(({name} - m) / sd, 3)) FROM t, (SELECT avg({name}) m, stddev_samp({name}) sd FROM t) s
         WHERE {name} IS NOT NULL AND sd > 0) AS skew_raw,
       (SELECT count(*) FROM t, (SELECT quantile_cont({name}, 0.25) q1, quantile_cont({name}, 0.75) q3 FROM t) q
         WHERE {name} < q1 - 1.5 * (q3 - q1) OR {name} > q3 + 1.5 * (q3 - q1)) AS outl
FROM t""")
        else:
            parts.append(f"""
SELECT '{name}' AS column, '{cls}' AS class, false AS is_numeric, count(*) AS n,
       count(*) - count({name}) AS n_missing, count(DISTINCT {name}) AS n_unique,
       CAST(NULL AS DOUBLE) AS skew_raw, CAST(NULL AS BIGINT) AS outl
FROM t""")
    body = " UNION ALL ".join(parts)
    return f"""
WITH t AS ({inputs.PROFILE_INPUT_SQL}),
s AS ({body}),
p AS (
  SELECT "column", class, CAST(n_missing AS BIGINT) AS n_missing,
         round(100.0 * n_missing / n, 2) AS pct_missing, CAST(n_unique AS BIGINT) AS n_unique, is_numeric,
         CASE WHEN is_numeric AND n_unique > 2 THEN skew_raw END AS skew_full,
         CASE WHEN is_numeric AND n_unique > 4 THEN CAST(outl AS BIGINT) END AS n_outliers,
         n_unique <= 1 AS is_constant,
         n_unique > 1 AND n_unique < greatest(2.0, ceil(0.005 * n)) AS is_quasi_const,
         n_unique = n - n_missing AND NOT is_numeric AS is_id_like,
         CAST(n_missing AS DOUBLE) / n AS mr, n
  FROM s)
SELECT "column", class, n_missing, pct_missing, n_unique, is_numeric, round(skew_full, 3) AS skew, n_outliers,
       is_constant, is_quasi_const, is_id_like,
       CASE WHEN is_constant THEN 'CRITICAL' WHEN mr > 0.6 THEN 'CRITICAL'
            WHEN is_id_like OR is_quasi_const THEN 'WARN' WHEN mr > 0.2 THEN 'WARN'
            WHEN is_numeric AND skew_full IS NOT NULL AND abs(skew_full) > 1.5 THEN 'WARN' ELSE 'OK' END AS severity,
       coalesce(nullif(concat_ws('; ',
            CASE WHEN is_constant THEN 'Zero variance - drop' END,
            CASE WHEN is_quasi_const THEN 'Quasi-constant - likely drop' END,
            CASE WHEN is_id_like THEN 'ID-like - drop or hash' END,
            CASE WHEN mr > 0.2 THEN printf('%.0f%% missing', 100 * mr) END,
            CASE WHEN is_numeric AND skew_full IS NOT NULL AND abs(skew_full) > 1.5
                 THEN printf('skew=%.2f - power transform', skew_full) END,
            CASE WHEN n_outliers IS NOT NULL AND n_outliers > 0.05 * n
                 THEN printf('%d outliers (IQR)', n_outliers) END), ''), 'Healthy') AS finding
FROM p"""


PROFILE_SQL = _profile_sql()


@query("profile_columns", PROFILE_SQL)
def q_profile_columns(spark, sf):
    return profile.profile_columns(inputs.profile_input(spark, sf))


@query("health_grade", f"""
WITH pr AS ({PROFILE_SQL})
SELECT CASE WHEN count_if(severity = 'CRITICAL') > 0 THEN 'FAIL'
            WHEN count_if(severity = 'WARN') > count_if(severity = 'OK') THEN 'WEAK' ELSE 'PASS' END AS grade,
       CAST(count_if(severity = 'CRITICAL') AS BIGINT) AS n_critical,
       CAST(count_if(severity = 'WARN') AS BIGINT) AS n_warn,
       CAST(count_if(severity = 'OK') AS BIGINT) AS n_ok,
       round(avg(pct_missing), 2) AS overall_missing_pct
FROM pr""")
def q_health_grade(spark, sf):
    return profile.health_grade(profile.profile_columns(inputs.profile_input(spark, sf)))


def _missing_sql() -> str:
    parts = [f"SELECT '{n}' AS column, round(100.0 * (count(*) - count({n})) / count(*), 4) AS pct_missing FROM t"
             for n, _, _ in inputs.PROFILE_COLUMNS]
    return f"WITH t AS ({inputs.PROFILE_INPUT_SQL}) " + " UNION ALL ".join(parts)


@query("missingness", _missing_sql())
def q_missingness(spark, sf):
    return profile.missingness(inputs.profile_input(spark, sf))


def _schema_sql() -> str:
    parts = []
    for n, cls, is_num in inputs.PROFILE_COLUMNS:
        txt = f"CAST(CAST({n} AS DOUBLE) AS VARCHAR)" if is_num else f"CAST({n} AS VARCHAR)"
        order = f"CAST({n} AS DOUBLE)" if is_num else f"CAST({n} AS VARCHAR)"
        parts.append(f"""
SELECT '{n}' AS column, '{cls.split('/')[0]}' AS type,
       CAST(count(*) - count({n}) AS BIGINT) AS n_missing,
       CAST(count(DISTINCT {n}) + (CASE WHEN count(*) > count({n}) THEN 1 ELSE 0 END) AS BIGINT) AS n_unique,
       (SELECT string_agg(v, ', ' ORDER BY o) FROM (SELECT DISTINCT {txt} AS v, {order} AS o FROM t
          WHERE {n} IS NOT NULL ORDER BY o LIMIT 3)) AS sample
FROM t""")
    return f"WITH t AS ({inputs.PROFILE_INPUT_SQL}) " + " UNION ALL ".join(parts)


@query("schema_summary", _schema_sql())
def q_schema_summary(spark, sf):
    return profile.schema_summary(inputs.profile_input(spark, sf))


@query("leakage_numeric", f"""
WITH t AS ({inputs.LINE_NUMERIC_SQL}),
r AS (
  {" UNION ALL ".join(f"SELECT '{c}' AS column, corr({c}, l_extendedprice) AS r, count_if({c} IS NOT NULL AND l_extendedprice IS NOT NULL) AS n_pairs FROM t" for c in inputs.LINE_NUM_COLUMNS if c != 'l_extendedprice')})
SELECT "column", printf('|cor|=%.4f', r) AS relation, 'near-perfect correlation' AS risk
FROM r WHERE n_pairs > 5 AND r IS NOT NULL AND abs(r) > 0.99""")
def q_leakage_numeric(spark, sf):
    return profile.leakage_numeric(inputs.line_numeric(spark, sf), "l_extendedprice", inputs.LINE_NUM_COLUMNS)


@query("leakage_categorical", """
WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderpriority,
                  CASE WHEN o_totalprice > 250000 THEN 'high' ELSE 'low' END AS price_band FROM orders),
tot AS (SELECT var_samp(o_totalprice) AS tv, count(*) AS n FROM t),
g AS (
  SELECT 'o_orderstatus' AS column, var_samp(gm) AS bv, count(*) AS k FROM (SELECT o_orderstatus, avg(o_totalprice) gm FROM t WHERE o_orderstatus IS NOT NULL GROUP BY 1)
  UNION ALL SELECT 'o_orderpriority', var_samp(gm), count(*) FROM (SELECT o_orderpriority, avg(o_totalprice) gm FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1)
  UNION ALL SELECT 'price_band', var_samp(gm), count(*) FROM (SELECT price_band, avg(o_totalprice) gm FROM t WHERE price_band IS NOT NULL GROUP BY 1)),
r AS (SELECT "column", CASE WHEN tv > 0 THEN bv * k / n / tv ELSE 0.0 END AS ratio FROM g, tot)
SELECT "column", printf('between/total var=%.3f', ratio) AS relation, 'groups explain ~all variance' AS risk,
       round(ratio, 6) AS ratio
FROM r""")
def q_leakage_categorical(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("price_band"))
    cols = ["o_orderstatus", "o_orderpriority", "price_band"]
    return rounded(profile.leakage_ratios(o, "o_totalprice", cols))



def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@query("correlation_matrix", f"""
WITH t AS ({inputs.LINE_NUMERIC_SQL})
{" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS cor FROM t" for a, b in _pairs(inputs.LINE_NUM_COLUMNS))}""")
def q_correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(inputs.line_numeric(spark, sf), inputs.LINE_NUM_COLUMNS))


def _spearman_sql(cols) -> str:
    ranked = ", ".join(
        f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0) AS r_{c}" for c in cols)
    body = " UNION ALL ".join(
        f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr(r_{a}, r_{b}), 6) AS cor FROM rk" for a, b in _pairs(cols))
    return f"WITH t AS ({inputs.LINE_NUMERIC_SQL}), rk AS (SELECT {ranked} FROM t) {body}"


@query("correlation_spearman", _spearman_sql(inputs.LINE_NUM_COLUMNS))
def q_correlation_spearman(spark, sf):
    return rounded(profile.correlation_spearman(inputs.line_numeric(spark, sf), inputs.LINE_NUM_COLUMNS))


def _kendall_sql(table_name, cols):
    return " UNION ALL ".join(f"""SELECT '{a}' AS var1, '{b}' AS var2, round(
       sum(sign(CAST(s.{a} - t.{a} AS DOUBLE)) * sign(CAST(s.{b} - t.{b} AS DOUBLE)))
       / sqrt(sum(abs(sign(CAST(s.{a} - t.{a} AS DOUBLE)))) * sum(abs(sign(CAST(s.{b} - t.{b} AS DOUBLE))))), 6) AS cor
FROM {table_name} s, {table_name} t""" for a, b in _pairs(cols))


KENDALL_COLUMNS = ["p_partkey", "p_size", "p_retailprice"]


@query("correlation_kendall", _kendall_sql("part", KENDALL_COLUMNS))
def q_correlation_kendall(spark, sf):
    return rounded(profile.correlation_kendall(table(spark, sf, "part"), KENDALL_COLUMNS))


@query("top_correlated_pairs", f"""
WITH t AS ({inputs.LINE_NUMERIC_SQL}),
c AS ({" UNION ALL ".join(f"SELECT '{a}' AS var1, '{b}' AS var2, corr({a}, {b}) AS cor FROM t" for a, b in _pairs(inputs.LINE_NUM_COLUMNS))})
SELECT var1, var2, round(cor, 4) AS cor, round(abs(cor), 4) AS abs_cor FROM c
ORDER BY abs_cor DESC, var1, var2 LIMIT 10""")
def q_top_correlated_pairs(spark, sf):
    pairs = profile.correlation_matrix(inputs.line_numeric(spark, sf), inputs.LINE_NUM_COLUMNS)
    return profile.top_correlated_pairs(pairs, 10)


@query("target_histogram", """
WITH r AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders),
b AS (SELECT CASE WHEN hi = lo THEN 1 ELSE least(30, CAST(floor((o_totalprice - lo) / ((hi - lo) / 30)) AS INTEGER) + 1) END AS bin,
             lo, hi FROM orders, r)
SELECT bin, round(lo + (bin - 1) * (hi - lo) / 30, 6) AS lower, round(lo + bin * (hi - lo) / 30, 6) AS upper,
       CAST(count(*) AS BIGINT) AS n
FROM b GROUP BY bin, lo, hi""")
def q_target_histogram(spark, sf):
    return rounded(profile.target_histogram(table(spark, sf, "orders"), "o_totalprice", 30))


@query("target_counts", """
SELECT CAST(o_orderpriority AS VARCHAR) AS level, count(*) AS n FROM orders GROUP BY 1""")
def q_target_counts(spark, sf):
    return profile.target_counts(table(spark, sf, "orders"), "o_orderpriority")


# ---------------------------------------------------------------- detection

@query("detect_task_type", """
WITH l AS (SELECT d.doc_id, quality, toxic, n_chars, CAST(quality AS DOUBLE) / 2 AS half_quality,
                  CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS quality_label, lang
           FROM labels JOIN documents d USING (doc_id)),
c AS (
  SELECT 'n_chars' AS column, count(DISTINCT n_chars) AS nd, bool_and(n_chars = floor(n_chars)) AS is_int,
         min(n_chars) AS mn, max(n_chars) AS mx, true AS is_num FROM l
  UNION ALL SELECT 'half_quality', count(DISTINCT half_quality), bool_and(half_quality = floor(half_quality)),
         min(half_quality), max(half_quality), true FROM l
  UNION ALL SELECT 'quality_label', count(DISTINCT quality_label), NULL, NULL, NULL, false FROM l
  UNION ALL SELECT 'lang', count(DISTINCT lang), NULL, NULL, NULL, false FROM l
  UNION ALL SELECT 'toxic', count(DISTINCT toxic), bool_and(toxic = floor(toxic)), min(toxic), max(toxic), true FROM l)
SELECT "column",
       CASE WHEN NOT is_num AND nd = 2 THEN 'binary_classification'
            WHEN NOT is_num THEN 'multiclass_classification'
            WHEN is_int AND mn >= 0 AND nd > 2 AND mx < 1e6 THEN 'count'
            WHEN mn >= 0 AND mx <= 1 THEN 'proportion'
            ELSE 'regression' END AS task_type
FROM c""")
def q_detect_task_type(spark, sf):
    lab, doc = table(spark, sf, "labels"), table(spark, sf, "documents")
    l = lab.join(doc, "doc_id").select(
        "n_chars", (F.col("quality").cast("double") / 2).alias("half_quality"),
        F.when(F.col("quality") == 1, "good").otherwise("bad").alias("quality_label"), "lang", "toxic")
    return detect.detect_task_types(l, ["n_chars", "half_quality", "quality_label", "lang", "toxic"])


def _codebook_basic_sql() -> str:
    parts = [f"""SELECT '{n}' AS variable, '' AS label, '{cls}' AS class, CAST(count(*) - count({n}) AS BIGINT) AS n_missing,
       round(100.0 * (count(*) - count({n})) / greatest(count(*), 1), 2) AS pct_missing,
       CAST(count(DISTINCT {n}) AS BIGINT) AS n_unique, '' AS value_labels FROM t""" for n, cls, _ in inputs.PROFILE_COLUMNS]
    return f"WITH t AS ({inputs.PROFILE_INPUT_SQL}) " + " UNION ALL ".join(parts)


@query("codebook_basic", _codebook_basic_sql())
def q_codebook_basic(spark, sf):
    return profile.codebook_basic(inputs.profile_input(spark, sf))


def _codebook_rich_sql() -> str:
    parts = []
    for n, cls, is_num in inputs.PROFILE_COLUMNS:
        typ = "numeric" if is_num else ("datetime" if cls.startswith("POSIX") else "character")
        txt = f"printf('%g', CAST({n} AS DOUBLE))" if is_num else f"CAST({n} AS VARCHAR)"
        order = f"CAST({n} AS DOUBLE)" if is_num else f"CAST({n} AS VARCHAR)"
        if is_num:
            summ = (f"(SELECT printf('min=%g · Q25=%g · med=%g · Q75=%g · max=%g', quantile_cont({n}, 0.0), "
                    f"quantile_cont({n}, 0.25), quantile_cont({n}, 0.5), quantile_cont({n}, 0.75), "
                    f"quantile_cont({n}, 1.0)) FROM t)")
        elif typ == "character":
            summ = (f"coalesce((SELECT string_agg(l || '=' || CAST(c AS VARCHAR), '; ' ORDER BY c DESC, l) FROM "
                    f"(SELECT {n} AS l, count(*) AS c FROM t WHERE {n} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)), '')")
        else:
            summ = "''"
        parts.append(f"""SELECT '{n}' AS name, '{typ}' AS type, '' AS label, 0 AS n_value_labels, '' AS value_labels_str,
       round(100.0 * (count(*) - count({n})) / count(*), 2) AS pct_missing, CAST(count(DISTINCT {n}) AS INTEGER) AS n_unique,
       coalesce((SELECT CASE WHEN length(s) > 80 THEN substr(s, 1, 77) || '...' ELSE s END FROM
                 (SELECT string_agg(v, ' | ' ORDER BY o) AS s FROM (SELECT DISTINCT {txt} AS v, {order} AS o FROM t
                  WHERE {n} IS NOT NULL ORDER BY o LIMIT 3))), '') AS sample,
       {summ} AS summary FROM t""")
    return f"WITH t AS ({inputs.PROFILE_INPUT_SQL}) " + " UNION ALL ".join(parts)


@query("codebook_rich", _codebook_rich_sql())
def q_codebook_rich(spark, sf):
    return profile.codebook_rich(inputs.profile_input(spark, sf))
