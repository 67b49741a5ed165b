"""Spark queries against their DuckDB twins on the smallest scale (the full
set runs in tools/check_oracle.py at sf0.01)."""

import duckdb
import pytest

from tabloom.session import TABLES

from conftest import SF_SMALL

SUBSET = ["profile_columns", "missingness", "correlation_matrix", "impute", "lump_rare", "target_encode",
          "bin_quantile", "date_features", "lag_features", "forecast_snaive", "regression_metrics",
          "classification_metrics", "flatten_stats", "pii_scan", "k_anonymity", "survey_mean_taylor",
          "survey_proportion", "replicate_design_jk1", "mi_mean", "did_2x2", "rolling_origin_cv", "scan_csv",
          "correlation_kendall", "correlation_spearman", "survey_quantile", "robust_scale", "clip", "impute_date",
          "replicate_design_jkn", "crosstab_chisq", "panel_summary", "stream_profile", "scan_json_array",
          "partial_dependence", "batch_score", "privacy_audit_log", "sink_run_tables", "model_presets",
          "iv_diagnostics", "cross_validate_lm", "glmnet_path", "survey_quantile_woodruff", "mi_quantile", "midas",
          "make_replicates_jk1", "panel_waves", "unweighted_shares", "top_k_importance"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _canon(v):
    if isinstance(v, float):
        return repr(float(v))
    return str(v)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_duckdb(spark, duck, name):
    import __spark_entry__ as E
    sdf = E.queries()[name](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    order = sorted(sdf.columns)
    srows = sorted(tuple(_canon(r[c]) for c in order) for r in sdf.collect())
    dcols = rel.columns
    drows = sorted(tuple(_canon(r[dcols.index(c)]) for c in order) for r in rel.fetchall())
    assert srows == drows
