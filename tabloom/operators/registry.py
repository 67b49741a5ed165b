"""Run registry on Parquet: datasets / runs / predictions / analyses /
prep reports / privacy log / survey designs as append-only tables, plus the
reports built on them (flattened stats, leaderboard, rule verdict, project
diff, fingerprint, manifest)."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fmt import c_fixed
from ..functions.ranks import attach_scalars

REGISTRY_TABLES = ("datasets", "runs", "predictions", "analyses", "prep_reports", "privacy_log",
                   "survey_designs")


def registry_path(spark: SparkSession, base: str | None = None) -> str:
    """Registry root: explicit, else under the session's shared checkpoint dir."""
    if base:
        return base
    ck = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    return os.path.join(ck, "tabloom_registry") if ck else "tabloom_registry"


def append_rows(df: DataFrame, root: str, table: str) -> None:
    """Append to ``root/table`` (Parquet), partitioned by ingestion date."""
    (df.withColumn("created_at", F.coalesce(F.col("created_at") if "created_at" in df.columns else F.lit(None),
                                            F.current_timestamp().cast("string")))
       .withColumn("_day", F.to_date(F.col("created_at")))
       .write.mode("append").partitionBy("_day").parquet(os.path.join(root, table)))


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(root, table)).drop("_day")


def keep_latest(df: DataFrame, key: Sequence[str], order_col: str = "created_at") -> DataFrame:
    """INSERT OR REPLACE semantics over an append-only table: newest row per key.
    Grouped ``max_by`` keeps it an aggregate (partial + final), no window sort."""
    others = [c for c in df.columns if c not in key]
    latest = df.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(order_col)).alias("_r"))
    return latest.select(*key, "_r.*")


def runs_join_datasets(runs: DataFrame, datasets: DataFrame) -> DataFrame:
    """runs LEFT JOIN datasets on dataset_id, newest first."""
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("dataset"))
    return (runs.join(d, "dataset_id", "left")
            .select(F.col("id"), "created_at", "dataset", "model_id", "task_type", "metrics_json", "params_json",
                    "horizon", "duration_sec", "status")
            .orderBy(F.desc("id")))


def flatten_stats(runs: DataFrame) -> DataFrame:
    """Each run's metrics and params JSON objects -> long rows
    (run_id, model, task, kind, key, value, numeric_value)."""
    def part(col: str, kind_name: str) -> DataFrame:
        m = F.from_json(F.col(col), "map<string,string>")
        return runs.select(F.col("id").alias("run_id"), F.col("model_id").alias("model"),
                           F.col("task_type").alias("task"), F.lit(kind_name).alias("kind"),
                           F.explode_outer(m).alias("key", "value")).where(F.col("key").isNotNull())
    out = part("metrics_json", "metric").unionByName(part("params_json", "param"))
    return out.withColumn("numeric_value", F.col("value").try_cast("double"))


def stats_search(stats: DataFrame, q: str) -> DataFrame:
    """Case-insensitive contains over key / value / kind."""
    hay = F.lower(F.concat_ws(" ", F.col("key"), F.col("value"), F.col("kind")))
    return stats.where(hay.contains(q.lower()))


def leaderboard(runs: DataFrame) -> DataFrame:
    """Primary metric per run (accuracy for classification, rmse otherwise) and
    its rank within the task (higher accuracy / lower rmse first)."""
    m = F.transform_values(F.from_json(F.col("metrics_json"), "map<string,string>"), lambda k, v: v.try_cast("double"))
    is_cls = F.col("task_type").contains("classification")
    prim = F.when(is_cls, m["accuracy"]).otherwise(m["rmse"])
    x = runs.select("id", "model_id", "task_type", F.when(is_cls, "accuracy").otherwise("rmse").alias("primary_metric"),
                    prim.alias("primary_value"))
    order = F.when(F.col("task_type").contains("classification"), -F.col("primary_value")).otherwise(F.col("primary_value"))
    w = Window.partitionBy("task_type").orderBy(order.asc_nulls_last(), F.col("id"))
    return x.withColumn("rank", F.rank().over(w))


def quality_verdict(metrics: DataFrame) -> DataFrame:
    """Rule grade from r2 (0.85 / 0.5) or accuracy (0.9 / 0.7) and red flags.
    Input columns: run_id, task_type, r2, rmse, mape, accuracy, f1, bias, het_p,
    acf1, n_test (missing ones may be NULL)."""
    cls = F.col("task_type").contains("classification")
    r2, acc = F.col("r2"), F.col("accuracy")
    grade = (F.when(~cls & r2.isNotNull() & (r2 >= 0.85), "PASS")
             .when(~cls & r2.isNotNull() & (r2 >= 0.5), "WEAK")
             .when(~cls & r2.isNotNull(), "FAIL")
             .when(cls & acc.isNotNull() & (acc >= 0.9), "PASS")
             .when(cls & acc.isNotNull() & (acc >= 0.7), "WEAK")
             .when(cls & acc.isNotNull(), "FAIL").otherwise("WEAK"))
    bias_lim = 0.1 * (F.col("rmse") / F.sqrt(F.lit(2.0)) + 1e-9)
    flags = F.array_compact(F.array(
        F.when(~cls & F.col("bias").isNotNull() & (F.abs("bias") > bias_lim), F.lit("bias")),
        F.when(~cls & F.col("het_p").isNotNull() & (F.col("het_p") < 0.05), F.lit("heteroscedastic")),
        F.when(~cls & F.col("acf1").isNotNull() & (F.abs("acf1") > 0.3), F.lit("autocorrelated")),
        F.when(~cls & F.col("mape").isNotNull() & (F.col("mape") > 50), F.lit("high_mape")),
        F.when(cls & F.col("f1").isNotNull() & (F.col("f1") < 0.5), F.lit("low_f1")),
        F.when(F.col("n_test").isNotNull() & (F.col("n_test") < 30), F.lit("small_test"))))
    verdict = (F.when(~cls & r2.isNotNull() & (r2 >= 0.85), F.concat(F.lit("Strong fit (R2="), c_fixed(r2, 3), F.lit(")")))
               .when(~cls & r2.isNotNull() & (r2 >= 0.5), F.concat(F.lit("Moderate fit (R2="), c_fixed(r2, 3), F.lit(")")))
               .when(~cls & r2.isNotNull() & (r2 >= 0), F.concat(F.lit("Poor fit (R2="), c_fixed(r2, 3), F.lit(")")))
               .when(~cls & r2.isNotNull(), F.concat(F.lit("Worse than mean baseline (R2="), c_fixed(r2, 3), F.lit(")")))
               .when(cls & acc.isNotNull(), F.concat(F.lit("Accuracy="), c_fixed(acc, 3))))
    return metrics.select("run_id", grade.alias("grade"), verdict.alias("verdict"),
                          F.array_join(flags, ",").alias("flags"))


def project_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Field-wise comparison of two one-row project summaries; equal fields are
    suppressed; no difference -> one '(no differences)' row."""
    def long(df, name):
        return df.select(F.explode(F.map_from_arrays(
            F.array(*[F.lit(c) for c in df.columns]),
            F.array(*[F.col(c).cast("string") for c in df.columns]))).alias("field", name))
    la, lb = long(a, "project_a"), long(b, "project_b")
    d = la.join(lb, "field", "full_outer").where(~F.col("project_a").eqNullSafe(F.col("project_b")))
    filler = d.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == 0).select(
        F.lit("(no differences)").alias("field"), F.lit("").alias("project_a"), F.lit("").alias("project_b"))
    return d.unionByName(filler)


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content fingerprint: row count plus sum and xor of a
    64-bit hash of every row (detects drift; not the reference's SHA value)."""
    h = F.xxhash64(*[F.col(c) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"),
                  F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"),
                  F.bit_xor(h).alias("hash_xor"))


def run_manifest(run: DataFrame, fingerprint: DataFrame, recipe: list, design: dict | None) -> DataFrame:
    """One JSON document per run: dataset fingerprint, recipe, design, model,
    metrics (built with to_json on the cluster)."""
    rj = json.dumps(recipe)
    dj = json.dumps(design or {})
    fp = fingerprint.select(F.struct(*fingerprint.columns).alias("dataset"))
    x = attach_scalars(run, fp)
    return x.select("id", F.to_json(F.struct(
        F.col("dataset"), F.lit(rj).alias("recipe"), F.lit(dj).alias("design"),
        F.struct("model_id", "task_type", F.col("params_json").alias("params")).alias("model"),
        F.col("metrics_json").alias("metrics"))).alias("manifest"))


def next_project_name(existing: Sequence[str], name: str) -> str:
    """name, name_v2, name_v3, ... (first unused)."""
    if name not in existing:
        return name
    k = 2
    while f"{name}_v{k}" in existing:
        k += 1
    return f"{name}_v{k}"


# ----------------------------------------------------------------- projects

def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def project_list(base_dir: str) -> list[str]:
    """Saved project names, newest first (by manifest time)."""
    base = _local(base_dir)
    if not os.path.isdir(base):
        return []
    out = []
    for n in os.listdir(base):
        m = os.path.join(base, n, "manifest.json")
        if os.path.exists(m):
            with open(m) as fh:
                out.append((json.load(fh).get("saved_at", ""), n))
    return [n for _, n in sorted(out, reverse=True)]


def project_save(df: DataFrame, base_dir: str, name: str, recipe: list | None = None,
                 meta: dict | None = None, recipe_log: list | None = None) -> str:
    """Write the data (Parquet) and a JSON manifest under ``base/name``; an
    existing name gets ``_v2``, ``_v3``, ... ."""
    import datetime
    base = _local(base_dir)
    os.makedirs(base, exist_ok=True)
    final = next_project_name(os.listdir(base), name)
    path = os.path.join(base, final)
    df.write.parquet(os.path.join(path, "data"))
    fp = dataset_fingerprint(df).first().asDict()
    manifest = {"name": final, "saved_at": datetime.datetime.now(datetime.timezone.utc).isoformat(),
                "dataset": fp, "recipe": recipe or [], "recipe_log": recipe_log or [], "meta": meta or {}}
    with open(os.path.join(path, "manifest.json"), "w") as fh:
        json.dump(manifest, fh, default=str)
    return path


def project_load(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    with open(os.path.join(_local(path), "manifest.json")) as fh:
        manifest = json.load(fh)
    return spark.read.parquet(os.path.join(path, "data")), manifest


def reproduce_check(spark: SparkSession, path: str, replay) -> dict:
    """Fingerprint of the stored data equals the manifest's AND replaying the
    recipe gives the same log; does not retrain."""
    df, m = project_load(spark, path)
    fp = dataset_fingerprint(df).first().asDict()
    same_data = all(str(fp[k]) == str(m["dataset"].get(k)) for k in fp)
    _, log = replay(df, m.get("recipe", []))
    same_log = log == m.get("recipe_log", [])
    return {"ok": bool(same_data and same_log), "same_data": same_data, "same_recipe_log": same_log}
