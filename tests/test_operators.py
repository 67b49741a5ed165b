"""Operator properties, following the reference's own test scripts."""

import math

import pytest
from pyspark.sql import functions as F

from tabloom.operators import metrics, mi, models, privacy, profile, recipe, registry, series, survey, validation
from tabloom.operators.recipe import step
from tabloom.sources import readers
from tabloom.session import table

from conftest import SF_SMALL


def _smoke(spark, n=100):
    # recipe smoke fixture: ids, daily dates, numerics, a category, a skewed column
    rows = [(i, f"2024-01-{(i % 28) + 1:02d}", (i % 7) - 3.0, float(i % 5), "ABC"[i % 3], math.exp((i % 10) / 2), float(i))
            for i in range(n)]
    return spark.createDataFrame(rows, "obs_id long, date string, x_num1 double, x_num2 double, x_cat string, "
                                       "x_skewed double, y double")


def test_default_recipe_keeps_predictors(spark):
    df = _smoke(spark).withColumn("date", F.to_date("date"))
    prof = [r.asDict() for r in profile.profile_columns(df).collect()]
    steps = recipe.default_steps(prof, target="y")
    out, log = recipe.apply_recipe(df, steps, target="y", time_col="date")
    assert "y" in out.columns and out.count() == 100
    assert any(c.startswith("x_cat_") for c in out.columns)
    assert len(log) == len(steps)


def test_empty_targets_are_a_no_op(spark):
    df = _smoke(spark)
    out, log = recipe.apply_recipe(df, [step("drop_zero_var", []), step("impute", [])])
    assert out.columns == df.columns
    assert log == ["drop_zero_var -> no eligible columns (skipped)", "impute -> no eligible columns (skipped)"]


def test_unknown_step_is_logged(spark):
    _, log = recipe.apply_recipe(_smoke(spark), [{"id": "nope", "targets": "all"}])
    assert log == ["UNKNOWN step `nope` -> ignored"]


def test_profile_flags(spark):
    df = _smoke(spark).withColumn("const", F.lit(1)).withColumn("code", F.concat(F.lit("id-"), F.col("obs_id")))
    p = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert p["const"]["is_constant"] and p["const"]["severity"] == "CRITICAL"
    assert p["code"]["is_id_like"] and p["code"]["severity"] == "WARN"
    assert p["x_num1"]["n_unique"] == 7


def test_supervised_window_shapes(spark):
    n = 80
    df = spark.createDataFrame([(i, math.sin(i / 5)) for i in range(n)], "t long, y double")
    w = series.supervised_windows(df, ["y"], "y", ["t"], 12)
    assert w.count() == 68 and len(w.first()["X"]) == 12 and len(w.first()["X"][0]) == 1
    df3 = spark.createDataFrame([(i, float(i), float(i * 2), float(i * 3)) for i in range(60)], "t long, a double, b double, c double")
    w3 = series.supervised_windows(df3, ["a", "b", "c"], "c", ["t"], 8)
    assert w3.count() == 52 and len(w3.first()["X"][0]) == 3
    with pytest.raises(ValueError, match="positive integer"):
        series.supervised_windows(df, ["y"], "y", ["t"], 0)


def test_prophet_prepare(spark):
    rows = [(f"2024-01-{d:02d}", 100.0 + d, i) for i, d in enumerate(list(range(1, 31)) + [3, 4, 5, 6, 7])]
    rows += [("2024-02-01", None, 99), ("2024-02-02", None, 100), ("2024-02-03", None, 101)]
    df = spark.createDataFrame(rows, "date string, sales double, _ord long").withColumn("date", F.to_date("date"))
    out = series.prophet_prepare(df, "date", "sales").orderBy("ds")
    assert out.columns == ["ds", "y"] and out.count() == 30
    assert out.where(F.col("ds") == F.lit("2024-01-03").cast("date")).first()["y"] == 103.0
    lg = series.prophet_prepare(df, "date", "sales", growth="logistic", cap=250.0)
    assert set(lg.columns) >= {"cap", "floor"} and lg.first()["floor"] == 0.0
    with pytest.raises(ValueError, match="cap"):
        series.prophet_prepare(df, "date", "sales", growth="logistic")
    with pytest.raises(ValueError, match="growth"):
        series.prophet_prepare(df, "date", "sales", growth="cubic")


def test_train_shape_guard():
    with pytest.raises(ValueError, match="Cannot train"):
        models.train_shape_guard(0, 10, 2, "lm")
    with pytest.raises(ValueError, match="Cannot train"):
        models.train_shape_guard(10, 9, 2, "lm")


def _design_df(spark):
    o = table(spark, SF_SMALL, "orders")
    return o.select((F.col("o_totalprice") / 1000).alias("y"), ((5 + F.col("o_orderkey") % 16) / 10.0).alias("w"),
                    F.col("o_orderpriority").alias("h"), (F.col("o_custkey") % 10).alias("psu"), "o_orderkey")


def test_variance_methods_positive(spark):
    d = _design_df(spark)
    D = survey.Design("w", "h", "psu")
    tay = survey.survey_mean(d, "y", D).first()
    assert tay["se"] > 0 and math.isfinite(tay["se"])
    tot = survey.survey_total(d, "y", D).first()
    assert tot["se"] > 0
    boot = survey.bootstrap_mean(d, "y", D, 50).first()
    assert boot["se"] > 0 and math.isclose(boot["mean"], tay["mean"], rel_tol=1e-12)
    wr = survey.jk1_replicate_weights(d, "w", F.col("o_orderkey") % 20, 20)
    jk = survey.replicate_mean(wr, "y", "w", [f"wr_{i}" for i in range(1, 21)], "JK1").first()
    assert jk["se"] > 0


def test_jk1_matches_taylor_under_srs(spark):
    # JK1 over random groups of an unstratified unit-weight sample ~ the Taylor SE
    d = _design_df(spark).withColumn("one", F.lit(1.0))
    tay = survey.survey_mean(d, "y", survey.Design("one")).first()["se"]
    wr = survey.jk1_replicate_weights(d, "one", F.col("o_orderkey") % 50, 50)
    jk = survey.replicate_mean(wr, "y", "one", [f"wr_{i}" for i in range(1, 51)], "JK1").first()["se"]
    assert abs(jk - tay) / tay < 0.35


def test_mi_pooling(spark):
    d = _design_df(spark).withColumn("implicate", F.explode(F.sequence(F.lit(1), F.lit(5))))
    d = d.withColumn("y_imp", F.col("y") * (1 + ((F.col("o_orderkey") * F.col("implicate")) % 11 - 5) / 100.0))
    D = survey.Design("w", "h", "psu")
    pooled = mi.mi_mean(d, "y_imp", D).first()
    per = survey.survey_mean(d, "y_imp", D, ["implicate"]).agg(F.avg("se").alias("w")).first()["w"]
    assert pooled["m"] == 5 and pooled["std_error"] >= per * 0.999
    assert len(mi.with_p_value(mi.mi_mean(d, "y_imp", D)).columns) == 10
    wide = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id int, y_imp1 double, y_imp2 double, y_imp3 double")
    assert mi.wide_bases(wide.columns) == {"y": ["y_imp1", "y_imp2", "y_imp3"]}
    assert mi.mi_split_wide(wide, mi.wide_bases(wide.columns)).count() == 3


def test_predictor_analysis(spark):
    rows = [(float(i), (i * 7 % 13) / 13.0, (i * 5 % 11) / 11.0) for i in range(100)]
    df = spark.createDataFrame(rows, "i double, x1 double, x2 double").withColumn(
        "y", 1 + 0.7 * F.col("x1") - 0.3 * F.col("x2") + ((F.col("i") * 3) % 7 - 3) / 20.0)
    fit = models.ols(df, "y", ["x1", "x2"])
    assert abs(fit.coef[1] - 0.7) < 0.1 and abs(fit.coef[2] + 0.3) < 0.1
    pdp = validation.partial_dependence(df, lambda d: d.withColumn("prediction", fit.predict({c: F.col(c) for c in ["x1", "x2"]})),
                                        "x1", 10)
    assert pdp.count() == 10
    V = models.robust_se(df, fit, "y", {c: F.col(c) for c in ["x1", "x2"]}, "HC0")
    assert V.shape == (3, 3) and all(V[i, i] > 0 for i in range(3))
    did_rows = [(float(t * 2 + p + (i % 5) / 10), t, p) for t in (0, 1) for p in (0, 1) for i in range(25)]
    did = models.did_2x2(spark.createDataFrame(did_rows, "y double, treat int, post int"), "y", "treat", "post")
    assert math.isclose(did["ate"], 0.0, abs_tol=1e-9)


def test_pseudonymize_and_scan(spark):
    c = table(spark, SF_SMALL, "customer").withColumn("passport_no", F.concat(F.lit("P"), F.col("c_custkey")))
    c = c.withColumn("email", F.concat(F.col("c_custkey"), F.lit("@example.org")))
    scan = [r.asDict() for r in privacy.privacy_scan(c).collect()]
    tags = {r["column"]: r for r in scan}
    assert "email" in tags["email"]["tags"] and tags["email"]["severity"] == "CRITICAL"
    assert "id_doc" in tags["passport_no"]["tags"]
    out = privacy.pseudonymize(c, scan)
    assert "email" not in out.columns and len(out.first()["passport_no"]) == 12


def test_metrics_positive_class_is_second_level(spark):
    df = spark.createDataFrame([("no", "no"), ("yes", "yes"), ("yes", "no"), ("no", "yes")], "a string, p string")
    m = metrics.classification_metrics(df, "a", "p").first()
    assert m["accuracy"] == 0.5 and m["precision"] == 0.5 and m["recall"] == 0.5


def test_project_save_versions_and_reproduce(spark, tmp_path):
    df = _smoke(spark, 20)
    steps = [step("zscore", ["x_num1"]).to_dict()]
    _, log = recipe.apply_recipe(df, steps)
    p1 = registry.project_save(df, str(tmp_path), "demo", steps, {"target": "y"}, log)
    p2 = registry.project_save(df, str(tmp_path), "demo", steps, {"target": "y"}, log)
    assert p1.endswith("demo") and p2.endswith("demo_v2")
    back, m = registry.project_load(spark, p2)
    assert back.count() == 20 and set(m) >= {"name", "saved_at", "dataset", "recipe", "meta"}
    r = registry.reproduce_check(spark, p2, lambda d, s: recipe.apply_recipe(d, s))
    assert r["ok"]


def test_brr_hadamard_and_fay(spark):
    H = survey.hadamard(6)
    assert len(H) == 8 and all(sum(a * b for a, b in zip(H[i], H[j])) == 0 for i in range(8) for j in range(i))
    d = _design_df(spark).withColumn("psu2", F.col("o_orderkey") % 2)
    brr = survey.brr_mean(d, "y", survey.Design("w", "h", "psu2"), 0.0).first()
    fay = survey.brr_mean(d, "y", survey.Design("w", "h", "psu2"), 0.5).first()
    tay = survey.survey_mean(d, "y", survey.Design("w", "h", "psu2")).first()
    assert math.isclose(brr["mean"], tay["mean"], rel_tol=1e-12) and brr["se"] > 0 and fay["se"] > 0


def test_survey_glm_logit_matches_unweighted_glm(spark):
    # equal weights, one PSU per row: the point estimates equal the plain logit MLE
    rows = [(float(i % 10), float((i * 7) % 3), 1.0 if (i * 13) % 7 < 3 + (i % 10) // 4 else 0.0, i) for i in range(600)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, yb double, id long").withColumn("w", F.lit(1.0))
    r = {t["term"]: t for t in survey.survey_glm(df, "yb", ["x1", "x2"], survey.Design("w"), "binomial").collect()}
    m, _ = models.fit_model(df, "logit", "yb", ["x1", "x2"])
    assert abs(r["x1"]["estimate"] - m.coefficients[0]) < 1e-6 and abs(r["(Intercept)"]["estimate"] - m.intercept) < 1e-6


def test_negbin_recovers_overdispersion(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, 4000)
    mu = np.exp(0.5 + 1.0 * x)
    y = rng.negative_binomial(2.0, 2.0 / (2.0 + mu))
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y long")
    from tabloom.operators import likelihood
    r = likelihood.negbin_fit(df, "y", ["x"])
    assert abs(r["coef"][1] - 1.0) < 0.15 and 1.2 < r["theta"] < 3.5


def test_qq_points_are_monotone(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 11)) for i in range(50)], "id long, r double")
    q = metrics.qq_points(df, "r", "id").orderBy("i").collect()
    assert len(q) == 50 and all(a["theoretical"] < b["theoretical"] for a, b in zip(q, q[1:]))
    assert all(a["sample"] <= b["sample"] for a, b in zip(q, q[1:]))


def test_preset_grid():
    assert models.preset("xgb_reg", "aggressive")["nrounds"] == 1500
    assert models.preset("xgb_cls", "conservative")["lambda"] == 5
    assert models.preset("ranger_reg", "aggressive")["num_trees"] == 1500
    assert models.preset("glmnet_reg", "aggressive") == {}


def test_rao_scott_reduces_to_pearson_under_srs(spark):
    # unit weights, one PSU per row, no strata: generalised design effects ~ 1
    o = table(spark, SF_SMALL, "orders").select("o_orderpriority", "o_orderstatus").withColumn("w", F.lit(1.0))
    r = survey.rao_scott_test(o, "o_orderpriority", "o_orderstatus", survey.Design("w"))
    assert abs(r["deff_mean"] - 1) < 0.05
    assert abs(r["F"] * r["ndf"] - r["chisq"]) / r["chisq"] < 0.1 and 0 <= r["p_value"] <= 1


def test_column_names_with_dots(spark, tmp_path):
    import json
    path = tmp_path / "doc.json"
    path.write_text(json.dumps([{"id": i, "cust": {"name": "ab"[i % 2], "age": 20.0 + i}} for i in range(40)], indent=1))
    df = readers.read_dispatch(spark, str(path))
    assert sorted(df.columns) == ["cust.age", "cust.name", "id"] and df.count() == 40
    prof = {r["column"]: r for r in profile.profile_columns(df).collect()}
    assert prof["cust.name"]["n_unique"] == 2
    out, _ = recipe.apply_recipe(df, [recipe.step("lump_rare", ["cust.name"]), recipe.step("zscore", ["cust.age"])])
    assert out.count() == 40


def test_json_lines_stay_lines(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text("\n".join('{"a": %d}' % i for i in range(5)))
    assert readers.read_dispatch(spark, str(path)).count() == 5


def test_impute_keeps_the_date_type(spark):
    df = spark.sql("SELECT CASE WHEN id % 3 = 0 THEN NULL ELSE DATE'2024-01-05' END AS d, id FROM range(9)")
    out, _ = recipe.apply_recipe(df, [recipe.step("impute", ["d"])])
    assert dict(out.dtypes)["d"] == "date" and out.where("d IS NULL").count() == 0


def test_jkn_replicates(spark):
    rows = [(h, p, 1.0 + h, float(h * 10 + p + i)) for h in (1, 2) for p in range(1, 4 + h) for i in range(3)]
    df = spark.createDataFrame(rows, "h int, p int, w double, y double")
    of = {1: [1, 2, 3, 4], 2: [1, 2, 3, 4, 5]}
    reps, scales = survey.jkn_replicate_weights(df, "w", F.col("h"), F.col("p"), of)
    assert scales == [0.75] * 4 + [0.8] * 5
    got = survey.replicate_mean(reps, "y", "w", [f"wr_{i + 1}" for i in range(9)], "JKn", rscales=scales).first()
    mean = lambda keep: sum(keep(h, p) * w * y for h, p, w, y in rows) / sum(keep(h, p) * w for h, p, w, y in rows)
    full, v = mean(lambda h, p: 1.0), 0.0
    for a in of:
        n = len(of[a])
        for b in of[a]:
            theta = mean(lambda h, p: 1.0 if h != a else 0.0 if p == b else n / (n - 1))
            v += (n - 1) / n * (theta - full) ** 2
    assert abs(got["mean"] - full) < 1e-9 and abs(got["se"] - v ** 0.5) < 1e-9


def test_scoring_keeps_incomplete_rows(spark):
    df = spark.sql("SELECT CAST(id AS DOUBLE) AS y, CASE WHEN id % 10 = 0 THEN NULL ELSE CAST(id % 7 AS DOUBLE) END AS x FROM range(100)")
    m, asm = models.fit_model(df, "lm", "y", ["x"])
    out = models.score(m, asm, df)
    assert asm.rows_dropped == 10 and out.count() == 100 and out.where("prediction IS NULL").count() == 10


def _write(spark, folder, files):
    import os
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    return str(folder)


def test_json_lines_with_a_corrupt_line_lose_that_line_only(spark, tmp_path):
    from tabloom.sources import readers
    p = _write(spark, tmp_path / "lines", {"x.json": '{"a":1,"b":{"c":2}}\n{"a":2,"b":{"c":3}}\n{"a":3,"b"\n\n{"a":4}\n{"a":5}\n'})
    got = readers.scan_json_flat(spark, p)
    assert sorted(r["a"] for r in got.collect()) == [1, 2, 4, 5] and got.columns == ["a", "b.c"] and got.count() == 4
    assert [r["value"] for r in readers.corrupt_json_lines(spark, p).collect()] == ['{"a":3,"b"']
    # a corrupt first line makes no document of the file
    p = _write(spark, tmp_path / "first", {"x.json": '{"a":1,\n{"a":2}\n{"a":3}\n'})
    assert sorted(r["a"] for r in readers.scan_json_flat(spark, p).collect()) == [2, 3]


def test_json_files_are_judged_one_by_one(spark, tmp_path):
    from tabloom.sources import readers
    p = _write(spark, tmp_path / "mixed", {
        "lines.json": '{"a":1}\n{"a":2}\n', "array.json": '[\n {"a": 3},\n {"a": 4, "b": {"c": 7}}\n]\n',
        "object.json": '{\n "a": 5\n}', "row.json": '[{"a":6},{"a":7}]'})
    got = {r["a"]: r["b.c"] for r in readers.scan_json_flat(spark, p).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 7, 5: None, 6: None, 7: None}
    assert readers.corrupt_json_lines(spark, p).count() == 0


def test_missing_and_dotted_predictors(spark):
    from tabloom.operators import models
    nan = float("nan")
    rows = [(float(i), float(i % 7), 2.0 * i + 3.0 * (i % 7)) for i in range(40)] + [(nan, 1.0, 5.0), (1.0, None, 5.0), (2.0, 3.0, nan), (9.0, 1.0, None)]
    df = spark.createDataFrame(rows, "`x.1` double, z double, y double")
    model, asm = models.fit_model(df, "lm", "y", ["x.1", "z"])
    assert asm.rows_dropped == 2
    got = models.score(model, asm, df).collect()
    assert len(got) == 44 and sum(r["prediction"] is None for r in got) == 2
    for r in got:
        if r["prediction"] is not None:
            assert abs(r["prediction"] - (2 * r["x.1"] + 3 * r["z"])) < 1e-6
