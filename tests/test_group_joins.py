"""Tables of few groups go to every task: joined by key they put all rows into a few tasks."""

import pytest
from pyspark.sql import functions as F

from tabloom.functions import ranks
from tabloom.operators import metrics, recipe, series, survey


@pytest.fixture
def no_size_guess(spark):
    """The planner broadcasts only what it is told to."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def rows(spark):
    return spark.range(300).select("id", F.when(F.col("id") % 50 != 0, (F.col("id") % 3).cast("string")).alias("g"),
                                   (F.col("id") * 37 % 101).cast("double").alias("y"), F.lit(1.0).alias("w"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_target_encoding_joins_no_rows_by_level(no_size_guess):
    out, _ = recipe.apply_recipe(rows(no_size_guess), [recipe.step("target_encode", ["g"])], target="y")
    assert "SortMergeJoin" not in plan(out)
    got = {r["id"]: r["g"] for r in out.collect()}
    data = [(r["id"], r["g"], r["y"]) for r in rows(no_size_guess).collect()]
    mean = sum(y for *_, y in data) / len(data)
    for i, g, _ in data:
        ys = [y for _, h, y in data if h == g]
        assert got[i] == pytest.approx(mean if g is None else (sum(ys) + 10 * mean) / (len(ys) + 10))


def test_weighted_quantiles_join_no_rows_by_key(no_size_guess):
    x = rows(no_size_guess).where("g IS NOT NULL")
    cdf = survey._weighted_cdf(x, ["g"], "y", "w")
    wanted = x.groupBy("g").agg(F.array(F.lit(0.5)).alias("ps"))
    found = survey._inverted(cdf, wanted, ["g"])
    assert "SortMergeJoin" not in plan(found)
    got = {r["g"]: r["value"] for r in found.collect()}
    for g in ("0", "1", "2"):
        ys = sorted(r["y"] for r in x.where(F.col("g") == g).collect())
        assert got[g] == ys[-(-len(ys) // 2) - 1]


def test_blocks_and_totals_join_no_rows_by_key(no_size_guess):
    x = rows(no_size_guess).where("g IS NOT NULL")
    assert "SortMergeJoin" not in plan(series.halo_blocks(x, ["g"], ["id"], 0))
    vc = ranks.value_weights(x, ["g"], "y")
    totals = ranks.with_cumulative(vc, ["g"], "value", "w", totals=True)
    assert "SortMergeJoin" not in plan(totals)
    assert {(r["g"], r["_total"]) for r in totals.collect()} == {
        (r["g"], r["n"]) for r in x.groupBy("g").agg(F.count("y").alias("n")).collect()}


def test_residuals_of_few_keys(no_size_guess):
    x = rows(no_size_guess).where("g IS NOT NULL").withColumn("p", 50.0 + F.col("id") % 5)
    got = {r["g"]: r for r in metrics.residual_stats(x, "y", "p", ["id"], ["g"]).collect()}
    for g in ("0", "1", "2"):
        r = [a["y"] - a["p"] for a in x.where(F.col("g") == g).orderBy("id").collect()]
        d = [v - sum(r) / len(r) for v in r]
        assert got[g]["n"] == len(r) and got[g]["bias"] == pytest.approx(sum(r) / len(r))
        assert got[g]["acf1"] == pytest.approx(sum(a * b for a, b in zip(d, d[1:])) / sum(a * a for a in d))


def test_many_groups_join_by_key(no_size_guess, monkeypatch):
    monkeypatch.setattr(ranks, "SMALL_ROWS", 2)
    x = rows(no_size_guess)
    out = ranks.attach_groups(x, x.groupBy("g").agg(F.count("y").alias("n")), ["g"])
    assert "BroadcastHashJoin" not in plan(out)
    assert out.count() == x.where("g IS NOT NULL").count()
