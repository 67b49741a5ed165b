"""Permutation importance: one shuffle a repeat, the pairing of two hash orders in a bucket."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.functions import ranks
from tabloom.operators import validation


def test_one_shuffle_a_repeat_and_the_same_pairing(spark):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 11).alias("b"),
                                 (F.col("id") % 7 + (F.col("id") % 11) / 10 + F.sin("id")).alias("y"))
    plans = []

    def predict(d):
        plans.append(d._jdf.queryExecution().executedPlan().toString())
        return d.withColumn("prediction", F.col("a") + F.col("b") / 10)
    got = {r["feature"]: r["importance"] for r in validation.permutation_importance(df, predict, "y", ["a", "b"], "id", 2).collect()}
    assert len(plans) == 3
    assert all(p.count("Exchange") == 1 and "Window" not in p for p in plans[1:])
    rmse = lambda d: math.sqrt(predict(d).agg(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))).first()[0])
    n = ranks.default_buckets(df)
    for f in ("a", "b"):
        gains = []
        for rep in (1, 2):
            x = df.withColumn("k", F.pmod(F.xxhash64("id", F.lit(rep), F.lit(42)), F.lit(n)))
            order = lambda j: F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("id", F.lit(rep), F.lit(f), F.lit(j))))
            moved = x.withColumn("r", order(1)).drop(f).join(x.select("k", f, order(2).alias("r")), ["k", "r"])
            gains.append(rmse(moved) - rmse(df))
        assert got[f] == pytest.approx(sum(gains) / 2, rel=1e-9)
