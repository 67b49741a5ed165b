"""lightgbm_cls: all rounds of trees that grow leaf by leaf, against the same trees grown on rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabloom.operators import boosting, models
from tabloom.plans import models as plans


def test_query_runs_the_defaults(spark, tmp_path, monkeypatch):
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    rows = spark.range(4000, numPartitions=2).select(
        (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 4).cast("int").alias("l_linenumber"),
        (h(1, 50) + 1).cast("double").alias("l_quantity"), (h(2, 11) / 100).alias("l_discount"), (h(3, 9) / 100).alias("l_tax"),
        (h(4, 9000) + 1000).cast("double").alias("l_extendedprice"))
    odd = F.pmod(F.floor(F.col("l_quantity") / 4) + F.floor(F.col("l_discount") * 50), F.lit(2)) == 1
    rows.withColumn("l_returnflag", F.when(odd, "R").otherwise("N")).write.parquet(f"{tmp_path}/lineitem.parquet")
    fitted, fit = [], models.fit_model
    monkeypatch.setattr(models, "fit_model", lambda *a, **k: fitted.append(fit(*a, **k)) or fitted[-1])
    out = plans.q_lightgbm_cls(spark, str(tmp_path)).collect()
    (model, _), = fitted
    assert len(model.trees) == 300 and model.treeWeights == [1.0] + [0.05] * 299
    leaves = [int((t.feature < 0).sum()) for t in model.trees]
    assert max(leaves) == 31
    assert len(out) == 1 and out[0]["accuracy"] > 0.9


def _rows(spark, n=1500):
    x = spark.range(n, numPartitions=3).select(
        F.pmod(F.xxhash64("id"), F.lit(30)).cast("double").alias("a"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(7)).cast("double").alias("b"), F.lit(2.0).alias("c"))
    noise = F.pmod(F.xxhash64("a", "b", F.monotonically_increasing_id()), F.lit(5)) == 0
    return x.withColumn("k", ((F.pmod(F.floor(F.col("a") / 5) + F.floor(F.col("b") / 3), F.lit(2)) == 1) != noise).cast("double"))


def _by_rows(x, y, rounds, step, leaves, least, depth):
    """Margins and leaves of every tree, each split tried on the rows."""
    margin, counts = np.zeros(len(y)), []
    for m in range(rounds):
        r = y if m == 0 else 4 * y / (1 + np.exp(2 * y * margin))

        def best(at, level):
            found = (1e-9, None, None)
            for f in range(x.shape[1]) if level < depth else ():
                for v in np.unique(x[at, f])[:-1]:
                    low = at & (x[:, f] <= v)
                    high = at & ~low
                    if min(low.sum(), high.sum()) >= least:
                        gain = r[low].sum() ** 2 / low.sum() + r[high].sum() ** 2 / high.sum() - r[at].sum() ** 2 / at.sum()
                        if gain > found[0] * (1 + 1e-9):
                            found = gain, low, high
            return found
        parts = [(np.ones(len(y), bool), 0)]
        tried = [best(*parts[0])]
        while len(parts) < leaves and max(t[0] for t in tried) > 1e-9:
            i = int(np.argmax([t[0] for t in tried]))
            (_, level), (_, low, high) = parts.pop(i), tried.pop(i)
            parts += [(low, level + 1), (high, level + 1)]
            tried += [best(low, level + 1), best(high, level + 1)]
        for at, _ in parts:
            margin[at] += (1.0 if m == 0 else step) * r[at].mean()
        counts.append(len(parts))
    return margin, counts


@pytest.mark.parametrize("leaves,least,depth", [(9, 20, -1), (31, 5, -1), (31, 1, 3)])
def test_same_trees_as_on_rows(spark, leaves, least, depth):
    df = _rows(spark).cache()
    params = {"num_iterations": 4, "learning_rate": 0.3, "num_leaves": leaves, "min_data_in_leaf": least, "max_depth": depth}
    model, asm = models.fit_model(df, "lightgbm_cls", "k", ["a", "b", "c"], params)
    got = models.score(model, asm, df).select("a", "b", "c", "k", "probability").toPandas()
    x, y = got[["a", "b", "c"]].to_numpy(), 2 * got["k"].to_numpy() - 1
    want, counts = _by_rows(x, y, 4, 0.3, leaves, least, depth if depth > 0 else 99)
    assert [int((t.feature < 0).sum()) for t in model.trees] == counts
    assert np.allclose(got["probability"], 1 / (1 + np.exp(-2 * want)), atol=1e-9)
    bins = [boosting._binned(x[:, f], b) for f, b in enumerate(model.bounds)]
    assert np.allclose(boosting._margin(model.trees, model.treeWeights, bins), want, atol=1e-9)
    df.unpersist()


def test_drawn_rounds_do_not_depend_on_blocks(spark, monkeypatch):
    df, found = _rows(spark), []
    for block in (8, 5):
        monkeypatch.setattr(boosting, "BLOCK", block)
        model, asm = models.fit_model(df, "lightgbm_cls", "k", ["a", "b", "c"], {"num_iterations": 11, "bagging_fraction": 0.6})
        assert len(model.trees) == 11
        found.append(models.score(model, asm, df).select("a", "b", "probability").distinct().orderBy("a", "b").collect())
    assert found[0] == found[1]


def test_constant_predictors_and_few_rows(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1.0), (1.0, 1.0), (None, 1.0)], "a double, k double")
    model, asm = models.fit_model(df.where("a is not null"), "lightgbm_cls", "k", ["a"], {"num_iterations": 3})
    assert [t.feature.tolist() for t in model.trees] == [[-1]] * 3
    assert sorted(str(r[0]) for r in models.score(model, asm, df).select("prediction").collect()) == ["1.0", "1.0", "1.0", "None"]
