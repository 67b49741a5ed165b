"""Trees are grown on partitions of bounded size, whatever the input's partitions."""

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tabloom.operators import models


def test_trees_get_small_partitions(spark, monkeypatch):
    monkeypatch.setattr(models, "PORTION_ROWS", 25, raising=False)
    seen = []
    fit = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, data, *a: seen.append(data.rdd.getNumPartitions()) or fit(self, data, *a))
    df = spark.range(200).select((F.col("id") % 9).alias("x"), (F.col("id") % 9 * 2.0).alias("y")).coalesce(1)
    model, asm = models.fit_model(df, "ranger_reg", "y", ["x"], {"num_trees": 5, "max_depth": 4})
    assert seen == [8] and asm.rows_used == 200
    assert models.score(model, asm, df).where(F.abs(F.col("prediction") - F.col("y")) < 2).count() > 150
