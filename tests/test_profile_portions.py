"""A task of the column profile counts a bounded number of values, however few the input's partitions."""

from pyspark.sql import functions as F

from tabloom.operators import profile


def test_counted_values_are_bounded(spark, monkeypatch):
    seen = []
    count = profile.value_counts
    monkeypatch.setattr(profile, "value_counts", lambda df, columns: seen.append(df.rdd.getNumPartitions()) or count(df, columns))
    monkeypatch.setattr(profile, "TASK_VALUES", 20, raising=False)
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("g")).coalesce(1)
    got = {r["column"]: r["n_unique"] for r in profile.profile_columns(df).collect()}
    assert seen == [100] and got == {"id": 1000, "g": 7}
