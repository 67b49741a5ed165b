"""Tables that an operator writes between its steps.

They go to the shared folder named by ``spark.checkpoint.dir``, as Parquet, so
a lost executor costs a re-read and never a whole lineage."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package
from .workers import give_back

REST = 2.0      # seconds between two times that the driver gives memory back


class Scratch:
    rested = time.monotonic()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        ship_package(spark)
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a frame that reads it back."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        if time.monotonic() - Scratch.rested > REST:
            give_back(self.spark)
            Scratch.rested = time.monotonic()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step and no result reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
