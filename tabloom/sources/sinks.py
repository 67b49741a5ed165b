"""Sinks: CSV export and shared-storage scratch paths for derived files."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory (never a
    machine-local temp folder)."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "tabloom", f"{name}-{uuid.uuid4().hex}")


def sink_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    df.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def sink_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
