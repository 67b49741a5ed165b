"""Column kinds and the R-style class names the reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column(name: str) -> Column:
    """Column by exact name (names may contain dots or backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC):
        return "numeric"
    if isinstance(dt, T.BooleanType):
        return "logical"
    if isinstance(dt, T.DateType):
        return "date"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def r_class(dt: T.DataType) -> str:
    if isinstance(dt, INTEGRAL):
        return "integer"
    if isinstance(dt, NUMERIC):
        return "numeric"
    return {"logical": "logical", "date": "Date", "timestamp": "POSIXct/POSIXt",
            "string": "character"}.get(kind(dt), dt.simpleString())


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) == "numeric" and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) == "string" and f.name not in exclude]
