"""Date texts meet only the patterns of their shape, with the results of trying all."""

import re

from pyspark.sql import functions as F

from tabloom.functions import dates

TEXTS = ["2024-02-29", "2023-02-29", "2024/1/2", "31/12/2020", "12/31/2020", "13/13/2020", "20200131", "31012020", "01312020",
         "2020-01-31 23:59:59", "2020-01-31 24:00:00", "31.12.2020 07:05", "12.31.2020 07:05:09", "+12020-01-01", "-2020-01-01",
         "02020-01-01", "0000-01-01", " 2020-01-01 ", "", "not a date", "F", "2020-01-01x", "2020-00-10", "99", "2020-01-01T00:00:00",
         "20200131 235959", "1/2/2020", "２０２０-01-01", "2020-01-01\n", None]


def test_shapes_leave_results_alone_and_spare_attempts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    s = F.trim("t")
    tried_all = F.coalesce(*[F.try_to_timestamp(s, F.lit(p)) for p in dates.ISO_PATTERNS + dates._all_patterns()])
    rows = df.select("t", dates.parse_timestamp(F.col("t")).cast("string").alias("a"), tried_all.cast("string").alias("b")).collect()
    assert [(r["t"], r["a"]) for r in rows] == [(r["t"], r["b"]) for r in rows]
    assert sum(r["b"] is not None for r in rows) >= 9
    patterns = list(dict.fromkeys(dates.ISO_PATTERNS + dates._all_patterns()))
    assert not any(re.search(dates._shape(p), t) for p in patterns for t in ("not a date", "F", "2020-01-01x"))
    assert [p for p in patterns if re.search(dates._shape(p), "2024-02-29")] == ["yyyy-MM-dd"]
