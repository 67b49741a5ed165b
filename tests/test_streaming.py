"""Structured Streaming jobs: exactly-once ingest across restarts."""

from pyspark.sql import functions as F

from tabloom.session import table
from tabloom.sources import sinks
from tabloom.streaming import jobs

from conftest import SF_SMALL


def test_incremental_ingest_is_exactly_once_across_restarts(spark):
    o = table(spark, SF_SMALL, "orders").select("o_orderkey", "o_totalprice")
    src, out, ck = (sinks.shared_scratch(spark, n) for n in ("src", "out", "ck"))
    o.where(F.col("o_orderkey") % 2 == 0).write.parquet(src)
    first = jobs.incremental_ingest(spark, src, o.schema, out, ck).count()
    # a restart with the same checkpoint re-reads nothing
    again = jobs.incremental_ingest(spark, src, o.schema, out, ck).count()
    assert first == again == o.where(F.col("o_orderkey") % 2 == 0).count()
    # new files arriving later are picked up once
    o.where(F.col("o_orderkey") % 2 == 1).write.mode("append").parquet(src)
    final = jobs.incremental_ingest(spark, src, o.schema, out, ck)
    assert final.count() == o.count() and final.select("o_orderkey").distinct().count() == o.count()
