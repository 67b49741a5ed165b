"""Exact ranks, cumulative weights and type-7 quantiles without a global sort
in one task.

A plain ``Window.partitionBy(key).orderBy(x)`` puts every distinct value of a
key into one task.  Here values are first collapsed to ``(key, value, weight)``
(map-side partial aggregation makes a hot value cost one row), then range-partitioned
by key and value: the planner samples the bounds, so a key of any size is cut wherever
its values are dense, and small keys share a partition.  Running weights within a
partition are one pass over its sorted rows; only the first key of a partition can have
begun in an earlier one, so the totals before a partition are a table of one row a
partition at most.  One shuffle, whatever the number of keys or the skew.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SMALL_ROWS = 50_000         # of a table of groups that every task may hold

def default_buckets(df: DataFrame) -> int:
    try:
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    except Exception:  # pragma: no cover
        n = 200
    return max(2, n)


def _running(batches, keys: int, weight: int):
    """Arrow batches of sorted rows with the weight of the rows before each, within its key and this
    partition, as a last column; the first ``keys`` columns are the key."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    last, held = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts = np.zeros(n, bool)
        for i in range(keys):
            c = batch.column(i)
            if n > 1:
                a, b = c.slice(1), c.slice(0, n - 1)
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                starts[1:] |= ~same.to_numpy(zero_copy_only=False)
        first = tuple(batch.column(i)[0].as_py() for i in range(keys))
        starts[0] = last is None or first != last
        w = pc.fill_null(batch.column(weight), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(w)
        before = total - w
        # each row less what its key's first row had before it
        at = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
        before = np.where(at >= 0, before - before[np.maximum(at, 0)], before + held)
        held = before[-1] + w[-1]
        last = tuple(batch.column(i)[n - 1].as_py() for i in range(keys))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "_here"])


def _placed(vc: DataFrame, keys: Sequence[str], value: str, weight: str) -> DataFrame:
    """``vc`` range-partitioned by key and value, with ``_part`` (the partition) and ``_here`` (weight of
    smaller values of the key in it); written once, so that all that follows sees the same bounds."""
    from pyspark.sql import types as T
    from ..session import ship_package
    ship_package(vc.sparkSession)
    keys = list(keys)
    rest = [c for c in vc.columns if c not in keys]
    whole = isinstance(vc.schema[weight].dataType, (T.LongType, T.IntegerType, T.ShortType))
    w = F.col(weight).cast("long" if whole else "double").alias(weight)
    x = vc.select(*keys, *[w if c == weight else c for c in rest])
    x = x.repartitionByRange(*keys, value).sortWithinPartitions(*keys, value).withColumn("_part", F.spark_partition_id())
    schema = T.StructType([*x.schema.fields, T.StructField("_here", T.LongType() if whole else T.DoubleType())])
    at, n = x.columns.index(weight), len(keys)

    def run(batches):
        yield from _running(batches, n, at)
    return materialize(x.mapInArrow(run, schema))


def _seams(placed: DataFrame, keys: Sequence[str], weight: str) -> tuple[DataFrame, DataFrame]:
    """(weight before a partition of the keys that go on into it: at most a row a partition; totals by key)"""
    parts = placed.groupBy(*keys, "_part").agg(F.sum(weight).alias("_w"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_off", F.sum("_w").over(w)).where(F.col("_off").isNotNull()).select(
        *[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], F.col("_part").alias("_sp"), "_off")
    return offsets, parts.groupBy(*keys).agg(F.sum("_w").alias("_total"))


def with_cumulative(vc: DataFrame, keys: Sequence[str], value: str, weight: str, out_before: str = "cum_before",
                    totals: bool = False) -> DataFrame:
    """Add ``out_before`` = total ``weight`` of rows with a smaller ``value`` in the
    same ``keys`` group.  ``vc`` must hold one row per ``(keys, value)``, value not NULL.
    With ``totals`` also ``_total``, the weight of the group."""
    keys = list(keys)
    placed = _placed(vc, keys, value, weight)
    offsets, sums = _seams(placed, keys, weight)
    on = F.col("_part") == F.col("_sp")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_s{i}"))
    x = placed.join(F.broadcast(offsets), on, "left")       # bounded by the number of partitions
    x = x.withColumn(out_before, F.col("_here") + F.coalesce("_off", F.lit(0)))
    x = x.drop("_here", "_part", "_sp", "_off", *[f"_s{i}" for i in range(len(keys))])
    if totals:
        x = attach_groups(x, sums, keys) if keys else attach_scalars(x, sums)
    return x.select(*vc.columns, out_before, *(["_total"] if totals else []))


def value_weights(df: DataFrame, keys: Sequence[str], value: str | Column,
                  weight: str | Column | None = None) -> DataFrame:
    """Collapse rows to ``(keys, value, w)`` with NULL values removed."""
    v = F.col(value) if isinstance(value, str) else value
    w = F.lit(1).cast("long") if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    return (df.select(*[F.col(k) for k in keys], v.alias("value"), w.alias("w"))
            .where(F.col("value").isNotNull())
            .groupBy(*keys, "value").agg(F.sum("w").alias("w")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column,
                    probs: Sequence[float]) -> DataFrame:
    """Type-7 (R default, Spark ``percentile``, DuckDB ``quantile_cont``) quantiles
    of ``value`` per ``keys`` group.  Returns ``(keys..., p, q)``.  Rows collapse to
    distinct values with their counts before anything is ranked."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    return quantiles_from_counts(value_weights(df, keys, v), keys, "value", "w", probs)


def quantiles_from_counts(vc: DataFrame, keys: Sequence[str], value: str, cnt: str,
                          probs: Sequence[float]) -> DataFrame:
    """Exact type-7 quantiles from a (keys, value, count) table: the rows whose running count covers
    a wanted rank, the two ranks beside each quantile."""
    keys = list(keys)
    x = with_cumulative(vc, keys, value, cnt, "_before", totals=True)
    at = F.transform(F.array(*[F.lit(float(p)) for p in probs]),
                     lambda p: F.struct(p.alias("p"), ((F.col("_total") - 1) * p + 1).alias("h")))
    covers = lambda r: (F.col("_before") < r) & (r <= F.col("_before") + F.col(cnt))
    hit = F.filter(at, lambda s: covers(F.floor(s["h"])) | covers(F.ceil(s["h"])))
    r = x.select(*keys, F.col(value).alias("_v"), F.col(cnt).alias("_c"), "_before", F.explode(hit).alias("_s")).select(
        *keys, "_v", "_before", "_c", "_s.p", "_s.h")
    inside = lambda k: (F.col("_before") < k) & (k <= F.col("_before") + F.col("_c"))
    res = r.groupBy(*keys, "p", "h").agg(F.max(F.when(inside(F.floor("h")), F.col("_v"))).alias("_lo"),
                                         F.max(F.when(inside(F.ceil("h")), F.col("_v"))).alias("_hi"))
    return res.select(*keys, "p", (F.col("_lo") + (F.col("h") - F.floor("h")) * (F.col("_hi") - F.col("_lo"))).alias("q"))


def quantile_map(qdf: DataFrame, keys: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Pivot ``(keys, p, q)`` into one column per probability."""
    aggs = [F.max(F.when(F.abs(F.col("p") - p) < 1e-12, F.col("q"))).alias(nm) for p, nm in names.items()]
    return qdf.groupBy(*keys).agg(*aggs)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str,
                  out: str = "rank_avg") -> DataFrame:
    """Average ranks with ties (R ``rank(ties='average')``) of ``value`` per keys,
    joined back to ``df``.  NULL values get a NULL rank."""
    keys = list(keys)
    vc = value_weights(df, keys, value)
    cum = with_cumulative(vc, keys, "value", "w")
    rk = [f"_rk{i}" for i in range(len(keys))]
    cum = cum.select(*[F.col(k).alias(r) for k, r in zip(keys, rk)], F.col("value").alias("_rv"),
                     (F.col("cum_before") + (F.col("w") + 1) / 2.0).alias(out))
    cond = [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(keys, rk)] + [F.col(value) == F.col("_rv")]
    return df.join(cum, cond, "left").drop(*rk, "_rv")


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    buckets: int | None = None) -> DataFrame:
    """Exact first-``k`` rows per ``keys`` group by ``order``, without a window over a
    whole group: rank inside hash buckets of the group (each ~1/buckets of it),
    keep <= k per bucket, then rank the <= k*buckets survivors."""
    keys = list(keys)
    b = buckets or default_buckets(df)
    x = df.withColumn("_tb", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(b)))
    w1 = Window.partitionBy(*keys, "_tb").orderBy(*order)
    x = x.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k).drop("_r1", "_tb")
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return x.withColumn("_rank", F.row_number().over(w2)).where(F.col("_rank") <= k)


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row (broadcast
    equi-join on a constant key; the right side is a single row)."""
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def attach_groups(df: DataFrame, table: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a table of one row per group.  It is written once and counted: up to ``SMALL_ROWS`` rows go
    to every task, because joined by key few groups put all rows of ``df`` into as many tasks (and
    the planner keeps such a join as it is where most of its partitions are empty); more rows than
    that are joined by key."""
    table = materialize(table)
    return df.join(F.broadcast(table) if table.count() <= SMALL_ROWS else table, on, how)


def ensure_parallelism(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Before CPU-heavy per-row work (replicates, grids): if the input has
    fewer partitions than the cluster's default parallelism, spread it
    round-robin; large inputs already have enough partitions and pass through.
    With ``rows``, work that keeps a state per row, so many that a partition
    holds at most about ``rows`` of them."""
    target = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        target = max(target, -(-df.count() // rows))
    n = df.rdd.getNumPartitions()
    return df.repartition(target) if n < target else df


def release(spark) -> None:
    """Lets Spark delete the shuffles that no plan refers to any more."""
    import gc
    gc.collect()
    spark._jvm.java.lang.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Write an input that several plan branches will read to the shared checkpoint folder, once,
    as Parquet (so that a branch reads only its columns), and read it back; cuts the lineage."""
    import uuid
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
