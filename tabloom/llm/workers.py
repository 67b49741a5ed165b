"""What Python processes do besides the operators' own work."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa

BATCH_BYTES = 4 << 20     # of an Arrow batch that goes to a worker; a longer text is a batch of its own


@contextmanager
def small_batches(spark) -> Iterator[None]:
    """What is executed inside sends rows to Python in Arrow batches of about BATCH_BYTES.  Spark's
    10,000 rows of text or 64 MB are held by every task several times over: as vectors that double
    while they grow, outside of the JVM's heap, and by the worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back(spark=None) -> None:
    """Returns freed memory to the system: neither Arrow's pool nor the C library does so soon.
    With ``spark`` the driver's JVM too, which otherwise keeps a heap as large as it ever needed
    and the broadcast variables and shuffles that no plan refers to any more."""
    gc.collect()
    if spark is not None:
        spark._jvm.java.lang.System.gc()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):   # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` (an Arrow batch function) that gives memory back when it ends: Spark keeps
    workers for later tasks, and what they hold counts against the executor."""
    def tidied(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()
    return tidied
