"""Keeping Python workers small on executors with little memory."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts in a batch between Spark and Python; its default is meant for short rows.
ROWS_A_BATCH = 500


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches to ROWS_A_BATCH rows, unless they are smaller already."""
    if not 0 < int(spark.conf.get(KEY, "10000")) <= ROWS_A_BATCH:
        spark.conf.set(KEY, ROWS_A_BATCH)


def release() -> None:
    """Gives memory that Python has freed back to the machine; a reused worker would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function over batches, after whose task the worker is small again."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
