"""Helpers of several operators: the shared folder, labelled rows that are held out, and column names."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quarry.sources.folders import discard, keep, shared_folder

__all__ = ["discard", "fresh", "give_back", "held_out", "keep", "shared_folder", "small_batches"]

#: Documents that Spark hands to Python at once.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Hands over few documents at once: they are a few kB each, and a task holds a batch twice, in Python and in Spark."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Memory that is free goes back to the system: the driver's Python lives on after a fit, and the allocators keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is learned: crc32 of the doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fresh(name: str, columns: Iterable[str]) -> str:
    """``name`` with as many underscores before it as keep it apart from ``columns`` (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
