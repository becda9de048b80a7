"""Arrow batches of the media engine's Python steps, kept small whatever the size of the input."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows and bytes that are Python objects at one time. A unit of a stream takes some sixty times its bytes as a record.
ROWS, BYTES = 1000, 1 << 18


def small(spark: SparkSession) -> None:
    """What Spark hands over at once is bounded in rows and bytes; the settings stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of so many rows and, by the batch's mean, so many bytes."""
    for batch in batches:
        step = max(1, min(ROWS, BYTES * len(batch) // max(1, batch.nbytes)))
        for at in range(0, len(batch), step):
            yield batch.slice(at, step)


def give_back() -> None:
    """Return to the system what this worker has freed: Spark keeps the worker, and its allocators what it had at most."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def sliced(run: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over each slice, for ``mapInArrow``."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in slices(batches):
                yield run(batch)
        finally:
            give_back()

    return whole
