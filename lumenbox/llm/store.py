"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


#: By application, where the session names no folder.
_own_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, as in local tests, one of our own, which becomes
    the context's checkpoint folder, too. A master that is not local must name a folder."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = _own_roots.get(context.applicationId)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="lumenbox-")
        context.setCheckpointDir(root)
    path = context._jvm.org.apache.hadoop.fs.Path(root)  # a path without a scheme is of the default file system
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other run uses."""
    return f"{shared_root(spark)}/lumenbox/{name}-{uuid.uuid4().hex}"


#: Spark's setting by which the shuffle files of a query go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and lost executors cost nothing.

    ``tidy``: the write's shuffle files go when it ends; otherwise they stay until the driver happens to collect garbage."""
    path = new_folder(df.sparkSession, name)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    if tidy:
        conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tables = [path]
    return out


def forget(*frames: DataFrame) -> None:
    """Remove the tables that ``save`` wrote for these frames, once nothing that is still to run reads them."""
    for df in frames:
        for path in df.__dict__.pop("_tables", []):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded_batches(spark: SparkSession) -> None:
    """Keep what one Arrow batch holds small, so that a run of long texts does not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def give_back() -> None:
    """Return to the system what this Python worker has freed. Its allocators would keep that, and Spark keeps the worker for tasks to
    come, so that it would count beside the heap of the executor in steps that run no Python at all."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def tidy_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; when a task ends, its worker gives back what it has freed."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


_given_back = 0.0


def tidy_group(run: Callable[[tuple, pa.Table], pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """``run`` for ``applyInArrow``; its worker gives back what it has freed once a second at most, as groups may be small."""

    def whole(key: tuple, table: pa.Table) -> pa.Table:
        global _given_back
        out = run(key, table)
        if time.monotonic() - _given_back > 1:
            give_back()
            _given_back = time.monotonic()
        return out

    return whole


def task_each(rows: DataFrame, most: int = 100_000) -> DataFrame:
    """Rows that each stand for a file, dealt one to a task. A number is given, as adaptive execution would otherwise put
    rows this short together into a single task."""
    return rows.repartition(max(1, min(most, rows.count())))


#: A key is hot if it holds more than one in so many of all rows, so there are fewer hot keys than that.
HOT_KEYS = 4096


def spread_join(left: DataFrame, right: DataFrame, key: str, weight: str, salt: Column) -> DataFrame:
    """Inner join on a key of type long, whichever keys are hot. ``right`` is a saved table of one row a key, with ``weight``, the
    number of rows that ``left`` has of it. The rows of hot keys, fewer than HOT_KEYS, are broadcast; the left rows that they meet
    go by ``salt``, a long that tells rows apart, and so to all tasks."""
    total, most = right.agg(F.sum(weight), F.max(weight)).first()
    cut = max(1000, (total or 0) // HOT_KEYS)
    more = [c for c in right.columns if c != key]
    if (most or 0) <= cut:
        return left.join(right, key).select(*left.columns, *more)
    side = right.select(F.col(key).alias("__key"), F.struct(*more).alias("__more"))
    hot = side.where(F.col("__more")[weight] > cut).select(F.col("__key").alias("__hot_key"), F.col("__more").alias("__hot"))
    met = left.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumn("__to", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(salt))
    cold = side.where(F.col("__more")[weight] <= cut)
    both = met.join(cold, (F.col("__to") == F.col("__key")) & F.col("__hot").isNull(), "left").withColumn("__got", F.coalesce("__hot", "__more"))
    return both.where(F.col("__got").isNotNull()).select(*left.columns, *[F.col(f"__got.{c}").alias(c) for c in more])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, **more: str) -> StructType:
    """The schema of ``df`` and further columns by type name."""
    return StructType([*df.schema.fields, *(StructField(k, _parse_datatype_string(t)) for k, t in more.items())])
