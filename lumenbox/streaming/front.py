"""Files as they arrive: the parsers are per file, so they run on a stream as they are (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, suffix: str = ".avif", files_a_batch: int = 1000) -> DataFrame:
    """(path, length, mtime, content) of new files; append mode needs no watermark as no state is kept."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", files_a_batch).load(folder)
    return read.select("path", "length", F.col("modificationTime").alias("mtime"), "content")


def write(table: DataFrame, to: str, checkpoint: str, once: bool = True):
    """Append a table made of ``arriving`` to Parquet; ``once`` takes what is there and stops."""
    w = table.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w).start()
