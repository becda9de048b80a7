"""Where bytes come from: container and stream files, tables of bytes, manifests."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = ("base", "preset", "width", "height", "sha256_src", "sha256_avif", "sha256_oracle")


def scan(spark: SparkSession, root: str, suffix: str = ".avif", include_generated: bool = False, limit: int | None = None, max_length: int | None = None) -> DataFrame:
    """(path, length, mtime, content) of the files below ``root`` with the suffix, those in a folder named
    ``generated`` left out unless asked for; ``limit`` takes the first by path.

    Listing prunes by name, and a filter on length or mtime reaches the scan; without ``content`` no bytes are read. Spark's source
    leaves out files of no bytes: they are added from its listing, with a null mtime.
    """
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
    files = read.select("path", "length", F.col("modificationTime").alias("mtime"), "content").unionAll(_empty(read, suffix))
    if max_length is not None:
        files = files.where(F.col("length") <= max_length)
    if not include_generated:
        files = files.where(~F.col("path").rlike("/generated/"))
    return files if limit is None else files.orderBy("path").limit(limit)


def _empty(read: DataFrame, suffix: str) -> DataFrame:
    """Rows of a binary scan's files of no bytes: those that were listed and are not among what it reads."""
    spark = read.sparkSession
    uris = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", read._jdf.inputFiles())  # at once, not one call a file
    listed = spark.createDataFrame(pa.table({"uri": pa.array(uris.split("\n") if uris else [], pa.string())}))
    rest = listed.join(read.select(F.input_file_name().alias("uri")), "uri", "left_anti")
    path = F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B")))  # a plus stands for itself in a path
    return rest.select(path.alias("path"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(b"").alias("content")).where(F.col("path").endswith(suffix))


def from_table(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return df.select(F.col(path).cast("string").alias("path"), F.length(content).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("mtime"), F.col(content).alias("content"))


def tile_lines(text: DataFrame, line: str = "line") -> DataFrame:
    """(tg_index, tile_num, tile_row, tile_col, offset, size) read back from lines of tile_text; other lines give no row."""
    names = ("tg_index", "tile_num", "tile_row", "tile_col", "offset", "size")
    pattern = r"^tg(\d+) tile (\d+) r(\d+) c(\d+) @ \[(\d+)\+(\d+)\]$"
    found = text.where(F.col(line).rlike(pattern))
    return found.select(*[c for c in text.columns if c != line and c not in names], *[F.regexp_extract(line, pattern, i + 1).cast("long").alias(n) for i, n in enumerate(names)])


def header_lines(text: DataFrame, names: tuple[str, ...], line: str = "line") -> DataFrame:
    """The named values read back from lines of header_text, as longs; n/a and what isn't there are null."""
    pairs = F.str_to_map(F.col(line), F.lit(" "), F.lit("="))
    return text.withColumn("__pairs", pairs).select(*[c for c in text.columns if c != line and c not in names], *[F.col("__pairs")[n].try_cast("long").alias(n) for n in names])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lines of seven fields apart by white space; those that start with # or have fewer fields are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(p) >= 7))
    return lines.select(*[F.element_at(p, i + 1).cast("int" if n in ("width", "height") else "string").alias(n) for i, n in enumerate(MANIFEST)])
