"""Text views and files made of the tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import batches as small_batches
from ..functions import bits
from ..operators import streams
from . import report


def box_text(boxes: DataFrame) -> DataFrame:
    """(path, box_seq, line): two blanks a level, range, type, and what else the box has."""
    head = F.concat(F.expr("repeat('  ', depth)"), F.format_string("[%d+%d] %s", "offset", "size", "type"))
    more = F.concat(F.coalesce(F.concat(F.lit(" uuid="), "uuid"), F.lit("")), F.when(F.col("is_fullbox"), F.format_string(" v=%d flags=0x%06x", "version", "flags")).otherwise(F.lit("")))
    return boxes.select("path", "box_seq", F.concat(head, more).alias("line"))


def extents_text(tables, shown: int = 4) -> DataFrame:
    """(path, item_id, line): the first extents of an item and how many more it has."""
    i = tables.nested.select("path", F.explode("items").alias("i")).select("path", "i.item_id", "i.extents")
    part = lambda e: F.concat(F.lit("["), e["offset"].cast("string"), F.lit("+"), e["length"].cast("string"), F.lit("]"), F.coalesce(F.concat(F.lit(" idx="), e["ext_index"].cast("string")), F.lit("")))
    rest = F.size("extents") - shown
    return i.select("path", "item_id", F.concat(F.array_join(F.transform(F.slice("extents", 1, shown), part), " "), F.when(rest > 0, F.format_string(" ... (%d more)", rest)).otherwise(F.lit(""))).alias("line"))


def meta_text(tables) -> DataFrame:
    """(path, line): handler, primary item, counts and what the primary item is."""
    m = tables.nested.withColumn("i", F.try_element_at(F.filter("items", lambda i: i["item_id"] == F.col("meta.primary_item_id")), F.lit(1)))
    kind = F.col("i.item_type")
    what = (
        F.when(F.col("meta.primary_item_id").isNull(), "meta.pitm: (missing primary item)")
        .when(F.col("i").isNull(), "primary item: not found in item table (unexpected)")
        .when(kind.isNull(), "primary item: type unknown (missing infe?)")
        .when(kind != "av01", F.concat(F.lit("primary item: not a coded 'av01' item (type='"), kind, F.lit("')")))
        .otherwise("primary item: coded 'av01' (simple still path candidate)")
    )
    return m.select("path", F.concat_ws("\n", F.concat(F.lit("meta.hdlr: "), F.coalesce("meta.handler_type", F.lit("(missing)"))), F.format_string("items: %d", "meta.item_count"), F.format_string("properties: %d", "meta.property_count"), what).alias("line"))


def item_text(tables) -> DataFrame:
    """(path, item_no, line): each item with its type, where its bytes are, and how many properties it names."""
    i = tables.nested.select("path", F.explode("items").alias("i")).select("path", "i.*")
    where = F.when(F.col("has_iloc"), F.format_string("method=%d extents=%d", "construction_method", F.size("extents"))).otherwise("no location")
    return i.select("path", "item_no", F.concat_ws(" ", F.format_string("item %d", "item_id"), F.coalesce("item_type", F.lit("(no type)")), where, F.format_string("properties=%d", F.size("props"))).alias("line"))


def primary_text(tables) -> DataFrame:
    """(path, line): size, depths and configuration that the primary item names, or that it names none."""
    p = report.primary_properties(tables)
    ispe = F.when(F.col("ispe").isNotNull(), F.format_string("ispe %dx%d", "ispe.width", "ispe.height"))
    pixi = F.when(F.col("pixi").isNotNull(), F.concat(F.lit("pixi "), F.array_join(F.transform("pixi.depths", lambda d: d.cast("string")), ",")))
    av1c = F.when(F.col("av1c").isNotNull(), F.concat(F.lit("av1C "), bits.chroma_format(F.col("av1c")), F.lit(" "), bits.av1c_bit_depth(F.col("av1c")).cast("string"), F.lit(" bits")))
    return p.select("path", F.when(F.coalesce("ispe.width", "pixi.channels", "av1c.version").isNull(), "no properties").otherwise(F.concat_ws("; ", ispe, pixi, av1c)).alias("line"))


def tile_file_names(tiles: DataFrame) -> DataFrame:
    return tiles.withColumn("file_name", F.format_string("tg%d_tile%d_r%d_c%d.bin", "tg_index", "tile_num", "tile_row", "tile_col"))


def tile_text(tiles: DataFrame) -> DataFrame:
    return tiles.select("path", "tg_index", "tile_num", F.format_string("tg%d tile %d r%d c%d @ [%d+%d]", "tg_index", "tile_num", "tile_row", "tile_col", "offset", "size").alias("line"))


def header_text(headers: DataFrame) -> DataFrame:
    """(path, line): name=value of each column in order, n/a for null."""
    cols = [c for c, t in headers.dtypes if c != "path" and not t.startswith(("array", "struct"))]
    return headers.select("path", F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in cols]).alias("line"))


def ivf_files(payloads: DataFrame, dims: DataFrame) -> DataFrame:
    """(path, ivf): payloads as one-frame files, sizes from (path, width, height)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [streams.ivf(x.as_py(), w, h) for x, w, h in zip(batch["payload"], batch["width"].to_pylist(), batch["height"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(out, pa.binary())], ["path", "ivf"])

    rows = payloads.where("payload is not null").join(dims, "path").select("path", "payload", "width", "height")
    return rows.mapInArrow(run, "path string, ivf binary")


def write_tiles(tiles: DataFrame, folder: str) -> None:
    """Tiles with their names, as Parquet; one folder a group of files would not scale, so paths stay a column."""
    tile_file_names(tiles).write.mode("overwrite").parquet(folder)


def write_payloads(payloads: DataFrame, folder: str, suffix: str = ".av1", apart: bool = False) -> DataFrame:
    """Each payload as a file of its own below ``folder`` (any URI that pyarrow knows); (path, file, bytes) of what was
    written. A file's name comes from the path it was taken from, and it is written whole under another name first, so a
    task that runs again does no harm. Call an action on the result to write.

    Of rows with the same path one file remains, unless they are kept ``apart``: then each task has a folder of its own, and one
    more for rows whose path it has had before, and so on."""
    where = re.sub("^file:/(?!/)", "file:///", folder) if "://" in folder or folder.startswith("file:/") else "file://" + folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(where)
        seen: Counter[bytes] = Counter()
        made: set[str] = set()
        for batch in batches:
            files, sizes = [], []
            for path, body in zip(batch["path"].to_pylist(), batch["payload"], strict=True):
                at = base
                if apart:
                    key = hashlib.sha256(path.encode()).digest()[:16]
                    at, seen[key] = f"{base}/{TaskContext.get().partitionId():06d}-{seen[key]}", seen[key] + 1
                if at not in made:
                    system.create_dir(at, recursive=True)
                    made.add(at)
                name = f"{at}/{hashlib.sha256(path.encode()).hexdigest()[:32]}{suffix}"
                with system.open_output_stream(name + ".part", compression=None) as f:
                    f.write(body.as_buffer())
                system.move(name + ".part", name)
                files.append(name)
                sizes.append(len(body.as_buffer()))
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(files, pa.string()), pa.array(sizes, pa.int64())], ["path", "file", "bytes"])

    small_batches.small(payloads.sparkSession)
    return payloads.where("payload is not null").select("path", "payload").mapInArrow(run, "path string, file string, bytes long")


def write_tile_folder(streams_, folder: str) -> DataFrame:
    """The bytes of each tile as a file of its own, and the headers of each stream as a line of text: (path, file, bytes) of
    the tiles. Names are those of tile_file_names after a hash of the path, so a task that runs again does no harm."""
    headers = header_text(streams_.frame_headers)
    headers.select(F.concat_ws(" ", "path", "line").alias("value")).write.mode("overwrite").text(f"{folder}/frame_info")
    named = tile_file_names(streams_.tiles)
    return write_payloads(named.select(F.concat_ws("/", "path", "file_name").alias("path"), "payload"), f"{folder}/tiles", suffix=".bin")
