"""The table functions under SQL: ``SELECT b.* FROM files, LATERAL media_boxes(content) b``."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DataType, DecimalType, StructType, _parse_datatype_string

from .operators import containers, entropy, streams, syntax, tables
from .operators.probe import PROBE


def _typed(value: Any, kind: DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, DecimalType):
        return Decimal(value)
    if isinstance(kind, ArrayType):
        return [_typed(x, kind.elementType) for x in value]
    if isinstance(kind, StructType):
        return tuple(_typed(value.get(f.name), f.dataType) for f in kind)
    return value


def _function(schema: str, rows: Callable[[bytes], Iterable[dict[str, Any]]]):
    kind = _parse_datatype_string(schema)

    class Table:
        def eval(self, content: bytes):
            for r in rows(bytes(content or b"")):
                yield _typed(r, kind)

    return udtf(Table, returnType=kind, useArrow=True)


def _one(value: dict[str, Any] | None) -> list[dict[str, Any]]:
    return [] if value is None else [value]


def _of_items(name: str) -> Callable[[bytes], list[dict[str, Any]]]:
    return lambda b: [{"item_id": i["item_id"], **x} for i in containers.meta(b)["items"] for x in i[name]]


def _probed(b: bytes) -> list[dict[str, Any]]:
    """A look at the first blocks of each tile, with the distributions that are built in."""
    s = streams.stream(b)
    out = []
    for t in s["tiles"]:
        cols, rows = s["tile_info"]["mi_col_starts"], s["tile_info"]["mi_row_starts"]
        p = s["sequence_header"] | s["frame_header"] | {"mi_cols": cols[t["tile_col"] + 1] - cols[t["tile_col"]], "mi_rows": rows[t["tile_row"] + 1] - rows[t["tile_row"]]}
        out.append(t | syntax.probe(b[t["offset"] : t["offset"] + t["size"]], p))
    return out


#: Name, schema and rows of each function of one binary argument.
FUNCTIONS = {
    "media_boxes": (tables.BOX, lambda b: containers.boxes(b)[0]),
    "media_diagnostics": (tables.DIAGNOSTIC, lambda b: containers.boxes(b)[1] + containers.meta(b)["diagnostics"]),
    "media_meta": (tables.META, lambda b: _one(containers.meta(b)["meta"])),
    "media_items": (tables.ITEM, lambda b: containers.meta(b)["items"]),
    "media_extents": (f"item_id long, {tables.EXTENT}", _of_items("extents")),
    "media_item_props": (f"item_id long, {tables.ASSOC}", _of_items("props")),
    "media_properties": (tables.PROPERTY, lambda b: containers.meta(b)["properties"]),
    "av1_obus": (tables.OBU, lambda b: streams.obus(b)[0]),
    "av1_sequence_header": (tables.SEQUENCE, lambda b: _one(streams.stream(b)["sequence_header"])),
    "av1_frame_header": (tables.FRAME, lambda b: _one(streams.stream(b)["frame_header"])),
    "av1_tile_info": (tables.TILE_INFO, lambda b: _one(streams.stream(b)["tile_info"])),
    "av1_tile_groups": (tables.TILE_GROUP, lambda b: streams.stream(b)["tile_groups"]),
    "av1_tiles": (tables.TILE, lambda b: streams.stream(b)["tiles"]),
    "av1_tile_probe": (f"tg_index long, tile_num long, {PROBE}", _probed),
}


def register(spark: SparkSession) -> None:
    """FUNCTIONS, and the check av1_tile_ok(tile, bools)."""
    for name, (schema, rows) in FUNCTIONS.items():
        spark.udtf.register(name, _function(schema, rows))

    def checked(b, n):
        return None if b is None else entropy.tile_check(bytes(b), "exit", n or 0) is None

    spark.udf.register("av1_tile_ok", F.udf(checked, "boolean", useArrow=True))


def payload_view(spark: SparkSession, files: str, name: str, compat: str = "m1") -> None:
    """A view of the payloads of a table (path, content): what ``tables.payloads`` gives, which is no Python but the parser."""
    tables.payloads(spark.table(files), compat).createOrReplaceTempView(name)
