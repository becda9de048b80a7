"""The parsers as table functions: (path, content) in, typed tables out.

Each file is one row and one narrow step; nothing here shuffles. Bytes are passed on only where asked for.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import cached_property
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, StructType, _parse_datatype_string

from .. import batches
from . import containers, entropy, streams
from . import reasons as why

PERMISSIVE, DROPMALFORMED, FAILFAST = "PERMISSIVE", "DROPMALFORMED", "FAILFAST"

DIAGNOSTIC = "stage string, severity string, code string, message string, byte_offset long"
BOX = "box_seq long, parent_seq long, depth int, offset long, size long, header_size int, payload_off long, payload_len long, type_raw binary, type string, uuid string, is_fullbox boolean, version int, flags long, is_container boolean"
META = "handler_type string, primary_item_id long, idat_off long, idat_len long, item_count long, property_count long, warning_count long, status string, reason string"
EXTENT = "extent_no int, offset decimal(20,0), length decimal(20,0), ext_index decimal(20,0)"
ASSOC = "assoc_no int, prop_index int, essential boolean"
ITEM = f"item_no int, item_id long, item_type string, has_iloc boolean, iloc_version int, construction_method int, data_reference_index int, base_offset decimal(20,0), extents array<struct<{EXTENT}>>, props array<struct<{ASSOC}>>"
PROPERTY = (
    "prop_index int, type string, box_offset long, box_size long, ispe struct<width:long,height:long>, pixi struct<channels:int,depths:array<int>>, "
    "av1c struct<version:int,profile:int,level_idx_0:int,tier_0:int,high_bitdepth:int,twelve_bit:int,monochrome:int,subsampling_x:int,subsampling_y:int,chroma_sample_position:int,ipd_present:int,ipd_minus_one:int>"
)
OBU = "obu_no long, header_off long, payload_off long, obu_type int, obu_type_name string, has_extension boolean, payload_size long"
_INTS = lambda names: ", ".join(f"{n} long" for n in names.split())
SEQUENCE = _INTS(
    "seq_profile still_picture reduced_still_picture_header timing_info_present decoder_model_info_present initial_display_delay_present operating_points_cnt operating_point_idc_0 seq_level_idx_0 seq_tier_0 "
    "frame_width_bits frame_height_bits max_frame_width max_frame_height frame_id_numbers_present use_128x128_superblock enable_filter_intra enable_intra_edge_filter enable_order_hint order_hint_bits "
    "seq_force_screen_content_tools seq_force_integer_mv enable_superres enable_cdef enable_restoration high_bitdepth twelve_bit bit_depth monochrome color_description_present color_primaries "
    "transfer_characteristics matrix_coefficients color_range subsampling_x subsampling_y chroma_sample_position separate_uv_delta_q film_grain_params_present"
)
FRAME = (
    _INTS(
        "obu_type header_bytes frame_type show_frame error_resilient_mode disable_cdf_update allow_screen_content_tools allow_intrabc upscaled_width superres_denom coded_width coded_height mi_cols mi_rows render_width "
        "render_height base_q_idx delta_q_y_dc delta_q_u_dc delta_q_u_ac delta_q_v_dc delta_q_v_ac coded_lossless segmentation_enabled seg_id_pre_skip last_active_seg_id"
    )
    + ", alt_q array<struct<enabled:boolean,value:int>>, "
    + _INTS("delta_q_present delta_q_res delta_lf_present delta_lf_res delta_lf_multi cdef_bits tx_mode reduced_tx_set")
)
TILE_INFO = _INTS("tile_cols tile_rows tile_cols_log2 tile_rows_log2 tile_size_bytes context_update_tile_id uniform") + ", mi_col_starts array<int>, mi_row_starts array<int>"
TILE_GROUP = _INTS("tg_index tg_start tg_end header_bytes payload_bytes")
TILE = _INTS("tg_index tile_num tile_row tile_col offset size")
STREAM = f"status string, reason string, obus array<struct<{OBU}>>, sequence_header struct<{SEQUENCE}>, frame_header struct<{FRAME}>, tile_info struct<{TILE_INFO}>, tile_groups array<struct<{TILE_GROUP}>>, tiles array<struct<{TILE}>>, diagnostics array<struct<{DIAGNOSTIC}>>"


def _plain(kind: pa.DataType) -> Callable[[Any], Any] | None:
    """What makes decimals of integers wherever a type has them; None for a type that has none and takes what it is given."""
    if pa.types.is_decimal(kind):
        return lambda x: None if x is None else Decimal(x)
    if pa.types.is_list(kind) and (each := _plain(kind.value_type)):
        return lambda x: None if x is None else [each(y) for y in x]
    if pa.types.is_struct(kind) and (wide := [(f.name, each) for f in kind if (each := _plain(f.type))]):
        return lambda x: None if x is None else x | {n: each(x.get(n)) for n, each in wide}
    return None


def per_file(files: DataFrame, parse: Callable[[bytes], dict[str, Any]], schema: str, key: str = "path", content: str = "content", keep_content: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a file: its key, the columns to ``carry``, what ``parse`` makes of its bytes (null: of none) and, if asked for,
    the bytes. What earlier steps found of a file comes along and need not be joined."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in kind]
    exact = {n: f for n, t in arrow if (f := _plain(t))}
    base = files.select(key, content, *carry)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [parse(x or b"") for x in batch[content].to_pylist()]
        cols = [pa.array([exact[n](r.get(n)) for r in rows] if n in exact else [r.get(n) for r in rows], t) for n, t in arrow]
        names = [key, *carry, *(n for n, _ in arrow), *[content] * keep_content]
        return pa.RecordBatch.from_arrays([batch[key], *(batch[c] for c in carry), *cols, *[batch[content]] * keep_content], names)

    out = StructType([base.schema[key], *(base.schema[c] for c in carry), *kind.fields, *[base.schema[content]] * keep_content])
    batches.small(files.sparkSession)
    return base.mapInArrow(batches.sliced(run), out)


def _moded(parsed: DataFrame, mode: str) -> DataFrame:
    bad = F.exists("diagnostics", lambda d: d["severity"] != "WARNING")
    if mode == DROPMALFORMED:
        return parsed.where(~bad)
    if mode == FAILFAST:
        first = F.element_at(F.filter("diagnostics", lambda d: d["severity"] != "WARNING"), 1)["message"]
        return parsed.where(F.when(bad, F.raise_error(F.concat_ws(": ", "path", first)).cast("boolean")).otherwise(F.lit(True)))
    if mode != PERMISSIVE:
        raise ValueError(mode)
    return parsed


def _parse_boxes(max_depth: int):
    def parse(data: bytes) -> dict[str, Any]:
        rows, notes = containers.boxes(data, max_depth)
        return {"boxes": rows, "diagnostics": notes}

    return parse


def boxes(files: DataFrame, max_depth: int = containers.MAX_DEPTH, mode: str = PERMISSIVE) -> DataFrame:
    """A row a box, depth first; the rows before a broken box stay (see ``box_diagnostics``)."""
    return _moded(box_trees(files, max_depth), mode).select("path", F.inline("boxes"))


def box_trees(files: DataFrame, max_depth: int = containers.MAX_DEPTH, keep_content: bool = False) -> DataFrame:
    return per_file(files, _parse_boxes(max_depth), f"boxes array<struct<{BOX}>>, diagnostics array<struct<{DIAGNOSTIC}>>", keep_content=keep_content)


def box_diagnostics(files: DataFrame, max_depth: int = containers.MAX_DEPTH) -> DataFrame:
    return box_trees(files, max_depth).select("path", F.inline("diagnostics"))


class MetaTables:
    """Item metadata of container files, parsed once: a row a file with nested arrays, and the flat tables of it."""

    def __init__(self, files: DataFrame, mode: str = PERMISSIVE, keep_content: bool = False, carry: tuple[str, ...] = ()) -> None:
        schema = f"meta struct<{META}>, items array<struct<{ITEM}>>, properties array<struct<{PROPERTY}>>, diagnostics array<struct<{DIAGNOSTIC}>>"
        self.nested = _moded(per_file(files, containers.meta, schema, keep_content=keep_content, carry=carry), mode)
        self._named = self.nested if mode != PERMISSIVE else per_file(files, containers.meta, f"items array<struct<item_no int, item_id long, item_type string, props array<struct<{ASSOC}>>>>, properties array<struct<{PROPERTY}>>")

    @cached_property
    def meta(self) -> DataFrame:
        return self.nested.select("path", "meta.*")

    @cached_property
    def items(self) -> DataFrame:
        i = self.nested.select("path", F.col("meta.primary_item_id").alias("p"), F.explode("items").alias("i")).select("path", "p", "i.*")
        return i.select(*[c for c in i.columns if c not in ("p", "extents", "props")], F.size("extents").alias("extent_count"), F.size("props").alias("prop_count"), F.col("item_id").eqNullSafe(F.col("p")).alias("is_primary"))

    @cached_property
    def extents(self) -> DataFrame:
        return self.nested.select("path", F.explode("items").alias("i")).select("path", "i.item_id", F.inline("i.extents"))

    @cached_property
    def properties(self) -> DataFrame:
        return self.nested.select("path", F.inline("properties"))

    @cached_property
    def item_props(self) -> DataFrame:
        return self.nested.select("path", F.explode("items").alias("i")).select("path", "i.item_id", F.inline("i.props"))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self.nested.select("path", F.inline("diagnostics"))

    @cached_property
    def resolved(self) -> DataFrame:
        """Items with the properties they name; an index of 0 or beyond the list names none. Both sides come from one
        row, so the lookup is by position in the row's list and shuffles nothing."""
        p = self._named.select("path", "properties", F.explode("items").alias("i")).select("path", "properties", "i.item_id", "i.item_type", "i.item_no", F.explode_outer("i.props").alias("a"))
        named = F.when((F.col("a.prop_index") > 0) & (F.col("a.prop_index") <= F.size("properties")), F.try_element_at("properties", F.col("a.prop_index")))
        return p.withColumn("q", named).select("path", "item_no", "item_id", "item_type", "a.assoc_no", "a.prop_index", "a.essential", F.col("q.type").alias("type"), F.col("q.ispe").alias("ispe"), F.col("q.pixi").alias("pixi"), F.col("q.av1c").alias("av1c"))


def payloads(files: DataFrame, compat: str = "m1", carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, the columns to ``carry``, item_id, total_bytes, payload, status, reason) of each file's primary item.

    Extents are sliced out of the file's own bytes in the row and put together in order. The first predicate that
    fails gives the reason, in the order in which they are listed. ``compat="m2"`` takes extents that have an index.
    """
    m = MetaTables(files, keep_content=True, carry=carry).nested
    p = m.withColumn("item", F.when(F.col("meta.status") == "OK", F.try_element_at(F.filter("items", lambda i: i["item_id"] == F.col("meta.primary_item_id")), F.lit(1)))).drop("items", "properties")
    i, method, size = F.col("item"), F.col("item.construction_method"), F.length("content").cast("decimal(20,0)")
    idat = F.col("meta.idat_len").cast("decimal(20,0)")
    base = F.when(method == 1, F.col("meta.idat_off")).otherwise(F.lit(0)).cast("decimal(20,0)")
    e_sum = lambda e: e["offset"].cast("decimal(21,0)") + e["length"]

    def broken(e):
        m1 = F.when(e["ext_index"].isNotNull(), F.lit(why.EXTENT_INDEX)) if compat == "m1" else F.when(F.lit(False), F.lit(""))
        return (
            m1.when(e["length"] == 0, why.EXTENT_LENGTH)
            .when((method == 1) & idat.isNull(), why.NO_IDAT)
            .when((method == 1) & (e["offset"] > idat), why.IDAT_OFFSET)
            .when((method == 1) & (e_sum(e) > idat), why.IDAT_OVERRUNS)
            .when(base + e_sum(e) > size, why.EXTENT_OVERRUNS)
        )

    extents = F.col("item.extents")
    reason = (
        F.when(F.col("meta.status") != "OK", F.col("meta.reason"))
        .when(F.col("meta.primary_item_id").isNull(), why.NO_PRIMARY)
        .when(i.isNull(), why.PRIMARY_MISSING)
        .when(~F.col("item.item_type").eqNullSafe("av01"), why.PRIMARY_TYPE)
        .when(~F.col("item.has_iloc") | (F.size(extents) == 0), why.NO_EXTENTS)
        .when(F.col("item.data_reference_index") != 0, F.format_string(why.EXTERNAL_DATA, F.col("item.data_reference_index")))
        .when(method == 2, why.ITEM_BASED)
        .when(method > 1, F.format_string(why.METHOD, method))
        .otherwise(F.try_element_at(F.filter(F.transform(extents, broken), lambda r: r.isNotNull()), F.lit(1)))
    )
    piece = lambda e: F.substring(F.col("content"), (base + e["offset"]).cast("int") + 1, e["length"].cast("int"))
    whole = F.aggregate(F.transform(extents, piece), F.lit(b""), lambda a, b: F.concat(a, b))
    unsupported = F.col("reason").contains("unsupported") | F.col("reason").contains("not a coded")
    p = p.withColumn("reason", reason).withColumn("payload", F.when(F.col("reason").isNull(), whole))
    status = F.when(F.col("reason").isNull(), "OK").when(unsupported, "UNSUPPORTED").otherwise("ERROR")
    return p.select("path", *carry, F.col("meta.primary_item_id").alias("item_id"), F.length("payload").cast("long").alias("total_bytes"), "payload", status.alias("status"), "reason")


def _one_header(units: list[dict[str, Any]], notes: list[dict[str, Any]]) -> str | None:
    if notes:
        return notes[0]["message"]
    n = sum(u["obu_type"] == 1 for u in units)
    return None if n == 1 else why.SEQUENCE_HEADERS.format(n=n)


def payload_checks(payloads_: DataFrame) -> DataFrame:
    """(path, obu_count, sequence_headers, reason): an extracted payload must hold just one sequence header."""

    def parse(data: bytes) -> dict[str, Any]:
        units, notes = streams.obus(data)
        return {"obu_count": len(units), "sequence_headers": sum(u["obu_type"] == 1 for u in units), "reason": _one_header(units, notes)}

    return per_file(payloads_, parse, "obu_count long, sequence_headers long, reason string", content="payload")


def obus(payloads_: DataFrame, types: tuple[int, ...] | None = None, first_only: bool = False, content: str = "payload") -> DataFrame:
    def parse(data: bytes) -> dict[str, Any]:
        return {"obus": streams.obus(data, types, first_only)[0]}

    return per_file(payloads_, parse, f"obus array<struct<{OBU}>>", content=content).select("path", F.inline("obus"))


class StreamTables:
    """Headers and tiles of AV1 payloads, parsed once a table that is asked for."""

    def __init__(self, payloads_: DataFrame, content: str = "payload", mode: str = PERMISSIVE, keep_content: bool = False, carry: tuple[str, ...] = ()) -> None:
        self.content, self.mode, self.keep_content, self.carry = content, mode, keep_content, carry
        self.payloads = payloads_

    def part(self, *names: str, **fields: str) -> DataFrame:
        """The named columns of ``nested``, and its path, bytes and carried ones; records of the others are not made into rows.
        ``fields``: by column the fields, apart by blanks, of which alone its structs consist."""
        kept = ("path", *self.carry, *names, *fields, *[self.content] * self.keep_content)
        if self.mode != PERMISSIVE:  # which looks at the diagnostics
            return self.nested.select(*kept)

        def shape(kind: DataType, only: str | None) -> str:
            if only is None:
                return kind.simpleString()
            inner = f"struct<{', '.join(f'{f.name}:{f.dataType.simpleString()}' for f in (kind.elementType if isinstance(kind, ArrayType) else kind) if f.name in only.split())}>"
            return f"array<{inner}>" if isinstance(kind, ArrayType) else inner

        schema = ", ".join(f"{f.name} {shape(f.dataType, fields.get(f.name))}" for f in _parse_datatype_string(STREAM) if f.name in kept)
        return per_file(self.payloads, streams.stream, schema, content=self.content, keep_content=self.keep_content, carry=self.carry)

    def tiles_of(self, fields: str) -> DataFrame:
        """The named columns of ``tiles``, of those that TILE lists."""
        return self.part(tiles=fields).select("path", F.inline("tiles")).select("path", *fields.split())

    @cached_property
    def nested(self) -> DataFrame:
        return _moded(per_file(self.payloads, streams.stream, STREAM, content=self.content, keep_content=self.keep_content, carry=self.carry), self.mode)

    def _struct(self, name: str) -> DataFrame:
        return self.part(name).where(F.col(name).isNotNull()).select("path", f"{name}.*")

    def _rows(self, name: str) -> DataFrame:
        return self.part(name).select("path", F.inline(name))

    obus = cached_property(lambda self: self._rows("obus"))
    sequence_headers = cached_property(lambda self: self._struct("sequence_header"))
    frame_headers = cached_property(lambda self: self._struct("frame_header"))
    tile_info = cached_property(lambda self: self._struct("tile_info"))
    tile_groups = cached_property(lambda self: self._rows("tile_groups"))
    diagnostics = cached_property(lambda self: self._rows("diagnostics"))

    @cached_property
    def tiles(self) -> DataFrame:
        """Tiles, with their bounds in units of 4x4; with ``keep_content`` also their bytes."""
        return self.tiles_with()

    def tiles_with(self, *more: Column, of: tuple[str, ...] | None = None) -> DataFrame:
        """``tiles`` and columns of the row that they come from, such as header fields: nothing is joined. ``of``: the columns of
        ``nested`` that these read, any if left out."""
        rows = self.nested if more and of is None else self.part("tile_info", "tiles", *of or ())
        t = rows.select("path", "tile_info", *[self.content] * (self.content in rows.columns), F.explode("tiles").alias("t"), *more)
        names = t.columns[len(t.columns) - len(more) :]
        at = lambda name, i: F.element_at(f"tile_info.{name}", (i + 1).cast("int"))
        body = [F.substring(F.col(self.content), F.col("t.offset").cast("int") + 1, F.col("t.size").cast("int")).alias("payload")] if self.content in t.columns else []
        return t.select("path", "t.*", at("mi_col_starts", F.col("t.tile_col")).alias("mi_col_start"), at("mi_col_starts", F.col("t.tile_col") + 1).alias("mi_col_end"), at("mi_row_starts", F.col("t.tile_row")).alias("mi_row_start"), at("mi_row_starts", F.col("t.tile_row") + 1).alias("mi_row_end"), *body, *names)


def tile_checks(tiles: DataFrame, check: str = "exit", bools: int = 0) -> DataFrame:
    """(path, tg_index, tile_num, check, ok, reason); ``tiles`` must carry ``payload``. Tiles are independent: the
    check is a narrow step over tiles."""
    keys = ["path", "tg_index", "tile_num"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        why = [entropy.tile_check(x or b"", check, bools) for x in batch["payload"].to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array([check] * len(why), pa.string()), pa.array([w is None for w in why], pa.bool_()), pa.array(why, pa.string())], [*keys, "check", "ok", "reason"])

    batches.small(tiles.sparkSession)
    base = tiles.select(*keys, "payload")
    return base.mapInArrow(batches.sliced(run), StructType([*base.select(*keys).schema.fields, *_parse_datatype_string("check string, ok boolean, reason string").fields]))
