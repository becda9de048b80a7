"""The walk through a tile's syntax as a table function, and the distributions that it takes."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from .. import batches
from . import coefficients
from .syntax import MODE_TABLES, probe

#: A transform block; base_level is there where a block was read as far as that only.
TRANSFORM = "plane int, x4 int, y4 int, skip_ctx int, all_zero int, eob int, base_level int, dc int, cul_level int"
_STATED = "skip_ctx int, skip int, segment_id int, qindex int, lossless boolean, cdef int, current_qindex int, filter array<int>, y_mode_ctx int, y_mode int, angle_delta_y int, uv_mode int, cfl_signs int, cfl_alpha_u int, cfl_alpha_v int, angle_delta_uv int, "
_STATED += "has_palette_y int, palette_size_y int, has_palette_uv int, palette_size_uv int, use_filter_intra int, filter_intra_mode int, tx_depth int, tx_width int, tx_height int, tx_type string"
BLOCK = f"r int, c int, wlog2 int, hlog2 int, {_STATED}, tx array<struct<{TRANSFORM}>>"
#: The tile's counters, its first partition, and its first block with the first luma transform block.
PROBE = f"status string, reason string, partition_symbols long, forced_splits long, leaf_blocks long, blocks_decoded long, partition string, partition_ctx int, forced boolean, depth int, wlog2 int, hlog2 int, {_STATED}, all_zero int, eob int, dc int, cul_level int"

_SEQUENCE = ("use_128x128_superblock", "monochrome", "subsampling_x", "subsampling_y", "enable_filter_intra", "enable_cdef")
_FRAME = (
    "disable_cdf_update", "allow_screen_content_tools", "allow_intrabc", "coded_lossless", "base_q_idx", "delta_q_y_dc", "delta_q_u_dc", "delta_q_u_ac", "delta_q_v_dc", "delta_q_v_ac", "tx_mode", "reduced_tx_set",
    "segmentation_enabled", "seg_id_pre_skip", "last_active_seg_id", "alt_q", "delta_q_present", "delta_q_res", "delta_lf_present", "delta_lf_res", "delta_lf_multi", "cdef_bits",
)


def load_tables(text: str) -> dict[str, Any]:
    """Distributions from JSON (name: nested rows of cumulative values that end in 32768), checked: those of the modes,
    and all or none of those of the block's rest."""
    got = json.loads(text)
    for name, (rows, symbols) in MODE_TABLES.items():
        table = got.get(name)
        if table is None or len(table) != rows or any(len(r) != symbols or r[-1] != 32768 or sorted(r) != r for r in table):
            raise ValueError(f"{name}: {rows} rows of {symbols} rising values up to 32768 are needed")
    more = coefficients.BLOCK_TABLES | coefficients.COEFF_TABLES
    return {k: got[k] for k in MODE_TABLES} | ({k: v for k, v in coefficients.check(got).items() if k in more} if set(more) & set(got) else {})


def tile_probe(streams, tables: dict[str, Any] | None = None, whole: bool = False, blocks: bool = False) -> DataFrame:
    """(path, tg_index, tile_num, PROBE) of the tiles of StreamTables that keep their bytes; a narrow step over tiles.

    ``whole``: each tile is read to its end, which gives OK if its padding is right; otherwise two blocks at most are read
    and the status is UNSUPPORTED, with the point that was reached, or ERROR. ``blocks``: all blocks come along as an array,
    for ``mi_blocks`` and ``transforms``. An empty tile is an ERROR; what a header lacks counts as 0."""
    rows = streams.tiles_with(*[F.col(f"sequence_header.{c}") for c in _SEQUENCE], *[F.col(f"frame_header.{c}") for c in _FRAME], of=("sequence_header", "frame_header"))
    rows = rows.selectExpr("path", "tg_index", "tile_num", "payload", "mi_row_end - mi_row_start AS mi_rows", "mi_col_end - mi_col_start AS mi_cols", *_SEQUENCE, *_FRAME)
    kind = _parse_datatype_string(PROBE + f", blocks array<struct<{BLOCK}>>" * blocks)
    keys = ["path", "tg_index", "tile_num"]
    arrow = [(f.name, to_arrow_type(f.dataType)) for f in kind]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [probe(r["payload"], r, tables, whole) for r in batch.to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *(pa.array([g.get(n) for g in got], a) for n, a in arrow)], [*keys, *(n for n, _ in arrow)])

    batches.small(rows.sparkSession)
    return rows.mapInArrow(batches.sliced(run), StructType([*rows.select(*keys).schema.fields, *kind.fields]))


def mi_blocks(probed: DataFrame) -> DataFrame:
    """(path, tg_index, tile_num, block_no, BLOCK without transforms): a row a block, in the order of coding."""
    each = probed.select("path", "tg_index", "tile_num", F.posexplode("blocks").alias("block_no", "b"))
    return each.select("path", "tg_index", "tile_num", "block_no", *[f"b.{f.name}" for f in _parse_datatype_string(BLOCK) if f.name != "tx"])


def transforms(probed: DataFrame) -> DataFrame:
    """(path, tg_index, tile_num, block_no, tx_no, TRANSFORM): a row a transform block."""
    each = probed.select("path", "tg_index", "tile_num", F.posexplode("blocks").alias("block_no", "b"))
    return each.select("path", "tg_index", "tile_num", "block_no", F.posexplode("b.tx").alias("tx_no", "t")).select("path", "tg_index", "tile_num", "block_no", "tx_no", "t.*")
