"""AV1 open bitstream units, headers and tile groups of one payload, as plain records."""

from __future__ import annotations

from functools import lru_cache
from typing import Any

from ..bitio import Bits, Malformed, Unsupported, floor_log2, leb128, tile_log2
from . import reasons as why
from .containers import problem

#: Names by obu_type; others are reserved. Fixed by the AV1 specification.
OBU_NAMES = ("reserved", "sequence_header", "temporal_delimiter", "frame_header", "tile_group", "metadata", "frame", "redundant_frame_header", "tile_list", "padding")
FRAME_TYPES = (3, 6, 7)
#: Segmentation features: bits, largest value, signed. Fixed by the AV1 specification.
SEGMENT_FEATURES = ((8, 255, True), (6, 63, True), (6, 63, True), (6, 63, True), (6, 63, True), (3, 7, False), (0, 0, False), (0, 0, False))
MAX_TILE_WIDTH, MAX_TILE_AREA, MAX_TILES = 4096, 4096 * 2304, 64


def obus(data: bytes, types: tuple[int, ...] | None = None, first_only: bool = False) -> tuple[list[dict[str, Any]], list[dict[str, Any]]]:
    """Units in order and diagnostics; a tail of zeros ends the scan."""
    out: list[dict[str, Any]] = []
    at = no = 0
    content = len(data.rstrip(b"\0"))
    try:
        while at < content:
            start, head = at, data[at]
            at += 1
            if head & 0x80:
                raise Malformed(why.OBU_FORBIDDEN_BIT)
            if not head & 2:
                raise Malformed(why.OBU_WITHOUT_SIZE)
            if head & 4:
                if at >= len(data):
                    raise Malformed(why.OBU_EXTENSION_CUT)
                at += 1
            if (sized := leb128(data, at)) is None:
                raise Malformed(why.OBU_SIZE)
            size, at = sized
            if size > len(data) - at:
                raise Malformed(why.OBU_OVERRUNS)
            kind = head >> 3 & 15
            if types is None or kind in types:
                out.append({"obu_no": no, "header_off": start, "payload_off": at, "obu_type": kind, "obu_type_name": OBU_NAMES[kind] if kind < len(OBU_NAMES) else "reserved", "has_extension": bool(head & 4), "payload_size": size})
                if first_only:
                    break
            at, no = at + size, no + 1
    except Malformed as e:
        return out, [problem("m3a", e, start)]
    return out, []


def color_config(b: Bits, s: dict[str, Any]) -> None:
    s["high_bitdepth"] = b.f(1, "high_bitdepth")
    s["twelve_bit"] = b.f(1, "twelve_bit") if s["seq_profile"] == 2 and s["high_bitdepth"] else 0
    if s["seq_profile"] > 2:
        raise Unsupported(why.PROFILE)
    s["bit_depth"] = 12 if s["twelve_bit"] else 10 if s["high_bitdepth"] else 8
    s["monochrome"] = 0 if s["seq_profile"] == 1 else b.f(1, "mono_chrome")
    s["color_description_present"] = b.f(1, "color_description_present_flag")
    primaries = transfer = matrix = 2
    if s["color_description_present"]:
        primaries, transfer, matrix = (b.f(8, "color_description") for _ in range(3))
    s |= {"color_primaries": primaries, "transfer_characteristics": transfer, "matrix_coefficients": matrix, "chroma_sample_position": 0, "separate_uv_delta_q": 0}
    if s["monochrome"]:
        s |= {"color_range": b.f(1, "color_range"), "subsampling_x": 1, "subsampling_y": 1}
        return
    if (primaries, transfer, matrix) == (1, 13, 0):  # sRGB
        s |= {"color_range": 1, "subsampling_x": 0, "subsampling_y": 0}
    else:
        s["color_range"] = b.f(1, "color_range")
        if s["seq_profile"] == 2 and s["bit_depth"] == 12:
            x = b.f(1, "subsampling_x")
            y = b.f(1, "subsampling_y") if x else 0
        else:
            x, y = ((1, 1), (0, 0), (1, 0))[s["seq_profile"]]
        s |= {"subsampling_x": x, "subsampling_y": y}
        if x and y:
            s["chroma_sample_position"] = b.f(2, "chroma_sample_position")
    s["separate_uv_delta_q"] = b.f(1, "separate_uv_delta_q")


def sequence_header(data: bytes) -> dict[str, Any]:
    b = Bits(data)
    t = "sequence header"
    s: dict[str, Any] = {"seq_profile": b.f(3, t), "still_picture": b.f(1, t), "reduced_still_picture_header": b.f(1, t)}
    reduced = s["reduced_still_picture_header"]
    s |= {"timing_info_present": 0, "decoder_model_info_present": 0, "initial_display_delay_present": 0, "operating_points_cnt": 1, "operating_point_idc_0": 0, "seq_tier_0": 0}
    if reduced:
        s["seq_level_idx_0"] = b.f(5, "seq_level_idx")
    else:
        delay_bits = 0
        s["timing_info_present"] = b.f(1, "timing_info_present_flag")
        if s["timing_info_present"]:
            b.f(32, "timing_info"), b.f(32, "timing_info")
            if b.f(1, "timing_info"):
                b.uvlc("timing_info")
            s["decoder_model_info_present"] = b.f(1, "decoder_model_info_present_flag")
            if s["decoder_model_info_present"]:
                delay_bits = b.f(5, "decoder_model_info") + 1
                b.f(32, "decoder_model_info"), b.f(5, "decoder_model_info"), b.f(5, "decoder_model_info")
        s["initial_display_delay_present"] = b.f(1, "initial_display_delay_present_flag")
        s["operating_points_cnt"] = b.f(5, "operating_points_cnt_minus_1") + 1
        for i in range(s["operating_points_cnt"]):
            idc, level = b.f(12, "operating_point_idc"), b.f(5, "seq_level_idx")
            tier = b.f(1, "seq_tier") if level > 7 else 0
            if s["decoder_model_info_present"] and b.f(1, "decoder_model_present_for_this_op"):
                b.f(delay_bits, "operating_parameters_info"), b.f(delay_bits, "operating_parameters_info"), b.f(1, "operating_parameters_info")
            if s["initial_display_delay_present"] and b.f(1, "initial_display_delay_present_for_this_op"):
                b.f(4, "initial_display_delay_minus_1")
            if i == 0:
                s |= {"operating_point_idc_0": idc, "seq_level_idx_0": level, "seq_tier_0": tier}
    w, h = b.f(4, "frame_width_bits") + 1, b.f(4, "frame_height_bits") + 1
    s |= {"frame_width_bits": w, "frame_height_bits": h, "max_frame_width": b.f(w, "max_frame_width") + 1, "max_frame_height": b.f(h, "max_frame_height") + 1}
    s["frame_id_numbers_present"] = 0 if reduced else b.f(1, "frame_id_numbers_present_flag")
    if s["frame_id_numbers_present"]:
        b.f(7, "frame_id_lengths")
    for k in ("use_128x128_superblock", "enable_filter_intra", "enable_intra_edge_filter"):
        s[k] = b.f(1, k)
    s |= {"enable_order_hint": 0, "order_hint_bits": 0, "seq_force_screen_content_tools": 2, "seq_force_integer_mv": 2}
    if not reduced:
        b.f(4, "inter tools")
        s["enable_order_hint"] = b.f(1, "enable_order_hint")
        if s["enable_order_hint"]:
            b.f(2, "order hint tools")
        if not b.f(1, "seq_choose_screen_content_tools"):
            s["seq_force_screen_content_tools"] = b.f(1, "seq_force_screen_content_tools")
        if s["seq_force_screen_content_tools"] and not b.f(1, "seq_choose_integer_mv"):
            s["seq_force_integer_mv"] = b.f(1, "seq_force_integer_mv")
        if s["enable_order_hint"]:
            s["order_hint_bits"] = b.f(3, "order_hint_bits_minus_1") + 1
    for k in ("enable_superres", "enable_cdef", "enable_restoration"):
        s[k] = b.f(1, k)
    color_config(b, s)
    s["film_grain_params_present"] = b.f(1, "film_grain_params_present")
    return s


def _frame_size(b: Bits, s: dict, h: dict, override: int) -> None:
    if override:
        width, height = b.f(s["frame_width_bits"], "frame_size override") + 1, b.f(s["frame_height_bits"], "frame_size override") + 1
    else:
        width, height = s["max_frame_width"], s["max_frame_height"]
    h |= {"upscaled_width": width, "superres_denom": 8}
    if s["enable_superres"] and b.f(1, "use_superres"):
        h["superres_denom"] = d = b.f(3, "coded_denom") + 9
        width = (width * 8 + d // 2) // d
    h |= {"coded_width": width, "coded_height": height, "mi_cols": 2 * ((width + 7) >> 3), "mi_rows": 2 * ((height + 7) >> 3)}
    h |= {"render_width": h["upscaled_width"], "render_height": height}
    if b.f(1, "render_and_frame_size_different"):
        h |= {"render_width": b.f(16, "render_size override") + 1, "render_height": b.f(16, "render_size override") + 1}


def tile_info(b: Bits, s: dict, h: dict) -> dict[str, Any]:
    shift = 5 if s["use_128x128_superblock"] else 4
    cols, rows = ((h[k] + (1 << shift) - 1) >> shift for k in ("mi_cols", "mi_rows"))
    size = shift + 2
    widest_allowed, area_allowed = MAX_TILE_WIDTH >> size, MAX_TILE_AREA >> (2 * size)
    min_cols = tile_log2(widest_allowed, cols)
    max_cols, max_rows = tile_log2(1, min(cols, MAX_TILES)), tile_log2(1, min(rows, MAX_TILES))
    min_tiles = max(min_cols, tile_log2(area_allowed, rows * cols))
    uniform = b.f(1, "uniform_tile_spacing_flag")

    def even(count: int, least: int, most: int, name: str) -> tuple[list[int], int]:
        k = least
        while k < most and b.f(1, f"increment_tile_{name}_log2"):
            k += 1
        return list(range(0, count, (count + (1 << k) - 1) >> k)), k

    def listed(count: int, most: int, name: str, what: str) -> tuple[list[int], int]:
        starts, at, widest = [], 0, 0
        while at < count:
            if len(starts) >= MAX_TILES:
                raise Malformed(why.TILE_LIMIT.format(name=name, upper=name.upper()))
            step = b.ns(min(count - at, most), f"{what}_in_sbs_minus_1") + 1
            widest = max(widest, step)
            starts.append(at)
            at += step
        return starts, widest

    if uniform:
        col_starts, log_cols = even(cols, min_cols, max_cols, "cols")
        row_starts, log_rows = even(rows, max(min_tiles - log_cols, 0), max_rows, "rows")
        for name, starts in (("cols", col_starts), ("rows", row_starts)):
            if len(starts) > MAX_TILES:
                raise Malformed(why.TILE_LIMIT.format(name=name, upper=name.upper()))
    else:
        col_starts, widest = listed(cols, widest_allowed, "cols", "width")
        log_cols = tile_log2(1, len(col_starts))
        area = (rows * cols) >> (min_tiles + 1) if min_tiles else rows * cols
        row_starts, _ = listed(rows, max(area // widest, 1), "rows", "height")
        log_rows = tile_log2(1, len(row_starts))
    context = size_bytes = 0
    if log_cols or log_rows:
        context = b.f(log_cols + log_rows, "context_update_tile_id")
        size_bytes = b.f(2, "tile_size_bytes_minus_1") + 1
        if context >= len(col_starts) * len(row_starts):
            raise Malformed(why.CONTEXT_TILE)
    return {
        "tile_cols": len(col_starts), "tile_rows": len(row_starts), "tile_cols_log2": log_cols, "tile_rows_log2": log_rows, "tile_size_bytes": size_bytes, "context_update_tile_id": context, "uniform": uniform,
        "mi_col_starts": [x << shift for x in col_starts] + [h["mi_cols"]], "mi_row_starts": [x << shift for x in row_starts] + [h["mi_rows"]],
    }


def _quantization(b: Bits, s: dict) -> dict[str, Any]:
    def delta() -> int:
        return b.su(7, "delta_q") if b.f(1, "delta_coded") else 0

    q = {"base_q_idx": b.f(8, "base_q_idx"), "delta_q_y_dc": delta(), "delta_q_u_dc": 0, "delta_q_u_ac": 0, "delta_q_v_dc": 0, "delta_q_v_ac": 0}
    if not s["monochrome"]:
        apart = b.f(1, "diff_uv_delta") if s["separate_uv_delta_q"] else 0
        q["delta_q_u_dc"], q["delta_q_u_ac"] = delta(), delta()
        q["delta_q_v_dc"], q["delta_q_v_ac"] = (delta(), delta()) if apart else (q["delta_q_u_dc"], q["delta_q_u_ac"])
    if b.f(1, "using_qmatrix"):
        b.f(8, "qmatrix")
        if s["separate_uv_delta_q"]:
            b.f(4, "qm_v")
    return q


def _segmentation(b: Bits) -> dict[str, Any]:
    g: dict[str, Any] = {"segmentation_enabled": b.f(1, "segmentation_enabled"), "seg_id_pre_skip": 0, "last_active_seg_id": 0, "alt_q": [{"enabled": False, "value": 0} for _ in range(8)]}
    if g["segmentation_enabled"]:
        for i in range(8):
            for j, (bits, most, signed) in enumerate(SEGMENT_FEATURES):
                if b.f(1, "feature_enabled"):
                    value = b.su(bits + 1, "signed feature_value") if signed else b.f(bits, "feature_value")
                    value = max(-most if signed else 0, min(most, value))
                    g["last_active_seg_id"] = i
                    g["seg_id_pre_skip"] |= int(j >= 5)
                    if j == 0:
                        g["alt_q"][i] = {"enabled": True, "value": value}
    return g


def _lossless(h: dict) -> int:
    flat = not any(h[k] for k in ("delta_q_y_dc", "delta_q_u_dc", "delta_q_u_ac", "delta_q_v_dc", "delta_q_v_ac"))
    return int(flat and all(max(0, min(255, h["base_q_idx"] + a["value"])) == 0 for a in h["alt_q"]))


def _tail(b: Bits, s: dict, h: dict) -> None:
    """From delta_q_params() to the end of the header."""
    planes = 1 if s["monochrome"] else 3
    h |= {"delta_q_present": 0, "delta_q_res": 0, "delta_lf_present": 0, "delta_lf_res": 0, "delta_lf_multi": 0, "cdef_bits": 0}
    if h["base_q_idx"]:
        h["delta_q_present"] = b.f(1, "delta_q_present")
    if h["delta_q_present"]:
        h["delta_q_res"] = b.f(2, "delta_q_res")
        if not h["allow_intrabc"]:
            h["delta_lf_present"] = b.f(1, "delta_lf_present")
        if h["delta_lf_present"]:
            h["delta_lf_res"], h["delta_lf_multi"] = b.f(2, "delta_lf_res/multi"), b.f(1, "delta_lf_res/multi")
    coded = h["coded_lossless"]
    if not (coded or h["allow_intrabc"]):
        a, c = b.f(6, "loop_filter_level[0/1]"), b.f(6, "loop_filter_level[0/1]")
        if planes > 1 and (a or c):
            b.f(12, "loop_filter_level[2/3]")
        b.f(3, "loop_filter_sharpness/delta_enabled")
        if b.f(1, "loop_filter_sharpness/delta_enabled") and b.f(1, "loop_filter_delta_update"):
            for count, name in ((8, "ref"), (2, "mode")):
                for _ in range(count):
                    if b.f(1, f"update_{name}_delta"):
                        b.su(7, f"loop_filter_{name}_deltas")
        if s["enable_cdef"]:
            b.f(2, "cdef_damping_minus_3/cdef_bits")
            h["cdef_bits"] = b.f(2, "cdef_damping_minus_3/cdef_bits")
            for _ in range(1 << h["cdef_bits"]):
                b.f(6, "cdef y strengths")
                if planes > 1:
                    b.f(6, "cdef uv strengths")
    all_lossless = coded and h["coded_width"] == h["upscaled_width"]
    if s["enable_restoration"] and not (all_lossless or h["allow_intrabc"]):
        kinds = [b.f(2, "lr_type") for _ in range(planes)]
        if any(kinds):
            if b.f(1, "lr_unit_shift") and not s["use_128x128_superblock"]:
                b.f(1, "lr_unit_extra_shift")
            if s["subsampling_x"] and s["subsampling_y"] and any(kinds[1:]):
                b.f(1, "lr_uv_shift")
    h["tx_mode"] = 0 if coded else 2 if b.f(1, "tx_mode_select") else 1
    h["reduced_tx_set"] = b.f(1, "reduced_tx_set")
    if s["film_grain_params_present"]:
        _film_grain(b, s)


def _film_grain(b: Bits, s: dict) -> None:
    if not b.f(1, "apply_grain"):
        return
    b.f(16, "grain_seed")

    def points(name: str) -> int:
        n = b.f(4, f"num_{name}_points")
        for _ in range(n):
            b.f(8, f"point_{name}_value"), b.f(8, f"point_{name}_scaling")
        return n

    luma = points("y")
    from_luma = 0 if s["monochrome"] else b.f(1, "chroma_scaling_from_luma")
    cb = cr = 0
    if not (s["monochrome"] or from_luma or (s["subsampling_x"] and s["subsampling_y"] and not luma)):
        cb, cr = points("cb"), points("cr")
    b.f(2, "grain_scaling_minus_8")
    lag = b.f(2, "ar_coeff_lag")
    n = 2 * lag * (lag + 1)
    for count, used, name in ((n, luma, "y"), (n + bool(luma), from_luma or cb, "cb"), (n + bool(luma), from_luma or cr, "cr")):
        for _ in range(count if used else 0):
            b.f(8, f"ar_coeffs_{name}_plus_128")
    b.f(2, "ar_coeff_shift_minus_6"), b.f(2, "grain_scale_shift")
    for used, name in ((cb, "cb"), (cr, "cr")):
        if used:
            b.f(8, f"{name}_mult"), b.f(8, f"{name}_luma_mult"), b.f(9, f"{name}_offset")
    b.f(1, "overlap_flag"), b.f(1, "clip_to_restricted_range")


def frame_header(data: bytes, s: dict[str, Any], whole: bool) -> tuple[dict[str, Any], dict[str, Any]]:
    """(frame header, tile info) of a shown key frame. ``whole``: read to the end, as a frame unit needs; otherwise
    what follows tile_info() is only looked at, and null where it isn't there."""
    b = Bits(data)
    reduced = s["reduced_still_picture_header"]
    h: dict[str, Any] = {"frame_type": 0, "show_frame": 1, "error_resilient_mode": 1}
    if s["frame_id_numbers_present"]:
        raise Unsupported("unsupported: frame_id_numbers_present_flag " + ("with reduced still" if reduced else "for still-picture subset"))
    if not reduced:
        if b.f(1, "show_existing_frame"):
            raise Unsupported(why.EXISTING_FRAME)
        h |= {"frame_type": b.f(2, "frame_type/show_frame"), "show_frame": b.f(1, "frame_type/show_frame")}
        if h["frame_type"] or not h["show_frame"]:
            raise Unsupported(why.NOT_A_KEY_FRAME)
    h["disable_cdf_update"] = b.f(1, "disable_cdf_update")
    tools = s["seq_force_screen_content_tools"]
    h["allow_screen_content_tools"] = b.f(1, "allow_screen_content_tools") if tools == 2 else tools
    if h["allow_screen_content_tools"] and s["seq_force_integer_mv"] == 2:
        b.f(1, "force_integer_mv")
    override = 0 if reduced else b.f(1, "frame_size_override_flag")
    b.f(s["order_hint_bits"], "order_hint")
    if s["decoder_model_info_present"] and b.f(1, "buffer_removal_time_present_flag"):
        raise Unsupported(why.REMOVAL_TIME)
    _frame_size(b, s, h, override)
    same_width = h["upscaled_width"] == h["coded_width"]
    h["allow_intrabc"] = b.f(1, "allow_intrabc") if h["allow_screen_content_tools"] and same_width else 0
    if not (reduced or h["disable_cdf_update"]):
        b.f(1, "disable_frame_end_update_cdf")
    tiles = tile_info(b, s, h)
    ahead, q = b.fork(), None
    try:
        q = _quantization(ahead, s) | _segmentation(ahead)
    except Malformed:
        if whole:
            raise
    if q is not None:
        h |= q
        h["coded_lossless"] = _lossless(h)
    if whole:
        _tail(ahead, s, h)
        ahead.align(strict=True)
        h["header_bytes"] = ahead.pos // 8
    return h, tiles


def tile_group(data: bytes, info: dict[str, Any]) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    """(tg_start, tg_end, header_bytes) and the tiles, with offsets within ``data``."""
    count = info["tile_cols"] * info["tile_rows"]
    b = Bits(data)
    first, last = 0, count - 1
    if count > 1 and b.f(1, "tile_start_and_end_present_flag"):
        bits = info["tile_cols_log2"] + info["tile_rows_log2"]
        first, last = b.f(bits, "tg_start/tg_end"), b.f(bits, "tg_start/tg_end")
        if not first <= last < count:
            raise Malformed(why.GROUP_BOUNDS)
    b.align(strict=True)
    at, tiles = b.pos // 8, []
    head = at
    for n in range(first, last + 1):
        if n < last:
            width = info["tile_size_bytes"]
            if at + width > len(data):
                raise Malformed(why.TILE_SIZE_CUT)
            size, at = int.from_bytes(data[at : at + width], "little") + 1, at + width
            if size > len(data) - at:
                raise Malformed(why.TILE_OVERRUNS)
        else:
            size = len(data) - at
        tiles.append({"tile_num": n, "tile_row": n // info["tile_cols"], "tile_col": n % info["tile_cols"], "offset": at, "size": size})
        at += size
    return {"tg_start": first, "tg_end": last, "header_bytes": head, "payload_bytes": len(data) - head}, tiles


#: Many streams begin with the same headers. What is remembered of them is bounded, and must not be changed.
_known_sequence = lru_cache(maxsize=1024)(sequence_header)


@lru_cache(maxsize=1024)
def _frame(data: bytes, coded: bytes, whole: bool) -> tuple[dict[str, Any], dict[str, Any]]:
    return frame_header(data, _known_sequence(coded), whole)


_whole_headers: dict[tuple[bytes, bytes], tuple[dict[str, Any], dict[str, Any]]] = {}
_whole_lengths: dict[bytes, set[int]] = {}


def _known_frame(data: bytes, coded: bytes, whole: bool) -> tuple[dict[str, Any], dict[str, Any]]:
    """``frame_header`` after the sequence header ``coded``. A whole header is read from its own bytes alone, whatever follows, and
    none is the beginning of another, so that it is known by them."""
    if not whole:
        return _frame(data, coded, whole) if len(data) <= 256 else frame_header(data, _known_sequence(coded), whole)
    for n in _whole_lengths.get(coded, ()):
        if got := _whole_headers.get((coded, data[:n])):
            return got
    got = frame_header(data, _known_sequence(coded), whole)
    if len(_whole_headers) >= 1024:
        _whole_headers.clear(), _whole_lengths.clear()
    n = got[0]["header_bytes"]
    _whole_headers[coded, data[:n]] = got
    _whole_lengths.setdefault(coded, set()).add(n)
    return got


def stream(data: bytes) -> dict[str, Any]:
    """{obus, sequence_header, frame_header, tile_info, tile_groups, tiles, diagnostics, status, reason} of a payload.

    The first sequence header and the first frame unit count; tile groups are the rest of a frame unit, numbered
    0, or all tile group units after a frame header, numbered from 1. The first error ends what depends on it.
    """
    units, notes = obus(data)
    out: dict[str, Any] = {"obus": units, "sequence_header": None, "frame_header": None, "tile_info": None, "tile_groups": [], "tiles": [], "diagnostics": notes, "status": "OK", "reason": None}
    part = lambda u: data[u["payload_off"] : u["payload_off"] + u["payload_size"]]
    stage, at = "m3a", 0
    try:
        if notes and not any(u["obu_type"] in FRAME_TYPES for u in units):
            raise Malformed(notes[0]["message"])
        head = next((u for u in units if u["obu_type"] == 1), None)
        if head is None:
            raise Malformed(why.NO_SEQUENCE_HEADER)
        at = head["payload_off"]
        out["sequence_header"] = s = _known_sequence(coded := part(head))
        stage = "m3b"
        frame = next((u for u in units if u["obu_type"] in FRAME_TYPES), None)
        if frame is None:
            raise Malformed(why.NO_FRAME_HEADER)
        at = frame["payload_off"]
        whole = frame["obu_type"] == 6
        h, info = _known_frame(part(frame), coded, whole)
        out["frame_header"], out["tile_info"] = {"obu_type": frame["obu_type"], **h}, info
        if whole:
            if h["header_bytes"] >= frame["payload_size"]:
                raise Malformed(why.GROUP_OVERRUNS)
            groups = [(0, at + h["header_bytes"], frame["payload_size"] - h["header_bytes"])]
        else:
            later = [u for u in units if u["obu_no"] > frame["obu_no"] and u["obu_type"] == 4]
            groups = [(i, u["payload_off"], u["payload_size"]) for i, u in enumerate(later, 1)]
        for index, at, size in groups:  # noqa: B007
            group, tiles = tile_group(data[at : at + size], info)
            out["tile_groups"].append({"tg_index": index, **group})
            out["tiles"] += [t | {"tg_index": index, "offset": at + t["offset"]} for t in tiles]
    except Malformed as e:
        out |= {"status": e.severity, "reason": str(e)}
        if not any(n["message"] == str(e) for n in out["diagnostics"]):
            out["diagnostics"] = [*out["diagnostics"], problem(stage, e, at)]
    return out


def ivf(payload: bytes, width: int, height: int) -> bytes:
    """One frame in an IVF file."""
    le = lambda x, n: x.to_bytes(n, "little")
    head = b"DKIF" + le(0, 2) + le(32, 2) + b"AV01" + le(width, 2) + le(height, 2) + le(30, 4) + le(1, 4) + le(1, 4) + le(0, 4)
    return head + le(len(payload), 4) + le(0, 8) + payload


__all__ = ["color_config", "floor_log2", "frame_header", "ivf", "obus", "sequence_header", "stream", "tile_group", "tile_info"]
