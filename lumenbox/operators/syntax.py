"""The syntax of a tile from its first symbol to its last: the partition tree, what a block states before its coefficients, and
the coefficients of all planes, with the contexts that come from the blocks above and to the left.

What comes out is for statistics on streams and tells whether a tile is coded as it should be; it is not a decoded image.
Modes of key frames are read by block size, a skipped block ends after its mode, and the transform type is read once a
block: the register of decisions in the survey (D14 to D16) keeps these.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from ..bitio import Malformed, Unsupported
from . import coefficients as k
from .entropy import Symbols

PARTITIONS = ("NONE", "HORZ", "VERT", "SPLIT", "HORZ_A", "HORZ_B", "VERT_A", "VERT_B", "HORZ_4", "VERT_4")
#: Partition types that divide horizontally or vertically, among which a choice is left at the picture's edge.
SPLITS_DOWN = ("VERT", "SPLIT", "HORZ_A", "VERT_A", "VERT_B", "VERT_4")
SPLITS_ACROSS = ("HORZ", "SPLIT", "HORZ_A", "HORZ_B", "VERT_A", "HORZ_4")
#: Blocks of a partition in order: row and column in quarters of its side, then log2 by which width and height are less.
BLOCKS = {
    "NONE": ((0, 0, 0, 0),),
    "HORZ": ((0, 0, 0, 1), (2, 0, 0, 1)),
    "VERT": ((0, 0, 1, 0), (0, 2, 1, 0)),
    "HORZ_A": ((0, 0, 1, 1), (0, 2, 1, 1), (2, 0, 0, 1)),
    "HORZ_B": ((0, 0, 0, 1), (2, 0, 1, 1), (2, 2, 1, 1)),
    "VERT_A": ((0, 0, 1, 1), (2, 0, 1, 1), (0, 2, 1, 0)),
    "VERT_B": ((0, 0, 1, 0), (0, 2, 1, 1), (2, 2, 1, 1)),
    "HORZ_4": tuple((i, 0, 0, 2) for i in range(4)),
    "VERT_4": tuple((0, i, 2, 0) for i in range(4)),
}

#: Default distributions of the AV1 specification: partitions of 8x8 to 128x128 by context, then skip by context, then the
#: size of a quantizer or filter change. Fixed values.
PARTITION_CDFS = (
    ((19132, 25510, 30392, 32768), (13928, 19855, 28540, 32768), (12522, 23679, 28629, 32768), (9896, 18783, 25853, 32768)),
    (
        (15597, 20929, 24571, 26706, 27664, 28821, 29601, 30571, 31902, 32768), (7925, 11043, 16785, 22470, 23971, 25043, 26651, 28701, 29834, 32768),
        (5414, 13269, 15111, 20488, 22360, 24500, 25537, 26336, 32117, 32768), (2662, 6362, 8614, 20860, 23053, 24778, 26436, 27829, 31171, 32768),
    ),
    (
        (18462, 20920, 23124, 27647, 28227, 29049, 29519, 30178, 31544, 32768), (7689, 9060, 12056, 24992, 25660, 26182, 26951, 28041, 29052, 32768),
        (6015, 9009, 10062, 24544, 25409, 26545, 27071, 27526, 32047, 32768), (1394, 2208, 2796, 28614, 29061, 29466, 29840, 30185, 31899, 32768),
    ),
    (
        (20137, 21547, 23078, 29566, 29837, 30261, 30524, 30892, 31724, 32768), (6732, 7490, 9497, 27944, 28250, 28515, 28969, 29630, 30104, 32768),
        (5945, 7663, 8348, 28683, 29117, 29749, 30064, 30298, 32238, 32768), (870, 1212, 1487, 31198, 31394, 31574, 31743, 31881, 32332, 32768),
    ),
    (
        (27899, 28219, 28529, 32484, 32539, 32619, 32639, 32768), (6607, 6990, 8268, 32060, 32219, 32338, 32371, 32768),
        (5429, 6676, 7122, 32027, 32227, 32531, 32582, 32768), (711, 966, 1172, 32448, 32538, 32617, 32664, 32768),
    ),
)
SKIP_CDFS = ((31671, 32768), (16515, 32768), (4576, 32768))
DELTA_CDF = (28160, 32120, 32677, 32768)

#: Distributions that come as a parameter, with the shape of each: contexts, then symbols.
MODE_TABLES = {"y_mode": (4, 13), "angle_delta": (8, 7), "uv_mode_cfl": (13, 14), "uv_mode_no_cfl": (13, 13), "cfl_sign": (1, 8), "cfl_alpha": (6, 16)}
BUILT_IN = {"partition": PARTITION_CDFS, "skip": SKIP_CDFS, "delta_q": DELTA_CDF, "delta_lf": (DELTA_CDF,) * 5}

#: The transform types of chroma by the chroma mode. Fixed by the AV1 specification.
MODE_TO_TX = ("DCT_DCT", "ADST_DCT", "DCT_ADST", "DCT_DCT", "ADST_ADST", "ADST_DCT", "DCT_ADST", "DCT_ADST", "ADST_DCT", "ADST_ADST", "ADST_DCT", "DCT_ADST", "ADST_ADST", "DCT_DCT")


class Enough(Exception):
    """The first blocks have been seen."""


def edge_cdf(cdf: tuple[int, ...] | list[int], names: tuple[str, ...], symbols: int) -> list[int]:
    """The choice between dividing once and splitting, where only one is possible otherwise: its mass is that of all
    types that divide the other way, too."""
    mass = [b - a for a, b in zip((0, *cdf[: symbols - 1]), cdf[:symbols], strict=True)]
    split = sum(m for m, n in zip(mass, PARTITIONS, strict=False) if n in names)
    return [32768 - split, 32768, 0]


def size_group(wlog2: int, hlog2: int) -> int:
    """Blocks by their smaller side: below 8, 16, 32 samples, and from there."""
    return min(3, min(wlog2, hlog2))


def directional(mode: int) -> int | None:
    """Which of eight directions a mode is of, the vertical one first."""
    return mode - 1 if 1 <= mode <= 8 else None


def chroma_transform(w: int, h: int) -> tuple[int, int]:
    """Log2 of the sides of a chroma block's transforms from log2 of the block's in units of four samples: 32 at most."""
    return min(w + 2, 5), min(h + 2, 5)


class Grid:
    """What is known of each 4x4 unit of a tile; of units not reached yet, nothing."""

    FIELDS = ("wlog2", "hlog2", "skip", "segment", "palette_y")

    def __init__(self, rows: int, cols: int) -> None:
        self.rows, self.cols = rows, cols
        self.cells = {f: [0] * (rows * cols) for f in self.FIELDS}

    def fill(self, r: int, c: int, w: int, h: int, **values: int) -> None:
        """Set fields of the block of 2^w x 2^h units at (r, c), as far as it lies in the tile."""
        width = max(0, min(c + (1 << w), self.cols) - c)
        starts = range(r * self.cols + c, min(r + (1 << h), self.rows) * self.cols + c, self.cols) if self.cols else ()
        for field, value in values.items():
            cells, row = self.cells[field], [value] * width
            for at in starts:
                cells[at : at + width] = row

    def above(self, field: str, r: int, c: int) -> int | None:
        return self.cells[field][(r - 1) * self.cols + c] if 0 < r <= self.rows and c < self.cols else None

    def left(self, field: str, r: int, c: int) -> int | None:
        return self.cells[field][r * self.cols + c - 1] if 0 < c <= self.cols and r < self.rows else None

    def corner(self, field: str, r: int, c: int) -> int | None:
        return self.cells[field][(r - 1) * self.cols + c - 1] if 0 < r <= self.rows and 0 < c <= self.cols else None


class Plane:
    """Levels and signs of the last transform blocks along the upper and left edge, in units of four samples."""

    def __init__(self, cols: int, rows: int) -> None:
        self.level = ([0] * cols, [0] * rows)
        self.sign = ([0] * cols, [0] * rows)

    def edges(self, of: tuple[list[int], list[int]], x: int, y: int, w: int, h: int) -> tuple[list[int], list[int]]:
        return of[0][x : x + w], of[1][y : y + h]

    def set(self, x: int, y: int, w: int, h: int, level: int, sign: int) -> None:
        for of, value in ((self.level, level), (self.sign, sign)):
            for line, at, n in ((of[0], x, w), (of[1], y, h)):
                n = max(0, min(at + n, len(line)) - at)
                line[at : at + n] = [value] * n


class Tile:
    """A walk through one tile. ``whole``: all of it and the padding after the last symbol; otherwise the first blocks of the
    first superblock, two at most, with all of the first one's luma that is needed to know its first two transform blocks.

    p: mi_rows, mi_cols (of the tile), use_128x128_superblock, disable_cdf_update, monochrome, subsampling_x, subsampling_y,
    coded_lossless, base_q_idx, the delta_q_* of the header, tx_mode, reduced_tx_set, enable_filter_intra,
    allow_screen_content_tools, allow_intrabc, segmentation_enabled, seg_id_pre_skip, alt_q, enable_cdef, cdef_bits,
    delta_q_present, delta_q_res, delta_lf_present, delta_lf_res, delta_lf_multi. What is missing or null is 0.
    """

    def __init__(self, data: bytes, p: dict[str, Any], tables: dict[str, Any] | None, whole: bool) -> None:
        self.p = {n: v or 0 for n, v in p.items()}
        self.s = Symbols(data, adapt=not self.get("disable_cdf_update"))
        self.tables, self.whole = tables, whole
        self.own: dict[tuple, list[int]] = {}  # a tile's distributions, copied when they are first used
        rows, cols = self.p["mi_rows"], self.p["mi_cols"]
        self.grid = Grid(rows, cols)
        x, y = self.get("subsampling_x"), self.get("subsampling_y")
        chroma = ((cols + x) >> x, (rows + y) >> y)
        self.planes = [Plane(cols, rows)] + [Plane(*chroma) for _ in range(0 if self.get("monochrome") else 2)]
        self.q_context = k.q_context(self.get("base_q_idx"))
        self.qindex, self.filter = self.get("base_q_idx"), [0] * 4
        self.blocks: list[dict[str, Any]] = []
        self.out: dict[str, Any] = {"partition_symbols": 0, "forced_splits": 0, "leaf_blocks": 0, "blocks_decoded": 0}

    def get(self, name: str) -> int:
        return self.p.get(name, 0)

    def cdf(self, name: str, *row: int) -> list[int]:
        key = (name, *row)
        if (known := self.own.get(key)) is not None:
            return known
        else:
            t = BUILT_IN.get(name) or (self.tables or {}).get(name)
            if t is None:
                raise Unsupported(f"unsupported: {'coefficient' if name in k.BLOCK_TABLES | k.COEFF_TABLES else 'mode'} distributions were not given")
            for i in row:
                t = t[i]
            self.own[key] = [*t, 0]  # and the count of uses
        return self.own[key]

    def read(self, name: str, *row: int) -> int:
        return self.s.symbol(self.cdf(name, *row))

    def coeff(self, name: str, *row: int) -> int:
        return self.read(name, self.q_context, *row)

    def run(self) -> None:
        side = 32 if self.get("use_128x128_superblock") else 16
        top = side.bit_length() - 1
        for r in range(0, self.grid.rows if self.whole else 1, side):
            for c in range(0, self.grid.cols if self.whole else 1, side):
                self.origin, self.cdef_seen, self.read_deltas = (r, c, side), set(), bool(self.get("delta_q_present"))
                try:
                    self.tree(r, c, top, top)
                except Enough:
                    return
        if self.whole:
            self.s.exit()

    def tree(self, r: int, c: int, bsl: int, top: int) -> None:
        if r >= self.grid.rows or c >= self.grid.cols:
            return
        kind = self.partition(r, c, bsl, top) if bsl else "NONE"
        if kind == "SPLIT":
            half = 1 << (bsl - 1)
            for y in (r, r + half):
                for x in (c, c + half):
                    self.tree(y, x, bsl - 1, top)
            return
        for row, col, less_w, less_h in BLOCKS[kind] if self.whole else BLOCKS[kind][:1]:
            self.out.setdefault("depth", top - bsl)
            self.block(r + (row << bsl >> 2), c + (col << bsl >> 2), bsl - less_w, bsl - less_h)

    def partition(self, r: int, c: int, bsl: int, top: int) -> str:
        half = 1 << (bsl - 1)
        has_rows, has_cols = r + half < self.grid.rows, c + half < self.grid.cols
        smaller = lambda log2: log2 is not None and log2 < bsl
        ctx = smaller(self.grid.above("wlog2", r, c)) + 2 * smaller(self.grid.left("hlog2", r, c))
        forced = not (has_rows or has_cols)
        if forced:
            kind, ctx = "SPLIT", 0
            self.out["forced_splits"] += 1
        elif has_rows and has_cols:
            kind = PARTITIONS[self.read("partition", bsl - 1, ctx)]
        elif bsl == 1:
            raise Unsupported(f"unsupported: an 8x8 block across the {'lower' if has_cols else 'right'} edge")
        else:
            once, names = ("HORZ", SPLITS_DOWN) if has_cols else ("VERT", SPLITS_ACROSS)
            cdf = self.cdf("partition", bsl - 1, ctx)
            kind = "SPLIT" if self.s.symbol(edge_cdf(cdf, names, len(cdf) - 1)) else once
        self.out["partition_symbols"] += not forced
        if bsl == top and not (r or c):
            self.out |= {"partition": kind, "partition_ctx": ctx, "forced": forced}
        return kind

    def block(self, r: int, c: int, w: int, h: int) -> None:
        self.out["leaf_blocks"] += 1
        self.grid.fill(r, c, w, h, wlog2=w, hlog2=h)
        b: dict[str, Any] = {"r": r, "c": c, "wlog2": w, "hlog2": h, "tx": []}
        self.blocks.append(b)
        self.prefix(b)
        if not b["skip"]:
            self.rest(b)
        self.out["blocks_decoded"] += 1
        if not self.whole and len(self.blocks) >= 2:
            raise Enough

    # what comes before the coefficients

    def prefix(self, b: dict[str, Any]) -> None:
        r, c, w, h = b["r"], b["c"], b["wlog2"], b["hlog2"]
        segments = self.whole and self.get("segmentation_enabled")
        if segments and self.get("seg_id_pre_skip"):
            self.segment(b, 0)
        b["skip_ctx"] = (self.grid.above("skip", r, c) or 0) + (self.grid.left("skip", r, c) or 0)
        b["skip"] = self.read("skip", b["skip_ctx"])
        self.grid.fill(r, c, w, h, skip=b["skip"])
        if segments and not self.get("seg_id_pre_skip"):
            self.segment(b, b["skip"])
        if self.whole:
            if self.get("allow_intrabc"):
                raise Unsupported("unsupported: copies of blocks within the picture")
            b["qindex"] = k.segment_q(self.get("base_q_idx"), self.p["alt_q"], b["segment_id"]) if segments else self.get("base_q_idx")
            b["lossless"] = not b["qindex"] and not any(self.get(f"delta_q_{n}") for n in ("y_dc", "u_dc", "u_ac", "v_dc", "v_ac"))
            self.per_superblock(b)
        else:
            b["qindex"], b["lossless"] = self.get("base_q_idx"), bool(self.get("coded_lossless"))
        b["y_mode_ctx"] = size_group(w, h)
        b["y_mode"] = self.read("y_mode", b["y_mode_ctx"])

    def segment(self, b: dict[str, Any], skip: int) -> None:
        corner, above, left = (f("segment", b["r"], b["c"]) for f in (self.grid.corner, self.grid.above, self.grid.left))
        if above is None or left is None:
            guess = above if above is not None else left or 0
        else:
            guess = above if corner == above else left
        value = guess
        if not skip:
            same = 0 if corner is None else (corner == above) + (corner == left) + (above == left)
            ctx = 2 if same == 3 else int(same > 0)
            count = self.get("last_active_seg_id") + 1
            value = min(7, max(0, k.neg_deinterleave(self.read("segment_id", ctx), guess, count))) if count > 1 else 0
        b["segment_id"] = value
        self.grid.fill(b["r"], b["c"], b["wlog2"], b["hlog2"], segment=value)

    def per_superblock(self, b: dict[str, Any]) -> None:
        """The index of the directional filter, once a 64x64 area, and changes of quantizer and loop filter, once a superblock."""
        r, c, side = self.origin
        if self.get("enable_cdef") and self.get("cdef_bits") and not (b["skip"] or b["lossless"]):
            area = ((b["r"] - r) >> 4, (b["c"] - c) >> 4)
            if area not in self.cdef_seen:
                self.cdef_seen.add(area)
                b["cdef"] = self.s.literal(self.get("cdef_bits"))
        if self.read_deltas and not (b["skip"] and 1 << b["wlog2"] == 1 << b["hlog2"] == side):
            change = k.delta(self.s, self.cdf("delta_q"), self.get("delta_q_res"))
            self.qindex = max(1, min(255, self.qindex + change)) if change else self.qindex
            b["current_qindex"] = self.qindex
            if self.get("delta_lf_present"):
                many = (2 if self.get("monochrome") else 4) if self.get("delta_lf_multi") else 1
                for i in range(many):
                    step = k.delta(self.s, self.cdf("delta_lf", i if self.get("delta_lf_multi") else 4), self.get("delta_lf_res"))
                    self.filter[i] = max(-63, min(63, self.filter[i] + step))
                b["filter"] = self.filter[:many]
        self.read_deltas = False

    def rest(self, b: dict[str, Any]) -> None:
        if (d := directional(b["y_mode"])) is not None:
            b["angle_delta_y"] = self.read("angle_delta", d) - 3
        if not self.get("monochrome"):
            self.chroma_mode(b)
        w, h = b["wlog2"], b["hlog2"]
        if self.get("allow_screen_content_tools") and min(w, h) >= 1 and max(w, h) <= 4:
            self.palette(b, w + h - 2)
        if self.get("enable_filter_intra") and b["y_mode"] == 0 and max(w, h) <= 3:
            b["use_filter_intra"] = self.read("filter_intra", k.block_index(w, h))
            if b["use_filter_intra"]:
                b["filter_intra_mode"] = self.read("filter_intra_mode")
        self.transform(b)
        for n, (x, y) in enumerate(self.tiling(b["c"], b["r"], w, h, *b["size"])):
            if not self.whole and n == (2 if len(self.blocks) == 1 else 1):
                break
            self.coefficients(b, 0, x, y, (w + 2, h + 2), b["size"], b["tx_type"], cut=not self.whole and len(self.blocks) == 2)
        second = not self.whole and len(self.blocks) == 2 and not b["tx"][-1]["all_zero"]
        if not (self.get("monochrome") or second):
            self.chroma(b)

    def chroma_mode(self, b: dict[str, Any]) -> None:
        w, h = b["wlog2"], b["hlog2"]
        if b["lossless"]:
            cfl = max(0, w - self.get("subsampling_x")) == 0 and max(0, h - self.get("subsampling_y")) == 0
        else:
            cfl = max(w, h) <= 3
        b["uv_mode"] = uv = self.read("uv_mode_cfl" if cfl else "uv_mode_no_cfl", b["y_mode"])
        if cfl and uv == 13:
            joint = self.read("cfl_sign", 0)
            u, v = divmod(joint + 1, 3)  # 0: none, 1: negative, 2: positive
            size = lambda sign, ctx: (self.read("cfl_alpha", ctx) + 1) * (1 if sign == 2 else -1) if sign else 0
            b |= {"cfl_signs": joint, "cfl_alpha_u": size(u, (u - 1) * 3 + v), "cfl_alpha_v": size(v, (v - 1) * 3 + u)}
        if (d := directional(uv)) is not None:
            b["angle_delta_uv"] = self.read("angle_delta", d) - 3

    def palette(self, b: dict[str, Any], size: int) -> None:
        if b["y_mode"] == 0:
            r, c = b["r"], b["c"]
            ctx = bool(self.grid.above("palette_y", r, c)) + bool(self.grid.left("palette_y", r, c))
            b["has_palette_y"] = self.read("palette_y_mode", size, ctx)
            if b["has_palette_y"]:
                b["palette_size_y"] = self.read("palette_y_size", size) + 2
                self.grid.fill(r, c, b["wlog2"], b["hlog2"], palette_y=b["palette_size_y"])
                raise Unsupported("unsupported: palette")
        if b.get("uv_mode") == 0:
            b["has_palette_uv"] = self.read("palette_uv_mode", 0)
            if b["has_palette_uv"]:
                b["palette_size_uv"] = self.read("palette_uv_size", size) + 2
                raise Unsupported("unsupported: palette")

    def transform(self, b: dict[str, Any]) -> None:
        w, h = b["wlog2"], b["hlog2"]
        tw, th = (2, 2) if b["lossless"] else k.largest_transform(w, h)
        if not b["lossless"] and self.get("tx_mode") == 2 and (w or h):
            depth = k.max_depth(w, h)
            b["tx_depth"] = self.read(f"tx_depth_{8 << (min(depth, 4) - 1)}", 0)
            for _ in range(b["tx_depth"]):
                tw, th = k.split_transform(tw, th)
        b |= {"size": (tw, th), "tx_width": 1 << tw, "tx_height": 1 << th, "tx_type": "DCT_DCT"}
        if max(tw, th) < 5 and b["qindex"] and not b["lossless"]:
            mode = k.FILTER_DIRECTIONS[b["filter_intra_mode"]] if b.get("use_filter_intra") else b["y_mode"]
            if self.get("reduced_tx_set") or min(tw, th) == 4:
                b["tx_type"] = k.TX_SET_2[self.read("intra_tx_set2", min(tw, th) - 2, mode)]
            else:
                b["tx_type"] = k.TX_SET_1[self.read("intra_tx_set1", min(tw, th) - 2, mode)]

    # coefficients

    @staticmethod
    def tiling(x: int, y: int, w: int, h: int, tw: int, th: int) -> Iterator[tuple[int, int]]:
        """Places of transform blocks, row by row, in units of four samples."""
        for down in range(0, 1 << h, 1 << (th - 2)):
            for across in range(0, 1 << w, 1 << (tw - 2)):
                yield x + across, y + down

    def chroma(self, b: dict[str, Any]) -> None:
        sx, sy = self.get("subsampling_x"), self.get("subsampling_y")
        w, h = max(0, b["wlog2"] - sx), max(0, b["hlog2"] - sy)
        if (w, h) not in k.BLOCK_SIZES:
            raise Malformed(f"no chroma block has {4 << w}x{4 << h} samples")
        size = chroma_transform(w, h)
        kind = "DCT_DCT" if b["lossless"] or max(size) > 4 else MODE_TO_TX[b["uv_mode"]]
        for plane in (1, 2):
            for x, y in self.tiling(b["c"] >> sx, b["r"] >> sy, w, h, *size):
                self.coefficients(b, plane, x, y, (w + 2, h + 2), size, kind, cut=not self.whole)
                if not self.whole:
                    break

    def skip_context(self, plane: int, x: int, y: int, block: tuple[int, int], size: tuple[int, int]) -> int:
        """The context of a transform block without coefficients."""
        p = self.planes[plane]
        levels, signs = (p.edges(of, x, y, 1 << (size[0] - 2), 1 << (size[1] - 2)) for of in (p.level, p.sign))
        if plane:
            some = any(levels[0] + signs[0]) + any(levels[1] + signs[1])
            return 7 + some + 3 * (sum(block) > sum(size))
        if block == size:
            return 0
        top, left = (max(e, default=0) for e in levels)
        if not (top and left):
            return 1 if not (top or left) else 2 + (max(top, left) > 3)
        return 4 + (top > 3) + (left > 3)

    def sign_context(self, plane: int, x: int, y: int, size: tuple[int, int]) -> int:
        p = self.planes[plane]
        above, left = p.edges(p.sign, x, y, 1 << (size[0] - 2), 1 << (size[1] - 2))
        balance = sum((s == 2) - (s == 1) for s in above + left)
        return 0 if not balance else 1 if balance < 0 else 2

    def coefficients(self, b: dict[str, Any], plane: int, x: int, y: int, block: tuple[int, int], size: tuple[int, int], kind: str, cut: bool) -> None:
        """One transform block. ``cut``: of the first blocks, only as far as is looked at."""
        ctx = self.skip_context(plane, x, y, block, size)
        t: dict[str, Any] = {"plane": plane, "x4": x, "y4": y, "skip_ctx": ctx}
        b["tx"].append(t)
        short, long = min(size), max(size)
        large = min(4, (short - 2 + long - 2 + 1) >> 1)
        t["all_zero"] = self.coeff("txb_skip", large, ctx)
        if not t["all_zero"]:
            k.block_coefficients(self.s, size, large, int(plane > 0), kind, lambda name, *row: self.cdf(name, self.q_context, *row), lambda: self.sign_context(plane, x, y, size), t, cut and ("eob" if plane else "first"))
            if "cul_level" in t:
                dc = t.get("dc", 0)
                self.planes[plane].set(x, y, 1 << (size[0] - 2), 1 << (size[1] - 2), t["cul_level"], 0 if not dc else 1 if dc < 0 else 2)


def probe(data: bytes, p: dict[str, Any], tables: dict[str, Any] | None = None, whole: bool = False) -> dict[str, Any]:
    """Status, reason, counters, the first partition, the first block's fields, and all blocks that were read."""
    out: dict[str, Any] = {}
    tile = None
    try:
        if not data:
            raise Malformed("empty tile")
        if p["mi_rows"] <= 0 or p["mi_cols"] <= 0:
            raise Malformed("tile without blocks")
        tile = Tile(data, p, tables, whole)
        tile.run()
        out |= {"status": "OK", "reason": None} if whole else {"status": "UNSUPPORTED", "reason": "unsupported: what follows the first blocks"}
    except Malformed as e:
        out |= {"status": e.severity, "reason": str(e)}
    if tile is None:
        return out
    out |= tile.out | {"blocks": tile.blocks}
    if tile.blocks:
        first = tile.blocks[0]
        out |= {n: v for n, v in first.items() if n not in ("tx", "r", "c", "size")}
        luma = next((t for t in first["tx"] if t["plane"] == 0), {})
        out |= {n: luma[n] for n in ("all_zero", "eob", "dc", "cul_level") if n in luma}
    return out
