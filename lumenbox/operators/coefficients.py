"""Transform geometry, the coefficients of a transform block, and the readers of segment ids and of quantizer and filter
changes. All distributions come as a parameter."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

from ..bitio import Malformed
from .entropy import Symbols

#: Shape of each table: the dimensions before the symbols, then the number of symbols. The last group has four sets first.
BLOCK_TABLES = {
    "palette_y_mode": ((7, 3), 2), "palette_uv_mode": ((2,), 2), "palette_y_size": ((7,), 7), "palette_uv_size": ((7,), 7), "segment_id": ((3,), 8), "filter_intra": ((22,), 2), "filter_intra_mode": ((), 5), "tx_depth_8": ((3,), 2), "tx_depth_16": ((3,), 3), "tx_depth_32": ((3,), 3), "tx_depth_64": ((3,), 3),
    "intra_tx_set1": ((2, 13), 7), "intra_tx_set2": ((3, 13), 5),
}
COEFF_TABLES = {
    "txb_skip": ((4, 5, 13), 2), "eob_pt_16": ((4, 2, 2), 5), "eob_pt_32": ((4, 2, 2), 6), "eob_pt_64": ((4, 2, 2), 7), "eob_pt_128": ((4, 2, 2), 8), "eob_pt_256": ((4, 2, 2), 9), "eob_pt_512": ((4, 2), 10), "eob_pt_1024": ((4, 2), 11),
    "eob_extra": ((4, 5, 2, 9), 2), "coeff_base_eob": ((4, 5, 2, 4), 3), "coeff_base": ((4, 5, 2, 42), 4), "coeff_br": ((4, 5, 2, 21), 4), "dc_sign": ((4, 2, 3), 2),
}

#: Transform types by symbol in the two sets of intra blocks; what is one-dimensional has a class of its own.
TX_SET_1 = ("IDTX", "DCT_DCT", "V_DCT", "H_DCT", "ADST_ADST", "ADST_DCT", "DCT_ADST")
TX_SET_2 = ("IDTX", "DCT_DCT", "ADST_ADST", "ADST_DCT", "DCT_ADST")
#: Neighbours (down, right) whose levels make a coefficient's context, by class of the transform.
BASE_NEIGHBOURS = {"2D": ((0, 1), (1, 0), (1, 1), (0, 2), (2, 0)), "HORIZ": ((0, 1), (1, 0), (0, 2), (0, 3), (0, 4)), "VERT": ((1, 0), (0, 1), (2, 0), (3, 0), (4, 0))}
BR_NEIGHBOURS = {"2D": ((0, 1), (1, 0), (1, 1)), "HORIZ": ((0, 1), (1, 0), (0, 2)), "VERT": ((0, 1), (1, 0), (2, 0))}
#: The intra mode that each filter mode stands for when a transform type is coded.
FILTER_DIRECTIONS = (0, 1, 2, 6, 0)
MAX_GOLOMB = 32


def check(tables: dict[str, Any]) -> dict[str, Any]:
    """The tables, if each has its shape and each row rises to 32768."""

    def sound(x: Any, dims: tuple[int, ...], symbols: int) -> bool:
        if dims:
            return len(x) == dims[0] and all(sound(y, dims[1:], symbols) for y in x)
        return len(x) == symbols and x[-1] == 32768 and sorted(x) == x

    for name, (dims, symbols) in (BLOCK_TABLES | COEFF_TABLES).items():
        if name not in tables or not sound(tables[name], dims, symbols):
            raise ValueError(f"{name}: {dims} rows of {symbols} rising values up to 32768 are needed")
    return tables


def q_context(base_q_idx: int) -> int:
    return sum(base_q_idx > q for q in (20, 60, 120))


def segment_q(base_q_idx: int, alt_q: list[dict[str, Any]], segment: int) -> int:
    a = alt_q[segment]
    return max(0, min(255, base_q_idx + (a["value"] if a["enabled"] else 0)))


def neg_deinterleave(diff: int, ref: int, count: int) -> int:
    """A segment id coded as its distance from a prediction, nearest first; the inverse of interleaving."""
    if not ref:
        return diff
    if ref >= count - 1:
        return count - 1 - diff
    near = min(ref, count - 1 - ref)
    if diff <= 2 * near:
        return ref + (diff + 1) // 2 if diff & 1 else ref - diff // 2
    return diff if ref < count - 1 - ref else count - 1 - diff


def delta(s: Symbols, cdf: list[int], scale: int) -> int:
    """A change of the quantizer or a filter level: small ones by symbol, others with the number of their bits."""
    size = s.symbol(cdf)
    if size == 3:
        bits = s.literal(3) + 1
        size = s.literal(bits) + (1 << bits) + 1
    return (-size if size and s.literal(1) else size) << scale


#: Block sizes in the order of the AV1 specification. Fixed values.
BLOCK_SIZES = ((0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (3, 2), (3, 3), (3, 4), (4, 3), (4, 4), (4, 5), (5, 4), (5, 5), (0, 2), (2, 0), (1, 3), (3, 1), (2, 4), (4, 2))


def block_index(w: int, h: int) -> int:
    """Place of a block among the 22 sizes, from log2 of its sides in units of four samples."""
    return BLOCK_SIZES.index((w, h))


def largest_transform(w: int, h: int) -> tuple[int, int]:
    """Log2 of the sides of a block's largest transform, in samples: up to 64."""
    return min(w + 2, 6), min(h + 2, 6)


def split_transform(w: int, h: int) -> tuple[int, int]:
    """A transform one step down: a square is quartered, the longer side of others halved."""
    return (w - 1, h - 1) if w == h else (w, h - 1) if h > w else (w - 1, h)


def max_depth(w: int, h: int) -> int:
    """How many steps down a transform of a block may go in all."""
    n, size = 0, largest_transform(w, h)
    while size != (2, 2):
        size, n = split_transform(*size), n + 1
    return n


def scan(w: int, h: int, kind: str) -> list[int]:
    """Positions in the order of coding: rows, columns, or diagonals that turn back and forth."""
    cols, rows = 1 << w, 1 << h
    if kind == "HORIZ":
        return list(range(rows * cols))
    if kind == "VERT":
        return [r * cols + c for c in range(cols) for r in range(rows)]
    out = []
    for d in range(rows + cols - 1):
        cells = [(r, d - r) for r in range(max(0, d - cols + 1), min(rows, d + 1))]
        out += [r * cols + c for r, c in (cells if d % 2 else cells[::-1])]
    return out


_scan = lru_cache(maxsize=256)(scan)  # by size and kind there are fewer


def base_offset(row: int, col: int, w: int, h: int) -> int:
    """What the place of a coefficient adds to its context: by diagonal, and by rows or columns first if it isn't square.
    This stands for the specification's table of offsets by transform size, row and column."""
    row, col = min(row, 4), min(col, 4)
    if not row + col:
        return 0
    if h > w and row < 2:
        return 11
    if w > h and col < 2:
        return 16
    return (1 if row + col < 2 else 6 if row + col < 4 else 21) if w == h else 6 if row + col < 4 else 21


def block_coefficients(s: Symbols, size: tuple[int, int], large: int, plane_type: int, kind: str, get: Callable[..., list[int]], sign_context: Callable[[], int], out: dict[str, Any], cut: str | bool = False) -> None:
    """The coefficients of a transform block that has some. ``size``: log2 of its sides in samples; ``large``: its class of
    size; get(name, *row): distribution. ``cut``: "eob" ends after the last coefficient's base level, "first" after the
    level of the first one."""
    w, h = size
    cw, ch = min(w, 5), min(h, 5)
    cls = "VERT" if kind.startswith("V_") else "HORIZ" if kind.startswith("H_") else "2D"
    many = 16 << (cw + ch - 4)
    row = (plane_type,) if many >= 512 else (plane_type, 0 if cls == "2D" else 1)
    point = s.symbol(get(f"eob_pt_{many}", *row)) + 1
    eob = point if point < 2 else (1 << (point - 2)) + 1
    if point >= 3:
        shift = point - 3
        if s.symbol(get("eob_extra", large, plane_type, shift)):
            eob += 1 << shift
        for i in range(shift - 1, -1, -1):
            eob += s.literal(1) << i
    out["eob"] = eob
    order, cols, rows = _scan(cw, ch, cls), 1 << cw, 1 << ch
    level = [0] * (cols * rows)

    def around(r: int, c: int, cells: tuple, most: int) -> int:
        return sum(min(level[(r + a) * cols + c + b], most) for a, b in cells if r + a < rows and c + b < cols)

    for i in range(eob - 1, -1, -1):
        at = order[i]
        r, c = divmod(at, cols)
        if i == eob - 1:
            ctx = 0 if not i else 1 if i <= cols * rows // 8 else 2 if i <= cols * rows // 4 else 3
            x = s.symbol(get("coeff_base_eob", large, plane_type, ctx)) + 1
            if cut == "eob" or (cut == "first" and not i):
                out["base_level"] = x
                return
        else:
            ctx = min((around(r, c, BASE_NEIGHBOURS[cls], 3) + 1) >> 1, 4)
            if cls == "2D":
                ctx = 0 if not at else ctx + base_offset(r, c, w, h)
            else:
                ctx += 26 + 5 * min(r if cls == "VERT" else c, 2)
            x = s.symbol(get("coeff_base", large, plane_type, ctx))
        if x > 2:
            ctx = min((around(r, c, BR_NEIGHBOURS[cls], 15) + 1) >> 1, 6)
            close = (r < 2 and c < 2) if cls == "2D" else not (c if cls == "HORIZ" else r)
            ctx += 0 if not at else 7 if close else 14
            for _ in range(4):
                more = s.symbol(get("coeff_br", min(large, 3), plane_type, ctx))
                x += more
                if more < 3:
                    break
        level[at] = x
    if cut == "first":
        out["base_level"] = level[order[0]]
        return
    total = 0
    for i in range(eob):
        at = order[i]
        if level[at]:
            negative = s.symbol(get("dc_sign", plane_type, sign_context())) if not i else s.literal(1)
            if level[at] > 14:
                zeros = 0
                while not s.literal(1):
                    zeros += 1
                    if zeros >= MAX_GOLOMB:
                        raise Malformed("Exp-Golomb length too long")
                level[at] += (1 << zeros | s.literal(zeros)) - 1
            total += level[at]
            if not at:
                out["dc"] = -level[0] if negative else level[0]
    out["cul_level"] = min(63, total)
