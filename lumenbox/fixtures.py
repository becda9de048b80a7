"""Writers that turn table rows into containers and streams, so that the parsers have input. They share no code with them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from . import batches
from .operators.coefficients import BLOCK_TABLES, COEFF_TABLES
from .operators.syntax import DELTA_CDF as DELTA
from .operators.syntax import MODE_TABLES, PARTITION_CDFS
from .operators.syntax import SKIP_CDFS as SKIP

#: The distributions of the specification that the engine has built in.
PARTITION_32, PARTITION_64 = PARTITION_CDFS[2], PARTITION_CDFS[3]

class BitWriter:
    def __init__(self) -> None:
        self.bits: list[str] = []

    def f(self, value: int, n: int) -> BitWriter:
        if n:
            self.bits.append(format(value & ((1 << n) - 1), f"0{n}b"))
        return self

    def uvlc(self, value: int) -> BitWriter:
        n = (value + 1).bit_length()
        return self.f(0, n - 1).f(value + 1, n)

    def ns(self, value: int, n: int) -> BitWriter:
        w = n.bit_length()
        m = (1 << w) - n
        return self.f(value, w - 1) if value < m else self.f(value + m, w)

    def bytes(self) -> bytes:
        s = "".join(self.bits)
        s += "0" * (-len(s) % 8)
        return int(s or "0", 2).to_bytes(len(s) // 8, "big")

    def trailing(self) -> bytes:
        self.f(1, 1)
        return self.bytes()


def u(value: int, n: int) -> bytes:
    return value.to_bytes(n, "big")


def leb128(value: int) -> bytes:
    out = bytearray()
    while True:
        value, low = value >> 7, value & 127
        out.append(low | (128 if value else 0))
        if not value:
            return bytes(out)


def box(kind: bytes, *parts: bytes, large: bool = False) -> bytes:
    body = b"".join(parts)
    return u(1, 4) + kind + u(16 + len(body), 8) + body if large else u(8 + len(body), 4) + kind + body


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, u(version, 1), u(flags, 3), *parts)


@lru_cache(maxsize=1 << 16)
def ispe(width: int, height: int) -> bytes:
    return full(b"ispe", 0, 0, u(width, 4), u(height, 4))


def pixi(*depths: int) -> bytes:
    return full(b"pixi", 0, 0, u(len(depths), 1), bytes(depths))


def av1c(profile: int = 0, high: int = 0, twelve: int = 0, mono: int = 0, sx: int = 1, sy: int = 1, level: int = 0, tier: int = 0, csp: int = 0) -> bytes:
    return box(b"av1C", bytes([0x81, profile << 5 | level, tier << 7 | high << 6 | twelve << 5 | mono << 4 | sx << 3 | sy << 2 | csp, 0]))


@lru_cache(maxsize=1 << 16)
def infe(item_id: int, kind: bytes = b"av01", version: int = 2) -> bytes:
    return full(b"infe", version, 0, u(item_id, 4 if version == 3 else 2), u(0, 2), *([kind, b"\0"] if version >= 2 else [b"\0"]))


def iinf(*entries: bytes) -> bytes:
    return full(b"iinf", 0, 0, u(len(entries), 2), *entries)


def iloc(items: list[dict[str, Any]], version: int = 1, index_size: int = 0) -> bytes:
    """Items of (id, method, dref, base, extents [(offset, length)])."""
    wide = 4 if version == 2 else 2
    out = [u(0x44, 1), u(0x40 | index_size, 1), u(len(items), wide)]
    for i in items:
        out.append(u(i["id"], wide))
        if version:
            out.append(u(i.get("method", 0), 2))
        out += [u(i.get("dref", 0), 2), u(i.get("base", 0), 4), u(len(i["extents"]), 2)]
        for offset, length in i["extents"]:
            out += [u(0, index_size), u(offset, 4), u(length, 4)]
    return full(b"iloc", version, 0, *out)


def ipma(entries: list[tuple[int, list[tuple[int, bool]]]], wide: bool = False) -> bytes:
    out = [u(len(entries), 4)]
    for item, assocs in entries:
        out += [u(item, 2), u(len(assocs), 1), *(u(p | essential << (15 if wide else 7), 2 if wide else 1) for p, essential in assocs)]
    return full(b"ipma", 0, int(wide), *out)


@lru_cache(maxsize=1 << 16)
def hdlr() -> bytes:
    return full(b"hdlr", 0, 0, u(0, 4), b"pict", bytes(13))


@lru_cache(maxsize=1 << 16)
def pitm(item_id: int) -> bytes:
    return full(b"pitm", 0, 0, u(item_id, 2))


FTYP = box(b"ftyp", b"avif", u(0, 4), b"avifmif1")


def still(payload: bytes, width: int = 64, height: int = 64, pieces: int = 1, idat: bool = False, props: list[bytes] | None = None, **how: Any) -> bytes:
    """A container whose primary item is ``payload`` in so many extents. how: kind, method, dref, index_size, pitm
    (id or None), extents, no_iloc, no_idat, no_meta, iloc_version."""
    props = props if props is not None else [ispe(width, height), pixi(8, 8, 8), av1c()]
    step = max(1, -(-len(payload) // pieces))
    cuts = [(a, min(step, len(payload) - a)) for a in range(0, max(1, len(payload)), step)]
    cuts = how.get("extents", cuts)
    method = how.get("method", 1 if idat else 0)

    def made(base: int) -> bytes:
        item = {"id": 1, "method": method, "dref": how.get("dref", 0), "base": base, "extents": cuts}
        parts = [hdlr()]
        if (primary := how.get("pitm", 1)) is not None:
            parts.append(pitm(primary))
        parts += [iinf(infe(1, how.get("kind", b"av01"))), *([] if how.get("no_iloc") else [iloc([item], how.get("iloc_version", 1), how.get("index_size", 0))])]
        parts.append(box(b"iprp", box(b"ipco", *props), ipma([(1, [(i + 1, i == len(props) - 1) for i in range(len(props))])])))
        if idat and not how.get("no_idat"):
            parts.append(box(b"idat", payload))
        return full(b"meta", 0, 0, *parts)

    if how.get("no_meta"):
        return FTYP + box(b"mdat", payload)
    if idat:
        return FTYP + made(0)
    base = len(FTYP) + len(made(0)) + 8
    return FTYP + made(base) + box(b"mdat", payload)


def obu(kind: int, payload: bytes) -> bytes:
    return bytes([kind << 3 | 2]) + leb128(len(payload)) + payload


def sequence(width: int = 64, height: int = 64, profile: int = 0, reduced: bool = True, high: int = 0, twelve: int = 0, mono: int = 0, sx: int = 1, sy: int = 1, use_128: int = 0, superres: int = 0, bits: int = 16, screen: int = 0, grain: int = 0, separate: int = 0, cdef: int = 0) -> bytes:
    """The payload of a sequence header."""
    b = BitWriter().f(profile, 3).f(1, 1).f(int(reduced), 1)
    if reduced:
        b.f(0, 5)
    else:
        b.f(0, 1).f(0, 1).f(0, 5).f(0, 12).f(4, 5)
    b.f(bits - 1, 4).f(bits - 1, 4).f(width - 1, bits).f(height - 1, bits)
    if not reduced:
        b.f(0, 1)
    b.f(use_128, 1).f(0, 2)
    if not reduced:
        b.f(0, 4).f(0, 1)  # inter tools, no order hint
        b.f(0, 1).f(screen, 1)  # screen content tools are forced to ``screen``
        if screen:
            b.f(1, 1)
    b.f(superres, 1).f(cdef, 1).f(0, 1)
    b.f(high, 1)
    if profile == 2 and high:
        b.f(twelve, 1)
    if profile != 1:
        b.f(mono, 1)
    b.f(0, 1)
    if mono:
        b.f(0, 1)
    else:
        b.f(0, 1)
        if profile == 2 and high and twelve:
            b.f(sx, 1)
            if sx:
                b.f(sy, 1)
        else:
            sx, sy = ((1, 1), (0, 0), (1, 0))[profile]
        if sx and sy:
            b.f(0, 2)
        b.f(separate, 1)
    return b.f(grain, 1).trailing()


def frame(reduced: bool = True, override: tuple[int, int] | None = None, denom: int | None = None, superres: bool = False, render: tuple[int, int] | None = None, tile_bits: tuple[tuple[int, int], ...] = ((1, 1),), bits: int = 16, tail: bool = False, mono: bool = False) -> BitWriter:
    """A key frame's header up to tile_info(), whose bits are given; ``tail``: the rest as well, quantizer 100."""
    b = BitWriter()
    if not reduced:
        b.f(0, 1).f(0, 2).f(1, 1)
    b.f(1, 1)  # disable_cdf_update
    if reduced:
        b.f(0, 1)  # no screen content tools
    else:
        b.f(int(override is not None), 1)
    if override:
        b.f(override[0] - 1, bits).f(override[1] - 1, bits)
    if superres:
        b.f(int(denom is not None), 1)
        if denom is not None:
            b.f(denom - 9, 3)
    b.f(int(render is not None), 1)
    if render:
        b.f(render[0] - 1, 16).f(render[1] - 1, 16)
    for value, n in tile_bits:
        b.f(value, n)
    if tail:
        b.f(100, 8).f(0, 1).f(0, 0 if mono else 2).f(0, 1)  # base_q_idx, no deltas, no qmatrix
        b.f(0, 1).f(0, 1)  # no segmentation, no delta q
        b.f(0, 12).f(0, 3).f(0, 1)  # loop filter off
        b.f(1, 1).f(0, 1)  # tx_mode_select, reduced_tx_set
    return b


def tile_group(tiles: list[bytes], size_bytes: int = 1, subset: tuple[int, int, int] | None = None, many: bool = True) -> bytes:
    """``subset``: first tile, last tile, bits of a tile's number."""
    b = BitWriter()
    if many:
        b.f(int(subset is not None), 1)
        if subset:
            b.f(subset[0], subset[2]).f(subset[1], subset[2])
    out = [b.bytes()] if many else []
    for t in tiles[:-1]:
        out += (len(t) - 1).to_bytes(size_bytes, "little"), t
    return b"".join([*out, *tiles[-1:]])


def grid_stream(tiles: list[bytes]) -> bytes:
    """A 128x128 picture of two by two tiles of 64x64 superblocks: sequence header, frame header, one tile group."""
    # tile_info: uniform spacing, one more column, one more row, context 0, one byte a size
    head = frame(tile_bits=((1, 1), (1, 1), (1, 1), (0, 2), (0, 2)))
    return obu(1, sequence(128, 128)) + obu(3, head.bytes()) + obu(4, tile_group(tiles))


def columns(n: int) -> int:
    """Columns of the squarest whole grid of ``n`` tiles that is not higher than wide."""
    return next(c for c in range(1, n + 1) if n % c == 0 and c * c >= n)


def layout_stream(tiles: list[bytes], size_bytes: int = 1) -> bytes:
    """A picture of as many 64x64 tiles as given, in a whole grid of ``columns()``; without tiles no tile group."""
    return _layout_head(len(tiles), size_bytes) + (obu(4, tile_group(tiles, size_bytes, many=len(tiles) > 1)) if tiles else b"")


@lru_cache(maxsize=4096)
def _layout_head(n: int, size_bytes: int) -> bytes:
    cols = columns(n) if n else 1
    rows = n // cols if n else 1
    if cols > 64:
        raise ValueError(f"no grid of up to 64 columns holds {n} tiles")
    log = (cols - 1).bit_length() + (rows - 1).bit_length()
    # tile_info: uniform spacing, as many columns and rows as superblocks, context 0, so many bytes a size
    head = frame(tile_bits=((1, 1), *[(1, 1)] * log, *([(0, log), (size_bytes - 1, 2)] if log else [])))
    return obu(1, sequence(64 * cols, 64 * rows)) + obu(3, head.bytes())


def uneven_stream(widths: list[int]) -> bytes:
    """A picture of one row of tiles that are as many 64x64 superblocks wide as given, of one byte each."""
    total = sum(widths)
    b = frame(tile_bits=((0, 1),))
    left = total
    for w in widths:
        b.ns(w - 1, min(left, 64))
        left -= w
    b.ns(0, 1)
    log = (len(widths) - 1).bit_length()
    if log:
        b.f(0, log).f(0, 2)
    return obu(1, sequence(64 * total, 64)) + obu(3, b.bytes()) + obu(4, tile_group([bytes([i + 1]) for i in range(len(widths))], many=len(widths) > 1))


def tail_stream(q: int, deltas: tuple[int, int, int, int, int], alt_q: dict[int, int], preskip: bool, delta_q: int | None, delta_lf: tuple[int, int] | None, tx_select: bool, reduced_tx: bool, grain: tuple[int, int, int] | None) -> bytes:
    """A 64x64 picture whose header has, after tile_info(): quantizer, its five deltas (apart for v), a change of the quantizer
    for some segments, resolutions of delta q and delta lf, and film grain as (points of luma, chroma from luma, lag)."""
    b = frame()
    b.f(q, 8)
    for i, d in enumerate(deltas):
        if i == 1:
            b.f(1, 1)  # v has deltas of its own
        b.f(int(d != 0), 1)
        if d:
            b.f(d, 7)
    b.f(0, 1).f(int(bool(alt_q)), 1)
    for i in range(8) if alt_q else ():
        b.f(int(i in alt_q), 1)
        if i in alt_q:
            b.f(alt_q[i], 9)
        b.f(0, 4).f(int(preskip), 1)
        if preskip:
            b.f(0, 3)  # a reference frame
        b.f(0, 2)
    if q:
        b.f(int(delta_q is not None), 1)
        if delta_q is not None:
            b.f(delta_q, 2).f(int(delta_lf is not None), 1)
            if delta_lf is not None:
                b.f(delta_lf[0], 2).f(delta_lf[1], 1)
    flat = not any(deltas)
    if not (flat and all(min(255, max(0, q + alt_q.get(i, 0))) == 0 for i in range(8))):
        b.f(9, 6).f(0, 6).f(0, 12).f(0, 3).f(1, 1).f(0, 1)  # loop filter levels, sharpness, deltas not updated
        b.f(int(tx_select), 1)
    b.f(int(reduced_tx), 1)
    b.f(int(grain is not None), 1)
    if grain is not None:
        points, from_luma, lag = grain
        b.f(77, 16).f(points, 4)
        for i in range(points):
            b.f(i, 8).f(i, 8)
        b.f(from_luma, 1)
        if points and not from_luma:
            b.f(0, 4).f(0, 4)
        b.f(0, 2).f(lag, 2)
        n = 2 * lag * (lag + 1)
        for count in (n if points else 0, *(n + bool(points) if from_luma else 0 for _ in range(2))):
            for _ in range(count):
                b.f(128, 8)
        b.f(0, 4).f(0, 2)
    return obu(1, sequence(64, 64, grain=1, separate=1)) + obu(6, b.bytes() + b"\x80")


class SymbolWriter:
    """The arithmetic coder of AV1 symbols, on whole numbers: what a decoder takes off its value is summed up, and the bits
    follow when all is known."""

    def __init__(self) -> None:
        self.off, self.range, self.shifted = 0, 1 << 15, 0

    def symbol(self, value: int, cdf: Sequence[int]) -> SymbolWriter:
        n = len(cdf)
        step = lambda i: ((self.range >> 8) * ((32768 - cdf[i]) >> 6) >> 1) + 4 * (n - i - 1)
        high = step(value - 1) if value else self.range
        low = step(value)
        bits = 16 - (high - low).bit_length()
        self.off, self.range, self.shifted = (self.off + low) << bits, (high - low) << bits, self.shifted + bits
        return self

    def literal(self, value: int, n: int) -> SymbolWriter:
        for i in range(n - 1, -1, -1):
            self.symbol(value >> i & 1, (16384, 32768))
        return self

    def bytes(self) -> bytes:
        """The symbols, a one, and zeros to the end of the byte."""
        most = (1 << (15 + self.shifted)) - 1 - self.off
        word = most - (most - (1 << 14)) % (1 << 15)  # ends in a one and 14 zeros, and is within the range
        size = (self.shifted + 8) // 8
        total = word << 8 * size >> 15 + self.shifted if 15 + self.shifted < 8 * size else word >> (15 + self.shifted - 8 * size)
        return total.to_bytes(size, "big")


def distribution(name: str, row: tuple[int, ...], symbols: int) -> list[int]:
    """Cumulative values by a rule, other ones for each context: no symbol is rare, no two rows are alike."""
    weights = [1 + zlib.crc32(f"{name}{row}{i}".encode()) % 9 for i in range(symbols)]
    total = sum(weights)
    return [32768 * sum(weights[: i + 1]) // total for i in range(symbols)]


@lru_cache(maxsize=1)
def distributions() -> dict[str, Any]:
    """A full set of tables for the tile syntax, by that rule."""

    def nest(name: str, dims: tuple[int, ...], symbols: int, row: tuple[int, ...] = ()) -> list:
        return [nest(name, dims[1:], symbols, (*row, i)) for i in range(dims[0])] if dims else distribution(name, row, symbols)

    shapes = {k: ((rows,), n) for k, (rows, n) in MODE_TABLES.items()} | BLOCK_TABLES | COEFF_TABLES
    return {name: nest(name, dims, n) for name, (dims, n) in shapes.items()}


def quarters_tile(blocks: list[dict[str, int]]) -> bytes:
    """A tile of 64x64 luma samples as four blocks of 32x32, one transform each, in the order of coding. A block has skip,
    y_mode, angle (-3 to 3) and dc (0: no coefficient), and quantizer class q. Distributions are those of distributions()."""
    w, t = SymbolWriter(), distributions()
    w.symbol(3, PARTITION_64[0])
    skipped: dict[tuple[int, int], int] = {}
    sign: dict[tuple[str, int], int] = {}
    for i, b in enumerate(blocks):
        r, c = divmod(i, 2)
        w.symbol(0, PARTITION_32[0])
        w.symbol(b["skip"], SKIP[skipped.get((r - 1, c), 0) + skipped.get((r, c - 1), 0)])
        skipped[r, c] = b["skip"]
        w.symbol(b["y_mode"], t["y_mode"][3])
        if b["skip"]:
            continue
        if 1 <= b["y_mode"] <= 8:
            w.symbol(b["angle"] + 3, t["angle_delta"][b["y_mode"] - 1])
        w.symbol(0, t["tx_depth_32"][0])
        q, size = b["q"], abs(b["dc"])
        w.symbol(int(size == 0), t["txb_skip"][q][3][0])
        if size:
            w.symbol(0, t["eob_pt_1024"][q][0])
            w.symbol(min(size, 3) - 1, t["coeff_base_eob"][q][3][0][0])
            left = min(size, 15) - 3
            while left >= 0 and size > 2:
                w.symbol(min(left, 3), t["coeff_br"][q][3][0][0])
                left -= 3
                if left < 0 or min(size, 15) - 3 - left > 11:
                    break
            balance = sign.get(("above", c), 0) + sign.get(("left", r), 0)
            w.symbol(int(b["dc"] < 0), t["dc_sign"][q][0][0 if not balance else 1 if balance < 0 else 2])
            if size > 14:
                n = (size - 14).bit_length()
                w.literal(1, n)
                w.literal(size - 14 - (1 << n - 1), n - 1)
            sign["above", c] = sign["left", r] = -1 if b["dc"] < 0 else 1
    return w.bytes()


#: How a 32x32 area may be divided: its symbol and the blocks' row, column, width and height in units of four samples.
DIVISIONS = (
    (0, ((0, 0, 8, 8),)), (1, ((0, 0, 8, 4), (4, 0, 8, 4))), (2, ((0, 0, 4, 8), (0, 4, 4, 8))), (4, ((0, 0, 4, 4), (0, 4, 4, 4), (4, 0, 8, 4))), (5, ((0, 0, 8, 4), (4, 0, 4, 4), (4, 4, 4, 4))),
    (6, ((0, 0, 4, 4), (4, 0, 4, 4), (0, 4, 4, 8))), (7, ((0, 0, 4, 8), (0, 4, 4, 4), (4, 4, 4, 4))), (8, tuple((i, 0, 8, 2) for i in (0, 2, 4, 6))), (9, tuple((0, i, 2, 8) for i in (0, 2, 4, 6))),
)


def divided_tile(kinds: list[int], first_mode: int, first_only: bool = False) -> bytes:
    """A tile of 64x64 samples whose quarters are divided as DIVISIONS says; all blocks are skipped, with modes that count up.
    ``first_only``: of each quarter only the first block is written, as a look at the first blocks takes it."""
    w, t = SymbolWriter(), distributions()
    w.symbol(3, PARTITION_64[0])
    at: dict[tuple[int, int], tuple[int, int]] = {}  # sides of the block that holds a unit
    mode = first_mode
    for i, kind in enumerate(kinds):
        r, c = 8 * (i // 2), 8 * (i % 2)
        none = lambda outside: (8, 8) if outside else (0, 0)  # noqa: E731  a unit that was left out counts as small
        ctx = int(at.get((r - 1, c), none(r == 0))[0] < 8) + 2 * int(at.get((r, c - 1), none(c == 0))[1] < 8)
        symbol, blocks = DIVISIONS[kind]
        w.symbol(symbol, PARTITION_32[ctx])
        for y, x, wide, high in blocks[:1] if first_only else blocks:
            top, left = (r + y - 1, c + x) in at, (r + y, c + x - 1) in at
            w.symbol(1, SKIP[top + left])
            w.symbol(mode % 13, t["y_mode"][{2: 1, 4: 2, 8: 3}[min(wide, high)]])
            mode += 1
            at |= {(r + y + a, c + x + b): (wide, high) for a in range(high) for b in range(wide)}
    return w.bytes()


def _change(w: SymbolWriter, value: int) -> None:
    size = abs(value)
    w.symbol(min(size, 3), DELTA)
    if size >= 3:
        n = (size - 1).bit_length() - 1
        w.literal(n - 1, 3).literal(size - 1 - (1 << n), n)
    if size:
        w.literal(int(value < 0), 1)


def _single(w: SymbolWriter, t: dict[str, Any], points: str, row: tuple[int, ...], q: int, large: int, plane: int, level: int, balance: int) -> None:
    """A block of one coefficient, of at most 2 and of either sign."""
    cdf = t[points][q]
    for i in row:
        cdf = cdf[i]
    w.symbol(0, cdf).symbol(abs(level) - 1, t["coeff_base_eob"][q][large][plane][0]).symbol(int(level < 0), t["dc_sign"][q][plane][0 if not balance else 1 if balance < 0 else 2])


def colour_tile(blocks: list[dict[str, int]], q_change: int, filter_change: int) -> bytes:
    """Four blocks of 32x32 with chroma of half its sides, segments of eight, an index of the directional filter, and changes of
    quantizer and loop filter before the first block. A block has skip, segment, cdef, y_mode, uv_mode, signs, alpha, y and u
    (levels of -2 to 2); a skipped one takes the segment that is predicted."""
    w, t = SymbolWriter(), distributions()
    w.symbol(3, PARTITION_64[0])
    skip: dict[tuple[int, int], int] = {}
    segment: dict[tuple[int, int], int] = {}
    edge: dict[tuple[str, int], int] = {}
    filtered = False
    for i, b in enumerate(blocks):
        r, c = divmod(i, 2)
        w.symbol(0, PARTITION_32[0]).symbol(b["skip"], SKIP[skip.get((r - 1, c), 0) + skip.get((r, c - 1), 0)])
        skip[r, c] = b["skip"]
        above, left, corner = segment.get((r - 1, c)), segment.get((r, c - 1)), segment.get((r - 1, c - 1))
        guess = 0 if above is None and left is None else above if left is None or (above is not None and corner == above) else left
        segment[r, c] = guess
        if not b["skip"]:
            context = 0 if corner is None else 2 if corner == above == left else int(corner in (above, left) or above == left)
            order = sorted(range(8), key=lambda s: (abs(s - guess), s < guess)) if 0 < guess < 7 else [*range(8)] if not guess else [*range(7, -1, -1)]
            w.symbol(order.index(b["segment"]), t["segment_id"][context])
            segment[r, c] = b["segment"]
            if not filtered:
                w.literal(b["cdef"], 2)
                filtered = True
        if not i:
            _change(w, q_change)
            _change(w, filter_change)
        w.symbol(b["y_mode"], t["y_mode"][3])
        if b["skip"]:
            continue
        if 1 <= b["y_mode"] <= 8:
            w.symbol(3, t["angle_delta"][b["y_mode"] - 1])
        w.symbol(b["uv_mode"], t["uv_mode_cfl"][b["y_mode"]])
        if b["uv_mode"] == 13:
            w.symbol(b["signs"], t["cfl_sign"][0])
            for sign, row in ((lambda u, v: ((u, 3 * (u - 1) + v), (v, 3 * (v - 1) + u)))(*divmod(b["signs"] + 1, 3))):
                if sign:
                    w.symbol(b["alpha"], t["cfl_alpha"][row])
        if 1 <= b["uv_mode"] <= 8:
            w.symbol(3, t["angle_delta"][b["uv_mode"] - 1])
        w.symbol(0, t["tx_depth_32"][0])
        for name, level, points, row, large, plane in (("y", b["y"], "eob_pt_1024", (0,), 3, 0), ("u", b["u"], "eob_pt_256", (1, 0), 2, 1), ("v", 0, "", (), 2, 1)):
            known = edge.get((f"{name} above", c), 0), edge.get((f"{name} left", r), 0)
            w.symbol(int(level == 0), t["txb_skip"][2][large][7 + sum(map(bool, known)) if plane else 0])
            if level:
                _single(w, t, points, row, 2, large, plane, level, sum(known))
                edge[f"{name} above", c] = edge[f"{name} left", r] = 1 if level > 0 else -1
    return w.bytes()


def colour_stream(tile: bytes) -> bytes:
    """A 64x64 picture of one tile whose eight segments raise the quantizer of 100 by two each, with all that colour_tile writes."""
    b = frame()
    b.f(100, 8).f(0, 3).f(0, 1).f(1, 1)  # no deltas, no qmatrix, segments
    for i in range(8):
        b.f(1, 1).f(2 * i, 9).f(0, 7)
    b.f(1, 1).f(1, 2).f(1, 1).f(0, 2).f(0, 1)  # changes of the quantizer in steps of two, of one filter level in steps of one
    b.f(0, 12).f(0, 4).f(0, 2).f(2, 2).f(0, 48)  # loop filter off, four strengths of the directional filter
    b.f(1, 1).f(0, 1)
    return obu(1, sequence(64, 64, cdef=1)) + obu(6, b.bytes() + tile)


def syntax_stream(tile: bytes) -> bytes:
    """A 64x64 picture without chroma of one tile, quantizer 100, transform sizes selected by block."""
    head = frame(tail=True, mono=True)
    return obu(1, sequence(64, 64, mono=1)) + obu(6, head.bytes() + tile)


def build(rows: DataFrame, make: Callable[..., bytes], key: str, name: str = "content") -> DataFrame:
    """(path, content): the key column as text and what ``make`` writes from the row's other columns."""
    names = rows.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = {n: batch[n].to_pylist() for n in names}
        out = [make(**dict(zip(names, row, strict=True))) for row in zip(*cols.values(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([str(k) for k in cols[key]], pa.string()), pa.array(out, pa.binary())], ["path", name])

    batches.small(rows.sparkSession)
    return rows.mapInArrow(batches.sliced(run), f"path string, {name} binary")
