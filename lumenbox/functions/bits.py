"""Fixed-offset fields of binary columns, as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.streams import OBU_NAMES

#: Names of transform sizes in the order of the AV1 specification.
TX_SIZES = tuple(f"TX_{s}" for s in "4X4 8X8 16X16 32X32 64X64 4X8 8X4 8X16 16X8 16X32 32X16 32X64 64X32 4X16 16X4 8X32 32X8 16X64 64X16".split())


def be_n(b: Column, at: int | Column, n: int) -> Column:
    """Big-endian unsigned integer of n bytes from byte ``at`` (0 first); decimal(20,0) for eight bytes."""
    if not 0 <= n <= 8:
        raise ValueError("0 to 8 bytes")
    if n == 0:
        return F.lit(0).cast("long")
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(b, at + 1, F.lit(n))), 16, 10).cast("decimal(20,0)" if n == 8 else "long")


def le_n(b: Column, at: int, n: int) -> Column:
    parts = [be_n(b, at + i, 1) * (1 << 8 * i) for i in range(n)]
    return reduce(lambda x, y: x + y, parts)


def bit_field(b: Column, bit: int, n: int) -> Column:
    """n bits, n up to 32, most significant first, from bit ``bit``."""
    first, last = bit // 8, (bit + n + 7) // 8
    return F.shiftrightunsigned(be_n(b, first, last - first), 8 * last - bit - n).bitwiseAND(F.lit((1 << n) - 1))


def su(value: Column, n: int) -> Column:
    """An n-bit field as a signed number."""
    return F.when(value >= (1 << (n - 1)), value - (1 << n)).otherwise(value)


def _byte_list(b: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long"))


def leb128(b: Column) -> Column:
    """The number that starts the bytes, as far as a long goes; null where it is cut off."""
    parts = F.slice(_byte_list(b), 1, 9)
    step = F.aggregate(
        parts, F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("s"), F.lit(False).alias("done")),
        lambda a, x: F.when(a["done"], a).otherwise(F.struct((a["v"] + x.bitwiseAND(F.lit(127)) * F.pow(F.lit(2.0), a["s"]).cast("long")).alias("v"), (a["s"] + 7).alias("s"), (x < 128).alias("done"))),
        lambda a: F.when(a["done"], a["v"]),
    )
    return F.when(F.length(b) > 0, step)


def _bit_string(b: Column) -> Column:
    return F.array_join(F.transform(_byte_list(b), lambda x: F.lpad(F.bin(x), 8, "0")), "")


def uvlc(b: Column) -> Column:
    """Leading zeros, a one, and as many more bits; null beyond 31 zeros or where it is cut off."""
    bits = _bit_string(b)
    zeros = F.length(F.regexp_extract(bits, "^0*", 0))
    suffix = F.substring(bits, zeros + 2, zeros)
    value = F.pow(F.lit(2.0), zeros).cast("long") - 1 + F.coalesce(F.conv(F.when(zeros > 0, suffix), 2, 10).cast("long"), F.lit(0))
    return F.when((zeros <= 31) & (F.length(bits) >= 2 * zeros + 1), value)


def ns(b: Column, n: Column) -> Column:
    """One of n values at the start of the bytes."""
    bits = _bit_string(b)
    w = F.length(F.bin(n))
    short = F.pow(F.lit(2.0), w).cast("long") - n
    v = F.coalesce(F.conv(F.when(w > 1, F.substring(bits, F.lit(1), w - 1)), 2, 10).cast("long"), F.lit(0).cast("long"))
    return F.when(n > 0, F.when(v < short, v).otherwise(2 * v - short + F.substring(bits, w, F.lit(1)).cast("long")))


def fourcc(b: Column) -> Column:
    return F.regexp_replace(F.decode(b, "ISO-8859-1"), r"[^\x20-\x7e]", ".")


def trailing_bits_ok(b: Column) -> Column:
    """Whether a one is among the last 15 bits; of a single byte, among its 8; no bytes are not ok."""
    n = F.length(b)
    two = be_n(F.substring(b, F.greatest(n - 1, F.lit(1)), F.lit(2)), 0, 2)
    return F.when(n >= 2, two.bitwiseAND(F.lit(0x7FFF)) != 0).when(n == 1, be_n(b, 0, 1) != 0).otherwise(F.lit(False))


def floor_log2(x: Column) -> Column:
    return F.length(F.bin(F.greatest(x, F.lit(1)))) - 1


def tile_log2(block: Column, target: Column) -> Column:
    return F.element_at(F.filter(F.sequence(F.lit(0), F.lit(32)), lambda k: (block.cast("decimal(20,0)") * F.pow(F.lit(2.0), k).cast("decimal(20,0)") >= target) | (k == 32)), 1)


def clip3(low: Column | int, high: Column | int, x: Column) -> Column:
    col = lambda v: F.lit(v) if isinstance(v, int) else v
    return F.least(F.greatest(x, col(low)), col(high))


def ceil_div(x: Column, y: int) -> Column:
    return F.floor((x + (y - 1)) / y).cast("long")


def _named(code: Column, names: tuple[str, ...], other: str) -> Column:
    return F.when((code >= 0) & (code < len(names)), F.element_at(F.array(*map(F.lit, names)), (F.least(F.greatest(code, F.lit(0)), F.lit(len(names) - 1)) + 1).cast("int"))).otherwise(other)


def obu_type_name(code: Column) -> Column:
    return _named(code, OBU_NAMES, "reserved")


def tx_size_name(code: Column) -> Column:
    return _named(code, TX_SIZES, "TX_INVALID")


def av1c_struct(b: Column) -> Column:
    """The four bytes of an AV1 configuration record."""
    f = lambda bit, n: bit_field(b, bit, n).cast("int")
    names = (("version", 1, 7), ("profile", 8, 3), ("level_idx_0", 11, 5), ("tier_0", 16, 1), ("high_bitdepth", 17, 1), ("twelve_bit", 18, 1), ("monochrome", 19, 1), ("subsampling_x", 20, 1), ("subsampling_y", 21, 1), ("chroma_sample_position", 22, 2), ("ipd_present", 27, 1))
    return F.struct(*[f(bit, n).alias(k) for k, bit, n in names], F.when(f(27, 1) == 1, f(28, 4)).alias("ipd_minus_one"))


def av1c_bit_depth(c: Column, by_profile: bool = True) -> Column:
    """Twelve bits are for profile 2; without ``by_profile`` the flag alone says so."""
    twelve = c["twelve_bit"] == 1
    return F.when(c["high_bitdepth"] == 0, 8).when((c["profile"] == 2) & twelve if by_profile else twelve, 12).otherwise(10)


def av1c_channels(c: Column) -> Column:
    return F.when(c["monochrome"] == 1, 1).otherwise(3)


def chroma_format(c: Column) -> Column:
    x, y = c["subsampling_x"], c["subsampling_y"]
    return F.when(c["monochrome"] == 1, "YUV400").when((x == 0) & (y == 0), "YUV444").when((x == 1) & (y == 0), "YUV422").when((x == 1) & (y == 1), "YUV420")


def superres_width(width: Column, denom: Column) -> Column:
    return F.floor((width * 8 + F.floor(denom / 2)) / denom).cast("long")


def mi_size(x: Column) -> Column:
    return (F.floor((x + 7) / 8) * 2).cast("long")


def shown_size(upscaled_width: Column, coded_width: Column, coded_height: Column) -> Column:
    """struct(width, height) of the picture that is shown: as wide as before it was coded narrower, where that is known."""
    return F.struct(F.coalesce(upscaled_width, coded_width).alias("width"), coded_height.alias("height"))


def sb_count(mi: Column, use_128: Column) -> Column:
    return F.when(use_128 == 1, ceil_div(mi, 32)).otherwise(ceil_div(mi, 16))


def q_context(base_q_idx: Column) -> Column:
    """Which of four sets of default coefficient distributions a base quantizer takes."""
    return F.when(base_q_idx <= 20, 0).when(base_q_idx <= 60, 1).when(base_q_idx <= 120, 2).otherwise(3)
